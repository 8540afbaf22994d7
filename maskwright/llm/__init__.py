"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  ``llm.queries`` registers one
``opN_<name>`` query per operator; ``corpus_pipeline.py`` chains five of them.
"""
