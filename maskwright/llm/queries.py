"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bloom_lm import op10_bloom_lm
from .conversation_repair import OP12_SQL, op12_conversation_repair
from .decontamination import OP6_SQL, op6_decontamination
from .langid import op3_language
from .lexical_search import OP11_SQL, op11_lexical_search
from .multi_index import op4_multi_index
from .packing import op7_packing
from .parity_join import op9_parity_join
from .prefix_forest import op13_prefix_forest
from .quality import op1_quality
from .secret_scan import op5_secrets
from .token_files import op2_token_files
from .toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_files": op2_token_files,
    "op3_language": op3_language,
    "op4_multi_index": op4_multi_index,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_parity_join": op9_parity_join,
    "op10_bloom_lm": op10_bloom_lm,
    "op11_lexical_search": op11_lexical_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_forest": op13_prefix_forest,
}

ORACLE_SQL: dict[str, str] = {"op6_decontamination": OP6_SQL, "op11_lexical_search": OP11_SQL, "op12_conversation_repair": OP12_SQL}
