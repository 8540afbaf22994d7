"""The registered queries: each operator on the driver's tables, with SQL that gives the same rows.

``documents`` has no PHI annotations, so four detectors give gold spans and a
weaker set of the same kind plays the system.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokenizer import rule_tokens
from ..operators import augment, evaluation, labels, lookup, sampling, spans, tags, vectors
from ..schemas import HIPAA_TYPES, PHI_TYPES, label_index, phi_types
from ..sources import sinks
from ..storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GOLD = {
    "EMAIL": "[A-Za-z0-9.]+@[A-Za-z0-9]+[.][a-z.]+",
    "IPADDR": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
    "PHONE": "[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
    "ACCOUNT": "[0-9a-f]{40}",
}
SYSTEM = {
    "EMAIL": "[A-Za-z0-9]+@[A-Za-z0-9]+[.][a-z]+",
    "IPADDR": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,2}",
    "PHONE": "[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
    "ACCOUNT": "[0-9a-f]{38}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _documents(spark, sf_dir)
    return docs, _detected(docs, GOLD), _detected(docs, SYSTEM)


def _detected(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Spans, which are few, found once however often the plan names them."""
    return stored(spans.detect(docs, patterns, {"EMAIL": "@"}), "spans")


# --- SQL building blocks -------------------------------------------------------------------


def _spans_sql(name: str, patterns: dict[str, str]) -> str:
    parts = []
    for kind, p in patterns.items():
        parts.append(
            f"SELECT doc_id, '{kind}' AS tag_type, '{PHI_TYPES[kind]}' AS tag_name, unnest(regexp_extract_all(text, '{p}')) AS m, "
            f"unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS g, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM documents"
        )
    return (
        f"{name}_raw AS ({' UNION ALL '.join(parts)}), {name} AS (SELECT doc_id, tag_type, tag_name, (e - length(m))::INT AS \"start\", e::INT AS \"end\", m AS text FROM "
        f"(SELECT *, sum(length(m) + length(g)) OVER (PARTITION BY doc_id, tag_type ORDER BY i) AS e FROM {name}_raw))"
    )


_SIDES = f"{_spans_sql('gold', GOLD)}, {_spans_sql('sys', SYSTEM)}"
_HIPAA_LIST = ", ".join(f"'{t}'" for t in HIPAA_TYPES)


def _token_units(side: str) -> str:
    return (
        f"SELECT doc_id, tag_type, tag_name, s0 + p - length(m) AS \"start\", s0 + p AS \"end\" FROM (SELECT *, sum(length(m) + length(g)) OVER (PARTITION BY doc_id, tag_type, s0, e0 ORDER BY i) AS p FROM "
        f"(SELECT doc_id, tag_type, tag_name, \"start\" AS s0, \"end\" AS e0, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS m, "
        f"unnest(list_slice(string_split_regex(text, '[A-Za-z0-9]+'), 1, len(regexp_extract_all(text, '[A-Za-z0-9]+')))) AS g, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9]+'), 1) AS i FROM {side}))"
    )


def _variant_rows(which: list[evaluation.Variant], unit: str, source: str, flag: int) -> str:
    rows = []
    for v in which:
        if v.unit != unit or v.fuzzy:
            continue
        cond = ["true"] + ([f"tag_type IN ({_HIPAA_LIST})"] if v.hipaa else []) + ([f"tag_name = '{v.category}'"] if v.category else [])
        key = '"start" || \'|\' || "end"' + ("" if v.binary else " || '|' || tag_type || tag_name")
        rows.append(f"SELECT '{v.name}' AS variant, doc_id, {key} AS key, {flag} AS gold FROM {source} WHERE {' AND '.join(cond)}")
    return " UNION ALL ".join(rows)


def _relaxed(v: evaluation.Variant) -> str:
    cond = f"WHERE tag_type IN ({_HIPAA_LIST})" if v.hipaa else ""
    same = "g.doc_id = s.doc_id AND g.tag_type = s.tag_type AND g.\"start\" = s.\"start\" AND abs(g.\"end\" - s.\"end\") <= 2"
    g, s = (f"(SELECT DISTINCT doc_id, tag_type, \"start\", \"end\" FROM {t} {cond})" for t in ("gold", "sys"))
    return (
        f"SELECT '{v.name}' AS variant, doc_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ("
        f"SELECT s.doc_id, (EXISTS (SELECT 1 FROM {g} g WHERE {same}))::INT AS tp, 1 - (EXISTS (SELECT 1 FROM {g} g WHERE {same}))::INT AS fp, 0 AS fn FROM {s} s "
        f"UNION ALL SELECT g.doc_id, 0, 0, 1 FROM {g} g WHERE NOT EXISTS (SELECT 1 FROM {s} s WHERE {same})) GROUP BY doc_id"
    )


def _counts_sql() -> str:
    which = evaluation.variants()
    units = [_variant_rows(which, u, src, f) for u, src, f in (("tag", "gold", 1), ("tag", "sys", 0), ("token", "gold_tok", 1), ("token", "sys_tok", 0))]
    return (
        f"{_SIDES}, gold_tok AS ({_token_units('gold')}), sys_tok AS ({_token_units('sys')}), units AS ({' UNION ALL '.join(units)}), "
        f"counts AS (SELECT variant, doc_id, sum(g * s) AS tp, sum(s * (1 - g)) AS fp, sum(g * (1 - s)) AS fn FROM "
        f"(SELECT variant, doc_id, key, max(gold) AS g, max(1 - gold) AS s FROM units GROUP BY 1, 2, 3) GROUP BY 1, 2 UNION ALL {' UNION ALL '.join(_relaxed(v) for v in which if v.fuzzy)})"
    )


_ALL = "v AS (SELECT unnest([" + ", ".join(f"'{v.name}'" for v in evaluation.variants()) + "]) AS variant)"
_P, _R = "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0)", "coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0)"
_F1 = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0)"


def _rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- evaluation ------------------------------------------------------------------------------


@query(
    "eval_micro_by_variant",
    f"WITH {_counts_sql()}, {_ALL}, m AS (SELECT variant, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn FROM v LEFT JOIN counts USING (variant) GROUP BY 1), "
    f"r AS (SELECT *, {_P} AS precision, {_R} AS recall FROM m) SELECT variant, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round({_F1}, 9) AS f1 FROM r",
)
def eval_micro_by_variant(spark, sf_dir):
    return _rounded(evaluation.micro(evaluation.counts(*_both(spark, sf_dir))), "precision", "recall", "f1")


@query(
    "eval_macro",
    f"WITH {_counts_sql()}, {_ALL}, n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), e AS (SELECT variant, coalesce({_P}, 0) AS p, coalesce({_R}, 0) AS r FROM v LEFT JOIN counts USING (variant)), "
    "a AS (SELECT variant, sum(p) / max(n) AS precision, sqrt(greatest(sum(p * p) / max(n) - (sum(p) / max(n)) ** 2, 0)) AS precision_sd, sum(r) / max(n) AS recall, "
    "sqrt(greatest(sum(r * r) / max(n) - (sum(r) / max(n)) ** 2, 0)) AS recall_sd FROM e, n GROUP BY variant) "
    f"SELECT variant, round(precision, 7) AS precision, round(precision_sd, 7) AS precision_sd, round(recall, 7) AS recall, round(recall_sd, 7) AS recall_sd, round({_F1}, 7) AS f1 FROM a",
)
def eval_macro(spark, sf_dir):
    docs, gold, system = _both(spark, sf_dir)
    return _rounded(evaluation.macro(evaluation.counts(docs, gold, system), docs), "precision", "precision_sd", "recall", "recall_sd", "f1", places=7)


@query("eval_per_document", f"WITH {_counts_sql()} SELECT variant, doc_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round({_P}, 9) AS precision, round({_R}, 9) AS recall FROM counts")
def eval_per_document(spark, sf_dir):
    return _rounded(evaluation.per_document(evaluation.counts(*_both(spark, sf_dir))), "precision", "recall")


_RELAXED = evaluation.Variant("Relaxed", "tag", fuzzy=True)
_STRICT = evaluation.Variant("Strict", "tag")


@query("eval_relaxed", f"WITH {_SIDES} SELECT variant, doc_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM ({_relaxed(_RELAXED)})")
def eval_relaxed(spark, sf_dir):
    return evaluation.relaxed_counts(*_both(spark, sf_dir), [_RELAXED])


@query(
    "eval_filtered",
    f"WITH {_SIDES}, u AS (SELECT doc_id, \"start\" || '|' || \"end\" || tag_type AS k, 1 AS gold FROM gold WHERE tag_name = 'CONTACT' UNION ALL SELECT doc_id, \"start\" || '|' || \"end\" || tag_type, 0 FROM sys WHERE tag_name = 'CONTACT'), "
    "c AS (SELECT doc_id, k, max(gold) AS g, max(1 - gold) AS s FROM u GROUP BY 1, 2) SELECT 'Strict' AS variant, sum(g * s)::BIGINT AS tp, sum(s * (1 - g))::BIGINT AS fp, sum(g * (1 - s))::BIGINT AS fn FROM c",
)
def eval_filtered(spark, sf_dir):
    user = tags.combined([tags.compile_filter("CONTACT")])
    return evaluation.micro(evaluation.counts(*_both(spark, sf_dir), [evaluation.Variant("Strict", "tag")], user), [evaluation.Variant("Strict", "tag")]).select("variant", "tp", "fp", "fn")


@query("eval_missing_docs", "SELECT missing_in, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'system' ELSE 'gold' END AS missing_in FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id IS NULL) GROUP BY 1")
def eval_missing_docs(spark, sf_dir):
    return evaluation.missing_documents(_documents(spark, sf_dir), table(spark, sf_dir, "labels")).groupBy("missing_in").agg(F.count("*").alias("n"))


@query("document_report", f"WITH {_counts_sql()}, e AS (SELECT doc_id, tp, fp, fn, {_P} AS precision, {_R} AS recall FROM counts WHERE variant = 'Strict'), f AS (SELECT d.doc_id, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, coalesce(fn, 0)::BIGINT AS fn, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN e USING (doc_id)) SELECT doc_id, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round({_F1}, 9) AS f1 FROM f")
def document_report(spark, sf_dir):
    docs, gold, system = _both(spark, sf_dir)
    return _rounded(evaluation.document_report(evaluation.counts(docs, gold, system, [_STRICT]), docs), "precision", "recall", "f1")


@query("text_differences", "WITH b AS (SELECT doc_id, text AS g, regexp_replace(text, '[0-9]', '0', 'g') AS s FROM documents) SELECT doc_id, length(g)::INT AS n_gold, length(s)::INT AS n_system, (length(regexp_extract(g, '^(?s:[^1-9]*)')))::INT AS first_difference FROM b WHERE g <> s")
def text_differences(spark, sf_dir):
    """Gold texts against those of a system that has every digit as 0."""
    docs = _documents(spark, sf_dir)
    return evaluation.text_differences(docs, docs.withColumn("text", F.regexp_replace("text", "[0-9]", "0")))


_COLS = 'doc_id, tag_type, "start", "end", text'


@query("span_diff_report", f"WITH {_SIDES} (SELECT {_COLS}, 'gold' AS side FROM (SELECT {_COLS} FROM gold EXCEPT SELECT {_COLS} FROM sys)) UNION ALL (SELECT {_COLS}, 'system' FROM (SELECT {_COLS} FROM sys EXCEPT SELECT {_COLS} FROM gold))")
def span_diff_report(spark, sf_dir):
    return evaluation.difference_report(*_both(spark, sf_dir)[1:])


# --- segmentation ----------------------------------------------------------------------------

_A = "[A-Za-z0-9]+"
_SCORER = (
    f"t0 AS (SELECT doc_id, text, regexp_extract_all(text, '{_A}') AS m, string_split_regex(text, '{_A}') AS g FROM documents), "
    "t1 AS (SELECT doc_id, CASE WHEN len(m) = 0 THEN [''] ELSE m END AS m, CASE WHEN len(m) = 0 THEN [text, ''] ELSE g END AS g FROM t0), "
    "t2 AS (SELECT doc_id, unnest(m) AS token, unnest(list_slice(g, 1, len(m))) AS pre_ws, unnest(list_slice(g, 2, len(m) + 1)) AS post_ws, generate_subscripts(m, 1) - 1 AS idx FROM t1), "
    "tok AS (SELECT doc_id, idx, token, pre_ws, post_ws, (e - length(token))::INT AS \"start\", e::INT AS \"end\" FROM (SELECT *, sum(length(pre_ws) + length(token)) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM t2))"
)


@query("tokenize_scorer", f"WITH {_SCORER} SELECT doc_id, idx::INT AS idx, token, pre_ws, post_ws, \"start\", \"end\" FROM tok")
def tokenize_scorer(spark, sf_dir):
    return T.scorer_tokens(_documents(spark, sf_dir), "text", "doc_id")


@query("token_roundtrip", "SELECT count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, 0::BIGINT AS n_broken FROM documents")
def token_roundtrip(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    back = T.rendered(T.scorer_tokens(docs, "text", "doc_id"), "doc_id").withColumnRenamed("text", "back")
    both = docs.join(back, "doc_id", "left")
    return both.agg(F.count("*").alias("n_docs"), F.sum(F.length("back")).alias("n_chars"), F.sum((~F.col("text").eqNullSafe(F.col("back"))).cast("long")).alias("n_broken"))


_MAIN_RE = T.MAIN.replace("\\s", "[\\t\\n\\f\\r ]")
_MAIN_SQL = (
    f"w0 AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?s){_MAIN_RE}')) AS text, generate_subscripts(regexp_extract_all(text, '(?s){_MAIN_RE}'), 1) - 1 AS ord FROM conversations), "
    "w1 AS (SELECT *, (sum(length(text)) OVER (PARTITION BY conv_id, turn ORDER BY ord))::INT AS \"end\" FROM w0), "
    "lagged AS (SELECT *, lag(text, 1) OVER o AS l1, lag(text, 2) OVER o AS l2, lag(text, 3) OVER o AS l3 FROM w1 WINDOW o AS (PARTITION BY conv_id, turn ORDER BY ord)), "
    "starts AS (SELECT *, CASE WHEN l1 IS NULL OR (length(l1) - length(replace(l1, chr(10), '')) > 2 AND length(text) - length(replace(text, chr(10), '')) <= 2) "
    "OR (contains(l1, chr(10)) AND NOT contains(text, chr(10)) AND (text LIKE '-%' OR text LIKE '*%' OR text LIKE '.%' OR text = 'o' OR regexp_matches(text, '^[0-9]'))) "
    "OR (l1 = '-' AND l2 = '-' AND l3 = '-' AND text <> '-') OR (regexp_full_match(l1, '[\\t\\n\\f\\r ]+') AND l2 IN ('.', '?', '!') AND regexp_matches(text, '^\\p{Lu}')) THEN 1 ELSE 0 END AS st FROM lagged)"
)


def _turns(spark, sf_dir) -> DataFrame:
    return T.main_tokens(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "conv_id", "turn")


@query("tokenize_main", f"WITH {_MAIN_SQL} SELECT conv_id, turn, count(*) AS n_tokens, sum((trim(text, ' \\t' || chr(10) || chr(12) || chr(13)) <> '')::INT)::BIGINT AS n_words, max(\"end\")::INT AS n_chars FROM w1 GROUP BY 1, 2")
def tokenize_main(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("conv_id", "turn").agg(F.count("*").alias("n_tokens"), F.sum((~F.col("text").rlike(r"^\s+$")).cast("long")).alias("n_words"), F.max("end").alias("n_chars"))


@query("tokenize_rules")
def tokenize_rules(spark, sf_dir):
    """Tokens of every turn by prefixes, suffixes, infixes and exceptions."""
    rows = rule_tokens(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "conv_id", "turn")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\x01")  # a turn's tokens
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_tokens"), F.sum((~F.col("is_space")).cast("long")).alias("n_words"), F.md5(text).alias("tokens"))


@query(
    "sentence_split",
    f"WITH {_MAIN_SQL}, s AS (SELECT *, sum(st) OVER (PARTITION BY conv_id, turn ORDER BY ord) AS sid FROM starts), f AS (SELECT * FROM s WHERE NOT regexp_full_match(text, '[\\t\\n\\f\\r ]+')) "
    "SELECT conv_id, turn, count(DISTINCT sid) AS n_sentences, count(*) AS n_tokens FROM f GROUP BY 1, 2",
)
def sentence_split(spark, sf_dir):
    rows = T.with_sentences(_turns(spark, sf_dir), "conv_id", "turn")
    return rows.groupBy("conv_id", "turn").agg((F.max("sent_idx") + 1).cast("long").alias("n_sentences"), F.count("*").alias("n_tokens"))


@query(
    "html_entities",
    "WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '<[bB][rR]/?>|&[a-z]{2,3};|&#[0-9]{2,4};')) AS m FROM pages) "
    "SELECT m AS entity, CASE WHEN lower(m) IN ('<br>', '<br/>') THEN chr(10) WHEN m = '&lt;' THEN '<' WHEN m = '&gt;' THEN '>' WHEN m = '&amp;' THEN '&' "
    "WHEN m LIKE '&#%' THEN chr(regexp_extract(m, '[0-9]+')::INT) ELSE m END AS plain, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM e GROUP BY 1, 2",
)
def html_entities(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(<[bB][rR]/?>|&[a-z]{2,3};|&#[0-9]{2,4};)"), F.lit(1))).alias("entity"))
    return found.groupBy("entity", T.unescape_html("entity").alias("plain")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query("case_feature_hist", f"WITH {_SCORER}, c AS (SELECT CASE WHEN length(token) = 0 THEN 0 WHEN d = length(token) THEN 1 WHEN d > length(token) / 2 THEN 2 WHEN lower(token) = token AND token ~ '.*[A-Za-z].*' THEN 3 "
       "WHEN upper(token) = token AND token ~ '.*[A-Za-z].*' THEN 4 WHEN token ~ '[A-Z].*' THEN 5 WHEN d > 0 THEN 6 ELSE 0 END AS class FROM (SELECT token, length(regexp_replace(token, '[^0-9]', '', 'g')) AS d FROM tok)) SELECT class::INT AS class, count(*) AS n FROM c GROUP BY 1")  # fmt: skip
def case_feature_hist(spark, sf_dir):
    tokens = T.scorer_tokens(_documents(spark, sf_dir), "text", "doc_id", columns=("token",))
    return tokens.groupBy(T.case_class("token").alias("class")).agg(F.count("*").alias("n"))


@query("feature_vectors", f"WITH {_SCORER} SELECT doc_id, idx::INT AS idx, (length(token) > 0 AND regexp_full_match(token, '[0-9]+'))::INT AS is_number, 1 AS is_one, 8::INT AS size FROM tok")
def feature_vectors(spark, sf_dir):
    # classes are worked out where tokens are cut, so no token leaves the task
    tokens = T.scorer_tokens(_documents(spark, sf_dir), "text", "doc_id", columns=("idx", "case"))
    f = T.class_features("case", ["case", "useless_one"])
    return tokens.select("doc_id", "idx", f.alias("f")).select("doc_id", "idx", F.get("f", F.lit(1)).alias("is_number"), F.get("f", F.lit(7)).alias("is_one"), F.size("f").alias("size"))


# --- alignment, assembly, masking ---------------------------------------------------------------

_BIO = (
    f"{_spans_sql('gold', GOLD)}, {_SCORER}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\", tag_type) AS o FROM gold), "
    "hits AS (SELECT t.doc_id, t.idx, t.\"start\" AS ts, t.\"end\" AS te, g.o, g.tag_type, g.\"start\" AS s, g.\"end\" AS e, row_number() OVER (PARTITION BY t.doc_id, t.idx ORDER BY g.o) AS r "
    "FROM tok t JOIN g ON t.doc_id = g.doc_id AND t.\"start\" < g.\"end\" AND t.\"end\" > g.\"start\" WHERE length(t.token) > 0), "
    "h AS (SELECT *, (ts = s OR (ts >= s AND te <= e) OR ts < s) AS op FROM hits WHERE r = 1), "
    "lab AS (SELECT doc_id, idx, CASE WHEN coalesce(max(op::INT) OVER (PARTITION BY doc_id, o ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'I-' || tag_type WHEN op THEN 'B-' || tag_type ELSE 'O' END AS type FROM h), "
    "bio AS (SELECT t.doc_id, t.idx AS tok_idx, t.token, t.\"start\", t.\"end\", coalesce(l.type, 'O') AS type FROM tok t LEFT JOIN lab l ON t.doc_id = l.doc_id AND t.idx = l.idx WHERE length(t.token) > 0)"
)


def _one_sentence(docs: DataFrame) -> DataFrame:
    """Scoring tokens of documents, one sentence each."""
    rows = T.scorer_tokens(docs, "text", "doc_id", columns=("idx", "token", "start", "end")).where("length(token) > 0")
    return rows.select("doc_id", F.lit(0).alias("sent_idx"), F.col("idx").alias("tok_idx"), F.col("token").alias("text"), "start", "end")


def _bio_tokens(spark, sf_dir, untouched: bool = True) -> DataFrame:
    """Scoring tokens of documents, one sentence each, labelled by the gold detectors; ``untouched``: of those without gold spans too."""
    docs = _documents(spark, sf_dir)
    return spans.labelled_tokens(docs, _detected(docs, GOLD), _one_sentence, untouched)


@query("bio_align", f"WITH {_BIO} SELECT doc_id, tok_idx::INT AS tok_idx, token AS text, \"start\", \"end\", type FROM bio")
def bio_align(spark, sf_dir):
    return _bio_tokens(spark, sf_dir).select("doc_id", "tok_idx", "text", "start", "end", "type")


@query(
    "bio_to_spans",
    f"WITH {_BIO}, k AS (SELECT *, CASE WHEN type <> 'O' THEN substr(type, 3) END AS tag_type FROM bio), p AS (SELECT *, lag(tag_type) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS prev FROM k), "
    "i AS (SELECT *, sum((tag_type IS NOT NULL AND (type LIKE 'B-%' OR prev IS NULL OR prev <> tag_type))::INT) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS sid FROM p) "
    "SELECT doc_id, tag_type, min(\"start\") AS \"start\", max(\"end\") AS \"end\", count(*) AS n_tokens FROM i WHERE tag_type IS NOT NULL GROUP BY doc_id, sid, tag_type",
)
def bio_to_spans(spark, sf_dir):
    """Documents without gold spans have no label to assemble, so their tokens stay out of the windows."""
    return spans.bio_to_spans(_bio_tokens(spark, sf_dir, untouched=False)).select("doc_id", "tag_type", "start", "end", "n_tokens")


_ISLANDS = (
    "u AS (SELECT * FROM gold UNION ALL SELECT * FROM sys), r AS (SELECT *, max(\"end\") OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\", tag_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u), "
    "q AS (SELECT *, sum(CASE WHEN \"start\" <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\", tag_type ROWS UNBOUNDED PRECEDING) AS isl FROM r), "
    "islands AS (SELECT doc_id, isl, min(\"start\") AS \"start\", max(\"end\") AS \"end\", count(*) AS n, arg_min(tag_type, (\"start\", \"end\", tag_type)) AS tag_type FROM q GROUP BY doc_id, isl)"
)


@query("overlap_merge", f"WITH {_SIDES}, {_ISLANDS} SELECT doc_id, \"start\", \"end\", n, tag_type FROM islands")
def overlap_merge(spark, sf_dir):
    _, gold, system = _both(spark, sf_dir)
    return spans.merge_overlaps(gold.unionByName(system), "doc_id")


@query(
    "interval_merge_events",
    "WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 3600 AS e, event_type FROM events), "
    "r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), "
    "q AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e, event_type ROWS UNBOUNDED PRECEDING) AS isl FROM r) "
    "SELECT user_id, min(s) AS \"start\", max(e) AS \"end\", count(*) AS n, arg_min(event_type, (s, e, event_type)) AS tag_type FROM q GROUP BY user_id, isl",
)
def interval_merge_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"), F.col("event_type").alias("tag_type")).withColumn("end", F.col("start") + 3600)
    return spans.merge_overlaps(e, "user_id")


@query(
    "redact_text",
    f"WITH {_SIDES}, {_ISLANDS}, l AS (SELECT i.*, d.text, lag(i.\"end\", 1, 0) OVER (PARTITION BY i.doc_id ORDER BY i.\"start\") AS done, max(i.\"end\") OVER (PARTITION BY i.doc_id) AS z FROM islands i JOIN documents d USING (doc_id)), "
    "m AS (SELECT doc_id, string_agg(substr(text, done::INT + 1, (\"start\" - done)::INT) || '[' || tag_type || ']', '' ORDER BY \"start\") || substr(max(text), max(z)::INT + 1) AS masked FROM l GROUP BY doc_id) "
    "SELECT d.doc_id, md5(coalesce(m.masked, d.text)) AS md5_text, length(coalesce(m.masked, d.text))::INT AS n FROM documents d LEFT JOIN m USING (doc_id)",
)
def redact_text(spark, sf_dir):
    docs, gold, system = _both(spark, sf_dir)
    return spans.masked(docs, gold.unionByName(system)).select("doc_id", F.md5("text").alias("md5_text"), F.length("text").alias("n"))


@query("tag_alignment_check", f"WITH {_SIDES}, u AS (SELECT * FROM gold UNION ALL SELECT * FROM sys) SELECT u.tag_type, count(*) AS n, sum((u.text = substr(d.text, u.\"start\" + 1, u.\"end\" - u.\"start\"))::INT)::BIGINT AS n_aligned FROM u JOIN documents d USING (doc_id) GROUP BY 1")
def tag_alignment_check(spark, sf_dir):
    docs, gold, system = _both(spark, sf_dir)
    rows = spans.alignment(docs, gold.unionByName(system))
    return rows.groupBy("tag_type").agg(F.count("*").alias("n"), F.sum(F.col("aligned").cast("long")).alias("n_aligned"))


_TAGS = "SELECT doc_id, 'P' || (row_number() OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\", tag_type) - 1) AS id, tag_name, tag_type, \"start\", \"end\", text FROM sys"


@query("prediction_tags", f"WITH {_SIDES} {_TAGS}")
def prediction_tags(spark, sf_dir):
    docs, _, system = _both(spark, sf_dir)
    return sinks.prediction_tags(docs, system).select("doc_id", "id", "tag_name", "tag_type", "start", "end", "text")


@query("standoff_dicts", f"WITH {_SIDES} SELECT doc_id, tag_type, \"start\", \"end\", CAST(NULL AS VARCHAR) AS comment FROM sys")
def standoff_dicts(spark, sf_dir):
    return spans.to_dicts(_both(spark, sf_dir)[2], ["tag_type", "start", "end", "comment"])


def _escaped_sql(column: str) -> str:
    for plain, mark in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("chr(34)", "&quot;"), ("chr(10)", "&#10;")):
        column = f"replace({column}, {plain}, '{mark}')"
    return column


_ELEMENT = "'<' || tag_name || ' id=\"' || id || '\" start=\"' || \"start\" || '\" end=\"' || \"end\" || '\" text=\"' || " + _escaped_sql("text") + " || '\" TYPE=\"' || tag_type || '\" comment=\"\"/>'"


@query("tag_xml", f"WITH {_SIDES}, tags AS ({_TAGS}) SELECT doc_id, id, {_ELEMENT} AS xml FROM tags")
def tag_xml(spark, sf_dir):
    docs, _, system = _both(spark, sf_dir)
    return sinks.prediction_tags(docs, system).select("doc_id", "id", sinks.tag_xml().alias("xml"))


@query(
    "prediction_xml",
    f"WITH {_SIDES}, tags AS ({_TAGS}), lists AS (SELECT doc_id, string_agg({_ELEMENT}, chr(10) ORDER BY \"start\", \"end\", {_ELEMENT}) AS body FROM tags GROUP BY 1) "
    "SELECT doc_id, '<?xml version=\"1.0\" encoding=\"UTF-8\" ?>' || chr(10) || '<deIdi2b2>' || chr(10) || '<TEXT><![CDATA[' || replace(text, ']]>', ']]]]><![CDATA[>') || ']]></TEXT>' || chr(10) || '<TAGS>' || chr(10) "
    "|| coalesce(body, '') || chr(10) || '</TAGS>' || chr(10) || '</deIdi2b2>' || chr(10) AS xml FROM documents LEFT JOIN lists USING (doc_id)",
)
def prediction_xml(spark, sf_dir):
    docs, _, system = _both(spark, sf_dir)
    return sinks.to_xml(docs, system)


@query("gold_text_fix", "SELECT d.doc_id, md5(coalesce(g.text, 'x' || d.text)) AS md5_text FROM documents d LEFT JOIN (SELECT doc_id, text FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)) g USING (doc_id)")
def gold_text_fix(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    gold = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return spans.with_gold_text(docs.withColumn("text", F.concat(F.lit("x"), "text")), gold).select("doc_id", F.md5("text").alias("md5_text"))


@query("offset_repair", f"WITH {_SIDES}, n AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\", tag_type) - 1) AS ord, tag_type, \"start\", \"end\" FROM gold) SELECT doc_id, ord::INT AS ord, tag_type, CASE WHEN ord > 1 THEN \"start\" - 4 ELSE \"start\" END::INT AS \"start\", CASE WHEN ord >= 1 THEN \"end\" - 4 ELSE \"end\" END::INT AS \"end\" FROM n")
def offset_repair(spark, sf_dir):
    gold = _both(spark, sf_dir)[1].withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("start", "end", "tag_type")) - 1)
    return spans.shifted_from(gold, 1, -4).select("doc_id", "ord", "tag_type", "start", "end")


@query("span_violations", f"WITH {_SIDES} SELECT doc_id, tag_type, \"start\", \"end\" + 0 AS \"end\", 'type of another category' AS reason FROM sys WHERE tag_type = 'PHONE'")
def span_violations(spark, sf_dir):
    wrong = _both(spark, sf_dir)[2].withColumn("tag_name", F.when(F.col("tag_type") == "PHONE", "ID").otherwise(F.col("tag_name")))
    return spans.violations(wrong).select("doc_id", "tag_type", "start", "end", "reason")


# --- labels and vocabularies -----------------------------------------------------------------

_TYPES = "VALUES " + ", ".join(f"('{t}', '{n}', {str(t in HIPAA_TYPES).lower()})" for t, n in PHI_TYPES.items())


@query("phi_dictionary", f"WITH {_SIDES}, n AS (SELECT tag_type, count(*) AS n FROM gold GROUP BY 1), m AS (SELECT tag_type, count(*) AS m FROM sys GROUP BY 1) SELECT tag_type, tag_name, is_hipaa, coalesce(n, 0)::BIGINT AS n_gold, coalesce(m, 0)::BIGINT AS n_system FROM ({_TYPES}) t(tag_type, tag_name, is_hipaa) LEFT JOIN n USING (tag_type) LEFT JOIN m USING (tag_type)")
def phi_dictionary(spark, sf_dir):
    """Every PHI type with the spans that both sides have of it in all documents."""
    _, gold, system = _both(spark, sf_dir)
    sides = gold.select("tag_type", F.lit(1).alias("g")).unionByName(system.select("tag_type", F.lit(0).alias("g")))
    counts = sides.groupBy("tag_type").agg(F.sum("g").alias("n_gold"), F.sum(1 - F.col("g")).alias("n_system"))
    out = phi_types(spark).join(counts, "tag_type", "left")
    return out.select("tag_type", "tag_name", "is_hipaa", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_gold", "n_system")))


@query("label_index", f"WITH {_BIO}, t AS ({_TYPES}), l AS (SELECT b || '-' || col0 AS label FROM t, (VALUES ('B'), ('I')) p(b)), i AS (SELECT 0 AS ind, 'O' AS label UNION ALL SELECT 1, 'O' UNION ALL SELECT (row_number() OVER (ORDER BY label) + 1)::INT, label FROM l), n AS (SELECT type, count(*) AS n FROM bio GROUP BY 1) SELECT ind, label, CASE WHEN ind = 0 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS n_tokens FROM i LEFT JOIN n ON n.type = i.label")
def label_index_query(spark, sf_dir):
    """Every label with its index and its tokens in all documents; padding has none."""
    counts = _indexed(spark, sf_dir).groupBy("ind").agg(F.count("*").alias("n"))
    return label_index(spark).join(counts, "ind", "left").select("ind", "label", F.coalesce("n", F.lit(0)).alias("n_tokens"))


@query("relabel_hipaa", f"WITH {_BIO} SELECT type, count(*) AS n FROM (SELECT CASE WHEN type <> 'O' AND substr(type, 3) NOT IN ({_HIPAA_LIST}) THEN 'O' ELSE type END AS type FROM bio) GROUP BY 1")
def relabel_hipaa(spark, sf_dir):
    return _bio_tokens(spark, sf_dir).groupBy(labels.relabel_hipaa().alias("type")).agg(F.count("*").alias("n"))


@query("relabel_binary", f"WITH {_BIO} SELECT type, count(*) AS n FROM (SELECT CASE WHEN type = 'O' OR substr(type, 3) NOT IN ({_HIPAA_LIST}) THEN 'O' ELSE left(type, 1) || '-PATIENT' END AS type FROM bio) GROUP BY 1")
def relabel_binary(spark, sf_dir):
    return _bio_tokens(spark, sf_dir).groupBy(labels.relabel_binary(labels.relabel_hipaa()).alias("type")).agg(F.count("*").alias("n"))


_INDEX = f"WITH t AS ({_TYPES}), l AS (SELECT b || '-' || col0 AS label FROM t, (VALUES ('B'), ('I')) p(b)) SELECT 1 AS ind, 'O' AS label UNION ALL SELECT (row_number() OVER (ORDER BY label) + 1)::INT, label FROM l"


def _indexed(spark, sf_dir) -> DataFrame:
    return labels.with_label_index(_bio_tokens(spark, sf_dir), label_index(spark))


@query("label_indices", f"WITH {_BIO}, ix AS ({_INDEX}) SELECT ix.ind, bio.type, count(*) AS n FROM bio JOIN ix ON ix.label = bio.type GROUP BY 1, 2")
def label_indices(spark, sf_dir):
    return _indexed(spark, sf_dir).groupBy("ind", "type").agg(F.count("*").alias("n"))


@query("class_weights", f"WITH {_BIO}, c AS (SELECT count(*)::DOUBLE AS n, sum((type = 'O')::INT)::DOUBLE AS o FROM bio) SELECT i::INT AS ind, round(CASE WHEN i = 0 THEN 0 WHEN i = 1 THEN n / o ELSE n / nullif(n - o, 0) END, 9) AS weight FROM c, range(64) r(i)")
def class_weights(spark, sf_dir):
    return _rounded(labels.class_weights(_indexed(spark, sf_dir), 64), "weight")


@query("label_priors", f"WITH {_BIO} SELECT type AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 12) AS share FROM bio GROUP BY 1")
def label_priors(spark, sf_dir):
    return _rounded(labels.label_priors(_bio_tokens(spark, sf_dir)), "share", places=12)


@query(
    "wordlist_mode",
    f"WITH {_BIO}, c AS (SELECT token AS word, type, count(*) AS n FROM bio GROUP BY 1, 2), v AS (SELECT word, type, n + (type = 'O')::INT AS n FROM c UNION ALL SELECT word, 'O', 1 FROM c GROUP BY word HAVING max((type = 'O')::INT) = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, type <> 'O', type) AS k FROM v) SELECT word, type AS label FROM r WHERE k = 1",
)
def wordlist_mode(spark, sf_dir):
    return labels.word_list_tagger(_bio_tokens(spark, sf_dir))


@query(
    "wordlist_scores",
    f"WITH {_BIO}, c AS (SELECT token AS word, type, count(*) AS n FROM bio WHERE doc_id % 2 = 0 GROUP BY 1, 2), v AS (SELECT word, type, n + (type = 'O')::INT AS n FROM c UNION ALL SELECT word, 'O', 1 FROM c GROUP BY word HAVING max((type = 'O')::INT) = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, type <> 'O', type) AS k FROM v), m AS (SELECT word, type AS predicted FROM r WHERE k = 1) "
    "SELECT bio.type, coalesce(m.predicted, 'O') AS predicted, count(*) AS n FROM bio LEFT JOIN m ON m.word = bio.token WHERE doc_id % 2 = 1 GROUP BY 1, 2",
)
def wordlist_scores(spark, sf_dir):
    """Learned on even documents, used on odd ones: the split is what this query is about."""
    rows = _bio_tokens(spark, sf_dir)
    model = labels.word_list_tagger(rows.where("doc_id % 2 = 0"))
    return labels.predict_word_list(rows.where("doc_id % 2 = 1"), model).groupBy("type", "predicted").agg(F.count("*").alias("n"))


_BENCH_WORDS = "unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))"


def _words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("text"))


@query("vocab", f"SELECT DISTINCT word FROM (SELECT {_BENCH_WORDS} AS word FROM documents)")
def vocab(spark, sf_dir):
    return labels.vocabulary(_words(table(spark, sf_dir, "documents")))


@query("vocab_union", f"SELECT DISTINCT word FROM (SELECT {_BENCH_WORDS} AS word FROM documents UNION ALL SELECT {_BENCH_WORDS} FROM benchmark UNION ALL SELECT {_BENCH_WORDS} FROM conversations)")
def vocab_union(spark, sf_dir):
    return labels.vocabulary(*(_words(table(spark, sf_dir, t)) for t in ("documents", "benchmark", "conversations")))


@query("vocab_difference", f"SELECT DISTINCT word FROM (SELECT {_BENCH_WORDS} AS word FROM benchmark) WHERE word NOT IN (SELECT {_BENCH_WORDS} FROM documents)")
def vocab_difference(spark, sf_dir):
    own, other = (labels.vocabulary(_words(table(spark, sf_dir, t))) for t in ("benchmark", "documents"))
    return own.join(other, "word", "left_anti")


@query(
    "oov_cascade",
    f"WITH b AS (SELECT DISTINCT word FROM (SELECT {_BENCH_WORDS} AS word FROM benchmark)), v AS (SELECT word, (row_number() OVER (ORDER BY word) + 1)::INT AS ind FROM b), d AS (SELECT DISTINCT word FROM (SELECT {_BENCH_WORDS} AS word FROM documents)), "
    "f AS (SELECT word, unnest([word, lower(word), lower(word), regexp_replace(lower(word), '[0-9]', '0', 'g'), regexp_replace(lower(word), '[0-9]+', '0', 'g')]) AS form, unnest([0, 1, 2, 3, 4]) AS pr FROM d), "
    "j AS (SELECT f.word, arg_min(v.ind, pr) AS ind, min(pr) AS pr FROM f JOIN v ON f.form = v.word GROUP BY 1) SELECT coalesce(pr, 5)::INT AS priority, count(*) AS n, sum(coalesce(ind, 1))::BIGINT AS ind_sum FROM d LEFT JOIN j USING (word) GROUP BY 1",
)
def oov_cascade(spark, sf_dir):
    bench = labels.vocabulary(_words(table(spark, sf_dir, "benchmark")))
    index = augment.numbered_words(bench).select("word", (F.col("i") + 2).cast("int").alias("ind"))
    found = labels.word_index(labels.vocabulary(_words(table(spark, sf_dir, "documents"))), index)
    return found.groupBy("priority").agg(F.count("*").alias("n"), F.sum("ind").alias("ind_sum"))


@query("split_leak_guard", "SELECT h AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, md5(text) AS h, doc_id % 2 AS s FROM documents) GROUP BY 1 HAVING count(DISTINCT s) > 1")
def split_leak_guard(spark, sf_dir):
    """Texts that both halves of the documents have."""
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id", (F.col("doc_id") % 2).alias("split"))
    leaks = labels.split_reuse(rows.select(F.col("text_md5").alias("doc_id"), "split")).select(F.col("doc_id").alias("text_md5"))
    return rows.join(leaks, "text_md5", "left_semi").groupBy("text_md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("short_sentences", "SELECT count(*) AS n_sentences, sum(k)::BIGINT AS n_tokens FROM (SELECT conv_id, turn, count(*) AS k FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM conversations) GROUP BY 1, 2) WHERE k < 64")
def short_sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_idx"), F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("text"))
    short = labels.short_sentences(rows)
    return short.groupBy("doc_id", "sent_idx").count().agg(F.count("*").alias("n_sentences"), F.sum("count").alias("n_tokens"))


@query("phi_sentences", f"WITH {_BIO} SELECT doc_id, max((type <> 'O')::INT) = 1 AS has_phi FROM bio GROUP BY 1")
def phi_sentences(spark, sf_dir):
    return labels.phi_sentences(_indexed(spark, sf_dir)).select("doc_id", "has_phi")


# --- vectors -----------------------------------------------------------------------------------

_COS = "list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2]))"
_VEC = "n AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings)"
_QUERY_SET = "vec_id % 100 = 0"


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All vectors, and every hundredth as a query: a stated query set."""
    rows = table(spark, sf_dir, "embeddings")
    every = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return rows.where(_QUERY_SET).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), every


@query("knn_cosine", f"WITH {_VEC}, s AS (SELECT q.id AS query, e.id, {_COS} AS c FROM n q, n e WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM s) SELECT query, rank::INT AS rank, id, round(c, 5) AS similarity FROM r WHERE rank <= 5")
def knn_cosine(spark, sf_dir):
    return _rounded(vectors.top_neighbours(*_vectors(spark, sf_dir), 5), "similarity", places=5)


@query("knn_l2", f"WITH {_VEC}, s AS (SELECT q.id AS query, e.id, sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS c FROM n q, n e WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c, id) AS rank FROM s) SELECT query, rank::INT AS rank, id, round(c, 5) AS similarity FROM r WHERE rank <= 5")
def knn_l2(spark, sf_dir):
    return _rounded(vectors.top_neighbours(*_vectors(spark, sf_dir), 5, "l2"), "similarity", places=5)


@query("cosine_rank", f"WITH {_VEC}, s AS (SELECT q.id AS query, e.id, {_COS} AS c FROM n q, n e WHERE q.id % 100 = 0) SELECT query, id, rank::INT AS rank FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY c DESC) AS rank FROM s)")
def cosine_rank(spark, sf_dir):
    return vectors.cosine_ranks(*_vectors(spark, sf_dir))


@query("nn_similarity_report", f"WITH {_VEC}, s AS (SELECT q.id AS query, e.id, {_COS} AS c FROM n q, n e WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM s) SELECT count(*) AS n, round(avg(c), 6) AS mean_similarity, round(stddev_pop(c), 6) AS sd_similarity FROM r WHERE rank = 2")
def nn_similarity_report(spark, sf_dir):
    found = vectors.closest_other(vectors.top_neighbours(*_vectors(spark, sf_dir), 2))
    return _rounded(vectors.noise_report(found).select("n", "mean_similarity", "sd_similarity"), "mean_similarity", "sd_similarity", places=6)


@query("normalise_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def normalise_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"), F.round(vectors.norm(vectors.normalised("embedding")), 9).alias("unit"))


def _draw(seed: int) -> str:
    """SQL of a normal draw by vec_id and place i."""
    u = [f"(('0x' || substr(md5(vec_id || '|' || i || '|{s}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)" for s in (seed, seed + 1)]
    return f"(sqrt(-2 * ln(1 - {u[0]})) * cos(2 * pi() * {u[1]}))"


_COMPONENTS = "c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _by_component(e: DataFrame, **columns: Column) -> DataFrame:
    """A row for every component of every vector."""
    rows = e.select("vec_id", F.posexplode(F.arrays_zip(*(c.alias(name) for name, c in columns.items()))).alias("i", "z"))
    return rows.select("vec_id", "i", *(F.round(F.col(f"z.{name}"), 7).alias(name) for name in columns))


@query(
    "vector_noise",
    f"WITH {_COMPONENTS} SELECT vec_id, i::INT AS i, round(x + 0.1 * {_draw(1)}, 7) AS additive, round(x * (1 + 0.3 * {_draw(3)}), 7) AS multiplied, "
    "CASE WHEN ('0x' || substr(md5(vec_id || '|' || i || '|2'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 THEN 0.0 ELSE round(x, 7) END AS dropped FROM c",
)
def vector_noise(spark, sf_dir):
    e, key = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    return _by_component(e, additive=vectors.gaussian_noise("embedding", 0.1, 1, key=key), multiplied=vectors.multiplied_noise("embedding", 0.3, 3, key=key), dropped=vectors.dropout("embedding", 0.2, 2, key=key))


@query(
    "augment_vectors",
    f"WITH {_COMPONENTS}, n AS (SELECT vec_id, i, x + 0.1 * {_draw(0)} AS a, 0.5 * {_draw(0)} AS r, 1e-6 * {_draw(0)} AS z FROM c), "
    "l AS (SELECT vec_id, sqrt(sum(a * a)) AS la, sqrt(sum(r * r)) AS lr FROM n GROUP BY vec_id) "
    "SELECT vec_id, i::INT AS i, round(a / la, 7) AS additive_noise, round(r / lr, 7) AS random_embedding, round(z * 1000000, 7) AS zeros FROM n JOIN l USING (vec_id)",
)
def augment_vectors(spark, sf_dir):
    strategies = [augment.parse_strategy(s) for s in ("additive_noise-0.1", "random_embedding-0.5-l2", "zeros")]
    made = {s.name: s.vector("embedding", key=F.col("vec_id")) for s in strategies}
    made["zeros"] = F.transform(made["zeros"], lambda x: x * 1_000_000)
    return _by_component(table(spark, sf_dir, "embeddings"), **made)


# --- augmentation ---------------------------------------------------------------------------------

_PICK = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_NEAR = f"{_VEC}, s AS (SELECT q.id AS query, e.id, {_COS} AS c FROM n q, n e WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM s), opt AS (SELECT query::VARCHAR AS word, list(id::VARCHAR ORDER BY rank) AS options FROM r WHERE rank <= 3 GROUP BY query)"
#: Words that are vector ids, as sentences of ten.
_ID_TOKENS = "tokens AS (SELECT vec_id // 10 AS doc_id, 0 AS sent_idx, (vec_id % 10)::INT AS tok_idx, vec_id::VARCHAR AS text, true AS eligible FROM embeddings)"


def _id_tokens(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    _, every = _vectors(spark, sf_dir)
    near = vectors.top_neighbours(every, every, 3).withColumn("query", F.col("query").cast("string")).withColumn("id", F.col("id").cast("string"))
    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("doc_id"), F.lit(0).alias("sent_idx"), (F.col("vec_id") % 10).cast("int").alias("tok_idx"), F.col("vec_id").cast("string").alias("text"), F.lit(True).alias("eligible")
    )
    return rows, augment.neighbour_words(near, 3)


def _pseudonym_sql(keys: str) -> str:
    return (
        f"WITH {_NEAR.replace(' WHERE q.id % 100 = 0', '')}, {_ID_TOKENS}, a AS (SELECT t.*, alt FROM tokens t, range(2) x(alt) WHERE doc_id IN (SELECT doc_id FROM tokens WHERE eligible)) "
        f"SELECT doc_id, tok_idx, alt::INT AS alt, a.text, CASE WHEN eligible AND options IS NOT NULL THEN options[({_PICK.format(keys)} % len(options) + 1)::INT] ELSE a.text END AS new_text FROM a LEFT JOIN opt ON opt.word = a.text"
    )


@query("pseudonym_neighbors", _pseudonym_sql("concat_ws('|', doc_id, sent_idx, tok_idx, alt, a.text)"))
def pseudonym_neighbors(spark, sf_dir):
    return augment.pseudonyms(*_id_tokens(spark, sf_dir), alternatives=2).select("doc_id", "tok_idx", "alt", "text", "new_text")


@query("pseudonym_consistent", _pseudonym_sql("a.text"))
def pseudonym_consistent(spark, sf_dir):
    return augment.pseudonyms(*_id_tokens(spark, sf_dir), alternatives=2, consistent=True).select("doc_id", "tok_idx", "alt", "text", "new_text")


@query(
    "augment_capped",
    f"WITH {_BIO}, p AS (SELECT doc_id, tok_idx, token AS text, type <> 'O' AND NOT regexp_full_match(token, '[.,:;/+*=-]*') AS eligible FROM bio), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, eligible ORDER BY md5(concat_ws('|', doc_id, 0, tok_idx, 0)), tok_idx) AS r FROM p WHERE doc_id IN (SELECT doc_id FROM p WHERE eligible)) "
    "SELECT doc_id, tok_idx::INT AS tok_idx, text, (eligible AND r <= 2) AS take FROM k",
)
def augment_capped(spark, sf_dir):
    # documents without gold spans have no word to replace, and no version
    rows = _bio_tokens(spark, sf_dir, untouched=False).withColumn("eligible", augment.eligible())
    options = rows.select(F.col("text").alias("word")).distinct().select("word", F.array("word").alias("options"))
    return augment.pseudonyms(rows, options, most=2).select("doc_id", "tok_idx", "text", "take")


@query(
    "random_digits",
    f"WITH v AS (SELECT DISTINCT word FROM (SELECT {_BENCH_WORDS} AS word FROM documents)), g AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i, count(*) OVER () AS n FROM v WHERE regexp_full_match(word, '[0-9]+')) "
    f"SELECT g.word, h.word AS new_word FROM g JOIN g h ON h.i = {_PICK.format('g.word')} % g.n",
)
def random_digits(spark, sf_dir):
    words = labels.vocabulary(_words(table(spark, sf_dir, "documents")))
    return augment.random_digits(words.where(augment.is_digits("word")), words)


# --- lookup and padded sequences ---------------------------------------------------------------------


@query("word_vector_lookup", "SELECT vec_id, (vec_id % 3 <> 0)::INT AS source, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * (1 + (vec_id % 3 = 0)::INT))), 6) AS total FROM embeddings")
def word_vector_lookup(spark, sf_dir):
    """A cache of every third word, whose vectors are doubled to tell them apart, before the whole table."""
    words = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("word"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    cache = words.where("vec_id % 3 = 0").select("word", F.transform("vec", lambda x: x * 2).alias("vec"))
    found = lookup.word_vectors(words.select("vec_id", "word"), cache, words.select("word", "vec"))
    return found.select("vec_id", "source", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("sentence_vectors", "SELECT vec_id // 10 AS doc_id, count(*)::INT AS n, round(sum(embedding[1]::DOUBLE * (1 + vec_id % 10)), 6) AS weighted FROM embeddings GROUP BY 1")
def sentence_vectors(spark, sf_dir):
    """Sentences of ten words that are vector ids; the weights show the order of the rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    tokens = e.select(F.floor(F.col("vec_id") / 10).alias("doc_id"), F.lit(0).alias("sent_idx"), (F.col("vec_id") % 10).cast("int").alias("tok_idx"), "word")
    found = lookup.sentence_matrix(tokens, e.select("word", "vec"))
    weighted = F.aggregate(F.transform("matrix", lambda v, i: F.get(v, F.lit(0)).cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return found.select("doc_id", F.size("matrix").alias("n"), F.round(weighted, 6).alias("weighted"))


_SPLIT = "regexp_extract_all(text, '[^ ]+')"


@query("sentence_cache", f"SELECT item_id, md5(array_to_string({_SPLIT}, ' ')) AS value FROM benchmark")
def sentence_cache(spark, sf_dir):
    """Sentences found in a cache of their own by their words joined with spaces."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("words"))
    cache = rows.select(F.array_join("words", " ").alias("sentence")).distinct().withColumn("value", F.md5("sentence"))
    return lookup.cached_sentences(rows, cache).select("item_id", "value")


@query("padded_sequences", f"WITH w AS (SELECT item_id, {_SPLIT} AS words FROM benchmark) SELECT item_id, len(words)::INT AS n_words, (SELECT max(len(words)) FROM w)::INT AS n_padded, md5(array_to_string(words, ' ')) AS back FROM w")
def padded_sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("words"))
    out = lookup.padded(rows)
    return out.select("item_id", "n_words", F.size("padded").alias("n_padded"), F.md5(F.array_join(lookup.unpadded(), " ")).alias("back"))


@query("chunked_sequences", f"WITH w AS (SELECT doc_id, {_SPLIT} AS words FROM documents), c AS (SELECT doc_id, words, unnest(range((len(words) + 49) // 50)) AS chunk FROM w) SELECT doc_id, chunk::INT AS chunk, len(words[chunk * 50 + 1 : chunk * 50 + 50])::INT AS n, md5(array_to_string(words[chunk * 50 + 1 : chunk * 50 + 50], ' ')) AS words FROM c")
def chunked_sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("words"))
    return lookup.chunked(rows, 50).select("doc_id", "chunk", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("words"))


@query("unpadded_vectors", "SELECT vec_id, 3 AS n_rows, 3 AS n_predictions, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def unpadded_vectors(spark, sf_dir):
    """Three vectors behind two of zeros, cut back."""
    zero = F.transform("embedding", lambda x: x * 0)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(zero, zero, "embedding", "embedding", "embedding").alias("m"), F.array(*(F.lit(k) for k in range(5))).alias("p"))
    matrix, predictions = lookup.unpadded_matrix("m", "p")
    return rows.select("vec_id", F.size(matrix).alias("n_rows"), F.size(predictions).alias("n_predictions"), F.round(F.get(F.get(matrix, F.lit(0)), F.lit(0)).cast("double"), 6).alias("first"))


@query("sentence_sizes", f"WITH {_BIO}, n AS (SELECT doc_id, count(*) AS n FROM bio GROUP BY 1) SELECT count(*) AS n_documents, count(*) AS n_sentences, sum(n)::BIGINT AS n_tokens, max(n) AS max_length FROM n")
def sentence_sizes(spark, sf_dir):
    return labels.sentence_sizes(_bio_tokens(spark, sf_dir))


@query(
    "token_places",
    f"WITH {_SIDES}, gold_tok AS ({_token_units('gold')}), {_SCORER} SELECT g.doc_id, g.tag_type, g.\"start\"::INT AS \"start\", g.\"end\"::INT AS \"end\", t.idx::INT AS place FROM gold_tok g LEFT JOIN tok t ON t.doc_id = g.doc_id AND t.\"start\" = g.\"start\" AND t.\"end\" = g.\"end\"",
)
def token_places(spark, sf_dir):
    docs, gold, _ = _both(spark, sf_dir)
    return evaluation.token_places(docs, gold).select("doc_id", "tag_type", "start", "end", "place")


@query(
    "span_subsequences",
    f"WITH {_SIDES}, gold_tok AS ({_token_units('gold')}), sys_tok AS ({_token_units('sys')}) SELECT s.doc_id, s.tag_type, bool_and(EXISTS (SELECT 1 FROM gold_tok g WHERE g.doc_id = s.doc_id AND g.tag_type = s.tag_type AND g.\"start\" = s.\"start\" AND g.\"end\" = s.\"end\")) AS subsequence FROM sys_tok s GROUP BY 1, 2",
)
def span_subsequences(spark, sf_dir):
    docs, gold, system = _both(spark, sf_dir)
    return evaluation.subsequences(evaluation.span_tokens(docs, system), evaluation.span_tokens(docs, gold), "doc_id", "tag_type")


# --- batches, splits, pairs ---------------------------------------------------------------------

_ORDERED = "o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|0'), doc_id) - 1 AS n FROM documents)"


@query("epoch_batches", f"WITH {_ORDERED} SELECT doc_id, n // 32 AS batch, n % 32 AS place FROM o")
def epoch_batches(spark, sf_dir):
    return sampling.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32)


_ALTS = "alts AS (SELECT conv_id AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS alt, text FROM conversations)"


def _alternatives(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as sentences, turns of the conversation with the same number as alternatives."""
    turns = table(spark, sf_dir, "conversations").withColumn("alt", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    return _documents(spark, sf_dir).withColumnRenamed("doc_id", "id"), turns.select(F.col("conv_id").alias("id"), "alt", "text")


_PICKED = f"c AS (SELECT id, count(*) AS n FROM alts GROUP BY 1), p AS (SELECT d.doc_id AS id, d.text AS re, a.text AS fa FROM documents d JOIN c ON c.id = d.doc_id JOIN alts a ON a.id = c.id AND a.alt = {_PICK.format(chr(39).join(['concat_ws(', '|', ', d.doc_id, ', '0', ')']))} % c.n)"


@query("batches_with_features", f"WITH {_ORDERED} SELECT doc_id, n // 32 AS batch, n % 32 AS place, quality FROM o LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def batches_with_features(spark, sf_dir):
    extra = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return sampling.batches_with_features(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", extra, 32)


@query(
    "combined_batches",
    f"WITH {_ALTS}, {_PICKED}, {_ORDERED} SELECT doc_id AS id, n // 32 AS batch, n % 32 AS place, 'main' AS side, quality, NULL AS same, NULL AS \"left\", NULL AS \"right\" FROM o LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) "
    "UNION ALL SELECT id, n // 32, n % 32, 'pair', NULL, same, md5(re), md5(CASE same WHEN 1 THEN re ELSE fa END) FROM o JOIN p ON p.id = o.doc_id, (VALUES (0), (1)) s(same)",
)
def combined_batches(spark, sf_dir):
    """Every document once with its label, and beside it the pairs of its batch, real and fake."""
    extra = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs, alts = _alternatives(spark, sf_dir)
    out = sampling.combined_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", extra, 32, docs, alts)
    return out.select("id", "batch", "place", "side", "quality", "same", F.md5("left").alias("left"), F.md5("right").alias("right"))


@query(
    "alternating_batches",
    f"WITH {_ALTS}, {_PICKED}, {_ORDERED}, a AS (SELECT doc_id AS id, n // 16 AS batch, NULL AS same FROM o), b AS (SELECT id, n // 32 AS batch, same FROM o JOIN p ON p.id = o.doc_id, (VALUES (0), (1)) s(same)), "
    "z AS (SELECT least((SELECT max(batch) FROM a), (SELECT max(batch) FROM b)) AS z) SELECT id, batch * 2 AS step, 0 AS stream, same FROM a, z WHERE batch <= z UNION ALL SELECT id, batch * 2 + 1, 1, same FROM b, z WHERE batch <= z",
)
def alternating_batches(spark, sf_dir):
    """Batches of 16 documents and batches of pairs in turn, until one stream ends."""
    docs, alts = _alternatives(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").select("doc_id")
    main = sampling.batches(rows, "doc_id", 16).withColumnRenamed("doc_id", "id")
    pairs = sampling.adversary_batches(rows, "doc_id", 32, docs, alts)
    return sampling.alternating_steps(main, pairs).select("id", "step", "stream", "same")


@query("epoch_batches_whole", f"WITH {_ORDERED} SELECT doc_id, n // 32 AS batch, n % 32 AS place FROM o WHERE n < (SELECT count(*) // 32 * 32 FROM o)")
def epoch_batches_whole(spark, sf_dir):
    return sampling.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32, keep_tail=False)


# sizes are int(1.1^i) while below 20, and 20 from the 32nd batch on
_SIZES = "z0 AS (SELECT i, least(floor(1.1 ** i), 20)::BIGINT AS size FROM range(33) r(i)), z AS (SELECT i, size, sum(size) OVER (ORDER BY i) - size AS first, i = 32 AS last FROM z0)"


@query("compounding_batches", f"WITH {_ORDERED}, {_SIZES} SELECT doc_id, (i + CASE WHEN last THEN (n - first) // size ELSE 0 END)::INT AS batch, ((n - first) % size)::BIGINT AS place FROM o JOIN z ON n >= first AND (last OR n < first + size)")
def compounding_batches(spark, sf_dir):
    sizes = sampling.compounding_sizes(spark, 1, 20, 1.1)
    return sampling.growing_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", sizes)


@query(
    "stratified_batches",
    "WITH l AS (SELECT doc_id, coalesce(toxic = 1, false) AS positive FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY md5(doc_id || '|0'), doc_id) - 1 AS n FROM l), "
    "m AS (SELECT least(sum(positive::INT), sum((NOT positive)::INT)) AS least FROM l) SELECT doc_id, positive, (n // 3)::BIGINT AS batch FROM r, m WHERE n < least",
)
def stratified_batches(spark, sf_dir):
    return sampling.stratified_batches(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", F.col("toxic") == 1, 6).select("doc_id", "positive", "batch")


@query("train_valid_split", f"WITH {_ORDERED}, c AS (SELECT least(greatest(floor(0.5 * count(*)), 2), count(*)) AS size FROM o) SELECT doc_id, CASE WHEN n < greatest(1, floor(0.2 * size)) THEN 'validation' ELSE 'train' END AS split FROM o, c WHERE n < size")
def train_valid_split(spark, sf_dir):
    return sampling.split_train_validation(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.5, 0.2)


@query("pair_real_fake", f"WITH {_ALTS}, {_PICKED} SELECT id, md5(re) AS \"left\", md5(re) AS \"right\", 1 AS same FROM p UNION ALL SELECT id, md5(re), md5(fa), 0 FROM p")
def pair_real_fake(spark, sf_dir):
    return sampling.real_fake_pairs(*_alternatives(spark, sf_dir)).select("id", F.md5("left").alias("left"), F.md5("right").alias("right"), "same")


@query("single_real_fake", f"WITH {_ALTS}, {_PICKED} SELECT id, md5(re) AS text, 1 AS \"real\" FROM p UNION ALL SELECT id, md5(fa), 0 FROM p")
def single_real_fake(spark, sf_dir):
    return sampling.real_fake_singles(*_alternatives(spark, sf_dir)).select("id", F.md5("text").alias("text"), "real")


@query("triple_mtn", f"WITH {_ALTS}, {_PICKED}, f AS (SELECT id, text FROM alts WHERE alt = 0) SELECT p.id, md5(f.text) AS \"left\", md5(re) AS \"right\", 1 AS same FROM p JOIN f USING (id) UNION ALL SELECT p.id, md5(f.text), md5(fa), 0 FROM p JOIN f USING (id)")
def triple_mtn(spark, sf_dir):
    docs, alts = _alternatives(spark, sf_dir)
    return sampling.augmented_triples(docs, alts, alts).select("id", F.md5("left").alias("left"), F.md5("right").alias("right"), "same")


@query("train_with_augmented", f"WITH {_ALTS}, l AS (SELECT doc_id AS id, quality AS label FROM labels) SELECT d.doc_id AS id, -1 AS alt, l.label FROM documents d JOIN l ON l.id = d.doc_id UNION ALL SELECT a.id, a.alt, l.label FROM alts a JOIN l USING (id) JOIN documents d ON d.doc_id = a.id")
def train_with_augmented(spark, sf_dir):
    docs, alts = _alternatives(spark, sf_dir)
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return sampling.with_augmented(docs.join(known, "id"), alts).select("id", "alt", "label")


@query("chosen_alternative", f"WITH {_ALTS}, c AS (SELECT id, count(*) AS n FROM alts GROUP BY 1) SELECT id, ({_PICK.format(chr(39).join(['concat_ws(', '|', ', id, 3)']))} % (n + 1) - 1)::INT AS alt FROM c")
def chosen_alternative(spark, sf_dir):
    alts = _alternatives(spark, sf_dir)[1].groupBy("id").agg(F.count("*").alias("n_alternatives"))
    return sampling.chosen_alternative(alts, epoch=3)


@query("sampled_words", f"WITH b AS (SELECT DISTINCT word FROM (SELECT {_BENCH_WORDS} AS word FROM benchmark)), d AS (SELECT DISTINCT word FROM (SELECT {_BENCH_WORDS} AS word FROM documents)) SELECT word FROM d WHERE length(word) > 2 AND NOT regexp_matches(word, '[0-9]') AND word IN (SELECT word FROM b) ORDER BY md5(word || '|0'), word LIMIT 1000")
def sampled_words(spark, sf_dir):
    """A thousand sampled words: the number is the operator's."""
    own, known = (labels.vocabulary(_words(table(spark, sf_dir, t))) for t in ("documents", "benchmark"))
    return sampling.sampled_words(own, known)


@query("limited_documents", "SELECT doc_id, length(text)::INT AS n FROM documents ORDER BY doc_id LIMIT 10")
def limited_documents(spark, sf_dir):
    """The document limit of test runs: the first ten by id."""
    return sampling.limited_documents(_documents(spark, sf_dir), 10).select("doc_id", F.length("text").alias("n"))


# --- clinical tags -----------------------------------------------------------------------------------

#: What numbers in documents stand for: lists that a number's parts pick from.  Some values are not allowed, for the validator to find.
_RISK_NAMES = list(tags.CLINICAL)
_RISK_VALUES: dict[str, list[str | None]] = {
    "time": ["before DCT", "during dct", "After DCT", "continuing", None, "sometimes"],
    "indicator": ["mention", "A1C", "high bp", None, "present", "bmi", "mentioned"],
    "status": ["current", "past", None, "Never", "now"],
    "type1": ["statin", "metformin", "aspirin", None, "Insulin", "water"],
    "type2": ["metformin", None, "statin"],
}
_KEY_SQL = "concat_ws('|', lower(tag_name), lower(coalesce(time, '')), lower(coalesce(indicator, '')), lower(coalesce(status, '')), greatest(lower(coalesce(type1, '')), lower(coalesce(type2, ''))), least(lower(coalesce(type1, '')), lower(coalesce(type2, ''))))"


def _risk_sql() -> str:
    """Every number of every document as a clinical tag: its last six digits pick name and attributes; numbers of one digit have no place."""
    lists = {"tag_name": _RISK_NAMES, **_RISK_VALUES}
    picks, by = [], 1
    for name, values in lists.items():
        picks.append(f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][v // {by} % {len(values)} + 1] AS {name}")
        by *= len(values)
    return (
        "risk_raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS m, unnest(list_slice(string_split_regex(text, '[0-9]+'), 1, len(regexp_extract_all(text, '[0-9]+')))) AS g, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) AS i FROM documents), "
        "risk_at AS (SELECT *, sum(length(m) + length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS e, right(m, 6)::INT AS v FROM risk_raw), "
        f"risk AS MATERIALIZED (SELECT doc_id, CASE WHEN length(m) = 1 THEN -1 ELSE e - length(m) END AS \"start\", CASE WHEN length(m) = 1 THEN -1 ELSE e END AS \"end\", {', '.join(picks)} FROM risk_at)"
    )


_RISK_SQL = _risk_sql()


def _risk(spark, sf_dir) -> DataFrame:
    rows = T.with_matches(_documents(spark, sf_dir), "text", "[0-9]+", "doc_id").withColumn("v", F.right("match", F.lit(6)).cast("int"))
    picks, by = {}, 1
    for name, values in {"tag_name": _RISK_NAMES, **_RISK_VALUES}.items():
        picks[name] = F.get(F.array(*(F.lit(v) for v in values)), (F.floor(F.col("v") / by) % len(values)).cast("int"))
        by *= len(values)
    alone = F.length("match") == 1
    return rows.select("doc_id", F.when(alone, -1).otherwise(F.col("start")).alias("start"), F.when(alone, -1).otherwise(F.col("end")).alias("end"), *(c.alias(n) for n, c in picks.items()))


@query("doc_level_tags", f"WITH {_RISK_SQL}, k AS (SELECT doc_id, {_KEY_SQL} AS key, count(*) AS n FROM risk GROUP BY 1, 2) SELECT doc_id, key, n, 'DOC' || (row_number() OVER (PARTITION BY doc_id ORDER BY key) - 1) AS id FROM k")
def doc_level_tags(spark, sf_dir):
    return tags.document_tags(_risk(spark, sf_dir)).select("doc_id", "key", "n", "id")


@query("filter_algebra", f"WITH {_RISK_SQL} SELECT 'any' AS kind, count(*) AS n FROM risk WHERE lower(coalesce(time, '')) = 'before dct' OR lower(tag_name) = 'cad' UNION ALL SELECT 'all', count(*) FROM risk WHERE lower(coalesce(time, '')) = 'before dct' AND lower(tag_name) = 'medication' UNION ALL SELECT 'not any', count(*) FROM risk WHERE NOT (lower(coalesce(time, '')) = 'before dct' OR lower(tag_name) = 'cad')")
def filter_algebra(spark, sf_dir):
    rows = _risk(spark, sf_dir)
    before, cad, drug = (tags.compile_filter(v) for v in ("before DCT", "CAD", "medication"))
    kinds: list[tuple[str, Column]] = [("any", tags.combined([before, cad])), ("all", tags.combined([before, drug], conjunctive=True)), ("not any", tags.combined([before, cad], invert=True))]
    counts = rows.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in kinds))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k, _ in kinds))).alias("z")).select("z.*")


@query("family_history", f"WITH {_RISK_SQL} SELECT doc_id, coalesce(indicator, CASE WHEN \"start\" <> -1 AND \"end\" <> -1 THEN 'present' ELSE 'not present' END) AS indicator FROM risk WHERE tag_name = 'FAMILY_HIST'")
def family_history(spark, sf_dir):
    return _risk(spark, sf_dir).where("tag_name = 'FAMILY_HIST'").select("doc_id", tags.family_history_default().alias("indicator"))


def _violations_sql() -> str:
    rules = []
    for name, spec in tags.CLINICAL.items():
        for attribute, values in spec.items():
            for a in ("type1", "type2") if attribute == "type1" else (attribute,):
                rules.append(f"SELECT doc_id, tag_name, '{a}' AS attribute, {a} AS value FROM risk WHERE tag_name = '{name}' AND {a} IS NOT NULL AND lower({a}) NOT IN ({', '.join(repr(v) for v in values)})")
    return " UNION ALL ".join(rules)


@query("clinical_violations", f"WITH {_RISK_SQL} {_violations_sql()}")
def clinical_violations(spark, sf_dir):
    return tags.clinical_violations(_risk(spark, sf_dir))


@query("cardiac_risk_eval", f"WITH {_RISK_SQL}, g AS (SELECT DISTINCT doc_id, {_KEY_SQL} AS k FROM risk), s AS (SELECT DISTINCT doc_id, {_KEY_SQL} AS k FROM risk WHERE tag_name <> 'CAD') SELECT g.doc_id, count(s.k) AS tp, 0::BIGINT AS fp, count(*) - count(s.k) AS fn FROM g LEFT JOIN s ON g.doc_id = s.doc_id AND g.k = s.k GROUP BY 1")
def cardiac_risk_eval(spark, sf_dir):
    gold = _risk(spark, sf_dir)
    return tags.cardiac_counts(gold.select("doc_id").distinct(), gold, gold.where("tag_name <> 'CAD'"))


