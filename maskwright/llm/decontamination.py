"""Benchmark decontamination by template windows, in DataFrame functions alone.

Texts are brought into template form: words in lower case, with typed
placeholders for numbers (``#``), for units after a number (``~``) and for names
(``@``: words that start with a capital inside a sentence).  Every window of
``WINDOW`` tokens is hashed, and document windows are hash-joined with benchmark
windows; so a question still matches when its numbers, units and names have
been exchanged.  Matched windows without placeholders count as they are; those
with placeholders count only if the *slots* agree: along one alignment, equal
values in the benchmark must stand for equal values in the document.  A document
is contaminated by an item if at least ``MIN_SHARE`` of the item's windows count.

Matches are aggregated by (document, item), so a passage that many documents
share is many small groups.  The benchmark's windows are broadcast only if they
are at most ``BROADCAST_WINDOWS``; else the join is shuffled.

Defined cases: null and empty texts, and texts or items shorter than a window,
match nothing; documents with equal ids count as one; rows with a null id are
not reported; several items with equal windows each match; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

WINDOW = 8
MIN_SHARE = 0.5
BROADCAST_WINDOWS = 2_000_000
BROADCAST_IDS = 1_000_000
# Units that are placeholders after a number.
UNITS = (
    "%", "km", "m", "cm", "mm", "mi", "ft", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml", "h", "hr", "hrs", "s", "ms", "mph", "kmh",
    "hour", "hours", "minute", "minutes", "min", "second", "seconds", "sec", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "meter", "meters", "metre", "metres", "mile", "miles", "foot", "feet", "inch", "inches", "gram", "grams", "pound", "pounds", "liter", "liters",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees",
)
_NAME = r"(\p{Lu})(?<=[\p{L}\p{N},;:] \p{Lu})(?=\p{Ll})"
_TOKEN = r"@?\p{L}+|[0-9]+(?:[.,:/][0-9]+)*|%"


def with_tokens(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``tokens``: raw tokens in lower case, names marked by ``@``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(*keep, F.regexp_extract_all(F.lower(F.regexp_replace(text, _NAME, "@$1")), F.lit(_TOKEN), F.lit(0)).alias("tokens"))


def _template(token: Column, place: Column, tokens: Column) -> Column:
    """A raw token's template form.  Below 'a' are the signs: %, then digits, then @."""
    number_before = (place > 0) & F.get(tokens, place - 1).between("0", "9~")
    return (
        F.when(token.isin(*UNITS) & number_before, "~")
        .when(token >= "a", token)
        .when(token.between("0", "9~"), "#")
        .when(token.startswith("@"), "@")
        .otherwise(token)
    )


def with_windows(df: DataFrame, *keep: str) -> DataFrame:
    """``keep``, and ``windows``: the hash of the window at every place, by doubling its width."""
    assert WINDOW == 8  # three doublings
    out = with_tokens(df, *keep).withColumn("w", F.transform("tokens", lambda t, i: F.xxhash64(_template(t, i, F.col("tokens")))))
    for step in (1, 2, 4):
        out = out.select(*keep, F.zip_with("w", F.slice("w", step + 1, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.xxhash64(a, b)).alias("w"))
    return out.select(*keep, F.when(F.size("w") >= WINDOW, F.slice("w", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0)))).alias("windows"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, item_id, ipos, plain, n_windows) of every window of every item."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.groupBy("item_id").agg(F.max("text").alias("text"))
    tokens = with_tokens(items, "item_id", "text").withColumn("slot", F.transform("tokens", lambda t, i: _template(t, i, F.col("tokens")) != t))
    slots = tokens.select("item_id", "text", "slot")
    rows = with_windows(slots, "item_id", "slot").select("item_id", "slot", F.size("windows").alias("n_windows"), F.posexplode_outer("windows").alias("ipos", "hash")).where("hash is not null")
    plain = ~F.exists(F.slice("slot", F.col("ipos") + 1, F.lit(WINDOW)), lambda s: s)
    return rows.select("hash", "item_id", "ipos", plain.alias("plain"), "n_windows")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, ipos, shift, plain, n_windows): windows of documents that are windows of items."""
    known = stored(benchmark_windows(benchmark), "benchmark")
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    # the outer form: else a filter on the arrays' sizes would work them out once more
    found = with_windows(texts, "doc_id").select("doc_id", F.posexplode_outer("windows").alias("pos", "hash")).join(known, "hash")
    return found.select("doc_id", "item_id", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"), "plain", "n_windows").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_plain, share of every contaminated pair."""
    found = stored(matches(docs, benchmark), "matches")
    enough = found.groupBy("doc_id", "item_id").agg(F.countDistinct("ipos").alias("n"), F.max("n_windows").alias("t")).where(F.col("n") >= min_share * F.col("t"))
    slotted = found.where("not plain").join(enough, ["doc_id", "item_id"], "left_semi")
    if not slotted.isEmpty():
        broken = _broken(docs, benchmark, slotted)
        found = found.join(broken.withColumn("broken", F.lit(True)), ["doc_id", "item_id", "shift"], "left").where("plain or broken is null")
    places = found.groupBy("doc_id", "item_id", "ipos").agg(F.max("plain").alias("plain"), F.max("n_windows").alias("n_windows"))
    pairs = places.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").cast("long").alias("n_windows"), F.count("*").alias("n_matched"), F.sum(F.col("plain").cast("long")).alias("n_plain")
    )
    return pairs.withColumn("share", F.col("n_matched") / F.col("n_windows")).where(F.col("share") >= min_share)


def _broken(docs: DataFrame, benchmark: DataFrame, slotted: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift) of alignments where one value of the item stands for two of the document."""
    at = slotted.select("doc_id", "item_id", "shift", F.explode(F.sequence(F.col("ipos"), F.col("ipos") + (WINDOW - 1))).alias("ipos")).distinct()
    ids = slotted.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id").agg(F.max("text").alias("text"))
    template = F.transform("tokens", lambda t, i: _template(t, i, F.col("tokens")))
    values = with_tokens(items, "item_id").select("item_id", "tokens", template.alias("kinds")).select("item_id", F.posexplode_outer(F.arrays_zip("tokens", "kinds")).alias("ipos", "z"))
    values = values.where("z.tokens <> z.kinds").select("item_id", "ipos", F.col("z.tokens").alias("value"), F.col("z.kinds").alias("kind"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    own = with_tokens(texts, "doc_id").select("doc_id", F.posexplode_outer("tokens").alias("pos", "own"))
    both = at.join(values, ["item_id", "ipos"]).withColumn("pos", F.col("ipos") + F.col("shift")).join(own, ["doc_id", "pos"])
    return both.groupBy("doc_id", "item_id", "shift", "kind", "value").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select("doc_id", "item_id", "shift").distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` without the contaminated ones, all columns."""
    bad = stored(contaminated(docs, benchmark, min_share).select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    if bad.count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (document, benchmark item) pairs where the document holds the item."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)
# The same in SQL: windows as strings, names marked in two passes since RE2 has no look-behind.
OP6_SQL = rf"""
WITH raw AS (
  SELECT 0 AS side, doc_id AS id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 1, item_id, coalesce(max(text), '') FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id
), marked AS (
  SELECT side, id, regexp_extract_all(lower(regexp_replace(regexp_replace(text,
    '([\p{{L}}\p{{N}},;:] )(\p{{Lu}}\p{{Ll}})', '\1@\2', 'g'), '([\p{{L}}\p{{N}},;:] )(\p{{Lu}}\p{{Ll}})', '\1@\2', 'g')),
    '@?\p{{L}}+|[0-9]+(?:[.,:/][0-9]+)*|%') AS tokens FROM raw
), flat AS (
  SELECT side, id, row_number() OVER () AS r, tokens FROM marked
), words AS (
  SELECT side, id, r, unnest(tokens) AS w, generate_subscripts(tokens, 1) - 1 AS p FROM flat
), kinds AS (
  SELECT *, CASE WHEN w IN ({_UNIT_LIST}) AND regexp_matches(lag(w) OVER (PARTITION BY side, r ORDER BY p), '^[0-9]') THEN '~'
    WHEN regexp_matches(w, '^[0-9]') THEN '#' WHEN w LIKE '@%' THEN '@' ELSE w END AS k FROM words
), wins AS (
  SELECT side, id, r, p, string_agg(k, ' ') OVER v AS win, max((k <> w)::int) OVER v AS slot, count(*) OVER v AS n FROM kinds
  WINDOW v AS (PARTITION BY side, r ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), items AS (
  SELECT id AS item_id, p AS ipos, win, slot, count(*) OVER (PARTITION BY id) AS t FROM wins WHERE side = 1 AND n = 8
), found AS (
  SELECT DISTINCT d.r, d.id AS doc_id, i.item_id, i.ipos, d.p - i.ipos AS shift, i.slot, i.t FROM wins d JOIN items i USING (win) WHERE d.side = 0 AND d.n = 8
), broken AS (
  SELECT DISTINCT doc_id, item_id, shift FROM (
    SELECT f.doc_id, f.item_id, f.shift, iw.k, iw.w FROM (SELECT DISTINCT r, doc_id, item_id, shift, unnest(range(ipos, ipos + 8)) AS tp FROM found WHERE slot = 1) f
    JOIN kinds iw ON iw.side = 1 AND iw.id = f.item_id AND iw.p = f.tp AND iw.k <> iw.w
    JOIN kinds dw ON dw.side = 0 AND dw.r = f.r AND dw.p = f.tp + f.shift
    GROUP BY f.doc_id, f.item_id, f.shift, iw.k, iw.w HAVING min(dw.w) <> max(dw.w))
), places AS (
  SELECT doc_id, item_id, ipos, min(slot) AS slot, max(t) AS t FROM found ANTI JOIN (SELECT doc_id, item_id, shift, 1 AS slot FROM broken) b USING (doc_id, item_id, shift, slot)
  GROUP BY doc_id, item_id, ipos
)
SELECT doc_id, item_id, max(t)::BIGINT AS n_windows, count(*)::BIGINT AS n_matched, sum(1 - slot)::BIGINT AS n_plain, count(*) / max(t) AS share
FROM places GROUP BY doc_id, item_id HAVING count(*) / max(t) >= {MIN_SHARE}
"""
