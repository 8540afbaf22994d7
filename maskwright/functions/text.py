"""Column functions over text and tokens; they run inside the JVM, but for scoring tokens, which are cut from Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyarrow import RecordBatch
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..storage import ship
from . import segments

#: Main grammar: line-break residue and entities first, then runs of spaces, letters, digits, dots, and any single character.
MAIN = r"<[bB][rR]/?>|&[a-z]{2,3};|&#[0-9]{2,4};|\s+|[\p{L}\p{M}]+|[0-9]+|\.\.+|."
#: Strategies treat words of digits alone apart.
DIGITS = "^[0-9]*$"
PUNCTUATION = r"^[.,:;/+\-*=\\]*$"

#: What ends a sentence of scoring tokens, in the separator before the next token; ``segments`` finds the same in bytes.
SENTENCE_END = r"[.!?][ \t\r]|\n"

# Entities that text carries after markup was stripped.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Numbers that are added up in one go; a long text is pieces of so many pieces of so many numbers.
PIECE = 16


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once for a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column) -> Column:
    """Running totals of an array of one number or more, inside the row: nothing is exchanged, and repeated keys do no harm.

    A total copies those before it, so arrays are cut in pieces, and their sums once more.
    """

    def totals(numbers: Column, start: Column) -> Column:
        return F.aggregate(numbers, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def pieces(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / PIECE).cast("int")), lambda k: F.slice(s, k * PIECE + 1, PIECE))

    def before(p: Column, levels: int) -> Column:
        sums = F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + y))
        return totals(sums, F.lit(0)) if not levels else F.concat(F.array(F.lit(0)), bound(sums, lambda s: bound(pieces(s), lambda q: whole(q, levels - 1))))

    def whole(p: Column, levels: int) -> Column:
        return F.flatten(F.zip_with(p, F.slice(before(p, levels), 1, F.size(p)), lambda x, start: F.slice(totals(x, start), 2, PIECE)))

    return bound(sizes, lambda s: bound(pieces(s), lambda p: whole(p, 1)))


def with_matches(df: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """A row for every match of ``pattern``: ``keep``, ord, match, gap (what lies before it), start, end.

    Offsets are code points and come from running lengths, since positions that
    regular expressions report count UTF-16 units.
    """
    parts = df.select(*keep, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("m"), F.split(text, pattern, -1).alias("g"))
    parts = parts.where(F.size("m") > 0).withColumn("g", F.slice("g", 1, F.size("m")))
    parts = parts.withColumn("e", running(F.zip_with("g", "m", lambda g, m: F.length(g) + F.length(m))))
    rows = parts.select(*keep, F.posexplode(F.arrays_zip("m", "g", "e")).alias("ord", "z"))
    return rows.select(*keep, "ord", F.col("z.m").alias("match"), F.col("z.g").alias("gap"), (F.col("z.e") - F.length("z.m")).alias("start"), F.col("z.e").alias("end"))


#: What a scoring token has, with Spark's types.
_TOKEN = {"sent_idx": "int", "idx": "int", "token": "string", "pre_ws": "string", "post_ws": "string", "start": "int", "end": "int", "case": "int"}
_TYPES = {"int": IntegerType, "string": StringType}


def _cut(df: DataFrame, text: str, keep: tuple[str, ...], columns: tuple[str, ...], most: int, empty: bool) -> DataFrame:
    rows = df.select(*keep, _col(text).cast("string").alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = StructType(kept + [StructField(c, _TYPES[_TOKEN[c]]()) for c in columns])
    names = [f.name for f in kept]
    ship(df.sparkSession)
    return rows.mapInArrow(lambda batches: segments.token_batches(batches, "_text", names, list(columns), most, empty), schema)


def scorer_tokens(df: DataFrame, text: str, *keep: str, columns: tuple[str, ...] = ("idx", "token", "pre_ws", "post_ws", "start", "end")) -> DataFrame:
    """Scoring tokens with their separators: keep, idx, token, pre_ws, post_ws, start, end, or those of them in ``columns``, which may have ``case``, the token's ``case_class``.

    A text of separators alone gives one empty token at its end; the empty text too.
    """
    return _cut(df, text, keep, columns, 1, True)


def scorer_sentences(df: DataFrame, text: str, *keep: str, most: int = 256, columns: tuple[str, ...] = ("token", "pre_ws", "post_ws", "start", "end")) -> DataFrame:
    """Scoring tokens with ``sent_idx``: a sentence ends where a separator has a line break or one of ``.!?`` before a blank, and every ``most`` tokens.

    Numbered inside the row, so a very long text is no long window: keep, sent_idx, tok_idx (that of the text), token, pre_ws, post_ws, start, end, or those of the last five in ``columns``.
    """
    return _cut(df, text, keep, ("sent_idx", "idx", *columns), most, False).withColumnRenamed("idx", "tok_idx")


def scorer_sentence_words(df: DataFrame, text: str, *keep: str, most: int = 256, lists: dict[str, str] | None = None) -> DataFrame:
    """The sentences of ``scorer_sentences`` as rows: keep, sent_idx, words.  Cut inside the row, so nothing is exchanged.

    ``lists``: other lists than the words, as name and what of each token, ``token``, ``idx``, ``pre_ws``, ``post_ws``, ``start`` or ``end``.
    """
    lists = lists or {"words": "token"}
    rows = df.select(*keep, _col(text).cast("string").alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    made = [StructField(name, ArrayType(_TYPES[_TOKEN[c]]())) for name, c in lists.items()]
    names = [f.name for f in kept]
    ship(df.sparkSession)
    return rows.mapInArrow(lambda batches: segments.sentence_batches(batches, "_text", names, lists, most), StructType([*kept, StructField("sent_idx", IntegerType()), *made]))


def sentence_cut(text: str, *keep: str, most: int = 256, lists: dict[str, str] | None = None) -> Callable[[Iterator[RecordBatch]], Iterator[RecordBatch]]:
    """What ``scorer_sentence_words`` does to Arrow batches, for functions that go on with the sentences in the same task."""
    lists = lists or {"words": "token"}
    return lambda batches: segments.sentence_batches(batches, text, list(keep), lists, most)


def rendered(tokens: DataFrame, *keep: str) -> DataFrame:
    """Text rebuilt from scoring tokens."""
    rows = tokens.select(*keep, "idx", F.concat("pre_ws", "token").alias("s"), "post_ws")
    # of what lies behind tokens only the last is part of the text, so it is no part of the lists
    out = rows.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("idx", "s"))).alias("p"), F.max(F.struct("idx", "s", "post_ws")).alias("last"))
    return out.select(*keep, F.concat(F.array_join(F.transform("p", lambda x: x["s"]), ""), F.col("last.post_ws")).alias("text"))


def main_tokens(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Tokens of the main grammar, blanks included: keep, ord, text, start, end, unescaped."""
    rows = with_matches(df, text, MAIN, *keep)
    return rows.select(*keep, "ord", F.col("match").alias("text"), "start", "end", unescape_html("match").alias("unescaped"))


def unescape_html(c: str | Column) -> Column:
    """Line-break markup and entities as the characters they stand for; other text as it is."""
    c = _col(c)
    out = F.when(F.lower(c).isin("<br>", "<br/>"), "\n").when(c.rlike("^&#[0-9]{2,4};$"), F.char(F.regexp_extract(c, "[0-9]+", 0).cast("int")))
    for entity, plain in ENTITIES.items():
        out = out.when(c == entity, plain)
    return out.otherwise(c)


def newlines(c: str | Column) -> Column:
    return F.length(_col(c)) - F.length(F.replace(_col(c), F.lit("\n"), F.lit("")))


def is_bullet(c: str | Column) -> Column:
    c = _col(c)
    return c.startswith("-") | c.startswith("*") | c.startswith(".") | (c == "o") | c.rlike("^[0-9]")


def sentence_starts(tokens: DataFrame, *keep: str) -> DataFrame:
    """``tokens`` (ord, text) with ``sent_start``.

    A sentence starts with the first token, after a token with more than two line
    breaks, at a bullet after a line break, after three dashes, and at a capital
    after a full stop, question or exclamation mark and white space.
    """
    w = W.partitionBy(*keep).orderBy("ord")
    lag = [F.lag("text", k).over(w) for k in (1, 2, 3)]
    text = F.col("text")
    no = F.lit(False)
    rules = [
        lag[0].isNull(),
        (newlines(lag[0]) > 2) & (newlines(text) <= 2),
        (newlines(lag[0]) > 0) & (newlines(text) == 0) & is_bullet(text),
        (lag[0] == "-") & (lag[1] == "-") & (lag[2] == "-") & (text != "-"),
        lag[0].rlike(r"^\s+$") & lag[1].isin(".", "?", "!") & text.rlike(r"^\p{Lu}"),
    ]
    return tokens.withColumn("sent_start", reduce(lambda a, b: a | b, (F.coalesce(r, no) for r in rules)))


def with_sentences(tokens: DataFrame, *keep: str) -> DataFrame:
    """``tokens`` with sent_idx and tok_idx; blank tokens are dropped, and sentences of blanks alone with them."""
    w = W.partitionBy(*keep).orderBy("ord")
    numbered = sentence_starts(tokens, *keep).withColumn("s", F.sum(F.col("sent_start").cast("int")).over(w))
    full = numbered.where(F.trim(F.regexp_replace("unescaped", r"\s+", " ")) != "")
    full = full.withColumn("sent_idx", F.dense_rank().over(W.partitionBy(*keep).orderBy("s")) - 1)
    return full.withColumn("tok_idx", F.row_number().over(W.partitionBy(*keep, "s").orderBy("ord")) - 1).drop("s", "sent_start")


def split_sentences(tokens: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Regroup a flat token stream with sentinels: a sentence closes at ``</s>``; empty and unterminated groups go."""
    w = W.partitionBy(doc).orderBy(order)
    closed = F.coalesce(F.sum((F.col("text") == "</s>").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = tokens.withColumn("grp", closed)
    terminated = F.max((F.col("text") == "</s>").cast("int")).over(W.partitionBy(doc, "grp"))
    full = grouped.withColumn("done", terminated).where((F.col("done") == 1) & ~F.col("text").isin("<s>", "</s>"))
    full = full.withColumn("sent_idx", F.dense_rank().over(W.partitionBy(doc).orderBy("grp")) - 1)
    return full.withColumn("tok_idx", F.row_number().over(W.partitionBy(doc, "grp").orderBy(order)) - 1).drop("grp", "done")


# The classes by number, which is their place in the one-hot vector.
CASE_CLASSES = ("OTHER", "NUMERIC", "MAINLY_NUMERIC", "ALL_LOWER", "ALL_UPPER", "INITIAL_UPPER", "CONTAINS_DIGIT")


def case_class(c: str | Column) -> Column:
    """Class of a token by the look of it, a number from 0 to 6, tests in this order; the empty token is OTHER (0)."""
    c = _col(c)
    digits = F.length(c) - F.length(F.translate(c, "0123456789", ""))
    cased = c.rlike(r"[\p{Ll}\p{Lu}\p{Lt}]")
    return (
        F.when(F.length(c) == 0, 0)
        .when(digits == F.length(c), 1)
        .when(digits > F.length(c) / 2, 2)
        .when((F.lower(c) == c) & cased, 3)
        .when((F.upper(c) == c) & cased, 4)
        .when(c.rlike(r"^\p{Lu}"), 5)
        .when(digits > 0, 6)
        .otherwise(0)
    )


def one_hot(index: str | Column, size: int) -> Column:
    # Spark works out an expression that all elements share once
    return F.array(*((_col(index) == i).cast("int") for i in range(size)))


def case_feature(c: str | Column) -> Column:
    """One-hot of the case class, seven places."""
    return one_hot(case_class(c), 7)


def constant_feature(_: str | Column) -> Column:
    return F.array(F.lit(1))


FEATURES = {"case": case_feature, "useless_one": constant_feature}
FEATURE_SIZES = {"case": 7, "useless_one": 1}


def features(c: str | Column, names: list[str]) -> Column:
    """Concatenated feature vectors of a token; none for no names."""
    return F.concat(*(FEATURES[n](c) for n in names)) if names else F.array().cast("array<int>")


def class_features(case: str | Column, names: list[str]) -> Column:
    """``features`` of a token whose case class is known."""
    return F.concat(*(one_hot(case, 7) if n == "case" else FEATURES[n](case) for n in names)) if names else F.array().cast("array<int>")


def feature_size(names: list[str]) -> int:
    return sum(FEATURE_SIZES[n] for n in names)


def left_padded(sequence: str | Column, size: int, zero: Column) -> Column:
    """Zeros before a sequence up to ``size``; longer ones stay whole."""
    c = _col(sequence)
    return F.concat(F.array_repeat(zero, F.greatest(F.lit(size) - F.size(c), F.lit(0)).cast("int")), c)


def pick(n: Column | int, *keys: Column | str) -> Column:
    """A number below ``n`` from the md5 of the keys: the deterministic stand-in for a random choice."""
    text = F.concat_ws("|", *(_col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def digits_to_zero(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "[0-9]+", "0")
