"""The main tokeniser by rules: white space, then prefixes and suffixes stripped to a fixed point, then infixes.

A stretch without white space is ``prefixes core suffixes``, with the shortest core that
leaves nothing to strip; stripping stops at an exception, which stays whole or comes
apart as listed.  What is left of the core is cut at infixes, and between a digit and
a letter.  All of it is regular expressions over short strings and runs in the JVM;
entities of markup are tokens of their own from the start.

Spaces: one blank after a token belongs to it and is no token; any other white space is.

Defined cases: null and empty texts have no token; offsets are code points; repeated
ids do no harm, since nothing is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound, running, unescape_html

ENTITY = r"<[bB][rR]/?>|&[a-z]{2,3};|&#[0-9]{2,4};"
_QUOTES = "\"'`“”‘’„«»"
_PREFIX = rf"\.\.+|[\[\](){{}}<>*_#&§%=~^+|@!?;:,…{_QUOTES}$£€¥\-–—/\\]"
_UNIT = "km|cm|mm|kg|mg|ml|dl|lb|lbs|oz|hz|khz|mhz|ghz|kb|mb|gb|tb|mph|°[CFK]?|%|[$£€¥]"
_SUFFIX = rf"['’][sS]|\.\.+|(?<=[0-9])(?:{_UNIT})(?![A-Za-z])|(?<=[a-z0-9%²\-)\]+{_QUOTES}])\.|(?<=[A-Z][A-Z])\.|[\[\](){{}}<>*_#&§%=~^+|@!?;:,…{_QUOTES}$£€¥\-–—/\\]"
_INFIX = r"\.\.+|…|[!&:;#,()/_\-\^~%{}='<>@]|(?<=[a-z])\.(?=[A-Z])|(?<=[0-9])[+*](?=[0-9\-])|[–—]"

# Abbreviations that keep their full stop, and words that come apart before their last part.
ABBREVIATIONS = (
    "a.m.", "p.m.", "Adm.", "Bros.", "Co.", "Corp.", "D.C.", "Dr.", "e.g.", "E.g.", "E.G.", "Gen.", "Gov.", "i.e.", "I.e.", "I.E.", "Inc.", "Jr.", "Ltd.", "Md.", "Messrs.",
    "Mo.", "Mont.", "Mr.", "Mrs.", "Ms.", "Ph.D.", "Prof.", "Rep.", "Rev.", "Sen.", "Sr.", "St.", "vs.", "v.s.", "etc.", "U.S.", "U.K.", "Jan.", "Feb.", "Mar.", "Apr.", "Jun.",
    "Jul.", "Aug.", "Sep.", "Sept.", "Oct.", "Nov.", "Dec.",
)
NEGATED = ("ai", "are", "ca", "could", "did", "does", "do", "had", "has", "have", "is", "might", "must", "need", "sha", "should", "was", "were", "wo", "would")
SUBJECTS = ("i", "you", "he", "she", "it", "we", "they", "who", "what", "where", "when", "why", "how", "that", "there", "this")
ENDINGS = ("m", "re", "ve", "ll", "d", "s")

_NEGATION = rf"(?:(?i:{'|'.join(NEGATED)})[nN]['’][tT])"
_SUBJECT = rf"(?:(?i:{'|'.join(SUBJECTS)})['’](?i:{'|'.join(ENDINGS)}))"
_ABBREVIATION = "(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")"
_EXCEPTION = rf"(?:{_ABBREVIATION}|{_NEGATION}|{_SUBJECT})"
# repeated groups are possessive, which Java works off without recursion: stretches may be very long
_CHUNK = rf"{ENTITY}|\s+|(?:[^\s<&]++|(?!{ENTITY})[<&])++"
# most stretches: a word or a number, alone or with one sign behind it; no rule cuts the word or number
_WORD = r"^(?:[A-Za-z]+|[0-9]+)$"
_WORD_AND_SIGN = r"^(?:[A-Za-z]+[,;:!?]|[A-Za-z]*[a-z]\.)$"
_INSIDE = rf"(?:(?!{_INFIX})(?![0-9][A-Za-z])(?s:.))"
#: A run up to an infix, or up to a digit that a letter follows, with that digit.
_RUN = rf"{_INSIDE}*+(?!{_INFIX})[0-9](?=[A-Za-z])|{_INSIDE}++"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def pieces(chunk: str | Column) -> Column:
    """Tokens of a stretch without white space, as an array."""
    c = F.col(chunk) if isinstance(chunk, str) else chunk
    around = rf"^((?:{_PREFIX})*+)({_EXCEPTION})((?:{_SUFFIX})*+)$"
    plain = rf"(?s)^((?:{_PREFIX})*+)(.*?)((?:{_SUFFIX})*+)$"
    has = c.rlike(around)
    part = lambda k: F.when(has, F.regexp_extract(c, around, k)).otherwise(F.regexp_extract(c, plain, k))
    core = part(2)
    whole = (
        F.when(core == "", F.array().cast("array<string>"))
        .when(has & core.rlike(f"^{_NEGATION}$"), F.array(F.left(core, F.length(core) - 3), F.right(core, F.lit(3))))
        .when(has & core.rlike(f"^{_SUBJECT}$"), F.array(F.regexp_extract(core, r"^([^'’]*)", 1), F.regexp_extract(core, r"(['’].*)$", 1)))
        .when(has, F.array(core))
        .otherwise(_all(core, f"{_INFIX}|{_RUN}"))
    )
    # suffixes look at what is before them, so they are found again behind the last character of the core
    behind = F.when(part(3) == "", F.array().cast("array<string>")).otherwise(_suffixes(F.right(F.concat(part(1), core), F.lit(2)), part(3)))
    return F.concat(_all(part(1), _PREFIX), whole, behind)


def _suffixes(before: Column, tail: Column) -> Column:
    """The suffixes that ``tail`` is made of; ``before`` are the two characters before it, which some of them look at."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))

    def behind(found: Column) -> Column:
        # at most two of those found lie in ``before``
        more = total(found) - F.length(tail)
        first, second = F.length(F.get(found, F.lit(0))), F.length(F.get(found, F.lit(1)))
        skip = F.when(more == 0, 0).when(more == first, 1).when(more == first + second, 2)
        return F.when(skip.isNotNull(), F.slice(found, skip + 1, F.size(found))).otherwise(_all(tail, f"{_SUFFIX}|(?s:.)"))

    return bound(_all(F.concat(before, tail), _SUFFIX), behind)


def rule_tokens(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, ord, text, start, end, unescaped, is_space of every token; ``ord`` ascends with the text."""
    # stretches leave nothing between them, so their lengths alone say where they are
    parts = df.select(*keep, _all(F.col(text), _CHUNK).alias("m")).where(F.size("m") > 0).withColumn("e", running(F.transform("m", lambda x: F.length(x))))
    chunks = parts.select(*keep, F.explode(F.arrays_zip("m", "e")).alias("z")).select(*keep, F.col("z.m").alias("match"), (F.col("z.e") - F.length("z.m")).alias("start"))
    match = F.col("match")
    blank = match.rlike(r"^\s+$")
    rest = F.when((F.col("start") > 0) & match.startswith(" "), F.substring(match, F.lit(2), F.length(match))).otherwise(match)
    one = lambda t, e: F.struct(t.alias("p"), e.cast("int").alias("e"))  # noqa: E731  a token and where it ends
    whole, before = F.array(one(match, F.length(match))), F.length(match) - 1
    some = bound(pieces(match), lambda p: F.when(F.size(p) > 0, F.zip_with(p, running(F.transform(p, lambda x: F.length(x))), one)))
    parts = (
        F.when(blank, F.when(rest != "", F.array(one(rest, F.length(rest)))))
        .when(match.rlike(_WORD), whole)
        .when(match.rlike(_WORD_AND_SIGN) & ~match.isin(*ABBREVIATIONS), F.array(one(F.left(match, before), before), one(F.right(match, F.lit(1)), before + 1)))
        .when(match.rlike(f"^(?:{ENTITY})$"), whole)
        .otherwise(some)
    )
    # nothing but the explosion names the tokens: a condition on them would work them out once more
    rows = chunks.select(*keep, "start", (F.length("match") - F.length(rest)).alias("skip"), blank.alias("is_space"), F.explode(parts).alias("z"))
    end = F.col("start") + F.when(F.col("is_space"), F.col("skip")).otherwise(0) + F.col("z.e")
    rows = rows.select(*keep, F.col("z.p").alias("text"), end.alias("end"), "is_space").withColumn("start", F.col("end") - F.length("text"))
    return rows.select(*keep, F.col("start").alias("ord"), "text", "start", "end", unescape_html("text").alias("unescaped"), "is_space")
