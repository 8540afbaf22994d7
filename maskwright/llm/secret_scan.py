"""Secret scans: fixed patterns, and guess costs of values in a credential context.

Base spans come from three patterns (``assign``, ``access``, ``hex``).  The
method adds ``guess`` spans: every value that follows a credential word is scored,
whether or not a base span covers it, and is a span where the cheapest way to guess
it costs at least ``MIN_LOG10_GUESSES``.  The cost is a dynamic program over the value: segments are dictionary words, dates, repeats,
keyboard walks and brute-force stretches, and the product of their guesses is
made as small as possible.  So ``password: sunshine2019`` is cheap and no
secret, ``password is xK93..`` is one.

Word ranks are those of the corpus: words are counted once for each distinct text,
without values in a credential context; those of the most texts are kept - all
of a count or none, ``DICTIONARY_WORDS`` at most - after a fixed list of common
passwords.

Offsets are code points, ends exclusive.  Defined cases: null text is empty and
has no span; values of any length are scored whole; repeated ids are scanned
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, least_tasks, most_frequent, stored, texts_of, worker_memory

KINDS = ("assign", "access", "hex", "guess")
# The base patterns, and how long a match must be to count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # AKIA[A-Z0-9]+ of 18 or more
HEX = re.compile(r"[0-9a-f]{16,}")  # [0-9a-f]+ of 16 or more

#: Words after which a value counts as a credential, and the value itself.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|auth(?:orization)?|bearer|login|(?:api|access|private|secret)[_-]?key)"""
    r"""["']?[ \t]*(?:is\b|:=|=>|[:=])[ \t]*["']?([^\s"'<>]{8,})""",
    re.I | re.A,
)
#: Every match of CONTEXT or ASSIGN holds one of these in some case.
_CUES = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "login", "key")
MIN_LOG10_GUESSES = 10.0
DICTIONARY_WORDS = 20_000
LONGEST_WORD = 32
# Common passwords, most common first.
COMMON = (
    "password 123456 12345678 qwerty abc123 letmein monkey dragon master login princess welcome admin iloveyou sunshine football "
    "shadow superman secret changeme default root guest test example user token key pass access system service account"
).split()
# Rows of a keyboard.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: key -> neighbour -> direction of the step: along the row, or to a row beside it.
_NEXT: dict[str, dict[str, tuple[int, int]]] = {}
for _r, _row in enumerate(KEYBOARD):
    for _c, _key in enumerate(_row):
        _steps = [(0, -1), (0, 1), *((d, e) for d in (-1, 1) for e in (-1, 0, 1))]
        _NEXT[_key] = {KEYBOARD[_r + d][_c + e]: (d, e) for d, e in _steps if 0 <= _r + d < len(KEYBOARD) and 0 <= _c + e < len(KEYBOARD[_r + d])}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d)")
_LEET = str.maketrans("@430157$", "aaeoists")


def _alphabet(c: str) -> float:
    """log10 of the guesses for one more character by brute force."""
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


def log10_guesses(value: str, ranks: dict[str, int], min_word: int = 3) -> float:
    """Least log10 of guesses over all segmentations of ``value``.

    Every segment costs the log10 of its own guesses; to the sum comes what it
    takes to try the kinds of segments, half a digit for each after the first.
    """
    n = len(value)
    low = value.lower()
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    brute = math.inf  # least cost of what ends in an open brute-force stretch
    # lengths by their start: of keyboard walks, and of what repeats after 1 to 4 characters
    step = [_NEXT.get(low[i], {}).get(low[i + 1]) for i in range(n - 1)]
    turned = list(itertools.accumulate((a != b for a, b in zip(step, step[1:], strict=False)), initial=0))  # turns before each step
    walk = [0] * (n + 1)
    same = {unit: [0] * (n + 1) for unit in (1, 2, 3, 4)}
    for i in range(n - 1, -1, -1):
        walk[i] = walk[i + 1] + 1 if i + 1 < n and step[i] else 1
        for unit, length in same.items():
            length[i] = length[i + 1] + 1 if i + unit < n and value[i] == value[i + unit] else 0
    turn = 0.5
    for i in range(n):
        here = best[i] + (turn if i else 0.0)
        brute = min(brute, here) + _alphabet(value[i])  # one character more by brute force
        best[i + 1] = min(best[i + 1], brute)
        for size in range(min_word, min(LONGEST_WORD, n - i) + 1):
            rank = ranks.get(low[i : i + size])
            extra = 0.0
            if rank is None and (rank := ranks.get(plain[i : i + size])) is not None:
                extra = 1.0  # signs for letters
            if rank is not None:
                piece = value[i : i + size]
                extra += 0.0 if piece.islower() else 0.3 if piece[0].isupper() and piece[1:].islower() or piece.isupper() else 1.0
                best[i + size] = min(best[i + size], here + math.log10(rank + 1) + extra)
        for unit, length in same.items():  # a short unit again and again
            size = unit + length[i] // unit * unit
            if size >= 2 * unit and size > (2 if unit == 1 else 4):
                best[i + size] = min(best[i + size], here + sum(map(_alphabet, value[i : i + unit])) + math.log10(size / unit))
        if walk[i] >= 4:
            best[i + walk[i]] = min(best[i + walk[i]], here + math.log10(47 * walk[i]) + 0.66 * (1 + turned[i + walk[i] - 2] - turned[i]))
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            best[m.end()] = min(best[m.end()], here + (2.0 if m.end() - i == 4 else 4.6))
    return best[n]


def _cued(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in _CUES)


def spans_of(text: str, ranks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start and then kind as listed."""
    cued = _cued(text)
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE] if cued else []
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text) if cued else ():
        start, end = m.span(1)
        end = start + len(m[1].rstrip(".,;:!?)]}"))
        if end - start >= 8 and log10_guesses(text[start:end], ranks) >= MIN_LOG10_GUESSES:
            found.append(("guess", start, end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


#: Words that a counting task gathers and that a worker remembers; text hashes that may be broadcast, 8 bytes each.
TASK_WORDS, CACHE_WORDS, BROADCAST_HASHES = 300_000, 300_000, 1_000_000


class _Words(dict):
    """What stands between spaces -> the word it is, in lower case, or nothing."""

    def __missing__(self, piece: str) -> str:
        if len(self) >= CACHE_WORDS:
            self.clear()
        word = piece.strip(".,;:!?\"'()").lower()
        value = self[piece] = word if 3 <= len(word) <= LONGEST_WORD and word.isalpha() else ""
        return value


def word_ranks(docs: DataFrame, most: int = DICTIONARY_WORDS) -> dict[str, int]:
    """Rank of each dictionary word, from 1: common passwords, then the corpus's words of the most texts, ``most`` at most.

    Equal texts count once, however many copies there are.  Values in a credential
    context and of base spans are left out, so a secret is no word of its own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = worker_memory("words of secrets", _Words), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if _cued(text):
                    for pattern in (CONTEXT, ASSIGN):
                        text = pattern.sub(_without_value, text)
                seen.update({words[piece] for piece in set(HEX.sub(" ", text).split())})
                if len(seen) > TASK_WORDS:
                    yield from _counted(seen)
                    seen.clear()
        yield from _counted(seen)

    bounded_batches(docs.sparkSession)
    texts = texts_of(docs).select("text", F.xxhash64("text").alias("h")).where("text <> ''")
    # copies: a row for each text and task is exchanged, and texts alone that do repeat
    tasks = least_tasks(docs.sparkSession)
    repeated = stored(texts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h").coalesce(tasks), "repeated")
    if repeated.count() <= BROADCAST_HASHES:
        repeated = F.broadcast(repeated)
    once = texts.join(repeated, "h", "left_anti").select("text")
    copies = texts.join(repeated, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")).select("text")
    counted = once.unionByName(copies).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = most_frequent(stored(counted.where("n > 1").coalesce(tasks), "words"), most).collect()  # at most `most` words
    ranks = {w: k + 1 for k, w in enumerate(COMMON)}
    for k, row in enumerate(sorted(top, key=lambda r: (-r["n"], r["word"]))):
        ranks.setdefault(row["word"], len(COMMON) + k + 1)
    return ranks


def _counted(seen: Counter) -> Iterator[pa.RecordBatch]:
    seen.pop("", None)
    words = list(seen)
    for lo in range(0, len(words), 20_000):
        part = words[lo : lo + 20_000]
        yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), "n": pa.array([seen[w] for w in part], pa.int64())})


def _without_value(m: re.Match) -> str:
    """A match with a sign, which no pattern takes, for its value, the last group."""
    return m[0][: m.start(m.lastindex) - m.start()] + "\x01 "


def scan(docs: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # DICTIONARY_WORDS words at most
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t, own)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, kind)})

    return texts_of(docs).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redact(docs: DataFrame, ranks: dict[str, int], mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars``, if there, counted anew.  Null texts stay null."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("string")
    def cleaned(texts):
        own = shared.value

        def one(text):
            if text is None:
                return None
            spans, out, at = spans_of(text, own), [], 0
            for _, start, end in spans:
                if end <= at:
                    continue
                out.append(text[at:start] if start > at else "")
                if start >= at:
                    out.append(mark)
                at = end
            return "".join(out) + text[at:] if spans else text

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", cleaned(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``: counts by kind, a digest of the base spans, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, word_ranks(docs))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text(of(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(of("guess")).cast("long").alias("n_guess"),
    )
