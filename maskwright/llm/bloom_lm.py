"""Language-model scoring with log-frequency Bloom filters.

The model is a bigram model.  Unigram and bigram counts are taken over all
training documents, quantised to levels (a count c has level 1 + floor(log2 c))
and kept in Bloom filters: a key with level q is present as (key, 1) .. (key, q).
A filter answers a count by probing levels upwards until one is absent, so an
error only ever raises a count.  Probabilities are smoothed towards the unigram:

    P(w | h) = (real(h, w) * low(h w) + MU * P(w)) / ((1 + d) high(h) + (1 + d)^2 F(h) + MU)
    P(w) = (low(w) + 1) / ((1 + d) N + V + 1)

where low and high are the least and the greatest count of a level.  Without errors of the
filter real = 1, d = F = 0, and for every history h the probabilities of all words add up to
at most 1.  The filter does err, and among V words even a rare error is many, so what it
tells is weighed by how often it errs, which is measured from the bits that are set:

* e, the share of absent keys that it takes for seen; d, the share by which it raises counts
  on average, since each further level is told wrongly as often as an absent key of that level;
* real(h, w) = prior / (prior + (1 - prior) e), the chance that a bigram it has was seen
  indeed, with prior = min(1, LIFT * high(h) * P(w));
* F(h) = e * (sum of real(h, w) over all words), what words never seen after h may bring in,
  exact from the number of words of each level.

So the probabilities add up to at most 1 through the filter as it is, however large V is; a
test adds them up.  LIFT shifts belief between rare and frequent words and leaves the sum alone.

Every worker loads the filters from the shared folder, so they pass through no
driver.  Their size grows with the number of distinct n-grams;
one segment never exceeds ``FILTER_BYTES``.  Beyond one the texts are still passed once:
each portion of them sends the keys of its bigrams, with the levels of their words, to the
tasks that hold the keys' ranges, a few MB each, and gets sums by text back.  Levels of words
then come from a filter of words alone, which has fewer bits a level beyond ``FILTER_BYTES``.

Words and bigrams are counted in one pass: each task merges what it counts (up to
``MERGE`` bigram keys and ``WORDS`` words at a time) and writes it to the shared folder;
words are added up from there, and bigrams are exchanged by key range, so a word or
bigram that makes up much of the corpus arrives as a few rows from each task.

The base score uses exact unigram counts: those of the most frequent words, at
most ``HEAD_WORDS``, go to every worker by 64-bit hash; others are joined by word.

Tokens: words (what lies between ASCII white space) with A-Z in lower case, then
one end, which is counted as a token.

Defined cases: null text is empty (its only token is the end); without training
documents N = V = 0 and every token has probability 1; repeated ids are scored
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, delete_path, give_back, in_portions, mix, release, remainder, scratch_path, stored, texts_of, worker_memory

END = b""  # no word is empty
MU = 600.0
#: Bits for each level of a key, probes for the first level and for each further one, and the most bytes of one filter.
BITS_PER_LEVEL, FIRST_PROBES, PROBES, FILTER_BYTES = 14, 9, 4, 128 << 20
#: How many times more probable than by chance a pair of words is before the filter is asked.
LIFT = 100.0
#: Exact counts that every worker holds, 16 bytes each.
HEAD_WORDS = 6_000_000
#: Bigram keys a counting task merges before it hands them on; words a counting task holds at once; bytes of text handled at once.
MERGE, WORDS, PORTION = 2_000_000, 300_000, 2_000_000
RANGES = 1024
_U = np.uint64
_BIT = (1 << np.arange(8)).astype(np.uint8)
#: Keys that are probed at once: what is worked out for them stays near the processor.
PROBED = 8192
_STEP, _LOW, _ALL = 0xD1B54A32D192ED03, 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF
#: Bytes of a row group of what is tallied: a task holds one in memory while it writes.
TALLY_GROUP = 16 << 20
#: One in so many bigram keys is counted one by one, to size the filters.
SHARE = 1024


_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END_HASH = _U(xxhash.xxh64_intdigest(END))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """xxh64 of each of the words ``data[s:e]``, all words of one length at once; those of 32 bytes or more one by one."""
    out = np.empty(len(s), _U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight, four = (np.ndarray((len(data) + 1,), t, padded, strides=(1,)) for t in ("<u8", "<u4"))
    sizes = np.minimum(e - s, 32).astype(np.uint8)
    order = np.argsort(sizes, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(sizes, minlength=33))])
    for n in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[n] : cuts[n + 1]]
        if n == 32:
            out[own] = [xxhash.xxh64_intdigest(data[a:b].tobytes()) for a, b in zip(s[own].tolist(), e[own].tolist(), strict=True)]
            continue
        at = s[own]
        h = np.full(len(own), _P5 + _U(n))
        for k in range(0, n - 7, 8):
            h ^= _turned(eight[at + k] * _P2, 31) * _P1
            h = _turned(h, 27) * _P1 + _P4
        if n & 4:
            h ^= four[at + (n & 24)].astype(_U) * _P1
            h = _turned(h, 23) * _P2 + _P3
        for k in range(n & 28, n):
            h ^= padded[at + k].astype(_U) * _P5
            h = _turned(h, 11) * _P1
        h ^= h >> _U(33)
        h *= _P2
        h ^= h >> _U(29)
        h *= _P3
        out[own] = h ^ (h >> _U(32))
    return out


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array without nulls and where each string begins, and the last ends."""
    strings = strings.cast(pa.large_string())
    bounds = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def hashes_of(strings: pa.Array) -> np.ndarray:
    """xxh64 of every string."""
    data, bounds = _bytes_of(strings)
    return word_hashes(data, bounds[:-1], bounds[1:])


class Tokens:
    """The tokens of some texts, one text after the other: ``sizes`` by text, ``hashes``, and where they lie in ``data``."""

    def __init__(self, texts: pa.Array):
        data, bounds = _bytes_of(texts)
        self.data = _LOWER[data]
        inside = ~_SPACE[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        full = bounds[1:] > bounds[:-1]
        for marks, at in ((opens, bounds[:-1][full]), (closes, bounds[1:][full] - 1)):
            marks[at] = inside[at]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.sizes = np.diff(np.searchsorted(s, bounds)) + 1
        self.last = np.cumsum(self.sizes) - 1  # the end of each text
        word = np.ones(len(s) + len(self.sizes), bool)
        word[self.last] = False
        self.hashes = np.full(len(word), _END_HASH)
        self.hashes[word] = word_hashes(self.data, s, e)
        self.s, self.e = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        self.s[word], self.e[word] = s, e

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def words(self, at: np.ndarray) -> pa.Array:
        """Tokens ``at`` as strings."""
        sizes = self.e[at] - self.s[at]
        ends = np.cumsum(sizes)
        place = np.repeat(self.s[at] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(self.data[place])]).cast(pa.string())


def bigram_keys(uni: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it, the end before the first, from the tokens' hashes."""
    before = np.empty_like(uni)
    before[1:] = uni[:-1]
    ends = np.cumsum(sizes)
    before[ends - sizes] = uni[ends - 1]  # a text's last token is the end
    return mix(before * _U(0x9E3779B97F4A7C15) + uni)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def level(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def least_count(levels: np.ndarray) -> np.ndarray:
    """The least count of a level, 0 for level 0."""
    return np.where(levels <= 0, 0.0, 2.0 ** (levels - 1.0))


def greatest_count(levels: np.ndarray) -> np.ndarray:
    return 2.0**levels - 1.0


_LOW_OF, _HIGH_OF = least_count(np.arange(64)), greatest_count(np.arange(64))


class Belief:
    """What the levels that a filter tells are worth: tables by the levels of history and word.

    ``by_level`` is the number of words of each level, ``false_first`` and ``false_more`` the
    filter's error at the first and at each further level.
    """

    def __init__(self, n_all: int, by_level: dict[int, int], false_first: float, false_more: float):
        raised = 1 + false_more / (1 - 2 * min(false_more, 0.4))  # false levels double what they add each time
        self.smoothed = (_LOW_OF + 1) / (raised * n_all + sum(by_level.values()) + 1)
        prior = np.minimum(1.0, LIFT * _HIGH_OF[:, None] * self.smoothed[None, :])
        self.real = prior / np.maximum(prior + (1 - prior) * false_first, 1e-300)
        words = np.array([by_level.get(q, 0) for q in range(len(_LOW_OF))], float)
        self.divisor = raised * _HIGH_OF + raised**2 * false_first * (self.real @ words) + MU
        self.divisor[0] = MU  # after a word never seen no bigram counts

    def probabilities(self, bigram: np.ndarray, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        """P(w | h) from the levels of h w, h and w."""
        # a bigram cannot have been seen more often than its history
        seen = np.minimum(_LOW_OF[bigram], _HIGH_OF[history]) * self.real[history, word]
        return (seen + MU * self.smoothed[word]) / self.divisor[history]


def probes(q: int) -> int:
    return FIRST_PROBES if q == 1 else PROBES


class LogBloom:
    """A log-frequency Bloom filter in blocks: a key's bits lie in the range of blocks that its top bits name."""

    def __init__(self, bits: np.ndarray, ranges: int, first: int = 0):
        # bits: uint8 (ranges x bytes of a range), from range `first` on
        self.bits, self.ranges, self.first = bits, ranges, first

    @staticmethod
    def positions(keys: np.ndarray, q: int, range_bits: int) -> Iterator[np.ndarray]:
        """Places of (key, q) within the key's range, one array for each probe."""
        a = mix(keys + _U(q * _STEP & _ALL))
        low, turn = a & _U(_LOW), (a >> _U(32)) | _U(1)
        for j in range(probes(q)):
            yield (((low + _U(j) * turn) & _U(_LOW)) * _U(range_bits)) >> _U(32)

    @staticmethod
    def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
        return ((keys >> _U(32)) * _U(ranges)) >> _U(32)

    @classmethod
    def fill(cls, keys: np.ndarray, levels: np.ndarray, range_bytes: int) -> bytes:
        """The bits of one range that holds these keys."""
        bits = np.zeros(range_bytes * 8, bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            for at in cls.positions(keys[levels >= q], q, range_bytes * 8):
                bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, 0 where absent."""
        out = np.zeros(len(keys), np.uint8)
        for lo in range(0, len(keys), PROBED):
            self._levels(keys[lo : lo + PROBED], out[lo : lo + PROBED])
        return out

    def _levels(self, keys: np.ndarray, out: np.ndarray) -> None:
        range_bytes = self.bits.shape[1]
        flat, wide = self.bits.reshape(-1), _U(range_bytes * 8)
        open_ = np.arange(len(keys))
        base = ((self.range_of(keys, self.ranges) - _U(self.first)) * _U(range_bytes)).astype(np.int64)
        q = 0
        while len(open_):
            q += 1
            a = mix(keys + _U(q * _STEP & _ALL))
            low, turn = a.astype(np.uint32), (a >> _U(32)).astype(np.uint32) | np.uint32(1)
            for j in range(probes(q)):  # a key that misses is not probed again
                if j:
                    low += turn  # modulo 2^32
                at = (low * wide) >> _U(32)
                hit = (flat[base + (at >> _U(3)).astype(np.int64)] & _BIT[at & _U(7)]) != 0
                if not hit.all():
                    low, turn, base, open_, keys = low[hit], turn[hit], base[hit], open_[hit], keys[hit]
            out[open_] = q


def _cut(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between neighbouring ``cuts``, fewer than 2^31 in all."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _blobs(keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Ascending keys as one row for each range: range, keys, counts."""
    at = LogBloom.range_of(keys, ranges).astype(np.int64)
    cuts = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
    return pa.RecordBatch.from_pydict({"range": at[cuts[:-1]].astype(np.int32), "keys": _cut(keys, cuts), "counts": _cut(counts.astype("<u8"), cuts)})


_TALLY = "kind string, word string, n long, range int, keys binary, counts binary"


def tally(docs: DataFrame) -> DataFrame:
    """What tasks counted, in one pass over the texts: words (kind ``w``), bigram keys by coarse range (``p``),
    and one by one the bigram keys of a fixed share of the key space (``b``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("tally", dict)  # an earlier model goes
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = distinct = 0
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in in_portions(_sizes(texts), PORTION):
                tokens = Tokens(texts.slice(lo, hi - lo))
                h, first, n = np.unique(tokens.hashes, return_index=True, return_counts=True)
                words.append((h, n, tokens.words(first)))
                distinct += len(h)
                if distinct > WORDS:
                    words = [_merged_words(words)]
                    distinct = len(words[0][0])
                if distinct > WORDS // 2:
                    yield from _words(words)
                    distinct = 0
                held.append(np.unique(bigram_keys(tokens.hashes, tokens.sizes), return_counts=True))
                size += len(held[-1][0])
                if size > MERGE:
                    held = [_merged(held)]
                    size = len(held[0][0])
                if size > MERGE // 2:
                    yield from _pairs(held)
                    size = 0
        if distinct:
            yield from _words(words)
        if size:
            yield from _pairs(held)
        give_back()

    return docs.select("text").mapInArrow(count, _TALLY)


def summed(table: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(word, n) of all tokens, and sizes: N, V, and the levels of distinct bigrams as estimated from a fixed share of the key space."""
    table = stored(table.where("kind <> 'p'").groupBy("kind", "word").agg(F.sum("n").alias("n")), "words")
    words = table.where("kind = 'w'").select("word", "n")
    levels = F.length(F.bin("n")).cast("long")
    size = table.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(levels).alias("levels")).collect()
    by = {r["kind"]: r for r in size}
    if "w" not in by:
        return words, {"N": 0, "V": 0, "levels": 0, "by_level": {}}
    by_level = {r["q"]: r["v"] for r in words.groupBy(levels.alias("q")).agg(F.count("*").alias("v")).collect()}  # 63 rows at most
    return words, {"N": by["w"]["n"], "V": by["w"]["v"], "levels": int(by["w"]["levels"] + (by["b"]["levels"] * SHARE if "b" in by else 0)), "by_level": by_level}


def _tallied(kind: str, **columns) -> pa.RecordBatch:
    """A batch of ``tally``; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    types = {"word": pa.string(), "n": pa.int64(), "range": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * n, pa.string())} | {c: columns[c] if c in columns else pa.nulls(n, t) for c, t in types.items()})


def _sizes(texts: pa.Array) -> list[int]:
    return np.diff(_bytes_of(texts)[1]).tolist()


def _merged_words(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All of ``held`` as one, each word once."""
    h, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    order = np.argsort(h)
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    return h[order][first], np.add.reduceat(n[order], first), pa.concat_arrays([x[2] for x in held]).take(pa.array(order[first]))


def _words(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
    _, n, words = _merged_words(held)
    held.clear()
    for lo in range(0, len(n), 20_000):
        yield _tallied("w", word=words.slice(lo, 20_000), n=pa.array(n[lo : lo + 20_000], pa.int64()))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All of ``held`` as one, which is emptied."""
    keys, n = map(np.concatenate, zip(*held, strict=True))
    held.clear()
    return _summed(keys, n)


def _pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    keys, n = _merged(held)
    blobs = _blobs(keys, n, RANGES)
    yield _tallied("p", **{c: blobs.column(c) for c in ("range", "keys", "counts")})
    few = int(np.searchsorted(keys, _U(_ALL // SHARE)))
    yield _tallied("b", word=pa.array(list(map(str, keys[:few].tolist())), pa.string()), n=pa.array(n[:few], pa.int64()))


def unigram_key(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ _U(0xA0761D6478BD642F))


def build_filter(table: DataFrame | None, words: DataFrame, levels: int, bits: int = BITS_PER_LEVEL, most: int = 1 << 62) -> dict:
    """Fill the filters in the shared folder from a tally, and from ``words``; returns where they are and their shape.

    ``most`` bounds the number of segments: a filter of so many has fewer bits a level instead of more.
    Each *group* of neighbouring ranges is a file of its own.
    """
    spark = words.sparkSession
    total = min(max(1 << 16, levels * bits // 8), most * FILTER_BYTES)
    segments = -(-total // FILTER_BYTES)
    ranges = RANGES * segments
    range_bytes = -(-total // ranges)

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield _blobs(np.frombuffer(k, _U), np.frombuffer(n, "<u8"), ranges)

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = unigram_key(hashes_of(batch.column("word")))
                yield _blobs(*_summed(keys, batch.column("n").to_numpy().astype(np.int64)), ranges)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("fill", dict)
        held: dict[int, list] = {}
        for batch in batches:
            for r, k, n in zip(*(batch.column(c).to_pylist() for c in ("range", "keys", "counts")), strict=True):
                held.setdefault(r, []).append((k, n))
        for r in sorted(held):
            own = held.pop(r)
            keys, counts = _summed(np.frombuffer(b"".join(k for k, _ in own), _U), np.frombuffer(b"".join(n for _, n in own), "<u8").astype(np.int64))
            bits = LogBloom.fill(keys, level(counts), range_bytes)
            full = float(np.unpackbits(np.frombuffer(bits, np.uint8)).mean())
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "bits": pa.array([bits], pa.binary()), "full": pa.array([full], pa.float64())})

    kind = "range int, keys binary, counts binary"
    groups = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), segments * 16), ranges)
    dealt = words.mapInArrow(unigrams, kind)
    if table is not None:
        pairs = table.where("kind = 'p'").select("range", "keys", "counts")
        if segments > 1:  # a coarse range is so many neighbouring ranges
            pairs = pairs.mapInArrow(finer, kind)
        dealt = pairs.unionByName(dealt)
    # keys are hashes, so ranges are even; one row for each task and range
    group = F.floor(F.col("range").cast("long") * groups / ranges).cast("int")
    filled = dealt.repartitionById(groups, group).mapInArrow(fill, "range int, bits binary, full double")
    path = scratch_path(spark, "filter")
    filled.withColumns({"segment": F.floor(F.col("range") / RANGES).cast("int"), "group": group}).write.partitionBy("group").parquet(path)
    made = spark.read.schema("range int, bits binary, full double, segment int, group int").parquet(path)
    # ranges without a key have no row and err never
    errors = made.agg(*(F.coalesce(F.sum(F.pow("full", F.lit(k))), F.lit(0.0)) / ranges for k in (FIRST_PROBES, PROBES))).first()
    return {"path": made.inputFiles(), "ranges": ranges, "range_bytes": range_bytes, "segments": segments, "groups": groups, "errors": tuple(errors)}


def _load_filter(files: Iterable[str], segment: int, ranges: int, range_bytes: int) -> LogBloom:
    """One segment in this worker's memory."""
    return _load_ranges(files, segment * RANGES, (segment + 1) * RANGES, ranges, range_bytes)


def _load_ranges(files: Iterable[str], first: int, end: int, ranges: int, range_bytes: int) -> LogBloom:
    """The ranges from ``first`` on in this worker's memory."""
    import pyarrow.parquet as pq

    from .token_files import filesystem

    bits = np.zeros((end - first, range_bytes), np.uint8)
    for file in files:
        system, path = filesystem(file)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=64, columns=["range", "bits"]):
                for r, b in zip(batch.column("range").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                    if first <= r < end:
                        bits[r - first] = np.frombuffer(b, np.uint8)
    return LogBloom(bits, ranges, first)


def _load_head(files: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes of words counted once; those of other words, and their exact counts."""
    import pyarrow.parquet as pq

    from .token_files import filesystem

    sources = [filesystem(file) for file in files]
    total = sum(pq.read_metadata(path, filesystem=system).num_rows for system, path in sources)
    # filled and sorted in place, for the head is large; pages that stay empty take no memory
    ones, h, n = np.zeros(total, _U), np.zeros(total, _U), np.zeros(total, np.int64)
    a = b = 0
    for system, path in sources:
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["h", "n"]):
                hashes, counts = batch.column("h").to_numpy().view(_U), batch.column("n").to_numpy()
                once = counts == 1
                few = int(once.sum())
                ones[a : a + few] = hashes[once]
                a += few
                many = len(counts) - few
                h[b : b + many], n[b : b + many] = hashes[~once], counts[~once]
                b += many
    ones, h, n = ones[:a], h[:b], n[:b]
    ones.sort()
    order = np.argsort(h)
    give_back()
    return ones, h[order], n[order]


def _exact(head: tuple[np.ndarray, np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Counts of these word hashes in the head, 0 where it has none."""
    ones, h, n = head

    def place_in(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        return place, own[place] == hashes

    found = np.zeros(len(hashes), np.int64)
    if len(ones):
        found[place_in(ones)[1]] = 1
    if len(h):
        place, same = place_in(h)
        found[same] = n[place[same]]
    return found


def head_words(words: DataFrame, most: int = HEAD_WORDS) -> tuple[DataFrame, int]:
    """(h, n) of the words of at least some count, at most ``most`` of them, and that count."""
    sizes = words.groupBy("n").count().groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.sum("count").alias("c")).orderBy(F.desc("n")).collect()  # 65,536 rows at most
    least, total = 1 << 62, 0
    for r in sizes:
        if total + r["c"] > most:
            break
        total += r["c"]
        least = r["n"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes_of(batch.column("word"))
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": batch.column("n")})

    return stored(words.where(F.col("n") >= least).mapInArrow(hashed, "h long, n long"), "head"), least


def train(docs: DataFrame) -> dict:
    """A model of all these texts."""
    bounded_batches(docs.sparkSession)
    docs = texts_of(docs)
    table = stored(tally(docs), "tally", TALLY_GROUP)
    words, sizes = summed(table)
    head, least = head_words(words)
    bloom = build_filter(table, words, sizes["levels"])
    delete_path(docs.sparkSession, os.path.dirname(table.inputFiles()[0]))  # nothing reads the tally after this
    # beyond one segment tasks ask for bigrams by exchange, and have a filter of words alone at hand
    own = build_filter(None, words, sum(q * v for q, v in sizes["by_level"].items()), most=1) if bloom["segments"] > 1 else bloom
    release(docs.sparkSession)
    return {"words": words, **sizes, "least": least, "head": tuple(sorted(head.inputFiles())), "filter": bloom, "word_filter": own}


def _log_table(belief: Belief) -> np.ndarray:
    """log10 P by the levels of bigram, history and word, one after the other."""
    q = np.arange(64)
    return np.log10(belief.probabilities(*(x.ravel() for x in np.meshgrid(q, q, q, indexing="ij"))))


_DOCS = "doc_id long, n_tokens long, n_known long, base double, rest array<string>"


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n_all, n_words, shape, own = model["N"], model["V"], model["filter"], model["word_filter"]
    files, word_files, head_files, segments = tuple(sorted(shape["path"])), tuple(sorted(own["path"])), model["head"], shape["segments"]
    ranges, range_bytes, groups, whole = shape["ranges"], shape["range_bytes"], shape["groups"], model["least"] <= 1
    word_ranges, word_bytes = own["ranges"], own["range_bytes"]
    belief = Belief(n_all, model["by_level"], shape["errors"][0], max(shape["errors"][1], own["errors"][1]))
    total = math.log10(n_all + n_words + 1)

    def memory():
        """The filter, the head and the probabilities in this worker's memory."""
        return worker_memory(f"{word_files[:1]}", lambda: (_load_filter(word_files, 0, word_ranges, word_bytes), _load_head(head_files), _log_table(belief)))

    def looked_up(texts: pa.Array):
        """Tokens with owners, keys of bigrams, levels of history and word as one number, and the columns of ``_DOCS`` but the id."""
        probe, head, _ = memory()
        tokens = Tokens(texts)
        n = len(tokens.sizes)
        h, place = np.unique(tokens.hashes, return_inverse=True)
        lu, exact = probe(unigram_key(h))[place], _exact(head, h)
        context = np.empty(len(lu), np.uint16)
        context[1:] = lu[:-1]
        context[tokens.last - tokens.sizes + 1] = lu[tokens.last[0]]  # the end before the first word
        owner = tokens.owners()
        inside = np.full(len(h), True) if whole else exact > 0
        base = np.bincount(owner, np.where(inside, np.log10(exact + 1.0) - total, 0.0)[place], n)
        known = np.bincount(owner, (exact > 0)[place], n).astype(np.int64)
        out = np.flatnonzero(~inside[place])
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[out], minlength=n))]).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(ends), tokens.words(out))
        return owner, bigram_keys(tokens.hashes, tokens.sizes), context << 6 | lu, [pa.array(tokens.sizes, pa.int64()), pa.array(known), pa.array(base), rest]

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in in_portions(_sizes(texts), PORTION):
                owner, keys, code, found = looked_up(texts.slice(lo, hi - lo))
                probe, _, logs = memory()
                pairs, place = np.unique(keys, return_inverse=True)
                p = logs[probe(pairs)[place].astype(np.int64) << 12 | code]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *found, pa.array(np.bincount(owner, p, hi - lo))], names=["doc_id", "n_tokens", "n_known", "base", "rest", "score"])

    if segments == 1:
        done = texts_of(docs).mapInArrow(one_pass, f"{_DOCS}, score double")
    else:
        done = _scored_by_exchange(texts_of(docs), looked_up, belief, files, ranges, range_bytes, groups)
    if whole:
        return done.select("doc_id", "n_tokens", "n_known", F.col("base").alias("base_score"), "score")
    done = stored(done.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = done.select("row", F.explode("rest").alias("word")).groupBy("row", "word").count()
    tail = model["words"].where(F.col("n") < model["least"])
    added = rest.join(tail, "word", "left").groupBy("row").agg(
        F.sum(F.col("count") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - total)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("count")).otherwise(0)).alias("known")
    )
    both = done.join(added, "row", "left")
    return both.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def _scored_by_exchange(texts: DataFrame, looked_up: Callable, belief: Belief, files: tuple[str, ...], ranges: int, range_bytes: int, groups: int) -> DataFrame:
    """The rows of ``score`` where bigrams are in many files: each portion of texts sends its keys to the tasks that hold their ranges, which send back sums by text."""
    by_group: dict[int, list[str]] = {}
    for file in files:
        by_group.setdefault(int(os.path.dirname(file).rpartition("=")[2]), []).append(file)
    lists = ", ".join(f"{name} array<{kind}>" for name, kind in (x.split(" ", 1) for x in _DOCS.split(", ")))
    names = [x.split()[0] for x in _DOCS.split(", ")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in in_portions(_sizes(texts), PORTION):
                owner, keys, code, found = looked_up(texts.slice(lo, hi - lo))
                # as Spark works out a range's group
                group = (LogBloom.range_of(keys, ranges).astype(np.int64) * groups // ranges).astype(np.uint16)
                order = np.argsort(group, kind="stable")
                sizes = np.bincount(group, minlength=groups)
                at = np.flatnonzero(sizes)
                ends = np.concatenate([[0], np.cumsum(sizes[at])])
                columns = [_cut(values[order], ends) for values in (keys, code.astype("<u2"), owner.astype("<u4"))]
                rows = pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), portion)), *columns], names=["group", "portion", "keys", "codes", "owners"])
                yield _with_nulls(rows)
                whole = [batch.column("doc_id").slice(lo, hi - lo), *found]
                own = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), x) for x in whole]
                yield _with_nulls(pa.RecordBatch.from_arrays([pa.array([portion % groups], pa.int32()), pa.array([portion]), *own], names=["group", "portion", *names]))
                portion += 1

    asked = f"group int, portion long, keys binary, codes binary, owners binary, {lists}"
    wanted = pa.schema([("group", pa.int32()), ("portion", pa.int64()), ("keys", pa.binary()), ("codes", pa.binary()), ("owners", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("rest", pa.list_(pa.list_(pa.string())))])

    def _with_nulls(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(f.name).cast(f.type) if f.name in rows.schema.names else pa.nulls(rows.num_rows, f.type) for f in wanted], schema=wanted)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = None
        for batch in batches:
            sums = []
            for g, keys, codes, owners in zip(*(batch.column(c).to_pylist() for c in ("group", "keys", "codes", "owners")), strict=True):
                if keys is None:
                    sums.append((None, None))
                    continue
                first, end = -(-g * ranges // groups), -(-(g + 1) * ranges // groups)
                probe = worker_memory(f"{files[:1]} group {g}", lambda g=g, a=first, b=end: _load_ranges(by_group.get(g, ()), a, b, ranges, range_bytes))
                logs = _log_table(belief) if logs is None else logs
                p = logs[probe(np.frombuffer(keys, "<u8")).astype(np.int64) << 12 | np.frombuffer(codes, "<u2")]
                some, place = np.unique(np.frombuffer(owners, "<u4"), return_inverse=True)
                sums.append((some.tobytes(), np.bincount(place, p).tobytes()))
            owner, part = zip(*sums, strict=True) if sums else ((), ())
            arrays = [batch.column("group"), batch.column("portion"), pa.array(owner, pa.binary()), pa.array(part, pa.binary()), *(batch.column(c) for c in names)]
            yield pa.RecordBatch.from_arrays(arrays, names=["group", "portion", "owner", "part", *names])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, parts in enumerate(batch.column("parts").to_pylist()):
                columns = [batch.column(c).slice(k, 1).flatten() for c in names]
                score = np.zeros(len(columns[0]))
                for x in parts:
                    score[np.frombuffer(x["owner"], "<u4")] += np.frombuffer(x["part"])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*names, "score"])

    answered = texts.mapInArrow(ask, asked).repartitionById(groups, F.col("group")).mapInArrow(answer, f"group int, portion long, owner binary, part binary, {lists}")
    # a portion's sums in order of groups, so that results repeat
    parts = F.array_sort(F.collect_list(F.when(F.col("owner").isNotNull(), F.struct("group", "owner", "part"))))  # as many as groups at most
    portions = answered.groupBy("portion").agg(parts.alias("parts"), *(F.first(c, ignorenulls=True).alias(c) for c in names))
    return portions.mapInArrow(added, f"{_DOCS}, score double")


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all ``documents`` by a model of those whose hash remainder of 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(texts_of(docs).where(remainder("doc_id", 7) != 2))
    scored = score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")
