"""N-gram Jaccard join by parity sketches.

Documents are compared by their sets of word shingles.  Two sets A, B have
Jaccard similarity at least P/Q only if their symmetric difference is at most

    D = floor((|A| + |B|) (Q - P) / (Q + P)).

*Parity sketch*: every shingle flips one bit of a bit sketch, chosen by its
hash; so the Hamming distance of two sketches never exceeds the symmetric
difference of the sets.  It is used twice.

1. *Pigeonhole*: of W > D words of a sketch, a qualifying pair has at least W - D
   in which the two agree.  These words are ``WORD_BITS`` wide and mostly blank, so
   they are kept as hashes of their set bits.  A set gives a key for each word
   that is neither blank nor *hot*; if more than W - D - 1 of its words are, for those
   as well.  Then any qualifying pair shares a key.  Sketch widths must agree, so
   sets are put in *size bands*; a set takes part in its own band and in the band
   below, where the partner may be.
2. *Hamming test*: a packed sketch of four to eight bits for each shingle (halved
   until widths agree) goes with every candidate.  Pairs whose sketches differ in
   more than D bits are gone before any set is read; the others are verified on
   their whole shingle sets.

No qualifying pair is lost.

Skew: equal sets are one *class* first (the members of a class are linked with
each other by definition).  Keys that very many classes have are found on a share of
the texts (``HOT_SHARE``) and are left out wherever the pigeonhole bound holds without
them; what is left of such a group is dealt by salt.  Groups with equal members,
as a family of near copies has by the hundred, are one group.  Pairs within
a group are never formed: each member is compared with two centres of the group, those
with the least salted hashes.  What then is left - members of one group without a centre in
common - is compared in blocks, which loses no link.

Defined cases: null or empty text has no shingle and is linked with nothing
(its component is its own id); fewer words than a shingle's are one
shingle; rows with a null doc_id stay, with the component of a set equal to theirs if
any, and never name a component; rows with one doc_id and unlike texts are
rows of their own; repeated rows have one result row each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, ascii_words, bounded_batches, give_back, in_portions, least_tasks, mix, most_frequent, release, stored, texts_of, worker_memory
from .components import components

_U = np.uint64
#: Characters handled at once; keys that a task gathers.
PORTION, TASK_KEYS = 2_000_000, 1_000_000
WORD_BITS = 1 << 20
#: One text in so many tells which keys are hot: those of so many of these texts; at most so many keys; parts of a hot group.
HOT_SHARE, HOT_TEXTS, HOT_KEYS, HOT_PARTS = 64, 32, 100_000, 256


def most_different(total: int | np.ndarray, threshold: Fraction) -> int | np.ndarray:
    """The largest symmetric difference of a qualifying pair whose sizes add to ``total``."""
    p, q = threshold.numerator, threshold.denominator
    return total * (q - p) // (q + p)


@functools.lru_cache(8)
def bands(threshold: Fraction, most: int = 1 << 31) -> np.ndarray:
    """Lower ends of the size bands: a qualifying pair lies in one band or in neighbours."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, ends[-1] * threshold.denominator // threshold.numerator + 1))
    return np.array(ends, np.int64)


@functools.lru_cache(8)
def _widths(threshold: Fraction) -> np.ndarray:
    """Words of a sketch for each band.

    D + 1 words, D being the largest difference of a pair whose smaller set lies
    in the band, and as many more as a set of the band may leave without a bit
    (four standard deviations above what is expected) or have hot (a sixteenth).
    """
    ends = bands(threshold)
    out = []
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        small = high - 1
        need = most_different(small + small * threshold.denominator // threshold.numerator, threshold) + 1
        words = need
        while need > 1 and words < 4 * low:
            blank = words * math.exp(-low / words)
            if words - blank - 4 * math.sqrt(blank) - words // 16 >= need:
                break
            words += max(1, words // 64)
        out.append((need, words))
    return np.array(out, np.int64)


def sketch_words(band: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """D + 1, and the number of words, of sketches in a band."""
    both = _widths(threshold)[band]
    return both[..., 0], both[..., 1]


def _hashes() -> WordHashes:
    return worker_memory("words", lambda: WordHashes(300_000))


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles of ``n`` words."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, _U)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), len(words))], _U)
    h = _hashes().array(words)
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketch_keys(sets: list[np.ndarray], threshold: Fraction, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of the sketch words of these non-empty sets, in their own band and the one below.

    ``hot``: ascending keys that need not be given while words enough are left.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets)
    ends = bands(threshold)
    own = np.searchsorted(ends, sizes, "right") - 1
    numbers, keys = [], []
    who = np.repeat(np.arange(len(sets)), sizes)
    h = mix(elements ^ _U(0x2545F4914F6CDD1D))
    bit = mix(h & _U(WORD_BITS - 1))  # which bit of its word a shingle flips, as the hash of a word of that bit alone
    for down in (0, 1):
        band = own - down
        use = band >= 0
        if down:  # a partner in the band below must be large enough
            largest = (ends[np.maximum(band, 0) + 1] - 1) * threshold.denominator // threshold.numerator
            use &= sizes <= largest
        need, count = sketch_words(np.maximum(band, 0), threshold)
        inside = use[who]
        owner = who[inside]
        word = (((h[inside] >> _U(32)) * count[owner].astype(_U)) >> _U(32)).astype(np.int64)
        at = owner << 32 | word
        order = np.argsort(at)
        at, flips = at[order], bit[inside][order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
        # a word's hash: exclusive or over its set bits; two flips of one bit undo each other
        value = np.bitwise_xor.reduceat(flips, first) if len(first) else flips
        number, place = at[first] >> 32, (at[first] & 0xFFFFFFFF).astype(_U)

        def key_of(number: np.ndarray, place: np.ndarray, value: np.ndarray, band: np.ndarray = band) -> np.ndarray:
            return mix(mix(value + _U(0x9E3779B97F4A7C15) * (place + _U(1))) ^ (band[number].astype(_U) * _U(0xBF58476D1CE4E5B9)))

        key = key_of(number, place, value)
        spare = value == 0
        if hot is not None and len(hot):
            spare |= hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        # blank and hot words need no key while words enough are neither
        idle = count - np.bincount(number[~spare], minlength=len(sets))
        all_of = use & (idle > count - need)
        numbers.append(number[~spare | all_of[number]])
        keys.append(key[~spare | all_of[number]])
        for k in np.flatnonzero(all_of):
            gaps = np.setdiff1d(np.arange(count[k]), place[number == k].astype(np.int64))
            numbers.append(np.full(len(gaps), k))
            keys.append(key_of(numbers[-1], gaps.astype(_U), np.zeros(len(gaps), _U)))
    return np.concatenate(numbers), np.concatenate(keys)


def packed_sketch(shingles: np.ndarray) -> bytes:
    """The parity sketch of a set: a power of two of bits, four for each shingle at least."""
    bits = max(256, 1 << (4 * len(shingles) - 1).bit_length()) if len(shingles) else 256
    flips = np.bincount((mix(shingles ^ _U(0x6A09E667F3BCC909)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool), bitorder="little").tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of 64-bit words brought to ``words`` of them: the halves of a sketch give that of half the width."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def hamming(x: bytes, y: bytes) -> int:
    """In how many bits two packed sketches differ: at most the sets' symmetric difference."""
    a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def shingle_classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles and the set's 128-bit fingerprint in two longs (null for the empty set) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, high, low = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_hashes(text, n)
                sizes.append(len(s))
                high.append(_print(s)[0] if len(s) else None)
                low.append(_print(s)[1] if len(s) else None)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "t": batch.column("t"), "n_shingles": pa.array(sizes, pa.int64()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())}
            )

    return _hashed(docs).mapInArrow(run, "doc_id long, t long, n_shingles long, high long, low long")


def _hashed(docs: DataFrame) -> DataFrame:
    return texts_of(docs).withColumn("t", F.xxhash64("text"))


def _print(shingles: np.ndarray) -> tuple[int, int]:
    high, low = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8").tolist()
    return high, low


def _keyed(n: int, threshold: Fraction, hot: np.ndarray | None):
    """The task that turns texts into (key, low, salt); it names a set's keys once, however many copies of it it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in in_portions(map(len, texts), PORTION):
                sets, lows = [], []
                for text in texts[lo:hi]:
                    s = shingle_hashes(text, n)
                    if len(s) and (low := _print(s)[1]) not in seen:
                        if len(seen) > TASK_KEYS:
                            seen.clear()
                        seen.add(low)
                        sets.append(s)
                        lows.append(low)
                if sets:
                    number, keys = sketch_keys(sets, threshold, hot)
                    owner = np.array(lows, np.int64)[number]
                    salt = np.zeros(len(keys), np.int16)
                    if hot is not None and len(hot):
                        is_hot = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
                        salt[is_hot] = 1 + (owner[is_hot] & (HOT_PARTS - 1))
                    for a in range(0, len(keys), 200_000):
                        yield pa.RecordBatch.from_pydict({"key": keys[a : a + 200_000].view(np.int64), "low": owner[a : a + 200_000], "salt": salt[a : a + 200_000]})

    return run


def hot_keys(docs: DataFrame, n: int, threshold: Fraction) -> np.ndarray:
    """Ascending keys that many of a share of the texts have.  What is hot changes the work alone, not the result."""
    share = texts_of(docs).where(F.pmod(F.xxhash64("text"), F.lit(HOT_SHARE)) == 0).select("text")
    counted = share.mapInArrow(_keyed(n, threshold, None), "key long, low long, salt short").select("key", "low").distinct().groupBy("key").agg(F.count("*").alias("n"))
    found = most_frequent(stored(counted.where(F.col("n") >= HOT_TEXTS).coalesce(least_tasks(docs.sparkSession)), "hot"), HOT_KEYS).select("key").collect()  # HOT_KEYS rows at most
    return np.sort(np.array([r["key"] for r in found], np.int64).view(_U))


def shared_keys(docs: DataFrame, n: int, threshold: Fraction, partitions: int | None = None) -> DataFrame:
    """(key, low): groups of sets with different fingerprints that share a sketch key.  Groups with equal members are one."""
    hot = hot_keys(docs, n, threshold)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("key").to_numpy(), b.column("low").to_numpy(), b.column("salt").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        key, low, salt = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        if (part := salt > 0).any():  # parts of hot groups stay as they are
            yield from _batches(key[part], low[part])
            key, low = key[~part], low[~part]
        del salt, part
        order = np.lexsort((low, key))
        key, low = key[order], low[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1])][: len(key)]
        key, low = key[new], low[new]
        same = np.r_[False, key[1:] == key[:-1]][: len(key)]
        keep = same | np.r_[same[1:], False][: len(key)]
        key, low, same = key[keep], low[keep], same[keep]
        del order, new, keep
        if len(key):
            first = np.flatnonzero(~same)
            members = np.add.reduceat(mix(low.view(_U)), first)  # of equal members if the sums of their hashes are equal
            _, one = np.unique(members, return_index=True)
            sizes = np.diff(np.r_[first, len(key)])
            take = np.zeros(len(first), bool)
            take[one] = True
            yield from _batches(np.repeat(members.view(np.int64), sizes)[np.repeat(take, sizes)], low[np.repeat(take, sizes)])
        del key, low
        give_back()

    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts_of(docs).select("text").mapInArrow(_keyed(n, threshold, hot), "key long, low long, salt short").repartition(partitions, "key", "salt")
    return dealt.mapInArrow(shared, "key long, low long").distinct()


def _batches(key: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(key), 100_000):
        yield pa.RecordBatch.from_pydict({"key": key[a : a + 100_000], "low": low[a : a + 100_000]})


def link_classes(docs: DataFrame, n: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and how they hang together.

    Returns every row with its class (doc_id, t, n_shingles, class), and for each
    class (class, first) the least row (doc_id, t) of all classes that it hangs together with.
    """
    rows = stored(shingle_classes(docs, n), "rows")
    tasks = _tasks(rows)
    # aggregated before they are exchanged, so thousands of copies are a row for each task
    least = rows.where("high is not null and doc_id is not null").groupBy("high", "low").agg(F.min(F.struct("doc_id", "t")).alias("r"), F.max("n_shingles").alias("size"))
    classes = stored(least.coalesce(tasks).select("high", "low", "size", "r.doc_id", "r.t", F.monotonically_increasing_id().alias("class")), "classes")
    members = rows.join(classes.select("high", "low", "class"), ["high", "low"], "left").select("doc_id", "t", "n_shingles", "class")
    # a set has about a key for two shingles, bands and copies that tasks don't share included
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_KEYS)
    ids = classes.select("low", F.col("class").alias("id"))
    groups = stored(shared_keys(docs, n, threshold, parts).join(ids, "low").select("key", "id").coalesce(max(tasks, parts // 4)), "groups")
    release(docs.sparkSession)
    sketches = _described(docs, classes, groups.select("id").distinct(), n, "sketch")
    pairs = stored(_with_centres(groups, tasks), "pairs")
    near = stored(near_pairs(pairs, sketches, threshold).coalesce(_tasks(pairs, 10_000)), "near")
    sets = _described(docs, classes, near.select("a").union(near.select("b")).distinct(), n, "set")
    links = stored(verified(near, sets, threshold), "links")
    met = stored(_left_open(groups, _labels(links).coalesce(tasks), sketches, threshold, tasks), "left-open")
    sets = _described(docs, classes, met.select("id").distinct(), n, "set").join(sketches.select("class", "sketch"), "class")
    more = stored(_rest(met, sets, threshold, tasks), "links-rest")
    joined = components(links.unionByName(more))
    firsts = classes.join(joined, F.col("class") == F.col("node")).groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    if links.count() + more.count() <= BROADCAST_IDS:  # no more components than links; a large one then doesn't meet in a task
        firsts = F.broadcast(firsts)
    own = F.struct("doc_id", "t")
    named = classes.join(joined, F.col("class") == F.col("node"), "left").join(firsts, "component", "left").select("class", F.coalesce("first", own).alias("first"))
    return members, named


def _with_centres(groups: DataFrame, tasks: int) -> DataFrame:
    """(a, b): each member of a group with the group's two centres."""
    order = [F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), F.col("id").alias("id"))).alias(f"c{r}") for r in (0, 1)]
    centres = groups.groupBy("key").agg(*order).select("key", F.array_distinct(F.array("c0.id", "c1.id")).alias("centres")).coalesce(tasks)
    pairs = groups.join(centres, "key").select("id", F.explode("centres").alias("centre")).where("id <> centre")
    return pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct().coalesce(tasks)


def _labels(links: DataFrame) -> DataFrame:
    """(node, component): of a node and its neighbours that with the least hash, which is the centre that a family was compared with."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    order = lambda c: F.struct(F.xxhash64(c, F.lit(0)).alias("h"), F.col(c).alias("id"))
    least = both.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least("m", order("a")).alias("m"))
    return least.select(F.col("a").alias("node"), F.col("m.id").alias("component"))


def _open(rows: DataFrame, parts: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """``rows`` (with id) of the groups by ``keys`` that hold more than one part by (node, component), with ``part``."""
    known = rows.join(parts, F.col("id") == F.col("node"), "left").select(*rows.columns, F.coalesce("component", "id").alias("part")).coalesce(tasks)
    mixed = known.groupBy(*keys).agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n"))
    mixed = mixed.where("p <> q and n > 2").select(*keys).coalesce(tasks)  # two members have met: one is the centre
    return known.join(mixed, keys, "left_semi").coalesce(tasks)


#: Bytes of sets or sketches, and members at most, in one block of a group.
BLOCK_BYTES, BLOCK_SETS = 8 << 20, 2048


def _left_open(groups: DataFrame, parts: DataFrame, sketches: DataFrame, threshold: Fraction, tasks: int) -> DataFrame:
    """(centre, id, part): members of groups that their sketches leave near a member of another part.

    All groups with the same centre are put together, since a family of near copies
    shares most of its centres; whoever shares a key with whom then meets in the
    group of that key's centre.
    """
    order = F.struct(F.xxhash64("id", F.lit(0)).alias("h"), F.col("id").alias("id"))
    open_ = stored(_open(groups, parts, ["key"], tasks), "open-groups")
    centre = open_.groupBy("key").agg(F.min(order).alias("c")).select("key", F.col("c.id").alias("centre")).coalesce(tasks)
    met = stored(open_.join(centre, "key").select("centre", "id", "part").coalesce(tasks).distinct().coalesce(tasks), "open")

    def near(group: pd.DataFrame) -> pd.DataFrame:
        return _near_members(group, threshold)

    members = sketches.withColumnRenamed("class", "id")
    blocks = _block_pairs(met, members, "sketch", tasks).join(members, "id")
    found = blocks.groupBy("centre", "i", "j").applyInPandas(near, "centre long, id long").coalesce(_tasks(met, 10_000)).distinct().coalesce(tasks)
    return met.join(found, ["centre", "id"], "left_semi").coalesce(tasks)


def _rest(met: DataFrame, sets: DataFrame, threshold: Fraction, tasks: int) -> DataFrame:
    """Links between members (centre, id, part) of one group in different parts.

    A group is dealt into blocks and every pair of blocks is one task's work; pairs are never rows, only links are.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _cross_links(group, threshold)

    members = sets.withColumnRenamed("class", "id")
    blocks = _block_pairs(met, members, "set", tasks).join(members, "id")
    return blocks.groupBy("centre", "i", "j").applyInPandas(compare, "a long, b long").coalesce(tasks).distinct().coalesce(tasks)


def _block_pairs(met: DataFrame, members: DataFrame, column: str, tasks: int) -> DataFrame:
    """(centre, i, j, own, id, part): each member of a group in every pair of blocks of which its own is one."""
    # what members of a group hold has the centre's size or nearly so
    size = members.select(F.col("id").alias("centre"), F.length(column).alias("bytes"))
    each = F.greatest(F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_BYTES) / F.coalesce("bytes", F.lit(64 << 10)))), F.lit(8))
    blocks = met.groupBy("centre").agg(F.count("*").alias("n")).join(size, "centre", "left").select("centre", F.ceil(F.col("n") / each).cast("int").alias("blocks"))
    dealt = met.join(blocks.coalesce(tasks), "centre").withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    # block i meets block j for i <= j
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("centre", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "part")


def _sides(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    return (group, group) if i == j else (group[group["own"] == i], group[group["own"] == j])


def _near(left: pd.DataFrame, right: pd.DataFrame, threshold: Fraction) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``left`` those of ``right`` of another part that the sketches leave open."""
    if not len(left) or not len(right):
        return
    words = min(min(map(len, side["sketch"])) for side in (left, right)) // 8
    lw, rw = (np.stack([folded(np.frombuffer(x, _U), words) for x in side["sketch"]]) for side in (left, right))
    ln, rn = left["size"].to_numpy(), right["size"].to_numpy()
    lp, rp = left["part"].to_numpy(), right["part"].to_numpy()
    for k in range(len(left)):
        far = np.bitwise_count(rw ^ lw[k]).sum(1, dtype=np.int64)
        yield k, np.flatnonzero((far <= most_different(rn + ln[k], threshold)) & (rp != lp[k]))


def _near_members(group: pd.DataFrame, threshold: Fraction) -> pd.DataFrame:
    """Members of a pair of blocks that may be near one of another part."""
    left, right = _sides(group)
    li, ri = left["id"].to_numpy(), right["id"].to_numpy()
    ids: set[int] = set()
    for k, hits in _near(left, right, threshold):
        if len(hits):
            ids.add(int(li[k]))
            ids.update(ri[hits].tolist())
    return pd.DataFrame({"centre": np.full(len(ids), int(group["centre"].iloc[0]), np.int64), "id": np.array(sorted(ids), np.int64)})


def _cross_links(group: pd.DataFrame, threshold: Fraction) -> pd.DataFrame:
    """Links between different parts of a pair of blocks, those that join parts not joined yet."""
    left, right = _sides(group)
    ls, rs = ([np.frombuffer(x, _U) for x in side["set"]] for side in (left, right))
    lp, rp = left["part"].to_numpy(), right["part"].to_numpy()
    li, ri = left["id"].to_numpy(), right["id"].to_numpy()
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b = [], []
    for k, hits in _near(left, right, threshold):
        for m in hits.tolist():
            x, y = find(int(lp[k])), find(int(rp[m]))
            if x != y and similar_sets(ls[k], rs[m], threshold):  # one link for two parts is enough
                parent[x] = y
                a.append(min(li[k], ri[m]))
                b.append(max(li[k], ri[m]))
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def similar_sets(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    """Whether two ascending sets have the similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) * threshold.denominator < len(large) * threshold.numerator:
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return common * threshold.denominator >= threshold.numerator * (len(a) + len(b) - common)


def _tasks(table: DataFrame, rows: int = 100_000) -> int:
    """Tasks for what comes of a stored table: one for so many of its rows, and no more than 12 shuffle partitions in one."""
    return max(least_tasks(table.sparkSession), table.count() // rows)


#: Ids that may be broadcast, 24 bytes each.
BROADCAST_IDS = 1_000_000


def _described(docs: DataFrame, classes: DataFrame, ids: DataFrame, n: int, column: str) -> DataFrame:
    """(class, size, ``sketch`` or ``set``) of the classes in ``ids``, made anew from the text of their least rows (doc_id, t).

    A text is read once more, so that the sets of those alone are written that are compared.
    """
    wanted = stored(classes.join(ids.toDF("class"), "class").select("doc_id", "t", "class").coalesce(_tasks(classes)), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t, n) for t in batch.column("text").to_pylist()]
            values = [packed_sketch(s) if column == "sketch" else s.tobytes() for s in found]
            yield pa.RecordBatch.from_pydict({"class": batch.column("class"), "size": pa.array([len(s) for s in found], pa.int64()), column: pa.array(values, pa.binary())})

    found = _hashed(docs).join(wanted, ["doc_id", "t"]).select("class", "text").mapInArrow(run, f"class long, size long, {column} binary")
    if column == "set":  # few of the texts: tasks that take in several splits write as many fewer small files
        found = found.coalesce(max(least_tasks(docs.sparkSession), found.rdd.getNumPartitions() // 4))
    return stored(found, column)


def near_pairs(pairs: DataFrame, sketches: DataFrame, threshold: Fraction) -> DataFrame:
    """The (a, b) pairs whose sketches leave it open that their sets are similar enough."""

    @F.pandas_udf("boolean")
    def near(m, x, n, y):
        return pd.Series([hamming(a, b) <= most_different(k + l, threshold) for k, a, l, b in zip(m.tolist(), x, n.tolist(), y, strict=True)], dtype=bool)

    p, q = threshold.numerator, threshold.denominator
    one, two = (sketches.select(F.col("class").alias(c), F.col("size").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p)
    return both.where(near("n_a", "s_a", "n_b", "s_b")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The (a, b) pairs whose whole sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(x, y):
        return pd.Series([similar_sets(np.frombuffer(a, _U), np.frombuffer(b, _U), threshold) for a, b in zip(x, y, strict=True)], dtype=bool)

    one, two = (sets.select(F.col("class").alias(c), F.col("set").alias(f"x_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").where(similar("x_a", "x_b")).select("a", "b").coalesce(_tasks(pairs, 2_000))


def _named(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """Every row (doc_id, t, n_shingles, class) with the least row of its component (first); null for the empty set."""
    members, classes = link_classes(docs, n, threshold)
    return members.join(classes, "class", "left")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _named(docs, n, threshold).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """``docs``, all columns, with one row of each group of similar texts: that of least doc_id, then of least text hash.

    Rows with the same id and text count as one, that with the least hash of its other
    columns; rows without words or without an id stay.
    """
    rows = _named(docs, n, threshold).where("doc_id is not null and first is not null").groupBy("doc_id", "t").agg(F.count("*").alias("rows"), F.min("first").alias("first"))
    decided = rows.select("doc_id", "t", "rows", (F.struct("doc_id", "t") == F.col("first")).alias("stays")).where("not stays or rows > 1")
    decided = stored(decided.coalesce(least_tasks(docs.sparkSession)), "decided")
    gone = decided.where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t"))
    again = decided.where("stays and rows > 1").select(F.col("doc_id").alias("again_id"), F.col("t").alias("again_t"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    left = docs.join(gone, (docs["doc_id"].cast("long") == gone["gone_id"]) & (text == gone["gone_t"]), "left_anti")
    if again.isEmpty():
        return left
    same = (left["doc_id"].cast("long") == again["again_id"]) & (F.xxhash64(F.coalesce(left["text"].cast("string"), F.lit(""))) == again["again_t"])
    order = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*docs.columns))
    one = left.join(again, same, "left_semi").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    return left.join(again, same, "left_anti").unionByName(one)


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, Fraction(9, 10))

