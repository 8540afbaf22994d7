"""Chains, the sequence tagger, subword and contextual vectors, and adversaries against brute force and planted data."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import adversary, contextual, labels, lookup, sequence, spans, subword, tagger
from maskwright.plans import model_queries
from maskwright.plans.queries import GOLD
from maskwright.storage import fresh_path

# --- chains ---------------------------------------------------------------------------------------


def chains(rng, k, lengths):
    steps = rng.normal(size=(k, k)).round(3)
    rows = [(i, rng.normal(size=(n, k)).round(3).tolist(), rng.integers(0, k, n).tolist()) for i, n in enumerate(lengths)]
    return steps, rows


def listed(unary, steps):
    n, k = len(unary), len(steps)
    ways = list(itertools.product(range(k), repeat=n))
    scores = [sum(unary[i][y] for i, y in enumerate(w)) + sum(steps[a][b] for a, b in itertools.pairwise(w)) for w in ways]
    return ways, np.array(scores)


def test_chain_equals_all_label_sequences(spark):
    steps, rows = chains(np.random.default_rng(0), 3, [0, 1, 2, 5, 1, 4])
    df = spark.createDataFrame(rows, "id int, unary array<array<double>>, labels array<int>")
    m = sequence.matrix(steps.tolist())
    u = F.col("unary")
    got = df.select("id", sequence.log_likelihood(u, m, F.col("labels")).alias("ll"), sequence.marginals(u, m).alias("p"), sequence.best_path(u, m).alias("path")).collect()
    for r in got:
        _, unary, ys = rows[r["id"]]
        if not unary:
            assert (r["ll"], r["p"], r["path"]) == (0.0, [], [])
            continue
        ways, scores = listed(unary, steps)
        weights = np.exp(scores - scores.max())
        weights /= weights.sum()
        assert r["ll"] == pytest.approx(math.log(weights[ways.index(tuple(ys))]))
        want = [[sum(w for w, way in zip(weights, ways, strict=True) if way[i] == y) for y in range(3)] for i in range(len(unary))]
        assert np.allclose(r["p"], want)
        assert tuple(r["path"]) == ways[int(scores.argmax())]
        assert tagger.viterbi(np.array([unary]), steps)[0].tolist() == r["path"]


def test_long_chain_does_not_overflow(spark):
    steps, rows = chains(np.random.default_rng(1), 2, [200])
    rows = [(i, (np.array(u) * 300).tolist(), y) for i, u, y in rows]
    r = spark.createDataFrame(rows, "id int, unary array<array<double>>, labels array<int>").select(sequence.log_partition(F.col("unary"), sequence.matrix(steps.tolist())).alias("z"), sequence.marginals(F.col("unary"), sequence.matrix(steps.tolist())).alias("p")).first()
    assert math.isfinite(r["z"]) and np.allclose(np.sum(r["p"], axis=1), 1)


SENTENCES = "doc_id long, sent_idx int, words array<string>, labels array<int>"


def counted_sentences(rng, n=60):
    """Sentences of few frequent and many rare words, empty ones and null words among them; every third is all label 0."""
    rows = []
    for i in range(n):
        words = [None if x > 0.97 else f"rare{rng.randrange(200)}" if x > 0.7 else f"w{int(20 * x * x)}" for x in (rng.random() for _ in range(rng.choice([0, 1, 2, 7, 40])))]
        rows.append((i // 4, i % 4, words, [0 if i % 3 == 0 else rng.randrange(3) for _ in words]))
    return rows


def folded(spark, rows):
    """The same by counting in Python and the folds over columns."""
    words, steps, totals = {}, np.zeros((3, 3)), np.zeros(3)
    for _, _, sentence, ys in rows:
        for w, y in zip(sentence, ys, strict=True):
            totals[y] += 1
            if w is not None:
                words.setdefault(w, np.zeros(3))[y] += 1
        for a, b in itertools.pairwise(ys):
            steps[a, b] += 1
    unary = lambda w: np.log((words.get(w, np.zeros(3)) + 1) / (totals + 1)).tolist()
    m = sequence.matrix(np.log((steps + 1) / (steps.sum(1, keepdims=True) + 3)).tolist())
    df = spark.createDataFrame([(d, s, [unary(w) for w in sentence], ys) for d, s, sentence, ys in rows], "doc_id long, sent_idx int, unary array<array<double>>, labels array<int>")
    return {(r[0], r[1]): (r[2], r[3]) for r in df.select("doc_id", "sent_idx", F.size("labels"), sequence.log_likelihood(F.col("unary"), m, F.col("labels"))).collect()}


@pytest.mark.parametrize("most", [0, 3, 15, 1000])
def test_counted_chain_equals_folds(spark, most):
    """Whatever number of words is held by tasks, and whether or not sentences come without labels."""
    rows = counted_sentences(random.Random(5))
    plain = [r for r in rows if not any(r[3])]
    sources = (spark.createDataFrame([r for r in rows if any(r[3])], SENTENCES), None), (spark.createDataFrame([r[:3] for r in plain], SENTENCES.rsplit(",", 1)[0]), None)
    parts = [sequence.tallies(df, 3, cut) for df, cut in sources]
    chain = sequence.counted(parts[0].unionByName(parts[1]), 3)
    names, unary = sequence.frequent_words(chain, most)
    assert len(names) <= most and len(unary) == len(names) + 1
    got = {(r["doc_id"], r["sent_idx"]): (r["n_tokens"], r["log_likelihood"]) for r in sequence.likelihoods(chain, *sources, most=most).collect()}
    want = folded(spark, rows)
    assert got.keys() == want.keys()
    for k, (n, ll) in want.items():
        assert got[k] == (n, pytest.approx(ll, abs=1e-9))


def test_chain_without_rows(spark):
    none = spark.createDataFrame([], SENTENCES)
    chain = sequence.counted(sequence.tallies(none, 3), 3)
    assert np.allclose(chain.steps, math.log(1 / 3)) and sequence.likelihoods(chain, (none, None)).count() == 0
    # words that were not counted have the scores of a word never seen
    one = spark.createDataFrame([(1, 0, ["new"], [2])], SENTENCES)
    assert sequence.likelihoods(chain, (one, None)).first()["log_likelihood"] == pytest.approx(math.log(1 / 3))


def test_sequence_likelihood_exchanges_no_frequent_words(spark, tmp_path):
    rng = random.Random(2)
    texts = [(d, " ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(3000)) + (" a@b.com" if d % 10 == 0 else "")) for d in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages())

    def stages():
        every = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return {every.apply(i).stageId() for i in range(every.size())}

    before = written()
    assert model_queries.sequence_likelihood(spark, str(tmp_path)).agg(F.sum("n_tokens")).first()[0] == 40 * 3000 + 4 * 3
    assert written() - before < 40 * 3000 / 5


# --- sentences and running totals -----------------------------------------------------------------


def test_running_totals_of_all_sizes(spark):
    rng = random.Random(3)
    rows = [(n, [rng.randrange(9) for _ in range(n)]) for n in (1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096, 4097, 9000)]
    got = spark.createDataFrame(rows, "n int, x array<int>").select("n", T.running(F.col("x")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == {n: list(itertools.accumulate(x)) for n, x in rows}


def test_sentences_of_scoring_tokens(spark):
    texts = [(1, "One two. Three\nfour 3.5 end.x"), (2, ""), (3, None), (4, "..."), (5, "w " * 600), (5, "again. Here")]
    got = T.scorer_sentences(spark.createDataFrame(texts, "doc_id int, text string"), "text", "doc_id").collect()
    first = sorted((r["tok_idx"], r["sent_idx"], r["token"], r["start"], r["end"]) for r in got if r["doc_id"] == 1)
    assert [(s, t) for _, s, t, _, _ in first] == [(0, "One"), (0, "two"), (1, "Three"), (2, "four"), (2, "3"), (2, "5"), (2, "end"), (2, "x")]
    assert all(texts[0][1][a:b] == t for _, _, t, a, b in first)
    assert {r["doc_id"] for r in got} == {1, 5} and max(r["sent_idx"] for r in got) == 2
    # the same sentences cut inside the row
    rows = T.scorer_sentence_words(spark.createDataFrame(texts[:5], "doc_id int, text string"), "text", "doc_id").collect()
    want = {}
    for r in sorted((r for r in got if r["doc_id"] == 1 or r["token"] == "w"), key=lambda r: r["tok_idx"]):
        want.setdefault((r["doc_id"], r["sent_idx"]), []).append(r["token"])
    assert {(r["doc_id"], r["sent_idx"]): r["words"] for r in rows} == want


# --- tagger ---------------------------------------------------------------------------------------


def planted(spark, n):
    """Texts where a name after 'Mr' or 'Dr' is a span, whatever the name; names are mostly new, so a word list must fail."""
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)).capitalize()
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randrange(4, 20)):
            x = rng.random()
            words += [rng.choice(["Mr", "Dr"]), name()] if x < 0.2 else [name()] if x < 0.3 else [rng.choice(["the", "saw", "visit", "on", "Monday", "with"])]
        for i, w in enumerate(words):
            rows.append((d, 0, i, w, "B-DOCTOR" if i and words[i - 1] in ("Mr", "Dr") else "O"))
    return spark.createDataFrame(rows, "doc_id int, sent_idx int, tok_idx int, text string, type string")


def f1(rows):
    tp = sum(r["type"] == r["predicted"] != "O" for r in rows)
    wrong = sum(r["predicted"] != "O" and r["predicted"] != r["type"] for r in rows)
    missed = sum(r["type"] != "O" and r["predicted"] != r["type"] for r in rows)
    return 2 * tp / max(1, 2 * tp + wrong + missed)


def test_tagger_beats_a_word_list(spark):
    tokens = planted(spark, 200)
    rows = tagger.featured(tokens, bits=14).cache()
    model = tagger.train(rows.where("doc_id % 2 = 0"), ["O", "B-DOCTOR", "I-DOCTOR"], bits=14)
    said = tagger.tagged(rows.where("doc_id % 2 = 1"), model)
    own = f1(tokens.join(said, ["doc_id", "sent_idx", "tok_idx"]).collect())
    listed_words = labels.predict_word_list(tokens.where("doc_id % 2 = 1"), labels.word_list_tagger(tokens.where("doc_id % 2 = 0")))
    assert own > 0.95 > f1(listed_words.collect()) + 0.3
    # the same rows dealt otherwise give the same model
    again = tagger.train(rows.where("doc_id % 2 = 0").repartition(7), ["O", "B-DOCTOR", "I-DOCTOR"], bits=14)
    assert np.array_equal(model.unary, again.unary) and np.array_equal(model.steps, again.steps)


def test_tagger_on_documents(spark):
    """Strict F1 on the documents with odd ids, of those that the whole tables give, above that of a word list."""
    rows = model_queries.sequence_tagger(spark, "/root/testdata/sf0.001")
    assert rows.count() == model_queries._sentences(spark, "/root/testdata/sf0.001").where("doc_id % 2 = 1").count()
    tokens = model_queries._sentences(spark, "/root/testdata/sf0.001")
    listed_words = labels.predict_word_list(tokens.where("doc_id % 2 = 1"), labels.word_list_tagger(tokens.where("doc_id % 2 = 0")))
    assert f1(rows.collect()) > f1(listed_words.collect())


def test_tagger_without_rows(spark):
    none = planted(spark, 1).where("false")
    model = tagger.train(tagger.featured(none, bits=8), ["O", "B-DOCTOR"], bits=8)
    odd = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, ""), (2, 3, 5, "x")], "doc_id long, sent_idx int, tok_idx int, text string")
    said = tagger.tagged(tagger.featured(odd, bits=8, label=None), model).collect()
    assert sorted((r["doc_id"], r["sent_idx"], r["tok_idx"], r["predicted"]) for r in said) == [(1, 0, 0, "O"), (1, 0, 1, "O"), (2, 3, 5, "O")]
    assert tagger.tagged(tagger.featured(none, bits=8), model).count() == 0


def test_tagger_learns_from_every_sentence(spark, monkeypatch):
    """What the query learns from is all sentences of the documents with even ids, none left out."""
    given = []
    monkeypatch.setattr(tagger, "train", lambda sentences, known: given.append(sentences.count()) or tagger.Tagger(known, 18, np.zeros((1 << 18, len(known))), np.zeros((len(known),) * 2)))
    model_queries.sequence_tagger(spark, "/root/testdata/sf0.01")
    sentences = T.scorer_sentence_words(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0"), "text", "doc_id")
    assert given == [sentences.count()]


def test_mislabelled_sentences_are_those_that_viterbi_labels_otherwise():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for first in (0.0, 3.0, 12.0):  # from no sentence that is certain to nearly all
        unary, steps = rng.normal(size=(64, 3)), rng.normal(size=(3, 3))
        unary[:, 0] += first / 4
        sizes = [0, *rng.integers(0, 6, 200).tolist(), 0]
        features = [rng.integers(0, 64, (n, 4)).tolist() for n in sizes]
        paths = [tagger.viterbi(unary[np.array(f)].sum(1)[None], steps)[0].tolist() if f else [] for f in features]
        ys = [[(y + (rng.random() < 0.1)) % 3 for y in p] for p in paths]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(ys))), pa.array(features, pa.list_(pa.list_(pa.int32()))), pa.array(ys, pa.list_(pa.int32()))], names=["i", "features", "ys"])
        for part in (batch, batch.slice(7, 90)):
            got = [i for b in tagger._mislabelled(iter([part]), unary, steps) for i in b.column("i").to_pylist()]
            assert got == [i for i in part.column("i").to_pylist() if ys[i] != paths[i]]


def test_tagger_in_shards(spark, monkeypatch):
    monkeypatch.setattr(tagger, "SHARD", 25)
    tokens = planted(spark, 200)
    rows = tagger.featured(tokens, bits=14).cache()
    model = tagger.train(rows.where("doc_id % 2 = 0"), ["O", "B-DOCTOR"], bits=14)
    assert f1(tokens.join(tagger.tagged(rows.where("doc_id % 2 = 1"), model), ["doc_id", "sent_idx", "tok_idx"]).collect()) > 0.9


# --- subword vectors ------------------------------------------------------------------------------


def fnv(gram):
    h = 2166136261
    for b in gram.encode():
        h = ((h ^ (b if b < 128 else b + 0xFFFFFF00)) * 16777619) & 0xFFFFFFFF
    return h


def grams_of(word):
    w = f"<{word}>"
    return [w[i : i + n] for n in range(3, 7) for i in range(len(w) - n + 1)] if word else []


def test_ngrams_and_buckets(spark):
    words = ["a", "ab", "straße", "漢字かな", "", "x" * 40, "😀b"]
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", subword.ngrams(F.col("word")).alias("g"), F.transform(subword.ngrams(F.col("word")), lambda g: subword.bucket(g, 1 << 32)).alias("b")).collect()
    assert {r["word"]: r["g"] for r in got} == {w: grams_of(w) for w in words}
    assert all(r["b"] == [fnv(g) for g in r["g"]] for r in got)
    assert fnv("a") == 0xE40C292C  # published value of the hash


def test_vectors_of_unknown_words(spark):
    rng = np.random.default_rng(2)
    table = {b: rng.normal(size=4).tolist() for b in range(50) if b % 7}
    grams = spark.createDataFrame([(b, v) for b, v in table.items()], "bucket long, vec array<double>")
    known = spark.createDataFrame([("apple", [1.0, 2.0, 3.0, 4.0]), ("zero", [0.0] * 4)], "word string, vec array<double>")
    words = spark.createDataFrame([("apple",), ("aaaaaa",), ("aaaaaa",), ("pear",), (None,), ("",), ("long" * 500,)], "word string")
    got = {r["word"]: r for r in subword.word_vectors(words, grams, known, 4, 50, l2=False).collect()}
    assert set(got) == {"apple", "aaaaaa", "pear", "", "long" * 500}
    for w, r in got.items():
        found = [table[fnv(g) % 50] for g in grams_of(w) if fnv(g) % 50 in table] + ([[1.0, 2.0, 3.0, 4.0]] if w == "apple" else [])
        assert r["n_known"] == len(found)
        if found:
            assert np.allclose(r["vec"], np.mean(found, axis=0))
        else:
            assert 0 < np.linalg.norm(r["vec"]) < 1e-4
    unit = subword.word_vectors(words, grams, known, 4, 50).collect()
    assert all(np.linalg.norm(r["vec"]) == pytest.approx(1) for r in unit)


# --- contextual vectors ---------------------------------------------------------------------------


def test_cache_encodes_each_sentence_once(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abcdefg") for _ in range(rng.randrange(0, 5))]) for i in range(500)] + [(500, None)]
    df = spark.createDataFrame(rows, "id int, words array<string>")
    cache = contextual.SentenceCache(fresh_path(spark, "cache"), contextual.NeighbourEncoder(3))
    distinct = {" ".join(w) for _, w in rows if w}
    half = {" ".join(w) for i, w in rows if w and i < 250}
    assert cache.fill(df.where("id < 250")) == len(half)
    assert cache.fill(df) == len(distinct - half)
    assert cache.fill(df) == 0
    got = {r["id"]: r["matrix"] for r in cache.lookup(df).collect()}
    assert set(got) == set(range(501)) and got[500] is None
    for i, w in rows[:500]:
        want = contextual.NeighbourEncoder(3)([list(w)], [len(w)])[0] if w else np.zeros((0, 3))
        assert np.allclose(np.array(got[i]).reshape(-1, 3), want)


def test_lookup_exchanges_no_vectors_for_sums(spark):
    df = spark.createDataFrame([(i, ["a", "b", str(i % 7)][: i % 4]) for i in range(60)], "id int, words array<string>")
    cache = contextual.SentenceCache(fresh_path(spark, "cache"), contextual.NeighbourEncoder(3))
    cache.fill(df)
    found = cache.lookup(df, made=contextual.weighted_sums)
    for r in found.collect():
        m = contextual.NeighbourEncoder(3)([r["words"]], [len(r["words"])])[0] if r["words"] else None
        want = None if m is None else sum(x * (p + 1 + 10 * j) for p, row in enumerate(m) for j, x in enumerate(row))
        assert r["weighted"] == (want if want is None else pytest.approx(want))


def test_cache_errors(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, words array<string>")
    cache = contextual.SentenceCache(fresh_path(spark, "cache"), contextual.NeighbourEncoder(3))
    with pytest.raises(ValueError, match="no sentence"):
        cache.lookup(df)
    cache.fill(df)
    with pytest.raises(Exception, match="not in the cache"):
        cache.lookup(spark.createDataFrame([(1, ["b", "a"])], "id int, words array<string>")).collect()
    with pytest.raises(TypeError, match="sentence"):
        cache.lookup_word("a")


def test_batches_are_bounded_and_padded_alike(spark):
    def counting(rows, lengths):
        """The number of rows of the batch, for each of its words."""
        if any(len(r) != max(lengths) for r in rows):
            raise ValueError("not padded alike")
        return np.full((len(rows), max(lengths), 1), float(len(rows)))

    df = spark.createDataFrame([(i, ["w"] * (1 + i % 40) + [str(i)]) for i in range(300)], "id int, words array<string>")
    cache = contextual.SentenceCache(fresh_path(spark, "cache"), counting, batch=16)
    assert cache.fill(df) == 300
    assert all(1 <= r["matrix"][0][0] <= 16 and len(r["matrix"]) == len(r["words"]) for r in cache.lookup(df).collect())


def test_padding_by_batch(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["d"]), (2, ["e"]), (2, []), (3, ["f"] * 50)], "batch int, words array<string>")
    got = sorted((r["batch"], r["n_words"], len(r["padded"])) for r in lookup.padded(df, batch="batch").collect())
    assert got == [(1, 1, 3), (1, 3, 3), (2, 0, 1), (2, 1, 1), (3, 50, 50)]


# --- adversaries ----------------------------------------------------------------------------------


def named_vectors(spark, x):
    return spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "id long, vec array<double>")


def test_discriminator_by_noise(spark):
    x = np.random.default_rng(4).normal(size=(600, 16))
    for multiplicative in (False, True):
        got = {r["scale"]: r for r in adversary.discriminate(named_vectors(spark, x), [0.05, 1.0, 300.0], multiplicative).collect()}
        assert got[0.05]["accuracy"] > 0.99 and got[0.05]["loss"] < 0.2
        assert got[300.0]["accuracy"] < (0.6 if not multiplicative else 0.75)
        assert got[0.05]["accuracy"] >= got[1.0]["accuracy"] >= got[300.0]["accuracy"] - 0.05
        for r in got.values():
            assert r["n"] == 600 and r["discriminator_loss"] == max(r["loss"], math.log(2)) and r["objective"] == pytest.approx(abs(r["loss"] - math.log(2)))


def test_pairs_and_features(spark):
    x = np.random.default_rng(5).normal(size=(11, 3))
    rows = adversary.representations(named_vectors(spark, x))
    both = adversary.pairs(rows).collect()
    assert len(both) == 22 and sum(r["same"] for r in both) == 11 and sorted({r["place"] for r in both}) == list(range(11))
    assert all((r["x"] == r["other"]) == bool(r["same"]) and r["a"] != r["b"] for r in both)
    for r in adversary.pair_features(adversary.pairs(rows), [0.5]).join(adversary.pairs(rows), ["place", "same"]).collect():
        u, v = np.array(r["x"]) + 0.5 * np.array(r["a"]), np.array(r["other"]) + 0.5 * np.array(r["b"])
        lengths = np.linalg.norm(u), np.linalg.norm(v)
        assert np.allclose(r["f"], [u @ v / lengths[0] / lengths[1], np.linalg.norm(u - v) / (1 + sum(lengths)), abs(lengths[0] - lengths[1]) / (1 + sum(lengths)), 1])


def test_newton_steps_reach_the_optimum(spark):
    x = np.random.default_rng(6).normal(size=(300, 4))
    features = adversary.pair_features(adversary.pairs(adversary.representations(named_vectors(spark, x))), [0.7, 2.0]).cache()
    weights = adversary.fit_discriminators(features, [0.7, 2.0], steps=12)
    for scale, w in weights.items():
        rows = [(r["f"], r["same"]) for r in features.where((F.col("scale") == scale) & (F.col("place") % 2 == 1)).collect()]
        f, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
        slope = ((y - 1 / (1 + np.exp(-f @ w)))[:, None] * f).mean(0) - adversary.RIDGE * w
        assert np.abs(slope).max() < 1e-6


def test_least_noise(spark):
    x = np.random.default_rng(7).normal(size=(800, 8))
    found = adversary.least_noise(named_vectors(spark, x), 0.01, 100.0, rounds=2, each=6)
    assert found.scale is not None and 0.5 < found.scale <= 100
    assert all(a > 0.9 for s, a in found.tried if s < 0.2)
    # twice the vectors need twice the noise, about
    doubled = adversary.least_noise(named_vectors(spark, 8 * x), 0.01, 1000.0, rounds=2, each=6)
    assert doubled.scale > 2 * found.scale
    # vectors that are all alike are at chance whatever the noise
    alike = adversary.least_noise(named_vectors(spark, np.ones((400, 8))), 0.01, 1.0, rounds=1, each=3, within=0.1)
    assert alike.scale == pytest.approx(0.01)


def test_noise_by_component(spark):
    """A component that never varies carries nothing, and gets no noise."""
    x = np.random.default_rng(8).normal(size=(100, 3)) * [1.0, 5.0, 0.0] + [0.0, 0.0, 2.0]
    rows = adversary.representations(named_vectors(spark, x), by_component=True).collect()
    z = np.array([r["first"] for r in rows])
    assert np.allclose(z[:, 2], 0) and z[:, 1].std() > 2.5 * z[:, 0].std()


def test_reidentification(spark):
    x = np.random.default_rng(9).normal(size=(500, 6))
    little, much = (adversary.reidentify(named_vectors(spark, x), s).first() for s in (0.01, 3.0))
    assert little["n"] == 250 and little["cosine"] > 0.99 > 0.6 > much["cosine"] and little["error"] < much["error"]
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (None, [1.0, 1.0])], "id long, vec array<double>")
    assert adversary.reidentify(odd, 0.1).first()["n"] == 0
    assert adversary.discriminate(odd, [0.1]).count() == 0


def test_bio_alignment_of_untouched_documents(spark):
    docs = spark.createDataFrame([(1, "no span here"), (2, "mail a.b@x.org now"), (3, "")], "doc_id long, text string")
    rows = T.scorer_sentences(docs, "text", "doc_id").withColumnRenamed("token", "text")
    got = {(r["doc_id"], r["text"]): r["type"] for r in spans.bio_align(rows.drop("pre_ws", "post_ws"), spans.detect(docs, GOLD)).collect()}
    assert got[1, "here"] == got[2, "mail"] == "O" and got[2, "a"] == "B-EMAIL" and got[2, "org"] == "I-EMAIL" and len(got) == 9
