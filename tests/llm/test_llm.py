"""Each training-data operator against brute force, a round trip or held-out labels, and its edge cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from maskwright.llm import bloom_lm, components, decontamination, langid, multi_index, packing, parity_join, quality, secret_scan, token_files, toxicity
from maskwright.llm.common import in_portions, remainder, scratch_path
from maskwright.llm.tokens import ChunkEncoder, tokenizer_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long, repeated and tied texts, and a column named like an output."""
    texts = [None, "", " \t\n", "a", "x " * 30_000, "same text here", "same text here", "Ünï ÇØdé 漢字", "!!! ???"]
    return docs_of(spark, texts).withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash")).unionByName(
        spark.createDataFrame([(5, "same text here", None, None, None, "clash", "clash"), (None, "no id", None, None, None, "clash", "clash")], DOC + ", score string, label string")
    )


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# --- shared helpers ---------------------------------------------------------------------------


def test_portions():
    assert list(in_portions([], 5)) == []
    assert list(in_portions([9, 1, 1, 9], 5)) == [(0, 1), (1, 3), (3, 4)]
    assert list(in_portions([0, 0], 5)) == [(0, 2)]


def test_remainder(spark):
    row = spark.createDataFrame([(12,), (None,)], "doc_id long").select(remainder("doc_id", 7).alias("r")).collect()
    assert [r["r"] for r in row] == [zlib.crc32(b"12") % 7, -1]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 quality ----------------------------------------------------------------------------------


def test_quality_held_out():
    rng = random.Random(1)

    def doc(good):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 300))]
        if not good:
            at = rng.randrange(len(words))
            words[at:] = [w + "***" for w in words[at:]] if rng.random() < 0.5 else [words[at]] * (len(words) - at)
        return " ".join(words)

    data = [(doc(y), y) for y in [rng.random() < 0.7 for _ in range(500)]]
    features = quality.PassageFeatures()
    model = quality.fit([(features([t])[0], int(y)) for t, y in data[:350]])
    scores = quality.forward(model, *features([t for t, _ in data[350:]]))["score"]
    assert np.mean((scores >= quality.THRESHOLD) == [y for _, y in data[350:]]) > 0.85
    assert quality.fit([(features(["a"])[0], 1)]) is None


def test_quality_attention_gradient():
    rng = np.random.default_rng(0)
    p = {"W": rng.normal(size=(quality.FEATURES, quality.HIDDEN)), "b": np.zeros(quality.HIDDEN), "V": rng.normal(size=(quality.HIDDEN, quality.ATTENTION)), "U": rng.normal(size=(quality.HIDDEN, quality.ATTENTION)),
         "w": rng.normal(size=quality.ATTENTION), "c": rng.normal(size=quality.HIDDEN), "d": np.zeros(1)}
    f = quality.forward(p, rng.normal(size=(5, quality.FEATURES)), np.array([0, 0, 0, 1, 1]))
    assert np.add.reduceat(f["a"], f["starts"]) == pytest.approx([1, 1])


def test_quality_edges(spark, odd):
    rows = quality.score(odd, None).collect()
    assert len(rows) == 11 and {r["score"] for r in rows} == {0.5}
    model = quality.train(docs_of(spark, ["good words here"] * 20 + ["BAD!! BAD!!"] * 20), spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)], "doc_id long, quality int, toxic int"), F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, model).collect())
    assert quality.accepted(odd, model).columns == odd.columns
    assert quality.score(odd.limit(0), model).count() == 0


# --- 2 token files -------------------------------------------------------------------------------


def test_encoder_equals_library():
    rng = random.Random(5)
    alphabet = "aB é\n\n  .,'!?0 9\t\r\x1c\xa0ñ漢😀s'll<|endoftext|>ßÆµªİΣ"
    for name, ends in ((token_files.TOKENIZER, False), (packing.TOKENIZER, True)):
        e = ChunkEncoder(tokenizer_path(name), ends, limit=50)
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
            assert e.encode(text) == e.whole(text)


def test_token_files_round_trip(spark, documents, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(token_files.TOKENIZER))
    tokenizer.encode_special_tokens = True
    for table in (documents, odd):
        out = scratch_path(spark, "t")
        manifest = token_files.write_tokens(table, out, partitions=3)
        rows = token_files.read_tokens(spark, out, manifest).orderBy("start").collect()
        want = sorted(((r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        assert [r["doc_id"] for r in rows] == [d for d, _ in want]
        start = 0
        for r in rows:
            assert r["start"] == start
            start += r["n_tokens"]
        if table is documents:
            for r, (_, text) in zip(rows, want, strict=True):
                assert np.frombuffer(r["ids"], "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
            one = manifest.orderBy("shard").first()
            shard = token_files.Shard(f"{out}/{one['file']}")
            k = shard.find(want[7][0])
            assert len(k) == 1 and shard.ids(k[0]).tolist() == np.frombuffer(rows[7]["ids"], "<u4").tolist()
            assert shard.find(-5) == []
            with pytest.raises(ValueError, match="another dictionary"):
                token_files.Shard(f"{out}/{one['file']}", b"other")
    empty = token_files.write_tokens(documents.limit(0), out := scratch_path(spark, "t"))
    assert token_files.read_digests(spark, out, empty).count() == 0


# --- 3 language -----------------------------------------------------------------------------------


def test_language(spark, documents, odd):
    keep = remainder("doc_id", 4) != 2
    model = langid.train(documents, keep)
    truth = documents.where(~keep).select("doc_id", F.col("lang").alias("true_lang"))
    got = langid.predict(documents, model).join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("true_lang")).cast("double"))).first()[0]
    assert got > 0.9
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).where("doc_id is not null").collect()}
    assert all(rows[i]["lang"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 8))
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert {r["lang"] for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.train(documents.limit(0), keep) is None


def test_language_rejects(spark, documents):
    model = langid.train(documents, remainder("doc_id", 4) != 2)
    far = docs_of(spark, ["ζξψω χφυτ σρπο " * 20])
    row = langid.predict(far, model).first()
    assert row["accepted"] == "und" and row["lang"] != "und"


# --- 4 multi-index ---------------------------------------------------------------------------------


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    cells = list(multi_index.multi_sequence(a, b, 10.0))
    assert len({(i, j) for i, j, _ in cells}) == 63
    over = [o for _, _, o in cells]
    assert over == sorted(over) and over[0] == 0
    some = list(multi_index.multi_sequence(a, b, 0.5))
    assert len(some) == sum(x + y - a.min() - b.min() <= 0.5 for x in a for y in b)


def test_vector_links(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 60)  # parts and chunks
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x[100:220] = x[0] + rng.normal(size=(120, 16)) * 0.09  # one large group
    x[220:260] = x[1]
    x[260:300] = x[300:340] + rng.normal(size=(40, 16)) * 0.05
    rows = [(i, x[i].astype(np.float32).tolist(), 0, "c") for i in range(400)]
    rows += [(1000, None, 0, "c"), (1001, [0.0] * 16, 0, "c"), (1002, [float("nan")] * 16, 0, "c"), (1003, [], 0, "c"), (1004, [1.0, None], 0, "c"), (1005, [1.0] * 3, 0, "c"), (1006, [2.0] * 3, 0, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block string")
    got = {r["vec_id"]: r for r in multi_index.vector_links(df).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.95
    want = near.sum(1) - 1
    links = np.array([got[i]["n_links"] for i in range(400)])
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(1000, 1005))
    assert got[1005]["n_links"] == 1 and got[1006]["component_id"] == 1005
    assert got[221]["component_id"] == 1 and not got[221]["kept"]
    assert multi_index.vector_links(df.limit(0)).count() == 0


# --- 5 secrets ----------------------------------------------------------------------------------------


def test_guess_costs():
    ranks = {w: k + 1 for k, w in enumerate(secret_scan.COMMON)}
    cost = {v: secret_scan.log10_guesses(v, ranks) for v in ("password1", "sunshine2019", "qwertyuiop", "aaaaaaaaaaaaaaa", "2019-05-11", "xK93jf8Qz2Lp", "abcabcabcabc")}
    assert all(c < secret_scan.MIN_LOG10_GUESSES for v, c in cost.items() if v != "xK93jf8Qz2Lp") and cost["xK93jf8Qz2Lp"] > secret_scan.MIN_LOG10_GUESSES
    brute = secret_scan.log10_guesses("zqxjkvbw", {})
    assert brute == pytest.approx(8 * math.log10(26))  # nothing is cheaper
    assert secret_scan.log10_guesses("", {}) == 0


def brute_base(text):
    """The base patterns as stated: all matches, then those that are too short are dropped."""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_secret_spans():
    rng = random.Random(9)
    parts = ["token", "PassWord", "api_key", "apikey", "=", ": ", '"', "AKIA", "ABCDEF0123", "deadbeef", "0123456789", " ", "é", "😀", "-x_", "secret is Zq8!kd93Lm,", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        spans = secret_scan.spans_of(text, {})
        assert [s for s in spans if s[0] != "guess"] == brute_base(text)
        for kind, a, b in spans:
            assert 0 <= a < b <= len(text)
    assert secret_scan.spans_of("😀 login: Zq8!kd93Lm. ", {}) == [("guess", 9, 19)]


def test_secret_is_no_word_of_its_own(spark):
    copies = ["The password is Xkqjvbnmzwrt today"] * 50
    others = ["password: Xkqjvbnmzwrt evening", "token = Xkqjvbnmzwrt evening", "mypassword=Qzxjkvwqhgfp here", "again mypassword=Qzxjkvwqhgfp there", "now password is Xkqjvbnmzwrt again"]
    docs = docs_of(spark, [*copies, *others, None, ""])
    ranks = secret_scan.word_ranks(docs)
    assert "xkqjvbnmzwrt" not in ranks and "qzxjkvwqhgfp" not in ranks and "today" not in ranks and {"again", "evening"} <= set(ranks)
    assert all(r["spans"] for r in secret_scan.scan(docs.where("text like '%Xkq%'"), ranks).collect())


def test_secrets_beside_base_spans(spark):
    for text, base in (("password: Abcdefgh1234$Zq8!Lm2@Xw", ("assign", 0, 22)), ("pwd: Zk!Q#deadbeefdeadbeef00%Qx&7T", ("hex", 10, 28))):
        start = text.index(" ") + 1
        assert sorted(secret_scan.spans_of(text, {})) == sorted([base, ("guess", start, len(text))])
        assert "[SECRET]" in (left := secret_scan.redact(docs_of(spark, [text]), {}).first()["text"]) and not any(x in left for x in ("Zq8", "Xw", "Zk!", "7T"))
    assert secret_scan.spans_of("password: Abcdefgh1234Zq8Lm2Xw", {}) == [("assign", 0, 30), ("guess", 10, 30)]  # values in a base span are scored as well


def test_every_credential_value_is_scored(spark):
    ranks = {w: k + 1 for k, w in enumerate([*secret_scan.COMMON, "sunny", "horse", "battery"])}
    strong = ["xK93jf8Qz2Lp", "Vt7#mQ2z!Rk9", "zq8kd93lmw4t7b", "h7G-p2Q-x9Z-m4K"]
    weak = ["sunshine2019", "P@ssw0rd2019", "qwertyuiopqwertyuiop", "aaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabcabc", "horsebattery", "2019-05-11", "ab" * 4000]
    texts = [f"note {cue} {v}, then more" for v in strong + weak for cue in ("password:", "PASSWD =", "api_key =>", "token is")]
    rows = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs_of(spark, texts), ranks).collect()}
    for k, text in enumerate(texts):
        value = (strong + weak)[k // 4]
        want = [(text.index(value), text.index(value) + len(value))] if value in strong else []
        if "PASSWD" in text:  # no cue of its own in the list
            continue
        assert [(s["start"], s["end"]) for s in rows[k] if s["kind"] == "guess"] == want, text[:60]
    assert rows[0] and [s["kind"] for s in rows[0]] == ["assign", "guess"]


def test_guess_cost_equals_all_segmentations():
    """The dynamic program against every way to cut a short value."""
    ranks = {"cat": 1, "dog": 5, "catdog": 40}

    def piece(v):  # the least cost of one segment
        costs = [sum(map(secret_scan._alphabet, v))]
        if v.lower() in ranks:
            costs.append(math.log10(ranks[v.lower()] + 1) + (0 if v.islower() else 0.3 if v[0].isupper() and v[1:].islower() or v.isupper() else 1.0))
        for unit in (1, 2, 3, 4):
            if len(v) % unit == 0 and v == v[:unit] * (len(v) // unit) and len(v) >= 2 * unit and len(v) > (2 if unit == 1 else 4):
                costs.append(sum(map(secret_scan._alphabet, v[:unit])) + math.log10(len(v) / unit))
        return min(costs)

    def brute(v):
        return min(sum(piece(v[a:b]) for a, b in zip((0, *cuts), (*cuts, len(v)), strict=True)) + 0.5 * len(cuts) for r in range(len(v)) for cuts in itertools.combinations(range(1, len(v)), r))

    rng = random.Random(4)
    for _ in range(150):
        value = "".join(rng.choice(["cat", "Dog", "x", "zz", "mm", "b", "vvv"]) for _ in range(rng.randint(1, 4)))[:10]
        assert secret_scan.log10_guesses(value, ranks) <= brute(value) + 1e-9
        if not any(b in secret_scan._NEXT.get(a, ()) for a, b in zip(value.lower(), value.lower()[1:], strict=False)):
            assert secret_scan.log10_guesses(value, ranks) == pytest.approx(brute(value))


def test_secret_table(spark, odd):
    assert secret_scan.scan(odd, {}).count() == 11
    docs = docs_of(spark, ["my token = 0123456789abcdef0123 end", None, "fine"])
    out = {r["doc_id"]: r for r in secret_scan.redact(docs, {}).collect()}
    assert out[0]["text"] == "my [SECRET] end" and out[0]["n_chars"] == 15 and out[1]["text"] is None and out[2]["text"] == "fine"
    assert secret_scan.word_ranks(docs_of(spark, ["Blue blue, red", "blue"]))["blue"] == len(secret_scan.COMMON) + 1


# --- 6 decontamination -----------------------------------------------------------------------------


def test_decontamination(spark):
    item = "alice had 12 apples and met Robert who gave 7 km of rope to Robert near the old harbour town before sunset came"
    other = "completely different words that nobody would ever put into a document by chance alone or otherwise at any time"
    bench = spark.createDataFrame([(1, item), (2, other), (3, "too short"), (4, None), (None, item)], "item_id long, text string")
    same = item.replace("12", "99").replace("Robert", "Martin").replace("7 km", "3 miles")
    broken = item.replace("met Robert", "met Martin").replace("to Robert", "to Gerald")
    texts = [f"Intro words. {item} And more.", f"Filler here. {same} And so on.", f"Filler here. {broken} And so on.", other[:40], "clean text of no interest to anyone", None, "", item.upper()]
    docs = docs_of(spark, texts).withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert {(0, 1), (1, 1)} <= got <= {(0, 1), (1, 1), (2, 1)}
    share = {r["doc_id"]: r for r in decontamination.contaminated(docs, bench, 0.0).collect()}
    assert share[2]["n_matched"] < share[1]["n_matched"]  # the two Roberts disagree
    left = {r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()}
    assert left >= {3, 4, 5, 6, 7} and not left & {0, 1}
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


# --- 7 packing ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 40, 5000])
def test_solve(n):
    rng = np.random.default_rng(n)
    counts = np.bincount(np.minimum(rng.lognormal(4, 1, n).astype(int) + 1, 300), minlength=301)
    plan = packing.solve(counts, 300, rounds=60)
    got = np.zeros(301, int)
    for contents, times in plan:
        assert sum(k * v for k, v in contents.items()) <= 300 and times > 0
        for k, v in contents.items():
            got[k] += v * times
    assert (got == counts).all()
    used, bound = sum(t for _, t in plan), -(-(counts * np.arange(301)).sum() // 300)
    assert used <= bound * 1.02 + 2


def test_knapsack():
    prices = np.zeros(11)
    prices[[3, 4, 7]] = 3.0, 5.0, 7.5
    made = packing.knapsack(prices, np.full(11, 9), 10)
    assert made[3] == 2 and made[4] == 1  # 11, against 10.5 and 10


@pytest.mark.parametrize("times", [1, 300])
def test_configurations_hold_most_pieces(times):
    rng = np.random.default_rng(5)
    counts = np.bincount(np.minimum(rng.lognormal(4, 1, 5000).astype(int) + 1, 300), minlength=301) * times
    uses, left = packing.configurations(counts, 300)
    sizes = np.arange(301)
    assert all(sum(k * v for k, v in contents.items()) >= packing.FILLED * 300 for contents, _ in uses)
    assert (left >= 0).all() and left @ sizes <= 0.02 * (counts @ sizes)
    assert sum(t for _, t in packing.solve(counts, 300)) <= 1.001 * -(-(counts @ sizes) // 300) + 1


def test_fullest_equals_all_subsets():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.randint(1, 30)
        limits = np.zeros(capacity + 1, np.int64)
        for _ in range(rng.randint(0, 4)):
            limits[rng.randint(1, capacity)] = rng.randint(0, 3)
        lengths = np.flatnonzero(limits).tolist()
        sums = [sum(k * x for k, x in zip(lengths, some, strict=True)) for some in itertools.product(*(range(int(limits[x]) + 1) for x in lengths))]
        made = packing.fullest(limits, capacity)
        assert (made <= limits).all() and int(made @ np.arange(capacity + 1)) == max(s for s in sums if s <= capacity)


@pytest.mark.parametrize("times", [1, 30])
def test_configurations_pack_most_sequences(times):
    """Sequences come from the configuration program, few from best fit, and the gap to the bound is small."""
    rng = np.random.default_rng(8)
    counts = np.bincount(np.minimum(rng.lognormal(6, 0.8, 6000).astype(int) + 1, 2048), minlength=2049) * times
    found = packing.solved(counts)
    assert found["sequences"] == sum(t for _, t in found["plan"]) == found["by_configurations"] + found["by_best_fit"]
    assert found["by_configurations"] >= 0.9 * found["sequences"] and 0 <= found["gap"] <= 1 + 0.002 * found["bound"]


@pytest.fixture(scope="module")
def lengths(spark):
    """How many pieces of each length the given documents have."""
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).groupBy("length").count().collect()
    return np.bincount([r["length"] for r in rows], [r["count"] for r in rows], minlength=2049).astype(np.int64)


@pytest.mark.parametrize("times", [1, 10, 30, 300])
def test_configurations_at_every_size(lengths, times):
    """On the lengths of the given documents, and as many times more, sequences stay those of the configuration program."""
    found = packing.solved(lengths * times)
    assert found["by_configurations"] >= 0.9 * found["sequences"] and 0 <= found["gap"] <= 1 + 0.0001 * found["bound"]


def test_packing(spark, documents, odd):
    for table, capacity in ((documents, 512), (odd, 2048)):
        rows = packing.pack(table, capacity=capacity).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        assert sum(r["length"] for r in rows) <= len(by) * capacity
        own = defaultdict(list)
        for r in rows:
            own[r["doc_id"]].append(r)
        if table is documents:
            assert all(r["start"] == r["piece"] * capacity for r in rows) and set(own) == {r["doc_id"] for r in documents.select("doc_id").collect()}
            assert len(by) <= 1.02 * -(-sum(r["length"] for r in rows) // capacity) + 2
    assert packing.pack(odd.limit(0)).count() == 0


# --- 8 toxicity -------------------------------------------------------------------------------------------


def test_factorization_learns_pairs():
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(200)]
    data = []
    for _ in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(filler, 12) + ["zork"] * insult + ["mibs"] * group
        data.append((" ".join(words), int(insult and group)))
    terms = toxicity.Terms()
    model = toxicity.fit([(terms.of([t])[1], y) for t, y in data[:900]], epochs=30)
    z, _ = toxicity.logits(model, 300, *terms.of([t for t, _ in data[900:]], model["active"]))
    assert np.mean((z > 0) == [y for _, y in data[900:]]) > 0.95


def test_factorization_equals_pair_sum():
    rng = np.random.default_rng(0)
    model = {"w0": 0.3, "w": rng.normal(size=toxicity.BUCKETS), "V": rng.normal(size=(toxicity.BUCKETS, toxicity.FACTORS))}
    ids = np.array([3, 9, 27, 81])
    z, _ = toxicity.logits(model, 1, np.zeros(4, int), ids)
    want = 0.3 + model["w"][ids].sum() + sum(model["V"][a] @ model["V"][b] for i, a in enumerate(ids) for b in ids[i + 1 :])
    assert z[0] == pytest.approx(want)


def test_toxicity_edges(spark, odd):
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
    model = toxicity.train(docs_of(spark, ["you idiot"] * 20 + ["nice day"] * 20), spark.createDataFrame([(i, 0, int(i < 20)) for i in range(40)], "doc_id long, quality int, toxic int"), F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)


# --- 9 Jaccard join -----------------------------------------------------------------------------------------


def shingle_set(text, n):
    w = words_of(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, threshold):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and len(s & t) >= threshold * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("n", "threshold"), [(3, Fraction(9, 10)), (5, Fraction(8, 10)), (1, Fraction(1, 2))])
def test_jaccard(spark, n, threshold):
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append("  ".join(copy).upper())
    texts += [None, "", " \n", "same three words", "Same three\twords"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(docs_of(spark, texts), n, threshold).collect()}
    assert got == brute_components(rows, n, threshold)


def test_sketch_bounds_difference():
    """Sets within the bound share a key, always; and blank words are not needed for that."""
    rng = np.random.default_rng(6)
    threshold = Fraction(8, 10)
    for _ in range(400):
        size = int(rng.choice([1, 2, 3, 6, 12, 40, 150]))
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        b = a.copy()
        for k in range(size):
            b[rng.integers(size)] = rng.integers(0, 1 << 63, dtype=np.uint64)
            x, y = np.unique(a), np.unique(b)
            common = len(np.intersect1d(x, y))
            if common < threshold * (len(x) + len(y) - common):
                break
            number, keys = parity_join.sketch_keys([x, y], threshold)
            assert set(keys[number == 0].tolist()) & set(keys[number == 1].tolist())


def test_jaccard_edges(spark, odd):
    rows = parity_join.jaccard_components(odd, 3, Fraction(9, 10)).collect()
    assert len(rows) == 11
    assert sorted(r["component_id"] for r in rows if r["doc_id"] in (5, 6)) == [5, 5, 5]
    kept = parity_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert parity_join.jaccard_components(odd.limit(0)).count() == 0


# --- 10 language model --------------------------------------------------------------------------------------


def test_bloom_filter():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    levels = rng.integers(1, 6, len(keys))
    size = int(levels.sum() * bloom_lm.BITS_PER_LEVEL // 8 // 16) + 1
    at = bloom_lm.LogBloom.range_of(keys, 16)
    bits = np.zeros((16, size), np.uint8)
    for r in range(16):
        bits[r] = np.frombuffer(bloom_lm.LogBloom.fill(keys[at == r], levels[at == r], size), np.uint8)
    own = bloom_lm.LogBloom(bits, 16)
    got = own(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.95  # errors only raise
    assert (own(keys + np.uint64(1)) > 0).mean() < 0.05


def brute_lm(rows, keep):
    words = {i: [*words_of(t), None] for i, t in rows}
    uni = Counter(w for i in words if keep(i) for w in words[i])
    total, distinct = sum(uni.values()), len(uni)
    base = {i: sum(math.log10((uni[w] + 1) / (total + distinct + 1)) for w in ws) for i, ws in words.items()}
    return {i: (len(ws), sum(uni[w] > 0 for w in ws), base[i]) for i, ws in words.items()}, total


def counted(texts):
    words = [[*words_of(t), None] for t in texts]
    uni = Counter(w for ws in words for w in ws)
    bi = Counter((h, w) for ws in words for h, w in zip([None, *ws], ws, strict=False))
    return words, uni, bi


def levels_of(counts):
    counts = np.array(counts)
    return bloom_lm.level(counts) * (counts > 0)


def test_probabilities_add_up_to_one_at_most():
    """For every history, over all words and an unknown one, with the levels that a filter without errors gives."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)], k=rng.randint(0, 80))) for _ in range(120)]
    _, uni, bi = counted(texts)
    vocabulary = [*uni, "never seen"]
    lw = levels_of([uni[w] for w in vocabulary])
    belief = bloom_lm.Belief(sum(uni.values()), Counter(lw[:-1].tolist()), 0.0, 0.0)
    for h in vocabulary:
        p = belief.probabilities(levels_of([bi[h, w] for w in vocabulary]), np.full(len(vocabulary), levels_of([uni[h]])[0]), lw)
        assert (p > 0).all() and p.sum() <= 1 + 1e-9


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_probabilities_add_up_through_the_filter(spark, size):
    """Sums over the whole vocabulary with what the filter says, false hits included; V grows eightfold between the sizes."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    model = bloom_lm.train(docs)
    shape = model["filter"]
    told = bloom_lm._load_filter(tuple(shape["path"]), 0, shape["ranges"], shape["range_bytes"])
    words = [(r["word"].encode(), r["n"]) for r in model["words"].orderBy(F.desc("n"), "word").collect()]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w, _ in words], np.uint64)
    levels = told(bloom_lm.unigram_key(hashes))
    belief = bloom_lm.Belief(model["N"], model["by_level"], *shape["errors"])
    n = np.array([c for _, c in words])
    some = np.r_[np.arange(10), np.flatnonzero((n > 5) & (n < 40))[:15], np.flatnonzero(n == 1)[:60]]
    false = []
    for h in some:
        pairs = bloom_lm.bigram_keys(np.stack([hashes, np.full(len(hashes), hashes[h])], 1).reshape(-1), np.full(len(hashes), 2))[::2]  # a text's first token follows its last
        hits = told(pairs)
        p = belief.probabilities(hits, np.full(len(hashes), levels[h]), levels)
        assert (p > 0).all() and 0.3 < p.sum() <= 1.001
        if n[h] == 1:
            assert (hits > 0).sum() >= 1  # a word seen once has one follower
            false.append(((hits > 0).sum() - 1) / len(hits))
    assert np.mean(false) == pytest.approx(shape["errors"][0], rel=0.25)  # the error is what it is said to be


def test_counts_beyond_32_bits():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5, dtype=np.uint64))
    row = bloom_lm._blobs(keys, np.full(5, (1 << 33) + 7), 1).to_pylist()[0]
    assert np.frombuffer(row["counts"], "<u8").tolist() == [(1 << 33) + 7] * 5


@pytest.mark.parametrize("small", [False, True])
def test_language_model(spark, documents, monkeypatch, small):
    if small:  # several segments, and most words joined by word
        monkeypatch.setattr(bloom_lm, "FILTER_BYTES", 1 << 16)
        monkeypatch.setattr(bloom_lm, "HEAD_WORDS", 50)
    model = bloom_lm.train(documents.where(remainder("doc_id", 7) != 2))
    assert (model["filter"]["segments"] > 1) == small
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    want, total = brute_lm(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    assert model["N"] == total
    got = bloom_lm.score(documents, model).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (n, known) and r["base_score"] == pytest.approx(base) and r["score"] < 0
    # the same formula on exact counts: the filter's errors move a text's mean by little
    words, uni, bi = counted([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    belief = bloom_lm.Belief(total, Counter(levels_of(list(uni.values())).tolist()), *model["filter"]["errors"])
    exact = {}
    for i, t in rows:
        ws = [*words_of(t), None]
        before = [None, *ws[:-1]]
        p = belief.probabilities(levels_of([bi[x] for x in zip(before, ws, strict=True)]), levels_of([uni[h] for h in before]), levels_of([uni[w] for w in ws]))
        exact[i] = np.log10(p).sum()
    off = np.array([(r["score"] - exact[r["doc_id"]]) / r["n_tokens"] for r in got])
    assert np.abs(off).max() < 0.2 and abs(off.mean()) < 0.02


def test_word_hashes_equal_library():
    rng = random.Random(3)
    texts = ["", " \t\n", "A", "\u00c4\u00df \x0b\x1c\x85 Zz\u00a0b", *("".join(rng.choices("aB\u00e9 \u6f22\n", k=n)) for n in range(200)), "x" * 31 + " " + "y" * 32 + " " + "Z" * 5000]
    tokens = bloom_lm.Tokens(pa.array(["left out", *texts])[1:])
    want = [[*t.encode().lower().split(), b""] for t in texts]
    assert tokens.sizes.tolist() == [len(w) for w in want]
    assert tokens.hashes.tolist() == [xxhash.xxh64_intdigest(w) for ws in want for w in ws]
    assert tokens.words(np.arange(len(tokens.hashes))).to_pylist() == [w.decode() for ws in want for w in ws]


def test_texts_are_passed_once_for_all_segments(spark, documents, monkeypatch):
    """Passing them once for each segment grew with the square of the corpus."""
    monkeypatch.setattr(bloom_lm, "FILTER_BYTES", 1 << 16)
    model = bloom_lm.train(documents)
    assert model["filter"]["segments"] > 2
    monkeypatch.setattr(bloom_lm, "stored", lambda *_: pytest.fail("texts are written again"))
    plan = bloom_lm.score(documents, model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_language_model_edges(spark, odd):
    model = bloom_lm.train(odd.limit(0))
    assert model["N"] == 0 and all(r["base_score"] == 0 for r in bloom_lm.score(odd, model).collect())
    model = bloom_lm.train(odd)
    assert bloom_lm.score(odd, model).count() == 11 and bloom_lm.score(odd.limit(0), model).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------


def test_pipeline(spark, documents):
    import corpus_pipeline

    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = scratch_path(spark, name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append(docs)
    first, second, third, fourth, last = kept
    assert all(d.columns == documents.columns for d in kept[:4])
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    assert ids(first) >= ids(second) >= ids(third) == ids(fourth) == ids(last)
    want = brute_components([(r["doc_id"], r["text"]) for r in first.collect()], 5, Fraction(8, 10))
    assert ids(second) == {c for _, c in want.values()}
    bad = {r["doc_id"] for r in decontamination.contaminated(second, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(third) == ids(second) - bad
    assert not [r for r in fourth.collect() if brute_base(r["text"])]
