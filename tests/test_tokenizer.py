"""The main tokeniser: the cases it is known by, and stripping step by step on random stretches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import tokenizer as K


def tokens_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = [[] for _ in texts]
    for r in K.rule_tokens(df.repartition(3), "text", "id").orderBy("id", "ord").collect():
        assert texts[r["id"]][r["start"] : r["end"]] == r["text"]
        out[r["id"]].append(r["text"])
    return out


CASES = {
    "A sentence that is simple to tokenize.": ["A", "sentence", "that", "is", "simple", "to", "tokenize", "."],
    "555-2394-72-01": ["555", "-", "2394", "-", "72", "-", "01"],
    "a/b": ["a", "/", "b"],
    "a_b_c": ["a", "_", "b", "_", "c"],
    "81-year-old": ["81", "-", "year", "-", "old"],
    "a^b": ["a", "^", "b"],
    "25yo": ["25", "yo"],
    "NASA &amp; SpaceX": ["NASA", "&amp;", "SpaceX"],
    "NASA &#62; SpaceX": ["NASA", "&#62;", "SpaceX"],
    "Nasa <br> SpaceX": ["Nasa", "<br>", "SpaceX"],
    "x<BR/>&lt;y": ["x", "<BR/>", "&lt;", "y"],
    "(e.g. don't stop, Dr. Smith's dog!)": ["(", "e.g.", "do", "n't", "stop", ",", "Dr.", "Smith", "'s", "dog", "!", ")"],
    "I'm WON'T they'll (U.S.).": ["I", "'m", "WO", "N'T", "they", "'ll", "(", "U.S.", ")", "."],
    "10km. J. 3.5% end.Start x.y": ["10", "km", ".", "J.", "3.5", "%", "end", ".", "Start", "x.y"],
    " a  b\n\nc ": [" ", "a", " ", "b", "\n\n", "c"],
    "": [],
    "\u2028x": ["\u2028x"],
    "ünï-ÇØ 漢字。😀)": ["ünï", "-", "ÇØ", "漢字。😀", ")"],
}


def test_known_cases(spark):
    assert tokens_of(spark, list(CASES)) == list(CASES.values())


def test_unescaped(spark):
    df = spark.createDataFrame([(1, "NASA &amp; &#62; <br> x"), (2, None)], "id int, text string")
    got = {r["text"]: r["unescaped"] for r in K.rule_tokens(df, "text", "id").collect()}
    assert got == {"NASA": "NASA", "&amp;": "&", "&#62;": ">", "<br>": "\n", "x": "x"}


def test_very_long_stretches(spark):
    """No recursion: stretches of one kind of character each, and mixtures."""
    texts = ["x" * 60_000, "-" * 60_000, "x" + "!" * 60_000, "a1" * 30_000, "1a" * 30_000, "a-" * 30_000, "." * 60_000, "(" * 30_000 + "x" + ")" * 30_000, "&amp;" * 9000, " " * 60_000]
    got = tokens_of(spark, texts)
    assert [len(t) for t in got] == [1, 60_000, 60_001, 30_000, 30_001, 60_000, 1, 60_001, 9000, 1]
    assert all("".join(t) == x for t, x in zip(got, texts, strict=True))


def stripped(chunk):
    """One prefix and one suffix at a time until an exception or nothing is left to strip, then infixes."""
    before, behind = [], []
    exception = re.compile(rf"^{K._EXCEPTION}$")
    while chunk and not exception.match(chunk):
        if m := re.match(K._PREFIX, chunk):
            before.append(m[0])
            chunk = chunk[m.end() :]
            continue
        if m := re.search(rf"(?:{K._SUFFIX})$", chunk):
            behind.insert(0, m[0])
            chunk = chunk[: m.start()]
            continue
        break
    if exception.match(chunk):
        m = re.match(r"^(.*)([nN]['’][tT])$", chunk) or re.match(r"^([^'’]*)(['’].*)$", chunk)
        core = [m[1], m[2]] if m else [chunk]
    else:
        core, run = [], ""
        while chunk:
            at = len(run)
            whole = run + chunk
            m = re.compile(K._INFIX).match(whole, at)
            if m and m.end() > at:
                core += [run] * bool(run) + [m[0]]
                chunk, run = chunk[len(m[0]) :], ""
                # what lies before an infix still counts for the next one's look back
                continue
            run, chunk = run + chunk[0], chunk[1:]
            if run[-1].isascii() and run[-1].isdigit() and chunk and chunk[0].isascii() and chunk[0].isalpha():
                core.append(run)
                run = ""
        core += [run] * bool(run)
    return before + core + behind


@pytest.mark.parametrize("alphabet", ["ab1.-'s(", "aB.,:!\"%k", "don't1)._"])
def test_stripping_step_by_step(spark, alphabet):
    rng = random.Random(alphabet)
    texts = sorted({"".join(rng.choices(alphabet, k=rng.randrange(1, 8))) for _ in range(400)})
    got = tokens_of(spark, texts)
    same = sum(g == stripped(t) for g, t in zip(got, texts, strict=True))
    assert all("".join(g) == t for g, t in zip(got, texts, strict=True))
    assert same >= 0.97 * len(texts), [(t, g, stripped(t)) for g, t in zip(got, texts, strict=True) if g != stripped(t)][:8]


def test_query(spark):
    from maskwright.plans.registry import QUERIES

    rows = QUERIES["tokenize_rules"](spark, "/root/testdata/sf0.001").collect()
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where(F.length("text") > 0).count()
    assert len(rows) == turns and all(0 < r["n_words"] <= r["n_tokens"] for r in rows)


def test_common_stretches_as_by_all_rules(spark):
    """Words and numbers, alone or before one sign, go round the rules' regular expressions and come out as by them."""
    rng = random.Random(9)
    cases = [w + sign for w in ("a", "I", "kg", "Word", "WORD", "wORd", "x", "12", "7", "km", "etc", "Dr", "Co", "vs", "St", "cant", "mph", "Zb") for sign in ("", ".", ",", ";", ":", "!", "?", "..", "'s", "%")]
    cases += ["".join(rng.choices("abKM19.,;!?", k=rng.randint(1, 4))) for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for r in df.select("c", K.pieces("c").alias("p")).collect():
        CASES_BY_RULE[r["c"]] = r["p"]
    assert tokens_of_each(spark, cases) == [CASES_BY_RULE[c] for c in cases]
    plan = K.rule_tokens(df.withColumn("id", F.lit(1)), "c", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # texts are matched once


CASES_BY_RULE: dict = {}


def tokens_of_each(spark, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    found = {i: [] for i in range(len(cases))}
    for r in K.rule_tokens(df, "text", "id").orderBy("id", "ord").collect():
        found[r["id"]].append(r["text"])
    return [found[i] for i in range(len(cases))]
