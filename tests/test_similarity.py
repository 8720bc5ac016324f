"""Similarity joins against all pairs of sets."""

import random

import pytest
from pyspark.sql import functions as F

from tierlab.operators import similarity as M


def plain_grams(text):
    t = " ".join(text.split()).lower() if text else ""
    return {t[i : i + 3] for i in range(len(t) - 2)}


def plain_sim(x, y):
    a, b = plain_grams(x), plain_grams(y)
    return len(a & b) / len(a | b) if a & b else 0.0


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)
    words = ["alpha", "beta", "gamma", "été", "中文字", "\U0001f600x", "delta", "of", "the", "zeta-1", "omega"]
    out = [" ".join(draw.choices(words, k=draw.randint(1, 14))) for _ in range(70)]
    out += [t + " " + draw.choice(words) for t in out[:30]] + [out[3], out[3].upper(), "  " + out[4], out[3], "", "ab", "abc", "abc", "word " * 4000, "word " * 4000 + "x"]
    return list(enumerate(out)) + [(1000, None), (1001, None)]


def test_codes_are_the_grams(spark, texts):
    df = spark.createDataFrame(texts, "id int, text string")
    for r in df.select("text", M.gram_codes(F.col("text")).alias("c")).collect():
        code = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
        assert len(r["c"]) == len(set(r["c"])) and set(r["c"]) == {code(g) for g in plain_grams(r["text"])}


@pytest.mark.parametrize("floor", [0.9, 0.5, 0.35, 0.1])
def test_join_loses_no_pair(spark, texts, floor):
    df = spark.createDataFrame(texts, "id int, text string")
    left, right = M.text_sets(df.where("id % 3 = 0"), df)
    names = {r["h"]: r["text"] for r in df.where("text is not null").select(M.problem_hash(F.col("text")).alias("h"), "text").collect()}
    got = {(r["a"], r["b"]): r["sim"] for r in M.similar(left, right, floor).collect()}
    want = {(r["h"], s["h"]): x for r in left.collect() for s in right.collect() if (x := plain_sim(names[r["h"]], names[s["h"]])) >= floor}
    assert got == pytest.approx(want)
    tried = M.candidates(left, right, floor).count()
    assert len(want) <= tried and (floor < 0.9 or tried < left.count() * right.count() / 10)


def test_retrieve(spark, texts):
    stored = [(i, t, float(i % 4)) for i, t in texts]
    df = spark.createDataFrame(stored, "id int, text string, score double")
    for k in (3, 0):
        got = {(r["a"], r["b"]): (r["sim"], r["place"]) for r in M.retrieve(df.where("id % 5 = 0").select("id", "text"), df, k=k, floor=0.4).collect()}
        want = {}
        for q, t in texts:
            if q % 5 == 0 and t is not None:
                same = lambda x: " ".join(x.split()).lower() == " ".join(t.split()).lower()  # noqa: E731, B023
                near = sorted((-(1.0 if same(x) else plain_sim(t, x)), -s, i) for i, x, s in stored if x is not None and (same(x) or plain_sim(t, x) >= 0.4))
                want |= {(q, i): (pytest.approx(-s), n + 1) for n, (s, _, i) in enumerate(near[: k or None])}
        assert got == want and len(want) > 50


def test_best_prior_and_top_pairs(spark, texts):
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r["id"]: r["best"] for r in M.best_prior(df).collect()}
    assert got == pytest.approx({i: max((plain_sim(t, u) for j, u in texts if j < i), default=0.0) for i, t in texts})
    pairs = sorted(((plain_sim(t, u), i, j) for i, t in texts for j, u in texts if i < j), reverse=True)
    pairs = [p for p in pairs if p[0] > 0]
    for k, floors in ((5, (0.8, 0.5)), (60, (0.9, 0.6)), (100000, (0.9,))):
        found = [(r["sim"], r["a"], r["b"]) for r in M.top_pairs(df, k, floors).collect()]
        assert found == [pytest.approx(p) for p in pairs[:k]]
    none = df.limit(0)
    assert M.best_prior(none).count() == 0 and M.top_pairs(none, 3).count() == 0


def test_a_hot_text_costs_one_set(spark):
    df = spark.createDataFrame([(i, "one common text that very many rows hold") for i in range(3000)] + [(9000, "one common text that very many rows hold too")], "id int, text string")
    sets = M.text_sets(df)[0]
    assert sets.count() == 2 and M.candidates(sets, sets, 0.5).count() == 4
    assert [(r["a"], r["b"], r["sim"]) for r in M.top_pairs(df, 2).collect()] == [(2998, 2999, 1.0), (2997, 2999, 1.0)]


def test_retrieval_explodes_no_grams(spark, texts, monkeypatch):
    monkeypatch.setattr(M, "candidates", lambda *_: pytest.fail("retrieval joined prefixes"))
    monkeypatch.setattr(M, "CHUNK", 7, raising=False)  # several chunks and blocks
    monkeypatch.setattr(M, "QUERIES", 9, raising=False)
    monkeypatch.setattr(M, "CELLS", 300, raising=False)
    df = spark.createDataFrame([(i, t, float(i % 4)) for i, t in texts], "id int, text string, score double")
    got = {(r["a"], r["b"]): r["sim"] for r in M.retrieve(df.where("id % 5 = 0").select("id", "text"), df, k=0, floor=0.2).collect()}
    same = lambda x, t: " ".join(x.split()).lower() == " ".join(t.split()).lower()
    pairs = [(i, j, 1.0 if same(t, u) else plain_sim(t, u)) for i, t in texts if i % 5 == 0 and t is not None for j, u in texts if u is not None]
    assert got == pytest.approx({(i, j): s for i, j, s in pairs if s >= 0.2}) and len(got) > 100
    assert M.retrieve(df.limit(0).select("id", "text"), df).count() == M.retrieve(df.select("id", "text"), df.limit(0)).count() == 0
