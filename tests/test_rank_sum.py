"""Mann-Whitney against enumeration and against plain ranks; the two arms of a stopping signal."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tierlab.functions import stats as T
from tierlab.operators import studies as D


def plain(a, b):
    rank = lambda x: sum(y < x for y in a + b) + (sum(y == x for y in a + b) + 1) / 2
    u = sum(map(rank, a)) - len(a) * (len(a) + 1) / 2
    n1, n2 = len(a), len(b)
    ties = sum(c**3 - c for c in ((a + b).count(x) for x in set(a + b)))
    sd = math.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))
    return u, (u - n1 * n2 / 2) / sd, math.erfc(max(abs(u - n1 * n2 / 2) - 0.5, 0) / sd / math.sqrt(2)), ties


def enumerated(n1, n2, u):
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    return min(1.0, 2 * sum(x <= min(u, n1 * n2 - u) for x in us) / len(us))


def test_exact_where_small_and_untied(spark):
    import random

    draw, rows, want = random.Random(3), [], {}
    for g, (n1, n2) in enumerate([(1, 1), (1, 7), (3, 4), (8, 8), (5, 8), (2, 12), (8, 3), (9, 9), (0, 5), (6, 6)]):
        values = draw.sample(range(1000), n1 + n2) if g != 9 else [draw.randint(0, 3) for _ in range(12)]
        rows += [(g, i < n1, float(x)) for i, x in enumerate(values)]
        a, b = values[:n1], values[n1:]
        if a and b:
            u, z, p, ties = plain(a, b)
            want[g] = (n1, n2, u, z, enumerated(n1, n2, u) if not ties and min(n1, n2) <= 8 else p)
    rows += [(0, None, 3.0), (0, True, None)]
    got = {r["g"]: r for r in D.rank_sum(spark.createDataFrame(rows, "g int, a boolean, x double"), "a", "x", ["g"]).collect()}
    for g, (n1, n2, u, z, p) in want.items():
        r = got[g]
        assert (r["n1"], r["n2"], r["u"]) == (n1, n2, u) and r["z"] == pytest.approx(z, abs=1e-6) and r["p"] == pytest.approx(p, abs=1e-9), g
    assert got[8]["z"] is None and got[8]["p"] is None
    assert D.rank_sum(spark.createDataFrame([(True, 1.0), (False, 1.0)], "a boolean, x double"), "a", "x").first()["z"] is None
    assert D.rank_sum(spark.createDataFrame([], "a boolean, x double"), "a", "x").first()["n1"] == 0


def test_many_values_against_plain_ranks(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).alias("a"), (F.col("id") * 7919 % 641).cast("double").alias("x"))
    rows = df.collect()
    u, z, p, _ = plain([r["x"] for r in rows if r["a"]], [r["x"] for r in rows if not r["a"]])
    got = D.rank_sum(df, "a", "x").first()
    assert got["u"] == u and got["z"] == pytest.approx(z, abs=1e-6) and got["p"] == pytest.approx(p, rel=1e-9)


def test_normal_tail(spark):
    zs = [0.0, 1e-6, 0.3, 1.0, 1.96, 3.0, 4.2, 4.3, 6.0, 10.0, -2.5]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", T.normal_two_sided(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-9, abs=1e-12)


def test_signals_pool_and_deduplicate(spark):
    from test_policy import make

    r = make(spark, [([(0.1, False, 1), (0.5, True, 2), (1, True, 3)], {}), ([(0.2, False, 1), (0.4, False, 2), (1, True, 3)], {}), ([(0.3, True, 1), (0.4, False, 2), (1, True, 3)], {}), ([(0.4, False, 1), (0.4, False, 2), (1, False, 3)], {}), ([(0.4, False, 1), (0.4, True, 2)], {"contaminated": True}), ([(0.4, False, 1)], {})])
    assert sorted((e["rec_idx"], e["score"], e["helped"]) for e in D.escalations(r, 0).collect()) == [(0, 0.1, True), (1, 0.2, True), (3, 0.4, False)]
    assert sorted((e["rec_idx"], e["score"], e["helped"]) for e in D.escalations(r, 1).collect()) == [(1, 0.4, True), (3, 0.4, False)]
    draws = [(i, "b", (i + d) % 4 > 1, float(i * 10 + d)) for i in range(12) for d in range(3)]
    got = {x["arm"]: x for x in D.stopping_signals(spark.createDataFrame(draws, "id int, boundary string, helped boolean, score double"), ["b"], ["score"]).collect()}
    assert (got["pooled"]["n1"] + got["pooled"]["n2"], got["deduplicated"]["n1"] + got["deduplicated"]["n2"]) == (36, 12)
    a, b = ([x for i, _, h, x in draws if h is side] for side in (True, False))
    assert got["pooled"]["u"] == plain(a, b)[0]
    once = {i: sum(h for j, _, h, _ in draws if j == i) >= 2 for i in range(12)}
    assert got["deduplicated"]["u"] == plain([i for i in once if once[i]], [i for i in once if not once[i]])[0]


def test_fisher_steps_grow_with_the_root_of_the_counts(spark):
    """Tables of 40 million: walking all of them would take minutes; small ones agree with whole sums."""
    small = [(3, 1, 1, 3), (0, 5, 7, 2), (8, 2, 1, 5), (0, 0, 0, 0), (4, 0, 0, 4), (10, 90, 40, 300), (0, 3, 4, 0), (700, 20, 30, 900)]
    large = [(10_000_000, 10_000_000, 10_000_000, 10_000_000), (10_004_000, 9_996_000, 9_996_000, 10_004_000), (12_000_000, 8_000_000, 8_000_000, 12_000_000)]
    rows = spark.createDataFrame(small + large + [(None, 1, 1, 1)], "a long, b long, c long, e long")
    got = {tuple(r)[:4]: r["p"] for r in rows.select("*", T.fisher(*map(F.col, "abce")).alias("p")).collect()}
    for a, b, c, e in small:
        ways = {x: math.comb(a + b, x) * math.comb(c + e, a + c - x) for x in range(max(0, a - e), min(a + b, a + c) + 1)}
        whole = sum(ways.values())
        assert got[a, b, c, e]["one_sided"] == pytest.approx(sum(w for x, w in ways.items() if x >= a) / whole, rel=1e-11)
        assert got[a, b, c, e]["two_sided"] == pytest.approx(sum(w for w in ways.values() if w <= ways[a]) / whole, rel=1e-11)
    even, leaning, dependent = (got[x] for x in large)
    assert even["two_sided"] == 1 and even["one_sided"] == pytest.approx(0.5 + 0.5 / (2 * math.pi * 2_500_000) ** 0.5, rel=1e-6)
    assert leaning["one_sided"] == pytest.approx(0.00571, rel=0.01) and leaning["two_sided"] == pytest.approx(2 * leaning["one_sided"], rel=1e-9)
    assert dependent["two_sided"] == 0 and got[None, 1, 1, 1] is None


def test_repeated_draws_of_a_row_are_those_of_rows(spark):
    draws = [(i, b, (i * s) % 3 == 0, float(i * s % 7) if i % 5 else None) for i in range(1, 40) for b in ("b", "c") for s in (1, 2, 5) if (i + s) % 4]
    df = spark.createDataFrame(draws, "id int, boundary string, helped boolean, score double")
    gathered = df.groupBy("boundary", "id").agg(F.collect_list(F.struct("helped", "score")).alias("draws"))
    none = gathered.limit(1).select("boundary", F.lit(-1).alias("id"), F.filter("draws", lambda d: F.lit(False)).alias("draws"))
    got = {(r["arm"], r["boundary"]): r for r in D.repeated_signals(gathered.unionByName(none), ["score"]).collect()}
    assert got == {(r["arm"], r["boundary"]): r for r in D.stopping_signals(df, ["b", "c"], ["score"]).collect()}
    for b in ("b", "c"):
        known = [d for d in draws if d[1] == b and d[3] is not None]
        assert got["pooled", b]["n1"] == sum(d[2] for d in known) and got["pooled", b]["n1"] + got["pooled", b]["n2"] == len(known)
        helped = [[d[2] for d in known if d[0] == i] for i in {d[0] for d in known}]
        assert got["deduplicated", b]["n1"] == sum(2 * sum(h) >= len(h) for h in helped)
