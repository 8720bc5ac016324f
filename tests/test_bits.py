"""Wrapping arithmetic, generators and the seeded shuffle against plain loops."""

import random

from pyspark.sql import functions as F

from tierlab.functions import bits as N
from tierlab.operators import ordering as O

M = (1 << 64) - 1


def mix(z):
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & M
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & M
    return z ^ (z >> 31)


def shuffled(n, seed):
    idx, s = list(range(n)), (seed | 1) & M
    for i in range(n - 1, 0, -1):
        s = (s + 0x9E3779B97F4A7C15) & M
        j = mix(s) % (i + 1)
        idx[i], idx[j] = idx[j], idx[i]
    return idx


def fnv(text):
    h = 1469598103934665603
    for b in text.encode():
        h = (h ^ b) * 1099511628211 & M
    return h


def test_arithmetic(spark):
    draw = random.Random(1)
    xs = [0, 1, M, 1 << 63, (1 << 63) - 1, 1 << 32, LOW := (1 << 32) - 1, LOW << 32] + [draw.getrandbits(64) for _ in range(60)]
    df = spark.createDataFrame([(N.signed(x), N.signed(y), y % 1000 + 1) for x in xs for y in xs[:12]], "x long, y long, n long")
    by = [0xFFFFFFFFFFFFFFFF, 0x9E3779B97F4A7C15, 1099511628211, 3]
    for r in df.select("*", N.wrapping_add(F.col("x"), F.col("y")).alias("sum"), N.remainder(F.col("x"), F.col("n")).alias("rest"), N.splitmix64(F.col("x")).alias("mixed"), *[N.wrapping_multiply(F.col("x"), b).alias(f"p{i}") for i, b in enumerate(by)]).collect():
        x, y = r["x"] & M, r["y"] & M
        assert r["sum"] & M == (x + y) & M and r["rest"] == x % r["n"] and r["mixed"] & M == mix(x)
        assert [r[f"p{i}"] & M for i in range(4)] == [x * b & M for b in by]


def test_sequences_and_strings(spark):
    # the first numbers of the generator from state 0 are published with it
    assert [x & M for x in N.derived_seeds(0, 3)] == [mix((1 + k * 0x9E3779B97F4A7C15) & M) for k in (1, 2, 3)] and mix(0x9E3779B97F4A7C15) == 0xE220A8397B1DCDAF
    df = spark.range(1, 40).select("id", N.seeded_number(F.lit(N.signed(M - 5)), F.col("id")).alias("z"))
    assert [r["z"] for r in df.orderBy("id").collect()] == N.derived_seeds(M - 5, 39)
    texts = ["", "a", "uniform", "easy-first", "é中\U0001f600", "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.hash_string(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] & M for r in got} == {t: fnv(t) for t in texts}


def test_permutation_is_the_sequential_one(spark):
    for n, seed in ((1, 5), (2, 8), (3, 2**64 - 1), (500, 12345), (3000, 7)):
        got = O.seeded_permutation(spark.range(n).withColumnRenamed("id", "x"), F.lit(N.signed(seed)).cast("long"), [F.asc("x")]).collect()
        assert [r["x"] for r in sorted(got, key=lambda r: r["place"])] == shuffled(n, seed), n


def test_permutations_of_groups(spark):
    rows = [(f"g{k % 7}" if k % 11 else None, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, x long").withColumn("keep", F.lit("yes"))
    got = O.seeded_permutation(df, N.hash_string(F.coalesce("g", F.lit("none"))), [F.desc("x")], ["g"]).collect()
    assert len(got) == 300 and got[0]["keep"] == "yes"
    for g in {g for g, _ in rows}:
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        before = sorted((x for h, x in rows if h == g), reverse=True)
        assert [r["x"] for r in mine] == [before[i] for i in shuffled(len(before), fnv(g or "none"))]
    assert O.seeded_permutation(df.limit(0), F.lit(1).cast("long"), [F.asc("x")], ["g"]).count() == 0


def test_seeded_draws_of_a_sweep(spark):
    import struct

    from tierlab.operators import sweep as W

    bits = lambda x: struct.unpack("<Q", struct.pack("<d", x))[0]
    records = spark.range(409).withColumnRenamed("id", "rec_idx")
    for rho, eps, seed in ((0.2, 0.05, 1), (0.6, 0.5, 99), (0.0, 0.001, 3)):
        left = shuffled(409, seed ^ bits(rho))[int(rho * 409 + 0.5) :]
        got = W.seeded_residual(records, rho, seed)
        assert [r["rec_idx"] for r in got.orderBy("place").collect()] == left
        want = [left[i] for i in shuffled(len(left), seed ^ bits(eps) ^ bits(rho) ^ fnv("uniform"))[: max(1, int(eps * len(left) + 0.5))]]
        assert {r["rec_idx"] for r in W.seeded_shadow(got, eps, seed, "uniform", rho, order="place").collect()} == set(want)


def stepped(n, drawn, first=0):
    idx = list(range(n))
    for i in range(n - 1, first - 1, -1):
        idx[i], idx[drawn[i]] = idx[drawn[i]], idx[i]
    return idx


def test_settled_steps_of_any_kind(spark):
    draw = random.Random(4)
    kinds = {
        "one long path": [max(k - 1, 0) for k in range(150)], "all draw one place": [0] * 60, "all draw themselves": list(range(60)),
        "near": [max(k - draw.randrange(3), 0) for k in range(300)], "far": [draw.randrange(k // 9 + 1) for k in range(300)],
    }
    for kind, drawn in kinds.items():
        n = len(drawn)
        for first, upto in ((0, None), (n // 3, None), (0, n // 4)):
            steps = spark.createDataFrame([(k, drawn[k]) for k in range(first, n)], "step long, drawn long")
            got = [(r["_place"], r["_source"]) for r in O.settled(steps, first, upto).collect()]
            assert sorted(got) == list(enumerate(stepped(n, drawn, first)))[first:upto], (kind, first, upto)


def test_first_places_of_a_shuffle(spark):
    for n, k, seed in ((0, 1, 3), (1, 1, 3), (5, 9, 3), (400, 1, 2**63 + 5), (400, 120, 7), (400, 399, 7)):
        got = [r["source"] for r in O.seeded_prefix(spark, N.signed(seed), n, k).collect()]
        assert sorted(got) == sorted(shuffled(n, seed)[:k]), (n, k)
    df = spark.range(400).withColumnRenamed("id", "x")
    got = O.seeded_permutation(df, F.lit(7).cast("long"), [F.asc("x")], first=150).orderBy("place").collect()
    assert [(r["place"], r["x"], r["source"]) for r in got] == [(p, x, x) for p, x in enumerate(shuffled(400, 7))][150:]


def test_seeded_cell_of_a_sweep(spark):
    import struct

    from tierlab.operators import sweep as W

    bits = lambda x: struct.unpack("<Q", struct.pack("<d", x))[0]
    records = spark.range(307).withColumnRenamed("id", "rec_idx")
    for rho, eps, seed in ((0.4, 0.2, 7), (0.0, 0.001, 3), (0.999, 0.5, 3), (0.3, 1.0, 2)):
        left = shuffled(307, seed ^ bits(rho))[min(int(rho * 307 + 0.5), 306) :]
        want = [left[i] for i in shuffled(len(left), seed ^ bits(eps) ^ bits(rho) ^ fnv("uniform"))[: max(1, int(eps * len(left) + 0.5))]]
        got = W.seeded_cell(records, rho, eps, seed).orderBy("place").collect()
        assert [(r["rec_idx"], r["shadow"]) for r in got] == [(x, x in set(want)) for x in left]
        assert [r["place"] for r in got] == list(range(307 - len(left), 307))
    assert W.seeded_cell(records.limit(0), 0.4, 0.2, 7).count() == 0


def test_seeded_draws_stage_few_rows(spark, monkeypatch):
    """A step's row leaves once it is settled: whole tables aren't staged anew in every round, nor is what is left made twice."""
    from tierlab.plans.registry import QUERIES

    staged, real = [], O.stage

    def counted(df, name, *args):
        out = real(df, name, *args)
        staged.append(out.count())
        return out

    monkeypatch.setattr(O, "stage", counted)
    n = 3000
    assert O.seeded_permutation(spark.range(n).withColumnRenamed("id", "x"), F.lit(7).cast("long"), [F.asc("x")]).count() == n
    assert sum(staged) < 4 * n
    staged.clear()
    assert QUERIES["absorb_seeded"](spark, "/root/testdata/sf0.001").count() > 0
    assert sum(staged) < 4 * 1500
