"""Published figures, closed forms and small fixtures of the policy operators."""

import math

import pytest
from pyspark.sql import functions as F

from tierlab.functions import stats as T
from tierlab.operators import policy as P
from tierlab.sources import bindings as B

SF = "/root/testdata/sf0.001"
SCHEMA = "rec_idx long, tiers array<struct<tier:string,score:double,correct:boolean,true_correct:boolean,cost:double,timed_out:boolean>>, contaminated boolean, oracle_unsound boolean, oracle_inconclusive boolean, shadow boolean, cache_hit boolean, cache_correct boolean, cache_cost double"


def make(spark, rows):
    """rows: (tiers as (score, correct, cost), flags)."""
    data = []
    for i, (tiers, flags) in enumerate(rows):
        f = {"contaminated": False, "oracle_unsound": False, "oracle_inconclusive": False, "shadow": False, "cache_hit": False, "cache_correct": False, "cache_cost": 0.0} | flags
        data.append((i, [(f"t{k}", None if s is None else float(s), c, None, float(x), False) for k, (s, c, x) in enumerate(tiers)], *f.values()))
    return spark.createDataFrame(data, SCHEMA)


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def risk(records, tau):
    r = P.replay(records, tau).agg(F.avg((~F.col("correct")).cast("int")).alias("r"), F.avg("cost").alias("c")).first()
    return r["r"], r["c"]


def test_two_records(spark):
    r = make(spark, [([(0.9, True, 0.001), (1.0, True, 0.002)], {}), ([(0.8, False, 0.001), (1.0, True, 0.002)], {})])
    assert risk(r, [0.5]) == (0.5, pytest.approx(0.001))
    assert risk(r, [0.9]) == (0.0, pytest.approx(0.002))


def test_last_tier_always_accepts_and_empty_tiers_are_exhausted(spark):
    r = make(spark, [([(0.1, True, 1.0)], {}), ([], {}), ([(0.1, False, 5.0)], {"cache_hit": True, "cache_correct": True})])
    got = {x["rec_idx"]: (x["accepted_at"], x["correct"], x["cost"]) for x in P.replay(r, [0.9]).collect()}
    assert got == {0: ("t0", True, 1.0), 1: ("exhausted", False, 0.0), 2: ("cache", True, 0.0)}


def test_exclusion_precedence(spark):
    r = make(spark, [([(1, True, 1)], {"contaminated": True, "oracle_unsound": True}), ([(1, True, 1)], {"oracle_unsound": True}), ([(1, True, 1)], {"oracle_inconclusive": True}), ([(1, True, 1)], {})])
    assert P.exclusions(r).first().asDict() == {"n_contaminated": 1, "n_unsound": 1, "n_inconclusive": 1, "n_usable": 2}


def test_published_statistics(spark):
    got = values(
        spark, a=T.hoeffding_bentkus(F.lit(24 / 409), F.lit(409), F.lit(0.1)), b=T.hoeffding_bentkus(F.lit(0.0), F.lit(53), F.lit(0.05)), c=T.mcnemar_exact(F.lit(5), F.lit(1)), d=T.mcnemar_exact(F.lit(45), F.lit(5)),
        e=T.clopper_pearson_upper(F.lit(0), F.lit(145), F.lit(0.05)), f=T.clopper_pearson_upper(F.lit(0), F.lit(9), F.lit(0.05)), g=T.wilson_lcb(F.lit(10), F.lit(10)), h=T.wilson_lcb(F.lit(1), F.lit(2)),
        i=T.min_calibration_size(F.lit(0.1), F.lit(0.1)), j=T.min_calibration_size(F.lit(0.01), F.lit(0.05)), k=T.wilson_lcb(F.lit(0), F.lit(0)), l=T.min_calibration_size(F.lit(0.0), F.lit(0.05)),
    )
    want = {"a": 0.005481413737170497, "b": 0.06597069817787227, "c": 0.21875, "d": 4.20985202e-09, "e": 1 - 0.05 ** (1 / 145), "f": 0.283, "g": 0.78703, "h": 0.12085, "i": 22, "j": 299, "k": 0.0, "l": 0}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9 if k in "abcd" else 2e-3), k


@pytest.mark.parametrize("n", [1, 7, 40, 200])
def test_binomial_tail(spark, n):
    df = spark.range(n + 1).select("id", *[T.binom_cdf(F.col("id"), F.lit(n), F.lit(p)).alias(f"p{i}") for i, p in enumerate((0.01, 0.3, 0.5, 0.97))])
    for r in df.collect():
        for i, p in enumerate((0.01, 0.3, 0.5, 0.97)):
            want = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(r["id"] + 1))
            assert r[f"p{i}"] == pytest.approx(want, abs=1e-10)


def test_separable_scores_certify(spark):
    r = make(spark, [([(0.2, False, 1), (1.0, True, 3)] if i % 10 == 0 else [(0.9, True, 1), (1.0, True, 3)], {}) for i in range(200)])
    for method in ("fixed-sequence", "bonferroni"):
        c = P.calibrate(r, 0.05, 0.1, method=method, arity=1).first()
        assert c["valid"] and 0.2 < c["tau0"] <= 0.9 and c["empirical_risk"] == 0


def test_wrong_top_tier_never_certifies(spark):
    r = make(spark, [([(0.5, False, 1), (0.5, False, 2)], {}) for _ in range(100)])
    c = P.calibrate(r, 0.1, 0.1, arity=1).first()
    assert not c["valid"] and c["tau0"] is not None


def test_shadow_rows_are_used_alone_from_thirty_on(spark):
    for n, used in ((29, 60), (30, 30)):
        r = make(spark, [([(0.9, True, 1), (1, True, 2)], {"shadow": i < n}) for i in range(60)])
        assert P.prefer_shadow(r).count() == used


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        P.calibrate(make(spark, []), 0.1, 0.1, method="none")


def test_bound_scores_are_not_degenerate(spark):
    o = P.observations(B.records(spark, SF))
    n = {r["tier"]: r["n"] for r in o.groupBy("tier").agg(F.countDistinct("score").alias("n")).collect()}
    assert n["small"] == 6 and n["mid"] == 3 and n["large"] == 2
    points = P.grid_risk(P.score_profiles(P.usable(B.records(spark, SF)), 2), 2)
    assert points.select("risk").distinct().count() >= 10


def test_profiles_are_of_the_lattice_not_of_the_records(spark):
    """Every record has scores of its own; the certificate is that of the replay, from 121 profiles at most."""
    import random

    draw = random.Random(4)
    rows = [([(draw.random(), draw.random() < 0.8, 1), (draw.random(), draw.random() < 0.9, 3), (1.0, draw.random() < 0.97, 9)], {}) for _ in range(3000)]
    r = make(spark, rows)
    profiles = P.score_profiles(r, 2)
    assert profiles.count() == 100 and r.select("tiers").distinct().count() == 3000
    points = {p["grid_idx"]: p for p in P.grid_risk(profiles, 2).collect()}
    assert len(points) == 121 and all(p["n"] == 3000 for p in points.values())
    for g in P.threshold_grid(spark, 2).where("grid_idx % 17 = 3").collect():
        want = P.replay(r, g["tau"]).agg(F.count_if(~F.col("correct")).alias("bad"), F.count_if(~F.col("true_correct")).alias("bad_true"), F.sum("cost").alias("cost")).first()
        assert g["tau"] == points[g["grid_idx"]]["tau"] and {k: points[g["grid_idx"]][k] for k in ("bad", "bad_true", "cost")} == want.asDict()
    plan = P.grid_risk(profiles, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_scores_on_and_between_levels(spark):
    rows = [([(x, False, 1), (1.0, True, 2)], {}) for x in (0.0, 0.1, 0.3, 0.7, 0.29999, 0.30001, 1.0, -0.5, 1.5)] + [([(None, False, 1), (1.0, True, 2)], {})]
    points = P.grid_risk(P.score_profiles(make(spark, rows), 1), 1).collect()
    assert {p["grid_idx"]: p["bad"] for p in points} == {i: sum(x is not None and x >= t for ((x, _, _), _), _ in rows) for i, t in enumerate(P.grid_levels())}


def test_four_tiers_and_ragged_records_match_replay(spark):
    rows = [([(0.1, False, 1), (0.2, False, 2), (0.3, False, 4), (0.4, False, 8)], {})] * 3
    rows += [([(0.5, True, 1), (0.2, True, 2), (0.9, False, 4), (0.7, True, 8), (0.6, False, 16)], {}), ([(0.1, False, 1)], {}), ([], {}), ([(0.1, True, 1)] * 4, {"cache_hit": True, "cache_correct": False, "cache_cost": 3.0})]
    r = make(spark, rows)
    points = P.grid_risk(P.score_profiles(r, 4, 0.5), 4, 0.5).collect()
    assert len(points) == 81
    for p in (x for x in points if x["grid_idx"] % 16 == 0):
        want = P.replay(r, p["tau"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("correct")).alias("bad"), F.count_if(~F.col("true_correct")).alias("bad_true"), F.sum("cost").alias("cost")).first()
        assert {k: p[k] for k in ("n", "bad", "bad_true", "cost")} == want.asDict(), p


def test_no_usable_record_is_an_error(spark):
    r = make(spark, [([(0.5, True, 1), (1, True, 2)], {"contaminated": True})])
    with pytest.raises(Exception, match="no usable calibration records"):
        P.calibrate(r, 0.1, 0.1, arity=1).collect()


def test_one_tier_certifies_without_a_test(spark):
    r = make(spark, [([(0.5, i > 2, 4)], {}) for i in range(10)])
    c = P.calibrate(r, 0.1, 0.1, arity=0).first()
    assert (c["valid"], c["p_value"], c["tau0"], c["empirical_risk"], c["expected_cost"], c["nominal_only"]) == (True, None, None, 0.3, 4.0, True)


def test_wrong_records_of_four_tiers_are_no_certificate(spark):
    r = make(spark, [([(0.1, False, 1)] * 4, {}) for _ in range(50)])
    c = P.calibrate(r, 0.1, 0.1, step=0.5, arity=3).first()
    assert not c["valid"] and c["empirical_risk"] == 1.0


def test_fewest_samples(spark):
    wants = (0.0, 0.27, 0.42, 0.9, 0.999, 0.99999, 1.0, 1.5)
    got = values(spark, **{f"n{i}": T.min_samples_for(F.lit(w)) for i, w in enumerate(wants)})
    score = lambda n: n / (n + 1.645**2)
    want = [next((n for n in range(1, 100_001) if score(n) >= w), 0) for w in wants]
    assert list(got.values()) == want and want[4] == 2704
