"""Queries over records, observations and threshold vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import policy as P
from ..operators import routing as R
from ..sources import bindings as B
from . import sql as S
from .registry import query

TAU = [0.4, 0.3]
ALPHA, DELTA = 0.2, 0.1


@query(f"{S.OBS} select rec_idx, k, truth from obs")
def truth_coalesce(spark, sf):
    return P.observations(B.records(spark, sf)).select("rec_idx", "k", "truth")


@query(f"{S.OBS} select rec_idx, k from obs where true_correct is not null and correct <> true_correct")
def disagrees(spark, sf):
    o = P.observations(B.records(spark, sf))
    return o.where(F.col("true_correct").isNotNull() & (F.col("correct") != F.col("true_correct"))).select("rec_idx", "k")


@query(f"{S.OBS} select rec_idx, k, case when true_correct is not null and correct <> true_correct then tier || ':' || rec_idx end as source from obs")
def retain_source(spark, sf):
    o = P.observations(B.records(spark, sf))
    differ = F.col("true_correct").isNotNull() & (F.col("correct") != F.col("true_correct"))
    return o.select("rec_idx", "k", F.when(differ, F.concat("tier", F.lit(":"), F.col("rec_idx").cast("string"))).alias("source"))


@query(f"{S.OBS} select distinct rec_idx from obs where not contaminated and not oracle_unsound")
def usable_records(spark, sf):
    return P.usable(B.records(spark, sf)).select("rec_idx")


@query(f"{S.OBS} select distinct rec_idx from obs where not contaminated and not oracle_unsound and not cache_hit")
def usable_tier_records(spark, sf):
    return P.usable(B.records(spark, sf)).where((F.size("tiers") > 0) & ~F.col("cache_hit")).select("rec_idx")


@query(f"""{S.OBS} select cast(count(*) filter (contaminated) as bigint) n_contaminated, cast(count(*) filter (not contaminated and oracle_unsound) as bigint) n_unsound,
cast(count(*) filter (not contaminated and not oracle_unsound and oracle_inconclusive) as bigint) n_inconclusive, cast(count(*) filter (not contaminated and not oracle_unsound) as bigint) n_usable from obs where k=0""")
def exclusion_counts(spark, sf):
    return P.exclusions(B.records(spark, sf))


@query(f"{S.OBS} select rec_idx, (select count(*) from obs where k=0 and shadow) as n_shadow from obs where k=0 and shadow")
def shadow_preference(spark, sf):
    return P.prefer_shadow(B.records(spark, sf)).select("rec_idx", "n_shadow")


@query(f"{S.OBS} select cast(count(distinct rec_idx) filter (timed_out) as bigint) as n_timed_out from obs")
def count_timed_out(spark, sf):
    return B.records(spark, sf).agg(F.count_if(F.exists("tiers", lambda t: t["timed_out"])).alias("n_timed_out"))


@query(f"{S.OBS} select rec_idx % 1000 as batch, bool_or(timed_out) as timed_out from obs group by 1")
def sticky_or(spark, sf):
    o = P.observations(B.records(spark, sf))
    return o.groupBy((F.col("rec_idx") % 1000).alias("batch")).agg(F.bool_or("timed_out").alias("timed_out"))


@query(f"{S.OBS} select rec_idx, score >= 0.4 as served, correct as tier0_correct, round(score, 9) as tier0_score from obs where k=0")
def served_at_tier0(spark, sf):
    t0 = F.get(F.col("tiers"), F.lit(0))
    score = F.coalesce(t0["score"], F.lit(0.0))
    return B.records(spark, sf).select("rec_idx", (score >= TAU[0]).alias("served"), F.coalesce(t0["correct"], F.lit(False)).alias("tier0_correct"), F.round(score, 9).alias("tier0_score"))


@query(f"{S.OBS} select rec_idx, k, cast(sum(cost) over (partition by rec_idx order by k) as bigint) as spent from obs")
def running_cost(spark, sf):
    o = P.observations(B.records(spark, sf))
    w = Window.partitionBy("rec_idx").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return o.select("rec_idx", "k", F.sum("cost").over(w).alias("spent"))


@query(f"{S.OBS} select rec_idx, cast(min(k) as integer) as k from obs where is_last or score >= case k when 0 then cast(0.4 as double) else cast(0.3 as double) end group by rec_idx")
def first_accept(spark, sf):
    tau = F.array(*[F.lit(t) for t in TAU])
    return B.records(spark, sf).select("rec_idx", P.accepted_at(F.col("tiers"), tau).alias("k"))


@query(f"{S.replay(*TAU)} select rec_idx, accepted_at, correct, cost from rep")
def replay(spark, sf):
    return P.replay(B.records(spark, sf), TAU).select("rec_idx", "accepted_at", "correct", "cost")


@query(f"{S.replay(*TAU)} select rec_idx, true_correct from rep")
def replay_truth(spark, sf):
    return P.replay(B.records(spark, sf), TAU).select("rec_idx", "true_correct")


@query(f"{S.replay(*TAU)} select rec_idx, cost from rep where not cache_hit")
def cascade_spend(spark, sf):
    tau = F.array(*[F.lit(t) for t in TAU])
    r = B.records(spark, sf).where(~F.col("cache_hit"))
    return r.select("rec_idx", P.spend(F.col("tiers"), P.accepted_at(F.col("tiers"), tau)).cast("long").alias("cost"))


@query(f"{S.replay(*TAU)} select round(avg(cast(not correct as int)), 9) as risk, round(avg(cost), 9) as mean_cost, cast(count(*) as bigint) as n from rep")
def risk_cost(spark, sf):
    r = P.replay(B.records(spark, sf), TAU)
    return r.agg(F.round(F.coalesce(F.avg((~F.col("correct")).cast("int")), F.lit(1.0)), 9).alias("risk"), F.round(F.coalesce(F.avg("cost"), F.lit(0.0)), 9).alias("mean_cost"), F.count(F.lit(1)).alias("n"))


@query(f"{S.replay(*TAU)} select round(avg(cast(not true_correct as int)), 9) as realized_risk from rep")
def realized_risk(spark, sf):
    r = P.replay(B.records(spark, sf), TAU)
    return r.agg(F.round(F.coalesce(F.avg((~F.col("true_correct")).cast("int")), F.lit(1.0)), 9).alias("realized_risk"))


@query(f"""{S.replay(*TAU)} select 'cascade' as policy, cast(count(*) filter (not true_correct) as bigint) as bad, cast(sum(cost) as bigint) as cost, cast(count(*) as bigint) as n from rep where not cache_hit
union all select 'always-cheapest', count(*) filter (not truth), cast(sum(cost) as bigint), count(*) from obs where k=0 and not cache_hit
union all select 'always-frontier', count(*) filter (not truth), cast(sum(cost) as bigint), count(*) from obs where k=2 and not cache_hit""")
def baselines(spark, sf):
    return P.baselines(B.records(spark, sf), TAU)


@query(f"{S.OBS} select round(avg(cast(truth as int)), 9) as accuracy, cast(count(*) as bigint) as n from obs where k=0")
def tier0_accuracy(spark, sf):
    t0 = P.truth(F.get(F.col("tiers"), F.lit(0)))
    return B.records(spark, sf).agg(F.round(F.coalesce(F.avg(F.coalesce(t0, F.lit(False)).cast("int")), F.lit(0.0)), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query(f"""{S.OBS}, g as (select cast(a.i * 11 + b.i as bigint) as grid_idx, round(a.i * 0.1, 3)::double as tau0, round(b.i * 0.1, 3)::double as tau1 from range(11) a(i), range(11) b(i)),
w as (select rec_idx, max(score) filter (k = 0) as s0, max(score) filter (k = 1) as s1 from obs group by rec_idx)
select grid_idx, tau0, tau1, count(*) filter (s0 >= tau0) as first, count(*) filter (s0 < tau0 and s1 >= tau1) as second from g, w group by all""")
def threshold_grid(spark, sf):
    """The grid, with the records that the first and the second tier accept at each point."""
    r = B.records(spark, sf).withColumn("cache_hit", F.lit(False)).withColumn("tiers", F.transform("tiers", lambda t, k: t.withField("correct", k != 0).withField("true_correct", k != 1)))
    found = P.grid_risk(P.score_profiles(r, 2), 2)  # wrong at the first tier only, and by truth at the second only
    return found.select("grid_idx", F.get("tau", F.lit(0)).alias("tau0"), F.get("tau", F.lit(1)).alias("tau1"), F.col("bad").alias("first"), F.col("bad_true").alias("second"))


def _points(spark, sf, only_shadow=True):
    r = P.usable(B.records(spark, sf))
    r = P.prefer_shadow(r) if only_shadow else r
    return P.grid_risk(P.score_profiles(r, 2), 2)


USED = "not contaminated and not oracle_unsound and shadow"


@query(f"{S.grid_points('true')} select cast(grid_idx as bigint) as grid_idx, n, bad, cost from points")
def replay_grid(spark, sf):
    return P.grid_risk(P.score_profiles(B.records(spark, sf), 2), 2).select("grid_idx", "n", "bad", "cost")


@query(f"""{S.grid_points(USED)}, {S.p_values(ALPHA)} select cast(grid_idx as bigint) as grid_idx, round(p, 9) as p, test_rank,
max(cast(p > {DELTA} as int)) over (order by test_rank rows unbounded preceding) = 0 as certified from ranked""")
def fixed_sequence(spark, sf):
    return P.fixed_sequence(_points(spark, sf), ALPHA, DELTA).select("grid_idx", F.round("p", 9).alias("p"), "test_rank", "certified")


@query(f"""{S.grid_points(USED)}, {S.p_values(ALPHA)}, t as (select *, max(cast(p > {DELTA} as int)) over (order by test_rank rows unbounded preceding) = 0 as c from ranked)
select true as valid, t0 as tau0, t1 as tau1, bad, cost from t where c order by cost, test_rank limit 1""")
def select_threshold(spark, sf):
    got = P.select_threshold(P.fixed_sequence(_points(spark, sf), ALPHA, DELTA))
    return got.select("valid", F.get("tau", F.lit(0)).alias("tau0"), F.get("tau", F.lit(1)).alias("tau1"), "bad", "cost")


@query(S.certificate(ALPHA, DELTA))
def calibrate_fixed(spark, sf):
    return P.calibrate(B.records(spark, sf), ALPHA, DELTA)


@query(S.certificate(ALPHA, DELTA, "bonferroni"))
def calibrate_bonferroni(spark, sf):
    return P.calibrate(B.records(spark, sf), ALPHA, DELTA, method="bonferroni")


ALPHAS = [round(0.02 * i, 2) for i in range(1, 16)]


@query(f"{S.grid_points(USED)}" + "".join(f", p{i} as (with {S.p_values(a)} select * from ranked), c{i} as (select *, max(cast(p > {DELTA} as int)) over (order by test_rank rows unbounded preceding) = 0 as ok from p{i})" for i, a in enumerate(ALPHAS))
       + " union all ".join(f"{' ' if i else ' '}select cast({a} as double) as alpha, cast(count(*) filter (ok) as bigint) as n_certified, coalesce(bool_or(ok), false) as valid from c{i}" for i, a in enumerate(ALPHAS)))
def alpha_frontier(spark, sf):
    """Risks are computed once; only the p-values depend on alpha."""
    points = _points(spark, sf).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    tested = points.withColumn("p", P.hoeffding_bentkus(F.col("risk"), F.col("n"), F.col("alpha")))
    total = F.aggregate("tau", F.lit(0.0), lambda a, x: a + x)
    w = Window.partitionBy("alpha").orderBy(F.desc("_s"), F.desc("tau")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.max((F.col("p") > DELTA).cast("int")).over(w) == 0
    return tested.withColumn("_s", total).withColumn("ok", ok).groupBy("alpha").agg(F.count_if("ok").alias("n_certified"), F.bool_or("ok").alias("valid"))


@query(f"""with {S.TIERS}, {S.obs('obs')}, {S.obs('other', 6)} select a.rec_idx, a.k, a.correct as correct_a, b.correct as correct_b, cast(b.cost - a.cost as bigint) as extra
from obs a join other b on a.rec_idx = b.rec_idx and a.k = b.k""")
def paired_arms(spark, sf):
    a = P.observations(B.records(spark, sf)).select("rec_idx", "k", F.col("correct").alias("correct_a"), F.col("cost").alias("cost_a"))
    b = P.observations(B.records(spark, sf, 6)).select("rec_idx", "k", F.col("correct").alias("correct_b"), F.col("cost").alias("cost_b"))
    return a.join(b, ["rec_idx", "k"]).select("rec_idx", "k", "correct_a", "correct_b", (F.col("cost_b") - F.col("cost_a")).alias("extra"))


@query(f"""with {S.TIERS}, {S.obs('obs')}, {S.obs('other', 6)},
u as (select a.rec_idx, a.truth as ta, b.truth as tb from obs a join other b on a.rec_idx = b.rec_idx and a.k = 0 and b.k = 0
      where not a.contaminated and not a.oracle_unsound and a.rec_idx % 7 <> 3)
select cast(count(*) as bigint) as n, cast(count(*) filter (ta and tb) as bigint) as both_right, cast(count(*) filter (ta and not tb) as bigint) as only_a,
cast(count(*) filter (not ta and tb) as bigint) as only_b, cast(count(*) filter (not ta and not tb) as bigint) as both_wrong from u""")
def contingency_2x2(spark, sf):
    t0 = P.truth(F.get(F.col("tiers"), F.lit(0)))
    a = P.usable(B.records(spark, sf)).select("rec_idx", t0.alias("ta"))
    b = B.records(spark, sf, 6).where("rec_idx % 7 <> 3").select("rec_idx", t0.alias("tb"))
    j = a.join(b, "rec_idx")
    one = lambda c, n: F.count_if(c).alias(n)
    x, y = F.col("ta"), F.col("tb")
    return j.agg(F.count(F.lit(1)).alias("n"), one(x & y, "both_right"), one(x & ~y, "only_a"), one(~x & y, "only_b"), one(~x & ~y, "both_wrong"))


@query(f"{S.OBS} select rec_idx from obs where k=0 and not contaminated and not oracle_unsound intersect select rec_idx from obs where k=0 and rec_idx % 7 <> 3")
def paired_denominator(spark, sf):
    a = P.usable(B.records(spark, sf)).select("rec_idx")
    return a.join(B.records(spark, sf, 6).where("rec_idx % 7 <> 3").select("rec_idx"), "rec_idx")


@query("select o_orderkey as id from orders where o_orderkey % 97 <> 0 intersect select o_orderkey from orders where o_orderkey % 7 <> 3")
def ids_intersect(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return o.where("id % 97 <> 0").intersect(o.where("id % 7 <> 3"))


@query("select o_orderkey as id from orders where o_orderkey % 97 <> 0 except select o_orderkey from orders where o_orderkey % 7 <> 3")
def ids_except(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return o.where("id % 97 <> 0").subtract(o.where("id % 7 <> 3"))


@query("""select 'a' as side, o_orderkey as id from orders where o_orderkey % 97 <> 0 and o_orderkey % 7 = 3
union all select 'b', o_orderkey from orders where o_orderkey % 7 <> 3 and o_orderkey % 97 = 0""")
def anti_only(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    a, b = o.where("id % 97 <> 0"), o.where("id % 7 <> 3")
    return a.join(b, "id", "left_anti").select(F.lit("a").alias("side"), "id").unionByName(b.join(a, "id", "left_anti").select(F.lit("b").alias("side"), "id"))


@query(f"""{S.OBS} select tier, cast(count(true_correct) as bigint) as comparable, cast(count(*) filter (correct and not true_correct) as bigint) as over_accept,
cast(count(*) filter (not correct and true_correct) as bigint) as over_reject from obs group by tier""")
def judge_errors(spark, sf):
    o, c, t = P.observations(B.records(spark, sf)), F.col("correct"), F.col("true_correct")
    return o.groupBy("tier").agg(F.count("true_correct").alias("comparable"), F.count_if(c & ~t).alias("over_accept"), F.count_if(~c & t).alias("over_reject"))


@query(f"""{S.OBS}, d as (select tier, case when correct then 'over_accept' else 'over_reject' end as direction from obs where true_correct is not null and correct <> true_correct)
select tier, cast(count(*) filter (direction='over_accept') as bigint) as over_accept, cast(count(*) filter (direction='over_reject') as bigint) as over_reject from d group by tier""")
def disagreement_pivot(spark, sf):
    o = P.observations(B.records(spark, sf)).where("true_correct is not null and correct <> true_correct")
    o = o.withColumn("direction", F.when(F.col("correct"), "over_accept").otherwise("over_reject"))
    return o.groupBy("tier").pivot("direction", ["over_accept", "over_reject"]).count().na.fill(0)


@query(f"{S.OBS} select round(score, 4) as score, cast(count(*) as bigint) as n, cast(count(*) filter (not truth) as bigint) as wrong, round(avg(cast(not truth as int)), 9) as rate from obs where k=0 group by 1")
def score_histogram(spark, sf):
    o = P.observations(B.records(spark, sf)).where("k = 0")
    return o.groupBy(F.round("score", 4).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("truth")).alias("wrong"), F.round(F.avg((~F.col("truth")).cast("int")), 9).alias("rate"))


@query(f"""{S.OBS}, c as (select *, max(score) over () as ceiling from obs where k=0)
select case when score >= ceiling - 1e-9 then 'confident' when score <= 1e-9 then 'refuted' else 'flaky' end as class, cast(count(*) as bigint) as n from c where not truth group by 1""")
def wrong_classes(spark, sf):
    return R.wrong_classes(B.records(spark, sf))


@query(f"""{S.OBS}, w as (select rec_idx, bool_or(truth) filter (k=0) as first_right, bool_or(truth) filter (k=2) as last_right, sum(cost) as total, sum(cost) filter (k=0) as first_cost from obs where not cache_hit group by rec_idx)
select cast(sum(case when first_right then first_cost else total end) as bigint) as cost, cast(count(*) filter (not first_right and not last_right) as bigint) as bad, cast(count(*) as bigint) as n from w""")
def omniscient_bound(spark, sf):
    return R.omniscient_bound(B.records(spark, sf))


@query(f"{S.replay(*TAU)} select accepted_at, cast(count(*) as bigint) as accepted, cast(count(*) filter (not true_correct) as bigint) as wrong from rep group by 1")
def risk_by_tier(spark, sf):
    return P.replay(B.records(spark, sf), TAU).groupBy("accepted_at").agg(F.count(F.lit(1)).alias("accepted"), F.count_if(~F.col("true_correct")).alias("wrong"))


@query(f"""with {S.TIERS}, {S.obs('obs')}, {S.obs('other', 6)} select cast((select sum(cost) from obs) as bigint) as arm_a, cast((select sum(cost + rec_idx % 3) from other) as bigint) as arm_b,
cast((select sum(cost + rec_idx % 3) from other) - (select sum(cost) from obs) as bigint) as judge""")
def billed(spark, sf):
    a = P.observations(B.records(spark, sf)).agg(F.sum("cost").alias("arm_a"))
    b = P.observations(B.records(spark, sf, 6)).agg(F.sum(F.col("cost") + F.col("rec_idx") % 3).alias("arm_b"))
    return a.crossJoin(b).withColumn("judge", F.col("arm_b") - F.col("arm_a"))


@query(f"""with {S.TIERS}, {S.obs('obs')}, {S.obs('other', 6)} select a.tier, round(avg(b.cost + b.rec_idx % 3 - a.cost), 9) as price, cast(count(*) as bigint) as n
from obs a join other b on a.rec_idx = b.rec_idx and a.k = b.k where a.true_correct is not null group by a.tier""")
def oracle_price(spark, sf):
    a = P.observations(B.records(spark, sf)).where("true_correct is not null").select("rec_idx", "k", "tier", F.col("cost").alias("ca"))
    b = P.observations(B.records(spark, sf, 6)).select("rec_idx", "k", (F.col("cost") + F.col("rec_idx") % 3).alias("cb"))
    return a.join(b, ["rec_idx", "k"]).groupBy("tier").agg(F.round(F.avg(F.col("cb") - F.col("ca")), 9).alias("price"), F.count(F.lit(1)).alias("n"))


@query(f"""{S.replay(*TAU)}, m as (select avg(cost) as c from rep where not cache_hit), f as (select avg(cost) as f from obs where k=2 and not cache_hit)
select round((40.8 + f) / (40.8 + c), 9) as ratio, round((1.2 * c - f) / (1 - 1.2), 9) as break_even from m, f""")
def total_cost(spark, sf):
    """Cost ratio with a shared oracle price S, and the S at which the ratio is 1.2."""
    b = P.baselines(B.records(spark, sf), TAU).withColumn("mean", F.col("cost") / F.col("n"))
    m = b.agg(F.max(F.when(F.col("policy") == "cascade", F.col("mean"))).alias("c"), F.max(F.when(F.col("policy") == "always-frontier", F.col("mean"))).alias("f"))
    return m.select(F.round((40.8 + F.col("f")) / (40.8 + F.col("c")), 9).alias("ratio"), F.round((1.2 * F.col("c") - F.col("f")) / F.lit(1 - 1.2), 9).alias("break_even"))


@query(f"""{S.OBS} select rec_idx, cast(min(k) filter (truth) as integer) as first_right, coalesce(bool_or(truth) filter (k=0), false) <> coalesce(bool_or(truth) filter (k=2), false) as boundary from obs group by rec_idx""")
def escalation_outcome(spark, sf):
    return R.escalation_outcome(B.records(spark, sf))


@query(f"""{S.OBS}, cum as (select rec_idx, k, sum(cost) over (partition by rec_idx order by k) as cumulative from obs)
select rec_idx, k, cast(cumulative - lag(cumulative, 1, 0) over (partition by rec_idx order by k) as bigint) as cost from cum""")
def trace_cost_delta(spark, sf):
    o = P.observations(B.records(spark, sf))
    w = Window.partitionBy("rec_idx").orderBy("k")
    cum = o.select("rec_idx", "k", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    return cum.select("rec_idx", "k", (F.col("c") - F.lag("c", 1, 0).over(w)).cast("long").alias("cost"))


@query(f"{S.OBS} select k, tier, cast(sum(cost) as bigint) as cost, cast(count(*) filter (correct) as bigint) as solved, round(cast(sum(cost) as double) / nullif(count(*) filter (correct), 0), 9) as per_solved from obs group by k, tier")
def tier_cost_ratio(spark, sf):
    o = P.observations(B.records(spark, sf))
    return o.groupBy("k", "tier").agg(F.sum("cost").alias("cost"), F.count_if("correct").alias("solved")).withColumn("per_solved", F.round(F.try_divide(F.col("cost").cast("double"), F.col("solved")), 9))


@query(f"""{S.replay(*TAU)} select rec_idx from rep where accepted_at <> 'cache' and not contaminated and correct and (select o.score from obs o where o.rec_idx = rep.rec_idx and o.k = rep.a) >= 0.35""")
def cache_admission(spark, sf):
    return R.cache_admission(B.records(spark, sf), TAU)


@query(f"{S.OBS} select rec_idx, bool_or(correct) as solved, cast(min(k) filter (correct) as integer) as winner, cast(sum(cost) as bigint) as cost from obs group by rec_idx")
def speculative_winner(spark, sf):
    return R.speculative_winner(B.records(spark, sf))


@query(f"""{S.OBS} select rec_idx, k, case when not is_last and score < case k when 0 then cast(0.4 as double) else cast(0.3 as double) end then 'escalate' when not correct then 'reject' else 'accept' end as decision,
case when not is_last and score < case k when 0 then cast(0.4 as double) else cast(0.3 as double) end then 'score below threshold' when not correct then 'acceptance failed' else 'accepted' end as reason from obs
where k <= (select min(o.k) from obs o where o.rec_idx = obs.rec_idx and (o.is_last or (o.correct and o.score >= case o.k when 0 then cast(0.4 as double) else cast(0.3 as double) end)))""")
def route_trace(spark, sf):
    return R.route_trace(B.records(spark, sf), TAU)


@query(f"{S.replay(*TAU)} select quantile_cont(cost, 0.5) as median, cast(count(*) as bigint) as n, cast(count(*) filter (cost > 55) as bigint) as over from rep")
def cost_rollup(spark, sf):
    r = P.replay(B.records(spark, sf), TAU)
    over = r.agg(F.count_if(F.col("cost") > 55).alias("over"))
    return O.quantile(r, "cost", 0.5).select(F.col("quantile").alias("median"), "n").crossJoin(over)  # one row each


def _cert(spark, sf, salt, name):
    return P.calibrate(B.records(spark, sf, salt), ALPHA, DELTA).withColumn("arm", F.lit(name))


@query(f"select *, 'execution' as arm from ({S.certificate(ALPHA, DELTA)}) union all select *, 'judge' as arm from ({S.certificate(ALPHA, DELTA).replace('*7919', '*7925').replace('*15487', '*15493')})")
def compare_arms(spark, sf):
    return _cert(spark, sf, 0, "execution").unionByName(_cert(spark, sf, 6, "judge"))


LEVELS = {"strict": 0, "balanced": 6, "permissive": 18}


@query(" union all ".join(f"""select '{level}' as level, c.valid, c.tau0, c.tau1, e.over_accept, e.over_reject from
({S.certificate(ALPHA, DELTA).replace('*7919', f'*{7919 + s}').replace('*15487', f'*{15487 + s}')}) c,
(with {S.TIERS}, {S.obs('obs', s)} select cast(count(*) filter (correct and not true_correct) as bigint) over_accept, cast(count(*) filter (not correct and true_correct) as bigint) over_reject from obs) e""" for level, s in LEVELS.items()))
def judge_sweep(spark, sf):
    out = None
    c, t = F.col("correct"), F.col("true_correct")
    for level, salt in LEVELS.items():
        e = P.observations(B.records(spark, sf, salt)).agg(F.count_if(c & ~t).alias("over_accept"), F.count_if(~c & t).alias("over_reject"))
        row = P.calibrate(B.records(spark, sf, salt), ALPHA, DELTA).crossJoin(e).select(F.lit(level).alias("level"), "valid", "tau0", "tau1", "over_accept", "over_reject")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""{S.grid_points('not contaminated and not oracle_unsound').replace("range(11)", "range(4)").replace("i * 0.1", "i * 0.3").replace("* 11", "* 4")} select t0 as tau0, t1 as tau1, n, bad_true as bad, cost from points""")
def compare_tier0(spark, sf):
    """Tier-0 arms over a coarse grid, by truth."""
    p = P.grid_risk(P.score_profiles(P.usable(B.records(spark, sf)), 2, 0.3), 2, 0.3)
    return p.select(F.get("tau", F.lit(0)).alias("tau0"), F.get("tau", F.lit(1)).alias("tau1"), "n", F.col("bad_true").alias("bad"), "cost")
