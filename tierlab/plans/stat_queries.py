"""Queries of the statistics, over parameter tables and over aggregates of the data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as T
from ..operators import policy as P
from ..operators import studies as D
from ..sources import bindings as B
from . import sql as S
from .registry import query


def _groups(spark, sf):
    """k, g, n, bad: observations of each tier in sixty groups of problems."""
    o = P.observations(B.records(spark, sf))
    return o.groupBy("k", (F.col("rec_idx") % 60).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("truth")).alias("bad"))


GROUPS = f"{S.OBS}, gr as (select k, rec_idx % 60 as g, count(*) as n, count(*) filter (not truth) as bad from obs group by 1, 2)"
KEYS = "cast(k as integer) as k, cast(g as bigint) as g"


def _crossed(spark, sf, groups: int):
    """g and a, b, c, e: problems by whether the first and the second tier are right (both, first only, second only, none)."""
    right = lambda k: F.coalesce(P.truth(F.get(F.col("tiers"), F.lit(k))), F.lit(False))
    r = B.records(spark, sf).select((F.col("rec_idx") % groups).alias("g"), right(0).alias("x"), right(1).alias("y"))
    cell = lambda c: F.count_if(c)
    x, y = F.col("x"), F.col("y")
    return r.groupBy("g").agg(cell(x & y).alias("a"), cell(x & ~y).alias("b"), cell(~x & y).alias("c"), cell(~x & ~y).alias("e"))


def crossed(groups: int) -> str:
    return f"""{S.OBS}, w as (select rec_idx, bool_or(truth) filter (k = 0) as x, bool_or(truth) filter (k = 1) as y from obs group by rec_idx),
t as (select rec_idx % {groups} as g, count(*) filter (x and y) as a, count(*) filter (x and not y) as b, count(*) filter (not x and y) as c, count(*) filter (not x and not y) as e from w group by 1)"""


def _sizes(spark, sf, least: int, most: int):
    """n: how many orders customers have, each number once; and k from 0 to n."""
    n = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select("n").where(F.col("n").between(least, most)).distinct()
    return n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("k"))


SIZES = "sizes as (select distinct count(*) as n from orders group by o_custkey having count(*) between {least} and {most}), pairs as (select n, unnest(range(0, n + 1)) as k from sizes)"


@query(f"{GROUPS} select {KEYS}, round({S.wilson('(n - bad)', 'n')}, 9) as lcb from gr")
def wilson_lcb(spark, sf):
    """The lower bound of each group's rate of right answers."""
    return _groups(spark, sf).select("k", "g", F.round(T.wilson_lcb(F.col("n") - F.col("bad"), F.col("n")), 9).alias("lcb"))


@query(f"{GROUPS}, s as (select n as m, {S.wilson('n', 'n')} as top from range(1, 5001) t(n)), w as (select k, g, round(cast(n - bad as double) / n, 4) as want from gr) select {KEYS}, want, cast(coalesce((select min(m) from s where top >= want), 0) as bigint) as n from w")
def min_samples_for(spark, sf):
    """The fewest unanimous samples whose score reaches a group's rate of right answers; 0 if none does."""
    want = F.round((F.col("n") - F.col("bad")).cast("double") / F.col("n"), 4)
    return _groups(spark, sf).select("k", "g", want.alias("want")).select("*", T.min_samples_for(F.col("want")).alias("n"))


TAIL = "(select sum(exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) + i * ln({p}) + ({n} - i) * ln(1 - {p}))) from range(cast({lo} as bigint), cast({hi} as bigint) + 1) t(i))"


def cdf(k: str, n: str, p: str) -> str:
    """Binomial tail sum as a join-free list expression."""
    return f"list_sum(list_transform(range(0, cast({k} as bigint) + 1), lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"


@query(f"{GROUPS}, ps as (select unnest([0.07, 0.23, 0.45, 0.88]::double[]) as p) select {KEYS}, p, round(least(1.0, {cdf('bad', 'n', 'p')}), 9) as cdf from gr, ps")
def binom_cdf(spark, sf):
    """The chance of no more errors than a group has, at four rates."""
    p = _groups(spark, sf).withColumn("p", F.explode(F.array(*map(F.lit, (0.07, 0.23, 0.45, 0.88)))))
    return p.select("k", "g", "p", F.round(F.least(F.lit(1.0), T.binom_cdf(F.col("bad"), F.col("n"), F.col("p"))), 9).alias("cdf"))


@query(f"""{GROUPS}, r as (select k, g, n, bad, 0.25::double as alpha, cast(bad as double) / n as risk from gr)
select {KEYS}, round(case when risk >= alpha then 1.0 else least(1.0, exp(-n * (case when bad = 0 then 0.0 else risk * ln(risk / alpha) end + (1 - risk) * ln((1 - risk) / (1 - alpha)))), 2.718281828459045 * {cdf('ceil(n * risk)', 'n', 'alpha')}) end, 9) as p from r""")
def hoeffding_bentkus(spark, sf):
    """Each group's p-value of an error rate over a quarter."""
    return _groups(spark, sf).select("k", "g", F.round(T.hoeffding_bentkus(F.col("bad") / F.col("n"), F.col("n"), F.lit(0.25)), 9).alias("p"))


@query(f"{GROUPS}, d as (select unnest([0.05, 0.1]::double[]) as delta) select {KEYS}, delta, cast(ceil(ln(delta) / ln(1 - cast(bad as double) / n)) as bigint) as size from gr, d where bad > 0 and bad < n")
def min_calibration_size(spark, sf):
    """How many error-free records certify each group's own error rate."""
    g = _groups(spark, sf).where("bad > 0 and bad < n").withColumn("delta", F.explode(F.array(F.lit(0.05), F.lit(0.1))))
    return g.select("k", "g", "delta", T.min_calibration_size(F.col("bad").cast("double") / F.col("n"), F.col("delta")).alias("size"))


@query(f"""with recursive {S.OBS[5:]}, g as (select round(score, 4) as score, count(*) filter (not truth) as k, count(*) as n from obs where k = 0 group by 1),
b as (select score, k, n, 0.0::double as lo, 1.0::double as hi, 0 as i from g union all
      select score, k, n, case when above then mid else lo end, case when above then hi else mid end, i + 1
      from (select *, {cdf('k', 'n', 'mid')} > 0.05 as above from (select *, (lo + hi) / 2 as mid from b where i < 60)))
select score, cast(k as bigint) as k, cast(n as bigint) as n, round(case when k = n then 1.0 when k = 0 then 1 - pow(0.05::double, 1.0 / n) else (lo + hi) / 2 end, 9) as upper from b where i = 60""")
def clopper_pearson(spark, sf):
    """Upper bounds at 0.95 of wrong tier-0 answers by score; the twin halves the interval of the defining equation."""
    o = P.observations(B.records(spark, sf)).where("k = 0")
    g = o.groupBy(F.round("score", 4).alias("score")).agg(F.count_if(~F.col("truth")).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("score", "k", "n", F.round(T.clopper_pearson_upper(F.col("k"), F.col("n"), F.lit(0.05)), 9).alias("upper"))


@query(f"{crossed(60)} select g, b, c, round(case when b + c = 0 then 1.0 else least(1.0, 2 * {cdf('least(b, c)', '(b + c)', '0.5')}) end * (1 + 1e-11), 9) as p from t")
def mcnemar_exact(spark, sf):
    """Do the first two tiers err alike: the exact test on the problems that one of them gets right."""
    p = T.mcnemar_exact(F.col("b"), F.col("c")) * (1 + 1e-11)  # powers of two are ties of the rounding: both engines lean up
    return _crossed(spark, sf, 60).select("g", "b", "c", F.round(p, 9).alias("p"))


_HYPER = "exp(lgamma(a+b+1.0) - lgamma(x+1.0) - lgamma(a+b-x+1.0) + lgamma(c+e+1.0) - lgamma(a+c-x+1.0) - lgamma(e-a+x+1.0) - lgamma(a+b+c+e+1.0) + lgamma(a+c+1.0) + lgamma(b+e+1.0))"
_T = crossed(400) + f", x as (select g,a,b,c,e, unnest(range(greatest(0, a-e), least(a+b, a+c) + 1)) as x from t), h as (select g,a,b,c,e,x, {_HYPER} as p from x)"


@query(f"{_T} select g, a, b, c, e, round(least(1.0, sum(p) filter (x >= a)), 9) as p from h group by all")
def fisher_one_sided(spark, sf):
    """Are the first two tiers right together more often than by chance, in each of 400 groups."""
    return _crossed(spark, sf, 400).withColumn("p", F.round(T.fisher_one_sided(*map(F.col, "abce")), 9))


@query(f"{_T}, s as (select g,p as seen from h where x = a) select g, a, b, c, e, round(least(1.0, sum(p) filter (p <= seen * (1 + 1e-7))), 9) as p, case when b * c > 0 then round(cast(a * e as double) / (b * c), 9) end as odds from h join s using (g) group by g, a, b, c, e")
def fisher_two_sided(spark, sf):
    """The same without a direction, with the odds ratio (null where a cell off the diagonal is empty)."""
    odds = F.when(F.col("b") * F.col("c") > 0, F.round((F.col("a") * F.col("e")).cast("double") / (F.col("b") * F.col("c")), 9))
    return _crossed(spark, sf, 400).select("*", F.round(T.fisher_two_sided(*map(F.col, "abce")), 9).alias("p"), odds.alias("odds"))


@query("""with s as (select customer.c_mktsegment as seg, o_totalprice as x from orders join customer on o_custkey = c_custkey where c_mktsegment in ('BUILDING','MACHINERY')),
v as (select x, count(*) as n, count(*) filter (seg='BUILDING') as na from s group by x),
r as (select *, sum(n) over (order by x) - n + (n + 1) / 2.0 as rank from v),
t as (select sum(na) as n1, sum(n - na) as n2, sum(na * rank) as r1, sum(cast(n as double)*n*n - n) as ties from r)
select cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, round(r1 - n1*(n1+1)/2.0, 6) as u, round((r1 - n1*(n1+1)/2.0 - n1*n2/2.0) / sqrt(n1*n2/12.0*((n1+n2+1) - ties/((n1+n2)*(n1+n2-1.0)))), 6) as z from t""")
def mann_whitney(spark, sf):
    """U and its normal score with tie correction. Ranks come from counts per value: equal values share their mean rank."""
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select((F.col("c_mktsegment") == "BUILDING").alias("a"), F.col("o_totalprice").alias("x"))
    return D.rank_sum(s, "a", "x").select("n1", "n2", "u", "z")


@query("with " + SIZES.format(least=3, most=60) + """,
p as (select n, k, exp(lgamma(n+1.0)-lgamma(k+1.0)-lgamma(n-k+1.0) + k*ln(0.2::double) + (n-k)*ln(0.8::double)) as p0, exp(lgamma(n+1.0)-lgamma(k+1.0)-lgamma(n-k+1.0) + k*ln(0.6::double) + (n-k)*ln(0.4::double)) as p1 from pairs),
t as (select n, k, sum(p0) over (partition by n order by k desc) as tail0, sum(p1) over (partition by n order by k desc) as tail1 from p)
select n, cast(min(k) as bigint) as critical, round(max(tail1) filter (k = (select min(k) from t u where u.n = t.n and u.tail0 < 0.05)), 9) as power from t where tail0 < 0.05 group by n""")
def critical_value(spark, sf):
    """For each number of orders a customer has: the least count whose upper tail at rate 0.2 is under 0.05, and the power at rate 0.6."""
    tail = lambda p: 1 - T.binom_cdf(F.col("k") - 1, F.col("n"), F.lit(p))
    t = _sizes(spark, sf, 3, 60).withColumn("t0", tail(0.2)).where("t0 < 0.05").groupBy("n").agg(F.min("k").alias("k"))
    return t.select("n", F.col("k").alias("critical"), F.round(tail(0.6), 9).alias("power"))


@query(f"{S.OBS} select tier, round(exp(sum(ln(1 - least(score, 0.999)))), 9) as p_zero from (select *, row_number() over (partition by tier order by rec_idx) as r from obs) where r <= 20 group by tier")
def p_zero(spark, sf):
    """The chance that none of the first twenty observations of a tier fires, each with its score as its rate."""
    o = P.observations(B.records(spark, sf)).withColumn("r", F.row_number().over(Window.partitionBy("tier").orderBy("rec_idx"))).where("r <= 20")  # each task keeps its first 20 of a tier before the exchange
    return o.groupBy("tier").agg(F.round(F.exp(_log_none(F.lit(1))), 9).alias("p_zero"))


def _log_none(n):
    """The log of the chance that nothing fires, of rows (score, n times)."""
    return F.sum(n * F.log1p(-F.least(F.col("score"), F.lit(0.999))))


@query(f"{S.OBS} select tier, count(*) as n, round(sum(ln(1 - least(score, 0.999))), 6) as log_p_zero from obs group by tier")
def p_zero_all(spark, sf):
    """p_zero over every observation of a tier, as a log since the product underflows; equal scores are counted first."""
    g = P.observations(B.records(spark, sf)).groupBy("tier", "score").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("tier").agg(F.sum("n").alias("n"), F.round(_log_none(F.col("n")), 6).alias("log_p_zero"))


@query(f"{S.OBS}, g as (select tier, avg(cast(not truth as int)) as p from obs group by tier), m as (select unnest([47, 53, 64]) as m) select tier, cast(m as bigint) as m, round(pow(1 - p, m), 9) as p_zero, round(p * m, 9) as expected from g, m")
def zero_prob(spark, sf):
    g = P.observations(B.records(spark, sf)).groupBy("tier").agg(F.avg((~F.col("truth")).cast("int")).alias("p"))
    m = g.withColumn("m", F.explode(F.array(*[F.lit(x).cast("long") for x in (47, 53, 64)])))
    return m.select("tier", "m", F.round(F.pow(1 - F.col("p"), F.col("m")), 9).alias("p_zero"), F.round(F.col("p") * F.col("m"), 9).alias("expected"))


_UP = "list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n+1.0)-lgamma(i+1.0)-lgamma(n-i+1.0) + i*ln({p}) + (n-i)*ln(1-{p}))))"


@query(f"with {SIZES.format(least=1, most=60)}, d as (select n, k, round({_UP.format(p='0.9')} - {_UP.format(p='0.5')}, 9) as gap from pairs), r as (select *, row_number() over (partition by n order by gap desc, k) as rn from d) select n, k, gap from r where rn = 1")
def headroom(spark, sf):
    """For each number of orders a customer has: the count that best tells a rate of 0.9 from one of 0.5 (first of the best)."""
    up = lambda p: 1 - T.binom_cdf(F.col("k") - 1, F.col("n"), F.lit(p))
    d = _sizes(spark, sf, 1, 60).withColumn("gap", F.round(up(0.9) - up(0.5), 9))
    return d.groupBy("n").agg(F.max_by(F.struct("k", "gap"), F.struct(F.col("gap"), -F.col("k"))).alias("b")).select("n", "b.k", "b.gap")


@query(f"with {S.TIERS}, c as (select conv_id, cast(sum(case when role <> 'assistant' then strlen(text) // 4 else 0 end) as bigint) as tin, cast(sum(case when role = 'assistant' then strlen(text) // 4 else 0 end) as bigint) as tout from conversations group by conv_id) select conv_id, tier, round(tin / 1e6 * in_price + tout / 1e6 * out_price, 9) as usd from c, tiers")
def token_cost(spark, sf):
    c = _calls(spark, sf).crossJoin(F.broadcast(B.tiers(spark)))  # three rows
    return c.select("conv_id", "tier", F.round(F.col("tin") / 1e6 * F.col("in_price") + F.col("tout") / 1e6 * F.col("out_price"), 9).alias("usd"))


def _calls(spark, sf):
    c = B.table(spark, sf, "conversations").select("conv_id", "role", F.expr("octet_length(text) div 4").alias("tokens"))
    out = F.col("role") == "assistant"
    return c.groupBy("conv_id").agg(F.sum(F.when(out, 0).otherwise(F.col("tokens"))).alias("tin"), F.sum(F.when(out, F.col("tokens")).otherwise(0)).alias("tout"))


@query("select conv_id, turn, cast(strlen(text) // 4 as bigint) as tokens from conversations")
def token_estimate(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", F.expr("octet_length(text) div 4").alias("tokens"))


@query(f"{S.OBS}, c as (select rec_idx, k, cost + rec_idx % 4 * 10 as cost, lead(cost + rec_idx % 4 * 10 * (k + 1)) over (partition by rec_idx order by k) as next, rec_idx % 3 as depth from obs) select rec_idx, cast(k as integer) as k, case when depth = 0 then false when next is null then true else 0.45::double / (cost / 2.0) > 0.35::double / next end as repair from c")
def prefer_repair(spark, sf):
    """Whether another repair beats escalating: chance per cost, repair at half the tier's cost; depth 0 never, last tier always."""
    extra = F.col("rec_idx") % 4 * 10
    o = P.observations(B.records(spark, sf)).select("rec_idx", "k", (F.col("cost") + extra).alias("cost"), (F.col("cost") + extra * (F.col("k") + 1)).alias("own"))
    o = o.withColumn("next", F.lead("own").over(Window.partitionBy("rec_idx").orderBy("k")))
    worth = 0.45 / (F.col("cost") / 2.0) > 0.35 / F.col("next")
    return o.select("rec_idx", "k", F.when(F.col("rec_idx") % 3 == 0, False).when(F.col("next").isNull(), True).otherwise(worth).alias("repair"))


@query(f"{S.OBS} select rec_idx, cast(k as integer) as k, case when k < rec_idx % 4 then 0.7::double - k * 0.1::double when k = 0 then 0.6::double else 0.5::double end as tau from obs")
def effective_tau(spark, sf):
    """A given vector, which may be shorter than the tiers, else the prior 0.6 at the first tier and 0.5 after it."""
    given = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (F.col("rec_idx") % 4).cast("int")), lambda k: F.lit(0.7) - k * F.lit(0.1))
    prior = F.when(F.col("k") == 0, 0.6).otherwise(0.5)
    return P.observations(B.records(spark, sf)).select("rec_idx", "k", F.coalesce(F.get(given, F.col("k")), prior).alias("tau"))


@query(f"with t as (select o_custkey, o_orderstatus, count(*) as samples from orders group by 1, 2), w as (select o_custkey, {S.wilson('samples', 'samples')} as top from t) select o_custkey, round(max(top), 9) as attainable, round(min(top), 9) as admit, floor(round(min(top), 9) * 1000) / 1000 as suggested from w group by o_custkey")
def admit_score(spark, sf):
    """Of the sample counts that a configuration has (a customer's orders by status): the highest attainable score and the admission gate all can reach."""
    t = B.table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("samples"))
    w = t.select("o_custkey", T.wilson_lcb(F.col("samples"), F.col("samples")).alias("top")).groupBy("o_custkey")
    return w.agg(F.round(F.max("top"), 9).alias("attainable"), F.round(F.min("top"), 9).alias("admit"), (F.floor(F.round(F.min("top"), 9) * 1000) / F.lit(1000.0)).alias("suggested"))


@query("select o_orderkey as id from orders where cast('0x' || substr(sha256(cast(o_orderkey as varchar)), 1, 6) as bigint) % 1000 < 50")
def shadow_sample(spark, sf):
    """A twentieth of the problems bypasses the cache, drawn by a hash of the id, so a retry draws the same."""
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return o.where(F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 6), 16, 10).cast("long") % 1000 < 50)


@query(f"{S.OBS} select rec_idx, k, round((1 + rec_idx % 7) * 0.5::double * 0.0001::double, 9) as usd from obs")
def compute_cost(spark, sf):
    o = P.observations(B.records(spark, sf))
    return o.select("rec_idx", "k", F.round((1 + F.col("rec_idx") % 7) * F.lit(0.5) * F.lit(0.0001), 9).alias("usd"))


@query(f"select valid, realized_risk, alpha, valid and realized_risk > alpha + 1e-9 as nominal_only from ({S.certificate(0.2, 0.1)})")
def nominal_flag(spark, sf):
    return P.calibrate(B.records(spark, sf), 0.2, 0.1).select("valid", "realized_risk", "alpha", "nominal_only")


@query("select user_id, ['V0:parse','V1:imports','V2:typecheck','V3:build','V4:vet','V5:visible','V6:race','V7:held-out','VA:accept'][event_id % 9 + 1] as stage, count(*) as n from events where event_type = 'error' group by 1, 2")
def stage_names(spark, sf):
    """Refuted candidates of each problem by the name of the stage they failed at."""
    names = F.array(*map(F.lit, ("V0:parse", "V1:imports", "V2:typecheck", "V3:build", "V4:vet", "V5:visible", "V6:race", "V7:held-out", "VA:accept")))
    e = B.table(spark, sf, "events").where("event_type = 'error'")
    return e.groupBy("user_id", F.get(names, (F.col("event_id") % 9).cast("int")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("""with t as (select o_custkey % 40 as fam, o_orderpriority as pri, count(*) filter (o_orderkey % 3 = 0 and o_orderkey % 2 = 0) a, count(*) filter (o_orderkey % 3 = 0 and o_orderkey % 2 = 1) b,
count(*) filter (o_orderkey % 3 <> 0 and o_orderkey % 2 = 0) c, count(*) filter (o_orderkey % 3 <> 0 and o_orderkey % 2 = 1) e from orders group by 1, 2),
x as (select fam,pri,a,b,c,e, unnest(range(greatest(0, a-e), least(a+b, a+c) + 1)) as x from t), h as (select *, """ + _HYPER + """ as p from x), s as (select fam, pri, p as seen from h where x = a)
select fam, pri, a as both_wrong, b as only_first, c as only_second, e as both_right, round((a + b) * (a + c) / cast(a + b + c + e as double), 9) as expected,
case when b * c > 0 then round(cast(a * e as double) / (b * c), 9) end as odds, round(least(1.0, sum(p) filter (x >= a)), 9) as p_together, round(least(1.0, sum(p) filter (p <= seen * (1 + 1e-7))), 9) as p_two_sided from h join s using (fam, pri) group by all""")
def cross_family_check(spark, sf):
    """Do two families err together: the counts, the joint errors that chance would give, the odds ratio and Fisher's p-values of each pair."""
    o, x, y = B.table(spark, sf, "orders"), F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 2 == 0
    return D.joint_errors(o.select((F.col("o_custkey") % 40).alias("fam"), F.col("o_orderpriority").alias("pri"), x.alias("first_wrong"), y.alias("second_wrong")), ["fam", "pri"])


@query(f"""{S.OBS}, i as (select rec_idx, cast(rec_idx % 10 as bigint) as family, correct from obs where k=0) select a.family as fam_a, b.family as fam_b, cast(count(*) as bigint) as n, cast(count(*) filter (a.correct = b.correct) as bigint) as agree
from i a join i b on a.rec_idx // 10 = b.rec_idx // 10 and a.family < b.family group by 1, 2 having count(*) >= 15""")
def cross_family_pairs(spark, sf):
    """Pairs of families over the ids they share; at least fifteen."""
    t0 = F.get(F.col("tiers"), F.lit(0))["correct"]
    i = B.records(spark, sf).select((F.col("rec_idx") % 10).alias("family"), F.expr("rec_idx div 10").alias("id"), t0.alias("correct"))
    a = i.select("id", F.col("family").alias("fam_a"), F.col("correct").alias("ca"))
    b = i.select("id", F.col("family").alias("fam_b"), F.col("correct").alias("cb"))
    j = a.join(b, "id").where("fam_a < fam_b")
    return j.groupBy("fam_a", "fam_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ca") == F.col("cb")).alias("agree")).where("n >= 15")
