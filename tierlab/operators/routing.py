"""How a policy routes each record: decisions tier by tier, winners, bounds, admission to the cache, oracle verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import policy as P


def _levels(tau: list[float]) -> Column:
    return F.array(*[F.lit(float(t)) for t in tau])


def _truth_at(k: Column) -> Column:
    return P.truth(F.get(F.col("tiers"), k))


def route_trace(records: DataFrame, tau: list[float]) -> DataFrame:
    """rec_idx, k, decision, reason: tier after tier until one is accepted. Below its threshold a tier escalates, over it a failed acceptance rejects."""
    tiers, levels = F.col("tiers"), _levels(tau)
    n = F.size(tiers)
    clears = lambda k: (k == n - 1) | (F.get(tiers, k)["score"] >= F.get(levels, k))
    right = lambda k: F.get(tiers, k)["correct"]
    stop = F.get(F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == n - 1) | (clears(k) & right(k))), F.lit(0))
    step = lambda k: F.struct(
        k.alias("k"), F.when(~clears(k), "escalate").when(~right(k), "reject").otherwise("accept").alias("decision"),
        F.when(~clears(k), "score below threshold").when(~right(k), "acceptance failed").otherwise("accepted").alias("reason"),
    )
    return records.where(n > 0).select("rec_idx", F.explode(F.transform(F.sequence(F.lit(0), stop), step)).alias("s")).select("rec_idx", "s.*")


def speculative_winner(records: DataFrame) -> DataFrame:
    """rec_idx, solved, winner, cost: every tier runs and is paid; the cheapest that passes wins."""
    takes = F.filter(F.sequence(F.lit(0), F.size("tiers") - 1), lambda k: F.get(F.col("tiers"), k)["correct"])
    cost = P.spend(F.col("tiers"), F.size("tiers") - 1, P.cost_kind(records))
    return records.where(F.size("tiers") > 0).select("rec_idx", (F.size(takes) > 0).alias("solved"), F.get(takes, F.lit(0)).alias("winner"), cost.alias("cost"))


def escalation_outcome(records: DataFrame) -> DataFrame:
    """rec_idx, first_right (the first tier that is right, or null), boundary (first and last tier differ)."""
    first = F.get(F.filter(F.sequence(F.lit(0), F.size("tiers") - 1), _truth_at), F.lit(0))
    return records.where(F.size("tiers") > 0).select("rec_idx", first.alias("first_right"), (_truth_at(F.lit(0)) != _truth_at(F.size("tiers") - 1)).alias("boundary"))


def omniscient_bound(records: DataFrame) -> DataFrame:
    """cost, bad, n of a gate that knows whether the first tier is right and pays for all tiers only if it isn't; cache hits are left out."""
    r = records.where(~F.col("cache_hit") & (F.size("tiers") > 0))
    last, kind = F.size("tiers") - 1, P.cost_kind(records)
    cost = F.when(_truth_at(F.lit(0)), P.spend(F.col("tiers"), F.lit(0), kind)).otherwise(P.spend(F.col("tiers"), last, kind))
    return r.agg(F.sum(cost).alias("cost"), F.count_if(~_truth_at(F.lit(0)) & ~_truth_at(last)).alias("bad"), F.count(F.lit(1)).alias("n"))


def wrong_classes(records: DataFrame) -> DataFrame:
    """class, n of the wrong first-tier answers: confident (at the ceiling of all scores), refuted (score 0) or flaky."""
    o = P.observations(records).where("k = 0")
    top = o.agg(F.max("score").alias("ceiling"))  # one row
    c = F.when(F.col("score") >= F.col("ceiling") - 1e-9, "confident").when(F.col("score") <= 1e-9, "refuted").otherwise("flaky")
    return o.crossJoin(F.broadcast(top)).where(~F.col("truth")).groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def cache_admission(records: DataFrame, tau: list[float], least_score: float = 0.35) -> DataFrame:
    """rec_idx of the answers that may be stored: no cache hits, not contaminated, accepted, right and with a score of least_score."""
    at = F.get(F.col("tiers"), P.accepted_at(F.col("tiers"), _levels(tau)))
    return records.where(~F.col("cache_hit") & ~F.col("contaminated") & at["correct"] & (at["score"] >= least_score)).select("rec_idx")


def oracle_verdict(outcome: Column) -> Column:
    """From a struct built, passed, timed_out: no build or a timeout is inconclusive, a reference that fails its own tests is unsound."""
    return F.when(~outcome["built"], "inconclusive").when(~outcome["passed"], "unsound").when(outcome["timed_out"], "inconclusive").otherwise("sound")


def tier_violations(tiers: DataFrame, config: str, order: str) -> DataFrame:
    """config, order, violation of tiers (samples, price): `samples` under one, `order` where a price is below that of the tier before."""
    before = F.lag("price").over(Window.partitionBy(config).orderBy(order))  # a configuration is a handful of rows
    found = F.array_compact(F.array(F.when(F.col("samples") < 1, "samples"), F.when(F.col("price") < F.col("_before"), "order")))
    return tiers.withColumn("_before", before).select(config, order, F.explode(found).alias("violation"))
