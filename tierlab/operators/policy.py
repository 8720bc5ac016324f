"""Policy replay and certification.

A policy is a vector of thresholds. A record is accepted at the first tier whose score reaches its threshold; the last
tier accepts anything. Risk and cost of a policy on a grid of thresholds depend on a record only through the grid levels
that its scores reach, so records are summed by those first: at most (levels + 1) ** places profiles, however many scores
there are. The points' sums are then cumulative sums over the lattice of levels, one place at a time, and no record or
profile is ever joined with the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import hoeffding_bentkus

SHADOW_LEAST = 30


def truth(obs: Column) -> Column:
    """The true label where there is one, else the oracle's."""
    return F.coalesce(obs["true_correct"], obs["correct"])


def observations(records: DataFrame) -> DataFrame:
    """One row for each record and tier."""
    keep = [c for c in records.columns if c != "tiers"]
    out = records.select(*keep, F.size("tiers").alias("n_tiers"), F.posexplode("tiers").alias("k", "o"))
    return out.select(*keep, "n_tiers", "k", "o.*", truth(F.col("o")).alias("truth"), (F.col("k") == F.col("n_tiers") - 1).alias("is_last"))


def accepted_at(tiers: Column, tau: Column) -> Column:
    """The index of the accepting tier; null without tiers."""
    n = F.size(tiers)
    takes = lambda k: (k == n - 1) | ((k < F.size(tau)) & (F.get(tiers, k)["score"] >= F.get(tau, k)))
    return F.when(n > 0, F.get(F.filter(F.sequence(F.lit(0), n - 1), takes), F.lit(0)))


def cost_kind(records: DataFrame) -> str:
    """long for whole units, double for money as recorded."""
    return records.schema["tiers"].dataType.elementType["cost"].dataType.simpleString()


def spend(tiers: Column, at: Column, kind: str = "bigint") -> Column:
    """The cost of all tiers up to `at`, added in tier order."""
    zero = F.lit(0).cast(kind)
    return F.when(at.isNull(), zero).otherwise(F.aggregate(F.slice(tiers, F.lit(1), at + 1), zero, lambda s, t: s + t["cost"]))


def replay(records: DataFrame, tau: list[float]) -> DataFrame:
    """correct, true_correct (truth label), cost, accepted_at of each record; a cache hit answers before any tier."""
    levels = F.array(*[F.lit(float(t)) for t in tau])
    out = records.withColumn("_at", accepted_at(F.col("tiers"), levels))
    at = F.get(F.col("tiers"), F.col("_at"))
    label = F.when(F.col("cache_hit"), "cache").when(F.col("_at").isNull(), "exhausted").otherwise(at["tier"])
    return out.select(
        "rec_idx", label.alias("accepted_at"),
        F.when(F.col("cache_hit"), F.col("cache_correct")).otherwise(F.coalesce(at["correct"], F.lit(False))).alias("correct"),
        F.when(F.col("cache_hit"), F.col("cache_correct")).otherwise(F.coalesce(truth(at), F.lit(False))).alias("true_correct"),
        F.when(F.col("cache_hit"), F.col("cache_cost")).otherwise(spend(F.col("tiers"), F.col("_at"), cost_kind(records))).cast(cost_kind(records)).alias("cost"),
    )


def usable(records: DataFrame) -> DataFrame:
    return records.where(~F.coalesce("contaminated", F.lit(False)) & ~F.coalesce("oracle_unsound", F.lit(False)))


def exclusions(records: DataFrame) -> DataFrame:
    """Contaminated first, then unsound; inconclusive rows are kept and counted."""
    bad, unsound = F.coalesce("contaminated", F.lit(False)), F.coalesce("oracle_unsound", F.lit(False))
    return records.agg(
        F.count_if(bad).alias("n_contaminated"), F.count_if(~bad & unsound).alias("n_unsound"),
        F.count_if(~bad & ~unsound & F.coalesce("oracle_inconclusive", F.lit(False))).alias("n_inconclusive"), F.count_if(~bad & ~unsound).alias("n_usable"),
    )


def prefer_shadow(records: DataFrame) -> DataFrame:
    """The shadow rows alone if there are enough of them, else all; n_shadow is added. The count is one small row."""
    n = records.agg(F.count_if("shadow").alias("n_shadow"))
    return records.crossJoin(F.broadcast(n)).where((F.col("n_shadow") < SHADOW_LEAST) | F.col("shadow"))


def grid_levels(step: float = 0.1) -> list[float]:
    levels, x = [], 0.0
    while x <= 1 + 1e-9:
        levels.append(round(x, 3))
        x += step
    return levels


def threshold_grid(spark: SparkSession, arity: int, step: float = 0.1) -> DataFrame:
    """grid_idx and tau: levels 0, step, ... up to 1 in each place, the last place fastest."""
    levels = grid_levels(step)
    n = len(levels)
    level = F.array(*[F.lit(v) for v in levels])
    place = lambda j: F.get(level, (F.floor(F.col("grid_idx") / n ** (arity - 1 - j)) % n).cast("int"))
    tau = F.array(*[place(j) for j in range(arity)]) if arity else F.array().cast("array<double>")
    return spark.range(n**arity if arity > 0 else 0).select(F.col("id").alias("grid_idx"), tau.alias("tau"))


def codes(arity: int) -> list[str]:
    return [f"_g{d}" for d in range(arity)]


def outcomes(arity: int) -> list[str]:
    return ["_n", *(f"_{x}{s}" for s in range(arity + 1) for x in "wtc")]


def coded(records: DataFrame, arity: int, step: float = 0.1, keep: list[str] | None = None) -> DataFrame:
    """What a grid of thresholds can tell of a record, in a narrow row: columns `keep`, codes(arity) and outcomes(arity).

    _g0, _g1, ...: how many grid levels the score of a tier reaches; null from the record's last stop on. A record stops at a
    tier under a threshold, or at its last tier (after `arity` thresholds at the latest); _w, _t, _c of stop s: wrong,
    wrong by truth, cost up to there. Cache hits and records without tiers have one stop.
    """
    hit, kind = F.coalesce(F.col("cache_hit"), F.lit(False)), cost_kind(records)
    level = F.array(*[F.lit(v) for v in grid_levels(step)])
    last = F.when(hit, 0).otherwise(F.greatest(F.size("tiers") - 1, F.lit(0)))
    stops = F.least(last, F.lit(arity))
    out = records.select(*(keep or []), "tiers", "cache_correct", "cache_cost", hit.alias("_hit"), last.alias("_last"), stops.alias("_stops"))
    reached = lambda d: F.size(F.filter(level, lambda v: v <= F.coalesce(F.get(F.col("tiers"), F.lit(d))["score"], F.lit(-1.0))))
    made = [F.when(F.col("_stops") > d, reached(d)).alias(f"_g{d}") for d in range(arity)]
    for s in range(arity + 1):
        k = F.when(F.col("_stops") == s, F.col("_last")).otherwise(F.lit(s))
        at = F.get(F.col("tiers"), k)
        wrong = lambda x: F.when(F.col("_hit"), ~F.col("cache_correct")).otherwise(~F.coalesce(x, F.lit(False))).cast("long")
        cost = F.when(F.col("_hit"), F.col("cache_cost").cast(kind)).otherwise(spend(F.col("tiers"), k, kind))
        reachable = F.col("_stops") >= s
        made += [F.when(reachable, x).alias(f"_{name}{s}") for name, x in (("w", wrong(at["correct"])), ("t", wrong(truth(at))), ("c", cost))]
    return out.select(*(keep or []), F.lit(1).cast("long").alias("_n"), *made)


def score_profiles(records: DataFrame, arity: int, step: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """coded rows (or records, which are coded first) summed by their codes: at most (levels + 1) ** arity profiles and those of shorter records."""
    by = by or []
    rows = records if "_n" in records.columns else coded(records, arity, step, by)
    return rows.groupBy(*by, *codes(arity)).agg(*[F.sum(c).alias(c) for c in outcomes(arity)])


def grid_risk(profiles: DataFrame, arity: int, step: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """grid_idx, tau, n, bad, bad_true, cost, risk of every threshold vector (in each group of `by`).

    Stop s of a profile counts at the points whose first s thresholds are over the codes and whose threshold s is not: a
    code becomes the range of thresholds it allows, place by place, and sums are taken after each place, so no more than
    levels times the lattice's points are ever made.
    """
    by = by or []
    levels = grid_levels(step)
    top, place = len(levels) - 1, codes(arity)
    stops = F.lit(0)
    for c in place:
        stops = stops + F.col(c).isNotNull().cast("int")
    each = F.array(*[F.struct(F.lit(s).alias("s"), *[F.col(f"_{x}{s}").alias(x) for x in "wtc"]) for s in range(arity + 1)])
    rows = profiles.withColumn("_m", stops).withColumn("x", F.explode(F.slice(each, F.lit(1), F.col("_m") + 1)))
    rows = rows.select(*by, *place, F.col("x.s").alias("_s"), (F.col("x.s") == F.col("_m")).alias("_final"), "_n", *[F.col(f"x.{c}").alias(f"_{c}") for c in "wtc"])
    none = F.array().cast("array<int>")
    for d, c in enumerate(place):
        over = F.when(F.col(c) <= top, F.sequence(F.col(c), F.lit(top))).otherwise(none)
        under = F.when(F.col(c) >= 1, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(none)
        allowed = F.when(F.col("_s") > d, over).when((F.col("_s") == d) & ~F.col("_final"), under).otherwise(F.array(F.lit(-1)))  # -1: any
        rows = rows.withColumn(c, F.explode(allowed))
        if d < arity - 1:
            rows = rows.groupBy(*by, *place, "_s", "_final").agg(*[F.sum(x).alias(x) for x in ("_n", "_w", "_t", "_c")])
    for c in place:
        rows = rows.withColumn(c, F.explode(F.when(F.col(c) < 0, F.sequence(F.lit(0), F.lit(top))).otherwise(F.array(F.col(c)))))
    index = F.lit(0).cast("long")
    for c in place:
        index = index * (top + 1) + F.col(c)
    sums = rows.groupBy(*by, index.alias("grid_idx")).agg(F.sum("_n").alias("n"), F.sum("_w").alias("bad"), F.sum("_t").alias("bad_true"), F.sum("_c").alias("cost"))
    level = F.array(*[F.lit(v) for v in levels])
    tau = F.array(*[F.get(level, (F.floor(F.col("grid_idx") / (top + 1) ** (arity - 1 - d)) % (top + 1)).cast("int")) for d in range(arity)]) if arity else F.array().cast("array<double>")
    return sums.select(*by, "grid_idx", tau.alias("tau"), "n", "bad", "bad_true", "cost", (F.col("bad") / F.col("n")).alias("risk"))


def fixed_sequence(points: DataFrame, alpha: float, delta: float, by: list[str] | None = None) -> DataFrame:
    """p and certified: points in order of falling threshold sum (then lexicographically) up to the first p > delta."""
    by = by or []
    total = F.aggregate("tau", F.lit(0.0), lambda a, x: a + x)
    order = Window.partitionBy(*by).orderBy(F.desc("_sum"), F.desc("tau"))
    out = points.withColumn("p", hoeffding_bentkus(F.col("risk"), F.col("n"), F.lit(alpha))).withColumn("_sum", total)
    out = out.withColumn("test_rank", F.row_number().over(order).cast("long"))
    failed = F.max((F.col("p") > delta).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("certified", failed == 0).drop("_sum")


def bonferroni(points: DataFrame, alpha: float, delta: float) -> DataFrame:
    """p, test_rank (grid order) and certified where p <= delta / number of points."""
    size = points.agg(F.count(F.lit(1)).alias("_m"))
    out = points.withColumn("p", hoeffding_bentkus(F.col("risk"), F.col("n"), F.lit(alpha))).crossJoin(F.broadcast(size))
    return out.withColumn("test_rank", F.col("grid_idx")).withColumn("certified", F.col("p") <= delta / F.col("_m")).drop("_m")


def select_threshold(tested: DataFrame, by: list[str] | None = None) -> DataFrame:
    """valid, tau and its figures: the cheapest certified point (first in test order), else the least risk (first in grid order)."""
    by = by or []
    row = F.struct("tau", "grid_idx", "n", "bad", "bad_true", "cost", "risk", "p")
    best = F.min_by(row, F.when(F.col("certified"), F.struct("cost", "test_rank")))
    least = F.min_by(row, F.struct("risk", "grid_idx"))
    out = tested.groupBy(*by).agg(F.bool_or("certified").alias("valid"), F.count_if("certified").alias("n_certified"), best.alias("b"), least.alias("l"))
    pick = F.when(F.col("valid"), F.col("b")).otherwise(F.col("l"))
    return out.select(*by, "valid", "n_certified", pick.alias("x")).select(*by, "valid", "n_certified", "x.*")


def calibrate(records: DataFrame, alpha: float, delta: float, step: float = 0.1, method: str = "fixed-sequence", arity: int = 2) -> DataFrame:
    """The certificate: exclusions, shadow preference, grid risks, p-values, ordered tests, choice, realised risk.

    Without a usable record reading valid is an error. With one tier (arity 0) there is nothing to choose or test: the
    certificate is valid as it stands, without a p-value.
    """
    if method not in ("fixed-sequence", "bonferroni"):
        raise ValueError(f"unknown method {method}")
    used = prefer_shadow(usable(records))
    points = grid_risk(score_profiles(used, arity, step), arity, step)
    if not arity:
        tested = points.select("*", F.lit(None).cast("double").alias("p"), F.col("grid_idx").alias("test_rank"), F.lit(True).alias("certified"))
    else:
        tested = fixed_sequence(points, alpha, delta) if method == "fixed-sequence" else bonferroni(points, alpha, delta)
    chosen = select_threshold(tested)
    chosen = chosen.withColumn("valid", F.when(F.col("n").isNull(), F.raise_error(F.lit("no usable calibration records"))).otherwise(F.col("valid")))
    realized = F.col("bad_true") / F.col("n")
    return chosen.select(
        "valid", F.lit(float(alpha)).alias("alpha"), F.lit(float(delta)).alias("delta"), F.lit(method).alias("method"), F.col("n").alias("n_calibration"), "n_certified",
        F.get("tau", F.lit(0)).alias("tau0"), F.get("tau", F.lit(1)).alias("tau1"), "bad", F.round("risk", 9).alias("empirical_risk"), F.round(realized, 9).alias("realized_risk"),
        F.round("p", 9).alias("p_value"), F.round(F.col("cost") / F.col("n"), 9).alias("expected_cost"), (F.col("valid") & (realized > alpha + 1e-9)).alias("nominal_only"),
    )


def baselines(records: DataFrame, tau: list[float]) -> DataFrame:
    """Always-cheapest, cascade and always-frontier: risk by truth, mean cost, n; cache hits and empty rows are skipped."""
    rows = records.where(~F.col("cache_hit") & (F.size("tiers") > 0))
    levels = F.array(*[F.lit(float(t)) for t in tau])
    last = F.size("tiers") - 1
    arms = {"always-cheapest": (F.lit(0), F.lit(0)), "cascade": (accepted_at(F.col("tiers"), levels), F.lit(0)), "always-frontier": (last, last)}
    each = F.array(*[F.struct(F.lit(name).alias("policy"), at.alias("at"), F.lit(name == "cascade").alias("sums")) for name, (at, _) in arms.items()])
    out = rows.select("tiers", F.explode(each).alias("a")).select("tiers", "a.*")
    cost = F.when(F.col("sums"), spend(F.col("tiers"), F.col("at"), cost_kind(records))).otherwise(F.get(F.col("tiers"), F.col("at"))["cost"])
    return out.groupBy("policy").agg(F.count_if(~truth(F.get(F.col("tiers"), F.col("at")))).alias("bad"), F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("n"))
