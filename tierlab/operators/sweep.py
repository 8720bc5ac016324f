"""Distribution-shift sweeps: what a policy's certificate is worth after part of the traffic is absorbed.

A cell is a pattern, an absorbed share rho, a shadow rate epsilon and a seed. Cells are a parameter table, and all of
them are drawn, replayed and certified in one grouped plan instead of a loop. Without a shadow draw (epsilon 0) the
certificate is that of the whole sample, as of a system that doesn't know its cache is warm; with one it is made from
the draw off what is left. Either is then deployed on what is left.

A record enters as a narrow row: its id, what a grid of thresholds can tell of it (policy.coded), and its tier-0 order. The two
sorted patterns are sorted once, whatever the shares; a drawn cell keeps the rows beyond one bound, the k-th draw,
found among the few rows near the place where it is expected. The pass that finds it also sums the rows beyond that
place, so a row is drawn once. Per cell only sums over the lattice of thresholds are shuffled.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import double_bits, hash_of, signed
from ..functions.stats import min_calibration_size
from ..staging import stage
from . import policy as P
from .ordering import digits_of, draw_bounds, expected, first_drawn, placed, seeded_permutation, seeded_prefix, stable_rank, upto_bound

PATTERNS = ("easy-first", "cheap-accept", "uniform")


def tier0(records: DataFrame) -> DataFrame:
    t = F.get(F.col("tiers"), F.lit(0))
    return records.withColumn("t0_right", F.coalesce(P.truth(t), F.lit(False))).withColumn("t0_score", F.coalesce(t["score"], F.lit(0.0)))


def draw(label: Column | str, id_col: str = "rec_idx", digits: int = 12) -> Column:
    """A number drawn for an id by a hash; each label is a draw of its own."""
    return F.conv(drawn_digits(label, id_col, digits), 16, 10).cast("long")


def drawn_digits(label: Column | str, id_col: str = "rec_idx", digits: int = 12) -> Column:
    """draw in hexadecimal digits: of one length, so they compare as their numbers, and cost less to make."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.substring(F.sha2(F.concat(label, F.col(id_col).cast("string")), 256), 1, digits)


def with_place(records: DataFrame, pattern: str, tau0: float, label: str = "draw-", digits: int = 3) -> DataFrame:
    """Each record's place in the order of a pattern: easy-first (right first), cheap-accept (served first), uniform (drawn)."""
    r = tier0(records)
    if pattern == "uniform":
        return stable_rank(r.withColumn("draw", draw(label, digits=digits)), {"draw": False}, "rec_idx", pattern).drop("draw")
    first = F.col("t0_right") if pattern == "easy-first" else F.col("t0_score") >= tau0
    return stable_rank(r.withColumn("first", first), {"first": True, "t0_score": True}, "rec_idx", pattern).drop("first")


def dropped(rho: Column, n: Column) -> Column:
    """How many of n records a cache of share rho absorbs: one at least is left."""
    return F.least(F.round(rho * n), n - 1).cast("long")


def residual(records: DataFrame, pattern: str, rho: float, tau0: float) -> DataFrame:
    """The records that are left of one cell; the draw of the uniform pattern has no seed."""
    if not 0 <= rho < 1:
        raise ValueError("rho has to be in [0, 1)")
    ranked = with_place(records, pattern, tau0)
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).where(F.col(f"`{pattern}`") >= dropped(F.lit(float(rho)), F.col("_n"))).drop("_n", pattern)


def shadow_draw(records: DataFrame, rate: float) -> DataFrame:
    """round(rate * n) records, one at least, drawn by a hash of the id alone."""
    ranked = with_place(records, "uniform", 0.0)
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).where(F.col("uniform") < F.greatest(F.lit(1), F.round(rate * F.col("_n")))).drop("_n", "uniform")


def seeded_residual(records: DataFrame, rho: float, seed: int) -> DataFrame:
    """The records that the uniform pattern leaves under a seed: those after the absorbed prefix of the seeded shuffle.

    The shuffle is that of bits.splitmix64 with the share's bits in the seed, in order of rec_idx, so a published seed gives
    the published records. place: the record's place in the shuffle.
    """
    return _seeded_left(records, rho, seed, records.count())


def _seeded_left(records: DataFrame, rho: float, seed: int, n: int) -> DataFrame:
    if not 0 <= rho < 1:
        raise ValueError("rho has to be in [0, 1)")
    key = F.lit(signed(seed ^ double_bits(rho))).cast("long")
    return seeded_permutation(records, key, [F.asc("rec_idx")], first=_absorbed(rho, n)).drop("source")


def _shadow_places(spark: SparkSession, n: int, epsilon: float, seed: int, pattern: str, rho: float) -> DataFrame:
    """source: the places of n rows that the seed's shadow draw takes."""
    key = signed(seed ^ double_bits(epsilon) ^ double_bits(rho) ^ hash_of(pattern))
    return seeded_prefix(spark, key, n, max(1, _nearest(epsilon * n)))


def seeded_shadow(residual: DataFrame, epsilon: float, seed: int, pattern: str, rho: float, order: str = "rec_idx") -> DataFrame:
    """The shadow draw off what is left, under a seed: a prefix of the seeded shuffle of the rows in `order`, one row at least; all rows from epsilon 1 on."""
    if epsilon >= 1:
        return residual
    rows = placed(residual, [F.asc(order)], "_ordinal")
    taken = _shadow_places(residual.sparkSession, rows.count(), epsilon, seed, pattern, rho)
    return rows.join(taken.withColumnRenamed("source", "_ordinal"), "_ordinal", "left_semi").drop("_ordinal")


def seeded_cell(records: DataFrame, rho: float, epsilon: float, seed: int) -> DataFrame:
    """seeded_residual with shadow: whether the seed's shadow draw off it, in order of place, takes the record.

    Places that are left have no gaps, so the shadow draw is made of their number alone and no record is sorted for it.
    """
    n = records.count()
    left, first = _seeded_left(records, rho, seed, n), _absorbed(rho, n)
    if epsilon >= 1:
        return left.withColumn("shadow", F.lit(True))
    taken = _shadow_places(records.sparkSession, n - first, epsilon, seed, "uniform", rho)
    taken = taken.select((F.col("source") + first).alias("place"), F.lit(True).alias("_taken"))
    return left.join(taken, "place", "left").withColumn("shadow", F.coalesce("_taken", F.lit(False))).drop("_taken")


def _nearest(x: float) -> int:
    """round as Spark's: of the shortest decimal form, halves up."""
    return int(Decimal(repr(x)).to_integral_value(ROUND_HALF_UP))


def _absorbed(rho: float, n: int) -> int:
    """dropped, of known numbers; 0 of none."""
    return max(0, min(_nearest(rho * n), n - 1))


def _rows(spark: SparkSession, rows: list[tuple], **types: str) -> DataFrame:
    """A small table of literals."""
    each = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, types.items())]) for row in rows]
    schema = ", ".join(f"{c}: {t}" for c, t in types.items())
    return spark.range(1).select(F.inline(F.array(*each).cast(f"array<struct<{schema}>>")))


def coded_base(records: DataFrame, arity: int, step: float = 0.1) -> DataFrame:
    """Staged narrow rows of records: rec_idx, the tier-0 order, and _x: what a grid tells of them (policy.coded)."""
    narrow = P.coded(tier0(records), arity, step, ["rec_idx", "t0_right", "t0_score"])
    tasks = records.sparkSession.sparkContext.defaultParallelism
    if narrow.rdd.getNumPartitions() < tasks:  # each row is drawn in every cell, so few small files are dealt over all cores
        narrow = narrow.repartition(tasks)
    packed = F.struct(*P.codes(arity), *P.outcomes(arity)).alias("_x")  # a column of its own, as rows are copied for each cell
    return stage(narrow.select("rec_idx", "t0_right", "t0_score", packed), "sweep-records")


def residuals(base: DataFrame, patterns: list[str], rhos: list[float], seeds: list[int], tau0: float, n: int) -> DataFrame | None:
    """Narrow rows (pattern, rho, seed, rec_idx, t0_right, _x) of the n records of coded_base left in every cell that isn't drawn; None without one.
    Sorted patterns are the same for all seeds and come once, with the first."""
    if not all(0 <= r < 1 for r in rhos) or not set(patterns) <= set(PATTERNS):
        raise ValueError("rho has to be in [0, 1), patterns are easy-first, cheap-accept and uniform")
    plain = [c for c in base.columns if c != "t0_score"]
    left = None
    for p in (p for p in patterns if p != "uniform"):
        first = F.col("t0_right") if p == "easy-first" else F.col("t0_score") >= tau0
        ranked = placed(base.withColumn("_first", first), [F.desc("_first"), F.desc("t0_score"), F.asc("rec_idx")], "_place")
        shares = F.array(*[F.struct(F.lit(float(r)).alias("rho"), F.lit(_absorbed(r, n)).cast("long").alias("after")) for r in rhos])
        kept = ranked.withColumn("c", F.explode(F.filter(shares, lambda c: F.col("_place") >= c["after"])))
        kept = kept.select(F.lit(p).alias("pattern"), "c.rho", F.lit(seeds[0]).cast("long").alias("seed"), *plain)
        left = kept if left is None else left.unionByName(kept)
    whole = [r for r in rhos if not _absorbed(r, n)]  # nothing is drawn in these
    if "uniform" in patterns and whole:
        kept = _uniform(base, whole, seeds).drop("label")
        left = kept if left is None else left.unionByName(kept)
    return left


def _uniform(base: DataFrame, rhos: list[float], seeds: list[int]) -> DataFrame:
    """All rows of base in each cell of the uniform pattern, with the label of its draw."""
    cell = lambda r, s: F.struct(F.lit(float(r)).alias("rho"), F.lit(s).cast("long").alias("seed"), F.lit(f"draw-{s}-{r}-").alias("label"))
    rows = base.select(F.lit("uniform").alias("pattern"), F.explode(F.array(*[cell(r, s) for r in rhos for s in seeds])).alias("c"), *[c for c in base.columns if c != "t0_score"])
    return rows.select("pattern", "c.rho", "c.seed", "c.label", *[c for c in base.columns if c != "t0_score"])


def drawn_profiles(base: DataFrame, rhos: list[float], seeds: list[int], n: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """Sums over codes of what the drawn cells (shares that absorb a record) leave, and bounds: cells, bound_draw (digits), bound_tie.

    In one pass rows that are surely absorbed are counted, those surely left summed by codes, and the few near the bound kept
    with their draws. Where a cell's bound isn't among these, the histograms of draw_bounds find all of them, and a second pass sums.
    """
    cells, codes = ["pattern", "rho", "seed"], P.codes(arity)
    sums = [F.sum(c).alias(c) for c in P.outcomes(arity)]
    rows = _uniform(base, rhos, seeds)
    wanted = _rows(base.sparkSession, [("uniform", float(r), s, _absorbed(r, n), n) for r in rhos for s in seeds], pattern="string", rho="double", seed="bigint", k="bigint", n="bigint")
    near = expected(wanted, 48).select(*cells, "k", digits_of(F.col("_low")).alias("_low"), digits_of(F.col("_high")).alias("_high"))
    zone = F.when(F.col("_h") < F.col("_low"), 0).when(F.col("_h") < F.col("_high"), 1).otherwise(2)
    met = rows.withColumn("_h", drawn_digits(F.col("label"))).join(F.broadcast(near), cells).select(*cells, "k", zone.alias("_z"), "_h", "rec_idx", "t0_right", "_x.*")
    close = lambda c, name: F.when(F.col("_z") == 1, F.col(c)).alias(name)
    kept_codes = [F.when(F.col("_z") > 0, F.col(c)).alias(c) for c in codes]
    held = stage(met.groupBy(*cells, "k", "_z", *kept_codes, close("_h", "_d"), close("rec_idx", "_t")).agg(*sums, F.count_if("t0_right").alias("right")), "drawn-profiles")
    run = Window.partitionBy(*cells).orderBy(F.asc_nulls_first("_d"), "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = held.where("_z < 2").withColumn("_upto", F.sum("_n").over(run)).where("_z = 1 and _upto = k")
    bounds = stage(upto.select(*cells, F.col("_d").alias("bound_draw"), F.col("_t").alias("bound_tie")), "bounds")
    if bounds.count() == len(rhos) * len(seeds):
        beyond = held.join(F.broadcast(bounds), cells).where((F.col("_z") == 2) | ((F.col("_z") == 1) & ~upto_bound("_d", "_t")))
        return beyond.groupBy(*cells, *codes).agg(*sums, F.sum("right").alias("right")), bounds
    found = draw_bounds(rows.withColumn("_draw", draw(F.col("label"))), cells, "_draw", "rec_idx", wanted)
    bounds = found.withColumn("bound_draw", digits_of(F.col("bound_draw")))
    return drawn_left(base, rhos, seeds, bounds).select(*cells, "t0_right", "_x.*").groupBy(*cells, *codes).agg(*sums, F.count_if("t0_right").alias("right")), bounds


def drawn_left(base: DataFrame, rhos: list[float], seeds: list[int], bounds: DataFrame) -> DataFrame:
    """The rows of residuals for the drawn cells, beyond their bounds."""
    rows = _uniform(base, rhos, seeds).withColumn("_h", drawn_digits(F.col("label"))).join(F.broadcast(bounds), ["pattern", "rho", "seed"], "left")  # every cell has a bound; a left join computes _h once
    return rows.where(~upto_bound("_h", "rec_idx")).drop("_h", "label", "bound_draw", "bound_tie")


def absorption_sweep(records: DataFrame, patterns: list[str], rhos: list[float], alpha: float, delta: float, tau: list[float], epsilons: list[float] | None = None, seeds: list[int] | None = None, step: float = 0.1) -> DataFrame:
    """A row for each pattern, rho, epsilon and seed: sizes, tier-0 accuracy before and after, certificate, deployed risk and its gap.

    calibrated_risk is what the certificate saw, deployed_risk the risk by truth of its thresholds on what is left;
    a gap over 0 is an optimistic certificate. underpowered: fewer calibration records than certify alpha without an
    error. With under two records left or drawn no certificate is tried: valid is false, risks are null.
    """
    epsilons, seeds, arity = epsilons or [0.0], seeds or [0], len(tau)
    cell, shadow_cell = ["pattern", "rho", "seed"], ["pattern", "rho", "seed", "epsilon"]
    spark, base = records.sparkSession, coded_base(P.usable(records), arity, step)
    n = base.count()
    left, drawn = residuals(base, patterns, rhos, seeds, tau[0], n), [r for r in rhos if "uniform" in patterns and _absorbed(r, n)]
    sums = [F.sum(c).alias(c) for c in P.outcomes(arity)]
    profiles = None if left is None else left.select(*cell, "t0_right", "_x.*").groupBy(*cell, *P.codes(arity)).agg(*sums, F.count_if("t0_right").alias("right"))
    if drawn:
        summed, bounds = drawn_profiles(base, drawn, seeds, n, arity)
        profiles = summed if profiles is None else profiles.unionByName(summed)
    profiles = stage(profiles, "residual-profiles")
    facts = profiles.groupBy(*cell).agg(F.sum("_n").alias("n_residual"), (F.sum("right") / F.sum("_n")).alias("accuracy"))
    whole = base.agg(F.count(F.lit(1)).alias("n_use"), F.avg(F.col("t0_right").cast("int")).alias("accuracy_d"))
    deployed = P.grid_risk(profiles.drop("right"), arity, step, cell).select(*cell, "grid_idx", (F.col("bad_true") / F.col("n")).alias("deployed"))
    figures = ["valid", "n_certified", "grid_idx", "tau", F.col("n").alias("n_calibration"), F.col("risk").alias("calibrated")]
    certificates = None
    if 0.0 in epsilons or not n:  # of no records there is nothing to draw, and facts holds no cell
        full = P.select_threshold(P.fixed_sequence(P.grid_risk(P.score_profiles(base.select("_x.*"), arity, step), arity, step), alpha, delta)).select(*figures)
        certificates = facts.select(*cell, F.lit(0.0).alias("epsilon")).crossJoin(F.broadcast(full))
    rates = [float(e) for e in epsilons if e > 0]
    if rates and n:
        if drawn:
            beyond = drawn_left(base, drawn, seeds, bounds)
            left = beyond if left is None else left.unionByName(beyond)
        rows = left.drop("t0_right").withColumn("epsilon", F.explode(F.array(*map(F.lit, rates))))
        label = F.concat(F.lit("shadow-"), F.col("seed").cast("string"), F.lit("-"), F.col("rho").cast("string"), F.lit("-"), F.col("epsilon").cast("string"), F.lit("-"), F.col("pattern"), F.lit("-"))
        made = [(p, float(r), s, n - _absorbed(r, n)) for p in patterns for r in rhos for s in (seeds if p == "uniform" else seeds[:1])]
        wanted = [(*c, e, m if e >= 1 else max(1, _nearest(e * m)), m) for *c, m in made for e in rates]
        wanted = _rows(spark, wanted, pattern="string", rho="double", seed="bigint", epsilon="double", k="bigint", n="bigint")
        shadows = first_drawn(rows.withColumn("_draw", draw(label)), shadow_cell, "_draw", "rec_idx", wanted)
        tested = P.fixed_sequence(P.grid_risk(P.score_profiles(shadows.select(*shadow_cell, "_x.*"), arity, step, shadow_cell), arity, step, shadow_cell), alpha, delta, shadow_cell)
        shadow = P.select_threshold(tested, shadow_cell).select(*shadow_cell, *figures)
        certificates = shadow if certificates is None else certificates.unionByName(shadow)
    needed = min_calibration_size(alpha, delta)
    tried = (F.col("n_residual") >= 2) & (F.col("n_calibration") >= 2)
    under = F.col("n_calibration") < needed
    gap = F.col("deployed") - F.col("calibrated")
    note = F.when(~tried, "too few records: no certificate tried").when(under, F.format_string("calibrated on %d records, at least %d are needed", "n_calibration", needed)).otherwise("")
    out = certificates.join(deployed, [*cell, "grid_idx"], "left").join(facts, cell).crossJoin(F.broadcast(whole))
    when_tried = lambda x: F.when(tried, x)
    return out.select(
        *cell, "epsilon", "n_residual", F.when(F.col("epsilon") > 0, F.col("n_calibration")).otherwise(0).alias("n_shadow"), "n_calibration",
        F.round("accuracy_d", 9).alias("tier0_accuracy_d"), F.round("accuracy", 9).alias("tier0_accuracy"), (tried & F.col("valid")).alias("certified"), F.when(tried, F.col("n_certified")).otherwise(0).alias("n_certified"),
        when_tried(F.get("tau", F.lit(0))).alias("tau0"), when_tried(F.get("tau", F.lit(1))).alias("tau1"), when_tried(F.round("calibrated", 9)).alias("calibrated_risk"),
        when_tried(F.round("deployed", 9)).alias("deployed_risk"), when_tried(F.round(gap, 9)).alias("risk_gap"), under.alias("underpowered"), note.alias("note"),
    )


def null_envelope(records: DataFrame, rhos: list[float], alpha: float, delta: float, tau: list[float], seeds: list[int]) -> DataFrame:
    """The spread of the uniform pattern's gap over seeds and shares above 0: n_draws, max_abs_gap, mean_abs_gap and where the largest is.

    Rows that are underpowered or not certified don't count. Ties of the largest: the first seed, then the first share.
    """
    s = absorption_sweep(records, ["uniform"], [r for r in rhos if r > 0], alpha, delta, tau, [0.0], seeds).where("certified and not underpowered")
    size = F.abs("risk_gap")
    first = F.max_by(F.struct("rho", "seed"), F.struct(size, -F.col("seed"), -F.col("rho")))
    out = s.agg(F.count(F.lit(1)).alias("n_draws"), F.coalesce(F.max(size), F.lit(0.0)).alias("max_abs_gap"), F.round(F.coalesce(F.avg(size), F.lit(0.0)), 9).alias("mean_abs_gap"), first.alias("at"))
    return out.select("n_draws", "max_abs_gap", "mean_abs_gap", F.col("at.rho").alias("max_at_rho"), F.col("at.seed").alias("max_at_seed"))


def significant(sweep: DataFrame, envelope: DataFrame) -> DataFrame:
    """sweep's rows of selective patterns with the envelope and significant: certified with enough records, and a gap beyond the largest null gap."""
    top = envelope.select("n_draws", F.col("max_abs_gap").alias("envelope"))
    rows = sweep.where("pattern <> 'uniform'").crossJoin(F.broadcast(top))
    beyond = (F.col("n_draws") > 0) & F.col("certified") & ~F.col("underpowered") & (F.abs("risk_gap") > F.col("envelope"))
    return rows.withColumn("significant", F.coalesce(beyond, F.lit(False)))
