"""Places in a sorted order without a task over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df, staged, with `name`: the 0-based place of each row in the order (rows equal in it: any order among them).

    Rows are dealt by ranges of the order and sorted in them, one shuffle; a row's place is its number in its partition
    and the rows of the partitions before, of which there is one count each (a small table, whatever the data's size).
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = stage(spread, f"placed-{name}").withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, place.cast("long")).drop("_part", "_at", "_before")


def stable_rank(df: DataFrame, order: dict[str, bool], id_col: str, name: str) -> DataFrame:
    """0-based place of each row in the order of `order` (column -> descending), then id_col ascending (unique)."""
    return placed(df, [F.desc(c) if down else F.asc(c) for c, down in order.items()] + [F.asc(id_col)], name)


def running_counts(counts: DataFrame, by: list[str], value: str, count: str) -> DataFrame:
    """Staged counts (a row a group and value) with upto and first: the sum of `count` up to and with the row, and before its group, in order of group and value.

    Rows are dealt by ranges of group and value; running sums run inside a range and over the ranges' totals.
    """
    ranges = stage(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "value-counts")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_part").agg(F.sum(count).alias("_m")).select("_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))  # a row a range
    run = Window.partitionBy("_part").orderBy(*by, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = ranges.withColumn("_upto", F.sum(count).over(run)).join(F.broadcast(totals), "_part").withColumn("upto", F.col("_before") + F.col("_upto")).drop("_part", "_before", "_upto")
    if not by:
        return cum.withColumn("first", F.lit(0).cast("long"))
    groups = cum.groupBy(*by).agg(F.min(F.col("upto") - F.col(count)).alias("first"))
    return cum.join(groups, by)


def value_at(df: DataFrame, value: str, places: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """n and the values at 0-based places of the sorted column, in each group of `by`; places may use n. Nulls have no place."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cum = running_counts(counts, by, "v", "c")
    groups = cum.groupBy(*by).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    in_group = cum.join(groups, by) if by else cum.crossJoin(F.broadcast(groups))
    at = lambda place: F.min(F.when(F.col("upto") - F.col("first") > place, F.col("v")))
    out = in_group.groupBy(*by).agg(*[at(place).alias(k) for k, place in places.items()])
    return groups.select(*by, "n").join(out, by) if by else groups.select("n").crossJoin(out)


def quantile(df: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """n and quantile: interpolated between the two nearest places, exactly and without a buffer of all values."""
    by = by or []
    h = (F.col("n") - 1) * F.lit(float(q))
    found = value_at(df, value, {"low": F.floor(h), "high": F.ceil(h)}, by)
    return found.select(*by, "n", (F.col("low") + (F.col("high") - F.col("low")) * (h - F.floor(h))).alias("quantile"))


def smallest(rows: DataFrame, cells: list[str], draw: str, tie: str, wanted: DataFrame, total: int, bits: int = 48) -> DataFrame:
    """Staged: cells, bound_draw, bound_tie: in each cell exactly k rows have (draw, tie) <= (bound_draw, bound_tie).

    wanted: a small table (cells, k), k from 1 to the rows of the cell. draw: a long below 2**bits, spread evenly; tie is unique in
    a cell. The k-th row is found by histograms of the draw's leading bits, 4,096 bins a cell and round, and each round looks
    into the one bin that holds it; no row is shuffled or sorted, but for the few of the last bin. rows is computed once a round:
    once up to some millions of rows (`total`), twice up to 16 billion.
    """
    from pyspark.sql import Window

    at = wanted.select(*cells, F.col("k").alias("_k"), F.lit(0).cast("long").alias("_prefix"))
    narrow, shift = rows.select(*cells, draw, tie), bits
    while total > 4096 and shift > 12:
        known, shift = shift, shift - 12
        inside = narrow.join(F.broadcast(at), cells).where(F.shiftright(draw, known) == F.col("_prefix")) if known < bits else narrow.join(F.broadcast(at), cells)
        bins = inside.groupBy(*cells, "_k", F.shiftright(draw, shift).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
        run = Window.partitionBy(*cells).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = bins.withColumn("_upto", F.sum("_n").over(run)).where(F.col("_upto") >= F.col("_k"))
        found = first.groupBy(*cells).agg(F.min(F.struct("_bin", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("k"))).alias("x"))
        at = stage(found.select(*cells, F.col("x.k").alias("_k"), F.col("x._bin").alias("_prefix")), "selection")
        total //= 1024
    last = narrow.join(F.broadcast(at), cells)
    last = last.where(F.shiftright(draw, shift) == F.col("_prefix")) if shift < bits else last
    place = F.row_number().over(Window.partitionBy(*cells).orderBy(draw, tie))
    kth = last.withColumn("_place", place).where(F.col("_place") == F.col("_k"))
    return stage(kth.select(*cells, F.col(draw).alias("bound_draw"), F.col(tie).alias("bound_tie")), "bounds")


def expected(wanted: DataFrame, bits: int) -> DataFrame:
    """wanted (cells, k, n) with _low and _high: draws between which the k-th of n even ones lies, with eight standard deviations to spare."""
    share, span = F.col("k") / F.col("n"), float(1 << bits)
    spare = (8 * F.sqrt(F.col("k") * (1 - share)) + 64) / F.col("n")
    return wanted.select("*", F.floor(F.greatest(F.lit(0.0), share - spare) * span).alias("_low"), F.ceil(F.least(F.lit(1.0), share + spare) * span).alias("_high"))


def _under(draw: str) -> Column:
    """draw < _high; from the plain comparison a test of draw for null would follow, and the draw would be computed for it too."""
    return F.coalesce(F.col(draw) < F.col("_high"), F.lit(False))


def draw_bounds(rows: DataFrame, cells: list[str], draw: str, tie: str, wanted: DataFrame, bits: int = 48) -> DataFrame:
    """As smallest, for draws that should be spread evenly; wanted is a small table (cells, k, n) with the rows of each cell.

    The k-th draw lies in a narrow range then: rows below it are counted and those in it (some 16 times the root of k a cell)
    ranked, so rows is computed once. Where a cell's bound isn't there after all, the histograms of `smallest` find all of them.
    """
    met = rows.select(*cells, draw, tie).join(F.broadcast(expected(wanted, bits)), cells).where(_under(draw))
    inside = F.col(draw) >= F.col("_low")
    counted = met.groupBy(*cells, "k", F.when(inside, F.col(draw)).alias("_d"), F.when(inside, F.col(tie)).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*cells).orderBy(F.asc_nulls_first("_d"), "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("_upto", F.sum("_n").over(run))
    bounds = stage(upto.where((F.col("_upto") == F.col("k")) & F.col("_d").isNotNull()).select(*cells, F.col("_d").alias("bound_draw"), F.col("_t").alias("bound_tie")), "bounds")
    if bounds.count() == wanted.count():
        return bounds
    most = wanted.agg(F.max("n").alias("n")).first()["n"] or 0
    return smallest(rows, cells, draw, tie, wanted.select(*cells, "k"), most, bits)


def upto_bound(draw: str, tie: str) -> Column:
    """Whether a row joined with its cell's bound is one of its first k; false without a bound."""
    at = (F.col(draw) < F.col("bound_draw")) | ((F.col(draw) == F.col("bound_draw")) & (F.col(tie) <= F.col("bound_tie")))
    return F.coalesce(at, F.lit(False))


def digits_of(number: Column) -> Column:
    """A number from 0 to 2**48 as twelve lower-case hexadecimal digits, which sort as numbers do; 2**48 sorts after all others."""
    return F.when(number < 1 << 48, F.lpad(F.lower(F.hex(number)), 12, "0")).otherwise("g")


def first_drawn(rows: DataFrame, cells: list[str], draw: str, tie: str, wanted: DataFrame, bits: int = 48) -> DataFrame:
    """The k rows of each cell of wanted (cells, k, n) with the least (draw, tie).

    Rows that an even draw can't put among them are left out at once, and the others staged; if a cell then holds fewer than
    k, all rows of the cells are staged instead.
    """
    near = F.broadcast(expected(wanted, bits).select(*cells, "_high"))
    held = stage(rows.join(near, cells).where(_under(draw)).drop("_high"), "drawn")
    sizes = held.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    short = wanted.join(sizes, cells, "left").where(F.coalesce("_n", F.lit(0)) < F.col("k"))
    if not short.isEmpty():
        held = stage(rows.join(F.broadcast(wanted.select(*cells)), cells), "drawn")
    bounds = draw_bounds(held, cells, draw, tie, wanted, bits)
    return held.join(F.broadcast(bounds), cells).where(upto_bound(draw, tie)).drop("bound_draw", "bound_tie")


#: Rounds in which paths of steps go on by one link; about half of them end in each. What is left after them jumps.
HOPS = 6


def settled(steps: DataFrame, first: int = 0, upto: int | None = None) -> DataFrame:
    """_place and _source: what lies at a step's place after it, as its place before all steps.

    steps (step, drawn): from the largest down each step swaps what lies at its own place and at `drawn`, a place at or below
    it. No step is below `first`; only places below `upto` are wanted.

    What a step finds at the place it drew was put there by the next larger step that drew it; else it lay there from the start.
    What lies at a step's own place was put there by the smallest larger step that drew that. So a step is linked from one
    place or one asking step and links lie on disjoint paths upwards, whose ends are wanted. Each link is used by one path, once: in a
    round paths go on by a link, and those that ended and the links used leave, so all rounds together move a few rows a step.
    Long paths, rare in a shuffle, are resolved by pointer jumping in a logarithm of rounds.
    """
    run, step, drawn = Window.partitionBy("drawn").orderBy("step"), F.col("step"), F.col("drawn")
    before = F.lag("step").over(run)
    asked = F.when(before.isNotNull(), F.bitwise_not(before)).when(step != drawn, drawn)  # an asking step as its complement, below 0
    linked = stage(steps.select("step", asked.alias("from"), F.when(F.lead("step").over(run).isNull(), drawn).alias("end")), "permutation-steps")
    wanted = lambda place: F.lit(True) if upto is None else place < upto
    found = linked.where(F.col("end").isNotNull() & wanted(step)).select(step.alias("_place"), F.col("end").alias("_source"))
    ended = lambda paths: paths.select(F.bitwise_not("head").alias("_place"), F.col("at").alias("_source"))
    head = F.when((F.col("from") < 0) & wanted(F.bitwise_not("from")), F.col("from"))  # null: nobody asks for this path
    paths = linked.where(F.col("from") < first).select(head.alias("head"), step.alias("tail"))
    links = linked.where(F.col("from") >= first).select("from", step.alias("to"))
    for _ in range(HOPS):
        state = F.when(F.col("tail").isNull(), "link").when(F.col("from").isNull(), "ended").otherwise("path")
        met = paths.join(links, F.col("tail") == F.col("from"), "full").select(F.coalesce("head", F.when(F.col("tail").isNull(), F.col("from"))).alias("head"), F.coalesce("to", "tail").alias("at"), state.alias("state"))
        met = stage(met.where("head is not null or state = 'path'"), "permutation-paths")
        found = found.unionByName(ended(met.where("state = 'ended'")))
        paths = met.where("state = 'path'").select("head", F.col("at").alias("tail"))
        links = met.where("state = 'link'").select(F.col("head").alias("from"), F.col("at").alias("to"))
        if paths.isEmpty():
            return found
    at = paths.where("head is not null").select("head", F.col("tail").alias("at")).unionByName(links.select(F.col("from").alias("head"), F.col("to").alias("at")))
    while True:
        jump = at.where("head >= 0").select(F.col("head").alias("at"), F.col("at").alias("further"))
        after = stage(at.join(jump, "at", "left").select("head", F.coalesce("further", "at").alias("at"), F.col("further").isNotNull().alias("moved")), "permutation-paths")
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            return found.unionByName(ended(at.where("head < 0")))


def seeded_permutation(df: DataFrame, seed: Column, order: list[Column], by: list[str] | None = None, name: str = "place", first: int = 0) -> DataFrame:
    """df's rows with `name`: the 0-based place that a seeded shuffle gives each row of its group; `source`: its place before.

    The shuffle is the sequential one (from the last place down to the second, each swaps with a place drawn below or at it)
    with splitmix64 numbers, to the last row, but no task goes through it in sequence. Step i swaps places i and j(i); all
    numbers j(i) are known at once, as the generator counts, and `settled` resolves them.

    seed: a long by group (its bits count as unsigned); order: decides all ties. Null groups are a group. first (without
    groups): only rows that get this place or a later one are returned, and steps below it aren't taken.
    """
    from ..functions.bits import remainder, seeded_number

    by = by or []
    if by and first:
        raise ValueError("first holds for a single group")
    cells = [f"_by{i}" for i in range(len(by))]
    keyed = df.withColumns({c: F.coalesce(F.concat(F.lit("="), F.col(b).cast("string")), F.lit("")) for c, b in zip(cells, by)}).withColumn("_seed", seed)
    ranked = placed(keyed, [*[F.asc(c) for c in cells], *order], "_ordinal")
    if cells:
        sizes = stage(ranked.groupBy(*cells).agg(F.min("_ordinal").alias("_first"), F.count(F.lit(1)).alias("_n")), "group-sizes")
        ranked = stage(ranked.join(sizes, cells), "permutation-rows")
    else:
        ranked = ranked.withColumns({"_first": F.lit(0).cast("long"), "_n": F.lit(ranked.count()).cast("long")})
    i, n = F.col("_ordinal") - F.col("_first"), F.col("_n")
    drawn = F.when(i > 0, remainder(seeded_number(F.col("_seed"), n - i), i + 1)).otherwise(0).cast("long")  # the first step is at place n - 1
    steps = ranked.where(F.col("_ordinal") >= first).select(F.col("_ordinal").alias("step"), (F.col("_first") + drawn).alias("drawn"))  # groups lie one after the other
    out = ranked.join(settled(steps, first).withColumnRenamed("_source", "_ordinal"), "_ordinal")
    return out.withColumns({"source": i, name: F.col("_place") - F.col("_first")}).drop(*cells, "_seed", "_ordinal", "_first", "_n", "_place")


def seeded_prefix(spark: SparkSession, seed: int, n: int, k: int) -> DataFrame:
    """source: which of n places (0-based) the seeded shuffle puts in the first k, in any order; all for k from n on.

    Steps below k only swap these among each other, so they aren't taken.
    """
    from ..functions.bits import remainder, seeded_number

    step = F.col("id")
    drawn = F.when(step >= k, remainder(seeded_number(F.lit(seed), F.lit(n).cast("long") - step), step + 1)).otherwise(step)
    return settled(spark.range(n).select(step.alias("step"), drawn.alias("drawn")), upto=k).select(F.col("_source").alias("source"))
