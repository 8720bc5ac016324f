"""Sharding by proportional stratified interleaving: every shard gets the corpus's mixture of sources.

Rows are shuffled by a seeded hash inside each source and ranked; rank r of n becomes the fraction (r - 1/2) / n, all
rows are sorted by their fraction, and the sorted rows are cut into shards of equal count. Any stretch of the order
then holds each source in proportion. Both orders are dealt over the cluster by ranges of all that decides them, so
neither a source with a third of all rows nor very many sources of one row each fall into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, salted_join, stage


def interleave(df: DataFrame, shards: int = 8, seed: int = 7, key: str = "doc_id", source: str = "source") -> DataFrame:
    """df's columns with shard (0..shards-1) and slot (from 0, gapless in the shard); shard counts differ by one at most.

    df has to be narrow (ids and what goes with them): its rows are shuffled three times. Null sources are one source.
    Rows are shuffled by a hash of key and other columns; fully equal rows are interchangeable. Empty table: no rows.
    Columns named shard or slot are replaced. Law `rows` holds; equal texts are spread like any other rows.
    """
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = df.select(*cols, name.alias("_src"), F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(*cols)).alias("_h"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # fully equal rows are dealt over tasks too
    ranked = placed(rows, [F.asc("_src"), F.asc("_h"), F.asc("_row")], "_place")
    sizes = stage(ranked.groupBy("_src").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("n")), "source-sizes")
    ranked = salted_join(ranked, sizes.withColumnRenamed("n", "_n"), "_src", sizes.select("_src", "n"), ["_h"])
    fraction = (F.col("_place") - F.col("_first") + F.lit(0.5)) / F.col("_n")
    mixed = F.xxhash64(F.lit(seed + 1), "_src", "_h")  # of rows with one fraction
    in_order = placed(ranked.withColumn("_f", fraction).withColumn("_mixed", mixed), [F.asc("_f"), F.asc("_mixed"), F.asc("_src"), F.asc("_h"), F.asc("_row")], "_pos")
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shard = F.expr(f"cast(_pos * {shards} div {max(n, 1)} as int)")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return in_order.withColumn("shard", shard).withColumn("slot", (F.col("_pos") - first).cast("long")).select(*cols, "shard", "slot")
