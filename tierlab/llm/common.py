"""What the operators of this subpackage share: staging, reading columns, Arrow mapping and distributed ranks."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.binding import let  # noqa: F401  for the operators here
from ..operators.ordering import placed  # noqa: F401
from ..staging import delete, shared_dir, stage, unstage  # noqa: F401


def salted_join(left: DataFrame, right: DataFrame, key: str, weights: DataFrame, spread: list[Column | str], how: str = "inner", least: int = 100_000) -> DataFrame:
    """left join right (one row a key at most) by key, for `how` inner, left_semi or left_anti; a hot key's rows are dealt over many tasks.

    weights: staged, key and n, the rows of left by key. A key is hot from `least` rows and a 10,000th of all rows on,
    so there are under 10,000 hot keys, whatever the data; only they and their numbers of parts are broadcast. A hot key
    has a copy of its right row in each part; left rows go to a part by a hash of `spread`.
    """
    facts = weights.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    share = max(least, facts["n"] // 10_000)
    if facts["most"] <= share:
        return left.join(right, key, how)
    hot = weights.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_parts"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copies = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def text_slices(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about most_bytes (one row at least): long texts stay bounded in memory."""
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, most_bytes // per_row)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """What make() gives, kept by a Python worker over its tasks until another key is asked for.

    Workers outlive stages: tables and memos of several operators would add up in them.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def global_rank(df: DataFrame, order: list[Column], bucket: Column, name: str, within: list[str] | None = None) -> DataFrame:
    """Add a 1-based rank of each row in the order (bucket, *order), in each group of `within`, with no task over a whole group.

    bucket: an integer that never falls as the order rises, and is spread evenly over the rows; windows run in a
    bucket, and the rows in the buckets before it come from a small table of counts (one row for each group and bucket).
    df must be staged: it is read twice, and both readings have to see the same rows.
    """
    from pyspark.sql import Window

    within = within or []
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order)))
    on = F.col("_bucket") == F.col("_b")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    return ranked.join(offsets, on).withColumn(name, (F.col("_before") + F.col("_rn")).cast("long")).drop("_bucket", "_rn", "_b", "_before", *[f"_w_{c}" for c in within])
