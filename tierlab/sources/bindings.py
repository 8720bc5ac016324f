"""Relations of the domain derived from the driver's tables; each has a twin in SQL (plans/sql.py)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import wilson_lcb


@dataclass(frozen=True)
class Tier:
    name: str
    samples: int
    in_price: int
    out_price: int


#: Tiers from cheapest to dearest.
TIERS = (Tier("small", 5, 1, 5), Tier("mid", 2, 3, 15), Tier("large", 1, 5, 25))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed(a: int, b: int, by: float, most: int, key: Column, k: int) -> Column:
    """A well-mixed integer in 0..most-1: plain linear hashes would share factors with the flags."""
    return F.floor((key * a + k * b).cast("double") / by).cast("long") % most


def tier_obs(key: Column, k: int, salt: int = 0) -> Column:
    t = TIERS[k]
    agree = mixed(7919 + salt, 104729, 13.0, t.samples + 1, key, k)
    correct = mixed(15487 + salt, 32453, 17.0, 20, key, k) < 13 + 3 * k + F.when(agree == t.samples, 3).otherwise(0)
    truth = F.when(key % 13 == 0, F.lit(None)).when((key * 5 + k) % 29 == 0, ~correct).otherwise(correct)
    return F.struct(
        F.lit(t.name).alias("tier"), wilson_lcb(agree, F.lit(t.samples)).alias("score"), correct.alias("correct"), truth.alias("true_correct"),
        F.lit(t.samples * t.out_price).cast("long").alias("cost"), ((key + k) % 53 == 0).alias("timed_out"),
    )


def records(spark: SparkSession, sf_dir: str, salt: int = 0) -> DataFrame:
    """One row for each problem, with its tiers in order; costs are whole units."""
    return records_of(table(spark, sf_dir, "orders"), salt)


def records_of(orders: DataFrame, salt: int = 0) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("rec_idx"), F.array(*[tier_obs(key, k, salt) for k in range(len(TIERS))]).alias("tiers"),
        (key % 97 == 0).alias("contaminated"), (key % 89 == 0).alias("oracle_unsound"), (key % 83 == 0).alias("oracle_inconclusive"),
        (key % 5 < 2).alias("shadow"), (key % 41 == 0).alias("cache_hit"), (key % 3 != 0).alias("cache_correct"), F.lit(0).cast("long").alias("cache_cost"),
    )


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t.name, t.samples, t.in_price, t.out_price) for k, t in enumerate(TIERS)], "k int, tier string, samples int, in_price int, out_price int")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate programs of a problem, from events: behaviour by type, size by props, verified unless an error."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("problem_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("behaviour"), (F.col("event_type") != "error").alias("verified"),
        F.octet_length("props").cast("long").alias("bytes"), (F.col("event_id") % 11).cast("long").alias("complexity"), F.concat(F.col("event_type"), F.lit("  \n"), F.col("props")).alias("source"),
    )


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
