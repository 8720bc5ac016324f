"""Behavioural clusters of candidate programs: grouping, ranking, representatives, scores and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson_lcb
from ..staging import stage

#: Fixed value: the size of a candidate without static figures.
UNKNOWN_SIZE = 1 << 29


def clusters(candidates: DataFrame, key: str = "behaviour") -> DataFrame:
    """One row for each problem and behaviour: size, total, mass, verified, representative (smallest, then first)."""
    size = F.coalesce(F.expr("complexity * 1000 + bytes div 100"), F.lit(UNKNOWN_SIZE))
    g = candidates.groupBy("problem_id", key).agg(
        F.count(F.lit(1)).alias("size"), F.bool_and("verified").alias("verified"), F.min_by("idx", F.struct(size.alias("s"), F.col("idx").alias("i"))).alias("representative"), F.min("idx").alias("first")
    )
    total = F.sum("size").over(Window.partitionBy("problem_id"))
    return g.withColumn("total", total).withColumn("mass", F.col("size") / F.col("total"))


def ranked(clusters: DataFrame, key: str = "behaviour") -> DataFrame:
    """Verified first, then larger, then by key."""
    order = Window.partitionBy("problem_id").orderBy(F.desc("verified"), F.desc("size"), F.asc(key))
    return clusters.withColumn("place", F.row_number().over(order).cast("long"))


def routing_score(clusters: DataFrame, key: str = "behaviour") -> DataFrame:
    """Wilson bound of the leading verified cluster over all candidates, refuted ones included; 0 without one."""
    top = ranked(clusters, key).where("place = 1")
    return top.select("problem_id", F.when(F.col("verified"), wilson_lcb(F.col("size"), F.col("total"))).otherwise(0.0).alias("score"), F.when(F.col("verified"), F.col("representative")).alias("representative"))


def text_vote(candidates: DataFrame, key) -> DataFrame:
    """Plurality of text keys; ties go to the earliest candidate."""
    g = candidates.withColumn("_key", key).groupBy("problem_id", "_key").agg(F.count(F.lit(1)).alias("votes"), F.min("idx").alias("winner"))
    total = F.sum("votes").over(Window.partitionBy("problem_id"))
    w = g.withColumn("mass", F.col("votes") / total)
    best = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.desc("votes"), "winner"))
    return w.withColumn("_p", best).where("_p = 1").select("problem_id", "winner", "votes", "mass")


def transfer_groups(rows: DataFrame, signature: str, key: str) -> DataFrame:
    """signature, members, transfers (ordered pairs), first of each signature that at least two rows share; the pairs aren't made."""
    g = rows.groupBy(signature).agg(F.count(F.lit(1)).alias("members"), F.min(key).alias("first")).where("members > 1")
    return g.select(signature, "members", (F.col("members") * (F.col("members") - 1)).alias("transfers"), "first")


def transfers(rows: DataFrame, signature: str, key: str, side: int = 1000) -> DataFrame:
    """donor, recipient: all ordered pairs of different keys with one signature; keys and signatures that are null make none.

    The work is the pairs, not the rows, so they are dealt: a signature's donors and recipients lie in blocks of about `side`
    rows, each two blocks meet in a cell of their own, and there is a task for about side ** 2 pairs, whatever the bytes of its input.
    """
    spark, r = rows.sparkSession, rows.select(F.col(signature).alias("_sig"), F.col(key).alias("_key")).where("_sig is not null and _key is not null")
    sizes = stage(r.groupBy("_sig").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "signature-sizes")
    pairs = sizes.agg(F.coalesce(F.sum(F.col("_n") * F.col("_n")), F.lit(0)).alias("n")).first()["n"]
    tasks = min(max(spark.sparkContext.defaultParallelism, -(-pairs // side**2)), 20_000)
    blocks = F.ceil(F.col("_n") / side).cast("int")
    own, each = F.pmod(F.xxhash64("_key"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    shared = r.join(sizes, "_sig")
    donors = shared.select("_sig", F.col("_key").alias("donor"), own.alias("_i"), each.alias("_j")).repartition(tasks, "_sig", "_i", "_j")
    recipients = shared.select("_sig", F.col("_key").alias("recipient"), each.alias("_i"), own.alias("_j")).repartition(tasks, "_sig", "_i", "_j")
    return donors.join(recipients, ["_sig", "_i", "_j"]).where("donor <> recipient").select("donor", "recipient")
