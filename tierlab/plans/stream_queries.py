"""Queries that run a table through Structured Streaming; their twins are the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import policy as P
from ..sources import bindings as B
from ..staging import shared_dir
from ..streaming import observe as V
from . import sql as S
from .registry import query

TAU = [0.4, 0.3]


@query(f"{S.replay(*TAU)} select accepted_at, cast(count(*) as bigint) as n, cast(count(*) filter (not true_correct) as bigint) as bad, cast(sum(cost) as bigint) as cost from rep group by 1")
def stream_risk(spark, sf):
    """The running risk of a policy, after all records have come."""
    return V.to_table(V.running_risk(B.records_of(B.stream(spark, sf, "orders")), TAU), "stream-risk", "complete")


@query("select o_orderkey as id from orders where cast('0x' || substr(sha256(cast(o_orderkey as varchar)), 1, 6) as bigint) / 16777216.0::double < 0.25::double")
def stream_shadow(spark, sf):
    """A quarter of the stream is routed past the cache."""
    return V.to_table(V.shadow_stream(B.stream(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), 0.25, "id"), "stream-shadow")


@query("select user_id as problem, min(event_id) as seq, 'h' || (event_id % 50) as hash from events group by 1, 3")
def stream_failures(spark, sf):
    """New failures of each problem; fewer distinct ones than a memory holds, so each comes once."""
    rows = B.stream(spark, sf, "events").select(F.col("user_id").alias("problem"), F.col("event_id").alias("seq"), F.concat(F.lit("h"), (F.col("event_id") % 50).cast("string")).alias("hash"))
    return V.to_table(V.failure_memory(rows), "stream-failures")


@query("""with recursive e as (
    select user_id % 12 as problem, event_id as seq, 'h' || (event_id * 7919 % 97) as hash, row_number() over (partition by user_id % 12 order by event_id) as n from events
), st(problem, n, seq, hash, fresh, memory) as (
    select problem, n, seq, hash, true, [hash] from e where n = 1
    union all
    select e.problem, e.n, e.seq, e.hash, not list_contains(memory, e.hash), case when list_contains(memory, e.hash) then memory else list_append(memory, e.hash)[-64:] end
    from st join e on e.problem = st.problem and e.n = st.n + 1
)
select problem, seq, hash from st where fresh""")
def stream_failures_bounded(spark, sf):
    """More distinct failures than a memory holds: the oldest fall out, and are news when they come again."""
    rows = B.stream(spark, sf, "events").select((F.col("user_id") % 12).alias("problem"), F.col("event_id").alias("seq"), F.concat(F.lit("h"), (F.col("event_id") * 7919 % 97).cast("string")).alias("hash"))
    return V.to_table(V.failure_memory(rows), "stream-failures-bounded")


def _grams() -> str:
    from .text_queries import _BB

    return _BB.format(l="bench", r="bench", on="and a.id > b.id")


@query(_grams() + ", m as (select item_id, coalesce(max(sim), 0.0) as best from benchmark left join sims on a = item_id group by item_id) select item_id, round(best, 9) as best from m")
def stream_warm_cache(spark, sf):
    """Each item's best similarity to those before it, as the cache fills."""
    at = f"{shared_dir(spark)}/warm-cache-{uuid.uuid4().hex}"
    items = B.stream(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    V.warm_cache(items, at).awaitTermination()
    return spark.read.parquet(f"{at}/best").select(F.col("id").alias("item_id"), F.round("best", 9).alias("best"))


@query("select o_orderkey as id from orders where cast('0x' || substr(sha256(cast(o_orderkey as varchar)), 1, 6) as bigint) / 16777216.0::double < 0.5::double")
def stream_resume(spark, sf):
    """A stream that is stopped, fed and started again at its checkpoint: every row once."""
    at = f"{shared_dir(spark)}/resumed-{uuid.uuid4().hex}"
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    for part in (o.where("id % 3 = 0"), o.where("id % 3 <> 0")):
        part.write.mode("append").parquet(f"{at}/in")
        found = V.to_table(V.shadow_stream(spark.readStream.schema(o.schema).parquet(f"{at}/in"), 0.5, "id"), "resumed", at=f"{at}/out")
    return found


_EVENTS = f"""{S.OBS}, e as (
    select o_custkey as key, o_orderkey as seq, 1 - coalesce(score, 0) as oddity, not coalesce(truth, false) as wrong, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n
    from obs join orders on rec_idx = o_orderkey where k = 0 and o_orderdate < (select max(o_orderdate) from orders) - interval 732 hour
)"""


@query(_EVENTS.replace("with ", "with recursive ", 1) + """, st(key, n, seq, tau, accepted, err) as (
    select key, n, seq, 0.5::double, oddity <= 0.5::double, oddity <= 0.5::double and wrong from e where n = 1
    union all
    select key, n, seq, t, oddity <= t, oddity <= t and wrong from (
        select e.*, st.tau + 0.05::double * (0.2::double - cast(cast(st.err as int) as double)) as t from st join e on e.key = st.key and e.n = st.n + 1)
)
select key, seq, round(tau, 9) as tau, accepted, err from st""")
def stream_adaptive(spark, sf):
    """The level of tolerated oddity of each customer, led by its errors; answers of the last 30 and a half days still wait for the watermark."""
    o = B.stream(spark, sf, "orders")
    first = B.tier_obs(F.col("o_orderkey"), 0)
    answers = o.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"), first["score"].alias("score"), (~F.coalesce(P.truth(first), F.lit(False))).alias("wrong"))
    return V.to_table(V.adaptive_level(answers, 0.5, 0.2, 0.05, "732 hours"), "stream-adaptive").withColumn("tau", F.round("tau", 9))
