"""Exact top-k search by inner product: a pivot table bounds every score, candidates are tried in bound order.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance: with M the largest
norm, |q' - x'|**2 = |q|**2 + M**2 - 2 q.x for x' = (x, sqrt(M**2 - |x|**2)) and q' = (q, 0). Distances from every
candidate to the pivots are computed once; for a query, the largest |d(q, p) - d(x, p)| over the pivots is a lower bound
of the distance, so an upper bound of the score. Candidates of a block are taken in bound order until no bound reaches
the k-th best score, in runs that lie about as far from all pivots: a run has one bound for each query and is scored by a
matrix product for all queries that still ask it. Bounds carry a margin over rounding, and scores are exact integers. Bounds are doubles; vectors too
long for them (a square norm over 1e200) have none and are always tried. A score that a long doesn't hold counts as the
nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

MARGIN = 1e-6


LONGEST = 1e200  # square norms beyond this have no bounds
WHOLE = float(2**52)


def integer_vectors(df: DataFrame, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key as vec_id, and v: floor(scale * x) of each component, as whole doubles; vectors that are null or hold null, NaN or infinities go.

    A product over the largest double counts as the largest double.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    whole = df.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).where("x is not null and vec_id is not null")
    fine = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = F.lit(np.finfo(np.float64).max.item())
    scaled = F.transform("x", lambda c: F.least(F.greatest(c * scale, -most), most))
    return whole.where(fine).select("vec_id", F.transform(scaled, lambda y: F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(flat) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def inner_products(rows: np.ndarray, largest: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors as longs; what a long doesn't hold is the nearest long. largest: of each row's components, absolute."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.nan_to_num(largest * np.abs(q).max(initial=0) * max(len(q), 1), nan=0.0, posinf=np.inf)
    if (bound < WHOLE).all():
        return np.rint(rows @ q).astype(np.int64)  # sums of whole doubles below 2**52 are exact
    out = np.empty(len(rows), np.int64)
    small, fits = bound < WHOLE, bound < 2.0**62
    out[small] = np.rint(rows[small] @ q).astype(np.int64)
    some = fits & ~small
    if some.any():
        out[some] = rows[some].astype(np.int64) @ q.astype(np.int64)
    whole = [int(c) for c in q.tolist()] if not fits.all() else []
    for i in np.flatnonzero(~fits):
        out[i] = max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(rows[i].tolist(), whole))))
    return out


def scores_from(rows: np.ndarray, largest: np.ndarray, q: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and exact scores of the rows that score `least` of a query or more and don't bear its id."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.nan_to_num(largest.max(initial=0) * np.abs(q).max(initial=0) * max(q.shape[1], 1), nan=0.0, posinf=np.inf)
    if bound < WHOLE:
        scores = q @ rows.T  # whole doubles below 2**52 are exact, and rounding `least` doesn't carry it past one of them
    else:
        scores = np.stack([inner_products(rows, largest, x) for x in q]) if len(q) else np.empty((0, len(rows)), np.int64)
    at, row = np.nonzero((scores >= least[:, None].astype(scores.dtype)) & (ids != q_ids[:, None]))
    return at, ids[row], np.rint(scores[at, row]).astype(np.int64) if scores.dtype.kind == "f" else scores[at, row]


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))]


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the farthest from those before it."""
    at = [0]
    d = ((x - x[0]) ** 2).sum(1)
    while len(at) < min(n, len(x)):
        at.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def top_k(df: DataFrame, k: int = 20, query_step: int = 20, scale: int = 64, pivots: int = 16, pivot_sample: int = 512, block: int = 4096, query_block: int = 2048, run: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row whose key is divisible by query_step.

    Ties go to the smaller vec_id. A query never meets rows of its own vec_id; a repeated vec_id asks once (with its
    least vector) and each of its rows is a candidate. Scores beyond a long count as the nearest long. Shorter vectors count as padded with zeros. Rows with a null key
    or an unusable vector take no part. The pivots come from `pivot_sample` vectors by hash order (a documented bound);
    every row is indexed. Queries and candidates meet in blocks, each pair of blocks once: first every query meets one
    block, and its k-th best score there is the least that it asks of all others.
    """
    rows = stage(integer_vectors(df, scale, key, vector), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    bounded = rows.withColumn("square", square)
    facts = bounded.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.coalesce(F.max(F.when(F.col("square") <= LONGEST, F.col("square"))), F.lit(0.0)).alias("top"), F.count(F.lit(1)).alias("n")).first()
    dim, top, n = facts["dim"], facts["top"], facts["n"]
    sample = [r["v"] for r in bounded.where(F.col("square") <= LONGEST).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(pivot_sample).collect()]
    base = np.zeros((max(len(sample), 1), dim))
    for i, v in enumerate(sample):
        base[i, : len(v)] = v
    points = _far_apart(_lift(base, top), pivots)
    blocks = max(1, -(-n // block))
    asked = stage(rows.where(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    query_blocks = max(1, -(-(n // query_step + 1) // query_block))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        q_id, c_id = queries.column("vec_id").to_numpy(), candidates.column("vec_id").to_numpy()
        floors = queries.column("floor").to_numpy()
        q, c = (_matrix(t.column("v").combine_chunks(), dim) for t in (queries, candidates))
        to_pivots = lambda x: np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * x @ points.T, 0))
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (c * c).sum(1)
            free = ~(squares <= LONGEST)  # candidates without a bound
            d_c = to_pivots(_lift(np.where(free[:, None], 0, c), top))
            q_squares = (q * q).sum(1)
            d_q = to_pivots(np.c_[np.where((q_squares <= LONGEST)[:, None], q, 0), np.zeros(len(q))])
        largest = np.abs(c).max(1, initial=0)
        near = d_c.argmin(1)
        deal = np.lexsort((d_c[np.arange(len(c)), near], near))  # runs of candidates about as far from all pivots
        runs = [deal[i : i + run] for i in range(0, len(deal), run)]
        gaps = np.stack([np.maximum(d_c[r].min(0) - d_q, d_q - d_c[r].max(0)).max(1) for r in runs], 1)
        low = np.maximum(gaps - MARGIN * (1 + d_q.max(1))[:, None], 0)
        bound = (q_squares[:, None] + top - low * low) / 2 + MARGIN * (1 + top + q_squares)[:, None]
        bound[:, [free[r].any() for r in runs]] = np.inf
        bound[~(q_squares <= LONGEST)] = np.inf
        kth = floors.copy()  # of each query: the least score that is still asked
        held, waiting, due = [np.empty(0, np.int64)] * 3, [], 0  # places of queries, candidates, scores

        def merge() -> list[np.ndarray]:
            at, ids, scores = (np.concatenate([h, *(w[j] for w in waiting)]) for j, h in enumerate(held))
            best = np.lexsort((ids, ~scores, at))  # ~ turns the order without overflow
            at, ids, scores = at[best], ids[best], scores[best]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            full = place == k - 1
            kth[at[full]] = np.maximum(kth[at[full]], scores[full])
            return [x[place < k] for x in (at, ids, scores)]

        for j in np.argsort(-np.nan_to_num(bound.max(0), posinf=np.inf), kind="stable"):
            live, rows = np.flatnonzero(bound[:, j] >= kth), runs[j]
            for part in np.array_split(live, max(1, -(-len(live) // 512))):
                found = scores_from(c[rows], largest[rows], q[part], c_id[rows], q_id[part], kth[part])
                waiting.append((part[found[0]], *found[1:]))
                due += len(found[0])
            if due > 4 * k * len(q) or not len(held[0]):
                held, waiting, due = merge(), [], 0
        at, ids, scores = merge()
        return pa.Table.from_arrays([pa.array(q_id[at]), pa.array(ids), pa.array(scores)], schema=schema)

    home = F.col("qb") % blocks  # the block that a block of queries meets first

    def met(asked: DataFrame, candidates: DataFrame) -> DataFrame:
        return asked.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(search, "query_id long, vec_id long, score long")

    none = F.lit(-(2**63)).cast("long")
    first = stage(met(left.where(F.col("cb") == home).withColumn("floor", none), right.where(F.col("cb") == home)), "first-scores")
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(none).alias("floor"))
    rest = left.where(F.col("cb") != home).join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
    found = first.unionByName(met(rest, right.where(F.col("cb") != home)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
    where embedding is not null and vec_id is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), asked as (
    select vec_id, min(v) as v from v where vec_id % 20 = 0 group by vec_id
), scored as (
    select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from asked q join v c on q.vec_id <> c.vec_id
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rn from scored
)
select query_id, cast(rn as integer) as rank, vec_id, score from ranked where rn <= 20
"""
