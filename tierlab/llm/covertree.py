"""Embedding near-dedup: cover trees over unit vectors, walked in pairs, give exactly the pairs over a cosine threshold.

A cover tree holds its vectors in nested levels: each node has one of its vectors as centre, its children cover it with
half its radius, and the centre is the first child's centre again. Two trees (or one and itself) are walked together:
a pair of nodes is left as soon as the distance of the centres is more than the linking distance and both covering
radii, and taken as a whole when it is so small that every pair links. The vectors of a label are cut into blocks around
pivots; a block's centre and radius are a node above its tree, so whole pairs of blocks are pruned by the same bound
before any vector is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stage, unstage
from .simhash import Components, connected

MARGIN = 1e-7  # of distances, far over their rounding


class CoverTree:
    """Nodes as arrays: centre (a place in the vectors), radius, and the range of `order` that lies below.

    children[i] is the range of node i's children; a leaf has none. Where half the radius takes a centre for every few
    vectors (vectors without structure, of many dimensions), the node stays a leaf, whose pairs one product of matrices tries.
    x: unit vectors.
    """

    def __init__(self, x: np.ndarray, leaf: int = 32):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.lo, self.hi, self.children = [0], [0.0], [0], [len(x)], [(0, 0)]
        d = distances(x, x[:1])[:, 0]
        self.radius[0] = float(d.max())
        todo = [(0, d)]
        while todo:
            node, d = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= leaf or self.radius[node] <= 1e-6:
                continue
            rows = self.order[lo:hi].copy()
            net, nearest, d = self._net(rows, d, self.radius[node] / 2)
            if net is None:
                continue
            by = np.argsort(nearest, kind="stable")
            self.order[lo:hi], d = rows[by], d[by]
            cuts = lo + np.r_[0, np.cumsum(np.bincount(nearest, minlength=len(net)))]
            first = len(self.centre)
            self.children[node] = (first, first + len(net))
            for i, at in enumerate(net):
                part = d[cuts[i] - lo : cuts[i + 1] - lo]
                self.centre.append(int(rows[at]))
                self.radius.append(float(part.max()))
                self.lo.append(int(cuts[i]))
                self.hi.append(int(cuts[i + 1]))
                self.children.append((0, 0))
                todo.append((first + i, part))
        self.centre, self.radius, self.lo, self.hi = (np.array(a) for a in (self.centre, self.radius, self.lo, self.hi))
        self.children = np.array(self.children)

    def _net(self, rows: np.ndarray, d: np.ndarray, radius: float) -> tuple[list[int] | None, np.ndarray, np.ndarray]:
        """Centres (places in rows) that cover all rows with the radius, the node's own centre first; each row's centre and distance.

        None instead of centres if it takes more than an eighth of the rows.
        """
        x = self.x[rows]
        net, nearest, d = [int(d.argmin())], np.zeros(len(rows), np.int64), d.copy()
        while d.max() > radius:
            at = int(d.argmax())
            new = distances(x, x[at : at + 1])[:, 0]
            closer = new < d
            closer[at] = True
            nearest[closer], d[closer] = len(net), new[closer]
            d[at] = 0.0
            net.append(at)
            if len(net) > 8 + len(rows) // 8:
                return None, nearest, d
        return net, nearest, d


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


class Linker:
    """Counts and connects the links within a tree or between two: counts of other vectors (weighted), and a forest of links."""

    def __init__(self, a: CoverTree, b: CoverTree | None, weights_a: np.ndarray, weights_b: np.ndarray, threshold: float, chunk: int = 1 << 12):
        self.a, self.b, self.threshold, self.chunk = a, b or a, threshold, chunk
        self.same = b is None
        self.weights = (weights_a, weights_b)
        self.counts = (np.zeros(len(a.x), np.int64), np.zeros(len(self.b.x), np.int64))
        self.base = 0 if self.same else len(a.x)  # places of b come after those of a
        self.joined = Components(self.base + len(self.b.x))
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        self.pairs_tried = 0
        self._walk()

    def _walk(self) -> None:
        a, b = self.a, self.b
        stack = [np.array([[0, 0]])]
        while stack:
            pairs = stack.pop()
            if len(pairs) > self.chunk:
                stack.append(pairs[self.chunk :])
                pairs = pairs[: self.chunk]
            i, j = pairs.T
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a.x[a.centre[i]], b.x[b.centre[j]]), 0))
            both = a.radius[i] + b.radius[j]
            near = d <= self.reach + both + MARGIN
            i, j, d, both = i[near], j[near], d[near], both[near]
            whole = d + both <= self.reach - MARGIN
            for u, v in zip(i[whole], j[whole]):
                self._take(u, v)
            i, j = i[~whole], j[~whole]
            leaf_a, leaf_b = a.children[i, 0] == a.children[i, 1], b.children[j, 0] == b.children[j, 1]
            for u, v in zip(i[leaf_a & leaf_b], j[leaf_a & leaf_b]):
                self._try(u, v)
            deep_a = ~leaf_a & (leaf_b | (a.radius[i] >= b.radius[j]))
            deep_b = ~leaf_b & ~deep_a
            mirrored = self.same & (i == j)
            below = []
            for u, v in zip(i[mirrored & ~leaf_a], j[mirrored & ~leaf_a]):  # a node with itself: its children's pairs, each once
                at = np.arange(*a.children[u])
                p, q = np.triu_indices(len(at))
                below.append(np.stack([at[p], at[q]], 1))
            for which, side in ((deep_a & ~mirrored, 0), (deep_b & ~mirrored, 1)):
                if which.any():
                    children = (a if side == 0 else b).children[(i if side == 0 else j)[which]]
                    n = children[:, 1] - children[:, 0]
                    child = np.repeat(children[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    other = np.repeat((j if side == 0 else i)[which], n)
                    below.append(np.stack([child, other] if side == 0 else [other, child], 1))
            if below:
                stack.append(np.concatenate(below))

    def _rows(self, u: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        return self.a.order[self.a.lo[u] : self.a.hi[u]], self.b.order[self.b.lo[v] : self.b.hi[v]]

    def _add(self, side: int, rows: np.ndarray, more: np.ndarray | int) -> None:
        self.counts[0 if self.same else side][rows] += more

    def _take(self, u: int, v: int) -> None:
        """All vectors of one node link with all of the other."""
        ra, rb = self._rows(u, v)
        wa, wb = self.weights[0][ra], self.weights[1][rb]
        if self.same and u == v:
            self._add(0, ra, wa.sum() - wa)
        else:
            self._add(0, ra, wb.sum())
            self._add(1, rb, wa.sum())
        self.joined.join(np.r_[np.full(len(rb), ra[0]), ra], np.r_[rb, np.full(len(ra), rb[0])] + self.base)

    def _try(self, u: int, v: int) -> None:
        ra, rb = self._rows(u, v)
        itself = self.same and u == v
        self.pairs_tried += len(ra) * len(rb)
        for at in range(0, len(ra), 512):
            some = ra[at : at + 512]
            p, q = np.nonzero(self.a.x[some] @ self.b.x[rb].T >= self.threshold)
            if itself:
                p, q = p[some[p] != rb[q]], q[some[p] != rb[q]]
            if not len(p):
                continue
            self._add(0, some, np.bincount(p, self.weights[1][rb[q]], len(some)).astype(np.int64))
            if not itself:  # a node with itself shows each pair from both sides
                self._add(1, rb, np.bincount(q, self.weights[0][some[p]], len(rb)).astype(np.int64))
            self.joined.join(some[p], rb[q] + self.base)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what all links connect: at most one a vector."""
        label = self.joined.label
        node = np.flatnonzero(label != np.arange(len(label)))
        return node, label[node]


def unit_rows(blobs: list[bytes] | bytes, kind: str, n: int | None = None) -> np.ndarray:
    """Rows of length 1; they are scaled by powers of two first, so neither huge nor tiny components lose anything."""
    n, blob = (len(blobs), b"".join(blobs)) if n is None else (n, blobs)
    x = np.frombuffer(blob, kind).reshape(n, -1).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cells(x: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the farthest from those before it: centres whose covering radius falls as n grows."""
    at, d = [0], distances(x, x[:1])[:, 0]
    while len(at) < min(n, len(x)) and d.max() > MARGIN:
        at.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[at[-1] :][:1])[:, 0])
    return x[at]


def vector_blocks(vectors: DataFrame, kind: str, block: int, sample: int, most_cells: int) -> DataFrame:
    """Staged: label, block, n, ids, weights, vectors (packed), centre, radius; at most `block` vectors a block.

    vectors: staged (node, label, weight, v: packed components, as many in each row of a label). Cells lie around far-apart
    vectors of a sample, every vector goes to its nearest one, and a cell is cut by ranges of the distance to its centre, so
    a cell of any size becomes blocks and is never gathered in one task. Labels have cells by their share of all rows: most_cells
    in all, and about `sample` sampled vectors for each, whatever the table's size; a label with a share of under two has one.
    """
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    total = vectors.count()
    share = F.least(F.ceil(F.col("n") / block), F.floor(F.col("n") * F.lit(most_cells) / max(total, 1))).cast("int")
    large = sizes.withColumn("cells", share).where("cells >= 2").collect()  # most_cells / 2 rows at most
    centres: dict[int, np.ndarray] = {}
    if large:
        rates = vectors.sparkSession.createDataFrame([(r["label"], r["cells"] * sample / r["n"]) for r in large], "label long, rate double")
        u = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
        drawn: dict[int, list[bytes]] = {}
        for r in vectors.join(F.broadcast(rates), "label").where(u < F.col("rate")).select("label", "v").collect():
            drawn.setdefault(r["label"], []).append(bytes(r["v"]))
        centres = {r["label"]: _cells(unit_rows(sorted(drawn[r["label"]]), kind), r["cells"]) for r in large if r["label"] in drawn}
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy()
            cell, d = np.zeros(len(labels), np.int32), np.zeros(len(labels))
            for label in np.unique(labels):
                if (c := shared.value.get(int(label))) is not None:
                    rows = np.flatnonzero(labels == label)
                    x = unit_rows(batch.column(1).take(pa.array(rows)).to_pylist(), kind)
                    all_d = distances(x, c)
                    cell[rows], d[rows] = all_d.argmin(1), all_d.min(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(d), *[batch.column(i) for i in (1, 2, 3)]], ["label", "cell", "d", "v", "node", "weight"])

    dealt = vectors.select("label", "v", "node", "weight").mapInArrow(deal, "label long, cell int, d double, v binary, node long, weight long")
    order = ["label", "cell", "d", "node"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one label and cell, a block at a time."""
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            x = unit_rows([h[2] for h in held], kind)
            middle = x.mean(0)
            size = float(np.sqrt(middle @ middle))
            middle = middle / size if size > 1e-9 else x[0]
            radius = float(distances(x, middle[None]).max())
            columns = [pa.array([held[0][0]], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([np.array([h[3] for h in held], np.int64).tobytes()], pa.binary()), pa.array([np.array([h[4] for h in held], np.int64).tobytes()], pa.binary()), pa.array([b"".join(h[2] for h in held)], pa.binary()), pa.array([middle.tobytes()], pa.binary()), pa.array([radius], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["label", "n", "ids", "weights", "vectors", "centre", "radius"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if held and (len(held) >= block or held[0][:2] != row[:2]):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    in_order = stage(dealt, "dealt-vectors").repartitionByRange(*order).sortWithinPartitions(*order)
    made = in_order.mapInArrow(gather, "label long, n long, ids binary, weights binary, vectors binary, centre binary, radius double")
    return stage(made.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


def block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """label, p, q (p <= q): the pairs of blocks of a label whose centres are within the linking distance and both radii.

    It reads a centre and a radius a block, not its vectors.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def meet(heads: pa.Table) -> pa.Table:
        heads = heads.sort_by("block")
        name = heads.column("label")[0].as_py()
        no, radius = heads.column("block").to_numpy(), heads.column("radius").to_numpy()
        x = np.frombuffer(b"".join(heads.column("centre").to_pylist()), np.float64).reshape(len(no), -1)
        p, q = [], []
        for i in range(0, len(no), 256):  # rows of distances at a time
            near = distances(x[i : i + 256], x) <= reach + radius[i : i + 256, None] + radius + MARGIN
            a, b = np.nonzero(near)
            keep = a + i <= b
            p.append(no[a[keep] + i])
            q.append(no[b[keep]])
        p, q = np.concatenate(p), np.concatenate(q)
        return pa.table({"label": pa.array([name] * len(p), pa.int64()), "p": pa.array(p, pa.int64()), "q": pa.array(q, pa.int64())})

    return blocks.select("label", "block", "centre", "radius").groupBy("label").applyInArrow(meet, "label long, p long, q long")


def links(blocks: DataFrame, pairs: DataFrame, kind: str, threshold: float, leaf: int = 32) -> DataFrame:
    """u, v, n: for v null, n more links of node u; else a link between nodes u and v (enough of them to connect all that link)."""
    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "weights", "vectors")])
    met = pairs.join(side("p"), "p").join(side("q"), "q")
    dealt = met.select((F.col("p") == F.col("q")).alias("same"), *[f"{c}_{s}" for s in "pq" for c in ("ids", "weights", "vectors")], F.xxhash64("p", "q").alias("deal"))
    dealt = dealt.select("same", "ids_p", "weights_p", "vectors_p", *[F.when(F.col("same"), F.lit(None)).otherwise(F.col(f"{c}_q")).alias(f"{c}_q") for c in ("ids", "weights", "vectors")], "deal")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, *parts = (batch.column(c)[k].as_py() for c in range(7))
                ids = [np.frombuffer(b, np.int64) for b in (parts[0], parts[3] or b"")]
                weights = [np.frombuffer(b, np.int64) for b in (parts[1], parts[4] or b"")]
                a = CoverTree(unit_rows(parts[2], kind, len(ids[0])), leaf)
                b = None if same else CoverTree(unit_rows(parts[5], kind, len(ids[1])), leaf)
                found = Linker(a, b, weights[0], weights[0] if same else weights[1], threshold)
                u, v = found.forest()
                node = ids[0] if same else np.concatenate(ids)
                counts = found.counts[0] if same else np.concatenate(found.counts)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[node[some], node[u]]), pa.array(np.r_[np.zeros(len(some), np.int64), node[v]], mask=np.r_[np.ones(len(some), bool), np.zeros(len(u), bool)]), pa.array(np.r_[counts[some], np.zeros(len(u), np.int64)])], ["u", "v", "n"])

    return dealt.repartition("deal").drop("deal").mapInArrow(walk, "u long, v long, n long")


def near_vectors(df: DataFrame, threshold: float = 0.93, block: int = 2048, sample: int = 16, most_cells: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id (the smallest key reachable by links, itself included), kept (key = component_id), a row a vector.

    Vectors link when their labels are equal and their cosine, in doubles, is at least the threshold. Equal vectors of a
    label are one node with a weight, so copies cost one however many there are; a copy counts as a link. A vector that is null,
    empty or zero, or holds null, NaN or infinity, and one without a label, links with nothing: n_links 0, component_id its
    own key. Vectors of different lengths don't link. Null keys keep their row, and are the smallest only of a
    component without any other (component_id null, kept true). Repeated keys are rows of their own. Extra columns aren't read; empty table: no rows.
    """
    kind = "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    id_type = df.schema[key].dataType.simpleString()
    src = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("l"), F.col(vector).alias("x"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for l, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):  # noqa: E741
                v = None
                if l is not None and x and None not in x:
                    a = np.array(x, np.float64)
                    if np.isfinite(a).all() and a.any():
                        v = (a + 0.0).astype(kind).tobytes()  # no negative zeros
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "l", "v"])

    known = F.sha2(F.concat(F.col("l").cast("binary"), F.lit("\n").cast("binary"), "v"), 256)  # no other vector has this one
    rows = stage(src.mapInArrow(code, f"id {id_type}, l string, v binary").withColumn("k", known), "coded-vectors")
    usable = rows.where("v is not null")
    same = stage(usable.groupBy("k", "l", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    groups = same.groupBy("l", F.length("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("l", "size")
    groups = stage(groups.withColumn("label", F.monotonically_increasing_id()), "vector-labels")
    vectors = stage(same.select("l", "v", "node", "weight").withColumn("size", F.length("v")).join(groups, ["l", "size"]).select("label", "v", "node", "weight"), "vectors")
    blocks = vector_blocks(vectors, kind, block, sample, most_cells)
    found = stage(links(blocks, block_pairs(blocks, threshold), kind, threshold), "vector-links")
    unstage(groups, vectors, blocks)
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    labels = connected(found.where("v is not null").select("u", "v"))
    of_node = same.select("k", "weight", "first", "node").join(counts, "node", "left").join(labels.withColumnRenamed("label", "root"), "node", "left")
    of_node = stage(of_node.select("k", "weight", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "vector-nodes")
    least = of_node.groupBy("root").agg(F.min("first").alias("component_id"))
    final = stage(of_node.join(least, "root").select("k", "weight", "n_links", "component_id"), "vector-components")
    unstage(same, found, of_node)
    hot = final.select("k", F.col("weight").alias("n"))
    linked = salted_join(usable.select("id", "k").withColumn("_row", F.monotonically_increasing_id()), final.select("k", "n_links", "component_id"), "k", hot, ["_row"]).select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
with recursive v as (
    select vec_id, label, case when len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
           then list_transform(embedding, lambda x: cast(x as double)) end as e
    from embeddings
), links as materialized (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where a.e is not null and b.e is not null and list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) as (
    select vec_id, vec_id from v union select r.a, l.b from reach r join links l on l.a = r.b
), least as (
    select a, min(b) as component_id from reach group by a
), n as (
    select a, count(*) as n from links group by a
)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from v join least on least.a = vec_id left join n on n.a = vec_id
"""
