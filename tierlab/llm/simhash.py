"""SimHash near-dedup: fingerprints by vectorised bit votes, linked by a binary trie self-join under a Hamming budget.

The trie is a sorted array of fingerprints; a node is a range that shares a prefix. Pairs of nodes are walked together
from the top, one bit at a time, adding up the bits in which the two sides differ, and a pair is left as soon as it is
over its budget. Two walks share the work: a pair within k bits has at most k // 2 differing bits in its high half, or
at most (k - 1) // 2 in its low half, so the first walk reads the bits from the top under the first budget, the second
walk reads the halves swapped under the second. The trie is cut at a fixed depth into subtrees; Spark joins the pairs of
subtrees that are within budget and each task walks one pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stage, text_slices, unstage

SEED = 42
_BITS = np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """Bits set in over half the shingles' hashes; no words: 0."""
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    n = max(1, len(tokens) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)])], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int((np.uint64(1) << _BITS)[2 * total > n].sum(dtype=np.uint64))


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4) -> DataFrame:
    """key and fp (long with the fingerprint's 64 bits) of each whole text; null or empty text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    src = df.select(key, text)
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, fp long")


class Components:
    """Labels of n nodes, joined in bulk."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.runs = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        label, changed = self.label, False
        while True:
            a, b = label[u], label[v]
            differ = a != b
            if not differ.any():
                break
            changed = True
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (up := label[label]).tobytes() != label.tobytes():
                label[:] = up
        if changed:
            self.runs = np.cumsum(np.r_[0, label[1:] != label[:-1]])

    def joined(self, lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
        """Which pairs of ranges lie in one component as a whole: nothing is left to find there."""
        one = (self.runs[hi_a - 1] == self.runs[lo_a]) & (self.runs[hi_b - 1] == self.runs[lo_b])
        return one & (self.label[lo_a] == self.label[lo_b])


def trie_components(a: np.ndarray, b: np.ndarray | None, budget: int, half_budget: int, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(value, least value of its component) of those values that a link joins to another; a, b: sorted distinct uint64.

    b None: the links inside a. Else: only the links between a and b. half_budget: of the 32 high bits.
    """
    values = a if b is None else np.r_[a, b]
    found = Components(len(values))
    end_b = len(values)
    begin = (0, len(a), 0, len(a)) if b is None else (0, len(a), len(a), end_b)
    if not len(a) or (b is not None and not len(b)):
        return values[:0], values[:0]
    stack = [(0, np.array([begin], np.int64), np.zeros(1, np.int64))]
    side_b = a if b is None else b
    base = 0 if b is None else len(a)
    while stack:
        depth, nodes, err = stack.pop()
        if len(nodes) > chunk:
            stack.append((depth, nodes[chunk:], err[chunk:]))
            nodes, err = nodes[:chunk], err[:chunk]
        lo_a, hi_a, lo_b, hi_b = nodes.T
        left = ~found.joined(lo_a, hi_a, lo_b, hi_b)
        nodes, err = nodes[left], err[left]
        if not len(nodes):
            continue
        lo_a, hi_a, lo_b, hi_b = nodes.T
        small = ((hi_a - lo_a) * (hi_b - lo_b) <= 8) | (depth >= 64)
        if small.any():
            s_lo_a, s_hi_a, s_lo_b, s_hi_b = nodes[small].T
            n_b = s_hi_b - s_lo_b
            n = (s_hi_a - s_lo_a) * n_b
            which = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            u, v = s_lo_a[which] + at // n_b[which], s_lo_b[which] + at % n_b[which]
            x = values[u] ^ values[v]
            near = (np.bitwise_count(x) <= budget) & (np.bitwise_count(x >> np.uint64(32)) <= half_budget) & (u != v)
            found.join(u[near], v[near])
            nodes, err = nodes[~small], err[~small]
            if not len(nodes):
                continue
            lo_a, hi_a, lo_b, hi_b = nodes.T
        bit = np.uint64(1 << (63 - depth))
        above = ~np.uint64((1 << (64 - depth)) - 1) if depth else np.uint64(0)
        mid_a = np.clip(np.searchsorted(a, (values[lo_a] & above) | bit), lo_a, hi_a)
        mid_b = np.clip(np.searchsorted(side_b, (values[lo_b] & above) | bit) + base, lo_b, hi_b)
        most = min(budget, half_budget) if depth < 32 else budget
        same = lo_a == lo_b if b is None else np.zeros(len(nodes), bool)
        agree, differ = err, err + 1
        parts = [(lo_a, mid_a, lo_b, mid_b, agree, None), (mid_a, hi_a, mid_b, hi_b, agree, None), (lo_a, mid_a, mid_b, hi_b, differ, None), (mid_a, hi_a, lo_b, mid_b, differ, same)]
        below = []
        for la, ha, lb, hb, e, skip in parts:  # the pairs that agree in this bit come first: components form before the rest is walked
            ok = (la < ha) & (lb < hb) & (e <= most)
            if skip is not None:
                ok &= ~skip
            below.append((np.stack([la[ok], ha[ok], lb[ok], hb[ok]], 1), e[ok]))
        if any(len(x) for x, _ in below):
            stack.append((depth + 1, np.concatenate([x for x, _ in below]), np.concatenate([e for _, e in below])))
    linked = np.flatnonzero(found.label != np.arange(len(values)))
    least = np.full(len(values), np.uint64(2**64 - 1))
    np.minimum.at(least, found.label, values)
    roots = np.unique(found.label[linked])
    members = np.r_[roots, linked]
    return values[members], least[found.label[members]]


def trie_pairs(values: np.ndarray, labels: np.ndarray, starts: np.ndarray, budget: int, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of the values within the budget of each other that have different labels, over pairs of ranges.

    starts: rows lo_i, hi_i, lo_j, hi_j; each range of values is in order and is the root of a trie. The pairs of roots
    are walked together; a pair of nodes is left when its bits differ too often, or when all below it have one label.
    """
    runs = np.cumsum(np.r_[0, labels[1:] != labels[:-1]]) if len(labels) else labels
    zeros: dict[int, np.ndarray] = {}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, starts.reshape(-1, 4).astype(np.int64), np.zeros(len(starts), np.int64))]
    while stack:
        depth, nodes, err = stack.pop()
        if len(nodes) > chunk:
            stack.append((depth, nodes[chunk:], err[chunk:]))
            nodes, err = nodes[:chunk], err[:chunk]
        ok = (nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (err <= budget)
        nodes, err = nodes[ok], err[ok]
        lo_a, hi_a, lo_b, hi_b = nodes.T
        one = (runs[lo_a] == runs[hi_a - 1]) & (runs[lo_b] == runs[hi_b - 1]) & (labels[lo_a] == labels[lo_b])
        nodes, err = nodes[~one], err[~one]
        if not len(nodes):
            continue
        lo_a, hi_a, lo_b, hi_b = nodes.T
        size = (hi_a - lo_a) * (hi_b - lo_b)
        small = size <= (8 if depth < 64 else 1 << 12)
        if small.any():
            at_a, _, at_b, end_b = nodes[small].T
            which = np.repeat(np.arange(small.sum()), size[small])
            place = np.arange(len(which)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
            n_b = (end_b - at_b)[which]
            i, j = at_a[which] + place // n_b, at_b[which] + place % n_b
            near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (labels[i] != labels[j])
            found.append((i[near], j[near]))
            nodes, err = nodes[~small], err[~small]
            if not len(nodes):
                continue
            lo_a, hi_a, lo_b, hi_b = nodes.T
        if depth >= 64:  # equal values only: halve until a part is small
            mid_a, mid_b = (lo_a + hi_a) // 2, (lo_b + hi_b) // 2
            differ = err
        else:
            if depth not in zeros:
                zeros[depth] = np.r_[0, np.cumsum(values >> np.uint64(63 - depth) & np.uint64(1) == 0)]
            z = zeros[depth]
            mid_a, mid_b = lo_a + z[hi_a] - z[lo_a], lo_b + z[hi_b] - z[lo_b]
            differ = err + 1
        parts = [(lo_a, mid_a, lo_b, mid_b), (mid_a, hi_a, mid_b, hi_b), (lo_a, mid_a, mid_b, hi_b), (mid_a, hi_a, lo_b, mid_b)]
        stack.append((min(depth + 1, 64), np.concatenate([np.stack(x, 1) for x in parts]), np.concatenate([err, err, differ, differ])))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def _swap(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(32)) | (x >> np.uint64(32))


def trie_links(fps: DataFrame, budget: int, depth: int = 6, block: int = 8192) -> DataFrame:
    """(u, v): each fp that has a link, with a fp of its component; enough of them that all linked fps are connected.

    fps: staged distinct longs `fp`. They are sorted over the cluster and cut, where the prefix of `depth` bits changes,
    into blocks of at most `block` values, so a crowded subtree becomes several blocks and is never gathered; the pairs
    of blocks whose prefixes differ within the budget are walked.
    """
    first, second = budget // 2, (budget - 1) // 2
    in_order = lambda x: x.bitwiseXOR(F.lit(-(2**63)))  # noqa: E731  signed order of this is the unsigned order of x
    swapped = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    turns = [F.struct(F.lit(t).alias("turn"), in_order(x).alias("x")) for t, x in ((0, F.col("fp")), (1, swapped))[: 1 if second < 0 else 2]]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        subtree, held = None, np.empty(0, np.uint64)

        def cut(whole: bool) -> pa.RecordBatch:
            """Full blocks of what is held, and the rest too if the subtree ends."""
            nonlocal held, made
            n = len(held) if whole else len(held) - len(held) % block
            parts = [held[i : min(i + block, n)].tobytes() for i in range(0, n, block)]
            held, no = held[n:], range(task + made, task + made + len(parts))
            made += len(parts)
            turn, prefix = divmod(subtree, 1 << depth)
            return pa.RecordBatch.from_arrays([pa.array([turn] * len(parts), pa.int32()), pa.array([prefix] * len(parts), pa.int32()), pa.array(no, pa.int64()), pa.array(parts, pa.binary())], ["turn", "prefix", "no", "block"])

        for batch in batches:
            x = batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            at = (batch.column(0).to_numpy().astype(np.int64) << depth) | (x >> np.uint64(64 - depth)).astype(np.int64)
            for run in np.split(np.arange(len(x)), np.flatnonzero(np.diff(at)) + 1):
                if len(run) and at[run[0]] != subtree:
                    if len(held):
                        yield cut(True)
                    subtree = int(at[run[0]])
                held = np.r_[held, x[run]]
                if len(held) >= block:
                    yield cut(False)
        if len(held):
            yield cut(True)

    in_turns = fps.select(F.inline(F.array(*turns))).repartitionByRange("turn", "x").sortWithinPartitions("turn", "x")
    blocks = stage(in_turns.mapInArrow(pack, "turn int, prefix int, no long, block binary"), "trie-blocks")
    masks = [[m for m in range(1 << depth) if m.bit_count() <= k] for k in (first, second)]
    near = F.when(F.col("turn") == 0, F.array(*map(F.lit, masks[0]))).otherwise(F.array(*map(F.lit, masks[1] or [0])))
    left = blocks.select("turn", F.col("prefix").alias("p"), F.col("no").alias("n"), F.col("block").alias("x"), F.explode(F.transform(near, lambda m: F.col("prefix").bitwiseXOR(m))).alias("q")).where("p <= q")
    right = blocks.select(F.col("turn").alias("t2"), F.col("prefix").alias("q2"), F.col("no").alias("n2"), F.col("block").alias("y"))
    pairs = left.join(right, (F.col("turn") == F.col("t2")) & (F.col("q") == F.col("q2"))).where("p < q or n <= n2")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for turn, same, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                a = np.frombuffer(x, np.uint64)
                u, v = trie_components(a, None if same else np.frombuffer(y, np.uint64), budget, second if turn else first)
                if turn:
                    u, v = _swap(u), _swap(v)
                keep = u != v
                yield pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(v[keep].view(np.int64))], ["u", "v"])

    same = (F.col("p") == F.col("q")) & (F.col("n") == F.col("n2"))
    dealt = pairs.select("turn", same.alias("same"), "x", F.when(same, F.lit(None)).otherwise(F.col("y")).alias("y"), F.xxhash64("turn", "p", "q", "n", "n2").alias("_deal"))
    return dealt.repartition("_deal").drop("_deal").mapInArrow(walk, "u long, v long")


def connected(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) over links (u, v): least labels of neighbours, then pointer jumps.

    All tables stay in the shared folder; the driver sees one count of changes a round.
    """
    edges = stage(links.where("u <> v").selectExpr("least(u, v) as u", "greatest(u, v) as v").distinct().selectExpr("inline(array(struct(u, v), struct(v as u, u as v)))"), "links")
    labels = stage(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        before = labels
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        lower = stage(labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "near").alias("to"), F.col("label").alias("was")), "labels")
        jump = lower.select(F.col("node").alias("n2"), F.col("to").alias("to2"))
        after = stage(lower.join(jump, F.col("to") == F.col("n2"), "left").select("node", F.least("to", F.coalesce("to2", "to")).alias("label"), "was"), "labels")
        changed = after.where("label <> was").limit(1).count()
        unstage(before, lower)
        labels = after
        if not changed:
            unstage(edges)
            return labels.select("node", "label")


def near_components(df: DataFrame, budget: int = 4, words: int = 4, text: str = "text", key: str = "doc_id", depth: int | None = None) -> DataFrame:
    """key, fp and component_id, the smallest key reachable over links of at most `budget` differing bits.

    Equal fingerprints are one node, so a group of copies of any size costs one; links are walked between distinct
    fingerprints only and each task gives a spanning star, never all pairs. Null or empty texts have the fingerprint
    zero and link like any other. Null keys keep their row and are never the smallest, unless the component has no
    other (then component_id is null). Without a depth the trie is cut deeper as distinct fingerprints grow. Repeated rows stay. Other columns aren't read.
    """
    docs = stage(fingerprints(df, text, key, words), "fingerprints")
    nodes = stage(docs.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    depth = depth or max(6, (nodes.count() >> 13).bit_length())  # a subtree is about a block, so two near subtrees meet once
    labels = connected(trie_links(nodes, budget, depth))
    of_node = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    of_node = stage(of_node, "node-labels")
    least = of_node.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = stage(of_node.join(least, "label").select("fp", "component_id"), "components")
    return salted_join(docs, of_fp, "fp", nodes.select("fp", "n"), [F.monotonically_increasing_id()]).select(key, "fp", "component_id")


def hex64(column) -> F.Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
