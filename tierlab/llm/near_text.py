"""Near-duplicate texts by exact Jaccard similarity of word shingles: MinHash bands, a SimHash trie walk, verification.

Equal texts are one class before anything is compared. Classes that share a band of their MinHash signature meet in
Spark. First each class of a band is verified against the band's smallest one; what that links is one component, so a
group of near copies of any size costs a star. Bands that still hold several components are walked: those outside the
band's largest component meet all others in blocks, and a binary trie over SimHash fingerprints leaves a pair as soon
as it is over the bits in which texts at the threshold can differ, or lies in one component. What is left is verified in the
same task, which gives a tree of links and never the pairs of a group.

A trie over all texts can't do this alone: at a similarity of 0.8 up to 24 of 64 bits differ, and with that budget
nothing is pruned above its leaves, so all pairs would be compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stage, text_slices, unstage
from .minhash import load
from .simhash import connected, trie_pairs

#: 64-bit words of a wide fingerprint, and odd factors that give each of them its own hash of a shingle.
_WIDE = 4
_FACTORS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_BITS = np.arange(63, -1, -1, dtype=np.uint64)
_WORDS = [f"f{i}" for i in range(_WIDE)]
#: Bits of the first 64 and of all 256 in which a pair at Jaccard 0.8 may differ; texts of few shingles spread more.
FIRST_BUDGET, FEW, FEW_BUDGET, BUDGET = 24, 32, 76, 62


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes in 256 bits: those set in over half the shingles; no shingles: zeros."""
    total = np.zeros((_WIDE, 64), np.int64)
    for i in range(0, len(shingles), 1 << 14):
        h = shingles[i : i + (1 << 14), None] * _FACTORS
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), _WIDE, 8), axis=2).sum(0, dtype=np.int64)
    return ((2 * total > len(shingles)) * (np.uint64(1) << _BITS)).sum(1, dtype=np.uint64)


def classes_of(df: DataFrame, words: int, rows: int, bands: int, seed: int, text: str, key: str) -> DataFrame:
    """Staged: h (SHA-256 of the text), first (its smallest key), n (shingles), bands (keys), f0.. (SimHash words), node; one row a distinct text."""
    kind = df.select(key).schema[0].dataType.simpleString()
    t = F.coalesce(F.col(text), F.lit(""))
    shift = np.arange(rows, dtype=np.int64)[::-1] * 16
    names = ["_id", "h", "n", "bands", *_WORDS]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = load(rows * bands, words, seed)
        for batch in chain.from_iterable(map(text_slices, batches)):
            sets = [hasher.shingles(x) for x in batch.column(2).to_pylist()]
            slots = [hasher.signature(s).astype(np.int64).reshape(bands, rows) for s in sets]
            keys = [(np.arange(bands) << 16 * rows) + (x << shift).sum(1) if len(s) else None for x, s in zip(slots, sets)]
            fps = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, _WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, fps.T.copy())], names)

    signed = df.select(F.col(key).alias("_id"), F.sha2(t, 256).alias("h"), t.alias("t")).mapInArrow(sign, f"_id {kind}, h string, n long, bands array<long>, " + ", ".join(f"{w} long" for w in _WORDS))
    classes = signed.groupBy("h").agg(F.min("_id").alias("first"), F.min(F.struct("n", "bands", *_WORDS)).alias("s")).select("h", "first", "s.*")
    return stage(classes.withColumn("node", F.monotonically_increasing_id()), "text-classes")


def _shingle_sets(df: DataFrame, classes: DataFrame, nodes: DataFrame, words: int, seed: int, text: str) -> DataFrame:
    """Staged: node and shingles of the classes in `nodes` (distinct)."""
    wanted = classes.select("node", "h").join(nodes, "node", "left_semi")
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.sha2("t", 256)).dropDuplicates(["h"]).join(wanted, "h")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = load(1, words, seed)
        for batch in chain.from_iterable(map(text_slices, batches)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hasher.shingles(x).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["node", "shingles"])

    return stage(rows.select("node", "t").mapInArrow(shingle, "node long, shingles binary"), "shingle-sets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Staged: (u, v) of the staged pairs (a, b) whose shingle sets have a Jaccard similarity of threshold or more.

    The sets of b, which is in few pairs, are joined first; an a that is in very many is dealt over many tasks.
    """
    weights = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "pair-weights")
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = salted_join(left, sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a", weights, ["b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= threshold * (len(p) + len(q) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["u", "v"])

    links = stage(both.select("a", "b", "x", "y").mapInArrow(verify, "u long, v long"), "links")
    unstage(weights)
    return links


def _near(a: str, b: str, threshold: float) -> F.Column:
    """Whether two signed rows (struct columns) can reach the threshold by their sizes and bits."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    bits = [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in _WORDS]
    return (small >= threshold * large - 1e-6) & (bits[0] <= FIRST_BUDGET) & (sum(bits[1:], bits[0]) <= F.when(small < FEW, FEW_BUDGET).otherwise(BUDGET))


def _star_pairs(classes: DataFrame, in_bands: DataFrame, threshold: float) -> DataFrame:
    """Staged: (a, b) of those classes b that can be near the smallest class a of a band."""
    star = stage(in_bands.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "star")
    weights = stage(star.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "star-weights")
    row = F.struct("n", *_WORDS)
    left = star.join(classes.select(F.col("node").alias("b"), row.alias("y")), "b")
    both = salted_join(left, classes.select(F.col("node").alias("a"), row.alias("x")), "a", weights, ["b"])
    pairs = stage(both.where(_near("x", "y", threshold)).select("a", "b"), "star-pairs")
    unstage(star, weights)
    return pairs


def _walked_links(df: DataFrame, classes: DataFrame, in_bands: DataFrame, labels: DataFrame, threshold: float, block: int, words: int, seed: int, text: str) -> DataFrame:
    """Staged: (u, v), links between the components that share a band; enough of them to join all that any link joins.

    In each band with several labels, rows outside the commonest label (blocks i) meet all rows (chunks j); a group
    (band, i, j) holds about three blocks of rows, however large the band is. A task walks its groups, takes the
    candidates in order of their bits, verifies those that it hasn't joined yet in the first band that they share, and
    gives a tree of links: never the pairs of a group.
    """
    named = stage(in_bands.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "named-bands")
    tally = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.max_by("label", F.struct("c", "label")).alias("common"), F.sum("c").alias("n"), F.max("c").alias("most"))
    open_bands = stage(tally.where("n > most").select("band", "common", "n", F.ceil((F.col("n") - F.col("most")) / block).alias("blocks"), F.ceil(F.col("n") / (2 * block)).alias("chunks")), "open-bands")
    members = stage(salted_join(named, open_bands, "band", open_bands.select("band", "n"), ["node"]), "open-members")
    sets = _shingle_sets(df, classes, members.select("node").distinct(), words, seed, text)
    rows = members.join(classes.select("node", "bands", F.col("n").alias("size"), *_WORDS), "node").join(sets, "node")
    few, place = F.col("label") != F.col("common"), F.xxhash64("node")
    roles = F.array_compact(F.array(
        F.when(few, F.struct(F.lit(0).alias("side"), F.array(F.pmod(place, F.col("blocks"))).alias("i"), F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1).alias("j"))),
        F.struct(F.lit(1).alias("side"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1).alias("i"), F.array(F.pmod(place, F.col("chunks"))).alias("j")),
    ))
    dealt = rows.withColumn("r", F.explode(roles)).withColumn("i", F.explode("r.i")).withColumn("j", F.explode("r.j"))
    groups = dealt.select("band", "i", "j", F.col("r.side").alias("side"), "node", "label", "size", *_WORDS, "bands", "shingles", F.col("f0").bitwiseXOR(F.lit(-(2**63))).alias("_order"))
    groups = groups.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side", "_order").drop("_order")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            group = np.stack([rows.column(c).to_numpy() for c in ("band", "i", "j")], 1)
            new = np.r_[True, (group[1:] != group[:-1]).any(1)]
            side = rows.column("side").to_numpy()
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(side)]
            middle = first + np.add.reduceat(side == 0, first)
            node, label, size, band = (rows.column(c).to_numpy() for c in ("node", "label", "size", "band"))
            fp = np.stack([rows.column(w).to_numpy() for w in _WORDS], 1).view(np.uint64)
            i, j = trie_pairs(np.ascontiguousarray(fp[:, 0]), label, np.stack([first, middle, middle, last], 1), FIRST_BUDGET)
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            bits = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64)
            near = (bits <= np.where(small < FEW, FEW_BUDGET, BUDGET)) & (small >= threshold * large - 1e-6)
            i, j, bits = i[near], j[near], bits[near]
            held_bands = np.stack(rows.column("bands").to_numpy(zero_copy_only=False)) if len(i) else None
            links, up, sets = [], {}, {}
            shingles = rows.column("shingles")

            def root(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = x = up.get(y, y)
                return x

            def set_of(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = np.frombuffer(shingles[k].as_buffer(), np.uint64)
                return sets[k]

            for at in np.argsort(bits, kind="stable").tolist():
                x, y = int(i[at]), int(j[at])
                a, b = root(int(label[x])), root(int(label[y]))
                if a == b or held_bands[x][held_bands[x] == held_bands[y]][0] != band[x]:
                    continue
                p, q = set_of(x), set_of(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= threshold * (len(p) + len(q) - both):
                    up[max(a, b)] = min(a, b)
                    links.append((int(node[x]), int(node[y])))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:  # a group may span batches; whole groups are walked together, many small ones at once
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            ends = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if held and batch.num_rows and any(held[-1].column(k)[-1].as_py() != int(key[0, k]) for k in range(3)):
                yield found(held)
                held = []
            if len(ends):
                yield found([*held, batch.slice(0, int(ends[-1]))])
                held, batch = [], batch.slice(int(ends[-1]))
            if batch.num_rows:
                held.append(batch)
        if held:
            yield found(held)

    return stage(groups.mapInArrow(walk, "u long, v long"), "walked-links")


def simhash_components(df: DataFrame, threshold: float = 0.8, words: int = 5, rows: int = 3, bands: int = 16, seed: int = 1, text: str = "text", key: str = "doc_id", block: int = 512) -> DataFrame:
    """h (SHA-256 of the text), first (its smallest key) and label (of its component), one row a distinct text.

    Links: Jaccard of word shingles >= threshold, exact for each candidate. Two texts at 0.8 share one of 16 bands of 3
    slots with a probability of 0.99999 (1 - (1 - J**3)**16). Texts without words are one class and link to nothing
    else. Null keys are never first unless a text has no other. Repeated rows are one text. Other columns aren't read.
    """
    classes = classes_of(df, words, rows, bands, seed, text, key)
    members = classes.select("node", F.explode("bands").alias("band"))
    shared = stage(members.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-bands")
    in_bands = stage(salted_join(members, shared.select("band", "least"), "band", shared.select("band", "n"), ["node"]), "band-members")
    star = _star_pairs(classes, in_bands, threshold)
    nodes = stage(star.selectExpr("explode(array(a, b)) as node").distinct(), "star-nodes")
    sets = _shingle_sets(df, classes, nodes, words, seed, text)
    links = _verified(star, sets, threshold)
    labels = stage(connected(links), "star-labels")
    labels = connected(links.unionByName(_walked_links(df, classes, in_bands, labels, threshold, block, words, seed, text)))
    return classes.join(labels, "node", "left").select("h", "first", F.coalesce("label", "node").alias("label"))


def near_components(df: DataFrame, threshold: float = 0.8, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, class_id (smallest key of the equal texts) and component_id (smallest key reachable), one row a document.

    As simhash_components. Null keys keep their row and are never an id unless a class has no other. Repeated rows stay.
    """
    found = stage(simhash_components(df, threshold, words, text=text, key=key), "class-components")
    least = found.groupBy("label").agg(F.min("first").alias("component_id"))
    final = found.join(least, "label").select("h", F.col("first").alias("class_id"), "component_id")
    docs = stage(df.select(F.col(key).alias("_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h")), "text-hashes")
    copies = stage(docs.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "copies")
    return salted_join(docs, final, "h", copies, [F.monotonically_increasing_id()]).select(F.col("_id").alias(key), "class_id", "component_id")
