"""Similarity of trigram sets: exact Jaccard joins over a threshold by prefix filtering, retrieval, best earlier text, best pairs.

Two sets with a Jaccard similarity of t share one of their rarest grams: of a set of n, in order of rarity, one of the first
n - ceil(t * n) + 1. So only these prefixes are joined, among sets whose sizes allow t (classes of size are part of
the key), and a match counts only if the grams that are left after it can still reach t. What remains is verified once,
from the whole sets. Any order of grams gives the same pairs; rarity is taken from
counts of hashed grams, a byte for each of 65,536 buckets, so what every task gets doesn't grow with the texts. Equal texts are one
set, however many rows hold them.

At low thresholds, such as those of retrieval, prefixes hold most of a set and keep little apart. There queries and texts
meet in blocks, and common grams are counted for all pairs of a block by a product of 0/1 matrices.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import normalize, problem_hash, trigrams
from ..staging import stage

BUCKETS = 1 << 16  # of the table of rarity
QUERIES, CHUNK = 1024, 512  # texts of a block and of a chunk that meet in retrieval
CELLS = 1 << 23  # of a matrix in retrieval


def grams(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, size and g: a row for each distinct trigram."""
    t = df.select(F.col(id_col).alias("id"), trigrams(F.col(text)).alias("gs"))
    return t.select("id", F.size("gs").alias("size"), F.explode("gs").alias("g"))


def jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, sim for all pairs of grams tables that share a trigram: for when every such pair is wanted."""
    x = left.select(F.col("id").alias("a"), F.col("size").alias("na"), "g")
    y = right.select(F.col("id").alias("b"), F.col("size").alias("nb"), "g")
    both = x.join(y, "g").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    return both.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("sim"))


def gram_codes(text: Column) -> Column:
    """The distinct trigrams of a text as longs, 21 bits a code point; fewer than three code points: none."""
    chars = F.filter(F.split(normalize(text), "", -1), lambda c: c != "")

    def codes(points: Column) -> Column:
        n = F.greatest(F.size(points) - 2, F.lit(0))
        part = lambda k, bits: F.transform(F.slice(points, F.lit(k + 1), n), lambda p: F.shiftleft(p, bits))
        return F.array_distinct(F.zip_with(F.zip_with(part(0, 42), part(1, 21), lambda a, b: a + b), part(2, 0), lambda a, b: a + b))

    found = let(F.transform(chars, lambda c: F.ascii(c).cast("long")), codes)
    return F.when(F.length(text) >= 3, found).otherwise(F.array().cast("array<long>"))


def text_sets(*sides: DataFrame) -> list[DataFrame]:
    """Staged, for each side (id, text, more): h (the text's hash), n and gs (its grams, rarest of all sides first); a row a distinct text."""
    distinct = [stage(s.where("text is not null").groupBy(problem_hash(F.col("text")).alias("h")).agg(F.first("text").alias("t")).select("h", gram_codes(F.col("t")).alias("gs")), "texts") for s in sides]
    bucket = lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")
    counts = None
    for d in distinct:
        c = d.select(F.explode("gs").alias("g")).groupBy(bucket(F.col("g")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        counts = c if counts is None else counts.unionByName(c)
    levels = bytearray(BUCKETS)  # a byte a bucket: eighths of powers of two
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        levels[r["bucket"]] = min(255, int(8 * math.log2(1 + r["n"])))
    rarity = F.lit(bytes(levels))

    def ordered(d: DataFrame) -> DataFrame:
        key = lambda g: F.struct(F.substr(rarity, bucket(g) + 1, F.lit(1)).alias("c"), g.alias("g"))
        in_order = F.transform(F.array_sort(F.transform("gs", key)), lambda x: x["g"])
        return d.select("h", F.size("gs").alias("n"), in_order.alias("gs"))

    return [stage(ordered(d), "text-sets") for d in distinct]


def _size_classes(t: float, most: int = 1 << 40) -> list[int]:
    """Least sizes of classes such that sets of a similarity of t lie in one class or two neighbours."""
    least = [1]
    while least[-1] < most:
        least.append(max(least[-1] + 1, math.floor(least[-1] / t) + 1))
    return least


def candidates(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """a, b (hashes): the pairs of text_sets that prefixes, sizes and positions leave at a threshold t > 0; every pair that reaches t is among them."""
    bounds = F.array(*[F.lit(b).cast("long") for b in _size_classes(t)[:200]])
    margin = 1e-9  # t * n may be rounded up past a whole number

    def prefixes(s: DataFrame, names: tuple[str, str, str], spread: bool) -> DataFrame:
        h, n, place = names
        size = F.size(F.filter(bounds, lambda b: b <= F.col("n")))
        length = (F.col("n") - F.ceil(F.col("n") * t - margin) + 1).cast("int")
        rows = s.where("n > 0").select(F.col("h").alias(h), F.col("n").alias(n), size.alias("_class"), F.posexplode(F.slice("gs", F.lit(1), length)).alias(place, "_g"))
        return rows.withColumn("_class", F.explode(F.array(*[F.col("_class") + d for d in (-1, 0, 1)]))) if spread else rows

    x, y = prefixes(left, ("a", "na", "i"), True), prefixes(right, ("b", "nb", "j"), False)
    fits = (F.col("nb") >= F.col("na") * t - margin) & (F.col("na") >= F.col("nb") * t - margin)
    rest = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j"))  # this gram and those after it
    met = x.join(y, ["_class", "_g"]).where(fits & (rest >= (F.col("na") + F.col("nb")) * (t / (1 + t)) - margin))
    return met.select("a", "b").distinct()


def similar(left: DataFrame, right: DataFrame, t: float, keep: Column | None = None) -> DataFrame:
    """a, b (hashes), sim of the pairs of text_sets whose Jaccard similarity is at least t > 0; keep: a condition on a and b."""
    found = candidates(left, right, t)
    found = found if keep is None else found.where(keep)
    sets = lambda s, k: s.select(F.col("h").alias(k), F.col("n").alias(f"n{k}"), F.col("gs").alias(f"gs_{k}"))
    both = F.size(F.array_intersect("gs_a", "gs_b"))
    exact = found.join(sets(left, "a"), "a").join(sets(right, "b"), "b").select("a", "b", "na", "nb", both.alias("both"))
    return exact.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("sim")).where(F.col("sim") >= t)


def _codes(text: str) -> np.ndarray:
    """As gram_codes, sorted, of a text that is normalised."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])


def _by_size(texts: pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Places, sets and sizes of the texts, smallest set first; texts without a gram are left out."""
    sets = [_codes(t) for t in texts.to_pylist()]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    return order, [sets[i] for i in order], sizes[order]


def _incidence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """1 where a set (row) holds a gram of the sorted vocabulary (column), else 0. Sums are exact: 32 bits hold counts below 2**24."""
    grams = np.concatenate(sets)
    row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
    known = vocabulary[at] == grams
    out = np.zeros((len(sets), len(vocabulary)), dtype=np.float32 if len(vocabulary) < 1 << 24 else np.float64)
    out[row[known], at[known]] = 1
    return out


def _near(asked: pa.Table, held: pa.Table, t: float) -> tuple[list, list, list]:
    """Places in asked and held, and similarity, of the pairs that reach t, and of equal texts under three code points.
    Sets whose sizes forbid it don't meet; no matrix has over CELLS cells (or one row)."""
    margin = 1e-9
    place_a, sets_a, n_a = _by_size(asked["t"])
    place_b, sets_b, n_b = _by_size(held["t"])
    at_a, at_b, sims, i = [], [], [], 0
    while i < len(sets_a):
        grams, j = 0, i
        while j < len(sets_a) and (j == i or (grams + n_a[j]) * (j + 1 - i) <= CELLS):
            grams, j = grams + n_a[j], j + 1
        vocabulary = np.unique(np.concatenate(sets_a[i:j]))
        x = _incidence(sets_a[i:j], vocabulary)
        low, high = np.searchsorted(n_b, n_a[i] * t - margin), np.searchsorted(n_b, n_a[j - 1] / t + margin, "right")
        step = max(1, CELLS // len(vocabulary))
        for k in range(low, high, step):
            m = min(k + step, high)
            both = (_incidence(sets_b[k:m], vocabulary) @ x.T).astype(np.float64)
            sim = both / (n_b[k:m, None] + n_a[None, i:j] - both)
            b, a = np.nonzero(sim >= t)
            at_a.append(place_a[i + a]), at_b.append(place_b[k + b]), sims.append(sim[b, a])
        i = j
    short = {x: i for i, x in enumerate(asked["t"].to_pylist()) if len(x) < 3}
    same = [(short[x], i) for i, x in enumerate(held["t"].to_pylist()) if len(x) < 3 and x in short]
    at_a.append([a for a, _ in same]), at_b.append([b for _, b in same]), sims.append(np.ones(len(same)))
    return at_a, at_b, sims


def retrieve(queries: DataFrame, stored: DataFrame, k: int = 5, floor: float = 0.35) -> DataFrame:
    """The k stored texts most like each query, over the floor (> 0): queries (id, text), stored (id, text, score): a, b, sim, score, place.

    Equal normalised texts count 1, also those under three code points; ties go to the higher score, then the smaller id.
    Chunks of stored rows meet blocks of distinct queries, each pair of them in one group; stored rows are shuffled once for
    each block of QUERIES queries. k = 0: all.
    """
    t = normalize(F.col("text"))
    asked = queries.where("text is not null").select(problem_hash(F.col("text")).alias("h"), "id", t.alias("t"))
    held = stored.where("text is not null").select("id", "score", t.alias("t"))
    distinct = stage(asked.groupBy("h").agg(F.first("t").alias("t")), "asked")
    blocks, chunks = -(-distinct.count() // QUERIES), max(1, -(-stored.count() // CHUNK))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    left = distinct.select("h", "t", deal("h", max(1, blocks)).alias("block"), each(chunks).alias("chunk"))
    right = held.select("id", "score", "t", deal("id", chunks).alias("chunk"), each(blocks).alias("block"))
    fields = right.select("id", "score").schema
    schema = f"h string, id {fields['id'].dataType.simpleString()}, score {fields['score'].dataType.simpleString()}, sim double"

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        at_a, at_b, sims = _near(a, b, floor)
        at_a, at_b = (np.concatenate(x).astype(np.int64) for x in (at_a, at_b))
        return pa.table({"h": a["h"].take(at_a), "id": b["id"].take(at_b), "score": b["score"].take(at_b), "sim": np.concatenate(sims)})

    near = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, schema)
    found = near.select("h", F.col("id").alias("_stored"), "score", "sim")
    scored = found.join(asked.select("h", F.col("id").alias("_query")), "h").select(F.col("_query").alias("a"), F.col("_stored").alias("b"), "sim", "score")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), F.desc("score"), "b"))
    out = scored.withColumn("place", place)
    return out.where(F.col("place") <= k) if k > 0 else out


def _members(df: DataFrame) -> DataFrame:
    """h and id, a row a text; equal texts are told apart by id."""
    return df.where("text is not null").select(problem_hash(F.col("text")).alias("h"), "id")


def best_prior(df: DataFrame, floors: tuple[float, ...] = (0.7, 0.35, 0.15)) -> DataFrame:
    """id and best: the highest similarity of each text (id, text) to one of a smaller id; 0 where none shares a gram.

    Thresholds fall: a text that has an earlier one over a threshold is done, and only the others look further; what is left
    after the last threshold is joined on all its grams.
    """
    sets = text_sets(df)[0]
    members = stage(_members(df), "members")
    first = stage(members.groupBy("h").agg(F.min("id").alias("first")), "first-members")  # an earlier copy of b exists if its first one is earlier
    grammed = members.join(sets.where("n > 0").select("h"), "h", "left_semi")
    w = Window.partitionBy("h").orderBy("id")
    again = grammed.withColumn("_n", F.row_number().over(w)).where("_n > 1").select("id", F.lit(1.0).alias("best"))  # a copy of an earlier text
    left = stage(grammed.join(first.select(F.col("first").alias("id")), "id", "left_semi"), "best-left")
    done = again
    for t in floors:
        open_sets = sets.join(left.select("h"), "h", "left_semi")
        pairs = similar(open_sets, sets, t, F.col("a") != F.col("b")).join(left.select(F.col("h").alias("a"), "id"), "a").join(first.select(F.col("h").alias("b"), F.col("first").alias("_other")), "b")
        best = stage(pairs.where(F.col("_other") < F.col("id")).groupBy("id").agg(F.max("sim").alias("best")), "best-prior")
        done = done.unionByName(best)
        left = stage(left.join(best.select("id"), "id", "left_anti"), "best-left")
    exploded = lambda s: s.select(F.col("h").alias("id"), F.col("n").alias("size"), F.explode("gs").alias("g"))
    rest = jaccard(exploded(sets.join(left.select("h"), "h", "left_semi")), exploded(sets)).where("a <> b").join(left.select(F.col("h").alias("a"), "id"), "a").join(first.select(F.col("h").alias("b"), F.col("first").alias("_other")), "b")
    done = done.unionByName(rest.where(F.col("_other") < F.col("id")).groupBy("id").agg(F.max("sim").alias("best")))
    return df.select("id").join(done, "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"))


def top_pairs(df: DataFrame, k: int, floors: tuple[float, ...] = (0.8, 0.5, 0.3, 0.15)) -> DataFrame:
    """a, b, sim: the k pairs of texts (id, text), a < b, with the highest similarity, ties to larger a, then larger b.

    Thresholds fall until k pairs lie over one, so the pairs in between are never compared; only if the last one leaves
    fewer than k are all pairs that share a gram joined. Pairs without a common gram aren't pairs.
    """
    sets = text_sets(df)[0]
    members = stage(_members(df).join(sets.where("n > 0").select("h"), "h", "left_semi"), "members")
    best = [F.desc("sim"), F.desc("a"), F.desc("b")]

    def pairs(found: DataFrame) -> DataFrame:
        """Of texts by their ids: each found pair of texts, and the copies of one text."""
        few = members.withColumn("_n", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("id")))).where(F.col("_n") <= k + 1)  # of a text's copies only the largest ids can be among the first k
        u, v = few.select(F.col("h").alias("ha"), F.col("id").alias("ida")), few.select(F.col("h").alias("hb"), F.col("id").alias("idb"))
        across = found.join(u, F.col("a") == F.col("ha")).join(v, F.col("b") == F.col("hb")).select(F.greatest("ida", "idb").alias("hi"), F.least("ida", "idb").alias("lo"), "sim")
        within = u.join(v, F.col("ha") == F.col("hb")).where("ida < idb").select(F.col("idb").alias("hi"), F.col("ida").alias("lo"), F.lit(1.0).alias("sim"))
        return across.unionByName(within).select(F.col("lo").alias("a"), F.col("hi").alias("b"), "sim")

    for t in floors:
        found = stage(pairs(similar(sets, sets, t, F.col("a") < F.col("b"))).orderBy(*best).limit(k), "top-pairs")
        if found.count() >= k:
            return found.orderBy(*best)
    exploded = sets.select(F.col("h").alias("id"), F.col("n").alias("size"), F.explode("gs").alias("g"))
    return pairs(jaccard(exploded, exploded).where("a < b")).orderBy(*best).limit(k)
