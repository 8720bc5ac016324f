"""Document fingerprints: MinHash over word shingles by universal hash permutations in numpy, bands joined in Spark.

A shingle's 64-bit hash x goes through a * x + b (mod 2**64, odd a) for each permutation; 16 bits of the least value,
from below its leading zeros (a long text's least values are small numbers), are a slot. The share of equal slots of two fingerprints estimates the Jaccard similarity of their shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, stage, text_slices

_MIX = np.uint64(0x9E3779B97F4A7C15)


class MinHasher:
    def __init__(self, permutations: int = 128, words: int = 5, seed: int = 1, cache_entries: int = 500_000):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, permutations, np.uint64)
        self.order = rng.integers(0, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)
        self.words, self.cache_entries, self.known = words, cache_entries, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct hashes of the shingles: A-Z lower-cased, words between ASCII blanks; fewer words: the whole sequence."""
        tokens = text.encode("utf-8", "replace").lower().split() if text else []
        if not tokens:
            return np.empty(0, np.uint64)
        known = self.known
        missing = {w for w in tokens if w not in known}
        if missing:
            if len(known) + len(missing) > self.cache_entries:
                known.clear()
                missing = set(tokens)
            known.update((w, xxhash.xxh64_intdigest(w)) for w in missing)
        x = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        k = min(self.words, len(x))
        n = len(x) - k + 1
        h = np.full(n, np.uint64(k))
        for i in range(k):
            h += x[i : i + n] * self.order[i]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return np.unique(h)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """uint16 slots; no shingles: every slot is the largest."""
        least = np.full(len(self.a), np.uint64(2**64 - 1))
        for i in range(0, len(hashes), 1024):
            h = hashes[i : i + 1024, None] * self.a
            h += self.b
            np.minimum(least, h.min(0), out=least)
        return (least >> np.uint64(16)).astype(">u2")

    def of(self, text: str | None) -> np.ndarray:
        return self.signature(self.shingles(text))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(x == y))


def load(permutations: int, words: int, seed: int) -> MinHasher:
    return held(("minhash", permutations, words, seed), lambda: MinHasher(permutations, words, seed))


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many of the next text (or all it has)."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


_OUT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprints_with_next(df: DataFrame, permutations: int = 128, words: int = 5, seed: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex), near_edited, near_next.

    The next document is the one below in descending key (nulls last, equal keys by the text's hash); the lowest one's
    is the first. Texts are dealt by ranges of the key and read in order, one pass a partition; each partition's first
    and last row are kept aside and the last rows get their next text from the partition after. Null text: empty; its
    fingerprint is that of no shingles. One row: it is its own next. Repeated rows follow each other. Other columns
    aren't read. Empty table: no rows.
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("_tie", F.xxhash64("t")).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie"), F.col("_row")]  # rows equal in all are dealt too
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie", "_row")

    def record(hasher: MinHasher, this: str, sig: np.ndarray, after: str, after_sig: np.ndarray):
        new = edited(this, after)
        new_sig = sig if new == this else hasher.of(new)
        return (len(this), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), sig.tobytes(), new_sig.tobytes(), likeness(sig, new_sig), likeness(sig, after_sig))

    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def table(ids: list, records: list, role: list, part: list, texts: list, id_type) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*records) if records else [[]] * 6, types)]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns, pa.array(role, pa.int32()), pa.array(part, pa.int64()), pa.array(texts, pa.string())], ["doc_id", *names, "role", "part", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, part = load(permutations, words, seed), TaskContext.get().partitionId()
        last, id_type, nothing = None, None, (0, "", b"", b"", 0.0, 0.0)
        for batch in chain.from_iterable(map(text_slices, batches)):
            id_type = batch.column(0).type
            ids, records = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sig = hasher.of(t)
                if last is None:
                    yield table([i], [nothing], [1], [part], [t], id_type)
                else:
                    ids.append(last[0])
                    records.append(record(hasher, last[1], last[2], t, sig))
                last = (i, t, sig)
            yield table(ids, records, [0] * len(ids), [part] * len(ids), [None] * len(ids), id_type)
        if last is not None:
            yield table([last[0]], [nothing], [2], [part], [last[1]], id_type)

    staged = stage(sorted_rows.mapInArrow(run, f"doc_id {kind}, {_OUT}, role int, part long, t string"), "fingerprints")
    heads = staged.where("role = 1").select(F.col("part").alias("head_part"), F.col("t").alias("after"))
    parts = staged.where("role = 1").select("part")  # one row a partition
    follow = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(1)))).alias("head_part"))
    tails = staged.where("role = 2").select("doc_id", "part", "t").join(follow, "part").join(heads, "head_part").select("doc_id", "t", "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = load(permutations, words, seed)
        for batch in chain.from_iterable(map(text_slices, batches)):
            ids, texts, after = (batch.column(k).to_pylist() for k in range(3))
            records = [record(hasher, t, hasher.of(t), a, hasher.of(a)) for t, a in zip(texts, after)]
            yield table(ids, records, [0] * len(ids), [0] * len(ids), [None] * len(ids), batch.column(0).type).select(["doc_id", *names])

    done = staged.where("role = 0").select("doc_id", *names).unionByName(tails.mapInArrow(finish, f"doc_id {kind}, {_OUT}"))
    hexed = [F.lower(F.hex(c)).alias(c) if "fingerprint" in c else F.col(c) for c in names]
    return done.select(F.col("doc_id").alias(key), *hexed)
