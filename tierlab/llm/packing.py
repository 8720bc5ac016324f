"""Packing into fixed-length sequences as a cutting-stock problem, by column generation.

Documents are cut into full sequences and one tail; tails are counted by length class (lengths rounded up to a multiple
of `width`). Over this histogram a linear program picks patterns (how many tails of each class share a sequence) with
the fewest sequences; new patterns are priced by an unbounded knapsack over the program's duals. The solution is
rounded down, ranked tails fill the patterns' slots, and the few tails left over (under one sequence for each pattern of
the basis, whatever the corpus's size) are laid end to end and cut, the last stretch into powers of two.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import global_rank, held, stage, text_slices

#: What the tokenizer drops as white space; str.split() drops these and four separators more.
WHITE = re.compile("[\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
SEPARATORS = re.compile("[\\x1c-\\x1f]")
#: Fixed value: how the tokenizer cuts a word in lower case.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
LONGEST_CACHED = 48
#: Bytes of text that a task holds as Python strings at once.
SLICE = 4 << 20


class PieceIds(dict):
    """Packed ids of the tokenizer's own pieces of a word; full, it keeps what it has: common pieces come early."""

    def __init__(self, tokenizer: Tokenizer, most: int):
        self.model, self.most = tokenizer.model, most
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these stand for themselves
        self.letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}

    def __missing__(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            ids = self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.letters))
        else:
            ids = self.model.tokenize(piece)
        packed = array("I", [t.id for t in ids]).tobytes()
        if len(self) < self.most and len(piece) <= LONGEST_CACHED:
            self[piece] = packed
        return packed


class KnownWords(dict):
    """Packed ids of runs of text between white space (no token crosses it); bounded like the pieces.

    Words of Latin-1 characters, where lower case, composition and character classes are the same everywhere, are cut
    here; others, and words that hold a special token or a separator, go through the whole tokenizer.
    """

    def __init__(self, tokenizer: Tokenizer, most: int):
        self.tokenizer, self.most, self.pieces = tokenizer, most, PieceIds(tokenizer, most // 2)
        special = "|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values())
        self.other = re.compile(f"[^\\x00-\\xff]|[\\x1c-\\x1f]{special and '|'}{special}")

    def __missing__(self, word: str) -> bytes:
        if self.other.search(word):
            packed = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            packed = b"".join(map(self.pieces.__getitem__, PIECES.findall(word.lower())))
        if len(self) < self.most and len(word) <= LONGEST_CACHED:
            self[word] = packed
        return packed


class WordIds:
    def __init__(self, path: str, end_id: int, cache_entries: int = 400_000):
        self.known = KnownWords(Tokenizer.from_file(path), cache_entries)
        self.end = array("I", [end_id]).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text and end_id."""
        packed = self.known.__getitem__
        for t in texts:
            words = (WHITE.split(t) if SEPARATORS.search(t) else t.split()) if t else []
            yield np.frombuffer(b"".join(map(packed, words)) + self.end, "<u4")


def load(path: str, end_id: int) -> WordIds:
    return held(("packing", path, end_id), lambda: WordIds(path, end_id))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of items of sizes 1..len(value), each as often as it fits, and how often each is taken."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    back = value[::-1]
    m = len(value)
    for c in range(1, capacity + 1):
        k = min(c, m)
        gain = best[c - k : c] + back[m - k :]
        i = int(gain.argmax())
        if gain[i] > best[c - 1] + 1e-12:
            best[c], last[c] = gain[i], k - i
        else:
            best[c], last[c] = best[c - 1], 0
    taken, c = np.zeros(m), capacity
    while c > 0:
        if last[c]:
            taken[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), taken


def column_generation(demand: np.ndarray, capacity: int, gap: float = 1e-3, most_rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, for demand[s - 1] items of size s; each pattern counts its items by size.

    Revised simplex on the demanded sizes, from one pattern for each size. Stops as soon as the duals prove that the
    number of sequences is within `gap` of the least (or after most_rounds: any basis on the way is a valid packing).
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return []
    d = demand[sizes - 1].astype(float)
    patterns = np.diag(np.floor(capacity / sizes))
    inverse = np.diag(1 / np.diag(patterns))
    x = inverse @ d
    for _ in range(most_rounds):
        duals = inverse.sum(0)
        value = np.zeros(capacity)
        value[sizes - 1] = np.maximum(duals, 0)
        best, taken = knapsack(value, capacity)
        if best <= 1 + 1e-9 or x.sum() <= (duals @ d) / best * (1 + gap):
            break
        column = taken[sizes - 1]
        move = inverse @ column
        ok = move > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, move, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        x = np.maximum(x - step * move, 0)
        x[r] = step
        inverse[r] /= move[r]
        others = move.copy()
        others[r] = 0
        inverse -= np.outer(others, inverse[r])
        patterns[:, r] = column
    out = []
    for j in range(m):
        full = np.zeros(capacity)
        full[sizes - 1] = patterns[:, j]
        out.append((full, float(x[j])))
    return out


def cut_at(total: int, length: int) -> list[int]:
    """Where a stream of `total` ids is cut: each `length`, and the rest into falling powers of two."""
    cuts = list(range(0, total - total % length + 1, length))
    for k in range(length.bit_length(), -1, -1):
        if total % length >> k & 1:
            cuts.append(cuts[-1] + (1 << k))
    return cuts


def pack(df: DataFrame, path: str | None = None, length: int = 2048, end_id: int = 1, width: int = 4, bucket_rows: int = 2000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and end_id; null or empty text: end_id alone. Every id is in exactly one
    piece. Equal lengths are ranked in buckets, so a length that a third of the rows share is dealt to many tasks.
    Repeated rows and null keys are documents like others. What goes to the driver: one count for each length class.
    Leftovers are at most one sequence for each class, so they may be laid end to end in one task; their documents are
    tokenised again to cut them. Other columns aren't read. Empty table: no rows.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    spark = df.sparkSession
    kind = df.select(key).schema[0].dataType.simpleString()
    source = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path, end_id)
        for batch in chain.from_iterable(text_slices(b, SLICE) for b in batches):
            ids = words.encode(batch.column(1).to_pylist())
            rows = [(i, s, min(length, len(x) - s), crc(x[s : s + length]), len(x)) for i, x in enumerate(ids) for s in range(0, len(x), length)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5))], ["doc_id", "md5", "start", "length", "ids_crc32", "doc_tokens"])

    pieces = source.select("doc_id", "t", F.md5("t").alias("md5")).mapInArrow(cut, f"doc_id {kind}, md5 string, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = stage(pieces.withColumn("cls", F.ceil(F.col("length") / width).cast("int")), "pieces")
    capacity = length // width
    counts = {r["cls"]: r["n"] for r in pieces.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    demand = np.zeros(capacity, np.int64)
    for c, n in counts.items():
        demand[c - 1] = n
    slots, sequences, filled = [], 0, np.zeros(capacity, np.int64)
    for pattern, times in column_generation(demand, capacity):
        times = int(times + 1e-6)
        taken = pattern.astype(np.int64)
        if times:
            for c in np.flatnonzero(taken):
                slots.append((int(c) + 1, int(filled[c]), int(filled[c] + times * taken[c]), int(taken[c]), sequences))
                filled[c] += times * taken[c]
            sequences += times
    biggest = max(counts.values(), default=1)
    buckets = min(10_000, max(1, -(-biggest // bucket_rows)))  # at most so many counts a class
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "md5", "start"), F.lit(buckets)).cast("int"))
    ranked = stage(global_rank(salted, [F.col("doc_id"), F.col("md5"), F.col("start")], F.col("_salt"), "_rank", ["cls"]).drop("_salt"), "ranked-pieces")
    table = spark.createDataFrame(slots, "c int, low long, high long, taken long, base long")
    placed = ranked.join(F.broadcast(table), (F.col("cls") == F.col("c")) & (F.col("_rank") > F.col("low")) & (F.col("_rank") <= F.col("high")), "left")
    placed = stage(placed.withColumn("sequence_id", F.col("base") + F.expr("(_rank - 1 - low) div taken")).drop("c", "low", "high", "taken", "base"), "placed-pieces")
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy("cls", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    in_patterns = placed.where("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    left = placed.where("sequence_id is null")
    running = Window.orderBy("cls", "_rank").rowsBetween(Window.unboundedPreceding, -1)  # under one sequence for each class: bounded
    left = stage(left.withColumn("_at", F.coalesce(F.sum("length").over(running), F.lit(0))).select("doc_id", "md5", "start", "length", "doc_tokens", "_at"), "leftover-pieces")
    total = left.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    cuts = cut_at(total, length)
    wanted = left.select(F.col("doc_id").alias("_id"), F.col("md5").alias("_md5")).distinct()
    again = source.withColumn("md5", F.md5("t")).join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("md5") == F.col("_md5")), "left_semi").dropDuplicates(["doc_id", "md5"])
    spread = left.select(F.col("doc_id").alias("_id"), F.col("md5").alias("_md5"), "start", "length", "doc_tokens", "_at")
    again = again.join(F.broadcast(spread), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("md5") == F.col("_md5"))).select("doc_id", "t", "start", "length", "doc_tokens", "_at")

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path, end_id)
        for batch in chain.from_iterable(text_slices(b, SLICE) for b in batches):
            rows = []
            for i, (ids, start, n, doc_tokens, at) in enumerate(zip(words.encode(batch.column(1).to_pylist()), *(batch.column(k).to_pylist() for k in range(2, 6)))):
                a = at
                while a < at + n:
                    q = int(np.searchsorted(cuts, a, "right"))
                    b = min(cuts[q], at + n)
                    s = start + a - at
                    rows.append((i, s, b - a, crc(ids[s : s + b - a]), doc_tokens, sequences + q - 1, a - cuts[q - 1]))
                    a = b
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 7))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = in_patterns.select(*columns).unionByName(again.mapInArrow(recut, schema))
    return out.withColumnRenamed("doc_id", key)
