"""Quality classifier: ordinal cumulative-link regression on graded ratings, with shared weights over hashed text.

Grades are 0 (toxic), 1 (poor) and 2 (good). One weight vector w scores a text, ordered thresholds cut the score:
P(grade > j) = sigmoid(w.x - theta_j). The sum of these tail probabilities is the expected grade; the last one is what
selection looks at. Features are presences of hashed words and word beginnings, and binned text statistics; training is
follow-the-regularised-leader with an L1 term, so rare words get no weight and the model stays small.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, text_slices

TABLE = 1 << 20
#: Words; a longer run of letters is read as several, so that no letter goes unseen.
LETTERS = re.compile(r"[^\W\d_]{1,32}")
#: Signs that prose seldom has; the usual stops aren't among them.
MARKS = re.compile(r"[^\w\s.,;:'\"()?-]")
STARTS = (3, 4, 5, 6, 7, 8)


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % TABLE


def word_features(word: str) -> tuple[int, ...]:
    """A lower-case word and its beginnings."""
    return (_hash(f"w{word}"), *(_hash(f"b{word[:k]}") for k in STARTS if k < len(word)))


def text_features(text: str, words: list[str]) -> list[int]:
    """Binned statistics of the whole text: shares of symbols, capitals and digits, repetition, length."""
    n = max(len(text), 1)
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, text)) if text != text.lower() else 0
    digits = sum(map(str.isdigit, text))
    blanks = n - len(text.replace(" ", "").replace("\n", ""))
    tokens = text.split()
    top = Counter(tokens).most_common(1)[0][1] if tokens else 0
    same_before = sum(a == b for a, b in zip(tokens, tokens[1:]))
    stats = {
        "symbols": max(0, n - letters - digits - blanks) / n, "upper": upper / max(letters, 1), "digits": digits / n,
        "top": top / max(len(tokens), 1) if len(tokens) >= 20 else 0.0, "again": same_before / max(len(tokens) - 1, 1), "pipes": text.count("|") / n,
        "distinct": len(set(tokens)) / max(len(tokens), 1) if len(tokens) >= 20 else 1.0,
    }
    out = [_hash(f"#{k}{min(20, int(v * 40))}") for k, v in stats.items()]
    out += [_hash(f"@{k}{j}") for k, v in stats.items() for j in range(1, 11) if v >= j * 0.05]
    marks = Counter(MARKS.findall(text))
    out += [_hash(f"m{c}{j}") for c, k in marks.items() for j in range(min(8, k.bit_length()))]
    out.append(_hash(f"#length{min(12, int(np.log2(len(tokens) + 1)))}"))
    return out


@dataclass
class OrdinalModel:
    """weights: of the features that have any, by their id. thresholds rise."""

    weights: dict[int, float]
    thresholds: np.ndarray
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "known": {}}

    def score(self, text: str | None, most_known: int = 500_000) -> float:
        text = text or ""
        words = LETTERS.findall(text.lower())
        known, weights = self.known, self.weights
        distinct = set(words)
        missing = [w for w in distinct if w not in known]
        if len(known) + len(missing) > most_known:
            known.clear()
            missing = list(distinct)
        for w in missing:
            known[w] = tuple(i for i in word_features(w) if i in weights)
        ids = set(chain.from_iterable(map(known.__getitem__, distinct)))
        ids.update(i for i in text_features(text, words) if i in weights)
        return sum(weights[i] for i in sorted(ids))

    def tails(self, score: float) -> list[float]:
        """P(grade > j) for each threshold."""
        return (1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))).tolist()


def features(text: str | None) -> np.ndarray:
    text = text or ""
    words = LETTERS.findall(text.lower())
    ids = set(text_features(text, words))
    for w in set(words):
        ids.update(word_features(w))
    return np.fromiter(sorted(ids), np.int64, len(ids))


def fit(examples: list[tuple[np.ndarray, int]], grades: int = 3, epochs: int = 12, l1: float = 4.0, rate: float = 0.15, seed: int = 5) -> OrdinalModel:
    """Cumulative-link likelihood, weighted so that each grade counts alike in the mean; proximal steps by feature.

    Fewer than two grades among the examples: no weights, and thresholds that accept every text.
    """
    rng = np.random.default_rng(seed)
    z, n, w = np.zeros(TABLE), np.zeros(TABLE), np.zeros(TABLE)
    theta = np.linspace(-1.0, 1.0, grades - 1)
    wanted = [g for _, g in examples]
    if len(set(wanted)) < 2:
        return OrdinalModel({}, np.full(grades - 1, -20.0))
    balance = np.sqrt(len(wanted) / (grades * np.maximum(np.bincount(wanted, minlength=grades), 1)))
    seen = np.zeros(TABLE, np.int64)
    for ids, _ in examples:
        seen[ids] += 1
    common = seen >= 3
    flat, ends = np.empty(sum(len(ids) for ids, _ in examples), np.int32), [0]  # one block, so that the driver gets its memory back
    for ids, _ in examples:
        ids = ids[common[ids]]
        flat[ends[-1] : ends[-1] + len(ids)] = ids
        ends.append(ends[-1] + len(ids))
    del examples, seen, ids
    for _ in range(epochs):
        for i in rng.permutation(len(wanted)):
            ids, g = flat[ends[i] : ends[i + 1]].astype(np.intp), wanted[i]
            s = w[ids].sum()
            p = np.r_[1.0, 1 / (1 + np.exp(np.clip(theta - s, -30, 30))), 0.0]  # P(grade >= 0), ..., P(grade > last)
            slope = p * (1 - p)
            prob = max(p[g] - p[g + 1], 1e-9)
            d_score = balance[g] * (slope[g] - slope[g + 1]) / prob
            d_theta = np.zeros(grades - 1)
            if g > 0:
                d_theta[g - 1] -= balance[g] * slope[g] / prob
            if g < grades - 1:
                d_theta[g] += balance[g] * slope[g + 1] / prob
            theta = np.maximum.accumulate(np.clip(theta + 0.02 * np.clip(d_theta, -3, 3), -20, 20))
            grad = -float(np.clip(d_score, -3, 3))
            if abs(grad) < 1e-4:
                continue
            n_ids = n[ids]
            sigma = (np.sqrt(n_ids + grad * grad) - np.sqrt(n_ids)) / rate
            z[ids] += grad - sigma * w[ids]
            n[ids] = n_ids + grad * grad
            z_ids = z[ids]
            w[ids] = np.where(np.abs(z_ids) <= l1, 0.0, -(z_ids - np.sign(z_ids) * l1) / ((1 + np.sqrt(n[ids])) / rate))
    used = np.flatnonzero(w)
    return OrdinalModel({int(i): float(w[i]) for i in used}, theta)


def _examples(table: pa.Table) -> list[tuple[np.ndarray, int]]:
    """Features and grade of each row, in an order that doesn't depend on the rows' own; views on the table's memory."""
    ids = chain.from_iterable(table.column("ids").chunks)
    return sorted(((x.values.to_numpy(), g) for x, g in zip(ids, table.column("grade").to_pylist())), key=lambda e: (e[1], len(e[0]), e[0].tobytes()))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, key: str = "doc_id", text: str = "text") -> OrdinalModel:
    """A model from at most about most_rows labelled documents, drawn by a hash of the key (a documented bound).

    Grade 0: toxic = 1; 1: else quality = 0; 2: else quality = 1. Rows with a null in what decides are left out; of
    several ratings of a document the least counts. Without any example, or with one grade only, the model has no
    weights and thresholds that accept every text.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & F.col("toxic").isNotNull(), 2)
    rated = labels.select(F.col(key).alias("_id"), grade.alias("grade")).where("_id is not null and grade is not null").groupBy("_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    share = min(1.0, most_rows / max(n, 1))
    u = F.pmod(F.xxhash64(F.lit(17), "_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rated.where(u < share)
    src = docs.select(F.col(key).alias("_id"), F.col(text).alias("t"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            ids = [features(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["grade", "ids"])

    found = src.join(F.broadcast(chosen), "_id").select("grade", "t").mapInArrow(extract, "grade int, ids array<int>")
    return fit(_examples(found.toArrow()))


def rate(df: DataFrame, model: OrdinalModel, text: str = "text", keep: list[str] | None = None, least_tail: float = 0.5) -> DataFrame:
    """The columns in `keep` (default doc_id), expected_grade, p_clean (at least grade 1), p_good (grade 2), accepted.

    accepted: p_good >= least_tail. Null text counts as empty. A row's result depends on its text alone.
    """
    keep = keep or ["doc_id"]
    shared, token = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by the feature table
    src = df.select(*keep, F.col(text).alias("_t"))
    names = [*keep, "expected_grade", "p_clean", "p_good", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held(("quality", token), lambda: shared.value)
        for batch in chain.from_iterable(map(text_slices, batches)):
            tails = [m.tails(m.score(t)) for t in batch.column(len(keep)).to_pylist()]
            values = [[sum(t) for t in tails], [t[0] for t in tails], [t[-1] for t in tails]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(v, pa.float64()) for v in values), pa.array([t[-1] >= least_tail for t in tails], pa.bool_())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1])
    return src.mapInArrow(run, f"{fields}, expected_grade double, p_clean double, p_good double, accepted boolean")
