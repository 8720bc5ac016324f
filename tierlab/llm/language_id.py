"""Language ID by a linear-chain conditional random field over words, for texts that switch languages.

Each word has affix, character n-gram and lexicon features; learned transitions make neighbours agree, so a switch
costs. Forward-backward gives every word's language posterior; a document takes the language with the most posterior
mass over its words with letters. Trained on the driver, on a bounded sample of labelled documents from which
code-switched sequences are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

TABLE = 1 << 15


class HashedNames(dict):
    """Feature ids by name; those of short names are kept, up to a bound."""

    def __missing__(self, name: str) -> int:
        i = zlib.crc32(name.encode("utf-8", "replace")) % TABLE
        if len(name) <= 5 and len(self) < 200_000:
            self[name] = i
        return i


_ID_OF = HashedNames().__getitem__


#: A longer run of characters is read as several words, each with features of its own.
LONGEST = 24


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed ids of the features of a lower-case word."""
    marked = f"^{word}$"
    names = ["p" + word[:1], "p" + word[:2], "p" + word[:3], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:], "s" + word[-4:]]
    names += map(add, marked, marked[1:])
    names += map(add, map(add, marked, marked[1:]), marked[2:])
    if (langs := lexicon.get(word)) is not None:
        names.append(f"l{langs}")
    return list(map(_ID_OF, names))


class ChainCRF:
    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        n = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.weight, self.move, self.first = np.zeros((TABLE, n)), np.zeros((n, n)), np.zeros(n)
        self.row_of: dict[str, int] = {}
        self.rows, self.lettered = np.zeros((1024, n), np.float32), np.zeros(1024, bool)

    def __getstate__(self):
        return self.__dict__ | {"row_of": {}, "rows": np.zeros((1024, len(self.langs)), np.float32), "lettered": np.zeros(1024, bool), "weight": self.weight.astype(np.float32)}

    def posteriors(self, emission: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word posteriors, summed pair posteriors and the log normaliser; emission: position x sequence x language.

        Past a sequence's end positions are passed over (emission 0, no transition), and give posterior 0.
        """
        t_max, n, k = emission.shape
        top = emission.max(2, keepdims=True)
        e = np.exp(emission - top)
        a_move = np.exp(self.move)
        alive = np.arange(t_max)[:, None] < lengths
        alpha, beta = np.empty_like(e), np.empty_like(e)
        scale = np.ones((t_max, n))
        a = np.exp(self.first) * e[0]
        for t in range(t_max):
            if t:
                a = np.where(alive[t, :, None], (a @ a_move) * e[t], a)
            scale[t] = a.sum(1)
            a = a / scale[t][:, None]
            alpha[t] = a
        b = np.ones((n, k))
        pairs = np.zeros((k, k))
        for t in range(t_max - 1, -1, -1):
            beta[t] = b
            if t:
                on = alive[t]
                be = b * e[t]
                if self.training:
                    z = np.where(on, 1 / scale[t], 0.0)
                    pairs += a_move * ((alpha[t - 1] * z[:, None]).T @ be)
                b = np.where(on[:, None], (be @ a_move.T) / scale[t][:, None], b)
        post = alpha * beta
        post /= np.maximum(post.sum(2, keepdims=True), 1e-30)
        post[~alive] = 0
        return post, pairs, (np.log(scale) + np.where(alive, top[:, :, 0], 0)).sum(0)

    training = False

    def fit(self, sequences: list[tuple[list[str], list[int]]], epochs: int = 4, batch: int = 64, rate: float = 0.5, decay: float = 1e-6, seed: int = 3) -> None:
        """Adagrad on the conditional likelihood of the labels."""
        self.training = True
        known: dict[str, list[int]] = {}
        rng = np.random.default_rng(seed)
        k = len(self.langs)
        g_w, g_m, g_f = np.full(self.weight.shape, 1e-6), np.full(self.move.shape, 1e-6), np.full(k, 1e-6)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // batch)):
                chosen = [sequences[i] for i in part]
                lengths = np.array([len(w) for w, _ in chosen])
                t_max = lengths.max()
                emission, gold = np.zeros((t_max, len(chosen), k)), np.zeros((t_max, len(chosen), k))
                ids, at = [], []
                for j, (words, labels) in enumerate(chosen):
                    for t, (w, y) in enumerate(zip(words, labels)):
                        if w not in known:
                            known[w] = features(w, self.lexicon)
                        ids.append(known[w])
                        at.append(t * len(chosen) + j)
                        gold[t, j, y] = 1
                flat = np.fromiter(chain.from_iterable(ids), np.int64)
                owner = np.repeat(np.array(at), [len(x) for x in ids])
                for c in range(k):
                    emission.reshape(-1, k)[:, c] = np.bincount(owner, self.weight[flat, c], t_max * len(chosen))
                post, pairs, _ = self.posteriors(emission, lengths)
                error = (gold - post).reshape(-1, k)
                grad = np.stack([np.bincount(flat, error[owner, c], TABLE) for c in range(k)], 1) / len(chosen) - decay * self.weight
                seen_pairs = np.einsum("tni,tnj->ij", gold[:-1], gold[1:])
                for value, total, g in ((self.weight, g_w, grad), (self.move, g_m, (seen_pairs - pairs) / len(chosen)), (self.first, g_f, (gold[0] - post[0]).mean(0))):
                    total += g * g
                    value += rate * g / np.sqrt(total)
        self.training = False

    def rows_of(self, words: list[str], most: int = 400_000) -> np.ndarray:
        """Rows of self.rows with the words' emissions, and of self.lettered (has it a letter); kept over documents, emptied when `most` words are known."""
        row_of = self.row_of
        missing = {w for w in words if w not in row_of}
        if len(row_of) + len(missing) > most:
            row_of.clear()
            missing = set(words)
        if missing:
            need = len(row_of) + len(missing)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((need, self.rows.shape[1]), np.float32)])
                self.lettered = np.concatenate([self.lettered, np.zeros(need, bool)])
            ids = [features(w, self.lexicon) for w in missing]
            ends = np.cumsum([len(x) for x in ids])
            flat = np.fromiter(chain.from_iterable(ids), np.int64, ends[-1])
            self.rows[len(row_of) : need] = np.add.reduceat(self.weight[flat], np.r_[0, ends[:-1]])
            self.lettered[len(row_of) : need] = [w.isalpha() or any(map(str.isalpha, w)) for w in missing]
            row_of.update(zip(missing, range(len(row_of), need)))
        return np.fromiter(map(row_of.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None], most_cells: int = 200_000) -> list[tuple[str, float]]:
        """The language with the most posterior mass over the words that hold a letter, and its share; und without any."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        todo = []
        for i, t in enumerate(texts):
            words = words_of(t) if t else []
            if any(map(str.isalpha, t or "")):
                at = self.rows_of(words)
                todo.append((len(words), i, self.rows[at], self.lettered[at]))
        todo.sort(key=lambda x: x[0])
        while todo:
            longest = todo[-1][0]
            group = todo[-max(1, most_cells // longest) :]
            del todo[-len(group) :]
            lengths = np.array([g[0] for g in group])
            emission = np.zeros((longest, len(group), len(self.langs)), np.float32)
            counted = np.zeros((longest, len(group)), bool)
            for j, (n, _, rows, lettered) in enumerate(group):
                emission[:n, j] = rows
                counted[:n, j] = lettered
            post = self.posteriors(emission, lengths)[0]
            mass = (post * counted[:, :, None]).sum(0)
            share = mass / mass.sum(1, keepdims=True)
            for j, (_, i, _, _) in enumerate(group):
                best = int(share[j].argmax())
                out[i] = (self.langs[best], float(min(1.0, share[j, best])))
        return out


def training_sequences(rows: list[tuple[str, str]], langs: list[str], seed: int = 3, words: int = 40, each: int = 4) -> list[tuple[list[str], list[int]]]:
    """Runs of about `words` words; a third of them go on in the words of another document, as code-switched text does."""
    rng = np.random.default_rng(seed)
    at = {lang: i for i, lang in enumerate(langs)}
    split = [(words_of(t), at[lang]) for t, lang in rows if t and t.split()]

    def stretch(i: int, n: int) -> tuple[list[str], list[int]]:
        text, y = split[i]
        s = int(rng.integers(0, max(1, len(text) - n + 1)))
        return text[s : s + n], [y] * len(text[s : s + n])

    out = []
    for i in range(len(split)):
        for _ in range(each):
            w, y = stretch(i, words)
            if rng.random() < 1 / 3:
                cut = int(rng.integers(1, len(w) + 1))
                w2, y2 = stretch(int(rng.integers(0, len(split))), words - cut)
                w, y = w[:cut] + w2, y[:cut] + y2
            out.append((w, y))
    return out


def spread(text: str, stretches: int, run: int) -> str:
    """Lower-case words of a text: all, or `stretches` runs of `run` words at even distances from its first to its last."""
    words = words_of(text)
    if len(words) > stretches * run:
        starts = [i * (len(words) - run) // max(1, stretches - 1) for i in range(stretches)]
        words = [w for s in starts for w in words[s : s + run]]
    return " ".join(words)


def train(df: DataFrame, docs_per_lang: int = 400, stretches: int = 16, run: int = 40, most_langs: int = 256, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ChainCRF | None:
    """A model from a bounded sample (the parameters are the bound): about docs_per_lang documents of each language, by a
    hash of key and text, and of a longer text `stretches` runs of `run` words spread over all of it. Copies of a row
    count once. Of more than most_langs labels those with the most documents are learned (ties by name), so a column of
    stray labels neither fills the driver nor the plan. None if no row has a label and a word."""
    named = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    counts = named.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(most_langs).collect()
    if not counts:
        return None
    shares = df.sparkSession.createDataFrame([(r["l"], min(1.0, docs_per_lang / r["n"])) for r in counts], "l string, share double")
    u = F.pmod(F.xxhash64(F.lit(11), F.coalesce("k", F.lit("")), "t"), F.lit(1 << 20)) / float(1 << 20)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            yield pa.RecordBatch.from_arrays([pa.array([spread(t, stretches, run) for t in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["t", "l"])

    chosen = named.join(F.broadcast(shares), "l").where(u < F.col("share")).dropDuplicates(["k", "t", "l"]).select("t", "l")
    rows = chosen.mapInArrow(sample, "t string, l string").collect()
    pairs = sorted((r["t"], r["l"]) for r in rows)
    langs = sorted({name for _, name in pairs})
    if not langs:
        return None
    seen: dict[str, Counter] = {name: Counter() for name in langs}
    for t, name in pairs:
        seen[name].update(set(t.split()))
    lexicon: dict[str, int] = {}
    for i, name in enumerate(langs):
        for w, n in seen[name].most_common(500):
            if n >= 3 and n > 4 * sum(seen[o][w] for o in langs if o != name):
                lexicon[w] = i
    model = ChainCRF(langs, lexicon)
    model.fit(training_sequences(pairs, langs))
    return model


def predict(df: DataFrame, model: ChainCRF | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of each whole text. Null text, or no letter: und, 0. No model: und for all."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a row of the feature table a language, and a lexicon of 500 words each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chain.from_iterable(map(text_slices, batches)):
            texts = batch.column(1).to_pylist()
            found = m.predict(texts) if m else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    src = df.select(F.col(key).alias("doc_id"), text)
    out = src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("doc_id", key)
