"""Phrase collocation mining: a merged count-min sketch finds what can be frequent, a second pass counts only that, exactly.

First pass: each task reduces its words, phrases included, to counters of a sketch of `depth` rows, and gives the counters it
touched; the sketches are merged by ranges of counters, saturating at min_count. A counter is never below the count of
anything that falls on it, so an n-gram with a row under min_count is not frequent, for certain. Second pass: the n-grams
that all rows let through are counted by their text, so what the sketch overestimates is dropped by its exact count and
nothing frequent is lost. Then phrases are scored by their weakest cut and those inside a longer phrase are subsumed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, salted_join, stage, text_slices, unstage

#: What ends a piece, and what separates words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END = b"\xff"  # in no UTF-8 text: stands between pieces
_CLASSES = bytes(10 if c in PIECE_ENDS else 32 if c in BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROWS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)  # odd multipliers
_STEP = np.uint64(0x2545F4914F6CDD1D)
_GAP = np.iinfo(np.uint16).max


def marked(text: str) -> bytes:
    """The text in UTF-8 with A-Z lower-cased, blanks as spaces, and a token of its own at the end of each piece and of the text."""
    return text.encode("utf-8", "replace").translate(_CLASSES).replace(b"\n", b" \xff ") + b" \xff "


class Grams:
    """The n-grams of one run of words: distinct ones with their counts, first places and hashes."""

    def __init__(self, words: list[bytes], lang: str, longest: int, own: int):
        """own: only n-grams that start at one of the first `own` places count; the words after belong to the next run."""
        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.words = words
        ids = coded.indices.to_numpy().astype(np.int64)
        vocabulary = coded.dictionary.to_pylist()
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in vocabulary], np.uint64)
        bits = max(1, len(vocabulary)).bit_length()
        inside = ids != vocabulary.index(_END) if _END in vocabulary else np.ones(len(ids), bool)
        self.total = int(inside[:own].sum())
        self.found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # words, counts, first places, hashes
        code, h, ok = ids, hashes[ids], inside
        for k in range(1, longest + 1):
            if k > 1:
                if k * bits > 63:  # number the shorter n-grams anew so that the pair fits
                    _, code = np.unique(code, return_inverse=True)
                    if len(code) and (int(code.max()) + 1) << bits >= 1 << 63:
                        raise ValueError("a run of words is too long")
                m = len(ids) - k + 1
                if m <= 0:
                    break
                code = (code[:m] << bits) | ids[k - 1 :]
                h = (h[:m] ^ (h[:m] >> np.uint64(29))) * _STEP + hashes[ids[k - 1 :]]
                ok = ok[:m] & inside[k - 1 :]
            at = np.flatnonzero(ok[:own])
            _, first, counts = np.unique(code[at], return_index=True, return_counts=True)
            self.found.append((k, counts, at[first], h[at[first]]))

    def phrase(self, place: int, k: int) -> str:
        return b" ".join(self.words[place : place + k]).decode()


def counters(h: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    """The counter of each hash in a row of the sketch."""
    x = (h ^ (h >> np.uint64(31))) * _ROWS[row]
    x = (x ^ (x >> np.uint64(27))) * _ROWS[row]
    return (x >> np.uint64(64 - width_bits)).astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], longest: int, words: int = 1 << 18) -> Iterator[tuple[str, Grams]]:
    """(lang, n-grams) over batches of (lang, text): about `words` words at a time, of whole texts of any length.

    Texts wait as bytes and become words when there are enough of them, so a task holds the words of one run only.
    """
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def grams(lang: str) -> Iterator[tuple[str, Grams]]:
        have = b"".join(waiting.pop(lang)).split()
        del size[lang]
        for at in range(0, len(have), words):  # a run sees the first words of the next, so n-grams across their border count once
            yield lang, Grams(have[at : at + words + longest - 1], lang, longest, words)

    for batch in batches:
        for piece in text_slices(batch, 4 << 20):
            for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                whole = marked(text)
                waiting.setdefault(lang, []).append(whole)
                size[lang] = size.get(lang, 0) + len(whole)
                if size[lang] >= 5 * words:
                    yield from grams(lang)
            if len(waiting) > 64 and sum(size.values()) > 5 * words:  # very many languages: none waits for long
                for lang in list(waiting):
                    yield from grams(lang)
    for lang in list(waiting):
        yield from grams(lang)


def pack(at: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Rising places and their values as 16-bit steps; a longer step is filled up by places of value 0."""
    gaps = np.diff(at, prepend=-1)
    extra = (gaps - 1) // _GAP
    if extra.any():
        where = np.repeat(np.arange(len(at)), extra)
        gaps = gaps - extra * _GAP
        return np.insert(gaps, where, _GAP).astype("<u2").tobytes(), np.insert(n, where, 0).astype(np.uint8).tobytes()
    return gaps.astype("<u2").tobytes(), n.astype(np.uint8).tobytes()


def unpack(steps: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(steps, "<u2").astype(np.int64)) - 1, np.frombuffer(n, np.uint8)


def merged_sketch(texts: DataFrame, longest: int, least: int, width_bits: int, depth: int, range_bits: int) -> DataFrame:
    """row, range, bits: which counters of each row reach `least`, in ranges of 2**range_bits counters; ranges that no text touches are absent."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams in runs(batches, longest):
            h, n = (np.concatenate([f[i] for f in grams.found]) for i in (3, 1))
            for row in range(depth):
                c = counters(h, row, width_bits)
                order = np.argsort(c, kind="stable")
                c, m = c[order], n[order]
                new = np.flatnonzero(np.diff(c, prepend=-1))
                if not len(new):
                    continue
                c, m = c[new], np.minimum(np.add.reduceat(m, new), least)
                which = c >> range_bits
                cuts = np.flatnonzero(np.diff(which, prepend=-1))
                packed = [pack(c[a:b] & ((1 << range_bits) - 1), m[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(c)])]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(cuts), pa.int32()), pa.array(which[cuts].astype(np.int32)), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["row", "range", "steps", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(1 << range_bits, np.uint8)

        def passed() -> pa.RecordBatch:
            bits = zlib.compress(np.packbits(sums >= least, bitorder="little").tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bits], pa.binary())], ["row", "range", "bits"])

        for batch in batches:
            for row, part, steps, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (row, part) != now:
                    if now is not None:
                        yield passed()
                    now = (row, part)
                    sums[:] = 0
                at, m = unpack(steps, n)
                real = m > 0
                at = at[real]
                sums[at] = np.minimum(sums[at].astype(np.int16) + m[real], least)
        if now is not None:
            yield passed()

    touched = texts.mapInArrow(build, "row int, range int, steps binary, n binary")
    return touched.repartition("row", "range").sortWithinPartitions("row", "range").mapInArrow(merge, "row int, range int, bits binary")


class Sieve:
    """Which counters reach the least count, a bit each."""

    def __init__(self, rows: list[tuple[int, int, bytes]], depth: int, width_bits: int, range_bits: int):
        self.width_bits = width_bits
        self.bits = np.zeros((depth, max(1 << width_bits, 1 << range_bits) // 8), np.uint8)
        size = (1 << range_bits) // 8
        for row, part, bits in rows:
            self.bits[row, part * size : (part + 1) * size] = np.frombuffer(zlib.decompress(bits), np.uint8)

    def passes(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for row, bits in enumerate(self.bits):
            c = counters(h, row, self.width_bits)
            ok &= (bits[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
        return ok


def frequent_ngrams(df: DataFrame, longest: int = 3, least: int = 10, depth: int = 2, most_width_bits: int = 30, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Staged: (lang, phrase, k, f) of all n-grams of 1..longest words with f >= least, exactly; and (lang, n) of all words.

    The sketch has about a counter for every 8 bytes of text, up to 2**most_width_bits a row; the bits of the counters that
    pass (128 MB a row at most, whatever the corpus) are what each task of the second pass gets. Beyond that width more
    infrequent n-grams pass and are dropped by their exact counts: results stay the same.
    """
    if not 1 <= least <= 255 or not 1 <= longest or not 1 <= depth <= len(_ROWS):
        raise ValueError("least has to be in [1, 255], depth in [1, 4], longest 1 or more")
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    width_bits = min(most_width_bits, max(16, (int(size) // 8).bit_length()))
    range_bits = max(12, min(20, width_bits - 8))
    sketch = stage(merged_sketch(texts, longest, least, width_bits, depth, range_bits), "phrase-sketch")
    rows = [(r["row"], r["range"], bytes(r["bits"])) for r in sketch.collect()]  # compressed bits: 2**width_bits / 8 bytes a row at most
    shared = df.sparkSession.sparkContext.broadcast(rows)
    name = sketch.staged_at
    del rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = held(("phrases", name), lambda: Sieve(shared.value, depth, width_bits, range_bits))
        for language, grams in runs(batches, longest):
            phrases, ks, ns = [None], [0], [grams.total]
            for k, counts, first, h in grams.found:
                ok = np.flatnonzero(sieve.passes(h))
                phrases += [grams.phrase(p, k) for p in first[ok].tolist()]
                ks += [k] * len(ok)
                ns += counts[ok].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(ks), pa.string()), pa.array(phrases, pa.string()), pa.array(ks, pa.int32()), pa.array(ns, pa.int64())], ["lang", "phrase", "k", "f"])

    counted = texts.mapInArrow(count, "lang string, phrase string, k int, f long").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    kept = stage(counted.where((F.col("f") >= least) | F.col("phrase").isNull()), "phrase-counts")
    shared.unpersist()
    unstage(sketch)
    totals = kept.where("phrase is null").select("lang", F.col("f").alias("n"))
    return kept.where("phrase is not null"), totals


def collocations(df: DataFrame, longest: int = 3, least: int = 10, most: int = 2000, inside_percent: int = 50, depth: int = 2, most_width_bits: int = 30, part_rows: int = 50_000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first `most` phrases of 2..longest words.

    a, l and r are the counts of the phrase and of the two parts of its weakest cut, n the language's words, score
    floor(1000000 * a * a / (l * r)) in decimals. Phrases inside a longer frequent phrase with at least inside_percent
    of their count are dropped. Order: score, a (both falling), phrase. Null lang: `und`; null text: empty. A text without
    a frequent phrase gives nothing; repeated rows count as often as they occur; other columns aren't read; empty table: no rows.
    """
    if most * 8 > part_rows:
        part_rows = most * 8
    counts, totals = frequent_ngrams(df, longest, least, depth, most_width_bits, text, lang)
    candidates = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    key = lambda phrase: F.concat(phrase, F.lit("\n"), F.col("lang"))  # noqa: E731  no phrase holds a line end
    joined = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "k", "a", cut)
    asked = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(F.struct(F.lit(0).alias("side"), key(joined(F.lit(1), F.col("cut"))).alias("key")), F.struct(F.lit(1).alias("side"), key(joined(F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("key")))).alias("x")).select("lang", "phrase", "a", "cut", "x.*")
    asked = stage(asked, "phrase-parts")
    weights = stage(asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "phrase-part-uses")
    met = salted_join(asked, counts.select(key(F.col("phrase")).alias("key"), "f"), "key", weights, ["phrase", "cut"])
    sides = met.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    # a <= l and a <= r, so the score is at most 1000000; squares of counts fit a decimal
    square = (F.col("a").cast("decimal(16,0)") * F.col("a").cast("decimal(16,0)")).cast("decimal(32,0)")
    scored = sides.withColumn("score", F.call_function("div", (square * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,0)"), (F.col("l").cast("decimal(16,0)") * F.col("r").cast("decimal(16,0)")).cast("decimal(38,0)")))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.score", "w.l", "w.r")
    size_start = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> struct(m, s))))")
    inside = candidates.where("k > 2").select("lang", "a", words.alias("ws"), F.explode(size_start).alias("x"))
    inside = inside.select("lang", F.array_join(F.slice("ws", F.col("x.s"), F.col("x.m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent)).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, counts.count() // part_rows)
    while parts > 1:  # a language's phrases are ranked in parts of bounded size first, so no task sorts them all
        salt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        left = left.withColumn("place", F.row_number().over(salt)).where(F.col("place") <= most).drop("place")
        parts = parts * most * 4 // part_rows
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with pieces as (
    select lang, row_number() over () as piece, p from (
        select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents)
), lists as (
    select lang, piece, regexp_extract_all(p, '[^\x20\x09]+') as ws from pieces
), w as (
    select lang, piece, unnest(ws) as w1, generate_subscripts(ws, 1) as pos from lists
), g as (
    select lang, w1, lead(w1) over s as w2, lead(w1, 2) over s as w3 from w window s as (partition by piece order by pos)
), grams as (
    select lang, w1 as phrase, 1 as k, count(*) as f from g group by 1, 2
    union all select lang, w1 || ' ' || w2, 2, count(*) from g where w2 is not null group by 1, 2
    union all select lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) from g where w3 is not null group by 1, 2
), freq as materialized (select lang, phrase, k, cast(f as hugeint) as f, string_split(phrase, ' ') as ws from grams where f >= 10
), totals as (select lang, count(*) as n from w group by lang
), cuts as (
    select lang, phrase, f as a, 1 as cut, ws[1] as p, array_to_string(ws[2:], ' ') as q from freq where k >= 2
    union all select lang, phrase, f, 2, ws[1] || ' ' || ws[2], ws[3] from freq where k = 3
), scored as (
    select c.lang, c.phrase, c.a, cut, x.f as l, y.f as r, (c.a * c.a * 1000000) // (x.f * y.f) as score
    from cuts c join freq x on x.lang = c.lang and x.phrase = c.p join freq y on y.lang = c.lang and y.phrase = c.q
), weakest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), longer as (
    select lang, phrase, max(a) as a from (
        select lang, ws[1] || ' ' || ws[2] as phrase, f as a from freq where k = 3
        union all select lang, ws[2] || ' ' || ws[3], f from freq where k = 3) group by 1, 2
), kept as (
    select w.* from weakest w left join longer x on x.lang = w.lang and x.phrase = w.phrase where x.a is null or 100 * x.a < 50 * w.a
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000
"""
