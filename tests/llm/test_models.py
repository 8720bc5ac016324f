"""The trained operators and fingerprints against plain implementations that share only the trained numbers."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tierlab.llm import language_id, quality, queries

SF = "/root/testdata/sf0.001"
M64 = 2**64 - 1


def brute_score(text, model):
    """The sum of the weights of a text's features."""
    crc = lambda name: zlib.crc32(name.encode("utf-8", "replace")) % quality.TABLE
    words = re.findall(r"[^\W\d_]{1,32}", text.lower())
    names = {f"w{w}" for w in words} | {f"b{w[:k]}" for w in words for k in range(3, 9) if k < len(w)}
    tokens, n = text.split(), max(len(text), 1)
    letters, digits = sum(len(w) for w in words), sum(c.isdigit() for c in text)
    most = max(Counter(tokens).values(), default=0)
    few = len(tokens) < 20
    stats = {
        "symbols": max(0, n - letters - digits - text.count(" ") - text.count("\n") - (len(text) == 0)) / n if text else 0.0, "upper": sum(c.isupper() for c in text) / max(letters, 1), "digits": digits / n,
        "top": 0.0 if few else most / len(tokens), "again": sum(a == b for a, b in zip(tokens, tokens[1:])) / max(len(tokens) - 1, 1), "pipes": text.count("|") / n, "distinct": 1.0 if few else len(set(tokens)) / len(tokens),
    }
    for k, v in stats.items():
        names.add(f"#{k}{min(20, int(v * 40))}")
        names |= {f"@{k}{j}" for j in range(1, 11) if v >= j * 0.05}
    for c, k in Counter(re.findall(r"[^\w\s.,;:'\"()?-]", text)).items():
        names |= {f"m{c}{j}" for j in range(min(8, k.bit_length()))}
    names.add(f"#length{min(12, int(math.log2(len(tokens) + 1)))}")
    return sum(model.weights.get(i, 0.0) for i in sorted({crc(x) for x in names}))


def test_quality_query_is_the_cumulative_link_of_its_features(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(model.weights) > 20
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op6_quality(spark, SF).collect():
        s = brute_score(text[r["doc_id"]], model)
        p_clean, p_good = (1 / (1 + math.exp(t - s)) for t in model.thresholds)
        assert r["p_clean"] == pytest.approx(p_clean, abs=1e-9) and r["p_good"] == pytest.approx(p_good, abs=1e-9)
        assert r["expected_grade"] == pytest.approx(p_clean + p_good, abs=1e-9) and r["accepted"] == (p_good >= 0.5)


def test_toxic_words_late_in_an_unspaced_run_have_features():
    run = "harmless" * 8
    far = set(quality.features(run + "q" * 40).tolist()) - set(quality.features(run).tolist())
    assert len(far) > 3


def brute_language(text, model):
    """Posterior mass of each language over words with letters, by sums over log probabilities."""
    words = [w[i : i + 24] for w in text.lower().split() for i in range(0, len(w), 24)]
    if not any(c.isalpha() for c in text):
        return None
    k = len(model.langs)

    def emission(w):
        marked = f"^{w}$"
        names = ["p" + w[:j] for j in (1, 2, 3)] + ["s" + w[-j:] for j in (1, 2, 3, 4)] + [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
        names += [f"l{model.lexicon[w]}"] if w in model.lexicon else []
        return sum(model.weight[zlib.crc32(x.encode("utf-8", "replace")) % language_id.TABLE] for x in names)

    total = lambda x: np.logaddexp.reduce(x)
    e = [emission(w) for w in words]
    a = [model.first + e[0]]
    for x in e[1:]:
        a.append(np.array([total(a[-1] + model.move[:, j]) for j in range(k)]) + x)
    b = [np.zeros(k)]
    for x in reversed(e[1:]):
        b.append(np.array([total(model.move[i] + x + b[-1]) for i in range(k)]))
    post = [np.exp(x + y - total(x + y)) for x, y in zip(a, reversed(b))]
    mass = sum(p for p, w in zip(post, words) if any(c.isalpha() for c in w))
    return mass / mass.sum()


def test_language_query_is_forward_backward_of_its_features(spark):
    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    learn = spark.read.parquet(f"{SF}/documents.parquet").where("crc32(cast(doc_id as string)) % 4 <> 2")
    model = language_id.train(learn)
    n = 0
    for r in queries.op10_language_id(spark, SF).collect():
        text = docs[r["doc_id"]][0] or ""
        if len(text) > 6000:
            continue
        share = brute_language(text, model)
        if share is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            n += 1
            assert r["score"] == pytest.approx(share.max(), abs=2e-3) and share[model.langs.index(r["lang_pred"])] > share.max() - 2e-3
    assert n > 100


def test_long_runs_and_many_languages(spark):
    text = "unspaced" * 40
    assert "".join(language_id.words_of(text + " ab")) == text + "ab" and max(map(len, language_id.words_of(text))) == 24
    rows = [(i, f"{'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10 % 10] * 3}{'uvwxyz'[i // 100 % 6]} words", f"l{i:03d}") for i in range(230)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 230
    hot = spark.createDataFrame([(None, "gleich und gleich", "de")] * 300 + [(1, "one and two", "en")], "doc_id long, text string, lang string")
    assert set(language_id.train(hot).langs) == {"de", "en"}


def brute_signature(text, permutations=128, words=5, seed=1):
    """MinHash slots by integers of Python."""
    rng = np.random.default_rng(seed)
    a = [int(x) * 2 + 1 & M64 for x in rng.integers(0, 1 << 63, permutations, np.uint64)]
    b = [int(x) for x in rng.integers(0, 1 << 63, permutations, np.uint64)]
    order = [int(x) * 2 + 1 & M64 for x in rng.integers(0, 1 << 63, words, np.uint64)]
    w = [xxhash.xxh64_intdigest(t) for t in re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())]
    k = min(words, len(w))
    hashes = set()
    for i in range(len(w) - k + 1 if w else 0):
        h = k + sum(x * o for x, o in zip(w[i : i + k], order)) & M64
        h = (h ^ h >> 32) * 0x9E3779B97F4A7C15 & M64
        hashes.add(h ^ h >> 29)
    return [(min(((h * x + y) & M64 for h in hashes), default=M64) >> 16) & 0xFFFF for x, y in zip(a, b)]


def test_fingerprint_query_is_min_hash(spark):
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(text, reverse=True)
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, SF).collect()}
    short = [i for i in ids if len(text[i]) < 1500][:60]
    for d in short:
        after = text[ids[(ids.index(d) + 1) % len(ids)]]
        third = len(text[d]) // 3
        new = text[d][: len(text[d]) - third] + after[:third]
        mine, edited, follow = (brute_signature(t[:200_000]) for t in (text[d], new, after if len(after) < 20_000 else ""))
        hexed = lambda s: b"".join(x.to_bytes(2, "big") for x in s).hex()
        r = got[d]
        assert (r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (hexed(mine), hexed(edited), hashlib.sha256(new.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(np.mean([x == y for x, y in zip(mine, edited)]))
        if len(after) < 20_000:
            assert r["near_next"] == pytest.approx(np.mean([x == y for x, y in zip(mine, follow)]))
