"""The SimHash stage of the pipeline against all-pairs Jaccard."""

import random

import pytest

import corpus_pipeline
from tierlab.llm import near_text

from test_near_text import shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], COLUMNS)


def families(seed, groups, length, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    texts = []
    for _ in range(groups):
        text = [word() for _ in range(rng.randrange(5, length))]
        for _ in range(rng.randrange(1, 8)):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randrange(1, edits)):
                text[rng.randrange(len(text))] = word()
            text += [word() for _ in range(rng.randrange(0, len(text) // 8 + 1))]
    return texts + [texts[0], texts[0].upper(), "", "a b", "a  B", "a b c"]


def roots(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_near_copies_match_all_pairs(spark):
    texts = families(3, 25, 200, 5)
    want = roots(texts)
    assert len(set(want)) < len(texts) - 20
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, enumerate(texts)), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want))
    assert corpus_pipeline.drop_near_copies(spark, table(spark, []), "").count() == 0


@pytest.mark.parametrize("block", [3, 16])
def test_small_blocks_meet(spark, block):
    texts = families(4, 12, 60, 3)
    want = len(set(roots(texts)))
    found = near_text.simhash_components(table(spark, enumerate(texts)), block=block)
    assert found.select("label").distinct().count() == want


def test_texts_without_an_id_or_with_a_shared_one_stay(spark):
    texts = [f"{w} alone in the table with {w} words of its own about {w}" for w in ("ant", "bee", "cow", "doe", "elk", "fox")]
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, near), (3, near + " end"), (None, near + " stop"), (9, None), (None, "")]
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect()
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (3, near + " end"), (7, texts[3]), (7, texts[4]), (9, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(want, key=str)


SF = "/root/testdata/sf0.001"


def test_stages_chained_match_brute_force(spark):
    from collections import defaultdict

    from tierlab.llm import quality
    from test_llm_queries import check_pieces
    from test_models import brute_score
    from test_secrets import brute_found

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if brute_score(r["text"] or "", model) >= model.thresholds[-1]}
    low = lambda line: line.strip(" \t\n\x0b\x0c\r").lower() if line.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            seen[low(line)].add(i)
    texts = {i: "\n".join(x for x in t.split("\n") if not low(x) or len(seen[low(x)]) < 10) for i, t in texts.items()}
    ids = sorted(texts)
    root = roots([texts[i] for i in ids])
    texts = {ids[k]: texts[ids[k]] for k in sorted(set(root))}
    for i, t in texts.items():
        left, at = "", 0
        for s, _, e, _ in brute_found(t)[1]:
            left += (t[at:s] + "[secret]") if s >= at else ""
            at = max(at, e)
        texts[i] = left + t[at:]
    place = {i: k for k, i in enumerate(sorted(texts))}
    rows = [r.asDict() | {"doc_id": place[r["doc_id"]]} for r in corpus_pipeline.run(spark, SF).collect()]
    check_pieces(rows, [texts[i] for i in sorted(texts)])


def test_stages_keep_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "good words of a text", "en", "b", 1), (None, "good words of a text", "en", "b", 1), (None, None, None, None, None), (4, "token = q8Zk2LmX0vRt7YpW", None, "c", 5), (5, "x" * 30000, "en", "a", 30000)]
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'clash' as base", "1 as n_lines", "'clash' as found", "0 as shard", "'k' as _h")
    empty = docs.where("false")
    columns = [f.split()[0] for f in COLUMNS.split(", ")]
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        got[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got["line_dedup"] == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    assert got["simhash"] == sorted([(1, None), (None, "good words of a text"), (4, rows[5][1]), (5, rows[6][1])], key=str)
    assert got["secrets"] == sorted(((i, "[secret]" if i == 4 else t) for i, t, *_ in rows), key=str)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == {1, 2, None, 4, 5} and sum(r["length"] for r in pieces if r["doc_id"] == 1) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
