"""Fill-in-the-middle, phrases and near vectors against plain implementations, and on nulls, ties, long texts and clashing names."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlab.llm import covertree, fim, phrases, queries

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_fim(key, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i * 8 : i * 8 + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_starts_and_ranks():
    rng = np.random.default_rng(0)
    for n in [1, 2, 3, 63, 64, 65, 1000]:
        for _ in range(20):
            text = "".join(rng.choice(list("ab Z9\né中\U0001f600"), n))
            bits = fim.starts(text)
            places = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
            assert bits.bit_count() == len(places)
            assert [fim.nth_start(bits, n, k) for k in range(len(places))] == places
    assert fim.starts("") == 0


def test_fill_in_middle(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op11_fill_in_middle(spark, SF).collect():
        n, form, prefix, middle, out = plain_fim(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, prefix, middle, sha(out), sha(texts[r["doc_id"]]))


def test_fill_in_middle_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<P> marked"), (4, "a<S"), (None, "no key"), (5, "same"), (5, "same"), (6, "word " * 60000), (7, "é中\U0001f600\x00\n\x85x"), (8, "x" * 100000)]
    rows += [(i, f"<<{'ab ' * (i % 7)}<S>>"[: i % 23]) for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    got = fim.fill_in_middle(df).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    seen = lambda rows: sorted(map(repr, rows))
    assert seen((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == seen((k, *plain_fim(k, t or "")) for k, t in rows)
    assert seen((r["doc_id"], r["back"]) for r in got) == seen((k, t or "") for k, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, marks=("<P>", "<P>", "<M>"))
    plan = fim.fill_in_middle(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def plain_phrases(rows, longest=3, least=10, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    inside[p[s : s + m]] = max(inside[p[s : s + m]], a)
        kept = []
        for p, a in found.items():
            score, cut = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < 50 * a:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:most])]
    return sorted(out)


def test_phrases(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op12_phrases(spark, SF).collect())
    assert got == plain_phrases(rows) and len(got) > 100


def test_phrases_in_small_runs_and_narrow_sketches(spark, monkeypatch):
    """Ties, nulls, overlaps, a long text without a piece end, runs that cut texts, and a sketch in which all counters are shared."""
    rng = np.random.default_rng(1)
    words = ["a", "b", "A", "é", "中文", "\U0001f600", "x\x1cy", "\x85", "\xa0z", "un-de"]
    rows = [(lang, " ".join(rng.choice(words, rng.integers(0, 30))) + str(rng.choice([".", "\n", "\t", "\r"]))) for lang in ("en", None, "l\n1", "") for _ in range(60)]
    rows += [("en", None), ("en", ""), (None, "... ,"), ("long", "a b " * 20000), ("hot", "same same same")] + [("hot", "same same same")] * 20
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("rank", F.lit("clash")).withColumn("phrase", F.lit(0))
    want = plain_phrases(rows, least=12, most=40)
    assert len({w[0] for w in want}) == 6
    spec = lambda **more: sorted(tuple(r) for r in phrases.collocations(df, least=12, most=40, **more).collect())
    assert spec() == want
    plain = phrases.runs
    monkeypatch.setattr(phrases, "runs", lambda batches, longest, words=97: plain(batches, longest, 97))
    assert spec(most_width_bits=13, depth=1, part_rows=321) == want
    assert phrases.collocations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(df, least=1000)


def test_sketch_runs_and_codes():
    text = b"a b c a b \xff c a".split()
    grams = phrases.Grams(text, "en", 4, len(text))
    got = {grams.phrase(p, k): c for k, counts, first, _ in grams.found for c, p in zip(counts.tolist(), first.tolist())}
    assert grams.total == 7 and got["a b"] == 2 and got["c a"] == 2 and got["a b c a"] == 1 and "b c a b" in got and not any("\udcff" in g for g in got)
    at = np.array([0, 5, 70000, 70001, 400000])
    where, n = phrases.unpack(*phrases.pack(at, np.array([1, 2, 3, 4, 5])))
    assert where[n > 0].tolist() == at.tolist() and n[n > 0].tolist() == [1, 2, 3, 4, 5]
    h = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    assert phrases.counters(h, 0, 16).max() < 1 << 16 and len(np.unique(phrases.counters(h, 0, 30))) == 1000


def plain_links(rows, threshold=0.93):
    unit = {}
    for i, (_, x, label) in enumerate(rows):
        if x and label is not None and None not in x and np.isfinite(x).all() and np.any(x):
            a = np.array(x, np.float64)
            a = a / np.abs(a).max()
            unit[i] = a / np.sqrt(a @ a)
    near = defaultdict(set)
    for i in unit:
        for j in unit:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                near[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def grouped_vectors(rng, n, dim=8):
    centres = rng.normal(size=(9, dim))
    x = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.15, 0.5], n)[:, None]
    return [(int(i), [float(c) for c in np.float32(v)], int(rng.integers(0, 3))) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [40, 2048])
def test_near_vectors(spark, block):
    rows = grouped_vectors(np.random.default_rng(block), 700)
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(50)] + [(2000 + i, [c * 3 for c in rows[5][1]], rows[5][2]) for i in range(3)]
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 8, 0), (3003, [1.0, None] * 4, 0), (3004, [float("nan")] * 8, 0), (3005, [float("inf")] * 8, 0), (3006, rows[3][1], None), (3007, [1.0, 2.0], 0), (3008, [1.0, 2.0], 0)]
    rows += [(None, rows[3][1], rows[3][2]), (None, [1.0] * 5, 0), (7, rows[8][1], rows[8][2]), (7, rows[7][1], rows[7][2]), (3009, [1e30, 0.0], 7), (3010, [1e-30, 1e-38], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash")).withColumn("k", F.lit(0))
    got = sorted((tuple(r) for r in covertree.near_vectors(df, block=block, most_cells=12).collect()), key=repr)
    want = plain_links([(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], label) for i, x, label in rows])
    want = sorted(((i, n, c, k if i is not None or c is not None else True) for i, n, c, k in want), key=repr)
    assert got == want
    assert covertree.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_the_table(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op13_near_vectors(spark, SF).collect()), key=repr) == plain_links(rows)


def test_cover_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(3)
    x = np.array([v for _, v, _ in grouped_vectors(rng, 1500, 6)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = covertree.CoverTree(x, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(1500))
    for i in range(len(tree.centre)):
        assert covertree.distances(x[tree.order[tree.lo[i] : tree.hi[i]]], x[tree.centre[i]][None]).max() <= tree.radius[i] + 1e-7
        for c in range(*tree.children[i]):
            assert tree.radius[c] <= tree.radius[i] / 2 + 1e-7 and tree.lo[i] <= tree.lo[c] and tree.hi[c] <= tree.hi[i]
        if tree.children[i][0] < tree.children[i][1]:
            assert tree.centre[tree.children[i][0]] == tree.centre[i]
    w = rng.integers(1, 4, 1500)
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    found = covertree.Linker(tree, None, w, w, 0.93)
    assert (found.counts[0] == linked @ w).all() and found.pairs_tried < 1500 * 1500 / 8
    a, b = covertree.CoverTree(x[:600], leaf=8), covertree.CoverTree(x[600:], leaf=8)
    between = covertree.Linker(a, b, w[:600], w[600:], 0.93)
    assert (between.counts[0] == linked[:600, 600:] @ w[600:]).all() and (between.counts[1] == linked[600:, :600] @ w[:600]).all()


def test_topk_of_large_components(spark):
    """Scores beyond doubles, beyond longs (the nearest long counts) and vectors too long for bounds; ties to the smaller id."""
    from tierlab.llm import topk

    big = [5e7, -5e7, 1e30, -1e30, 3e15, 1e300, 0.0, 1.5, 2.0**40, 1.7e308]
    rng = np.random.default_rng(5)
    rows = [(i, [float(rng.choice(big)) if rng.random() < 0.3 else float(rng.normal()) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda x: int(np.floor(64 * x)) if abs(64 * x) < 2**52 else int(max(-1.7976931348623157e308, min(1.7976931348623157e308, 64.0 * x)))
    v = {i: [whole(c) for c in x] for i, x in rows}
    near = lambda s: max(-(2**63), min(2**63 - 1, s))
    for block in (4096, 25):
        got = defaultdict(list)
        for r in sorted(topk.top_k(df, k=6, block=block, query_block=2).collect(), key=lambda r: r["rank"]):
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        for q in range(0, 120, 20):
            want = sorted(((near(sum(a * b for a, b in zip(v[q], v[i]))), i) for i in v if i != q), key=lambda x: (-x[0], x[1]))[:6]
            assert got[q] == want


def test_many_stray_languages(spark):
    from tierlab.llm import language_id

    rows = [(i, f"word{i % 7} and other words of text {i}", f"stray-{i}") for i in range(300)] + [(1000 + i, "the cat sat on the mat and it was good", "en") for i in range(30)] + [(2000 + i, "le chat est sur la table et il est bon", "fr") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, most_langs=3)
    assert model.langs == ["en", "fr", "stray-0"]


def test_equal_rows_are_dealt(spark):
    from tierlab.llm import line_dedup, minhash, sharding

    same = spark.createDataFrame([(None, "one two three", "s")] * 400, "doc_id long, text string, source string").repartition(4)
    assert sorted((r["shard"], r["slot"]) for r in sharding.interleave(same, shards=8).collect()) == [(s, k) for s in range(8) for k in range(50)]
    assert {(r["near_next"], r["n_chars"]) for r in minhash.fingerprints_with_next(same).collect()} == {(1.0, 13)}
    import duckdb

    twice = spark.createDataFrame([(i % 12, f"shared\nown {i}") for i in range(24)], "doc_id long, text string")
    db = duckdb.connect()
    db.register("documents", twice.toPandas())
    want = sorted(db.sql(line_dedup.SQL).fetchall())
    kept = line_dedup.drop_frequent_lines(twice, min_docs=10).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("h"))
    assert sorted(tuple(r) for r in kept.collect()) == want
