"""MinHash near-duplicate components against all-pairs Jaccard."""

import random

from pyspark.sql import functions as F

from tierlab.llm import near_text


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return set(zip(*[w[i:] for i in range(min(k, len(w)))])) if w else set()


def test_components_match_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows = []
    for _ in range(12):
        text = [word() for _ in range(120)]
        for _ in range(rng.randrange(1, 9)):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = word()
    rows += [rows[0], rows[0].upper(), "", None, "a b", "a  B", "a b c"]
    data = list(enumerate(rows)) + [(None, rows[0]), (3, rows[3])]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("node", F.lit("clash"))
    sets = [shingles(t) for t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i] or "") == (rows[j] or "")
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = near_text.near_components(df).collect()
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == root(r["doc_id"]), r
    assert near_text.near_components(df.limit(0)).count() == 0
