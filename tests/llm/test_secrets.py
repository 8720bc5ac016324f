"""The secret scan on hard texts: many and short matches, long runs, placeholders; against brute force and the SQL twin."""

import random
import re
import string
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tierlab.llm import queries, secrets

from test_llm_queries import brute_entropy, brute_secrets

RNG = random.Random(11)


def drawn(n, alphabet=string.ascii_letters + string.digits + "+/"):
    return "".join(RNG.choice(alphabet) for _ in range(n))


KEYS = " ".join("AKIA" + drawn(16, string.ascii_uppercase + string.digits) for _ in range(60))
TEXTS = [
    KEYS, "AKIAABCD and AKIA1234567890AB", "password=token: x", "password=short token=longer_value secret: 'q8Zk2LmX'", "\n".join(f"api_key = {drawn(20)} # {i}" for i in range(50)),
    "-".join(["ab"] * 300), drawn(400), drawn(64, "0123456789abcdef") + " " + drawn(31, "0123456789abcdef"), "example_key=q8Zk2LmX0vRt7YpW4nBc9HdJ and /examples/q8Zk2LmX0vRt7YpW4nBc9HdJ",
    "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "dummy-dummy/" + drawn(22) + "/changeme", "x" * 200, "=" * 80 + drawn(30), "éü " + drawn(40) + " 中文 " + drawn(24) + "\U0001f600" + drawn(24, "0123456789ABCDEF"),
    "token=" + drawn(30) + drawn(10), "", None, "id 123e4567-e89b-12d3-a456-426614174000", "xxxxxxxxxxxx" + drawn(30), drawn(30) + "_placeholder_" + drawn(30),
]


def brute_found(text):
    """base spans and, by another way than the operator's, the entropy spans."""
    base = brute_secrets(text)
    out = set(base)
    for pattern, width, least in ((r"(?<![A-Za-z0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9])", 24, 3.05), (r"[A-Za-z0-9+/_=-]{24,}", 24, 3.85)):
        for m in re.finditer(pattern, text):
            if any(b[0] <= m.start() and b[2] >= m.end() for b in base):
                continue
            for part in re.sub(r"(?i)[A-Za-z0-9+]*(?:example|placeholder|changeme|dummy|x{6})[A-Za-z0-9+]*", " ", m[0]).split(" "):
                allowed = re.fullmatch(r"[A-Za-z/_=+-]+|[0-9_=+/-]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", part)
                if len(part) >= width and not allowed and brute_entropy(part, width) >= least:
                    out.add((m.start(), 3, m.end(), "entropy"))
    return base, sorted(out)


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_all_spans_match_brute_force(spark):
    text_of = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    got = secrets.scan(rows_of(spark, TEXTS)).select("doc_id", secrets.spans_text(F.col("base")).alias("base"), secrets.spans_text(F.col("found")).alias("found")).collect()
    for r in got:
        base, found = brute_found(TEXTS[r["doc_id"]] or "")
        assert (r["base"], r["found"]) == (text_of(base), text_of(found)), TEXTS[r["doc_id"]]
    spans = {r["doc_id"]: r["found"] for r in got}
    assert spans[0].count("access:") == 60 and spans[1] == "access:13:29" and spans[2] == "" and spans[9] == ""
    assert spans[8] == "entropy:0:36,entropy:41:75"
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(rows_of(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        left, at = "", 0
        for s, _, e, _ in brute_found(t or "")[1]:
            left += (t[at:s] + "[secret]") if s >= at else ""
            at = max(at, e)
        assert clean[i] == (None if t is None else left + t[at:])


def test_twin_agrees_on_hard_texts(spark, tmp_path):
    rows_of(spark, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op8_secrets(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(db.execute(secrets.SQL).fetchall())


@pytest.mark.parametrize("text, n", [(" ".join("AKIA" + f"{i:016d}" for i in range(2000)), 2000), ("-".join(["hyphenated"] * 6000), 0), (drawn(1_000_000), 1), ("password=" * 30000, 1), (" " * 300_000 + "token" + " " * 300_000, 0)])
def test_long_texts_take_seconds(spark, text, n):
    began = time.time()
    df = rows_of(spark, [text])
    found = secrets.scan(df).select(F.size("found").alias("n")).first()["n"]
    assert found == n and time.time() - began < 60
    assert secrets.redact(df).first()["text"].count("[secret]") == n


def test_running_over_many_chunks(spark):
    values = [RNG.randrange(100) for _ in range(3000)]
    df = spark.createDataFrame([(values,), ([],), (values[:1],)], "v array<bigint>")
    got = [r["r"] for r in df.select(secrets.running(F.col("v"), lambda a, b: a + b).alias("r")).collect()]
    assert got == [[sum(values[:i]) for i in range(3000)], [], [0]]
    with pytest.raises(ValueError):
        secrets.scan(df.withColumn("found", F.lit(1)), "found", ["found"])
