"""Ingesting a published corpus: names, signatures, statements, suites and gates."""

import pytest

from tierlab.operators import clusters as C
from tierlab.operators import ingest as I

PROMPT = "package main\n\n// Is x prime?\n//   >>> is_prime(3)\n// not is_prime_helper\nfunc is_prime(x int, y []interface{}) (bool, error)  {  \n"
TESTS = '\nfunc TestIs_Prime(t *testing.T) {\n  candidate := is_prime\n  {actual: candidate(3), expected: true},\n}\nfunc TestOther(t *testing.T) {}\n'


def test_rows(spark):
    rows = [
        ("HumanEval_0_is_prime", PROMPT, TESTS), ("mbpp_1_no_comment", PROMPT.replace("// ", "/ ").replace("//", "/"), TESTS), ("mbpp_2_no_test", PROMPT, "func Check() {}"), ("mbpp_3_open", PROMPT.replace("{  \n", "\n"), TESTS),
        ("mbpp_4_clash", PROMPT, TESTS + "{actual: candidate(3.0), expected: false},"), ("mbpp_5_null", None, TESTS), ("mbpp_6_null", PROMPT, None), ("mbpp_7_void", PROMPT.replace("(bool, error)", ""), TESTS),
    ]
    df = spark.createDataFrame(rows, "name string, prompt string, tests string")
    got = {r["id"]: r for r in I.gated(df).collect()}
    assert {i: r["outcome"] for i, r in got.items()} == {"he_0_is_prime": "ingested", "mbpp_1_no_comment": "shape", "mbpp_2_no_test": "shape", "mbpp_3_open": "shape", "mbpp_4_clash": "contradictory", "mbpp_5_null": "shape", "mbpp_6_null": "shape", "mbpp_7_void": "ingested"}
    r = got["he_0_is_prime"]
    assert (r["fn"], r["sig"], r["ret"]) == ("IsPrime", "func IsPrime(x int, y []interface{}) (bool, error)", "(bool, error)")
    assert r["problem"].startswith("Is x prime?\n>>> IsPrime(3)\nnot is_prime_helper\n\nImplement") and r["problem"].endswith(f"    {r['sig']}\nUse only the standard library.")
    assert r["suite"].startswith("package solution\n") and r["suite"].count("TestCanonical") == 1 and "func TestOther" in r["suite"] and "candidate := IsPrime\n" in r["suite"] and r["suite"].endswith("{}\n")
    assert got["mbpp_7_void"]["sig"] == "func IsPrime(x int, y []interface{})" and got["mbpp_5_null"]["suite"] is None
    assert {r["id"] for r in I.ingest(df).collect()} == {"he_0_is_prime", "mbpp_7_void"}
    with pytest.raises(Exception, match="duplicate id"):
        I.ingest(df.unionByName(df)).collect()
    assert I.ingest(df.limit(0)).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("differ_At_One_Bit_Pos", "DifferAtOneBitPos"), ("is_NOT_prime", "IsNotPrime"), ("_x__y", "XY"), ("one", "One")], "s string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", I.exported(df["s"])).collect())


def test_transfers_are_counted(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 3), (None, 4)], "sig string, k int")
    assert [tuple(r) for r in C.transfer_groups(df, "sig", "k").collect()] == [("a", 3, 6, 1)]


def test_transfers_are_dealt_by_pairs(spark):
    """One signature of 300 rows among small ones: its pairs lie in many tasks, and all of them come once."""
    rows = [("hot", k) for k in range(300)] + [("a", 1000), ("a", 1001), ("b", 1002), (None, 1003), (None, 1004), ("c", None), ("c", 1005)]
    df = spark.createDataFrame(rows, "sig string, k long")
    found = C.transfers(df, "sig", "k", side=50).selectExpr("*", "spark_partition_id() as part").collect()
    assert sorted((r["donor"], r["recipient"]) for r in found) == sorted((x, y) for s, x in rows for t, y in rows if s == t and s is not None and None not in (x, y) and x != y)
    sizes = {}
    for r in found:
        sizes[r["part"]] = sizes.get(r["part"], 0) + 1
    assert len(sizes) > 8 and max(sizes.values()) < len(found) // 3
