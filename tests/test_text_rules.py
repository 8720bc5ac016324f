"""The parsers on hard cases: what counts, what doesn't, and input that is broken."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tierlab.functions import text as X
from tierlab.operators import studies as D


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_extract_code(spark):
    cases = {
        "prose\n```go\npackage solution\n```\ntrailing": "package solution", "```\npackage solution\n```": "package solution", "package solution\n\nfunc F() {}": "package solution\n\nfunc F() {}",
        "I cannot help with that.": None, None: None, "": None, "```golang \t\r\n x 　\n```": "x", "```Go\nx```": None, "```python\ny\n```\nand\n```go\nz\n```": "and",
        "```python y```go\nz\n```": "z", "```\n```": "", "```go x```": None, "a package is": "a package is", "```go\nfirst```\n```go\nsecond```": "first",
    }
    assert values(spark, list(cases), X.extract_code) == list(cases.values())


def test_parse_spec(spark):
    block = lambda head, body, level="##": f"{level} {head}\nSome words.\n\n```go\n{body}\n```\n"
    full = block("API", "a") + block("Visible Tests", "v", "#") + block("HIDDEN TESTS  ", "h", "######")
    cases = [
        (full, ("a", "v", "h")), (full + block("api", "a2"), ("a2", "v", "h")), (full + "## API\nnothing\n", None), (full.replace("## API", "API"), None), (full.replace("h\n", " \n"), None),
        (full + "####### API\nno heading\n#APIs\nx # API\n", ("a", "v", "h")), (block("API", "a") * 3, None), (full.replace("```go\nv", "```python\nv"), None), (None, None), ("", None), (full.replace("\n", "\r\n"), ("a", "v", "h")),
    ]
    assert [None if r is None else tuple(r) for r in values(spark, [t for t, _ in cases], X.parse_spec)] == [want for _, want in cases]


def test_worst_allocs(spark):
    two = "BenchmarkX-8   1000   1234 ns/op   56 B/op   3 allocs/op\nBenchmarkY-8   1000   99 ns/op   0 B/op   7 allocs/op"
    cases = {"5000000 231 ns/op 48 B/op 2 allocs/op": 2, two: 7, "9" * 25 + " allocs/op": 0, "9" * 25 + " allocs/op 4\tallocs/op": 4, "12 B/op": None, "": None, None: None, "3allocs/op": None}
    assert values(spark, list(cases), X.worst_allocs) == list(cases.values())
    rows = spark.createDataFrame([("a", two), ("a", None), ("b", "none"), (None, "1 allocs/op")], "k string, t string")
    assert {r["k"]: r["worst"] for r in D.worst_allocs(rows, "k", "t").collect()} == {"a": 7, "b": None, None: 1}


def test_summaries_of_test_output(spark):
    event = lambda action, text: f'{{"Action":"{action}","Test":"T","Output":"{text}"}}'
    out = "\n".join(["  plain \t", "", event("output", "=== RUN   T\\n"), event("output", "--- PASS: T\\n"), event("output", "    --- FAIL: T\\n"), event("run", "x"), event("output", "ok  \\tpkg"), event("output", "PASS\\n"), "{broken", event("output", "okay\\n"), "\r"])
    assert values(spark, [out, event("output", "PASS"), "", None], lambda t: X.summarise_test_output(t, F.lit("fell back"))) == ["plain\n    --- FAIL: T\nokay", "fell back", "fell back", "fell back"]
    rows = [("k", i, line) for i, line in enumerate(out.split("\n"))] + [("quiet", 0, "{broken"), ("null", 0, None)]
    df = spark.createDataFrame(rows, "k string, n int, line string")
    assert {r["k"]: r["summary"] for r in D.summarise_output(df, "k", "n", fallback="-").collect()} == {"k": "plain\n    --- FAIL: T\nokay", "quiet": "-", "null": "-"}
    assert {r["k"]: r["summary"] for r in D.summarise_output(df, "k", "n", most=1).collect()}["k"] == "okay"


def plain_contradictions(suite):
    fold = lambda s: re.sub(r"-?\b\d+\.?\d*\b", lambda m: repr(float(m[0])), " ".join(s.split()))
    seen = {}
    for args, want in re.findall(r"candidate\((.*?)\),\s*expected:\s*(.*?)\},", suite, re.S):
        seen.setdefault(fold(args), set()).add(fold(want))
    return {a: len(w) for a, w in seen.items() if len(w) > 1}


def test_contradictions(spark):
    row = lambda args, want: f"{{actual: candidate({args}), expected: {want}}},\n"
    suites = {
        "any_int": row("3, 4, 7", "true") + row("3.0, 4, 7", "false"), "fractions": row("3.5", "a") + row("3.2", "b"), "signs": row("-3", "1") + row("3", "2") + row("-3.0", "1.0"), "two": row("3, 4", "true") + row("3, 4", "true"),
        "nested": row('[]int{1, 2}, f(x), "a)"', "1") + row('[]int{1,  2.0}, f(x), "a)"', "2"), "names": row("x3, 1e5, .5, 5.", "1") + row("x3.0, 1e5, 0.5, 5", "2"), "empty": row("", "1") + row("", "2"), "none": "nothing", "big": row("9" * 400, "1") + row("8" * 400, "2"), "zero": row("-0", "1") + row("0", "2"),
    }
    df = spark.createDataFrame([*suites.items(), ("null", None)], "k string, suite string")
    got = {}
    for r in D.contradictions(df, "k").collect():
        got.setdefault(r["k"], []).append(r["n"])
        assert len(r["wants"]) == r["n"]
    want = {k: sorted(v.values()) for k, s in suites.items() if (v := plain_contradictions(s))}
    assert {k: sorted(v) for k, v in got.items()} == want and set(want) == {"any_int", "nested", "empty", "big"}
    spread = spark.createDataFrame([("k", "f( 3.5 ) == a"), ("k", "f(3.50) == b"), ("k", "f(-3) == true"), (None, "f(3, 4) == true"), ("k", "f() == x")], "k string, suite string")
    assert [(r["k"], r["args"], r["wants"]) for r in D.contradictions(spread, "k", pattern=r"f\((.*?)\)\s*==\s*(\w+)").collect()] == [("k", "3.5", ["a", "b"])]


def test_pairs_with_bad_values(spark):
    got = values(spark, ["a=1,b=x", "a=99999999999", "", None, "a"], X.parse_pairs)
    assert got[0] == {"a": 1, "b": None} and got[1] == {"a": None} and got[3] is None and got[4] == {"a": None}


@pytest.mark.parametrize("text", ["1", "-1.50", "x 2 y", "3.", "12345678901234567890"])
def test_numbers_by_value(spark, text):
    got = values(spark, [text], X.by_value)[0]
    numbers = [float(x) for x in re.findall(r"-?\b\d+\.?\d*\b", text)]
    assert [float(x) for x in re.findall(r"-?\d+(?:\.\d+)?(?:E\d+)?", got)] == numbers and all(map(math.isfinite, numbers))
