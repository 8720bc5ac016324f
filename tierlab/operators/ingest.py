"""Published function-completion problems to benchmark problems: shapes, names, suites, statements, and the gates a row has to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import suite_cases, trimmed

#: Fixed patterns: the one function of a prompt (name, parameters, result), the comment before it, and a suite's test function.
FUNCTION = r"(?md)^func\s+(\w+)\s*\(([^\n]*?)\)\s*([^\n]*?)\s*\{\s*$"
COMMENT = r"(?md)((?:^//.*\n)+)\s*func\s+\w+\s*\("
TEST_FUNCTION = r"(?md)^func\s+Test\w*\s*\(t \*testing\.T\)\s*\{"
#: Fixed texts: what a suite and a statement are given.
TEST_HEAD = "func TestCanonical(t *testing.T) {"
SUITE_HEAD = 'package solution\n\nimport (\n\t"fmt"\n\t"testing"\n)\n\n'
ASK, ONLY = "Implement this as an exported Go function with exactly this signature:", "Use only the standard library."


def exported(snake: Column) -> Column:
    """is_NOT_prime to IsNotPrime: each part with its first letter in upper case and the rest in lower."""
    return F.array_join(F.transform(F.split(snake, "_", -1), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2**31 - 1)))), "")


def renamed(source: Column, old: Column, new: Column) -> Column:
    """Whole words `old` become `new`; both are plain identifiers."""
    return F.regexp_replace(source, F.concat(F.lit(r"\b"), old, F.lit(r"\b")), new)


def corpus_id(name: Column) -> Column:
    """HumanEval_7_x to he_7_x; other names stay."""
    return F.when(name.startswith("HumanEval_"), F.concat(F.lit("he_"), F.substring(name, len("HumanEval_") + 1, 2**31 - 1))).otherwise(name)


def signature(fn: Column, params: Column, ret: Column) -> Column:
    """The whole signature; the parameter list stands in one pair of brackets."""
    ret = trimmed(ret)
    return F.concat(F.lit("func "), fn, F.lit("("), trimmed(params), F.lit(")"), F.when(ret != "", F.concat(F.lit(" "), ret)).otherwise(""))


def statement(comment: Column, old: Column, fn: Column, sig: Column) -> Column:
    """The comment as prose, with the exported name, and the signature it asks for."""
    lines = F.transform(F.split(trimmed(comment), "\r?\n", -1), lambda x: F.when(x.startswith("//"), F.ltrim(F.substring(x, 3, 2**31 - 1), F.lit(" \t"))).otherwise(x))
    return F.concat(renamed(F.array_join(lines, "\n"), old, fn), F.lit(f"\n\n{ASK}\n    "), sig, F.lit(f"\n{ONLY}"))


def contradictory(suite: Column) -> Column:
    """Whether two cases of a suite demand different answers for the same arguments."""
    cases = suite_cases(suite)
    return F.size(F.array_distinct(F.transform(cases, lambda c: c["args"]))) < F.size(F.array_distinct(cases))


def gated(rows: DataFrame) -> DataFrame:
    """rows (name, prompt, tests) as id, problem, suite, fn, sig, ret, outcome, a row each: `shape` (prompt or suite isn't of the
    expected form; nothing else is filled in), `contradictory` or `ingested`. Whether a suite compiles isn't tried here."""
    shaped = F.col("prompt").rlike(FUNCTION) & F.col("prompt").rlike(COMMENT) & F.col("tests").rlike(TEST_FUNCTION)
    part = lambda i: F.regexp_extract("prompt", FUNCTION, i)
    one = rows.select("name", "tests", F.coalesce(shaped, F.lit(False)).alias("ok"), part(1).alias("old"), part(2).alias("params"), part(3).alias("ret"), F.regexp_extract("prompt", COMMENT, 1).alias("comment"))
    one = one.withColumn("fn", exported(F.col("old"))).withColumn("sig", signature(F.col("fn"), F.col("params"), F.col("ret")))
    named = renamed(F.col("tests"), F.col("old"), F.col("fn"))
    halves = F.split(named, TEST_FUNCTION, 2)  # the first test function gets the canonical name
    suite = F.concat(F.lit(SUITE_HEAD), trimmed(F.concat(F.get(halves, F.lit(0)), F.lit(TEST_HEAD), F.get(halves, F.lit(1)))), F.lit("\n"))
    one = one.withColumn("suite", F.when(F.col("ok"), suite))
    outcome = F.when(~F.col("ok"), "shape").when(contradictory(F.col("suite")), "contradictory").otherwise("ingested")
    filled = lambda c, name: F.when(F.col("ok"), c).alias(name)
    return one.select(corpus_id(F.col("name")).alias("id"), filled(statement(F.col("comment"), F.col("old"), F.col("fn"), F.col("sig")), "problem"), "suite", filled(F.col("fn"), "fn"), filled(F.col("sig"), "sig"), filled(trimmed(F.col("ret")), "ret"), outcome.alias("outcome"))


def ingest(rows: DataFrame) -> DataFrame:
    """The problems that pass all gates; an id that two of them share is an error."""
    passed = gated(rows).where("outcome = 'ingested'").drop("outcome")
    repeated = passed.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("_again"))
    clash = F.raise_error(F.concat(F.lit("duplicate id "), F.col("id")))
    return passed.join(repeated, "id", "left").withColumn("id", F.when(F.col("_again"), clash).otherwise(F.col("id"))).drop("_again")
