"""Text functions: normalising, hashes, trigrams, keys and the small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that is folded (ASCII; wider Unicode spaces are kept, a documented deviation).
SPACE = r"[ \t\n\r\f\x0B]+"
#: The code points with Unicode's White_Space property, trimmed from the ends of blocks and lines.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed patterns: a Go block (or one without a tag), and the headings of a spec (in Unix lines).
FENCE = r"(?s)```(?:go|golang)?[\t\n\f\r ]*\n(.*?)```"
HEADING = r"(?mid)^#{1,6}[\t\n\f\r ]*(API|VISIBLE TESTS|HIDDEN TESTS)[\t\n\f\r ]*$"
#: Fixed patterns: a number inside an argument list, and a row of a table of cases (arguments, expectation).
NUMBER = r"-?\b\d+\.?\d*\b"
CASE = r"(?s)candidate\((.*?)\),\s*expected:\s*(.*?)\},"


def normalize(text: Column) -> Column:
    """White-space runs to one space, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def problem_hash(text: Column) -> Column:
    return F.substring(F.sha2(normalize(text), 256), 1, 32)


def trigrams(text: Column) -> Column:
    """Distinct code-point trigrams of the normalised text, in linear time; fewer than three code points: none."""
    chars = F.split(normalize(text), "", -1)
    chars = F.filter(chars, lambda c: c != "")
    n = F.size(chars)
    shifted = lambda k: F.slice(chars, F.lit(k + 1), F.greatest(n - 2, F.lit(0)))
    joined = F.zip_with(F.zip_with(shifted(0), shifted(1), lambda a, b: F.concat(a, b)), shifted(2), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) >= 3, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))


def behaviour_key(ok: Column, failed_at: Column, tests: Column) -> Column:
    """nil without a report, refuted:<stage>, or ok: and 16 hex digits over the sorted test outcomes."""
    entries = F.array_sort(F.map_entries(F.coalesce(tests, F.create_map().cast("map<string,boolean>"))))
    outcome = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"), F.lit(";"))), "")
    return F.when(ok.isNull(), "nil").when(~ok, F.concat(F.lit("refuted:"), failed_at.cast("string"))).otherwise(F.concat(F.lit("ok:"), F.substring(F.sha2(outcome, 256), 1, 16)))


def raw_text_key(source: Column) -> Column:
    """raw: and 16 hex digits over the text with its white space folded (case kept)."""
    return F.concat(F.lit("raw:"), F.substring(F.sha2(F.trim(F.regexp_replace(source, SPACE, " ")), 256), 1, 16))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def first_block(text: Column) -> Column:
    """The first block fenced as Go or without a tag, trimmed; null without one. Blocks of other languages aren't opened,
    so what follows their closing fence is read as a block without a tag."""
    return F.when(text.rlike(FENCE), trimmed(F.regexp_extract(text, FENCE, 1)))


def extract_code(reply: Column) -> Column:
    """The first block, else the whole trimmed reply if it declares a package, else null."""
    return F.when(reply.rlike(FENCE), first_block(reply)).when(reply.contains("package "), trimmed(reply))


def parse_verdict(reply: Column) -> Column:
    """True, false, or null where no verdict is given; the first one counts."""
    found = F.upper(F.regexp_extract(reply, r"(?i)VERDICT:\s*(PASS|FAIL)", 1))
    return F.when(found == "PASS", True).when(found == "FAIL", False)


def first_line(text: Column, most: int = 200) -> Column:
    """The first line of the trimmed text, cut to `most` code points and then marked with dots."""
    line = F.substring_index(F.trim(F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")), "\n", 1)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def is_stdlib(path: Column) -> Column:
    return ~F.substring_index(path, "/", 1).contains(".")


def slug(name: Column, most: int = 64) -> Column:
    """Runs of other characters to one dash; longer names end in 8 hex digits of their hash."""
    flat = F.regexp_replace(name, "[^A-Za-z0-9]+", "-")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 9), F.lit("-"), F.substring(F.sha2(name, 256), 1, 8)))


def model_identity(name: Column) -> Column:
    """What follows the last slash, without a routing prefix."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"^(us-gov|us|eu|apac|global)\.", "")


def parse_pairs(text: Column) -> Column:
    """`a=1,b=2` as map<string,int>; a value that is no whole number of 32 bits is null."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda k, v: F.trim(v).try_cast("int"))


def parse_spec(reply: Column) -> Column:
    """Struct api, visible, hidden: the first block of the section under each heading, the last section of a kind counts.

    Null if there are under three headings, a section (of any kind, repeated ones too) has no block, or a kind is missing or blank.
    """
    names = F.transform(F.regexp_extract_all(reply, F.lit(HEADING), F.lit(1)), F.upper)
    bodies = F.split(reply, HEADING, -1)
    sections = F.zip_with(names, F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))), lambda n, b: F.struct(n.alias("name"), first_block(b).alias("code")))
    code = lambda kind: F.try_element_at(F.filter(sections, lambda x: x["name"] == kind), F.lit(-1))["code"]
    api, visible, hidden = code("API"), code("VISIBLE TESTS"), code("HIDDEN TESTS")
    whole = (F.size(names) >= 3) & F.forall(sections, lambda x: x["code"].isNotNull()) & (api != "") & (visible != "") & (hidden != "")
    return F.when(whole, F.struct(api.alias("api"), visible.alias("visible"), hidden.alias("hidden")))


def output_line(line: Column) -> Column:
    """What a line of test output tells: plain lines as they are (trimmed), the text of JSON output events; null for blank
    lines, other events, broken JSON and the noise of passing tests."""
    x = trimmed(line)
    event = F.from_json(x, "Action string, Output string")
    said = F.rtrim(event["Output"], F.lit("\n"))
    noise = (said == "") | said.startswith("=== RUN") | said.startswith("--- PASS") | said.startswith("ok ") | (said == "PASS")
    return F.when(~x.startswith("{"), F.when(x != "", x)).when((event["Action"] == "output") & ~noise, said)


def summarise_test_output(out: Column, fallback: Column) -> Column:
    """The telling lines of a whole output, in order; the fallback if there is none."""
    said = F.filter(F.transform(F.split(out, "\n", -1), output_line), lambda x: x.isNotNull())
    text = trimmed(F.array_join(said, "\n"))
    return F.when(text != "", text).otherwise(fallback)


def worst_allocs(out: Column) -> Column:
    """The largest count before `allocs/op`, 0 where only numbers beyond 64 bits stand there; null without one."""
    counts = F.regexp_extract_all(out, F.lit(r"(\d+)[\t\n\f\r ]+allocs/op"), F.lit(1))
    return F.when(F.size(counts) > 0, F.greatest(F.lit(0).cast("long"), F.array_max(F.transform(counts, lambda x: x.try_cast("long")))))


def by_value(text: Column) -> Column:
    """White-space runs to one space, ends trimmed, and each number written by its value: 3, 3.0 and 3.00 are one spelling."""
    folded = F.trim(F.regexp_replace(text, SPACE, " "))
    between = F.split(folded, NUMBER, -1)
    numbers = F.transform(F.regexp_extract_all(folded, F.lit(NUMBER), F.lit(0)), lambda n: n.try_cast("double").cast("string"))
    return F.array_join(F.zip_with(between, numbers, lambda b, n: F.concat(b, F.coalesce(n, F.lit("")))), "")


def suite_cases(suite: Column, pattern: str = CASE) -> Column:
    """Array of (args, want), both by value, of every case of a suite; pattern: its two groups are arguments and expectation."""
    part = lambda i: F.transform(F.regexp_extract_all(suite, F.lit(pattern), F.lit(i)), by_value)
    return F.zip_with(part(1), part(2), lambda a, w: F.struct(a.alias("args"), w.alias("want")))


def arm_path(path: Column, arm: Column) -> Column:
    """The arm's name before the extension, or at the end where there is none."""
    stem, ext = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 2)
    return F.concat(stem, F.lit("."), arm, ext)


def camel(text: Column, separator: str = " ") -> Column:
    """The parts joined, each with its first letter in upper case."""
    return F.array_join(F.transform(F.split(text, separator), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), "")


def rename_ident(source: Column, old: str, new: str) -> Column:
    """Whole words `old` (a plain identifier) become `new`."""
    return F.regexp_replace(source, rf"\b{old}\b", new)


def problem_id(corpus: str, key: Column) -> Column:
    return F.concat(F.lit(f"{corpus}_"), key.cast("string"))
