"""Queries of the text functions and of similarity retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ingest as I
from ..operators import similarity as M
from ..operators import studies as D
from ..sources import bindings as B
from . import sql as S
from .registry import query

NORM = r"lower(trim(regexp_replace({0}, '[ \t\n\r\f\x0B]+', ' ', 'g')))"
N = NORM.format("text")


@query(f"select doc_id, sha256({N}) as normalized from documents")
def normalize_text(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("normalized"))


@query(f"select doc_id, substr(sha256({N}), 1, 32) as hash from documents")
def problem_hash(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.problem_hash(F.col("text")).alias("hash"))


def _grams(table: str, key: str) -> str:
    return f"(select id, len(gs) as size, unnest(gs) as g from {_gram_lists(table, key)})"


def _gram_lists(table: str, key: str) -> str:
    return f"(select id, list_filter(list_distinct(list_transform(list_zip(c, c[2:], c[3:]), lambda z: z[1] || z[2] || z[3])), lambda g: g is not null) as gs from (select {key} as id, string_split({NORM.format('text')}, '') as c from {table}))"


@query(f"select item_id, cast(count(*) as bigint) as n from (select id as item_id, g from {_grams('benchmark', 'item_id')}) group by item_id")
def trigrams(spark, sf):
    return M.grams(B.table(spark, sf, "benchmark"), "item_id", "text").groupBy(F.col("id").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))


_SIM = """x as (select a.id as a, b.id as b, a.size as na, b.size as nb, count(*) as common from {l} a join {r} b on a.g = b.g {on} group by 1, 2, 3, 4),
sims as (select a, b, cast(common as double) / (na + nb - common) as sim from x)"""
_BB = f"with bench as materialized (select * from {_grams('benchmark', 'item_id')}), " + _SIM


@query(_BB.format(l="bench", r="bench", on="and a.id < b.id") + " select a, b, round(sim, 9) as sim from sims")
def trigram_jaccard(spark, sf):
    g = M.grams(B.table(spark, sf, "benchmark"), "item_id", "text")
    return M.jaccard(g, g).where("a < b").select("a", "b", F.round("sim", 9).alias("sim"))


@query(_BB.format(l="bench", r="bench", on="and a.id > b.id") + ", m as (select item_id, coalesce(max(sim), 0.0) as best from benchmark left join sims on a = item_id group by item_id) select item_id, round(best, 9) as best, best >= 0.35 as candidate from m")
def warm_candidacy(spark, sf):
    """Each item against all earlier ones: the best similarity a cache filled in order could offer."""
    bench = B.table(spark, sf, "benchmark")
    out = M.best_prior(bench.select(F.col("item_id").alias("id"), "text")).withColumnRenamed("id", "item_id")
    return out.select("item_id", F.round("best", 9).alias("best"), (F.col("best") >= 0.35).alias("candidate"))


@query(_BB.format(l="bench", r="bench", on="and a.id < b.id") + " select a, b, round(sim, 9) as sim from sims order by sims.sim desc, a desc, b desc limit 20")
def top_pairs(spark, sf):
    return M.top_pairs(B.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), 20).select("a", "b", F.round("sim", 9).alias("sim"))


@query(f"""with dg as materialized (select * from {_grams('documents', 'doc_id')}), bench as materialized (select * from {_grams('benchmark', 'item_id')}),
x as (select a.id as a, b.id as b, a.size as na, b.size as nb, count(*) as common from bench a join dg b on a.g = b.g group by 1, 2, 3, 4),
s as (select a, b, cast(common as double) / (na + nb - common) as sim from x where cast(common as double) / (na + nb - common) >= 0.35
      union all select q.item_id, d.doc_id, 1.0 from benchmark q join documents d on {NORM.format('q.text')} = {NORM.format('d.text')}),
m as (select a, b, max(sim) as sim from s group by a, b),
r as (select a, b, sim, row_number() over (partition by a order by sim desc, b % 10 desc, b) as place from m)
select a as item_id, b as doc_id, round(sim, 9) as sim, place from r where place <= 5""")
def cache_retrieve(spark, sf):
    """The five stored texts most like each benchmark item (score: doc_id % 10), floor 0.35."""
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    s = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 10).cast("double").alias("score"))
    return M.retrieve(q, s).select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), F.round("sim", 9).alias("sim"), F.col("place").cast("long").alias("place"))


_KEY = f"substr(sha256({N} || chr(1) || 'pin' || chr(1) || 'api'), 1, 32)"


@query(f"with k as (select doc_id, {_KEY} as h from documents), s as (select h, min(doc_id) as spec from k group by h) select doc_id, spec from k join s using (h)")
def spec_lookup(spark, sf):
    """Point lookup of each problem's spec by a salted hash of problem, pin and API; one spec a key."""
    h = F.substring(F.sha2(F.concat_ws("\x01", X.normalize(F.col("text")), F.lit("pin"), F.lit("api")), 256), 1, 32)
    k = B.table(spark, sf, "documents").select("doc_id", h.alias("h"))
    return k.join(k.groupBy("h").agg(F.min("doc_id").alias("spec")), "h").select("doc_id", "spec")


@query("select conv_id, turn, case when regexp_matches(r, '(?i)VERDICT:\\s*(PASS|FAIL)') then upper(regexp_extract(r, '(?i)VERDICT:\\s*(PASS|FAIL)', 1)) = 'PASS' end as pass from (select conv_id, turn, case (conv_id + turn) % 4 when 0 then text || ' Verdict: pass' when 1 then 'VERDICT: FAIL then verdict: PASS ' || text when 2 then text else 'verdict:' || chr(10) || 'fail' end as r from conversations)")
def parse_verdict(spark, sf):
    n = (F.col("conv_id") + F.col("turn")) % 4
    r = F.when(n == 0, F.concat("text", F.lit(" Verdict: pass"))).when(n == 1, F.concat(F.lit("VERDICT: FAIL then verdict: PASS "), "text")).when(n == 2, F.col("text")).otherwise(F.lit("verdict:\nfail"))
    return B.table(spark, sf, "conversations").select("conv_id", "turn", X.parse_verdict(r).alias("pass"))


@query("with l as (select doc_id, split_part(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), chr(10), 1) as line from documents) select doc_id, case when length(line) > 60 then substr(line, 1, 60) || '...' else line end as line from (select doc_id, trim(line) as line from l)")
def first_line(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.first_line(F.col("text"), 60).alias("line"))


@query("select doc_id, 'raw:' || substr(sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), 1, 16) as key from documents")
def text_key_raw(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.raw_text_key(F.col("text")).alias("key"))


@query("select page_id, case when length(s) <= 64 then s else substr(s, 1, 55) || '-' || substr(sha256(url), 1, 8) end as slug from (select page_id, url, regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g') as s from pages)")
def slug(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query("select p_partkey, regexp_replace(split_part(m, '/', -1), '^(us-gov|us|eu|apac|global)\\.', '') as identity from (select p_partkey, 'arn:x/' || case p_partkey % 3 when 0 then 'us.' when 1 then 'eu.' else '' end || replace(p_name, ' ', '-') as m from part)")
def model_identity(spark, sf):
    n = F.col("p_partkey") % 3
    m = F.concat(F.lit("arn:x/"), F.when(n == 0, "us.").when(n == 1, "eu.").otherwise(""), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    return B.table(spark, sf, "part").select("p_partkey", X.model_identity(m).alias("identity"))


@query("select page_id, position('.' in split_part(regexp_replace(url, '^https?://', ''), '/', 1)) = 0 as stdlib, position('.' in split_part('net/http/' || page_id, '/', 1)) = 0 as std2 from pages")
def is_stdlib(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", X.is_stdlib(F.regexp_replace("url", "^https?://", "")).alias("stdlib"), X.is_stdlib(F.concat(F.lit("net/http/"), F.col("page_id").cast("string"))).alias("std2"))


@query("select o_orderkey as id, cast(o_orderkey % 5 + 1 as integer) as small, cast(o_orderkey % 3 as integer) as mid from orders")
def parse_kv(spark, sf):
    kv = F.format_string("small=%d,mid= %d", F.col("o_orderkey") % 5 + 1, F.col("o_orderkey") % 3)
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.parse_pairs(kv).alias("m")).select("id", F.col("m")["small"].alias("small"), F.col("m")["mid"].alias("mid"))


@query("select page_id, regexp_replace(url, '(\\.[^./]*)?$', '') as stem, case when regexp_matches(url, '\\.[^./]*$') then regexp_extract(url, '^(.*?)(\\.[^./]*)?$', 1) || '.judge' || regexp_extract(url, '(\\.[^./]*)$', 1) else url || '.judge' end as path from pages")
def arm_path(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"(\.[^./]*)?$", "").alias("stem"), X.arm_path(F.col("url"), F.lit("judge")).alias("path"))


@query(f"{S.OBS}, f as (select tier, cast(count(*) as bigint) as n, cast(count(*) filter (not truth) as bigint) as bad from obs group by tier) select tier, case when bad = 0 then tier || ': no errors in ' || n else tier || ': ' || bad || ' of ' || n || ' wrong' end as verdict from f")
def verdict_text(spark, sf):
    from ..operators import policy as P

    f = P.observations(B.records(spark, sf)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("truth")).alias("bad"))
    return f.select("tier", F.when(F.col("bad") == 0, F.format_string("%s: no errors in %d", "tier", "n")).otherwise(F.format_string("%s: %d of %d wrong", "tier", "bad", "n")).alias("verdict"))


_REPLY = r"""case (conv_id + turn) % 8
    when 0 then 'see ```go' || chr(10) || 'package a' || conv_id || chr(10) || '``` and ```' || chr(10) || 'x```'
    when 1 then chr(160) || ' package b' || turn || chr(10) when 2 then text
    when 3 then '```python' || chr(10) || 'print(' || turn || ')' || chr(10) || '```' || chr(10) || 'then' || chr(10) || '```go' || chr(10) || 'package c' || chr(10) || '```'
    when 4 then 'x ```golang' || chr(9) || ' ' || chr(13) || chr(10) || chr(10) || '  package d' || conv_id || '  ' || chr(10) || '``` y'
    when 5 then '```Go' || chr(10) || 'package e```' when 6 then '```' || chr(10) || '```' || text else '```go package f```' || text end"""


@query(rf"""with r as (select conv_id, turn, {_REPLY} as r from conversations), c as (
    select conv_id, turn, r, regexp_matches(r, '(?s)```(?:go|golang)?\s*\n(.*?)```') as fenced, regexp_extract(r, '(?s)```(?:go|golang)?\s*\n(.*?)```', 1) as block from r)
select conv_id, turn, case when fenced then regexp_replace(block, '^[\s\x85\xA0]+|[\s\x85\xA0]+$', '', 'g') when contains(r, 'package ') then regexp_replace(r, '^[\s\x85\xA0]+|[\s\x85\xA0]+$', '', 'g') end as code from c""")
def extract_code(spark, sf):
    """Blocks of Go, without a tag, of other languages before them, with blanks after the tag, empty ones, and replies without any."""
    c, t, text = F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("text")
    kinds = [
        F.concat(F.lit("see ```go\npackage a"), c, F.lit("\n``` and ```\nx```")), F.concat(F.lit("\xa0 package b"), t, F.lit("\n")), text,
        F.concat(F.lit("```python\nprint("), t, F.lit(")\n```\nthen\n```go\npackage c\n```")), F.concat(F.lit("x ```golang\t \r\n\n  package d"), c, F.lit("  \n``` y")),
        F.lit("```Go\npackage e```"), F.concat(F.lit("```\n```"), text), F.concat(F.lit("```go package f```"), text),
    ]
    reply = F.get(F.array(*kinds), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    return B.table(spark, sf, "conversations").select("conv_id", "turn", X.extract_code(reply).alias("code"))


_SPEC = r"""'intro # API' || chr(10) || case conv_id % 7 when 3 then 'API' else '## API  ' end || chr(10) || 'Some prose first.' || chr(10) || chr(10) || '```go' || chr(10) || 'api' || conv_id || chr(10) || '```' || chr(10)
    || '# visible tests' || chr(10) || chr(10) || case conv_id % 7 when 4 then '```python' || chr(10) || 'v```' else '```' || chr(10) || 'v' || chr(10) || '``` and ```' || chr(10) || 'w```' end || chr(10)
    || '###### Hidden Tests' || chr(10) || '```golang ' || chr(10) || case conv_id % 7 when 5 then ' ' else 'h1' end || '```' || chr(10)
    || case conv_id % 7 when 1 then '### HIDDEN TESTS' || chr(10) || '```' || chr(10) || 'h2```' when 2 then '### HIDDEN TESTS' || chr(10) || 'no block' when 6 then '####### API' || chr(10) || '#APIs' || chr(10) else '' end"""


@query(rf"""with r as (select distinct conv_id, {_SPEC} as r from conversations), s as (
    select conv_id, list_transform(regexp_extract_all(r, '(?mi)^#{{1,6}}\s*(API|VISIBLE TESTS|HIDDEN TESTS)\s*$', 1), lambda x: upper(x)) as names,
           list_transform(regexp_split_to_array(r, '(?mi)^#{{1,6}}\s*(?:API|VISIBLE TESTS|HIDDEN TESTS)\s*$')[2:], lambda b: case when regexp_matches(b, '(?s)```(?:go|golang)?\s*\n(.*?)```') then regexp_replace(regexp_extract(b, '(?s)```(?:go|golang)?\s*\n(.*?)```', 1), '^\s+|\s+$', '', 'g') end) as codes from r
), k as (
    select conv_id, names, codes, list_filter(list_zip(names, codes), lambda z: z[1] = 'API')[-1][2] as api, list_filter(list_zip(names, codes), lambda z: z[1] = 'VISIBLE TESTS')[-1][2] as visible, list_filter(list_zip(names, codes), lambda z: z[1] = 'HIDDEN TESTS')[-1][2] as hidden from s
), w as (
    select *, len(names) >= 3 and len(list_filter(codes, lambda c: c is null)) = 0 and api <> '' and visible <> '' and hidden <> '' as whole from k)
select conv_id, case when whole then api end as api, case when whole then visible end as visible, case when whole then hidden end as hidden from w""")
def parse_spec(spark, sf):
    """Prose before blocks, headings in other depths and inside lines, repeated and blank sections, sections without a block."""
    c, n = F.col("conv_id").cast("string"), F.col("conv_id") % 7
    body = F.concat(
        F.lit("intro # API\n"), F.when(n == 3, "API").otherwise("## API  "), F.lit("\nSome prose first.\n\n```go\napi"), c, F.lit("\n```\n# visible tests\n\n"),
        F.when(n == 4, "```python\nv```").otherwise("```\nv\n``` and ```\nw```"), F.lit("\n###### Hidden Tests\n```golang \n"), F.when(n == 5, " ").otherwise("h1"), F.lit("```\n"),
        F.when(n == 1, "### HIDDEN TESTS\n```\nh2```").when(n == 2, "### HIDDEN TESTS\nno block").when(n == 6, "####### API\n#APIs\n").otherwise(""),
    )
    found = B.table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", X.parse_spec(body).alias("s"))
    return found.select("conv_id", "s.api", "s.visible", "s.hidden")


@query("""with e as (select user_id, event_id, event_type, event_id % 3 as test from events where event_type in ('click','error','view')), a as (select user_id, test, case event_type when 'click' then 'pass' when 'error' then 'fail' else 'output' end as action, event_id from e)
select user_id, test, arg_max(action, event_id) as outcome from a where action <> 'output' group by user_id, test""")
def parse_test_events(spark, sf):
    """NDJSON test events: the last pass or fail of each test."""
    e = B.table(spark, sf, "events").where(F.col("event_type").isin("click", "error", "view"))
    action = F.when(F.col("event_type") == "click", "pass").when(F.col("event_type") == "error", "fail").otherwise("output")
    lines = e.select("user_id", "event_id", F.to_json(F.struct(action.alias("Action"), (F.col("event_id") % 3).cast("string").alias("Test"))).alias("line"))
    return D.test_outcomes(lines, "user_id", "event_id").withColumn("test", F.col("test").cast("long"))


@query("""with c as (select user_id, case event_id % 4 when 0 then event_id % 97 when 1 then greatest(event_id % 11, event_id % 13) when 3 then 0 end as n from events)
select user_id, max(n) as worst from c group by user_id""")
def parse_allocs(spark, sf):
    """Benchmark lines with times and bytes before the count, two lines a text, lines without one, and a count beyond 64 bits."""
    i = F.col("event_id")
    bench = lambda k: F.concat(F.format_string("BenchmarkX-8   %d   231.5 ns/op   48 B/op   %d", i + 5000000, k), F.lit("\tallocs/op\n"))
    text = F.when(i % 4 == 0, bench(i % 97)).when(i % 4 == 1, F.concat(bench(i % 11), bench(i % 13))).when(i % 4 == 3, F.lit("9" * 25 + " allocs/op")).otherwise(F.format_string("BenchmarkY-8 %d 12 ns/op", i))
    return D.worst_allocs(B.table(spark, sf, "events").select("user_id", text.alias("out")), "user_id", "out")


@query("""with e as (select user_id, event_id, event_id % 9 as n, event_type, props from events where event_type in ('view','error','click')),
l as (select user_id, event_id, case n when 0 then 'note ' || trim(props) when 1 then 'out ' || event_type when 2 then '    --- FAIL: x' end as line from e where n in (0, 1, 2)),
s as (select user_id, string_agg(line, chr(10) order by event_id) as summary from l group by user_id)
select user_id, coalesce(trim(summary, ' '), 'no output') as summary from (select distinct user_id from e) left join s using (user_id)""")
def summarise_output(spark, sf):
    """Plain lines, output events, the noise of passing tests, other actions and broken lines; in order of the lines."""
    e = B.table(spark, sf, "events").where(F.col("event_type").isin("view", "error", "click"))
    event = lambda action, text: F.to_json(F.struct(F.lit(action).alias("Action"), F.lit("T").alias("Test"), text.alias("Output")))
    lines = [
        F.concat(F.lit("  note "), F.trim("props"), F.lit("\t")), event("output", F.concat(F.lit("out "), F.col("event_type"), F.lit("\n"))), event("output", F.lit("    --- FAIL: x\n\n")), event("output", F.lit("=== RUN   x\n")),
        event("output", F.lit("--- PASS: x (0.00s)\n")), event("output", F.lit("ok  \tpkg\t0.1s\n")), event("output", F.lit("PASS\n")), event("run", F.lit("hidden")), F.lit('{"Action":"output","Output":'),
    ]
    return D.summarise_output(e.select("user_id", "event_id", F.get(F.array(*lines), (F.col("event_id") % 9).cast("int")).alias("line")), "user_id", "event_id", fallback="no output")


@query("select p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) as camel, regexp_replace(p_name, '\\bring\\b', 'hoop', 'g') as renamed, 'part_' || p_partkey as id from part")
def ingest_strings(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", X.camel(F.col("p_name")).alias("camel"), X.rename_ident(F.col("p_name"), "ring", "hoop").alias("renamed"), X.problem_id("part", F.col("p_partkey")).alias("id"))


@query("""select o_custkey, cast(o_orderkey % 5 - 2 as double) as a, (o_orderkey % 4) / 2.0 as b, cast(count(distinct w) as bigint) as n
from (select *, case when o_orderkey % 6 = 0 then '1' else o_orderstatus end as w from orders) group by 1, 2, 3 having count(distinct w) > 1""")
def contradiction(spark, sf):
    """Cases of two numbers and a string: signs, fractions, spellings (3, 3.0, 3.00), blanks, and answers spelled 1 or 1.0."""
    k = F.col("o_orderkey")
    a = F.when(k % 2 == 0, F.format_string("%d", k % 5 - 2)).otherwise(F.format_string("%d.0", k % 5 - 2))
    b = F.when(k % 3 == 0, F.format_string("%d.%d0", F.floor((k % 4) / 2).cast("int"), (k % 2) * 5)).otherwise(F.format_string("  %d.%d", F.floor((k % 4) / 2).cast("int"), (k % 2) * 5))
    want = F.when(k % 6 == 0, F.when(k % 12 == 0, "1").otherwise("1.0")).otherwise(F.col("o_orderstatus"))
    row = F.concat(F.lit("{actual: candidate("), a, F.lit(",\n "), F.trim(b), F.lit(', "x  )y"'), F.lit("), expected:  "), want, F.lit(" },"))
    found = D.contradictions(B.table(spark, sf, "orders").select("o_custkey", row.alias("suite")), "o_custkey")
    part = lambda i: F.trim(F.get(F.split("args", ","), F.lit(i))).cast("double")
    return found.select("o_custkey", part(0).alias("a"), part(1).alias("b"), "n")


@query(f"""with n as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_matches(html, '<h1>[^<]*</h1>') as has from pages), ok as (select page_id, title from n where has and title <> '' order by page_id limit 50) select page_id, title from ok""")
def ingest_gates(spark, sf):
    """A shape gate, then the first fifty by id (the limit is the feature)."""
    p = B.table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").rlike("<h1>[^<]*</h1>").alias("has"))
    return p.where("has and title <> ''").orderBy("page_id").limit(50).select("page_id", "title")


_PART = "select p_partkey as k, 'name_' || (p_partkey % 7) || '_OF_' || p_partkey as snake, p_name from part"
_SIG = "'func Name' || (k % 7) || 'Of' || k || '(xs []int, y int)' || case k % 3 when 0 then '' when 1 then ' bool' else ' []interface{}' end"


@query(f"""with p as ({_PART}), o as (
    select *, {_SIG} as sig, 'Name' || (k % 7) || 'Of' || k as fn, case when k % 11 = 0 or k % 13 = 0 or k % 17 = 0 then 'shape' when k % 5 = 0 then 'contradictory' else 'ingested' end as outcome from p)
select case when k % 2 = 0 then 'he_' || snake else 'mbpp_' || snake end as id, outcome, case when outcome <> 'shape' then fn end as fn, case when outcome <> 'shape' then sig end as sig,
       case when outcome <> 'shape' then case k % 3 when 0 then '' when 1 then 'bool' else '[]interface{{}}' end end as ret,
       case when outcome <> 'shape' then sha256('Write ' || p_name || '.' || chr(10) || '>>> ' || fn || '([1], 2)' || chr(10) || snake || '_x' || chr(10) || chr(10) || 'Implement this as an exported Go function with exactly this signature:' || chr(10) || '    ' || sig || chr(10) || 'Use only the standard library.') end as problem,
       case when outcome <> 'shape' then sha256('package solution' || chr(10) || chr(10) || 'import (' || chr(10) || chr(9) || '"fmt"' || chr(10) || chr(9) || '"testing"' || chr(10) || ')' || chr(10) || chr(10) || 'func TestCanonical(t *testing.T) {{' || chr(10) || 'candidate := ' || fn || chr(10)
           || '{{actual: candidate(3, ' || (k % 4) || '.0), expected: 1}},' || chr(10) || '{{actual: candidate(3.0, ' || (k % 4) || '), expected: ' || case when k % 5 = 0 then 2 else 1 end || '}},' || chr(10) || '}}' || chr(10)) end as suite from o""")
def ingest_rows(spark, sf):
    """Rows of a published corpus: prompts and suites of the expected shape or not, contradictory suites, names to rename."""
    k, name = F.col("p_partkey"), F.col("p_name")
    snake = F.concat(F.lit("name_"), (k % 7).cast("string"), F.lit("_OF_"), k.cast("string"))
    ret = F.when(k % 3 == 0, "").when(k % 3 == 1, "bool").otherwise("[]interface{}")
    comment = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("// Write "), name, F.lit(".\n//   >>> "), snake, F.lit("([1], 2)\n// "), snake, F.lit("_x\n")))
    prompt = F.concat(F.lit("package main\n\n"), comment, F.lit("func "), snake, F.lit("( xs []int, y int ) "), ret, F.when(k % 13 == 0, "\n").otherwise(" {\n"))
    head = F.when(k % 17 == 0, "func Check() {\n").otherwise(F.concat(F.lit("func Test_"), snake, F.lit("(t *testing.T) {\n")))
    fourth = (k % 4).cast("string")
    tests = F.concat(F.lit("\n"), head, F.lit("candidate := "), snake, F.lit("\n{actual: candidate(3, "), fourth, F.lit(".0), expected: 1},\n{actual: candidate(3.0, "), fourth, F.lit("), expected: "), F.when(k % 5 == 0, "2").otherwise("1"), F.lit("},\n}\n"))
    rows = B.table(spark, sf, "part").select(F.concat(F.when(k % 2 == 0, "HumanEval_").otherwise("mbpp_"), snake).alias("name"), prompt.alias("prompt"), tests.alias("tests"))
    return I.gated(rows).select("id", "outcome", "fn", "sig", "ret", F.sha2("problem", 256).alias("problem"), F.sha2("suite", 256).alias("suite"))
