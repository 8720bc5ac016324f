"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window Shannon entropy per character class.

A candidate is a maximal run of one character class. Its entropy is taken in every window of the class's width; going
on by one character changes two counts, so each step updates these two (counts are packed into a few longs) and the
sum of c * log2(c) by the character that comes and the one that goes: constant work a character. Runs that match the
allow-list are left out, and so are runs inside a base span. Work is linear in the text and about n**1.5 in the number
of its matches, whatever they are.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The base patterns by kind, with the group whose length counts and the least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)


@dataclass(frozen=True)
class CharClass:
    """run: the pattern of a maximal run of at least `width` characters of the alphabet; least_bits: the entropy of a window that is a finding."""

    run: str
    width: int
    least_bits: float
    alphabet: str


CLASSES = (
    CharClass(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9])", 24, 3.05, string.hexdigits),
    CharClass(r"[A-Za-z0-9+/_=-]{24,}", 24, 3.85, string.ascii_letters + string.digits + "+/_=-"),
)
#: Whole candidates that are no secrets: words, paths and names in words, rulers; numbers; ids with dashes.
ALLOW = (
    r"^[A-Za-z/_=+-]+$",
    r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)
#: Of a candidate, the part between / = _ - that holds one of these is no secret; what lies beside it is looked at.
PLACEHOLDER = r"(?i:example|placeholder|changeme|dummy|x{6})"
_SPAN = "struct<s:bigint,e:bigint,m:string,v:string>"
_TAGGED = "struct<s:bigint,k:int,e:bigint,kind:string,m:string,cls:int>"
#: Code points that redact holds as one string.
_BLOCK = 4096


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of the longs, all before it combined from 0 on. In chunks of about the root of their number, as appending copies the array."""
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def scan(items: Column, start: Column) -> Column:
        step = lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(items, F.struct(start.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def by_chunk(v: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda i: F.slice(v, i * width + 1, width))
        return let(chunks, lambda c: F.flatten(F.zip_with(c, scan(F.transform(c, lambda x: F.aggregate(x, zero, combine)), zero), scan)))

    return let(values, lambda v: F.when(F.size(v) > 0, by_chunk(v)).otherwise(none))


def matches(text: Column, pattern: str, group: int = 0, found: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as structs s, e (code points, end exclusive), m (the match), v (the group).

    The texts between the matches give the places: each start is the sum of all that lies before it. found: a column
    that holds all matches already.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if found is None else found
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def place(z: Column) -> Column:
        lengths = F.transform(z, lambda x: (F.length(x["gap"]) + F.length(x["m"])).cast("bigint"))

        def span(x: Column, before: Column) -> Column:
            s = before + F.length(x["gap"])
            return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["v"].alias("v"))

        return F.zip_with(z, running(lengths, lambda a, b: a + b), span)

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("m"), values.alias("v"))
    return F.when(F.size(found) > 0, let(zipped, place)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def window_entropy(s: Column, width: int, alphabet: str = "".join(map(chr, range(128)))) -> Column:
    """The largest Shannon entropy (bits) of a window of `width` characters of a string over an ASCII alphabet; null if it is shorter."""
    bits = width.bit_length()
    per = 63 // bits
    words = -(-len(alphabet) // per)
    plogp = [0.0 if n < 2 else n * math.log2(n) for n in range(width + 2)]
    rise = F.array(*[F.lit(plogp[n + 1] - plogp[n]) for n in range(width + 1)])
    fall = F.array(*[F.lit(plogp[max(n - 1, 0)] - plogp[n]) for n in range(width + 1)])
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), words).alias("n"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))
    shifted = lambda name, value, by: F.call_function(name, value, by)

    def step(state: Column, x: Column) -> Column:
        came, gone = x["came"], x["gone"]
        count = lambda c: shifted("shiftright", F.get(state["n"], c["word"]), c["bit"]).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        total = F.when(came["at"] == F.coalesce(gone["at"], F.lit(-1)), state["sum"]).otherwise(state["sum"] + F.get(rise, count(came)) + F.when(gone.isNull(), 0.0).otherwise(F.get(fall, count(gone))))
        one = lambda c, k: F.when(k == c["word"], shifted("shiftleft", F.lit(1).cast("bigint"), c["bit"])).otherwise(0)
        moved = F.struct(F.transform(state["n"], lambda v, k: v + one(came, k) - one(gone, k)).alias("n"), total.alias("sum"))
        return let(moved, lambda m: F.struct(m["n"].alias("n"), m["sum"].alias("sum"), F.when(x["full"], F.least(state["least"], m["sum"])).otherwise(state["least"]).alias("least")))

    def code(c: Column) -> Column:
        return let(F.position(c, F.lit(alphabet)) - 1, lambda at: F.struct(at.alias("at"), F.floor(at / per).cast("int").alias("word"), (at % per * bits).alias("bit")))

    codes = F.transform(F.slice(F.split(s, "", -1), F.lit(1), F.length(s)), code)
    moves = lambda c: F.transform(c, lambda came, i: F.struct(came.alias("came"), F.when(i >= width, F.get(c, i - width)).alias("gone"), (i >= width - 1).alias("full")))
    most = F.aggregate(let(codes, moves), start, step, lambda state: F.lit(math.log2(width)) - state["least"] / width)
    return F.when(F.length(s) >= width, most)


def _tagged(spans: Column, kind: str, order: int, cls: int | None = None) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), (F.lit("") if cls is None else x["m"]).alias("m"), F.lit(-1 if cls is None else cls).alias("cls")))


def _longer(least: int) -> Callable[[Column], Column]:
    return lambda x: F.length(x["v"]) >= least


def _parts(m: Column) -> Column:
    """The stretches of a candidate that are left without the parts that hold a placeholder."""
    tokens = F.split(m, r"(?<=[/=_-])|(?=[/=_-])", -1)
    left = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(PLACEHOLDER), " ").otherwise(t)), "")
    return F.when(m.rlike(PLACEHOLDER), F.split(left, " ", -1)).otherwise(F.array(m))


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The columns in `keep` (default doc_id), with `base` and `found`: arrays of structs s, k, e, kind, sorted by place and kind.

    base: the three fixed kinds. found: these and kind `entropy`. Null or empty text: empty arrays. No shuffle, no
    Python: a row's result depends on that row alone, repeated rows and null keys stay as they are. Other columns
    aren't read; keep may not name base or found.
    """
    keep = keep or ["doc_id"]
    if {"base", "found"} & set(keep):
        raise ValueError("base and found are columns of the result")
    ids = [f"_key{i}" for i in range(len(keep))]
    patterns = [p for _, p, _, _ in BASE] + [c.run for c in classes]
    out = df.select(*[F.col(c).alias(i) for c, i in zip(keep, ids)], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    out = out.select(*ids, "_t", *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"_m{i}") for i, p in enumerate(patterns)])
    spans = [F.filter(matches(F.col("_t"), p, g, F.col(f"_m{i}")), _longer(least)) for i, (_, p, g, least) in enumerate(BASE)]
    runs = [matches(F.col("_t"), c.run, 0, F.col(f"_m{len(BASE) + i}")) for i, c in enumerate(classes)]
    base = F.array_sort(F.concat(*[_tagged(x, kind, i) for i, (x, (kind, *_)) in enumerate(zip(spans, BASE))]).cast(f"array<{_TAGGED}>"))
    cands = F.concat(*[_tagged(x, "entropy", len(BASE), i) for i, x in enumerate(runs)]).cast(f"array<{_TAGGED}>")
    out = out.select(*ids, base.alias("_base"), cands.alias("_cands"))

    def secret(x: Column) -> Column:
        allowed = lambda p: reduce(lambda a, b: a | b, [p.rlike(a) for a in allow], F.lit(False))
        high = lambda p: reduce(lambda rest, ic: F.when(x["cls"] == ic[0], window_entropy(p, ic[1].width, ic[1].alphabet) >= ic[1].least_bits).otherwise(rest), enumerate(classes), F.lit(False))
        return F.exists(_parts(x["m"]), lambda p: F.when(allowed(p), False).otherwise(F.coalesce(high(p), F.lit(False))))

    plain = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))

    def judged(every: Column) -> Column:
        """Sorted by start, base spans first: a candidate lies inside one if the furthest end of those before it reaches its own."""
        ends = running(F.transform(every, lambda x: F.when(x["k"] < len(BASE), x["e"]).otherwise(0).cast("bigint")), lambda a, b: F.greatest(a, b))
        both = F.zip_with(every, ends, lambda x, end: F.struct(x.alias("x"), end.alias("end")))
        kept = F.filter(both, lambda y: F.when(y["x"]["k"] < len(BASE), True).when(y["end"] >= y["x"]["e"], False).otherwise(secret(y["x"])))
        return F.array_distinct(F.transform(kept, lambda y: plain(y["x"])))

    base = F.transform("_base", plain)
    found = F.when(F.size("_cands") > 0, let(F.array_sort(F.concat("_base", "_cands")), judged)).otherwise(base)
    return out.select(*[F.col(i).alias(c) for c, i in zip(keep, ids)], base.alias("base"), found.alias("found"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with each found span of the text replaced by a mark (overlapping spans by one); null texts stay null."""
    cols = df.columns
    names = {c: f"_in_{i}" for i, c in enumerate(cols)}
    t = names[text]
    scanned = scan(df.select(*[F.col(c).alias(names[c]) for c in cols]), t, list(names.values()))

    def piece(blocks: Column, s: Column, e: Column) -> Column:
        part = lambda i: F.substring(F.get(blocks, i), (F.greatest(s - i * _BLOCK, F.lit(0)) + 1).cast("int"), (F.least(e - i * _BLOCK, F.lit(_BLOCK)) - F.greatest(s - i * _BLOCK, F.lit(0))).cast("int"))
        block_of = lambda at: F.floor(at / _BLOCK).cast("int")
        return F.when(e > s, F.array_join(F.transform(F.sequence(block_of(s), block_of(e - 1)), part), "")).otherwise("")

    def clean(blocks: Column) -> Column:
        spans = F.col("found")
        before = running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
        both = F.zip_with(spans, before, lambda x, b: F.struct(x["s"].alias("s"), b.alias("b")))
        pieces = F.transform(F.filter(both, lambda y: y["s"] >= y["b"]), lambda y: F.array(piece(blocks, y["b"], y["s"]), F.lit(mark)))
        last = F.array_max(F.transform(spans, lambda x: x["e"]))
        return F.concat(F.array_join(F.flatten(pieces), ""), piece(blocks, last, F.length(t).cast("bigint")))

    marked = let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), clean)
    return scanned.select(*[(F.when(F.size("found") > 0, marked).otherwise(F.col(t)) if c == text else F.col(names[c])).alias(c) for c in cols])


def _sql() -> str:
    """The production scan in SQL: entropies from the counts of each whole window, place by place."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    a, c, h = (quote(p) for _, p, _, _ in BASE)
    run = quote(CLASSES[1].run)
    allow = " or ".join(f"regexp_matches(p, {quote(p)})" for p in ALLOW)
    held = quote(f"[A-Za-z0-9+]*{PLACEHOLDER}[A-Za-z0-9+]*")
    source = lambda k, kind, p, g, least: f"select doc_id, {k} as k, '{kind}' as kind, {least} as least, string_split_regex(t, {p}) as parts, regexp_extract_all(t, {p}) as ms, regexp_extract_all(t, {p}, {g}) as vs from d where regexp_matches(t, {p})"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), raw as (
    {source(0, "assign", a, 2, 8)} union all {source(1, "access", c, 0, 16)} union all {source(2, "hex", h, 0, 32)}
    union all {source(3, "hexrun", "'[A-Za-z0-9]{24,}'", 0, 24)} union all {source(4, "run", run, 0, 24)}
), placed as (select *, unnest(range(1, len(ms) + 1)) as i from raw),
spans as (
    select doc_id, k, kind, least, ms[i] as m, vs[i] as v,
           list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as s from placed
), base as (select doc_id, k, kind, s, s + length(m) as e from spans where k <= 2 and length(v) >= least),
cand as (
    select row_number() over () as id, doc_id, kind, m, s, s + length(m) as e from spans
    where (k = 4 or k = 3 and regexp_full_match(m, '[0-9A-Fa-f]+'))
      and not exists (select 1 from base b where b.doc_id = spans.doc_id and b.s <= spans.s and b.e >= spans.s + length(spans.m))
), pieces as (select id, kind, unnest(string_split(regexp_replace(m, {held}, ' ', 'g'), ' ')) as p from cand),
tried as (select row_number() over () as piece, * from pieces where length(p) >= 24 and not ({allow})),
windows as (select id, piece, kind, unnest(range(1, length(p) - 24 + 2)) as w, p from tried),
chars as (select id, piece, kind, w, unnest(string_split(substr(p, w, 24), '')) as ch from windows),
counted as (select id, piece, kind, w, ch, count(*) as n from chars group by all),
entropy as (select id, piece, kind, w, log2(24.0) - sum(n * log2(n)) / 24 as bits from counted group by all),
hits as (select distinct id from (select id from entropy group by id, piece, kind having max(bits) >= case kind when 'hexrun' then {CLASSES[0].least_bits} else {CLASSES[1].least_bits} end)),
found as (select * from base union all select distinct doc_id, 3, 'entropy', s, e from cand where id in (select id from hits)),
b as (select doc_id, count(*) filter (k = 0) as a, count(*) filter (k = 1) as c, count(*) filter (k = 2) as h, string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k, e) as t from base group by doc_id),
f as (select doc_id, string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k, e) as t from found group by doc_id)
select d.doc_id, cast(coalesce(a, 0) as bigint) as n_assign, cast(coalesce(c, 0) as bigint) as n_access, cast(coalesce(h, 0) as bigint) as n_hex, sha256(coalesce(b.t, '')) as base_sha256, coalesce(f.t, '') as spans
from d left join b using (doc_id) left join f using (doc_id)"""


SQL = _sql()
