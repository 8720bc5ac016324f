"""Fill-in-the-middle: texts cut at word boundaries into prefix, middle and suffix, by bit-parallel work on big integers.

A text becomes one big integer with a bit a code point (the first code point is the highest bit), set where bytes.translate
finds a letter. A unit starts where a bit is not both set and preceded by a set bit, so one shift and two boolean
operations mark all starts at once, and bit_count gives the number of units. The start of the k-th unit is found by
halving: the units of the upper half decide which half is searched further, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_LETTERS = bytes(0x31 if 65 <= c <= 90 or 97 <= c <= 122 else 0x30 for c in range(256))  # class mask: digits of a binary number


def starts(text: str) -> int:
    """A bit a code point, highest first: whether a unit ([A-Za-z]+ or one other code point) starts there."""
    n = len(text)
    if not n:
        return 0
    letters = int(text.encode("latin-1", "replace").translate(_LETTERS), 2)  # one byte a code point; what isn't Latin-1 is no letter
    return ((1 << n) - 1) ^ (letters & (letters >> 1))


def nth_start(bits: int, width: int, k: int) -> int:
    """The place, from the highest of `width` bits, of the k-th (from 0) set bit; k is below the number of set bits."""
    at = 0
    while width > 1:
        low = width >> 1
        upper = bits >> low
        n = upper.bit_count()
        if k < n:
            bits, width = upper, width - low
        else:
            bits, k, at, width = bits & ((1 << low) - 1), k - n, at + width - low, low
    return at


def draws(key: str, seed: int) -> list[int]:
    """Four numbers below 2**32 from the hash of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, key: str, seed: int, plain_from: int, spm_below: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, code points of prefix and middle (None if plain), output."""
    bits = starts(text)
    n = bits.bit_count()
    h = draws(key, seed)
    if not text or any(m in text for m in marks) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    ends = [nth_start(bits, len(text), k) if k < n else len(text) for k in sorted((h[0] % (n + 1), h[1] % (n + 1)))]
    prefix, middle, suffix = text[: ends[0]], text[ends[0] : ends[1]], text[ends[1] :]
    p, s, m = marks
    if h[3] % 100 < spm_below:
        return n, "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(df: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = MARKS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output: the whole transformed text.

    The cuts, the form and the order are drawn from a hash of seed and decimal key, so each row is done by itself (no
    shuffle) and a rerun gives the same. Null text: empty, and so plain. A text that holds a mark is plain, so every
    output can be undone (`restore`). A null key draws as the empty string. Repeated rows give repeated rows. Other
    columns aren't read. Empty table: no rows. A text of any length is done in linear work; texts over 16 MB go one a batch.
    """
    if len(set(marks)) < 3 or not all(marks) or any(a != b and a in b for a in marks for b in marks) or any(m[:i] == m[-i:] for m in marks for i in range(1, len(m))):
        raise ValueError("marks have to differ, and none may hold another or begin as it ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            keys, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            done = [cut(t or "", k or "", seed, plain_from, spm_below, marks) for k, t in zip(keys, texts)]
            columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    src = df.select(F.col(key).alias("key"), F.col(key).cast("string").alias("decimal"), F.col(text).alias("t"))
    out = src.mapInArrow(run, f"key {src.schema[0].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made from. No part holds a mark, so the first one found is the one put there."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 2**31 - 1)
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    after, before, between = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, between, after)).otherwise(output)


SQL = r"""
with d as (
    select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), u as (
    select doc_id, t, case when t = '' then [] else regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') end as units,
           cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
           cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
    from d
), c as (
    select doc_id, t, units, cast(len(units) as bigint) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
           case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from u
), p as (
    select doc_id, t, n, form, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:n], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
