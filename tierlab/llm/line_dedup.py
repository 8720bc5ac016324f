"""Line dedup: levelled sorted runs of line hashes; batches merge-anti-join the runs and add their own.

A run holds (key, docs), sorted: line hashes that no earlier run holds, and in how many documents of their first batch
they occur. A new batch is anti-joined with the runs; what is left is its own run at level 0, and what the runs know
goes to a levelled list of raises (key, docs). As soon as a level has `fan_in` tables, they are merged into one of the
next level, so n batches leave about fan_in * log(n) tables and each key is rewritten log(n) times. Tables are
bucketed by key, so no run is shuffled again for a batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, let, salted_join, shared_dir, stage

#: The characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; texts of ASCII alone take the cheaper function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column, min_chars: int) -> Column:
    """A 128-bit hash for each line of a text, in order; null where the key has under min_chars code points."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    keys = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.unhex(F.md5(k))))


class LineRuns:
    """The runs of one corpus, in a folder that all executors share, in as many buckets as the session has shuffle partitions."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 4):
        self.spark, self.fan_in = spark, fan_in
        self.path = path or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.raises: list[list[str]] = [[]]

    def _write(self, table: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        table.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            delete(self.spark, f"{self.path}/{name}")

    def _push(self, levels: list[list[str]], name: str) -> None:
        """Add a table at level 0 and merge full levels."""
        levels[0].append(name)
        level = 0
        while len(levels[level]) >= self.fan_in:
            full = levels[level]
            merged = self._write(self._sums(full))
            if len(levels) == level + 1:
                levels.append([])
            levels[level] = []
            levels[level + 1].append(merged)
            self._drop(full)
            level += 1

    def _sums(self, names: list[str]) -> DataFrame:
        plain = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[f"{self.path}/{n}" for n in names])  # a union of bucketed tables isn't dealt by its key, though its plan says so
        return plain.groupBy("key").agg(F.sum("docs").alias("docs"))

    def _unknown(self, rows: DataFrame) -> DataFrame:
        """rows without those whose key a run holds: a merge anti-join with each run."""
        for name in (n for level in self.levels for n in level):
            rows = rows.join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti")
        return rows

    def add(self, keys: DataFrame) -> None:
        """keys: a column `keys`, the line keys of one document a row. Adds the batch's run, and raises what the runs know."""
        lines = keys.select(F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
        batch = self._write(lines.groupBy("key").agg(F.count(F.lit(1)).alias("docs")))
        if not any(self.levels):
            self._push(self.levels, batch)
            return
        run = self._write(self._unknown(self.spark.table(batch)))
        met = self.spark.table(batch).join(self.spark.table(run).select("key").hint("merge"), "key", "left_anti")
        self._push(self.raises, self._write(met))
        self._push(self.levels, run)
        self._drop([batch])

    def counts(self) -> DataFrame:
        """key and docs over all batches; no rows before the first."""
        names = [n for level in self.levels + self.raises for n in level]
        return self._sums(names) if names else self.spark.createDataFrame([], "key string, docs long")

    def frequent(self, min_docs: int) -> DataFrame:
        """Staged: key and docs of the keys in at least min_docs documents."""
        return stage(self.counts().where(F.col("docs") >= min_docs), "frequent-lines")

    def novel(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """For incremental use: (key, line key) of the lines that no earlier batch has."""
        return self._unknown(keys.select(key, F.explode("keys").alias("key")).where("key is not null")).select(key, "key")

    def drop(self) -> None:
        self._drop([n for level in self.levels + self.raises for n in level])
        self.levels, self.raises = [[]], [[]]


def drop_frequent_lines(df: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df's columns, with text rid of every line whose key is in at least min_docs documents, and n_lines, n_dropped.

    The corpus goes through the runs in `batches` batches (by a hash of key and text). The lines are then joined to the
    keys that are in min_docs documents (a key of very many lines is dealt over many tasks), which gives the places of
    the lines to drop. A row is a document: repeated rows count as often as they occur, rows that share a key are each
    cleaned by themselves, null keys too. Null or empty text is one empty line, whose key is too short to drop; it
    becomes the empty string. Columns named n_lines or n_dropped are replaced.
    """
    spark = df.sparkSession
    named = df.drop("n_lines", "n_dropped")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = named.select(F.col(key).alias("_id"), F.md5(whole).alias("_h"), line_keys(F.col(text), min_chars).alias("keys"))
    staged = stage(rows.withColumn("batch", F.pmod(F.xxhash64("_id", "_h"), F.lit(batches)).cast("int")), "line-keys", ["batch"])
    runs = LineRuns(spark)
    try:
        for b in range(batches):
            runs.add(staged.where(F.col("batch") == b))
        frequent = runs.frequent(min_docs)
    finally:
        runs.drop()  # their tables are in the catalog
    lines = staged.select("_id", "_h", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    met = salted_join(lines, frequent.select("key"), "key", frequent.select("key", F.col("docs").alias("n")), ["_id", "_h", "pos"], "left_semi")
    hits = met.groupBy("_id", "_h").agg(F.collect_set("pos").alias("_hits")).withColumnRenamed("_h", "_h2")
    with_hits = named.withColumn("_h", F.md5(whole)).join(hits, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_h2")), "left")
    lines_of = lambda t: F.split(t, "\n", -1)
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_hits"), lambda i: F.get(x, i))
    kept = F.when(F.col("_hits").isNull(), whole).otherwise(let(lines_of(whole), lambda x: F.array_join(left(x), "\n")))
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    out = with_hits.withColumn("n_lines", n_lines.cast("long")).withColumn("n_dropped", F.coalesce(F.size("_hits"), F.lit(0)).cast("long")).withColumn(text, kept)
    return out.select(*named.columns, "n_lines", "n_dropped")


SQL = r"""
with rows as (
    select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), lines as (
    select r, doc_id, unnest(list_zip(ls, range(len(ls)))) as z from rows
), keyed as (
    select r, doc_id, z[2] as pos, z[1] as line,
           translate(regexp_replace(z[1], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from lines
), frequent as (
    select k from keyed where length(k) >= 1 group by k having count(distinct r) >= 10
)
select doc_id, cast(count(*) as bigint) as n_lines,
       cast(count(*) filter (where f.k is not null) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.k is null), '')) as kept_sha256
from keyed left join frequent f using (k) group by r, doc_id
"""
