"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, secret scans, packing.

Each stage takes the documents that the one before kept and, but for the last, returns the columns of documents. Stages
read sf_dir only for the labels that the classifier learns from.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlab.llm import line_dedup, near_text, packing, quality, secrets
from tierlab.llm.common import documents, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No single SQL statement expresses training, SimHash or the packing program; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def _as_documents(df: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier accepts (grade 2 at least as likely as not); toxic and poor ones go."""
    model = quality.train(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.rate(docs.select(*COLUMNS), model, keep=list(COLUMNS)).where("accepted").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents share go, in all of them; a document that loses every line stays, empty."""
    return _as_documents(line_dedup.drop_frequent_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 one row stays: the smallest id (null last), ties by the text's hash.

    Rows are known by id and text together, so texts that share an id, or have none, are told apart.
    """
    row_of = lambda key, h: F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), h)  # noqa: E731  h has a fixed length
    found = near_text.simhash_components(docs.select("doc_id", "text"))
    least = found.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "h")).alias("least"))
    first = least.select(row_of("least.first", F.col("least.h")).alias("_row"))
    rows = docs.select(*COLUMNS).withColumn("_row", row_of("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)))
    return rows.dropDuplicates(["_row"]).join(first, "_row", "left_semi").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span the scan finds is replaced by a mark; all documents stay."""
    return _as_documents(secrets.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("simhash", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
