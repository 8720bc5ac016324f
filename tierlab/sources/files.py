"""Readers and writers of the domain's files: record arrays, problem lines, reference trees, certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIER = "tier string, score double, correct boolean, true_correct boolean, cost long, timed_out boolean"
RECORD = f"rec_idx long, tiers array<struct<{TIER.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean').replace(' long', ':long')}>>, contaminated boolean, oracle_unsound boolean, oracle_inconclusive boolean, shadow boolean, cache_hit boolean, cache_correct boolean, cache_cost long"
#: The fields of a calibration record file; absent flags are false, an absent true label stays null.
RECORD_FILE = "id string, problem string, tiers array<struct<tier:string,score:double,correct:boolean,true_correct:boolean,cost_usd:double,disagreement_source:string,timed_out:boolean>>, cache_hit boolean, cache_correct boolean, cache_cost_usd double, contaminated boolean, oracle_unsound boolean, oracle_unsound_diag string, oracle_inconclusive boolean, shadow boolean"


#: The fields of the observation files (each one JSON array) and of a certificate file.
ESTIMATOR_FILE = "id string, tier string, generated_accept boolean, canonical_correct boolean, canonical_ran boolean, false_accept boolean, mutation_score double, mutation_valid long, mutation_killed long"
SELF_CONSISTENCY_FILE = "id string, tier string, budget_usd double, spent_usd double, over_budget_usd double, spec_usd double, fanout long, degenerate boolean, text_correct boolean, text_mass double, cluster_correct boolean, cluster_score double, cluster_abstained boolean, agreed boolean, skipped string"
SEEDED_FILE = "id string, kind string, seeds long, levels array<struct<level:string,judged:long,false_accept:long>>"
CERTIFICATE_FILE = "valid boolean, alpha double, delta double, n_calibration long, n_shadow long, n_excluded_contaminated long, n_excluded_oracle_unsound long, n_oracle_inconclusive long, n_timed_out long, method string, grid_size long, tiers array<string>, thresholds array<double>, empirical_risk double, realized_risk double, p_value double, expected_cost_usd double, mutation_score_mean double, note string, created_at string"


def read_array(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The rows of files that each hold one JSON array, with place, the row's number in its file; malformed text is an error."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{_as_struct(fields)}>>", {"mode": "FAILFAST"})).alias("place", "r"))
    return rows.select("place", "r.*")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def save_certificate(certificate: DataFrame, path: str) -> None:
    """One JSON object through the commit protocol; columns that the file format lacks are written too."""
    certificate.coalesce(1).write.mode("overwrite").json(path)


def load_certificate(spark: SparkSession, path: str) -> DataFrame | None:
    """The certificate at path, a folder as save_certificate writes it or one JSON file; None where there is none."""
    if not exists(spark, path):
        return None
    return spark.read.schema(CERTIFICATE_FILE).json(path, multiLine=True, mode="FAILFAST")


def with_provenance(rows: DataFrame, note: str, **facts) -> DataFrame:
    """One row: the note, the facts that the rows can't carry (sources, levels, seeds), and rows as an array in their own order.

    For reports, whose rows are as many as their parameters and not as the data's.
    """
    packed = rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("rows"))
    return packed.select(F.lit(note).alias("note"), *[F.lit(v).alias(k) for k, v in facts.items()], "rows")


def parse_records(lines: DataFrame) -> DataFrame:
    """Rows of JSON text `value` to records; malformed text is an error."""
    return lines.select(F.from_json("value", RECORD, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A record file (one JSON array) with rec_idx, the place in the file; costs in whole micro-dollars."""
    rows = read_array(spark, path, RECORD_FILE).withColumnRenamed("place", "rec_idx")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("cache_hit", "cache_correct", "contaminated", "oracle_unsound", "oracle_inconclusive", "shadow")]
    tiers = F.transform("tiers", lambda t: F.struct(t["tier"].alias("tier"), t["score"].alias("score"), t["correct"].alias("correct"), t["true_correct"].alias("true_correct"), t["cost_usd"].alias("cost"), F.coalesce(t["timed_out"], F.lit(False)).alias("timed_out")))
    return rows.select("rec_idx", "id", "problem", tiers.alias("tiers"), *flags, F.coalesce("cache_cost_usd", F.lit(0.0)).alias("cache_cost"))


def _as_struct(fields: str) -> str:
    depth, out = 0, []
    for part in fields.split(", "):
        name, kind = part.split(" ", 1)
        out.append(f"{name}:{kind}")
    return ",".join(out)


def parse_problems(lines: DataFrame) -> DataFrame:
    """line_no (physical, from 1) and value to id and problem; blank lines and // comments go."""
    body = F.trim("value")
    kept = lines.where((body != "") & ~body.startswith("//"))
    parsed = kept.select("line_no", F.from_json("value", "id string, problem string", {"mode": "FAILFAST"}).alias("p"))
    return parsed.select(F.coalesce(F.nullif("p.id", F.lit("")), F.format_string("p%03d", "line_no")).alias("id"), F.col("p.problem").alias("problem"))


def read_tree(spark: SparkSession, root: str, name: str = "solution.go") -> DataFrame:
    """id (the folder's name) and source of every file of that name below root; a repeated id is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("id"), F.col("content").cast("string").alias("source"))
    repeated = rows.groupBy("id").count().where("count > 1")
    clash = F.raise_error(F.concat(F.lit("repeated id "), F.col("id")))
    return rows.join(repeated, "id", "left").select(F.when(F.col("count").isNull(), F.col("id")).otherwise(clash).alias("id"), "source")


def write_atomic(df: DataFrame, path: str) -> None:
    """JSON through the commit protocol: readers see the old result or the new one."""
    df.write.mode("overwrite").json(path)
