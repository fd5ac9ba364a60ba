"""Stored tables: mappings, sessions, logs, decisions, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.operators.logs import latest_per_key
from bookmerge.schemas import DECISION, EVENT, FAILURE, MAPPING, SESSION, VERSION


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON or parquet table of a fixed schema; an empty one where there is no file. A corrupt file is an error."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.option("mode", "FAILFAST").json(path)


def load_mappings(spark: SparkSession, path: str) -> DataFrame:  # S09
    """The last entry of each left id (by sync time, then file order within a partition)."""
    rows = load(spark, path, MAPPING).withColumn("seq", F.struct("last_synced_at", F.monotonically_increasing_id().alias("at")))
    return latest_per_key(rows, "google_resource_name", "seq").drop("seq")


def load_events(spark: SparkSession, path: str) -> DataFrame:  # S14
    return load(spark, path, EVENT)


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, DECISION)


def load_failures(spark: SparkSession, path: str) -> DataFrame:
    return latest_per_key(load(spark, path, FAILURE), "id", "last_failed_at")


def read_index(spark: SparkSession, path: str) -> DataFrame:  # S11
    """Session index in the summary or the older full form, as summaries."""
    rows = spark.read.schema(f"{SESSION}, contact_versions array<struct<id:string>>").option("mode", "FAILFAST").json(path)
    return rows.withColumn("version_count", F.coalesce("version_count", F.when(F.col("contact_versions").isNotNull(), F.size("contact_versions")))).drop("contact_versions")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:  # S12
    """Versions; fields that an older file lacks are null."""
    return load(spark, path, VERSION)


def load_session(primary: DataFrame, fallback: DataFrame, session_id: str) -> DataFrame:  # S10
    """A session's versions from the primary place, else from the fallback."""
    both = primary.withColumn("place", F.lit(0)).unionByName(fallback.withColumn("place", F.lit(1))).where(F.col("session_id") == session_id)
    first = both.groupBy("session_id").agg(F.min("place").alias("place"))
    return both.join(first, ["session_id", "place"], "left_semi").drop("place")


#: A list of name families is a short table; a longer one is not one.
MOST_FAMILIES = 10_000


def load_nicknames(spark: SparkSession, path: str) -> tuple[tuple[str, ...], ...]:
    """Name families for ``Settings.nicknames``: a text file with one family a line, names parted by commas, in order."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("at")).orderBy("at").limit(MOST_FAMILIES + 1).collect()
    if len(lines) > MOST_FAMILIES:
        raise ValueError(f"more than {MOST_FAMILIES} name families")
    return tuple(tuple(n.strip().lower() for n in r["value"].split(",")) for r in lines)
