"""Available-now runs of the streaming jobs over the events table; results are tables in the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.operators.graph import shared_folder
from bookmerge.operators.store import KeyedStore
from bookmerge.streaming import jobs


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


#: Most files of a micro-batch, where results do not depend on the batch that brings an event.
FILES = 64


def _events(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    bound = {"maxFilesPerTrigger": str(files)} if files else {}
    return spark.readStream.schema(schema).options(**bound).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")


def _start(df: DataFrame, folder: str):
    return df.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts by user, all from the stream: a run over the events, then one in which the clock has gone on and open bursts are flushed."""
    folder = _folder(spark)
    e = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("timestamp"))
    latest = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.coalesce(F.max(F.col("ts").cast("timestamp")), F.timestamp_seconds(F.lit(0))).alias("timestamp"))
    latest.limit(0).write.parquet(f"{folder}/clock")
    clock = spark.readStream.schema("timestamp timestamp").parquet(f"{folder}/clock")
    for later in ("0 seconds", "3 hours"):  # the second is beyond the gap and the watermark
        latest.select((F.col("timestamp") + F.expr(f"interval {later}")).alias("timestamp")).write.mode("append").parquet(f"{folder}/clock")
        _start(jobs.burst_counts(e, "1 hour", "1 hour", clock=clock), folder).outputMode("append").format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    out = spark.read.schema("key long, start timestamp, end timestamp, n long").parquet(f"{folder}/out")
    return out.select("key", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "n")


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each key, from a store that each micro-batch brings up to date."""
    e = _events(spark, sf_dir, FILES).select(F.concat(F.lit("mac:"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").cast("long").alias("seq"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("kind"))
    folder = _folder(spark)
    store = lambda fold: KeyedStore(spark, f"{folder}/strikes", jobs.STRIKES, "key", fold)
    _start(e, folder).foreachBatch(jobs.strike_batches(store)).start().awaitTermination()
    return jobs.strike_totals(store(jobs.strike_fold()).read()).select("key", "strikes", F.col("skip").cast("int").alias("skip"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user: a change feed that bounded micro-batches put into a stored book."""
    e = _events(spark, sf_dir, FILES).select(F.col("user_id").cast("long").alias("key"), "event_type", F.col("event_id").cast("long").alias("seq"))
    folder = _folder(spark)
    store = KeyedStore(spark, f"{folder}/book", "key long, event_type string, seq long", "key", jobs.latest_fold("key", "seq"))
    _start(e, folder).foreachBatch(jobs.upsert_batches(store)).start().awaitTermination()
    return store.read()


AUDIT = "id long, action string, timestamp timestamp"


def audit(spark: SparkSession, sf_dir: str, days: int = 0, most: int | None = None) -> DataFrame:
    """The log of a stream in which every event comes twice; with ``days`` as of the last event."""
    e = _events(spark, sf_dir).select(F.col("event_id").cast("long").alias("id"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("timestamp"))
    folder = _folder(spark)
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    now = F.lit(last).cast("timestamp")
    _start(jobs.audit_log(e.unionByName(e)), folder).outputMode("append").foreachBatch(jobs.audit_batches(spark, f"{folder}/log", days, lambda _: now)).start().awaitTermination()
    kept = jobs.audit_rows(spark, f"{folder}/log", AUDIT, days, most, now)
    return kept.select("id", "action")
