"""Structured Streaming twins of the stateful batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.operators.logs import latest_per_key, prune_events
from bookmerge.operators.store import KeyedStore, exists, names, remove


def burst_counts(events: DataFrame, gap: str = "2 seconds", watermark: str = "10 seconds", key: str = "key", clock: DataFrame | None = None) -> DataFrame:  # R01
    """Flushes a burst's count once no event came for ``gap``; later ones than the watermark are dropped.

    ``clock`` is a stream of times (column timestamp) that moves the watermark where a source falls silent: an open burst is flushed as soon
    as the clock has passed its gap and the watermark, without an event of its own or of others. Clock rows have no key
    and are no events; events without a key are bursts of a key of their own.
    """
    rows = events.select(F.struct(F.col(key).alias("key")).alias("of"), "timestamp")
    if clock is not None:
        rows = rows.unionByName(clock.select(F.lit(None).cast(rows.schema["of"].dataType).alias("of"), "timestamp"))
    s = rows.withWatermark("timestamp", watermark).groupBy("of", F.session_window("timestamp", gap).alias("w")).agg(F.count("of").alias("n"), F.max("timestamp").alias("last"))
    # A test of the count, not of the key: that one would go below the watermark, and clock rows with it.
    return s.where("n > 0").select(F.col("of.key").alias(key), F.col("w.start").alias("start"), F.col("last").alias("end"), "n")


def open_strikes(parts: DataFrame) -> DataFrame:
    """What of the parts (key, kind, at, n) later ones can still change: each key's last reset, and its failures and ignores after that."""
    resets = parts.where("kind = 'reset'").groupBy("key").agg(F.max("at").alias("at"))
    last = resets.select(F.col("key").alias("reset_key"), F.col("at").alias("reset"))
    marks = parts.where("kind <> 'reset'").groupBy("key", "kind", "at").agg(F.sum("n").alias("n"))
    after = marks.join(last, F.col("key").eqNullSafe(F.col("reset_key")), "left").where(F.col("reset").isNull() | (F.col("at") > F.col("reset")))
    return after.select("key", "kind", "at", "n").unionByName(resets.select("key", F.lit("reset").alias("kind"), "at", F.lit(0).cast("long").alias("n")))


_RESET, _MARK = "reset", ("failure", "ignore")


def strike_parts(events: DataFrame) -> DataFrame:
    """Events (key, timestamp, seq, kind) as parts: failures count, success, clear and retry reset the row, ignore flags it."""
    kind = F.when(F.col("kind").isin(*_MARK), F.col("kind")).otherwise(_RESET)
    return events.select("key", kind.alias("kind"), F.struct("timestamp", "seq").alias("at"), F.lit(1).cast("long").alias("n"))


def strike_fold(expire: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """What a store of open strikes keeps of parts; a reset of a key without marks goes once it is older than ``expire``, the time before which no event comes any more."""

    def fold(parts: DataFrame) -> DataFrame:
        left = open_strikes(parts)
        if expire is None:
            return left
        marked = left.where(F.col("kind") != _RESET).select(F.col("key").alias("marked_key")).distinct().withColumn("marked", F.lit(True))
        left = left.join(marked, F.col("key").eqNullSafe(F.col("marked_key")), "left")
        return left.where(F.col("marked") | (F.col("kind") != _RESET) | (F.col("at.timestamp") >= expire)).select("key", "kind", "at", "n")

    return fold


STRIKES = "key string, kind string, at struct<timestamp:timestamp,seq:long>, n long"


def strike_batches(store: Callable[[Callable[[DataFrame], DataFrame]], KeyedStore], ttl: str | None = None) -> Callable[[DataFrame, int], None]:  # R02
    """A foreachBatch function over events (key, timestamp, seq, kind): their parts go into a store of open strikes, whose touched buckets alone are written.

    Aggregates and a join, so no task holds a key's rows; order is that of (timestamp, seq), whichever micro-batch brings an event. With
    ``ttl`` (an interval, no shorter than events are late) the state of a cleared key goes once a micro-batch with a time that much later reaches its bucket.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        parts = strike_parts(batch)
        expire = None
        if ttl is not None:
            latest = batch.agg(F.max("timestamp") - F.expr(f"interval {ttl}")).first()[0]
            expire = None if latest is None else F.lit(latest)
        store(strike_fold(expire)).step(parts, batch_id)

    return run


def strike_totals(parts: DataFrame) -> DataFrame:
    """(key, strikes, skip) of a store's parts; a key that has none left has no strikes."""
    by_key = open_strikes(parts).groupBy("key").agg(F.sum(F.when(F.col("kind") == "failure", F.col("n")).otherwise(0)).cast("int").alias("strikes"), F.bool_or(F.col("kind") == "ignore").alias("ignored"))
    return by_key.select("key", "strikes", ((F.col("strikes") >= 3) | F.col("ignored")).alias("skip"))


def latest_fold(key: str, seq: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: latest_per_key(rows, key, seq)


def upsert_batches(store: KeyedStore) -> Callable[[DataFrame, int], None]:  # R03
    """A foreachBatch function: the latest row of each key goes into the stored book.

    The book keeps the column that orders the feed, so batches may come in any order; a repeated one changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store.step(store.fold(batch), batch_id)

    return run


def audit_log(events: DataFrame, watermark: str = "1 day") -> DataFrame:  # R04
    """Each id once within the watermark."""
    return events.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["id"])


def audit_batches(spark: SparkSession, path: str, days: int, now: Callable[[DataFrame], Column] | None = None) -> Callable[[DataFrame, int], None]:  # R04
    """A foreachBatch function: rows go to their day's folder, then the days that lie wholly before the age limit go (0: none).

    A micro-batch has a file set of its own in each day, so a repeated one takes its own place. ``now`` gives the time of a batch; the clock by default.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("day", F.to_date("timestamp").cast("string")).withColumn("batch", F.lit(batch_id))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
        if days:
            at = now(batch) if now else F.current_timestamp()
            oldest = spark.range(1).select(F.to_date(at - F.make_dt_interval(F.lit(days))).cast("string")).first()[0]
            for name in names(spark, path):
                if name.startswith("day=") and name.removeprefix("day=") < oldest:
                    remove(spark, f"{path}/{name}")

    return run


def audit_rows(spark: SparkSession, path: str, schema: str, days: int, most: int | None, now: Column) -> DataFrame:
    """The log as its settings let it be seen: not older than ``days``, the newest ``most``; of the oldest day's folder only the rows inside the limit."""
    rows = spark.read.schema(f"{schema}, day string, batch long").parquet(path).drop("day", "batch") if exists(spark, path) else spark.createDataFrame([], schema)
    return prune_events(rows, days, most, now)
