"""Event logs, the failure ledger and small stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def latest_per_key(df: DataFrame, key: str | list[str], seq: str) -> DataFrame:  # W07
    """The last row of each key by seq; combined before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*").select(*df.columns)


def upsert(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:  # K04, K11, R03
    return store.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete_keys(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:  # K04, K11
    return store.join(keys.select(key).distinct(), key, "left_anti")


def unlink(mapping: DataFrame, ledger: DataFrame, left_ids: DataFrame) -> tuple[DataFrame, DataFrame]:  # O39
    """mapping and ledger without these left ids (column google_resource_name) and the failures of both halves."""
    gone = mapping.join(left_ids.distinct(), "google_resource_name", "left_semi")
    keys = gone.select(F.explode(F.array(F.concat(F.lit("google:"), "google_resource_name"), F.concat(F.lit("mac:"), "mac_contact_identifier"))).alias("id"))
    return delete_keys(mapping, left_ids, "google_resource_name"), delete_keys(ledger, keys, "id")


def import_sessions(existing: DataFrame, incoming: DataFrame) -> DataFrame:  # S13
    return existing.unionByName(incoming.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti"), allowMissingColumns=True)


def prune_events(events: DataFrame, days: int, most: int | None, now: Column) -> DataFrame:  # W03
    """Events not older than ``days`` (0: any age), the newest ``most`` of them (None: all); a top-k, no global window."""
    kept = events if days == 0 else events.where(F.col("timestamp") >= now - F.make_dt_interval(F.lit(days)))
    return kept if most is None else kept.orderBy(F.desc("timestamp"), F.desc("id")).limit(most)


def strike_islands(attempts: DataFrame, order: list[str]) -> DataFrame:
    """attempts (key, failed) with island: the number of successes so far of the key."""
    w = W.partitionBy("key").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return attempts.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))


def strike_counts(attempts: DataFrame, order: list[str], limit: int = 3) -> DataFrame:  # W05
    """(key, strikes, last_failed_at, skip): failures since the key's last success.

    Without a window: the last success of each key, then a join and a count, so a hot key is
    combined before the shuffle.
    """
    at = F.struct(*order)
    last = attempts.where(~F.col("failed")).groupBy("key").agg(F.max(at).alias("success"))
    after = attempts.where("failed").withColumn("at", at).groupBy("key", "at").agg(F.max(order[0]).alias("t"), F.count("*").alias("n"))
    rows = after.join(last, "key", "left").where(F.col("success").isNull() | (F.col("at") > F.col("success")))
    hit = rows.groupBy("key").agg(F.sum("n").alias("strikes"), F.max("t").alias("last_failed_at"))
    keys = attempts.select("key").distinct()
    return keys.join(hit, "key", "left").select("key", F.coalesce("strikes", F.lit(0)).alias("strikes"), "last_failed_at", (F.coalesce("strikes", F.lit(0)) >= limit).alias("skip"))


def circuit_breaker(attempts: DataFrame, order: list[str], limit: int = 3, run: str = "run") -> DataFrame:  # W06
    """attempts (run, failed) with skipped: true after the run's first streak of ``limit`` failures."""
    w = W.partitionBy(run).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = attempts.withColumn("_s", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(upto))
    streak = W.partitionBy(run, "_s").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_k", F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(streak))
    opened = F.max(F.when(F.col("_k") >= limit, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("skipped", F.coalesce(opened, F.lit(0)) == 1).drop("_s", "_k")


def apply_ledger_events(ledger: DataFrame, events: DataFrame, limit: int = 3) -> DataFrame:  # K12
    """ledger (id, failure_count, last_failed_at, ignored) after events (id, timestamp, seq, kind).

    kind: failure adds one; clear and success remove the row; ignore sets the flag; retry resets the row; all of the key's in order.
    """
    at = F.struct("timestamp", "seq")
    resets = events.where(F.col("kind").isin("clear", "success", "retry")).groupBy("id").agg(F.max(at).alias("reset"))
    tagged = events.withColumn("at", at).join(resets, "id", "left").where(F.col("reset").isNull() | (F.col("at") > F.col("reset")))
    fresh = tagged.groupBy("id").agg(F.count_if(F.col("kind") == "failure").alias("n"), F.max(F.when(F.col("kind") == "failure", F.col("timestamp"))).alias("t"), F.bool_or(F.col("kind") == "ignore").alias("ig"))
    old = ledger.join(resets, "id", "left").where("reset is null").drop("reset")
    both = old.select("id", "failure_count", "last_failed_at", "ignored").join(fresh, "id", "full")
    out = both.select("id", (F.coalesce("failure_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("failure_count"), F.greatest("last_failed_at", "t").alias("last_failed_at"), (F.coalesce("ignored", F.lit(False)) | F.coalesce("ig", F.lit(False))).alias("ignored"))
    return out.where("failure_count > 0 or ignored")


def list_failures(ledger: DataFrame) -> DataFrame:  # T03
    return ledger.orderBy(F.desc("last_failed_at"), "id")


def list_patterns(decisions: DataFrame) -> DataFrame:  # T04
    return decisions.orderBy(F.desc("created_at"), "pattern")


def decision_stats(decisions: DataFrame) -> DataFrame:  # A06
    n = lambda d: F.count_if(F.col("decision") == d)
    return decisions.agg(F.count("*").alias("total"), n("merge").alias("merge"), n("keepSeparate").alias("keep_separate"), n("skip").alias("skip"))


def events_by_day(events: DataFrame) -> DataFrame:  # A14
    return events.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day"))


_INTERESTING = r"^(change\.|sync\.|restore|rollback|userDecision)"


def is_interesting(action: Column) -> Column:  # P52
    return action.rlike(_INTERESTING)


def is_change(action: Column) -> Column:
    return action.startswith("change.")


def is_error(action: Column) -> Column:
    return action.rlike(r"(?i)(failed|error)")


def matches_text(text: str, *columns: str) -> Column:
    return F.lower(F.concat_ws("\x1f", *columns)).contains(text.lower())


def recent_events(events: DataFrame, limit: int = 8) -> DataFrame:  # T05
    return events.where(is_interesting(F.col("action"))).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def redacted(details: Column) -> Column:  # P38
    """The name before the first bracket gives way to its length."""
    name = F.regexp_replace(F.regexp_extract(details, r"(?s)^([^\[]*)\[", 1), r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")
    rest = F.regexp_extract(details, r"(?s)^[^\[]*(\[.*)$", 1)
    return F.when(details.contains("[") & (name != ""), F.concat(F.lit("<contact "), F.length(name).cast("string"), F.lit(" chars> "), rest)).otherwise(details)


def failure_digest(failed: DataFrame, k: int = 3) -> DataFrame:  # T06
    """The first k names of failed restores (pos, name), and how many more there are; only k names are kept by a task."""
    first = failed.orderBy("pos").limit(k)
    names = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ", ").alias("names"))
    total = failed.agg(F.count("*").alias("n"))
    return names.join(total).select(F.when(F.col("n") > k, F.concat("names", F.lit(" and "), (F.col("n") - k).cast("string"), F.lit(" more"))).otherwise(F.col("names")).alias("digest"))


def minus_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:  # X02
    return a.join(b.select(key).distinct(), key, "left_anti")


def coalesce_bursts(events: DataFrame, gap: str, key: str = "key") -> DataFrame:  # R01, batch twin
    """(key, start, end, n): runs of events no more than ``gap`` apart."""
    s = events.groupBy(key, F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))
    return s.select(key, F.col("w.start").alias("start"), F.col("last").alias("end"), "n")


def with_display(events: DataFrame) -> DataFrame:  # K07
    return events.withColumn("details", redacted(F.col("details")))


