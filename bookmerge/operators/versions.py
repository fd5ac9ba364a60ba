"""Snapshots: numbered versions, history, comparison, retention, restore and rollback."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.operators.store import publish, published
from bookmerge.schemas import CONTACT, CONTACT_TYPES, VERSION


def snapshot_rows(left: DataFrame, right: DataFrame, session_id: str, now: Column) -> DataFrame:  # O35, P46
    """A row for each record of both books: session_id, contact_identifier, timestamp, source, data."""
    one = lambda df, side, own: C.as_struct(C.completed(df), "data").select(F.lit(session_id).alias("session_id"), F.coalesce(F.col(f"data.{own}"), F.lit("unknown")).alias("contact_identifier"), now.alias("timestamp"), F.lit(side).alias("source"), "data")
    return one(left, "google", "google_resource_name").unionByName(one(right, "mac", "mac_contact_identifier"))


def max_versions(versions: DataFrame) -> DataFrame:  # A09
    return versions.groupBy("contact_identifier").agg(F.max("version_number").alias("version_number"))


def number_versions(rows: DataFrame, prior: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:  # W01
    """rows with version_number: the prior maximum of the identifier plus the position in time."""
    w = W.partitionBy("contact_identifier").orderBy(*(order or ["timestamp", "source"]))
    rows = rows.withColumn("version_number", F.row_number().over(w))
    if prior is None:
        return rows
    base = prior.select("contact_identifier", F.col("version_number").alias("prior"))
    return rows.join(base, "contact_identifier", "left").withColumn("version_number", F.coalesce("prior", F.lit(0)) + F.col("version_number")).drop("prior")


def versioned_contacts(versions: DataFrame, name: str = "name") -> DataFrame:  # A08
    g = versions.groupBy("contact_identifier").agg(F.max_by(name, F.struct("timestamp", "version_number")).alias("name"), F.count("*").alias("versions"), F.max("timestamp").alias("latest"))
    return g.orderBy(F.desc("latest"), "contact_identifier")


def search_versioned(contacts: DataFrame, text: str) -> DataFrame:  # P64
    return contacts.where(F.lower("name").contains(text.lower()))


def version_history(versions: DataFrame, identifier: str) -> DataFrame:  # T02
    return versions.where(F.col("contact_identifier") == identifier).orderBy("version_number")


def version_diffs(versions: DataFrame) -> DataFrame:  # W08
    """(contact_identifier, version_number, field, old_value, new_value) against the version before.

    versions has display_name, phones, emails (arrays), organization. Lists compare whole; their sizes are told.
    """
    w = W.partitionBy("contact_identifier").orderBy("version_number")
    now = F.struct("display_name", "phones", "emails", "organization")
    rows = versions.withColumn("was", F.lag(now).over(w)).withColumn("now", now).where("was is not null")
    size = lambda side, f: F.coalesce(F.size(f"{side}.{f}"), F.lit(0)).cast("string")
    text = lambda side, f: F.coalesce(F.col(f"{side}.{f}"), F.lit("None"))
    fields = [("Display Name", "display_name", text), ("Phone Numbers", "phones", size), ("Email Addresses", "emails", size), ("Organization", "organization", text)]
    found = [F.when(~F.col(f"was.{f}").eqNullSafe(F.col(f"now.{f}")), F.struct(F.lit(label).alias("field"), show("was", f).alias("old_value"), show("now", f).alias("new_value"))) for label, f, show in fields]
    return rows.select("contact_identifier", "version_number", F.explode(F.array_compact(F.array(*found))).alias("d")).select("contact_identifier", "version_number", "d.*")


def list_backups(sessions: DataFrame) -> DataFrame:  # T01
    return sessions.orderBy(F.desc("timestamp"), "id")


def session_summary(sessions: DataFrame) -> DataFrame:  # P65, S11
    """Sessions without bodies; version_count from the body where the row lacks it."""
    count = F.coalesce("version_count", F.size("contact_versions")) if "contact_versions" in sessions.columns else F.col("version_count")
    return sessions.withColumn("version_count", count.cast("int")).drop("contact_versions")


def backup_stats(sessions: DataFrame) -> DataFrame:  # A07
    return sessions.agg(F.count("*").alias("backups"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"), F.coalesce(F.sum("version_count"), F.lit(0)).alias("versions"), *([F.sum("bytes").alias("bytes")] if "bytes" in sessions.columns else []))


def retain_sessions(sessions: DataFrame, keep: int) -> DataFrame:  # W10
    """The newest sessions (one at least); a bounded top-k, no global window."""
    return sessions.orderBy(F.desc("timestamp"), F.desc("id")).limit(max(1, keep))


def dropped_sessions(sessions: DataFrame, keep: int) -> DataFrame:
    return sessions.join(retain_sessions(sessions, keep).select("id"), "id", "left_anti")


def orphans(files: DataFrame, index: DataFrame) -> DataFrame:  # J18
    return files.join(index.select("id").distinct(), "id", "left_anti")


def merge_indexes(primary: DataFrame, fallback: DataFrame, bodies: DataFrame) -> DataFrame:  # J19
    """Sessions of both by id, the newer row wins; ids of the fallback alone stay only with a body."""
    kept = fallback.join(primary.select("id"), "id", "left_semi").unionByName(fallback.join(primary.select("id"), "id", "left_anti").join(bodies.select("id").distinct(), "id", "left_semi"))
    cols = [c for c in primary.columns if c != "id"]
    both = primary.withColumn("p", F.lit(1)).unionByName(kept.withColumn("p", F.lit(0)))
    return both.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("timestamp", "p")).alias("r")).select("id", "r.*")


def should_snapshot(plan: DataFrame, written: DataFrame | None = None, dry_run: bool = False, after: bool = False) -> bool:  # O36
    """Before a run: if the plan has rows. After it: if something was written and it was no dry run."""
    if not after:
        return not plan.isEmpty()
    return not dry_run and written is not None and not written.isEmpty()


def legacy_mask(snapshot: DataFrame) -> dict[str, bool]:  # P44
    """What a session's snapshots may write: one without url lists is legacy and has no such fields."""
    legacy = snapshot.agg(F.coalesce(F.bool_or(F.col("data.urls").isNull()), F.lit(False)).alias("legacy")).first()["legacy"]
    return {"websites": not legacy, "birthday": not legacy, "extended_names": not legacy}


def restore_upserts(snapshot: DataFrame, live: DataFrame, mask: dict[str, bool] | None = None) -> DataFrame:  # J16
    """snapshot (contact_identifier, data) against live: outcome restored (updated in place) or recreated, and the record."""
    now = C.as_struct(C.completed(live), "live").withColumn("contact_identifier", F.col("live.contact_id"))
    rows = snapshot.join(now, "contact_identifier", "left")
    data, old = F.col("data"), F.col("live")
    record = F.when(old.isNotNull(), C.apply_mask(data, old, {"photos": False, **(mask or {})})).otherwise(C.replaced(data))
    return rows.select("contact_identifier", F.when(old.isNotNull(), "updated").otherwise("recreated").alias("outcome"), record.alias("record"))


def restore_extras(snapshot: DataFrame, live: DataFrame) -> DataFrame:  # J17
    return live.join(snapshot.select(F.col("contact_identifier").alias("contact_id")).distinct(), "contact_id", "left_anti")


def rollback(versions: DataFrame, session_id: str, left: DataFrame, right: DataFrame, extras: str = "keep", failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:  # O38
    """(new left, new right, tally by side: updated, recreated, removed, failed) for a session's snapshot.

    extras: keep leaves records that the snapshot lacks, remove drops them. ``failed`` (source, contact_identifier) are writes that were
    rejected: such a record stays as it lives, one that would be re-created stays away. ``run_rollback`` saves both books first.
    """
    session = versions.where(F.col("session_id") == session_id)
    mask = legacy_mask(session)
    out, tallies = [], []
    for side, book in (("google", left), ("mac", right)):
        own = session.where(F.col("source") == side)
        restored = restore_upserts(own, book, mask)
        more = restore_extras(own, book)
        removed = more if extras == "remove" else more.limit(0)
        stays = more.limit(0) if extras == "remove" else more
        told = lambda df, outcome, side=side: df.select(F.lit(side).alias("side"), outcome.alias("outcome"))
        if failed is not None:
            bad = failed.where(F.col("source") == side).select("contact_identifier").distinct()
            bad_id = bad.withColumnRenamed("contact_identifier", "contact_id")
            tallies.append(told(restored.join(bad, "contact_identifier", "left_semi"), F.lit("failed")).unionByName(told(removed.join(bad_id, "contact_id", "left_semi"), F.lit("failed"))))
            stays = stays.unionByName(removed.join(bad_id, "contact_id", "left_semi")).unionByName(book.join(own.select(F.col("contact_identifier").alias("contact_id")).distinct(), "contact_id", "left_semi").join(bad_id, "contact_id", "left_semi").select(stays.columns))
            restored, removed = restored.join(bad, "contact_identifier", "left_anti"), removed.join(bad_id, "contact_id", "left_anti")
        out.append(restored.select("record.*").select(*CONTACT_TYPES).unionByName(C.completed(stays).select(*CONTACT_TYPES)))
        tallies.append(told(restored, F.col("outcome")).unionByName(told(removed, F.lit("removed"))))
    tally = tallies[0]
    for t in tallies[1:]:
        tally = tally.unionByName(t)
    return out[0], out[1], tally.groupBy("side", "outcome").agg(F.count("*").alias("n"))


def run_rollback(sessions, folder: str, session_id: str, left: DataFrame, right: DataFrame, now: Column, extras: str = "keep", failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rollback`` to a session of a ``sinks.SessionStore`` in steps that are published one by one in ``folder``.

    First both books, as they live, become a session of the store (``safety-`` and the id): published before anything of the result is
    written. Then the new books and the tally. A run that failed is started again with the same folder: published steps are read, not repeated, so the
    safety session holds the books of the first start.
    """
    spark = left.sparkSession
    manifest = f"{folder.rstrip('/')}/manifest.json"
    done = published(spark, manifest) or {}
    safety = f"safety-{session_id}"
    if "safety" not in done:
        rows = number_versions(snapshot_rows(left, right, safety, now).withColumn("position", F.lit(0)), sessions.highest())
        sessions.write(rows.select("session_id", *_BODY_COLUMNS))
        done["safety"] = safety
        publish(spark, manifest, done)
    if "books" not in done:
        bodies = sessions.bodies(BODY)
        new = rollback(bodies, session_id, left, right, extras, failed)
        name = uuid.uuid4().hex
        for part, df in zip(("left", "right", "tally"), new, strict=True):
            df.write.parquet(f"{folder}/{name}/{part}")
        done["books"] = name
        publish(spark, manifest, done)
    read = lambda part, schema: spark.read.schema(schema).parquet(f"{folder}/{done['books']}/{part}")
    return read("left", CONTACT), read("right", CONTACT), read("tally", "side string, outcome string, n long")


#: Columns of a stored session's bodies, beside session_id.
BODY = VERSION.removeprefix("session_id string, ")
_BODY_COLUMNS = ["contact_identifier", "version_number", "timestamp", "source", "position", "data"]


def restore_one(version: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:  # O37
    """One version's record: updated on the side where it lives, else re-created on the right."""
    a = restore_upserts(version.where("source = 'google'"), left).withColumn("side", F.lit("google"))
    b = restore_upserts(version.where("source = 'mac'"), right).withColumn("side", F.lit("mac"))
    return a.unionByName(b).withColumn("side", F.when(F.col("outcome") == "recreated", "mac").otherwise(F.col("side")))
