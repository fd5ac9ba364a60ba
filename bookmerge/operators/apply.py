"""Applying a plan: gates, outcomes, new books, mapping stamps, outbound batches and their responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.functions import normalize as N
from bookmerge.operators import merge as G
from bookmerge.operators.diff import effective_action
from bookmerge.operators.graph import durable
from bookmerge.operators.logs import latest_per_key
from bookmerge.operators.ranges import numbered
from bookmerge.schemas import CONTACT_TYPES, Settings

_DISTANT = "timestamp'0001-01-01 00:00:00'"


def writes_left(direction: str) -> Column:  # O26
    """Whether a change is written to the left book in a session of this direction."""
    if direction != "twoWay":
        return F.lit(direction == "macToGoogle")
    has_left = (F.col("source") == "google") & F.col("left_id").isNotNull()
    return F.when(effective_action() == "delete", has_left).otherwise(~has_left)


def plan_failure_key() -> Column:  # P30 over a plan's ids
    return N.failure_key(F.col("right_id"), F.lit(None).cast("string"), F.col("left_id"), F.lit(None).cast("string"))


def with_failures(plan: DataFrame, ledger: DataFrame, settings: Settings = Settings()) -> DataFrame:  # J20, O33
    """plan with failure_key and set_aside (three strikes, or ignored)."""
    asides = ledger.where((F.col("failure_count") >= settings.max_failures) | F.coalesce("ignored", F.lit(False))).select(F.col("id").alias("failure_key")).distinct().withColumn("set_aside", F.lit(True))
    return plan.withColumn("failure_key", plan_failure_key()).join(asides, "failure_key", "left").withColumn("set_aside", F.coalesce("set_aside", F.lit(False)))


def deletion_held(settings: Settings, reviewed: bool) -> Column:  # O31
    return (effective_action() == "delete") & F.lit(settings.confirm_deletions and not reviewed)


def merge_held() -> Column:  # O32
    return (F.col("action") == "merge") & F.col("user_override").isNull()


def batch_eligible(direction: str, settings: Settings = Settings(), reviewed: bool = False) -> Column:  # O34
    return ~deletion_held(settings, reviewed) & ~F.col("set_aside") & writes_left(direction) & (effective_action() != "merge")


def with_outcomes(plan: DataFrame, ledger: DataFrame, settings: Settings = Settings(), reviewed: bool = False, failed: DataFrame | None = None) -> DataFrame:  # O25, O30
    """plan with an outcome a row, by the gates in order: set aside, held deletion, held merge, failed write, action.

    ``failed`` has left_id, right_id of rejected writes; a dry run counts them as done.
    """
    df = with_failures(plan, ledger, settings)
    if failed is not None and not settings.dry_run:
        df = df.join(failed.select("left_id", "right_id").distinct().withColumn("rejected", F.lit(True)), (df.left_id.eqNullSafe(failed.left_id)) & (df.right_id.eqNullSafe(failed.right_id)), "left").drop(failed.left_id, failed.right_id)
    else:
        df = df.withColumn("rejected", F.lit(False))
    done = F.element_at(F.create_map(*(F.lit(x) for kv in {"add": "added", "update": "updated", "delete": "deleted", "merge": "merged", "skip": "skipped"}.items() for x in kv)), effective_action())
    outcome = F.when(F.col("set_aside"), "set_aside").when(deletion_held(settings, reviewed), "deferred_deletion").when(merge_held(), "deferred_merge").when(F.coalesce("rejected", F.lit(False)), "error").otherwise(done)
    return df.withColumn("outcome", outcome)


def tally(outcomes: DataFrame) -> DataFrame:  # A04
    """One row of counters; everything held back counts as skipped too."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(n("added").alias("added"), n("updated").alias("updated"), n("deleted").alias("deleted"), n("merged").alias("merged"), n("skipped", "set_aside", "deferred_deletion", "deferred_merge").alias("skipped"), n("error").alias("errors"), n("deferred_deletion").alias("deferred_deletions"), n("deferred_merge").alias("deferred_merges"), n("set_aside").alias("set_aside"))


def to_left_record(c, now: Column | None = None) -> Column:  # P45
    """A record as the left side stores it: elements carry type = label, empty lists are none."""
    typed = lambda items: F.when(F.size(items) > 0, F.transform(items, lambda x: F.struct(x["value"].alias("value"), N.canonical_label(x["label"]).alias("type"), x["label"].alias("label"))))
    return F.struct(*(typed(c[f]).alias(f) if f in ("phones", "emails", "urls") else c[f].alias(f) for f in CONTACT_TYPES))


def _write(rows: DataFrame, book: DataFrame, side: str, settings: Settings, new_id: Column | None = None) -> DataFrame:
    """The records that rows (at, seq, made) write into a book: ``made`` onto the record ``at``, or a new one where at has none.

    A record's fields are plain columns; of several rows for one record the last by seq stays.
    """
    own = "google_resource_name" if side == "google" else "mac_contact_identifier"
    sent, old = C.Prefixed("s_"), C.Prefixed("d_")
    s = rows.select("at", "seq", *(F.col(f"made.{f}").alias(f"s_{f}") for f in CONTACT_TYPES))
    s = s.select("at", "seq", *(v.alias(f"s_{f}") for f, v in C.settings_fields(sent, settings).items()))
    made = new_id if new_id is not None else F.concat(F.lit("people/new-" if side == "google" else "mac/new-"), F.substring(F.sha2(sent["contact_id"], 256), 1, 16))
    fresh = C.fields_of(sent, contact_id=made, source=F.lit(side), **{own: made})
    kept = C.masked_fields(sent, old, C.write_mask(settings))
    joined = s.join(C.prefixed(book, "d_"), F.col("at") == F.col("d_contact_id"), "left")
    out = joined.select("seq", *(F.when(old["contact_id"].isNull(), fresh[f]).otherwise(kept[f]).alias(f) for f in CONTACT_TYPES))
    return durable(latest_per_key(out, "contact_id", "seq").drop("seq"))


def _onto(rows: DataFrame, old: str, settings: Settings) -> DataFrame:
    """The records that ``made`` of rows gives where it is written onto their struct ``old``; nothing moves, so it ends as long as it is given out."""
    fields = rows.select(F.col(old).alias("d"), *(F.col(f"made.{f}").alias(f"s_{f}") for f in CONTACT_TYPES))
    sent = C.Prefixed("s_")
    fields = fields.select("d", *(v.alias(f"s_{f}") for f, v in C.settings_fields(sent, settings).items()))
    return fields.select(*(v.alias(f) for f, v in C.masked_fields(sent, F.col("d"), C.write_mask(settings)).items()))


def _replaced_rows(book: DataFrame, changed: DataFrame, dropped: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """book with changed records in place of its own; ids are those of changed, where they are known without making it."""
    touched = changed.select("contact_id") if ids is None else ids
    if dropped is not None:
        touched = touched.unionByName(dropped)
    return book.join(touched.distinct(), "contact_id", "left_anti").select(*CONTACT_TYPES).unionByName(changed.select(*CONTACT_TYPES))


def apply_books(outcomes: DataFrame, left: DataFrame, right: DataFrame, direction: str = "twoWay", settings: Settings = Settings(), new_id: Column | None = None) -> tuple[DataFrame, DataFrame]:  # O26, O28
    """(new left book, new right book). Plan rows meet the current records, not copies in the plan.

    Additions, updates and deletions come first; merges then read the left record as those left it. Several right
    records that merge into one left record do so one after the other (the mapped or matched one, then linked ones by
    right id), each with what the ones before have made (``merge.merge_in_turn``). A new record's id is derived from its source
    (``new_id`` overrides the rule).
    """
    left, right = C.completed(left).select(*CONTACT_TYPES), C.completed(right).select(*CONTACT_TYPES)
    if settings.dry_run:
        return left, right
    linked = F.coalesce(F.get("changes", F.lit(0)).startswith("Matched an existing"), F.lit(False))
    done = durable(outcomes.where(F.col("outcome").isin("added", "updated", "deleted", "merged")).select("left_id", "right_id", effective_action().alias("act"), writes_left(direction).alias("to_left"), linked.alias("linked")))
    record = lambda book, name, key: C.as_struct(book, name).select(F.col(f"{name}.contact_id").alias(key), name)

    put = done.where(F.col("act").isin("add", "update"))
    to_left = put.where("to_left").join(record(right, "made", "right_id"), "right_id").select(F.col("left_id").alias("at"), F.col("right_id").alias("seq"), "made")
    to_right = put.where("not to_left").join(record(left, "made", "left_id"), "left_id").select(F.col("right_id").alias("at"), F.col("left_id").alias("seq"), "made")
    gone = lambda own, where: done.where((F.col("act") == "delete") & where).select(F.col(own).alias("contact_id")).where("contact_id is not null")
    new_left, new_right = _write(to_left, left, "google", settings, new_id), _write(to_right, right, "mac", settings, new_id)
    left = durable(_replaced_rows(left, new_left, gone("left_id", F.col("to_left"))))
    right = durable(_replaced_rows(right, new_right, gone("right_id", ~F.col("to_left"))))

    pairs = done.where("act = 'merge'").join(record(left, "a", "left_id"), "left_id").join(record(right, "b", "right_id"), "right_id")
    pairs = durable(pairs.select(F.monotonically_increasing_id().alias("row"), "left_id", "right_id", "a", "b", "linked"))
    slim = pairs.select("row", "left_id", "right_id", "linked")
    turn = slim.withColumn("seq", F.row_number().over(W.partitionBy("left_id").orderBy("linked", "right_id")))
    turn = turn.withColumn("last", F.col("seq") == F.count("*").over(W.partitionBy("left_id")))
    # Of several rows for one right record the last by seq is written: found before any record is made.
    turn = durable(turn.withColumn("wins", F.row_number().over(W.partitionBy("right_id").orderBy(F.desc("seq"), F.desc("left_id"))) == 1).select("row", "seq", "last", "wins", (F.col("last") & (F.col("seq") == 1)).alias("alone")))
    in_turn = durable(turn.where("not alone").join(pairs, "row").select(F.col("left_id").alias("at"), "seq", "last", "wins", "a", "b"))
    alone = turn.where("alone").join(pairs, "row").select("last", "wins", "a", "b", G.merge_sync(F.col("a"), F.col("b")).alias("made"))
    rows = [alone] if in_turn.isEmpty() else [alone, G.merge_in_turn(in_turn).select("last", "wins", "a", "b", "made")]
    put = lambda which, old: reduce(DataFrame.unionByName, [_onto(r.where(which), old, settings) for r in rows])
    # The left record ends with the data of all.
    return _replaced_rows(left, put("last", "a"), ids=slim.select(F.col("left_id").alias("contact_id"))), _replaced_rows(right, put("wins", "b"), ids=slim.select(F.col("right_id").alias("contact_id")))


def mapping_stamps(outcomes: DataFrame, mapping: DataFrame, now: Column, direction: str = "twoWay") -> DataFrame:  # O29
    """(google_resource_name, mac_contact_identifier, last_synced_at) of pairs written to the left.

    now, unless the right half of the pair is still to be written: then the previous stamp, or the distant past.
    """
    act = effective_action()
    half = act.isin("add", "update") & ~writes_left(direction)
    waiting = outcomes.where(half).select(F.explode(F.array(F.concat(F.lit("google:"), "left_id"), F.concat(F.lit("mac:"), "right_id"))).alias("key")).where("key is not null").distinct()
    sent = outcomes.where(F.col("outcome").isin("added", "updated") & writes_left(direction) & F.col("left_id").isNotNull() & F.col("right_id").isNotNull()).select(F.col("left_id").alias("google_resource_name"), F.col("right_id").alias("mac_contact_identifier"))
    flagged = sent.withColumn("k", F.concat(F.lit("google:"), "google_resource_name")).join(waiting.select(F.col("key").alias("k")).withColumn("w1", F.lit(True)), "k", "left").withColumn("k", F.concat(F.lit("mac:"), "mac_contact_identifier")).join(waiting.select(F.col("key").alias("k")).withColumn("w2", F.lit(True)), "k", "left").drop("k")
    before = mapping.groupBy("google_resource_name").agg(F.max("last_synced_at").alias("previous"))
    return flagged.join(before, "google_resource_name", "left").select("google_resource_name", "mac_contact_identifier", F.when(F.coalesce("w1", "w2", F.lit(False)), F.coalesce("previous", F.expr(_DISTANT))).otherwise(now).alias("last_synced_at"))


def chunk(df: DataFrame, size: int | dict[str, int], by: str = "kind", order: str = "id", shards: int = 1) -> DataFrame:  # W09
    """Chunk numbers of ``size`` rows within a kind (a number, or one for each kind); with shards, numbering runs in each shard apart.

    Rows are numbered in ranges (``numbered``): a range bounds what a task sorts, whatever a kind's size.
    """
    sharded = df.withColumn("shard", F.pmod(F.xxhash64(order), F.lit(shards)).cast("int"))
    sizes = F.lit(size) if isinstance(size, int) else F.create_map(*(F.lit(x) for kv in size.items() for x in kv))[F.col(by)]
    return numbered(sharded, [by, "shard"], order, "__place").withColumn("chunk", F.floor(F.col("__place") / sizes).cast("int")).select(*df.columns, "shard", "chunk")


#: Most rows of a call by kind.
BATCH = {"create": 200, "update": 200, "delete": 500}


def plan_batches(changes: DataFrame, etags: DataFrame, shards: int = 1) -> DataFrame:  # K08, J14
    """changes (kind, id) with etag, batch number, or single = true: updates without etag, and kinds of one row."""
    df = with_etags(changes, etags).withColumn("loose", (F.col("kind") == "update") & F.col("etag").isNull())
    counts = df.where("not loose").groupBy("kind").agg(F.count("*").alias("n"))
    df = df.join(counts, "kind", "left").withColumn("single", F.col("loose") | (F.coalesce("n", F.lit(0)) < 2))
    out = chunk(df.where(F.col("kind").isin(*BATCH) & ~F.col("single")), BATCH, "kind", "id", shards)
    alone = df.where("single").withColumn("shard", F.lit(None).cast("int")).withColumn("chunk", F.lit(None).cast("int"))
    return out.unionByName(alone).select("kind", "id", "etag", "single", "shard", "chunk")


def with_etags(df: DataFrame, etags: DataFrame, cached: DataFrame | None = None) -> DataFrame:  # J14
    one = lambda t, name: t.groupBy("id").agg(F.max("etag").alias(name))
    out = df.join(one(etags, "etag"), "id", "left")
    if cached is not None:
        out = out.join(one(cached, "fresh"), "id", "left").withColumn("etag", F.coalesce("fresh", "etag")).drop("fresh")
    return out


def align_create_results(batch: DataFrame, responses: DataFrame) -> DataFrame:  # K09
    """batch (batch, pos, id) against responses (batch, items array): an item without an answer is rejected."""
    items = responses.select("batch", F.posexplode_outer("items").alias("pos", "person"))
    return batch.join(items, ["batch", "pos"], "left").withColumn("accepted", F.col("person").isNotNull())


def align_update_results(batch: DataFrame, responses: DataFrame) -> DataFrame:  # K10
    """batch (id) against responses (id, person): no key or a null person is rejected."""
    return batch.join(responses.select("id", "person"), "id", "left").withColumn("accepted", F.col("person").isNotNull())


def counts_toward_set_aside(kind: Column, status: Column) -> Column:  # P50
    """kind: cancel, network, auth, chunk, rate, api or item; status of an api error."""
    return F.when(kind.isin("cancel", "network", "auth", "chunk", "rate"), False).when(kind == "api", ~status.isin(401, 403, 429) & (status < 500)).otherwise(True)


def is_fatal(kind: Column, inner: Column) -> Column:  # P51
    """Sign-in trouble, also inside a failed chunk, ends a run."""
    return F.when(kind == "chunk", inner == "auth").otherwise(kind == "auth")
