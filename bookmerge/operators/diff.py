"""Reconciling two books against a mapping: field differences, conflicts, and the plan of changes.

A plan row is (name, action, direction, changes, user_override, source, left_id, right_id); source says which
side's record is written from. Contacts are joined again when the plan is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.functions import normalize as N
from bookmerge.operators.graph import durable
from bookmerge.operators.linkage import link_fuzzy, link_identity
from bookmerge.schemas import Settings

PLAN = ["name", "action", "direction", "changes", "user_override", "source", "left_id", "right_id"]


def diff_fields(a, b, settings: Settings = Settings(), failed_photos: Column | None = None) -> Column:  # O01
    """array<string>: what differs between the left record a and the right record b, in fixed order."""
    text = lambda f: ~F.lower(N.non_blank(a[f])).eqNullSafe(F.lower(N.non_blank(b[f])))
    none = F.array().cast("array<string>")
    as_set = lambda items, one: F.array_sort(F.array_distinct(F.coalesce(F.transform(items, one), none)))
    same = lambda f, one: ~as_set(a[f], one).eqNullSafe(as_set(b[f], one))
    many = lambda f, normal: ~F.coalesce(normal(C.values(a[f])), none).eqNullSafe(F.coalesce(normal(C.values(b[f])), none))
    tests = [
        ("Forced update", F.lit(settings.force_update_all)),
        *((f"{label} changed", text(f)) for label, f in (("First name", "given_name"), ("Last name", "family_name"), ("Middle name", "middle_name"), ("Company", "organization"), ("Nickname", "nickname"), ("Name prefix", "name_prefix"), ("Name suffix", "name_suffix"), ("Department", "department"))),
        ("Job title changed", F.lit(settings.sync_job_title) & text("job_title")),
        ("Note changed", F.lit(settings.sync_notes) & text("note")),
        ("Birthday changed", F.lit(settings.sync_birthday) & ~N.birthday_key(a["birthday"]).eqNullSafe(N.birthday_key(b["birthday"]))),
        ("Phone numbers changed", many("phones", N.normalize_phones)),
        ("Email addresses changed", many("emails", N.normalize_emails)),
        ("Addresses changed", F.lit(settings.sync_addresses) & same("addresses", N.normalize_address)),
        ("Websites changed", F.lit(settings.sync_websites) & same("urls", lambda u: N.normalize_url(u["value"]))),
        ("Photo changed", F.lit(settings.sync_photos) & C.photo_needs_copy(a, b, failed_photos)),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(said)) for said, test in tests)))


def filter_groups(book: DataFrame, membership: DataFrame, selected: list[str], key: str = "contact_id") -> DataFrame:  # J07
    """Records in a selected group, and those without an id; everything where nothing is selected."""
    if not selected:
        return book
    allowed = membership.where(F.col("group").isin(selected)).select(F.col("id").alias(key)).distinct()
    return book.join(allowed, key, "left_semi").unionByName(book.where(F.col(key).isNull()))


def with_outside_filter(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:  # J02
    """Whether key is an id of the unfiltered book (ids: one column)."""
    return df.join(ids.toDF(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def unmapped(book: DataFrame, mapping: DataFrame, column: str) -> DataFrame:  # J03
    return book.join(mapping.select(F.col(column).alias("contact_id")).distinct(), "contact_id", "left_anti")


def classify_mappings(mapping: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:  # J01
    """mapping rows with structs a (left) and b (right), null where that record is missing."""
    a = C.as_struct(left, "a").withColumn("google_resource_name", F.col("a.contact_id"))
    b = C.as_struct(right, "b").withColumn("mac_contact_identifier", F.col("b.contact_id"))
    return mapping.join(a.select("google_resource_name", "a"), "google_resource_name", "left").join(b.select("mac_contact_identifier", "b"), "mac_contact_identifier", "left")


def _change(name, action, direction, changes, override, source) -> Column:
    return F.struct(name.alias("name"), F.lit(action).alias("action"), F.lit(direction).alias("direction"), changes.alias("changes"), F.lit(override).cast("string").alias("user_override"), F.lit(source).alias("source"))


_UNKNOWN = "Differs, but neither side reports when it changed"
# What a both-sides conflict adds to the changes.
_BOTH = {"alwaysAsk": "⚠️ Conflict: both sides changed since last sync", "preferGoogle": "Auto-resolved: Google preferred", "preferMac": "Auto-resolved: Mac preferred", "mergeBoth": "Auto-resolved: merged both sides"}


# Action, direction, override and source of a conflict settled by each preference.
_SETTLED = {"alwaysAsk": ("merge", "twoWay", None, "google"), "preferGoogle": ("update", "googleToMac", None, "google"), "preferMac": ("update", "macToGoogle", None, "mac"), "mergeBoth": ("merge", "twoWay", "merge", "google")}


def conflict_inputs(a, b) -> list[Column]:
    """The columns that ``resolve`` reads of a mapped pair."""
    return [C.display_name(a).alias("name_a"), C.display_name(b).alias("name_b"), a["last_modified"].alias("at_a"), b["last_modified"].alias("at_b")]


def resolve(changes: Column, synced_at: Column, conflict: str) -> Column:  # O03
    """The change for a differing mapped pair, over the columns of ``conflict_inputs``."""
    moved = lambda t: F.coalesce(F.col(t) > synced_at, F.col(t).isNotNull() & synced_at.isNull())
    photo_only = F.size(changes).eqNullSafe(1) & F.get(changes, F.lit(0)).eqNullSafe("Photo changed")
    to_right, to_left = photo_only | (moved("at_a") & ~moved("at_b")), ~photo_only & moved("at_b") & ~moved("at_a")
    both = moved("at_a") & moved("at_b") & ~photo_only
    settled = _SETTLED[conflict]
    pick = lambda n, right, left: F.when(to_right, F.lit(right)).when(to_left, F.lit(left)).otherwise(F.lit(settled[n]).cast("string"))
    unknown = F.array(F.lit(_UNKNOWN)) if conflict == "alwaysAsk" else F.array().cast("array<string>")
    more = F.when(to_right | to_left, F.array().cast("array<string>")).when(both, F.array(F.lit(_BOTH[conflict]))).otherwise(unknown)
    source = pick(3, "google", "mac")
    return F.struct(F.when(source == "mac", F.col("name_b")).otherwise(F.col("name_a")).alias("name"), pick(0, "update", "update").alias("action"), pick(1, "googleToMac", "macToGoogle").alias("direction"), F.concat(changes, more).alias("changes"), pick(2, None, None).alias("user_override"), source.alias("source"))


def _plan(df: DataFrame) -> DataFrame:
    return df.select("change.*", "left_id", "right_id").select(*PLAN)


def diff_two_way(left: DataFrame, right: DataFrame, mapping: DataFrame, settings: Settings = Settings(), left_ids: DataFrame | None = None, right_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # O02, O04-O06
    """(plan, google ids of dead mappings). left_ids and right_ids are the ids of the unfiltered books."""
    rows = classify_mappings(mapping, left, right)
    outside = lambda df, ids, key, name: with_outside_filter(df, ids, key, name) if ids is not None else df.withColumn(name, F.lit(False))
    rows = outside(outside(rows, left_ids, "google_resource_name", "left_outside"), right_ids, "mac_contact_identifier", "right_outside")
    a, b = F.col("a"), F.col("b")
    left_hidden, right_hidden = a.isNull() & F.col("left_outside"), b.isNull() & F.col("right_outside")
    gone = a.isNull() & b.isNull()
    dead = rows.where(gone & ~left_hidden & ~right_hidden).select("google_resource_name").distinct()

    deletion = F.when(a.isNotNull() & b.isNull() & ~right_hidden, _change(C.display_name(a), "delete", "macToGoogle", F.array(F.lit("Deleted on Mac side")), None, "google")).when(a.isNull() & b.isNotNull() & ~left_hidden, _change(C.display_name(b), "delete", "googleToMac", F.array(F.lit("Deleted on Google side")), None, "mac"))
    ids = [F.col("a.contact_id").alias("left_id"), F.col("b.contact_id").alias("right_id")]
    # Written: what decides a conflict is then plain columns, not rules over two records.
    pairs = durable(rows.where(a.isNotNull() & b.isNotNull()).select(*ids, "last_synced_at", *conflict_inputs(a, b), diff_fields(a, b, settings).alias("diff")).where(F.size("diff") > 0))
    plan = _plan(pairs.select(resolve(F.col("diff"), F.col("last_synced_at"), settings.conflict).alias("change"), "left_id", "right_id"))
    if settings.sync_deleted:
        plan = plan.unionByName(_plan(rows.select(deletion.alias("change"), *ids).where("change is not null")))

    # Unmapped records: mapped ones count as taken, even through dead mappings.
    free_left, free_right = unmapped(left, mapping, "google_resource_name"), unmapped(right, mapping, "mac_contact_identifier")
    links = link_fuzzy(free_left, free_right)
    right_names = right.select(F.col("contact_id").alias("right_id"), C.display_name(C.HERE).alias("right_name"))
    step2 = free_left.withColumn("left_id", F.col("contact_id")).join(links, "left_id", "left").join(right_names, "right_id", "left")
    name, email = C.display_name(C.HERE), F.col("confidence") == "exactEmail"
    merged = F.when(email, _change(name, "merge", "twoWay", F.array(F.concat(F.lit("Matched on a shared email address: "), F.col("right_name"))), "merge", "google")).otherwise(_change(name, "merge", "twoWay", F.array(F.concat(F.lit("Possible match: "), F.col("right_name"), F.lit(" (same name only — review before merging)"))), None, "google"))
    added = _change(name, "add", "googleToMac", F.array(F.lit("New contact from Google")), None, "google")
    plan = plan.unionByName(_plan(step2.select(F.when(F.col("right_id").isNotNull(), merged).otherwise(added).alias("change"), "left_id", "right_id")))

    rest = free_right.where(C.has_syncable_content(C.HERE)).join(links.select(F.col("right_id").alias("contact_id")), "contact_id", "left_anti")
    step3 = rest.withColumn("right_id", F.col("contact_id")).join(link_identity(rest, left), "right_id", "left")
    linked = _change(name, "merge", "twoWay", F.array(F.lit("Matched an existing Google contact — linking instead of adding a duplicate")), None, "google")
    new = _change(name, "add", "macToGoogle", F.array(F.lit("New contact from Mac")), None, "mac")
    return plan.unionByName(_plan(step3.select(F.when(F.col("left_id").isNotNull(), linked).otherwise(new).alias("change"), "left_id", "right_id"))), dead


def lookup_targets(source: DataFrame, mapping: DataFrame, target: DataFrame, source_key: str, target_key: str) -> DataFrame:  # J06
    """source rows (struct a) with target_id (the latest mapping's) and the target record (struct b)."""
    order = F.max_by(target_key, "seq") if "seq" in mapping.columns else F.max(target_key)
    one = mapping.groupBy(source_key).agg(order.alias("target_id"))
    a = C.as_struct(source, "a").withColumn(source_key, F.col("a.contact_id"))
    b = C.as_struct(target, "b").select(F.col("b.contact_id").alias("target_id"), "b")
    return a.select(source_key, "a").join(one, source_key, "left").join(b, "target_id", "left")


def diff_one_way(source: DataFrame, target: DataFrame, mapping: DataFrame, direction: str = "googleToMac", settings: Settings = Settings(), target_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # O07
    """(plan, google ids of mappings whose target is gone): updates and adds toward the target, never a deletion."""
    keys = ("google_resource_name", "mac_contact_identifier") if direction == "googleToMac" else ("mac_contact_identifier", "google_resource_name")
    rows = lookup_targets(source, mapping, target, *keys)
    rows = with_outside_filter(rows, target_ids, "target_id", "outside") if target_ids is not None else rows.withColumn("outside", F.lit(False))
    a, b, side = F.col("a"), F.col("b"), "google" if direction == "googleToMac" else "mac"
    rows = durable(rows.withColumn("diff", F.when(b.isNotNull(), diff_fields(a, b, settings) if side == "google" else diff_fields(b, a, settings))))  # compared once
    say = lambda action, changes: _change(C.display_name(a), action, direction, changes, None, side)
    lost = F.col("target_id").isNotNull() & b.isNull() & ~F.col("outside")
    change = F.when(F.col("target_id").isNull(), say("add", F.array(F.lit("New contact")))).when(lost, say("add", F.array(F.lit("Deleted on target — re-creating from source")))).when(F.size("diff") > 0, say("update", F.col("diff")))
    ids = (F.col("a.contact_id").alias("left_id"), F.col("b.contact_id").alias("right_id")) if side == "google" else (F.col("b.contact_id").alias("left_id"), F.col("a.contact_id").alias("right_id"))
    dead = rows.where(lost).select((F.col("a.contact_id") if side == "google" else F.col("target_id")).alias("google_resource_name")).distinct()
    return _plan(rows.select(change.alias("change"), *ids).where("change is not null")), dead


def compute_changes(left: DataFrame, right: DataFrame, mapping: DataFrame, direction: str = "twoWay", settings: Settings = Settings(), left_ids: DataFrame | None = None, right_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # O08
    if direction == "twoWay":
        return diff_two_way(left, right, mapping, settings, left_ids, right_ids)
    if direction == "googleToMac":
        return diff_one_way(left, right, mapping, direction, settings, right_ids)
    return diff_one_way(right, left, mapping, direction, settings, left_ids)


def effective_action() -> Column:  # O27
    return F.coalesce("user_override", "action")


def plan_counters(plan: DataFrame) -> DataFrame:  # A01
    return plan.groupBy(effective_action().alias("action")).agg(F.count("*").alias("n"))


def filter_counts(plan: DataFrame) -> DataFrame:  # A13
    n = lambda a: F.count_if(effective_action() == a)
    return plan.agg(F.count("*").alias("all"), n("add").alias("add"), n("update").alias("update"), n("delete").alias("delete"), n("merge").alias("conflict"))


def reason_histogram(plan: DataFrame, k: int = 8) -> DataFrame:  # A02
    keys = plan.select(F.explode("changes").alias("reason")).groupBy(N.histogram_key(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))
    return keys.orderBy(F.desc("n"), "reason").limit(k)


def needs_review() -> Column:  # P53
    return (F.col("action") == "merge") & F.col("user_override").isNull()


def is_routine() -> Column:
    return (effective_action() != "delete") & ~needs_review()


def routine_summary(plan: DataFrame, k: int = 3) -> DataFrame:  # A03
    first = N.histogram_key(F.get("changes", F.lit(0)))
    top = plan.where(is_routine() & (F.size("changes") > 0)).groupBy(first.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("reason"))))
    return top.agg(F.array_join(F.transform(rows, lambda r: F.concat((-r["o"]).cast("string"), F.lit(" × "), r["reason"])), ", ").alias("summary"))


def reason_maps(reason: Column) -> Column:  # P54
    """struct<field,left,right> of "Field: old → new" (left is the new value), null otherwise."""
    part = lambda k: F.regexp_extract(reason, r"(?s)^([^:]+): (.*?) → (.*)$", k)
    return F.when(reason.rlike(r"(?s)^[^:]+: .*? → .*$"), F.struct(part(1).alias("field"), part(3).alias("left"), part(2).alias("right")))


def review(plan: DataFrame, decisions: DataFrame) -> DataFrame:  # O23
    """plan with decisions (left_id, right_id, decision) on rows that need review.

    skip drops; keepBoth merges; useGoogle and useMac update toward the other side.
    """
    d = F.when(needs_review(), F.col("decision"))
    joined = plan.join(decisions.dropDuplicates(["left_id", "right_id"]), ["left_id", "right_id"], "left")
    override = F.when(d == "skip", "skip").when(d == "keepBoth", "merge").when(d.isin("useGoogle", "useMac"), "update").otherwise(F.col("user_override"))
    direction = F.when(d == "useGoogle", "googleToMac").when(d == "useMac", "macToGoogle").otherwise(F.col("direction"))
    source = F.when(d == "useGoogle", "google").when(d == "useMac", "mac").otherwise(F.col("source"))
    return joined.withColumns({"user_override": override, "direction": direction, "source": source}).select(*plan.columns)


def dedup_input(plan: DataFrame, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:  # O40
    """The records that a plan touches on each side."""
    ids = lambda c: plan.select(F.col(c).alias("contact_id")).where("contact_id is not null").distinct()
    return left.join(ids("left_id"), "contact_id", "left_semi"), right.join(ids("right_id"), "contact_id", "left_semi")
