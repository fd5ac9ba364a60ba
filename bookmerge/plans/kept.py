"""Queries over what is kept between runs: stored tables, sessions, exports, feeds; and the rules that guard them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.functions import normalize as N
from bookmerge.operators import diff as D
from bookmerge.operators import graph, logs, matching, versions
from bookmerge.operators.ranges import numbered
from bookmerge.plans import fixtures as X
from bookmerge.plans import queries as Q
from bookmerge.plans import sqltext as T
from bookmerge.plans.queries import query
from bookmerge.sources import sinks, stores
from bookmerge.streaming import runs


def _path(spark: SparkSession, tag: str) -> str:
    return f"{graph.shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, d: str, *columns) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k")).select("k", *columns)


def _by(n: int, *values) -> Column:
    """The value at k % n; None is null."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("k") % n).cast("int"))


@query(f"select google_resource_name, mac_contact_identifier from ({X.MAPPING}) m")
def stored_mappings(spark, d):  # S09, S14
    """A stored mapping with an older entry of every left id; a table that is not there is empty."""
    path = _path(spark, "mapping")
    now = X.mapping(spark, d)
    older = now.withColumns({"mac_contact_identifier": F.concat("mac_contact_identifier", F.lit("-old")), "last_synced_at": F.col("last_synced_at") - F.make_dt_interval(F.lit(2))})
    now.unionByName(older).write.json(path)
    found, none = stores.load_mappings(spark, path), stores.load_mappings(spark, f"{path}-none")
    return found.unionByName(none).select("google_resource_name", "mac_contact_identifier")


@query(f"with {Q._ORDERS} select contact_identifier, cast(version_number as int) as version_number, session, case when session < 20 then name else 'copy of ' || name end as name from o where session in (7, 33)")
def session_bodies(spark, d):  # K05, S10
    """Two sessions from the primary place and its fallback, which holds all of them."""
    v = graph.durable(Q._versions(spark, d).select(F.col("session").alias("session_id"), "contact_identifier", "version_number", "name"))
    here, there = (sinks.SessionStore(spark, _path(spark, "sessions")) for _ in range(2))
    here.write(v.where("session_id < 20"))
    there.write(v.withColumn("name", F.concat(F.lit("copy of "), "name")))
    read = lambda kept: kept.bodies("contact_identifier string, version_number int, name string").withColumn("session_id", F.col("session_id").cast("long"))
    found = [stores.load_session(read(here), read(there), s) for s in ("7", "33")]
    return found[0].unionByName(found[1]).select("contact_identifier", "version_number", F.col("session_id").alias("session"), "name")


_SESSIONS = "s as (select o_orderkey % 40 as id, max(o_orderdate) as ts, count(*) as n from orders group by 1)"


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy((F.col("o_orderkey") % 40).alias("id")).agg(F.max("o_orderdate").cast("timestamp").alias("timestamp"), F.count("*").alias("n"))


@query(f"with {_SESSIONS} select cast(id as varchar) as id, cast(n as int) as versions from s")
def session_index(spark, d):  # S11
    """An index whose even sessions are summaries and whose odd ones are in the older form, with their bodies."""
    path = _path(spark, "index")
    old = F.col("id") % 2 == 1
    body = F.when(old, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(i.cast("string").alias("id"))))
    _sessions(spark, d).select(F.col("id").cast("string").alias("id"), "timestamp", F.when(~old, F.col("n").cast("int")).alias("version_count"), body.alias("contact_versions")).write.json(path)
    return stores.read_index(spark, path).select("id", F.col("version_count").alias("versions"))


@query(f"with {_SESSIONS} select '{{\"id\":' || id || ',\"n\":' || n || ',\"timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\"}}' as text from s")
def session_documents(spark, d):  # K06
    path = _path(spark, "documents")
    sinks.export_session(_sessions(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("text"))


@query(f"with {_SESSIONS} select id, cast(row_number() over (order by ts desc, id) as int) as place from s")
def session_list(spark, d):  # T01
    """Places of the sessions in the list, numbered in ranges."""
    rows = versions.list_backups(_sessions(spark, d)).select("id", F.struct((-F.unix_micros("timestamp")).alias("t"), "id").alias("at"), F.lit(0).alias("list"))
    return numbered(rows, ["list"], "at", "place").select("id", (F.col("place") + 1).cast("int").alias("place"))


@query(f"with {T.BOOKS} select id, given_name, true as lacks_urls from l")
def legacy_snapshots(spark, d):  # S12, P44
    """An older file, whose records have no lists of websites."""
    path = _path(spark, "legacy")
    old = X.left_book(spark, d).select(F.lit("s1").alias("session_id"), F.col("contact_id").alias("contact_identifier"), F.struct("contact_id", "given_name").alias("data"))
    old.write.json(path)
    rows = stores.read_snapshots(spark, path)
    mask = versions.legacy_mask(rows)
    return rows.select(F.col("contact_identifier").alias("id"), "data.given_name", (F.col("data.urls").isNull() & F.lit(not any(mask.values()))).alias("lacks_urls"))


@query(f"with {T.BOOKS}, {Q._BOTH_BOOKS} select source, count(*) as n, true as websites, true as before, true as after, false as after_dry from both_books where id not like '%3' group by source")
def session_gates(spark, d):  # O36, P44
    snapshot = graph.durable(Q._snapshot(spark, d))
    plan = X.mapping(spark, d)
    told = {"websites": versions.legacy_mask(snapshot)["websites"], "before": versions.should_snapshot(plan), "after": versions.should_snapshot(plan, snapshot, after=True), "after_dry": versions.should_snapshot(plan, snapshot, dry_run=True, after=True)}
    return snapshot.groupBy("source").agg(F.count("*").alias("n"), *(F.lit(v).alias(k) for k, v in told.items()))


@query(f"with {T.BOOKS}, {Q._BOTH_BOOKS} select case when id like '%4' then 'mac' else source end as side, case when id like '%4' then 'recreated' else 'updated' end as outcome, count(*) as n from both_books where id not like '%3' group by 1, 2")
def restored_versions(spark, d):  # O37
    restored = versions.restore_one(graph.durable(Q._snapshot(spark, d)), *Q._live(spark, d))
    return restored.groupBy("side", "outcome").agg(F.count("*").alias("n"))


@query('''select c_custkey || ',' || case c_custkey % 5 when 0 then '"a, b"' when 1 then '"say ""x"""' when 2 then '' when 3 then ' plain ' else '' end || ',end' as line from customer''')
def csv_lines(spark, d):  # K03
    """Lines of the written files: fields with commas and quotes, blanks at the ends, empty and null ones."""
    path = _path(spark, "csv")
    sinks.write_csv(_customers(spark, d, _by(5, "a, b", 'say "x"', "", " plain ", None).alias("v"), F.lit("end").alias("last")), path)
    return spark.read.text(path).where("value <> 'k,v,last'").select(F.col("value").alias("line"))


@query(Q.SQL["redacted_log"])
def exported_log(spark, d):  # K07
    path = _path(spark, "log")
    sinks.export_log(X.sync_events(spark, d), path)
    return spark.read.schema("id long, details string").json(path)


@query("""select c_custkey as k, case c_custkey % 6 when 0 then 'United States' when 1 then 'Germany' when 2 then 'France' when 3 then 'Germany' when 4 then 'Nowhere' else 'France' end as country,
  case c_custkey % 6 when 0 then 'US' when 1 then 'DE' when 2 then 'FR' when 3 then 'DE' when 5 then 'FR' end as code from customer""")
def country_codes(spark, d):  # P20
    known = N.normalize_country(_by(6, None, "x", "France", "germany", "Nowhere", "  FRANCE "), _by(6, "us ", " de", "zz", "", None, ""))
    return _customers(spark, d, known["country"].alias("country"), known["country_code"].alias("code"))


@query(f"with {T.BOOKS}, q as (select id, cast(regexp_extract(id, '[0-9]+$') as bigint) as k from l) select id, k % 3 <> 0 as same, k % 2 = 0 and k % 4 <> 0 as copies_photo from q")
def same_contents(spark, d):  # P49, P61
    """Records against versions of themselves with another id and time, some with another nickname; photos whose copy failed before."""
    k = F.regexp_extract("a.contact_id", "[0-9]+$", 0).cast("long")
    rows = C.as_struct(X.left_book(spark, d), "a").select("a", k.alias("k"))
    a = F.col("a")
    other = C.replaced(a, contact_id=F.lit("other"), last_modified=F.lit(None).cast("timestamp"), nickname=F.when(F.col("k") % 3 == 0, "zz").otherwise(a["nickname"]))
    shown = C.replaced(a, photo_url=F.when(F.col("k") % 2 == 0, "http://photo.test/1"))
    rows = rows.select("a", "k", other.alias("b"), shown.alias("p"))
    failed = F.array(F.when(F.col("k") % 4 == 0, a["google_resource_name"]))
    return rows.select(F.col("a.contact_id").alias("id"), C.same_content(a, F.col("b")).alias("same"), C.photo_needs_copy(F.col("p"), F.col("b"), failed).alias("copies_photo"))


@query(Q.SQL["diff_one_way"])
def computed_changes(spark, d):  # O08
    return Q._joined(D.compute_changes(X.left_book(spark, d), X.right_book(spark, d), X.mapping(spark, d), "googleToMac")[0])


@query("select 'p' || c_custkey as pattern, case when c_custkey % 3 = 0 then 'skip' else 'merge' end as decision from customer order by c_custkey % 30 desc, 1 limit 20")
def pattern_list(spark, d):  # O24, T04
    """The newest 20 patterns, with one answer for all that had none."""
    rows = _customers(spark, d, F.when(F.col("k") % 3 == 0, "skip").alias("decision")).select(F.concat(F.lit("p"), "k").alias("pattern"), "decision", F.timestamp_seconds(F.col("k") % 30).alias("created_at"))
    return logs.list_patterns(matching.bulk_decide(rows, "merge")).limit(20).select("pattern", "decision")


@query("select user_id as key, arg_max(event_type, event_id) as event_type, max(event_id) as seq from events group by user_id")
def stream_feed(spark, d):  # R03
    return runs.feed(spark, d)


@query("select event_id as id, event_type as action from events")
def stream_audit(spark, d):  # R04
    """Every event comes twice and is logged once."""
    return runs.audit(spark, d)
