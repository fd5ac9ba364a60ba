"""Queries over merges in turn, hot keys, stores that change in steps, and logs that forget."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.operators import apply as A
from bookmerge.operators import graph, matching, versions
from bookmerge.plans import fixtures as X
from bookmerge.plans import queries as Q
from bookmerge.plans import sqltext as T
from bookmerge.plans.queries import query
from bookmerge.schemas import Settings
from bookmerge.sources import sinks
from bookmerge.streaming import runs


def _path(spark: SparkSession, tag: str) -> str:
    return f"{graph.shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


# A left record for each nation, and a right one for each customer that merges into its nation's.
_NATION = """select concat('people/n', n_nationkey) as id, case n_nationkey % 3 when 0 then {name} when 1 then '' end as given_name, case when n_nationkey % 4 = 0 then 'note 1' end as note,
  concat('own', n_nationkey, '@x.test') as mail, n_nationkey as n from nation"""
_CUSTOMER = """select concat('mac/', lpad(cast(c_custkey as varchar(20)), 7, '0')) as id, case when c_custkey % 7 = 0 then cast(null as varchar(20)) when c_custkey % 5 < 2 then '' else concat('c', c_custkey) end as given_name,
  case when c_custkey % 40 < 2 then concat('note ', c_custkey % 3) end as note, case when c_custkey % 2 = 0 then upper(concat(c_mktsegment, '@x.test')) else lower(concat(c_mktsegment, '@x.test')) end as mail,
  case when c_custkey % 50 = 0 then concat('c', c_custkey, '@x.test') end as mail2, c_nationkey as n from customer"""
_LIVE = _NATION.format(name="concat('now ', n_name)")


def _contacts(rows: DataFrame, source: str) -> DataFrame:
    own = "google_resource_name" if source == "google" else "mac_contact_identifier"
    mails = F.transform(F.array_compact(F.array(*(c for c in ("mail", "mail2") if c in rows.columns))), lambda m: F.struct(m.alias("value"), F.lit("work").alias("label")))
    phone = F.concat(F.lit("55 " if source == "google" else "5-5"), (F.col("n") + 1000).cast("string"))
    return C.completed(rows.select(F.col("id").alias("contact_id"), F.lit(source).alias("source"), F.col("id").alias(own), "given_name", "note", mails.alias("emails"), F.array(F.struct(phone.alias("value"), F.lit("work").alias("label"))).alias("phones")))


@query(f"""with live as (select * from ({_LIVE}) where n % 10 <> 9), c as ({_CUSTOMER}), o as (select *, row_number() over (partition by n order by id) as seq from c where n in (select n from live)),
mails as (select n, 0 as seq, 1 as pos, mail as v from live union all select n, seq, 1, mail from o union all select n, seq, 2, mail2 from o where mail2 is not null),
kept as (select m.* from mails m join (select n, lower(v) as k, min(seq) as owner from mails group by 1, 2) w on w.n = m.n and w.k = lower(m.v) and w.owner = m.seq),
lists as (select o.n, o.seq, string_agg(k.v, ';' order by k.seq, k.pos) as emails from o join kept k on k.n = o.n and k.seq <= o.seq group by 1, 2),
made as (select o.n, o.seq, o.id, coalesce(nullif(l.given_name, ''), first_value(nullif(o.given_name, '') ignore nulls) over w, o.given_name) as given_name, emails,
  list_filter(list_prepend(l.note, list(o.note) over w), lambda x: x is not null) as notes, count(*) over (partition by o.n) as of_n from o join live l on l.n = o.n join lists on lists.n = o.n and lists.seq = o.seq window w as (partition by o.n order by o.seq rows unbounded preceding)),
told as (select *, case when len(notes) > 0 then list_reduce(notes, lambda a, x: case when a = x then a else a || chr(10) || '---' || chr(10) || x end) end as note from made)
select 'mac' as side, id, given_name, emails, 1 as n_phones, note from told union all select 'google', 'people/n' || n, given_name, emails, 1, note from told where seq = of_n
union all select 'google', id, given_name, mail, 1, note from live where n not in (select n from o) union all select 'mac', id, given_name, concat_ws(';', mail, mail2), 1, note from c where n not in (select n from live)""")
def merged_in_turn(spark, d):  # O28
    """All customers of a nation merge into its record, one after the other. The plan is stale: the records got other names since, and every tenth is gone."""
    nation, customer = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    made = lambda text, **t: spark.sql(text.replace("from nation", "from {nation}").replace("from customer", "from {customer}"), **t)
    planned, live = made(_NATION.format(name="n_name"), nation=nation), made(_LIVE, nation=nation).where("n % 10 <> 9")
    right = made(_CUSTOMER, customer=customer)
    pairs = planned.select(F.col("id").alias("left_id"), "n").join(right.select(F.col("id").alias("right_id"), "n"), "n")
    plan = pairs.select(F.lit("merge").alias("action"), F.lit("merge").alias("user_override"), F.lit("google").alias("source"), F.array(F.lit("Matched an existing Google contact")).alias("changes"), "left_id", "right_id", F.lit("merged").alias("outcome"))
    left2, right2 = A.apply_books(plan, _contacts(live, "google"), _contacts(right, "mac"), settings=Settings(sync_notes=True))
    told = lambda book, side: book.select(F.lit(side).alias("side"), F.col("contact_id").alias("id"), "given_name", F.array_join(C.values(F.col("emails")), ";").alias("emails"), F.size("phones").alias("n_phones"), "note")
    return told(left2, "google").unionByName(told(right2, "mac"))


@query("with k as (select c_custkey as id, c_nationkey || c_mktsegment as key from customer) select x.key, count(*) as pairs, count(distinct x.id) as lesser, cast(sum(x.id * y.id % 1009) as bigint) as folded from k x join k y on x.key = y.key and x.id < y.id group by x.key")
def shared_key_pairs(spark, d):  # J09
    """Pairs of the customers of one nation and segment, whose keys are dealt in blocks of eight records."""
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.concat("c_nationkey", "c_mktsegment").alias("key"))
    pairs = matching.pairs_by_key(keys, block=8, keyed=True)
    by_lesser = pairs.groupBy("key", "id_a").agg(F.count("*").alias("n"), F.sum(F.col("id_a") * F.col("id_b") % 1009).alias("folded"))
    return by_lesser.groupBy("key").agg(F.sum("n").alias("pairs"), F.count("*").alias("lesser"), F.sum("folded").alias("folded"))


@query(f"""with recursive {T.BOOKS}, k as (select id, 'n' || lower(given_name) || '|' || lower(family_name) as key from l where given_name is not null and family_name is not null union select id, 'e' || lower(email) from l where email is not null),
e as (select distinct x.id as a, y.id as b from k x join k y on x.key = y.key and x.id <> y.id), reach as (select a, b from e union select reach.a, e.b from reach join e on e.a = reach.b)
select a as id, min(b) as cluster from reach group by a""")
def simple_duplicate_groups(spark, d):  # J21
    return matching.simple_duplicate_groups(X.left_book(spark, d))


@query(f"with {T.BOOKS} select id, email, case when email is not null then 'work' end as type, phone, case when phone is not null then 'mobile' end as phone_type, url, organization_name as organization from l")
def left_records(spark, d):  # P45
    """The left book as its side stores it: elements carry their type, an empty list is none."""
    rows = C.as_struct(X.left_book(spark, d), "c").select(A.to_left_record(F.col("c")).alias("r"))
    first = lambda f: F.get(f"r.{f}", F.lit(0))
    return rows.select("r.contact_id", first("emails").alias("e"), first("phones").alias("p"), first("urls").alias("u"), "r.organization").select(F.col("contact_id").alias("id"), F.col("e.value").alias("email"), F.col("e.type").alias("type"), F.col("p.value").alias("phone"), F.col("p.type").alias("phone_type"), F.col("u.value").alias("url"), "organization")


@query(f"""with {Q._ORDERS}, s as (select session, count(*) as n, max(ts) as ts from o group by 1), kept as (select * from s order by ts desc, cast(session as varchar) desc limit 25)
select cast(session as varchar) as session, cast(n as int) as versions, cast(ts as varchar) as newest, cast((select max(version_number) from o where session in (select session from kept)) as int) as highest from kept""")
def session_store(spark, d):  # K05
    """40 sessions are stored; one half is written again, which changes nothing; the newest 25 stay, and highest numbers are those of what stayed."""
    v = graph.durable(Q._versions(spark, d).select(F.col("session").cast("string").alias("session_id"), "contact_identifier", "version_number", F.col("timestamp").alias("timestamp"), "name"))
    kept = sinks.SessionStore(spark, _path(spark, "store"))
    kept.write(v)
    kept.write(v.where("cast(session_id as int) < 20"))
    kept.retain(25)
    highest = kept.highest().agg(F.max("version_number").alias("highest"))
    return kept.summaries().select(F.col("session_id").alias("session"), F.col("version_count").alias("versions"), F.col("timestamp").cast("string").alias("newest")).join(highest)


@query(f"""with {T.BOOKS}, {Q._BOTH_BOOKS}, x as (select *, right(id, 1) as last from both_books), live as (select * from x where last <> '4'),
told as (select source as side, case when last = '6' then 'failed' when last = '4' then 'recreated' else 'updated' end as outcome from x where last <> '3' union all select source, 'removed' from live where last = '3')
select side, outcome, count(*) as n from told group by 1, 2
union all select source, 'stored', count(*) from live group by 1
union all select source, 'left', count(*) from x where last <> '3' group by 1""")
def rollback_steps(spark, d):  # O38
    """A rollback that fails for every id with a 6 at its end, after a safety session: its tally, what the safety session holds, and what is left."""
    kept = sinks.SessionStore(spark, _path(spark, "store"))
    snapshot = versions.number_versions(Q._snapshot(spark, d).withColumn("position", F.lit(0)))
    kept.write(snapshot)
    left, right = Q._live(spark, d)
    failed = Q._snapshot(spark, d).where(F.col("contact_identifier").endswith("6")).select("source", "contact_identifier")
    a, b, tally = versions.run_rollback(kept, _path(spark, "rollback"), "s1", left, right, F.lit("2024-02-01").cast("timestamp"), "remove", failed)
    stored = kept.bodies(versions.BODY).where("session_id = 'safety-s1'").groupBy(F.col("source").alias("side")).agg(F.count("*").alias("n")).select("side", F.lit("stored").alias("outcome"), "n")
    rest = a.select("source").unionByName(b.select("source")).groupBy(F.col("source").alias("side")).agg(F.count("*").alias("n")).select("side", F.lit("left").alias("outcome"), "n")
    return tally.unionByName(stored).unionByName(rest)


@query("with e as (select event_id as id, event_type as action, cast(ts as timestamp) as ts from events) select id, action from e where ts >= (select max(ts) - interval 3 day from e)")
def audit_retention(spark, d):  # R04
    """The audit stream's log with three days' retention as of the last event."""
    return runs.audit(spark, d, days=3)
