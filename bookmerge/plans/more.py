"""Further registered queries: right-book exports, scalar rules, masks, folds, reviews, stores, responses, backups, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.functions import names as M
from bookmerge.functions import normalize as N
from bookmerge.operators import apply as A
from bookmerge.operators import diff as D
from bookmerge.operators import graph, logs, matching, merge, versions
from bookmerge.plans import fixtures as X
from bookmerge.plans import queries as Q
from bookmerge.plans import sqltext as T
from bookmerge.plans.queries import SYNC, query
from bookmerge.schemas import Settings
from bookmerge.sources import people as P
from bookmerge.sources import sinks


@query(f"""with {T.BOOKS} select array_to_string(list_filter([given_name, nullif(middle_name, ''), family_name], lambda q: q is not null), ' ') as "Name", given_name as "Given Name", middle_name as "Middle Name", family_name as "Family Name", email as "Email 1 Value", phone as "Phone 1 Value", organization_name as "Organization", job_title as "Job Title", '' as "Department", '' as "Notes", id as "Contact ID" from r""")
def right_export(spark, d):  # S06, K02
    """The right side's raw records (null texts) through its mapping into the flat export."""
    raw = X.right_book(spark, d).withColumnRenamed("contact_id", "identifier").withColumn("middle_name", F.nullif("middle_name", F.lit(""))).withColumn("source", F.lit(None).cast("string"))
    cols = ["Name", "Given Name", "Middle Name", "Family Name", "Email 1 Value", "Phone 1 Value", "Organization", "Job Title", "Department", "Notes", "Contact ID"]
    return sinks.flat_export_right(P.to_unified_right(raw)).select(*cols)


_SCORE = "2 + cast(organization_name is not null as int) + cast(job_title is not null as int) + 2 * cast(phone is not null as int) + 2 * cast(email is not null as int) + 1"


@query(f"""with {T.BOOKS} select id, email as mail, phone as number, concat_ws(', ', street, city, '', '', '') as address, regexp_replace(phone, '[^0-9+]', '', 'g') as loose_phone, lower(email) as loose_email,
  e <> '' or p <> '' as reachable, {_SCORE} as score, upper(given_name) as upper_given, job_title as title,
  concat_ws('-', case when bd_year is not null then lpad(cast(bd_year as varchar), 4, '0') end, lpad(cast(bd_month as varchar), 2, '0'), lpad(cast(bd_day as varchar), 2, '0')) as birthday,
  case when email is null then null else 'work' end as label, case when length(display) > 6 then substr(display, 1, 6) || '…' else display end as line, regexp_matches(given_name || family_name, '[一-鿿]') as cjk from l""")
def scalar_rules(spark, d):  # P04-P07, P17, P32, P35, P37, P39-P41
    book = M.apply_name_format(X.left_book(spark, d).withColumn("plain_given", F.col("given_name")), "upperCase")
    n = C.normalized(C.HERE)
    mail, number = C.primary_email(C.HERE), C.primary_phone(C.HERE)
    as_was = book.withColumns({"upper_given": F.col("given_name"), "given_name": F.col("plain_given"), "family_name": F.lower("family_name")})
    return as_was.select(
        F.col("contact_id").alias("id"), mail.alias("mail"), number.alias("number"), C.formatted_address(F.get("addresses", F.lit(0))).alias("address"), N.phone_key_loose(number).alias("loose_phone"), N.email_key_loose(mail).alias("loose_email"),
        (C.has_contact(n) & ~C.is_empty(n)).alias("reachable"), C.data_score(C.HERE).alias("score"), "upper_given", F.col("job_title").alias("title"), N.partial_date_text(F.col("birthday")).alias("birthday"),
        N.canonical_label(F.get("emails", F.lit(0))["label"]).alias("label"), N.bounded_single_line(C.display_name(C.HERE), 6).alias("line"), M.contains_cjk(F.concat("given_name", "family_name")).alias("cjk"),
    )


_MASKED = Settings(sync_job_title=False, sync_websites=False, sync_country_codes=False, name_format="upperCase")


@query(f"""with {T.BOOKS} select y.id, upper(x.given_name) as given_name, upper(x.family_name) as family_name, x.organization_name as organization, y.job_title, coalesce(x.phone, '') as phone, y.url, x.bd_day as day, x.nickname from mp join l x on x.id = google_resource_name join r y on y.id = mac_contact_identifier""")
def masked_writes(spark, d):  # P42, P43
    """Left records written onto mapped right ones with job titles and websites switched off."""
    rows = D.classify_mappings(X.mapping(spark, d), X.left_book(spark, d), X.right_book(spark, d)).where("a is not null and b is not null")
    c = rows.select(C.field_settings(F.col("a"), _MASKED).alias("sent"), "b").select(C.apply_mask(F.col("sent"), F.col("b"), C.write_mask(_MASKED)).alias("c"))
    one = lambda f: F.coalesce(F.get(C.values(F.col(f"c.{f}")), F.lit(0)), F.lit(""))
    return c.select(F.col("c.contact_id").alias("id"), "c.given_name", "c.family_name", "c.organization", "c.job_title", one("phones").alias("phone"), one("urls").alias("url"), F.col("c.birthday.day").alias("day"), "c.nickname")


_GROUPS = f"""m as (select *, regexp_extract(id, '[0-9]+$') as grp2, {_SCORE} as score, row_number() over (partition by regexp_extract(id, '[0-9]+$') order by -({_SCORE}), id) as no from l where regexp_matches(id, '[05]$')),
ph as (select grp2, no, phone, {T.digits('phone')} as k from m where phone is not null), em as (select grp2, no, email, lower(email) as k from m where email is not null)"""


def _first_list(table: str, value: str) -> str:
    return f"(select grp2, string_agg({value}, ';' order by no) as vals from {table} x where not exists (select 1 from {table} y where y.grp2 = x.grp2 and y.k = x.k and y.no < x.no) group by grp2)"


@query(f"""with {T.BOOKS}, {_GROUPS}
select m.grp2 as "group", arg_min(m.id, no) as contact_id, arg_min(given_name, no) as given_name, arg_min(organization_name, no) as organization, coalesce(any_value(p.vals), '') as phones, coalesce(any_value(e.vals), '') as emails, count(*) - 1 as deleted
from m left join {_first_list('ph', 'phone')} p on p.grp2 = m.grp2 left join {_first_list('em', 'email')} e on e.grp2 = m.grp2 group by m.grp2""")
def executed_merges(spark, d):  # O18, A11, W04
    """Left records of one customer merged: the survivor and how many records go."""
    book = C.completed(X.left_book(spark, d)).where(F.col("contact_id").rlike("[05]$"))
    members = C.as_struct(book, "c").select(F.regexp_extract("c.contact_id", "[0-9]+$", 0).alias("group"), "c")
    kept, gone, _ = merge.execute_merge(graph.durable(members), X.mapping(spark, d))
    n = gone.groupBy("group").agg(F.count("*").alias("deleted"))
    joined = lambda f: F.array_join(C.values(F.col(f"c.{f}")), ";").alias(f)
    return kept.join(n, "group", "left").select("group", "c.contact_id", "c.given_name", "c.organization", joined("phones"), joined("emails"), F.coalesce("deleted", F.lit(0)).alias("deleted"))


_RIGHT_WITHIN = f"{T.BOOKS}, {T.pairs('r', 'r', 'x.id < y.id')}, {T.signals('r', 'r')}"


@query(f"""with found as (select effective from (with {T.WITHIN} select effective from k) union all select effective from (with {_RIGHT_WITHIN} select effective from k) union all select effective from (with {T.ACROSS} select effective from k))
select (select count(*) from customer) as scanned, count(*) as "groups", count(*) filter (effective >= 80) as auto, count(*) filter (effective between 50 and 79) as confirm, count(*) filter (effective < 50) as separate, count(*) = 0 as may_proceed from found""")
def dedup_totals(spark, d):  # O15, A05, X01, O41
    scanned = spark.read.parquet(f"{d}/customer.parquet").count()
    found = graph.durable(matching.detect_duplicates(X.left_book(spark, d), X.right_book(spark, d), X.mapping(spark, d), carry=matching.bare_ids).select("effective", "decision"))
    return matching.dedup_stats(found, scanned).join(matching.may_proceed(found))


_DECIDED = "case when length(left_id) % 5 = 0 then 'skip' when length(left_id) % 5 = 1 then 'keepBoth' when length(left_id) % 5 = 2 then 'useGoogle' when length(left_id) % 5 = 3 then 'useMac' end"


@query(f"""with recursive {T.TWO_WAY}, q as (select *, case when action = 'merge' and user_override is null then {_DECIDED} end as de from plan2)
select coalesce(case de when 'skip' then 'skip' when 'keepBoth' then 'merge' when 'useGoogle' then 'update' when 'useMac' then 'update' end, user_override, action) as effective, case de when 'useGoogle' then 'googleToMac' when 'useMac' then 'macToGoogle' else direction end as direction, case de when 'useGoogle' then 'google' when 'useMac' then 'mac' else source end as source, count(*) as n from q group by 1, 2, 3""")
def reviewed_plan(spark, d):  # O23
    plan = Q._plan(spark, d)
    size = F.length("left_id") % 5
    choice = F.when(size == 0, "skip").when(size == 1, "keepBoth").when(size == 2, "useGoogle").when(size == 3, "useMac")
    decisions = plan.where("left_id is not null and right_id is not null").select("left_id", "right_id", choice.alias("decision"))
    done = D.review(plan, decisions)
    return done.groupBy(D.effective_action().alias("effective"), "direction", "source").agg(F.count("*").alias("n"))


@query(f"""with recursive {T.TWO_WAY}, a as (select count(distinct left_id) as n from plan2 where left_id in (select id from l)), b as (select count(distinct right_id) as n from plan2 where right_id in (select id from r)) select a.n as lefts, b.n as rights from a, b""")
def dedup_scope(spark, d):  # O40
    left, right = D.dedup_input(Q._plan(spark, d), X.left_book(spark, d), X.right_book(spark, d))
    return left.agg(F.count("*").alias("lefts")).join(right.agg(F.count("*").alias("rights")))


@query(f"""with recursive {T.TWO_WAY}, {Q._OUTCOME}, e as (select *, outcome not in ('set_aside', 'deferred_deletion') and coalesce(user_override, action) <> 'merge' and {Q._WRITE_LEFT} as eligible from done)
select count(*) filter (eligible) as eligible, count(*) filter (outcome in ('added', 'updated', 'deleted', 'merged')) as dry_done, (select count(*) from l) as left_rows from e""")
def dry_run(spark, d):  # O30, O34
    """What a dry run counts and what could go out in batches; the books stay."""
    dry = Settings(sync_deleted=True, dry_run=True)
    left, right = X.left_book(spark, d), X.right_book(spark, d)
    out = graph.durable(A.with_outcomes(Q._plan(spark, d), Q._ledger(spark, d), dry))
    same, _ = A.apply_books(out, left, right, settings=dry)
    told = out.agg(F.count_if(A.batch_eligible("twoWay", dry)).alias("eligible"), F.count_if(F.col("outcome").isin("added", "updated", "deleted", "merged")).alias("dry_done"))
    return told.join(same.agg(F.count("*").alias("left_rows")))


@query("""with c as (select c_custkey as k from customer) select k, case when k % 4 = 0 then 'f' || k when k % 5 <> 0 then 'e' || k end as etag, k % 7 <> 0 as created, k % 6 not in (0, 1) as updated from c""")
def batch_answers(spark, d):  # J14, K09, K10
    """Etags (cached first) and the answers to batches of 7: short ones leave items without an answer."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), k.cast("string").alias("id"))
    tagged = A.with_etags(c, c.where("k % 5 <> 0").select("id", F.concat(F.lit("e"), "id").alias("etag")), c.where("k % 4 = 0").select("id", F.concat(F.lit("f"), "id").alias("etag")))
    asked = tagged.select("k", "id", "etag", F.floor((F.col("k") - 1) / 7).alias("batch"), ((F.col("k") + 6) % 7).cast("int").alias("pos"))
    answers = asked.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("items")).select("batch", F.transform(F.filter("items", lambda x: x["pos"] < 6), lambda x: x["id"]).alias("items"))
    made = A.align_create_results(asked, answers).withColumnRenamed("accepted", "created").drop("person")
    replies = c.where("k % 6 <> 0").select("id", F.when(F.col("k") % 6 != 1, F.col("id")).alias("person"))
    return A.align_update_results(made, replies).select("k", "etag", "created", F.col("accepted").alias("updated"))


_LEDGER_EVENTS = "select user_id as k, ts, event_id as seq, case event_type when 'error' then 'failure' when 'purchase' then 'success' when 'signup' then 'ignore' when 'click' then 'retry' end as kind from events where event_type <> 'view'"


@query(f"""with e as ({_LEDGER_EVENTS}), old as (select distinct user_id as k, 1 + user_id % 3 as c from events where user_id % 2 = 0),
r as (select k, max((ts, seq)) as at from e where kind in ('success', 'retry') group by k), f as (select e.k, count(*) filter (kind = 'failure') as n, bool_or(kind = 'ignore') as ig from e left join r on r.k = e.k where r.at is null or (e.ts, e.seq) > r.at group by e.k),
z as (select coalesce(o.k, f.k) as k, coalesce(o.c, 0) + coalesce(f.n, 0) as n, coalesce(f.ig, false) as ig from (select * from old where k not in (select k from r)) o full join f on f.k = o.k)
select cast(k as varchar) as id, cast(n as int) as failure_count, ig as ignored from z where n > 0 or ig""")
def ledger_after_events(spark, d):  # K12
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type <> 'view'")
    kind = F.element_at(F.create_map(*(F.lit(x) for x in ("error", "failure", "purchase", "success", "signup", "ignore", "click", "retry"))), F.col("event_type"))
    events = e.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("seq"), kind.alias("kind"))
    every = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().where("user_id % 2 = 0")
    old = every.select(F.col("user_id").cast("string").alias("id"), (1 + F.col("user_id") % 3).cast("int").alias("failure_count"), F.lit(None).cast("timestamp").alias("last_failed_at"), F.lit(False).alias("ignored"))
    return logs.apply_ledger_events(old, events).select("id", "failure_count", "ignored")


@query("""with c as (select c_custkey as k from customer), m as (select k, case when k % 5 = 0 then 'new' else 'old' end as v from c where k % 3 <> 0 or k % 5 = 0) select k, v, k % 7 = 0 as unlinked, k % 7 <> 0 as struck from m where k % 11 <> 0""")
def mapping_store(spark, d):  # K04, K11, O39, W07, X02
    """Upserts (the latest of two changes a key), deletions and unlinked rows of a store."""
    k = F.col("c_custkey").alias("k")
    c = spark.read.parquet(f"{d}/customer.parquet").select(k)
    store = c.where("k % 3 <> 0").withColumn("v", F.lit("old"))
    changes = c.where("k % 5 = 0").select("k", F.explode(F.array(F.struct(F.lit("first").alias("v"), F.lit(1).alias("seq")), F.struct(F.lit("new").alias("v"), F.lit(2).alias("seq")))).alias("x")).select("k", "x.v", "x.seq")
    now = logs.delete_keys(logs.upsert(store, logs.latest_per_key(changes, "k", "seq").drop("seq"), "k"), c.where("k % 11 = 0"), "k")
    mapping = now.select(F.col("k").cast("string").alias("google_resource_name"), F.concat(F.lit("m"), "k").alias("mac_contact_identifier"), "k", "v")
    ledger = now.select(F.concat(F.lit("google:"), F.col("k").cast("string")).alias("id"))
    left, strikes = logs.unlink(mapping, ledger, c.where("k % 7 = 0").select(F.col("k").cast("string").alias("google_resource_name")))
    dropped = logs.minus_ids(now.select(F.col("k").alias("id")), left.select(F.col("k").alias("id"))).select(F.col("id").alias("k"))
    struck = strikes.select(F.regexp_extract("id", "[0-9]+", 0).cast("long").alias("k"), F.lit(True).alias("struck"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return now.join(dropped.withColumn("unlinked", F.lit(True)), "k", "left").join(struck, "k", "left").select("k", "v", flag("unlinked"), flag("struck"))


_SESSIONS = "s as (select o_orderkey % 40 as id, max(o_orderdate) as ts, count(*) as n from orders group by 1)"


@query(f"""with {_SESSIONS}, p as (select id, ts, n from s where id < 25), f as (select id, ts + interval 1 day as ts, n + 1 as n from s where id >= 20 and id < 35), b as (select id from s where id % 2 = 0),
u as (select id, n from f where id < 25 union all select id, n from p where id < 20 union all select id, n from f where id >= 25 and id in (select id from b))
select id, cast(n as bigint) as n, false as orphan from u union all select id, cast(0 as bigint), true from b where id >= 35""")
def backup_indexes(spark, d):  # J18, J19, S13
    """Two indexes united, and stored bodies that no index knows."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    s = o.groupBy((F.col("o_orderkey") % 40).alias("id")).agg(F.max("o_orderdate").cast("timestamp").alias("timestamp"), F.count("*").alias("n"))
    s = graph.durable(s)
    newer = s.where("id >= 20 and id < 35").select("id", (F.col("timestamp") + F.make_dt_interval(F.lit(1))).alias("timestamp"), (F.col("n") + 1).alias("n"))
    bodies = s.where("id % 2 = 0").select("id")
    both = versions.merge_indexes(s.where("id < 25"), newer, bodies)
    index = s.where("id < 35").select("id")
    known = logs.import_sessions(both, both)
    return known.select("id", "n", F.lit(False).alias("orphan")).unionByName(versions.orphans(bodies, index).select("id", F.lit(0).cast("long").alias("n"), F.lit(True).alias("orphan")))


@query(f"with {_SESSIONS} select count(*) as backups, cast(min(ts) as varchar) as oldest, cast(max(ts) as varchar) as newest, cast(sum(n) as bigint) as versions from s")
def backup_totals(spark, d):  # A07, P65, S11
    o = spark.read.parquet(f"{d}/orders.parquet")
    full = o.groupBy((F.col("o_orderkey") % 40).alias("id")).agg(F.max("o_orderdate").alias("timestamp"), F.lit(None).cast("int").alias("version_count"), F.transform(F.sequence(F.lit(1), F.count("*")), lambda i: F.struct(i.cast("string").alias("id"))).alias("contact_versions"))
    return versions.backup_stats(versions.session_summary(full)).select("backups", F.col("oldest").cast("string").alias("oldest"), F.col("newest").cast("string").alias("newest"), "versions")


@query(f"with {Q._ORDERS}, top as (select contact_identifier as c from o group by 1 order by cast(contact_identifier as int) limit 5) select contact_identifier, cast(max(version_number) as int) as top, arg_max(name, version_number) as name from o where contact_identifier in (select c from top) and lower(name) like '%customer%' group by 1")
def version_search(spark, d):  # A09, T02, P64
    v = graph.durable(Q._versions(spark, d))
    top = versions.max_versions(v).orderBy(F.col("contact_identifier").cast("int")).limit(5)
    found = versions.search_versioned(versions.versioned_contacts(v), "CUSTOMER").select("contact_identifier")
    last = v.join(top, ["contact_identifier", "version_number"], "left_semi").join(found, "contact_identifier", "left_semi")
    return last.select("contact_identifier", F.col("version_number").alias("top"), "name")


@query(f"""with {T.WITHIN}, b as (select id_a, id_b, score, row_number() over (order by id_a, id_b) as no, effective from k where score between 30 and 79)
select id_a, id_b, case length(id_a) % 3 when 0 then 'merge' when 1 then 'keepSeparate' else case when effective >= 80 then 'merge' else 'skip' end end as action, case length(id_a) % 3 when 0 then 'sure' when 1 then 'other' end as said,
  'Name: ' || lx.display || ' | Org: ' || lx.organization_name || coalesce(' | Title: ' || lx.job_title, '') || coalesce(' | Emails: ' || lx.email, '') || coalesce(' | Phones: ' || lx.phone, '') || coalesce(' | Nickname: ' || lx.nickname, '') as card from b join l lx on lx.id = id_a""")
def adjudicated_pairs(spark, d):  # J15, P36, P55, P59, P60
    """Ambiguous pairs with cards, and the answers that come back by key; a third has none."""
    found = matching.detect_within(X.left_book(spark, d), carry=matching.review_form)
    pairs = asked = graph.durable(matching.review_requests(found, keep=("verdict",)))
    size = F.length("id_a") % 3
    text = F.when(size == 0, '```json\n{"confidence": 90, "is_duplicate": true, "reasoning": "sure", "action": "merge"}\n```').when(size == 1, '{"action": "keep_separate", "reasoning": "other"}')
    answers = asked.select("verdict_key", text.alias("answer")).where("answer is not null")
    out = matching.with_verdicts(pairs, answers)
    return out.select("id_a", "id_b", F.col("verdict.action").alias("action"), F.when(size < 2, F.col("verdict.reasoning")).alias("said"), F.col("card_a").alias("card"))


@query(f"with {T.BOOKS} select x.id as id_a, y.id as id_b from l x join l y on x.id < y.id and ((lower(x.given_name) = lower(y.given_name) and lower(x.family_name) = lower(y.family_name)) or lower(x.email) = lower(y.email))")
def simple_duplicates(spark, d):  # J21
    return matching.simple_duplicates(X.left_book(spark, d))


@query("""with a as (select event_id as id, case event_type when 'error' then 'api' when 'click' then 'chunk' when 'view' then 'network' else 'item' end as kind, case event_id % 4 when 0 then 429 when 1 then 404 when 2 then 503 else 400 end as status from events)
select id, case when kind in ('chunk', 'network') then false when kind = 'api' then status in (404, 400) else true end as counts, kind = 'chunk' and id % 2 = 0 as fatal from a""")
def failure_kinds(spark, d):  # P50, P51
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("error", "api", "click", "chunk", "view", "network"))), F.col("event_type")), F.lit("item"))
    status = F.get(F.array(*map(F.lit, (429, 404, 503, 400))), (F.col("event_id") % 4).cast("int"))
    inner = F.when(F.col("event_id") % 2 == 0, "auth").otherwise("api")
    return e.select(F.col("event_id").alias("id"), A.counts_toward_set_aside(kind, status).alias("counts"), A.is_fatal(kind, inner).alias("fatal"))


@query("""with e as (select event_id as id, user_id % 3 as a, user_id % 2 as u, event_id % 5 as f from events)
select id, case when a + u + f = 0 then 'No changes' else concat_ws(' · ', case when a > 0 then a || ' added' end, case when u > 0 then u || ' updated' end, case when f > 0 then f || ' failed' end) end as said,
  case when f > 0 then 'Phone' end as field, case when f > 0 then 'n' || f end as new_value, f < 3 as photo from e""")
def outcome_texts(spark, d):  # P47, P54, P63
    e = spark.read.parquet(f"{d}/events.parquet")
    a, u, f = F.col("user_id") % 3, F.col("user_id") % 2, F.col("event_id") % 5
    reason = F.when(f > 0, F.concat(F.lit("Phone: o → n"), f.cast("string"))).otherwise(F.lit("no arrow"))
    bytes_of = F.repeat(F.lit("x"), F.when(f < 3, 10).otherwise(0)).cast("binary")
    parts = D.reason_maps(reason)
    return e.select(F.col("event_id").alias("id"), C.outcome_phrase(added=a, updated=u, errors=f).alias("said"), parts["field"].alias("field"), parts["left"].alias("new_value"), C.photo_accepted(bytes_of, F.lit(200)).alias("photo"))


@query(f"""with c as (select c_custkey as k, case c_custkey % 3 when 0 then 'c1' when 1 then 'c2' else 'c3' end as box from customer) select k, k % 4 in (1, 2) as member from c where box = 'c2'""")
def container_scan(spark, d):  # S07, S08
    """Records of the container that is to be scanned (no mirror, local before others), and whether a selected group holds them."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), F.concat(F.lit("c"), (k % 3 + 1).cast("string")).alias("container_id"))
    boxes = spark.sql("select * from values ('c1', 'Gmail', 'cardDAV'), ('c2', 'On this device', 'local'), ('c3', 'Other', 'other') as t(id, name, type)")
    member = c.select(F.col("k").alias("id"), F.concat(F.lit("g"), (F.col("k") % 4).cast("string")).alias("group"))
    chosen = P.group_members(member, ["g1", "g2", "unknown"]).select(F.col("id").alias("k"), F.lit(True).alias("member"))
    return P.scoped_scan(c, boxes).join(chosen, "k", "left").select("k", F.coalesce("member", F.lit(False)).alias("member"))


@query("with e as (select *, case user_id % 3 when 0 then 'merge' when 1 then 'skip' else 'keepSeparate' end as decision from events) select count(*) as total, count(*) filter (decision = 'merge') as merge, count(*) filter (decision = 'keepSeparate') as keep_separate, count(*) filter (decision = 'skip') as skip, (select string_agg(event_id, ', ' order by event_id) from (select event_id from events where event_type = 'error' order by event_id limit 3)) || ' and ' || (count(*) filter (event_type = 'error') - 3) || ' more' as digest from e")
def store_totals(spark, d):  # A06, T06
    e = spark.read.parquet(f"{d}/events.parquet")
    choice = F.get(F.array(F.lit("merge"), F.lit("skip"), F.lit("keepSeparate")), (F.col("user_id") % 3).cast("int"))
    failed = e.where("event_type = 'error'").select(F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("name"))
    return logs.decision_stats(e.select(choice.alias("decision"))).join(logs.failure_digest(failed))


@query("""with f as (select user_id as id, count(*) as n, max(ts) as t from events where event_type = 'error' group by 1) select id, cast(n as int) as n, row_number() over (order by t desc, id) as place from f order by t desc, id limit 20""")
def failure_list(spark, d):  # T03, S14 last state a key
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").cast("int").alias("n"), F.max("ts").alias("last_failed_at"))
    first = logs.list_failures(e).limit(20)
    return first.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("last_failed_at").cast("timestamp"))).alias("t"), "id", "n"))).alias("x")).select(F.posexplode("x").alias("place", "f")).select("f.id", "f.n", (F.col("place") + 1).cast("long").alias("place"))
