"""Registered queries: each applies operators to the given tables and returns flat columns; SQL twins check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.functions import names as M
from bookmerge.functions import normalize as N
from bookmerge.operators import apply as A
from bookmerge.operators import diff as D
from bookmerge.operators import graph, logs, matching, merge, versions
from bookmerge.plans import fixtures as X
from bookmerge.plans import sqltext as T
from bookmerge.schemas import PEOPLE_PAGE, Settings
from bookmerge.sources import people as P
from bookmerge.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SYNC = Settings(sync_deleted=True)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _joined(df: DataFrame) -> DataFrame:
    """Plan rows with their changes as one text."""
    return df.select(*(F.array_join("changes", "; ").alias("changes") if c == "changes" else c for c in D.PLAN))


@query(f"with {T.BOOKS} select id, display, f as full_name, e as email, p as phone, o as organization, a as address, u as url, b as birthday from l")
def normalize_fields(spark, d):
    n = C.normalized(C.HERE)
    one = lambda v: F.coalesce(F.get(v, F.lit(0)), F.lit(""))
    return X.left_book(spark, d).select(F.col("contact_id").alias("id"), C.display_name(C.HERE).alias("display"), n["full_name"].alias("full_name"), one(n["emails"]).alias("email"), one(n["phones"]).alias("phone"), n["organization"].alias("organization"), n["address"].alias("address"), N.normalize_url(one(C.values(F.col("urls")))).alias("url"), N.birthday_key(F.col("birthday")).alias("birthday"))


@query(f"with {T.BOOKS} select id, {T.soundex('family_name')} as code from l")
def soundex_variant(spark, d):
    return X.left_book(spark, d).select(F.col("contact_id").alias("id"), M.soundex_variant(F.col("family_name")).alias("code"))


@query(f"with {T.BOOKS} select id, {T.title('given_name')} as given, {T.title('family_name')} as family, upper(family_name) as caps from l")
def title_case(spark, d):
    styled = lambda c, how: M.format_name(F.col(c), how)
    return X.left_book(spark, d).select(F.col("contact_id").alias("id"), styled("given_name", "titleCase").alias("given"), styled("family_name", "titleCase").alias("family"), styled("family_name", "upperCase").alias("caps"))


@query(f"with {T.BOOKS} select id, ni as family from l union all select id, ni from r")
def nickname_group(spark, d):
    both = X.left_book(spark, d).select("contact_id", "given_name").unionByName(X.right_book(spark, d).select("contact_id", "given_name"))
    return M.with_nickname_group(both, F.col("given_name"), "family").select(F.col("contact_id").alias("id"), "family")


@query(f"with {T.BOOKS}, k as (select unnest(list_filter([case when e <> '' then 'e:' || e end, case when length(d) >= 7 then 'p:' || right(d, 7) end, case when n <> '' then 'f:' || n[1] end, case when g <> '' then 'g:' || g[1] end], lambda q: q is not null)) as key from l) select key, count(*) as n from k group by key")
def blocking_key_stats(spark, d):
    return X.left_book(spark, d).select(F.explode(C.blocking_keys(C.HERE)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


_PARTS = ["email", "phone", "exact_name", "similar_name", "organization", "address", "domain_mismatch", "different_info"]


def _compared(c: Column) -> Column:
    """The fields of a contact that conflicts are told from."""
    return F.struct(F.struct(*(c[f].alias(f) for f in ("given_name", "family_name", "organization", "emails", "phones"))).alias("c"))


def _scores(df: DataFrame) -> DataFrame:
    return df.select("id_a", "id_b", *(F.col(f"parts.{p}").alias(p) for p in _PARTS), "score", F.col("effective").cast("int").alias("effective"))


_PAIR_SQL = f"select id_a, id_b, {', '.join(_PARTS)}, score, cast(effective as int) as effective from k"


@query(f"with {T.WITHIN} {_PAIR_SQL}")
def dedup_within(spark, d):
    return _scores(matching.detect_within(X.left_book(spark, d), carry=matching.bare_ids))


@query(f"with {T.ACROSS} {_PAIR_SQL}")
def dedup_across(spark, d):
    return _scores(matching.detect_across(X.left_book(spark, d), X.right_book(spark, d), X.mapping(spark, d), carry=matching.bare_ids))


@query(f"with {T.WITHIN} select id_a, id_b, cast(delta as int) as delta, reasoning, cast(effective as int) as effective, case when effective >= 80 then 'merge' else 'skip' end as action from k")
def dedup_nlp(spark, d):
    df = matching.detect_within(X.left_book(spark, d), carry=matching.bare_ids)
    return df.select("id_a", "id_b", matching.signal_delta(F.col("signals")).cast("int").alias("delta"), F.col("verdict.reasoning").alias("reasoning"), F.col("effective").cast("int").alias("effective"), F.col("verdict.action").alias("action"))


@query(f"with {T.WITHIN} select id_a, id_b, cast(effective >= 80 as int) as auto, cast(effective between 50 and 79 as int) as prompt, 1 as needs_confirmation, cast(score >= 80 and lx.given_name = ly.given_name and lx.family_name = ly.family_name and lx.organization_name = ly.organization_name as int) as safe from k join l lx on lx.id = id_a join l ly on ly.id = id_b")
def dedup_route(spark, d):
    df = matching.detect_within(X.left_book(spark, d), carry=_compared).withColumn("route", matching.routing(F.col("effective"), F.lit(None).cast("string")))
    safe = matching.safe_to_merge(F.col("score"), matching.merge_conflicts(F.col("a.c"), F.col("b.c")))
    return df.select("id_a", "id_b", *(F.col(f"route.{c}").cast("int").alias(c) for c in ("auto", "prompt", "needs_confirmation")), safe.cast("int").alias("safe"))


@query(f"with {T.WITHIN} select id_a, id_b, cast(lx.given_name <> ly.given_name as int) as given, cast(lx.family_name <> ly.family_name as int) as family, cast(lx.organization_name <> ly.organization_name as int) as organization, cast(lx.email is not null as int) + cast(ly.email is not null as int) as emails, cast(lx.phone is not null as int) + cast(ly.phone is not null as int) as phones from k join l lx on lx.id = id_a join l ly on ly.id = id_b")
def merge_preview(spark, d):
    df = matching.detect_within(X.left_book(spark, d), carry=_compared).withColumn("m", matching.merge_conflicts(F.col("a.c"), F.col("b.c")))
    return df.select("id_a", "id_b", *(F.col(f"m.{c}").cast("int").alias(c) for c in ("given", "family", "organization", "emails", "phones")))


_PATTERN = f"select *, concat('type:withinGoogle|score:', cast(floor(effective / 10) * 10 as int), '|reason:', coalesce({T.REASONS}[1], 'Similar contacts'), '|count:2') as pattern from k"
_CHOICES = ["merge", "keepSeparate", "skip"]


@query(f"with {T.WITHIN}, q as ({_PATTERN}), c as (select pattern, ['merge', 'keepSeparate', 'skip'][1 + length(pattern) % 3] as decision from q where length(pattern) % 2 = 0 group by pattern) select id_a, id_b, q.pattern, decision from q left join c using (pattern)")
def pattern_decisions(spark, d):
    df = matching.detect_within(X.left_book(spark, d), carry=matching.bare_ids)
    df = graph.durable(df.select("id_a", "id_b", matching.pattern_text(F.col("type"), F.col("effective"), matching.primary_reason(F.col("parts"))).alias("pattern")))
    kept = df.where(F.length("pattern") % 2 == 0).select("pattern", F.get(F.array(*map(F.lit, _CHOICES)), F.length("pattern") % 3).alias("decision"), F.lit(0).alias("created_at")).distinct()
    return matching.apply_patterns(df, kept).select("id_a", "id_b", "pattern", "decision")


@query(f"with {T.WITHIN} select id_a, id_b from k where length(id_a) % 2 = 1")
def pair_suppression(spark, d):
    df = graph.durable(matching.detect_within(X.left_book(spark, d), carry=matching.bare_ids).select("id_a", "id_b"))
    kept = df.where(F.length("id_a") % 2 == 0).select(N.pair_key(F.col("id_a"), F.col("id_b")).alias("pair_key"))
    return matching.suppress_pairs(df, kept).select("id_a", "id_b")


@query(f"with recursive {T.WITHIN}, e as (select id_a as x, id_b as y from k union all select id_b, id_a from k), reach as (select distinct x as id, x as other from e union select reach.id, e.y from reach join e on e.x = reach.other) select id, min(other) as cluster from reach group by id")
def clusters(spark, d):
    return matching.duplicate_clusters(X.left_book(spark, d))


_MAPPED = f"{T.BOOKS}, j as materialized (select x.id as left_id, y.id as right_id, {T.diff()} as ch from mp join l x on x.id = google_resource_name join r y on y.id = mac_contact_identifier)"


@query(f"with {_MAPPED} select left_id, right_id, array_to_string(ch, '; ') as changes from j")
def diff_fields(spark, d):
    rows = D.classify_mappings(X.mapping(spark, d), X.left_book(spark, d), X.right_book(spark, d)).where("a is not null and b is not null")
    return rows.select(F.col("a.contact_id").alias("left_id"), F.col("b.contact_id").alias("right_id"), F.array_join(D.diff_fields(F.col("a"), F.col("b")), "; ").alias("changes"))


@query(f"with recursive {T.TWO_WAY} select {T.PLAN_OUT} from plan2")
def diff_two_way(spark, d):
    return _joined(D.diff_two_way(X.left_book(spark, d), X.right_book(spark, d), X.mapping(spark, d), SYNC)[0])


@query(f"with {T.BOOKS} select google_resource_name from mp where google_resource_name not in (select id from l) and mac_contact_identifier not in (select id from r)")
def dead_mappings(spark, d):
    return D.diff_two_way(X.left_book(spark, d), X.right_book(spark, d), X.mapping(spark, d), SYNC)[1]


_ONE_WAY = f"{T.BOOKS}, j as materialized (select x.id as left_id, y.id as right_id, x.display as name, mac_contact_identifier as target, {T.diff()} as ch from l x left join (select google_resource_name, max(mac_contact_identifier) as mac_contact_identifier from mp group by 1) q on x.id = google_resource_name left join r y on y.id = mac_contact_identifier)"


@query(f"with {_ONE_WAY} select name, case when right_id is null then 'add' else 'update' end as action, 'googleToMac' as direction, case when target is null then 'New contact' when right_id is null then 'Deleted on target — re-creating from source' else array_to_string(ch, '; ') end as changes, cast(null as varchar) as user_override, 'google' as source, left_id, right_id from j where right_id is null or len(ch) > 0")
def diff_one_way(spark, d):
    return _joined(D.diff_one_way(X.left_book(spark, d), X.right_book(spark, d), X.mapping(spark, d))[0])


def _conflict_sql() -> str:
    rows = []
    for pref, both in (("alwaysAsk", "⚠️ Conflict: both sides changed since last sync"), ("preferGoogle", "Auto-resolved: Google preferred"), ("preferMac", "Auto-resolved: Mac preferred"), ("mergeBoth", "Auto-resolved: merged both sides")):
        act, way = {"alwaysAsk": ("merge", "twoWay"), "preferGoogle": ("update", "googleToMac"), "preferMac": ("update", "macToGoogle"), "mergeBoth": ("merge", "twoWay")}[pref]
        unknown = "list_append(ch, 'Differs, but neither side reports when it changed')" if pref == "alwaysAsk" else "ch"
        rows.append(f"select '{pref}' as preference, left_id, right_id, case when cx = cy then '{act}' else 'update' end as action, case when cx = cy then '{way}' when cx then 'googleToMac' else 'macToGoogle' end as direction, array_to_string(case when cx and cy then list_append(ch, '{both}') when cx or cy then ch else {unknown} end, '; ') as changes, case when cx = cy and '{pref}' = 'mergeBoth' then 'merge' end as user_override from m")
    return f"with {T.BOOKS}, m as (select x.id as left_id, y.id as right_id, {T.diff()} as ch, coalesce(x.mod_day > synced_day, false) as cx, coalesce(y.mod_day > synced_day, false) as cy from mp join l x on x.id = google_resource_name join r y on y.id = mac_contact_identifier where len({T.diff()}) > 0) " + " union all ".join(rows)


@query(_conflict_sql())
def conflict_matrix(spark, d):
    rows = D.classify_mappings(X.mapping(spark, d), X.left_book(spark, d), X.right_book(spark, d)).where("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    rows = rows.select(a["contact_id"].alias("left_id"), b["contact_id"].alias("right_id"), "last_synced_at", *D.conflict_inputs(a, b), D.diff_fields(a, b).alias("diff")).where(F.size("diff") > 0)
    prefs = ["alwaysAsk", "preferGoogle", "preferMac", "mergeBoth"]
    settled = F.array(*(F.struct(F.lit(p).alias("preference"), D.resolve(F.col("diff"), F.col("last_synced_at"), p).alias("c")) for p in prefs))
    out = rows.select("left_id", "right_id", F.explode(settled).alias("s"))
    return out.select("s.preference", "left_id", "right_id", "s.c.action", "s.c.direction", F.array_join("s.c.changes", "; ").alias("changes"), "s.c.user_override")


@query(f"with {T.BOOKS} select grp as \"group\", count(*) as n from l where grp in ('contactGroups/g0', 'contactGroups/g2') group by grp")
def group_filter(spark, d):
    book = X.left_book(spark, d)
    member = book.select(F.col("contact_id").alias("id"), "group")
    return D.filter_groups(book, member, ["contactGroups/g0", "contactGroups/g2"]).groupBy("group").agg(F.count("*").alias("n"))


_FILTERED = f"{T.BOOKS}, fl as (select * from l where grp in ('contactGroups/g0', 'contactGroups/g2'))"


@query(f"with {_FILTERED} select google_resource_name, mac_contact_identifier, cast(x.id is null and google_resource_name in (select id from l) as int) as outside from mp left join fl x on x.id = google_resource_name")
def filter_guard(spark, d):
    book = X.left_book(spark, d)
    member = book.select(F.col("contact_id").alias("id"), "group")
    kept = D.filter_groups(book, member, ["contactGroups/g0", "contactGroups/g2"])
    rows = D.with_outside_filter(D.classify_mappings(X.mapping(spark, d), kept, X.right_book(spark, d)), book.select("contact_id"), "google_resource_name", "o")
    return rows.select("google_resource_name", "mac_contact_identifier", (F.col("a").isNull() & F.col("o")).cast("int").alias("outside"))


def _plan(spark, d) -> DataFrame:
    return graph.durable(D.diff_two_way(X.left_book(spark, d), X.right_book(spark, d), X.mapping(spark, d), SYNC)[0])


@query(f"with recursive {T.TWO_WAY} select coalesce(user_override, action) as action, count(*) as n from plan2 group by 1")
def plan_counters(spark, d):
    return D.plan_counters(_plan(spark, d))


@query(f"with recursive {T.TWO_WAY} select split_part(c, ':', 1) as reason, count(*) as n from (select unnest(changes) as c from plan2) group by 1 order by n desc, reason limit 8")
def reason_histogram(spark, d):
    return D.reason_histogram(_plan(spark, d))


@query(f"with recursive {T.TWO_WAY} select string_agg(n || ' × ' || reason, ', ' order by n desc, reason) as summary from (select split_part(changes[1], ':', 1) as reason, count(*) as n from plan2 where coalesce(user_override, action) <> 'delete' and not (action = 'merge' and user_override is null) group by 1 order by n desc, reason limit 3)")
def routine_summary(spark, d):
    return D.routine_summary(_plan(spark, d))


@query(f"with recursive {T.TWO_WAY} select count(*) as \"all\", count(*) filter (a = 'add') as \"add\", count(*) filter (a = 'update') as \"update\", count(*) filter (a = 'delete') as \"delete\", count(*) filter (a = 'merge') as conflict from (select coalesce(user_override, action) as a from plan2)")
def filter_counts(spark, d):
    return D.filter_counts(_plan(spark, d))


def _merged(spark, d, how) -> DataFrame:
    rows = D.classify_mappings(X.mapping(spark, d), X.left_book(spark, d), X.right_book(spark, d)).where("a is not null and b is not null")
    m = rows.select(how(F.col("a"), F.col("b")).alias("m"))
    join = lambda f: F.array_join(C.values(F.col(f"m.{f}")), ";").alias(f)
    return m.select("m.contact_id", "m.given_name", "m.middle_name", "m.family_name", "m.organization", "m.job_title", "m.nickname", join("phones"), join("emails"), join("urls"), F.size("m.addresses").alias("addresses"))


def _merge_sql(kind: str) -> str:
    """Merged mapped pairs; kind is simple, dedup or sync."""
    cols = [("given_name", "given_name"), ("middle_name", "middle_name"), ("family_name", "family_name"), ("organization_name", "organization"), ("job_title", "job_title"), ("nickname", "nickname")]
    filled = "case when x.{c} is not null and x.{c} <> '' then x.{c} else y.{c} end"
    plain = "coalesce(x.{c}, y.{c})"
    rule = {"sync": lambda c: filled, "simple": lambda c: plain, "dedup": lambda c: plain if c == "nickname" else filled}[kind]
    texts = ", ".join(f"{rule(c).format(c=c)} as {n}" for c, n in cols)
    if kind == "simple":
        many = ", ".join(f"array_to_string(list_sort(list_distinct([{{'value': x.{c}, 'label': '{lab}'}}, {{'value': y.{c}, 'label': '{lab}'}}])).list_transform(lambda q: q.value), ';') as {n}" for c, n, lab in (("phone", "phones", "mobile"), ("email", "emails", "work"), ("url", "urls", "home")))
        addr = "case when x.street = y.street and x.city = y.city then 1 else 2 end as addresses"
    else:
        key = {"phone": lambda t: T.digits(f"{t}.phone"), "email": lambda t: f"lower({t}.email)", "url": (lambda t: f"{t}.url") if kind == "dedup" else (lambda t: f"lower({t}.url)")}
        many = ", ".join(f"case when {key[c]('x')} = {key[c]('y')} then x.{c} else x.{c} || ';' || y.{c} end as {n}" for c, n in (("phone", "phones"), ("email", "emails"), ("url", "urls")))
        addr = "case when x.a = y.a then 1 else 2 end as addresses"
    return f"with {T.BOOKS} select x.id as contact_id, {texts}, {many}, {addr} from mp join l x on x.id = google_resource_name join r y on y.id = mac_contact_identifier"


@query(_merge_sql("simple"))
def merge_simple(spark, d):
    return _merged(spark, d, merge.merge_simple)


@query(_merge_sql("dedup"))
def merge_dedup(spark, d):
    return _merged(spark, d, merge.merge_dedup)


@query(_merge_sql("sync"))
def merge_sync(spark, d):
    return _merged(spark, d, merge.merge_sync)


def _ledger(spark, d) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.where("c_custkey % 30 = 0").select(F.concat(F.lit("mac:mac/"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_custkey") % 4).cast("int").alias("failure_count"), (F.col("c_custkey") % 60 == 0).alias("ignored"))


_OUTCOME = """led as (select 'mac:mac/' || c_custkey as id from customer where c_custkey % 30 = 0 and (c_custkey % 4 >= 3 or c_custkey % 60 = 0)),
done as materialized (select *, case when coalesce('mac:' || right_id, 'google:' || left_id) in (select id from led) then 'set_aside' when coalesce(user_override, action) = 'delete' then 'deferred_deletion' when action = 'merge' and user_override is null then 'deferred_merge'
  else case coalesce(user_override, action) when 'add' then 'added' when 'update' then 'updated' when 'merge' then 'merged' else 'skipped' end end as outcome from plan2)"""


@query(f"with recursive {T.TWO_WAY}, {_OUTCOME} select count(*) filter (outcome = 'added') as added, count(*) filter (outcome = 'updated') as updated, count(*) filter (outcome = 'deleted') as deleted, count(*) filter (outcome = 'merged') as merged, count(*) filter (outcome in ('skipped', 'set_aside', 'deferred_deletion', 'deferred_merge')) as skipped, count(*) filter (outcome = 'error') as errors, count(*) filter (outcome = 'deferred_deletion') as deferred_deletions, count(*) filter (outcome = 'deferred_merge') as deferred_merges, count(*) filter (outcome = 'set_aside') as set_aside from done")
def apply_result(spark, d):
    return A.tally(A.with_outcomes(_plan(spark, d), _ledger(spark, d), SYNC))


_WRITE_LEFT = "case when source = 'google' and left_id is not null then false else true end"


_RECORD = ["given_name", "middle_name", "family_name", "organization", "job_title", "nickname", "phones", "emails", "urls"]


def _plain_record(t: str) -> str:
    return f"{t}.given_name, {t}.middle_name, {t}.family_name, {t}.organization_name as organization, {t}.job_title, {t}.nickname, coalesce({t}.phone, '') as phones, coalesce({t}.email, '') as emails, coalesce({t}.url, '') as urls"


def _joined_lists() -> str:
    """Phones, emails and urls of x, then those of y that x has not."""
    rest = lambda c, x, y: f"concat_ws(';', x.{c}, case when x.{c} is null or {x} <> {y} then y.{c} end)"
    return f"{rest('phone', T.digits('x.phone'), T.digits('y.phone'))} as phones, {rest('email', 'lower(x.email)', 'lower(y.email)')} as emails, {rest('url', 'lower(x.url)', 'lower(y.url)')} as urls"


_FILLED = ", ".join(f"case when x.{c} is not null and x.{c} <> '' then x.{c} else y.{c} end as {n}" for c, n in (("given_name", "given_name"), ("middle_name", "middle_name"), ("family_name", "family_name"), ("organization_name", "organization"), ("job_title", "job_title"), ("nickname", "nickname")))
_NEW_ID = "substr(sha256({}), 1, 16)"


@query(f"""with recursive {T.TWO_WAY}, {_OUTCOME}, ok as (select *, coalesce(user_override, action) as act, {_WRITE_LEFT} as to_left from done where outcome in ('added', 'updated', 'merged')),
made as (select 'mac' as side, coalesce(ok.right_id, 'mac/new-' || {_NEW_ID.format('ok.left_id')}) as id, {_plain_record('x')} from ok join l x on x.id = ok.left_id where not to_left and act <> 'merge'
  union all select 'google', coalesce(ok.left_id, 'people/new-' || {_NEW_ID.format('ok.right_id')}), {_plain_record('y')} from ok join r y on y.id = ok.right_id where to_left and act <> 'merge'
  union all select side, case side when 'google' then x.id else y.id end, {_FILLED}, {_joined_lists()} from ok join l x on x.id = ok.left_id join r y on y.id = ok.right_id cross join (select unnest(['google', 'mac']) as side) where act = 'merge')
select * from made union all select 'google', x.id, {_plain_record('x')} from l x where id not in (select id from made where side = 'google') union all select 'mac', y.id, {_plain_record('y')} from r y where id not in (select id from made where side = 'mac')""")
def apply_books(spark, d):
    """Every record of both books after the plan."""
    out = A.with_outcomes(_plan(spark, d), _ledger(spark, d), SYNC)
    left, right = A.apply_books(out, X.left_book(spark, d), X.right_book(spark, d), settings=SYNC)
    told = lambda book, side: book.select(F.lit(side).alias("side"), F.col("contact_id").alias("id"), *(F.array_join(C.values(F.col(f)), ";").alias(f) if f in ("phones", "emails", "urls") else F.col(f) for f in _RECORD))
    return told(left, "google").unionByName(told(right, "mac"))


@query(f"""with recursive {T.TWO_WAY}, {_OUTCOME}, half as (select * from done where coalesce(user_override, action) in ('add', 'update') and not ({_WRITE_LEFT})),
sent as (select left_id, right_id from done where outcome in ('added', 'updated') and {_WRITE_LEFT} and left_id is not null and right_id is not null)
select left_id as google_resource_name, right_id as mac_contact_identifier, case when left_id in (select left_id from half where left_id is not null) or right_id in (select right_id from half where right_id is not null) then coalesce('2024-01-16', '0001-01-01') else '2024-03-01' end as stamp from sent""")
def mapping_stamps(spark, d):
    out = A.with_outcomes(_plan(spark, d), _ledger(spark, d), SYNC)
    stamps = A.mapping_stamps(out, X.mapping(spark, d), F.lit("2024-03-01").cast("timestamp"))
    return stamps.select("google_resource_name", "mac_contact_identifier", F.date_format("last_synced_at", "yyyy-MM-dd").alias("stamp"))


@query("""with c as (select case when c_custkey % 3 = 0 then 'create' when c_custkey % 3 = 1 then 'update' else 'delete' end as kind, lpad(cast(c_custkey as varchar), 9, '0') as id, case when c_custkey % 5 <> 0 then 'e' || c_custkey end as etag from customer),
b as (select *, floor((row_number() over (partition by kind order by id) - 1) / case kind when 'delete' then 500 else 200 end) as chunk from c where not (kind = 'update' and etag is null))
select kind, cast(chunk as int) as chunk, 0 as single, count(*) as n, min(id) as first_id from b group by 1, 2 union all select kind, cast(null as int), 1, count(*), min(id) from c where kind = 'update' and etag is null group by kind""")
def write_batches(spark, d):
    k = F.col("c_custkey")
    ids = F.lpad(k.cast("string"), 9, "0").alias("id")
    c = spark.read.parquet(f"{d}/customer.parquet")
    changes = c.select(F.when(k % 3 == 0, "create").when(k % 3 == 1, "update").otherwise("delete").alias("kind"), ids)
    etags = c.where(k % 5 != 0).select(ids, F.concat(F.lit("e"), k.cast("string")).alias("etag"))
    return A.plan_batches(changes, etags).groupBy("kind", "chunk", F.col("single").cast("int").alias("single")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_NAME = "concat('Customer ', o_custkey, ' ', o_orderpriority)"
_ORDERS = f"o as (select cast(o_custkey as varchar) as contact_identifier, o_orderdate as ts, o_orderkey % 40 as session, o_orderkey, {_NAME} as name, o_orderstatus as status, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version_number from orders)"


def _versions(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select(F.col("o_custkey").cast("string").alias("contact_identifier"), F.col("o_orderdate").alias("timestamp"), (F.col("o_orderkey") % 40).alias("session"), "o_orderkey", F.expr(_NAME).alias("name"), F.col("o_orderstatus").alias("status"))
    return versions.number_versions(rows, order=["timestamp", "o_orderkey"])


@query(f"with {_ORDERS} select o_orderkey, contact_identifier, cast(version_number as int) as version_number from o")
def version_numbers(spark, d):
    return _versions(spark, d).select("o_orderkey", "contact_identifier", "version_number")


@query(f"with {_ORDERS} select contact_identifier, arg_max(name, (ts, version_number)) as name, count(*) as versions, cast(max(ts) as varchar) as latest from o group by 1")
def version_rollup(spark, d):
    return versions.versioned_contacts(_versions(spark, d)).withColumn("latest", F.col("latest").cast("string"))


@query(f"""with {_ORDERS}, q as (select *, lag(name) over w as old_name, lag(status) over w as old_status, lag(o_orderkey) over w as prev from o window w as (partition by contact_identifier order by version_number))
select contact_identifier, cast(version_number as int) as version_number, 'Display Name' as field, old_name as old_value, name as new_value from q where prev is not null and old_name <> name
union all select contact_identifier, cast(version_number as int), 'Organization', old_status, status from q where prev is not null and old_status <> status
union all select contact_identifier, cast(version_number as int), 'Phone Numbers', cast(prev % 3 as varchar), cast(o_orderkey % 3 as varchar) from q where prev is not null and prev % 3 <> o_orderkey % 3""")
def version_diff(spark, d):
    v = _versions(spark, d)
    phones = F.transform(F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (F.col("o_orderkey") % 3).cast("int"))), lambda i: i.cast("string"))
    return versions.version_diffs(v.withColumns({"display_name": F.col("name"), "phones": phones, "emails": F.array().cast("array<string>"), "organization": F.col("status")}))


def _snapshot(spark, d) -> DataFrame:
    """Both books as they were in one session: without the records whose last digit is 3."""
    left, right = X.left_book(spark, d), X.right_book(spark, d)
    old = lambda df: df.where(~F.col("contact_id").endswith("3")).withColumn("job_title", F.lit("Intern"))
    return versions.snapshot_rows(old(left), old(right), "s1", F.lit("2024-01-01").cast("timestamp"))


def _live(spark, d) -> tuple[DataFrame, DataFrame]:
    now = lambda df: df.where(~F.col("contact_id").endswith("4"))
    return now(X.left_book(spark, d)), now(X.right_book(spark, d))


def _rolled(spark, d, extras) -> DataFrame:
    left, right, _ = versions.rollback(_snapshot(spark, d), "s1", *_live(spark, d), extras=extras)
    both = left.select("source", "contact_id", "job_title").unionByName(right.select("source", "contact_id", "job_title"))
    return both.groupBy("source", "job_title").agg(F.count("*").alias("n"), F.min("contact_id").alias("first_id"))


_BOTH_BOOKS = "both_books as (select 'google' as source, id, job_title from l union all select 'mac', id, job_title from r)"


@query(f"with {T.BOOKS}, {_BOTH_BOOKS} select source, case when id like '%3' then job_title else 'Intern' end as job_title, count(*) as n, min(id) as first_id from both_books group by 1, 2")
def rollback_keep(spark, d):
    return _rolled(spark, d, "keep")


@query(f"with {T.BOOKS}, {_BOTH_BOOKS} select source, 'Intern' as job_title, count(*) as n, min(id) as first_id from both_books where id not like '%3' group by 1")
def rollback_remove(spark, d):
    return _rolled(spark, d, "remove")


@query(f"with e as ({X.SYNC_EVENTS}) select id, action from e where timestamp >= (select max(timestamp) - interval 3 day from e) order by timestamp desc, id desc limit 1000")
def retention_log(spark, d):
    e = X.sync_events(spark, d)
    now = e.agg(F.max("timestamp").alias("now"))
    kept = e.crossJoin(F.broadcast(now)).where(F.col("timestamp") >= F.col("now") - F.make_dt_interval(F.lit(3))).drop("now")  # one row
    return logs.prune_events(kept, 0, 1000, F.lit(None)).select("id", "action")


@query("with s as (select o_orderkey % 40 as id, max(o_orderdate) as ts, count(*) as n from orders group by 1) select id, n from s order by ts desc, id desc limit 30")
def retention_sessions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    s = o.groupBy((F.col("o_orderkey") % 40).alias("id")).agg(F.max("o_orderdate").alias("timestamp"), F.count("*").alias("n"))
    return versions.retain_sessions(s, 30).select("id", "n")


def _attempts(spark, d) -> DataFrame:
    e = X.sync_events(spark, d)
    return e.select(F.concat(F.lit("mac:"), F.col("user_id").cast("string")).alias("key"), (F.col("source") == "error").alias("failed"), "timestamp", F.col("id").alias("seq"), (F.floor(F.col("id") / 500)).cast("long").alias("run"))


@query("with a as (select 'mac:' || user_id as key, event_type = 'error' as failed, ts, event_id from events), q as (select *, count(*) filter (not failed) over (partition by key order by ts, event_id) as island from a), z as (select key, max(island) as island from q group by 1) select z.key, count(*) filter (q.failed) as strikes, cast(count(*) filter (q.failed) >= 3 as int) as skip from z left join q on q.key = z.key and q.island = z.island group by 1")
def strike_ledger(spark, d):
    return logs.strike_counts(_attempts(spark, d), ["timestamp", "seq"]).select("key", "strikes", F.col("skip").cast("int").alias("skip"))


@query("with a as (select event_id as seq, event_id // 500 as run, event_type = 'error' as failed, ts from events), q as (select *, count(*) filter (not failed) over (partition by run order by ts, seq) as s from a), z as (select *, count(*) filter (failed) over (partition by run, s order by ts, seq) as k from q), y as (select *, max(cast(k >= 3 as int)) over (partition by run order by ts, seq rows between unbounded preceding and 1 preceding) as o from z) select seq, run, coalesce(o, 0) as skipped from y")
def circuit_breaker(spark, d):
    return logs.circuit_breaker(_attempts(spark, d), ["timestamp", "seq"]).select("seq", "run", F.col("skipped").cast("int").alias("skipped"))


@query("select cast(cast(ts as date) as varchar) as day, count(*) as n from events group by 1")
def events_by_day(spark, d):
    return logs.events_by_day(X.sync_events(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(f"with e as ({X.SYNC_EVENTS}) select id, action, details from e where action like 'change.%' or action like 'sync.%' order by timestamp desc, id desc limit 8")
def recent_events(spark, d):
    return logs.recent_events(X.sync_events(spark, d)).select("id", "action", "details")


@query(f"with e as ({X.SYNC_EVENTS}) select id, concat('<contact ', length(trim(split_part(details, '[', 1))), ' chars> ', substr(details, strpos(details, '['))) as details from e")
def redacted_log(spark, d):
    return logs.with_display(X.sync_events(spark, d)).select("id", "details")


_GAP = "q as (select *, case when ts <= lag(ts) over w + interval 1 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as no from q)"


@query(f"with {_GAP} select user_id as key, cast(min(ts) as varchar) as start, cast(max(ts) as varchar) as \"end\", count(*) as n from s group by user_id, no")
def coalesce_bursts(spark, d):
    e = X.sync_events(spark, d).withColumn("key", F.col("user_id"))
    return logs.coalesce_bursts(e, "1 hour").select("key", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "n")


@query(f"""with {T.BOOKS} select display as "Name", given_name as "Given Name", family_name as "Family Name", coalesce(email, '') as "Email 1 Value", case when email is null then '' else 'work' end as "Email 1 Type", '' as "Email 2 Value", coalesce(phone, '') as "Phone 1 Value", coalesce(street, '') as "Address 1 Street", coalesce(organization_name, '') as "Organization", coalesce(url, '') as "Website 1",
  concat_ws('-', case when bd_year is not null then lpad(cast(bd_year as varchar), 4, '0') end, lpad(cast(bd_month as varchar), 2, '0'), lpad(cast(bd_day as varchar), 2, '0')) as "Birthday", id as "Google Resource Name" from l""")
def flat_export(spark, d):
    cols = ["Name", "Given Name", "Family Name", "Email 1 Value", "Email 1 Type", "Email 2 Value", "Phone 1 Value", "Address 1 Street", "Organization", "Website 1", "Birthday", "Google Resource Name"]
    return sinks.flat_export_left(X.left_book(spark, d)).select(*cols)


@query(f"with {T.BOOKS} select id, given_name, family_name, organization_name as organization, coalesce(email, '') as email, 'home' as label, grp as \"group\", case when id like '%0' then null else concat('https://photos.test/', id) end as photo_url, '2024-01-30 10:00:00' as update_time from l")
def people_page_parse(spark, d):
    book = X.left_book(spark, d)
    s, text = F.struct, lambda c, n: F.col(c).alias(n)
    email = F.coalesce(C.primary_email(C.HERE), F.lit(""))
    person = s(
        text("contact_id", "resourceName"), s(F.array(s(F.lit("PROFILE").alias("type"), F.lit("2023-01-01T00:00:00Z").alias("updateTime")), s(F.lit("CONTACT").alias("type"), F.lit("2024-01-30T10:00:00.000Z").alias("updateTime"))).alias("sources")).alias("metadata"),
        F.array(s(text("given_name", "givenName"), text("family_name", "familyName"))).alias("names"), F.array(s(text("organization", "name"))).alias("organizations"), F.array(s(email.alias("value"), F.lit("home").alias("type"))).alias("emailAddresses"),
        F.array(s(F.concat(F.lit("https://photos.test/"), "contact_id").alias("url"), s(F.col("contact_id").endswith("0").alias("default")).alias("metadata"))).alias("photos"),
        F.array(s(s(text("group", "contactGroupResourceName")).alias("contactGroupMembership"))).alias("memberships"),
    )
    pages = book.select(F.to_json(s(F.array(person).alias("connections"))).alias("page")).select(F.from_json("page", PEOPLE_PAGE).alias("p")).select("p.*")
    rows = P.people(pages)
    out = P.to_unified_google(rows).join(rows.select(F.col("resource_name").alias("contact_id"), F.get("group_resource_names", F.lit(0)).alias("group"), F.date_format("update_time", "yyyy-MM-dd HH:mm:ss").alias("update_time")), "contact_id")
    return out.select(F.col("contact_id").alias("id"), "given_name", "family_name", "organization", F.get("emails", F.lit(0))["value"].alias("email"), F.get("emails", F.lit(0))["label"].alias("label"), "group", "photo_url", "update_time")


@query(SQL["coalesce_bursts"])
def stream_bursts(spark, d):
    from bookmerge.streaming import runs

    return runs.bursts(spark, d)


@query(SQL["strike_ledger"])
def stream_strikes(spark, d):
    from bookmerge.streaming import runs

    return runs.strikes(spark, d)
