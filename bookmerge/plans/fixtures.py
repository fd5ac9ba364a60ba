"""Contact books derived from the customer table, in Spark and as SQL text for other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.functions.contacts import completed

GIVEN = "robert,bob,william,bill,elizabeth,liz,katherine,kate,john,jon,michael,mike,wei,li,maria,molly,henry,harry,nicholas,nick,albert,bert,jean-luc,david"
FAMILY = "smith,smyth,schmidt,schmitt,li,wei,van der berg,o''brien,mcdonald,macintyre,ng,lee,garcia,müller,jones,johns,brown,chan,cruz,patel"

_PEOPLE = f"""with p as (
select cast(c_custkey as bigint) as k, c_mktsegment as seg,
  split_part('{GIVEN}', ',', cast(floor(c_custkey / 20) as int) % 24 + 1) as g,
  split_part('{GIVEN}', ',', case when (cast(floor(c_custkey / 20) as int) % 24) % 2 = 0 then cast(floor(c_custkey / 20) as int) % 24 + 2 else cast(floor(c_custkey / 20) as int) % 24 end) as g_alt,
  split_part('{FAMILY}', ',', cast(c_custkey % 20 as int) + 1) as f,
  split_part('gmail.com,example.com,acme.test,mail.test', ',', cast(c_custkey % 4 as int) + 1) as dom,
  lpad(cast(c_custkey as varchar(20)), 7, '0') as d7
from customer)"""

BOOK_LEFT = _PEOPLE + """
select concat('people/c', k) as id, g as given_name, cast(null as varchar(20)) as middle_name, f as family_name,
  concat('org ', k % 200, ' Inc.') as organization_name, 'Engineer' as job_title,
  concat(substr(g,1,1), '.', k, '@', dom) as email,
  concat('+1 (555) ', substr(d7,1,3), '-', substr(d7,4,4)) as phone,
  cast(case when k % 5 = 0 then 1990 end as int) as bd_year, cast(k % 12 + 1 as int) as bd_month, cast(k % 28 + 1 as int) as bd_day,
  case when k % 11 = 0 then cast(null as int) else cast(k * 37 % 30 as int) end as mod_day,
  concat(k % 300, ' Main St') as street, 'Springfield' as city, cast(case when k % 13 = 0 then 'Bobby' end as varchar(20)) as nickname,
  concat('https://www.site', k, '.test/') as url, concat('contactGroups/g', k % 4) as grp
from p where k % 10 <> 9
union all
select concat('people/d', k), case when k % 100 = 0 then g else g_alt end, cast(null as varchar(20)), f, concat('org ', k % 200), 'Engineer',
  case when k % 50 = 25 then upper(concat(substr(g,1,1), '.', k, '@', dom)) else concat(substr(g,1,1), '.', k, '+dup@', dom) end,
  case when k % 50 = 0 then concat('+1 555 ', d7) else concat('1555', d7) end, cast(null as int), cast(k % 12 + 1 as int), cast(k % 28 + 1 as int), cast(null as int),
  concat(k % 300, ' main st'), 'springfield', cast(null as varchar(20)), concat('https://www.site', k, '.test/'), concat('contactGroups/g', k % 4)
from p where k % 25 = 0
union all
select concat('people/e', k), g, cast(null as varchar(20)), concat(f, 'e'), concat('ORG ', k % 200), cast(null as varchar(20)),
  cast(null as varchar(40)), cast(null as varchar(40)), cast(null as int), cast(null as int), cast(null as int), cast(null as int),
  concat(k % 300, ' Main St'), 'Springfield', cast(null as varchar(20)), cast(null as varchar(40)), cast(null as varchar(40))
from p where k % 40 = 7"""

BOOK_RIGHT = _PEOPLE + """
select concat('mac/', k) as id,
  case when k % 7 = 2 then g_alt when k % 7 = 4 then upper(g) else g end as given_name,
  case when k % 7 = 5 then 'Q.' else '' end as middle_name,
  case when k % 7 = 6 then concat(f, 'e') else f end as family_name,
  case when k % 7 = 3 then concat('Org ', k % 200) else concat('org ', k % 200, ' Inc.') end as organization_name,
  case when k % 7 = 3 then 'Manager' else 'Engineer' end as job_title,
  case when k % 7 = 4 then upper(concat(substr(g,1,1), '.', k, '@', dom)) when k % 7 = 6 then concat(substr(g,1,1), '.', k, '@other.test') else concat(substr(g,1,1), '.', k, '@', dom) end as email,
  case when k % 7 = 1 then concat('+1555', d7) else concat('+1 (555) ', substr(d7,1,3), '-', substr(d7,4,4)) end as phone,
  cast(case when k % 7 = 5 and k % 5 <> 0 then 1604 when k % 5 = 0 then 1990 end as int) as bd_year, cast(k % 12 + 1 as int) as bd_month, cast(k % 28 + 1 as int) as bd_day,
  case when k % 3 = 0 then cast(null as int) else cast(k * 53 % 30 as int) end as mod_day,
  concat(k % 300, ' MAIN ST') as street, 'Springfield' as city, cast('' as varchar(20)) as nickname,
  case when k % 17 = 0 then concat('http://site', k, '.test/about') else concat('http://site', k, '.test') end as url, concat('group', k % 4) as grp
from p where k % 10 <> 8"""

MAPPING = """select concat('people/c', c_custkey) as google_resource_name, concat('mac/', c_custkey) as mac_contact_identifier, cast(15 as int) as synced_day
from customer where c_custkey % 10 in (0,1,2,3,4,8) or c_custkey % 20 = 9
union all
select concat('people/x', c_custkey), concat('mac/x', c_custkey), cast(15 as int) from customer where c_custkey % 100 = 0"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("''brien", "\\'brien").replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def _day(column: str):
    return F.when(F.col(column).isNotNull(), F.timestamp_micros(F.lit(1704067200000000).cast("long") + F.col(column).cast("long") * 86400000000))


def _book(flat: DataFrame, source: str) -> DataFrame:
    item = lambda c, label: F.when(F.col(c).isNotNull(), F.array(F.struct(F.col(c).alias("value"), F.lit(label).alias("label")))).otherwise(F.array().cast("array<struct<value:string,label:string>>"))
    none = F.lit("")
    own = "google_resource_name" if source == "google" else "mac_contact_identifier"
    df = flat.select(
        F.col("id").alias("contact_id"), F.lit(source).alias("source"), F.col("id").alias(own), "given_name", "middle_name", "family_name", "nickname", "job_title", F.col("organization_name").alias("organization"),
        item("email", "work").alias("emails"), item("phone", "mobile").alias("phones"), item("url", "home").alias("urls"),
        F.array(F.struct(F.col("street").alias("street"), F.col("city").alias("city"), none.alias("state"), none.alias("postal_code"), none.alias("country"), F.lit(None).cast("string").alias("country_code"), F.lit("home").alias("label"))).alias("addresses"),
        F.struct(F.col("bd_year").alias("year"), F.col("bd_month").alias("month"), F.col("bd_day").alias("day")).alias("birthday"), _day("mod_day").alias("last_modified"), F.col("grp").alias("group"),
    )
    return completed(df)


def left_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left book as contacts, with its group."""
    return _book(_sql(spark, sf_dir, BOOK_LEFT), "google")


def right_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(_sql(spark, sf_dir, BOOK_RIGHT), "mac")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, MAPPING).select("google_resource_name", "mac_contact_identifier", _day("synced_day").alias("last_synced_at"), F.lit(None).cast("string").alias("google_etag"))


def sync_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an audit log."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    action = F.element_at(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv)), F.col("event_type"))
    details = F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" ["), F.col("event_type"), F.lit("] session="), (F.col("event_id") % 50).cast("string"))
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("source"), action.alias("action"), details.alias("details"), "user_id")


ACTIONS = {"error": "change.failed", "purchase": "change.update", "signup": "change.add", "click": "sync.start", "view": "fetch.page"}

SYNC_EVENTS = f"""select event_id as id, ts as timestamp, event_type as source, case event_type {" ".join(f"when '{k}' then '{v}'" for k, v in ACTIONS.items())} end as action,
  concat('User ', user_id, ' [', event_type, '] session=', event_id % 50) as details, user_id from events"""
