"""URL filters: rules by host and path, and block decisions that spread over redirect-equivalent URLs.

Two URLs are aliases where their canonical forms agree (scheme, fragment, tracking parameters, trailing
slash and .html aside) or where a redirect (meta refresh, or a row of a redirect table) or a
canonical link joins them. Aliases form connected components, found by joins and minima
(``components``). A URL's own rule always decides. Without one, it is blocked if its component holds a
blocked URL and no explicitly allowed one. DataFrame functions only; a page's HTML is read once and
leaves the plan before anything is shuffled.

Edge cases: a null or malformed url has empty host and path, no rule and no aliases, and is allowed; null html has no
links; repeated pages are judged each; rules that tie in length cannot both fit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import pick, read, written
from bookmerge.llm.components import connected_components

# The rules in force.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ATTRIBUTE = r"""(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<verdict, rule> of the longest rule that fits, else null; rules are a short list in the plan."""
    longest_first = sorted(rules, key=lambda r: -len(r[1]))
    table = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"), F.lit(r[: r.index("/")]).alias("host"), F.lit(r[r.index("/") :]).alias("path")) for v, r in longest_first))
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fits, F.lit(0))


def canonical(url: Column) -> Column:
    """The form in which aliases agree; null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike("(?i)^(utm_[^=]*|ref|gclid|fbclid)(=|$)") & (p != ""))), "&")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?i)/index\.html?$", "/"), r"(?i)(\.html?|/+)$", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def linked(url: Column, html: Column) -> Column:
    """array<string>: absolute targets of canonical links and meta refreshes."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    value = lambda tag, name: F.coalesce(*(F.nullif(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*{_ATTRIBUTE}", k), F.lit("")) for k in (1, 2, 3)))
    canon = F.transform(F.filter(tags, lambda x: x.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b""")), lambda x: value(x, "href"))
    moved = F.transform(F.filter(tags, lambda x: x.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")), lambda x: F.regexp_extract(value(x, "content"), r"""(?i)url\s*=\s*['"]?([^'"\s]+)""", 1))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    base = F.concat(scheme, F.lit("://"), host_of(url))
    absolute = lambda x: F.when(x.contains("://"), x).when(x.startswith("//"), F.concat(scheme, F.lit(":"), x)).when(x.startswith("/"), F.concat(base, x)).otherwise(F.concat(base, F.regexp_replace(F.concat(F.lit("/"), path_of(url)), r"^/+|[^/]*$", "/"), x))
    return F.transform(F.filter(F.concat(canon, moved), lambda x: x.isNotNull() & (x != "")), absolute)


def judge(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for pages (page_id, url, html); redirects is (source url, target url)."""
    own = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    targets = F.when(F.col("html").rlike(r"(?i)canonical|refresh"), F.array_distinct(F.transform(linked(F.col("url"), F.col("html")), lambda u: u)))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), own.alias("own"), canonical(F.col("url")).alias("node"), targets.alias("targets"))
    seen = written(seen.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("own"), "node", "targets"), "pages")

    links = seen.where(F.col("node").isNotNull()).select("node", F.explode("targets").alias("url"))
    if redirects is not None:
        pairs = redirects.toDF("source", "url")
        links = links.unionByName(pairs.select(canonical(F.col("source")).alias("node"), "url"))
        sources = pairs.select(F.col("source").alias("url"))
    else:
        sources = links.select("url").limit(0)
    links = written(links.select("node", "url", canonical(F.col("url")).alias("target")).where("node is not null and target is not null"), "links")
    # What rules say of URLs that are linked to or redirect, but are no pages.
    others = links.select("url").unionByName(sources).select(canonical(F.col("url")).alias("node"), F.get(F.array(rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)), F.lit(0))["verdict"].alias("own"))
    said = seen.select("node", "own").unionByName(others).where("node is not null and own is not null")
    flags = said.groupBy("node").agg(F.bool_or(F.col("own") == "block").alias("blocked"), F.bool_or(F.col("own") == "allow").alias("allowed"))

    if links.where("node <> target").limit(1).count():
        members = connected_components(links, "node", "target")
        flags = written(flags, "flags").join(members, "node", "left").withColumn("component", F.coalesce("component", "node"))
        verdicts = written(flags.groupBy("component").agg(F.bool_or("blocked").alias("blocked"), F.bool_or("allowed").alias("allowed")).where("blocked and not allowed").select("component"), "blocked")
        blocked = verdicts.join(members, "component").select("node").union(verdicts.select("component")).distinct()
    else:
        blocked = flags.where("blocked and not allowed").select("node")
    blocked = written(blocked, "blocked-nodes")
    judged = seen.join(blocked.withColumn("hit", F.lit(True)), "node", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(pick(read(spark, sf_dir, "pages"), "page_id", "url", "html"), RULES)


#: Base rules as SQL; on tables without links, aliases are equal canonical forms.
def oracle() -> str:
    tests = " ".join(f"when (host = '{r[: r.index('/')]}' or host like '%.{r[: r.index('/')]}') and starts_with(path, '{r[r.index('/') :]}') then '{r}'" for _, r in sorted(RULES, key=lambda r: -len(r[1])))
    return f"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, coalesce(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '') as query from pages),
r as (select *, case {tests} end as rule from p),
v as (select *, case rule {' '.join(f"when '{r}' then '{v}'" for v, r in RULES)} end as own,
  host || regexp_replace(regexp_replace(path, '(?i)/index\\.html?$', '/'), '(?i)(\\.html?|/+)$', '') || '?' || array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&') as node from r),
c as (select node, bool_or(own = 'block') and not coalesce(bool_or(own = 'allow'), false) as hit from v where host <> '' group by node)
select v.page_id, v.host, v.path, v.rule, coalesce(v.own, case when c.hit then 'block' else 'allow' end) as verdict from v left join c on v.host <> '' and v.node = c.node
"""
