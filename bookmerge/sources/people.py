"""Sources: people pages, containers and groups, and the two mappings into the unified contact schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.functions import normalize as N
from bookmerge.schemas import ADDRESS, ITEM, PEOPLE_PAGE


def contact_update_time(sources: Column) -> Column:  # S02
    """Of the CONTACT source, else of the first; anything that is no ISO time is null."""
    own = F.get(F.filter(sources, lambda s: s["type"] == "CONTACT"), F.lit(0))
    return F.try_to_timestamp(F.coalesce(own, F.get(sources, F.lit(0)))["updateTime"])


def usable_photo_url(photos: Column) -> Column:  # S03
    return F.get(F.filter(photos, lambda p: ~F.coalesce(p["metadata"]["default"], F.lit(False))), F.lit(0))["url"]


def memberships(person: Column) -> Column:  # S04
    return F.filter(F.transform(person["memberships"], lambda m: m["contactGroupMembership"]["contactGroupResourceName"]), lambda g: g.isNotNull())


def people(pages: DataFrame) -> DataFrame:  # S01
    """A row for each person with a resource name; first names, nickname, organisation, birthday, note; all of the rest."""
    df = pages.select(F.explode("connections").alias("p")).where("p.resourceName is not null")
    first = lambda f: F.get(F.col(f"p.{f}"), F.lit(0))
    name, org = first("names"), first("organizations")
    return df.select(
        F.col("p.resourceName").alias("resource_name"), F.col("p.etag").alias("etag"),
        name["givenName"].alias("given_name"), name["middleName"].alias("middle_name"), name["familyName"].alias("family_name"), name["honorificPrefix"].alias("name_prefix"), name["honorificSuffix"].alias("name_suffix"),
        name["phoneticGivenName"].alias("phonetic_given_name"), name["phoneticMiddleName"].alias("phonetic_middle_name"), name["phoneticFamilyName"].alias("phonetic_family_name"),
        first("nicknames")["value"].alias("nickname"), org["name"].alias("organization"), org["title"].alias("job_title"), org["department"].alias("department"),
        F.col("p.phoneNumbers").alias("phones"), F.col("p.emailAddresses").alias("emails"), F.col("p.addresses").alias("addresses"), F.col("p.urls").alias("urls"),
        first("birthdays")["date"].alias("birthday"), first("biographies")["value"].alias("note"), usable_photo_url(F.col("p.photos")).alias("photo_url"),
        memberships(F.col("p")).alias("group_resource_names"), contact_update_time(F.col("p.metadata.sources")).alias("update_time"),
    )


def read_people_pages(spark: SparkSession, path: str) -> DataFrame:
    return people(spark.read.schema(PEOPLE_PAGE).json(path, multiLine=True))


def to_unified_google(df: DataFrame) -> DataFrame:  # S05
    """Blank texts become null, null address parts empty, labels fall back to types."""
    label = lambda x: F.coalesce(x["label"], x["type"], F.lit("")).alias("label")
    items = lambda f: F.coalesce(F.transform(f, lambda x: F.struct(x["value"].alias("value"), label(x))), F.array().cast(f"array<{ITEM}>"))
    part = lambda x, f, name: F.coalesce(x[f], F.lit("")).alias(name)
    addresses = F.transform("addresses", lambda x: F.struct(part(x, "streetAddress", "street"), part(x, "city", "city"), part(x, "region", "state"), part(x, "postalCode", "postal_code"), part(x, "country", "country"), x["countryCode"].alias("country_code"), label(x)))
    texts = ["given_name", "middle_name", "family_name", "name_prefix", "name_suffix", "nickname", "phonetic_given_name", "phonetic_middle_name", "phonetic_family_name", "organization", "department", "job_title", "note"]
    out = df.select(F.col("resource_name").alias("contact_id"), F.lit("google").alias("source"), *(N.non_blank(F.col(t)).alias(t) for t in texts), *(items(f).alias(f) for f in ("phones", "emails", "urls")), F.coalesce(addresses, F.array().cast(f"array<{ADDRESS}>")).alias("addresses"), "birthday", "photo_url", F.col("update_time").alias("last_modified"), F.col("resource_name").alias("google_resource_name"))
    return C.completed(out)


def to_unified_right(df: DataFrame) -> DataFrame:  # S06
    """Texts stay as they are (missing ones empty); there is no modification time."""
    texts = ["given_name", "middle_name", "family_name", "name_prefix", "name_suffix", "nickname", "organization", "department", "job_title", "note"]
    out = C.completed(df.withColumn("contact_id", F.col("identifier")))
    return out.withColumns({**{t: F.coalesce(t, F.lit("")) for t in texts}, "source": F.lit("mac"), "mac_contact_identifier": F.col("contact_id"), "last_modified": F.lit(None).cast("timestamp")})


_MIRROR = "(?i)(google|gmail|exchange|outlook)"


def scoped_scan(df: DataFrame, containers: DataFrame, container: str | None = None) -> DataFrame:  # S07
    """Records of one container: the named one, else iCloud card, local, any, none of them mirrors.

    containers (id, name, type) is a short list. Raises ValueError where no container is left: an unscoped scan would count mirrors twice.
    """
    open_ones = containers.where((F.col("type") != "exchange") & ~F.col("name").rlike(_MIRROR))
    if container is not None:
        open_ones = open_ones.where(F.col("id") == container)
    rank = F.when((F.col("type") == "cardDAV") & F.lower("name").contains("icloud"), 0).when(F.col("type") == "local", 1).otherwise(2)
    best = open_ones.agg(F.min_by("id", F.struct(rank.alias("r"), F.col("id").alias("i"))).alias("id")).first()["id"]
    if best is None:
        raise ValueError("no container can be scanned")
    return df.where(F.col("container_id") == best)


def group_members(membership: DataFrame, groups: list[str]) -> DataFrame:  # S08
    return membership.where(F.col("group").isin(groups)).select("id").distinct()
