"""Expressions over a whole contact: ``c`` is a struct Column, or anything that gives a Column by field name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookmerge.functions import normalize as N
from bookmerge.functions.names import NAME_PARTS, format_name
from bookmerge.schemas import CONTACT_TYPES, Settings


class Row:
    """A DataFrame's own columns as a contact."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


HERE = Row()


class Prefixed:
    """A DataFrame's columns of one prefix as a contact."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __getitem__(self, name: str) -> Column:
        return F.col(self.prefix + name)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """The contact columns alone, each under the prefix."""
    return df.select(*(F.col(f).alias(prefix + f) for f in CONTACT_TYPES))


ORDERED_NAME = ["name_prefix", "given_name", "middle_name", "family_name", "name_suffix"]


def as_struct(df: DataFrame, name: str) -> DataFrame:
    """The contact columns as one struct, beside the others."""
    rest = [c for c in df.columns if c not in CONTACT_TYPES]
    return df.select(*rest, F.struct(*CONTACT_TYPES).alias(name))


def completed(df: DataFrame) -> DataFrame:
    """Adds the contact columns that df lacks as nulls, and casts the rest."""
    return df.select(*(F.col(k).cast(t).alias(k) if k in df.columns else F.lit(None).cast(t).alias(k) for k, t in CONTACT_TYPES.items()), *(c for c in df.columns if c not in CONTACT_TYPES))


def values(items: Column) -> Column:
    return F.transform(items, lambda x: x["value"])


def primary_email(c) -> Column:  # P04
    return F.get(c["emails"], F.lit(0))["value"]


def primary_phone(c) -> Column:
    return F.get(c["phones"], F.lit(0))["value"]


def display_name(c) -> Column:  # P02
    joined = F.array_join(F.array_compact(F.array(*(N.non_blank(c[f]) for f in ORDERED_NAME))), " ")
    return F.coalesce(F.nullif(joined, F.lit("")), N.non_blank(primary_email(c)), N.non_blank(primary_phone(c)), N.non_blank(c["organization"]), N.non_blank(c["nickname"]), F.lit("Unnamed contact"))


def has_syncable_content(c) -> Column:  # P03
    named = F.coalesce(*(N.non_blank(c[f]) for f in [*ORDERED_NAME, "nickname", "organization"])).isNotNull()
    some = lambda f: F.coalesce(F.size(c[f]) > 0, F.lit(False))
    return named | some("phones") | some("emails") | some("addresses")


def formatted_address(a: Column) -> Column:  # P05
    return F.concat_ws(", ", a["street"], a["city"], a["state"], a["postal_code"], a["country"])


def normalized(c) -> Column:  # P16
    return F.struct(
        N.normalize_full_name(c["given_name"], c["middle_name"], c["family_name"]).alias("full_name"),
        N.normalize_name(c["given_name"]).alias("given_name"),
        N.normalize_name(c["family_name"]).alias("family_name"),
        F.coalesce(N.normalize_emails(values(c["emails"])), F.array().cast("array<string>")).alias("emails"),
        F.coalesce(N.normalize_phones(values(c["phones"])), F.array().cast("array<string>")).alias("phones"),
        N.normalize_organization(c["organization"]).alias("organization"),
        F.coalesce(N.normalize_address(F.get(c["addresses"], F.lit(0))), F.lit("")).alias("address"),
    )


def has_name(n: Column) -> Column:  # P17
    return n["full_name"] != ""


def has_contact(n: Column) -> Column:
    return (F.size(n["emails"]) > 0) | (F.size(n["phones"]) > 0)


def is_empty(n: Column) -> Column:
    return ~has_name(n) & ~has_contact(n) & (n["organization"] == "")


def blocking_keys(c) -> Column:  # P28
    n = normalized(c)
    emails = F.transform(n["emails"], lambda e: F.concat(F.lit("e:"), e))
    tails = F.transform(F.filter(F.transform(n["phones"], N.digits_of), lambda p: F.length(p) >= 7), lambda p: F.concat(F.lit("p:"), F.right(p, F.lit(7))))
    letters = F.array_compact(F.array(F.when(n["family_name"] != "", F.concat(F.lit("f:"), F.substring(n["family_name"], 1, 1))), F.when(n["given_name"] != "", F.concat(F.lit("g:"), F.substring(n["given_name"], 1, 1)))))
    keys = F.array_distinct(F.concat(emails, tails, letters))
    return F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit("∅")))


def identity_keys(c) -> Column:  # P29
    none = F.array().cast("array<string>")
    emails = F.filter(F.transform(values(c["emails"]), lambda e: F.concat(F.lit("email:"), F.lower(N.non_blank(e)))), lambda k: k.isNotNull())
    phones = F.transform(F.filter(F.transform(values(c["phones"]), N.digits_of), lambda p: F.length(p) >= 8), lambda p: F.concat(F.lit("phone:"), F.right(p, F.lit(8))))
    return F.concat(F.coalesce(emails, none), F.coalesce(phones, none))


def data_score(c) -> Column:  # P41
    point = lambda f: N.non_blank(c[f]).isNotNull().cast("int")
    n = lambda f: F.coalesce(F.size(c[f]), F.lit(0))
    photo = (c["photo_data"].isNotNull() | c["photo_url"].isNotNull()).cast("int")
    return point("given_name") + point("family_name") + point("organization") + point("job_title") + photo + point("note") + 2 * n("phones") + 2 * n("emails") + n("addresses")


_CONTENT = [f for f in CONTACT_TYPES if f not in ("contact_id", "source", "google_resource_name", "mac_contact_identifier", "phonetic_given_name", "phonetic_middle_name", "phonetic_family_name", "photo_data", "photo_url", "last_modified")]


def same_content(a, b) -> Column:  # P49
    return F.struct(*(a[f] for f in _CONTENT)).eqNullSafe(F.struct(*(b[f] for f in _CONTENT)))


def photo_needs_copy(left, right, failed_ids: Column | None = None) -> Column:  # P61
    held = left["photo_data"].isNotNull()
    blocked = F.lit(False) if failed_ids is None else F.coalesce(F.array_contains(failed_ids, left["google_resource_name"]), F.lit(False))
    return (held | (N.non_blank(left["photo_url"]).isNotNull() & ~blocked)) & right["photo_data"].isNull()


def photo_accepted(data: Column, status: Column) -> Column:  # P63
    return F.coalesce((F.length(data) > 0) & (F.length(data) <= 5 * 1024 * 1024) & status.between(200, 299), F.lit(False))


def fields_of(c, **fields: Column) -> dict[str, Column]:
    """The contact's fields by name, some of them replaced."""
    return {f: (fields[f] if f in fields else c[f]).cast(t) for f, t in CONTACT_TYPES.items()}


def as_one(fields: dict[str, Column]) -> Column:
    return F.struct(*(v.alias(f) for f, v in fields.items()))


def replaced(c, **fields: Column) -> Column:
    """The contact with some fields replaced."""
    return as_one(fields_of(c, **fields))


def field_settings(c, settings: Settings, countries: dict[str, str] | None = None) -> Column:  # P42
    """What may be written: switched-off fields empty, country codes and name casing applied."""
    return as_one(settings_fields(c, settings, countries))


def settings_fields(c, settings: Settings, countries: dict[str, str] | None = None) -> dict[str, Column]:
    empty = lambda f: F.array().cast(CONTACT_TYPES[f])
    out: dict[str, Column] = {f: format_name(c[f], settings.name_format) for f in NAME_PARTS}
    if not settings.sync_birthday:
        out["birthday"] = F.lit(None)
    if not settings.sync_websites:
        out["urls"] = empty("urls")
    if not settings.sync_job_title:
        out["job_title"] = F.lit(None)
    if not settings.sync_notes:
        out["note"] = F.lit(None)
    if not settings.sync_addresses:
        out["addresses"] = empty("addresses")
    elif settings.sync_country_codes:

        def coded(a: Column) -> Column:
            known = N.normalize_country(a["country"], a["country_code"], countries)
            return F.struct(a["street"].alias("street"), a["city"].alias("city"), a["state"].alias("state"), a["postal_code"].alias("postal_code"), known["country"].alias("country"), known["country_code"].alias("country_code"), a["label"].alias("label"))

        out["addresses"] = F.transform(c["addresses"], coded)
    return fields_of(c, **out)


#: Field groups that a write mask switches; everything else is always written.
MASKED = {"birthday": ["birthday"], "websites": ["urls"], "addresses": ["addresses"], "job_title": ["job_title"], "notes": ["note"], "photos": ["photo_data", "photo_url"], "extended_names": ["name_prefix", "name_suffix", "nickname", "phonetic_given_name", "phonetic_middle_name", "phonetic_family_name", "department"]}


def write_mask(settings: Settings) -> dict[str, bool]:
    return {"birthday": settings.sync_birthday, "websites": settings.sync_websites, "addresses": settings.sync_addresses, "job_title": settings.sync_job_title, "notes": settings.sync_notes, "photos": settings.sync_photos, "extended_names": True}


def apply_mask(source, target, mask: dict[str, bool | Column]) -> Column:  # P43
    """target with source's allowed fields, even empty ones; a photo is written only where there is one."""
    return as_one(masked_fields(source, target, mask))


def masked_fields(source, target, mask: dict[str, bool | Column]) -> dict[str, Column]:
    out = {}
    ids = ("contact_id", "source", "google_resource_name", "mac_contact_identifier", "last_modified")
    group_of = {f: g for g, fields in MASKED.items() for f in fields}
    for f in CONTACT_TYPES:
        if f in ids:
            out[f] = target[f]
            continue
        allowed = mask.get(group_of.get(f, ""), True)
        allowed = F.lit(allowed) if isinstance(allowed, bool) else allowed
        if f in MASKED["photos"]:
            allowed = allowed & source[f].isNotNull()
        out[f] = F.when(allowed, source[f].cast(CONTACT_TYPES[f])).otherwise(target[f])
    return fields_of(target, **out)


OUTCOMES = [("added", "added"), ("updated", "updated"), ("deleted", "deleted"), ("merged", "merged"), ("skipped", "skipped"), ("errors", "failed"), ("set_aside", "set aside"), ("deferred_deletions", "deletions held for review"), ("deferred_merges", "merges awaiting decision")]


def outcome_phrase(**counts: Column) -> Column:  # P47
    said = [F.when(counts[k] > 0, F.concat_ws(" ", counts[k].cast("string"), F.lit(text))) for k, text in OUTCOMES if k in counts]
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*said)), " · "), F.lit("")), F.lit("No changes"))
