"""Field normalisers as Column expressions; ids in comments name the inventory rows."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_EDGES = r"^[\p{Z}\s]+|[\p{Z}\s]+$"


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, _EDGES, "")


def non_blank(s: Column) -> Column:  # P01
    return F.nullif(trimmed(s), F.lit(""))


def phone_key_loose(s: Column) -> Column:  # P06
    return F.regexp_replace(s, r"[^\p{N}+]", "")


def email_key_loose(s: Column) -> Column:  # P07
    return trimmed(F.lower(s))


def normalize_name(s: Column) -> Column:  # P08
    """Lower case, no punctuation, single blanks; one-letter words go from names of more than two words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"\p{P}", ""), r"[\p{Z}\s]+"), lambda w: w != "")
    return F.array_join(F.when(F.size(words) > 2, F.filter(words, lambda w: F.length(w) > 1)).otherwise(words), " ")


def normalize_full_name(given: Column, middle: Column | None, family: Column) -> Column:  # P09
    parts = [normalize_name(p) for p in (given, middle, family) if p is not None]
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def normalize_email(s: Column) -> Column:  # P10
    e = trimmed(F.lower(F.coalesce(s, F.lit(""))))
    local = F.regexp_extract(e, r"(?s)^([^@]*)@", 1)
    rest = F.regexp_extract(e, r"(?s)^[^@]*(@.*)$", 1)
    gmail = e.contains("@gmail.com") | e.contains("@googlemail.com")
    return F.when(gmail, F.concat(F.replace(local, F.lit("."), F.lit("")), rest)).otherwise(e)


def _set_of(values: Column, one) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, one), lambda x: x.isNotNull() & (x != ""))))


def normalize_emails(values: Column) -> Column:  # P11
    return _set_of(values, normalize_email)


def normalize_phone(s: Column) -> Column:  # P12
    digits = F.regexp_replace(F.coalesce(s, F.lit("")), r"[^\p{N}]", "")
    return F.when(digits == "", "").when(s.rlike(r"^[^\p{N}]*\+"), F.concat(F.lit("+"), digits)).otherwise(digits)


def normalize_phones(values: Column) -> Column:  # P13
    return _set_of(values, normalize_phone)


# Legal forms that one trailing word of a company name may be.
LEGAL_FORMS = ["inc", "inc.", "incorporated", "llc", "l.l.c.", "l.l.c", "corp", "corp.", "corporation", "ltd", "ltd.", "limited", "co", "co.", "company", "plc", "plc."]


def normalize_organization(s: Column) -> Column:  # P14
    forms = "|".join(f.replace(".", r"\.") for f in sorted(LEGAL_FORMS, key=len, reverse=True))
    return trimmed(F.regexp_replace(trimmed(F.lower(F.coalesce(s, F.lit("")))), rf" (?:{forms})$", ""))


def normalize_address(a: Column) -> Column:  # P15
    parts = [trimmed(F.lower(F.coalesce(a[f], F.lit("")))) for f in ("street", "city", "state", "postal_code", "country")]
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def normalize_url(s: Column) -> Column:  # P18
    steps = [(r"/+$", ""), ("^https://", ""), ("^http://", ""), (r"^www\.", "")]
    return reduce(lambda u, step: F.regexp_replace(u, *step), steps, trimmed(F.lower(F.coalesce(s, F.lit("")))))


def birthday_key(b: Column) -> Column:  # P19
    year = F.when(b["year"].isNull() | b["year"].isin(0, 1604), F.lit("-")).otherwise(b["year"].cast("string"))
    return F.when(b["month"].isNotNull() & b["day"].isNotNull(), F.concat_ws("-", year, b["month"].cast("string"), b["day"].cast("string")))


@cache
def countries() -> dict[str, str]:
    """Code to English name of all ISO-3166 regions, as the session's platform knows them."""
    locale = SparkSession.active()._jvm.java.util.Locale
    return {code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()}


def normalize_country(country: Column, code: Column, names: dict[str, str] | None = None) -> Column:  # P20
    """struct<country, country_code>: a valid code gives both; else a known name gives both; else they stay."""
    names = countries() if names is None else names
    by_code = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    by_name = F.create_map(*(F.lit(x) for k, v in {v.lower(): k for k, v in names.items()}.items() for x in (k, v)))
    upper, low = F.upper(trimmed(code)), trimmed(F.lower(country))
    found = F.when(F.coalesce(code, F.lit("")) != "", F.when(F.element_at(by_code, upper).isNotNull(), upper))
    found = F.coalesce(found, F.when(F.coalesce(country, F.lit("")) != "", F.element_at(by_name, low)))
    known = lambda c: F.struct(F.coalesce(F.element_at(by_code, c), country).alias("country"), F.coalesce(c, code).alias("country_code"))
    return known(found)


def names_similar(a: Column, b: Column, most: int = 2) -> Column:  # P21, P22
    x, y = normalize_name(a), normalize_name(b)
    return (x != "") & (y != "") & ((x == y) | (F.levenshtein(x, y, most) >= 0))


def email_domain(e: Column) -> Column:  # P25
    parts = F.split(e, "@")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1)))


def domains_conflict(a: Column, b: Column) -> Column:  # P25, over arrays of normalised emails
    x, y = (F.filter(F.transform(v, email_domain), lambda d: d.isNotNull()) for v in (a, b))
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def _alias_domain(e: Column) -> Column:
    return F.regexp_extract(e, r"(?s)^[^@]+@(.+)$", 1)


def _alias_stem(e: Column) -> Column:
    local = F.regexp_extract(e, r"(?s)^([^@]+)@", 1)
    return F.coalesce(F.nullif(F.regexp_extract(local, r"^\+*([^+]+)", 1), F.lit("")), local)


def email_aliases(a: Column, b: Column) -> Column:  # P26
    return (a != b) & (_alias_domain(a) != "") & (_alias_domain(a) == _alias_domain(b)) & (_alias_stem(a) == _alias_stem(b))


def alias_key(e: Column) -> Column:
    """What two addresses share if they are aliases; null where an address has no aliases."""
    return F.when(_alias_domain(e) != "", F.concat(_alias_domain(e), F.lit("\n"), _alias_stem(e)))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{N}]", "")


def phone_suffix_equal(a: Column, b: Column) -> Column:  # P27, over raw numbers
    x, y = digits_of(a), digits_of(b)
    return (F.length(x) >= 7) & (F.right(x, F.lit(7)) == F.right(y, F.lit(7))) & (x != y)


def failure_key(target_mac: Column, source_mac: Column, target_google: Column, source_google: Column) -> Column:  # P30
    mac, google = F.coalesce(target_mac, source_mac), F.coalesce(target_google, source_google)
    return F.coalesce(F.concat(F.lit("mac:"), mac), F.concat(F.lit("google:"), google))


def histogram_key(reason: Column) -> Column:  # P31
    return F.substring_index(reason, ":", 1)


def fingerprint(*fields: Column) -> Column:  # P36
    return F.sha2(F.to_json(F.array(*(F.coalesce(f.cast("string"), F.lit("")) for f in fields))), 256)


def pair_key(a: Column, b: Column, sep: str = "<>") -> Column:  # P36, J13
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def bounded_single_line(s: Column, most: int) -> Column:  # P37
    flat = trimmed(F.regexp_replace(s, r"\p{Cc}+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


LABELS = {"home": "home", "work": "work", "other": "other", "mobile": "mobile", "cell": "mobile", "main": "main", "iphone": "iphone"}


def canonical_label(s: Column) -> Column:  # P39
    low = F.nullif(trimmed(F.lower(s)), F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), low), low)


def partial_date_text(b: Column) -> Column:  # P40
    pad = lambda c, n: F.when(F.length(c.cast("string")) >= n, c.cast("string")).otherwise(F.lpad(c.cast("string"), n, "0"))
    return F.concat_ws("-", pad(b["year"], 4), pad(b["month"], 2), pad(b["day"], 2))
