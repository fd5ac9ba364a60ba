"""Name expressions: phonetic codes, casing, nicknames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookmerge.functions.name_families import FAMILIES
from bookmerge.functions.normalize import normalize_name


def soundex_variant(s: Column) -> Column:  # P23
    """Soundex in which vowels, H and W all separate equal codes; letters only, four places."""
    letters = F.upper(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^\p{L}]", ""))
    codes = F.translate(letters, "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    digits = F.regexp_replace(codes, "[^1-6]", "0")
    runs = F.regexp_replace(digits, r"(.)\1+", "$1")
    rest = F.replace(F.substring(runs, 2, 1 << 20), F.lit("0"), F.lit(""))
    return F.when(letters == "", "").otherwise(F.substring(F.rpad(F.concat(F.substring(letters, 1, 1), rest), 4, "0"), 1, 4))


def contains_cjk(s: Column) -> Column:  # P32
    return s.rlike(r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]")


# Particles that stay lower-case inside a name.
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "la", "le", "los", "las", "du", "dos", "das", "ter", "ten", "af", "av", "zu", "und", "y", "e", "bin", "binti", "ibn", "al", "el"]


def _first_upper(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))


def _segment(segment: Column, index: Column) -> Column:
    low = F.lower(segment)
    after = lambda n: _first_upper(F.substring(low, n + 1, 1 << 20))
    return (
        F.when((index > 0) & low.isin(PARTICLES), low)
        .when(low.rlike("^[od]'.") , F.concat(F.upper(F.substring(low, 1, 1)), F.lit("'"), after(2)))
        .when(low.startswith("mc") & (F.length(low) > 2), F.concat(F.lit("Mc"), after(2)))
        .when(low.startswith("mac") & (F.length(low) > 4), F.concat(F.lit("Mac"), after(3)))
        .otherwise(_first_upper(low))
    )


def title_case(s: Column) -> Column:  # P34
    word = lambda w, i: F.array_join(F.transform(F.split(w, "-", -1), lambda x: _segment(x, i)), "-")
    return F.array_join(F.transform(F.split(s, " ", -1), word), " ")


def format_name(s: Column, convention: str) -> Column:  # P33
    styles = {"upperCase": F.upper, "lowerCase": F.lower, "titleCase": title_case}
    if convention not in styles:
        return s
    return F.when((s == "") | contains_cjk(s), s).otherwise(styles[convention](s))


NAME_PARTS = ["given_name", "middle_name", "family_name", "name_prefix", "name_suffix"]


def apply_name_format(df, convention: str):  # P35
    return df.withColumns({c: format_name(F.col(c), convention) for c in NAME_PARTS}) if convention != "asIs" else df


#: Names up to which the table of families is broadcast; a longer one is joined as it is.
MOST_NAMES = 100_000


def with_nickname_group(df: DataFrame, given: Column, name: str, families: Sequence[Sequence[str]] | None = None) -> DataFrame:  # P24
    """df with ``name``: the number of the family of the first given name, null outside all; the last family that lists a name wins.

    A left join with the table of names, which has each name once.
    """
    listed = families or [line.split() for line in FAMILIES.split("\n") if line]
    number = {n: i for i, family in enumerate(listed) for n in family}
    table = df.sparkSession.createDataFrame(list(number.items()), f"__name string, `{name}` int")
    first = F.get(F.split(normalize_name(given), " "), F.lit(0))
    return df.withColumn("__first", first).join(F.broadcast(table) if len(number) <= MOST_NAMES else table, F.col("__first") == F.col("__name"), "left").drop("__first", "__name")
