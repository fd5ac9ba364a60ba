"""Scalar cases as small tables."""

import pytest
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.functions import names as M
from bookmerge.functions import normalize as N
from bookmerge.operators import logs
from bookmerge.schemas import CONTACT
from bookmerge.sources import people as P

CASES = [
    (N.normalize_phone, [("(555) 123-4567", "5551234567"), ("+1 (555) 123-4567", "+15551234567"), ("ext.", ""), ("1+2", "12"), (None, "")]),
    (N.normalize_organization, [("  Apple Inc.  ", "apple"), ("Acme Co", "acme"), ("Inc", "inc"), (None, "")]),
    (N.normalize_name, [("O'Brien", "obrien"), ("Jean-Luc", "jeanluc"), ("J. R. Smith", "smith"), ("J Smith", "j smith"), (None, "")]),
    (N.normalize_email, [(" J.Doe@Gmail.com ", "jdoe@gmail.com"), ("A.B@x.org", "a.b@x.org")]),
    (N.normalize_url, [("https://www.Site.test//", "site.test"), ("http://site.test/a", "site.test/a")]),
    (M.soundex_variant, [("Ashcraft", "A226"), ("Smith", "S530"), ("", ""), ("Lee", "L000")]),
    (M.title_case, [("mcdonald", "McDonald"), ("macintyre", "MacIntyre"), ("mack", "Mack"), ("o'brien", "O'Brien"), ("jean-luc", "Jean-Luc"), ("van der berg", "Van der Berg"), ("MARIA de la cruz", "Maria de la Cruz")]),
    (lambda s: M.format_name(s, "titleCase"), [("山田 太郎", "山田 太郎"), ("", ""), (None, None)]),
    (N.non_blank, [("  x\n", "x"), (" \t", None), (None, None)]),
    (lambda s: N.bounded_single_line(s, 5), [("a\nb", "a b"), ("abcdefgh", "abcde…")]),
    (logs.redacted, [("Ann Lee [toMac] s=1", "<contact 7 chars> [toMac] s=1"), ("[x]", "[x]"), ("plain", "plain")]),
    (N.canonical_label, [("Cell", "mobile"), ("iPhone", "iphone"), ("Boat", "boat"), ("", None)]),
]


@pytest.mark.parametrize("f,rows", CASES)
def test_scalars(spark, f, rows):
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [y for _, y in rows]


def test_title_case_is_idempotent(spark):
    df = spark.createDataFrame([("o'neil mcdonald-smith",), ("VAN DER macarthur",)], "x string").select(M.title_case(F.col("x")).alias("once"))
    assert df.where(M.title_case(F.col("once")) != F.col("once")).count() == 0


def test_update_time(spark):
    t = "array<struct<type:string,updateTime:string>>"
    rows = [([("PROFILE", "2020-01-01T00:00:00Z"), ("CONTACT", "2024-01-30T10:00:30.123456Z")],), ([("X", "2024-01-30T10:00:30Z")],), ([("CONTACT", "garbage")],), (None,)]
    got = [r[0] and r[0].year for r in spark.createDataFrame(rows, f"s {t}").select(P.contact_update_time(F.col("s"))).collect()]
    assert got == [2024, 2024, None, None]


def contact(**f):
    base = dict.fromkeys([c.split(" ")[0] for c in CONTACT.split(", ")])
    return tuple((base | {"phones": [], "emails": [], "addresses": [], "urls": []} | f).values())


def test_names_and_keys(spark):
    rows = [contact(contact_id="1", given_name="John", family_name="Smith", emails=[("John@Example.com", "work")], phones=[("+1 555 123-4567", "mobile")]), contact(contact_id="2"), contact(contact_id="3", given_name=" ", organization="Acme")]
    df = spark.createDataFrame(rows, CONTACT)
    got = df.select(C.display_name(C.HERE).alias("n"), C.blocking_keys(C.HERE).alias("k"), C.identity_keys(C.HERE).alias("i"), C.has_syncable_content(C.HERE).alias("s")).collect()
    assert [r["n"] for r in got] == ["John Smith", "Unnamed contact", "Acme"]
    assert got[0]["k"] == ["e:john@example.com", "p:1234567", "f:s", "g:j"] and got[1]["k"] == ["∅"]
    assert got[0]["i"] == ["email:john@example.com", "phone:51234567"]
    assert [r["s"] for r in got] == [True, False, True]
