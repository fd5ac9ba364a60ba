"""Operator cases as small tables, and properties that hold between operators."""

import pytest
from pyspark.sql import functions as F

from bookmerge.operators import apply as A
from bookmerge.operators import diff as D
from bookmerge.operators import linkage, logs, matching, merge, versions
from bookmerge.schemas import CONTACT, Settings
from bookmerge.sources import people, sinks
from tests.test_functions import contact

MAPPING = "google_resource_name string, mac_contact_identifier string, last_synced_at timestamp, google_etag string"


def book(spark, *rows):
    return spark.createDataFrame([contact(**r) for r in rows], CONTACT)


def person(i, given="", family="", email=None, phone=None, side="google", **more):
    own = "google_resource_name" if side == "google" else "mac_contact_identifier"
    return {"contact_id": i, own: i, "source": side, "given_name": given, "family_name": family, "emails": [(email, "work")] if email else [], "phones": [(phone, "mobile")] if phone else [], **more}


SCORES = [
    (dict(email="A@x.test"), dict(email="a@x.test"), 60),
    (dict(phone="+15551234567"), dict(phone="+1 (555) 123-4567"), 60),
    (dict(given="John", family="Smith"), dict(given="john", family="SMITH"), 30),
    (dict(given="Jon", family="Smith"), dict(given="John", family="Smith"), 20),
    (dict(given="John", family="Smith", phone="5550001111"), dict(given="John", family="Smith", phone="5552223333"), 10),
    (dict(organization="Acme Inc."), dict(organization="acme"), 10),
]


@pytest.mark.parametrize("a,b,score", SCORES)
def test_rule_scores(spark, a, b, score):
    pairs = matching.candidate_pairs(matching.prepared(book(spark, person("a", **a), person("b", **b))), mode="exhaustive")
    assert [r[0] for r in pairs.select(matching.total_score(matching.match_score(F.col("a"), F.col("b")))).collect()] == [score]


def test_lossless_pairs_equal_exhaustive_ones(spark):
    import random

    rnd = random.Random(4)
    pick = lambda *xs: rnd.choice(xs)
    rows = [person(f"p{i:03}", pick("Jon", "John", "Ann", "Anne", "Bo"), pick("Smith", "Smyth", "Li", "Lee"), pick(None, f"u{i % 9}@x.test"), pick(None, f"55512345{i % 7}"), organization=pick("Acme", "Acme Inc", "Beta"), addresses=[(pick("1 Main", "2 Main"), "S", "", "", "", None, "home")]) for i in range(60)]
    ready = matching.prepared(book(spark, *rows))
    found = [{tuple(r) for r in matching.scored(matching.candidate_pairs(ready, mode=m)).select("id_a", "id_b", "score", "effective").collect()} for m in ("lossless", "exhaustive")]
    assert found[0] == found[1] and len(found[0]) > 20


@pytest.mark.parametrize("settings", [Settings(), Settings(confirm_score=30), Settings(ai_matching=False)])
def test_lossless_pairs_of_bare_records(spark, settings):
    """Records without email and phone, with nicknames, one-letter given names and names that split otherwise; within a book and across two."""
    import random

    rnd = random.Random(12)
    pick = lambda *xs: rnd.choice(xs)
    full = lambda: pick(("J", "Smith"), ("Jon", "Smith"), ("Ann Lee", "Wu"), ("Ann", "Lee Wu"), ("Bo", "Li"), ("Bob", "Li"))
    made = lambda tag: [person(f"{tag}{i:03}", *full(), pick(None, None, f"u{i % 5}@x.test"), pick(None, None, f"55512345{i % 7}"), nickname=pick(None, "", "Jon", "an", "bo"), organization=pick(None, "Acme", "Beta"), addresses=[(pick("", "1 Main"), "", "", "", "", None, "home")]) for i in range(50)]
    a, b = (matching.prepared(book(spark, *made(t))) for t in "pq")
    for other in (None, b):
        found = [{tuple(r) for r in matching.scored(matching.candidate_pairs(a, other, mode=m, settings=settings), settings).select("id_a", "id_b", "score", "effective").collect()} for m in ("lossless", "exhaustive")]
        assert found[0] == found[1] and len(found[0]) > 10


def test_hot_keys_are_told_and_their_records_stay_together(spark):
    ready = matching.prepared(book(spark, *(person(f"p{i:02}", f"N{i}", "X", "info@x.test") for i in range(30)), person("q", "A", "B", "a@x.test"), person("r", "C", "D", "a@x.test")))
    assert [tuple(r) for r in matching.hot_keys(ready, max_key_fanout=10).collect()] == [("E:info@x.test", 30)]
    got = {tuple(r) for r in matching.candidate_pairs(ready, max_key_fanout=10).select("id_a", "id_b").collect()}
    assert got == {("p00", f"p{i:02}") for i in range(1, 30)} | {("q", "r")}


def test_fold_equals_merges_one_by_one(spark):
    import random

    rnd = random.Random(5)
    pick = lambda *xs: rnd.choice(xs)
    many = lambda *xs: [(pick(*xs), pick("home", "work")) for _ in range(rnd.randrange(4))]
    rows = [person(f"g{i:02}", pick("", "Ann", "Bo", None), pick("", "Lee", None), note=pick(None, "", "n1", "n2"), photo_url=pick(None, "u"), phones=many("1-2", "12", "3"), emails=many("a@x", "A@x", "b@x"), urls=many("u", "U", "v"), addresses=[(pick("1 a", "1 A", "2 b"), "s", "", "", "", None, "home") for _ in range(rnd.randrange(4))], nickname=pick(None, "", "k")) for i in range(40)]
    from bookmerge.functions import contacts as C

    members = C.as_struct(book(spark, *rows), "c").withColumn("group", (F.substring("c.contact_id", 2, 2).cast("int") % 12).cast("string"))
    got = {r["group"]: r["merged"] for r in merge.fold_merge(members).collect()}
    rank = F.struct((-C.data_score(F.col("c"))).alias("score"), F.col("c.contact_id").alias("id"), F.col("c").alias("c"))
    in_order = members.groupBy("group").agg(F.array_sort(F.collect_list(rank)).alias("g"))
    step = lambda acc, x: merge.merge_dedup(acc, x["c"]).cast(merge_type)
    merge_type = members.schema["c"].dataType.simpleString()
    plain = in_order.select("group", F.aggregate(F.slice("g", F.lit(2), F.size("g")), F.get("g", F.lit(0))["c"].cast(merge_type), step).alias("merged"))
    assert got == {r["group"]: r["merged"] for r in plain.collect()}


def test_several_records_merge_into_one(spark):
    """Linked right records come after each other: the left one ends with the data of all."""
    left = book(spark, person("g", "Ann", "", "a@x.test", job_title="Boss"))
    right = book(spark, *(person(f"m{i}", "Ann", "Lee", f"a{i}@x.test", side="mac") for i in range(3)))
    plan = "name string, action string, direction string, changes array<string>, user_override string, source string, left_id string, right_id string"
    rows = [("x", "merge", "twoWay", ["Matched an existing Google contact"], "merge", "google", "g", f"m{i}") for i in range(3)]
    done = A.with_outcomes(spark.createDataFrame(rows, plan), spark.createDataFrame([], "id string, failure_count int, ignored boolean"))
    a, b = A.apply_books(done, left, right)
    mails = lambda r: [e["value"] for e in r["emails"]]
    (one,) = a.collect()
    assert mails(one) == ["a@x.test", "a0@x.test", "a1@x.test", "a2@x.test"] and one["family_name"] == "Lee"
    assert {r["contact_id"]: mails(r) for r in b.collect()} == {f"m{i}": mails(one)[: i + 2] for i in range(3)}


def test_countries_come_from_the_platform(spark):
    from bookmerge.functions import normalize as N

    rows = [("x", " de "), ("  france ", None), ("Nowhere", ""), (None, "QQ")]
    got = spark.createDataFrame(rows, "c string, k string").select(N.normalize_country(F.col("c"), F.col("k")).alias("n")).select("n.*").collect()
    assert [tuple(r) for r in got] == [("Germany", "DE"), ("France", "FR"), ("Nowhere", ""), (None, "QQ")] and len(N.countries()) > 240


def test_name_families_are_a_parameter(spark, tmp_path):
    from bookmerge.functions import names as M
    from bookmerge.sources import stores

    (tmp_path / "families.txt").write_text("Zed, zeddy\n\nann,zed\n")
    found = stores.load_nicknames(spark, f"{tmp_path}/families.txt")
    df = spark.createDataFrame([("Zed",), ("zeddy",), ("Ann",), ("Bob",)], "g string")
    assert {r["g"]: r["n"] for r in M.with_nickname_group(df, F.col("g"), "n", found).collect()} == {"Zed": 1, "zeddy": 0, "Ann": 1, "Bob": None}


def test_families_of_given_names(spark):
    """The last family that lists a name has it: 595 pairs of names are linked, and none of those that only an earlier family would link."""
    from itertools import combinations

    from bookmerge.functions import names as M
    from bookmerge.functions.name_families import FAMILIES

    names = sorted(set(FAMILIES.split()))
    assert (len(FAMILIES.strip().splitlines()), len(FAMILIES.split()), len(names)) == (119, 423, 398)
    group = {r["g"]: r["n"] for r in M.with_nickname_group(spark.createDataFrame([(n.upper() + " x",) for n in names], "g string"), F.col("g"), "n").select(F.lower(F.split("g", " ")[0]).alias("g"), "n").collect()}
    assert sum(group[a] == group[b] for a, b in combinations(names, 2)) == 595
    for a, b in (("bert", "robert"), ("al", "alexander"), ("harry", "henry"), ("nick", "nicholas"), ("ellie", "elizabeth"), ("rick", "richard"), ("ted", "edward"), ("jon", "john"), ("pat", "patrick"), ("charlie", "charles")):
        assert group[a] != group[b], (a, b)
    for a, b in (("bob", "robert"), ("harry", "harold"), ("nick", "dominic"), ("bert", "albert"), ("kate", "katherine"), ("winnie", "freddie"), ("jenny", "genevieve"), ("ray", "raymond"), ("hattie", "harriet")):
        assert group[a] == group[b], (a, b)


def test_records_that_merge_in_turn(spark):
    """Running merges are those of the plain fold, row by row, whatever the fields hold."""
    import random

    from bookmerge.schemas import CONTACT_STRUCT

    rnd = random.Random(11)
    pick = lambda *x: rnd.choice(x)

    def one(i, side):
        items = lambda *values: [(rnd.choice(values), rnd.choice(("home", "work"))) for _ in range(rnd.randrange(4))]
        where = [(pick("Main St", "main st ", "Elm", None), "", "", "", "", None, "home") for _ in range(rnd.randrange(3))]
        return person(i, pick("Ann", "", None, f"N{i}"), pick("", None, "Lee"), side=side, **{**dict(nickname=pick(None, "", "n"), phonetic_given_name=pick(None, "", "p"), note=pick(None, "", "x", "y", "x\n---\ny", "x\n---\ny"), organization=pick(None, "Acme", ""), urls=items("a.test", "A.TEST", None), addresses=where), "emails": items("a@x", "A@X", "b@x", None), "phones": items("555", "5-55", "77", None)})

    groups = {g: rnd.randrange(1, 9) for g in range(12)}
    a = book(spark, *(one(f"g{g}", "google") for g in groups))
    b = book(spark, *(one(f"m{g}-{i}", "mac") for g, n in groups.items() for i in range(n)))
    from bookmerge.functions import contacts as C

    rows = C.as_struct(b, "b").withColumn("at", F.regexp_extract("b.contact_id", "^m([0-9]+)", 1)).withColumn("seq", F.regexp_extract("b.contact_id", "-([0-9]+)$", 1).cast("int") + 1)
    rows = rows.join(C.as_struct(a, "a").withColumn("at", F.regexp_extract("a.contact_id", "[0-9]+", 0)), "at")
    got = {(r["at"], r["seq"]): r["made"] for r in merge.merge_in_turn(rows).collect()}
    listed = {}
    for r in rows.select("at", "seq", "a", "b").collect():
        listed.setdefault(r["at"], []).append((r["seq"], r["a"], r["b"]))
    schema = f"at string, seq int, a {CONTACT_STRUCT}, bs array<{CONTACT_STRUCT}>"
    prefixes = spark.createDataFrame([(g, k, x[0][1], [y[2] for y in sorted(x, key=lambda y: y[0])[:k]]) for g, x in listed.items() for k in range(1, len(x) + 1)], schema)
    made = F.aggregate("bs", F.col("a").cast(CONTACT_STRUCT), lambda acc, c: merge.merge_sync(acc, c).cast(CONTACT_STRUCT))
    want = {(r["at"], r["seq"]): r["made"] for r in prefixes.select("at", "seq", made.alias("made")).collect()}
    assert len(got) == len(want) == sum(groups.values())
    assert all(got[k] == want[k] for k in want)


@pytest.mark.parametrize("most_rows", [linkage.MOST_ROWS, 0])
def test_linkage_equals_choice_in_order(spark, most_rows):
    """Groups settled by one task, and the same by rounds."""
    import random

    rnd = random.Random(7)
    left = [person(f"l{i:02}", pick, "Lee", rnd.choice([None, f"m{rnd.randrange(8)}@x.test"])) for i, pick in enumerate(rnd.choice(["Ann", "Bo"]) for _ in range(25))]
    right = [person(f"r{i:02}", rnd.choice(["Ann", "Bo"]), "Lee", rnd.choice([None, f"m{rnd.randrange(8)}@x.test"]), side="mac") for i in range(20)]
    used, want = set(), {}
    for a in left:
        mails = {e for e, _ in a["emails"]}
        cands = [b for b in right if mails & {e for e, _ in b["emails"]}] + [b for b in right if b["given_name"] == a["given_name"]]
        for b in cands:
            if b["contact_id"] not in used:
                used.add(b["contact_id"])
                want[a["contact_id"]] = b["contact_id"]
                break
    got = {r["left_id"]: r["right_id"] for r in linkage.link_fuzzy(book(spark, *left), book(spark, *right), most_rows).collect()}
    assert got == want


def test_phone_format_is_no_change(spark):
    rows = D.classify_mappings(spark.createDataFrame([("g", "m", None, None)], MAPPING), book(spark, person("g", "A", phone="+15551234567")), book(spark, person("m", "a", phone="+1 (555) 123-4567", side="mac")))
    assert rows.select(D.diff_fields(F.col("a"), F.col("b")).alias("d")).first()["d"] == []


def test_filtered_records_are_not_deleted(spark):
    left, right = book(spark, person("g", "A")), book(spark, person("other", "Z", side="mac"))
    mapping = spark.createDataFrame([("g", "m", None, None)], MAPPING)
    ids = spark.createDataFrame([("m",)], "id string")
    delete = lambda right_ids: D.diff_two_way(left, right, mapping, Settings(sync_deleted=True), right_ids=right_ids)[0].where("action = 'delete'").count()
    assert delete(None) == 1 and delete(ids) == 0


def test_merge_rules(spark):
    a = person("g", "", "Lee", "a@x.test", note="n", nickname="", phones=[("1-2", "home")], urls=[("X", "home")])
    b = person("m", "Ann", "Li", "A@x.test", side="mac", note="n", nickname="Nan", phones=[("12", "work"), ("3", "work"), ("3", "work")], urls=[("x", "home")])
    rows = D.classify_mappings(spark.createDataFrame([("g", "m", None, None)], MAPPING), book(spark, a), book(spark, b))
    one = lambda f: rows.select(f(F.col("a"), F.col("b")).alias("c")).select("c.*").first()
    sync, dedup, simple = one(merge.merge_sync), one(merge.merge_dedup), one(merge.merge_simple)
    assert (sync["given_name"], sync["nickname"], sync["note"], len(sync["phones"]), len(sync["urls"])) == ("Ann", "Nan", "n", 3, 1)
    assert (dedup["given_name"], dedup["nickname"], dedup["note"], len(dedup["urls"])) == ("Ann", "", "n\n---\nn", 2)
    assert (simple["given_name"], simple["note"], len(simple["emails"])) == ("", "n", 2)


def test_gates_come_in_order(spark):
    plan = spark.createDataFrame([("a", "delete", "macToGoogle", ["x"], None, "google", "g1", None), ("b", "merge", "twoWay", ["x"], None, "google", "g2", "m2"), ("c", "merge", "twoWay", ["x"], "merge", "google", "g3", "m3"), ("d", "add", "googleToMac", ["x"], None, "google", "g4", None)], "name string, action string, direction string, changes array<string>, user_override string, source string, left_id string, right_id string")
    ledger = spark.createDataFrame([("google:g1", 3, False), ("google:g4", 2, False)], "id string, failure_count int, ignored boolean")
    got = {r["name"]: r["outcome"] for r in A.with_outcomes(plan, ledger).collect()}
    assert got == {"a": "set_aside", "b": "deferred_merge", "c": "merged", "d": "added"}
    reviewed = {r["name"]: r["outcome"] for r in A.with_outcomes(plan, ledger.limit(0), reviewed=True).collect()}
    assert reviewed["a"] == "deleted" and reviewed["b"] == "deferred_merge"


def test_merged_pairs_converge(spark):
    left = book(spark, person("g", "Ann", "Lee", "a@x.test", job_title="Boss"))
    right = book(spark, person("m", "Ann", "Lee", "b@x.test", side="mac", job_title="Clerk"))
    mapping, s = spark.createDataFrame([("g", "m", None, None)], MAPPING), Settings(conflict="mergeBoth")
    plan = D.diff_two_way(left, right, mapping, s)[0]
    done = A.with_outcomes(plan, spark.createDataFrame([], "id string, failure_count int, ignored boolean"), s)
    left2, right2 = A.apply_books(done, left, right, settings=s)
    assert D.diff_two_way(left2, right2, mapping, s)[0].count() == 0
    assert {e["value"] for e in left2.first()["emails"]} == {"a@x.test", "b@x.test"}


def test_rollback_with_removal_restores_the_snapshot(spark):
    left, right = book(spark, person("g1", "Ann", urls=[("u", "home")])), book(spark, person("m1", "Bo", side="mac", urls=[]))
    shot = versions.snapshot_rows(left, right, "s", F.lit("2024-01-01").cast("timestamp"))
    now = book(spark, person("g1", "Changed"), person("g2", "New"))
    a, b, n = versions.rollback(shot, "s", now, right, "remove")
    assert [(r["contact_id"], r["given_name"]) for r in a.collect()] == [("g1", "Ann")] and b.count() == 1
    assert {tuple(r) for r in n.collect()} == {("google", "updated", 1), ("google", "removed", 1), ("mac", "updated", 1)}


def test_retention(spark):
    events = spark.range(1005).selectExpr("id", "timestamp_seconds(id) as timestamp")
    kept = logs.prune_events(events, 0, 1000, F.lit(None))
    assert kept.count() == 1000 and kept.agg(F.min("id")).first()[0] == 5


def test_ledger_events(spark):
    ledger = spark.createDataFrame([("a", 2, None, False), ("b", 1, None, False)], "id string, failure_count int, last_failed_at timestamp, ignored boolean")
    events = spark.sql("select * from values ('a', timestamp'2024-01-01', 1, 'failure'), ('b', timestamp'2024-01-01', 1, 'clear'), ('b', timestamp'2024-01-02', 2, 'failure'), ('c', timestamp'2024-01-01', 1, 'ignore') as t(id, timestamp, seq, kind)")
    got = {r["id"]: (r["failure_count"], r["ignored"]) for r in logs.apply_ledger_events(ledger, events).collect()}
    assert got == {"a": (3, False), "b": (1, False), "c": (0, True)}


def test_scan_needs_a_container(spark):
    df = spark.createDataFrame([("1", "c1"), ("2", "c2")], "identifier string, container_id string")
    boxes = spark.createDataFrame([("c1", "Gmail", "cardDAV"), ("c2", "Local", "local")], "id string, name string, type string")
    assert [r["identifier"] for r in people.scoped_scan(df, boxes).collect()] == ["2"]
    with pytest.raises(ValueError):
        people.scoped_scan(df, boxes.where("id = 'c1'"))


def test_export(spark, tmp_path):
    df = sinks.flat_export_left(book(spark, person("g", 'A "x", y', "Lee", "a@x.test", birthday=(None, 3, 7))))
    assert len(df.columns) == 33 and df.first()["Birthday"] == "03-07"
    sinks.write_csv(df, f"{tmp_path}/csv")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert '"A ""x"", y Lee"' in text and ",," in text


def test_batches(spark):
    changes = spark.range(450).selectExpr("'update' as kind", "lpad(cast(id as string), 4, '0') as id").unionByName(spark.sql("select 'create' as kind, 'one' as id"))
    etags = spark.range(440).selectExpr("lpad(cast(id as string), 4, '0') as id", "'e' as etag")
    got = {(r["kind"], r["chunk"], r["single"]): r["count"] for r in A.plan_batches(changes, etags).groupBy("kind", "chunk", "single").count().collect()}
    assert got == {("update", 0, False): 200, ("update", 1, False): 200, ("update", 2, False): 40, ("update", None, True): 10, ("create", None, True): 1}


def test_chunks_spread_over_tasks(spark):
    """Numbers run on through the ranges, and no task numbers a whole kind."""
    df = spark.range(3000).selectExpr("case when id < 2000 then 'create' when id < 2900 then 'update' else 'delete' end as kind", "lpad(cast(id * 7 % 3000 as string), 4, '0') as id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks of a small table as of a large one
    try:
        got = A.chunk(df, A.BATCH, shards=2).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3000 and len({r["part"] for r in got if r["kind"] == "create"}) > 1
    for kind, size in A.BATCH.items():
        for shard in (0, 1):
            own = sorted((r["id"], r["chunk"]) for r in got if (r["kind"], r["shard"]) == (kind, shard))
            assert [c for _, c in own] == [n // size for n in range(len(own))]
