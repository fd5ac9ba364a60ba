"""Hot keys, merges of very many records in turn, sessions by manifest and rollbacks that go on after a failure."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.operators import apply as A
from bookmerge.operators import matching, merge, versions
from bookmerge.operators import store as S
from bookmerge.schemas import CONTACT, CONTACT_TYPES, Settings
from bookmerge.sources import sinks
from tests.test_operators import MAPPING, book, person


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pairs_by_key(spark, block):
    """Whatever the blocks, every pair of a key once; ids in order within one table, from both sides across two."""
    rnd = random.Random(block)
    a = sorted({(f"i{rnd.randrange(60)}", rnd.choice(["hot", "hot", "hot", "k1", "k2", f"k{rnd.randrange(9)}"])) for _ in range(120)})
    b = sorted({(f"j{rnd.randrange(40)}", rnd.choice(["hot", "k1", "none"])) for _ in range(50)})
    ka, kb = spark.createDataFrame([*a, ("n", None)], "id string, key string"), spark.createDataFrame([*b, ("n", None)], "id string, key string")
    got = sorted(map(tuple, matching.pairs_by_key(ka, block=block).collect()))
    assert got == sorted((x, y) for (x, k), (y, q) in combinations(a, 2) if k == q)
    got = sorted(map(tuple, matching.pairs_by_key(ka, kb, block).collect()))
    assert got == sorted((x, y) for x, k in a for y, q in b if k == q)


def test_blocks_spread_one_key(spark):
    """20,000 records of one key: each pair of blocks is a key of its own, none holds over a four-hundredth of the rows, and all pairs are met."""
    keys = spark.range(20_000).select(F.col("id"), F.lit("P:office").alias("key"))
    pairs = matching.pairs_by_key(keys)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "at_a" in plan and "at_b" in plan
    assert pairs.count() == 20_000 * 19_999 // 2
    met = pairs.groupBy((F.col("id_a") / 1000).cast("int"), (F.col("id_b") / 1000).cast("int")).count()
    assert met.count() == 20 * 21 // 2 and met.agg(F.max("count")).first()[0] == 1_000_000


def test_blocks_of_one_key_are_bounded(spark):
    """Small blocks of a large key: rows that travel grow with the records, and the copies are not broadcast."""
    keys = spark.range(5_000).select(F.col("id"), F.lit("hot").alias("key"))
    pairs = matching.pairs_by_key(keys, block=8, keyed=True)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    blocked = next(line for line in plan.splitlines() if "at_a" in line and "Join" in line)
    assert "SortMergeJoin" in blocked
    assert pairs.groupBy("key").count().collect()[0][:] == ("hot", 5_000 * 4_999 // 2)


def test_records_alike_without_a_signal_are_no_candidates(spark):
    """Records of one name, organisation and address with contact data of their own have 30 points and no signal: none of their pairs is made."""
    place = dict(organization="Acme", addresses=[("1 Main St", "Town", "", "", "", None, "home")])
    ready = matching.prepared(book(spark, *(person(f"p{i:03}", "Ann", "Lee", f"u{i}@x.test", f"555123{i:04}", **place) for i in range(120))))
    assert matching.candidate_pairs(ready).count() == 0


def test_detection_by_profiles(spark, monkeypatch):
    """Profiles in small blocks give what scoring every pair gives, within and across, and clusters are those of the pairs."""
    from bookmerge.operators.graph import clusters

    monkeypatch.setattr(matching, "BLOCK", 3)
    rnd = random.Random(21)
    pick = lambda *xs: rnd.choice(xs)
    made = lambda t: book(spark, *(person(f"{t}{i:03}", pick("Jon", "John", "J"), pick("Smith", "Smithe"), pick(None, None, f"u{i % 9}@x.test", f"u{i % 9}+z@x.test"), pick(None, None, f"55512345{i % 7:02}", f"155512345{i % 7:02}"), nickname=pick(None, "jo"), organization=pick("Acme", "Beta"), addresses=[(pick("1 Main St", "2 Main St"), "Town", "", "", "", None, "home")]) for i in range(70)))
    one, two = made("p"), made("q")
    told = lambda df: sorted(tuple(r) for r in df.select("id_a", "id_b", "score", "effective", "verdict.reasoning").collect())
    every = matching.detect_within(one, mode="exhaustive")
    assert told(matching.detect_within(one)) == told(every) and len(told(every)) > 50
    assert {tuple(r) for r in matching.duplicate_clusters(one).collect()} == {tuple(r) for r in clusters(every).collect()}
    mapping = spark.createDataFrame([(f"p{i:03}", f"q{j:03}", None, None) for i in range(70) for j in (i, (i + 5) % 70)], MAPPING)
    found = matching.detect_across(one, two, mapping)
    assert told(found) == told(matching.detect_across(one, two, mapping, mode="exhaustive")) and found.count() > 50


def test_fanout_reaches_the_detectors(spark):
    """With the setting a phone of many records gives a star, without it all pairs; a calm one gives its pairs in both."""
    people = [person(f"p{i:02}", f"N{i}", f"F{i}", None, "5551230000") for i in range(12)] + [person(f"q{i}", f"Q{i}", f"R{i}", None, "5559990000") for i in range(3)]
    one = book(spark, *people)
    key = lambda df: {(r["id_a"], r["id_b"]) for r in df.select("id_a", "id_b").collect()}
    every, star = key(matching.detect_within(one)), key(matching.detect_within(one, Settings(max_key_fanout=5)))
    ids = [f"p{i:02}" for i in range(12)]
    calm = set(combinations([f"q{i}" for i in range(3)], 2))
    assert every == set(combinations(ids, 2)) | calm and star == {("p00", p) for p in ids[1:]} | calm
    none = spark.createDataFrame([], MAPPING)
    assert key(matching.detect_across(one, one, none, Settings(max_key_fanout=5))) >= {("p00", p) for p in ids}
    found = matching.detect_duplicates(one, one.limit(0), none, Settings(max_key_fanout=5))
    assert key(found) == star


def test_a_pair_of_simple_duplicates_comes_once(spark, monkeypatch):
    """Pairs that share a name and several emails come from the first of them: no table of pairs is made distinct, whatever the blocks; a repeated id is one record."""
    rnd = random.Random(5)
    mails = lambda: [(f"m{rnd.randrange(12)}@x", "home") for _ in range(rnd.randrange(4))]
    people = [person(f"p{i:02}", rnd.choice(["Ann", "ANN", "Bo", None]), f"F{rnd.randrange(4)}", emails=mails()) for i in range(60)]
    people.append({**people[0], "given_name": "Cy"})
    keys = {}
    for p in people:
        keys.setdefault(p["contact_id"], set()).update({e[0] for e in p["emails"]} | ({(p["given_name"].lower(), p["family_name"].lower())} if p["given_name"] else set()))
    want = sorted((x, y) for x, y in combinations(sorted(keys), 2) if keys[x] & keys[y])
    for block, a_task in ((1000, 1_000_000), (3, 1_000_000), (3, 10)):
        monkeypatch.setattr(matching, "PAIRS_A_TASK", a_task)
        monkeypatch.setattr(matching.pairs_by_key, "__defaults__", (None, block, False))
        pairs = matching.simple_duplicates(book(spark, *people))
        assert "Aggregate [id_a" not in pairs._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, pairs.collect())) == want


def test_tables_of_pairs_and_keys_are_not_broadcast(spark):
    """Written pairs and keys are a few bytes a row, so Spark would take them for small and gather them in the driver; a kept pair goes whichever id comes first."""
    from bookmerge.operators.graph import durable

    joins = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line or "BroadcastExchange" in line]
    pairs = durable(spark.range(200_000).select(F.format_string("people/c%06d", F.col("id") % 500).alias("id_a"), F.format_string("people/c%06d", 500 + F.floor(F.col("id") / 500)).alias("id_b")))
    kept = pairs.where("id_a >= 'people/c000003'").select(F.concat_ws("<>", "id_a", "id_b").alias("pair_key"))
    rest = matching.suppress_pairs(pairs, kept)
    assert joins(rest) and all("SortMergeJoin" in j for j in joins(rest))
    assert rest.count() == 1200 and set(rest.columns) == {"id_a", "id_b", "pair_key"} and rest.where("id_a >= 'people/c000003'").isEmpty()
    turned = matching.suppress_pairs(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), F.lit(1).alias("more")), kept)
    assert all("SortMergeJoin" in j for j in joins(turned)) and turned.count() == 1200 and turned.agg(F.sum("more")).first()[0] == 1200

    keys = durable(spark.range(200_000).select(F.format_string("people/c%06d", "id").alias("id"), F.floor(F.col("id") / 2).alias("key")))
    for other, n in ((None, 100_000), (keys, 400_000)):
        met = matching.pairs_by_key(keys, other)
        assert joins(met) and all("SortMergeJoin" in j for j in joins(met)) and met.count() == n


@pytest.mark.parametrize("most", [0, 10_000])
def test_records_of_passing_profiles(spark, monkeypatch, most):
    """Only a counted, bounded table of profiles is broadcast to the records, and beyond the bound none; the pairs are the same."""
    monkeypatch.setattr(matching, "MOST_BROADCAST", most)
    rnd = random.Random(8)
    pick = lambda *xs: rnd.choice(xs)
    made = lambda t: book(spark, *(person(f"{t}{i:02}", pick("Jon", "John"), pick("Smith", "Smithe"), pick(None, None, f"u{i % 9}@x.test"), None, organization=pick("Acme", "Beta"), addresses=[("1 Main St", "Town", "", "", "", None, "home")]) for i in range(40)))
    one, two = made("p"), made("q")
    none = spark.createDataFrame([("p01", "q01", None, None)], MAPPING)
    told = lambda df: sorted(tuple(r) for r in df.select("id_a", "id_b", "score", "effective").collect())
    for found, every in ((matching.detect_within(one), matching.detect_within(one, mode="exhaustive")), (matching.detect_across(one, two, none), matching.detect_across(one, two, none, mode="exhaustive"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == (2 if most else 0)
        assert told(found) == told(every) and len(told(every)) > 50


def test_groups_without_pairs(spark):
    """Groups of simple duplicates are the components of their pairs."""
    from bookmerge.operators.graph import clusters

    rnd = random.Random(3)
    one = book(spark, *(person(f"p{i:03}", rnd.choice(["Ann", "ann", "Bo", "Cy"]), f"F{rnd.randrange(12)}", rnd.choice([None, f"m{rnd.randrange(30)}@x"])) for i in range(80)))
    told = lambda df: {(r["id"], r["cluster"]) for r in df.collect()}
    assert told(matching.simple_duplicate_groups(one)) == told(clusters(matching.simple_duplicates(one)))


def test_very_many_records_merge_in_turn(spark):
    """100,000 right records of one office phone merge into one left record: the last has what all gave, each the texts of those before."""
    n = 100_000
    b = spark.range(n).select((F.col("id") + 1).cast("int").alias("seq"), F.struct(*(c.cast(CONTACT_TYPES[f]).alias(f) for f, c in {f: F.lit(None) for f in CONTACT_TYPES} .items() if f not in ("contact_id", "family_name", "nickname", "phones", "emails")), F.concat(F.lit("m"), F.col("id").cast("string")).alias("contact_id"), F.when(F.col("id") >= 10, F.concat(F.lit("F"), F.col("id").cast("string"))).alias("family_name"), F.when(F.col("id") % 2 == 0, "").otherwise("x").alias("nickname"), F.array(F.struct(F.lit("555-1234").alias("value"), F.lit("work").alias("label"))).alias("phones"), F.array(F.struct(F.concat(F.lit("a"), (F.col("id") % 5).cast("string")).alias("value"), F.lit("work").alias("label"))).alias("emails")).alias("b"))
    b = b.select("seq", F.struct(*(F.col(f"b.{f}") for f in CONTACT_TYPES)).alias("b"))
    a = C.as_struct(book(spark, person("g", "Ann", "", "own", "5551234")), "a")
    made = merge.merge_in_turn(b.join(a).select(F.lit("g").alias("at"), "seq", "a", "b")).select("seq", "made.*")
    assert made.agg(F.count("*"), F.count_if(F.col("given_name") == "Ann"), F.count_distinct("contact_id"), F.max(F.size("phones")), F.max(F.size("emails"))).first()[:] == (n, n, 1, 1, 6)
    told = {r["seq"]: r for r in made.where(F.col("seq").isin(1, 10, 11, n)).collect()}
    assert [told[s]["family_name"] for s in (1, 10, 11, n)] == [None, None, "F10", "F10"]
    assert [told[s]["nickname"] for s in (1, n)] == ["", "x"]
    assert [e["value"] for e in told[n]["emails"]] == ["own", "a0", "a1", "a2", "a3", "a4"] and [e["value"] for e in told[1]["emails"]] == ["own", "a0"]


def test_results_in_turn_are_not_moved(spark, monkeypatch):
    """Merged records are completed in blocks of rows, last of all: no window holds a result and none is shuffled. A repeated plan row counts twice, the last merge into a right record stays."""
    monkeypatch.setattr(merge, "IN_TURN_BLOCK", 2)
    notes = [None, "x", "own", "own\n---\nx", "own\n---\nx\n---\nown", None, "y"]
    left = book(spark, person("g", "", "", "own@x", note="own"), person("h", "Hal", "", "h@x"))
    right = book(spark, *(person(f"m{i}", "" if i < 3 else f"N{i}", "", f"{i // 2}@x", side="mac", note=n) for i, n in enumerate(notes)))
    plan = "action string, user_override string, source string, changes array<string>, left_id string, right_id string, outcome string"
    rows = [("merge", "merge", "google", ["x"], g, m, "merged") for g, m in [*(("g", f"m{i}") for i in range(7)), ("g", "m3"), ("h", "m0")]]
    a, b = A.apply_books(spark.createDataFrame(rows, plan), left, right, settings=Settings(sync_notes=True))
    told = lambda df: {r["contact_id"]: (r["given_name"], [e["value"] for e in r["emails"]], r["note"]) for r in df.collect()}
    want, name, mails, note, order = {}, "", ["own@x"], "own", [0, 1, 2, 3, 3, 4, 5, 6]
    for i in order:
        name = name or ("" if i < 3 else f"N{i}")
        mails = mails + [m for m in [f"{i // 2}@x"] if m not in mails]
        note = note if notes[i] is None or notes[i] == note else f"{note}\n---\n{notes[i]}"
        want[f"m{i}"] = (name, mails, note)
    assert told(a) == {"g": want["m6"], "h": ("Hal", ["h@x", "0@x"], None)}
    assert told(b) == {**want, "m0": ("Hal", ["h@x", "0@x"], None)}
    text = b._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "all_emails" in text


def test_a_stale_plan_meets_the_current_records(spark):
    """The left record was edited, and another one deleted, after the plan was made."""
    plan = "action string, user_override string, source string, changes array<string>, left_id string, right_id string, outcome string"
    rows = [("merge", "merge", "google", ["x"], g, m, "merged") for g, m in (("g1", "m1"), ("g1", "m2"), ("g2", "m3"))]
    left = book(spark, person("g1", "Edited", "", "new@x"))
    right = book(spark, *(person(f"m{i}", f"R{i}", f"F{i}", f"{i}@x", side="mac") for i in (1, 2, 3)))
    a, b = A.apply_books(spark.createDataFrame(rows, plan), left, right)
    told = lambda df: {r["contact_id"]: (r["given_name"], r["family_name"], [e["value"] for e in r["emails"]]) for r in df.collect()}
    assert told(a) == {"g1": ("Edited", "F1", ["new@x", "1@x", "2@x"])}
    assert told(b) == {"m1": ("Edited", "F1", ["new@x", "1@x"]), "m2": ("Edited", "F1", ["new@x", "1@x", "2@x"]), "m3": ("R3", "F3", ["3@x"])}


def _snapshot(spark, name, *people):
    rows = versions.snapshot_rows(book(spark, *people), book(spark).limit(0), name, F.lit("2024-01-01").cast("timestamp"))
    return versions.number_versions(rows.withColumn("position", F.lit(0)))


def test_sessions_appear_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    kept = sinks.SessionStore(spark, f"{tmp_path}/s")
    assert kept.summaries().count() == kept.highest().count() == kept.bodies(versions.BODY).count() == 0
    one = _snapshot(spark, "s 1/x", person("g1", "Ann"), person("g2", "Bo"))
    with monkeypatch.context() as m:
        m.setattr(S, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.write(one)
    assert kept.summaries().count() == kept.highest().count() == kept.bodies(versions.BODY).count() == 0
    kept.write(one)
    kept.write(one)  # the same session again
    kept.write(_snapshot(spark, "s2", person("g1", "Cy")).withColumn("version_number", F.lit(7)))
    assert {(r["session_id"], r["version_count"], r["google_count"], r["mac_count"]) for r in kept.summaries().collect()} == {("s 1/x", 2, 2, 0), ("s2", 1, 1, 0)}
    assert {(r["contact_identifier"], r["version_number"]) for r in kept.highest().collect()} == {("g1", 7), ("g2", 1)}
    assert sorted(r["n"] for r in kept.bodies(versions.BODY).select(F.col("data.given_name").alias("n")).collect()) == ["Ann", "Bo", "Cy"]
    kept.retain(1)
    assert [r["session_id"] for r in kept.summaries().collect()] == ["s2"] and kept.bodies(versions.BODY).count() == 1


def test_rollback_goes_on_where_it_failed(spark, tmp_path, monkeypatch):
    """The safety session holds the books of the first start; a second start does not write it again; failed records stay as they live."""
    kept = sinks.SessionStore(spark, f"{tmp_path}/s")
    kept.write(_snapshot(spark, "s1", person("g1", "Old", urls=[("u", "home")]), person("g2", "Gone", urls=[("u", "home")]), person("g3", "Bad", urls=[("u", "home")])))
    now, right = book(spark, person("g1", "New"), person("g3", "Stays"), person("g4", "Extra"), person("g5", "Extra")), book(spark).limit(0)
    failed = spark.createDataFrame([("google", "g3"), ("google", "g5"), ("mac", "g1")], "source string, contact_identifier string")
    at = F.lit("2024-02-01").cast("timestamp")
    with monkeypatch.context() as m:
        m.setattr(versions, "rollback", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            versions.run_rollback(kept, f"{tmp_path}/r", "s1", now, right, at, "remove", failed)
    safe = lambda: sorted(tuple(r) for r in kept.bodies(versions.BODY).where("session_id = 'safety-s1'").select("contact_identifier", "data.given_name", "version_number").collect())
    assert safe() == [("g1", "New", 2), ("g3", "Stays", 2), ("g4", "Extra", 1), ("g5", "Extra", 1)]
    left, _, tally = versions.run_rollback(kept, f"{tmp_path}/r", "s1", now, right, at, "remove", failed)
    assert sorted((r["contact_id"], r["given_name"]) for r in left.collect()) == [("g1", "Old"), ("g2", "Gone"), ("g3", "Stays"), ("g5", "Extra")]
    assert {tuple(r) for r in tally.collect()} == {("google", "updated", 1), ("google", "recreated", 1), ("google", "removed", 1), ("google", "failed", 2)}
    again = versions.run_rollback(kept, f"{tmp_path}/r", "s1", left, right, at, "remove", failed)[2]  # all steps are published: nothing is written
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in tally.collect()} and len(safe()) == 4
    back, *_ = versions.rollback(kept.bodies(versions.BODY), "safety-s1", left, right, "remove")
    assert {r["contact_id"] for r in back.collect()} == {"g1", "g3", "g4", "g5"}
    assert set(CONTACT_TYPES) == set(left.columns) and CONTACT


def _greedy(left, right):
    """Each left record in ascending id takes its first free candidate: by the order of its keys, then by right id."""
    taken, out = set(), {}
    for i, keys in sorted(left.items()):
        for k in keys:
            free = [j for j, own in sorted(right.items()) if k in own and j not in taken]
            if free:
                out[i] = free[0]
                taken.add(free[0])
                break
    return out


def _random_book(rnd, n, n_mails, side):
    """Ids to keys: up to two emails, then a name that many share."""
    return {f"{side}{i:04}": [*dict.fromkeys(f"m{rnd.randrange(n_mails)}@x" for _ in range(rnd.randrange(3))), f"name {rnd.choice('abcdefgh')}"] for i in range(n)}


@pytest.mark.parametrize("most_rows", [0, 10**6])
def test_links_of_random_books(spark, monkeypatch, most_rows):
    """Greedy links of books whose keys hang together, by one pass and by rounds. Rounds are fewer than records, but not few: 28 for these."""
    from bookmerge.operators import linkage

    rnd = random.Random(9)
    left, right = _random_book(rnd, 250, 220, "g"), _random_book(rnd, 230, 220, "m")
    rounds = []
    write = linkage.durable

    def counted(df):
        if df.columns == ["left_id", "step", "right_id"]:
            rounds.append(1)
        return write(df)

    monkeypatch.setattr(linkage, "durable", counted)
    made = lambda book_, side: book(spark, *(person(i, "Name", k[-1].split()[1], side=side, emails=[(m, "work") for m in k[:-1]]) for i, k in book_.items()))
    got = {r["left_id"]: r["right_id"] for r in linkage.link_fuzzy(made(left, "google"), made(right, "mac"), most_rows).collect()}
    assert got == _greedy(left, right)
    assert len(rounds) < len(left) / 4


def test_single_keys_meet_place_by_place(spark):
    """Names that nothing connects, one of them very common: the k-th left record takes the k-th right one."""
    from bookmerge.operators import linkage

    rnd = random.Random(1)
    left = {f"g{i:03}": [f"name {rnd.choice('aaaab')}"] for i in range(60)}
    right = {f"m{i:03}": [f"name {rnd.choice('aaabbc')}"] for i in range(50)}
    made = lambda book_, side: book(spark, *(person(i, "Name", k[0].split()[1], side=side) for i, k in book_.items()))
    got = {(r["left_id"], r["right_id"], r["confidence"]) for r in linkage.link_fuzzy(made(left, "google"), made(right, "mac")).collect()}
    assert got == {(i, j, "nameOnly") for i, j in _greedy(left, right).items()}
