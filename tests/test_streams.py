"""Streams over several files against plain versions."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bookmerge.operators.store import KeyedStore, names, published
from bookmerge.streaming import jobs, runs

START = datetime.datetime(2024, 1, 1)


def test_strikes_of_files_in_any_order(spark, tmp_path, monkeypatch):
    """One file a micro-batch, the latest events first, a third of them of one user."""
    monkeypatch.setattr(runs, "FILES", 1)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 0, 0, *range(1, 9)]), START + datetime.timedelta(minutes=rnd.randrange(2_000)), rnd.choice(["error", "error", "error", "view"])) for i in range(600)]
    rows.sort(key=lambda r: r[2], reverse=True)
    for k in range(0, 600, 150):
        spark.createDataFrame(rows[k : k + 150], "event_id long, user_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    seen = []
    step = KeyedStore.step
    monkeypatch.setattr(KeyedStore, "step", lambda self, rows, n: (seen.append(n), step(self, rows, n))[1])
    want = defaultdict(int)
    for _, user, _, kind in sorted(rows, key=lambda r: (r[2], r[0])):
        want[user] = want[user] + 1 if kind == "error" else 0
    got = {(r["key"], r["strikes"], r["skip"]) for r in runs.strikes(spark, str(tmp_path)).collect()}
    assert got == {(f"mac:{u}", n, int(n >= 3)) for u, n in want.items()}
    assert len(set(seen)) == 4


@pytest.mark.parametrize("cut", [8, 20, 40])
def test_strike_kinds(spark, tmp_path, cut):
    """Parts of batches, in any order, give what one pass in order gives; a null key is a key."""
    rnd = random.Random(cut)
    events = [(rnd.choice(["a", "b", "c", "d", None]), START + datetime.timedelta(seconds=rnd.randrange(20)), i, rnd.choice(["failure", "failure", "ignore", "success", "clear", "retry"])) for i in range(40)]
    want = {}
    for key, _, _, kind in sorted(events, key=lambda e: e[1:3]):
        count, ignored = want.get(key, (0, False))
        want[key] = (count + 1, ignored) if kind == "failure" else (count, True) if kind == "ignore" else (0, False)
    store = lambda fold: KeyedStore(spark, f"{tmp_path}/store", jobs.STRIKES, "key", fold, 4)
    run = jobs.strike_batches(store)
    for k in range(0, 40, cut):
        batch = spark.createDataFrame(events[k : k + cut], "key string, timestamp timestamp, seq long, kind string")
        run(batch, k)
        run(batch, k)  # a repeated micro-batch changes nothing
    assert {r["key"]: (r["strikes"], r["skip"]) for r in jobs.strike_totals(store(jobs.strike_fold()).read()).collect()} == {k: (n, n >= 3 or ig) for k, (n, ig) in want.items()}


def test_state_of_a_cleared_key_goes(spark, tmp_path):
    """With a limit of age a reset without marks is forgotten once its bucket meets a later time; marks stay."""
    store = lambda fold: KeyedStore(spark, f"{tmp_path}/store", jobs.STRIKES, "key", fold, 1)
    run = jobs.strike_batches(store, "1 hour")
    at = lambda m: START + datetime.timedelta(minutes=m)
    schema = "key string, timestamp timestamp, seq long, kind string"
    run(spark.createDataFrame([("gone", at(0), 1, "failure"), ("gone", at(1), 2, "success"), ("held", at(0), 3, "clear"), ("held", at(1), 4, "failure")], schema), 0)
    assert store(jobs.strike_fold()).read().count() == 3
    run(spark.createDataFrame([("late", at(90), 5, "success"), ("held", at(89), 6, "failure")], schema), 1)
    left = store(jobs.strike_fold()).read()
    assert {r["key"] for r in left.collect()} == {"held", "late"}
    assert {r["key"]: r["strikes"] for r in jobs.strike_totals(left).collect()} == {"held": 2, "late": 0}
    run(spark.createDataFrame([], schema), 2)


def test_feed_of_batches_in_any_order(spark, tmp_path, monkeypatch):
    """One file a micro-batch, the latest first: the book keeps the last event of each user."""
    monkeypatch.setattr(runs, "FILES", 1)
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, 0, *range(1, 40)]), START, f"t{i}") for i in range(400)]
    for k in range(300, -1, -100):
        spark.createDataFrame(rows[k : k + 100], "event_id long, user_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in runs.feed(spark, str(tmp_path)).collect()} == {(u, f"t{i}", i) for u, i in {u: i for i, u, *_ in rows}.items()}


def test_store_writes_touched_buckets_alone(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", "key long, v string, seq long", "key", jobs.latest_fold("key", "seq"), 8)
    put = lambda n, *rows: store.step(spark.createDataFrame(rows, "key long, v string, seq long, extra string"), n)
    assert store.read().count() == 0
    assert put(0, *((k, "a", 10, "x") for k in range(100))) == 8
    before = published(spark, f"{tmp_path}/s/manifest.json")["files"]
    assert put(1, (5, "b", 11, "x"), (5, "old", 3, "x")) == 1
    after = published(spark, f"{tmp_path}/s/manifest.json")["files"]
    assert sum(before[b][-1] != after[b][-1] for b in before) == 1
    assert put(1, (6, "c", 12, "x")) == 0 and put(0, (6, "c", 12, "x")) == 0  # repeated steps
    again = KeyedStore(spark, f"{tmp_path}/s", "key long, v string, seq long", "key", jobs.latest_fold("key", "seq"), 64)  # the number of buckets is the store's
    assert {r["key"]: r["v"] for r in again.read().collect()} == {k: "b" if k == 5 else "a" for k in range(100)}
    for n in range(2, 6):
        put(n, (5, f"v{n}", 20 + n, "x"))
    assert max(len(v) for v in published(spark, f"{tmp_path}/s/manifest.json")["files"].values()) <= KeyedStore.KEPT
    assert {r["v"] for r in again.read().where("key = 5").collect()} == {"v5"}


def test_failed_step_leaves_the_table(spark, tmp_path, monkeypatch):
    """Files without a manifest that names them are not read."""
    store = KeyedStore(spark, f"{tmp_path}/s", "key long, v string, seq long", "key", jobs.latest_fold("key", "seq"), 2)
    rows = lambda v, n: spark.createDataFrame([(1, v, n)], "key long, v string, seq long")
    store.step(rows("a", 1), 0)
    from bookmerge.operators import store as S

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(S, "publish", fails)
        with pytest.raises(OSError):
            store.step(rows("b", 2), 1)
    assert [r["v"] for r in store.read().collect()] == ["a"]
    store.step(rows("b", 2), 1)
    assert [r["v"] for r in store.read().collect()] == ["b"]


DAY = datetime.timedelta(days=1)


@pytest.mark.parametrize(("ages", "days", "most", "left"), [((40, 10, 1), 30, 1000, 2), ((400, 1), 0, 1000, 2), (tuple(range(19, -1, -1)), 0, 5, 5), ((40, *range(10)), 30, 5, 5)])
def test_audit_retention(spark, tmp_path, ages, days, most, left):
    """Limits of age and number over the stream's log, whose old days leave the folder; a repeated micro-batch is logged once."""
    now = START + 500 * DAY
    rows = [(i, "change.update", now - a * DAY) for i, a in enumerate(ages)]
    run = jobs.audit_batches(spark, f"{tmp_path}/log", days, lambda _: F.lit(now))
    for n, part in enumerate((rows[::2], rows[1::2])):
        for _ in range(2):
            run(spark.createDataFrame(part, runs.AUDIT), n)
    got = jobs.audit_rows(spark, f"{tmp_path}/log", runs.AUDIT, days, most, F.lit(now)).collect()
    want = sorted((r for r in rows if not days or r[2] >= now - days * DAY), key=lambda r: r[2])[-most:]
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in want) and len(got) == left
    kept = {n for n in names(spark, f"{tmp_path}/log") if n.startswith("day=")}
    assert len(kept) == len({a for a in ages if not days or a <= days})


def test_audit_of_a_late_day(spark, tmp_path):
    """An event older than the limit is dropped in the trigger that brings it."""
    run = jobs.audit_batches(spark, f"{tmp_path}/log", 2, lambda _: F.lit(START))
    run(spark.createDataFrame([(1, "x", START - 9 * DAY)], runs.AUDIT), 0)
    assert not [n for n in names(spark, f"{tmp_path}/log") if n.startswith("day=")]
    assert jobs.audit_rows(spark, f"{tmp_path}/none", runs.AUDIT, 2, None, F.lit(START)).count() == 0


def test_bursts_are_whole(spark):
    """The stream alone gives the bursts of the batch twin; those open at its end are flushed by the clock."""
    from bookmerge.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert sorted(map(tuple, QUERIES["stream_bursts"](spark, sf).collect())) == sorted(map(tuple, QUERIES["coalesce_bursts"](spark, sf).collect()))
