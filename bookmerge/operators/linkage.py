"""Linking records without a mapping: one-to-one by email or name (J04), many-to-one by identity key (J05)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.functions import normalize as N
from bookmerge.operators.graph import clusters, durable
from bookmerge.operators.ranges import numbered

_BY_NAME = 1 << 30
#: Rows (a record and one of its keys) up to which a group of several connected keys is settled by one task.
MOST_ROWS = 500_000


def _link_keys(book: DataFrame) -> DataFrame:
    """(id, pos, key): emails in order, then the normalised given and family name; a key counts at its first place."""
    c = C.HERE
    name = N.normalize_full_name(c["given_name"], None, c["family_name"])
    mails = F.transform(C.values(F.col("emails")), lambda e, i: F.struct(i.alias("pos"), F.concat(F.lit("e:"), F.lower(N.non_blank(e))).alias("key")))
    named = F.array(F.struct(F.lit(_BY_NAME).alias("pos"), F.concat(F.lit("n:"), F.nullif(name, F.lit(""))).alias("key")))
    keys = book.select(F.col("contact_id").alias("id"), F.explode(F.concat(F.coalesce(mails, F.array().cast("array<struct<pos:int,key:string>>")), named)).alias("k"))
    return keys.select("id", "k.pos", "k.key").where("key is not null").groupBy("id", "key").agg(F.min("pos").alias("pos"))


def rank_candidates(left: DataFrame, right: DataFrame) -> DataFrame:  # W02
    """(left_id, right_id, rank, confidence): a left record's candidates by email order, then name, then right id.

    All pairs that share a key; ``link_fuzzy`` finds its links without them.
    """
    pairs = _link_keys(left).toDF("left_id", "key", "pos").join(_link_keys(right).select(F.col("id").alias("right_id"), "key"), "key")
    best = pairs.groupBy("left_id", "right_id").agg(F.min("pos").alias("pos"))
    w = W.partitionBy("left_id").orderBy("pos", "right_id")
    return best.select("left_id", "right_id", F.row_number().over(w).alias("rank"), _confidence().alias("confidence"))


def _confidence():
    return F.when(F.col("pos") == _BY_NAME, "nameOnly").otherwise("exactEmail")


def _first_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups in order (right records first, left ones by id and place): each left record takes the first free right one."""
    group, free, taken = None, {}, set()
    chooser, settled = None, False
    for batch in batches:
        out = []
        for g, is_left, i, pos, key in zip(*(batch.column(c).to_pylist() for c in ("group", "is_left", "id", "pos", "key")), strict=True):
            if g != group:
                group, free, taken, chooser = g, {}, set(), None
            if not is_left:
                free.setdefault(key, []).append(i)
                continue
            if i != chooser:
                chooser, settled = i, False
            if settled:
                continue
            queue = free.get(key, [])  # in descending order: the least id is last
            while queue and queue[-1] in taken:
                queue.pop()
            if queue:
                settled = True
                taken.add(queue[-1])
                out.append((i, queue.pop(), pos))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)], ["left_id", "right_id", "pos"])


def _in_rounds(keys: DataFrame) -> DataFrame:
    """(left_id, right_id, pos) for groups too large for a task: deferred acceptance, in which a right record prefers the least left id.

    In a round the left records that seek at a key, in order of id, meet the right ones that a lesser left record does not hold,
    place by place (those before are taken by lesser ones). A right record keeps the least of its proposers; the
    others seek again, and go on to their next key where none is left. The table of a round is as long as the left side.
    """
    places = W.partitionBy("id").orderBy("pos")
    left = durable(keys.where("is_left").select(F.col("id").alias("left_id"), "key", "pos", F.row_number().over(places).alias("step"), F.count("*").over(W.partitionBy("id")).alias("steps")))
    right = durable(keys.where(~F.col("is_left")).select(F.col("id").alias("right_id"), "key"))
    state = left.where("step = 1").select("left_id", "step", F.lit(None).cast("string").alias("right_id"))
    while True:
        state = durable(state)
        seeking = state.where("right_id is null").drop("right_id")
        if seeking.isEmpty():
            return state.join(left, ["left_id", "step"]).select("left_id", "right_id", "pos")
        held = state.where("right_id is not null").select("right_id", F.col("left_id").alias("holder"))
        seekers = numbered(seeking.join(left, ["left_id", "step"]), ["key"], "left_id", "place")
        wanted = seekers.groupBy("key").agg(F.min("left_id").alias("least"))
        open_ones = right.join(wanted, "key").join(held, "right_id", "left").where("holder is null or holder > least").select("key", "right_id")
        met = seekers.join(numbered(open_ones, ["key"], "right_id", "place"), ["key", "place"], "left")
        going_on = met.where("right_id is null and step < steps").select("left_id", (F.col("step") + 1).alias("step"), "right_id")
        rows = met.where("right_id is not null").select("left_id", "step", "right_id").unionByName(state.where("right_id is not null"))
        keeper = F.min("left_id").over(W.partitionBy("right_id"))
        state = rows.select("left_id", "step", F.when(F.col("left_id") == keeper, F.col("right_id")).alias("right_id")).unionByName(going_on)


def link_fuzzy(left: DataFrame, right: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:  # J04
    """(left_id, right_id, confidence): each left record in ascending id takes its first free candidate.

    Choices depend on each other only inside a group of keys that records connect. A key that no record connects to another
    is settled by itself: its left and right records, each in order of their ids, meet place by place (numbered in ranges, so a
    name of very many records spreads). Groups of several keys are found as clusters
    of keys and settled each by one task in one streamed pass, in order of the ids; those of more than ``most_rows``
    rows go through ``_in_rounds``. No table holds pairs.
    """
    side = lambda book, is_left: _link_keys(book).withColumn("is_left", F.lit(is_left))
    every = durable(side(left, True).unionByName(side(right, False)))
    common = every.groupBy("key").agg(F.bool_or("is_left").alias("l"), F.bool_and("is_left").alias("r")).where("l and not r").select("key")
    rows = durable(every.join(common, "key", "left_semi"))
    several = rows.groupBy("is_left", "id").agg(F.min("key").alias("one"), F.collect_set("key").alias("keys")).where(F.size("keys") > 1)
    edges = several.select("one", F.explode("keys").alias("other")).where("one <> other").distinct()
    group = clusters(edges, "one", "other").toDF("key", "group")
    rows = durable(rows.join(group, "key", "left"))
    placed = durable(numbered(rows.where("group is null").drop("group"), ["key", "is_left"], "id", "place"))
    met = placed.where("is_left").withColumnRenamed("id", "left_id").join(placed.where("not is_left").select("key", "place", F.col("id").alias("right_id")), ["key", "place"])
    rows = rows.where("group is not null")
    large = durable(rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > most_rows).select("group"))
    # Right records first and in descending order, so that the least free one is a list's last.
    order = ["group", "is_left", F.when(~F.col("is_left"), F.col("id")).desc(), "id", "pos"]
    small = rows.join(large, "group", "left_anti").repartition("group").sortWithinPartitions(*order).select("group", "is_left", "id", "pos", "key")
    found = [met.select("left_id", "right_id", "pos"), small.mapInArrow(_first_free, "left_id string, right_id string, pos int")]
    if not large.isEmpty():
        found.append(_in_rounds(rows.join(large, "group", "left_semi")))
    return durable(reduce(DataFrame.unionByName, found).select("left_id", "right_id", _confidence().alias("confidence")))


def link_identity(right: DataFrame, left: DataFrame) -> DataFrame:  # J05
    """(right_id, left_id): the first identity key of a right record that any left record has, then the least left id."""
    keys = lambda df, name: df.select(F.col("contact_id").alias(name), F.posexplode(C.identity_keys(C.HERE)).alias("pos", "key"))
    owner = keys(left, "left_id").groupBy("key").agg(F.min("left_id").alias("left_id"))
    hits = keys(right, "right_id").join(owner, "key")
    return hits.groupBy("right_id").agg(F.min_by("left_id", "pos").alias("left_id"))
