"""Survivorship: three merges with rules of their own, folds over groups, and executing merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookmerge.functions import arrays as X
from bookmerge.functions import contacts as C
from bookmerge.functions import normalize as N
from bookmerge.operators.graph import durable
from bookmerge.schemas import ADDRESS, ITEM

_SCALARS = ["given_name", "middle_name", "family_name", "name_prefix", "name_suffix", "nickname", "phonetic_given_name", "phonetic_middle_name", "phonetic_family_name", "organization", "department", "job_title"]
_IDS = ["google_resource_name", "mac_contact_identifier"]


def _filled(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & (a != ""), a).otherwise(b)


def _notes(a: Column, b: Column, sep: str) -> Column:
    return F.when(a.isNull() | b.isNull() | (a == b), F.coalesce(a, b)).otherwise(F.concat(a, F.lit(sep), b))


def merge_simple(a, b, prefer_other: bool = False) -> Column:  # O19
    """Non-null wins, even an empty text; collections unite as sets; the later modification stays."""
    choose = lambda f: F.coalesce(b[f], a[f]) if prefer_other else F.coalesce(a[f], b[f])
    out = {f: choose(f) for f in [*_SCALARS, "birthday", "photo_data", "photo_url"]}
    out |= {f: X.set_union(a[f], b[f]) for f in ("phones", "emails", "addresses", "urls")}
    return C.replaced(a, **out, note=_notes(a["note"], b["note"], "\n\n---\n\n"), last_modified=F.greatest(a["last_modified"], b["last_modified"]))


def _collections(a, b, url_key: Callable[[Column], Column]) -> dict[str, Column]:
    return {
        "phones": X.ordered_union(a["phones"], b["phones"], lambda x: N.digits_of(x["value"]), ITEM),
        "emails": X.ordered_union(a["emails"], b["emails"], lambda x: F.lower(x["value"]), ITEM),
        "addresses": X.ordered_union(a["addresses"], b["addresses"], N.normalize_address, ADDRESS, dedup_secondary=True),
        "urls": X.ordered_union(a["urls"], b["urls"], url_key, ITEM),
    }


def merge_dedup(a, b, now: Column | None = None) -> Column:  # O20
    """Primary a; non-empty wins for five texts, non-null for the others; notes join without comparison; no photo link."""
    filled = ("given_name", "middle_name", "family_name", "organization", "job_title")
    out = {f: _filled(a[f], b[f]) if f in filled else F.coalesce(a[f], b[f]) for f in [*_SCALARS, *_IDS]}
    notes = F.filter(F.array(a["note"], b["note"]), lambda n: n.isNotNull() & (n != ""))
    out |= {"birthday": F.coalesce(a["birthday"], b["birthday"]), "note": F.nullif(F.array_join(notes, "\n---\n"), F.lit("")), "photo_data": F.coalesce(a["photo_data"], b["photo_data"]), "photo_url": F.lit(None), "last_modified": now if now is not None else F.greatest(a["last_modified"], b["last_modified"])}
    return C.replaced(a, **out, **_collections(a, b, lambda x: x["value"]))


def merge_sync(a, b, now: Column | None = None) -> Column:  # O21
    """Primary a; non-empty wins for names and work fields; equal notes stay one; the photo link stays."""
    out = {f: F.coalesce(a[f], b[f]) if f.startswith("phonetic") else _filled(a[f], b[f]) for f in _SCALARS}
    out |= {f: F.coalesce(a[f], b[f]) for f in [*_IDS, "birthday", "photo_data", "photo_url"]}
    out |= {"note": _notes(a["note"], b["note"], "\n---\n"), "last_modified": now if now is not None else F.greatest(a["last_modified"], b["last_modified"])}
    return C.replaced(a, **out, **_collections(a, b, lambda x: F.lower(x["value"])))


_SYNC_LISTS = {"phones": (lambda x: N.digits_of(x["value"]), ITEM), "emails": (lambda x: F.lower(x["value"]), ITEM), "addresses": (N.normalize_address, ADDRESS), "urls": (lambda x: F.lower(x["value"]), ITEM)}
_SYNC_BREAK = "\n---\n"


def _note_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, seq, own, note), sorted: the rows whose note joins those before. The rule compares with all that stands so far, so it goes row by row; that is put together only where the lengths agree."""
    at, pieces, length = None, [], 0
    for batch in batches:
        out = []
        for key, seq, own, note in zip(*(batch.column(c).to_pylist() for c in ("at", "seq", "own", "note")), strict=True):
            if key != at:
                at, pieces = key, [] if own is None else [own]
                length = 0 if own is None else len(own)
            if note is None or (pieces and length == len(note) and _SYNC_BREAK.join(pieces) == note):
                continue
            length += len(note) + (len(_SYNC_BREAK) if pieces else 0)
            pieces.append(note)
            out.append((key, seq, note))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (batch.schema.field("at").type, batch.schema.field("seq").type, pa.string()), strict=True)], names=["at", "seq", "x"])


#: Rows of one ``at`` that a task completes, about; what all of them share travels once for each such block.
IN_TURN_BLOCK = 10_000


def merge_in_turn(rows: DataFrame, now: Column | None = None) -> DataFrame:  # O28
    """rows (at, seq from 1, a, b, more columns) with ``made``: ``merge_sync`` of a with the b of rows 1 to seq, one after the other; a is the same for an ``at``.

    No row holds the records before it, and no result moves. A text is the first filled one so far; a list has the elements whose key no
    record before their own has (the least seq of each key), and a note the pieces that the rule adds. All of these are gathered once an
    ``at``, with the seq from which a text stands and the running number of elements of a row, so a row is completed by a join that cuts its part from them.
    They are as long as the longest result, and go to each block of ``IN_TURN_BLOCK`` rows; results, which are quadratic together, are made where they are given out.
    """
    spark = rows.sparkSession
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    filled = lambda v: F.when(v != "", v)
    texts = [f for f in _SCALARS if not f.startswith("phonetic")]
    values = [*(f for f in _SCALARS if f.startswith("phonetic")), *_IDS, "birthday", "photo_data", "photo_url"]
    first = lambda f, v: F.min(F.when(v.isNotNull(), F.struct(F.col("seq").alias("seq"), v.alias("v")))).alias(f"first_{f}")
    whole = rows.groupBy("at").agg(F.max("seq").alias("__most"), *(first(f, filled(b(f))) for f in texts), *(first(f, b(f)) for f in values))
    added = []
    for f, (key, _) in _SYNC_LISTS.items():
        items = rows.select("at", "seq", F.posexplode(b(f)).alias("pos", "x")).withColumn("key", key(F.col("x")))
        own = rows.where("seq = 1").select("at", F.lit(0).alias("seq"), F.explode(a(f)).alias("x")).select("at", "seq", key(F.col("x")).alias("key"))
        owner = own.unionByName(items.select("at", "seq", "key")).where("key is not null").groupBy("at", "key").agg(F.min("seq").alias("owner"))
        kept = items.join(owner, ["at", "key"]).where("seq = owner").select("at", "seq", "pos", "x", "key")
        if f == "addresses":  # a key that repeats inside a record counts once
            kept = kept.groupBy("at", "seq", "key").agg(F.min_by("x", "pos").alias("x"), F.min("pos").alias("pos"))
        added.append((f, durable(kept.select("at", "seq", "pos", "x").unionByName(items.where("key is null").select("at", "seq", "pos", "x")))))
    notes = rows.select("at", "seq", F.when(F.col("seq") == 1, a("note")).alias("own"), b("note").alias("note")).repartition("at").sortWithinPartitions("at", "seq")
    pieces = durable(notes.mapInArrow(_note_pieces, f"at {rows.schema['at'].dataType.simpleString()}, seq {rows.schema['seq'].dataType.simpleString()}, x string"))
    added.append(("note", pieces.select("at", "seq", F.lit(0).alias("pos"), "x")))
    for f, new in added:
        all_f = F.transform(F.array_sort(F.collect_list(F.struct("seq", "pos", "x"))), lambda i: i["x"])
        whole = whole.join(new.groupBy("at").agg(all_f.alias(f"all_{f}")), "at", "left")
    whole = durable(whole.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor(F.col("__most") / IN_TURN_BLOCK).cast("int")))).drop("__most"))
    # Running numbers over narrow rows; the records themselves are not in a window.
    so_far = W.partitionBy("at").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    counts = reduce(DataFrame.unionByName, [new.select("at", "seq", F.lit(f).alias("f")) for f, new in added]).groupBy("at", "seq").agg(*(F.count_if(F.col("f") == f).cast("int").alias(f"n_{f}") for f, _ in added))
    narrow = rows.select("at", "seq", b("last_modified").alias("t")).join(counts, ["at", "seq"], "left")
    narrow = durable(narrow.select("at", "seq", F.max("t").over(so_far).alias("latest"), *(F.coalesce(F.sum(f"n_{f}").over(so_far), F.lit(0)).cast("int").alias(f"n_{f}") for f, _ in added)))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, int(whole.count())))
    full = rows.join(narrow, ["at", "seq"]).withColumn("block", F.floor(F.col("seq") / IN_TURN_BLOCK).cast("int"))
    full = full.repartition(parts, "at", "block").join(whole.repartition(parts, "at", "block").hint("merge"), ["at", "block"])
    standing = lambda f: F.when(F.col(f"first_{f}.seq") <= F.col("seq"), F.col(f"first_{f}.v"))
    cut = lambda f, t: F.slice(F.coalesce(f"all_{f}", F.array().cast(f"array<{t}>")), F.lit(1), F.col(f"n_{f}"))
    out = {f: F.coalesce(filled(a(f)), standing(f), b(f)) for f in texts}
    out |= {f: F.coalesce(a(f), standing(f)) for f in values}
    out["last_modified"] = now if now is not None else F.greatest(a("last_modified"), F.col("latest"))
    for f, (_, element) in _SYNC_LISTS.items():
        out[f] = F.concat(F.coalesce(a(f), F.array().cast(f"array<{element}>")), cut(f, element))
    own = F.array_compact(F.array(a("note")))
    some = a("note").isNotNull() | (F.col("n_note") > 0)
    note = F.when(some, F.array_join(F.concat(own, cut("note", "string")), _SYNC_BREAK))
    more = [c for c in rows.columns if c not in ("a", "b")]
    return full.select(*more, "a", "b", C.replaced(F.col("a"), **out, note=note).alias("made"))


def pick_primary(members: DataFrame) -> DataFrame:  # W04
    """The member (group, c) of each group with most data; ties go to the least id."""
    score = C.data_score(F.col("c"))
    rank = F.struct((-score).alias("score"), F.col("c.contact_id").alias("id"))
    return members.groupBy("group").agg(F.min_by("c", rank).alias("primary"))


_TEXTS = ("given_name", "middle_name", "family_name", "organization", "job_title")
_LISTS = {"phones": (lambda x: N.digits_of(x["value"]), ITEM), "emails": (lambda x: F.lower(x["value"]), ITEM), "addresses": (N.normalize_address, ADDRESS), "urls": (lambda x: x["value"], ITEM)}


def fold_merge(members: DataFrame) -> DataFrame:  # A11
    """(group, merged): members (group, c) folded by ``merge_dedup`` in order of data score, then id; a group is one entity's records.

    The fold as aggregates, which combine before the shuffle: a text is the first filled one, a list holds an element if no
    record before its own has the element's key. Only the lists of the result are gathered.
    """
    rank = F.struct((-C.data_score(F.col("c"))).alias("score"), F.col("c.contact_id").alias("id"))
    rows = members.select("group", rank.alias("rank"), "c")
    at = F.col("rank")

    def first(f: str, test: Column | None = None) -> Column:
        value = F.col(f"c.{f}")
        return F.min_by(value, F.when(value.isNotNull() if test is None else test, at))

    filled = lambda f: F.coalesce(first(f, F.col(f"c.{f}") != ""), F.max_by(F.col(f"c.{f}"), at))
    plain = [f for f in (*_SCALARS, *_IDS, "birthday", "photo_data") if f not in _TEXTS]
    notes = F.array_sort(F.collect_list(F.when(F.col("c.note") != "", F.struct(at, F.col("c.note").alias("note")))))
    joined = F.nullif(F.array_join(F.transform(notes, lambda x: x["note"]), "\n---\n"), F.lit(""))
    grouped = rows.groupBy("group").agg(
        F.count("*").alias("n"), *(filled(f).alias(f) for f in _TEXTS), *(first(f).alias(f) for f in plain), F.min_by("c.contact_id", at).alias("contact_id"), F.min_by("c.source", at).alias("source"),
        joined.alias("note"), F.max("c.last_modified").alias("last_modified"), F.min_by("c.note", at).alias("own_note"), F.min_by("c.photo_url", at).alias("own_url"),
    )
    for f, (key, element) in _LISTS.items():
        items = rows.select("group", "rank", F.posexplode(f"c.{f}").alias("pos", "x")).withColumn("key", key(F.col("x")))
        owner = items.groupBy("group", "key").agg(F.min("rank").alias("owner"), F.min(F.struct("rank", "pos")).alias("head"))
        kept = items.join(owner.withColumnsRenamed({"group": "g", "key": "k"}), F.col("group").eqNullSafe(F.col("g")) & F.col("key").eqNullSafe(F.col("k"))).where("rank = owner")
        if f == "addresses":  # repeats inside a record stay in the first record alone
            lead = rows.groupBy("group").agg(F.min("rank").alias("lead")).withColumnRenamed("group", "lead_group")
            kept = kept.join(lead, F.col("group").eqNullSafe(F.col("lead_group"))).where((F.col("rank") == F.col("lead")) | (F.struct("rank", "pos") == F.col("head")))
        lists = kept.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", "x"))), lambda i: i["x"]).alias(f)).withColumnRenamed("group", "list_group")
        grouped = grouped.join(lists, F.col("group").eqNullSafe(F.col("list_group")), "left").drop("list_group").withColumn(f, F.coalesce(f, F.array().cast(f"array<{element}>")))
    one = F.col("n") == 1
    note, photo_url = F.when(one, F.col("own_note")).otherwise(F.col("note")), F.when(one, F.col("own_url"))
    return grouped.select("group", C.replaced(C.HERE, note=note, photo_url=photo_url).alias("merged"))


def execute_merge(members: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:  # O18
    """(survivors, deletions, new mapping) for members (group, c): the primary takes the fold, the others go with their mappings.

    A survivor that carries both ids is mapped.
    """
    survivors = fold_merge(members).select("group", F.col("merged").alias("c"))
    gone = members.join(survivors.select("group", F.col("c.contact_id").alias("keep")), "group").where(F.col("c.contact_id") != F.col("keep")).select("group", F.col("c.contact_id").alias("contact_id"), F.col("c.source").alias("source"))
    dead = gone.select("contact_id").distinct()
    left = mapping.join(dead.toDF("google_resource_name"), "google_resource_name", "left_anti").join(dead.toDF("mac_contact_identifier"), "mac_contact_identifier", "left_anti")
    both = survivors.where("c.google_resource_name is not null and c.mac_contact_identifier is not null").select("c.google_resource_name", "c.mac_contact_identifier")
    fresh = both.select(*(F.col(f.name) if f.name in both.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in mapping.schema.fields))
    return survivors, gone, left.join(both.select("google_resource_name"), "google_resource_name", "left_anti").unionByName(fresh)
