"""N-gram Jaccard join: size-aware heavy-light join over 5-word shingle sets, and the classes of its links.

Two documents link when 100 * |A & B| >= 80 * |A | B|. Documents of one set form a class first (by hash
of the set), so copies cost one member. Small (light) sets enumerate all subsets of the least overlap
that a partner of their size can have; larger (heavy) sets are found through inverted lists of their
prefix: the 20 % of a set that come first in one global order, which any partner must meet. The
boundary between the two is the size at which the summed cost (keys to write, postings to scan) is
least. The order puts rare shingles first by a count sketch of all documents (fixed size, read by how far a counter
stands above the usual load; it steers cost, never results), so a passage that many documents share is hardly ever a key.

A list of k members is not k * k pairs. Links only have to join a list's members: every list compares its members
with a hub first; members of long lists whose labels (component so far) still differ from those of a few random
hubs are compared with these; last, every pair of members with different labels. Pairs inside one
component are skipped, since they can't change it; all others are compared, so the components are those
of all links. In lists up to ``LONG`` members these are rows of pairs; longer lists (those with the same
commonest label become one group) are compared in blocks of hashed sets, cut by size first: a block holds about ``BLOCK`` hashes
and members at most of one class of sizes, and meets those of its own and the next classes, each by one
product of two 0/1 matrices, which yields links alone. Pairs that fail the size or position bound (with the shingle's place in
both orders) can't link and are dropped. Candidate texts are written once; pairs are verified on
whole sets. Keys that the sketch calls heavy are salted over partitions; hubs are found by aggregation.

After Deng, Tao, Li, "Overlap set similarity joins with theoretical guarantees" (SIGMOD 2018), with the
position bound of Xiao et al., "Efficient similarity joins for near duplicate detection" (2008).
Classes are told apart by a 64-bit hash of the set and its size; words and shingles by 64-bit hashes.

``jaccard_classes`` gives components; ``jaccard_links`` gives every link between classes, also inside a component, and
``link_counts`` the number of links of each document.

Edge cases: a null text or one without words has an empty set and links with nothing, not even another
empty one; a null doc_id counts as the least id; rows that share a doc_id count as one document for
component_id, each with its own set; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import NULL_ID, id_back, id_or_least, in_pieces, pick, read, written
from bookmerge.llm.components import connected_components
from bookmerge.llm.shingles import shingle_sets

#: Counters of the sketch, as a power of two (16 bits each when broadcast).
SKETCH_BITS = 23
CHUNK = 1 << 16
#: Sizes up to which a set's cost as a light or a heavy one is counted (the number of its subsets grows without bound far below).
LARGEST_LIGHT = 30
#: Postings by the sketch from which a key is salted, and to which share a salt is cut.
HEAVY = 4096
#: Members from which a list is long; random hubs of a long list.
LONG, HUBS = 256, 4
#: Hashes, and members, of a block.
BLOCK, BLOCK_MEMBERS = 1 << 16, 128
#: Keys of a partition.
PART_KEYS = 2_000_000
PERCENT = 80
#: Pairs (24 bytes each) up to which their table is broadcast; more are joined by shuffles.
MAX_BROADCAST = 250_000


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Least intersection with which sets of n and m elements link."""
    return -(-percent * (n + m) // (100 + percent))


def smallest_partner(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - smallest_partner(n, percent) + 1


def light_tags(n: int, light: int) -> range:
    """Sizes of the smaller set of a pair under which a set of n elements writes subset keys."""
    return range(smallest_partner(n), min(n, light) + 1)


def subset_keys(hashes: np.ndarray, light: int) -> set[int]:
    keys = set()
    for tag in light_tags(len(hashes), light):
        for subset in itertools.combinations(hashes.tolist(), least_overlap(tag, tag)):
            keys.add(xxhash.xxh3_64_intdigest(np.array([tag, *subset], np.uint64).tobytes()) - (1 << 63))
    return keys


def n_subset_keys(n: int, light: int) -> int:
    return sum(math.comb(n, least_overlap(t, t)) for t in light_tags(n, light))


def class_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


_FIRST = ["kind", "d", "n", "class", "small", "chunk", "counts"]
_FIRST_TYPES = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a document; kind 1: a chunk of the task's sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        out = []
        for d, hashes in zip(batch.column("d").to_pylist(), shingle_sets(batch.column("text").cast(pa.binary()).to_pylist()), strict=True):
            n = len(hashes)
            out.append((0, d, n, class_of(hashes) if n else None, hashes.tobytes() if 0 < n <= LARGEST_LIGHT else None, None, None))
            np.add.at(sketch, slots(hashes), 1)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FIRST_TYPES, strict=True)], _FIRST)
    for k in range(len(sketch) // CHUNK):
        part = sketch[k * CHUNK : (k + 1) * CHUNK]
        if part.any():
            row = (1, None, None, None, None, k, zlib.compress(np.minimum(part, 0xFFFF).astype("<u2").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _FIRST_TYPES, strict=True)], _FIRST)


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of chunk; a running sum for each."""
    at, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    for batch in batches:
        for k, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if k != at:
                if at is not None:
                    yield row()
                at, total = k, np.zeros(CHUNK, np.int64)
            total += np.frombuffer(zlib.decompress(raw), "<u2")
    if at is not None:
        yield row()


def standing_out(counts: np.ndarray) -> np.ndarray:
    """By how much each counter stands above the usual load of one (what chance puts into it), up to 16 bits.

    So the order and the boundary mean the same however many shingles share a counter: at 10^13 shingles chance spreads a counter by about a thousand.
    """
    return np.clip(counts - int(np.median(counts)), 0, 0xFFFF).astype(np.uint16)


def _costs(sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, scan = sketch.value, {}
        for batch in batches:
            for raw in batch.column("small").to_pylist():
                hashes = np.frombuffer(raw, np.uint64)
                n = len(hashes)
                least = np.sort(counts[slots(hashes)])[: prefix_length(n)]
                scan[n] = scan.get(n, 0) + int(least.astype(np.int64).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(scan), pa.int64()), pa.array(list(scan.values()), pa.int64())], ["n", "scan"])

    return run


def boundary(sizes: dict[int, tuple[int, int]]) -> int:
    """The largest light size, from {size: (sets, postings that their prefixes would scan)}: least total cost."""
    best, best_cost = 0, None
    for light in range(LARGEST_LIGHT + 1):
        cost = 0
        for n, (sets, scan) in sizes.items():
            cost += sets * n_subset_keys(n, light) + (scan if n > light else 0)
        if best_cost is None or cost < best_cost:
            best, best_cost = light, cost
    return best


_LIST = ["key", "salt", "class", "n", "pos"]


def _keys(sketch, light: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in _LIST]
            for hashes in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist()):
                n = len(hashes)
                if not n:
                    continue
                own = class_of(hashes)
                if n > light:
                    df = counts[slots(hashes)].astype(np.int64)
                    p = prefix_length(n)
                    first = np.lexsort((hashes, df))[:p]
                    salt = np.where(df[first] > HEAVY, 1 + (own & 0xFFFF) % (1 + df[first] // HEAVY), 0)
                    for column, v in zip(out, (hashes.view(np.int64)[first], salt, np.full(p, own), np.full(p, n), np.arange(p)), strict=True):
                        column.append(v)
                keys = subset_keys(hashes, light) if smallest_partner(n) <= light else ()
                if keys:  # no position bound holds for subsets
                    k = len(keys)
                    for column, v in zip(out, (np.array(sorted(keys)), np.zeros(k, np.int64), np.full(k, own), np.full(k, n), np.full(k, -1)), strict=True):
                        column.append(v)
            if out[0]:
                types = [np.int64, np.int32, np.int64, np.int32, np.int32]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(out, types, strict=True)], _LIST)

    return run


def _has_partner(number: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether another member of a row's list (by number) has a size that the row's bounds in ``_possible`` allow."""
    least, most = -(-percent * n // 100), 100 * n // percent
    # Both need ceil(percent * (n + m) / (100 + percent)) elements from the key on.
    most = np.where(pos < 0, most, np.clip((100 + percent) * (n - pos) // percent - n, 0, most))
    width = 2 * int(n.max()) + 2
    at = np.sort(number * width + n)
    found = np.searchsorted(at, number * width + most, "right") - np.searchsorted(at, number * width + least, "left")
    return found - (most >= n) > 0


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, salt and class: repeated members go, then those that can link with no other member, and lists of one member (unless salted).

    Every row tells its list's first member, the hub, and whether it is the third one: a list without a third
    member is done once its members are compared with the hub.
    """
    held = carry = None  # the last row so far; its list's hub and its place there
    for batch in itertools.chain((b for b in batches if b.num_rows), [None]):
        table = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
        if table is None:
            return
        key, salt, own, n, pos = (table.column(c).to_numpy().astype(np.int64, copy=False) for c in _LIST)
        new_list = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        kept = new_list | np.concatenate([[True], (own[1:] != own[:-1]) | (n[1:] != n[:-1])])
        number = np.cumsum(new_list)
        key, salt, own, n, pos, number = (v[kept] for v in (key, salt, own, n, pos, number))
        # The first list may go on from the batch before, the last one into the next; cut lists are not whole either.
        whole = ((number > 1) | (carry is None)) & ((number < number[-1]) | (batch is None)) & (salt == 0)
        fits = ~whole | _has_partner(number, n, pos)
        key, salt, own, n, pos, number = (v[fits] for v in (key, salt, own, n, pos, number))
        if not len(key):  # of the last batch alone: before it, the last row stays
            return
        new_list = np.concatenate([[True], number[1:] != number[:-1]])
        start = np.maximum.accumulate(np.where(new_list, np.arange(len(key)), 0))
        place, hub, hub_n, hub_pos = np.arange(len(key)) - start, own[start], n[start], pos[start]
        if carry is not None:
            first = start == 0
            hub[first], hub_n[first], hub_pos[first] = carry[:3]
            place[first] += carry[3]
        member = (place > 0) | np.concatenate([~new_list[1:], [False]]) | (salt > 0)
        member[-1] &= batch is None
        columns = [key, own, n, pos, hub, hub_n, hub_pos, (place == 2) | (salt > 0)]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c[member], t) for c, t in zip(columns, types, strict=True)], ["key", "class", "n", "pos", "hub", "hub_n", "hub_pos", "third"])
        held, carry = table.slice(table.num_rows - 1), (hub[-1], hub_n[-1], hub_pos[-1], int(place[-1]))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in ("a", "an", "b", "bn")), strict=True))
            new = {}
            for (a, an, b, bn), x, y in zip(ids, batch.column("text_a").cast(pa.binary()).to_pylist(), batch.column("text_b").cast(pa.binary()).to_pylist(), strict=True):
                new.setdefault((a, an), x)
                new.setdefault((b, bn), y)
            missing = [k for k in new if k not in memo]
            sets = dict(zip(missing, shingle_sets([new[k] for k in missing]), strict=True))
            memo = {k: memo[k] if k in memo else sets[k] for k in new}  # this batch's sets alone
            hit = []
            for a, an, b, bn in ids:
                both = len(np.intersect1d(memo[a, an], memo[b, bn], assume_unique=True))
                hit.append(100 * both >= percent * (an + bn - both))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "an", "b", "bn")), pa.array(hit)], ["a", "an", "b", "bn", "linked"])

    return run


def _possible(percent: int = PERCENT):
    """Size and position bounds for a pair that shares a key (columns n, pos of one and hub_n, hub_pos of the other)."""
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("hub_n")) / F.lit(100 + percent) - F.lit(1e-9))
    size = (100 * F.col("n") >= percent * F.col("hub_n")) & (100 * F.col("hub_n") >= percent * F.col("n"))
    position = (F.col("pos") < 0) | (F.col("hub_pos") < 0) | (F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos")) >= need)
    return size & position


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, an, b, bn) of rows with class, n, pos and hub, hub_n, hub_pos."""
    one, other = F.struct(F.col("class").alias("c"), F.col("n").alias("n")), F.struct(F.col("hub").alias("c"), F.col("hub_n").alias("n"))
    rows = rows.where((one != other) & _possible()).select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y"))
    return rows.select(F.col("x.c").alias("a"), F.col("x.n").alias("an"), F.col("y.c").alias("b"), F.col("y.n").alias("bn")).distinct()


@dataclass
class _Search:
    """What the candidate search writes: rows of documents, classes of equal sets, pairs of list members with hubs, longer lists, texts."""

    members: DataFrame
    classes: DataFrame
    stars: DataFrame
    lists: DataFrame
    bodies: DataFrame


def _search(docs: DataFrame) -> _Search:
    spark = docs.sparkSession
    texts = docs.select(id_or_least().alias("d"), "text")
    first = written(texts.mapInArrow(in_pieces(_first_pass), "kind byte, d long, n long, class long, small binary, chunk int, counts binary"), "shingle-sizes")
    members = first.where("kind = 0").select("d", F.col("n").cast("int").alias("n"), "class")
    classes = written(members.where("n > 0").groupBy("class", "n").agg(F.min("d").alias("rep")), "classes")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = first.where("kind = 1").select("chunk", "counts").repartition(min(parts, (1 << SKETCH_BITS) // CHUNK), "chunk").sortWithinPartitions("chunk").mapInArrow(_sum_chunks, "chunk int, counts binary")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)  # of fixed size
    for r in sums.collect():  # a row a chunk; row by row would be a job for each partition
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    sketch = spark.sparkContext.broadcast(standing_out(counts))

    small = first.where("kind = 0 and small is not null").groupBy("class", "n").agg(F.first("small").alias("small"))
    scans = small.select("small").mapInArrow(_costs(sketch), "n long, scan long").groupBy("n").agg(F.sum("scan").alias("scan"))
    n_sets = {r["n"]: r["c"] for r in classes.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()}  # a row a size
    light = boundary({r["n"]: (n_sets.get(r["n"], 0), r["scan"]) for r in scans.collect()})

    n_keys = members.agg(F.sum(F.col("n") * (100 - PERCENT) / 100 + 1)).first()[0] or 0
    parts = max(parts, math.ceil(n_keys / PART_KEYS))
    keys = texts.select("text").mapInArrow(in_pieces(_keys(sketch, light)), "key long, salt int, class long, n int, pos int")
    lists = keys.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "class", "n").mapInArrow(_lists, "key long, class long, n int, pos int, hub long, hub_n int, hub_pos int, third boolean")
    lists = written(lists, "lists")
    stars = written(_pairs(lists), "stars")
    # Lists of three members or more may hold pairs that the hub has no part in.
    more = written(lists.where("third").select("key").distinct(), "longer-keys")
    lists = written(lists.select("key", "class", "n", "pos").join(more, "key"), "longer-lists")

    # Whole texts of the classes that are to be compared, once.
    compared = stars.select(F.col("a").alias("class"), F.col("an").alias("n")).union(stars.select("b", "bn")).union(lists.select("class", "n")).distinct()
    wanted = written(compared.join(classes, ["class", "n"]), "wanted")
    by_rep = texts.join(wanted.withColumnRenamed("rep", "d").hint("merge"), "d").select("class", "n", "text").mapInArrow(in_pieces(_own_text), "class long, n int, text string")
    return _Search(members, classes, stars, lists, written(by_rep, "bodies"))


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """pairs (a, an, b, bn) with linked, by their whole sets; written."""
    text_a, text_b = bodies.toDF("a", "an", "text_a"), bodies.toDF("b", "bn", "text_b")
    if pairs.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:  # texts stream past the pairs; only those in a pair move
        with_both = text_a.join(F.broadcast(pairs), ["a", "an"]).join(text_b.join(F.broadcast(pairs), ["b", "bn"]), ["a", "an", "b", "bn"])
    else:
        with_both = pairs.join(text_a, ["a", "an"]).join(text_b, ["b", "bn"])
    return written(with_both.select("a", "an", "b", "bn", "text_a", "text_b").mapInArrow(in_pieces(_verify(PERCENT)), "a long, an int, b long, bn int, linked boolean").distinct(), "judged")


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, (a, an, b, bn) with a class and its size on each side, and (d, class, n) for each row of docs."""
    found = _search(docs)
    long_keys = written(found.lists.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > LONG).select("key"), "long-keys")
    short = found.lists.join(long_keys, "key", "left_anti")
    other = short.select("key", F.col("class").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"))
    pairs = written(found.stars.unionByName(_pairs(short.join(other, "key"))).distinct(), "pairs")
    links = _verified(pairs, found.bodies).where("linked").drop("linked")
    if not long_keys.isEmpty():
        rows = found.lists.join(long_keys, "key").select("class", "n", F.col("key").alias("group"), F.lit(0).alias("common")).distinct()
        links = links.unionByName(_block_links(rows, found.bodies)).distinct()
    return written(links, "links"), found.members.select("d", "class", "n")


def link_counts(docs: DataFrame) -> DataFrame:
    """(d, n_shingles, n_links) for each row of docs: the number of other rows that it links with."""
    links, members = jaccard_links(docs)
    sizes = members.where("n > 0").groupBy("class", "n").agg(F.count("*").alias("size"))
    ways = links.unionByName(links.toDF("b", "bn", "a", "an"))
    beyond = ways.join(sizes.toDF("b", "bn", "size"), ["b", "bn"]).groupBy("a", "an").agg(F.sum("size").alias("beyond"))
    of_class = sizes.join(beyond.toDF("class", "n", "beyond"), ["class", "n"], "left").select("class", "n", (F.col("size") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    return members.join(of_class, ["class", "n"], "left").select("d", F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(d, n_shingles, component) for each row of docs (doc_id, text): d and component stand for null as the least id."""
    found = _search(docs)
    members, classes, stars, lists, bodies = found.members, found.classes, found.stars, found.lists, found.bodies
    tried = links = None

    def compare(pairs: DataFrame) -> None:
        nonlocal tried, links
        if tried is not None:
            pairs = pairs.join(tried, ["a", "an", "b", "bn"], "left_anti")
        pairs = written(pairs, "pairs") if pairs is not stars else pairs
        if pairs.isEmpty() and links is not None:
            return
        judged = _verified(pairs, bodies)
        new = judged.where("linked").drop("linked")
        tried = judged.drop("linked") if tried is None else tried.unionByName(judged.drop("linked"))
        links = new if links is None else links.unionByName(new)

    def hub(n: int):
        return F.min(F.struct(F.xxhash64(F.lit(n), "class", "n").alias("h"), F.col("class").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("label").alias("hub_label")))

    def labelled(lists: DataFrame) -> DataFrame:
        """Rows of lists with their members' labels."""
        parts = connected_components(links.select(F.struct(F.col("a").alias("c"), F.col("an").alias("n")).alias("a"), F.struct(F.col("b").alias("c"), F.col("bn").alias("n")).alias("b")))
        parts = parts.select(F.col("node.c").alias("class"), F.col("node.n").alias("n"), F.col("component").alias("label"))
        own = F.struct(F.col("class").alias("c"), F.col("n").alias("n"))
        return written(lists.join(written(parts, "parts"), ["class", "n"], "left").withColumn("label", F.coalesce("label", own)), "labelled")

    compare(stars)
    lengths = lists.groupBy("key").agg(F.count("*").alias("members"))
    long_keys = written(lengths.where(F.col("members") > LONG).select("key"), "long-keys")
    if not long_keys.isEmpty():
        rows = labelled(written(lists.join(long_keys, "key"), "long-lists"))
        some = rows.groupBy("key").agg(*(hub(1 + k).alias(f"h{k}") for k in range(HUBS)))
        hubs = some.select("key", F.explode(F.array(*(f"h{k}" for k in range(HUBS)))).alias("h")).select("key", "h.hub", "h.hub_n", "h.hub_pos", "h.hub_label").distinct()
        compare(_pairs(rows.join(written(hubs, "hubs"), "key").where("label <> hub_label")))

    # Every pair with different labels: members outside the list's commonest label against all of it.
    rows = labelled(lists)
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("k"))
    common = by_label.groupBy("key").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("top.label").alias("commonest"))
    rows = written(rows.join(written(common, "commonest"), "key").join(long_keys.withColumn("long", F.lit(True)), "key", "left"), "mixed-lists")
    short = rows.where("long is null")
    rest = short.where("label <> commonest").select("key", F.col("class").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("label").alias("hub_label"))
    compare(_pairs(short.join(rest, "key").where("label <> hub_label")))
    if not long_keys.isEmpty():
        blocked = rows.where("long").select("class", "n", F.col("commonest").alias("group"), (F.col("label") == F.col("commonest")).cast("int").alias("common")).distinct()
        links = links.unionByName(_block_links(blocked, bodies))

    reps = classes.select(F.col("class").alias("c"), F.col("n").alias("m"), "rep")
    edges = links.join(reps.toDF("a", "an", "ra"), ["a", "an"]).join(reps.toDF("b", "bn", "rb"), ["b", "bn"]).select("ra", "rb")
    # Rows that share a doc_id are one document: its other sets hang on to its first class.
    twins = members.where("n > 0").join(classes, ["class", "n"]).where("rep <> d").select(F.col("d").alias("ra"), F.col("rep").alias("rb")).distinct()
    parts = written(connected_components(edges.unionByName(twins), "ra", "rb"), "components")
    return members.join(parts.toDF("d", "component"), "d", "left").select("d", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "d").alias("component"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [h.tobytes() for h in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("n"), pa.array(sets, pa.binary())], ["class", "n", "hashes"])


def _block_links(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links (a, an, b, bn) among the members (class, n) of groups, but for pairs of two ``common`` ones, which are known to be joined.

    Sets that link differ in size by a quarter at most, so a class of sizes meets itself and the next one alone.
    """
    tier = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT * (1 + 1e-6))).cast("int")
    members = written(rows.select("group", "common", tier.alias("tier"), "class", "n"), "members")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / BLOCK_MEMBERS)).cast("int")
    cells = written(members.groupBy("group", "tier", "common").agg(blocks.alias("k")), "cells")
    placed = members.join(cells, ["group", "tier", "common"]).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "class", "n"), "k").cast("int"))
    sets = bodies.join(members.select("class", "n").distinct(), ["class", "n"]).mapInArrow(in_pieces(_hashed), "class long, n int, hashes binary")
    sets = placed.join(written(sets, "sets"), ["class", "n"]).groupBy("group", "tier", "common", "block").agg(F.collect_list(F.struct("class", "n", "hashes")).alias("sets"))
    sets = written(sets, "blocks")
    one, other = cells.toDF("group", "t", "c", "k"), cells.toDF("group", "u", "e", "m")
    meet = one.join(other, "group").where("c = 0 and abs(t - u) <= 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    meet = written(meet.where(F.col("e").eqNullSafe(1) | (F.struct("t", "i") <= F.struct("u", "j"))).select("group", "t", "c", "i", "u", "e", "j"), "block-pairs")
    both = meet.join(sets.toDF("group", "t", "c", "i", "x"), ["group", "t", "c", "i"]).join(sets.toDF("group", "u", "e", "j", "y"), ["group", "u", "e", "j"])
    return written(both.select("x", "y").mapInArrow(in_pieces(_matrix_links(PERCENT)), "a long, an int, b long, bn int").distinct(), "block-links")


def _matrix_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["a", "an", "b", "bn"], [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        for batch in batches:
            for row in batch.to_pylist():
                sides = []
                for members in (row["x"], row["y"]):
                    sets = [np.frombuffer(m["hashes"], np.uint64) for m in members]
                    sides.append((members, sets, np.array([len(v) for v in sets])))
                (mx, sx, nx), (my, sy, ny) = sides
                shared = np.intersect1d(np.concatenate(sx), np.concatenate(sy))
                both = np.zeros((len(sx), len(sy)), np.float32)
                for at in range(0, len(shared), 1 << 14):  # bounds the matrices, whatever the sets' sizes
                    some = shared[at : at + (1 << 14)]
                    p, q = (_incidence(sets, some) for sets in (sx, sy))
                    both += p @ q.T
                union = nx[:, None] + ny[None, :] - both
                ends = lambda i, j: sorted([(mx[i]["class"], mx[i]["n"]), (my[j]["class"], my[j]["n"])])
                out = [(*p, *q) for p, q in (ends(i, j) for i, j in zip(*np.nonzero(100 * both >= percent * union), strict=True)) if p != q]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _incidence(sets: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(tokens)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(tokens, s)
        at[at == len(tokens)] = 0
        out[i, at[tokens[at] == s]] = 1
    return out


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of document, those whose text has the class's set, once each (rows that share a doc_id may repeat or differ)."""
    last = None
    for batch in batches:
        keep = []
        for h, c, n in zip(shingle_sets(batch.column("text").cast(pa.binary()).to_pylist()), batch.column("class").to_pylist(), batch.column("n").to_pylist(), strict=True):
            fits = class_of(h) == c and len(h) == n and (c, n) != last
            keep.append(fits)
            last = (c, n) if fits else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(pick(read(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select(id_back("d").alias("doc_id"), "n_shingles", id_back("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of links, with the columns of docs."""
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    found = jaccard_classes(pick(docs, "doc_id", "text"))
    dropped = found.where("d <> component").select(F.col("d").alias("__d")).distinct()
    at = F.coalesce(F.col(plain[names.index("doc_id")]).cast("long"), F.lit(NULL_ID))
    return docs.toDF(*plain).withColumn("__d", at).join(dropped, "__d", "left_anti").drop("__d").toDF(*names)
