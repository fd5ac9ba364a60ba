"""Prefix trie of conversations: vertical bitmaps in shards of conversations, nodes united over shards.

A shard is a range of conversation ids. There, each (position, turn) has a bitset of the shard's conversations that
hold the turn at this place. From the root down, the bitset of a node and the postings of the next position
intersect in the bitsets of its children; a popcount gives the members, and the members that have no
further turn are the node's end list. A node is known by the SHA-256 of its path, so the shards' nodes are
united by one grouping; counts are summed and least ids taken before and after the shuffle.

A subtree's sums are found by doubling: round k adds to each node the sums of the nodes 2^k below it, which cover the
next 2^k levels, so the rounds grow with the logarithm of the depth. Only nodes of two or more conversations take part: a node of
one saves nothing and ends in one leaf. End lists of a node that one shard alone has are hashed as they are; those
of several shards are read in order of the ranges and hashed as a stream.

A shard holds the turns of its conversations as keys of 16 bytes, never texts. A conversation's turns stay in one task; rows are
dealt by ranges of ids, so many conversations with one first turn load no single task.

Edge cases: turns go by number, null first, then by role and text; null role or text is empty, so it equals an empty one; repeated rows
are turns of their own. Rows without conv_id form one conversation, which is not rebuilt; its id counts as none among others, and is empty in
lists. ``c % 20`` keeps the sign of c. Conversations without a turn end at the root; of no conversation there is no root and no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import NULL_ID, id_back, id_or_least, pick, read, written, written_in_parts
from bookmerge.operators.ranges import numbered

#: Conversations of a shard: bits of a bitset, and ids of an end list.
SHARD = 1024
#: Conversations ``c`` share the first turns of ``c - c % GROUP``; the most turns that they share.
GROUP, MOST_SHARED = 20, 3

_KEY = 16
_NODES = "node binary, parent binary, depth long, conv_id long, n_convs long, words long, ends string, first_end long"
_SCHEMA = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()), ("ends", pa.string()), ("first_end", pa.int64())])
ROOT = b""


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, key, words): the turns in order; key tells role and text apart, words are those of the text."""
    c = pick(conversations, "conv_id", "turn", "role", "text")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, _KEY)
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    rows = c.select(id_or_least("conv_id").alias("conv_id"), F.struct("turn", role.alias("role"), digest.alias("key")).alias("at"), words.alias("words"))
    return numbered(rows, ["conv_id"], "at", "place").select("conv_id", "place", F.col("at.key").alias("key"), "words")


def shared_turns(conv_id: Column) -> Column:
    return F.when(conv_id == NULL_ID, 0).otherwise(F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """turns (conv_id, place, key, words) of which each conversation's first ones are those of its group's head; a row of place -1 for each conversation.

    At most ``MOST_SHARED`` turns of a head are joined, with at most ``GROUP`` conversations each.
    """
    convs = turns.where("place = 0").select("conv_id", shared_turns(F.col("conv_id")).alias("h"))
    own = turns.where(F.col("place") >= shared_turns(F.col("conv_id")))
    heads = turns.where(F.col("place") < MOST_SHARED).select(F.col("conv_id").alias("head"), "place", "key", "words")
    led = convs.where("h > 0").withColumn("head", F.col("conv_id") - F.col("conv_id") % GROUP)
    first = led.join(heads, "head").where("place < h").select("conv_id", "place", "key", "words")
    marks = convs.select("conv_id", F.lit(-1).cast(turns.schema["place"].dataType).alias("place"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(first).unionByName(marks)


def _child(path: bytes, key: bytes) -> bytes:
    return hashlib.sha256(path + key).digest()[:_KEY]


def shard_nodes(convs: list[tuple[int, list[tuple[bytes, int]]]]) -> Iterator[tuple]:
    """Rows of ``_NODES`` for one shard: (conv_id, turns as (key, words)) in ascending order of ids.

    A bitset is an int: bit i stands for the i-th conversation.
    """
    postings: dict[tuple[int, bytes], int] = {}
    reach: list[int] = []  # conversations that have a turn at the position
    for i, (_, turns) in enumerate(convs):
        for p, (key, _) in enumerate(turns):
            postings[p, key] = postings.get((p, key), 0) | 1 << i
            if p == len(reach):
                reach.append(0)
            reach[p] |= 1 << i
    stack = [(ROOT, None, 0, (1 << len(convs)) - 1, 0)]
    while stack:
        node, parent, depth, members, words = stack.pop()
        known = members & ~int(convs[0][0] == NULL_ID) or members  # the first conversation may be the one without an id
        first = convs[(known & -known).bit_length() - 1][0]
        ended = members & ~(reach[depth] if depth < len(reach) else 0)
        ends = []
        while ended:
            low = ended & -ended
            ends.append(convs[low.bit_length() - 1][0])
            ended ^= low
        yield node, parent, depth, None if first == NULL_ID else first, members.bit_count(), words, ",".join("" if e == NULL_ID else str(e) for e in ends) if ends else None, ends[0] if ends else None
        rest = members & (reach[depth] if depth < len(reach) else 0)
        while rest:  # the child of the least conversation that no child has yet
            key, n = convs[(rest & -rest).bit_length() - 1][1][depth]
            both = members & postings[depth, key]
            stack.append((_child(node, key), node, depth + 1, both, n))
            rest &= ~both


def _in_shards(size: int):
    """A function over Arrow batches of (conv_id, place, key, words), sorted: the nodes of each shard of ``size`` conversations."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs: list[tuple[int, list[tuple[bytes, int]]]] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for row in shard_nodes(convs):
                rows.append(row)
                if len(rows) == 8192:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        for batch in batches:
            for c, place, key, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not convs or convs[-1][0] != c:
                    if len(convs) == size:
                        yield from out()
                        convs = []
                    convs.append((c, []))
                if place >= 0:
                    convs[-1][1].append((key, words))
        if convs:
            yield from out()

    return run


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends) sorted by node and range: the hash of each node's lists, joined; one state, whatever the list's length."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for n, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is not None and n == node:
                state.update(b",")
            else:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            state.update(ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """(node, n_leaves, saved): the sums of (leaves, saved) over the subtree of each node (node, parent, leaves, saved), by doubling."""
    at = written(shared.select("node", F.col("parent").alias("up"), "leaves", "saved"), "trie-sums")
    while not at.where("up is not null").isEmpty():
        below = at.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        higher = at.select(F.col("node").alias("up"), F.col("up").alias("next"))
        grown = at.join(below, "node", "left").join(higher, "up", "left")
        at = written(grown.select("node", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "trie-sums")
    return at.select("node", F.col("leaves").alias("n_leaves"), "saved")


def trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of turns (conv_id, place, key, words; a row of place -1 for each conversation): columns of op11, and node and parent keys."""
    rows, parts = written_in_parts(turns, "trie-turns")
    dealt = rows.repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "place", "key", "words")
    found, parts = written_in_parts(dealt.mapInArrow(_in_shards(shard), _NODES), "trie-shards")
    lists = F.count("ends")
    nodes = found.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"), lists.alias("lists"), F.min("ends").alias("ends"))
    nodes = written(nodes, "trie-nodes")
    several = nodes.where("lists > 1").select("node")
    streamed = found.where("ends is not null").join(several, "node", "left_semi").select("node", "ends", "first_end").repartition(parts, "node").sortWithinPartitions("node", "first_end").select("node", "ends").mapInArrow(_hash_lists, "node binary, ends_sha256 string")
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    nodes = written(nodes.join(below, "node", "left").join(streamed, "node", "left"), "trie-nodes")
    leaves = F.when(F.col("n_children").isNull(), 1).otherwise(F.col("alone")).cast("long")
    several_members = nodes.where("n_convs > 1").select("node", "parent", leaves.alias("leaves"), F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).cast("long").alias("saved"))
    sums = _subtree_sums(several_members)
    parents = nodes.where("n_children is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node", "left").join(parents, "parent", "left")
    hashed = F.coalesce("ends_sha256", F.sha2(F.coalesce("ends", F.lit("")).cast("binary"), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"), hashed.alias("ends_sha256"), "node", "parent")


def members(turns: DataFrame, trie_nodes: DataFrame) -> DataFrame:
    """(node, conv_id) of the node at which each conversation ends, for readers that want texts back: paths of keys are hashed as in ``trie``."""
    rows, parts = written_in_parts(turns, "trie-turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, path = None, ROOT
        for batch in batches:
            done = []
            for c, place, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv:
                    if conv is not None:
                        done.append((path, conv))
                    conv, path = c, ROOT
                if place >= 0:
                    path = _child(path, key)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int64())], names=["node", "conv_id"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([conv], pa.int64())], names=["node", "conv_id"])

    ended = rows.repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "place", "key").mapInArrow(run, "node binary, conv_id long")
    return ended.join(trie_nodes.select("node"), "node").select("node", id_back("conv_id").alias("conv_id"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie(rebuilt(turns_of(read(spark, sf_dir, "conversations"))))
    return found.drop("node", "parent")


def shared_turns_of(conv_id: int) -> int:
    """``shared_turns`` for one id, for tests."""
    return zlib.crc32(str(conv_id).encode()) % (MOST_SHARED + 1)


#: crc32 bit by bit: a decimal's bytes, least bit first, from all ones to the complement.
_BITS = "list_transform(range(0, 8 * length(cast(c as varchar))), lambda b: (ascii(substr(cast(c as varchar), cast(b // 8 + 1 as int), 1)) >> cast(b % 8 as int)) & 1)"
_CRC = f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform({_BITS}, lambda v: cast(v as bigint))), lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295)"

ORACLE = rf"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
convs as (select c, {_CRC} % {MOST_SHARED + 1} as h from (select distinct c from t)),
r as (select c, t.place, t.role, t.text from convs join t using (c) where t.place >= h union all select convs.c, t.place, t.role, t.text from convs join t on t.c = convs.c - convs.c % {GROUP} where t.place < h),
p as (select c, place, text, list(concat(length(role), ':', role, length(text), ':', text)) over (partition by c order by place) as path from r),
n as (select c, row_number() over (partition by c order by place) as depth, path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from p union all select c, 0, [], 0 from convs),
lengths as (select c, max(depth) as len from n group by c),
nodes as (select depth, path, min(n.c) as conv_id, count(*) as n_convs, min(words) as words, sha256(coalesce(string_agg(cast(n.c as varchar), ',' order by n.c) filter (len = depth), '')) as ends_sha256 from n join lengths using (c) group by depth, path),
kids as (select path[:-2] as path, count(*) as n_children from nodes where depth > 0 group by 1),
full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (path)),
below as (select a.path, count(*) filter (b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.words) as saved_tokens from full_nodes a join full_nodes b on b.depth >= a.depth and b.path[:a.depth] = a.path group by a.path)
select x.conv_id, x.depth, up.conv_id as parent_conv_id, x.n_convs, x.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, x.ends_sha256
from full_nodes x join below using (path) left join full_nodes up on x.depth > 0 and up.path = x.path[:-2]
"""
