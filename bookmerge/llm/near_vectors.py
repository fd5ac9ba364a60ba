"""Near duplicates among vectors: a navigable small-world graph for each shard, every shard queried, cosines verified, components united.

Equal vectors are one class with a count, so copies, however many, are one node. Classes are dealt to shards by hash; each shard's graph is written as
rows (one a node, with its links). Each unordered pair of shards is one task: the classes of the first are looked up in the graph of the second,
and those of one shard also in its own. Beams start narrow. A sample of a task's queries is compared with the whole shard; as long as less than
``RECALL`` of its links was found, all queries of the task go again with beams twice as wide. A query whose beam is full of
links goes again in any case, and where the widest beam does not do, the shard is scanned, which is exact. Every link counts only after its cosine was
verified in double precision (by float32 products where these are further from the limit than their error).

A task gives a row for each class it links: how many vectors, and one class of the links' component inside the task. So rows
do not grow with the square of a group of near vectors. Sums of counts and components of these rows are the result. Pairs of
shards run in passes, so that the vectors on the way are a few times the index at most. The work grows with the shards' number; a shard holds ``SHARD`` classes.

Edge cases: vectors that are null, empty or zero, or hold a null or a value that is not finite, link with nothing, not even with each other; vectors of other lengths
are shards of their own; repeated rows are vectors of their own; of rows without vec_id each is a row, and the component has
null only if no member has an id; ``kept`` is then true. Components keep the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import NULL_ID, id_back, id_or_least, pick, read, written
from bookmerge.llm.components import connected_components
from bookmerge.llm.hnsw import LINKS, LOW_LINKS, Graph

LEAST = 0.9
#: Classes of a shard at most (a task holds two shards), and shards at least.
SHARD, SHARDS = 100_000, 8
#: First and widest beam; recall of the audited links; links that an audit wants to see, and the queries it takes in one step.
BEAM, WIDEST, RECALL, AUDIT_LINKS, AUDIT = 32, 512, 0.99, 64, 128
#: Bytes of vectors on the way in a pass, if four times the index are not more.
PASS_BYTES = 1 << 30
#: Queries that are compared with a whole shard at once.
SCAN = 256


class _Labels:
    """Components of links inside a task."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while len(x):
            a, b = label[x], label[y]
            differ = a != b
            if not differ.any():
                return
            x, y, a, b = x[differ], y[differ], a[differ], b[differ]
            np.minimum.at(label, np.concatenate([x, y, a, b]), np.tile(np.minimum(a, b), 4))
            while (label[label] != label).any():
                label[:] = label[label]


class Lookup:
    """Links of queries (unit vectors in double precision) to a shard's nodes (likewise)."""

    def __init__(self, queries: np.ndarray, nodes: np.ndarray, layers: list[np.ndarray], least: float, own: bool):
        self.q, self.x, self.least, self.own = queries, nodes, least, own
        self.q32, self.x32 = queries.astype(np.float32), nodes.astype(np.float32)
        self.graph = Graph(self.x32, layers)
        self.error = 1e-5 + 1.2e-7 * queries.shape[1]
        self.audited = self.audited_links = self.audited_found = 0

    def _verified(self, i: np.ndarray, j: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = sims >= self.least + self.error
        for at in range(0, len(ok), 1 << 16):
            part = slice(at, at + (1 << 16))
            some = np.flatnonzero(~ok[part]) + at
            ok[some] = np.einsum("ij,ij->i", self.q[i[some]], self.x[j[some]]) >= self.least
        if self.own:
            ok &= i != j
        return i[ok], j[ok]

    def scan(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All links of the queries: each compared with every node."""
        for at in range(0, len(queries), SCAN):
            some = queries[at : at + SCAN]
            sims = self.q32[some] @ self.x32.T
            r, j = np.nonzero(sims >= self.least - self.error)
            yield self._verified(some[r], j, sims[r, j])

    def _recall(self, queries: np.ndarray, i: np.ndarray, j: np.ndarray) -> float:
        """Share of the links of a sample of the queries that are among the found ones (i, j)."""
        order = np.random.default_rng(len(queries)).permutation(queries)
        links = found = 0
        for at in range(0, max(AUDIT, len(order) // 4), AUDIT):
            some = order[at : at + AUDIT]
            links += sum(len(x) for x, _ in self.scan(some))
            found += int(np.isin(i, some).sum())
            self.audited += len(some)
            if links >= AUDIT_LINKS or at + AUDIT >= len(order):
                break
        self.audited_links += links
        self.audited_found += found
        return found / links if links else 1.0

    def by_beams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, rest): links found by beams, and the queries that are left for scans."""
        pending, width, found = np.arange(len(self.q)), BEAM, []
        while len(pending) and width <= WIDEST:
            ids, sims = self.graph.search(self.q32[pending], width)
            full = sims[:, -1] >= self.least - self.error
            r, c = np.nonzero((sims >= self.least - self.error) & ~full[:, None])
            i, j = self._verified(pending[r], ids[r, c], sims[r, c])
            if self._recall(pending[~full], i, j) >= RECALL:
                found.append((i, j))
                pending = pending[full]
            width *= 2
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        return i, j, pending


def linked(queries: np.ndarray, q_copies: np.ndarray, nodes: np.ndarray, copies: np.ndarray, layers: list[np.ndarray], least: float = LEAST, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of the queries, links of the nodes, label of queries and then nodes), with copies; ``own``: the queries are the nodes themselves."""
    look = Lookup(queries, nodes, layers, least, own)
    n_q, n_x, labels, base = np.zeros(len(queries), np.int64), np.zeros(len(nodes), np.int64), _Labels(len(queries) + (0 if own else len(nodes))), 0 if own else len(queries)
    i, j, rest = look.by_beams()
    scanned = np.zeros(len(queries), bool)
    scanned[rest] = True
    held = [np.stack([i, j])]
    for i, j in look.scan(rest):
        labels.unite(i, base + j)
        if own:  # links between two scanned ones come from both sides; others may come from one side or both
            both = scanned[j]
            held.append(np.stack([i[~both], j[~both]]))
            i, j = i[both], j[both]
            np.add.at(n_q, i, copies[j])
        else:
            np.add.at(n_q, i, copies[j])
            np.add.at(n_x, j, q_copies[i])
    i, j = np.concatenate(held, 1)
    labels.unite(i, base + j)
    if own:
        pair = np.unique(np.minimum(i, j) * len(nodes) + np.maximum(i, j))
        i, j = pair // len(nodes), pair % len(nodes)
        np.add.at(n_q, j, copies[i])
    else:
        np.add.at(n_x, j, q_copies[i])
    np.add.at(n_q, i, copies[j])
    return n_q, n_x, labels.label


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit vectors in double precision."""
    flat = column.combine_chunks()
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    v /= np.abs(v).max(1, keepdims=True)  # no square overflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _build(rows: pa.Table) -> pa.Table:
    """The classes of one shard by node number, with their links by layer."""
    rows = rows.sort_by("cid")
    levels = Graph.levels(rows.num_rows)
    order = np.argsort(-levels, kind="stable")
    rows, levels = rows.take(pa.array(order)), levels[order]
    graph = Graph.built(_unit(rows.column("embedding")).astype(np.float32), levels)
    n = rows.num_rows
    flat = np.concatenate([layer.ravel() for layer in graph.layers])  # layer after layer; put in order of nodes
    node = np.concatenate([np.repeat(np.arange(len(layer)), layer.shape[1]) for layer in graph.layers])
    links = flat[np.argsort(node, kind="stable")]
    ptr = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=n))])
    return rows.append_column("node", pa.array(np.arange(n), pa.int32())).append_column("links", pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(links, pa.int32()))).select(["dim", "shard", "cid", "copies", "embedding", "node", "links"])


def _layers(links: pa.ChunkedArray) -> list[np.ndarray]:
    """Link tables from the rows of nodes in order."""
    arr = links.combine_chunks()
    flat, ptr = arr.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(arr.value_lengths().to_numpy(zero_copy_only=False))])
    size = np.diff(ptr)
    out = [flat[ptr[:-1, None] + np.arange(LOW_LINKS)]]
    while len(higher := ptr[:-1][size > LOW_LINKS + LINKS * (len(out) - 1)]):
        out.append(flat[higher[:, None] + LOW_LINKS + LINKS * (len(out) - 1) + np.arange(LINKS)])
    return out


_FOUND = "cid long, links long, root long"


def _compare(least: float):
    def run(queries: pa.Table, nodes: pa.Table) -> pa.Table:
        """One pair of shards: (class, links, a class of the same component) of the classes with links."""
        if not queries.num_rows or not nodes.num_rows:  # a shard without classes of this length
            return pa.table({c: pa.array([], pa.int64()) for c in ("cid", "links", "root")})
        nodes = nodes.sort_by("node")
        own = queries.column("from")[0].as_py() == queries.column("home")[0].as_py()
        q = nodes if own else queries
        x, layers, copies, cid = _unit(nodes.column("embedding")), _layers(nodes.column("links")), nodes.column("copies").to_numpy(), nodes.column("cid").to_numpy()
        n_q, n_x, label = linked(x if own else _unit(q.column("embedding")), q.column("copies").to_numpy(), x, copies, layers, least, own)
        n, ids = (n_q, cid) if own else (np.concatenate([n_q, n_x]), np.concatenate([q.column("cid").to_numpy(), cid]))
        some = np.flatnonzero(n)
        return pa.table({"cid": ids[some], "links": n[some], "root": ids[label[some]]})

    return run


def classes_of(vectors: DataFrame) -> DataFrame:
    """(cid, dim, embedding, rep, copies): the distinct vectors that can link; rep is their least id (``NULL_ID`` stands last)."""
    ids = F.when(F.col("vec_id") != NULL_ID, F.col("vec_id"))
    usable = vectors.where("usable").groupBy("embedding").agg(F.min(ids).alias("rep"), F.count("*").alias("copies"))
    return written(usable.select(F.monotonically_increasing_id().alias("cid"), F.size("embedding").alias("dim"), "embedding", "rep", "copies"), "vector-classes")


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding, usable): a null id is ``NULL_ID``."""
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda x: F.coalesce(bad(x), F.lit(True))) & F.exists(e, lambda x: x != 0), F.lit(False))
    return pick(embeddings, "vec_id", "embedding").select(id_or_least("vec_id").alias("vec_id"), "embedding", usable.alias("usable"))


def class_links(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """(cid, links, root) a row for each task that links the class: ``links`` sum up over rows, (cid, root) are edges of the components."""
    spark = classes.sparkSession
    total, dim = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = max(SHARDS, -(-total // SHARD))
    shard = F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int")
    schema = f"dim int, shard int, cid long, copies long, embedding {classes.schema['embedding'].dataType.simpleString()}, node int, links array<int>"
    index = written(classes.withColumn("shard", shard).groupBy("dim", "shard").applyInArrow(_build, schema), "vector-index")
    n_bytes = 8 * dim * total
    passes = max(1, -(-(shards + 1) * n_bytes // max(PASS_BYTES, 4 * n_bytes)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * shards * (shards + 1) // passes))
    parts = []
    for p in range(passes):
        now = (F.col("from") + F.col("home")) % passes == p
        left = index.select("dim", F.col("shard").alias("from"), F.explode(F.sequence("shard", F.lit(shards - 1))).alias("home"), "cid", "copies", "embedding", "node").where(now)
        left = left.where("from <> home or node = 0").drop("node")  # a shard is looked up in its own graph without a second copy of it
        right = index.select(F.col("dim").alias("d"), F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("f"), F.col("shard").alias("h"), "cid", "copies", "embedding", "node", "links").where((F.col("f") + F.col("h")) % passes == p)
        left, right = left.repartition(tasks, "dim", "from", "home"), right.repartition(tasks, "d", "f", "h")
        parts.append(written(left.groupBy("dim", "from", "home").cogroup(right.groupBy("d", "f", "h")).applyInArrow(_compare(least), _FOUND), "vector-links"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def near_vectors(embeddings: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings (vec_id, embedding)."""
    rows = vectors_of(embeddings)
    classes = classes_of(rows)
    found = class_links(classes, least)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("cid <> root").distinct(), "cid", "root").toDF("cid", "component")
    judged = classes.join(counts, "cid", "left").join(comps, "cid", "left").select("embedding", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    heads = judged.groupBy("component").agg(F.min("rep").alias("head"))
    judged = judged.join(heads, "component").select("embedding", "n_links", "head")
    linked_rows = rows.where("usable").join(judged, "embedding").select("vec_id", "n_links", "head")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), id_back("vec_id").alias("head"))
    out = linked_rows.unionByName(alone).select(id_back("vec_id").alias("vec_id"), "n_links", F.col("head").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
