"""Line dedup: line hashes in ranges, sorted by hash, document and position; the first occurrence stays.

Each line of ten or more code points becomes a 16-byte hash row. Rows are range-partitioned on (hash,
document, position), so one very common line spreads over as many partitions as its rows need, and each
partition streams its sorted rows in bounded batches. Inside a partition the document that holds a hash
first is the owner; lines of other documents are dropped. Only a partition's leading run may have begun
before it: its rows are marked open, every partition tells the first document of its leading and
trailing runs (two rows at most), and the least of those decides. What comes back is a compressed bitmap of kept
lines for each document, not text.

Edge cases: a null or empty text is one empty line; an empty table gives no rows; rows that share a
doc_id hold their lines under the same id but get their own bitmap; a null doc_id counts as smaller
than any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import id_or_least, in_pieces, pick, read, small_side, written, written_in_parts

MIN_POINTS = 10
_ROW = "h1 long, h2 long, d long, row_key long, pos int, n_lines int"
_STREAM = "kind byte, h1 long, h2 long, d long, row_key long, pos int, n_lines int"
_DROP, _OPEN, _MARKER = range(3)


def keys_of(raw: bytes | None) -> list[bytes]:
    return [line.strip(b" \t\n\r\x0b\x0c").lower() for line in (raw or b"").split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least


def _hash_lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ds, rows, at, ns = [], [], [], [], []
            for d, row_key, raw in zip(batch.column("d").to_pylist(), batch.column("row_key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                lines = keys_of(raw)
                for i, key in enumerate(lines):
                    if long_enough(key, least):
                        digests.append(xxhash.xxh3_128_digest(key))
                        ds.append(d)
                        rows.append(row_key)
                        at.append(i)
                        ns.append(len(lines))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(ds, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(ns, pa.int32())], ["h1", "h2", "d", "row_key", "pos", "n_lines"])

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; dropped rows, open rows of the leading run and markers out."""
    names = ["kind", "h1", "h2", "d", "row_key", "pos", "n_lines"]
    lead = last = owner = None  # hash of the leading run; of the current run, and its first document

    def markers(rows: list[tuple[tuple[int, int], int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_MARKER] * len(rows), pa.int8()), pa.array([h[0] for h, _ in rows], pa.int64()), pa.array([h[1] for h, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.int64()), *(pa.array([0] * len(rows), t) for t in (pa.int64(), pa.int32(), pa.int32()))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, d = (batch.column(c).to_numpy() for c in ("h1", "h2", "d"))
        fresh = np.empty(len(h1), bool)
        fresh[0] = last != (int(h1[0]), int(h2[0]))
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if lead is None:
            lead = int(h1[0]), int(h2[0])
            yield markers([(lead, int(d[0]))])
        run = np.cumsum(fresh)
        firsts = np.concatenate([[owner if owner is not None else 0], d[fresh]])
        owners = firsts[run]
        is_open = (h1 == lead[0]) & (h2 == lead[1])
        out = is_open | (d != owners)
        last, owner = (int(h1[-1]), int(h2[-1])), int(owners[-1])
        if out.any():
            chosen = pa.array(np.flatnonzero(out))
            kind = np.where(is_open, _OPEN, _DROP).astype(np.int8)[out]
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(batch.column(c).take(chosen) for c in names[1:])], names)
    if last is not None and last != lead:
        yield markers([(last, owner)])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_dropped, maps = [], []
        for n, at in zip(batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[at] = False
            n_dropped.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("row_key"), pa.array(n_dropped, pa.int64()), pa.array(maps, pa.binary())], ["d", "row_key", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    """(d, row_key, n_dropped, keep_bitmap) for each row of docs (doc_id, text) that loses lines.

    d is doc_id (null as the least id), row_key a hash of the text; keep_bitmap is zlib over one bit a line.
    """
    rows = docs.select(id_or_least().alias("d"), F.xxhash64("text").alias("row_key"), "text").mapInArrow(in_pieces(_hash_lines(least)), _ROW)
    rows, parts = written_in_parts(rows, "lines")  # range bounds and the sort both read it
    ordered = rows.repartitionByRange(parts, "h1", "h2", "d", "pos", "row_key").sortWithinPartitions("h1", "h2", "d", "pos", "row_key")
    stream = written(ordered.mapInArrow(_first_occurrences, _STREAM), "first-lines")
    # Two rows a partition at most, so they grow with the number of partitions.
    owners = written(stream.where(F.col("kind") == _MARKER).groupBy("h1", "h2").agg(F.min("d").alias("owner")), "owners")
    still_open = stream.where(F.col("kind") == _OPEN).join(small_side(owners, owners.count()), ["h1", "h2"]).where("d <> owner")
    dropped = stream.where(F.col("kind") == _DROP).select("d", "row_key", "pos", "n_lines").unionByName(still_open.select("d", "row_key", "pos", "n_lines"))
    grouped = dropped.groupBy("d", "row_key").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    return grouped.mapInArrow(_bitmaps, "d long, row_key long, n_dropped long, keep_bitmap binary")


def kept_text(raw: bytes | None, bitmap: bytes | None) -> tuple[int, bytes]:
    """Number of lines, and those that the bitmap keeps, joined."""
    lines = (raw or b"").split(b"\n")
    if bitmap is None:
        return len(lines), raw or b""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    return len(lines), b"\n".join(line for line, k in zip(lines, keep.tolist(), strict=True) if k)


def with_bitmaps(docs: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    """docs (doc_id, text, ...) with n_dropped and keep_bitmap (null: all lines stay)."""
    maps = keep_bitmaps(pick(docs, "doc_id", "text"), least)
    left = docs.withColumn("__d", id_or_least()).withColumn("__row_key", F.xxhash64("text"))
    return left.join(maps.toDF("__d", "__row_key", "n_dropped", "keep_bitmap"), ["__d", "__row_key"], "left").drop("__d", "__row_key").withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_bitmaps(pick(read(spark, sf_dir, "documents"), "doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_text(raw, m) for raw, m in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("keep_bitmap").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in done], pa.int64()), batch.column("n_dropped"), pa.array([hashlib.sha256(t).hexdigest() for _, t in done], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return docs.mapInArrow(in_pieces(digest), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated lines gone from their texts; a null text stays null; n_chars follows the text where it is a column."""
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    d, t = plain[names.index("doc_id")], plain[names.index("text")]
    joined = with_bitmaps(docs.toDF(*plain).withColumnsRenamed({d: "doc_id", t: "text"}))
    fields = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    order = ["doc_id" if c == d else "text" if c == t else c for c in plain]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            done = [r if r is None else kept_text(r, m)[1] for r, m in zip(raw, batch.column("keep_bitmap").to_pylist(), strict=True)]
            columns = [pa.array(done, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in order]
            yield pa.RecordBatch.from_arrays(columns, order)

    out = joined.mapInArrow(in_pieces(apply), ", ".join(f"`{c}` {fields[c]}" for c in order)).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
