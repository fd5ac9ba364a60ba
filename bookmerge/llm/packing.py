"""Packing along a space-filling curve: similar documents become neighbours in training sequences.

A document's ids are hashed into 64 counts, scaled to unit length and projected by fixed random signs
to four dimensions. Mean and deviation of each over all documents centre the points, and the Hilbert index of a
centred point is its document's key. Ids are moved in chunks of ``CHUNK``, so a long document is many rows and ranges
are even in bytes. Chunks are range-partitioned and sorted by (key, doc_id, hash of the ids, chunk) - ids in the range key
too, so a group of copies with one key spreads over partitions - and every partition fills sequences of 4096 ids with
its chunks in curve order, cutting them where a sequence is full. Only a partition's last sequence can be short; it is
cut at powers of two, so that nothing needs padding.

Edge cases: a null or empty text is the end id alone; a null doc_id comes first among equal keys;
repeated rows are packed once each; an empty table gives no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import in_pieces, pick, read, written_in_parts
from bookmerge.llm.tokens import definition_of, dtype_for, encoder

LENGTH = 4096
END_ID = 2
DIMS, BITS, BUCKETS, SEED = 4, 15, 64, 20240229
#: Ids of a row that is shuffled.
CHUNK = 8192


def projection() -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (BUCKETS, DIMS)) / np.sqrt(BUCKETS)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, dims), each coordinate below 2**bits; dims * bits is at most 62.

    Follows J. Skilling, "Programming the Hilbert curve" (2004): undo the excess turns from the highest
    bit down, then Gray-decode across the axes, then interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


def points_of(ids: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """A point (DIMS numbers) for each document's ids."""
    counts = np.stack([np.bincount((i.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(26), minlength=BUCKETS) for i in ids]).astype(float)
    counts = np.sqrt(counts)
    return counts / np.maximum(1e-12, np.linalg.norm(counts, axis=1, keepdims=True)) @ signs


def curve_keys(points: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Hilbert keys; three deviations to each side of the mean fill the grid."""
    unit = np.clip((points - mean) / np.maximum(1e-12, 6 * deviation) + 0.5, 0, 1)
    return hilbert((unit * ((1 << BITS) - 1)).astype(np.int64))


def token_rows(docs: DataFrame, definition: str, end_id: int = END_ID, with_point: bool = True) -> DataFrame:
    """(doc_id, point, ids) of every row (point is null unless asked for); ids are little-endian in the tokenizer's narrow type, the end id last."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)  # a file of fixed size
    signs = projection()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        end = np.array([end_id], e.dtype)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [np.concatenate([x, end]) for x in e.encode(batch.column("text").cast(pa.binary()).to_pylist())]
            points = pa.array(points_of(ids, signs).tolist() if with_point else [None] * len(ids), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), points, pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "point", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(in_pieces(run), "doc_id long, point array<double>, ids binary")


def _pack(dtype: str, length: int):
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64()] * 6 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_pieces: list[tuple[int | None, int, np.ndarray, int]] = []  # of the sequence that is being filled
        filled, sequence, part, out = 0, 0, None, []

        def close(pieces) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids), total, part + sequence, at, ids.astype("<u4").tobytes()))
                at += len(ids)
            sequence += 1

        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column("part")[0].as_py() << 40
            for doc, first, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                ids = np.frombuffer(raw, dtype)
                at = 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    some = ids[at : at + take]
                    if open_pieces and first + at and open_pieces[-1][0] == doc and open_pieces[-1][1] + len(open_pieces[-1][2]) == first + at:
                        doc, begun, held, total = open_pieces.pop()  # the document goes on in this sequence
                        open_pieces.append((doc, begun, np.concatenate([held, some]), total))
                    else:
                        open_pieces.append((doc, first + at, some, total))
                    at += take
                    filled += take
                    if filled == length:
                        close(open_pieces)
                        open_pieces, filled = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        while open_pieces:  # less than one sequence: the largest power of two that it can fill, again and again
            room, pieces = 1 << (filled.bit_length() - 1), []
            filled -= room
            while room:
                doc, start, ids, total = open_pieces.pop(0)
                pieces.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    open_pieces.insert(0, (doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            close(pieces)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    from tokenizers import Tokenizer

    definition = definition_of(tokenizer)
    dtype = dtype_for(Tokenizer.from_str(definition).get_vocab_size())
    tokens, parts = written_in_parts(token_rows(docs, definition, end_id), "curve-tokens")
    figures = tokens.agg(*(f(F.col("point")[k]) for f in (F.avg, F.stddev_pop) for k in range(DIMS))).first()  # one row
    mean, deviation = np.array([v or 0.0 for v in figures]).reshape(2, DIMS)

    @F.pandas_udf("long")
    def key(points: pd.Series) -> pd.Series:
        return pd.Series(curve_keys(np.stack(points.tolist()), mean, deviation) if len(points) else np.zeros(0, np.int64))

    width = np.dtype(dtype).itemsize
    size = F.octet_length("ids")
    rows = tokens.select("doc_id", key("point").alias("curve_key"), F.xxhash64("ids").alias("tie"), F.expr(f"octet_length(ids) div {width}").alias("doc_tokens"), "ids", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / (CHUNK * width)).cast("int"))).alias("chunk"))
    rows = rows.select("doc_id", "curve_key", "tie", "doc_tokens", (F.col("chunk").cast("long") * CHUNK).alias("start"), F.substring("ids", F.col("chunk") * (CHUNK * width) + 1, F.lit(CHUNK * width)).alias("ids"))
    order = ["curve_key", "doc_id", "tie", "start"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "start", "doc_tokens", "ids", F.spark_partition_id().cast("long").alias("part")).mapInArrow(in_pieces(_pack(dtype, length)), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, pick(read(spark, sf_dir, "documents"), "doc_id", "text"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with a checksum of their ids."""
    return pack(pick(docs, "doc_id", "text")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
