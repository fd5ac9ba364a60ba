"""Token-id files: ids ranked by corpus frequency in byte-aligned variable-length code, control bytes apart.

Ids are counted over all documents (one counter array a task, summed by id; the result is as large as
the vocabulary) and replaced by their frequency rank, so frequent ids take one byte. As in stream
variable-byte coding (Lemire, Kurz, Rupp 2018), two bits an id give its number of bytes; four such
codes fill a control byte, and control bytes stand apart from data bytes, so numpy decodes whole blocks by
table lookup. Documents are range-partitioned and sorted by doc_id; a shard holds consecutive blocks.
Shards are rows of binary columns that Spark's writer commits, so a lost task leaves no half file and
any store that Spark writes to will do.

Edge cases: a null or empty text is the end id alone; a null doc_id comes first; rows that share a
doc_id follow one another in the order of a hash of their ids; an empty table makes files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import in_pieces, new_path, pick, read, small_side, written_in_parts
from bookmerge.llm.packing import END_ID, token_rows
from bookmerge.llm.tokens import definition_of, dtype_for

#: Ids after which a block ends (with the document that reaches it).
BLOCK_IDS = 1 << 16
#: For each control byte: bytes of its four ids.
SIZES = np.stack([(np.arange(256) >> 2 * k & 3) + 1 for k in range(4)], axis=1)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks (uint32)."""
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.concatenate([size - 1, np.zeros(-len(size) % 4, np.int64)]).reshape(-1, 4)
    control = (code << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    return control.tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    at = np.cumsum(size) - size
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        longer = size > k
        if longer.any():
            out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _count(dtype: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            raw = b"".join(batch.column("ids").to_pylist())
            counts += np.bincount(np.frombuffer(raw, dtype), minlength=vocabulary)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], ["id", "n"])

    return run


def _encode(dtype: str, rank_of, block_ids: int):
    names = ["shard", "block", "start", "doc_ids", "lengths", "n_ids", "control", "data"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank_of.value
        docs, parts, size, block, start, shard = [], [], 0, 0, 0, None

        def row() -> pa.RecordBatch:
            control, data = encode_block(ranks[np.concatenate(parts)])
            lengths = np.array([len(p) for p in parts], "<u4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, block, start, docs, lengths, size, control, data), types, strict=True)], names)

        for batch in batches:
            if shard is None and batch.num_rows:
                shard = batch.column("shard")[0].as_py()
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                parts.append(np.frombuffer(raw, dtype))
                size += len(parts[-1])
                if size >= block_ids:
                    yield row()
                    block, start = block + 1, start + size
                    docs, parts, size = [], [], 0
        if docs:
            yield row()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes path/blocks (the shards) and path/ranks (rank to id) for docs (doc_id, text)."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    definition = definition_of(tokenizer)
    vocabulary = Tokenizer.from_str(definition).get_vocab_size()
    dtype = dtype_for(vocabulary)
    tokens, parts = written_in_parts(token_rows(docs, definition, end_id, with_point=False).select("doc_id", "ids"), "tokens")
    counted = tokens.select("ids").mapInArrow(in_pieces(_count(dtype, vocabulary)), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r["id"] for r in sorted(counted.collect(), key=lambda r: (-r["n"], r["id"]))]  # no longer than the vocabulary
    spark.createDataFrame([(order,)], "ids array<int>").write.parquet(f"{path}/ranks")
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = ordered.select("doc_id", "ids", F.spark_partition_id().cast("long").alias("shard")).mapInArrow(in_pieces(_encode(dtype, spark.sparkContext.broadcast(rank_of), block_ids)), "shard long, block long, start long, doc_ids array<long>, lengths binary, n_ids long, control binary, data binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) in the files: start counts all ids before the document, ids are little-endian uint32."""
    blocks = spark.read.parquet(f"{path}/blocks")
    first = spark.read.parquet(f"{path}/ranks").first()  # as long as the vocabulary at most
    id_of = spark.sparkContext.broadcast(np.array(first["ids"], "<u4"))
    sizes = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a row a shard
    base, bases = 0, []
    for shard, n in sizes:
        bases.append((shard, base))
        base += n
    shard_base = spark.createDataFrame(bases, "shard long, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_by_rank = id_of.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = ids_by_rank[decode_block(row["control"], row["data"], row["n_ids"])]
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                starts = row["base"] + row["start"] + ends - lengths
                raw = [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(raw, pa.binary())], ["doc_id", "start", "ids"])

    return blocks.join(small_side(shard_base, len(bases)), "shard").mapInArrow(in_pieces(run), "doc_id long, start long, ids binary")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-file")
    write_tokens(pick(read(spark, sf_dir, "documents"), "doc_id", "text"), path)
    return read_tokens(spark, path).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
