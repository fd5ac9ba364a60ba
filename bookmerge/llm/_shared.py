"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The id that stands for a null doc_id inside operators; it sorts before every real id.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder of the setting ``spark.checkpoint.dir``, which driver and executors share; a temporary one only in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bookmerge-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; the store removes it when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, read again: later steps neither repeat its work nor lose it with an executor."""
    return written_in_parts(df, tag)[0]


#: Bytes of a written table for each partition of the shuffle that reads it.
PART_BYTES = 64 << 20


def parts_for(spark: SparkSession, n_bytes: int) -> int:
    """Partitions for so many bytes; the session's number of shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))


def written_in_parts(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """The written table, and the number of partitions in which its size is to be shuffled."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jvm_path).getLength()
    return spark.read.schema(df.schema).parquet(path), parts_for(spark, size)


#: Rows (of a few numbers each) up to which a table of two rows a partition is broadcast.
MAX_BROADCAST_ROWS = 250_000


def small_side(table: DataFrame, rows: int) -> DataFrame:
    """table as the side of a join: broadcast if it has few rows; beyond that the join is by shuffle, with Spark's handling of skew."""
    return F.broadcast(table) if rows <= MAX_BROADCAST_ROWS else table


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns; others, even ones that differ in case alone, are left out before any name is resolved."""
    plain = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*plain).select(*(F.col(plain[df.columns.index(n)]).alias(n) for n in names))


def id_or_least(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


#: Rows and bytes of the pieces in which a function over Arrow batches takes its rows (texts vary from none to megabytes).
ROWS, BYTES = 512, 16 << 20
Batches = Iterator[pa.RecordBatch]


def in_pieces(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run over batches cut into pieces; the session bounds the batches themselves by bytes."""

    def over(batches: Batches) -> Batches:
        def pieces() -> Batches:
            for batch in batches:
                step = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step)

        return run(pieces())

    return over


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
