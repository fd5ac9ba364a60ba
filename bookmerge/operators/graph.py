"""Steps on written tables, and clusters of pairs (O22): connected components by DataFrame joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of the setting spark.checkpoint.dir; a temporary one only in local mode. Elsewhere executors could not read it: an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bookmerge-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder and read again: lineage ends, executors may go."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clusters(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, cluster) for every id in pairs; cluster is the least id reachable.

    Least neighbour labels, with labels of labels each round, so chains shorten geometrically. A round is one
    written table, which also tells whether a label moved.
    """
    both = durable(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(pairs.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = durable(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("cluster")))
    while True:
        near = both.join(labels.toDF("v", "other"), "v").groupBy("u").agg(F.min("other").alias("least"))
        moved = near.join(labels.toDF("u", "old"), "u").where("least < old")
        moved = moved.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("least").alias("cluster")), F.struct(F.col("old").alias("id"), F.col("least").alias("cluster")))).alias("m")).select("m.*")
        before = labels.select("id", "cluster", F.col("cluster").alias("old"))
        hooked = before.unionByName(moved, allowMissingColumns=True).groupBy("id").agg(F.min("cluster").alias("cluster"), F.min("old").alias("old"))
        roots = hooked.select(F.col("id").alias("cluster"), F.col("cluster").alias("root"))
        shorter = durable(hooked.join(roots, "cluster", "left").select("id", F.coalesce("root", "cluster").alias("cluster"), "old"))
        labels = shorter.select("id", "cluster")
        if shorter.where("cluster <> old").isEmpty():
            return labels
