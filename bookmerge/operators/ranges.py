"""Numbers within groups of any size: rows are dealt by ranges, so no task sorts or numbers a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookmerge.operators.graph import durable


def numbered(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """df with ``name``: the place (from 0) of a row within its group ``by``, in ascending order.

    Rows are dealt by ranges of (by, order) and numbered inside a range; row counts of the ranges, one a group and
    range, are the offsets. The ranges are written, so that counts and numbers see the same ones; rows that agree in both are
    spread by their hash.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(df.repartitionByRange(parts, *by, order, F.xxhash64(*df.columns)).withColumn("__part", F.spark_partition_id()))
    ranges = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    place = F.row_number().over(W.partitionBy(*by, "__part").orderBy(order)) - 1
    return dealt.withColumn("__at", place).join(offsets, same).withColumn(name, F.col("__at") + F.col("__before")).select(*df.columns, name)
