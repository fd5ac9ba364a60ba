"""Connected components of an edge table, by DataFrame joins and minima only.

Each round every node takes the least label among its neighbours, hooks its old label to it, and
then takes its label's label (the steps of FastSV, Zhang, Azad, Hu 2020), so the number of rounds grows with
the logarithm of a component's diameter. Labels of a round are one table in the shared folder: the
lineage stays short, a lost executor costs a stage, and joins read plain tables, so Spark can split
a hub's rows. Nothing is gathered on the driver but the number of labels that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookmerge.llm._shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node of its component; only nodes with an edge to another occur."""
    x, y = F.col(a), F.col(b)
    both = edges.where(x != y).select(F.explode(F.array(F.struct(x.alias("u"), y.alias("v")), F.struct(y.alias("u"), x.alias("v")))).alias("e")).select("e.u", "e.v").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        least = both.join(labels.toDF("v", "lv"), "v").groupBy("u").agg(F.min("lv").alias("least"))
        seen = least.join(labels.toDF("u", "old"), "u").where("least < old")
        moved = seen.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("least").alias("label")), F.struct(F.col("old").alias("node"), F.col("least").alias("label")))).alias("m")).select("m.*")
        before = labels.select("node", "label", F.col("label").alias("old"))
        hooked = before.unionByName(moved, allowMissingColumns=True).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        roots = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = written(hooked.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label"), "old"), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels.toDF("node", "component")
