"""Tables that change in steps: files are written aside, and one small manifest, put in place by one rename, names those that count.

A step that fails before its rename leaves the table as it was; one that is repeated after it changes nothing. Manifests hold names
of folders (one a bucket, or one a session), never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it is not there."""
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def publish(spark: SparkSession, path: str, content: dict) -> None:
    """content as one line of JSON at path: readers see the old file or the new one, never a part."""
    fs, aside = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(content), "utf-8"))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    to = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    to[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, jvm.Path(path), to)


def published(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


class KeyedStore:
    """A table by key, hash-partitioned into buckets; a step rewrites the buckets that its rows fall into, no others.

    ``fold`` makes the new rows of a bucket of its old ones and those that come. Steps are numbered by their writer: a number that was
    published before is left out. The last ``KEPT`` versions of a bucket's files stay for readers that began before a step.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, fold: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.fold = spark, path.rstrip("/"), schema, key, fold
        now = self._manifest()
        self.buckets = now["buckets"] if now else buckets

    def _manifest(self) -> dict | None:
        return published(self.spark, f"{self.path}/manifest.json")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files))

    def read(self) -> DataFrame:
        """The table as the last published step left it."""
        now = self._manifest()
        return self._read([v[-1] for v in now["files"].values()] if now else [])

    def step(self, rows: DataFrame, number: int) -> int:
        """Folds rows into their buckets; the number of buckets that were written (0 for a repeated step)."""
        now = self._manifest() or {"buckets": self.buckets, "last": -1, "files": {}}
        if number <= now["last"]:
            return 0
        name = f"step={number}-{uuid.uuid4().hex}"
        bucketed = rows.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("bucket", self._bucket()).persist()
        try:
            touched = [str(r[0]) for r in bucketed.select("bucket").distinct().collect()]  # as many as there are buckets at most
            if touched:
                old = self._read([now["files"][b][-1] for b in touched if b in now["files"]])
                folded = self.fold(old.unionByName(bucketed.drop("bucket")))
                folded.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        finally:
            bucketed.unpersist()
        written = {f.removeprefix("bucket=") for f in names(self.spark, f"{self.path}/{name}") if f.startswith("bucket=")}
        gone = []
        for b in touched:
            versions = now["files"].pop(b, [])
            if b in written:
                versions = [*versions, f"{name}/bucket={b}"]
                now["files"][b] = versions[-self.KEPT :]
                gone += versions[: -self.KEPT]
            else:  # nothing of the bucket is left
                gone += versions
        publish(self.spark, f"{self.path}/manifest.json", {**now, "last": number})
        for f in gone:
            remove(self.spark, f"{self.path}/{f}")
        return len(touched)
