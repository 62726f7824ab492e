"""The keyed results store: upsert, failure marks, merge, export, status; over Parquet.

A store is a table with one row per key. Writing makes a new version beside the
old one and moves the pointer last, so readers and retried jobs see one or the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ERROR_LENGTH = 500


def latest(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The row of each key that comes first in ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace those of the same key; NaN becomes NULL; columns that either lacks are NULL there."""
    numeric = [f.name for f in rows.schema if f.dataType.simpleString() in ("double", "float")]
    clean = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numeric})
    return store.join(clean.select(*keys), keys, "left_anti").unionByName(clean, allowMissingColumns=True)


def mark_failed(store: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """``failures`` (keys and ``error``) replace whole rows: status failed, the error cut, all else NULL."""
    rows = failures.select(*keys, F.lit("failed").alias("status"), F.substring("error", 1, ERROR_LENGTH).alias("error"))
    return store.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def merge(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` win, over the columns both have; columns only ``target`` has are NULL in them."""
    common = [c for c in target.columns if c in source.columns]
    if not common:
        raise ValueError("the stores have no column in common")
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*common), allowMissingColumns=True)


def status_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("status").agg(F.count("*").alias("n"))


def done_keys(store: DataFrame, keys: list[str]) -> DataFrame:
    return store.where("status = 'done'").select(*keys).distinct()


class ResultStore:
    """A versioned store in a folder. One writer at a time.

    A write adds a version and then a pointer to it with the next number; the
    pointer with the highest number counts. Pointers are only ever added, so a
    crash at any moment leaves the state before or after the write.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema

    def _current(self) -> str | None:
        return self._newest()[1]

    def _newest(self) -> tuple[int, str | None]:
        """Number and version of the newest pointer; (0, None) for a new store."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        files = jvm.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(jvm.Path(f"{self.path}/_pointers")):
            if files.globStatus(jvm.Path(f"{self.path}/v-*")):
                raise RuntimeError(f"{self.path} has versions but no pointer to one; remove what an unfinished first write left")
            return 0, None
        newest = self.spark.read.schema("number long, version string").json(f"{self.path}/_pointers").where("number is not null").orderBy(F.col("number").desc()).first()
        if newest is None:
            raise RuntimeError(f"{self.path}/_pointers holds no pointer")
        return newest["number"], newest["version"]

    def read(self) -> DataFrame:
        """The store; columns added to the schema since it was written are NULL."""
        version = self._current()
        empty = self.spark.createDataFrame([], self.schema)
        return empty if version is None else empty.unionByName(self.spark.read.parquet(f"{self.path}/{version}"), allowMissingColumns=True)

    def _write(self, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        number, _ = self._newest()
        df.write.parquet(f"{self.path}/{version}")
        self.spark.createDataFrame([(number + 1, version)], "number long, version string").coalesce(1).write.mode("append").json(f"{self.path}/_pointers")

    def upsert(self, rows: DataFrame) -> None:
        self._write(upsert(self.read(), rows, self.keys))

    def mark_failed(self, failures: DataFrame) -> None:
        self._write(mark_failed(self.read(), failures, self.keys))

    def merge(self, other: DataFrame) -> tuple[int, int]:
        """Rows before and after."""
        before = self.read().count()
        self._write(merge(self.read(), other, self.keys))
        return before, self.read().count()

    def done_keys(self) -> DataFrame:
        return done_keys(self.read(), self.keys)

    def export_csv(self, path: str) -> None:
        self.read().coalesce(1).write.mode("overwrite").option("header", True).csv(path)
