"""Reading windows, features and lists; the bulk cache and its resumable build."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlegrid.functions.spatial import contains, intersects, road_width
from settlegrid.operators.joins import BOX, window_join


def scan_window(features: DataFrame, window: tuple[float, float, float, float], inside: bool) -> DataFrame:
    """Features of one window. Literals on the nested box reach the Parquet reader's row-group statistics."""
    x0, y0, x1, y1 = window
    b = F.col
    if inside:
        return features.where((b("bbox.xmin") >= x0) & (b("bbox.xmax") <= x1) & (b("bbox.ymin") >= y0) & (b("bbox.ymax") <= y1))
    return features.where((b("bbox.xmax") >= x0) & (b("bbox.xmin") <= x1) & (b("bbox.ymax") >= y0) & (b("bbox.ymin") <= y1))


def buildings(spark: SparkSession, path: str, window: tuple[float, float, float, float]) -> DataFrame:
    """Buildings that lie inside the window: ``id, name, height, num_floors, geometry``."""
    found = scan_window(spark.read.parquet(path), window, inside=True)
    return found.select("id", F.col("names.primary").alias("name"), "height", "num_floors", "geometry")


def roads(spark: SparkSession, path: str, window: tuple[float, float, float, float]) -> DataFrame:
    """Roads that meet the window, with their width: ``id, name, class, subclass, width, geometry``."""
    found = scan_window(spark.read.parquet(path), window, inside=False).where("subtype = 'road'")
    return found.select("id", F.col("names.primary").alias("name"), "class", "subclass", road_width(F.col("class")).alias("width"), "geometry")


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "class")


def extract(features: DataFrame, boxes: DataFrame, inside: bool) -> DataFrame:
    """Features of all windows at once, by ``loc_key``: the bulk form of the scans above."""
    flat = features.select("*", *(F.col(f"bbox.{c}").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")))
    condition: Column = contains(BOX) if inside else intersects(BOX)
    return window_join(flat, boxes, condition).drop("xmin", "xmax", "ymin", "ymax", *BOX)


def write_cache(rows: DataFrame, path: str) -> None:
    """One table clustered by ``loc_key``, so that a window's rows are few row groups."""
    rows.repartitionByRange("loc_key").sortWithinPartitions("loc_key").write.mode("overwrite").option("parquet.block.row.count.limit", 65536).parquet(path)


def read_cache(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the windows in ``keys``, a few or many."""
    return cache.join(keys.select("loc_key").distinct(), "loc_key", "left_semi")


class ChunkedExtract:
    """Extraction file by file with a manifest: chunks that it lists are not made again."""

    def __init__(self, spark: SparkSession, cache_dir: str, chunk_files: int = 16):
        self.spark, self.cache_dir, self.chunk_files = spark, cache_dir.rstrip("/"), chunk_files

    def files(self, path: str) -> list[str]:
        """Input files in order, as Spark lists them on any file system."""
        return sorted(self.spark.read.parquet(path).inputFiles())

    def done(self) -> set[int]:
        try:
            rows = self.spark.read.json(f"{self.cache_dir}/manifest", schema="chunk int, rows long").collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return set()
            raise
        return {r["chunk"] for r in rows}

    def run(self, path: str, boxes: DataFrame, inside: bool) -> int:
        """Make what is missing, then the clustered table; returns how many chunks were made."""
        files, done, made = self.files(path), self.done(), 0
        for n, start in enumerate(range(0, len(files), self.chunk_files)):
            if n in done:
                continue
            out = f"{self.cache_dir}/chunk_{n:04d}"
            extract(self.spark.read.parquet(*files[start : start + self.chunk_files]), boxes, inside).write.mode("overwrite").parquet(out)
            count = self.spark.read.parquet(out).count()
            self.spark.createDataFrame([(n, count)], "chunk int, rows long").coalesce(1).write.mode("append").json(f"{self.cache_dir}/manifest")
            made += 1
        chunks = [f"{self.cache_dir}/chunk_{n:04d}" for n in range(-(-len(files) // self.chunk_files))]
        if chunks:
            write_cache(self.spark.read.parquet(*chunks), f"{self.cache_dir}/final")
        return made


def locations_from_text(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """``lat, lon, name`` from a CSV, JSON or YAML list; ``coords: [lat, lon]`` stands for both. Countries named NA stay text."""
    if kind == "csv":
        rows = list(csv.DictReader(io.StringIO(text)))
    else:
        rows = parse_yaml(text) if kind == "yaml" else json.loads(text)
        rows = rows["locations"] if isinstance(rows, dict) else rows or []
    made = []
    for row in rows:
        lat, lon = row["coords"] if "coords" in row else (row["lat"], row["lon"])
        made.append((float(lat), float(lon), row.get("name")))
    return spark.createDataFrame(made, "lat double, lon double, name string")


def parse_yaml(text: str):
    """YAML as plain values; the parser is an optional dependency."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("YAML lists and settings need the package pyyaml") from error
    return yaml.safe_load(text)


def cache_source(spark: SparkSession, cache_dir: str) -> DataFrame | None:
    """The clustered table of a cache if it is there, else its chunks, else None.

    Chunks count only where the manifest lists them: one that a crash cut short is not read.
    """
    jvm, base = spark._jvm.org.apache.hadoop.fs, cache_dir.rstrip("/")
    final = jvm.Path(f"{base}/final/_SUCCESS")
    if final.getFileSystem(spark._jsc.hadoopConfiguration()).exists(final):
        return spark.read.parquet(f"{base}/final")
    chunks = [f"{base}/chunk_{n:04d}" for n in sorted(ChunkedExtract(spark, base).done())]
    return spark.read.parquet(*chunks) if chunks else None
