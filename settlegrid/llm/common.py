"""What the corpus operators share: table access, shared-storage tables and key helpers."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space and tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (local tests) a folder of this machine takes its place; elsewhere it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _local_dirs.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_dirs[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="settlegrid-")
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, *, sparse: bool = False) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    The result has no lineage to what made it: a lost executor costs a re-read,
    not a recomputation, and branches that start from it don't repeat the scan.
    ``sparse`` tables are the little that a wide stage leaves: their rows are
    moved once more, into as few files as their size needs, instead of one small file a task.
    """
    path = f"{shared_dir(df.sparkSession)}/settlegrid/{label}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if sparse else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken, found = {c.lower() for c in df.columns}, f"_{name}"
    while any(c.startswith(found.lower()) for c in taken):
        found = f"_{found}"
    return found


def id_type(df: DataFrame, column: str) -> str:
    """The type of a column, as a schema string has it."""
    return df.select(column).schema[0].dataType.simpleString()


#: Rows of one cell of a global order; a window never holds more than about one cell.
CELL_ROWS = 250_000


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the column ``name``: the sum of ``value`` over all rows up to this one in the global ``order``.

    The rows are dealt into cells by ranges of the order, cut at quantiles that
    Spark samples, so cells are alike in size whatever the keys; sums within a
    cell add to those of the cells before it. Written before and after the
    cut, so that a repeated task sees the same cells. Rows alike in ``order`` stand next to each other in no
    particular order.
    """
    cell, total, ahead = fresh(df, "cell"), fresh(df, "total"), fresh(df, "ahead")
    held = materialize(df.withColumn(total, value.cast("long")), "unordered")
    session = df.sparkSession
    cells = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // CELL_ROWS))
    held = materialize(held.repartitionByRange(cells, *order).withColumn(cell, F.spark_partition_id()), "cells")
    sums = held.groupBy(cell).agg(F.sum(total).alias(ahead))
    before = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(cell, F.coalesce(F.sum(ahead).over(before), F.lit(0)).alias(ahead))
    within = Window.partitionBy(cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn(name, F.sum(total).over(within)).join(sums, cell)
    return ranked.withColumn(name, F.col(name) + F.col(ahead)).drop(cell, total, ahead)


def null_key(column: str) -> Column:
    """A never-null string that differs for null, the empty string and every other value."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def uniform(seed: int, *columns: str) -> Column:
    """A reproducible draw from the open interval (0, 1): 48 bits of an MD5 of the columns."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns), F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**48))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id, as text, has that remainder. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, *, id_col: str = "doc_id", text_col: str = "text", modulus: int, remainder: int, seed: int = 11) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents that aren't held out.

    The rows with the least draws of the id are taken, so a larger table gives
    as many. Ids are chosen before texts are read; the few chosen ids are
    joined by broadcast, their number being the bound. Of rows that share an id
    one gives its text, the one whose text has the least hash.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, modulus, remainder))
    usable = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("label"))
    usable = usable.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    chosen = usable.withColumn("_draw", uniform(seed, "_id")).orderBy("_draw", "_id").limit(rows)
    chosen = materialize(chosen.select("_id", "label", "_draw"), "chosen")
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.first("label").alias("label"))


def send(df: DataFrame, model):
    """Broadcast a fitted model (of a size fixed by its parameters) to the tasks; ``receive`` opens it there."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))


def receive(sent):
    return pickle.loads(sent.value)
