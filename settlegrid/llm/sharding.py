"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded key and ranked within their source; sorted by
fractional rank ``(rank - offset) / rows of the source`` the sources interleave
in proportion, so any contiguous cut of that order has the mixture of the whole.
The offset of a source is a point of the golden-ratio sequence, taken by sources
in order of their row counts: sources of one row, however many, lie as evenly as
the rows of one source do, and don't crowd where a fixed offset puts them all.
The order is cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, null_key, running_total, uniform

GOLDEN = 0.6180339887498949


def shard_rows(
    docs: DataFrame,
    shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 4099,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, text_crc32, text_key, place, shard, slot``.

    ``size`` is the UTF-8 length of the text plus 16 (null: 16), ``place`` the
    row's position in the interleaved order from 0, ``slot`` its position in the
    shard, ``text_key`` a hash of the text. A null text has the CRC of the empty text; null sources are one
    source; rows alike in id, text and source are interchangeable; null ids are
    told apart by their texts; with fewer rows than shards some shards are
    empty; an empty table gives no rows; texts are read whole; other columns play no part.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    made = (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_key")
    base = base.select("doc_id", "source", null_key("source").alias("skey"), *made)
    base = base.withColumn("draw", uniform(seed, "doc_id", "text_crc32", "size"))
    base = materialize(running_total(base, ["skey", "draw", "doc_id", "text_crc32", "size"], F.lit(1), "nth"), "shuffled")

    sources = base.groupBy("skey").agg(F.count("*").alias("of_source"), F.min("nth").alias("first"))
    sources = sources.withColumn("lot", uniform(seed + 1, "skey"))
    sources = running_total(sources, ["of_source", "lot", "skey"], F.lit(1), "turn")
    offset = (F.col("turn") * F.lit(GOLDEN)) % F.lit(1.0)
    sources = materialize(sources.select("skey", "of_source", "first", offset.alias("offset")), "sources")
    fraction = (F.col("nth") - F.col("first") + F.col("offset")) / F.col("of_source")
    ranked = base.join(sources, "skey").withColumn("fraction", fraction).withColumn("tie", uniform(seed + 2, "skey", "nth"))
    placed = running_total(ranked.drop("draw", "nth", "first", "offset", "of_source"), ["fraction", "tie", "skey"], F.lit(1), "place")
    placed = materialize(placed.withColumn("place", F.col("place") - 1), "placed")
    placed = placed.withColumn("of_all", F.lit(placed.count()))
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards} div of_all as int)"))
    first = F.expr(f"(shard * of_all + {shards - 1}) div {shards}")
    placed = placed.withColumn("slot", (F.col("place") - first).cast("long"))
    return placed.select("doc_id", "source", "size", "text_crc32", "text_key", "place", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the columns ``shard`` and ``slot``, which replace such columns of ``docs``.

    Rows are matched by id and text, nulls included; of rows alike in both, the
    n-th takes the n-th placement of those. Defined cases are those of
    ``shard_rows``; other columns, whatever their names, stay as they are.
    """
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    key, nth, sid, skey, snth = (fresh(docs, n) for n in ("key", "nth", "sid", "skey", "snth"))
    rows = docs.select(*own, F.xxhash64(text_col).alias(key)).withColumn(nth, F.row_number().over(Window.partitionBy(id_col, key).orderBy(F.lit(1))))
    places = shard_rows(docs, shards, id_col=id_col, text_col=text_col, **options)
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("place"))
    places = places.select(F.col("doc_id").alias(sid), F.col("text_key").alias(skey), "shard", "slot", turn.alias(snth))
    joined = rows.join(places, rows[id_col].eqNullSafe(places[sid]) & (rows[key] == places[skey]) & (rows[nth] == places[snth]))
    return joined.select(*own, "shard", "slot")
