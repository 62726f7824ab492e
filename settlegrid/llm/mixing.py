"""Mixing sources to target weights by weighted sampling without replacement.

Method: Efraimidis-Spirakis. Each document draws ``u`` and gets the exponential
key ``-ln(u) / quality``; sorted by key within its source, documents are taken
until their prefix sum meets the source's token budget. A source whose target
is over its size first gives complete epochs; only the rest is drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize, null_key, running_total, uniform


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: str, size: Column) -> Column:
    """Default quality weight, 1 for a mean word length near 5 characters and less the further from it."""
    per_word = F.coalesce(F.length(F.col(text)), F.lit(0)) / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(per_word - F.lit(6.0)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Token targets of sources: ``skey, source, source_size`` in, ``target`` (double) added.

    Sources by code point, null last, take ``weights`` in turn. All targets
    together are as large as all sources; a target stops at ``cap`` times its
    source and what is over goes to the others by weight. With sources sorted
    by cap / weight the capped ones come first, so the common level of the
    others follows from prefix sums. One row per source passes through here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("n", F.row_number().over(order)).withColumn("weight", weight)
    ranked = ranked.withColumn("ceiling", F.lit(float(cap)) * F.col("source_size"))
    by_room = Window.orderBy((F.col("ceiling") / F.col("weight")).asc(), F.col("n"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double")
    all_weight = F.sum("weight").over(every)
    level = (total - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct("place", "level"))
    ranked = ranked.withColumn("place", F.row_number().over(by_room)).withColumn("first_fit", F.min(fits).over(every)["level"])
    target = F.least(F.col("ceiling"), F.coalesce(F.col("first_fit") * F.col("weight"), F.col("ceiling")))
    return ranked.select("skey", "source_size", target.alias("target"))


def _keyed(id_col: str, text_col: str, source_col: str, quality: Column | None, seed: int) -> dict[str, Column]:
    """What decides about a row, as columns of the documents: ``source, skey, size, key``."""
    size = word_count(text_col)
    worth = text_quality(text_col, size) if quality is None else F.coalesce(quality.cast("double"), F.lit(0.0))
    return {
        "source": F.col(source_col).cast("string"),
        "skey": null_key(source_col),
        "size": size,
        "key": -F.ln(uniform(seed, id_col)) / F.greatest(worth, F.lit(1e-6)),
    }


def mix_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: tuple[float, ...] = (1, 2, 3),
    cap: float = 3.0,
    seed: int = 1729,
) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: ``doc_id, source, size, source_size, target,
    copies, taken`` with ``taken = copies * size``. ``quality`` is a positive
    weight (null, zero or less counts as the least weight, 1e-6).

    Keys are sorted within their source by one global order of source and key,
    whose running total less that of the sources before is the prefix sum; no
    source and no range of keys meets in one task.

    Defined cases: null text has size 0; null sources are a source of their own,
    sorted last; null ids share one draw; empty documents are never drawn but
    belong to complete epochs; equal keys (repeated rows) go by id and size; an
    empty table gives an empty result; texts are read whole, whatever their
    length; columns other than the three named have no part in it. A document in
    which the budget ends is taken if more than half of it fits.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(n) for n, c in _keyed(id_col, text_col, source_col, quality, seed).items()))
    placed = materialize(running_total(base, ["skey", "key", "doc_id", "size"], F.col("size"), "upto"), "mix")

    sizes = placed.groupBy("skey").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    starts = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sizes, weights, cap).withColumn("start", F.coalesce(F.sum("source_size").over(starts), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.join(materialize(targets.withColumn("epochs", epochs), "targets"), "skey")
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    middle = F.col("upto") - F.col("start") - F.col("size") / F.lit(2.0)
    drawn = F.when((F.col("size") > 0) & (budget > 0) & (middle < budget), F.lit(1)).otherwise(F.lit(0))
    placed = placed.withColumn("drawn", drawn).withColumn("copies", (F.col("epochs") + F.col("drawn")).cast("long"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return placed.select("doc_id", "source", "size", F.col("source_size").cast("long"), "target", "copies", taken, "skey", "key", "epochs", "drawn")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it, columns unchanged.

    What a source draws is a prefix of its order, so its last drawn key tells
    for every row whether it is drawn: texts are not moved to be matched.

    Defined cases are those of ``mix_counts``; rows alike in id, source and size
    (repeated rows) share the decision of the last of them; any other columns,
    whatever their names, stay as they are.
    """
    counts = materialize(mix_counts(docs, **options), "counts")
    last = F.max(F.when(F.col("drawn") == 1, F.struct("key", "doc_id", "size")))
    names = {n: fresh(docs, n) for n in ("skey", "epochs", "last", "row")}
    ends = counts.groupBy("skey").agg(F.first("epochs").cast("int").alias(names["epochs"]), last.alias(names["last"])).withColumnRenamed("skey", names["skey"])
    ends = materialize(ends, "ends")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keyed = _keyed(id_col, text_col, options.get("source_col", "source"), options.get("quality"), options.get("seed", 1729))
    row = F.struct(keyed["skey"].alias("skey"), F.struct(keyed["key"].alias("key"), F.col(id_col).alias("doc_id"), keyed["size"].alias("size")).alias("at"))
    joined = docs.withColumn(names["row"], row)
    joined = joined.join(ends, F.col(names["row"])["skey"] == F.col(names["skey"]))
    drawn = F.when((F.col(names["row"])["at"]["size"] > 0) & (F.col(names["row"])["at"] <= F.col(names["last"])), 1).otherwise(0)
    copies = F.col(names["epochs"]) + drawn
    copies = F.explode(F.array_repeat(F.lit(0), copies))
    return joined.select(*docs.columns, copies.alias(names["last"])).select(*docs.columns)
