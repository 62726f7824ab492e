"""Benchmark decontamination by SimHash of item-sized windows, in SQL functions only.

A benchmark item of n words is looked for in every document window of n words.
Windows and items have 64-bit SimHash fingerprints over their word shingles,
each occurrence of a shingle voting once. Fingerprints are cut into blocks; if
two differ in fewer than 7 * (f + 1) bits, one of the seven blocks differs in at most f
bits, so joining on blocks, with f flips enumerated on the items' side,
finds every pair within that radius. The weighted Jaccard similarity of the
shingles, occurrences being the weights, then decides.

Fingerprints are made only for windows that can reach the threshold t at all.
A window of w shingles and an item of k need at least t / (1 + t) * (w + k)
positions with a shingle of the item. Moving a window up to its first such
position loses none of them, so windows that start elsewhere need not be tried.
At t = 0.8 a similar pair is outside the radius with a chance under 0.0005, at
0.85 and above under 0.00001, where the window is as long as the item. Documents
shorter than an item lose more (see README).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .near_dup import keep_ids

WIDTH = 5
#: Seven blocks with two flips each reach 7 * (2 + 1) - 1 bits; with few shingles a
#: fingerprint is rougher, so items of at most ``FEW`` shingles get three flips and 27 bits.
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
FLIPS = 2
FEW = 24


def words(text: str) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(column: str, width: int) -> Column:
    """Hashes of the ``width``-word shingles of an array of words, in order.

    The words are bound to a variable of an outer lambda, so that what makes
    them runs once per row and not once per shingle, however projections merge.
    """
    parts = ", ".join(f"get(w, i + {k})" for k in range(width))
    each = f"if(size(w) < {width}, cast(array() as array<bigint>), transform(sequence(0, size(w) - {width}), i -> xxhash64({width}, {parts})))"
    return F.expr(f"transform(array({column}), w -> {each})[0]")


def simhash(hashes: str) -> Column:
    vote = f"aggregate({hashes}, 0, (s, x) -> s + cast(shiftright(x, b) & 1L as int)) * 2 > size({hashes})"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> if({vote}, acc | shiftleft(1L, b), acc))")


def _blocks(fingerprint: str) -> list[tuple[int, int, str]]:
    """Number, width and value (SQL) of the blocks."""
    out, start = [], 0
    for n, width in enumerate(BLOCKS):
        out.append((n, width, f"cast(shiftrightunsigned({fingerprint}, {start}) & {(1 << width) - 1}L as int)"))
        start += width
    return out


def block_keys(fingerprint: str, flips: int) -> Column:
    """Keys ``block * 1024 + value`` of a fingerprint, with every value at most ``flips`` bits away."""
    keys = []
    for n, width, value in _blocks(fingerprint):
        masks = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(width), k)]
        keys.append(f"transform(array({', '.join(map(str, masks))}), m -> {n} * 1024 + ({value} ^ m))")
    return F.expr(f"concat({', '.join(keys)})")


def radius(flips: int) -> int:
    """Bits in which fingerprints may differ so that some block differs in at most ``flips``."""
    return len(BLOCKS) * (flips + 1) - 1


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of least over sum of greatest occurrences of the hashes in two arrays."""
    plain = f"size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b})"
    least = f"aggregate(array_intersect({a}, {b}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    common = f"(if({plain}, size(array_intersect({a}, {b})), {least}))"
    return F.expr(f"cast({common} as double) / (size({a}) + size({b}) - {common})")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item_id, n_words, width, hashes``: an item under ``WIDTH`` words is one shingle of its own width."""
    found = benchmark.select(F.col(item_col).alias("item_id"), words(text_col).alias("w")).withColumn("n_words", F.size("w")).where("n_words > 0")
    hashes = F.coalesce(*(F.when(F.col("n_words") == k, shingles("w", k)) for k in range(1, WIDTH)), shingles("w", WIDTH))
    return found.select("item_id", "n_words", F.least("n_words", F.lit(WIDTH)).alias("width"), hashes.alias("hashes")).dropDuplicates(["item_id", "hashes"])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.8,
) -> DataFrame:
    """``doc_id, item_id, similarity, start``: the items found in each document, one row per pair.

    ``similarity`` is that of the best window, ``start`` the first word (from 0)
    at which it begins. A document shorter than an item is one window. Null,
    empty and wordless texts and items match nothing. Rows that share an id are
    one document; a null id is an id like others. Items that are equal are found
    each. Very long texts are read whole; other columns play no part. Empty tables give no rows.
    """
    items = materialize(_items(benchmark, item_col, item_text_col), "items")
    grams = items.select("item_id", "n_words", "width", F.explode(F.array_distinct("hashes")).alias("hash"))
    grams = materialize(grams, "grams")

    # One scan makes the shingles of every width; those of no item's width are left out.
    widths = materialize(items.select("width").distinct(), "widths")
    wanted = {f"w{k}": F.max(F.when(F.col("width") == k, True)).alias(f"w{k}") for k in range(1, WIDTH + 1)}
    wanted = widths.agg(*wanted.values()).first()
    rows = docs.select(F.col(id_col).alias("doc_id"), words(text_col).alias("w")).withColumn("n", F.size("w"))
    made = [F.struct(F.lit(k).alias("width"), shingles("w", k).alias("h")) for k in range(1, WIDTH + 1) if wanted[f"w{k}"]]
    if not made:
        made = [F.struct(F.lit(WIDTH).alias("width"), F.expr("cast(array() as array<bigint>)").alias("h"))]
    spread = rows.select("doc_id", "n", F.explode(F.array(*made)).alias("s")).select("doc_id", "n", "s.width", F.posexplode("s.h").alias("pos", "hash"))
    anchors = spread.join(grams, ["hash", "width"]).select("doc_id", "n", "pos", "item_id", "n_words", "width")

    # A window that starts at position p has enough of the item if its m-th anchor from p on is still inside.
    w, k = "(least(n, n_words) - width + 1)", "(n_words - width + 1)"
    need = F.expr(f"greatest(1, cast(ceil({threshold} / {1 + threshold} * ({w} + {k}) - 1e-9) as int))")
    counted = anchors.groupBy("doc_id", "n", "item_id", "n_words", "width").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    counted = counted.withColumn("need", need).where(F.size("at") >= F.col("need"))
    starts = F.expr(f"filter(transform(sequence(0, size(at) - need), i -> if(at[i + need - 1] - at[i] < {w}, at[i], null)), p -> p is not null)")
    windows = counted.select("doc_id", "n", "n_words", "width", F.explode(starts).alias("p"))
    windows = windows.select("doc_id", "n_words", "width", F.greatest(F.lit(0), F.least(F.col("p"), F.col("n") - F.col("n_words"))).alias("start")).distinct()
    windows = materialize(windows, "windows")

    ids = windows.select(F.col("doc_id").alias("id")).distinct()
    near = keep_ids(docs.select(F.col(id_col).alias("doc_id"), text_col), "doc_id", ids)
    texts = near.select(F.col("doc_id").alias("id"), words(text_col).alias("w"))
    cut = windows.join(texts, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "n_words", "width", "start", F.expr("slice(w, start + 1, n_words)").alias("w"))
    hashes = F.coalesce(*(F.when(F.col("width") == k, shingles("w", k)) for k in range(1, WIDTH)), shingles("w", WIDTH))
    cut = materialize(cut.select("doc_id", "n_words", "width", "start", hashes.alias("hashes")).where(F.size("hashes") > 0), "cut")
    # Many documents hold the same passage: a passage is fingerprinted and compared once.
    passages = cut.select("n_words", "width", "hashes").distinct().withColumn("passage", F.xxhash64("hashes")).withColumn("mark", simhash("hashes"))
    passages = materialize(passages, "passages")
    few = F.size("hashes") <= FEW
    marked = materialize(items.withColumn("mark", simhash("hashes")), "marked")
    probes = marked.select("item_id", "n_words", "width", F.col("mark").alias("item_mark"), F.when(few, radius(FLIPS + 1)).otherwise(radius(FLIPS)).alias("radius"), F.explode(F.array_distinct(F.when(few, block_keys("mark", FLIPS + 1)).otherwise(block_keys("mark", FLIPS)))).alias("key"))
    keyed = passages.select("n_words", "width", "passage", "mark", F.explode(block_keys("mark", 0)).alias("key"))
    close = keyed.join(probes, ["n_words", "width", "key"]).where(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= F.col("radius"))
    close = materialize(close.select("n_words", "width", "passage", "item_id").distinct(), "close")
    compared = close.join(passages.select("n_words", "width", "passage", "hashes"), ["n_words", "width", "passage"])
    compared = compared.join(items.select("item_id", "n_words", "width", F.col("hashes").alias("item_hashes")), ["item_id", "n_words", "width"])
    compared = compared.withColumn("similarity", weighted_similarity("hashes", "item_hashes")).where(F.col("similarity") >= threshold - 1e-12)
    compared = materialize(compared.select("n_words", "width", "hashes", "item_id", "similarity"), "compared")
    found = cut.join(compared, ["n_words", "width", "hashes"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    found = found.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("int").alias("start"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found.

    Rows that share an id are one document and stay or go together; rows
    with a null id are told apart by their texts, so one that holds an item takes no
    other with it. Null, empty and wordless texts stay, very long texts are
    read whole, other columns, whatever their names, stay as they are; without items every row stays.
    """
    key = fresh(docs, "key")
    named = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.concat(F.lit("t"), F.xxhash64(text_col).cast("string")))
    texts = docs.select(named.alias("doc_id"), F.col(text_col).alias("text"))
    found = contaminated(texts, benchmark, **options).select(F.col("doc_id").alias(key)).distinct()
    found = materialize(found, "contaminated")
    return docs.withColumn(f"{key}_", named).join(found, F.col(f"{key}_") == F.col(key), "left_anti").select(*docs.columns)
