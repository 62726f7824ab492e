"""Exact deduplication through an extendible-hash index on shared storage.

Texts are normalised and hashed to 64 bits. The top bits of a hash select an
entry of a directory, which names a bucket. A bucket that holds more distinct
hashes than its capacity splits by its next bit; where it already used all bits
of the directory, the directory doubles first. The texts go to the owner tasks
of their buckets, which chain those whose hashes collide, told apart byte for
byte, and write their part of the index. Documents look up their bucket in the
directory and their text in its chain.

The directory is kept as ranges of hashes: entries that share a bucket are one
range. It has one row per bucket, and per entry of ``LOOKUP_BITS`` bits where a
bucket is wider than that. Buckets may split down to single hashes; only texts
of the very same 64 bits stay together, as a chain.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, fresh, materialize

#: Distinct hashes in a bucket before it splits.
CAPACITY = 50_000
#: Bits that one pass of counting looks at; deeper buckets are counted by further passes.
LOOKUP_BITS = 12


@dataclass
class Directory:
    """Buckets as ``(local depth, prefix)``, in order of their hashes."""

    leaves: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])

    @property
    def depth(self) -> int:
        """Bits of an entry: the directory has 2 ** depth of them."""
        return max(depth for depth, _ in self.leaves)

    @property
    def buckets(self) -> list[int]:
        """The bucket of every entry; for small directories, as it grows with 2 ** depth."""
        return [number for number, (local, _) in enumerate(self.leaves) for _ in range(1 << (self.depth - local))]

    def entries(self, lookup: int = LOOKUP_BITS) -> list[tuple[int, str, str, int]]:
        """``entry, low, high, bucket``: by the first ``lookup`` bits, the hexadecimal range of hashes that each bucket takes of them."""
        rows = []
        for number, (local, prefix) in enumerate(self.leaves):
            low, high = prefix << (64 - local), ((prefix + 1) << (64 - local)) - 1
            if local >= lookup:
                rows.append((prefix >> (local - lookup), f"{low:016X}", f"{high:016X}", number))
            else:
                first = prefix << (lookup - local)
                rows += [(e, f"{low:016X}", f"{high:016X}", number) for e in range(first, first + (1 << (lookup - local)))]
        return rows


def split_bucket(depth: int, prefix: int, fine: dict[int, int], capacity: int, bits: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Split a bucket until its parts hold at most ``capacity``; ``fine`` counts hashes by ``bits`` further bits.

    Returns the parts that fit, and those that used all these bits and are still overfull.
    """
    fits, overfull, work = [], [], [(0, 0, sorted(fine.items()))]
    while work:
        used, value, held = work.pop()
        if sum(n for _, n in held) <= capacity:
            fits.append((depth + used, (prefix << used) + value))
        elif used == bits:
            overfull.append((depth + used, (prefix << used) + value))
        else:
            middle = (2 * value + 1) << (bits - used - 1)
            work += [(used + 1, 2 * value, [x for x in held if x[0] < middle]), (used + 1, 2 * value + 1, [x for x in held if x[0] >= middle])]
    return fits, overfull


def grow_directory(keys: DataFrame, capacity: int, bits: int = LOOKUP_BITS) -> Directory:
    """The directory of the distinct hashes ``keys(key)``.

    Each pass counts the hashes of the overfull buckets by their next ``bits``
    bits; the driver holds 2 ** bits counts a bucket. A bucket of one hash value is as deep as
    its 64 bits and splits no further.
    """
    leaves, work = [], [(0, 0)]
    session = keys.sparkSession
    while work:
        depth = work[0][0]
        step = min(bits, 64 - depth)
        if not step:
            leaves += work
            break
        at = _bits("key", 0, depth).alias("prefix"), _bits("key", depth, step).alias("next")
        counted = keys.select(*at)
        if depth:
            counted = counted.join(session.createDataFrame([(p,) for _, p in work], "prefix long"), "prefix", "left_semi")
        fine: dict[int, dict[int, int]] = {}
        for prefix, after, held in counted.groupBy("prefix", "next").agg(F.count("*")).toLocalIterator():
            fine.setdefault(prefix, {})[after] = held
        deeper = []
        for depth, prefix in work:
            fits, overfull = split_bucket(depth, prefix, fine.get(_signed(prefix, depth), {}), capacity, step)
            leaves += fits
            deeper += overfull
        work = deeper
    return Directory(sorted(leaves, key=lambda b: b[1] << (64 - b[0])))


def _signed(prefix: int, depth: int) -> int:
    return prefix - (1 << 64) if depth == 64 and prefix >> 63 else prefix


def _bits(key: str, start: int, count: int) -> Column:
    """``count`` bits of the hash from its ``start``-th on, the highest being the first."""
    if not count:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(F.shiftleft(F.col(key), start), 64 - count)


def normalised(text: str) -> Column:
    """The text with every run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE, " ")


def hash_key(text: str, bits: int) -> Column:
    key = F.xxhash64(F.col(text))
    return key if bits >= 64 else F.shiftleft(key, 64 - bits)


def in_buckets(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """``rows`` with the ``bucket`` that the directory names for their ``key``."""
    place = F.hex(F.col("key"))
    whole = F.lpad(place, 16, "0")
    return rows.withColumn("entry", _bits("key", 0, LOOKUP_BITS).cast("int")).join(directory, "entry").where((whole >= F.col("low")) & (whole <= F.col("high"))).drop("entry", "low", "high")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``index, directory, slim``.

    ``index``: one row per distinct text, ``bucket, key, chain, sha, keep_id,
    group_size``, written in the order of the buckets, each bucket by one owner;
    ``chain`` numbers the texts of one key. ``directory``: ``entry, low, high, bucket``. ``slim``:
    ``doc_id, key, sha`` of every row.

    Copies of a text are counted within each input partition first, so a text
    that fills a third of the corpus reaches its owner as one row per partition;
    the aggregation compares whole texts and spills. An owner then numbers the
    chain of each key. Should two texts of a chain have the same SHA-256, the
    build fails, so that the digest stands for the bytes afterwards.
    ``key_bits`` under 64 forces collisions (tests).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).withColumn("key", hash_key("norm", key_bits))
    slim = materialize(rows.select("doc_id", "key", F.sha2("norm", 256).alias("sha")), "slim")
    keys = materialize(slim.select("key").distinct(), "keys")
    grown = grow_directory(keys, capacity)
    directory = materialize(docs.sparkSession.createDataFrame(grown.entries(), "entry int, low string, high string, bucket int"), "directory")
    texts = in_buckets(rows, directory).groupBy("bucket", "key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    texts = materialize(texts.select("bucket", "key", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"), "texts")
    chained = Window.partitionBy("bucket", "key")
    chain = texts.withColumn("chain", F.row_number().over(chained.orderBy("sha"))).withColumn("alike", F.lag("sha").over(chained.orderBy("sha")) == F.col("sha"))
    chain = chain.withColumn("sha", F.when(F.col("alike"), F.raise_error(F.lit("two texts share their SHA-256")).cast("string")).otherwise(F.col("sha")))
    owned = chain.drop("alike").repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain")
    return materialize(owned.select("bucket", "key", "chain", "sha", "keep_id", "group_size"), "index"), directory, slim


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal texts are those equal after white-space normalisation; the smallest
    id of a group stays. Null text equals the empty text. Rows that repeat both
    id and text are the same document: each says ``kept``, and they count each
    in ``group_size``. Null ids come after all others; if all ids of a group are
    null, ``keep_id`` is null and its rows are kept. Very long texts are read
    whole; ids may be of any type; other columns play no part. An empty table gives no rows.
    """
    index, directory, slim = build_index(docs, id_col=id_col, text_col=text_col, capacity=capacity, key_bits=key_bits)
    found = in_buckets(slim, directory).join(index, ["bucket", "key", "sha"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one per group of equal texts.

    Rows are told apart by id and text. A group whose ids are all null keeps one
    of its rows. Rows that share an id but not a text stand for their own
    groups. Columns stay as they are, whatever their names; an empty table stays empty.
    """
    found = exact_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("kept")
    own, sha = fresh(docs, "kept_id"), fresh(docs, "kept_sha")
    kept = found.select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).distinct()
    named = docs.withColumn(f"{sha}_", F.sha2(normalised(text_col), 256))
    rows = named.join(kept, named[id_col].eqNullSafe(kept[own]) & (named[f"{sha}_"] == kept[sha]), "left_semi")
    return rows.dropDuplicates([id_col, f"{sha}_"]).select(*docs.columns)
