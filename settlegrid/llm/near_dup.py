"""Near-duplicate groups from bottom-k sketches of word shingles.

One hash function maps a document's distinct five-word shingles to 64 bits; the
k least values are its sketch. Inverted lists of the retained values propose
pairs, an estimate on the union of two sketches filters them, and the Jaccard
similarity of the full sets decides. Components of the links are the groups.

How it stays whole and bounded:

* Documents with equal sets form a class; one class takes part once, however many copies it has.
* A list is keyed by three consecutive retained values. In a list of single values, all documents that share a passage
  would meet; runs of three are shared by those that are alike around the passage too. A union of c common values and d
  others holds a common run for certain if c >= 2 d + 3. Sets so small that a similar pair can miss this (4 of 5 at 0.8;
  none at 0.85) are also keyed by their single values. So it is certain for sets up to 93 shingles at 0.8 and 125 at
  0.85; beyond, two similar sets share no run among 64 values with a chance under 1e-9 at 0.8 and 3e-13 at 0.85.
* In a list everyone is first compared with its least class, the leader. Lists with the same leader are then one group;
  groups whose members are all linked by now are done. In the others, pairs are made across components only: in SQL where
  a group is small, else in blocks of two hundred or so that compare their sketches as matrices and return what may link.
  No list is capped or dropped, no group meets in one task, and copies already linked don't meet again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_type, materialize
from .components import components

#: Values retained per document. Sets up to this size are retained whole.
SKETCH = 256
#: The least values from which the keys of inverted lists are made, and how many of them make a key.
KEYED = 64
RUN = 3
#: Groups up to this size make their pairs in SQL, larger ones in blocks of about BLOCK members.
SMALL = 24
BLOCK = 200
VALUES = 60_000
COLUMNS = 8192
#: Rounds in which the open members of a group are compared with one of them.
STARS = 2
#: Bits of the id filter that is sent to all tasks: 8 MB at most, whatever the input.
FILTER_BITS = 1 << 26
#: Bits of one of Spark's bitmaps.
BITMAP = 1 << 15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_WORDS_KEPT = 60_000


class _WordHashes(dict):
    """Hash of a word, remembered; forgotten as a whole when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = _WordHashes()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``width``-word shingles.

    A-Z is lower-cased; words are runs of other than ASCII white space. Fewer
    than ``width`` words make one shingle; no words make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    count, size = max(1, len(words) - width + 1), min(width, len(words))
    mixed = np.full(count, size, np.uint64)
    for k in range(size):
        mixed = mixed * _MULTIPLIER + hashes[k : k + count]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _class_of(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def sketches(docs: DataFrame, id_col: str, text_col: str, *, size: int = SKETCH, width: int = 5, full: bool = False) -> DataFrame:
    """``doc_id, n_shingles, cls, sketch, text_key``: set size, a hash of the whole set, its least values (all of them if ``full``), a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(t, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_class_of(s) for s in sets], pa.binary()),
                        _lists(sets if full else [s[:size] for s in sets]),
                        part.column(2),
                    ],
                    ["doc_id", "n_shingles", "cls", "sketch", "text_key"],
                )

    columns = F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("text_key")
    return docs.select(*columns).mapInArrow(run, f"doc_id {id_type(docs, id_col)}, n_shingles long, cls binary, sketch array<long>, text_key long")


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def keep_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """A superset of the rows whose id is in ``ids(id)``, found without moving ``docs``.

    The ids become a bitmap of ``FILTER_BITS`` hashed positions, a table of at
    most 8 MB that each task gets. Other rows pass by chance only; an exact
    join follows wherever this is used.
    """
    position = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS))
    return _marked(docs, position(id_col), _bitmaps(ids, position("id")))


def keep_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose ``row`` is in ``chosen(row)``, exactly, and found without moving ``rows`` while bitmaps of ``FILTER_BITS`` hold them.

    ``row`` counts up within each partition that numbered it, so there are as
    many bitmaps of 32,768 numbers as rows and partitions need. Beyond the bound it is a filter and a join.
    """
    bits = _bitmaps(chosen, F.col("row") + 1)
    if bits.count() * BITMAP <= FILTER_BITS:
        return _marked(rows, F.col("row") + 1, bits)
    return keep_ids(rows, "row", chosen.select(F.col("row").alias("id"))).join(chosen.select("row"), "row", "left_semi")


def _bitmaps(ids: DataFrame, position: Column) -> DataFrame:
    bits = ids.select(position.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    return materialize(bits, "filter")


def _marked(rows: DataFrame, position: Column, bits: DataFrame) -> DataFrame:
    """The rows whose ``position`` is set in ``bits``, which all tasks get."""
    bucket, held = fresh(rows, "bucket"), fresh(rows, "bits")
    bits = bits.select(F.col("_bucket").alias(bucket), F.col("_bits").alias(held))
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(position) == bits[bucket])
    at = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return found.where(F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2 == 1).select(*rows.columns)


def block_links(group: pa.Table, percent: int) -> pa.Table:
    """Verified links of a block (``side, row, part, shingles``) that join its parts: a spanning forest, so fewer than the block has members.

    Both sides hold members of one group; the sides are the same block where
    all rows say ``side = 0``. Common values are counted by products of 0/1
    matrices over ``COLUMNS`` values at a time; with whole sets on both sides the similarity is exact.
    """
    side, row, part = (group.column(c).to_numpy() for c in ("side", "row", "part"))
    arrays = [np.asarray(x, np.int64) for x in group.column("shingles").to_pylist()]
    size = np.array([len(x) for x in arrays])
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1) if (side == 1).any() else first
    owner = np.repeat(np.arange(len(arrays)), size)
    _, column, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(first), len(second)), np.float32)
    for start in range(0, int((counts > 1).sum()), COLUMNS):
        low, high = np.searchsorted(column, (start, start + COLUMNS))
        held = np.zeros((len(arrays), COLUMNS), np.float32)
        held[owner[low:high], column[low:high] - start] = 1
        common += held[first] @ held[second].T
    linked = 100 * common >= percent * (size[first][:, None] + size[second][None, :] - common)
    linked &= part[first][:, None] != part[second][None, :]
    root = {p: p for p in part.tolist()}

    def top(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    a, b = [], []
    for x, y in zip(*(i.tolist() for i in np.nonzero(linked))):
        x, y = first[x], second[y]
        p, q = top(int(part[x])), top(int(part[y]))
        if p != q:
            root[p] = q
            a.append(min(row[x], row[y]))
            b.append(max(row[x], row[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def single_keyed(percent: int) -> int:
    """Sets up to this size need keys of single values: the largest union in which a similar pair may share no run of ``RUN``."""
    common = {u: -(-percent * u // 100) for u in range(1, KEYED + 1)}
    return max((u for u, c in common.items() if c < u and c < (RUN - 1) * (u - c + 1) + 1), default=0)


class _Job:
    """One run over a document table: its sketches and what is derived from them.

    A class is named by the ``row`` of one of its rows, so no two classes share
    a name; rows belong to a class by the 128-bit hash of their whole set.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, width: int):
        self.docs, self.id_col, self.text_col, self.percent, self.width = docs, id_col, text_col, percent, width
        rows = sketches(docs, id_col, text_col, width=width).withColumn("row", F.monotonically_increasing_id())
        head, tail = F.expr(f"slice(sketch, 1, {KEYED})").alias("head"), F.expr(f"slice(sketch, {KEYED + 1}, {SKETCH})").alias("tail")
        self.rows = materialize(rows.select("row", "doc_id", "n_shingles", "cls", "text_key", head, tail), "sketches")
        self.some = self.rows.where("n_shingles > 0 and doc_id is not null")
        self.classes = materialize(self.some.groupBy("cls").agg(F.min("doc_id").alias("min_id"), F.min("row").alias("row")), "classes")

    def groups(self) -> DataFrame:
        """``lead, row, met``: for every inverted list of two classes or more, its members by the class that meets most others."""
        heads = keep_rows(self.some.select("row", "head", "n_shingles"), self.classes.select("row"))
        runs = F.expr(f"transform(sequence(1, greatest(1, size(head) - {RUN - 1})), i -> xxhash64(slice(head, i, {RUN})))")
        singles = F.expr("transform(sequence(1, size(head)), i -> xxhash64(slice(head, i, 1)))")
        both = F.when(F.col("n_shingles") <= single_keyed(self.percent), F.concat(runs, singles)).otherwise(runs)
        keys = heads.select("row", F.explode(F.array_distinct(both)).alias("key"))
        lists = keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
        shared = materialize(keys.join(materialize(lists, "lists", sparse=True), "key"), "shared")
        met = materialize(shared.groupBy("row").agg(F.sum("held").alias("met")), "met")
        shared = materialize(shared.join(met, "row").select("key", "row", "met"), "shared")
        leads = materialize(shared.groupBy("key").agg(F.max(F.struct("met", "row"))["row"].alias("lead")), "leads")
        return materialize(shared.join(leads, "key").select("lead", "row", "met").distinct(), "groups")

    def hold(self, groups: DataFrame) -> None:
        """``held``: sketches, and ``sets``: whole sets made anew from the texts, of the classes in ``groups``."""
        wanted = materialize(groups.select("row").distinct().join(self.classes, "row"), "wanted")
        rows = keep_rows(self.some, wanted.select("row"))
        self.held = materialize(rows.select("row", F.col("n_shingles").alias("n"), F.concat("head", "tail").alias("sketch")), "held")
        docs = keep_ids(self.docs.select(self.id_col, self.text_col), self.id_col, wanted.select(F.col("min_id").alias("id")))
        sets = sketches(docs, self.id_col, self.text_col, width=self.width, full=True).select(F.col("doc_id").alias("min_id"), "cls", F.col("sketch").alias("shingles"))
        # One row a class, by the keys of the join: whole sets are not moved again.
        sets = sets.join(wanted, ["min_id", "cls"]).dropDuplicates(["min_id", "cls"])
        self.sets = materialize(sets.select("row", "shingles"), "sets")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that the union of their sketches leaves open.

        The estimate is the share of common values among the least of the union;
        a pair goes if that is more than six standard deviations below the
        threshold. Where both sketches hold whole sets the share is exact.
        """
        left = self.held.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        right = self.held.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        met = pairs.join(left, "a").join(right, "b").where((F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * self.percent))
        # Of each sketch, what is in the range that both cover; no array of the union has to be sorted.
        low = F.least(*(F.when(F.col(f"n_{x}") > F.size(f"s_{x}"), F.element_at(f"s_{x}", -1)).otherwise(F.lit(2**63 - 1)) for x in "ab"))
        met = met.withColumn("low", low).withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
        union = F.expr("size(filter(s_a, v -> v <= low)) + size(filter(s_b, v -> v <= low))") - F.col("common")
        t = self.percent / 100
        whole = F.col("low") == F.lit(2**63 - 1)
        least = F.when(whole, F.lit(t - 1e-6)).otherwise(F.lit(t - 6 * math.sqrt(t * (1 - t) / SKETCH)))
        return met.where(F.col("common") / F.greatest(union, F.lit(1)) >= least).select("a", "b")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that the estimate leaves open and whose whole sets are similar enough."""
        pairs = materialize(self.estimated(pairs), "pairs", sparse=True)
        both = pairs.join(self.sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(self.sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        found = both.where(common * 100 >= (F.size("x") + F.size("y") - common) * self.percent)
        return materialize(found.select("a", "b"), "links", sparse=True)

    def placed(self, groups: DataFrame, edges: DataFrame) -> DataFrame:
        """``groups`` with the component ``part`` of each member; only groups of several components stay."""
        parts = components(edges).withColumnRenamed("v", "row")
        placed = materialize(groups.select("lead", "row", "met").join(parts, "row", "left").select("lead", "row", "met", F.coalesce("root", "row").alias("part")), "placed")
        several = placed.groupBy("lead").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("lead")
        return materialize(placed.join(several, "lead"), "open")

    def links(self) -> DataFrame:
        """Links between classes whose components are those of all links."""
        groups = self.groups()
        self.hold(groups)
        edges = self.linked(groups.where("lead <> row").select(F.least("lead", "row").alias("a"), F.greatest("lead", "row").alias("b")).distinct())
        opened = self.placed(groups, edges)
        for _ in range(STARS - 1):
            # Those who don't hang together with the leader are compared with the one among them who meets most others.
            own = opened.where("lead = row").select("lead", F.col("part").alias("lead_part"))
            rest = opened.join(own, "lead").where("part <> lead_part")
            leads = rest.groupBy("lead").agg(F.max(F.struct("met", "row", "part")).alias("next")).select("lead", F.col("next.row").alias("c1"), F.col("next.part").alias("p1"))
            pairs = opened.join(materialize(leads, "leads"), "lead").where("part <> p1 and row <> lead")
            pairs = pairs.select(F.least("c1", "row").alias("a"), F.greatest("c1", "row").alias("b")).distinct()
            edges = materialize(edges.union(self.linked(pairs)), "edges")
            opened = self.placed(opened, edges)

        counts = opened.groupBy("lead", "part").agg(F.count("*").alias("n_part"))
        mixed = counts.groupBy("lead").agg(F.max(F.struct("n_part", "part")).alias("most"), F.sum("n_part").alias("n_all"))
        mixed = materialize(mixed.select("lead", F.col("most.part").alias("main"), "n_all"), "mixed")
        opened = materialize(opened.join(mixed, "lead").withColumn("minor", F.col("part") != F.col("main")), "open")
        small = opened.where(F.col("n_all") <= SMALL)
        one = small.where("minor").select("lead", F.col("row").alias("c1"), F.col("part").alias("p1"))
        two = small.select("lead", F.col("row").alias("c2"), F.col("part").alias("p2"), F.col("minor").alias("m2"))
        rest = one.join(two, "lead").where("p1 <> p2 and (not m2 or c1 < c2) and c1 <> lead and c2 <> lead")
        rest = materialize(rest.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct(), "rest", sparse=True)
        return edges.union(self.linked(rest)).union(self.in_blocks(opened.where(F.col("n_all") > SMALL)))

    def in_blocks(self, large: DataFrame) -> DataFrame:
        """Verified links across the components of large groups.

        Similar sets are in the same or in neighbouring bands of size, so a
        group falls into one group per band that also hosts the band below.
        Blocks of such a group meet in pairs; those of two members of its main
        component need not. A block holds about ``BLOCK`` sets and ``VALUES`` values.
        """
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / self.percent) * (1 + 1e-9) if self.percent < 100 else 1e-9)).cast("long")
        sized = large.join(self.held.select("row", "n"), "row").withColumn("band", band)
        spread = sized.select("lead", "row", "part", "n", F.explode(F.expr("array(named_struct('band', band, 'home', true), named_struct('band', band + 1, 'home', false))")).alias("b"))
        spread = spread.select("lead", "row", "part", "n", "b.band", "b.home")
        counts = spread.groupBy("lead", "band", "part").agg(F.count("*").alias("n_part"), F.sum("n").alias("values"), F.max("home").alias("home"))
        main = F.max(F.struct("n_part", "part", "values")).alias("main")
        mixed = counts.groupBy("lead", "band").agg(main, F.count("*").alias("n_parts"), F.sum("n_part").alias("n_all"), F.sum("values").alias("all_values"), F.max("home").alias("home"))
        mixed = mixed.where("home and n_parts > 1").select("lead", "band", F.col("main.part").alias("main"), F.col("main.n_part").alias("n_main"), F.col("main.values").alias("main_values"), "n_all", "all_values")
        blocks = lambda n, v: F.ceil(F.greatest(n / BLOCK, v / VALUES)).cast("int")
        mixed = mixed.withColumn("of_minor", blocks(F.col("n_all") - F.col("n_main"), F.col("all_values") - F.col("main_values"))).withColumn("of_main", blocks(F.col("n_main"), F.col("main_values")))
        large = spread.join(materialize(mixed, "bands"), ["lead", "band"]).withColumn("minor", F.col("part") != F.col("main"))
        large = large.withColumn("own", F.pmod(F.xxhash64("row"), F.when(F.col("minor"), F.col("of_minor")).otherwise(F.col("of_main"))).cast("int"))
        meets = F.expr(
            """CASE WHEN minor THEN concat(
                 transform(sequence(0, of_minor - 1), j -> named_struct('i', least(own, j), 'j', greatest(own, j), 'side', if(own <= j, 0, 1))),
                 transform(sequence(0, of_main - 1), j -> named_struct('i', own, 'j', of_minor + j, 'side', 0)))
               ELSE transform(sequence(0, of_minor - 1), i -> named_struct('i', i, 'j', of_minor + own, 'side', 1)) END"""
        )
        large = large.select("lead", "band", "row", "part", F.explode(meets).alias("m")).join(self.sets, "row")
        large = large.select("lead", "band", F.col("m.i").alias("i"), F.col("m.j").alias("j"), F.col("m.side").alias("side"), "row", "part", "shingles")
        percent = self.percent
        found = large.groupBy("lead", "band", "i", "j").applyInArrow(lambda group: block_links(group, percent), "a long, b long")
        return materialize(found, "blocks", sparse=True)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * |A n B| >= ``percent`` * |A u B| over their
    sets of distinct shingles; ``component_id`` is the least id reachable.

    Defined cases: null or wordless text has no shingles and links to nothing;
    fewer than ``width`` words are one shingle; rows with a null id form no
    links, have a null component and are kept; rows with the same id and the
    same shingles say the same; an empty table gives no rows.
    """
    return _decided(docs, id_col, text_col, percent, width).select("doc_id", "n_shingles", "component_id", "kept")


def _decided(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> DataFrame:
    """What ``near_duplicates`` returns, and ``text_key, root``: a hash of each row's text, and its component by class, null for wordless texts."""
    job = _Job(docs, id_col, text_col, percent, width)
    parts = components(job.links()).withColumnRenamed("v", "row")
    placed = job.classes.join(parts, "row", "left").select("cls", "min_id", F.coalesce("root", "row").alias("root"))
    placed = materialize(placed, "placed")
    least = materialize(placed.groupBy("root").agg(F.min("min_id").alias("component_id")), "roots")
    named = materialize(placed.join(least, "root").select("cls", "root", "component_id"), "named")
    rows = job.rows.select("doc_id", "n_shingles", "text_key", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls"))
    rows = rows.join(named, "cls", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key", "root")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: one per component, and every row with a null id.

    Rows are told apart by id and text, so rows that share an id but are not
    near duplicates all stay; of rows with the same id and no words, one.
    """
    decided = _decided(docs, id_col, text_col, percent, width).where("kept and doc_id is not null")
    own, key = fresh(docs, "kept_id"), fresh(docs, "text_key")
    kept = decided.groupBy("doc_id", "root").agg(F.min("text_key").alias(key)).select(F.col("doc_id").alias(own), key)
    named = docs.where(F.col(id_col).isNotNull()).withColumn(f"{key}_", text_key(text_col))
    rows = named.join(kept, (named[id_col] == kept[own]) & (named[f"{key}_"] == kept[key]), "left_semi")
    rows = rows.dropDuplicates([id_col, f"{key}_"]).select(*docs.columns)
    return rows.unionByName(docs.where(F.col(id_col).isNull()))
