import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from settlegrid.llm import exact_dedup as e
from settlegrid.llm.mixing import mix, mix_counts
from settlegrid.llm.sharding import shard_documents, shard_rows

SCHEMA = "doc_id long, text string, source string, size int"


def corpus(n=300, seed=1):
    draw = random.Random(seed)
    rows = [(i, " ".join("w" * draw.randrange(1, 9) for _ in range(draw.randrange(0, 60))), draw.choice(["a", "a", "a", "B", "é", None]), 1) for i in range(n)]
    return rows + [(n, None, "a", 1), (n + 1, "", None, 1), (n + 2, "x " * 4000, "B", 1), (None, "q r", "a", 1), (3, rows[3][1], rows[3][2], 1)]


def test_mix_meets_targets_and_repeats(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    rows = mix_counts(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(map(str, rows)) == sorted(map(str, mix_counts(docs.repartition(5)).collect()))
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
        assert r.taken == r.copies * r.size and r.copies <= 3
    for source in by_source.values():
        assert abs(sum(r.taken for r in source) - source[0].target) <= max(r.size for r in source)
        assert {r.source_size for r in source} == {sum(r.size for r in source)}
        least = int(source[0].target // max(1, source[0].source_size))
        assert all(r.copies in (least, least + 1) for r in source)
    assert abs(sum(s[0].target for s in by_source.values()) - sum(r.size for r in rows)) < 1e-6


def test_better_quality_is_drawn_more(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    rows = mix_counts(docs, weights=(1, 3), quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("source = 'a' and copies > 0").collect()
    even = sum(r.doc_id % 2 == 0 for r in rows)
    assert len(rows) == 1000 and even > 650


def test_mix_rows_and_empty_table(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    copies = {(r.doc_id): r.copies for r in mix_counts(docs).collect() if r.doc_id != 3}
    got = Counter(r.doc_id for r in mixed.collect())
    assert all(got[i] == c for i, c in copies.items())
    assert mix_counts(docs.limit(0)).count() == mix(docs.limit(0)).count() == 0


def test_shards(spark):
    rows = corpus(997)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = shard_rows(docs, 40).collect()
    assert sorted(map(str, got)) == sorted(map(str, shard_rows(docs.repartition(7), 40).collect()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    sizes = [len(shards[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in shards[s]) == list(range(len(shards[s]))) for s in shards)
    for source, n in Counter(r.source for r in got).items():
        for s in range(40):
            assert abs(sum(r.source == source for r in shards[s]) - n / 40) < 2.5
    few = docs.limit(3)
    assert len(shard_rows(few, 40).collect()) == 3 and shard_rows(docs.limit(0), 40).count() == 0
    whole = shard_documents(docs, 40)
    assert whole.columns == [*docs.columns, "shard", "slot"]
    assert Counter((r.doc_id, r.shard, r.slot) for r in whole.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in got)


def test_exact_groups_with_collisions_and_small_buckets(spark):
    draw = random.Random(5)
    texts = ["a b", "a  b", "a\tb", " a b", "", None, "\n", " ", "b", "B"] + [f"t{draw.randrange(60)}" for _ in range(200)] + ["z " * 9000]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(None, "a b", "s", 1), (4, "", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t, _, _ in rows:
        held = groups[norm(t)]
        keep = min(x for x in held if x is not None)
        want[i, keep, len(held), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    for bits, capacity in ((64, 50_000), (64, 4), (3, 4)):
        got = e.exact_duplicates(docs, key_bits=bits, capacity=capacity).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    kept = e.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(x for x in g if x is not None) for g in groups.values()})
    assert e.exact_duplicates(docs.limit(0)).count() == 0


def test_directory_doubles_and_splits(spark):
    draw = random.Random(2)
    keys = [draw.randrange(-(2**63), 2**63) for _ in range(400)] + [(5 << 58) + i for i in range(60)] + [-1 - i for i in range(40)] + [0]
    table = spark.createDataFrame([(k,) for k in keys], "key long")
    d = e.grow_directory(table, 12, bits=5)
    held = Counter()
    for k in keys:
        h = k % 2**64
        (number,) = [n for n, (local, prefix) in enumerate(d.leaves) if (h >> (64 - local) if local else 0) == prefix]
        held[number] += 1
    assert all(held[n] <= 12 for n in range(len(d.leaves))) and d.depth > 12
    assert sum(2.0**-local for local, _ in d.leaves) == 1
    got = e.in_buckets(table, spark.createDataFrame(d.entries(), "entry int, low string, high string, bucket int"))
    assert Counter(r.bucket for r in got.collect()) == held
    small = e.grow_directory(table.limit(30), 12, bits=5)
    assert len(small.buckets) == 2**small.depth and sorted(set(small.buckets)) == list(range(len(small.leaves)))
    assert e.grow_directory(table.limit(0), 10).leaves == [(0, 0)]
    same = spark.createDataFrame([(7,)] * 20, "key long")
    assert e.grow_directory(same, 3).depth == 64


def test_without_the_directory_nothing_is_found(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(50), SCHEMA)
    monkeypatch.setattr(e.Directory, "entries", lambda self, lookup=e.LOOKUP_BITS: [(0, "0" * 16, "0" * 16, 0)])
    assert e.exact_duplicates(docs).count() == 0


def test_sources_of_one_row_leave_the_mixture_alone(spark):
    rows = [(i, f"t{i}", f"one{i}", 1) for i in range(1500)] + [(5000 + i, f"u{i}", "big", 1) for i in range(1500)] + [(9000 + i, f"v{i}", f"two{i // 2}", 1) for i in range(200)]
    got = shard_rows(spark.createDataFrame(rows, SCHEMA), 40).collect()
    held = Counter(r.shard for r in got if r.source == "big")
    assert all(abs(held[s] - 1500 / 40) <= 3 for s in range(40))


def test_nulls_repeats_and_helper_names(spark):
    names = ["_copies", "_epoch", "_skey", "_epochs", "_last", "_row", "_key", "_nth", "_sid", "_snth", "_kept_id", "_kept_sha", "_Cell", "_total", "_ahead", "shard", "slot"]
    rows = [(i, f"some words {i}", "s", *range(len(names))) for i in range(6)] + [(None, f"null {i}", None, *range(len(names))) for i in range(3)] + [(None, None, "s", *range(len(names)))] * 2 + [(4, "some words 4", "s", *range(len(names)))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"{n} int" for n in names)]))
    mixed = mix(docs)
    assert mixed.columns == docs.columns and all(tuple(r)[3:] == tuple(range(len(names))) for r in mixed.collect())
    placed = shard_documents(docs, 3)
    assert Counter(placed.columns) == Counter(docs.columns) and placed.count() == len(rows)
    assert Counter((r.doc_id, r.text) for r in placed.collect()) == Counter(r[:2] for r in rows)
    assert len({(r.shard, r.slot) for r in placed.collect()}) == len(rows)
    kept = e.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(set(r[:2] for r in rows))
    empty = docs.limit(0)
    assert mix(empty).count() == shard_documents(empty, 3).count() == e.drop_duplicates(empty).count() == 0


def test_one_document_says_two_texts(spark):
    docs = spark.createDataFrame([(1, "a", "s", 1), (1, "b", "s", 1), (2, "a", "s", 1), (2, "c", "s", 1)], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in e.drop_duplicates(docs).collect()) == [(1, "a"), (1, "b"), (2, "c")]
    ids = spark.createDataFrame([("b", "a"), ("a", "a ")], "doc_id string, text string")
    assert {r.keep_id for r in e.exact_duplicates(ids).collect()} == {"a", "b"}
