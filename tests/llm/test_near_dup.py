import random

import pyarrow as pa
from pyspark.sql import functions as F

from brute import near_components
from settlegrid.llm import near_dup
from settlegrid.llm.near_dup import drop_near_duplicates, near_duplicates, shingle_set, single_keyed

SCHEMA = "doc_id long, text string"


def check(spark, rows, percent=85):
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=percent).collect()
    want, sizes = near_components(rows, percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return want


def drifting(seed, groups, size):
    draw = random.Random(seed)
    rows, number = [], 0
    shared = [f"common{i}" for i in range(40)]
    for g in range(groups):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(1, 160))]
        if g % 3 == 0:
            base = base[: len(base) // 2] + shared + base[len(base) // 2 :]
        for _ in range(size):
            words = list(base)
            for _ in range(draw.randrange(0, 4)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
            rows.append((number, " ".join(words)))
            number += 1
    draw.shuffle(rows)
    return rows


def test_groups_match_all_pairs(spark):
    want = check(spark, drifting(5, 30, 12))
    assert len(set(want.values())) < len(want)


def test_lower_threshold(spark):
    check(spark, drifting(6, 10, 8), percent=80)


def test_four_of_five_shingles_link_wherever_the_fifth_falls(spark):
    assert single_keyed(80) == 5 and single_keyed(85) == 0
    draw, rows, places = random.Random(9), [], set()
    for g in range(40):
        words = [f"w{draw.randrange(10**6)}" for _ in range(9)]
        short = words[1:] if g % 2 else words[:-1]
        whole, part = (shingle_set(" ".join(w)) for w in (words, short))
        places.add((g % 2, [x in part for x in whole].index(False)))
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(short))]
    assert places == {(side, place) for side in (0, 1) for place in range(5)}
    want = check(spark, rows, percent=80)
    assert all(want[2 * g + 1] == 2 * g for g in range(40))


def test_short_wordless_and_equal_texts(spark):
    rows = [(9, "a b c"), (4, "A B\tC"), (5, "a b"), (6, ""), (7, None), (8, "  \n"), (10, "a b c d e"), (11, "a b c d e f"), (3, "x " * 3000), (12, "X " * 2999)]
    want = check(spark, rows)
    assert want[9] == 4 and want[7] == 7 and want[12] == 3


def test_drop_keeps_one_row_of_each_group_and_all_columns(spark):
    rows = [(1, "one two three four five six", "s"), (1, "one two three four five six", "s"), (2, "One two three four five six", None), (3, None, "s"), (None, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    got = sorted(drop_near_duplicates(docs).collect(), key=str)
    assert [r.doc_id for r in got if r.doc_id is not None] == [1, 3]
    assert docs.columns == ["doc_id", "text", "cls"] and got[0].__fields__ == docs.columns
    assert sum(r.doc_id is None for r in got) == 1


def test_drop_keeps_null_ids_and_distinct_texts_of_an_id(spark):
    base = [f"w{i}" for i in range(30)]
    near = " ".join([*base[:-1], "other"])
    rows = [(None, "alpha beta"), (None, "gamma delta"), (None, "gamma delta"), (None, None)]
    rows += [(1, " ".join(base)), (2, near), (2, "a text of its own"), (2, "A text of its OWN")]
    rows += [(5, "five is one text"), (5, "five is another"), (5, "five is one text"), (7, None), (7, " ")]
    got = [tuple(r) for r in drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(t or "" for i, t in got if i is None) == ["", "alpha beta", "gamma delta", "gamma delta"]
    assert sorted((i, (t or "").lower().strip()) for i, t in got if i is not None) == [(1, " ".join(base)), (2, "a text of its own"), (5, "five is another"), (5, "five is one text"), (7, "")]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_block_links_are_a_spanning_forest_of_true_links(monkeypatch):
    monkeypatch.setattr(near_dup, "COLUMNS", 7)
    draw = random.Random(3)
    base = [draw.sample(range(100), 20) for _ in range(6)]
    sets = []
    for i in range(60):
        s = set(base[i % 6])
        for _ in range(draw.randrange(0, 5)):
            s = s - {draw.choice(sorted(s))} | {draw.randrange(1000)}
        sets.append(sorted(s))
    alike = lambda x, y: 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))
    for side in ([0] * 60, [0] * 25 + [1] * 35):
        group = pa.table({"side": side, "row": range(60), "part": range(60), "shingles": sets})
        got = near_dup.block_links(group, 80).to_pylist()
        want = [(i, j) for i in range(60) for j in range(i + 1, 60) if (side[i] != side[j] or not any(side)) and alike(sets[i], sets[j])]
        assert all((r["a"], r["b"]) in want for r in got)

        def parts(links):
            root = list(range(60))
            for i, j in links:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
            return root

        mine, theirs = parts((r["a"], r["b"]) for r in got), parts(want)
        assert len(set(mine)) == len(set(theirs)) == 60 - len(got) < 60


def test_a_large_group_of_mostly_unlinked_texts(spark):
    draw = random.Random(21)
    passage = [f"common{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"d{i}w{k}" for k in range(draw.choice((5, 12, 25, 60)))]
        rows += [(2 * i, " ".join(passage + own))]
        if i % 5 == 0:
            rows += [(2 * i + 1, " ".join(passage + own[:-1]))]
    want = check(spark, rows, percent=80)
    assert len(set(want.values())) > 60


def test_text_ids_and_helper_names(spark):
    rows = [("b", "one two three four five six", "p", 1), ("a", "One two three four five six", "q", 2), ("c", "else", "r", 3), (None, "else", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _kept_id string, _text_key int")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {"a": "a", "b": "a", "c": "c", None: None}
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(r._text_key for r in got.collect()) == [2, 3, 4]
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_chosen_rows_are_kept_exactly_with_and_beyond_the_bitmaps(spark, monkeypatch):
    rows = spark.range(0, 70_000, 1, 3).select(F.monotonically_increasing_id().alias("row"), "id")
    rows = near_dup.materialize(rows.unionByName(rows.select(F.lit(None).cast("long").alias("row"), "id").limit(2)), "rows")
    chosen = near_dup.materialize(rows.where("id % 7 in (0, 3)").select("row").where("row is not null"), "chosen")
    want = sorted(r.id for r in rows.where("row is not null and id % 7 in (0, 3)").collect())
    kept = near_dup.keep_rows(rows, chosen)
    assert kept.columns == rows.columns and sorted(r.id for r in kept.collect()) == want
    assert not near_dup.keep_rows(rows, chosen.where("false")).count()
    monkeypatch.setattr(near_dup, "FILTER_BITS", 1 << 16)
    assert sorted(r.id for r in near_dup.keep_rows(rows, chosen).collect()) == want


def test_sketches_stay_and_whole_sets_move_once(spark, monkeypatch):
    plans, write = {}, near_dup.materialize

    def watched(df, label, **options):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, **options)

    monkeypatch.setattr(near_dup, "materialize", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = spark.createDataFrame([(i, " ".join(f"w{i // 3}x{k + (k > 60) * (i % 3)}" for k in range(90))) for i in range(60)], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: i // 3 * 3 for i in range(60)}
    moves = {label: plan.count("Exchange hashpartitioning") for label, plan in plans.items()}
    assert (moves["lists"], moves["held"], moves["sets"]) == (1, 0, 2)
