import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from brute import near_components

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw, folder = random.Random(21), str(tmp_path_factory.mktemp("corpus"))
    word = lambda: "".join(draw.choice("bcdfglmnr") + draw.choice("aeiou") for _ in range(draw.randrange(1, 5)))
    items = [" ".join(word() for _ in range(draw.randrange(15, 40))) for _ in range(6)]
    docs, labels, kinds = [], [], {}
    for i in range(420):
        words = [word() for _ in range(draw.randrange(20, 160))]
        kind = ("clean", "clean", "clean", "toxic", "leak", "near", "clean")[i % 7]
        if kind == "toxic":
            for _ in range(4):
                words[draw.randrange(len(words))] = draw.choice(["xyzzq", "kwortx", "zqualp"]) + draw.choice(["", "s", "ed"])
        if kind == "leak":
            at = draw.randrange(len(words))
            words[at:at] = draw.choice(items).upper().split()
        text = " ".join(words)
        if kind == "near":
            text = docs[i - 5][1] + " " + word()
        docs.append((i, text, "en", f"src{i % 4 if i % 3 else 0}", len(text)))
        labels.append((i, 1, int(kind == "toxic")))
        kinds[i] = kind
    docs.append((9000, None, None, None, None))
    docs.append((9001, "", None, "src1", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items, kinds


@pytest.fixture(scope="module")
def steps(spark, tables):
    """Documents before each stage and after the last."""
    folder = tables[0]
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/out-{name}"
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    assert NAMES == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot"]


def test_toxicity_drops_toxic_and_keeps_clean(steps, tables):
    kept, kinds = ids(steps[1]), tables[3]
    toxic = {i for i, k in kinds.items() if k == "toxic"}
    assert len(toxic & set(kept)) <= 0.1 * len(toxic)
    assert len(set(kept)) >= 0.97 * (len(kinds) - len(toxic)) and {9000, 9001} <= set(kept)


def test_near_duplicates_leave_the_least_of_each_group(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    root, _ = near_components(before, corpus_pipeline.NEAR)
    assert ids(steps[2]) == Counter({i: 1 for i, r in root.items() if i == r})


def test_decontamination_drops_documents_with_items(steps, tables):
    plain = lambda text: " ".join((text or "").lower().split())
    want = {r.doc_id for r in steps[2].collect() if not any(plain(item) in plain(r.text) for item in tables[2])}
    assert set(ids(steps[3])) == want


def test_mixing_meets_the_targets(steps):
    before = {r.doc_id: (r.source, len((r.text or "").split())) for r in steps[3].collect()}
    taken = ids(steps[4])
    sizes, got, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, (source, n) in before.items():
        sizes[source] += n
        got[source] += n * taken[i]
        largest[source] = max(largest[source], n)
        assert taken[i] <= 3
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    low, high = 0.0, float(sum(sizes.values()) * 3 + 1)
    for _ in range(200):
        level = (low + high) / 2
        full = sum(min(3 * sizes[s], level * weight[s]) for s in order)
        low, high = (level, high) if full < sum(sizes.values()) else (low, level)
    for s in order:
        assert abs(got[s] - min(3 * sizes[s], high * weight[s])) <= largest[s] + 1


def test_shards_are_even_in_rows_and_sources(steps):
    rows = steps[5].collect()
    assert Counter(r.doc_id for r in rows) == ids(steps[4])
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert set(shards) == set(range(40))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    share = Counter(r.source for r in rows)
    for s in shards.values():
        for source, n in Counter(r.source for r in s).items():
            assert abs(n - share[source] * len(s) / len(rows)) < 3


def test_run_applies_all_stages(spark, tables, steps):
    got = corpus_pipeline.run(spark, tables[0])
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[5].collect()))
