import random
import zlib

import numpy as np

from settlegrid.llm import toxicity as t


def corpus(n=600, seed=3):
    draw = random.Random(seed)
    stems = ["blorgat", "zunderk", "mivraxo"]
    texts, labels = [], []
    for i in range(n):
        words = [f"{draw.choice('bcdfgh')}{draw.choice('aeiou')}{draw.choice('lmnrst')}{draw.choice('aeiou')}" for _ in range(draw.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(stems) + draw.choice(["", "s", "ed", "ish", "ler"])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


def score(model, text):
    return float(model.scores([text], model.word_gains())[0])


def test_subwords_are_all_ngrams_and_the_word():
    words = ["a", "ab", "abc", "abcdefgh", "été", "x" * 40, "abc"]
    flat, ends = t.subwords(words, 1 << 30)
    parts = np.split(flat, ends[:-1])
    for word, part in zip(words, parts):
        marked = f"<{word}>"
        assert len(part) == 1 + sum(max(0, len(marked) - n + 1) for n in t.NGRAMS) - (len(marked) in t.NGRAMS)
    assert np.array_equal(parts[2], parts[6])
    assert len(set(parts[2].tolist()) & set(parts[3].tolist())) == 3  # <ab, abc and <abc
    assert len(t.subwords([])[0]) == 0


def test_pieces_of_a_long_text_score_as_the_whole(monkeypatch):
    texts, labels = corpus(300)
    model = t.train(texts, labels)
    long = [" ".join(texts[i : i + 40]) for i in range(0, 200, 40)] + ["", None, "zz", "aa " * 50]
    whole = model.scores(long, model.word_gains())
    gains = model.word_gains()
    slow = []
    for x in long:
        numbers = t.without_repeats(gains.numbers(t.words_of(x)))
        top = model.bias + t.window_means(numbers, gains.sums, gains.counts).max()
        slow.append(1 / (1 + np.exp(-np.clip(model.slope * top + model.shift, -40, 40))))
    assert np.allclose(whole, slow)
    monkeypatch.setattr(t, "PIECE", 200)
    assert np.allclose(model.scores(long[:5], model.word_gains()), whole[:5])


def test_learns_and_reads_unseen_spellings():
    texts, labels = corpus()
    model = t.train(texts[:480], labels[:480])
    scores = np.array([score(model, x) for x in texts[480:]])
    assert scores[labels[480:] == 1].mean() > 0.8 > 0.3 > scores[labels[480:] == 0].mean()
    calm = "cali doru hino " * 3
    assert score(model, calm + "bl0rgatt zunderkk") > score(model, calm + "comu dite")


def test_one_class_and_no_labels():
    assert 0.5 < score(t.train(["a b", "c d"], np.array([1, 1])), "zzz") < 1
    assert score(t.train([], np.array([])), None) == 0.5


def test_query_rows(spark):
    texts, labels = corpus(200)
    rows = [(i, x, "src", 1) for i, x in enumerate(texts)] + [(900, None, None, 2), (901, "", "s", 3), (902, "?!", "s", 3), (903, "blorgat " * 30000, "s", 4), (None, "blorgat", "s", 1), (5, texts[5], "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, label int")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = t.train_on(docs, marks, modulus=3, remainder=1)
    got = t.toxicity(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].score == by_id[901].score == by_id[902].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    left = t.drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert left.count() == sum(r.predicted == 0 for r in got)


def test_held_out_rows_teach_nothing(spark):
    texts, labels = corpus(120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    outside = {i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1}
    models = []
    for flip in (0, 1):
        marks = [(i, int(1 - y if flip and i in outside else y)) for i, y in enumerate(labels)]
        models.append(t.train_on(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), modulus=3, remainder=1))
    assert np.array_equal(models[0].gain, models[1].gain) and models[0].bias == models[1].bias


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = t.train_on(docs, spark.createDataFrame([], "doc_id long, toxic int"), modulus=3, remainder=1)
    assert t.toxicity(docs, model).count() == 0
