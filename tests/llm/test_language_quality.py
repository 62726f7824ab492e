import random

import numpy as np

from settlegrid.llm import language as lang
from settlegrid.llm import quality as q

PARTS = {"aa": ["kor", "zit", "mel", "vun"], "bb": ["shae", "olli", "nua", "wey"], "cc": ["pfro", "tzul", "chek", "grun"]}


def speech(draw, name, words):
    return " ".join("".join(draw.choice(PARTS[name]) for _ in range(draw.randrange(1, 4))) for _ in range(words))


def test_languages_and_defined_cases(spark):
    draw = random.Random(4)
    rows = [(i, speech(draw, name, draw.randrange(8, 60)), name, "x") for i, name in enumerate(draw.choices(list(PARTS), k=300))]
    odd = [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 -- 9!", "bb", "x"), (1003, rows[0][1] * 400, None, "x"), (None, "kor zit", "aa", "x"), (3, rows[3][1], rows[3][2], "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    got = lang.identify(docs, lang.train_on(docs, modulus=5, remainder=0)).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert np.mean([by_id[i].lang_pred == name for i, _, name, _ in rows]) > 0.97
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == rows[0][2] and all(0 <= r.score <= 1 for r in got)


def test_bundle_is_the_sum_of_bound_ngrams():
    text = "Abca, b"
    codes = [0, *map(ord, "abca"), 0, ord("b"), 0]
    v = lang.letter_vector
    want = sum(np.roll(v(a).astype(int), 2) * np.roll(v(b).astype(int), 1) * v(c) for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert np.array_equal(lang.bundle([text, None])[0][0], want)


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "kor", None)], "doc_id long, text string, lang string")
    profiles = lang.train_on(docs, modulus=5, remainder=0)
    assert lang.identify(docs, profiles).collect()[0].lang_pred == "und"
    assert lang.identify(docs.limit(0), profiles).count() == 0


def test_additive_model_learns_curves_and_interactions():
    draw = np.random.default_rng(2)
    x = draw.random((3000, 4))
    y = ((np.abs(x[:, 0] - 0.5) > 0.25) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(int)
    model = q.fit(x[:2400], y[:2400])
    assert ((model.score(x[2400:]) >= 0.5) == y[2400:]).mean() > 0.93
    assert {(1, 2)} & {(i, j) for i, j, _ in model.pairs}


def test_score_is_the_sum_of_looked_up_values():
    draw = np.random.default_rng(3)
    x = draw.random((200, 3))
    model = q.fit(x, (x[:, 0] + x[:, 1] > 1).astype(int), rounds=10, pair_rounds=3)
    bins = model.bins(x[:1])[0]
    small = [b * q.COARSE // (len(e) + 1) for b, e in zip(bins, model.edges)]
    total = model.base + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[small[i], small[j]] for i, j, t in model.pairs)
    assert np.isclose(model.score(x[:1])[0], 1 / (1 + np.exp(-total)))


def test_quality_rows_and_defined_cases(spark):
    draw = random.Random(8)
    rows = []
    for i in range(200):
        words = [draw.choice("abcdef") * draw.randrange(2, 7) for _ in range(draw.randrange(5, 60))]
        rows.append((i, " ".join(w + "%%%" * (i % 3 == 0) for w in words), 5))
    odd = [(500, None, 1), (501, "", 1), (502, "a " * 50000, 1), (None, "b c", 1), (3, rows[3][1], 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, quality int")
    marks = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)] + [(None, 1), (4, None)], "doc_id long, quality int")
    got = q.quality(docs, q.train_on(docs, marks, modulus=5, remainder=0)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd) and by_id[500].score == by_id[501].score
    assert np.mean([by_id[i].predicted == int(i % 3 != 0) for i in range(200)]) > 0.97
    empty = q.train_on(docs, marks.limit(0), modulus=5, remainder=0)
    assert {r.score for r in q.quality(docs, empty).collect()} == {0.5}
    assert q.quality(docs.limit(0), empty).count() == 0


def test_pieces_and_neighbours_change_nothing(monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcdé ñ日本") for _ in range(draw.randrange(0, 400))) for _ in range(30)] + [None, "", "12 ?"]
    vectors, some = lang.bundle(texts)
    monkeypatch.setattr(lang, "LETTERS", 37)
    monkeypatch.setattr(lang, "KINDS", 11)
    again, also = lang.bundle(texts)
    assert np.array_equal(vectors, again) and np.array_equal(some, also)
    profiles = lang.Profiles.of({"a": vectors[0], "b": vectors[1], "c": vectors[2]})
    whole = profiles.identify(texts)
    one = [profiles.identify([x]) for x in texts]
    assert whole[0] == [n[0] for n, _ in one] and np.array_equal(whole[1], np.concatenate([s for _, s in one]))
