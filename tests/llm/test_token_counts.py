import random

import public_tokenizers
from tokenizers import Tokenizer as Library

from settlegrid.llm import token_counts as t

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\t", "I'm you'll we've 12345 a1b2", "<|endoftext|> x<|startoftext|>y <|end", "ΑΣ ΟΔΟΣ Σ", "é é ñ", "a\x1cb \x1f", "日本語 😀😀😂😂😂😂😂😂😂😂",
    "İstanbul ǅ ſ", "x" * 5000, "ab" * 700, "don't DON'T 'S's''re", "\U0010ffff", "²³½ ⅷ", "____--==", "\x00\x01", "\x85 a", "the" * 200 + "ing" * 100, "!" * 300,
]


def library_counts(texts):
    return [len(e.ids) for e in Library.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys():
    draw, library = random.Random(9), Library.from_file(PATH)
    pieces = [w.replace("</w>", "") for w in sorted(library.get_vocab())]
    texts = list(ODD)
    texts += ["".join(draw.choice(pieces)[:10] for _ in range(draw.randrange(1, 6))) for _ in range(800)]
    texts += ["".join(draw.choice("abeinorstlh ") for _ in range(draw.randrange(1, 300))) for _ in range(400)]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(160, 0x3000), draw.randrange(0x4E00, 0x9FFF)])) for _ in range(draw.randrange(1, 40))) for _ in range(300)]
    counter, want = t.Counter(t.Tokenizer.load(PATH)), library_counts(texts)
    assert [counter.count(x) for x in texts] == want
    assert [counter.count(x, 5) for x in texts] == want
    counter.words.clear()
    assert [counter.count(x, 1) for x in texts[:100]] == want[:100]


def test_chunk_maps_compose_in_any_grouping():
    counter = t.Counter(t.Tokenizer.load(PATH))
    text = "Hello wor" + "ld, don't stop" + "ping" + " now"
    a, b, c = (counter.chunk_map(x) for x in (text[:9], text[9:23], text[23:]))
    left, right = counter.compose(counter.compose(a, b), c), counter.compose(a, counter.compose(b, c))
    assert left == right


def test_rows(spark):
    rows = [(i, x, 7) for i, x in enumerate(ODD)] + [(100, None, 7), (None, "abc", 7), (3, ODD[3], 7), (101, "word " * 2049, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = t.token_counts(docs, t.Tokenizer.load(PATH)).collect()
    want = library_counts([x or "" for _, x, _ in rows])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((x or "").encode()), n, n > 2048) for (i, x, _), n in zip(rows, want))
    assert t.token_counts(docs.limit(0), t.Tokenizer.load(PATH)).count() == 0


def test_every_code_point_between_letters():
    points = [c for c in (*range(0xD800), *range(0xE000, 0x110000)) if c < 0x32000 or c >= 0xE0000 or c % 64 == 0]
    counter = t.Counter(t.Tokenizer.load(PATH))
    for start in range(0, len(points), 100_000):
        texts = [f"a{chr(c)}b {chr(c)}\u0327\u0301{chr(c)}" for c in points[start : start + 100_000]]
        want = library_counts(texts)
        wrong = [hex(c) for c, x, n in zip(points[start:], texts, want) if counter.count(x) != n]
        assert not wrong


def test_long_texts_are_counted_by_several_tasks(spark):
    texts = [" ".join(ODD * 3), "x" * 950, ("ab cd<|endoftext|>" * 70), "no", None]
    docs = spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(texts)] + [(None, texts[0])], "doc_id string, text string")
    got = t.token_counts(docs, t.Tokenizer.load(PATH), long=100).collect()
    want = library_counts([x or "" for x in [*texts, texts[0]]])
    sizes = [len((x or "").encode()) for x in [*texts, texts[0]]]
    assert sorted((str(r.doc_id), r.n_tokens, r.n_bytes) for r in got) == sorted(zip([*(f"d{i}" for i in range(5)), "None"], want, sizes))
