import random
import re
from collections import Counter

from settlegrid.llm import url_filter as u
from settlegrid.llm.decontam import contaminated, drop_contaminated


def brute(docs, items, threshold=0.8):
    def grams(words, width):
        return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))

    found = {}
    for d, text in docs:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for i, item in items:
            want = re.findall(r"[^\W_]+", (item or "").lower())
            if not want:
                continue
            width = min(5, len(want))
            b = grams(want, width)
            best = 0
            for s in range(max(1, len(words) - len(want) + 1)):
                a = grams(words[s : s + len(want)], width)
                best = max(best, sum((a & b).values()) / max(1, sum((a | b).values())))
            if best >= threshold:
                found[d, i] = max(best, found.get((d, i), 0))
    return found


def test_finds_what_all_windows_find(spark):
    draw = random.Random(12)
    word = lambda: draw.choice("aeiou") + str(draw.randrange(300))
    items = [(i, " ".join(word() for _ in range(draw.randrange(6, 50)))) for i in range(14)]
    items += [(50, "tiny item"), (51, "solo"), (52, ""), (53, None), (54, items[0][1]), (55, "la " * 20), (56, "!! ,")]
    docs = []
    for n in range(60):
        words = [word() for _ in range(draw.randrange(0, 120))]
        if n % 2:
            passage = draw.choice(items[:14])[1].split()
            for _ in range(n % 5):
                passage[draw.randrange(len(passage))] = word()
            at = draw.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((n, " ".join(w.upper() + draw.choice([" ", ", ", "\n"]) for w in words)))
    half = items[3][1].split()
    docs += [(100, None), (101, ""), (102, "A tiny, item!"), (103, "la " * 2000 + "end"), (104, " ".join(half[len(half) // 2 :] + half[: len(half) // 2])), (None, items[1][1]), (105, "Solo"), (3, items[2][1]), (106, " ".join(items[4][1].split()[:-1]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = contaminated(table, bench).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    assert all(abs(r.similarity - want[r.doc_id, r.item_id]) < 1e-9 for r in got)
    left = drop_contaminated(table, bench)
    assert left.columns == table.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(docs, items.limit(0)).count() == 0
    assert contaminated(docs.limit(0), items).count() == 0


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def test_hosts_rules_and_model(spark):
    urls = [
        "http://a.example.net/en/1", "https://EXAMPLE.net/EN/1", "http://net/", "http://net", "http://xnet/", "http://x.net?q=/", "http://b.example.com/de/x#/en/",
        "http://badexample.com/de/", "http://q.org/fr/1", "http://q.org/FR/1", "ftp://h:80/p?x", None, "", "no-scheme/en/", "://", "http://user@Host.org/a://b", "http://Ünï.org/fr/é",
        "http://casino.example.com/poker", "http://library.example.com/en/books", "http://casino.example.com/poker",
    ]
    pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)], "page_id long, url string, host string")
    model = u.train(spark)
    got = {r.page_id: r for r in u.judge(pages, model).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = plain_parts(url)
        assert (got[i].host, got[i].path) == (host, path)
        fits = [(len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i].rule == (max(fits)[1] if fits else None)
        assert got[i].verdict == (max(fits)[2] if fits else "block" if got[i].score >= 0.5 else "allow")
    assert got[17].verdict == "block" and got[18].verdict == "allow" and got[17].score == got[19].score
    assert u.judge(pages.limit(0), model).count() == 0


def test_model_reads_hosts_it_never_saw(spark):
    rows = [(0, "http://mega-casino-slots.example.io/bonus"), (1, "http://porn-cams.example.io/xxx"), (2, "http://the-library.example.io/en/guide"), (3, "http://news-archive.example.io/article/5")]
    got = {r.page_id: r.verdict for r in u.judge(spark.createDataFrame(rows, "page_id long, url string"), u.train(spark)).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_null_ids_go_for_their_own_texts_only(spark):
    item = " ".join(f"word{i}" for i in range(12))
    docs = spark.createDataFrame([(None, item, 1, "x"), (None, "clean", 2, "y"), (None, None, 3, "z"), ("a", f"start {item} end", 4, "w"), ("b", "clean", 5, "v")], "doc_id string, text string, _key int, _key_ string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r._key for r in left.collect()) == [2, 3, 5]
    assert drop_contaminated(docs, bench.limit(0)).count() == 5 and drop_contaminated(docs.limit(0), bench).count() == 0


def test_table_teaches_words_it_holds_back(spark):
    from pyspark.sql import functions as F

    rows = u.labelled_urls()
    held = [r for i, r in enumerate(rows) if i // 4 % 5 == 0]
    model = u.train(spark, [r for i, r in enumerate(rows) if i // 4 % 5])
    pages = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(held)], "page_id long, url string, y int")
    judged = u.judge(pages, model, rules=()).join(pages, "page_id").groupBy("y").agg(F.avg((F.col("verdict") == "block").cast("int")).alias("share"))
    share = {r.y: r.share for r in judged.collect()}
    assert share[1] >= 0.5 and share[0] <= 0.03
    assert u.judge(spark.createDataFrame([(None, "http://x.io/casino-12"), (1, "http://x.io/casino-9999")], "page_id long, url string"), model).select("score").distinct().count() == 1
