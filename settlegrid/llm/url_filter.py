"""URL filter: rules by host and path, and a logistic regression for the rest, in SQL functions only.

The regression works on hashed character n-grams of host and path and is fitted
by ``pyspark.ml`` to a small labelled table of URLs. Scoring is a sum of looked-up
coefficients within one projection.
"""

from __future__ import annotations

import uuid
from random import Random

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

BUCKETS = 2048
SIZES = (3, 4, 5)
THRESHOLD = 0.5

#: Rules of the contract, (verdict, host, path): fixed values.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Words of unwanted and of harmless sites and paths, from which the labelled table is composed.
UNWANTED = (
    "casino poker slots jackpot roulette blackjack bingo lottery gamble gambling bet bets betting odds wager bookmaker tipster spins bonus win winner prize jackpots "
    "pills viagra cialis pharma meds steroids slimming diet enlargement payday loan loans credit cash money rich profit forex crypto doubler "
    "cheap replica fake discount free offer offers deal click clicks ads adserver ad banner popup track tracker tracking pixel affiliate spam "
    "linkfarm farm seo backlinks traffic porn xxx adult sex cams nude escort dating hookup warez crack keygen serial torrent pirate malware virus phishing verify-login hack exploit"
).split()
HARMLESS = (
    "library archive docs guide manual news press blog journal wiki encyclopedia university college school academy museum gallery science research theory physics chemistry biology "
    "history garden plants flowers recipes kitchen bakery weather forecast maps city council village station railway airport travel hotel island mountain river lake forest nature animals birds "
    "music concert orchestra theatre cinema film books poetry novel author radio television sport football tennis swimming cycling health hospital clinic dentist pharmacy law court notary "
    "code software project developer database compiler kernel network forum community people family children parents nation government embassy army police fire church "
    "market shop store furniture clothing shoes bicycle car motor engine energy water house building architect design paint photo camera art craft paper pen mail post phone"
).split()
#: Beginnings, middles and ends of syllables, for invented names.
ONSETS = "b c d f g h j k l m n p r s t v w y z bl br ch cl cr dr fl fr gl gr pl pr sh sl sp st th tr wh".split()
VOWELS = "a e i o u ea ee ou".split()
CODAS = ["", *"n r s l t d m nd st sh ng ck nt".split()]
#: Invented names that are harmless, so that letters which mean nothing count as calm.
INVENTED = 1500
ENDINGS = ("com", "org", "net", "info", "co.uk", "de", "fr", "es")


def labelled_urls() -> list[tuple[str, int]]:
    """``url, label`` (1: unwanted): words in pairs as hosts, alone below a subdomain and in paths.

    Invented names, languages and numbers in paths stand on both sides, so that
    they tell nothing.
    """
    found, draw = [], Random(2024)
    name = lambda: "".join(draw.choice(ONSETS) + draw.choice(VOWELS) + draw.choice(CODAS) for _ in range(draw.randrange(1, 4)))
    for label, words in ((1, UNWANTED), (0, HARMLESS)):
        other = HARMLESS if label else UNWANTED
        for i, word in enumerate(words):
            second, third, end = words[(i * 7 + 3) % len(words)], words[(i * 11 + 5) % len(words)], ENDINGS[i % len(ENDINGS)]
            language = ("en", "de", "fr", "es")[i % 4]
            found += [
                (f"http://{word}-{second}.{end}/{language}/{i * 37}", label),
                (f"https://www.{word}{third}.{end}/{name()}", label),
                (f"https://{name()}.{end}/{word}/{second}", label),
                (f"http://{('www', 'm', 'blog', 'shop')[i % 4]}.{word}.{end}/{language}/{name()}.html", label),
            ]
            if i % 3 == 0:
                # A harmless word does not clear an unwanted host, nor does an unwanted one in a path damn a library.
                found.append((f"http://{word}-{third}.{end}/{other[i % len(other)] if label else name()}/{i}", label))
    found += [(f"http://{('www.', 'm.', 'blog.', '')[i % 4]}{name()}.{ENDINGS[i % 8]}/{('en', 'de', 'fr', 'es')[i // 4 % 4]}/{name()}/{i * 13}", 0) for i in range(INVENTED)]
    return found


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the columns ``host`` and ``path``; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def buckets() -> Column:
    """Distinct hashed n-grams of ``host`` and ``path``, each with marks at its ends and every number as one 0."""
    parts = []
    for mark, column in (("h", "host"), ("p", "path")):
        plain = f"concat('<', regexp_replace(lower({column}), '[0-9]+', '0'), '>')"
        each = ", ".join(f"if(length(t) < {n}, array(), transform(sequence(1, length(t) - {n - 1}), i -> cast(pmod(xxhash64('{mark}', substring(t, i, {n})), {BUCKETS}) as int)))" for n in SIZES)
        parts.append(f"transform(array({plain}), t -> concat({each}))[0]")
    return F.array_distinct(F.expr(f"concat({', '.join(parts)})"))


def train(spark: SparkSession, table: list[tuple[str, int]] | None = None) -> tuple[list[float], float]:
    """Coefficients and intercept; label 1 is ``block``."""
    rows = labelled_urls() if table is None else table
    values = ", ".join(f"('{u}', {y})" for u, y in rows)
    host, path = host_and_path("url")
    found = spark.sql(f"SELECT col1 AS url, col2 AS label FROM VALUES {values}").select("label", host.alias("host"), path.alias("path"))
    # Written as sparse vectors in a format that Spark's own reader knows.
    marks = F.array_join(F.transform(F.sort_array(buckets()), lambda b: F.concat((b + 1).cast("string"), F.lit(":1"))), " ")
    path = f"{shared_dir(spark)}/settlegrid/urls-{uuid.uuid4().hex}"
    found.coalesce(1).select(F.concat_ws(" ", "label", marks).alias("value")).write.text(path)
    vectors = spark.read.format("libsvm").option("numFeatures", BUCKETS).load(path)
    model = LogisticRegression(maxIter=25, regParam=0.02).fit(vectors)
    return [float(c) for c in model.coefficients], float(model.intercept)


def judge(pages: DataFrame, model: tuple[list[float], float], *, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, score, verdict``.

    Without a rule the regression decides: ``block`` from a probability of
    ``THRESHOLD`` on. Null urls and those without ``://`` have an empty host and path, whose
    only n-grams are those of their marks. Very long urls are read whole,
    repeated rows judged each, null ids pass through, other columns play no
    part. An empty table gives no rows.
    """
    weights, bias = model
    host, path = host_and_path(url_col)
    seen = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("_b", buckets())
    table = F.array(*(F.lit(w) for w in weights))
    logit = F.aggregate("_b", F.lit(bias), lambda total, b: total + F.element_at(table, b + 1))
    rule, verdict = rule_for(rules)
    seen = seen.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    verdict = F.coalesce(verdict, F.when(F.col("score") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow")))
    return seen.select("page_id", "host", "path", rule.alias("rule"), "score", verdict.alias("verdict"))
