"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read_table
from .decontam import contaminated
from .exact_dedup import exact_duplicates
from .language import identify
from .language import train_on as learn_languages
from .mixing import mix_counts
from .near_dup import near_duplicates
from .quality import quality
from .quality import train_on as learn_quality
from .sharding import shard_rows
from .token_counts import Tokenizer, token_counts
from .toxicity import toxicity, train_on
from .url_filter import judge
from .url_filter import train as learn_urls

SHARDS = 40


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mix_counts(read_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(read_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train_on(docs, read_table(spark, sf_dir, "labels"), modulus=3, remainder=1)
    return toxicity(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = learn_languages(docs, modulus=5, remainder=0)
    return identify(docs, profiles).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn_quality(docs, read_table(spark, sf_dir, "labels"), modulus=5, remainder=0)
    return quality(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), learn_urls(spark))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), Tokenizer.load(public_tokenizers.path("word_bpe_49k.json")))


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(length(text), 0) AS chars,
         (CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':1729'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents
), keyed AS (
  SELECT doc_id, coalesce('=' || source, '-') AS skey, source, size,
         -ln(u::DOUBLE) / greatest(1.0::DOUBLE / (1.0::DOUBLE + abs(chars::DOUBLE / greatest(size, 1) - 6.0::DOUBLE)), 1e-6::DOUBLE) AS key
  FROM base
), sources AS (
  SELECT skey, source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM keyed GROUP BY skey, source
), ranked AS (
  SELECT *, ((n - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS ceiling FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER before, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level,
         row_number() OVER (ORDER BY ceiling / weight, n) AS place
  FROM ranked
  WINDOW before AS (ORDER BY ceiling / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fit AS (
  SELECT min(place) AS place FROM levels WHERE level * weight <= ceiling
), targets AS (
  SELECT l.skey, l.source_size,
         least(l.ceiling, coalesce((SELECT level FROM levels x WHERE x.place = (SELECT place FROM fit)) * l.weight, l.ceiling)) AS target
  FROM levels l
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets
), placed AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs,
         sum(k.size) OVER (PARTITION BY k.skey ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size / 2.0::DOUBLE AS middle,
         b.target - b.epochs * b.source_size AS budget
  FROM keyed k JOIN budgets b ON k.skey = b.skey
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       ((epochs + CASE WHEN size > 0 AND budget > 0 AND middle < budget THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""

OP2_SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
"""


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), i AS (
  SELECT item_id, w, len(w) AS n, least(len(w), 5) AS width
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0
), ig AS (
  SELECT item_id, n, width, g, count(*) AS c
  FROM (SELECT item_id, n, width, array_to_string(w[p:p + width - 1], ' ') AS g FROM i, unnest(generate_series(1, n - width + 1)) t(p))
  GROUP BY item_id, n, width, g
), dg AS (
  SELECT doc_id, width, len(w) AS nw, p, array_to_string(w[p:p + width - 1], ' ') AS g
  FROM d, (SELECT DISTINCT width FROM i) x, unnest(generate_series(1, len(w) - width + 1)) t(p)
), a AS (
  SELECT DISTINCT doc_id, item_id, n, dg.width, nw, greatest(1, least(p, nw - n + 1)) AS s
  FROM dg JOIN ig ON dg.g = ig.g AND dg.width = ig.width
), win AS (
  SELECT a.doc_id, a.item_id, a.n, a.width, a.nw, a.s, dg.g, count(*) AS c
  FROM a JOIN dg ON dg.doc_id = a.doc_id AND dg.width = a.width AND dg.p BETWEEN a.s AND a.s + a.n - a.width
  GROUP BY ALL
), met AS (
  SELECT doc_id, win.item_id, s, any_value(win.n) AS n, any_value(win.width) AS width, any_value(nw) AS nw, sum(least(win.c, ig.c))::DOUBLE AS m
  FROM win JOIN ig ON win.item_id = ig.item_id AND win.g = ig.g
  GROUP BY doc_id, win.item_id, s
), sim AS (
  SELECT doc_id, item_id, s - 1 AS start, m / ((least(nw, n) - width + 1) + (n - width + 1) - m) AS similarity FROM met
)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, {'a': -similarity, 'b': start}) AS start
FROM sim WHERE similarity >= 0.8::DOUBLE - 1e-12::DOUBLE GROUP BY doc_id, item_id
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
  FROM d, unnest(generate_series(1, greatest(1, len(w) - 4))) t(p) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x AS src, x AS dst FROM both_ways UNION SELECT r.src, b.y FROM reach r JOIN both_ways b ON b.x = r.dst
), low AS (
  SELECT src, min(dst) AS component_id FROM reach GROUP BY src
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id,
       coalesce(low.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.src = d.doc_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_mixing": op1_mixing,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_decontamination": op3_decontamination,
        "op7_url_filter": op7_url_filter,
        "op4_token_counts": op4_token_counts,
        "op5_sharding": op5_sharding,
        "op6_toxicity": op6_toxicity,
        "op8_language_id": op8_language_id,
        "op10_quality": op10_quality,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op3_decontamination": OP3_SQL, "op9_minhash_near_dedup": OP9_SQL}
