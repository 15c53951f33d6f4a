"""Registered queries of this package: name -> f(spark, sf_dir), and SQL where it can say them."""

import hashlib

from pyspark.sql import functions as F

from motionframe.llm import centroids, common, exact_dedup, lm_score, matrix_bpe, mixing, outliers, packing, phrases, rans, simhash
from motionframe.llm import token_counts, toxicity, url_filter

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _draw(seed, hex_digits=7):
    """A number from a text, the same in Spark and in SQL."""
    return F.conv(F.substring(F.md5(seed), 1, hex_digits), 16, 10).cast("long")


def url_entries(spark, sf_dir):
    """Dated entries for the hosts and URLs of ``pages``: up to four changes of each domain, and
    one entry for some URLs, over the 60 days around the captures."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url")
    hosts = pages.select(url_filter.host(F.col("url")).alias("pattern")).filter("pattern <> ''").distinct()
    start = F.lit(1704067200)
    changes = hosts.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    seed = lambda what: F.concat_ws(":", F.lit(what), "pattern", F.col("k").cast("string"))
    domains = changes.filter(_draw(seed("use")) % 3 == 0).select(
        F.when(F.col("k") == 3, "allow").otherwise("block").alias("list"), F.lit("domain").alias("kind"), "pattern",
        F.timestamp_seconds(start + _draw(seed("at")) % (60 * 86400)).alias("at"), (F.col("k") != 1).alias("listed"),
    )
    urls = pages.select(url_filter.plain_url(F.col("url")).alias("pattern")).filter("pattern <> ''").distinct().withColumn("k", F.lit(9))
    single = urls.filter(_draw(seed("use")) % 10 == 0).select(
        F.lit("block").alias("list"), F.lit("url").alias("kind"), "pattern",
        F.timestamp_seconds(start + _draw(seed("at")) % (60 * 86400)).alias("at"), F.lit(True).alias("listed"),
    )
    return domains.unionByName(single)


@query(
    "op1_url_filter",
    r"""
WITH parts AS (SELECT row_number() OVER () AS id, page_id, lower(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^#]*)', 1) AS rest,
    1704067200 + ('0x' || substr(md5('fetch:' || CAST(page_id AS VARCHAR)), 1, 7))::BIGINT % (60 * 86400) AS fetched
  FROM pages),
hosts AS (SELECT DISTINCT host FROM parts WHERE host <> ''),
urls AS (SELECT DISTINCT host || rest AS u FROM parts WHERE host || rest <> ''),
entries AS (
  SELECT CASE WHEN k = 3 THEN 'allow' ELSE 'block' END AS list, 'domain' AS kind, host AS pattern, k <> 1 AS listed,
    1704067200 + ('0x' || substr(md5(concat('at:', host, ':', CAST(k AS VARCHAR))), 1, 7))::BIGINT % (60 * 86400) AS moment
  FROM hosts, range(4) t(k) WHERE ('0x' || substr(md5(concat('use:', host, ':', CAST(k AS VARCHAR))), 1, 7))::BIGINT % 3 = 0
  UNION ALL
  SELECT 'block', 'url', u, true, 1704067200 + ('0x' || substr(md5(concat('at:', u, ':9')), 1, 7))::BIGINT % (60 * 86400)
  FROM urls WHERE ('0x' || substr(md5(concat('use:', u, ':9')), 1, 7))::BIGINT % 10 = 0),
folded AS (SELECT list, kind, pattern, moment, bool_and(listed) AS listed FROM entries GROUP BY ALL),
spans AS (SELECT list, kind, pattern, moment AS since, until FROM (SELECT *, lead(moment) OVER (PARTITION BY list, kind, pattern ORDER BY moment) AS until
    FROM folded) WHERE listed),
probes AS (SELECT id, fetched, 'url' AS kind, host || rest AS pattern FROM parts WHERE host <> ''
  UNION ALL SELECT id, fetched, 'domain', pattern FROM (SELECT id, fetched, unnest(
    list_transform(range(1, len(l) + 1), lambda k: array_to_string(l[len(l) - k + 1:], '.'))) AS pattern
    FROM (SELECT *, string_split(host, '.') AS l FROM parts WHERE host <> ''))),
found AS (SELECT id, count(*) FILTER (list = 'block') AS n_block, count(*) FILTER (list = 'allow') AS n_allow
  FROM probes JOIN spans USING (kind, pattern) WHERE fetched >= since AND (until IS NULL OR fetched < until) GROUP BY id)
SELECT p.page_id, p.host, coalesce(n_block, 0) AS n_block, coalesce(n_allow, 0) AS n_allow,
  coalesce(n_block, 0) = 0 OR coalesce(n_allow, 0) > 0 AS kept
FROM parts p LEFT JOIN found f ON f.id = p.id
""",
)
def url_lists(spark, sf_dir):
    """Every capture of ``pages``, fetched at a moment drawn from its page_id, against the lists."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    fetched = F.timestamp_seconds(F.lit(1704067200) + _draw(F.concat(F.lit("fetch:"), F.col("page_id").cast("string"))) % (60 * 86400))
    captures = pages.select(F.col("page_id").alias("key"), "url", fetched.alias("fetched_at"))
    judged = url_filter.judge(captures, url_entries(spark, sf_dir))
    return judged.select(F.col("key").alias("page_id"), url_filter.host(F.col("url")).alias("host"), "n_block", "n_allow", "kept")


@query("op2_toxicity")
def toxic_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.score(spark, docs, toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op3_lm_scores")
def lm_scores(spark, sf_dir):
    """The target are the documents that ``labels`` marks as of good quality."""
    docs = documents(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return lm_score.score_own(spark, lm_score.fit(spark, docs, good))


@query("op4_token_files")
def token_files(spark, sf_dir):
    return rans.digests(spark, documents(spark, sf_dir))


@query("op5_quality_outliers")
def quality_outliers(spark, sf_dir):
    return outliers.judge(spark, documents(spark, sf_dir))


@query("op6_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.digests(spark, documents(spark, sf_dir))


@query(
    "op7_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
)
def exact_duplicates(spark, sf_dir):
    return exact_dedup.duplicates(spark, documents(spark, sf_dir))


@query("op8_source_mix")
def source_mix(spark, sf_dir):
    sized = documents(spark, sf_dir).select("doc_id", "source", common.word_count(F.col("text")).alias("size"))
    return mixing.taken_words(spark, sized).drop("source", "key")


@query("op9_simhash_anchors")
def simhash_components(spark, sf_dir):
    return simhash.clusters(spark, documents(spark, sf_dir))


@query("op10_token_counts")
def token_count_cache(spark, sf_dir):
    cache = f"{common.shared_dir(spark)}/llm/token-counts/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return token_counts.count_tokens(spark, documents(spark, sf_dir), cache)


@query("op11_ns_centroids", centroids.twin_sql())
def centroid_clusters(spark, sf_dir):
    return centroids.clusters(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_phrases", phrases.TWIN)
def phrase_collocations(spark, sf_dir):
    return phrases.collocations(spark, documents(spark, sf_dir))


@query("op13_matrix_bpe")
def matrix_encoded(spark, sf_dir):
    return matrix_bpe.digests(spark, documents(spark, sf_dir))
