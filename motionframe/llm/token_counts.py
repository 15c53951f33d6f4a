"""Token counts through a digest cache (operator 10).

A text counts the same wherever it stands, so counts are stored under the digest of its content
(null as empty, UTF-8) and the digest of the tokenizer file. A run joins the digests of its
documents to the cache, encodes one document of each digest that misses, appends those counts
and reads every count from the cache.

Only digests and ids are grouped; a text crosses the network once, on the id of its row, so a
group of copies of any size is spread like other rows. The cache is a Parquet folder; lost tasks
leave nothing (Spark's committer), and two runs at once may append a digest twice, which the
reading side folds.

Cases: a null or empty text has 0 bytes and 0 tokens; no rows give no rows; repeated rows and
equal texts are counted once and returned each; null doc_ids are kept.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from motionframe.llm import common, tokens

LIMIT = 512
CACHE_SCHEMA = "tokenizer string, digest binary, n_bytes long, n_tokens long"


def _counter(path):
    def run(batches):
        for batch in batches:
            for some in tokens.slices(batch):
                _, bounds = tokens.encoder(path).encode(some.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [some.column("digest"), some.column("n_bytes"), pa.array(np.diff(bounds))], ["digest", "n_bytes", "n_tokens"]
                )

    return run


def stored(spark, cache, tokenizer):
    """Counts of one tokenizer version, one row a digest."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == tokens.file_digest(tokenizer))
    return rows.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def count_tokens(spark, docs, cache, tokenizer=None, limit=LIMIT):
    """doc_id, n_bytes, n_tokens, over_limit of every document; ``cache`` is a shared folder."""
    tokenizer = tokenizer or tokens.default_tokenizer()
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)  # the folder is there from now on
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    keys = common.written(spark, keyed.select("doc_id", "digest"), "op10-digests")
    missing = keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored(spark, cache, tokenizer), "digest", "left_anti")
    missing = common.written(spark, missing, "op10-misses")
    chosen = (keyed["digest"] == missing["digest"]) & keyed["doc_id"].eqNullSafe(missing["doc_id"])
    texts = keyed.join(missing, chosen, "left_semi").select("digest", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    fresh = texts.mapInArrow(_counter(tokenizer), "digest binary, n_bytes long, n_tokens long")
    fresh.select(F.lit(tokens.file_digest(tokenizer)).alias("tokenizer"), "digest", "n_bytes", "n_tokens").write.mode("append").parquet(cache)
    counted = keys.join(stored(spark, cache, tokenizer), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
