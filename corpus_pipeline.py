"""The training-data pipeline: each stage takes what its predecessor kept.

Toxic documents go, then copies of equal text, then near-copies (Jaccard similarity of 0.8 or more
on five-word shingles, found by SimHash anchors); what stays is mixed to source weights and packed. All stages but the last return the columns of ``documents``.

In the mix a document is worth the words that the mix takes of it. The mix repeats and cuts
documents; the stage returns it at the grain of documents: one whole document for each time that
it is taken, begun times counted where at least half of the document is read.
"""

from pyspark.sql import functions as F

from motionframe.llm import common, exact_dedup, mixing, near_copies, packing, toxicity

#: Models and hashed orders are not expressible in SQL; the tests compare with plain versions.
ORACLE_SQL = None


def remove_toxic(spark, docs, sf_dir):
    return toxicity.clean(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark, docs, sf_dir):
    return exact_dedup.without_copies(spark, docs)


def remove_near_copies(spark, docs, sf_dir):
    return near_copies.without_near_copies(spark, docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed(spark, docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.digests(spark, docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("simhash_near_dedup", remove_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark, sf_dir):
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
