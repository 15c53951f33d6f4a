"""Sinks. All of them are distributed writes; the committer's marker makes them atomic."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.constants import JOB


def write_windows(windows: DataFrame, path: str) -> None:
    windows.write.mode("overwrite").partitionBy("fold_id").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Score shards per job; only the jobs present in ``scores`` are replaced. A job has as
    many files as its size asks for."""
    (
        scores.hint("rebalance", *[F.col(c) for c in JOB])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*JOB)
        .parquet(path)
    )


def write_metric_table(tables, path: str) -> None:
    """Tables with different columns as one CSV, blank where a column is missing."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    merged.write.mode("overwrite").csv(path, header=True)


def write_statistics(participants, aggregates, pairs, path: str) -> DataFrame:
    """Three tables and a manifest row: PASS when every method has an aggregate."""
    participants.write.mode("overwrite").parquet(f"{path}/participants")
    aggregates.write.mode("overwrite").parquet(f"{path}/aggregates")
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    read = participants.sparkSession.read
    methods = read.parquet(f"{path}/participants").select("model_id", "recipe").distinct()
    done = read.parquet(f"{path}/aggregates").select("model_id", "recipe").distinct()
    manifest = methods.join(done.withColumn("_done", F.lit(True)), ["model_id", "recipe"], "left").agg(
        F.count(F.lit(1)).alias("methods"),
        F.count("_done").alias("complete_methods"),
        F.when(F.count("_done") == F.count(F.lit(1)), "PASS").otherwise("PARTIAL").alias("status"),
    )
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return read.schema("methods long, complete_methods long, status string").json(f"{path}/manifest")


def append_events(events: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log."""
    events.write.mode("append").json(path)


def write_fold_proposal(assignments: DataFrame, version: str, path: str) -> None:
    ordered = assignments.select(
        F.lit(version).alias("split_version"), "dataset_id", "participant_id", "fold_id"
    ).orderBy("dataset_id", "participant_id")
    ordered.write.mode("overwrite").csv(path, header=True)


def write_manifest(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").json(path)
