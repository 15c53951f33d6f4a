"""Roles, role sizes and participant statistics of the fold split."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.constants import FOLD_COUNT, SEQ, TEAM_FOLD


def assign_roles(windows: DataFrame, folds: int = FOLD_COUNT, team: bool = True) -> DataFrame:
    """Repeat each window once per test fold with its role there.

    Test is fold k, validation fold k+1, the rest trains; team data (-1) only trains.
    An expansion of the row by the fixed number of folds, not a join.
    """
    k = F.col("fold")
    role = (
        F.when(F.col("fold_id") == k, "test")
        .when(F.col("fold_id") == (k + 1) % folds, "validation")
        .otherwise("train")
    )
    rows = windows if team else windows.filter(F.col("fold_id") != TEAM_FOLD)
    every = F.array(*[F.lit(i) for i in range(folds)])
    return rows.withColumn("fold", F.explode(every)).withColumn("role", role)


def split_sizes(roles: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Windows and distinct sequences per fold and role, reduced per sequence first."""
    per_sequence = roles.groupBy("fold", "role", *seq).agg(F.count(F.lit(1)).alias("_w"))
    return per_sequence.groupBy("fold", "role").agg(
        F.sum("_w").alias("windows"), F.count(F.lit(1)).alias("sequences")
    )


def participant_stats(
    sequences: DataFrame, events: DataFrame, annotations: DataFrame, seq: Sequence[str] = SEQ
) -> DataFrame:
    """Per participant: sequences, fall sequences, events, daily-activity rows, locations."""
    falls = events.groupBy(*seq).agg(F.count(F.lit(1)).alias("_events"))
    joined = sequences.join(falls, list(seq), "left")
    return joined.groupBy("dataset_id", "participant_id").agg(
        F.count(F.lit(1)).alias("sequences"),
        F.count(F.when(F.col("is_fall"), 1)).alias("fall_sequences"),
        F.coalesce(F.sum("_events"), F.lit(0)).alias("events"),
        F.coalesce(F.sum(F.when(~F.col("is_fall"), F.col("n"))), F.lit(0)).alias("adl_rows"),
        F.sort_array(F.collect_set("body_location")).alias("body_locations"),
    )


def fold_summary(stats: DataFrame, assignments: DataFrame) -> DataFrame:
    """Load of each fold."""
    return (
        stats.join(assignments, ["dataset_id", "participant_id"])
        .groupBy("fold_id")
        .agg(
            F.count(F.lit(1)).alias("participants"),
            F.sum("fall_sequences").alias("fall_sequences"),
            F.sum("events").alias("events"),
            F.sum("adl_rows").alias("adl_rows"),
            F.count_distinct("dataset_id").alias("datasets"),
        )
    )
