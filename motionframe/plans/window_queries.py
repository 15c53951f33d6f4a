"""Windows, labels and projections."""

from pyspark.sql import functions as F

from motionframe.operators import labels, windows
from motionframe.plans.registry import query
from motionframe.plans.sql import ctes


@query(
    "win_01_start_grid",
    ctes("grid") + "SELECT recording_id, win::BIGINT AS win, start_sample::BIGINT AS start_sample, end_sample::BIGINT AS end_sample FROM grid",
)
def win_01(t):
    return windows.start_grid(t.sequences).select(
        "recording_id", *[F.col(c).cast("long").alias(c) for c in ("win", "start_sample", "end_sample")]
    )


@query(
    "prj_06_impact_rule",
    ctes("impact") + "SELECT recording_id, win::BIGINT AS win, round(impact_score, 6) AS impact_score FROM impact",
)
def prj_06(t):
    return t.impact.select("recording_id", F.col("win").cast("long").alias("win"), F.round("impact_score", 6).alias("impact_score"))


@query(
    "win_03_decision_labels",
    ctes("marked") + """SELECT recording_id, win::BIGINT AS win, temporal_label::BIGINT AS temporal_label, bag_label::BIGINT AS bag_label,
      drop_excluded, drop_post, kept FROM marked""",
)
def win_03(t):
    return t.marked.select(
        "recording_id",
        *[F.col(c).cast("long").alias(c) for c in ("win", "temporal_label", "bag_label")],
        "drop_excluded", "drop_post", "kept",
    )


@query(
    "snk_02_score_rows",
    ctes("scores") + """SELECT model_id, recipe, fold::BIGINT AS fold, seed::BIGINT AS seed, split, recording_id, win::BIGINT AS win,
      pos::BIGINT AS pos, label::BIGINT AS label, score FROM scores""",
)
def snk_02(t):
    return t.job_scores().select(
        "model_id", "recipe", "split", "recording_id",
        *[F.col(c).cast("long").alias(c) for c in ("fold", "seed", "win", "pos", "label")], "score",
    )
