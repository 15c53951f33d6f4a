"""Groups of their own in balanced draws, strict pairing, streams over folders, long gaps, published tables."""

import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from motionframe.operators import labels, resample, sampling
from motionframe.plans.model_queries import replayed_events
from motionframe.sources import store
from motionframe.streaming import processors


def test_balanced_draws_stay_in_their_group(spark):
    """Fold a holds windows 0 to 3 of a participant, fold b windows 10 to 12 of the same one."""
    rows = [("a", 0, w) for w in range(4)] + [("b", 0, w) for w in range(10, 13)]
    rows += [("a", 1, 100), ("b", 1, 200)]
    frame = spark.createDataFrame(rows, "fold string, label int, win int").select(
        "*", F.lit("d").alias("dataset_id"), F.lit("p").alias("participant_id"), F.lit("r").alias("recording_id")
    )
    drawn = sampling.balanced_sample(frame, ["fold"], seq=("recording_id",)).collect()
    own = {(f, y, w) for f, y, w in rows}
    assert len(drawn) == len(rows) and all((r.fold, r.label, r.win) in own for r in drawn)


def test_ambiguous_onset_fails(spark):
    notes = spark.createDataFrame(
        [("r", "activity", 5, 50, "F01"), ("r", "activity", 5, 60, "F01"), ("r", "onset", 5, 5, "F01"), ("r", "impact", 20, 20, "F01")],
        "recording_id string, kind string, start_sample long, stop_sample long, code string",
    )
    with pytest.raises(Exception, match="onset without exactly one activity and impact"):
        labels.pair_events(notes, ["recording_id"]).collect()
    assert labels.unpaired_points(notes, ["recording_id"]).count() > 0


def test_events_stream_from_a_folder(spark):
    root = store.shared_root(spark) + f"/test-{uuid.uuid4().hex}"
    rows = spark.range(1000).select("id", F.timestamp_seconds("id").alias("ts"))
    rows.repartition(7).write.parquet(f"{root}/events.parquet")
    tables = SimpleNamespace(spark=spark, root=root, read=lambda name: spark.read.parquet(f"{root}/{name}.parquet"))
    table = processors.run_to_table(spark, replayed_events(tables, "id"), root)
    assert table.filter("id is not null").count() == 1000


def test_long_gap_is_resampled_in_blocks(spark):
    """A day without samples at 25 Hz: two million grid points between two samples."""
    series = spark.createDataFrame([("u", 0.0, 0.0), ("u", 86_400.0, 86_400.0)], "u string, t double, v double")
    made = resample.resample(series, ["u"], ["v"], 25.0, F.lit(0))
    n, worst = made.agg(F.count("*"), F.max(F.abs(F.col("v") - F.col("rel")))).first()
    assert n == 86_400 * 25 + 1 and worst < 1e-6


def test_a_finished_table_is_not_replaced(spark):
    root = store.shared_root(spark) + f"/test-{uuid.uuid4().hex}"
    first = store.stored(spark, root, "t", lambda: spark.range(3))
    spark.range(9).write.parquet(f"{root}/other")
    store.publish(spark, f"{root}/other", f"{root}/t")
    assert first.count() == 3 and spark.read.parquet(f"{root}/t").count() == 3
    assert not store.exists(spark, f"{root}/other")
