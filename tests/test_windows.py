"""Start grid, labels, event pairing: literal expectations."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionframe.operators import features, labels, windows


def grid_of(spark, sizes):
    rows = spark.createDataFrame([(f"r{i}", n) for i, n in enumerate(sizes)], "recording_id string, n long")
    return windows.start_grid(rows).orderBy("recording_id", "win").collect()


def test_half_up_start_grid(spark):
    starts = [r.start_sample for r in grid_of(spark, [150])]
    assert starts == [0, 13, 25, 38, 50, 63, 75, 88, 100]


def test_short_sequence_has_no_window(spark):
    assert grid_of(spark, [49]) == []


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=3, max_size=6))
def test_grid_matches_definition(spark, sizes):
    rows = grid_of(spark, sizes)
    for i, n in enumerate(sizes):
        want = [int(np.floor(k * 12.5 + 0.5)) for k in range(n) if np.floor(k * 12.5 + 0.5) <= n - 50]
        assert [r.start_sample for r in rows if r.recording_id == f"r{i}"] == want


def test_decision_time_labels_and_tail(spark):
    starts = [0, 13, 25, 38, 50, 63]
    grid = spark.createDataFrame(
        [("r", i, s, s + 50, "temporal", True) for i, s in enumerate(starts)],
        "recording_id string, win int, start_sample int, end_sample int, supervision_kind string, is_fall boolean",
    )
    notes = spark.createDataFrame(
        [("r", "activity", 0, 55, "ADL"), ("r", "activity", 55, 91, "F01"), ("r", "onset", 55, 55, "F01"),
         ("r", "impact", 80, 80, "F01"), ("r", "activity", 91, 140, "ADL")],
        "recording_id string, kind string, start_sample long, stop_sample long, code string",
    )
    events = labels.pair_events(notes)
    assert [tuple(r) for r in events.collect()] == [("r", 55, 80, 91, "F01")]
    rows = labels.label_windows(labels.mark_windows(grid, events, notes)).orderBy("win").collect()
    assert [r.temporal_label for r in rows] == [0, 1, 1, 1, 0, 0]
    assert [r.kept for r in rows] == [True, True, True, True, False, False]


def test_unpaired_points_are_reported(spark):
    notes = spark.createDataFrame(
        [("r", "onset", 10, 10, "F01"), ("r", "impact", 20, 20, "F02")],
        "recording_id string, kind string, start_sample long, stop_sample long, code string",
    )
    rules = {r.rule_id for r in labels.unpaired_points(notes).collect()}
    assert rules == {"onset_unpaired", "impact_unpaired"}


def sample_frame(spark, values):
    rows = [("r", i, *map(float, v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "recording_id string, sample_idx int, ax double, ay double, az double, gx double, gy double, gz double")


def test_stationary_window_scores_zero_and_impact_scores_more(spark):
    still = np.tile([0, 0, 9.80665, 0, 0, 0], (50, 1))
    moved = still.copy()
    moved[25, 0] = 30.0
    score = lambda v: windows.impact_scores(sample_frame(spark, v)).first().impact_score
    assert score(still) == 0.0
    assert score(moved) > 1.0


def test_features_are_complete_and_match_numpy(spark):
    values = (np.arange(300).reshape(50, 6) - 150) / 37
    frame = sample_frame(spark, values)
    row = features.feature_vectors(frame).first()
    assert len(row.features) == 158 and np.isfinite(row.features).all()
    again = features.feature_vectors(frame).first()
    assert row.features == again.features
    table = features.feature_table(frame).first().asDict()
    assert np.isclose(table["acceleration_x_mps2__std"], values[:, 0].std())
    assert np.isclose(table["angular_velocity_z_rad_s__iqr"], np.subtract(*np.percentile(values[:, 5], [75, 25])))
    jerk = np.linalg.norm(np.diff(values[:, :3], axis=0) * 25, axis=1)
    assert np.isclose(table["acceleration_jerk_norm__rms"], np.sqrt((jerk**2).mean()))
    taper = np.hanning(50)
    power = np.abs(np.fft.rfft((values[:, 0] - values[:, 0].mean()) * taper)) ** 2
    assert np.isclose(table["acceleration_x_mps2__spectral_centroid_hz"], (power * np.fft.rfftfreq(50, 0.04)).sum() / power.sum())


def test_constant_signals_have_defined_shape_statistics(spark):
    table = features.feature_table(sample_frame(spark, np.ones((50, 6)))).first().asDict()
    assert table["acceleration_x_mps2__skewness"] == 0.0
    assert table["acceleration_x_mps2__excess_kurtosis"] == -3.0
    assert table["acceleration_xy_correlation"] == 0.0


def test_staged_and_aggregated_features_agree(tables):
    wide = features.feature_table(tables.samples)
    stats = features.time_features(tables.samples)
    names = [n for n in stats.columns if "__" in n]
    far = [(F.abs(F.col(f"a.{n}") - F.col(f"b.{n}")) > 1e-8) for n in names]
    any_far = far[0]
    for f in far[1:]:
        any_far = any_far | f
    joined = wide.alias("a").join(stats.alias("b"), ["recording_id", "win"])
    assert joined.count() == stats.count() > 300
    assert joined.filter(any_far).count() == 0
