"""Streams out of order: nothing within the delay is lost, what is later is counted."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.constants import CHANNELS
from motionframe.sources import store
from motionframe.streaming import processors

SAMPLES = "recording_id string, sample_idx long, " + ", ".join(f"{c} double" for c in CHANNELS)


@pytest.fixture
def root(spark):
    return store.shared_root(spark) + f"/test-{uuid.uuid4().hex}"


def written_in_turn(spark, parts, schema, path):
    """One file a part; the stream reads one a micro-batch, in this order."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def samples(n, seed=0):
    made = np.random.default_rng(seed).normal(size=(n, 6)).tolist()
    return [("r", i, *v) for i, v in enumerate(made)]


@pytest.mark.parametrize("order", [lambda r: [r[200:], r[:200]], lambda r: [r[i::3] for i in (2, 0, 1)], lambda r: [r, r[100:300]]])
def test_windows_of_parts_in_any_order(spark, root, order):
    stream = written_in_turn(spark, order(samples(400)), SAMPLES, f"{root}/in")
    rows = processors.run_to_table(spark, processors.window_scores(stream), root).collect()
    assert sorted(r.win for r in rows) == list(range(29))
    whole = np.array([s[2:] for s in samples(400)])
    for r in rows:
        part = whole[r.end_sample - 50 : r.end_sample]
        acc, gyr = np.sqrt((part[:, :3] ** 2).sum(1)), np.sqrt((part[:, 3:] ** 2).sum(1))
        assert abs(r.impact_score - (np.abs(acc - 9.80665).max() / 9.80665 + gyr.max() / (2 * np.pi))) < 1e-9


def test_windows_across_blocks_and_gaps(spark, root):
    rows = [s for s in samples(2500) if s[1] != 1700]
    stream = written_in_turn(spark, [rows[1000:], rows[:1000]], SAMPLES, f"{root}/in")
    found = {r.win for r in processors.run_to_table(spark, processors.window_scores(stream), root).collect()}
    starts = {k: int(np.floor(k * 12.5 + 0.5)) for k in range(197)}
    assert found == {k for k, s in starts.items() if s + 50 <= 2500 and not s <= 1700 < s + 50}


def test_late_rows_are_counted_and_state_ends(spark, root):
    still = lambda *idx: [("r", i, *([0.0] * 6)) for i in idx]
    parts = [samples(100), still(*range(20_000, 20_010)), still(20_010), still(100, 20_011)]  # Spark drops late rows one batch on
    stream = written_in_turn(spark, parts, SAMPLES, f"{root}/in")
    table, late = processors.run(spark, processors.window_scores(stream, delay="60 seconds"), root)
    assert table.count() == 5 and late.agg(F.sum("late_rows")).first()[0] == 1


def test_session_keeps_its_state_store(spark, root):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    processors.run_to_table(spark, processors.window_scores(written_in_turn(spark, [samples(60)], SAMPLES, f"{root}/in")), root)
    assert spark.conf.get(key, None) == before


def plain_alarms(rows, required, lookback, cooldown):
    fired, flags, last = [], [], None
    for decision, alert in sorted(rows):
        flags = (flags + [alert])[-lookback:]
        if len(flags) == lookback and sum(flags) >= required and (last is None or decision - last >= cooldown):
            last = decision
            fired.append(decision)
    return fired


def test_alarms_out_of_order(spark, root):
    rng = np.random.default_rng(4)
    rows = {k: [(int(12 * i + 49), bool(rng.random() < 0.4)) for i in range(300)] for k in "ab"}
    frame = spark.createDataFrame([(k, d, a) for k in rows for d, a in rows[k]], "recording_id string, decision long, alert boolean")
    frame = frame.withColumn("time", processors.sample_time(F.col("decision")))
    stream = processors.replayed(frame, root, batches=4, files=2)
    table = processors.run_to_table(spark, processors.alarm_stream(stream, 2, 3, 100), root).collect()
    for k in rows:
        assert sorted(r.decision for r in table if r.recording_id == k) == plain_alarms(rows[k], 2, 3, 100)


def test_alarms_carried_over_batches_equal_the_fold():
    rng = np.random.default_rng(9)
    for required, lookback, cooldown in ((1, 1, 0), (2, 3, 50), (3, 5, 200)):
        rows = [(int(d), bool(a)) for d, a in zip(np.cumsum(rng.integers(1, 40, 400)), rng.random(400) < 0.5)]
        fired, flags, last = [], [], None
        for part in np.array_split(np.arange(400), 9):
            decision, alert = np.array([rows[i][0] for i in part]), np.array([rows[i][1] for i in part])
            more, flags, last = processors.accepted_alarms(decision, alert, flags, last, required, lookback, cooldown)
            fired += more
        assert fired == plain_alarms(rows, required, lookback, cooldown)


def test_hours_go_out_when_passed_and_late_events_are_counted(spark, root):
    schema = "time timestamp, value double"
    from datetime import datetime

    at = lambda h, m: datetime(2024, 1, 1 + h // 24, h % 24, m)
    parts = [[(at(1, 5), 30.0), (at(1, 6), 1.0)], [(at(60, 0), 5.0)], [(at(60, 2), 5.0)], [(at(1, 7), 50.0), (at(60, 1), 30.0)], [(at(100, 0), 1.0)]]
    stream = written_in_turn(spark, parts, schema, f"{root}/in")
    table, late = processors.run(spark, processors.hourly_false_alarms(stream, "time", 20.0, "10 hours"), root)
    assert sorted((r.false_positives, r.windows) for r in table.collect()) == [(1, 2), (1, 3)]
    assert late.agg(F.sum("late_rows")).first()[0] == 1


def test_alarms_of_many_keys_share_a_state(spark, root, monkeypatch):
    """Few buckets hold many keys, null among them; each key has its own flags and cooldown, and calls are few."""
    monkeypatch.setattr(processors, "BUCKETS", 2)
    calls = spark.sparkContext.accumulator(0)
    gathered = processors._gathered
    monkeypatch.setattr(processors, "_gathered", lambda *a: calls.add(1) or gathered(*a))
    rng = np.random.default_rng(5)
    rows = {(j, f"r{k}" if k else None): [(int(12 * i + 49), bool(rng.random() < 0.4)) for i in range(30 + k)] for j in (1, 2) for k in range(20)}
    schema = "fold int, recording_id string, decision long, alert boolean"
    frame = spark.createDataFrame([(*k, d, a) for k in rows for d, a in rows[k]], schema)
    stream = processors.replayed(frame.withColumn("time", processors.sample_time(F.col("decision"))), root, batches=3, files=2)
    out = processors.alarm_stream(stream, 2, 3, 100, ["fold", "recording_id"])
    table = processors.run_to_table(spark, out, root).collect()
    for k in rows:
        assert sorted(r.decision for r in table if (r.fold, r.recording_id) == k) == plain_alarms(rows[k], 2, 3, 100)
    assert len(table) == sum(len(plain_alarms(r, 2, 3, 100)) for r in rows.values())
    assert 0 < calls.value <= 2 * 5


def test_alarm_flags_outlive_a_pause_and_end(spark, root):
    """Flags carry over batches whose rows have passed; a key that is silent for long starts anew."""
    at = lambda d, a: ("r", d, a)
    far = 25 * 3600 * 30  # thirty hours of samples on
    parts = [[at(0, True)], [("s", 4000, False)], [at(4010, True)], [("s", far, False)], [("s", far + 4000, False)], [("s", 3 * far, False)], [("s", 3 * far + 4000, False)]]
    parts += [[at(3 * far + 4001, True)], [("s", 5 * far, False)], [("s", 5 * far + 4000, False)]]
    path = f"{root}/in"
    for rows in parts:
        frame = spark.createDataFrame(rows, "recording_id string, decision long, alert boolean")
        frame.withColumn("time", processors.sample_time(F.col("decision"))).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = processors.run_to_table(spark, processors.alarm_stream(stream, 2, 2, 10, delay="10 seconds"), root)
    assert [(r.recording_id, r.decision) for r in table.collect()] == [("r", 4010)]


def test_window_state_gets_a_sample_as_one_column(spark, root):
    """Every column is converted anew for each recording and block of a micro-batch."""
    stream = processors.window_scores(written_in_turn(spark, [samples(60)], SAMPLES, f"{root}/in"))
    node = stream._jdf.queryExecution().analyzed()
    while "InPandasWithState" not in node.nodeName():
        node = node.children().head()
    names = {node.children().head().output().apply(k).name() for k in range(node.children().head().output().size())}
    assert names == {"recording_id", "block", "row", "time"}


def test_windows_whose_samples_come_one_by_one_in_any_order(spark, root):
    """The state of a block goes through many batches; repeated samples change nothing."""
    rows = samples(130)
    parts = [rows[k::3] + rows[:5] for k in (2, 0, 1)]
    stream = written_in_turn(spark, parts, SAMPLES, f"{root}/in")
    found = sorted((r.win, r.end_sample) for r in processors.run_to_table(spark, processors.window_scores(stream), root).collect())
    whole = written_in_turn(spark, [rows], SAMPLES, f"{root}/whole")
    want = sorted((r.win, r.end_sample) for r in processors.run_to_table(spark, processors.window_scores(whole), root).collect())
    assert found == want and len(want) > 3
