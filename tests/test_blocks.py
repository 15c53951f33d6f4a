"""Work cut into blocks gives what the whole gives, and nothing large is broadcast or sorted for it."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from motionframe.operators import custom, features, statistics
from motionframe.sources import readers


def test_draws_are_not_broadcast(spark, monkeypatch):
    rows = [("u", side, "d", f"p{p:02d}", seed, p * 3 + seed, 1, p % 2, 2, 1, 1, 0.5, p) for side in "ab" for p in range(11) for seed in (1, 2)]
    schema = "unit string, side string, dataset_id string, participant_id string, seed int, " + ", ".join(
        f"{c} {'double' if 'hours' in c else 'long'}" for c in statistics.COUNTS
    )
    cells = spark.createDataFrame(rows, schema)
    whole = statistics.resampled(cells, 30)
    plan = whole._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    assert "draw" not in "".join(line for line in plan.split("\n") if "Broadcast" in line)
    want = {(r.side, r.rep): tuple(r) for r in whole.collect()}
    assert len(want) == 60
    monkeypatch.setattr(statistics, "PEOPLE_CHUNK", 4)
    monkeypatch.setattr(statistics, "REPLICATE_BLOCK", 7)
    cut = {(r.side, r.rep): tuple(r) for r in statistics.resampled(cells, 30).collect()}
    assert cut == want


def test_windows_are_cut_out_of_blocks(spark):
    gone, twice = {5000}, {120, 3190}
    values = [("r", i, *[float(i * k % 17) for k in range(1, 7)]) for i in range(7001) if i not in gone]
    values += [v for v in values if v[1] in twice]
    samples = spark.createDataFrame(values, "recording_id string, sample_idx int, ax double, ay double, az double, gx double, gy double, gz double")
    table = features.gathered_windows(samples, ["recording_id"])
    plan = table._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("ObjectHashAggregate")  # gathered first, cut afterwards
    got = {r["win"]: r["signals"] for r in table.collect()}
    starts = {k: int(np.floor(k * 12.5 + 0.5)) for k in range(600)}
    bad = gone | twice
    assert set(got) == {k for k, s in starts.items() if s + 50 <= 7001 and not bad & set(range(s, s + 50))}
    for k in (0, 255, 256, 300, 555):
        if k in got:
            assert got[k][1] == [float(i * 2 % 17) for i in range(starts[k], starts[k] + 50)]


def test_short_recordings_share_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(0)
        rows = [(None if r == 3 else f"r{r}", n, p, p * 12 + 50, float(rng.random())) for r in range(40) for n in [int(rng.integers(1, 30))] for p in range(n)]
        frame = pd.DataFrame(rows, columns=["recording_id", "n", "pos", "end_sample", "score"])
        scores = spark.createDataFrame(rows, "recording_id string, n int, pos int, end_sample int, score double").withColumn("threshold", F.lit(0.5))
        table = custom.custom_triggers(scores, lambda a: np.cumsum(a) % 3 == 1, 3, "rule", 10, [], ["recording_id"])
        assert "FlatMapGroupsInPandas" not in table._jdf.queryExecution().sparkPlan().toString()
        got = sorted((str(r["recording_id"]), r["decision"]) for r in table.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for name, part in frame.groupby("recording_id", dropna=False):
        hits = np.cumsum(part["score"].to_numpy() >= 0.5) % 3 == 1
        want += [(str(None) if pd.isna(name) else name, int(d)) for d in part["end_sample"][hits] - 1]
    assert got == sorted(want)


def test_digests_of_files_in_blocks_are_those_of_their_bytes(spark, tmp_path, monkeypatch):
    """Files beyond the limit are read in splits and hashed in order, whatever bytes they hold and end with."""
    noise = np.random.default_rng(8).integers(0, 256, 300_000).astype(np.uint8).tobytes()
    held = {
        "noise": noise, "ended": noise[:90_000] + b"\n", "feeds": b"\n" * 5_000, "zeros": bytes(40_000), "returns": b"a\r\nb\r" * 2_000,
        "mark": b"\xef\xbb\xbf" + noise[:50_000], "marked": b"\xef\xbb\xbf\n" + noise[:50_000] + b"\n", "small": b"\nfew\n",
    }
    (tmp_path / "in").mkdir()
    for name, data in held.items():
        (tmp_path / ("in" if name == "ended" else ".") / f"{name}.parquet").write_bytes(data)
    monkeypatch.setattr(readers, "WHOLE_BYTES", 1_000)
    monkeypatch.setattr(readers, "BLOCK_BYTES", 7_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    try:
        rows = readers.file_inventory(spark, str(tmp_path), "*.parquet").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, rows)) == sorted((f"{n}.parquet", len(d), hashlib.sha256(d).hexdigest()) for n, d in held.items())


def test_a_file_beyond_what_one_value_holds_has_a_digest(spark, tmp_path):
    """``binaryFile`` takes none beyond its limit, which is lowered here."""
    data = bytes(range(256)) * 4_000
    (tmp_path / "large.parquet").write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1_000)
    held, readers.WHOLE_BYTES = getattr(readers, "WHOLE_BYTES", None), 1_000
    try:
        rows = readers.file_inventory(spark, str(tmp_path)).collect()
    finally:
        readers.WHOLE_BYTES = held
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert list(map(tuple, rows)) == [("large.parquet", len(data), hashlib.sha256(data).hexdigest())]
