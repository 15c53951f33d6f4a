"""Online windowing, alarms and resampling that lose no row within the allowed delay.

Rows may arrive in any order. A window needs no order: it goes out when the last of its samples
arrives. Alarms and resampling do: their rows wait in state until the watermark has passed them
and are then taken in order of event time. Rows behind the watermark are dropped by Spark and counted
by batch in a table of their own. State goes when the watermark says that nothing more can come.

Windows are keyed by recording and block of starts, as in the batch plan, so a long recording is
many small states; a sample beside a block's edge goes to both.
"""

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motionframe.constants import CHANNELS, GRAVITY, SAMPLING_RATE_HZ, STRIDE_SECONDS, WINDOW_LENGTH

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Samples whose windows share a state.
SPAN = 800
#: States over which the keys of the alarm stream are dealt.
BUCKETS = 1024
#: How far behind the latest row of the stream a row may come.
DELAY = "2 hours"
#: Event time after which a silent key is forgotten.
FORGET_MS = 86_400_000
#: Event time of sample 0: 2000-01-01.
ORIGIN_MS = 946_684_800_000
#: Event time of the last row of a replay: it moves the watermark past everything.
END = "2200-01-01"


def sample_time(sample):
    """Event time of a sample number. A recording starts at ``ORIGIN_MS``, not at zero, where the
    watermark of a new stream stands."""
    return F.timestamp_micros((sample * int(round(1e6 / SAMPLING_RATE_HZ)) + ORIGIN_MS * 1000).cast("long"))


def _gathered(frames: Iterator[pd.DataFrame], columns: Sequence[str]) -> pd.DataFrame:
    return pd.concat([f[list(columns)] for f in frames], ignore_index=True)


# -- windows ------------------------------------------------------------------


def window_scores(samples: DataFrame, cadence_s: float | None = None, delay: str = DELAY) -> DataFrame:
    """Emit each causal window with its rule score when the last of its samples has arrived.

    A window with a missing sample never goes out. With ``cadence_s`` only windows starting on
    that coarser schedule do. Of repeated samples the first to arrive counts.
    """
    step = STRIDE_SECONDS * SAMPLING_RATE_HZ
    every = 1 if cadence_s is None else int(round(cadence_s * SAMPLING_RATE_HZ))
    names = ["sample_idx", *CHANNELS]
    reach = SPAN + WINDOW_LENGTH - 1
    to_ms = 1000 / SAMPLING_RATE_HZ

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        base = key[1] * SPAN
        rows = np.concatenate([row for f in frames for row in f["row"]]).reshape(-1, len(names))
        rows = rows[np.lexsort(rows.T[::-1])]
        values, there = np.zeros((reach, len(CHANNELS))), np.zeros(reach, dtype=bool)
        if state.exists:
            held, flat = state.get
            held = np.frombuffer(held, dtype=np.int32)
            there[held] = True
            values[held] = np.frombuffer(flat).reshape(-1, len(CHANNELS))
        place = rows[:, 0].astype(np.int64) - base
        keep = ~there[place] & np.concatenate(([True], np.diff(place) > 0))
        place = place[keep]
        fresh = np.zeros(reach, dtype=bool)
        fresh[place] = there[place] = True
        values[place] = rows[keep, 1:]
        have = np.flatnonzero(there)
        state.update((have.astype(np.int32).tobytes(), values[have].tobytes()))
        state.setTimeoutTimestamp(max(ORIGIN_MS + int((base + reach) * to_ms), state.getCurrentWatermarkMs() + 1))
        if len(have) < WINDOW_LENGTH:
            return

        first = int(np.ceil((base - 0.5) / step))
        k = np.arange(max(0, first), int(np.floor((base + SPAN) / step)) + 1)
        starts = np.floor(k * step + 0.5).astype(np.int64) - base
        inside = (starts >= 0) & (starts < SPAN) & ((starts + base) % every == 0)
        k, starts = k[inside], starts[inside]
        sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        within = lambda total: total[starts + WINDOW_LENGTH] - total[starts]
        ready = (within(sums(there)) == WINDOW_LENGTH) & (within(sums(fresh)) > 0)
        if ready.any():
            k, starts = k[ready], starts[ready]
            acc = np.abs(np.sqrt((values[:, :3] ** 2).sum(axis=1)) - GRAVITY)
            gyr = np.sqrt((values[:, 3:6] ** 2).sum(axis=1))
            at = starts[:, None] + np.arange(WINDOW_LENGTH)[None, :]
            score = acc[at].max(axis=1) / GRAVITY + gyr[at].max(axis=1) / (2 * np.pi)
            yield pd.DataFrame({"recording_id": key[0], "win": k, "end_sample": starts + base + WINDOW_LENGTH, "impact_score": score})

    block = F.floor(F.col("sample_idx") / SPAN).cast("long")
    beside = (F.col("sample_idx") % SPAN < WINDOW_LENGTH - 1) & (block > 0)
    blocks = F.when(beside, F.array(block, block - 1)).otherwise(F.array(block))
    # A sample is one column: each column is converted anew for every call.
    row = F.array(*[F.col(c).cast("double") for c in names]).alias("row")
    time = sample_time(F.col("sample_idx")).alias("time")
    timed = samples.select("recording_id", F.explode(blocks).alias("block"), row, time).withWatermark("time", delay)
    return timed.groupBy("recording_id", "block").applyInPandasWithState(
        run,
        "recording_id string, win long, end_sample long, impact_score double",
        "held binary, channels binary",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


# -- alarms -------------------------------------------------------------------


def accepted_alarms(decisions, alerts, flags, last_alarm, required, lookback, cooldown):
    """Alarms among ordered decisions after the carried ``flags`` and ``last_alarm``, and both for
    what follows. Counts of the look-back are running sums; the cooldown jumps from alarm to alarm."""
    whole = np.concatenate((np.asarray(flags, dtype=np.int64), np.asarray(alerts, dtype=np.int64)))
    total = np.concatenate(([0], np.cumsum(whole)))
    upto = len(flags) + np.arange(1, len(decisions) + 1)
    ready = (upto >= lookback) & (total[upto] - total[np.maximum(upto - lookback, 0)] >= required)
    candidates, fired = decisions[ready], []
    at = 0 if last_alarm is None else int(np.searchsorted(candidates, last_alarm + cooldown))
    while at < len(candidates):
        last_alarm = int(candidates[at])
        fired.append(last_alarm)
        at = max(at + 1, int(np.searchsorted(candidates, last_alarm + cooldown)))
    return fired, whole[-lookback:].astype(bool).tolist(), last_alarm


def _wait(state: GroupState, times) -> None:
    """Come back when the watermark has passed the first waiting row, or to forget a silent key."""
    mark = state.getCurrentWatermarkMs()
    due = int(min(times)) if len(times) else mark + FORGET_MS
    state.setTimeoutTimestamp(max(due, mark + 1))


def _unit_numbers(known: pd.DataFrame | None, rows: pd.DataFrame, keys: Sequence[str]):
    """Keys of all units, those in ``known`` first, and the unit of each row; null is a key like any other."""
    both = rows[list(keys)] if known is None else pd.concat([known, rows[list(keys)]], ignore_index=True)
    numbers = both.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
    _, first = np.unique(numbers, return_index=True)
    return both.iloc[first].reset_index(drop=True), numbers[0 if known is None else len(known) :]


def alarm_stream(scores: DataFrame, required: int, lookback: int, cooldown: int, keys: Sequence[str] = ("recording_id",), delay: str = DELAY) -> DataFrame:
    """N-of-M alarms with cooldown; the flag history goes on during the cooldown.

    ``scores`` holds ``keys``, decision, alert and time (the event time of the decision). Of
    repeated decisions an alert counts. Keys are dealt by hash over ``BUCKETS`` states, so that a call of
    Python and a state serve many short recordings; a key's flags and last alarm stay its own.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in scores.schema.fields}

    def run(_, frames, state: GroupState):
        mark = state.getCurrentWatermarkMs()
        rows = None if state.hasTimedOut else _gathered(frames, [*keys, "decision", "alert", "ms"]).dropna(subset=["decision", "alert", "ms"])
        known, due, last, flags = None, [], [], []
        unit = np.zeros(0, dtype=np.int64)
        decision, alert, ms = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
        if state.exists:
            *columns, due, last, flags, sizes, decision, alert, ms = state.get
            due, last, flags = list(due), list(last), [list(f) for f in flags]
            known = pd.DataFrame(dict(zip(keys, columns)))
            unit = np.repeat(np.arange(len(sizes)), np.asarray(sizes, dtype=np.int64))
            decision, ms = (np.frombuffer(bytes(v), dtype=np.int64) for v in (decision, ms))
            alert = np.frombuffer(bytes(alert), dtype=bool)
        active = np.zeros(len(due), dtype=bool)
        if rows is not None and len(rows):
            known, fresh = _unit_numbers(known, rows, keys)
            more = len(known) - len(due)
            due, last, flags = due + [0] * more, last + [None] * more, flags + [[] for _ in range(more)]
            active = np.zeros(len(due), dtype=bool)
            active[fresh] = True
            unit = np.concatenate((unit, fresh))
            decision = np.concatenate((decision, rows["decision"].to_numpy(dtype=np.int64)))
            alert = np.concatenate((alert, rows["alert"].to_numpy(dtype=bool)))
            ms = np.concatenate((ms, rows["ms"].to_numpy(dtype=np.int64)))
        if known is None or not len(known):
            if state.exists:
                state.remove()
            return

        order = np.lexsort((~alert, decision, unit))
        unit, decision, alert, ms = unit[order], decision[order], alert[order], ms[order]
        once = np.ones(len(unit), dtype=bool)
        once[1:] = (np.diff(unit) > 0) | (np.diff(decision) > 0)
        unit, decision, alert, ms = unit[once], decision[once], alert[once], ms[once]
        waits = ms > mark
        for u in np.unique(unit[~waits]):
            own = slice(np.searchsorted(unit, u), np.searchsorted(unit, u, side="right"))
            cut = own.start + int(np.searchsorted(ms[own], mark, side="right"))
            waits[own.start : cut], waits[cut : own.stop] = False, True
        passed = np.flatnonzero(~waits)
        found_unit, found = [], []
        for part in np.split(passed, np.flatnonzero(np.diff(unit[passed])) + 1) if len(passed) else []:
            u = int(unit[part[0]])
            active[u] = True
            fired, flags[u], last[u] = accepted_alarms(decision[part], alert[part], flags[u], last[u], required, lookback, cooldown)
            found_unit += [u] * len(fired)
            found += fired
        if found:
            yield known.iloc[found_unit].reset_index(drop=True).assign(decision=found)

        unit, decision, alert, ms = unit[waits], decision[waits], alert[waits], ms[waits]
        sizes = np.bincount(unit, minlength=len(known))
        due = np.where(active, mark + FORGET_MS, np.asarray(due, dtype=np.int64))  # when a silent key is forgotten
        stays = (sizes > 0) | (due > mark)
        if not stays.any():
            if state.exists:
                state.remove()
            return
        stay = np.flatnonzero(stays)
        state.update((
            *[[None if v is None or v != v else v for v in known[c].iloc[stay].tolist()] for c in keys],
            due[stay].tolist(), [last[u] for u in stay], [flags[u] for u in stay], sizes[stay].tolist(),
            decision.tobytes(), alert.tobytes(), ms.tobytes(),
        ))
        next_due = min([*due[stay[sizes[stay] == 0]].tolist(), *([int(ms.min())] if len(ms) else [])])
        state.setTimeoutTimestamp(max(int(next_due), mark + 1))

    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    timed = scores.withColumn("ms", F.unix_millis("time")).withWatermark("time", delay).withColumn("_bucket", bucket)
    held = ", ".join(f"key_{k} array<{types[c]}>" for k, c in enumerate(keys))
    return timed.groupBy("_bucket").applyInPandasWithState(
        run,
        ", ".join(f"{k} {types[k]}" for k in keys) + ", decision long",
        f"{held}, due array<long>, last_alarm array<long>, flags array<array<boolean>>, sizes array<int>, decision binary, alert binary, ms binary",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


# -- resampling ---------------------------------------------------------------


def resample_stream(series: DataFrame, rate_hz: float, delay: str = DELAY) -> DataFrame:
    """Grid points between the previous and the current sample, once the watermark passed both.

    ``series`` holds (user_id, t, value, time). Of samples at one time that of the least value counts.
    """

    def run(key, frames, state: GroupState):
        waiting, values, times, t0, last_t, last_value = state.get if state.exists else ([], [], [], None, None, None)
        mark = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            if not len(waiting):
                state.remove()
                return
            rows = pd.DataFrame({"t": [], "value": [], "ms": []})
        else:
            rows = _gathered(frames, ["t", "value", "ms"]).dropna()
        t = np.concatenate((np.asarray(waiting, dtype=np.float64), rows["t"].to_numpy(dtype=np.float64)))
        value = np.concatenate((np.asarray(values, dtype=np.float64), rows["value"].to_numpy(dtype=np.float64)))
        ms = np.concatenate((np.asarray(times, dtype=np.int64), rows["ms"].to_numpy(dtype=np.int64)))
        order = np.lexsort((value, t))
        order = order[np.concatenate(([True], np.diff(t[order]) > 0))[: len(order)]]
        t, value, ms = t[order], value[order], ms[order]
        passed = int(np.searchsorted(ms, mark, side="right"))
        now_t, now_value = t[:passed], value[:passed]
        if last_t is not None:
            now_t, now_value = np.concatenate(([last_t], now_t)), np.concatenate(([last_value], now_value))
        out = None
        if passed:
            t0 = float(now_t[0]) if t0 is None else t0
            rel = now_t - t0
            last_t, last_value = float(now_t[-1]), float(now_value[-1])
            k = np.arange(int(np.floor(rel[0] * rate_hz)), int(np.ceil(rel[-1] * rate_hz)) + 1)
            grid = k / rate_hz
            inside = (grid >= rel[0]) & (grid < rel[-1])
            out = pd.DataFrame({"user_id": key[0], "k": k[inside], "rel": grid[inside], "value": np.interp(grid[inside], rel, now_value)})
        rest = slice(passed, None)
        state.update((t[rest].tolist(), value[rest].tolist(), ms[rest].tolist(), t0, last_t, last_value))
        _wait(state, ms[rest])
        if out is not None and len(out):
            yield out

    timed = series.withColumn("ms", F.unix_millis("time")).withWatermark("time", delay)
    return timed.groupBy("user_id").applyInPandasWithState(
        run,
        "user_id long, k long, rel double, value double",
        "waiting array<double>, held array<double>, times array<long>, t0 double, last_t double, last_value double",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


# -- built-in stateful operators ----------------------------------------------


def distinct_within_watermark(events: DataFrame, time: str, key: str, delay: str = "2 days") -> DataFrame:
    """Drop repeated deliveries of a row that arrive within the allowed delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def hourly_false_alarms(events: DataFrame, time: str, threshold: float, delay: str = "2 days") -> DataFrame:
    """Alerts, rows and rate per event-time hour; an hour goes out when the watermark has passed it."""
    alert = F.col("value") >= threshold
    table = events.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("hour")).agg(
        F.count(F.when(alert, 1)).alias("false_positives"), F.count("value").alias("windows")
    )
    rate = F.col("false_positives") / F.col("windows")
    return table.select(F.col("hour.start").alias("hour"), "false_positives", "windows", rate.alias("rate"))


# -- running a stream to its end ----------------------------------------------


def replayed(frame: DataFrame, root: str, time: str = "time", batches: int = 3, files: int = 4) -> DataFrame:
    """``frame`` as a stream of so many micro-batches out of order, each of ``files`` files at most.

    Rows are dealt by hash, so every key has rows of any time in any batch. A last row of nulls at
    ``END`` moves the watermark past all others; operators take it for no row of theirs."""
    spark, path = frame.sparkSession, f"{root}/streams/{uuid.uuid4().hex}/input"
    dealt = frame.withColumn("_batch", F.pmod(F.xxhash64(*frame.columns), F.lit(batches)))
    for k in range(batches):
        dealt.filter(F.col("_batch") == k).drop("_batch").repartition(files).write.mode("append").parquet(path)
    types = {f.name: f.dataType for f in frame.schema.fields}
    last = [F.lit(END if c == time else None).cast(types[c]).alias(c) for c in frame.columns]
    spark.range(1).select(*last).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


LATE = "batch long, operator int, late_rows long"


def run(spark: SparkSession, stream: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Drive a stream over all available input into a Parquet table; gives it and the table of late
    rows (batch, operator, late_rows: rows that came behind the watermark of a stateful operator).

    The state store of the session is as before afterwards, and the stream's own state is removed."""
    path = f"{root}/streams/{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if before is None or before.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB)
    late = {}
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        query = writer.outputMode("append").format("parquet").option("path", f"{path}/table").start()
        done = False
        while not done:  # progress is kept for the last batches only, so it is read on the way
            done = query.awaitTermination(1)
            for progress in query.recentProgress:
                for k, operator in enumerate(progress["stateOperators"]):
                    late[progress["batchId"], k] = int(operator["numRowsDroppedByWatermark"])
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    _removed(spark, f"{path}/checkpoint")
    rows = [(batch, k, n) for (batch, k), n in sorted(late.items())]
    spark.createDataFrame(rows, LATE).coalesce(1).write.parquet(f"{path}/late")
    return spark.read.schema(stream.schema).parquet(f"{path}/table"), spark.read.schema(LATE).parquet(f"{path}/late")


def run_to_table(spark: SparkSession, stream: DataFrame, root: str) -> DataFrame:
    return run(spark, stream, root)[0]
