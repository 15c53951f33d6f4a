"""Places where users plug in their own Python: scorers and alarm rules."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from motionframe.constants import JOB, SEQ
from motionframe.operators.alarms import POSITION_BLOCK
from motionframe.operators.metrics import with_decision


def score_with(rows: DataFrame, scorer: Callable[[pd.DataFrame], np.ndarray], keys: Sequence[str]) -> DataFrame:
    """Apply a batch scorer; its output must be one value inside [0, 1] per row."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = np.asarray(scorer(frame), dtype=np.float64)
            if scores.shape != (len(frame),) or not np.isfinite(scores).all():
                raise ValueError("scorer must return one finite value per row")
            if ((scores < -1e-6) | (scores > 1.0 + 1e-6)).any():
                raise ValueError("scorer returned a value outside [0, 1]")
            yield frame[list(keys)].assign(score=np.clip(scores, 0.0, 1.0))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.mapInPandas(batches, f"{fields}, score double")


def custom_triggers(
    scores: DataFrame,
    rule: Callable[[np.ndarray], np.ndarray],
    lookback: int,
    name: str,
    cooldown: int,
    by: Sequence[str] = JOB,
    seq: Sequence[str] = SEQ,
) -> DataFrame:
    """Triggers of a user's rule over ordered alert flags.

    The rule sees a block of at most POSITION_BLOCK windows preceded by the
    ``lookback - 1`` windows before it, and returns one boolean per window. Blocks lie one after
    another in sorted partitions and are cut out of the batches, so short recordings cost little.
    """
    block = F.floor(F.col("pos") / POSITION_BLOCK)
    edge = F.col("pos") % POSITION_BLOCK >= POSITION_BLOCK - (lookback - 1)
    alert = F.col("score") >= F.col("threshold")
    keys = [*by, *seq, "n"]
    rows = with_decision(scores).select(
        *keys, "pos", "decision", alert.alias("alert"),
        F.explode(F.when(edge, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"),
    )

    group = [*keys, "block"]

    def fired(whole: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        alerts, ends = whole["alert"].to_numpy(dtype=bool), np.append(starts[1:], len(whole))
        hits = np.concatenate([np.asarray(rule(alerts[i:j]), dtype=bool) for i, j in zip(starts, ends)])
        own = (whole["pos"] // POSITION_BLOCK == whole["block"]).to_numpy()
        return whole.loc[hits & own, [*keys, "decision"]]

    def fire(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            here, before = frame[group], frame[group].shift()
            changed = ((here != before) & ~(here.isna() & before.isna())).any(axis=1).to_numpy()
            changed[0] = True
            starts = np.flatnonzero(changed)
            if len(starts) > 1:
                yield fired(frame.iloc[: starts[-1]], starts[:-1])
            rest = frame.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None:
            yield fired(rest, np.zeros(1, dtype=int))

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "decision"))
    fired_rows = rows.repartition(*group).sortWithinPartitions(*group, "pos").mapInPandas(fire, schema)
    return fired_rows.withColumns({"policy": F.lit(name), "cooldown": F.lit(cooldown)})


def start_grid_function():
    """Table function (n, length, rate, stride) -> (win, start_sample) for lateral joins."""

    class StartGrid:
        def eval(self, n: int, length: int, rate: float, stride: float):
            k, last = 0, n - length
            while last >= 0:
                start = int(np.floor(k * stride * rate + 0.5))
                if start > last:
                    break
                yield k, start
                k += 1

    return udtf(StartGrid, returnType="win: int, start_sample: int")
