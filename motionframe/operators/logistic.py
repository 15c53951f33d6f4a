"""L2 logistic regressions of many jobs in one pass over the rows per Newton step.

Jobs differ in the weights of the rows only (fold, recipe, seed). A pass reads the rows where they
lie and returns, per task and job, the loss, gradient and curvature, which are summed by Spark; a
matrix per job of the width of the features reaches the driver. Rows are neither shuffled nor kept.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A step counts as the last when half of the Newton decrement, the loss still to be gained, is below this.
TOLERANCE = 1e-9
_PARTIAL = "job int, totals array<double>"


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An array column as a matrix; all arrays are equally long."""
    values = batch.column(name)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def _summed(rows: DataFrame, jobs: Sequence[int], measure) -> dict[int, np.ndarray]:
    """Sum over all rows of ``measure(job, x, label, weight)``, a vector, for each job."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, weights = _matrix(batch, "features"), _matrix(batch, "weights")
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            for job in jobs:
                own = weights[:, job] > 0
                if own.any():
                    one = measure(job, x[own], label[own], weights[own, job])
                    totals[job] = totals[job] + one if job in totals else one
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], ["job", "totals"]
            )

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = rows.select("features", "label", "weights").mapInArrow(partial, _PARTIAL)
    total = parts.groupBy("job").agg(vector_to_array(Summarizer.sum(array_to_vector("totals"))).alias("totals"))
    return {r["job"]: np.asarray(r["totals"]) for r in total.collect()}


def fit(rows: DataFrame, weights: Sequence[Column], strength: float, most: int, standardised: bool = True, least: float = 0.0) -> list[dict]:
    """One model a weight column: minimum of sum(weight * loss) + |b|^2 / (2 strength).

    ``rows`` holds features and label. With ``standardised`` b is that of features scaled by the
    weighted moments of the job's rows, where a deviation below ``least`` counts as 1. A model is a
    dict of centre, scale, coefficients and intercept: score = sigmoid((x - centre) / scale . coefficients + intercept).
    Jobs of one class get that class; more than ``most`` steps are an error.
    """
    held = rows.select("features", F.col("label").cast("int").alias("label"), F.array(*[w.cast("double") for w in weights]).alias("weights"))
    every = range(len(weights))

    def sums(job, x, label, weight):
        return np.concatenate(([weight.sum(), weight @ label], weight @ x))

    first = _summed(held, every, sums)
    for job in every:
        if job not in first:
            raise ValueError(f"logistic regression {job} has no rows")
    width = len(first[0]) - 2
    centre = {job: first[job][2:] / first[job][0] for job in every}
    second = _summed(held, every, lambda job, x, label, weight: weight @ (x - centre[job]) ** 2)
    deviation = {job: np.sqrt(second[job] / first[job][0]) for job in every}
    if not all(np.isfinite(deviation[job]).all() for job in every):
        raise ValueError("logistic regression needs finite features")

    # Steps are taken on scaled features; the penalty is put into their units where it is on plain ones.
    scale = {job: np.where(d < max(least, np.finfo(float).tiny), 1.0, d) for job, d in deviation.items()}
    penalty = {job: np.append(np.ones(width) if standardised else scale[job] ** -2.0, 0.0) / strength for job in every}
    upper = np.triu_indices(width + 1)

    at = {job: np.zeros(width + 1) for job in every}  # where the loss was last found lower
    state, step, length = {}, {}, {}
    one_class = {job for job in every if first[job][1] <= 0 or first[job][1] >= first[job][0]}
    for job in one_class:
        at[job][-1] = np.inf if first[job][1] > 0 else -np.inf
    open_jobs = [job for job in every if job not in one_class]
    trial = {job: at[job] for job in open_jobs}
    for _ in range(most):
        if not open_jobs:
            break
        asked, points = list(open_jobs), dict(trial)

        def slopes(job, x, label, weight):
            z = np.column_stack(((x - centre[job]) / scale[job], np.ones(len(x))))
            gap = z @ points[job]
            p = 1.0 / (1.0 + np.exp(-np.abs(gap)))  # that of the likelier class
            likely = np.where(gap >= 0, p, 1.0 - p)
            loss = weight @ (np.maximum(gap, 0) - label * gap - np.log(p))
            bent = z * np.sqrt(weight * p * (1.0 - p))[:, None]
            return np.concatenate(([loss], z.T @ (weight * (likely - label)), (bent.T @ bent)[upper]))

        found = _summed(held, asked, slopes)
        for job in asked:
            own, here = penalty[job], points[job]
            loss = found[job][0] + 0.5 * own @ here**2
            slope = found[job][1 : width + 2] + own * here
            if job in state:
                before, gain = state[job]
                if not loss <= before - 1e-4 * length[job] * gain + 1e-12 * abs(before):
                    length[job] /= 2
                    trial[job] = at[job] + length[job] * step[job]
                    continue
            curve = np.zeros((width + 1, width + 1))
            curve[upper] = found[job][width + 2 :]
            curve = curve + np.triu(curve, 1).T + np.diag(own)
            step[job] = np.linalg.lstsq(curve, -slope, rcond=None)[0]
            gain = -slope @ step[job]
            at[job], state[job], length[job] = here, (loss, gain), 1.0
            trial[job] = here + step[job]
            if gain / 2 <= TOLERANCE:
                open_jobs.remove(job)
    if open_jobs:
        raise RuntimeError("logistic regression did not converge")
    models = []
    for job in every:
        middle, spread, inner, outer = centre[job], scale[job], at[job][:-1], at[job][-1]
        if not standardised:
            inner = inner / spread
            middle, spread, outer = np.zeros(width), np.ones(width), outer - inner @ middle
        models.append({"centre": middle, "scale": spread, "coefficients": inner, "intercept": float(outer)})
    return models


def score(rows: DataFrame, models: Sequence[dict], wanted: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """(keep, job, score) of every row and each model whose column in ``wanted`` is true of it."""
    held = rows.select(*keep, "features", F.array(*[F.coalesce(w, F.lit(False)) for w in wanted]).alias("wanted"))
    types = {f.name: f.dataType.simpleString() for f in held.schema.fields}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "features")
            asked = batch.column("wanted").flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(batch.num_rows, -1)
            for job, model in enumerate(models):
                own = np.flatnonzero(asked[:, job])
                if not len(own):
                    continue
                gap = (x[own] - model["centre"]) / model["scale"] @ model["coefficients"] + model["intercept"]
                with np.errstate(over="ignore"):
                    value = 1.0 / (1.0 + np.exp(-gap))
                taken = batch.select(list(keep)).take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(np.full(len(own), job, dtype=np.int32)), pa.array(value)], [*keep, "job", "score"]
                )

    fields = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return held.mapInArrow(scored, f"{fields}, job int, score double")
