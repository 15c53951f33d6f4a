"""Gaussian naive Bayes of several folds: one pass over the rows for the moments of all, one for the scores.

Rows that the same folds learn from share their moments, which are added up for each fold.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.operators.forest import _flags
from motionframe.operators.logistic import _matrix

_PARTIAL = "folds string, label int, total double, mean array<double>, spread array<double>"


def _added(one, other):
    """Weight, means and squared deviations of two sets of rows together."""
    if one is None or other is None:
        return other if one is None else one
    (n, mean, spread), (m, middle, more) = one, other
    gap = middle - mean
    return n + m, mean + gap * (m / (n + m)), spread + more + gap**2 * (n * m / (n + m))


def _records(totals: dict) -> pa.RecordBatch:
    columns = [[v for v in column] for column in zip(*[(*key, *held) for key, held in totals.items()])]
    types = [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["folds", "label", "total", "mean", "spread"])


def fit(rows: DataFrame, train: Sequence[Column], weight: Column, smoothing: float) -> list[list]:
    """(prior, means, variances) of labels 0 and 1 for each column of ``train``; a fold without both is an error."""
    flags = F.array(*[F.coalesce(c, F.lit(False)) for c in train])
    held = rows.select("features", F.col("label").cast("int").alias("label"), weight.cast("double").alias("weight"), flags.alias("train"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, flagged = _matrix(batch, "features"), _flags(batch, "train")
            label, w = batch.column("label").to_numpy(zero_copy_only=False), batch.column("weight").to_numpy()
            kinds, kind = np.unique(np.column_stack((flagged, label == 1)), axis=0, return_inverse=True)
            for k, (*folds, one) in enumerate(kinds):
                own = np.flatnonzero((kind.ravel() == k) & (w > 0))
                if len(own) and any(folds):
                    n = w[own].sum()
                    mean = w[own] @ x[own] / n
                    key = ("".join("01"[int(f)] for f in folds), int(one))
                    totals[key] = _added(totals.get(key), (n, mean, w[own] @ (x[own] - mean) ** 2))
        if totals:
            yield _records(totals)

    def together(key, table):
        held = None
        for n, mean, spread in zip(*(table.column(c).to_pylist() for c in ("total", "mean", "spread"))):
            held = _added(held, (n, np.asarray(mean), np.asarray(spread)))
        return pa.Table.from_batches([_records({(key[0].as_py(), key[1].as_py()): held})])

    parts = held.mapInArrow(partial, _PARTIAL).groupBy("folds", "label").applyInArrow(together, _PARTIAL)
    found = sorted(parts.collect(), key=lambda r: (r["folds"], r["label"]))
    fitted = []
    for fold in range(len(train)):
        classes = [None, None]
        for r in found:
            if r["folds"][fold] == "1":
                classes[r["label"]] = _added(classes[r["label"]], (r["total"], np.asarray(r["mean"]), np.asarray(r["spread"])))
        if None in classes:
            raise ValueError("naive Bayes needs both classes")
        n, _, spread = _added(*classes)
        least = (spread / n).max() * smoothing
        fitted.append([(float(np.log(m / n)), mean, own / m + least) for m, mean, own in classes])
        if any((variance == 0).any() for _, _, variance in fitted[-1]):
            raise ValueError("naive Bayes needs features that vary")
    return fitted


def scores(rows: DataFrame, fitted: Sequence[Sequence], asked: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """(keep, fold, score) of every row and each fold whose column of ``asked`` is true of it; rows stay where they are."""
    flags = F.array(*[F.coalesce(c, F.lit(False)) for c in asked])
    held = rows.select(*keep, F.col("features").alias("_features"), flags.alias("_asked"))
    types = {f.name: f.dataType.simpleString() for f in held.schema.fields}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, wanted = _matrix(batch, "_features"), _flags(batch, "_asked")
            for fold, classes in enumerate(fitted):
                own = np.flatnonzero(wanted[:, fold])
                if not len(own):
                    continue
                likely = [prior - 0.5 * (np.log(2 * np.pi * v).sum() + ((x[own] - mean) ** 2 / v).sum(axis=1)) for prior, mean, v in classes]
                with np.errstate(over="ignore"):
                    value = 1.0 / (1.0 + np.exp(likely[0] - likely[1]))
                taken = batch.select(list(keep)).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.full(len(own), fold, dtype=np.int32)), pa.array(value)], [*keep, "fold", "score"])

    fields = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return held.mapInArrow(scored, f"{fields}, fold int, score double")
