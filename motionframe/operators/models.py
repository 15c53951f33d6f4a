"""Standardisation, class weights and the fitted baselines."""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.constants import CHANNELS, SEQ
from motionframe.functions.exprs import count_if
from motionframe.operators import boosting, forest, logistic, naive_bayes
from motionframe.operators.windows import complete_windows, window_samples

MIN_SCALE = 1e-6


def standardisation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with mean and population deviation per column; tiny deviations become 1."""
    spread = lambda c: F.stddev_pop(c)
    return df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.when(spread(c) < MIN_SCALE, 1.0).otherwise(spread(c)).alias(f"scale_{c}") for c in columns],
    )


def standardise(df: DataFrame, parameters: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Apply the parameter row, read as a scalar subquery."""
    row = parameters.select(F.struct(*parameters.columns)).scalar()
    scaled = {
        c: (F.col(c) - row.getField(f"mean_{c}")) / row.getField(f"scale_{c}") for c in columns
    }
    return df.withColumns(scaled)


def channel_standardisation(samples: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Mean and deviation per channel over all windows and positions.

    Each window yields count, mean and squared deviations, which then combine exactly.
    """
    parts = []
    for c in CHANNELS:
        parts += [F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}")]
    per_window = complete_windows(window_samples(samples, seq), parts, seq)
    item = lambda c: F.struct(F.lit(c).alias("channel"), F.col(f"m_{c}").alias("m"), F.col(f"v_{c}").alias("v"))
    long = per_window.select(F.explode(F.array(*[item(c) for c in CHANNELS])).alias("s")).select("s.*")
    spread = F.sqrt(F.avg("v") + F.var_pop("m"))
    return long.groupBy("channel").agg(
        F.avg("m").alias("mean"), F.when(spread < MIN_SCALE, 1.0).otherwise(spread).alias("scale")
    )


def positive_weight(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Negatives per positive; a missing class fails the job."""
    counts = rows.groupBy(*by).agg(
        count_if(F.col("label") == 1).alias("positives"), count_if(F.col("label") == 0).alias("negatives")
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    weight = F.when(both, F.col("negatives") / F.col("positives")).otherwise(
        F.raise_error(F.lit("class weight needs both classes")).cast("double")
    )
    return counts.withColumn("positive_weight", weight)


# -- fixed values: parameters of the fitted baselines -------------------------
LOGISTIC = {"C": 1.0, "max_iterations": 500}
FOREST = {"trees": 200, "depth": 24, "bins": 128}
BOOSTING = {"rounds": 200, "depth": 6, "rate": 0.1, "rows": 0.8, "columns": "0.8", "bins": 32}
NAIVE_BAYES_SMOOTHING = 1e-9


def _moments(column: str, weight: Column):
    """Aggregates of an array column: weights, and mean and population variance per position.

    One buffer of a position each per task, so no row is taken apart. The variance comes with
    Bessel's correction for weights, which is taken back.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vector = array_to_vector(F.transform(column, lambda v: v.cast("double")))
    parts = [
        Summarizer.metrics("mean", "variance").summary(vector, weight).alias("_s"),
        F.sum(weight).alias("_w"),
        F.sum(weight * weight).alias("_w2"),
    ]
    bessel = (F.col("_w") - F.col("_w2") / F.col("_w")) / F.col("_w")
    variance = F.transform(vector_to_array("_s.variance"), lambda v: v * bessel)
    return parts, vector_to_array("_s.mean").alias("mean"), variance.alias("var")


def array_standardisation(df: DataFrame, column: str = "features", weight: str | None = None) -> DataFrame:
    """Mean and population deviation per array position, one row per position.

    ``weight`` counts how often a row occurs; without it every row counts once.
    """
    parts, mean, variance = _moments(column, F.col(weight) if weight else F.lit(1.0))
    long = df.agg(*parts).select(mean, variance).select(F.posexplode(F.arrays_zip("mean", "var")).alias("j", "m"))
    spread = F.sqrt("m.var")
    return long.select("j", "m.mean", F.when(spread < MIN_SCALE, 1.0).otherwise(spread).alias("scale"))


def standardise_array(df: DataFrame, parameters: DataFrame, column: str = "features") -> DataFrame:
    """Standardise an array column. The parameters are one row per feature, a fixed number."""
    ordered = F.sort_array(F.collect_list(F.struct("j", "mean", "scale")))
    row = parameters.agg(ordered.alias("p")).scalar()
    doubles = F.transform(column, lambda v: v.cast("double"))
    scaled = F.zip_with(doubles, F.col("_p"), lambda x, p: (x - p["mean"]) / p["scale"])
    return df.withColumn("_p", row).withColumn(column, scaled).drop("_p")


class Logistic(NamedTuple):
    """Coefficients of the features as they are, and the intercept."""

    coefficients: DenseVector
    intercept: float


def fit_logistic(train: DataFrame) -> Logistic:
    """L2 logistic regression of weighted rows; using up the iterations is an error."""
    model = logistic.fit(train, [F.col("weight")], LOGISTIC["C"], LOGISTIC["max_iterations"], standardised=False)[0]
    return Logistic(DenseVector(model["coefficients"]), model["intercept"])


def fit_logistic_jobs(rows: DataFrame, weights: Sequence[Column]) -> list[dict]:
    """One logistic regression a weight column, each on features standardised by its own rows."""
    return logistic.fit(rows, weights, LOGISTIC["C"], LOGISTIC["max_iterations"], least=MIN_SCALE)


def forest_scores(rows: DataFrame, train: Sequence[Column], asked: Sequence[Column], keys: Sequence[str], seed: int, trees: int = FOREST["trees"]) -> DataFrame:
    """Scores of a random forest a fold; ``train`` and ``asked`` say which rows a fold learns from and scores."""
    return forest.scores(rows, train, asked, keys, seed, trees, FOREST["depth"], FOREST["bins"])


def boosting_scores(rows: DataFrame, train: Sequence[Column], asked: Sequence[Column], keys: Sequence[str], seed: int, rounds: int = BOOSTING["rounds"]) -> DataFrame:
    """Scores of boosted trees a fold; ``train`` and ``asked`` say which rows a fold learns from and scores."""
    shares = (BOOSTING["rows"], float(BOOSTING["columns"]))
    fitted = boosting.fit(rows, train, keys, seed, rounds, BOOSTING["depth"], BOOSTING["rate"], shares, BOOSTING["bins"])
    return boosting.scores(rows, fitted, asked, keys, BOOSTING["depth"])


def naive_bayes_scores(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Gaussian naive Bayes: ``rows`` with ``score``."""
    fitted = naive_bayes.fit(train, [F.lit(True)], F.col("weight"), NAIVE_BAYES_SMOOTHING)
    return naive_bayes.scores(rows, fitted, [F.lit(True)], rows.columns).drop("fold")


def naive_bayes_fold_scores(rows: DataFrame, train: Sequence[Column], asked: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """Scores of a naive Bayes a fold; ``train`` and ``asked`` say which rows a fold learns from and scores."""
    return naive_bayes.scores(rows, naive_bayes.fit(rows, train, F.lit(1.0), NAIVE_BAYES_SMOOTHING), asked, keys)
