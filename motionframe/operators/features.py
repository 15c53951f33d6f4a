"""Engineered features: 8 signals x 11 time statistics, 14 window features, 8 x 7 spectral.

Time features are native aggregates over the long window rows; they need no exchange
beyond the one that forms the windows. Only the Fourier transform runs in Python, as one
matrix product per Arrow batch.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from motionframe.constants import (
    CHANNELS,
    FREQUENCY_STATISTICS,
    SAMPLING_RATE_HZ,
    SEQ,
    SIGNAL_NAMES,
    SIGNALS,
    STRIDE_SECONDS,
    TIME_STATISTICS,
    WINDOW_FEATURES,
    WINDOW_LENGTH,
    feature_names,
)
from motionframe.operators.windows import BLOCK_WINDOWS, add_norms, blocked_samples, complete_windows, start_of, window_samples

FLAT = 1e-12
BINS = WINDOW_LENGTH // 2 + 1
NAME_OF = dict(zip(SIGNALS, SIGNAL_NAMES, strict=True))
# -- fixed values: half-open bands in bins of 0.5 Hz -------------------------
BANDS = ((0, 1), (1, 6), (6, 16), (16, 26))


def time_statistic(stat: str, x: str) -> Column:
    """One statistic of signal ``x`` over the rows of a window."""
    spread = F.stddev_pop(x)
    quartiles = F.expr(f"percentile({x}, array(0.25D, 0.5D, 0.75D))")
    return {
        "mean": lambda: F.avg(x),
        "std": lambda: spread,
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "median": lambda: quartiles[1],
        "iqr": lambda: quartiles[2] - quartiles[0],
        "peak_to_peak": lambda: F.max(x) - F.min(x),
        "mean_abs_first_difference": lambda: F.avg(F.abs(F.col(f"d_{x}"))),
        "skewness": lambda: F.when(spread > FLAT, F.skewness(x)).otherwise(0.0),
        "excess_kurtosis": lambda: F.when(spread > FLAT, F.kurtosis(x)).otherwise(-3.0),
        "mean_square_energy": lambda: F.avg(F.col(x) * F.col(x)),
    }[stat]()


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of a window, 0 when either axis does not move."""
    product = F.stddev_pop(x) * F.stddev_pop(y)
    moving = product * WINDOW_LENGTH > FLAT
    return F.when(moving, F.try_divide(F.covar_pop(x, y), product)).otherwise(0.0)


def peak_time(x: str) -> Column:
    """Relative time of the first maximum."""
    first = F.min(F.struct((-F.col(x)).alias("v"), F.col("pos").alias("p")))
    return first["p"] / float(WINDOW_LENGTH - 1)


def window_feature(name: str) -> Column:
    jerk = F.col("jerk")
    area = lambda names: F.avg(sum((F.abs(F.col(n)) for n in names[1:]), F.abs(F.col(names[0]))))
    made = {
        "acceleration_sma": lambda: area(CHANNELS[:3]),
        "angular_velocity_sma": lambda: area(CHANNELS[3:]),
        "acceleration_peak_relative_time": lambda: peak_time("acc_norm"),
        "angular_velocity_peak_relative_time": lambda: peak_time("gyr_norm"),
        "acceleration_jerk_norm__mean": lambda: F.avg(jerk),
        "acceleration_jerk_norm__std": lambda: F.stddev_pop(jerk),
        "acceleration_jerk_norm__max": lambda: F.max(jerk),
        "acceleration_jerk_norm__rms": lambda: F.sqrt(F.avg(jerk * jerk)),
    }
    pairs = {"xy": (0, 1), "xz": (0, 2), "yz": (1, 2)}
    for sensor, offset in (("acceleration", 0), ("angular_velocity", 3)):
        for axes, (i, j) in pairs.items():
            made[f"{sensor}_{axes}_correlation"] = (
                lambda i=i, j=j, o=offset: correlation(CHANNELS[o + i], CHANNELS[o + j])
            )
    return made[name]()


def feature_rows(samples: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Long window rows with 8 signals, their first differences and the jerk norm."""
    rows = window_samples(add_norms(samples), seq, SIGNALS, differences=SIGNALS)
    squares = [F.col(f"d_{c}") * F.col(f"d_{c}") for c in CHANNELS[:3]]
    return rows.withColumn("jerk", F.sqrt(sum(squares[1:], squares[0])) * SAMPLING_RATE_HZ)


def time_features(samples: DataFrame, stats=TIME_STATISTICS, seq: Sequence[str] = SEQ) -> DataFrame:
    """Chosen time statistics of every window, named ``<signal>__<statistic>``."""
    columns = [
        time_statistic(stat, x).alias(f"{NAME_OF[x]}__{stat}") for x in SIGNALS for stat in stats
    ]
    return complete_windows(feature_rows(samples, seq), columns, seq)


def window_features(samples: DataFrame, names=WINDOW_FEATURES, seq: Sequence[str] = SEQ) -> DataFrame:
    """Chosen features that combine several signals."""
    return complete_windows(
        feature_rows(samples, seq), [window_feature(n).alias(n) for n in names], seq
    )


# -- spectrum ---------------------------------------------------------------


def dft_basis() -> np.ndarray:
    """[length, 2 * bins] cosine and sine columns with the Hann taper folded in."""
    n = np.arange(WINDOW_LENGTH)
    angle = 2.0 * np.pi * np.outer(n, np.arange(BINS)) / WINDOW_LENGTH
    taper = 0.5 - 0.5 * np.cos(2.0 * np.pi * n / (WINDOW_LENGTH - 1))
    return taper[:, None] * np.hstack((np.cos(angle), np.sin(angle)))


@pandas_udf(T.ArrayType(T.DoubleType()))
def power_spectrum(signals: pd.Series) -> pd.Series:
    """Tapered power of mean-removed signals; input and output hold the signals end to end."""
    values = np.stack(signals.to_numpy()).reshape(len(signals), -1, WINDOW_LENGTH)
    parts = (values - values.mean(axis=2, keepdims=True)) @ dft_basis()
    power = parts[:, :, :BINS] ** 2 + parts[:, :, BINS:] ** 2
    return pd.Series(list(power.reshape(len(signals), -1)))


def spectra(samples: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Power spectrum per window: ``power`` holds 8 x 26 bins in signal order."""
    windows = gathered_windows(samples, seq)
    return windows.select(*seq, "win", power_spectrum(F.flatten("signals")).alias("power"))


def add(a: Column, b: Column) -> Column:
    return a + b


def with_totals(spectrum: DataFrame) -> DataFrame:
    """Cut ``power`` into one array per signal and add each signal's total power."""
    cut = spectrum.withColumns(
        {x: F.slice("power", i * BINS + 1, BINS) for i, x in enumerate(SIGNALS)}
    )
    totals = {f"total_{x}": F.aggregate(F.col(x), F.lit(0.0), add) for x in SIGNALS}
    summed = cut.withColumns(totals)
    safe = lambda x: F.when(F.col(f"total_{x}") > 1e-18, F.col(f"total_{x}")).otherwise(1.0)
    return summed.withColumns({f"total_{x}": safe(x) for x in SIGNALS})


def spectral_statistic(stat: str, signal: str) -> Column:
    """One spectral statistic from ``<signal>`` (26 bins) and ``total_<signal>``."""
    p, total, zero = F.col(signal), F.col(f"total_{signal}"), F.lit(0.0)
    step = SAMPLING_RATE_HZ / WINDOW_LENGTH
    if stat == "dominant_frequency_hz":
        tail = F.slice(p, 2, BINS - 1)
        return F.array_position(tail, F.array_max(tail)) * step
    if stat == "spectral_centroid_hz":
        return F.aggregate(F.transform(p, lambda v, i: v * (i * step)), zero, add) / total
    if stat == "spectral_entropy":
        share = lambda v: F.when(v > 0, v / total * F.log2(v / total)).otherwise(0.0)
        return -F.aggregate(F.transform(p, share), zero, add) / F.log2(F.lit(float(BINS)))
    low, high = BANDS[FREQUENCY_STATISTICS.index(stat) - 3]
    return F.aggregate(F.slice(p, low + 1, high - low), zero, add) / total


def spectral_features(
    samples: DataFrame, stats=FREQUENCY_STATISTICS, seq: Sequence[str] = SEQ
) -> DataFrame:
    cut = with_totals(spectra(samples, seq))
    columns = [
        spectral_statistic(stat, x).alias(f"{NAME_OF[x]}__{stat}") for x in SIGNALS for stat in stats
    ]
    return cut.select(*seq, "win", *columns)


# -- all features of a window at once ------------------------------------------
#
# The full table works on one row per window: ``signals`` holds 8 arrays of 50 values.
# Each stage below adds one array with an entry per signal, so the plan stays small and
# nothing is exchanged after the windows are formed.


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), add)


def average(values: Column) -> Column:
    return total(values) / F.size(values)


def steps(values: Column) -> Column:
    """Differences of neighbouring values."""
    n = WINDOW_LENGTH - 1
    return F.zip_with(F.slice(values, 2, n), F.slice(values, 1, n), lambda later, earlier: later - earlier)


def quantile(ordered: Column, q: float) -> Column:
    """Linear quantile of a sorted array."""
    rank = q * (WINDOW_LENGTH - 1)
    low = int(rank)
    below, above = ordered[low], ordered[min(low + 1, WINDOW_LENGTH - 1)]
    return below + (above - below) * (rank - low)


def gathered_windows(samples: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """One row per window with ``signals``, 8 arrays in position order.

    Samples are gathered once per block of windows and the windows cut out of that array, so what
    is sorted is the samples, not the four-fold windows. A window with a missing or repeated sample
    is dropped.
    """
    rows = add_norms(blocked_samples(samples, seq, CHANNELS))
    taken = F.sort_array(F.collect_list(F.struct("sample_idx", *SIGNALS))).alias("_b")
    blocks = rows.groupBy(*seq, "block").agg(taken).withColumn("_i", F.col("_b.sample_idx"))
    first = F.col("block") * BLOCK_WINDOWS
    reach = F.floor((F.element_at("_i", -1) - WINDOW_LENGTH + 1) / (STRIDE_SECONDS * SAMPLING_RATE_HZ)) + 1
    final = F.least(first + BLOCK_WINDOWS - 1, reach)

    def cut(k):
        start = start_of(k)
        guess = start - F.col("_i")[0] + 1
        at = F.when(F.get("_i", guess - 1) == start, guess.cast("long")).otherwise(F.array_position("_i", start))
        end = start + WINDOW_LENGTH - 1
        alone = ~F.coalesce(F.get("_i", at.cast("int") - 2) == start, F.lit(False))
        alone &= ~F.coalesce(F.get("_i", at.cast("int") + WINDOW_LENGTH - 1) == end, F.lit(False))
        whole = (at > 0) & F.coalesce(F.get("_i", at.cast("int") + WINDOW_LENGTH - 2) == end, F.lit(False)) & alone
        return F.when(whole, F.struct(k.alias("win"), F.slice("_b", at.cast("int"), WINDOW_LENGTH).alias("w")))

    wins = F.when(first <= final, F.sequence(first.cast("int"), final.cast("int")))
    found = blocks.select(*seq, F.explode(F.array_compact(F.transform(wins, cut))).alias("_w"))
    return found.select(*seq, "_w.win", F.array(*[F.col(f"_w.w.{x}") for x in SIGNALS]).alias("signals"))


def signal_stages(windows: DataFrame) -> DataFrame:
    """Add sorted values, means, centred values, steps and moments per signal."""
    def moment(name):
        return F.transform(name, average)

    return (
        windows.withColumns(
            {
                "ordered": F.transform("signals", lambda s: F.sort_array(s)),
                "means": F.transform("signals", average),
                "steps": F.transform("signals", steps),
                "energy": F.transform("signals", lambda s: average(F.transform(s, lambda v: v * v))),
            }
        )
        .withColumn(
            "centred", F.zip_with("signals", "means", lambda s, m: F.transform(s, lambda v: v - m))
        )
        .withColumn("squares", F.transform("centred", lambda s: F.transform(s, lambda v: v * v)))
        .withColumns(
            {
                "m2": moment("squares"),
                "m3": F.zip_with("squares", "centred", lambda q, s: average(F.zip_with(q, s, lambda a, b: a * b))),
                "m4": F.transform("squares", lambda q: average(F.transform(q, lambda v: v * v))),
            }
        )
        .withColumn("std", F.transform("m2", F.sqrt))
    )


def staged_statistic(stat: str, i: int) -> Column:
    """A time statistic of signal number ``i`` from the stages."""
    at = lambda name: F.col(name)[i]
    ordered, moving = at("ordered"), at("std") > FLAT
    return {
        "mean": lambda: at("means"),
        "std": lambda: at("std"),
        "min": lambda: ordered[0],
        "max": lambda: ordered[WINDOW_LENGTH - 1],
        "median": lambda: quantile(ordered, 0.5),
        "iqr": lambda: quantile(ordered, 0.75) - quantile(ordered, 0.25),
        "peak_to_peak": lambda: ordered[WINDOW_LENGTH - 1] - ordered[0],
        "mean_abs_first_difference": lambda: average(F.transform(at("steps"), F.abs)),
        "skewness": lambda: F.when(moving, at("m3") / (at("m2") * at("std"))).otherwise(0.0),
        "excess_kurtosis": lambda: F.when(moving, at("m4") / (at("m2") * at("m2")) - 3.0).otherwise(-3.0),
        "mean_square_energy": lambda: at("energy"),
    }[stat]()


def staged_window_features() -> dict[str, Column]:
    """The 14 features that combine signals, from the stages and the ``jerk`` array."""
    at = lambda name, i: F.col(name)[i]
    area = lambda first: total(
        F.array(*[average(F.transform(at("signals", first + j), F.abs)) for j in range(3)])
    )
    first_peak = lambda i: (
        F.array_position(at("signals", i), at("ordered", i)[WINDOW_LENGTH - 1]) - 1
    ) / float(WINDOW_LENGTH - 1)
    jerk = F.col("jerk")
    jerk_mean = average(jerk)
    jerk_square = average(F.transform(jerk, lambda v: v * v))

    def related(i, j):
        spread = at("std", i) * at("std", j)
        product = average(F.zip_with(at("centred", i), at("centred", j), lambda x, y: x * y))
        return F.when(spread * WINDOW_LENGTH > FLAT, F.try_divide(product, spread)).otherwise(0.0)

    values = [area(0), area(3), first_peak(6), first_peak(7), jerk_mean]
    values.append(F.sqrt(average(F.transform(jerk, lambda v: (v - F.col("jerk_mean")) * (v - F.col("jerk_mean"))))))
    values += [F.array_max(jerk), F.sqrt(jerk_square)]
    values += [related(o + i, o + j) for o in (0, 3) for i, j in ((0, 1), (0, 2), (1, 2))]
    return dict(zip(WINDOW_FEATURES, values, strict=True))


def feature_table(samples: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """All 158 features of every window as named columns."""
    # The Python step comes first, while a row holds nothing but its signals.
    transformed = gathered_windows(samples, seq).withColumn("power", power_spectrum(F.flatten("signals")))
    staged = signal_stages(transformed)
    squares = lambda i: F.transform(F.col("steps")[i], lambda v: v * v)
    planar = F.zip_with(squares(0), squares(1), add)
    jerk = F.transform(F.zip_with(planar, squares(2), add), lambda v: F.sqrt(v) * SAMPLING_RATE_HZ)
    staged = staged.withColumn("jerk", jerk).withColumn("jerk_mean", average(F.col("jerk")))
    staged = with_totals(staged)
    columns = {
        f"{NAME_OF[x]}__{stat}": staged_statistic(stat, i)
        for i, x in enumerate(SIGNALS)
        for stat in TIME_STATISTICS
    }
    columns.update(staged_window_features())
    columns.update(
        {f"{NAME_OF[x]}__{s}": spectral_statistic(s, x) for x in SIGNALS for s in FREQUENCY_STATISTICS}
    )
    return staged.select(*seq, "win", *[columns[n].alias(n) for n in feature_names()])


def feature_vectors(samples: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """The 158 features as one float array in the published order; non-finite values fail."""
    table = feature_table(samples, seq)
    vector = F.array(*[F.col(n).cast("float") for n in feature_names()])
    finite = F.forall(vector, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    checked = F.when(finite, vector).otherwise(
        F.raise_error(F.lit("feature is not finite")).cast("array<float>")
    )
    return table.select(*seq, "win", checked.alias("features"))
