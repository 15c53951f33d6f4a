"""Engineered features, spectrum and resampling."""

import hashlib
import json

from pyspark.sql import functions as F

from motionframe.constants import (
    FREQUENCY_STATISTICS,
    SIGNALS,
    TIME_STATISTICS,
    WINDOW_FEATURES,
    feature_names,
)
from motionframe.functions.exprs import r6
from motionframe.operators import features, resample
from motionframe.operators.features import NAME_OF
from motionframe.plans.metric_queries import longs
from motionframe.plans.registry import query
from motionframe.plans.sql import ctes, part

_DIFFS = ", ".join(f"{x} - lag({x}) OVER w AS d_{x}" for x in SIGNALS)
_CENTRED = ", ".join(f"{x} - avg({x}) OVER (PARTITION BY recording_id, win) AS c_{x}" for x in SIGNALS)
part("wd", f"""
SELECT *, {_CENTRED}, 25.0::DOUBLE * sqrt(d_ax*d_ax + d_ay*d_ay + d_az*d_az) AS jerk FROM (
  SELECT *, {_DIFFS} FROM wrows WINDOW w AS (PARTITION BY recording_id, win ORDER BY p))
""", "wrows")

# SQL form of each time statistic, from plain moments.
TIME_SQL = {
    "mean": "avg({x})",
    "std": "stddev_pop({x})",
    "min": "min({x})",
    "max": "max({x})",
    "median": "quantile_cont({x}, 0.5)",
    "iqr": "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)",
    "peak_to_peak": "max({x}) - min({x})",
    "mean_abs_first_difference": "avg(abs(d_{x}))",
    "skewness": "CASE WHEN stddev_pop({x}) > 1e-12 THEN avg(pow(c_{x}, 3)) / pow(avg(pow(c_{x}, 2)), 1.5) ELSE 0 END",
    "excess_kurtosis": "CASE WHEN stddev_pop({x}) > 1e-12 THEN avg(pow(c_{x}, 4)) / pow(avg(pow(c_{x}, 2)), 2) - 3 ELSE -3 END",
    "mean_square_energy": "avg({x}*{x})",
}


def wide_sql(template, names=SIGNALS, label=lambda x: x):
    return ", ".join(f'round({template.format(x=x)}, 8) + 0.0 AS "{label(x)}"' for x in names)


def _time_query(number, stat):
    columns = wide_sql(TIME_SQL[stat], label=lambda x: f"{NAME_OF[x]}__{stat}")
    if stat == "excess_kurtosis":
        columns = columns.replace(", 8) + 0.0", ", 9) + 0.0")

    @query(
        f"fe_{number:02d}_{stat}",
        ctes("wd") + f"SELECT recording_id, win::BIGINT AS win, {columns} FROM wd GROUP BY recording_id, win",
    )
    def build(t):
        table = features.time_features(t.samples, (stat,))
        names = [f"{NAME_OF[x]}__{stat}" for x in SIGNALS]
        digits = 9 if stat == "excess_kurtosis" else 8
        return table.select("recording_id", *longs("win"), *[(F.round(n, digits) + 0.0).alias(n) for n in names])


for _number, _stat in enumerate(TIME_STATISTICS, start=1):
    _time_query(_number, _stat)

WINDOW_SQL = {
    "acceleration_sma": "avg(abs(ax) + abs(ay) + abs(az))",
    "angular_velocity_sma": "avg(abs(gx) + abs(gy) + abs(gz))",
    "acceleration_peak_relative_time": "arg_min(p, {{'v': -acc_norm, 'p': p}}) / 49.0::DOUBLE",
    "angular_velocity_peak_relative_time": "arg_min(p, {{'v': -gyr_norm, 'p': p}}) / 49.0::DOUBLE",
    "acceleration_jerk_norm__mean": "avg(jerk)",
    "acceleration_jerk_norm__std": "stddev_pop(jerk)",
    "acceleration_jerk_norm__max": "max(jerk)",
    "acceleration_jerk_norm__rms": "sqrt(avg(jerk*jerk))",
}
for _s, _axes in (("acceleration", ("ax", "ay", "az")), ("angular_velocity", ("gx", "gy", "gz"))):
    for _n, (_i, _j) in {"xy": (0, 1), "xz": (0, 2), "yz": (1, 2)}.items():
        WINDOW_SQL[f"{_s}_{_n}_correlation"] = (
            f"CASE WHEN stddev_pop({_axes[_i]}) * stddev_pop({_axes[_j]}) * 50 > 1e-12 THEN corr({_axes[_i]}, {_axes[_j]}) ELSE 0 END"
        )


def _window_query(name, chosen):
    columns = ", ".join(f'round({WINDOW_SQL[n].replace("{{", "{").replace("}}", "}")}, 6) + 0.0 AS "{n}"' for n in chosen)

    @query(name, ctes("wd") + f"SELECT recording_id, win::BIGINT AS win, {columns} FROM wd GROUP BY recording_id, win")
    def build(t):
        table = features.window_features(t.samples, chosen)
        return table.select("recording_id", *longs("win"), *[r6(n).alias(n) for n in chosen])


_window_query("fe_12_signal_magnitude_area", WINDOW_FEATURES[:2])
_window_query("fe_13_peak_relative_time", WINDOW_FEATURES[2:4])
_window_query("fe_14_jerk_norm", WINDOW_FEATURES[4:8])
_window_query("fe_15_axis_correlations", WINDOW_FEATURES[8:])

# -- spectrum: the twin sums over a cosine/sine table -------------------------

_NAMES = ", ".join(f"'{x}'" for x in SIGNALS)
_VALUES = ", ".join(SIGNALS)
part("lng", f"SELECT recording_id, win, p, unnest([{_NAMES}]) AS signal, unnest([{_VALUES}]) AS x FROM wrows", "wrows")
part("basis", """
SELECT n.n AS p, f.f, (0.5 - 0.5 * cos(2 * pi() * n.n / 49)) * cos(2 * pi() * n.n * f.f / 50) AS wc,
  (0.5 - 0.5 * cos(2 * pi() * n.n / 49)) * sin(2 * pi() * n.n * f.f / 50) AS ws
FROM range(50) n(n), range(26) f(f)
""")
part("pw", """
SELECT recording_id, win, signal, f, pow(sum((x - m) * wc), 2) + pow(sum((x - m) * ws), 2) AS power
FROM (SELECT *, avg(x) OVER (PARTITION BY recording_id, win, signal) AS m FROM lng) JOIN basis USING (p) GROUP BY ALL
""", "lng", "basis")
SPECTRAL_SQL = {
    "dominant_frequency_hz": "0.5 * arg_max(f, CASE WHEN f > 0 THEN power END)",
    "spectral_centroid_hz": "sum(power * f * 0.5) / CASE WHEN sum(power) > 1e-18 THEN sum(power) ELSE 1 END",
    "spectral_entropy": "-sum(CASE WHEN power / tot > 0 THEN power / tot * log2(power / tot) ELSE 0 END) / log2(26)",
    "relative_power_0_0p5_hz": "sum(power) FILTER (f = 0) / max(tot)",
    "relative_power_0p5_3_hz": "sum(power) FILTER (f BETWEEN 1 AND 5) / max(tot)",
    "relative_power_3_8_hz": "sum(power) FILTER (f BETWEEN 6 AND 15) / max(tot)",
    "relative_power_8_12p5_hz": "sum(power) FILTER (f >= 16) / max(tot)",
}
part("spt", "SELECT *, CASE WHEN t0 > 1e-18 THEN t0 ELSE 1 END AS tot FROM (SELECT *, sum(power) OVER (PARTITION BY recording_id, win, signal) AS t0 FROM pw)", "pw")


def _spectral_query(name, stats):
    inner = ", ".join(f'{SPECTRAL_SQL[s]} AS "{s}"' for s in stats)
    columns = ", ".join(
        f"round(max(\"{s}\") FILTER (signal = '{x}'), 6) + 0.0 AS \"{NAME_OF[x]}__{s}\"" for x in SIGNALS for s in stats
    )

    @query(
        name,
        ctes("spt") + f"""SELECT recording_id, win::BIGINT AS win, {columns} FROM (
        SELECT recording_id, win, signal, {inner} FROM spt GROUP BY ALL) GROUP BY recording_id, win""",
    )
    def build(t):
        table = features.spectral_features(t.samples, stats)
        names = [f"{NAME_OF[x]}__{s}" for x in SIGNALS for s in stats]
        return table.select("recording_id", *longs("win"), *[r6(n).alias(n) for n in names])


_spectral_query("fe_17_dominant_frequency", FREQUENCY_STATISTICS[:1])
_spectral_query("fe_18_spectral_centroid", FREQUENCY_STATISTICS[1:2])
_spectral_query("fe_19_spectral_entropy", FREQUENCY_STATISTICS[2:3])
_spectral_query("fe_20_relative_band_power", FREQUENCY_STATISTICS[3:])


def mean_power(t):
    """Mean power per recording, signal and frequency bin over all its windows."""
    names = F.array(*[F.lit(x) for x in SIGNALS])
    rows = features.spectra(t.samples).select("recording_id", F.posexplode("power").alias("i", "power"))
    bins = features.BINS
    keyed = rows.select(
        "recording_id",
        names[F.floor(F.col("i") / bins).cast("int")].alias("signal"),
        (F.col("i") % bins).cast("long").alias("bin"),
        "power",
    )
    return keyed.groupBy("recording_id", "signal", "bin").agg(r6(F.avg("power")).alias("mean_power"), F.count(F.lit(1)).alias("windows"))


_POWER = ctes("pw") + "SELECT recording_id, signal, f AS bin, round(avg(power), 6) + 0.0 AS mean_power, count(*) AS windows FROM pw GROUP BY ALL"
query("fe_16_power_spectrum", _POWER)(mean_power)


@query(
    "udf_02_power_of_strongest_bin",
    ctes("pw") + "SELECT recording_id, win::BIGINT AS win, round(max(power), 6) AS strongest FROM pw GROUP BY ALL",
)
def udf_02(t):
    return features.spectra(t.samples).select("recording_id", *longs("win"), r6(F.array_max("power")).alias("strongest"))


_ALL_TIME = [TIME_SQL[s].format(x=x) for x in SIGNALS for s in TIME_STATISTICS]
_ALL_WINDOW = [WINDOW_SQL[n].replace("{{", "{").replace("}}", "}") for n in WINDOW_FEATURES]


part("fvec", f"""
    SELECT recording_id, win, list_concat([{', '.join(_ALL_TIME + _ALL_WINDOW)}], any_value(spec)) AS v
    FROM wd JOIN (SELECT recording_id, win, list_concat({', '.join(f"any_value(s) FILTER (signal = '{x}')" for x in SIGNALS)}) AS spec FROM (
      SELECT recording_id, win, signal, [{', '.join(SPECTRAL_SQL[s] for s in FREQUENCY_STATISTICS)}] AS s FROM spt GROUP BY ALL) GROUP BY 1, 2) USING (recording_id, win)
    GROUP BY recording_id, win""", "wd", "spt")


@query(
    "fe_21_feature_vector",
    ctes("fvec") + """SELECT recording_id, win::BIGINT AS win, len(v)::BIGINT AS width, round(list_sum(v), 4) + 0.0 AS total,
    round(list_sum(list_transform(v, lambda x, i: x * i)), 2) + 0.0 AS placed_total FROM fvec""",
)
def fe_21(t):
    table = features.feature_table(t.samples)
    vector = F.array(*[F.col(n) for n in feature_names()])
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    placed = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)  # tells the order
    return table.select("recording_id", *longs("win"), vector.alias("v")).select(
        "recording_id", "win", F.size("v").cast("long").alias("width"), (F.round(total, 4) + 0.0).alias("total"), (F.round(placed, 2) + 0.0).alias("placed_total")
    )


_DIGEST = hashlib.sha256(json.dumps(feature_names(), separators=(",", ":")).encode()).hexdigest()


@query(
    "fe_22_feature_order_digest",
    ctes("grid") + f"SELECT dataset_id, count(*) AS windows, '{_DIGEST}' AS feature_order_sha256 FROM grid GROUP BY dataset_id",
)
def fe_22(t):
    digest = F.sha2(F.to_json(F.array(*[F.lit(n) for n in feature_names()])), 256)
    return t.grid.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("windows")).withColumn("feature_order_sha256", digest)


@query(
    "prj_01_vector_norms",
    ctes("samples") + """SELECT recording_id, sample_idx::BIGINT AS sample_idx, round(sqrt(ax*ax + ay*ay + az*az), 6) AS acc_norm,
    round(sqrt(gx*gx + gy*gy + gz*gz), 6) AS gyr_norm FROM samples""",
)
def prj_01(t):
    rows = features.add_norms(t.samples)
    return rows.select("recording_id", *longs("sample_idx"), r6("acc_norm").alias("acc_norm"), r6("gyr_norm").alias("gyr_norm"))


@query(
    "wf_07_first_differences",
    ctes("wd") + "SELECT recording_id, win::BIGINT AS win, p::BIGINT AS pos, " + ", ".join(
        f"round({c}, 6) + 0.0 AS {c}" for c in (*[f"d_{s}" for s in SIGNALS], "jerk")
    ) + " FROM wd WHERE p > 0",
)
def wf_07(t):
    rows = features.feature_rows(t.samples)
    whole = t.grid.select("recording_id", "win")
    return rows.join(whole, ["recording_id", "win"], "left_semi").filter("pos > 0").select(
        "recording_id", *longs("win", "pos"), *[r6(c).alias(c) for c in (*[f"d_{s}" for s in SIGNALS], "jerk")]
    )


# -- resampling: events as an irregular stream, one grid point per hour ------

HOURLY = 1.0 / 3600.0


def user_series(t):
    """Time in seconds since 2024-01-01 and two values per event."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return t.read("events").select(
        "user_id", "event_id", (micros / 1e6).alias("t"), "value", F.length("event_type").cast("double").alias("kind_length")
    )


def day_of():
    return F.floor(F.col("t") / 86400)


part("series", """
SELECT *, t - min(t) OVER (PARTITION BY user_id) AS rel FROM (SELECT user_id, event_id, ts,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 1e6 AS t, value, length(event_type)::DOUBLE AS kind_length FROM events)
""")
part("resampled", """
SELECT g.user_id, g.k, g.x AS rel, CASE WHEN r1 IS NULL THEN v0 ELSE (v1 - v0) / (r1 - r0) * (g.x - r0) + v0 END AS value,
  CASE WHEN r1 IS NULL THEN l0 ELSE (l1 - l0) / (r1 - r0) * (g.x - r0) + l0 END AS kind_length
FROM (SELECT user_id, k, k / (1.0::DOUBLE / 3600.0::DOUBLE) AS x FROM (
    SELECT user_id, unnest(range(0, floor(max(rel) * (1.0::DOUBLE / 3600.0::DOUBLE) + 1e-9)::BIGINT + 1)) AS k FROM series GROUP BY user_id)) g
ASOF JOIN (SELECT user_id, rel AS r0, value AS v0, kind_length AS l0, lead(rel) OVER u AS r1, lead(value) OVER u AS v1, lead(kind_length) OVER u AS l1
  FROM series WINDOW u AS (PARTITION BY user_id ORDER BY rel)) s ON g.user_id = s.user_id AND g.x >= s.r0
""", "series")


@query(
    "rsm_01_linear_resample",
    ctes("resampled") + "SELECT user_id, k, round(rel, 6) AS rel, round(value, 6) + 0.0 AS value, round(kind_length, 6) AS kind_length FROM resampled",
)
def rsm_01(t):
    rows = resample.resample(user_series(t), ["user_id"], ["value", "kind_length"], HOURLY, day_of())
    return rows.select("user_id", *longs("k"), *[r6(c).alias(c) for c in ("rel", "value", "kind_length")])


@query(
    "jn_05_bracketing_segments",
    ctes("series") + """SELECT user_id, event_id, round(rel, 6) AS rel, round(lead(rel) OVER u, 6) AS next_rel, round(lead(value) OVER u, 6) + 0.0 AS next_value
    FROM series WINDOW u AS (PARTITION BY user_id ORDER BY rel)""",
)
def jn_05(t):
    rows = resample.segments(user_series(t), ["user_id"], ["value"], day_of())
    return rows.select("user_id", "event_id", *[r6(c).alias(c) for c in ("rel", "next_rel", "next_value")])


@query(
    "rsm_02_timestamp_guard",
    ctes("series") + """SELECT user_id, event_id, 'not_increasing' AS rule_id FROM (
      SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY t) AS prev FROM (
        SELECT *, CASE WHEN event_id % 10 = 0 THEN t - 43200.0 ELSE t END AS s FROM series)) WHERE prev >= s""",
)
def rsm_02(t):
    """Every tenth event reports a clock that is twelve hours slow."""
    slow = F.when(F.col("event_id") % 10 == 0, F.col("t") - 43200.0).otherwise(F.col("t"))
    rows = user_series(t).withColumn("arrived", F.col("t")).withColumn("t", slow)
    bad = resample.bad_timestamps(rows, ["user_id"], F.floor(F.col("arrived") / 86400), [F.col("arrived")])
    return bad.select("user_id", "event_id", "rule_id")
