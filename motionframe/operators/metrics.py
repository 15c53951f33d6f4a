"""Window, event and recording metrics, computed for all jobs in one plan.

``by`` names the job columns; labels are 0/1, undefined values are NULL.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from motionframe.constants import JOB, SAMPLING_RATE_HZ, SEQ, STRIDE_SECONDS, TOP_FRACTION
from motionframe.functions.exprs import count_if, defined_ratio, ratio, score_cell
from motionframe.operators.labels import bucket_of, bucketed
from motionframe.operators.skew import offsets_before, ordered_positions

COUNTS = ("n", "positive", "tn", "fp", "fn", "tp")


def confusion_counts() -> list[Column]:
    """Aggregates over ``label``, ``score`` and ``threshold``."""
    alert, actual = F.col("score") >= F.col("threshold"), F.col("label") == 1
    return [
        F.count(F.lit(1)).alias("n"),
        count_if(actual).alias("positive"),
        count_if(~alert & ~actual).alias("tn"),
        count_if(alert & ~actual).alias("fp"),
        count_if(~alert & actual).alias("fn"),
        count_if(alert & actual).alias("tp"),
    ]


def mcc(tn="tn", fp="fp", fn="fn", tp="tp") -> Column:
    """Matthews correlation from counts; 0 when a margin is empty."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in (tn, fp, fn, tp))
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return ratio(tp * tn - fp * fn, margins)


def rates_from_counts() -> dict[str, Column]:
    c = F.col
    both = (c("positive") > 0) & (c("positive") < c("n"))
    sensitivity, specificity = ratio("tp", c("tp") + c("fn")), ratio("tn", c("tn") + c("fp"))
    return {
        "accuracy": ratio(c("tp") + c("tn"), "n"),
        "balanced_accuracy": F.when(both, (sensitivity + specificity) / 2.0),
        "sensitivity": sensitivity,
        "specificity": specificity,
        "precision": ratio("tp", c("tp") + c("fp")),
        "f1": ratio(c("tp") * 2, c("tp") * 2 + c("fp") + c("fn")),
        "mcc": F.when(both, mcc()),
    }


def classification(scores: DataFrame, by: Sequence[str] = JOB) -> DataFrame:
    """Confusion counts and the rates derived from them."""
    return scores.groupBy(*by).agg(*confusion_counts()).withColumns(rates_from_counts())


def score_curve(scores: DataFrame, by: Sequence[str] = JOB) -> DataFrame:
    """Per distinct score, from high to low: own and cumulative positives and negatives.

    Rows collapse to distinct scores before any ordering; the running sums are split
    by score cell, so one job with very many scores is not one task.
    """
    counts = scores.groupBy(*by, "score").agg(
        count_if(F.col("label") == 1).alias("pos_n"), count_if(F.col("label") == 0).alias("neg_n")
    )
    counts = counts.withColumn("_cell", -score_cell(F.col("score")))
    before = offsets_before(
        counts, by, "_cell", {"_pos": F.col("pos_n"), "_neg": F.col("neg_n")}
    )
    running = Window.partitionBy(*by, "_cell").orderBy(F.col("score").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = counts.withColumns(
        {"tp": F.sum("pos_n").over(running), "fp": F.sum("neg_n").over(running)}
    )
    return local.join(before.hint("merge"), [*by, "_cell"]).select(
        *by,
        "score",
        "pos_n",
        "neg_n",
        (F.col("tp") + F.col("_pos")).alias("tp"),
        (F.col("fp") + F.col("_neg")).alias("fp"),
    )


def ranking(scores: DataFrame, by: Sequence[str] = JOB) -> DataFrame:
    """AUROC with ties and average precision without interpolation."""
    above = F.col("tp") - F.col("pos_n")
    return (
        score_curve(scores, by)
        .groupBy(*by)
        .agg(
            F.sum(F.col("neg_n") * (above + F.col("pos_n") / 2.0)).alias("_pairs"),
            F.sum(F.col("pos_n") * defined_ratio("tp", F.col("tp") + F.col("fp"))).alias("_steps"),
            F.sum("pos_n").alias("_p"),
            F.sum("neg_n").alias("_q"),
        )
        .select(
            *by,
            defined_ratio("_pairs", F.col("_p").cast("double") * F.col("_q")).alias("auroc"),
            F.when(F.col("_q") > 0, defined_ratio("_steps", "_p")).alias("auprc"),
        )
    )


def best_threshold(scores: DataFrame, by: Sequence[str] = JOB) -> DataFrame:
    """Threshold with the best balanced accuracy: (by, threshold, balanced_accuracy, mcc).

    Candidates are the distinct scores and the next double above the largest one. Within
    1e-12 of the best, the one closest to 0.5 wins, then the smaller.
    """
    totals = scores.groupBy(*by).agg(
        count_if(F.col("label") == 1).alias("p"),
        count_if(F.col("label") == 0).alias("q"),
        F.max("score").alias("_top"),
    )
    above = F.expr("cast(java_method('java.lang.Math', 'nextUp', _top) as double)")
    none = totals.select(
        *by, above.alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp")
    )
    curve = score_curve(scores, by).select(*by, F.col("score").alias("threshold"), "tp", "fp")
    graded = (
        curve.unionByName(none)
        .join(F.broadcast(totals.drop("_top")), list(by))  # one row per job
        .withColumn(
            "balanced_accuracy",
            (defined_ratio("tp", "p") + (F.lit(1.0) - defined_ratio("fp", "q"))) / 2.0,
        )
    )
    best = graded.groupBy(*by).agg(F.max("balanced_accuracy").alias("_best"))
    tied = graded.join(F.broadcast(best), list(by)).filter("balanced_accuracy >= _best - 1e-12")
    first = F.min(
        F.struct(
            F.abs(F.col("threshold") - 0.5).alias("d"), "threshold", "_best", "tp", "fp", "p", "q"
        )
    ).alias("c")
    chosen = tied.groupBy(*by).agg(first).select(*by, "c.*")
    return chosen.select(
        *by,
        "threshold",
        F.col("_best").alias("balanced_accuracy"),
        mcc_of_curve().alias("mcc"),
    )


def mcc_of_curve() -> Column:
    tp, fp, p, q = (F.col(c).cast("double") for c in ("tp", "fp", "p", "q"))
    margins = F.sqrt(tp + fp) * F.sqrt(p) * F.sqrt(q) * F.sqrt((q - fp) + (p - tp))
    return ratio(tp * (q - fp) - fp * (p - tp), margins)


def apply_threshold(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = JOB) -> DataFrame:
    """Attach each job's threshold to its scores.

    The thresholds are one row per job and go to the scores; Spark's size estimates know
    nothing of the expansion into jobs and might send the scores instead.
    """
    return scores.join(F.broadcast(thresholds.select(*by, "threshold")), list(by))


def false_positives_per_hour(
    scores: DataFrame, by: Sequence[str] = JOB, stride_s: float = STRIDE_SECONDS
) -> DataFrame:
    """False-positive windows, negative hours and their quotient over label-0 windows."""
    negative = F.col("label") == 0
    counts = scores.groupBy(*by).agg(
        count_if(negative & (F.col("score") >= F.col("threshold"))).alias("false_positive_windows"),
        (count_if(negative) * stride_s / 3600.0).alias("negative_hours"),
    )
    return counts.withColumn(
        "false_positive_windows_per_hour", ratio("false_positive_windows", "negative_hours")
    )


# -- events -----------------------------------------------------------------


def event_lookup(events: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Events as one array per (seq, bucket); an array holds the events touching 512 samples."""
    return (
        bucketed(events, "onset", "stop")
        .groupBy(*seq, "bucket")
        .agg(F.collect_set(F.struct("onset", "impact", "stop", "code")).alias("_events"))
    )


def events_at(decisions: DataFrame, events: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Add ``hits``: the events whose [onset, stop) holds the row's ``decision``."""
    looked = decisions.withColumn("bucket", bucket_of("decision")).join(
        event_lookup(events, seq), [*seq, "bucket"], "left"
    )
    inside = F.filter(
        "_events", lambda e: (F.col("decision") >= e["onset"]) & (F.col("decision") < e["stop"])
    )
    return looked.withColumn("hits", F.coalesce(inside, F.array())).drop("_events", "bucket")


def with_decision(scores: DataFrame) -> DataFrame:
    return scores.withColumn("decision", F.col("end_sample") - 1)


def event_outcomes(
    scores: DataFrame, events: DataFrame, by: Sequence[str] = JOB, seq: Sequence[str] = SEQ
) -> DataFrame:
    """One row per covered event: first alerting decision, onset latency, impact offset."""
    alert = F.col("score") >= F.col("threshold")
    hit = events_at(with_decision(scores), events, seq).filter(F.size("hits") > 0)
    per_event = (
        hit.withColumn("e", F.explode("hits"))
        .groupBy(*by, *seq, "e")
        .agg(
            F.count(F.lit(1)).alias("windows"),
            F.min(F.when(alert, F.col("decision"))).alias("first_alert"),
        )
    )
    return per_event.select(*by, *seq, "e.*", "windows", "first_alert").withColumns(
        {
            "onset_latency_s": (F.col("first_alert") - F.col("onset")) / SAMPLING_RATE_HZ,
            "impact_offset_s": (F.col("first_alert") - F.col("impact")) / SAMPLING_RATE_HZ,
        }
    )


def latency_summary() -> list[Column]:
    """Exact linear percentiles; latencies are multiples of 1/rate, so state stays small."""
    return [
        F.expr("percentile(onset_latency_s, 0.5)").alias("onset_latency_median_s"),
        F.expr("percentile(onset_latency_s, 0.95)").alias("onset_latency_p95_s"),
        F.expr("percentile(impact_offset_s, 0.5)").alias("impact_offset_median_s"),
    ]


def scope_of(scores: DataFrame, by: Sequence[str], seq: Sequence[str] = SEQ) -> DataFrame:
    """Default scope: the sequences that have selected windows."""
    return scores.select(*by, *seq, "is_fall").distinct()


def events_in_scope(
    scope: DataFrame, events: DataFrame, scope_keys: Sequence[str], seq: Sequence[str] = SEQ
) -> DataFrame:
    """Number of events per scope key, counted per sequence before the join."""
    per_sequence = events.groupBy(*seq).agg(F.count(F.lit(1)).alias("_events"))
    return (
        scope.join(per_sequence, list(seq), "left")
        .groupBy(*scope_keys)
        .agg(
            F.coalesce(F.sum("_events"), F.lit(0)).alias("fall_events"),
            count_if(~F.col("is_fall")).alias("scope_adl_recordings"),
        )
    )


def event_metrics(
    scores: DataFrame,
    events: DataFrame,
    scope: DataFrame | None = None,
    scope_keys: Sequence[str] = ("fold",),
    by: Sequence[str] = JOB,
    seq: Sequence[str] = SEQ,
    stride_s: float = STRIDE_SECONDS,
) -> DataFrame:
    """Event sensitivity, latencies and daily-activity false positives per job.

    ``scope`` (scope_keys, seq, is_fall) lists the sequences to account for, so that
    events and non-fall recordings without any window still count.
    """
    if scope is None:
        scope, scope_keys = scope_of(scores, by, seq), by
    totals = events_in_scope(scope, events, scope_keys, seq)
    outcomes = event_outcomes(scores, events, by, seq).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_covered"),
        F.count("first_alert").alias("detected_events"),
        *latency_summary(),
    )
    alert, negative = F.col("score") >= F.col("threshold"), F.col("label") == 0
    windows = (
        scores.groupBy(*by, *seq, "is_fall")
        .agg(count_if(negative).alias("_neg"), count_if(negative & alert).alias("_fp"))
        .groupBy(*by)
        .agg(
            F.sum("_fp").alias("adl_false_positive_windows"),
            (F.sum("_neg") * stride_s / 3600.0).alias("adl_negative_window_hours"),
            count_if(~F.col("is_fall") & (F.col("_fp") > 0)).alias("adl_false_positive_recordings"),
        )
    )
    joined = windows.join(totals, list(scope_keys), "left").join(outcomes, list(by), "left")
    zero = F.lit(0).cast("long")
    filled = joined.withColumns(
        {
            "fall_events": F.coalesce("fall_events", zero),
            "detected_events": F.coalesce("detected_events", zero),
            "adl_recordings": F.coalesce("scope_adl_recordings", zero),
            "_covered": F.coalesce("_covered", zero),
        }
    )
    return filled.select(
        *by,
        "fall_events",
        "detected_events",
        (F.col("fall_events") - F.col("_covered")).alias("events_without_positive_decision_window"),
        ratio("detected_events", "fall_events").alias("event_sensitivity"),
        "adl_recordings",
        "adl_false_positive_recordings",
        ratio("adl_false_positive_recordings", "adl_recordings").alias("adl_recording_false_positive_rate"),
        "adl_negative_window_hours",
        "adl_false_positive_windows",
        ratio("adl_false_positive_windows", "adl_negative_window_hours").alias(
            "adl_false_positive_windows_per_hour"
        ),
        "onset_latency_median_s",
        "onset_latency_p95_s",
        "impact_offset_median_s",
    )


# -- subgroups, recordings, other -------------------------------------------


def subgroups(
    scores: DataFrame,
    fields: Sequence[str] = ("dataset_id", "body_location"),
    by: Sequence[str] = JOB,
) -> DataFrame:
    """Classification and ranking metrics per value of each subgroup field."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("subgroup_field"), F.col(f).alias("subgroup_value"))
                for f in fields
            ]
        )
    )
    keys = [*by, "subgroup_field", "subgroup_value"]
    counts = scores.filter("label >= 0").groupBy(*by, *fields, "threshold", "score").agg(
        count_if(F.col("label") == 1).alias("_pos"), count_if(F.col("label") == 0).alias("_neg")
    )
    long = counts.withColumn("_g", pairs).select(*by, "_g.*", "threshold", "score", "_pos", "_neg")
    alert = F.col("score") >= F.col("threshold")
    zero = F.lit(0).cast("long")
    total = lambda condition, name: F.sum(F.when(condition, F.col(name)).otherwise(zero))
    table = long.groupBy(*keys).agg(
        F.sum(F.col("_pos") + F.col("_neg")).alias("n"),
        F.sum("_pos").alias("positive"),
        total(~alert, "_neg").alias("tn"),
        total(alert, "_neg").alias("fp"),
        total(~alert, "_pos").alias("fn"),
        total(alert, "_pos").alias("tp"),
    )
    return table.withColumns(rates_from_counts())


def subgroup_rows(scores: DataFrame, fields=("dataset_id", "body_location"), by=JOB) -> DataFrame:
    """Score rows repeated once per subgroup field, for ranking metrics per subgroup."""
    pairs = [
        F.struct(F.lit(f).alias("subgroup_field"), F.col(f).alias("subgroup_value")) for f in fields
    ]
    return scores.select(*by, "label", "score", F.explode(F.array(*pairs)).alias("g")).select(
        *by, "g.*", "label", "score"
    )


def bag_scores(
    scores: DataFrame,
    by: Sequence[str] = JOB,
    seq: Sequence[str] = SEQ,
    fraction: float = TOP_FRACTION,
) -> DataFrame:
    """Recording score: mean of its top ``max(1, ceil(fraction * n))`` window scores.

    Works on distinct scores with multiplicities, ranked within score cells.
    """
    keys = [*by, *seq]
    distinct = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_m"))
    distinct = distinct.withColumn("_cell", -score_cell(F.col("score")))
    before = offsets_before(distinct, keys, "_cell", {"_above": F.col("_m")}, {"_n": F.col("_m")})
    running = Window.partitionBy(*keys, "_cell").orderBy(F.col("score").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    ranked = (
        distinct.withColumn("_upto", F.sum("_m").over(running))
        .join(before.hint("merge"), [*keys, "_cell"])
    )
    limit = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_n") * F.lit(fraction)))
    first = F.col("_upto") + F.col("_above") - F.col("_m")
    used = F.greatest(F.lit(0).cast("long"), F.least(F.col("_m"), limit - first))
    return (
        ranked.withColumns({"_used": used, "top_windows": limit})
        .groupBy(*keys)
        .agg(
            F.max("top_windows").alias("top_windows"),
            (F.sum(F.col("score") * F.col("_used")) / F.max("top_windows")).alias("bag_score"),
        )
    )


def log_loss(scores: DataFrame, by: Sequence[str] = JOB, clip: float = 1e-7) -> DataFrame:
    p = F.greatest(F.lit(clip), F.least(F.lit(1.0 - clip), F.col("score")))
    loss = F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(F.lit(1.0) - p))
    return scores.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def score_parity(
    observed: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    rtol: float,
    atol: float,
) -> DataFrame:
    """Absolute errors between two score columns and the tolerance verdict per group."""
    pairs = observed.select(*keys, F.col("score").alias("_o")).join(
        expected.select(*keys, F.col("score").alias("_e")).hint("merge"), list(keys)  # as many rows as observed
    )
    error = F.abs(F.col("_o") - F.col("_e"))
    within = error <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("_e"))
    return (
        pairs.withColumns({"_d": error, "_ok": within})
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.max("_d").alias("max_absolute_error"),
            F.avg("_d").alias("mean_absolute_error"),
            F.bool_and("_ok").alias("passed"),
        )
    )


def exact_quantile(
    df: DataFrame, value: str, q: float, by: Sequence[str], name: str
) -> DataFrame:
    """Linear quantile of a non-negative column without gathering a group.

    Distinct values with multiplicities are positioned by cell-wise running sums; only
    the two neighbouring order statistics of each group are kept.
    """
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.withColumn("_cell", score_cell(F.col("_v")))
    before = offsets_before(counts, by, "_cell", {"_below": F.col("_m")}, {"_n": F.col("_m")})
    running = Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = (
        counts.withColumn("_upto", F.sum("_m").over(running))
        .join(before.hint("merge"), [*by, "_cell"])
        .withColumn("_last", F.col("_upto") + F.col("_below") - 1)
        .withColumn("_first", F.col("_last") - F.col("_m") + 1)
        .withColumn("_rank", (F.col("_n") - 1) * F.lit(q))
    )
    low, high = F.floor("_rank"), F.ceil("_rank")
    pick = lambda r: F.max(F.when((F.col("_first") <= r) & (r <= F.col("_last")), F.col("_v")))
    picked = placed.groupBy(*by).agg(
        pick(low).alias("_a"), pick(high).alias("_b"), F.max(F.col("_rank") - low).alias("_t")
    )
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")
    return picked.select(*by, value_at.alias(name))


def evenly_spaced(
    rows: DataFrame, limit: int, seq: Sequence[str] = SEQ, position: str = "pos", size: str = "size"
) -> DataFrame:
    """Keep positions trunc(linspace(0, size-1, limit)) of each sequence; arithmetic only."""
    if limit == 1:
        return rows.filter(F.col(position) == 0)
    p, n = F.col(position), F.col(size)
    step = (n - 1).cast("double") / float(limit - 1)
    guess = F.floor(p / step)

    def chosen(j):
        at = F.when(j == limit - 1, n - 1).otherwise(F.floor(j.cast("double") * step))
        return j.between(0, limit - 1) & (at == p)

    picked = chosen(guess) | chosen(guess + 1) | chosen(guess - 1)
    return rows.filter(F.when(n <= limit, True).otherwise(picked))


def survivors_with_size(rows: DataFrame, seq: Sequence[str] = SEQ) -> DataFrame:
    """Renumber rows of each sequence by end sample and add the sequence's row count."""
    numbered = ordered_positions(
        rows.drop("pos"),
        seq,
        [F.col("end_sample")],
        F.floor(F.col("end_sample") / 65536),
        hot=F.col("n") > 5_000_000,
    )
    sizes = rows.groupBy(*seq).agg(F.count(F.lit(1)).alias("size"))
    return numbered.join(sizes, list(seq))
