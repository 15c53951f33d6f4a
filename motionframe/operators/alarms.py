"""Alarm policies: N positive windows of the last M, then a cooldown."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from motionframe.constants import JOB, POLICIES, SAMPLING_RATE_HZ, SEQ, STRIDE_SECONDS
from motionframe.functions.exprs import count_if, ratio
from motionframe.operators.metrics import (
    events_at,
    events_in_scope,
    latency_summary,
    scope_of,
    with_decision,
)

# Survivor positions and decision samples handled by one task at most.
POSITION_BLOCK = 4096
SAMPLE_BLOCK = 65536


def cooldown_samples(seconds: float, rate: float = SAMPLING_RATE_HZ) -> int:
    """Half-to-even rounding, as the protocol defines."""
    return int(round(seconds * rate))


def triggers(
    scores: DataFrame,
    policies=POLICIES,
    by: Sequence[str] = JOB,
    seq: Sequence[str] = SEQ,
) -> DataFrame:
    """Rows where a policy triggers: (by, seq, n, policy, cooldown, decision).

    All policies share one sorted pass. Positions are cut into blocks and the last M-1
    rows of a block are repeated in the next one, so a long recording uses many tasks.
    """
    lookbacks = sorted({p[2] for p in policies})
    halo = max(lookbacks) - 1
    block = F.floor(F.col("pos") / POSITION_BLOCK)
    edge = F.col("pos") % POSITION_BLOCK >= POSITION_BLOCK - halo
    rows = with_decision(scores).select(
        *by,
        *seq,
        "n",
        "pos",
        "decision",
        (F.col("score") >= F.col("threshold")).cast("int").alias("_hit"),
        F.explode(F.when(edge, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"),
    )
    last = Window.partitionBy(*by, *seq, "n", "_block").orderBy("pos")
    rows = rows.withColumns(
        {f"_last{m}": F.sum("_hit").over(last.rowsBetween(-(m - 1), 0)) for m in lookbacks}
    ).filter(F.floor(F.col("pos") / POSITION_BLOCK) == F.col("_block"))
    fired = []
    for policy_id, required, lookback, consecutive, seconds in policies:
        need = lookback if consecutive else required
        fires = (F.col("pos") >= lookback - 1) & (F.col(f"_last{lookback}") >= need)
        entry = F.struct(
            F.lit(policy_id).alias("policy"), F.lit(cooldown_samples(seconds)).alias("cooldown")
        )
        fired.append(F.when(fires, entry))
    hits = F.array_compact(F.array(*fired))
    return rows.withColumn("_p", F.explode(hits)).select(
        *by, *seq, "n", "_p.policy", "_p.cooldown", "decision"
    )


def _accept(start):
    """Fold a block's sorted decisions: keep one when the cooldown since the last has passed."""
    state = F.struct(start.cast("long").alias("next"), F.array().cast("array<long>").alias("out"))

    def step(s, d):
        taken = F.struct(
            (d + F.col("cooldown")).alias("next"), F.concat(s["out"], F.array(d)).alias("out")
        )
        return F.when(d >= s["next"], taken).otherwise(s)

    return F.aggregate("_ds", state, step, lambda s: s["out"])


def accept(fired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greedy cooldown per key: (keys, decision) of accepted alarms.

    Recordings of up to SAMPLE_BLOCK samples are folded in one bounded array. Longer ones
    are cut into blocks. What a block does depends only on where the cooldown carried into
    it ends; each block lists that outcome for every possible first alarm inside the
    carried cooldown, and the lists (not the decisions) are chained per recording.
    """
    largest = SAMPLE_BLOCK
    decisions = F.sort_array(F.collect_list(F.col("decision").cast("long"))).alias("_ds")
    group = [*keys, "cooldown"]
    start = F.lit(-1).cast("long")
    short = (
        fired.filter(F.col("n") <= largest).groupBy(*group).agg(decisions).withColumn("_ok", _accept(start))
    )
    long = fired.filter(F.col("n") > largest)
    span = F.greatest(F.lit(largest), F.col("cooldown") * 2)
    blocks = (
        long.withColumn("_block", F.floor(F.col("decision") / span))
        .groupBy(*group, "_block")
        .agg(decisions)
    )
    opening = F.col("_block") * span + F.col("cooldown")
    entries = F.slice(
        "_ds", F.lit(1), F.size(F.filter("_ds", lambda d: d < opening)) + F.lit(1)
    )
    exits = F.transform(
        entries,
        lambda d0: F.struct(
            d0.alias("first"),
            F.aggregate(
                F.col("_ds"), d0, lambda s, d: F.when(d >= s, d + F.col("cooldown")).otherwise(s)
            ).alias("next"),
        ),
    )
    chains = (
        blocks.withColumn("_exits", exits)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("_block", "_exits"))).alias("_chain"))
    )
    empty = F.struct(start.alias("next"), F.array().cast("array<struct<_block:bigint,entry:bigint>>").alias("out"))

    def follow(s, b):
        reached = F.filter(b["_exits"], lambda x: x["first"] >= s["next"])
        after = F.when(F.size(reached) > 0, reached[0]["next"]).otherwise(s["next"])
        here = F.struct(b["_block"].alias("_block"), s["next"].alias("entry"))
        return F.struct(after.alias("next"), F.concat(s["out"], F.array(here)).alias("out"))

    carried = chains.select(
        *group, F.explode(F.aggregate("_chain", empty, follow, lambda s: s["out"])).alias("_c")
    ).select(*group, "_c.*")
    split = blocks.join(carried, [*group, "_block"]).withColumn("_ok", _accept(F.col("entry")))
    columns = [*keys, F.explode("_ok").alias("decision")]
    return short.select(*columns).unionByName(split.select(*columns))


def alarms(
    scores: DataFrame, policies=POLICIES, by: Sequence[str] = JOB, seq: Sequence[str] = SEQ
) -> DataFrame:
    """Accepted alarms per job, policy and sequence."""
    return accept(triggers(scores, policies, by, seq), [*by, "policy", *seq])


def policy_rows(base: DataFrame, policies=POLICIES) -> DataFrame:
    """Repeat every row once per policy of the catalogue."""
    return base.withColumn("policy", F.explode(F.array(*[F.lit(p[0]) for p in policies])))


def alarm_metrics(
    scores: DataFrame,
    events: DataFrame,
    policies=POLICIES,
    scope: DataFrame | None = None,
    scope_keys: Sequence[str] = ("fold",),
    by: Sequence[str] = JOB,
    seq: Sequence[str] = SEQ,
    stride_s: float = STRIDE_SECONDS,
) -> DataFrame:
    """Event detection and false-alarm episodes per job and policy.

    Unlike the window-level event metrics, a non-fall sequence without windows is not
    counted as a daily-activity recording here.
    """
    if scope is None:
        scope, scope_keys = scope_of(scores, by, seq), by
    totals = events_in_scope(scope, events, scope_keys, seq).drop("scope_adl_recordings")
    negatives = (
        scores.groupBy(*by, *seq, "is_fall")
        .agg(count_if(F.col("label") == 0).alias("_neg"))
        .groupBy(*by)
        .agg(
            (F.sum("_neg") * stride_s / 3600.0).alias("adl_negative_window_hours"),
            count_if(~F.col("is_fall")).alias("adl_recordings"),
        )
    )
    covered = (
        events_at(with_decision(scores).select(*by, *seq, "decision"), events, seq)
        .filter(F.size("hits") > 0)
        .select(*by, *seq, F.explode("hits").alias("e"))
        .distinct()
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_covered"))
    )
    with_class = alarms(scores, policies, [*by, "is_fall"], seq)
    found = events_at(with_class, events, seq)
    keys = [*by, "policy"]
    detected = (
        found.filter(F.size("hits") > 0)
        .withColumn("e", F.explode("hits"))
        .groupBy(*keys, *seq, "e")
        .agg(F.min("decision").alias("_first"))
        .withColumns(
            {
                "onset_latency_s": (F.col("_first") - F.col("e.onset")) / SAMPLING_RATE_HZ,
                "impact_offset_s": (F.col("_first") - F.col("e.impact")) / SAMPLING_RATE_HZ,
            }
        )
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("detected_events"), *latency_summary())
    )
    false_alarms = (
        found.filter(F.size("hits") == 0)
        .groupBy(*keys, *seq, "is_fall")
        .agg(F.count(F.lit(1)).alias("_episodes"))
        .groupBy(*keys)
        .agg(
            F.sum("_episodes").alias("adl_alarm_episodes"),
            count_if(~F.col("is_fall")).alias("adl_false_positive_recordings"),
        )
    )
    zero = F.lit(0).cast("long")
    base = negatives.join(totals, list(scope_keys), "left").join(covered, list(by), "left")
    joined = (
        policy_rows(base, policies).join(detected, keys, "left").join(false_alarms, keys, "left")
    )
    counts = ("fall_events", "_covered", "detected_events", "adl_alarm_episodes", "adl_false_positive_recordings")
    filled = joined.withColumns({c: F.coalesce(c, zero) for c in counts})
    return filled.select(
        *by,
        F.col("policy").alias("alarm_policy_id"),
        "fall_events",
        "detected_events",
        (F.col("fall_events") - F.col("_covered")).alias("events_without_positive_decision_window"),
        ratio("detected_events", "fall_events").alias("event_sensitivity"),
        "adl_recordings",
        "adl_false_positive_recordings",
        ratio("adl_false_positive_recordings", "adl_recordings").alias("adl_recording_false_positive_rate"),
        "adl_negative_window_hours",
        "adl_alarm_episodes",
        ratio("adl_alarm_episodes", "adl_negative_window_hours").alias("adl_alarm_episodes_per_hour"),
        "onset_latency_median_s",
        "onset_latency_p95_s",
        "impact_offset_median_s",
    )


def pareto(rows: DataFrame, by: Sequence[str] = JOB) -> DataFrame:
    """Policies no other policy of the job dominates: sensitivity up, episodes per hour
    and p95 latency down, a missing latency ranking last.

    One row per job gathers its policies; that array is as long as the policy catalogue.
    """
    latency = F.coalesce("onset_latency_p95_s", F.lit(float("inf")))
    item = F.struct(
        F.col("alarm_policy_id").alias("id"),
        F.col("event_sensitivity").alias("sens"),
        F.col("adl_alarm_episodes_per_hour").alias("rate"),
        latency.alias("lat"),
    )
    per_job = rows.groupBy(*by).agg(F.collect_list(item).alias("_all"))

    def dominated(c):
        def better(o):
            no_worse = (o["sens"] >= c["sens"]) & (o["rate"] <= c["rate"]) & (o["lat"] <= c["lat"])
            strictly = (o["sens"] > c["sens"]) | (o["rate"] < c["rate"]) | (o["lat"] < c["lat"])
            return no_worse & strictly

        return F.exists("_all", better)

    front = F.filter("_all", lambda c: ~dominated(c))
    ids = F.transform(front, lambda c: c["id"])
    return per_job.select(*by, F.explode(ids).alias("alarm_policy_id"))


def choose_policy(
    rows: DataFrame, tolerance_points: float, by: Sequence[str] = ("model_id",)
) -> DataFrame:
    """Sensitivity guard, then the fewest episodes per hour, latency and id."""
    best = rows.groupBy(*by).agg(F.max("event_sensitivity").alias("maximum_event_sensitivity"))
    guarded = rows.join(best, list(by)).withColumn(
        "eligibility_cutoff", F.col("maximum_event_sensitivity") - tolerance_points / 100.0
    )
    eligible = guarded.filter(F.col("event_sensitivity") >= F.col("eligibility_cutoff") - 1e-12)
    latency = F.coalesce("onset_latency_p95_s", F.lit(float("inf")))
    rank = F.struct("adl_alarm_episodes_per_hour", latency.alias("latency"), "alarm_policy_id")
    return eligible.groupBy(*by).agg(
        F.max("maximum_event_sensitivity").alias("maximum_event_sensitivity"),
        F.max("eligibility_cutoff").alias("eligibility_cutoff"),
        F.array_join(F.sort_array(F.collect_set("alarm_policy_id")), ",").alias("eligible_policy_ids"),
        F.min(rank)["alarm_policy_id"].alias("selected_policy_id"),
    )
