"""Participant counts, rates, hierarchical and paired bootstrap."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from motionframe.constants import BALANCED, JOB, NATURAL, POLICIES, REFERENCE_POLICY, SEED, SEQ
from motionframe.functions.exprs import hash_draw, ratio
from motionframe.operators.alarms import alarm_metrics
from motionframe.operators.metrics import confusion_counts
from motionframe.operators.sampling import numbered
from motionframe.operators.skew import ordered_positions

try:  # Python's own md5 costs half of what the general interface does for short texts
    from _md5 import md5
except ImportError:
    from hashlib import md5

COUNTS = (
    "tn", "fp", "fn", "tp", "fall_events", "detected_events", "adl_negative_window_hours", "adl_alarm_episodes",
)
RATES = (
    "balanced_accuracy", "window_sensitivity", "window_specificity", "event_sensitivity",
    "adl_alarm_episodes_per_hour",
)
METHOD = ("model_id", "recipe")
#: Replicates that one task makes together, and participants whose counts it holds: some 100 bytes each.
REPLICATE_BLOCK = 128
PEOPLE_CHUNK = 500_000
PARTICIPANT = ("dataset_id", "participant_id")


def rates(df: DataFrame) -> DataFrame:
    """Five rates from the eight summed counts; a zero denominator gives 0."""
    c = F.col
    sensitivity, specificity = ratio("tp", c("tp") + c("fn")), ratio("tn", c("tn") + c("fp"))
    return df.withColumns(
        {
            "balanced_accuracy": (sensitivity + specificity) / 2.0,
            "window_sensitivity": sensitivity,
            "window_specificity": specificity,
            "event_sensitivity": ratio("detected_events", "fall_events"),
            "adl_alarm_episodes_per_hour": ratio("adl_alarm_episodes", "adl_negative_window_hours"),
        }
    )


def participant_counts(
    scores: DataFrame, events: DataFrame, scope: DataFrame, seq: Sequence[str] = SEQ
) -> DataFrame:
    """Eight additive counts per job and participant at the reference policy."""
    by = [*JOB, *PARTICIPANT]
    reference = [p for p in POLICIES if p[0] == REFERENCE_POLICY]
    windows = scores.groupBy(*by).agg(*confusion_counts()).drop("n", "positive")
    alarm = alarm_metrics(
        scores, events, reference, scope, ("fold", *PARTICIPANT), by, seq
    ).select(*by, *COUNTS[4:])
    return windows.join(alarm, by)


def completeness(counts: DataFrame) -> DataFrame:
    """Whether a method has every (seed, participant) cell."""
    return (
        counts.groupBy(*METHOD)
        .agg(
            F.count_distinct("seed").alias("seeds"),
            F.count_distinct(*PARTICIPANT).alias("participants"),
            F.count_distinct("seed", *PARTICIPANT).alias("cells"),
        )
        .withColumn("complete", F.col("seeds") * F.col("participants") == F.col("cells"))
    )


def complete_counts(counts: DataFrame) -> DataFrame:
    done = completeness(counts).filter("complete").select(*METHOD)
    return counts.join(done, list(METHOD), "left_semi")


def point_estimates(counts: DataFrame) -> DataFrame:
    return rates(counts.groupBy(*METHOD).agg(*[F.sum(c).alias(c) for c in COUNTS]))


def _numbered_people(cells: DataFrame) -> DataFrame:
    """Number the participants of each unit from 0, always split by dataset."""
    people = cells.select("unit", *PARTICIPANT).distinct()
    order = [F.col(k) for k in PARTICIPANT]
    return ordered_positions(people, ["unit"], order, F.col("dataset_id"), "p", hot=F.lit(True))


def _numbered_seeds(cells: DataFrame) -> DataFrame:
    """Number the seeds of each side from 0; a run has a handful of seeds."""
    order = Window.partitionBy("unit", "side").orderBy("seed")
    return cells.select("unit", "side", "seed").distinct().withColumn("s", F.row_number().over(order) - 1)


def _drawn_sums(seed: int, types: dict):
    """Sums per replicate, side and seed over one block of replicates and one chunk of participants."""

    def sums(key, reps: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(reps) or not len(held):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in types})
        unit, people, first = reps["unit"].iloc[0], int(reps["_p"].iloc[0]), int(key[2]) * PEOPLE_CHUNK
        sides = held.groupby(["side", "s"]).ngroup().to_numpy()
        names = held.groupby(["side", "s"]).size().index
        wide = min(PEOPLE_CHUNK, people - first)
        table = np.zeros((wide, len(names), len(COUNTS) + 1))
        table[held["p"].to_numpy() - first, sides] = np.column_stack((held[list(COUNTS)].to_numpy(dtype=np.float64), np.ones(len(held))))
        flat, numbers, parts = table.reshape(wide, -1), [b"%d" % d for d in range(people)], []
        for rep in reps["rep"]:
            start = f"{seed}:participant:{unit}:{rep}:".encode()
            draws = np.frombuffer(b"".join([md5(start + d).digest()[:4] for d in numbers]), dtype=">u4") % people
            times = np.bincount(draws, minlength=people)[first : first + wide].astype(np.float64)
            total = (times @ flat).reshape(len(names), -1)
            for (side, s), row in zip(names, total):
                if row[-1]:
                    parts.append((unit, side, rep, s, *row[:-1]))
        made = pd.DataFrame(parts, columns=list(types))
        return made.astype({c: "int64" for c, t in types.items() if t == "bigint"})

    return sums


def resampled(cells: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """Summed counts per (unit, side, replicate) of a two-level bootstrap.

    ``cells`` holds (unit, side, participant, seed, counts). Participants are drawn once
    per unit and replicate and shared by its sides; seeds are drawn per side. Replicates are dealt
    into blocks, and a block meets the counts of a chunk of participants in one task: how often each
    was drawn, times their counts. Draws are never shuffled or broadcast; the counts are shuffled
    once per block. One row per replicate and seed comes out, weighted by how often the seed was drawn.
    """
    people = _numbered_people(cells)
    seeds = _numbered_seeds(cells)
    placed = cells.join(people.hint("merge"), ["unit", *PARTICIPANT]).join(F.broadcast(seeds), ["unit", "side", "seed"])
    size = people.groupBy("unit").agg(F.count(F.lit(1)).alias("_p"))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["unit", "block", "chunk"]
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_p") - 1) / PEOPLE_CHUNK)))
    reps = numbered(size, F.lit(replicates), "rep").withColumns({"block": F.floor(F.col("rep") / REPLICATE_BLOCK), "chunk": chunks})
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((replicates - 1) // REPLICATE_BLOCK).cast("long")))
    held = placed.select(F.col("unit").alias("unit"), "side", "p", "s", *COUNTS, F.floor(F.col("p") / PEOPLE_CHUNK).alias("chunk")).withColumn("block", blocks)
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    types = {"unit": "string", "side": "string", "rep": "bigint", "s": kinds["s"], **{c: kinds[c] for c in COUNTS}}
    dealt = lambda df: df.repartition(tasks, *keys).groupBy(*keys)  # noqa: E731  (few narrow rows, each much work)
    sums = dealt(reps).cogroup(dealt(held)).applyInPandas(_drawn_sums(seed, types), ", ".join(f"{c} {t}" for c, t in types.items()))
    seed_size = seeds.groupBy("unit", "side").agg(F.count(F.lit(1)).alias("_s"))
    seed_draws = numbered(numbered(seed_size, F.lit(replicates), "rep"), F.col("_s"), "draw")
    which = hash_draw(seed, "seed", F.col("unit"), F.col("side"), F.col("rep"), F.col("draw")) % F.col("_s")
    weights = (
        seed_draws.withColumn("s", which.cast("int"))
        .groupBy("unit", "side", "rep", "s")
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    total = [F.sum(F.col(c) * F.col("_w")).alias(c) for c in COUNTS]
    return sums.join(weights, ["unit", "side", "rep", "s"]).groupBy("unit", "side", "rep").agg(*total)


def melted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in RATES])
    return df.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*")


def unit_name(model, recipe):
    return F.concat_ws("|", model, recipe)


def bootstrap(counts: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """Point estimate and 95 % interval of each rate per complete method."""
    whole = complete_counts(counts)
    cells = whole.withColumns({"unit": unit_name(F.col("model_id"), F.col("recipe")), "side": F.lit("")})
    samples = melted(rates(resampled(cells, replicates, seed)), ["unit", "rep"])
    interval = samples.groupBy("unit", "metric").agg(
        F.expr("percentile(value, 0.025)").alias("ci_lower_95"),
        F.expr("percentile(value, 0.975)").alias("ci_upper_95"),
        F.count(F.lit(1)).alias("bootstrap_replicates"),
    )
    point = point_estimates(whole).withColumn("unit", unit_name(F.col("model_id"), F.col("recipe")))
    estimate = melted(point, ["unit", *METHOD]).withColumnRenamed("value", "estimate")
    sizes = completeness(counts).select(*METHOD, "participants", "seeds")
    return estimate.join(interval, ["unit", "metric"]).join(sizes, list(METHOD)).drop("unit")


def comparison_pairs(methods: DataFrame, rule_model: str, rule_recipe: str) -> DataFrame:
    """Each method against the rule, and balanced against natural sampling of one model."""
    c = F.col
    other = F.when(
        c("model_id") != rule_model,
        F.struct(
            F.lit("model_vs_threshold").alias("comparison"),
            F.lit(rule_model).alias("reference_model_id"),
            F.lit(rule_recipe).alias("reference_recipe"),
        ),
    )
    natural = F.when(
        c("recipe") == BALANCED,
        F.struct(
            F.lit("balanced_minus_natural").alias("comparison"),
            c("model_id").alias("reference_model_id"),
            F.lit(NATURAL).alias("reference_recipe"),
        ),
    )
    wanted = methods.select(
        c("model_id").alias("candidate_model_id"),
        c("recipe").alias("candidate_recipe"),
        F.explode(F.array_compact(F.array(other, natural))).alias("_r"),
    ).select("candidate_model_id", "candidate_recipe", "_r.*")
    known = methods.select(c("model_id").alias("reference_model_id"), c("recipe").alias("reference_recipe"))
    return wanted.join(known, ["reference_model_id", "reference_recipe"])


def paired_bootstrap(
    counts: DataFrame, replicates: int, rule_model: str, rule_recipe: str, seed: int = SEED
) -> DataFrame:
    """Median and 95 % interval of candidate minus reference, on their common participants."""
    whole = complete_counts(counts)
    methods = whole.select(*METHOD).distinct()
    pairs = comparison_pairs(methods, rule_model, rule_recipe)
    names = ["comparison", "reference_model_id", "reference_recipe", "candidate_model_id", "candidate_recipe"]
    pairs = pairs.withColumn("unit", F.concat_ws("|", *names))
    sides = pairs.select(
        "unit",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("reference_model_id").alias("model_id"), F.col("reference_recipe").alias("recipe")),
                F.struct(F.lit("b").alias("side"), F.col("candidate_model_id").alias("model_id"), F.col("candidate_recipe").alias("recipe")),
            )
        ).alias("_s"),
    ).select("unit", "_s.*")
    cells = whole.join(sides, list(METHOD))
    common = (
        cells.groupBy("unit", *PARTICIPANT).agg(F.count_distinct("side").alias("_n")).filter("_n = 2").drop("_n")
    )
    cells = cells.join(common, ["unit", *PARTICIPANT], "left_semi")
    values = melted(rates(resampled(cells, replicates, seed)), ["unit", "side", "rep"])
    signed = F.when(F.col("side") == "b", F.col("value")).otherwise(-F.col("value"))
    differences = values.groupBy("unit", "rep", "metric").agg(F.sum(signed).alias("d"))
    table = differences.groupBy("unit", "metric").agg(
        F.expr("percentile(d, 0.5)").alias("difference_median"),
        F.expr("percentile(d, 0.025)").alias("ci_lower_95"),
        F.expr("percentile(d, 0.975)").alias("ci_upper_95"),
        F.count(F.lit(1)).alias("bootstrap_replicates"),
    )
    return table.join(pairs, "unit").drop("unit")


def fold_spread(table: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over folds, 0 for a single fold, in long form."""
    long = table.unpivot([*by, "fold"], list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count("value").alias("folds"),
    )
