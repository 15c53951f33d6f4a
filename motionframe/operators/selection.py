"""Job grid, resume plan, sticky folds and selection evidence."""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.constants import BALANCED, FOLD_COUNT, NATURAL, NOT_APPLICABLE, SEED
from motionframe.operators.skew import ordered_positions

STICKY_BATCH = 1000
PARTICIPANT = ["dataset_id", "participant_id"]
LOADS = ("fall_sequences", "events", "adl_rows")


def job_grid(
    folds: DataFrame,
    models: Sequence[str],
    seeds: Sequence[int],
    rule_model: str,
    deterministic: Sequence[str] = (),
    recipes: Sequence[str] = (NATURAL, BALANCED),
) -> DataFrame:
    """Jobs per fold: the rule once, deterministic models with the first seed only.

    The grid is a fixed list per fold, so each fold row is expanded.
    """
    combinations = []
    for place, model in enumerate(models):
        if model == rule_model:
            chosen = [(seeds[0], NOT_APPLICABLE)]
        else:
            allowed = seeds[:1] if model in deterministic else seeds
            chosen = [(s, r) for r in recipes for s in allowed]
        for seed, recipe in chosen:
            combinations.append(
                F.struct(
                    F.lit(model).alias("model_id"), F.lit(recipe).alias("recipe"),
                    F.lit(int(seed)).cast("long").alias("seed"), F.lit(place).cast("long").alias("model_order"),
                )
            )
    return folds.withColumn("_j", F.explode(F.array(*combinations))).select(*folds.columns, "_j.*")


def pending_jobs(jobs: DataFrame, completed: DataFrame) -> DataFrame:
    """Jobs whose hash is not among the completed ones."""
    return jobs.join(completed.select("job_hash"), "job_hash", "left_anti")


def participant_proof(rows: DataFrame) -> DataFrame:
    """Per validation fold: participants, and how many appear in another fold too."""
    placed = rows.select("fold", *PARTICIPANT).distinct()
    repeated = placed.groupBy(*PARTICIPANT).agg(F.count(F.lit(1)).alias("appearances"))
    return (
        placed.join(repeated, PARTICIPANT)
        .groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("participants"),
            F.count(F.when(F.col("appearances") > 1, 1)).alias("repeated_participants"),
        )
    )


# -- sticky fold proposal -----------------------------------------------------


def _loads(stats: DataFrame) -> DataFrame:
    """Long form of what a participant adds to a fold: one row per balanced quantity."""
    item = lambda name, value: F.struct(name.alias("quantity"), value.cast("double").alias("amount"))
    fixed = [item(F.lit("participants"), F.lit(1.0))]
    fixed += [item(F.lit(c), F.col(c)) for c in LOADS]
    fixed.append(item(F.concat(F.lit("dataset:"), "dataset_id"), F.lit(1.0)))
    places = F.transform(
        "body_locations", lambda b: item(F.concat(F.lit("body_location:"), b), F.lit(1.0))
    )
    return stats.withColumn("_q", F.explode(F.concat(F.array(*fixed), places))).select(
        *[c for c in stats.columns if c != "body_locations"], "_q.*"
    )


def propose_folds(stats: DataFrame, existing: DataFrame, path: str, seed: int = SEED) -> DataFrame:
    """Keep existing folds; give each new participant the fold that balances the loads best.

    The choice depends on all earlier ones, so new participants go in order through
    bounded batches. A batch is one task over at most STICKY_BATCH rows of participant
    totals; between batches only the fold loads (folds x quantities) are carried, and each
    batch is a written table, so a lost executor repeats one batch. Needs one sort.
    """
    spark = stats.sparkSession
    unknown = existing.join(stats, PARTICIPANT, "left_anti").limit(1).count()
    if unknown:
        raise ValueError("existing split names a participant that is not in the data")
    totals = {r["quantity"]: r["t"] for r in _loads(stats).groupBy("quantity").agg(F.sum("amount").alias("t")).collect()}
    tie = F.sha2(F.concat_ws(":", F.lit(str(seed)), *PARTICIPANT), 256)
    new = stats.join(existing.select(*PARTICIPANT), PARTICIPANT, "left_anti").withColumns(
        {"_tie": tie, "_all": F.lit(0)}
    )
    order = [F.col("events").desc(), F.col("fall_sequences").desc(), F.col("adl_rows").desc(), F.col("_tie")]
    placed = ordered_positions(new, ["_all"], order, -F.col("events"), "place").drop("_all", "_tie")
    placed.withColumn("batch", F.floor(F.col("place") / STICKY_BATCH)).write.mode("overwrite").partitionBy(
        "batch"
    ).parquet(f"{path}/ordered")
    ordered = spark.read.parquet(f"{path}/ordered")
    last = ordered.agg(F.max("batch")).first()[0]
    loads = _carried(stats.join(existing.select(*PARTICIPANT, "fold_id"), PARTICIPANT))
    for batch in range(0 if last is None else last + 1):
        rows = ordered.filter(F.col("batch") == batch)
        chosen = _assign(rows, dict(loads), totals, seed)
        chosen.write.mode("overwrite").parquet(f"{path}/assigned/batch_id={batch}")
        done = spark.read.parquet(f"{path}/assigned/batch_id={batch}")
        for key, amount in _carried(rows.join(done, PARTICIPANT)).items():
            loads[key] = loads.get(key, 0.0) + amount
    kept = existing.select(*PARTICIPANT, F.col("fold_id").cast("int").alias("fold_id"), F.lit(False).alias("is_new"))
    if last is None:
        return kept
    added = spark.read.parquet(f"{path}/assigned").select(*PARTICIPANT, "fold_id", F.lit(True).alias("is_new"))
    return kept.unionByName(added)


def _carried(rows: DataFrame) -> dict:
    """Loads per (fold, quantity): at most folds x quantities rows."""
    table = _loads(rows).groupBy("fold_id", "quantity").agg(F.sum("amount").alias("a"))
    return {(r["fold_id"], r["quantity"]): r["a"] for r in table.collect()}


def _assign(rows: DataFrame, loads: dict, totals: dict, seed: int) -> DataFrame:
    targets = {q: max(t / FOLD_COUNT, 1.0) for q, t in totals.items()}

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        load = {(f, q): loads.get((f, q), 0.0) for f in range(FOLD_COUNT) for q in targets}
        result = []
        for row in frame.sort_values("place").itertuples():
            adds = {"participants": 1.0, f"dataset:{row.dataset_id}": 1.0}
            adds.update({c: float(getattr(row, c)) for c in LOADS})
            adds.update({f"body_location:{b}": 1.0 for b in row.body_locations})

            def cost(fold, adds=adds, row=row):
                parts = ((load[fold, q] + adds.get(q, 0.0) - t) / t for q, t in targets.items())
                text = f"{seed}:{row.dataset_id}:{row.participant_id}:{fold}"
                return sum(p * p for p in parts), hashlib.sha256(text.encode()).hexdigest()

            fold = min(range(FOLD_COUNT), key=cost)
            for q, amount in adds.items():
                load[fold, q] += amount
            result.append((row.dataset_id, row.participant_id, fold))
        return pd.DataFrame(result, columns=["dataset_id", "participant_id", "fold_id"])

    return rows.groupBy("batch").applyInPandas(
        choose, "dataset_id string, participant_id string, fold_id int"
    )
