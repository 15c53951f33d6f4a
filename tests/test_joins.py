"""Tables whose rows were multiplied by an expansion are larger than Spark's estimate; they must not be broadcast."""

from pyspark.sql import functions as F

from motionframe.constants import JOB
from motionframe.operators import metrics, skew


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def scored(spark, rows=200):
    job = [F.lit("m").alias("model_id"), F.lit("r").alias("recipe"), F.lit(0).alias("fold"), F.lit(1).alias("seed")]
    base = spark.range(rows).select(*job, F.concat(F.lit("r"), F.col("id") % 7).alias("recording_id"), F.col("id").alias("win"))
    return base.withColumns({"label": (F.col("win") % 3 == 0).cast("int"), "score": (F.col("win") % 50) / 50.0})


def test_parity_joins_by_shuffle(spark):
    keys = [*JOB, "recording_id", "win"]
    table = metrics.score_parity(scored(spark), scored(spark), keys, list(JOB), 1e-4, 0.06)
    assert "Broadcast" not in plan_of(table)
    assert table.first()["samples"] == 200
    tail = metrics.exact_quantile(scored(spark), "score", 0.99, list(JOB), "q")
    assert "Broadcast" not in plan_of(tail)
    assert abs(tail.first()["q"] - 0.98) < 1e-12


def test_thresholds_go_to_the_scores(spark):
    few = scored(spark, 2)
    limits = metrics.best_threshold(scored(spark, 3000))
    joined = metrics.apply_threshold(few, limits)
    assert "BuildRight" in plan_of(joined).split("\n")[1] + plan_of(joined).split("\n")[0]
    assert "SortMergeJoin" in plan_of(metrics.score_curve(scored(spark)))


def test_bag_scores_join_once_by_shuffle(spark):
    table = metrics.bag_scores(scored(spark), seq=["recording_id"])
    assert "Broadcast" not in plan_of(table)
    assert plan_of(table).count("Join") == 1
    best = {r["recording_id"]: (r["top_windows"], r["bag_score"]) for r in table.collect()}
    rows = scored(spark).toPandas()
    for name, part in rows.groupby("recording_id"):
        top = sorted(part["score"], reverse=True)[: best[name][0]]
        assert abs(sum(top) / len(top) - best[name][1]) < 1e-12


def test_rows_are_exchanged_once_for_their_numbers(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("key"), F.col("id").alias("v"))
    plan = plan_of(skew.ordered_positions(df, ["key"], [F.col("v")], F.floor(F.col("v") / 10)))
    assert "BroadcastHashJoin [key" in plan and "LeftAnti" in plan
    cold = plan.split("LeftAnti")[0]
    assert "SortMergeJoin" not in cold and "Exchange" not in cold
