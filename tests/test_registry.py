"""Registered queries: a sample against its SQL twin, plan shapes, streaming equals batch."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from motionframe.operators import resample
from motionframe.plans.metric_queries import test_scores as scores_with_threshold
from motionframe.plans.catalog import ORACLES, QUERIES
from motionframe.sources import readers
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "minimum_slice", "win_03_decision_labels", "win_07_event_pairing", "dq_06_temporal_coverage", "dq_07_event_consistency",
    "agg_16_alarm_policy_metrics", "sel_02_pareto_policies", "smp_02_balanced_recipe", "lim_01_sequence_cap", "fe_09_skewness",
    "rsm_01_linear_resample", "str_02_gap_reset", "str_04_streaming_alarms", "smp_05_hierarchical_bootstrap",
]


def oracle(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted((str([r[names.index(n)] for n in sorted(names)]) for r in cursor.fetchall()))


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    assert sorted(str(list(r)) for r in frame.select(*columns).collect()) == oracle(ORACLES[name])


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(tables):
    plan = plan_of(tables.build_sequences())
    assert "ReadSchema: struct<l_suppkey:bigint,l_returnflag:string>" in plan


def test_windows_are_formed_with_one_exchange(tables):
    assert plan_of(tables.impact).count("Exchange hashpartitioning") <= 1


def test_no_cartesian_product(spark, tables):
    for name in ("sel_03_flagged_test_alarms", "smp_06_paired_bootstrap", "lim_02_both_caps", "prj_02_standardised_channels"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_resample_identity_and_guard(spark):
    series = spark.createDataFrame([("u", k / 25.0, float(k)) for k in range(6)], "u string, t double, v double")
    rows = resample.resample(series, ["u"], ["v"], 25.0, F.lit(0)).orderBy("k").collect()
    assert [round(r.v, 9) for r in rows] == [0, 1, 2, 3, 4, 5]
    bad = spark.createDataFrame([("u", 0, 0.0), ("u", 1, 0.04), ("u", 2, 0.04)], "u string, i int, t double")
    assert resample.bad_timestamps(bad, ["u"], F.lit(0), [F.col("i")]).count() == 1


def test_result_reader_rejects_bad_numbers(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    with open(path, "w") as f:
        f.write("job,f1\na,0.5\nb,oops\n")
    with pytest.raises(Exception, match="f1 is not a finite number"):
        readers.read_results(spark, path, ["job"], ["f1"]).collect()


def test_missing_fold_fails(spark, tables):
    with pytest.raises(Exception, match="no fold for participant"):
        readers.collection_union(tables.sequences.drop("fold_id"), tables.folds.limit(0), tables.sequences.drop("fold_id").limit(0)).collect()


def test_threshold_comes_from_validation_only(tables):
    scores = scores_with_threshold(tables)
    assert scores.groupBy("model_id", "recipe", "fold", "seed").agg(F.count_distinct("threshold").alias("n")).filter("n <> 1").count() == 0
