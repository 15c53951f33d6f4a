"""Headline queries at one scale factor; prints one JSON line.

``window_store`` is the cold build of the stored tables (samples, sequences, events,
annotations, windows, thresholds). The other queries read them, as every job after the
first does; each is run to completion into a sink that discards its rows.
"""

import json
import os
import time

from motionframe.plans.catalog import QUERIES
from motionframe.plans.metric_queries import stored_thresholds
from motionframe.session import local_session
from motionframe.sources.binding import Tables

HEADLINE = [
    "minimum_slice",
    "win_03_decision_labels",
    "prj_06_impact_rule",
    "fe_21_feature_vector",
    "fe_16_power_spectrum",
    "wf_01_best_threshold",
    "agg_01_confusion_counts",
    "agg_09_auroc",
    "agg_12_event_sensitivity",
    "agg_16_alarm_policy_metrics",
    "agg_17_subgroup_metrics",
    "agg_18_participant_counts",
    "agg_27_recording_scores",
    "sel_02_pareto_policies",
    "smp_02_balanced_recipe",
    "smp_05_hierarchical_bootstrap",
    "rsm_01_linear_resample",
    "dq_07_event_consistency",
    "str_01_streaming_windows",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}

    def timed(name, action):
        begin = time.time()
        action()
        times[name] = round(time.time() - begin, 3)

    def build_store():
        tables = Tables(spark, sf_dir)
        for name in ("samples", "sequences", "event_rows", "annotations", "scored"):
            getattr(tables, name)
        stored_thresholds(tables)

    timed("window_store", build_store)
    for name in HEADLINE:
        timed(name, lambda n=name: QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
