"""Explicit schemas; no source is read with inference."""

from pyspark.sql import types as T

TEST_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
}

SAMPLES = T.StructType(
    [
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("recording_id", T.StringType(), False),
        T.StructField("body_location", T.StringType(), False),
        T.StructField("sample_idx", T.IntegerType(), False),
        *[T.StructField(c, T.FloatType(), False) for c in ("ax", "ay", "az", "gx", "gy", "gz")],
    ]
)
SEQUENCES = (
    "dataset_id string, sample_start long, sample_stop long, source_file string, "
    "participant_id string, recording_id string, body_location string, activity_code string, "
    "is_fall boolean, supervision_kind string, source_sampling_rate_hz double"
)
ANNOTATIONS = "recording_id string, kind string, start_sample long, stop_sample long, code string"
FOLDS = "split_version string, dataset_id string, participant_id string, fold_id int"
POLICIES = (
    "id string, required_positive_windows int, lookback_windows int, consecutive boolean, "
    "cooldown_seconds double"
)
SCORES = (
    "model_id string, recipe string, fold int, seed long, split string, recording_id string, "
    "win int, label int, score double"
)
MANIFEST_FILE = (
    "dataset_id string, filename string, object_key string, sha256 string, "
    "logical_content_sha256 string, size_bytes long, hdf5_schema_version string, "
    "artifact_profile string, sampling_rate_hz double, evaluation_role string, sequences long, "
    "rows long, annotations long"
)
