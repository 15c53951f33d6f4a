"""Window store: derived tables written once under a content fingerprint.

The path holds the digest of the input files and the protocol values, so changed inputs
or rules never read an old table. A table counts as present only with the committer's
``_SUCCESS`` marker. Tables live in the folder the session names in
``spark.checkpoint.dir``; they also cut the lineage, so a lost executor re-reads files
instead of replaying the whole plan.
"""

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe import constants

STORE_VERSION = 1
SOURCES = ("lineitem", "supplier", "nation", "region")


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder: what one machine keeps for itself, others cannot read."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return configured.rstrip("/")


def protocol_digest() -> str:
    values = {
        "version": STORE_VERSION,
        "rate": constants.SAMPLING_RATE_HZ,
        "length": constants.WINDOW_LENGTH,
        "stride": constants.STRIDE_SECONDS,
        "folds": constants.FOLD_COUNT,
        "features": constants.feature_names(),
        "policies": [list(map(str, p)) for p in constants.POLICIES],
        "gravity": constants.GRAVITY,
        "seed": constants.SEED,
    }
    text = json.dumps(values, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def input_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Digest of path, size and time of every input file, reduced on the cluster.

    Taken anew for each set of tables, so that changed files are seen within a session.
    """
    paths = [f"{sf_dir}/{name}.parquet" for name in SOURCES]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    row = files.agg(
        F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))
    ).first()
    text = f"{protocol_digest()}:{sf_dir}:{list(row)}"
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def publish(spark: SparkSession, fresh: str, path: str) -> None:
    """Give a finished table its name; where another session was first, its table stays."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path))
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if exists(spark, path) and not exists(spark, f"{path}/_SUCCESS"):
        files.delete(target, True)  # an unfinished table of an earlier version
    if exists(spark, path) or not files.rename(source, target):
        if not exists(spark, f"{path}/_SUCCESS"):
            raise OSError(f"{fresh} cannot be renamed to {path}")
        files.delete(source, True)


def stored(spark: SparkSession, root: str, name: str, build, partition_by=()) -> DataFrame:
    """Read a table of the store, writing it first when it is not complete."""
    path = f"{root}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        frame = build()
        fresh = f"{root}/fresh-{uuid.uuid4().hex}"
        writer = frame.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(fresh)
        publish(spark, fresh, path)
        return spark.read.schema(frame.schema).parquet(path)
    return spark.read.parquet(path)
