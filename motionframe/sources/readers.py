"""Readers with explicit schemas and the guards that belong to them."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.constants import FOLD_COUNT, TEAM_FOLD
from motionframe.sources import schemas

#: Bytes of a file up to which it is hashed as one value; a larger one goes through its digest in blocks.
WHOLE_BYTES = 128 << 20
#: Bytes of such a block, if no line is longer.
BLOCK_BYTES = 1 << 20


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """Participant split CSV; a malformed row fails the read."""
    return spark.read.csv(path, schema=schemas.FOLDS, header=True, mode="FAILFAST")


def read_manifest(spark: SparkSession, paths) -> DataFrame:
    """Snapshot manifests (base and optional team collection), one row per file."""
    schema = f"snapshot_id string, role string, files array<struct<{_fields(schemas.MANIFEST_FILE)}>>"
    whole = spark.read.schema(schema).json(paths, multiLine=True)
    return whole.select("snapshot_id", "role", F.explode("files").alias("f")).select("snapshot_id", "role", "f.*")


def _fields(ddl: str) -> str:
    pairs = [p.strip().split(" ", 1) for p in ddl.split(",")]
    return ", ".join(f"{name}: {kind}" for name, kind in pairs)


def read_results(spark: SparkSession, path: str, keys, numbers) -> DataFrame:
    """Result CSV: key columns as text, number columns required and finite."""
    schema = ", ".join(f"{c} string" for c in (*keys, *numbers))
    rows = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
    return rows.withColumns({n: required_number(n) for n in numbers})


def required_number(name: str):
    value = F.col(name).try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, value).otherwise(
        F.raise_error(F.lit(f"{name} is not a finite number")).cast("double")
    )


def read_scores(spark: SparkSession, path: str, **job) -> DataFrame:
    """Score shards; job columns given by name prune the partitions read."""
    rows = spark.read.schema(schemas.SCORES).parquet(path)
    for name, value in job.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POLICIES).json(path)


def invalid_policies(policies: DataFrame, reference: str) -> DataFrame:
    """Policies that break a catalogue rule, and a missing reference policy."""
    need, back = F.col("required_positive_windows"), F.col("lookback_windows")
    rules = {
        "required_not_positive": need <= 0,
        "lookback_below_required": back < need,
        "consecutive_not_equal": F.col("consecutive") & (need != back),
        "negative_cooldown": F.col("cooldown_seconds") < 0,
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    broken = policies.select("id", F.explode(hits).alias("rule_id"))
    twice = policies.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate_id").alias("rule_id"))
    present = policies.agg(F.max(F.col("id") == reference).alias("_has"))
    missing = present.filter("not coalesce(_has, false)").select(
        F.lit(reference).alias("id"), F.lit("reference_missing").alias("rule_id")
    )
    return broken.unionByName(twice).unionByName(missing)


def file_inventory(spark: SparkSession, path: str, name_filter: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file; files of any size, none is held whole beyond ``WHOLE_BYTES``."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": name_filter}
    files = spark.read.format("binaryFile").options(**options).load(path).filter(F.col("length") <= WHOLE_BYTES)
    whole = files.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
    return whole.unionByName(_large_files(spark, path, options))


def _large_files(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """The same of larger files, which ``binaryFile`` holds whole, and none beyond 2 GB.

    A file is read in splits as lines between line feeds, whatever its bytes mean; a digest is a chain, so
    one task takes the blocks of a file in order. Line feeds are put back: between lines always, behind the last
    where the file has a byte more (three more are a byte order mark, which the reader leaves out).
    Names of compressed files (``.gz``) are an error, as the reader would open them."""
    lines = spark.read.options(**options).option("lineSep", "\n").text(path).filter(F.col("_metadata.file_size") > WHOLE_BYTES)
    lines = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("bytes"),
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, length, turn = None, [], 0, 0

        def block():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, turn, b"\n".join(held))))], schema)

        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("turn", pa.int64()), ("bytes", pa.binary())])
        for batch in batches:
            for *own, line in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "size", "start", "bytes"))):
                if held and (own != key or length >= BLOCK_BYTES):
                    yield block()
                    held, length, turn = [], 0, turn + 1
                key, length = own, length + len(line) + 1
                held.append(line)
        if held:
            yield block()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # path, name, size, digests without and with a byte order mark, bytes taken

        def take(data, size):
            for digest in state[3]:
                digest.update(data)
            state[4] += size

        def ended():
            path, name, size, (plain, marked), taken = state
            more = size - taken
            if more not in (0, 1, 3, 4):
                raise ValueError(f"{path} has {size} bytes, {taken} were read")
            digest = plain if more < 3 else marked
            if more % 3 == 1:
                digest.update(b"\n")
            return pa.RecordBatch.from_pylist([{"file_name": name, "size_bytes": size, "sha256": digest.hexdigest()}])

        for batch in batches:
            for path, name, size, start, data in zip(*(batch.column(c) for c in ("path", "name", "size", "start", "bytes"))):
                path, data = path.as_py(), data.as_buffer()
                if state and path != state[0]:
                    yield ended()
                    state = None
                if state:
                    take(b"\n", 1)
                else:
                    state = [path, name.as_py(), size.as_py(), (hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")), 0]
                take(data, data.size)
        if state:
            yield ended()

    parts = lines.mapInArrow(blocks, "path string, name string, size long, start long, turn long, bytes binary")
    ordered = parts.repartition("path").sortWithinPartitions("path", "start", "turn")
    return ordered.mapInArrow(digests, "file_name string, size_bytes long, sha256 string")


def collection_union(base: DataFrame, folds: DataFrame, team: DataFrame) -> DataFrame:
    """Base sequences with their fold, team sequences with fold -1.

    A base participant without a fold fails the job. Whether the fold table is broadcast
    is left to its measured size.
    """
    keys = ["dataset_id", "participant_id"]
    assigned = base.join(folds.select(*keys, "fold_id"), keys, "left").withColumn(
        "fold_id",
        F.when(F.col("fold_id").between(0, FOLD_COUNT - 1), F.col("fold_id")).otherwise(
            F.raise_error(F.concat(F.lit("no fold for participant "), F.col("participant_id"))).cast("int")
        ),
    )
    return assigned.unionByName(team.withColumn("fold_id", F.lit(TEAM_FOLD)))
