"""The test tables read as a sensor log.

``lineitem`` is the sample stream: one sequence per (supplier, return flag), samples in
ship-date order, six channels by fixed arithmetic. Suppliers are participants, nations
datasets, regions body locations. Flag R = temporal recordings with events, A = temporal
daily activity, N = recordings labelled as a whole.
"""

from functools import cached_property
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from motionframe.constants import BALANCED, FOLD_COUNT, NATURAL, NOT_APPLICABLE, SEED
from motionframe.operators import features as window_features
from motionframe.operators import labels, windows
from motionframe.operators.skew import HOT_ROWS, offsets_before, ordered_positions
from motionframe.sources.schemas import TEST_TABLES
from motionframe.sources.store import input_fingerprint, shared_root, stored

# (model, recipe, seed, share of the acceleration part, share of the rotation part, offset);
# offset NULL keeps the raw rule score. Scores are stored as float.
SCORERS = [
    ("impact_rule", NOT_APPLICABLE, SEED, 1.0, 1.0, None),
    ("acc_ratio", NATURAL, SEED, 1.0, 0.0, 1.0),
    ("acc_ratio", NATURAL, SEED + 1, 1.0, 0.0, 1.125),
    ("acc_ratio", BALANCED, SEED, 1.0, 0.125, 0.75),
    ("acc_ratio", BALANCED, SEED + 1, 1.0, 0.125, 0.875),
    ("gyr_ratio", NATURAL, SEED, 0.0, 1.0, 0.25),
    ("gyr_ratio", NATURAL, SEED + 1, 0.0, 1.0, 0.375),
    ("gyr_ratio", BALANCED, SEED, 0.125, 1.0, 0.25),
    ("gyr_ratio", BALANCED, SEED + 1, 0.125, 1.0, 0.375),
]


class Tables:
    """Lazily built frames over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")
        self._read = {}
        self._building = RLock()

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            reader = self.spark.read.schema(TEST_TABLES[name])
            self._read[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    @cached_property
    def root(self) -> str:
        fingerprint = input_fingerprint(self.spark, self.sf_dir)
        return f"{shared_root(self.spark)}/motionframe-{fingerprint}"

    def _stored(self, name, build, partition_by=()):
        return stored(self.spark, self.root, name, build, partition_by)

    # -- recordings ---------------------------------------------------------

    @cached_property
    def samples(self) -> DataFrame:
        return self._stored("samples", self.build_samples)

    def build_samples(self) -> DataFrame:
        line = self.read("lineitem").select(
            "l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber",
            "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        )
        order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
        placed = ordered_positions(
            line, ["l_suppkey", "l_returnflag"], order, F.to_date("l_shipdate"), "sample_idx"
        )
        return placed.select(
            recording_id(F.col("l_suppkey"), F.col("l_returnflag")).alias("recording_id"),
            F.col("l_suppkey").alias("suppkey"),
            F.col("l_returnflag").alias("flag"),
            F.col("sample_idx").cast("int").alias("sample_idx"),
            ((F.col("l_quantity") - 25.5) / 5.0).alias("ax"),
            ((F.col("l_extendedprice") - 45000.0) / 10000.0).alias("ay"),
            (F.lit(9.80665) + (F.col("l_discount") - 0.05) * 20.0).alias("az"),
            ((F.col("l_tax") - 0.04) * 50.0).alias("gx"),
            ((F.col("l_linenumber") - 4) * 0.5).cast("double").alias("gy"),
            ((F.col("l_partkey") % 100 - 49.5) / 50.0).cast("double").alias("gz"),
        )

    @cached_property
    def sequences(self) -> DataFrame:
        return self._stored("sequences", self.build_sequences)

    def build_sequences(self) -> DataFrame:
        """One row per recording; lengths come from a map-side count, not from the samples."""
        counts = (
            self.read("lineitem")
            .groupBy(F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("flag"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        places = (
            self.read("supplier")
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("suppkey"),
                F.col("n_name").alias("dataset_id"),
                F.col("r_name").alias("body_location"),
            )
        )
        s, flag = F.col("suppkey"), F.col("flag")
        return counts.join(places, "suppkey").select(
            recording_id(s, flag).alias("recording_id"),
            "dataset_id",
            participant_id(s).alias("participant_id"),
            "body_location",
            "suppkey",
            "flag",
            "n",
            F.when(flag == "N", "recording").otherwise("temporal").alias("supervision_kind"),
            F.when(flag == "R", True).when(flag == "N", s % 4 == 0).otherwise(False).alias("is_fall"),
            fold_of(s).alias("fold_id"),
        )

    @cached_property
    def folds(self) -> DataFrame:
        """Split file: participants that have a fold (team participants have none)."""
        return self.participants.filter("fold_id >= 0")

    @cached_property
    def participants(self) -> DataFrame:
        return self.sequences.select("dataset_id", "participant_id", "fold_id").distinct()

    @cached_property
    def event_rows(self) -> DataFrame:
        return self._stored("event_rows", self.build_event_rows)

    def build_event_rows(self) -> DataFrame:
        """Strongest sample in each half of an R recording is the impact of one event.

        An arg-max aggregate, so a hot recording is reduced before the exchange.
        """
        lengths = self.sequences.select("recording_id", "n")
        candidates = self.samples.filter("flag = 'R'").select("recording_id", "sample_idx", "ax", "ay")
        candidates = candidates.join(lengths, "recording_id")
        i, half_at = F.col("sample_idx"), F.floor(F.col("n") / 2)
        inside = i.between(20, half_at - 25) | i.between(half_at + 20, F.col("n") - 25)
        energy = F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")
        best = (
            candidates.filter(inside)
            .groupBy("recording_id", F.when(i < half_at, 1).otherwise(2).alias("half"))
            .agg(F.max(F.struct(energy.alias("e"), (-i).alias("neg"))).alias("best"), F.max("n").alias("n"))
        )
        impact = -F.col("best.neg")
        return best.select(
            "recording_id",
            "half",
            "n",
            (impact - 15).alias("onset"),
            impact.alias("impact"),
            (impact + 20).alias("stop"),
            F.concat(F.lit("F0"), F.col("half").cast("string")).alias("code"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.event_rows.select("recording_id", "onset", "impact", "stop", "code")

    @cached_property
    def annotations(self) -> DataFrame:
        return self._stored("annotations", self.build_annotations)

    def build_annotations(self) -> DataFrame:
        """Interval and point annotations; R recordings end with five excluded samples."""
        pair = self.event_rows.groupBy("recording_id", "n").agg(
            *[
                F.max(F.when(F.col("half") == h, F.col(c))).alias(f"{c}{h}")
                for h in (1, 2)
                for c in ("onset", "impact", "stop")
            ]
        )

        def item(kind, start, stop, code):
            return F.struct(
                F.lit(kind).alias("kind"),
                start.cast("long").alias("start_sample"),
                stop.cast("long").alias("stop_sample"),
                F.lit(code).alias("code"),
            )

        end = F.col("n") - 5
        free = [(F.lit(0), F.col("onset1")), (F.col("stop1"), F.col("onset2")), (F.col("stop2"), end)]
        items = [item("activity", a, b, "ADL") for a, b in free]
        for h in (1, 2):
            onset, impact, stop = (F.col(f"{c}{h}") for c in ("onset", "impact", "stop"))
            items += [
                item("activity", onset, stop, f"F0{h}"),
                item("onset", onset, onset, f"F0{h}"),
                item("impact", impact, impact, f"F0{h}"),
            ]
        items.append(item("exclude", end, F.col("n"), "other"))
        falls = pair.select("recording_id", F.explode(F.array(*items)).alias("a")).select("recording_id", "a.*")
        falls = falls.filter("kind in ('onset', 'impact') or start_sample < stop_sample")
        daily = self.sequences.filter("flag = 'A'").select(
            "recording_id",
            F.lit("activity").alias("kind"),
            F.lit(0).cast("long").alias("start_sample"),
            F.col("n").cast("long").alias("stop_sample"),
            F.lit("ADL").alias("code"),
        )
        return falls.unionByName(daily)

    # -- collection tables as delivered, and copies with known faults -------

    @cached_property
    def collection(self) -> DataFrame:
        """Sequences with their sample ranges inside the dataset, in supplier order."""
        chunked = self.sequences.withColumn("_chunk", F.floor(F.col("suppkey") / 1024))
        before = offsets_before(chunked, ["dataset_id"], "_chunk", {"_before": F.col("n")})
        order = Window.partitionBy("dataset_id", "_chunk").orderBy("suppkey", "flag")
        local = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        placed = chunked.withColumn("_upto", local).join(before, ["dataset_id", "_chunk"])
        stop = F.col("_upto") + F.col("_before")
        return placed.select(
            *self.sequences.columns,
            F.concat(F.lit("act_"), "flag").alias("activity_code"),
            (stop - F.col("n")).alias("sample_start"),
            stop.alias("sample_stop"),
            F.lit(25.0).alias("source_sampling_rate_hz"),
        )

    @cached_property
    def faulty_sequences(self) -> DataFrame:
        s, flag = F.col("suppkey"), F.col("flag")
        at = lambda modulus, rest, f: (s % modulus == rest) & (flag == f)
        rate = F.when(at(19, 4, "N"), 0.0).when(at(23, 5, "R"), -25.0).otherwise(25.0)
        return self.collection.withColumns(
            {
                "body_location": F.when(s % 29 == 7, "").otherwise(F.col("body_location")),
                "is_fall": F.when(at(31, 8, "R"), ~F.col("is_fall")).otherwise(F.col("is_fall")),
                "supervision_kind": F.when(at(13, 6, "A"), "unknown").otherwise(F.col("supervision_kind")),
                "source_sampling_rate_hz": rate,
                "sample_start": F.col("sample_start") + F.when(at(17, 3, "A"), 1).otherwise(0),
            }
        )

    @cached_property
    def faulty_annotations(self) -> DataFrame:
        keyed = self.annotations.join(self.sequences.select("recording_id", "suppkey"), "recording_id")
        s, kind = F.col("suppkey"), F.col("kind")
        shift = lambda condition, by: F.when(condition, by).otherwise(0)
        far = shift((s % 7 == 2) & (kind == "impact"), 1000)
        late = shift((s % 9 == 1) & (kind == "activity") & (F.col("code") == "ADL"), 2)
        longer = shift((s % 7 == 3) & (kind == "onset"), 1) + shift((s % 13 == 5) & (kind == "exclude"), 3)
        order = F.when(kind == "activity", 0).when(kind == "onset", 1).when(kind == "impact", 2).otherwise(3)
        placed = ordered_positions(
            keyed.withColumn("kind_order", order),
            ["recording_id"],
            [F.col(c) for c in ("start_sample", "kind_order", "stop_sample", "code")],
            F.floor(F.col("start_sample") / 65536),
            "row_idx",
        )
        swapped = F.when(s % 5 == 2, F.col("row_idx").bitwiseXOR(F.lit(1).cast("long")))
        return placed.select(
            "recording_id",
            F.when((s % 37 == 9) & (kind == "exclude"), "skip").otherwise(kind).alias("kind"),
            (F.col("start_sample") + far + late).alias("start_sample"),
            (F.col("stop_sample") + far + longer).alias("stop_sample"),
            F.when((s % 11 == 4) & (kind == "activity"), "").otherwise(F.col("code")).alias("code"),
            F.coalesce(swapped, F.col("row_idx")).alias("row_idx"),
        )

    # -- windows ------------------------------------------------------------

    @cached_property
    def grid(self) -> DataFrame:
        """Window metadata with the attributes of its sequence; needs no samples."""
        keep = ["dataset_id", "participant_id", "body_location", "supervision_kind", "is_fall", "fold_id", "suppkey", "n"]
        return windows.start_grid(self.sequences, keep=keep)

    @cached_property
    def marked(self) -> DataFrame:
        """Every window with its labelling flags, before any window is dropped."""
        return labels.label_windows(labels.mark_windows(self.grid, self.events, self.annotations))

    def build_kept(self) -> DataFrame:
        """Surviving windows with their position among the survivors of the sequence."""
        columns = [
            "recording_id", "dataset_id", "participant_id", "body_location", "supervision_kind",
            "is_fall", "fold_id", "n", "win", "start_sample", "end_sample", "temporal_label", "bag_label",
        ]
        survivors = self.marked.filter("kept").select(*columns)
        return ordered_positions(
            survivors,
            ["recording_id"],
            [F.col("end_sample"), F.col("start_sample")],
            F.floor(F.col("end_sample") / 65536),
            hot=F.col("n") > HOT_ROWS,
        )

    @cached_property
    def impact(self) -> DataFrame:
        return windows.impact_scores(self.samples)

    def build_scored(self) -> DataFrame:
        """Surviving windows with both parts of the rule score."""
        return self.build_kept().join(self.impact, ["recording_id", "win"])

    @cached_property
    def scored(self) -> DataFrame:
        """The window store: one row per surviving window, partitioned by fold."""
        return self._stored("windows", self.build_scored, ["fold_id"])

    @property
    def features(self) -> DataFrame:
        """The 158 features of every labelled window; those without a fold only train."""
        with self._building:  # folds are fitted side by side and ask for it at once
            return self._features

    @cached_property
    def _features(self) -> DataFrame:
        return self._stored("features", self.build_features)

    def build_features(self) -> DataFrame:
        rows = self.scored.filter("temporal_label >= 0").select(
            "recording_id", "win", "dataset_id", "participant_id", "fold_id", F.col("temporal_label").alias("label")
        )
        return rows.join(window_features.feature_vectors(self.samples), ["recording_id", "win"])

    @cached_property
    def kept(self) -> DataFrame:
        return self.scored.drop("acc_part", "gyr_part", "impact_score")

    def job_scores(self, split: str | None = None) -> DataFrame:
        """Score shards: every job's validation and test windows.

        A window of fold f is tested by job fold f and validates job fold f-1, so the
        roles are an expansion of the row; nothing is joined.
        """
        labelled = self.scored.filter("temporal_label >= 0 and fold_id >= 0")
        return expand_jobs(labelled, split)

    @cached_property
    def scope(self) -> DataFrame:
        """Stored sequences (at least one complete window) that belong to a fold."""
        return self.sequences.filter("n >= 50 and fold_id >= 0")


def recording_id(suppkey, flag):
    return F.concat(F.lit("r"), suppkey.cast("string"), F.lit("_"), flag)


def participant_id(suppkey):
    return F.concat(F.lit("p"), suppkey.cast("string"))


def fold_of(suppkey):
    return F.when(suppkey % 11 == 0, -1).otherwise(suppkey % 5).cast("int")


def expand_jobs(labelled: DataFrame, split: str | None = None) -> DataFrame:
    """Explode labelled windows into score rows, one per job that tests or validates them."""
    jobs = []
    for model, recipe, seed, acc, gyr, offset in SCORERS:
        base = F.col("acc_part") * acc + F.col("gyr_part") * gyr
        score = base if offset is None else base / (base + offset)
        jobs.append(
            F.struct(
                F.lit(model).alias("model_id"),
                F.lit(recipe).alias("recipe"),
                F.lit(seed).alias("seed"),
                score.cast("float").cast("double").alias("score"),
            )
        )
    roles = {
        "test": F.struct(F.lit("test").alias("split"), F.col("fold_id").alias("fold")),
        "validation": F.struct(
            F.lit("validation").alias("split"),
            ((F.col("fold_id") + (FOLD_COUNT - 1)) % FOLD_COUNT).alias("fold"),
        ),
    }
    wanted = [v for k, v in roles.items() if split in (None, k)]
    columns = [
        "recording_id", "dataset_id", "participant_id", "body_location", "is_fall", "n", "win",
        "start_sample", "end_sample", "pos",
    ]
    return (
        labelled.select(*columns, F.col("temporal_label").alias("label"), F.explode(F.array(*jobs)).alias("j"), F.array(*wanted).alias("rs"))
        .select(*columns, "label", "j.*", F.explode("rs").alias("r"))
        .select("model_id", "recipe", "r.fold", "seed", "r.split", *columns, "label", "score")
    )
