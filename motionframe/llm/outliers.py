"""Quality rules with robust multivariate outliers (operator 5).

Each document has counts of words, characters, symbols, repeated lines and repeated three-word
windows. Rows that fail the base rules go. For the others the counts become a vector of five
transformed statistics, and each language and source has a minimum-covariance-determinant
estimate: from several deterministic starts, concentration steps keep the ``SUPPORT`` share of
rows nearest to the centre, take their mean and covariance, and start again; the start with the
smallest determinant wins. A document whose squared Mahalanobis distance from its group's
estimate exceeds ``CUTOFF`` is rejected.

Everything is DataFrame expressions. A step is two aggregations with partial sums: moments of the
kept rows (count, 5 sums, 15 products per group), and a histogram of distances per group in
``BINS_PER_E`` bins for each factor e, whose running count gives the radius. The inverse of a
covariance is a Cholesky factor written as columns of the group's row. Rows are never gathered by
group, so a source with a third of them is no different. The covariance of the nearest rows is scaled
to be that of all (``CONSISTENCY``). Where a statistic hardly varies in a group its variance is raised
to ``FLOOR`` squared, so that no covariance is singular and one odd line does not reject a text; where
it varies more, the estimate alone decides.

Groups of fewer than ``LEAST_ROWS`` rows are estimated together with the others of their
language; if these are too few as well, with those of all languages; and if these are too few,
they are kept.

Cases: null, empty and blank texts have no words and fail the base rules; null languages and
sources are groups of their own; repeated rows and ties are judged alike; no rows give no rows.
Windows are told apart by 64-bit hashes within one text.
"""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionframe.llm import common

LEAST_WORDS = 50
MOST_REPEATED = 50
STATISTICS = ("s1", "s2", "s3", "s4", "s5")
#: The least standard deviation of each statistic, in its own unit; larger estimates stay as they are.
FLOOR = (0.5, 0.05, 0.03, 0.5, 0.12)
SUPPORT = 0.75
#: The covariance of the nearest three quarters of a normal group is too small by this factor
#: (0.75 over the chi-square distribution with seven degrees of freedom at the 75 % point of five).
CONSISTENCY = 1.41207
STEPS = 4
BINS_PER_E = 16
LEAST_ROWS = 100
#: The 99.9 % point of chi-square with five degrees of freedom.
CUTOFF = 20.515


def repeated_words(words):
    """Words that lie in a three-word window which the text has at least twice."""

    def covered(hashes):
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(pairs):
            hash_at = lambda k: F.get(pairs, k)["h"]
            same = lambda p, k: (p["h"] == hash_at(k + 1)) | ((k > 0) & (p["h"] == hash_at(F.greatest(k - 1, F.lit(0)))))
            marked = F.transform(pairs, lambda p, k: F.when(same(p, k), p["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        def width(found):
            before = lambda k: F.get(found, F.greatest(k - 1, F.lit(0)))
            steps = F.transform(found, lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - before(k))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return common.let(ranked, lambda pairs: common.let(places(pairs), width))

    def count(w):
        spots = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(spots, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        none = F.lit(0).cast("long")
        judged = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))
        return F.when(F.size(w) < 4, none).otherwise(common.let(hashes, judged))

    return common.let(words, count)


def counts(docs):
    """doc_id, lang, source and the base counts of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.SPACES)) != "")
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", text.alias("text"), common.words(text).alias("words"), lines.alias("lines"))
    return worded.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistics(rows):
    """The transformed vector: logarithms of sizes, square roots of shares."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    made = (
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        F.log1p("n_dup_lines"),
        share("n_repeat_words", "n_words"),
    )
    return rows.withColumns(dict(zip(STATISTICS, made)))


def grouped(spark, rows, least=LEAST_ROWS):
    """Add ``grp``: language and source, or the wider group where these have too few rows."""
    own = F.to_json(F.struct("lang", "source"))
    wide = F.to_json(F.struct("lang"))
    keyed = rows.withColumn("own", own).withColumn("wide", wide)
    sizes = keyed.groupBy("own", "wide").agg(F.count("*").alias("n"))
    pooled = sizes.withColumn("grp", F.when(F.col("n") >= least, F.col("own")))
    rest = pooled.filter("grp is null").groupBy("wide").agg(F.sum("n").alias("n_rest"))
    pooled = pooled.join(rest, "wide", "left")
    pooled = pooled.withColumn("grp", F.coalesce("grp", F.when(F.col("n_rest") >= least, F.col("wide")).otherwise("all")))
    return keyed.join(common.written(spark, pooled.select("own", "grp"), "op5-groups"), "own").drop("own", "wide")


def moments(kept, keys):
    """Mean and Cholesky factor of the scaled covariance, with floors, per group; ``logdet``."""
    pairs = [(i, j) for i in range(5) for j in range(i + 1)]
    sums = [F.avg(s).alias(f"m{i}") for i, s in enumerate(STATISTICS)]
    products = [F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"c{i}{j}") for i, j in pairs]
    out = kept.groupBy(*keys).agg(F.count("*").alias("held"), *sums, *products)
    for i, j in pairs:
        below = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
        value = CONSISTENCY * F.col(f"c{i}{j}")
        value = F.greatest(value, F.lit(FLOOR[i] ** 2)) if i == j else value
        value = reduce(lambda a, b: a - b, below, value)
        out = out.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    logdet = reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l{i}{i}")) for i in range(5)])
    factor = [f"l{i}{j}" for i, j in pairs]
    return out.select(*keys, "held", *[f"m{i}" for i in range(5)], *factor, logdet.alias("logdet"))


def with_distance(rows):
    """Add ``d2``, the squared Mahalanobis distance, by forward substitution."""
    for i in range(5):
        known = [F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)]
        rows = rows.withColumn(f"y{i}", reduce(lambda a, b: a - b, known, F.col(STATISTICS[i]) - F.col(f"m{i}")) / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"y{k}") * F.col(f"y{k}") for k in range(5)]))


def _bin(distance):
    return F.floor(F.log(distance + 1e-6) * BINS_PER_E)


def radius(rows, keys, support):
    """Upper edge of the distance bin in which the ``support`` share of a group's rows is full."""
    bins = rows.groupBy(*keys, _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin")
    run = bins.withColumn("run", F.sum("n").over(upto)).withColumn("of", F.sum("n").over(Window.partitionBy(*keys)))
    return run.filter(F.col("run") >= support * F.col("of")).groupBy(*keys).agg(F.min("bin").alias("last_bin"))


def estimates(spark, rows, support=SUPPORT, steps=STEPS):
    """The chosen estimate of each group: grp, mean, factor, logdet."""
    keys = ["grp", "start"]
    medians = [F.percentile_approx(s, 0.5, 1000).alias(f"q{i}") for i, s in enumerate(STATISTICS)]
    spread = [F.percentile_approx(s, [0.25, 0.75], 1000).alias(f"r{i}") for i, s in enumerate(STATISTICS)]
    centre = common.written(spark, rows.groupBy("grp").agg(*medians, *spread), "op5-medians")
    scaled = [F.abs(F.col(s) - F.col(f"q{i}")) / (F.col(f"r{i}")[1] - F.col(f"r{i}")[0] + FLOOR[i]) for i, s in enumerate(STATISTICS)]
    # starts: near the medians in every statistic together, in the worst one, and in the shares alone
    firsts = [reduce(lambda a, b: a + b, [x * x for x in scaled]), F.greatest(*scaled), scaled[2] + scaled[3] + scaled[4]]
    ways = F.array(*[F.struct(F.lit(k).alias("start"), d.alias("d2")) for k, d in enumerate(firsts)])
    near = rows.join(centre, "grp").select("grp", *STATISTICS, F.inline(ways))
    for step in range(steps + 1):
        edge = common.written(spark, radius(near, keys, support), "op5-radius")
        kept = near.join(edge, keys).filter(_bin(F.col("d2")) <= F.col("last_bin"))
        found = common.written(spark, moments(kept, keys), "op5-moments")
        if step < steps:
            tripled = rows.select("grp", *STATISTICS, F.explode(F.array(*map(F.lit, range(len(firsts))))).alias("start"))
            near = with_distance(tripled.join(found, keys)).select("grp", "start", *STATISTICS, "d2")
    best = found.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    return found.join(best, keys).drop("start")


def judge(spark, docs, cutoff=CUTOFF, support=SUPPORT, steps=STEPS, least=LEAST_ROWS):
    """Base counts, base_failed, distance (null where it is not judged) and kept of every row."""
    rows = common.written(spark, counts(docs).withColumn("base_failed", base_failed()), "op5-counts")
    passed = grouped(spark, statistics(rows.filter(~F.col("base_failed"))), least)
    passed = common.written(spark, passed, "op5-vectors")
    chosen = estimates(spark, passed, support, steps).filter(F.col("held") >= support * least / 2)
    judged = with_distance(passed.join(chosen, "grp", "left"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = judged.select(*columns, F.col("d2").alias("distance"), F.coalesce(F.col("d2") <= cutoff, F.lit(True)).alias("kept"))
    bad = rows.filter("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.unionByName(bad)
