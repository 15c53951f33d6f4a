"""Centroid clustering with ns-bounds (operator 11).

Lloyd's rounds over integer vectors, exact throughout. For every vector and centroid the last
evaluated squared distance is stored with the round of that evaluation. The centroids of all
rounds are retained, so a stored distance is loosened by the norm of the centroid's total
displacement since its evaluation: one norm, at most the sum of the drifts of the rounds between
and often far less. Where the loosened lower bound of a centroid stays above the loosened upper
bound of the vector's own, its distance is not computed; the others are rescanned exactly in
64-bit integers, ties going to the smaller number.

A round writes one table (vector, own centroid, stored distances and their rounds); the one before
is dropped when its successor is complete. The sums of a round change only by the vectors that
moved, so only those are read again. The driver holds the history of centroids and one sum per
centroid: ``(rounds + 1) * k * dimension`` numbers, whatever the number of vectors.

Cases: a vector of another length, with a null or non-finite component, or null itself, is left
out; fewer vectors than centroids give fewer centroids, none give no rows; repeated rows are
vectors each; a null vec_id comes last as a start, ties of the start hash go by the components;
an empty centroid stays where it is. A component beyond ``LARGEST`` units raises an error, as
exact squared distances would pass 64 bits.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from motionframe.llm import common

DIMENSION = 64
K = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Largest component: 64 squared differences of twice that fit in 63 bits.
LARGEST = (1 << 27) - 1
#: Room for the rounding of square roots and of their sums.
SLACK = 1e-9
STATE = "vec_id long, units array<int>, seen array<long>, at array<smallint>, cluster int, moved boolean, old int"


def integers(vectors, dimension=DIMENSION, scale=SCALE):
    """vec_id and units (whole numbers) of the usable rows of ``vectors`` (vec_id, embedding)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter(F.col("embedding").isNotNull()).filter((F.size("embedding") == dimension) & finite)
    unit = lambda x: F.floor(F.lit(scale) * x.cast("double"))
    large = F.exists("embedding", lambda x: F.abs(F.lit(scale) * x.cast("double")) > LARGEST)
    checked = F.when(large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.col("embedding"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(checked, lambda x: unit(x).cast("int")).alias("units"))


def starts(rows, k=K, seed=SEED):
    """The first centroids: the ``k`` rows of smallest hash, as an array."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "units").limit(k).select("units").collect()
    return np.array([r["units"] for r in first], np.int64)


def squared(vectors, centroids):
    """Exact squared distances of rows to one centroid or row by row."""
    apart = vectors - centroids
    return np.einsum("ij,ij->i", apart, apart)


def displacements(history):
    """[round, centroid]: distance from the centroid's place in that round to its last one."""
    apart = (history - history[-1]).astype(np.float64)
    return np.sqrt((apart * apart).sum(2)) * (1 + SLACK)


def rescan(vectors, seen, at, own, history):
    """One assignment by bounds: (seen, at, own, evaluated distances), the arrays updated in place."""
    now, rows = len(history) - 1, np.arange(len(vectors))
    centroids = history[-1]
    loosened = displacements(history)[at, np.arange(len(centroids))]
    known = np.sqrt(seen.astype(np.float64))
    upper = (known * (1 + SLACK) + loosened)[rows, own]
    lower = known * (1 - SLACK) - loosened
    rivals = lower <= upper[:, None]
    rivals[rows, own] = False
    failing = np.flatnonzero(rivals.any(1))
    # the own distance first: it tightens the upper bound, so fewer rivals are left
    seen[failing, own[failing]] = squared(vectors[failing], centroids[own[failing]])
    at[failing, own[failing]] = now
    tight = np.sqrt(seen[failing, own[failing]].astype(np.float64)) * (1 + SLACK)
    rivals = rivals[failing] & (lower[failing] <= tight[:, None])
    candidates = np.full(rivals.shape, np.iinfo(np.int64).max)
    candidates[np.arange(len(failing)), own[failing]] = seen[failing, own[failing]]
    for j in range(len(centroids)):
        some = np.flatnonzero(rivals[:, j])
        candidates[some, j] = squared(vectors[failing[some]], centroids[j])
        seen[failing[some], j], at[failing[some], j] = candidates[some, j], now
    own[failing] = candidates.argmin(1)  # the first of equals is the smallest number
    return seen, at, own, len(failing) + int(rivals.sum())


def _matrix(column, kind):
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1)


def _lists(matrix, kind):
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel().astype(kind)))


def _state(batch, seen, at, own, old):
    columns = [batch.column("vec_id"), batch.column("units"), _lists(seen, np.int64), _lists(at, np.int16)]
    columns += [pa.array(own.astype(np.int32)), pa.array(own != old), pa.array(old.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "units", "seen", "at", "cluster", "moved", "old"])


def _first(centroids):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch.column("units"), np.int64)
            seen = np.stack([squared(vectors, c) for c in centroids], 1)
            own = seen.argmin(1)
            yield _state(batch, seen, np.zeros(seen.shape, np.int16), own, np.full(len(own), -1))

    return run


def _again(history):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            vectors, old = _matrix(batch.column("units"), np.int64), batch.column("cluster").to_numpy().astype(np.int64)
            seen, at = _matrix(batch.column("seen"), np.int64), _matrix(batch.column("at"), np.int16)
            seen, at, own, _ = rescan(vectors, seen, at, old.copy(), history)
            yield _state(batch, seen, at, own, old)

    return run


def _changes(k, dimension):
    """mapInArrow function: per task and centroid, what moved vectors add to count and sums."""

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("units"), np.int64)
            own, old = (batch.column(c).to_numpy() for c in ("cluster", "old"))
            for j in range(k):
                sums[j] += vectors[own == j].sum(0) - vectors[old == j].sum(0)
                count[j] += (own == j).sum() - (old == j).sum()
        made = [pa.array(np.arange(k, dtype=np.int32)), pa.array(count), _lists(sums, np.int64)]
        yield pa.RecordBatch.from_arrays(made, ["cluster", "n", "sums"])

    return run


def _moved_sums(state, k, dimension):
    parts = state.filter("moved").select("units", "cluster", "old").mapInArrow(_changes(k, dimension), "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dimension)]).alias("sums"))
    count, sums = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
    for row in totals.collect():  # k rows
        count[row["cluster"]], sums[row["cluster"]] = row["n"], row["sums"]
    return count, sums


def fit(spark, rows, k=K, rounds=ROUNDS, seed=SEED):
    """(state table, history of centroids) after ``rounds`` rounds and a last assignment; None for
    the table where there are no vectors. ``rows``: vec_id, units."""
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return None, centroids
    k, dimension = centroids.shape
    history = centroids[None]
    path = common.new_path(spark, "op11-state")
    state = common.kept(spark, rows.mapInArrow(_first(centroids), STATE), path)
    count, sums = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
    for _ in range(rounds):
        n, more = _moved_sums(state, k, dimension)
        count, sums = count + n, sums + more
        filled = count > 0
        centroids = history[-1].copy()
        centroids[filled] = sums[filled] // count[filled, None]  # rounds down, below zero as well
        if (centroids == history[-1]).all():
            break  # no centroid moves, so no later round changes anything
        history = np.concatenate([history, centroids[None]])
        before, path = path, common.new_path(spark, "op11-state")
        state = common.kept(spark, state.mapInArrow(_again(history), STATE), path)
        common.dropped(spark, before)
    return state, history


def _distances(centroids):
    def run(batches):
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            made = squared(_matrix(batch.column("units"), np.int64), centroids[own]) if len(own) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(made)], ["vec_id", "cluster", "distance"])

    return run


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clusters(spark, vectors, dimension=DIMENSION, k=K, rounds=ROUNDS, scale=SCALE, seed=SEED):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row."""
    rows = common.written(spark, integers(vectors.select("vec_id", "embedding"), dimension, scale), "op11-vectors")
    state, history = fit(spark, rows, k, rounds, seed)
    if state is None:
        return spark.createDataFrame([], OUT)
    found = state.select("vec_id", "units", "cluster").mapInArrow(_distances(history[-1]), "vec_id long, cluster int, distance long")
    found = common.written(spark, found, "op11-distances")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    facts = [(j, sums[j], sum(sums.values()), names[j]) for j in sums]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in OUT.split(", ")])


def twin_sql(dimension=DIMENSION, k=K, rounds=ROUNDS, scale=SCALE, seed=SEED):
    """The same in SQL: every distance of every round."""
    apart = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.u[i] - c.u[i]) * (v.u[i] - c.u[i])))::BIGINT".format(d=dimension)
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS u
  FROM embeddings WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), u) - 1 AS j, u FROM v
  ORDER BY sha256('{seed}:' || vec_id), u LIMIT {k})""",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"""a{t} AS MATERIALIZED (SELECT i, min(d) AS d, min(j) FILTER (d = least_d) AS j FROM (SELECT v.i, c.j, {apart} AS d,
    min({apart}) OVER (PARTITION BY v.i) AS least_d FROM v, c{t} c) GROUP BY i)"""
        )
        if t < rounds:
            parts.append(
                f"""s{t} AS MATERIALIZED (SELECT j, p, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT a.j, unnest(v.u) AS x, unnest(range(1, {dimension} + 1)) AS p
    FROM v JOIN a{t} a USING (i)) GROUP BY j, p),
m{t} AS MATERIALIZED (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS u FROM s{t} GROUP BY j),
c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.u, c.u) AS u FROM c{t} c LEFT JOIN m{t} m USING (j))"""
            )
    last = rounds
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, a.j::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.u, ',')) AS centroid_sha256
FROM a{last} a JOIN v USING (i) JOIN c{last} c ON c.j = a.j"""
    )
