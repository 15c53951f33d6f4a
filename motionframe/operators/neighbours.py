"""Exact k nearest neighbours by pivot cells.

Reference vectors fall into the cell of their nearest pivot (a fixed number of vectors).
A query first searches its own cell; the k-th distance found there and the triangle
inequality then rule out every cell that cannot hold a closer vector. Cells are cut into
blocks of bounded size, so a crowded cell is many tasks, and a block returns at most k
rows per query: pairs are never emitted and no candidate is dropped.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.functions import pandas_udf

from motionframe.functions.exprs import hash_draw

PIVOTS = 16
REFERENCE_BLOCK = 8192
QUERY_BLOCK = 8192
#: Queries that one matrix product serves, and candidates measured at a time.
TILE = 256
CANDIDATES = 65_536
MATCH = "q_id long, r_id long, label int, distance double"


def _pivot_distances(pivots: np.ndarray):
    @pandas_udf(T.ArrayType(T.DoubleType()))
    def distances(features: pd.Series) -> pd.Series:
        values = np.stack(features.to_numpy()).astype(np.float64)
        gaps = values[:, None, :] - pivots[None, :, :]
        return pd.Series(list(np.sqrt((gaps**2).sum(axis=2))))

    return distances


def _cell(distances: str):
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def _closest(vectors, stored, norms, ids, k):
    """Places (query, reference) and distances of the k closest of ``stored`` to each vector, ties by id.

    A matrix product tells the distances up to its rounding; all references that this leaves open are
    measured exactly."""
    own = (vectors**2).sum(axis=1)
    rough = own[:, None] + norms[None, :] - 2.0 * (vectors @ stored.T)
    slack = 16 * vectors.shape[1] * np.finfo(float).eps * (own + norms.max())
    at = min(k, len(stored)) - 1
    limit = np.partition(rough, at, axis=1)[:, at] + slack
    row, place = np.nonzero(~(rough > limit[:, None]))  # what is not a number is measured too
    exact = np.empty(len(row))
    for a in range(0, len(row), CANDIDATES):
        part = slice(a, a + CANDIDATES)
        exact[part] = np.sqrt(((stored[place[part]] - vectors[row[part]]) ** 2).sum(axis=1))
    order = np.lexsort((ids[place], exact, row))
    row, place, exact = row[order], place[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], place[rank < k], exact[rank < k]


def _search(visits: DataFrame, references: DataFrame, blocks: dict, chunks: int, k: int) -> DataFrame:
    """Best k matches per query within each visited block."""
    sizes = F.create_map(*[F.lit(v) for pair in blocks.items() for v in pair])
    each = visits.withColumn("block", F.explode(F.sequence(F.lit(0), sizes[F.col("cell")] - 1))).withColumn(
        "chunk", (hash_draw("chunk", F.col("q_id")) % chunks).cast("int")
    )
    held = references.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def match(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(queries) and len(refs):
            stored = np.stack(refs["features"].to_numpy()).astype(np.float64)
            ids, labels = refs["r_id"].to_numpy(), refs["label"].to_numpy()
            norms = (stored**2).sum(axis=1)
            for first in range(0, len(queries), TILE):
                own = queries.iloc[first : first + TILE]
                vectors = np.stack(own["features"].to_numpy()).astype(np.float64)
                row, found, distance = _closest(vectors, stored, norms, ids, k)
                parts.append(pd.DataFrame({"q_id": own["q_id"].to_numpy()[row], "r_id": ids[found], "label": labels[found], "distance": distance}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["q_id", "r_id", "label", "distance"])

    keys = ["cell", "block", "chunk"]
    return each.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(match, MATCH)


def _best(matches: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_id").orderBy("distance", "r_id")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(q_id, r_id, label, distance, rank) for ``queries`` (q_id, features) against
    ``references`` (r_id, features, label)."""
    chosen = references.orderBy(F.md5(F.col("r_id").cast("string")), "r_id").limit(PIVOTS).select("features").collect()
    pivots = np.asarray([r["features"] for r in chosen], dtype=np.float64)
    distances = _pivot_distances(pivots)
    placed = references.withColumn("d", distances("features")).withColumns({"cell": _cell("d"), "own": F.array_min("d")})
    cells = placed.groupBy("cell").agg(F.max("own").alias("radius"), F.count(F.lit(1)).alias("size")).collect()
    radius = {r["cell"]: r["radius"] for r in cells}
    blocks = {r["cell"]: -(-r["size"] // REFERENCE_BLOCK) for r in cells}
    count = F.create_map(*[F.lit(v) for pair in blocks.items() for v in pair])
    held = placed.select(
        "r_id", "features", "label", "cell", (hash_draw("block", F.col("r_id")) % count[F.col("cell")]).cast("int").alias("block")
    )
    chunks = -(-queries.count() // QUERY_BLOCK)
    asked = queries.withColumn("d", distances("features")).withColumn("home", _cell("d"))
    first = _best(_search(asked.select("q_id", "features", F.col("home").alias("cell")), held, blocks, chunks, k), k)
    bound = first.filter(F.col("rank") == k).select("q_id", F.col("distance").alias("bound"))
    open_cells = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("home") != c) & (F.col("bound").isNull() | (F.col("d")[c] - radius[c] <= F.col("bound"))), F.lit(c)
                )
                for c in radius
            ]
        )
    )
    more = asked.join(bound, "q_id", "left").select("q_id", "features", F.explode(open_cells).alias("cell"))
    rest = _search(more, held, blocks, chunks, k)
    return _best(first.drop("rank").unionByName(rest), k)


def vote(matches: DataFrame) -> DataFrame:
    """Distance-weighted share of label 1; exact matches decide alone when there are any."""
    exact = F.max((F.col("distance") == 0).cast("int")).alias("exact")
    flags = matches.groupBy("q_id").agg(exact)
    weight = F.when(F.col("exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(
        F.try_divide(F.lit(1.0), F.col("distance"))
    )
    weighted = matches.join(flags, "q_id").withColumn("w", weight)
    return weighted.groupBy("q_id").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("score"))
