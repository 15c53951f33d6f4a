"""Gradient-boosted trees of several folds: folds that fit a task are fitted whole there, larger ones by
histograms over all rows.

Objective as in the original: logistic loss, second-order gains with an L2 term of ``LAMBDA``, a least
hessian of ``LEAST_CHILD`` in a child, rows and columns drawn anew for each tree. Every draw is a hash and
gradients are whole multiples of ``1 / UNIT``, so sums are exact and the trees depend neither on the
partitioning nor on where a fold is fitted. The rounds follow one another: a fold of at most ``TASK_ROWS``
training rows runs all of them in one task; of a larger one, Spark sums the histograms of a level over all
rows, and only the splits reach the driver. Trees are arrays of a fixed size.
"""

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.operators.forest import _binned, _flags, _mixed, _salt, _thresholds
from motionframe.operators.logistic import _matrix

#: Training rows of a fold that a task may fit by itself: a byte a feature each, as much again for the pairs of a round.
TASK_ROWS = 2_000_000
#: Rows that meet the histograms at a time, so that their cells stay in the cache.
CHUNK = 131_072
LAMBDA = 1.0
LEAST_CHILD = 1.0
LEAST_GAIN = 1e-6
UNIT = 2.0**24
#: Rounds after which the margins of a large fold are taken anew from the trees, which bounds their lineage.
RENEWED = 40


class Tree(NamedTuple):
    """Splits in heap order (node k has the children 2k and 2k + 1), and what each last node adds to the margin."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


class Fitted(NamedTuple):
    cuts: list
    base: float
    trees: list


def _drawn(key: np.ndarray, seed: int, fold: int, turn: int, share: float) -> np.ndarray:
    """Whether the tree of a round holds each row."""
    return (_mixed(_mixed(key ^ _salt(seed, fold, turn, 3))) >> np.uint64(11)) / 2.0**53 < share


def _columns(width: int, seed: int, fold: int, turn: int, share: float) -> np.ndarray:
    """Ascending features of the tree of a round."""
    draws = _mixed(np.arange(width, dtype=np.uint64) ^ _salt(seed, fold, turn, 4))
    return np.sort(np.argsort(draws, kind="stable")[: max(1, int(width * share))])


def _slopes(margin: np.ndarray, label: np.ndarray):
    """Gradient and hessian of the logistic loss in whole units."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - label) * UNIT), np.rint(p * (1.0 - p) * UNIT)


def _joined(bins, columns, size):
    """Joint bins of every two columns; of an odd number the last stays out."""
    return [bins[a].astype(np.uint16) * np.uint16(size) + bins[b] for a, b in zip(columns[::2], columns[1::2])]


def _sums(bins, rows, place, slopes, columns, nodes, size, joint=None):
    """Sums (node, column, bin, gradient or hessian) of ``rows`` lying at node ``place`` each; ``bins`` is by feature.

    Many rows are summed by joint bins of two columns, which takes half the passes and gives the same: sums are exact."""
    out = np.zeros((nodes, len(columns), size, 2))
    paired = len(columns) // 2 * 2 if len(rows) >= 2 * nodes * size**2 else 0
    joint = (_joined(bins, columns, size) if joint is None else joint) if paired else []
    both = np.zeros((len(joint), 2, nodes * size**2))
    for a in range(0, len(rows), CHUNK):
        part = rows[a : a + CHUNK]
        weights = [s[part] for s in slopes]
        if paired:
            first, cell = place[a : a + CHUNK] * size**2, np.empty(len(part), dtype=np.int64)
            for k, pair in enumerate(joint):
                np.add(first, pair.take(part), out=cell)
                for which, weight in enumerate(weights):
                    both[k, which] += np.bincount(cell, weight, nodes * size**2)
        first = place[a : a + CHUNK] * size
        for k in range(paired, len(columns)):
            cell = first + bins[columns[k]].take(part)
            for which, weight in enumerate(weights):
                out[:, k, :, which] += np.bincount(cell, weight, nodes * size).reshape(nodes, size)
    both = both.reshape(len(joint), 2, nodes, size, size)
    out[:, 0:paired:2] = both.sum(axis=4).transpose(2, 0, 3, 1)
    out[:, 1:paired:2] = both.sum(axis=3).transpose(2, 0, 3, 1)
    return out


def _best(sums: np.ndarray, columns: np.ndarray):
    """(feature, cut, totals left, totals right) of the best split of each node; feature -1 where none gains."""
    below = sums.cumsum(axis=2) / UNIT
    whole = below[:, 0, -1]
    left = below[:, :, :-1]
    right = whole[:, None, None] - left
    strength = lambda t: t[..., 0] ** 2 / (t[..., 1] + LAMBDA)
    gain = strength(left) + strength(right) - strength(whole)[:, None, None]
    flat = np.where((left[..., 1] >= LEAST_CHILD) & (right[..., 1] >= LEAST_CHILD), gain, -np.inf).reshape(len(sums), -1)
    at = flat.argmax(axis=1)
    each = np.arange(len(sums))
    slot, cut = np.divmod(at, sums.shape[2] - 1)
    return np.where(flat[each, at] > LEAST_GAIN, columns[slot], -1), cut, left[each, slot, cut], right[each, slot, cut]


class _Grower:
    """A tree in the making, level by level. A node that is not split sends its rows to the left with its value."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature, self.cut = np.zeros(1 << depth, dtype=np.int64), np.full(1 << depth, 255, dtype=np.int64)
        self.totals = {}
        self.open = [1]

    def split(self, found: dict) -> None:
        """``found``: open node -> (feature, cut, totals left, totals right)."""
        following = []
        for node in self.open:
            feature, cut, left, right = found[node]
            if feature < 0:
                continue
            self.feature[node], self.cut[node] = feature, cut
            self.totals[2 * node], self.totals[2 * node + 1] = left, right
            following += [2 * node, 2 * node + 1]
        self.open = [n for n in following if n < 1 << self.depth]

    def tree(self, rate: float) -> Tree:
        value = np.zeros(2 << self.depth)
        for node in range(2, 2 << self.depth):
            if node in self.totals:
                g, h = self.totals[node]
                value[node] = -rate * g / (h + LAMBDA)
            else:
                value[node] = value[node // 2]
        return Tree(self.feature, self.cut, value[1 << self.depth :])


def _nodes(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Node of each row (or of ``rows``) after so many levels; ``bins`` is by feature."""
    each = np.arange(bins.shape[1]) if rows is None else rows
    node = np.ones(len(each), dtype=np.int64)
    for _ in range(levels):
        node = _below(bins, each, node, feature, cut)
    return node


def _below(bins, rows, node, feature, cut):
    """The children that ``rows`` of each ``node`` fall into."""
    return 2 * node + (bins.ravel().take(feature[node] * bins.shape[1] + rows) > cut[node])


def _added(bins: np.ndarray, tree: Tree, depth: int, rows: np.ndarray | None = None) -> np.ndarray:
    return tree.value[_nodes(bins, tree.feature, tree.cut, depth, rows) - (1 << depth)]


def _grown_here(bins, label, key, base, seed, fold, rounds, depth, rate, shares, size) -> list[Tree]:
    """All trees of a fold whose rows are here. Of two children the one with fewer rows is summed, the other is the rest."""
    margin, trees = np.full(len(label), base), []
    for turn in range(rounds):
        columns, drawn = _columns(len(bins), seed, fold, turn, shares[1]), _drawn(key, seed, fold, turn, shares[0])
        rows, rest, slopes = np.flatnonzero(drawn), np.flatnonzero(~drawn), _slopes(margin, label)
        joint = _joined(bins, columns, size) if len(rows) >= 2 * size**2 else None
        grower, node = _Grower(depth), np.ones(len(rows), dtype=np.int64)
        known = {1: _sums(bins, rows, np.zeros(len(rows), dtype=np.int64), slopes, columns, 1, size, joint)[0]}
        levels = 0
        while grower.open:
            nodes = grower.open
            if nodes[0] > 1:
                count = np.bincount(node, minlength=2 << depth)
                fewer = [a if count[a] <= count[a + 1] else a + 1 for a in nodes[::2]]
                spot = np.full(2 << depth, -1)
                spot[fewer] = np.arange(len(fewer))
                place = spot[node]
                mine = np.flatnonzero(place >= 0)
                made = _sums(bins, rows[mine], place[mine], slopes, columns, len(fewer), size, joint)
                known = {**dict(zip(fewer, made)), **{a ^ 1: known[a // 2] - one for a, one in zip(fewer, made)}}
            found = _best(np.stack([known[a] for a in nodes]), columns)
            grower.split(dict(zip(nodes, zip(*found))))
            node, levels = _below(bins, rows, node, grower.feature, grower.cut), levels + 1
        trees.append(grower.tree(rate))
        margin[rows] += trees[-1].value[(node << (depth - levels)) - (1 << depth)]
        margin[rest] += _added(bins, trees[-1], depth, rest)
    return trees


def _packed(held: DataFrame, cuts: dict, chosen: Sequence[int]) -> DataFrame:
    """Blocks of training rows of the ``chosen`` folds: bins by feature, labels and keys as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, train = _matrix(batch, "features"), _flags(batch, "train")
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint8)
            key = batch.column("draw").to_numpy().astype(np.int64)
            for fold in chosen:
                own = np.flatnonzero(train[:, fold])
                if len(own):
                    bins = np.ascontiguousarray(_binned(x[own], cuts, fold).T)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([fold], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (bins, label[own], key[own])]],
                        ["fold", "bins", "label", "draw"],
                    )

    return held.select("features", "label", "draw", "train").mapInArrow(run, "fold int, bins binary, label binary, draw binary")


def _opened(bins: bytes, label: bytes, draw: bytes):
    label = np.frombuffer(label, np.uint8)
    return np.frombuffer(bins, np.uint8).reshape(-1, len(label)), label, np.frombuffer(draw, np.int64).astype(np.uint64)


def _dealt(blocks: DataFrame, chosen: Sequence[int]) -> DataFrame:
    """A task a fold: by number, as by hash two folds would share one while another has none."""
    places = F.create_map(*[F.lit(v) for pair in zip(chosen, range(len(chosen))) for v in pair])
    return blocks.repartitionById(len(chosen), places[F.col("fold")])


def _fitted_in_tasks(held, cuts, chosen, bases, seed, rounds, depth, rate, shares, size) -> dict[int, list[Tree]]:
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}
        for batch in batches:
            for fold, *block in zip(batch.column("fold").to_pylist(), *(batch.column(c) for c in ("bins", "label", "draw"))):
                parts.setdefault(fold, []).append(_opened(*(v.as_buffer() for v in block)))
        for fold in sorted(parts):
            bins, label, draw = (np.concatenate(p, axis=-1) for p in zip(*parts.pop(fold)))
            trees = _grown_here(bins, label, draw, bases[fold], seed, fold, rounds, depth, rate, shares, size)
            arrays = [pa.array([a.tolist() for a in column]) for column in zip(*trees)]
            yield pa.RecordBatch.from_arrays([pa.array([fold] * rounds, pa.int32()), pa.array(range(rounds), pa.int32()), *arrays], ["fold", "turn", *Tree._fields])

    rows = _dealt(_packed(held, cuts, chosen), chosen).mapInArrow(fit, "fold int, turn int, feature array<long>, cut array<long>, value array<double>").collect()
    made = {fold: [] for fold in chosen}
    for r in sorted(rows, key=lambda r: r["turn"]):
        made[r["fold"]].append(Tree(*(np.asarray(r[c]) for c in Tree._fields)))
    return made


def _fitted_by_sums(held, cuts, chosen, bases, seed, rounds, depth, rate, shares, size) -> dict[int, list[Tree]]:
    """Blocks stay where they are with their margins; a level is a pass that sums the histograms of all folds."""
    trees = {fold: [] for fold in chosen}
    width = 1 + max(j for _, j in cuts)

    def moved(block, more):
        fold, bins, label, draw, margin = block
        opened = _opened(bins, label, draw)[0]
        margin = np.full(opened.shape[1], bases[fold]) if margin is None else margin.copy()
        for tree in more[fold]:
            margin += _added(opened, tree, depth)
        return fold, bins, label, draw, margin

    start = _packed(held, cuts, chosen).rdd.map(lambda r: (r["fold"], bytes(r["bins"]), bytes(r["label"]), bytes(r["draw"]), None))
    start = start.persist(StorageLevel.MEMORY_AND_DISK)
    tasks = max(1, min(start.getNumPartitions(), held.sparkSession.sparkContext.defaultParallelism))
    state, before = start, None
    for turn in range(rounds):
        renewed = turn % RENEWED == 0
        more = {fold: trees[fold][:] if renewed else trees[fold][-1:] for fold in chosen}
        before, state = state, (start if renewed else state).map(lambda block, more=more: moved(block, more)).persist(StorageLevel.MEMORY_AND_DISK)
        columns = {fold: _columns(width, seed, fold, turn, shares[1]) for fold in chosen}
        growers = {fold: _Grower(depth) for fold in chosen}
        for level in range(depth):
            asked = {fold: (g.feature.copy(), g.cut.copy(), list(g.open)) for fold, g in growers.items() if g.open}
            if not asked:
                break

            def summed(blocks, asked=asked, level=level, turn=turn, columns=columns):
                totals = {}
                for fold, bins, label, draw, margin in blocks:
                    if fold not in asked:
                        continue
                    bins, label, draw = _opened(bins, label, draw)
                    feature, cut, nodes = asked[fold]
                    spot = np.full(2 << depth, -1)
                    spot[nodes] = np.arange(len(nodes))
                    place = spot[_nodes(bins, feature, cut, level)]
                    rows = np.flatnonzero((place >= 0) & _drawn(draw, seed, fold, turn, shares[0]))
                    made = _sums(bins, rows, place[rows], _slopes(margin, label), columns[fold], len(nodes), size)
                    totals[fold] = totals[fold] + made if fold in totals else made
                for fold, made in totals.items():
                    for node, one in zip(asked[fold][2], made):
                        yield (fold, node), one

            def chosen_split(item, columns=columns):
                (fold, node), one = item
                return fold, node, *(v[0] for v in _best(one[None], columns[fold]))

            found = {fold: {} for fold in asked}
            for fold, node, *split in state.mapPartitions(summed).reduceByKey(lambda a, b: a + b, tasks).map(chosen_split).collect():
                found[fold][node] = split
            for fold in asked:
                growers[fold].split({node: found[fold].get(node, (-1, 0, None, None)) for node in growers[fold].open})
        for fold in chosen:
            trees[fold].append(growers[fold].tree(rate))
        if before is not start:
            before.unpersist()
    state.unpersist()
    start.unpersist()
    return trees


def fit(rows: DataFrame, train: Sequence[Column], keys: Sequence[str], seed: int, rounds: int, depth: int, rate: float, shares: tuple[float, float], bins: int) -> list[Fitted]:
    """One model a column of ``train``, which says what rows it learns from; ``shares`` of rows and columns make a tree.

    ``rows`` holds keys, features and label (0 or 1); a key holds one row. A model without rows is an error."""
    flags = F.array(*[F.coalesce(c, F.lit(False)) for c in train])
    held = rows.select(F.col("label").cast("int").alias("label"), "features", F.xxhash64(*keys).alias("draw"), flags.alias("train"))
    each = F.struct(*[F.sum(F.col("train")[k].cast("long")).alias(f"n{k}") for k in range(len(train))], *[F.avg(F.when(F.col("train")[k], F.col("label"))).alias(f"m{k}") for k in range(len(train))])
    counted = held.agg(each.alias("c")).first()["c"]
    size, folds = [counted[f"n{k}"] or 0 for k in range(len(train))], range(len(train))
    if not all(size):
        raise ValueError(f"gradient boosting {size.index(0)} has no rows")
    share = [min(max(counted[f"m{k}"], 1e-6), 1 - 1e-6) for k in folds]
    bases = [float(np.log(p / (1 - p))) for p in share]
    cuts = _thresholds(held, len(train), bins)
    trees = {}
    for work, chosen in ((_fitted_in_tasks, [k for k in folds if size[k] <= TASK_ROWS]), (_fitted_by_sums, [k for k in folds if size[k] > TASK_ROWS])):
        if chosen:
            trees |= work(held, cuts, chosen, bases, seed, rounds, depth, rate, shares, bins)
    width = 1 + max(j for _, j in cuts)
    return [Fitted([cuts[k, j] for j in range(width)], bases[k], trees[k]) for k in folds]


def scores(rows: DataFrame, models: Sequence[Fitted], asked: Sequence[Column], keys: Sequence[str], depth: int) -> DataFrame:
    """(keys, label, fold, score) of every row and each model whose column of ``asked`` is true of it."""
    keep = [*keys, "label"]
    held = rows.select(*keys, F.col("label").cast("int").alias("label"), "features", F.array(*[F.coalesce(c, F.lit(False)) for c in asked]).alias("asked"))
    types = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    shared = rows.sparkSession.sparkContext.broadcast(list(models))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, wanted = _matrix(batch, "features"), _flags(batch, "asked")
            for fold, model in enumerate(shared.value):
                own = np.flatnonzero(wanted[:, fold])
                if not len(own):
                    continue
                bins = np.ascontiguousarray(_binned(x[own], {(fold, j): c for j, c in enumerate(model.cuts)}, fold).T)
                margin = np.full(len(own), model.base)
                for tree in model.trees:
                    margin += _added(bins, tree, depth)
                taken = batch.select(keep).take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(np.full(len(own), fold, dtype=np.int32)), pa.array(1.0 / (1.0 + np.exp(-margin)))], [*keep, "fold", "score"]
                )

    fields = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return held.mapInArrow(scored, f"{fields}, fold int, score double")
