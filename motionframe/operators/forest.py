"""Random forests of several folds: large nodes by histograms over all rows, small ones whole in a task.

Every draw is a hash (Poisson weights of a row in a tree, candidate features of a node), so the trees
do not depend on the partitioning, nor on where large nodes end. Nodes of more than ``NODE_ROWS`` rows
are split by histograms summed by Spark; then the rows of a node, and the rows to score that fall
into it, meet in one task that grows the rest of its trees and returns their part of the scores. No tree is ever gathered.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.operators.logistic import _matrix

#: Rows of a node that a task may grow by itself (a byte a feature each).
NODE_ROWS = 2_000_000
#: Trees grown from one copy of the rows at the least, where whole trees fit a task.
TREE_CHUNK = 10
#: Copies of the rows that a slot of the cluster gets, where whole trees fit a task.
COPIES = 3
#: Rows of a node from which its counts are laid out by bin; of fewer, the rows are sorted by bin.
BY_BIN = 48
#: Nodes whose histograms a pass holds (27 KB each).
PASS_NODES = 4_000
#: Partitions at the most of the last exchange.
PARTS = 2_000
#: Ordered values that a batch of rows tells of a feature: ranks are right within 1 / 512.
SUMMARY = 256
#: Tasks over which the rows to score of a large leaf are dealt.
PIECES = 64
_CELLS, _PIECE = 250_000, 8_192
_PACK = 2.0**26
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def _mixed(value: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned integers."""
    with np.errstate(over="ignore"):
        z = value + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _salt(*parts: int) -> np.uint64:
    salt = np.zeros(1, dtype=np.uint64)
    for part in parts:
        salt = _mixed(salt ^ np.uint64(part))
    return salt[0]


def _weights(key: np.ndarray, seed: int, fold: int, tree: int) -> np.ndarray:
    """How often the bootstrap of a tree holds each row: Poisson with mean 1."""
    uniform = (_mixed(_mixed(key ^ _salt(seed, fold, tree, 1))) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(_POISSON, uniform, side="right").astype(np.float64)


def _candidates(paths: np.ndarray, width: int, seed: int, fold: int, tree: int) -> np.ndarray:
    """Ascending candidate features of each node, as many as the root of their number."""
    count = int(np.ceil(np.sqrt(width)))
    node = _mixed(paths.astype(np.uint64) ^ _salt(seed, fold, tree, 2))
    draws = _mixed(node[:, None] ^ _mixed(np.arange(width, dtype=np.uint64))[None, :])
    return np.sort(np.argpartition(draws, count - 1, axis=1)[:, :count], axis=1)


def _best(counts: np.ndarray):
    """Slot and bin of the best Gini split from counts (node, slot, bin, class); slot -1 where none gains."""
    below = counts.cumsum(axis=2)
    total = below[:, :, -1:, :]
    left, right = below[:, :, :-1], total - below[:, :, :-1]
    nl, nr = left.sum(-1), right.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = (left**2).sum(-1) / nl + (right**2).sum(-1) / nr
    flat = np.where((nl > 0) & (nr > 0), purity, -np.inf).reshape(len(counts), -1)
    at = flat.argmax(axis=1)
    whole = total[:, 0, 0]
    size = whole.sum(-1)
    gains = flat[np.arange(len(flat)), at] / size - (whole**2).sum(-1) / size**2 > 1e-12
    slot, cut = np.divmod(at, counts.shape[2] - 1)
    return np.where(gains, slot, -1), cut


def _counts(bins, place, label, weight, features, size):
    """Counts (node, slot, bin, class) of rows lying at node ``place`` each."""
    nodes, slots = features.shape
    cell = (place[:, None] * slots + np.arange(slots)) * size + bins[np.arange(len(bins))[:, None], features[place]]
    made = np.bincount((cell * 2 + label[:, None]).ravel(), np.repeat(weight, slots), nodes * slots * size * 2)
    return made.reshape(nodes, slots, size, 2)


def _gain(n, p, total, ones):
    """Purity of splits with ``n`` rows and ``p`` of label 1 on the left; all are whole numbers, so it is that of ``_best``."""
    rest, other = total - n, ones - p
    with np.errstate(divide="ignore", invalid="ignore"):
        return (p * p + (n - p) ** 2) / n + (other * other + (rest - other) ** 2) / rest


def _unpacked(sums: np.ndarray):
    """Rows and rows of label 1 of sums of weights, where those of label 1 count ``_PACK`` times more: whole numbers, exact to 2^26 rows."""
    ones = np.floor(sums / _PACK)
    return sums - ones * _PACK, ones


def _best_by_bin(flat, rows, place, packed, features, total, ones, size, width):
    """(purity, slot, cut) of the best split of each node from counts by bin; ``packed`` is the weight, and that of label 1 higher up."""
    nodes, slots = features.shape
    counts = np.zeros((nodes, slots * size))
    for a in range(0, len(rows), _PIECE):  # rows come by node, so a piece has few of them
        own, at = rows[a : a + _PIECE], place[a : a + _PIECE]
        low, high = at[0], at[-1] + 1
        cell = flat.take(own[:, None] * width + features[at]) + (((at - low) * slots)[:, None] + np.arange(slots)) * size
        made = np.bincount(cell.ravel(), np.repeat(packed[a : a + _PIECE], slots), (high - low) * slots * size)
        counts[low:high] += made.reshape(high - low, -1)
    below = counts.reshape(nodes, slots, size)[:, :, :-1].cumsum(axis=2)
    n, p = _unpacked(below)
    purity = _gain(n, p, total[:, None, None], ones[:, None, None])
    flat = np.where((n > 0) & (n < total[:, None, None]), purity, -np.inf).reshape(nodes, -1)
    at = flat.argmax(axis=1)
    return flat[np.arange(nodes), at], *np.divmod(at, size - 1)


def _best_by_row(flat, rows, place, code, features, total, ones, size, width):
    """The same from the rows sorted by node, slot and bin: a cut behind each bin that holds rows."""
    nodes, slots = features.shape
    cell = flat.take(rows[:, None] * width + features[place]) + ((place * slots)[:, None] + np.arange(slots)) * size
    order = np.sort((cell * 64 + code[:, None]).ravel())
    cell, held = order >> 6, (order >> 1) & 31
    n, p = held.cumsum(), (held * (order & 1)).cumsum()
    edge = np.flatnonzero(cell[1:] != cell[:-1])
    segment, cut = np.divmod(cell[edge], size)
    node, slot = np.divmod(segment, slots)
    # Each segment holds all rows of its node, so what lies before it is known.
    before = lambda whole: (np.cumsum(whole) - whole)[node] * slots + slot * whole[node]
    n, p = n[edge] - before(total), p[edge] - before(ones)
    inside = np.flatnonzero(n < total[node])
    node, slot, cut, n, p = (v[inside] for v in (node, slot, cut, n, p))
    purity = _gain(n, p, total[node], ones[node])
    most = np.full(nodes, -np.inf)
    if len(node):
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        most[node[starts]] = np.maximum.reduceat(purity, starts)
    first = np.flatnonzero(purity == most[node])[::-1]
    out = np.zeros((2, nodes), dtype=np.int64)
    out[:, node[first]] = slot[first], cut[first]
    return most, *out


def _grow(bins, label, weight, paths, asked, depth, size, seed, fold, tree) -> np.ndarray:
    """Share of label 1 in the leaf of each row of ``asked``, growing the nodes ``paths`` of the rows to ``depth``.

    Rows of ``weight`` 0 are only moved along; nodes where nothing is asked are not grown."""
    value, width, flat = np.full(len(bins), np.nan), bins.shape[1], bins.ravel()
    rows, held = np.flatnonzero(asked), np.flatnonzero(weight > 0)
    nodes = np.unique(paths[np.append(rows, held)]).astype(np.int64)
    place, spot = (np.searchsorted(nodes, paths[r]) for r in (rows, held))
    if (np.bincount(spot, minlength=len(nodes)) == 0).any():
        raise ValueError("random forest has a node without training rows")
    code = weight[held].astype(np.int64) * 2 + label[held]  # weight and label of a training row
    near, turn = flat, 0  # the training rows by themselves
    while len(rows):
        order = np.argsort(spot * len(bins) + held)
        held, spot, code = held[order], spot[order], code[order]
        if turn % 3 == 0:  # rows of a node lie together again
            near, held = near.reshape(-1, width)[held].ravel(), np.arange(len(held))
        turn += 1
        packed = (code >> 1) * (1.0 + (code & 1) * _PACK)
        total, positive = _unpacked(np.bincount(spot, packed, len(nodes)))
        count = np.bincount(spot, minlength=len(nodes))
        starts = np.append(0, count.cumsum())
        open_ = (positive > 0) & (positive < total) & (np.floor(np.log2(nodes)) < depth) & (np.bincount(place, minlength=len(nodes)) > 0)
        feature, cut = np.full(len(nodes), -1), np.zeros(len(nodes), dtype=np.int64)
        for by_bin, some in ((True, np.flatnonzero(open_ & (count >= BY_BIN))), (False, np.flatnonzero(open_ & (count < BY_BIN)))):
            slots = int(np.ceil(np.sqrt(width)))
            chunk = max(1, _CELLS // (slots * (size if by_bin else 2 * BY_BIN)))
            for a in range(0, len(some), chunk):
                part = some[a : a + chunk]
                features = _candidates(nodes[part], width, seed, fold, tree)
                mine = np.repeat(starts[part] - np.append(0, count[part].cumsum()[:-1]), count[part]) + np.arange(count[part].sum())
                at = np.repeat(np.arange(len(part)), count[part])
                t, o = total[part], positive[part]
                if by_bin:
                    best, slot, edge = _best_by_bin(near, held[mine], at, packed[mine], features, t, o, size, width)
                else:
                    best, slot, edge = _best_by_row(near, held[mine], at, code[mine], features, t, o, size, width)
                gains = best / t - (o**2 + (t - o) ** 2) / t**2 > 1e-12
                feature[part] = np.where(gains, features[np.arange(len(part)), slot], -1)
                cut[part] = edge
        ended = feature[place] < 0
        value[rows[ended]] = (positive / total)[place[ended]]
        rows, place = rows[~ended], place[~ended]
        kept = feature[spot] >= 0
        held, spot, code = held[kept], spot[kept], code[kept]
        place, spot = (2 * at + (source.take(r * width + feature[at]) > cut[at]) for source, r, at in ((flat, rows, place), (near, held, spot)))
        used = np.bincount(spot, minlength=2 * len(nodes)) > 0
        number = np.cumsum(used) - 1
        nodes = (2 * nodes[:, None] + np.arange(2)).ravel()[used]
        place, spot = number[place], number[spot]
    return value[asked]


def _moved(bins: np.ndarray, splits: dict) -> np.ndarray:
    """Node of each row behind the splits of the large nodes (path -> feature, cut)."""
    path = np.ones(len(bins), dtype=np.int64)
    for node in sorted(splits):
        here = path == node
        feature, cut = splits[node]
        path[here] = node * 2 + (bins[here, feature] > cut)
    return path


def _thresholds(rows: DataFrame, folds: int, bins: int) -> dict:
    """Cuts of each (fold, feature): quantiles of all training rows of the fold."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, train = _matrix(batch, "features"), _flags(batch, "train")
            for fold in range(folds):
                ordered = np.sort(x[train[:, fold]], axis=0)
                n = len(ordered)
                if not n:
                    continue
                if n > SUMMARY:
                    ordered = ordered[((np.arange(SUMMARY) + 0.5) * n / SUMMARY).astype(int)]
                width = ordered.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(width, fold, dtype=np.int32)), pa.array(np.arange(width, dtype=np.int32)),
                        pa.array(np.full(width, n / len(ordered))), pa.array(list(ordered.T), pa.list_(pa.float64())),
                    ],
                    ["fold", "j", "each", "held"],
                )

    def cuts(key, frame: pd.DataFrame) -> pd.DataFrame:
        held = np.concatenate(frame["held"].to_list())
        each = np.repeat(frame["each"].to_numpy(), frame["held"].map(len).to_numpy())
        order = np.argsort(held, kind="stable")
        upto = np.cumsum(each[order])
        at = np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins)
        return pd.DataFrame({"fold": [key[0]], "j": [key[1]], "cuts": [np.unique(held[order][at])]})

    parts = rows.select("features", "train").mapInArrow(summaries, "fold int, j int, each double, held array<double>")
    table = parts.groupBy("fold", "j").applyInPandas(cuts, "fold int, j int, cuts array<double>")
    return {(r["fold"], r["j"]): np.asarray(r["cuts"]) for r in table.collect()}


def _chunk(trees: int, folds: int, slots: int) -> int:
    """Trees grown from one copy of the rows of a fold, so that copies, and with them the exchange, do not grow with the trees."""
    return max(min(TREE_CHUNK, trees), -(-trees // max(1, COPIES * slots // folds)))


def _held(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column as they lie."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(batch.num_rows, -1)


def _binned(x: np.ndarray, cuts: dict, fold: int) -> np.ndarray:
    return np.column_stack([np.searchsorted(cuts[fold, j], x[:, j]) for j in range(x.shape[1])]).astype(np.uint8)


def scores(rows: DataFrame, train: Sequence[Column], asked: Sequence[Column], keys: Sequence[str], seed: int, trees: int, depth: int, bins: int) -> DataFrame:
    """(keys, label, fold, score): mean share of label 1 over the trees of the fold that asks for the row.

    ``rows`` holds keys, features and label (0 or 1); a pair of columns of ``train`` and ``asked`` is a fold.
    A key holds one row."""
    folds = len(train)
    flag = lambda columns: F.array(*[F.coalesce(c, F.lit(False)) for c in columns])
    held = rows.select(
        *keys, F.col("label").cast("int").alias("label"), "features", F.xxhash64(*keys).alias("draw"), flag(train).alias("train"), flag(asked).alias("asked")
    )
    types = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    cuts = _thresholds(held, folds, bins)
    counted = held.agg(*[F.sum(F.col("train")[k].cast("long")) for k in range(folds)]).first()
    splits = {(fold, tree): {} for fold in range(folds) for tree in range(trees)}
    large = {(fold, tree, 1) for fold, tree in splits if (counted[fold] or 0) > NODE_ROWS}
    large_ones, ended = bool(large), {}
    while large:
        found = {}
        todo = sorted(large)
        for a in range(0, len(todo), PASS_NODES):
            found.update(_split_large(held, cuts, splits, todo[a : a + PASS_NODES], seed, bins))
        large = set()
        for (fold, tree, node), (feature, cut, left, right) in found.items():
            if feature < 0:  # a leaf, whose share of label 1 comes in place of the cut
                ended[fold, tree, node] = cut
                continue
            splits[fold, tree][node] = (feature, int(cut))
            if node.bit_length() < depth:
                large |= {(fold, tree, child) for child, n in ((2 * node, left), (2 * node + 1, right)) if n > NODE_ROWS}
    chunk = 1 if large_ones else _chunk(trees, folds, rows.sparkSession.sparkContext.defaultParallelism)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, trains, wanted = _matrix(batch, "features"), _flags(batch, "train"), _flags(batch, "asked")
            for fold in range(folds):
                own = np.flatnonzero(trains[:, fold] | wanted[:, fold])
                if not len(own):
                    continue
                values, part = _binned(x[own], cuts, fold), batch.take(pa.array(own))
                draw = part.column("draw").to_numpy().astype(np.uint64)
                plain = [part.column(c) for c in keys]
                for turn, first in enumerate(range(0, trees, chunk)):
                    sent = np.arange(len(own))
                    path, piece = _moved(values, splits[fold, first]), np.full(len(own), fold * -(-trees // chunk) + turn, dtype=np.int32)
                    if chunk == 1:  # rows that the tree did not draw need not go there
                        leaves = [n for f, t, n in ended if (f, t) == (fold, first)]
                        drawn = (_weights(draw, seed, fold, first) > 0) & ~np.isin(path, leaves)
                        sent = sent[wanted[own, fold] | (trains[own, fold] & drawn)]
                        piece = np.where(np.isin(path, leaves), draw % np.uint64(PIECES), 0).astype(np.int32)
                    if not len(sent):
                        continue
                    pick = pa.array(sent)
                    data = np.ascontiguousarray(values[sent] if chunk == 1 else values)
                    offsets = np.arange(len(sent) + 1, dtype=np.int32) * data.shape[1]
                    packed = pa.Array.from_buffers(pa.binary(), len(sent), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(sent), fold, dtype=np.int32)), pa.array(np.full(len(sent), first, dtype=np.int32)), pa.array(path[sent]), pa.array(piece[sent]),
                            *[c.take(pick) for c in plain], part.column("label").take(pick), part.column("draw").take(pick),
                            pa.array(trains[own, fold][sent]), pa.array(wanted[own, fold][sent]), packed,
                        ],
                        ["fold", "tree", "node", "piece", *keys, "label", "draw", "trains", "wanted", "bins"],
                    )

    named = ", ".join(f"`{c}` {types[c]}" for c in keys)
    fields = f"fold int, tree int, node long, piece int, {named}, label int, draw long, trains boolean, wanted boolean, bins binary"

    def grown(key, table):
        fold, first, node, _ = (k.as_py() for k in key)
        flags = {c: table.column(c).to_numpy().astype(bool) for c in ("trains", "wanted")}
        values = np.concatenate([_held(part) for part in table.column("bins").chunks]).reshape(table.num_rows, -1)
        label, draw = table.column("label").to_numpy().astype(np.int64), table.column("draw").to_numpy().astype(np.uint64)
        paths = np.full(len(label), node, dtype=np.int64)
        total = np.zeros(int(flags["wanted"].sum()))
        if (fold, first, node) in ended:
            total += ended[fold, first, node]
        for tree in range(first, min(first + chunk, trees)) if len(total) and (fold, first, node) not in ended else ():
            weight = np.where(flags["trains"], _weights(draw, seed, fold, tree), 0.0)
            total += _grow(values, label, weight, paths, flags["wanted"], depth, bins, seed, fold, tree)
        out = table.filter(table.column("wanted")).select([*keys, "label", "fold"])
        return out.append_column("total", pa.array(total))

    exchanged = held.mapInArrow(dealt, fields)
    if chunk == 1:
        count = sum(len(v) + 1 for v in splits.values())
        exchanged = exchanged.repartition(min(count, PARTS), "fold", "tree", "node", "piece")
    else:  # a task a copy, by number: by hash some would share one
        exchanged = exchanged.repartitionById(folds * -(-trees // chunk), F.col("piece"))
    parts = exchanged.groupBy("fold", "tree", "node", "piece").applyInArrow(grown, f"{named}, label int, fold int, total double")
    # Shares are summed in a fixed scale, so that their order does not show.
    exact = F.sum(F.round(F.col("total") * 2.0**40).cast("decimal(28,0)")).cast("double") / 2.0**40
    return parts.groupBy(*keys, "label", "fold").agg((exact / trees).alias("score"))


def _split_large(held, cuts, splits, nodes, seed, size) -> dict:
    """Best splits of large nodes (fold, tree, path) -> (feature, cut, training rows left, right).

    Where no split gains the feature is -1, and the share of label 1 stands in place of the cut."""
    wanted = {}
    for fold, tree, node in nodes:
        wanted.setdefault((fold, tree), []).append(node)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, trains = _matrix(batch, "features"), _flags(batch, "train")
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            draws = batch.column("draw").to_numpy().astype(np.uint64)
            for fold in sorted({f for f, _ in wanted}):
                own = np.flatnonzero(trains[:, fold])
                values = _binned(x[own], cuts, fold) if len(own) else None
                for (f, tree), paths in wanted.items():
                    if f != fold or not len(own):
                        continue
                    weight, path = _weights(draws[own], seed, fold, tree), _moved(values, splits[fold, tree])
                    for node in paths:
                        mine = np.flatnonzero((path == node) & (weight > 0))
                        if len(mine):
                            features = _candidates(np.array([node]), x.shape[1], seed, fold, tree)
                            place = np.zeros(len(mine), dtype=np.int64)
                            each = [_counts(values[mine], place, labels[own][mine], w, features, size).ravel() for w in (weight[mine], np.ones(len(mine)))]
                            # Distinct rows, by any one slot, tell how large the children are.
                            one = np.concatenate(each)
                            key = (fold, tree, node)
                            totals[key] = totals[key] + one if key in totals else one
        for (fold, tree, node), one in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((fold, pa.int32()), (tree, pa.int32()), (node, pa.int64()), (one, pa.list_(pa.float64())))],
                ["fold", "tree", "node", "totals"],
            )

    width = max(j for _, j in cuts) + 1

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                features = _candidates(np.array([r.node]), width, seed, r.fold, r.tree)[0]
                counts, distinct = np.asarray(r.totals).reshape(2, 1, len(features), size, 2)
                slot, cut = (int(v[0]) for v in _best(counts))
                spread = distinct[0, slot].sum(-1)
                left = int(spread[: cut + 1].sum())
                held_here = counts[0, 0].sum(0)
                value = float(cut) if slot >= 0 else held_here[1] / held_here.sum()
                out.append((r.fold, r.tree, r.node, int(features[slot]) if slot >= 0 else -1, value, left, int(spread.sum()) - left))
            yield pd.DataFrame(out, columns=["fold", "tree", "node", "feature", "cut", "left_rows", "right_rows"])

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = held.mapInArrow(partial, "fold int, tree int, node long, totals array<double>")
    summed = parts.groupBy("fold", "tree", "node").agg(vector_to_array(Summarizer.sum(array_to_vector("totals"))).alias("totals"))
    table = summed.mapInPandas(chosen, "fold int, tree int, node long, feature int, cut double, left_rows long, right_rows long")
    return {(r["fold"], r["tree"], r["node"]): (r["feature"], r["cut"], r["left_rows"], r["right_rows"]) for r in table.collect()}
