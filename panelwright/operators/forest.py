"""Random forests that are a function of their rows alone: not of partitions, row order or tasks that ran again.

All trees of all folds grow together, a level a round. Rows are binned per fold; every task sums histograms of the nodes that its
rows are in, the sums of a node meet in one row, and its best split comes to the driver. Nothing depends on order: a row's weight
in a tree (Poisson of mean 1, as in a bootstrap) and the features that a node may split on are hashes, and all sums are of whole
numbers, the target being a multiple of 2^-24 of its range in the fold.

A fold learns from the rows of earlier periods alone, bins, means and range of the target included. The driver holds the trees
(folds x trees x 2^depth nodes at most), sums of each period and SAMPLE rows of each period, the first by hash, for the bins' edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.operators.storage import settled, ship

#: Rows of a period that the edges of bins are taken from.
SAMPLE = 2048
#: Rows that a task of a level should have, and bytes of histograms that it may hold.
TASK_ROWS = 100_000
TASK_BYTES = 1 << 26
UNITS = float(1 << 24)
#: Chances that a Poisson variable of mean 1 is at most 0, 1, ..., 8.
POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8])])


def mixed(*parts) -> np.ndarray:
    """64-bit hashes of whole numbers, element by element."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for part in parts:
            out = (out ^ np.asarray(part).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(27))
    return out


def bootstrap_weights(keys: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """How often each tree draws each row: a matrix of rows by trees."""
    uniform = (mixed(seed, keys[:, None], trees[None, :]) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.searchsorted(POISSON, uniform, side="right")


@dataclass(frozen=True)
class Forest:
    """Trees of every fold. Node 1 is a root, 2 i and 2 i + 1 are below node i; a node without a split has feature -1."""

    folds: np.ndarray
    features: tuple[str, ...]
    trees: int
    depth: int
    bins: int
    least: int
    seed: int
    means: np.ndarray  # folds x features, for missing values
    edges: list[list[np.ndarray]] = field(repr=False)  # fold, feature: upper ends of all bins but the last
    low: np.ndarray
    span: np.ndarray
    split: np.ndarray = field(repr=False)  # folds x trees x nodes: feature
    cut: np.ndarray = field(repr=False)  # and the last bin that goes left
    value: np.ndarray = field(repr=False)  # and the mean of the target

    @property
    def tried(self) -> int:
        """Features that a node may split on."""
        return max(1, int(len(self.features) ** 0.5))

    def candidates(self, trees: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """(trees, nodes, tried): the features that each node may split on, the first by hash."""
        order = mixed(self.seed, trees[:, None, None], nodes[None, :, None], np.arange(len(self.features))[None, None, :])
        return np.sort(np.argsort(order, axis=2, kind="stable")[:, :, : self.tried], axis=2)

    def binned(self, x: np.ndarray, fold: int) -> np.ndarray:
        filled = np.where(np.isnan(x), self.means[fold], x)
        return np.column_stack([np.searchsorted(e, filled[:, i], side="left") for i, e in enumerate(self.edges[fold])])

    def nodes(self, binned: np.ndarray, fold: int, trees: np.ndarray, levels: int) -> np.ndarray:
        """(rows, trees): where rows are after so many levels, or where they ended before."""
        at = np.ones((len(binned), len(trees)), np.int64)
        rows = np.arange(len(binned))[:, None]
        for _ in range(levels):
            feature = self.split[fold][trees[None, :], at]
            right = binned[rows, feature] > self.cut[fold][trees[None, :], at]
            at = np.where(feature >= 0, 2 * at + right, at)
        return at

    def predicted(self, x: np.ndarray, fold: int) -> np.ndarray:
        trees = np.arange(self.trees)
        at = self.nodes(self.binned(x, fold), fold, trees, self.depth)
        return self.value[fold][trees[None, :], at].mean(axis=1)

    def best_split(self, sums: np.ndarray) -> tuple[int, int, int, int, int, int]:
        """(place among the candidates or -1, cut, rows, total, rows left, total left) of a node from (tried, bins, 2) sums.

        The split that lowers the squared error most, with `least` drawn rows on either side; the first of equal ones.
        """
        n, s = (int(v) for v in sums[0].sum(axis=0))
        upto = np.cumsum(sums, axis=1)[:, :-1]
        left_n, left_s = upto[:, :, 0], upto[:, :, 1]
        right_n, right_s = n - left_n, s - left_s
        fits = (left_n >= self.least) & (right_n >= self.least)
        gain = np.where(fits, left_s.astype(float) ** 2 / np.maximum(left_n, 1) + right_s.astype(float) ** 2 / np.maximum(right_n, 1), -np.inf)
        if not gain.size or gain.max() <= float(s) ** 2 / max(n, 1) * (1 + 1e-12) + 1e-6:
            return -1, 0, n, s, 0, 0
        place, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        return int(place), int(cut), n, s, int(left_n[place, cut]), int(left_s[place, cut])


def prepared(df: DataFrame, features: Sequence[str], target: str, period: str, keys: Sequence[str]) -> DataFrame:
    """(key, period, x, y): rows for a forest; a missing feature is NaN. Rows are told apart by keys."""
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    return df.select(F.xxhash64(*keys).alias("key"), F.col(period).cast("bigint").alias("period"), x.alias("x"), F.col(target).cast("double").alias("y"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _empty(rows: DataFrame, folds: Sequence[int], features: Sequence[str], trees: int, depth: int, bins: int, least: int, seed: int) -> Forest:
    """Means, edges and ranges of every fold that has earlier rows, and roots without splits."""
    width = len(features)
    at = [F.get("x", i) for i in range(width)]
    known = [~F.isnan(c) for c in at]
    # Decimal sums are exact, so their order doesn't matter.
    sums = [F.sum(F.when(k, c).try_cast("decimal(38, 12)")).alias(f"s{i}") for i, (c, k) in enumerate(zip(at, known))] + [F.count_if(k).alias(f"n{i}") for i, k in enumerate(known)]
    by_period = rows.groupBy("period").agg(F.min("y").alias("low"), F.max("y").alias("high"), *sums).collect()
    first = Window.partitionBy("period").orderBy("key", "x")
    sample = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= SAMPLE).select("period", "key", "x").collect()
    sample.sort(key=lambda r: (r.key, r.x))
    folds = [fold for fold in folds if any(r.period < fold for r in by_period)]
    means, edges, low, span = np.zeros((len(folds), width)), [], np.zeros(len(folds)), np.ones(len(folds))
    for f, fold in enumerate(folds):
        past = [r for r in by_period if r.period < fold]
        for i in range(width):
            n = sum(r[f"n{i}"] for r in past)
            means[f, i] = float(sum(r[f"s{i}"] or 0 for r in past)) / n if n else 0.0
        low[f] = min(r.low for r in past)
        span[f] = max(max(r.high for r in past) - low[f], 1e-300)
        x = np.array([r.x for r in sample if r.period < fold][:SAMPLE]).reshape(-1, width)
        x = np.sort(np.where(np.isnan(x), means[f], x), axis=0)
        ends = [np.unique(x[np.arange(1, bins) * len(x) // bins, i]) for i in range(width)]
        edges.append([e[e < x[-1, i]] for i, e in enumerate(ends)])
    shape = (len(folds), trees, 1 << (depth + 1))
    return Forest(np.array(folds), tuple(features), trees, depth, bins, least, seed, means, edges, low, span, np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape))


def _level_sums(rows: DataFrame, forest: Forest, level: int) -> DataFrame:
    """(fold, tree, node, sums): a part of the sums of each node of a level, for each of its candidates and bins (rows, target)."""
    first, tried, bins = 1 << level, forest.tried, forest.bins
    width = len(forest.features)
    held = len(forest.folds) * forest.trees * first * tried * bins * 16
    context = rows.sparkSession.sparkContext
    row_blocks = -(-rows.count() // TASK_ROWS)
    tree_blocks = int(min(forest.trees, max(1, context.defaultParallelism // max(row_blocks, 1), -(-held // TASK_BYTES))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for block in np.unique(blocks).tolist():
                part = batch.filter(pa.array(blocks == block))
                trees = np.arange(block, forest.trees, tree_blocks)
                x, period, y = _matrix(part.column("x"), width), part.column("period").to_numpy(), part.column("y").to_numpy()
                weights = bootstrap_weights(part.column("key").to_numpy(), trees, forest.seed)
                total = totals.setdefault(block, np.zeros((len(forest.folds), len(trees), first, tried, bins, 2), np.int64))
                tries = forest.candidates(trees, np.arange(first, 2 * first))
                for f, fold in enumerate(forest.folds):
                    past = period < fold
                    if not past.any():
                        continue
                    binned = forest.binned(x[past], f)
                    units = np.rint((y[past] - forest.low[f]) / forest.span[f] * UNITS)
                    at = forest.nodes(binned, f, trees, level)
                    row, tree = np.nonzero((at >= first) & (weights[past] > 0))
                    node, w = at[row, tree] - first, weights[past][row, tree].astype(float)
                    for place in range(tried):
                        cell = ((tree * first + node) * tried + place) * bins + binned[row, tries[tree, node, place]]
                        size = len(trees) * first * tried * bins
                        total[f, ..., 0] += np.bincount(cell, w, size).astype(np.int64).reshape(total.shape[1:-1])
                        total[f, ..., 1] += np.bincount(cell, w * units[row], size).astype(np.int64).reshape(total.shape[1:-1])
        for block, total in totals.items():
            folds, trees, nodes = np.nonzero(total[:, :, :, 0, :, 0].any(axis=-1))
            for i in range(0, len(folds), 1024):
                f, t, n = folds[i : i + 1024], trees[i : i + 1024], nodes[i : i + 1024]
                columns = [pa.array(f, pa.int32()), pa.array(t * tree_blocks + block, pa.int32()), pa.array(n + first, pa.int32()), pa.array([v.tobytes() for v in total[f, t, n]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["fold", "tree", "node", "sums"])

    if tree_blocks == 1:
        dealt = rows.withColumn("block", F.lit(0))
    else:
        part = F.pmod("key", F.lit(max(row_blocks, 1)))
        dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(tree_blocks - 1)))).repartition(max(row_blocks, 1) * tree_blocks, part, "block")
    return dealt.select("key", "period", "x", "y", "block").mapInArrow(work, "fold int, tree int, node int, sums binary")


def _splits(parts: DataFrame, forest: Forest) -> DataFrame:
    """(fold, tree, node, feature, cut, n, s, n_left, s_left) of every node of the parts of its sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def closed() -> tuple:
            fold, tree, node = now
            place, cut, *counts = forest.best_split(total)
            feature = -1 if place < 0 else int(forest.candidates(np.array([tree]), np.array([node]))[0, 0, place])
            return fold, tree, node, feature, cut, *counts

        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int32()] * 5 + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["fold", "tree", "node", "feature", "cut", "n", "s", "n_left", "s_left"])

        for batch in batches:
            for fold, tree, node, data in zip(*(batch.column(c).to_pylist() for c in ("fold", "tree", "node", "sums"))):
                sums = np.frombuffer(data, np.int64).reshape(forest.tried, forest.bins, 2)
                if (fold, tree, node) == now:
                    total = total + sums
                    continue
                if now is not None:
                    out.append(closed())
                now, total = (fold, tree, node), sums
            if len(out) > 4096:
                yield batch_of()
                out.clear()
        if now is not None:
            out.append(closed())
        if out:
            yield batch_of()

    key = ["fold", "tree", "node"]
    schema = "fold int, tree int, node int, feature int, cut int, n bigint, s bigint, n_left bigint, s_left bigint"
    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(work, schema)


def grow(rows: DataFrame, folds: Sequence[int], features: Sequence[str], trees: int = 200, depth: int = 6, bins: int = 32, least: int = 3, seed: int = 1337) -> Forest:
    """The forest of every fold from the rows (of `prepared`) of earlier periods whose target is known."""
    ship(rows.sparkSession)
    rows = settled(rows.filter("y IS NOT NULL AND NOT isnan(y)"))
    forest = _empty(rows, folds, features, trees, depth, bins, least, seed)
    for level in range(depth):
        found = _splits(_level_sums(rows, forest, level), forest).toArrow()
        if not len(found):
            break
        fold, tree, node, feature, cut, n, s, n_left, s_left = (found.column(c).to_numpy() for c in found.column_names)
        split, cuts, value = forest.split.copy(), forest.cut.copy(), forest.value.copy()
        mean = lambda total, count, f: forest.low[f] + total / np.maximum(count, 1) / UNITS * forest.span[f]
        split[fold, tree, node], cuts[fold, tree, node], value[fold, tree, node] = feature, cut, mean(s, n, fold)
        has = feature >= 0
        f, t, i = fold[has], tree[has], node[has]
        value[f, t, 2 * i] = mean(s_left[has], n_left[has], f)
        value[f, t, 2 * i + 1] = mean((s - s_left)[has], (n - n_left)[has], f)
        forest = replace(forest, split=split, cut=cuts, value=value)
        if not has.any():
            break
    return forest


def predict(df: DataFrame, forest: Forest, fold: str, name: str = "predicted") -> DataFrame:
    """df, every row, with the mean of its fold's trees; null for a fold without earlier rows."""
    ship(df.sparkSession)
    at = {int(f): i for i, f in enumerate(forest.folds)}
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in forest.features])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.full(batch.num_rows, np.nan)
            folds, rows = batch.column("_fold").to_numpy(zero_copy_only=False), _matrix(batch.column("_x"), len(forest.features))
            for f in np.unique(folds[~np.isnan(folds.astype(float))]):
                if int(f) in at:
                    values[folds == f] = forest.predicted(rows[folds == f], at[int(f)])
            kept = [c for c in batch.schema.names if c not in ("_fold", "_x")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(values, mask=np.isnan(values))], names=[*kept, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.withColumns({"_fold": F.col(fold).cast("bigint"), "_x": x}).mapInArrow(work, f"{schema}, `{name}` double")
