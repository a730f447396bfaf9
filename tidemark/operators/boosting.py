"""Boosted regression trees, grown leaf by leaf (best first) from histograms.

Features become bins of about equal numbers of rows. Each round sums gradients by (leaf, feature, bin) in Spark, in
every task before anything is shuffled; the driver sees those sums alone, never a row. A leaf of the highest
gain is split next, whatever its depth. One round looks at all leaves that may be split soon, so a tree takes about as
many rounds as it is deep, not one a leaf. Gradients are whole multiples of a small unit, so sums are
exact, and a tree is the same however rows are partitioned or tasks repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import materialize

BINS = 64
#: Trees after which predictions so far are written, so that rounds need not go through all trees again.
WRITTEN_EVERY = 10
#: Combinations of bins up to which the driver keeps sums by combination.
MOST_CELLS = 1 << 16
#: Relative error of the quantiles that part bins.
QUANTILE_ERROR = 1e-3


@dataclass(frozen=True)
class Params:
    n_estimators: int = 100
    learning_rate: float = 0.05
    num_leaves: int = 31
    min_child_samples: int = 20
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    bagging_freq: int = 0
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.n_estimators, self.min_child_samples) < 1 or self.learning_rate <= 0 or self.num_leaves < 2:
            raise ValueError("tree counts, rates and sizes must be positive")
        if not (0 < self.feature_fraction <= 1 and 0 < self.bagging_fraction <= 1):
            raise ValueError("fractions must be above 0 and at most 1")
        if self.bagging_freq < 0:
            raise ValueError("bagging_freq must not be negative")


@dataclass
class Tree:
    """Nodes by number: ``feature``, ``bin`` (rows of at most this bin go left) and children of splits, ``value`` of leaves."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, n, n + 1
        for name, x in (("feature", -1), ("bin", 0), ("left", 0), ("right", 0), ("value", 0.0)):
            getattr(self, name).extend([x, x])
        return n, n + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins."""
        feature, at, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            here = node[rows]
            goes = bins[rows, feature[here]] <= at[here]
            node[rows] = np.where(goes, left[here], right[here])
        return node


@dataclass(frozen=True)
class Ensemble:
    columns: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float
    trees: tuple[Tree, ...]


def bin_edges(train: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper bounds of all bins but the last of each feature, by approximate quantiles; equal ones once."""
    found = train.approxQuantile(columns, [k / bins for k in range(1, bins)], QUANTILE_ERROR)
    return [sorted(set(x)) for x in found]


def binned(values: np.ndarray, edges: tuple[tuple[float, ...], ...]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(edges)]) if len(edges) else np.zeros((len(values), 0), dtype=np.int64)


def _bin_column(c: str, edges: list[float]) -> Column:
    """How many edges lie below the value, by halving: a few comparisons a row."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(c) <= edges[mid], below(low, mid)).otherwise(below(mid + 1, high))

    return below(0, len(edges)).cast("int")


def sampled(pos: np.ndarray, tree: int, params: Params) -> np.ndarray:
    """Which rows a tree learns from: a hash of position, seed and the bag's number, which changes every bagging_freq trees."""
    if not params.bagging_freq or params.bagging_fraction == 1:
        return np.ones(len(pos), dtype=bool)
    x = pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((params.seed * 1_000_003 + tree // params.bagging_freq) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < params.bagging_fraction


def tree_features(n: int, tree: int, params: Params) -> list[int]:
    """The features that a tree may split by: a seeded choice of the fraction, one at least."""
    if params.feature_fraction == 1:
        return list(range(n))
    order = np.random.default_rng([params.seed, tree]).permutation(n)
    return sorted(order[: max(1, round(n * params.feature_fraction))].tolist())


def best_split(hist: dict[int, np.ndarray], least: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of a leaf's best split; hist: by feature, rows (sum, count) by bin. Ties: first feature, first bin."""
    best = None
    for f in sorted(hist):
        sums, counts = (np.cumsum(hist[f][:, k])[:-1] for k in (0, 1))
        total, n = int(hist[f][:, 0].sum()), int(hist[f][:, 1].sum())
        ok = (counts >= least) & (n - counts >= least)
        if not ok.any():
            continue
        a, c = sums.astype(np.float64), counts.astype(np.float64)
        gain = np.where(ok, a * a / np.maximum(c, 1) + (total - a) ** 2 / np.maximum(n - c, 1) - float(total) ** 2 / n, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > 0 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, k)
    return best


class _Grower:
    """A tree in the making. Leaves whose sums are known are split in order of gain; ``wanted`` are those whose children's sums are needed."""

    def __init__(self, params: Params, features: list[int]) -> None:
        self.params, self.features = params, features
        self.tree = Tree()  # split further than the result, to know sums ahead
        self.hists: dict[int, dict[int, np.ndarray]] = {}
        self.splits: dict[int, tuple[float, int, int] | None] = {}

    def learn(self, node: int, hist: dict[int, np.ndarray]) -> None:
        self.hists[node], self.splits[node] = hist, best_split(hist, self.params.min_child_samples)

    def grown(self) -> tuple[list[int], list[int]]:
        """The nodes split so far in order of gain, and the leaves that may come next but were not looked at."""
        leaves, done, unknown = [0], [], []
        while len(leaves) < self.params.num_leaves:
            able = [n for n in leaves if self.splits.get(n)]
            if not able:
                break
            top = max(able, key=lambda n: (self.splits[n][0], -n))
            if self.tree.feature[top] < 0 or self.tree.left[top] not in self.hists:
                unknown = sorted((n for n in able if self.tree.feature[n] < 0), key=lambda n: (-self.splits[n][0], n))[: self.params.num_leaves - len(leaves)]
                break
            leaves.remove(top)
            leaves += [self.tree.left[top], self.tree.right[top]]
            done.append(top)
        return done, unknown

    def look_ahead(self, nodes: list[int]) -> list[int]:
        """Split these leaves; the left children, whose sums must be counted (right ones are what is left)."""
        return [self.tree.split(n, *self.splits[n][1:])[0] for n in nodes]

    def result(self, done: list[int], unit: float, rate: float) -> Tree:
        """The tree of the splits in ``done`` alone; leaves hold the mean residual times the rate."""
        out, number = Tree(), {0: 0}
        for n in done:
            number[self.tree.left[n]], number[self.tree.right[n]] = out.split(number[n], self.tree.feature[n], self.tree.bin[n])
        for n, k in number.items():
            if out.feature[k] < 0:
                sums = next(iter(self.hists[n].values()), np.zeros((1, 2), dtype=np.int64)).sum(axis=0)
                out.value[k] = rate * float(sums[0]) * unit / float(sums[1]) if sums[1] else 0.0
        return out


class _Source:
    """Where residual sums come from: ``binned`` rows (pos, y in units, so_far, bins) and the trees made so far."""

    def __init__(self, rows: DataFrame, n_bins: list[int], base: float, unit: float, params: Params) -> None:
        self.rows, self.n_bins, self.base, self.unit, self.params = rows, n_bins, base, unit, params
        self.columns = [f"bin{k}" for k in range(len(n_bins))]

    def _empty(self, nodes: list[int], features: list[int]) -> dict[int, dict[int, np.ndarray]]:
        return {n: {f: np.zeros((self.n_bins[f], 2), dtype=np.int64) for f in features} for n in nodes}


def _counted(bins: np.ndarray, leaf: np.ndarray, sums: np.ndarray, counts: np.ndarray, into: dict[int, dict[int, np.ndarray]]) -> None:
    for n, by_feature in into.items():
        at = leaf == n
        for f, hist in by_feature.items():
            np.add.at(hist[:, 0], bins[at, f], sums[at])
            np.add.at(hist[:, 1], bins[at, f], counts[at])


class _FromRows(_Source):
    """A Spark job a round, over all rows; each task sends its sums by node, feature and bin."""

    trees: tuple[Tree, ...] = ()

    def start(self, number: int) -> None:
        self.number = number
        if len(self.trees) == WRITTEN_EVERY:
            columns, trees = self.columns, self.trees

            def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    yield batch.assign(so_far=_after(batch["so_far"].to_numpy(), batch[columns].to_numpy(), trees))

            self.rows, self.trees = materialize(self.rows.mapInPandas(add, self.rows.schema), "so_far"), ()

    def histograms(self, tree: Tree, nodes: list[int], features: list[int]) -> dict[int, dict[int, np.ndarray]]:
        columns, trees, unit, number, params, empty = self.columns, self.trees, self.unit, self.number, self.params, self._empty(nodes, features)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                bins = batch[columns].to_numpy()
                residual = batch["y"].to_numpy() - _in_units(_after(batch["so_far"].to_numpy(), bins, trees), unit)
                mine = sampled(batch["pos"].to_numpy(), number, params)
                _counted(bins[mine], tree.leaves(bins[mine]), residual[mine], np.ones(int(mine.sum()), dtype=np.int64), empty)
            made = [(n, f, b, int(s), int(c)) for n, by in empty.items() for f, hist in by.items() for b, (s, c) in enumerate(hist) if c]
            if made:
                yield pd.DataFrame(made, columns=["node", "feature", "bin", "s", "c"])

        sums = self.rows.mapInPandas(count, "node long, feature long, bin long, s long, c long").groupBy("node", "feature", "bin").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        out = self._empty(nodes, features)
        for r in sums.collect():  # leaves by features by bins, whatever the number of rows
            out[r["node"]][r["feature"]][r["bin"]] = (r["s"], r["c"])
        return out

    def add(self, tree: Tree) -> None:
        self.trees = (*self.trees, tree)


class _FromCells(_Source):
    """One Spark job a sample of rows: label sums and counts of each combination of bins. Rows of one combination are in
    one leaf of every tree, so nothing more is needed; combinations are at most MOST_CELLS, whatever the number of rows.
    """

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.bins = np.array(np.unravel_index(np.arange(int(np.prod(self.n_bins))), self.n_bins)).T
        self.made = np.full(len(self.bins), self.base)
        self.bag = None

    def start(self, number: int) -> None:
        params, columns, shape = self.params, self.columns, tuple(self.n_bins)
        bag = number // params.bagging_freq if params.bagging_freq and params.bagging_fraction < 1 else 0
        if bag == self.bag:
            return
        self.bag = bag

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                mine = sampled(batch["pos"].to_numpy(), number, params)
                cell = np.ravel_multi_index(batch[columns].to_numpy()[mine].T, shape)
                yield pd.DataFrame({"cell": cell, "y": batch["y"].to_numpy()[mine]}).groupby("cell", as_index=False).agg(s=("y", "sum"), c=("y", "size"))

        if not params.bagging_freq or params.bagging_fraction == 1:
            parts = self.rows.select(_cell([F.col(c) for c in columns], shape).alias("cell"), F.col("y").alias("s"), F.lit(1).alias("c"))
        else:
            parts = self.rows.mapInPandas(count, "cell long, s long, c long")
        sums = parts.groupBy("cell").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).toPandas()
        self.y, self.n = np.zeros(len(self.bins), dtype=np.int64), np.zeros(len(self.bins), dtype=np.int64)
        self.y[sums["cell"]], self.n[sums["cell"]] = sums["s"], sums["c"]

    def histograms(self, tree: Tree, nodes: list[int], features: list[int]) -> dict[int, dict[int, np.ndarray]]:
        out = self._empty(nodes, features)
        _counted(self.bins, tree.leaves(self.bins), self.y - self.n * _in_units(self.made, self.unit), self.n, out)
        return out

    def add(self, tree: Tree) -> None:
        self.made = _after(self.made, self.bins, (tree,))


def _cell(bins: list[Column], n_bins: tuple[int, ...]) -> Column:
    """The number of a combination of bins, the first feature's counting most."""
    at = F.lit(0).cast("long")
    for b, n in zip(bins, n_bins, strict=True):
        at = at * n + b
    return at


def _after(made: np.ndarray, bins: np.ndarray, trees: tuple[Tree, ...]) -> np.ndarray:
    for tree in trees:
        made = made + np.array(tree.value)[tree.leaves(bins)]
    return made


def _in_units(values: np.ndarray, unit: float) -> np.ndarray:
    return np.rint(values / unit).astype(np.int64)


def fit(data: DataFrame, columns: list[str], params: Params | None = None, bins: int = BINS, most_cells: int = MOST_CELLS) -> Ensemble:
    """Trees for the train rows of ``data`` (columns, y, split, pos); squared error, starting from the mean label.

    Features must be present and finite (``models.check_inputs``). A node is only split where both sides keep
    min_child_samples sampled rows. ``bagging_freq`` k: a new sample of rows every k trees; 0: all rows always.
    Features of few bins together (``most_cells`` combinations at most) are summed up once a sample, others once a round; trees
    are the same.
    """
    params = params or Params()
    train = data.where("split = 'train'")
    edges = bin_edges(train, columns, bins)
    known = train.agg(F.max(F.abs("y")).alias("top"), F.count("*").alias("n")).first()
    if not known["n"]:
        raise ValueError("no train rows")
    # A power of 2 so small that a row has 40 bits or more, and no sum passes 2^61.
    unit = float(2.0 ** np.ceil(np.log2(max(4 * known["top"], 1e-290) * known["n"] / 2.0**60)))
    n_bins = [len(e) + 1 for e in edges]
    binned_columns = [_bin_column(c, e).alias(f"bin{k}") for k, (c, e) in enumerate(zip(columns, edges, strict=True))]
    rows = train.select("pos", F.rint(F.col("y") / unit).cast("long").alias("y"), *binned_columns)
    rows = materialize(rows, "binned")
    base = rows.agg(F.sum("y")).first()[0] * unit / known["n"]  # a sum of whole numbers, so the same in any order
    source = (_FromCells if np.prod([float(n) for n in n_bins]) <= most_cells else _FromRows)(rows.withColumn("so_far", F.lit(base)), n_bins, base, unit, params)
    trees: list[Tree] = []
    for number in range(params.n_estimators):
        source.start(number)
        grower = _Grower(params, tree_features(len(columns), number, params))
        grower.learn(0, source.histograms(grower.tree, [0], grower.features)[0])
        while True:
            done, unknown = grower.grown()
            if not unknown:
                break
            left = grower.look_ahead(unknown)
            for parent, (child, hist) in zip(unknown, source.histograms(grower.tree, left, grower.features).items(), strict=True):
                grower.learn(child, hist)
                grower.learn(child + 1, {f: grower.hists[parent][f] - hist[f] for f in hist})
        trees.append(grower.result(done, unit, params.learning_rate))
        source.add(trees[-1])
    return Ensemble(tuple(columns), tuple(map(tuple, edges)), base, tuple(trees))


def predicted(values: np.ndarray, model: Ensemble) -> np.ndarray:
    """Predictions for rows of feature values."""
    bins = binned(values, model.edges)
    return _after(np.full(len(values), model.base), bins, model.trees)


def with_predictions(data: DataFrame, model: Ensemble, most_cells: int = MOST_CELLS) -> DataFrame:
    """``data`` with ``prediction``.

    Rows of one combination of bins have one prediction; where there are few combinations, trees are followed once for each of
    them, not for each row.
    """
    columns, n_bins = list(model.columns), tuple(len(e) + 1 for e in model.edges)
    if columns and np.prod([float(n) for n in n_bins]) <= most_cells:
        cells = np.array(np.unravel_index(np.arange(int(np.prod(n_bins))), n_bins)).T
        values = _after(np.full(len(cells), model.base), cells, model.trees)
        known = data.sparkSession.createDataFrame(list(enumerate(values.tolist())), "_cell long, prediction double")
        at = _cell([_bin_column(c, list(e)) for c, e in zip(columns, model.edges, strict=True)], n_bins)
        return data.withColumn("_cell", at).join(F.broadcast(known), "_cell", "left").drop("_cell")

    @F.pandas_udf("double")
    def made(*features: pd.Series) -> pd.Series:
        return pd.Series(predicted(np.column_stack([f.to_numpy(dtype=float) for f in features]), model))

    return data.withColumn("prediction", made(*[F.col(c).cast("double") for c in columns]))
