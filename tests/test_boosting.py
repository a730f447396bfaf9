"""Boosted trees against a plain version that looks at every row and split, one leaf at a time."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import boosting as B
from tidemark.operators import models


def table(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.randrange(5) / 2, rng.gauss(0, 1)
        rows.append(("train" if i % 5 else "test", i, a, b, c, math.sin(6 * a) + (b > 1) * a + 0.1 * rng.gauss(0, 1)))
    return rows, spark.createDataFrame(rows, "split string, pos long, a double, b double, c double, y double").repartition(3)


def plain(rows, edges, params):
    """Predictions by plain loops: every leaf's best split tried in full, the best leaf split, again and again."""
    train = [r for r in rows if r[0] == "train"]
    bins = {r[1]: [sum(v > e for e in edges[k]) for k, v in enumerate(r[2:5])] for r in rows}
    base = sum(r[5] for r in train) / len(train)
    made = {r[1]: base for r in rows}
    for number in range(params.n_estimators):
        features = B.tree_features(3, number, params)
        taken = [r for r in train if B.sampled(np.array([r[1]]), number, params)[0]]
        residual = {r[1]: r[5] - made[r[1]] for r in taken}

        def best(leaf):
            found = None
            ids = [i for i in leaf if i in residual]
            for f in features:
                for k in range(len(edges[f])):
                    left = [residual[i] for i in ids if bins[i][f] <= k]
                    right = [residual[i] for i in ids if bins[i][f] > k]
                    if min(len(left), len(right)) < params.min_child_samples:
                        continue
                    gain = sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right) - (sum(left) + sum(right)) ** 2 / len(ids)
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, f, k)
            return found

        leaves = [[r[1] for r in rows]]
        splits = [best(leaves[0])]
        while len(leaves) < params.num_leaves and any(splits):
            k = max((k for k in range(len(leaves)) if splits[k]), key=lambda k: splits[k][0])
            _, f, at = splits[k]
            two = [[i for i in leaves[k] if bins[i][f] <= at], [i for i in leaves[k] if bins[i][f] > at]]
            leaves[k : k + 1], splits[k : k + 1] = two, [best(x) for x in two]
        for leaf in leaves:
            inside = [residual[i] for i in leaf if i in residual]
            for i in leaf:
                made[i] += params.learning_rate * sum(inside) / len(inside)
    return made


@pytest.mark.parametrize("most_cells", [1 << 16, 0])
@pytest.mark.parametrize("options", [{}, {"bagging_freq": 3, "bagging_fraction": 0.6, "n_estimators": 5}, {"feature_fraction": 0.7, "num_leaves": 4}])
def test_against_plain_loops(spark, most_cells, options):
    rows, data = table(spark)
    params = B.Params(**({"n_estimators": 3, "num_leaves": 8, "min_child_samples": 10, "learning_rate": 0.3} | options))
    model = B.fit(data, ["a", "b", "c"], params, bins=8, most_cells=most_cells)
    want = plain(rows, model.edges, params)
    got = {r["pos"]: r["prediction"] for r in B.with_predictions(data, model).collect()}
    assert got == {i: pytest.approx(x, abs=1e-9) for i, x in want.items()}
    leaves = [sum(f < 0 for f in t.feature) for t in model.trees]
    assert max(leaves) == params.num_leaves


def test_written_predictions_and_partitions_change_nothing(spark, monkeypatch):
    _, data = table(spark, 200)
    params = B.Params(n_estimators=5, num_leaves=5, min_child_samples=5, bagging_freq=2, bagging_fraction=0.8)
    whole = B.fit(data, ["a", "b"], params, bins=6)
    monkeypatch.setattr(B, "WRITTEN_EVERY", 2)
    assert B.fit(data.repartition(7), ["a", "b"], params, bins=6, most_cells=0).trees == whole.trees


def test_samples_of_every_third_tree():
    pos, params = np.arange(5000), B.Params(bagging_freq=3, bagging_fraction=0.25)
    bags = [B.sampled(pos, k, params) for k in range(7)]
    assert all((bags[0] == b).all() for b in bags[1:3]) and all((bags[3] == b).all() for b in bags[4:6])
    assert (bags[0] != bags[3]).any() and (bags[3] != bags[6]).any()
    # By hand: a 64-bit finaliser of position, seed and the bag's number.
    mask = (1 << 64) - 1
    for p in range(0, 200, 7):
        x = (p * 0x9E3779B97F4A7C15 + 42 * 1_000_003 + 1) & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor & mask
        assert bags[3][p] == (((x ^ (x >> 31)) >> 11) * 2.0**-53 < 0.25)
    assert abs(bags[0].mean() - 0.25) < 0.03 and B.sampled(pos, 4, B.Params(bagging_fraction=0.25)).all()


def test_defaults_and_odd_tables(spark):
    _, data = table(spark, 400)
    model = models.fit_boosted(data, ["a", "c"], n_estimators=2, min_child_samples=3)
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == [31, 31]
    flat = spark.createDataFrame([("train", i, 1.0, 2.0) for i in range(50)], "split string, pos long, a double, y double")
    assert {r["prediction"] for r in models.predict_boosted(flat, ["a"], models.fit_boosted(flat, ["a"])).collect()} == {2.0}
    with pytest.raises(ValueError, match="no train rows"):
        models.fit_boosted(flat.where("pos < 0"), ["a"])
    assert models.predict_boosted(flat.where("pos < 0"), ["a"], models.fit_boosted(flat, ["a"], n_estimators=1)).count() == 0
