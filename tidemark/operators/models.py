"""Constant, least-squares and boosted-tree models; predictions, their errors and comparisons."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.medians import prefix_medians
from tidemark.sources.staging import materialize, tasks_for

PREDICTION_COLUMNS = ("model_name", "method", "split", "pos", "y", "prediction")


def check_inputs(data: DataFrame, columns: list[str]) -> None:
    """Features of every split and labels of train rows must be present and finite; holdout labels are not read."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf"))
    bad = [F.count_if(~good(c)).alias(c) for c in columns] + [F.count_if((F.col("split") == "train") & ~good("y")).alias("y")]
    row = data.agg(F.count_if(F.col("split") == "train").alias("_train"), *bad).first()
    if not row["_train"]:
        raise ValueError("no train rows")
    wrong = [c for c in [*columns, "y"] if row[c]]
    if wrong:
        raise ValueError("missing or infinite values: " + ", ".join(wrong))


def fit_constant(data: DataFrame, method: str = "mean") -> float:
    """Mean or exact median of the train labels. No task sees them all (``medians``)."""
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method: {method}")
    train = data.where("split = 'train'")
    if method == "mean":
        value = train.agg(F.avg("y")).first()[0]
    else:
        value = prefix_medians(train.select(F.lit(0).cast("long").alias("window"), "y"), 1).get(0)
    if value is None:
        raise ValueError("no train labels")
    return value


def predict_constant(data: DataFrame, value: float, method: str, name: str = "constant_baseline") -> DataFrame:
    return bundle(data.withColumn("prediction", F.lit(value)), name, method)


@dataclass(frozen=True)
class LinearModel:
    columns: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    method: str


def fit_ols(data: DataFrame, columns: list[str], fit_intercept: bool = True) -> LinearModel:
    """Least squares of least norm by a tall-skinny QR: factors of k by k are all that leaves a task.

    Each partition gives one factor; factors are combined in at most 64 groups, by partition number, before
    the driver solves the last, small system.
    """
    k = len(columns) + int(fit_intercept) + 1

    def factor(block: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(np.linalg.qr(block, mode="r"), columns=[f"c{i}" for i in range(k)])

    def by_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, k))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            if len(x):
                held = np.linalg.qr(np.vstack([held, np.hstack([np.ones((len(x), int(fit_intercept))), x])]), mode="r")
        if len(held):
            yield factor(held).assign(part=TaskContext.get().partitionId() % 64)

    fields = ", ".join(f"c{i} double" for i in range(k))
    factors = data.where("split = 'train'").select(*columns, "y").mapInPandas(by_partition, f"{fields}, part long")
    merged = factors.groupBy("part").applyInPandas(lambda p: factor(p.drop(columns="part").to_numpy()), fields)
    rows = np.array([list(r) for r in merged.collect()]).reshape(-1, k)
    if not len(rows):
        raise ValueError("no train rows")
    r = np.linalg.qr(rows, mode="r")
    beta = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0]
    b0 = float(beta[0]) if fit_intercept else 0.0
    return LinearModel(tuple(columns), tuple(map(float, beta[int(fit_intercept) :])), b0, "ols_with_intercept" if fit_intercept else "ols_no_intercept")


def predict_ols(data: DataFrame, model: LinearModel, name: str = "linear_regression") -> DataFrame:
    total = F.lit(model.intercept)
    for c, b in zip(model.columns, model.coefficients, strict=True):
        total = total + F.col(c) * F.lit(b)
    return bundle(data.withColumn("prediction", total), name, model.method)


def fit_boosted(data: DataFrame, columns: list[str], **params) -> boosting.Ensemble:
    """Boosted trees of the parameters of ``boosting.Params``, grown leaf by leaf on the train rows."""
    return boosting.fit(data, columns, boosting.Params(**params))


def predict_boosted(data: DataFrame, columns: list[str], model: boosting.Ensemble, name: str = "boosted_trees") -> DataFrame:
    if tuple(columns) != model.columns:
        raise ValueError(f"the trees were grown on {', '.join(model.columns)}")
    return bundle(boosting.with_predictions(data, model), name, "gbt")


def bundle(predicted: DataFrame, name: str, method: str) -> DataFrame:
    if not name.strip():
        raise ValueError("empty model name")
    return predicted.select(F.lit(name.strip()).alias("model_name"), F.lit(method).alias("method"), "split", "pos", "y", "prediction")


def check_bundle(predictions: DataFrame) -> DataFrame:
    """The predictions; raises unless positions are unique in a model, none is missing, and train and test have some."""
    if predictions.groupBy("model_name", "pos").count().where("count > 1").limit(1).count():
        raise ValueError("a position is predicted twice")
    check_parts(predictions)
    return predictions


def check_parts(predictions: DataFrame) -> None:
    """Raises where a prediction is missing, or a model has none for train or test."""
    for row in predictions.groupBy("model_name").agg(
        F.count_if(F.col("prediction").isNull() | F.isnan("prediction")).alias("missing"),
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"),
    ).collect():
        if row["missing"] or not row["train"] or not row["test"]:
            raise ValueError(f"missing predictions, or none for train or test: {row['model_name']}")


def check_evaluated(evaluations: DataFrame) -> DataFrame:
    """``check_bundle`` and ``check_evaluations`` by what ``evaluate`` has counted of predictions whose positions come from
    one written matrix, so are unique: the evaluations, written (a few rows); raises where a prediction is missing, or train, test or a split's actual values are.
    """
    out = materialize(evaluations, "evaluations")
    rows = out.select("model_name", "split", "row_count", "missing_prediction_count").collect()
    for name in {r["model_name"] for r in rows}:
        mine = [r for r in rows if r["model_name"] == name]
        if any(r["missing_prediction_count"] for r in mine) or not {"train", "test"} <= {r["split"] for r in mine}:
            raise ValueError(f"missing predictions, or none for train or test: {name}")
    return check_evaluations(out).drop("missing_prediction_count")


def with_actuals(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """``predictions`` (without their y) with y from ``actuals`` (pos, y) by position.

    Raises unless positions are unique on both sides and every prediction has an actual row. Both sides are dealt by position
    once, in tasks of a bounded number of rows; the guards are counted while their join is written.
    """
    kinds = dict(actuals.dtypes)
    if kinds["y"] not in ("double", "float", "int", "bigint", "smallint", "tinyint"):
        raise ValueError("actual values must be numbers")
    n, seen = tasks_for(actuals), Observation("actuals")
    same = lambda *by: Window.partitionBy(*by).orderBy(by[-1])
    # The second row of a key tells that there are two; of actual values the first alone is joined.
    right = actuals.select("pos", F.col("y").cast("double").alias("y")).repartition(n, "pos").withColumns(
        {"_k": F.row_number().over(same("pos")), "_more": F.lead(F.lit(True)).over(same("pos"))}
    ).where("_k = 1")
    left = predictions.drop("y").repartition(n, "pos").withColumn("_twice", F.row_number().over(same("pos", "model_name")) > 1)
    both = left.alias("l").join(right.alias("r"), F.col("l.pos") == F.col("r.pos"), "full").observe(
        seen,
        F.count_if(F.col("_k").isNotNull() & (F.col("_more").isNotNull() | F.col("r.pos").isNull())).alias("bad"),
        F.count_if(F.col("_twice").isNotNull() & F.col("_k").isNull()).alias("none"), F.count_if("_twice").alias("twice"),
    )
    out = materialize(both.where("_twice is not null").select(*[F.col(f"l.{c}") if c != "y" else F.col("r.y") for c in PREDICTION_COLUMNS]), "actuals")
    if seen.get["bad"]:
        raise ValueError("a position has two actual values, or none has a position")
    if seen.get["none"]:
        raise ValueError("a prediction has no actual row")
    if seen.get["twice"]:
        raise ValueError("a position is predicted twice")
    check_parts(out)
    return out


def check_evaluations(evaluations: DataFrame) -> DataFrame:
    """The evaluations; raises where a model has a split without any actual value."""
    empty = evaluations.where("non_missing_count = 0").select("model_name", "split").limit(1).collect()
    if empty:
        raise ValueError(f"no actual values: {empty[0]['model_name']}, {empty[0]['split']}")
    return evaluations


def evaluate(predictions: DataFrame, count_missing: bool = False) -> DataFrame:
    """Errors by model and split, over rows with an actual value; the mean prediction is over all rows."""
    missing = [F.count_if(F.col("prediction").isNull() | F.isnan("prediction")).alias("missing_prediction_count")] * count_missing
    e = F.col("prediction") - F.col("y")
    return predictions.groupBy("model_name", "method", "split").agg(
        F.count("*").alias("row_count"), F.count("y").alias("non_missing_count"), F.count_if(F.col("y").isNull()).alias("missing_actual_count"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_error"), F.avg("prediction").alias("prediction_mean"), *missing,
    )


def compare(evaluations: DataFrame, reference: str, candidate: str, check: bool = True) -> DataFrame:
    """Candidate less reference on each split; both must have been evaluated on as many rows."""
    counts, metrics = ("row_count", "non_missing_count", "missing_actual_count"), ("mae", "rmse", "mean_error", "prediction_mean")
    a, b = (evaluations.where(F.col("model_name") == n).select("split", *[F.col(c).alias(f"{p}_{c}") for c in counts + metrics]) for n, p in ((reference, "a"), (candidate, "b")))
    both = a.join(b, "split")
    if check:
        differ = both.where(" or ".join(f"a_{c} != b_{c}" for c in counts))
        if differ.limit(1).count():
            raise ValueError("evaluated on different rows")
    return both.select(
        F.lit(reference).alias("reference_name"), F.lit(candidate).alias("candidate_name"), "split", *[F.col(f"a_{c}").alias(c) for c in counts],
        *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"{m}_delta") for m in metrics],
    )
