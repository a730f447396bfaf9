"""Temporal and walk-forward splits, train-only scaling, supervised rows.

Walk-forward windows count rows in (date, ticker) order, as positions do, so a window's edge may
cut a date, and nothing separates a train label's horizon from the validation rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.validation import BarError
from tidemark.sources.staging import tasks_for

SPLITS = ("train", "validation", "test")


def split_of(train_end: str, validation_end: str | None = None, test_end: str | None = None) -> Column:
    """The split of a date; NULL past test_end. Boundaries that do not increase raise."""
    bounds = [dt.datetime.fromisoformat(b) for b in (train_end, validation_end, test_end) if b is not None]
    if any(a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ValueError("boundaries must increase")
    at = lambda b: F.lit(b).cast("timestamp_ntz")
    d = F.col("date").cast("timestamp_ntz")
    split = F.when(d <= at(train_end), "train")
    if validation_end is not None:
        split = split.when(d <= at(validation_end), "validation")
    return split.when(F.lit(True) if test_end is None else d <= at(test_end), "test")


def check_splits(counts: dict[str | None, int], validation: bool) -> None:
    """Raises where rows lie past the last boundary or a requested split has none."""
    wanted = ["train", "test"] + ["validation"] * validation
    if counts.get(None) or any(not counts.get(w) for w in wanted):
        raise ValueError(f"rows beyond the last boundary or an empty split: {counts}")


def temporal_split(matrix: DataFrame, train_end: str, validation_end: str | None = None, test_end: str | None = None, strict: bool = True) -> DataFrame:
    """Adds ``split``. With ``strict``, rows past test_end and empty requested splits raise."""
    out = matrix.withColumn("split", split_of(train_end, validation_end, test_end))
    if strict:
        counts = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
        check_splits(counts, validation_end is not None)
    return out


class Facts:
    """What is counted of a split matrix while it is written: keys, splits, train statistics, values that models refuse.

    ``watch`` puts the counters into a plan; once that has run, ``check_keys``, ``check_splits``, ``scaler`` and
    ``check_inputs`` raise or answer as the functions of those names do, without another job.
    """

    def __init__(self, columns: list[str], validation: bool = True) -> None:
        self.columns, self.validation, self.seen = list(columns), validation, Observation("facts")

    def watch(self, rows: DataFrame, repeated: str) -> DataFrame:
        """``rows`` have pos, date, ticker, the columns, y, split and the flag of repeated keys."""
        at = lambda s: F.coalesce(F.col("split") == s, F.lit(False))
        train, labelled = at("train"), F.col("y").isNotNull()
        good = lambda c: F.coalesce(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
        made = [
            F.count_if(F.col("date").isNull() | F.col("ticker").isNull() | F.col(repeated)).alias("bad_keys"), F.count_if(F.col("split").isNull()).alias("n_beyond"),
            *[F.count_if(at(s)).alias(f"n_{s}") for s in SPLITS], F.count_if(train & labelled).alias("n_labelled"), F.count_if(train & labelled & ~good("y")).alias("bad_y"),
        ]
        for c in self.columns:
            x = F.when(train, F.col(c))
            made += [f(x).alias(f"{c}_{k}") for k, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max), ("n", F.count))]
            made.append(F.count_if(labelled & ~good(c)).alias(f"{c}_bad"))
        return rows.observe(self.seen, *made)

    def __getitem__(self, name: str):
        return self.seen.get[name]

    def check_keys(self) -> None:
        if self["bad_keys"]:
            raise BarError("missing or duplicate date and ticker")

    def check_splits(self) -> None:
        check_splits({None: self["n_beyond"]} | {s: self[f"n_{s}"] for s in SPLITS}, self.validation)

    def scaler(self) -> dict[str, tuple[float, float]]:
        for c in self.columns:
            if self[f"{c}_n"] < self["n_train"] or not self["n_train"]:
                raise ValueError(f"missing train values: {c}")
            if self[f"{c}_lo"] == self[f"{c}_hi"]:
                raise ValueError(f"constant train values: {c}")
        return {c: (self[f"{c}_m"], self[f"{c}_s"]) for c in self.columns}

    def check_inputs(self) -> None:
        """For models of the labelled rows."""
        if not self["n_labelled"]:
            raise ValueError("no train rows")
        wrong = [c for c in self.columns if self[f"{c}_bad"]] + ["y"] * bool(self["bad_y"])
        if wrong:
            raise ValueError("missing or infinite values: " + ", ".join(wrong))


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def n_windows(count: int, train: int, validation: int, test: int, step: int | None = None, most: int | None = None) -> int:
    step = test if step is None else step
    if min(train, validation, test, step) < 1 or (most is not None and most < 1):
        raise ValueError("sizes must be positive")
    n = (count - train - validation - test) // step + 1
    n = n if most is None else min(n, most)
    if n < 1:
        raise ValueError("no walk-forward window fits")
    return n


def walk_forward_windows(spark: SparkSession, count: int, train: int, validation: int, test: int, step: int | None = None, most: int | None = None) -> DataFrame:
    """Inclusive position ranges of expanding windows, one row each."""
    n = n_windows(count, train, validation, test, step, most)
    end = train + F.col("id") * (test if step is None else step)
    return spark.range(n).select(
        F.col("id").alias("window"), F.lit(0).cast("long").alias("train_start"), (end - 1).alias("train_end"),
        end.alias("validation_start"), (end + validation - 1).alias("validation_end"),
        (end + validation).alias("test_start"), (end + validation + test - 1).alias("test_end"),
    )


def assign_windows(matrix: DataFrame, n: int, train: int, validation: int, test: int, step: int | None = None) -> DataFrame:
    """A row per validation or test row and window that holds it: by arithmetic on positions, not by a range join."""
    step = test if step is None else step
    found = []
    for split, base, size in (("validation", train, validation), ("test", train + validation, test)):
        low = F.greatest(F.lit(0), F.ceil((F.col("pos") - base - size + 1) / step)).cast("long")
        high = F.least(F.lit(n - 1), F.floor((F.col("pos") - base) / step)).cast("long")
        rows = matrix.withColumns({"_low": low, "_high": high}).where("_low <= _high")
        found.append(rows.withColumn("window", F.explode(F.sequence("_low", "_high"))).withColumn("split", F.lit(split)).drop("_low", "_high"))
    return found[0].unionByName(found[1])


def first_window(train: int, step: int):
    """The first window that trains on a position."""
    return F.greatest(F.lit(0), F.floor((F.col("pos") - train) / step) + 1).cast("long")


def train_prefix_stats(matrix: DataFrame, columns: list[str], n: int, train: int, step: int) -> DataFrame:
    """``window, n_train, n_labels, label_mean, <c>_mean, <c>_std`` over each window's train rows in one pass.

    Rows are put together by the first window that trains on them; windows are running sums over
    those groups, of squared deviations from one middle value per column, so that large means cancel nothing.
    """
    rows = matrix.withColumn("window", first_window(train, step)).where(F.col("window") < n)
    groups = rows.groupBy("window").agg(
        F.count("*").alias("n_train"), F.count("y").alias("n_labels"), F.sum("y").alias("sum_y"),
        *[f(F.col(c)).alias(f"{c}_{k}") for c in columns for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))],
    )
    every = matrix.sparkSession.range(n).withColumnRenamed("id", "window").join(groups, "window", "left")
    so_far = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, 0)  # over windows alone
    whole = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda x: F.coalesce(x, F.lit(0))
    middle = {f"{c}_c": F.first(f"{c}_m", ignorenulls=True).over(whole) for c in columns}
    every = every.withColumns(middle)
    parts = {"n_train": F.col("n_train"), "n_labels": F.col("n_labels"), "sum_y": F.col("sum_y")}
    for c in columns:
        k, off = F.col(f"{c}_n"), F.col(f"{c}_m") - F.col(f"{c}_c")
        parts |= {f"{c}_n": k, f"{c}_s": k * off, f"{c}_q": k * (F.col(f"{c}_v") + off * off)}
    run = every.select("window", *[f"{c}_c" for c in columns], *[F.sum(zero(x)).over(so_far).alias(name) for name, x in parts.items()])
    stats = []
    for c in columns:
        k, mean = F.col(f"{c}_n"), F.col(f"{c}_s") / F.nullif(F.col(f"{c}_n"), F.lit(0))
        spread = F.sqrt(F.greatest(F.lit(0.0), F.col(f"{c}_q") / F.nullif(k, F.lit(0)) - mean * mean))
        stats += [(F.col(f"{c}_c") + mean).alias(f"{c}_mean"), spread.alias(f"{c}_std")]
    return run.select("window", "n_train", "n_labels", F.when(F.col("n_labels") > 0, F.col("sum_y") / F.col("n_labels")).alias("label_mean"), *stats)


def window_dates(assigned: DataFrame) -> DataFrame:
    """``window, split, n, first_date, last_date``: observed dates of each window's validation and test rows."""
    return assigned.groupBy("window", "split").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def scale_by_window(assigned: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of windows with ``columns`` scaled by their window's train statistics; a constant column raises ValueError."""
    if stats.where(" or ".join(f"not {c}_std > 0" for c in columns)).limit(1).count():
        raise ValueError("constant train values in a window")
    params = stats.select("window", *[f"{c}_{k}" for c in columns for k in ("mean", "std")])
    made = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}
    # A row per window: rows stay where they are, instead of a window's rows meeting in one task.
    return assigned.join(F.broadcast(params), "window").withColumns(made).drop(*[f"{c}_{k}" for c in columns for k in ("mean", "std")])


def join_labels(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """``matrix`` with y from ``labels`` (pos, y) of another table, by position; rows without a label row go."""
    n = tasks_for(labels)
    return matrix.drop("y").repartition(n, "pos").join(labels.select("pos", "y").repartition(n, "pos"), "pos")


def fit_scaler(split: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of train rows. Missing values and constant columns raise."""
    kinds = dict(split.dtypes)
    for c in columns:
        if kinds.get(c) not in ("double", "float", "int", "bigint", "smallint", "tinyint"):
            raise ValueError(f"not a numeric column: {c}")
    aggs = [f(F.col(c)).alias(f"{c}_{k}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max), ("n", F.count))]
    row = split.where("split = 'train'").agg(F.count("*").alias("n"), *aggs).first()
    for c in columns:
        if row[f"{c}_n"] < row["n"] or not row["n"]:
            raise ValueError(f"missing train values: {c}")
        if row[f"{c}_lo"] == row[f"{c}_hi"]:
            raise ValueError(f"constant train values: {c}")
    return {c: (row[f"{c}_m"], row[f"{c}_s"]) for c in columns}


def scale(split: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    if any(not s > 0 for _, s in scaler.values()):
        raise ValueError("deviations must be positive")
    return split.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def supervised(split: DataFrame, drop_missing_labels: bool = True) -> DataFrame:
    """Rows with labels; missing labels raise if they may not be dropped."""
    if not drop_missing_labels and split.where("y is null").limit(1).count():
        raise ValueError("missing labels")
    return split.where("y is not null")


def supervised_counts(split: DataFrame) -> DataFrame:
    """Rows of each split before and after labels are required; empty splits too."""
    names = split.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    counts = split.groupBy("split").agg(F.count("*").alias("before"), F.count("y").alias("after"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(counts, "split", "left").select("split", zero("before"), zero("after")).withColumn("dropped", F.col("before") - F.col("after"))
