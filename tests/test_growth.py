"""Results on ties and rounding, and how much work a query does as its tables grow."""

import datetime as dt
import io
from contextlib import redirect_stdout
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import boosting, features, models, splits
from tidemark.operators.blocks import in_blocks, with_stretches
from tidemark.plans import pipelines, queries
from tidemark.sources import staging
from tidemark.sources.bars import sample_bars, trade_bars

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_blocks_with_equal_times(spark):
    """A run of rows at one time that a block's edge cuts keeps its order around the edge."""
    start = dt.datetime(2024, 1, 1)
    rows = [("all", start + dt.timedelta(seconds=(i // 60) * 7), float(i)) for i in range(600)]
    bars = spark.createDataFrame(rows, "ticker string, date timestamp_ntz, close double")
    made = in_blocks(bars, lambda df: df.withColumn("m", W.mean(F.col("close"), 20)).withColumn("c", W.change(F.col("close") + 1, 1)), before=20, after=20, rows=40)
    got = sorted((r["close"], r["m"], r["c"]) for r in made.collect())
    for i, (close, mean, change) in enumerate(got):
        assert close == i
        assert mean == (pytest.approx(i - 9.5) if i >= 19 else None)
        assert change == (pytest.approx(1 / i) if i else None)
    assert dict(made.dtypes)["date"] == "timestamp_ntz"


@needs_tables
def test_events_without_a_time_come_last(spark, tmp_path):
    """A user's bar without a date follows the others, as in the SQL."""
    db = duckdb.connect()
    db.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = queries.event_features(spark, str(tmp_path)).toPandas(), db.sql(queries.ORACLES["event_features"]).df()
    assert want["date"].isna().sum() > 10
    ordered = [x[want.columns].astype({"date": "datetime64[us]"}).sort_values(["ticker", "date"]).reset_index(drop=True) for x in (got, want)]
    pd.testing.assert_frame_equal(*ordered, check_dtype=False, atol=2e-6, rtol=1e-9)


@needs_tables
def test_ticks_without_a_time_come_last(spark, tmp_path, monkeypatch):
    """As in the SQL, and they stretch no stretch of time back to 1970."""
    db = duckdb.connect()
    db.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id = 500 THEN NULL ELSE ts END AS ts) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    monkeypatch.setattr(queries, "TICKS_A_BLOCK", 100)
    got, want = queries.tick_features(spark, str(tmp_path)).toPandas(), db.sql(queries.ORACLES["tick_features"]).df()
    pd.testing.assert_frame_equal(*(x[want.columns].sort_values("date").reset_index(drop=True).astype({"date": "datetime64[us]"}) for x in (got, want)), atol=2e-6, rtol=1e-9)
    ticks = spark.read.parquet(f"{tmp_path}/events.parquet").select(F.lit("all").alias("ticker"), F.col("ts").cast("timestamp_ntz").alias("date"))
    stretches = with_stretches(ticks, "ticker", 100, "s", undated_last=True).groupBy("s").agg(F.count("*").alias("n"), F.count("date").alias("dated")).orderBy("s").collect()
    assert len(stretches) >= 10 and (stretches[-1]["n"], stretches[-1]["dated"]) == (1, 0)


def test_rounding_is_that_of_the_sql(spark):
    rng = np.random.default_rng(1)
    ties = (rng.integers(-(10**9), 10**9, 4000) * 10 + 5) / 1e7
    xs = [float(x) for x in [*ties, *np.nextafter(ties, np.inf), *rng.normal(size=1000), *rng.normal(size=500) * 1e11, 0.0, -0.0, 1e305, np.inf, -np.inf]]
    db = duckdb.connect()
    want = [db.execute("SELECT round(?::DOUBLE, 6) + 0.0", [x]).fetchall()[0][0] for x in xs]
    df = spark.createDataFrame(list(enumerate(xs)), "i long, x double")
    assert [r["x"] for r in queries._rounded(df).orderBy("i").collect()] == want


def test_labels_are_met_in_tasks_of_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "tasks_for", lambda df: staging.tasks_for(df, 100))
    monkeypatch.setattr(splits, "tasks_for", lambda df: staging.tasks_for(df, 100))
    matrix = spark.range(2000).select(F.col("id").alias("pos"), F.when(F.col("id") < 1500, "train").otherwise("test").alias("split"), F.col("id").cast("double").alias("y"))
    joined = splits.join_labels(matrix, matrix.select("pos", "y"))
    assert joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
    predicted = models.predict_constant(joined, 1.0, "mean")
    out = models.with_actuals(predicted, matrix.select("pos", "y"))
    assert out.count() == 2000 and out.where("y = pos").count() == 2000
    for bad, text in ((matrix.select("pos", "y").union(matrix.select("pos", "y").limit(1)), "two actual"), (matrix.select("pos", "y").where("pos > 0"), "no actual row")):
        with pytest.raises(ValueError, match=text):
            models.with_actuals(predicted, bad)
    with pytest.raises(ValueError, match="predicted twice"):
        models.with_actuals(predicted.union(predicted.limit(1)), matrix.select("pos", "y"))


def test_predictions_by_cell_are_those_by_row(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(a * b + rng.normal()), "train") for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    data = spark.createDataFrame(rows, "pos long, a double, b double, y double, split string")
    model = boosting.fit(data, ["a", "b"], boosting.Params(n_estimators=5), bins=16)
    by_cell, by_row = (boosting.with_predictions(data, model, most_cells=n) for n in (boosting.MOST_CELLS, 0))
    assert [r["prediction"] for r in by_cell.orderBy("pos").collect()] == [r["prediction"] for r in by_row.orderBy("pos").collect()]
    assert "ArrowEvalPython" not in plan(by_cell) and "ArrowEvalPython" in plan(by_row)
    odd = spark.createDataFrame([(0, None, float("nan")), (1, float("inf"), float("-inf"))], "pos long, a double, b double")
    assert [r["prediction"] for r in boosting.with_predictions(odd, model).orderBy("pos").collect()] == [r["prediction"] for r in boosting.with_predictions(odd, model, 0).orderBy("pos").collect()]


def test_bars_and_their_windows_share_one_exchange_and_sort(spark):
    df = features.add_price_volume_features(trade_bars(spark, "/root/testdata/sf0.001"), (5,), (10,), (5,))
    assert plan(df).count("Exchange") == 1 and plan(df).count("Sort [") == 1


def test_windows_run_once_for_a_matrix(spark):
    """What is written holds ranks within dates; dates are counted in it, not in the bars again."""
    bars = sample_bars(spark, 40)
    seen = spark.sparkContext.accumulator(0)
    touch = F.udf(lambda x: (seen.add(1), x)[1], "double")
    frame = features.add_forward_return_label(bars.withColumn("a", touch("close")), 3, 1)
    matrix = pipelines.complete_matrix(frame, ["a"], "label_forward_return_3d_entry_lag_1d")
    n = matrix.count()
    want = frame.select("date", "ticker").toPandas().sort_values(["date", "ticker"])
    assert seen.value == n == 80
    assert [tuple(r) for r in matrix.orderBy("pos").select("pos", "ticker").collect()] == list(zip(range(80), want["ticker"]))


def test_rows_are_not_dealt_by_walk_forward_window(spark):
    matrix = spark.range(1000).select(F.col("id").alias("pos"), F.rand(1).alias("a"), F.rand(2).alias("y"))
    stats = splits.train_prefix_stats(matrix, ["a"], 4, 500, 50)
    rows = splits.scale_by_window(splits.assign_windows(matrix, 4, 500, 100, 100, 50), stats, ["a"])
    assert "BroadcastHashJoin" in plan(rows)
    top = plan(rows).split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning(window" not in top and rows.count() == 800


def test_smoke_summary_reads_the_bars_once(spark):
    seen = spark.sparkContext.accumulator(0)
    touch = F.udf(lambda x: (seen.add(1), x)[1], "double")
    bars = staging.materialize(sample_bars(spark, 30), "bars").withColumn("close", touch("close"))
    row = pipelines.smoke_summary(bars).first()
    assert (row["row_count"], row["ticker_count"], row["label_count"], row["n"]) == (60, 2, 54, 29)
    assert seen.value == 60
