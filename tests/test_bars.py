import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, models, performance, splits
from tidemark.operators.validation import BarError, validate_bars, violations
from tidemark.plans import pipelines
from tidemark.sources.bars import sample_bars

DAY = dt.datetime(2026, 1, 1)


def bars(spark, closes, ticker="A"):
    rows = [(DAY + dt.timedelta(days=i), ticker, c, c + 1, c - 1, c, 100 + i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "date timestamp_ntz, ticker string, open double, high double, low double, close double, volume long")


def column(df, name, ticker="A"):
    return [r[0] for r in df.where(F.col("ticker") == ticker).orderBy("date").select(name).collect()]


def test_sample_bars(spark):
    rows = sample_bars(spark).orderBy("ticker", "date").collect()
    assert len(rows) == 24 and rows[0]["date"] == dt.datetime(2026, 1, 2) and rows[1]["date"] == dt.datetime(2026, 1, 5)
    assert (rows[0]["close"], rows[0]["open"], rows[0]["volume"], rows[11]["volume"]) == (50.15, 50.0, 1200, 1475)
    assert validate_bars(sample_bars(spark)).count() == 24


def test_indicators_by_hand(spark):
    df = features.add_technical_indicators(bars(spark, [10.0, 11.0, 13.0, 12.0, 15.0]), (3,), (3,), (3,))
    assert column(df, "sma_3d")[2] == pytest.approx(34 / 3)
    assert column(df, "ema_3d")[:2] == [None, None] and column(df, "ema_3d")[3] == pytest.approx(11.875)
    assert column(df, "rsi_3d")[3] == pytest.approx(75.0)


def test_rsi_extremes(spark):
    two = bars(spark, [50.0, 52.0, 54.0, 56.0], "U").union(bars(spark, [100.0, 90.0, 80.0, 70.0], "D")).union(bars(spark, [5.0] * 4, "F"))
    df = features.add_technical_indicators(two, (2,), (2,), (2,))
    assert [column(df, "rsi_2d", t)[-1] for t in "UDF"] == [100.0, 0.0, 50.0]


def test_no_look_ahead_and_isolation(spark):
    make = lambda last: features.add_price_volume_features(bars(spark, [10.0, 11.0, 13.0, 17.0, last]).union(bars(spark, [1.0, 2.0, 3.0], "B")), (1, 2), (2,), (2,))
    for c in ("price_momentum_2d", "price_volatility_2d", "volume_average_2d"):
        assert column(make(19.0), c)[:4] == column(make(999.0), c)[:4]
    assert column(make(19.0), "price_momentum_1d", "B")[0] is None


def test_label_and_zero_price(spark):
    df = features.add_forward_return_label(bars(spark, [10.0, 11.0, 13.0, 0.0, 19.0]), 2, 1, label="label_y")
    assert column(df, "label_y")[:2] == [pytest.approx(13 / 11 - 1), pytest.approx(-1.0)] and column(df, "label_y")[2] == math.inf
    assert column(df, "label_y")[3:] == [None, None]
    with pytest.raises(ValueError):
        features.add_forward_return_label(df, 1, 1)


def test_violations_and_order(spark):
    good = bars(spark, [10.0, 11.0])
    bad = good.withColumn("volume", -F.col("volume")).union(good).withColumn("high", F.when(F.col("volume") == 100, 0.0).otherwise(F.col("high")))
    rules = {r["rule"] for r in violations(bad).collect()}
    assert rules == {"negative_volume", "high_below_low", "open_outside", "close_outside", "duplicate_key"}
    with pytest.raises(BarError, match="negative_volume"):
        validate_bars(bad)
    with pytest.raises(BarError, match="missing required columns: close"):
        validate_bars(good.drop("close"))
    texts = good.select(F.col("date").cast("string").alias("date"), F.lit(2330).alias("ticker"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")])
    assert validate_bars(texts).first()["ticker"] == "2330"
    with pytest.raises(BarError, match="not_numeric_close"):
        validate_bars(texts.withColumn("close", F.lit("x")))


def test_matrix_rules(spark):
    frame = pipelines.smoke_frame(sample_bars(spark))
    matrix = features.feature_matrix(frame, pipelines.SMOKE_LABEL)
    assert matrix.columns == ["pos", "date", "ticker", *pipelines.SMOKE_FEATURES, "y"]
    rows = matrix.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(24)) and rows == sorted(rows, key=lambda r: (r["date"], r["ticker"]))
    for chosen in (["close"], ["nothing"], [], ["price_momentum_1d"] * 2, [pipelines.SMOKE_LABEL]):
        with pytest.raises(ValueError):
            features.feature_columns(frame, pipelines.SMOKE_LABEL, chosen)


def test_golden_smoke_models(spark):
    frame = pipelines.smoke_frame(sample_bars(spark))
    split = splits.temporal_split(pipelines.complete_matrix(frame, complete=False), "2026-01-07", "2026-01-12")
    counts = {r["split"]: r["n"] for r in splits.split_summary(split).collect()}
    assert counts == {"train": 8, "validation": 6, "test": 10}
    assert models.fit_constant(split, "mean") == pytest.approx(0.024035964461991133, abs=1e-15)
    assert models.fit_constant(split, "median") == pytest.approx(0.02337506967450309, abs=1e-15)
    ready = pipelines.prepared(frame, "2026-01-07", "2026-01-12")
    rows = {r["split"]: (r["before"], r["after"], r["dropped"]) for r in splits.supervised_counts(ready).collect()}
    assert rows == {"train": (2, 2, 0), "validation": (6, 6, 0), "test": (10, 4, 6)}


def test_scaler_and_ols(spark):
    rows = [("train", 1.0, 10.0), ("train", 3.0, 14.0), ("train", 5.0, 18.0), ("test", 99.0, None)]
    split = spark.createDataFrame(rows, "split string, feature_a double, feature_b double")
    scaler = splits.fit_scaler(split, ["feature_a", "feature_b"])
    assert scaler["feature_a"] == (3.0, pytest.approx(1.632993161855452)) and scaler["feature_b"] == (14.0, pytest.approx(3.265986323710904))
    with pytest.raises(ValueError, match="constant"):
        splits.fit_scaler(split.withColumn("feature_a", F.lit(0.1)), ["feature_a"])
    points = [("train", i, float(a), float(b), 1 + 2 * a - 0.5 * b) for i, (a, b) in enumerate([(0, 1), (1, 0), (2, 3), (3, 1)])]
    model = models.fit_ols(spark.createDataFrame(points, "split string, pos long, a double, b double, y double").repartition(3), ["a", "b"])
    assert model.intercept == pytest.approx(1.0) and model.coefficients == (pytest.approx(2.0), pytest.approx(-0.5))


def test_walk_forward(spark):
    plan = splits.walk_forward_windows(spark, 12, 4, 2, 2).orderBy("window").collect()
    assert [tuple(r)[2:] for r in plan] == [(3, 4, 5, 6, 7), (5, 6, 7, 8, 9), (7, 8, 9, 10, 11)]
    matrix = pipelines.complete_matrix(pipelines.smoke_frame(sample_bars(spark)))
    got = pipelines.walk_forward_supervised(matrix, pipelines.SMOKE_FEATURES, 4, 2, 2).orderBy("window").collect()
    assert len(got) == 6 and (got[-1]["n_labels"], got[-1]["validation_after"], got[-1]["test_after"]) == (12, 0, 0)
    for method, value in (("mean", 0.024210705719453496), ("median", 0.023717805534439806)):
        first = pipelines.walk_forward_baseline(matrix, 4, 2, 2, method=method).where("window = 0").first()
        assert first["prediction"] == pytest.approx(value, abs=1e-15)
    with pytest.raises(ValueError):
        splits.n_windows(5, 4, 2, 2)


def test_performance_golden(spark):
    rows = [("s", DAY + dt.timedelta(days=i), r) for i, r in enumerate([0.10, 0.0, -0.05])] + [("none", DAY, None)]
    returns = spark.createDataFrame(rows, "series_id string, date timestamp_ntz, ret double")
    got = {r["series_id"]: r for r in performance.performance_summary(returns, 1).collect()}
    assert got["s"]["total_return"] == pytest.approx(0.045) and got["s"]["annual_volatility"] == pytest.approx(0.062360956446)
    assert got["s"]["sharpe_ratio"] == pytest.approx(0.267261241912) and got["s"]["max_drawdown"] == pytest.approx(-0.05)
    assert got["none"]["total_return"] == got["none"]["cagr"] == got["none"]["max_drawdown"] == 0.0
    assert performance.performance_summary(returns, 3).where("series_id = 's'").first()["cagr"] == pytest.approx(0.045)


def test_evaluation_counts(spark):
    rows = [("m", "x", "test", 0, 1.0, 2.0), ("m", "x", "test", 1, None, 4.0)]
    got = models.evaluate(spark.createDataFrame(rows, "model_name string, method string, split string, pos long, y double, prediction double")).first()
    assert (got["row_count"], got["non_missing_count"], got["mae"], got["prediction_mean"]) == (2, 1, 1.0, 3.0)
