"""Inputs that must be refused, and numbers worked out by hand."""

import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import checked_windows, ema_reach, with_ema
from tidemark.operators import features, models, performance, splits
from tidemark.operators.blocks import in_blocks
from tidemark.operators.medians import prefix_medians
from tidemark.operators.validation import BarError, normalize, validate_bars, violations
from tidemark.plans import pipelines
from tidemark.sources.bars import read_bars, sample_bars, store_bars, write_bars, write_summary

DAY = dt.datetime(2026, 1, 1)
PREDICTIONS = "model_name string, method string, split string, pos long, y double, prediction double"


def text_bars(spark, **changes):
    row = {"date": "2026-01-05", "ticker": "A", "open": "10", "high": "11", "low": "9", "close": "10", "volume": "100"} | changes
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


@pytest.mark.parametrize("changes, message", [
    ({"date": "no day"}, "unreadable_date"), ({"date": None}, "missing_date"), ({"ticker": None}, "missing_ticker"),
    ({"open": "x"}, "not_numeric_open"), ({"volume": "many"}, "not_numeric_volume"), ({"volume": "-0.5"}, "negative_volume"),
    ({"open": None, "low": "NaN"}, "missing_open: 1 rows, missing_low: 1 rows"), ({"high": "8"}, "high_below_low"), ({"open": "12"}, "open_outside"), ({"close": "8"}, "close_outside"),
    ({"date": "no day", "open": "x"}, "unreadable_date"), ({"open": "x", "low": None}, "not_numeric_open"),
])
def test_first_broken_rule_is_reported(spark, changes, message):
    with pytest.raises(BarError, match=message):
        validate_bars(text_bars(spark, **changes))


def test_volumes_are_not_cut(spark):
    assert normalize(text_bars(spark, volume="100.7")).first()["volume"] == 100.7
    assert validate_bars(text_bars(spark, volume="Infinity")).first()["volume"] == float("inf")
    assert dict(normalize(sample_bars(spark)).dtypes)["volume"] == "bigint"


def test_five_examples_in_order(spark):
    rows = [(DAY + dt.timedelta(days=i), t, 1.0, 2.0, 0.5, 1.0, -1) for i in (3, 1, 2) for t in "BAC"]
    bars = spark.createDataFrame(rows, "date timestamp_ntz, ticker string, open double, high double, low double, close double, volume long")
    with pytest.raises(BarError, match="negative_volume: 9 rows, such as 2026-01-02 00:00:00 A; .* B; .* C; 2026-01-03 00:00:00 A; 2026-01-03 00:00:00 B$"):
        validate_bars(bars)
    assert violations(bars).count() == 9


def test_bars_are_written_and_read(spark, tmp_path):
    for fmt in ("parquet", "csv", "json"):
        write_bars(sample_bars(spark), f"{tmp_path}/{fmt}", fmt)
        got = normalize(read_bars(spark, f"{tmp_path}/{fmt}", fmt)).select(*sample_bars(spark).columns)
        assert got.withColumn("volume", F.col("volume").cast("bigint")).exceptAll(sample_bars(spark)).count() == 0


def test_faults_of_csv_bars_are_seen(spark, tmp_path):
    """Text that is no number, a cut number and an unreadable date are reported as what they are."""
    (tmp_path / "bars.csv").write_text("date,ticker,open,high,low,close,volume,note\n2026-01-05,A,x,11,9,10,100,n\n2026-01-06,A,10,11,9,10,100.7,n\n2026-13-40,A,10,11,9,10,,n\n")
    bars = read_bars(spark, str(tmp_path / "bars.csv"), "csv")
    assert {r["rule"] for r in violations(bars).collect()} == {"not_numeric_open", "unreadable_date", "missing_volume"}
    assert [r["volume"] for r in normalize(bars).orderBy("volume").collect()] == [None, 100.0, 100.7] and "note" in bars.columns
    with pytest.raises(BarError, match="unreadable_date: 1 rows, such as None A"):
        validate_bars(bars)


def test_repeated_keys_by_counts(spark):
    bars = sample_bars(spark).union(sample_bars(spark).where("ticker = '2317'")).union(sample_bars(spark).limit(1))
    got = violations(bars)
    assert {r["rule"] for r in got.collect()} == {"duplicate_key"} and got.count() == 25
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(BarError, match="duplicate_key: 25 rows, such as 2026-01-02 00:00:00 2317; 2026-01-05"):
        validate_bars(bars)


def test_stored_bars_need_no_shuffle(spark, tmp_path):
    stored = store_bars(sample_bars(spark), f"bars_{tmp_path.name.replace('-', '_')}", 4, f"{tmp_path}/bars")
    made = features.add_price_volume_features(stored, (1,), (3,), (3,))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    plain = features.add_price_volume_features(sample_bars(spark), (1,), (3,), (3,))
    assert made.exceptAll(plain).count() == plain.exceptAll(made).count() == 0


def test_summary_as_sorted_json(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.0, None), ("a", 1.5, 3)], "split string, mae double, n long")
    write_summary(rows, f"{tmp_path}/summary")
    lines = "".join(p.read_text() for p in (tmp_path / "summary").glob("*.json")).splitlines()
    assert lines == ['{"mae":1.5,"n":3,"split":"a"}', '{"mae":2.0,"n":null,"split":"b"}']


def test_windows_over_blocks_equal_plain_ones(spark):
    """One ticker in blocks of 900 rows with halos, and as a whole."""
    rng = random.Random(3)
    rows = [(DAY + dt.timedelta(minutes=7 * i + rng.randrange(7)), "A", rng.choice([None, rng.uniform(5, 20)]) if i % 50 == 3 else rng.uniform(5, 20), float(i % 9)) for i in range(3000)]
    rows += [(DAY + dt.timedelta(days=i), "B", 10.0 + i, 1.0) for i in range(30)]
    bars = spark.createDataFrame(rows, "date timestamp_ntz, ticker string, close double, volume double")

    def make(df):
        made = features.add_price_volume_features(df, (5,), (10,), (5,))
        return features.add_forward_return_label(features.add_technical_indicators(made, (20,), (12,), (14,)), 20, 1)

    whole = {(r["ticker"], r["date"]): r for r in make(bars).collect()}
    cut = in_blocks(bars, make, before=ema_reach(12) + 12, after=20, rows=900)
    assert cut.columns == make(bars).columns
    got = cut.collect()
    assert len(got) == len(rows)
    for r in got:
        for c in cut.columns[2:]:
            a, b = r[c], whole[r["ticker"], r["date"]][c]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-12, abs=1e-12)), c
    with pytest.raises(ValueError):
        in_blocks(bars, make, before=1000, rows=900)


def test_drawdown_by_blocks(spark):
    """Blocks of 50 rows against the whole curve; returns of -1 and less too."""
    rng = random.Random(5)
    rows = [(s, DAY + dt.timedelta(days=i), rng.gauss(0.0002, 0.02)) for s in "ABC" for i in range(400)]
    rows += [("D", DAY + dt.timedelta(days=i), x) for i, x in enumerate([0.1, -1.0, 0.2])] + [("E", DAY, -1.5), ("E", DAY + dt.timedelta(days=1), 0.5), ("F", DAY, None), ("G", DAY, -0.3)]
    returns = spark.createDataFrame(rows, "series_id string, date timestamp_ntz, ret double")
    want = {r["series_id"]: r["d"] for r in performance.drawdown_curve(returns).groupBy("series_id").agg(F.min("drawdown").alias("d")).collect()}
    usual = returns.where("series_id in ('A', 'B', 'C', 'G')")
    got = {r["series_id"]: np.expm1(r["log_fall"]) for r in performance.max_drawdowns(usual, rows=50).collect()}
    assert got == {s: pytest.approx(want[s], abs=1e-12) for s in "ABCG"}
    summary = {r["series_id"]: r for r in performance.performance_summary(returns).collect()}
    assert {s: r["max_drawdown"] for s, r in summary.items()} == {s: pytest.approx(x, abs=1e-12) if x is not None else None for s, x in want.items()} | {"F": 0.0}
    assert summary["F"]["n"] == 0 and summary["F"]["total_return"] == 0.0


def test_guards_while_the_matrix_is_written(spark):
    frame = pipelines.smoke_frame(sample_bars(spark))
    split, facts = pipelines.split_matrix(frame, "2026-01-09", "2026-01-13")
    assert facts.scaler() == {c: (pytest.approx(m), pytest.approx(s)) for c, (m, s) in splits.fit_scaler(split, pipelines.SMOKE_FEATURES).items()}
    facts.check_inputs()
    with pytest.raises(BarError):
        pipelines.split_matrix(frame.union(frame.limit(20)), "2026-01-09", "2026-01-13")
    with pytest.raises(BarError):
        pipelines.complete_matrix(frame.withColumn("ticker", F.when(F.col("ticker") == "2317", F.col("ticker"))))
    with pytest.raises(BarError):
        pipelines.complete_matrix(frame.withColumn("date", F.when(F.col("ticker") == "2317", F.col("date"))))
    with pytest.raises(ValueError, match="empty split"):
        pipelines.split_matrix(frame, "2026-01-09", "2027-01-13")
    bad = frame.withColumn("price_momentum_1d", F.when(F.col("date") == F.lit("2026-01-08").cast("timestamp_ntz"), float("inf")).otherwise(F.col("price_momentum_1d")))
    with pytest.raises(ValueError, match="price_momentum_1d"):
        pipelines.split_matrix(bad, "2026-01-09", "2026-01-13")[1].check_inputs()
    with pytest.raises(ValueError, match="constant"):
        pipelines.split_matrix(frame.withColumn("price_momentum_1d", F.lit(0.1)), "2026-01-09", "2026-01-13")[1].scaler()


def test_windows_and_columns_are_checked(spark):
    for wrong in ((), (0,), (3, -1)):
        with pytest.raises(ValueError):
            checked_windows("windows", wrong)
    bars = sample_bars(spark).withColumn("mid", (F.col("high") + F.col("low")) / 2)
    got = features.add_price_volume_features(bars, (1,), (2,), (2,), price="mid").where("ticker = '2317'").orderBy("date").collect()
    assert got[1]["price_momentum_1d"] == pytest.approx(got[1]["mid"] / got[0]["mid"] - 1)
    with pytest.raises(KeyError):
        features.add_technical_indicators(bars, price="vwap")


def test_keys_and_splits_are_checked(spark):
    frame = pipelines.smoke_frame(sample_bars(spark))
    with pytest.raises(BarError):
        features.feature_matrix(frame.union(frame.limit(1)), pipelines.SMOKE_LABEL)
    with pytest.raises(BarError):
        pipelines.complete_matrix(frame.withColumn("ticker", F.when(F.col("ticker") != "2317", F.col("ticker"))))
    matrix = pipelines.complete_matrix(frame)
    for bounds in (("2026-01-12", "2026-01-07"), ("2020-01-01", "2026-01-12"), ("2026-01-07", "2026-01-12", "2026-01-13"), ("2026-01-07", "2026-01-07")):
        with pytest.raises(ValueError):
            splits.temporal_split(matrix, *bounds)
    with pytest.raises(ValueError, match="missing labels"):
        splits.supervised(matrix, drop_missing_labels=False)


def test_predictions_are_checked(spark):
    good = [("m", "x", "train", 0, 1.0, 1.0), ("m", "x", "test", 1, 2.0, 1.0)]
    frame = lambda rows: spark.createDataFrame(rows, PREDICTIONS)
    assert models.check_bundle(frame(good)).count() == 2
    for rows in (good[:1], [*good, good[0]], [good[0], ("m", "x", "test", 1, 2.0, None)]):
        with pytest.raises(ValueError):
            models.check_bundle(frame(rows))
    actual = lambda rows: spark.createDataFrame(rows, "pos long, y double")
    joined = models.evaluate(models.with_actuals(frame(good), actual([(0, 3.0), (1, None), (7, 1.0)]))).orderBy("split").collect()
    assert [(r["split"], r["row_count"], r["mae"]) for r in joined] == [("test", 1, None), ("train", 1, 2.0)]
    for rows in ([(0, 3.0)], [(0, 3.0), (0, 3.0), (1, 1.0)]):
        with pytest.raises(ValueError):
            models.with_actuals(frame(good), actual(rows))
    with pytest.raises(ValueError):
        models.with_actuals(frame(good), spark.createDataFrame([(0, "a"), (1, "b")], "pos long, y string"))
    with pytest.raises(ValueError, match="no actual values"):
        models.check_evaluations(models.evaluate(models.with_actuals(frame(good), actual([(0, 3.0), (1, None)]))))
    other = [("n", "x", "train", 0, 1.0, 1.0), ("n", "x", "test", 1, None, 1.0)]
    with pytest.raises(ValueError, match="different rows"):
        models.compare(models.evaluate(frame(good + other)), "m", "n")


def test_model_inputs_are_checked(spark):
    data = lambda a, y: spark.createDataFrame([("train", 0, 1.0, 1.0), ("train", 1, a, y), ("test", 2, 2.0, None)], "split string, pos long, a double, y double")
    models.check_inputs(data(3.0, 1.0), ["a"])
    for a, y in ((None, 1.0), (float("inf"), 1.0), (3.0, None), (3.0, float("nan"))):
        with pytest.raises(ValueError):
            models.check_inputs(data(a, y), ["a"])


def test_ols_of_least_norm(spark):
    """Twice the same column: the weight is shared. Without intercept: through the origin."""
    points = [("train", i, float(i), float(i), 3.0 * i) for i in range(1, 6)]
    data = spark.createDataFrame(points, "split string, pos long, a double, b double, y double").repartition(2)
    model = models.fit_ols(data, ["a", "b"], fit_intercept=False)
    assert model.coefficients == (pytest.approx(1.5), pytest.approx(1.5)) and (model.intercept, model.method) == (0.0, "ols_no_intercept")
    single = models.fit_ols(data.where("pos = 2"), ["a", "b"])
    assert single.intercept + 2 * sum(single.coefficients) == pytest.approx(6.0)


def test_boosted_trees_learn_a_step(spark):
    rows = [("train" if i % 4 else "test", i, float(i % 100), 5.0 if i % 100 >= 40 else 1.0) for i in range(400)]
    data = spark.createDataFrame(rows, "split string, pos long, a double, y double")
    got = models.predict_boosted(data, ["a"], models.fit_boosted(data, ["a"], n_estimators=60, learning_rate=0.2)).collect()
    # Near the step it depends on where the trees put their threshold between two train values.
    assert len(got) == 400 and max(abs(r["prediction"] - r["y"]) for r in got if abs(r["pos"] % 100 - 40) > 3) < 0.1
    for wrong in ({"n_estimators": 0}, {"learning_rate": 0.0}, {"num_leaves": 1}, {"feature_fraction": 1.5}, {"bagging_fraction": 0.0}, {"bagging_freq": -1}):
        with pytest.raises(ValueError):
            models.fit_boosted(data, ["a"], **wrong)


def test_medians_against_sorting(spark):
    rng = random.Random(4)
    for n_rows, values in ((1, 9), (2, 9), (501, 5), (3000, 10**6)):
        rows = [(rng.randrange(4), float(rng.randrange(values))) for _ in range(n_rows)] + [(0, None)]
        got = prefix_medians(spark.createDataFrame(rows, "window long, y double").repartition(3), 3, 50)
        want = {k: [y for w, y in rows if y is not None and w <= k] for k in range(3)}
        assert got == {k: statistics.median(ys) for k, ys in want.items() if ys}


def test_window_statistics_of_large_means(spark):
    """Deviations of values near 10^9 survive."""
    rows = [(i, 1e9 + (i % 7), float(i)) for i in range(60)]
    stats = splits.train_prefix_stats(spark.createDataFrame(rows, "pos long, x double, y double"), ["x"], 3, 20, 10).orderBy("window").collect()
    for r in stats:
        held = [x for i, x, _ in rows if i < 20 + 10 * r["window"]]
        assert r["x_std"] == pytest.approx(statistics.pstdev(held), rel=1e-6) and r["x_mean"] == pytest.approx(statistics.fmean(held), rel=1e-12)


def test_log_growth(spark):
    rows = [("s", DAY + dt.timedelta(days=i), r) for i, r in enumerate([0.10, 0.0, -0.05])] + [("none", DAY, None), ("gone", DAY, -1.0)]
    got = {r["series_id"]: r for r in performance.log_growth(spark.createDataFrame(rows, "series_id string, date timestamp_ntz, ret double"), 3).collect()}
    assert 10 ** got["s"]["log10_growth"] - 1 == pytest.approx(0.045) and 10 ** got["s"]["log10_annual_growth"] - 1 == pytest.approx(0.045)
    assert got["s"]["max_drawdown"] == pytest.approx(-0.05) and got["none"]["max_drawdown"] == 0.0
    assert (got["gone"]["log10_growth"], got["gone"]["max_drawdown"]) == (None, -1.0)


def test_baseline_modeling_by_hand(spark):
    got = pipelines.baseline_modeling(pipelines.smoke_frame(sample_bars(spark)), "2026-01-07", "2026-01-12", "median").collect()
    assert {r["split"]: r["row_count"] for r in got} == {"train": 8, "validation": 6, "test": 10}
    assert all(r["prediction_mean"] == pytest.approx(0.02337506967450309) for r in got)


@pytest.mark.parametrize("span", [1, 2, 12, 250])
def test_ema_of_any_span_over_blocks_and_gaps(spark, span):
    """Several blocks, a gap longer than a block, nothing at the start; against pandas."""
    rng = random.Random(span)
    prices = [None] * 5 + [rng.uniform(5, 20) for _ in range(2500)] + [None] * 1500 + [rng.choice([None, rng.uniform(5, 20)]) for _ in range(1500)]
    rows = [(DAY + dt.timedelta(days=i), "A", p) for i, p in enumerate(prices)] + [(DAY, "B", 3.0), (DAY, "C", None)]
    frame = spark.createDataFrame(rows, "date timestamp_ntz, ticker string, close double")
    got = with_ema(frame, F.col("close"), span, "e").where("ticker = 'A'").orderBy("date").toPandas()
    want = pd.Series(prices, dtype="float64").ewm(span=span, adjust=False, min_periods=span).mean()
    pd.testing.assert_series_equal(got["e"], want, check_names=False, rtol=1e-11)


def test_ema_over_missing_prices(spark):
    """Against pandas, which lets weights decay over missing values; both default spans."""
    rng = random.Random(6)
    prices = [None if rng.random() < 0.2 else rng.uniform(5, 20) for _ in range(700)]
    rows = [(DAY + dt.timedelta(days=i), "A", p, 1.0) for i, p in enumerate(prices)]
    frame = spark.createDataFrame(rows, "date timestamp_ntz, ticker string, close double, volume double")
    got = features.add_technical_indicators(frame).orderBy("date").toPandas()
    for span in (12, 26):
        want = pd.Series(prices, dtype="float64").ewm(span=span, adjust=False, min_periods=span).mean()
        pd.testing.assert_series_equal(got[f"ema_{span}d"], want, check_names=False, rtol=1e-12)
