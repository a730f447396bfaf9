"""Registered queries over bars that are derived from the given tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, models, performance, splits
from tidemark.operators.blocks import in_blocks
from tidemark.operators.validation import normalize, violations
from tidemark.plans import pipelines
from tidemark.sources.bars import event_bars, store_bars, trade_bars
from tidemark.sources.staging import materialize, shared_dir

TRAIN_END, VALIDATION_END = "1999-12-31", "2000-12-31"
LABEL = "label_forward_return_20d_entry_lag_1d"
TICKS_A_BLOCK = 8192
PAIR = ["price_momentum_5d", "price_volatility_10d"]


def _round(x: Column, digits: int) -> Column:
    """x rounded as the SQL does: the nearest whole number of units, halves away from zero, in doubles alone."""
    scaled = x * 10.0**digits
    near = F.rint(scaled)
    whole = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near)
    return F.when(F.abs(scaled) < float("inf"), whole / 10.0**digits).otherwise(x) + F.lit(0.0)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _keys(df: DataFrame, *columns: str) -> DataFrame:
    return _rounded(df.select("ticker", F.col("date").cast("date").alias("date"), *columns))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade bars with faults put in by arithmetic on the key."""
    m = (F.col("ticker").cast("int") + F.dayofyear("date")) % 97
    bars = trade_bars(spark, sf_dir).withColumn("m", m)
    on = lambda k, new, old: F.when(F.col("m") == k, new).otherwise(F.col(old))
    out = bars.select(
        "date", "ticker", on(3, F.col("high") + 1, "open").alias("open"), on(2, F.col("low") - 1, "high").alias("high"), "low",
        F.when(F.col("m") == 4, F.col("low") - 1).when(F.col("m") != 5, F.col("close")).alias("close"), on(1, -F.col("volume"), "volume").alias("volume"), "m",
    )
    return out.withColumn("copy", F.explode(F.when(F.col("m") == 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("m", "copy")


def bar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(_broken(spark, sf_dir)).withColumn("date", F.col("date").cast("date"))


def bars_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = trade_bars(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in ("date", "ticker", "open", "high", "low", "close", "volume")])
    return normalize(texts).select("ticker", F.col("date").cast("date").alias("date"), "open", "high", "low", "close", F.col("volume").cast("bigint").alias("volume"))


def _featured(bars: DataFrame) -> DataFrame:
    made = features.add_price_volume_features(bars, (5, 20, 60), (10, 20), (5, 20))
    return features.add_forward_return_label(made, 20, 1)


def price_volume_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _featured(trade_bars(spark, sf_dir))
    return _keys(df, "price_momentum_5d", "price_momentum_20d", "price_momentum_60d", "price_volatility_10d", "price_volatility_20d", "volume_average_5d", "volume_average_20d")


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum over a price of zero is infinite. Events without a time make a user's last bar, as in the SQL."""
    bars = event_bars(spark, sf_dir).withColumn("date", F.struct(F.col("date").isNull().alias("undated"), "date"))
    df = features.add_price_volume_features(bars, (1, 5), (3,), (5,)).withColumn("date", F.col("date.date"))
    return _keys(df, "price_momentum_1d", "price_volatility_3d", "volume_average_5d")


def technical_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.add_technical_indicators(trade_bars(spark, sf_dir), (5, 20, 60), (12,), (14,))
    return _keys(df, "sma_5d", "sma_20d", "sma_60d", "ema_12d", "rsi_14d")


def ema_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slower of the two default spans."""
    return _keys(features.add_technical_indicators(trade_bars(spark, sf_dir), (5,), (26,), (14,)), "ema_26d")


def stored_bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of bars that were stored in buckets of tickers: no shuffle before the windows."""
    name = f"tidemark_bars_{uuid.uuid4().hex}"
    stored = store_bars(trade_bars(spark, sf_dir), name, path=f"{shared_dir(spark)}/{name}")
    return _keys(features.add_technical_indicators(features.add_price_volume_features(stored, (5,), (10,), (5,)), (20,), (12,), (14,)), "price_momentum_5d", "price_volatility_10d", "volume_average_5d", "sma_20d", "rsi_14d")


def tick_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series of ticks: a single ticker, worked on in blocks with halos."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit("all").alias("ticker"), F.col("ts").cast("timestamp_ntz").alias("date"), F.col("value").alias("close"), F.lit(1).alias("volume")
    )

    def make(df: DataFrame) -> DataFrame:
        made = features.add_price_volume_features(df, (5,), (10,), (5,))
        return features.add_forward_return_label(features.add_technical_indicators(made, (20,), (1,), (14,)), 20, 1)

    df = in_blocks(ticks, make, before=20, after=20, rows=TICKS_A_BLOCK)
    return _rounded(df.select("date", "price_momentum_5d", "price_volatility_10d", "sma_20d", "rsi_14d", LABEL))


def forward_return_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(features.add_forward_return_label(trade_bars(spark, sf_dir), 20, 1), LABEL)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.complete_matrix(_featured(trade_bars(spark, sf_dir)), PAIR, LABEL)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_facts(spark, sf_dir)[0]


def _split_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, splits.Facts]:
    return pipelines.split_matrix(_featured(trade_bars(spark, sf_dir)), TRAIN_END, VALIDATION_END, PAIR, LABEL)


def feature_matrix_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(_matrix(spark, sf_dir), "pos", *PAIR, "y")


def temporal_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_summary(_split(spark, sf_dir))


def _sizes(count: int) -> tuple[int, int, int, int]:
    return count // 2, count // 10, count // 10, count // 20


def walk_forward_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = _matrix(spark, sf_dir).count()
    return splits.walk_forward_windows(spark, count, *_sizes(count))


def scaler_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = _split_facts(spark, sf_dir)[1].scaler()
    return _rounded(spark.createDataFrame([(c, m, s) for c, (m, s) in params.items()], "feature string, mean double, std double"))


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, facts = _split_facts(spark, sf_dir)
    return _keys(splits.scale(split, facts.scaler()), "split", *PAIR)


def scaled_train_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, facts = _split_facts(spark, sf_dir)
    train = splits.scale(split, facts.scaler()).where("split = 'train'")
    return _rounded(train.agg(*[f(c).alias(f"{c}_{k}") for c in PAIR for k, f in (("mean", F.avg), ("std", F.stddev_pop))]))


def supervised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.supervised_counts(_split(spark, sf_dir))


def baseline_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _split(spark, sf_dir)
    both = [models.predict_constant(split, models.fit_constant(split, m), m, f"baseline_{m}") for m in ("mean", "median")]
    return _rounded(pipelines.evaluated(both[0].unionByName(both[1])))


def baseline_modeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean baseline over all rows, those without features too."""
    return _rounded(pipelines.baseline_modeling(_featured(trade_bars(spark, sf_dir)), TRAIN_END, VALIDATION_END, label=LABEL, columns=PAIR))


def labels_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the mean label, evaluated against labels of a table of their own, found by position."""
    split = _split(spark, sf_dir)
    labels = split.select("pos", "y")
    rows = materialize(splits.join_labels(split, labels), "labelled")
    predicted = models.predict_constant(rows, models.fit_constant(rows), "mean")
    return _rounded(models.check_evaluations(models.evaluate(models.with_actuals(predicted, labels))))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.model_data(_featured(trade_bars(spark, sf_dir)), TRAIN_END, VALIDATION_END, PAIR, LABEL)


def ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models.fit_ols(_prepared(spark, sf_dir), PAIR)
    return _rounded(spark.createDataFrame([("intercept", m.intercept), *zip(m.columns, m.coefficients, strict=True)], "term string, value double"))


def ols_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _prepared(spark, sf_dir)
    return _rounded(pipelines.evaluated(models.predict_ols(data, models.fit_ols(data, PAIR))))


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pipelines.model_comparison(_prepared(spark, sf_dir), PAIR, check=False))


def gbt_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _prepared(spark, sf_dir)
    return _rounded(pipelines.evaluated(models.predict_boosted(data, PAIR, models.fit_boosted(data, PAIR))))


def daily_equal_weight_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(performance.equal_weight_returns(trade_bars(spark, sf_dir)))


def ticker_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.coverage(_featured(trade_bars(spark, sf_dir)), "price_momentum_5d", LABEL)


def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(performance.performance_summary(performance.ticker_returns(trade_bars(spark, sf_dir)), 252, 0.01))


def drawdown_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(performance.drawdown_curve(performance.ticker_returns(trade_bars(spark, sf_dir))))


def smoke_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five measures; growth as logarithms, as thousands of days of such bars take it beyond a double."""
    return _rounded(pipelines.smoke_summary(trade_bars(spark, sf_dir)).drop("total_return", "cagr"), 5)


def walk_forward_supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = _matrix(spark, sf_dir)
    count = matrix.count()
    return _rounded(pipelines.walk_forward_supervised(matrix, PAIR, *_sizes(count), count=count))


def walk_forward_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and test rows of each window, scaled by its own train statistics."""
    matrix = _matrix(spark, sf_dir)
    count = matrix.count()
    train, validation, test, step = _sizes(count)
    n = splits.n_windows(count, train, validation, test, step)
    stats = splits.train_prefix_stats(matrix, PAIR, n, train, step)
    rows = splits.scale_by_window(splits.assign_windows(matrix, n, train, validation, test, step), stats, PAIR)
    return _rounded(rows.select("window", "split", "pos", *PAIR, "y"))


def walk_forward_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = _matrix(spark, sf_dir)
    count = matrix.count()
    train, validation, test, step = _sizes(count)
    n = splits.n_windows(count, train, validation, test, step)
    return splits.window_dates(splits.assign_windows(matrix, n, train, validation, test, step))


def _walk_forward(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        matrix = _matrix(spark, sf_dir)
        count = matrix.count()
        return _rounded(pipelines.walk_forward_baseline(matrix, *_sizes(count), most=3, method=method, count=count))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        price_volume_features, bar_violations, bars_normalized, event_features, technical_indicators, ema_slow, forward_return_label, feature_matrix_positions,
        temporal_split_summary, walk_forward_plan, scaler_params, scaled_features, scaled_train_stats, supervised_counts, baseline_eval,
        ols_coefficients, ols_eval, model_comparison, gbt_eval, daily_equal_weight_return, ticker_coverage, performance_summary, drawdown_curve,
        smoke_summary, walk_forward_supervised, walk_forward_scaled, walk_forward_dates, baseline_modeling, labels_by_position, stored_bar_features, tick_features,
    )
} | {f"walk_forward_baseline_{m}": _walk_forward(m) for m in ("mean", "median")}


# SQL. Each query is a WITH clause over the bars and a SELECT.

_BARS = """bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
    first(p ORDER BY l_orderkey, l_linenumber, p) AS "open", max(p) AS high, min(p) AS low,
    last(p ORDER BY l_orderkey, l_linenumber, p) AS "close", CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2)"""
_W = "PARTITION BY ticker ORDER BY date"


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def _full(x: str, n: int, f: str) -> str:
    frame = f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} >= {n} THEN {f}({x}) OVER {frame} END"


def _over(a: str, b: str) -> str:
    """a / b; a signed infinity over zero, nothing for zero by zero."""
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN CAST('infinity' AS DOUBLE) WHEN {a} < 0 THEN CAST('-infinity' AS DOUBLE) END ELSE {a} / {b} END"


def _mom(n: int) -> str:
    return f'"close" / nullif(lag("close", {n}) OVER ({_W}), 0) - 1'


_RET = f"ret AS (SELECT *, {_mom(1)} AS r FROM bars)"
_LAB = f'lead("close", 20) OVER ({_W}) / nullif(lead("close", 1) OVER ({_W}), 0) - 1'
_FEAT = f"feat AS (SELECT *, {_mom(5)} AS m5, {_full('r', 10, 'stddev_pop')} AS v10, {_LAB} AS y FROM ret)"
_MAT = "mat AS (SELECT row_number() OVER (ORDER BY date, ticker) - 1 AS pos, date, ticker, m5, v10, y FROM feat WHERE m5 IS NOT NULL AND v10 IS NOT NULL)"
_SPL = f"spl AS MATERIALIZED (SELECT *, CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' WHEN date <= DATE '{VALIDATION_END}' THEN 'validation' ELSE 'test' END AS split FROM mat)"
_SCL = """par AS MATERIALIZED (SELECT avg(m5) AS am, stddev_pop(m5) AS sm, avg(v10) AS av, stddev_pop(v10) AS sv FROM spl WHERE split = 'train'),
scl AS (SELECT pos, date, ticker, split, y, (m5 - am) / sm AS m5, (v10 - av) / sv AS v10 FROM spl JOIN par ON true)"""
_OLS = """lab AS (SELECT * FROM scl WHERE y IS NOT NULL),
mom AS (SELECT avg(m5) AS a1, avg(v10) AS a2, avg(y) AS ay, var_pop(m5) AS s11, var_pop(v10) AS s22, covar_pop(m5, v10) AS s12,
  covar_pop(m5, y) AS s1y, covar_pop(v10, y) AS s2y FROM lab WHERE split = 'train'),
cf AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2, * FROM mom),
co AS (SELECT b1, b2, ay - b1 * a1 - b2 * a2 AS b0, ay FROM cf)"""
_EVAL = ", ".join(
    ["count(*) AS row_count", "count(y) AS non_missing_count", "count(*) FILTER (WHERE y IS NULL) AS missing_actual_count"]
    + [_r(x, n) for x, n in (("avg(abs(p - y))", "mae"), ("sqrt(avg((p - y) * (p - y)))", "rmse"), ("avg(p - y)", "mean_error"), ("avg(p)", "prediction_mean"))]
)
_RULES = {
    "missing_open": '"open" IS NULL', "missing_high": "high IS NULL", "missing_low": "low IS NULL", "missing_close": '"close" IS NULL',
    "missing_volume": "volume IS NULL", "negative_volume": "volume < 0", "high_below_low": "high < low",
    "open_outside": '"open" < low OR "open" > high', "close_outside": '"close" < low OR "close" > high', "duplicate_key": "same > 1",
}
_WF = """sz AS (SELECT count(*) AS n, count(*) // 2 AS tr, count(*) // 10 AS va, count(*) // 10 AS te, count(*) // 20 AS st FROM mat),
win AS (SELECT w AS "window", tr + w * st AS e, va, te FROM (SELECT *, unnest(range((n - tr - va - te) // st + 1)) AS w FROM sz))"""
_PERF = f"""ret AS (SELECT ticker AS series_id, date, {_mom(1)} AS ret FROM bars),
ok AS (SELECT * FROM ret WHERE ret IS NOT NULL),
cur AS (SELECT *, product(1 + ret) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM ok),
pk AS (SELECT *, max(equity) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM cur)"""
_MATRIX = ", ".join([_BARS, _RET, _FEAT, _MAT])
_SPLIT = f"{_MATRIX}, {_SPL}"
_SCALED = f"{_SPLIT}, {_SCL}"


def _walk_sql(fit: str) -> str:
    return f"""WITH {_MATRIX}, {_WF}, three AS (SELECT * FROM win WHERE "window" < 3),
fit AS (SELECT "window", {fit}(y) AS p FROM three JOIN mat ON pos < e GROUP BY 1),
held AS (SELECT "window", 'validation' AS split, y FROM three JOIN mat ON pos >= e AND pos < e + va WHERE y IS NOT NULL
  UNION ALL SELECT "window", 'test', y FROM three JOIN mat ON pos >= e + va AND pos < e + va + te WHERE y IS NOT NULL),
err AS (SELECT "window", split, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(p - y) AS me FROM held JOIN fit USING ("window") GROUP BY 1, 2)
SELECT "window", split, {_r("p", "prediction")}, coalesce(n, 0) AS n, {_r("mae", "mae")}, {_r("rmse", "rmse")}, {_r("me", "mean_error")},
  CASE WHEN n IS NULL THEN 'no labelled rows' ELSE 'ok' END AS status
FROM fit CROSS JOIN (VALUES ('validation'), ('test')) k(split) LEFT JOIN err USING ("window", split)"""


ORACLES: dict[str, str] = {
    "price_volume_features": f"WITH {_BARS}, {_RET} SELECT ticker, date, "
    + ", ".join([_r(_mom(n), f"price_momentum_{n}d") for n in (5, 20, 60)] + [_r(_full("r", n, "stddev_pop"), f"price_volatility_{n}d") for n in (10, 20)] + [_r(_full("volume", n, "avg"), f"volume_average_{n}d") for n in (5, 20)])
    + " FROM ret",
    "event_features": f"""WITH bars AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, last(value ORDER BY ts, value) AS "close", count(*) AS volume FROM events GROUP BY 1, 2), {_RET}, pre AS (SELECT *, lag("close") OVER ({_W}) AS b FROM ret)
SELECT ticker, date, {_r(_over('"close"', "b") + " - 1", "price_momentum_1d")}, {_r(_full("r", 3, "stddev_pop"), "price_volatility_3d")}, {_r(_full("volume", 5, "avg"), "volume_average_5d")} FROM pre""",
    "technical_indicators": f"""WITH {_BARS}, mv AS (SELECT *, "close" - lag("close") OVER ({_W}) AS d FROM bars),
gl AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0.0 END AS g, CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0.0 END AS l,
  list("close") OVER ({_W} ROWS BETWEEN 235 PRECEDING AND CURRENT ROW) AS past, row_number() OVER ({_W}) AS k FROM mv),
av AS (SELECT *, {_full("g", 14, "avg")} AS ug, {_full("l", 14, "avg")} AS ul FROM gl)
SELECT ticker, date, {_r(_full('"close"', 5, "avg"), "sma_5d")}, {_r(_full('"close"', 20, "avg"), "sma_20d")}, {_r(_full('"close"', 60, "avg"), "sma_60d")},
  {_r("CASE WHEN k >= 12 THEN list_reduce(past, lambda acc, x: acc * (1 - 2.0 / 13) + x * (2.0 / 13)) END", "ema_12d")},
  {_r("CASE WHEN ul = 0 AND ug = 0 THEN 50.0 WHEN ul = 0 THEN 100.0 ELSE 100 - 100 / (1 + ug / ul) END", "rsi_14d")} FROM av""",
    "ema_slow": f"""WITH {_BARS}, past AS (SELECT ticker, date, list("close") OVER ({_W} ROWS BETWEEN 509 PRECEDING AND CURRENT ROW) AS past, row_number() OVER ({_W}) AS k FROM bars)
SELECT ticker, date, {_r("CASE WHEN k >= 26 THEN list_reduce(past, lambda acc, x: acc * (1 - 2.0 / 27) + x * (2.0 / 27)) END", "ema_26d")} FROM past""",
    "stored_bar_features": f"""WITH {_BARS}, mv AS (SELECT *, "close" - lag("close") OVER ({_W}) AS d, {_mom(1)} AS r FROM bars),
gl AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0.0 END AS g, CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0.0 END AS l FROM mv),
av AS (SELECT *, {_full("g", 14, "avg")} AS ug, {_full("l", 14, "avg")} AS ul FROM gl)
SELECT ticker, date, {_r(_mom(5), "price_momentum_5d")}, {_r(_full("r", 10, "stddev_pop"), "price_volatility_10d")}, {_r(_full("volume", 5, "avg"), "volume_average_5d")}, {_r(_full('"close"', 20, "avg"), "sma_20d")},
  {_r("CASE WHEN ul = 0 AND ug = 0 THEN 50.0 WHEN ul = 0 THEN 100.0 ELSE 100 - 100 / (1 + ug / ul) END", "rsi_14d")} FROM av""",
    "tick_features": f"""WITH bars AS (SELECT 'all' AS ticker, ts AS date, value AS "close" FROM events), {_RET},
mv AS (SELECT *, "close" - lag("close") OVER ({_W}) AS d, lag("close", 5) OVER ({_W}) AS b5, lead("close", 20) OVER ({_W}) AS f20, lead("close", 1) OVER ({_W}) AS f1 FROM ret),
gl AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0.0 END AS g, CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0.0 END AS l FROM mv),
av AS (SELECT *, {_full("g", 14, "avg")} AS ug, {_full("l", 14, "avg")} AS ul FROM gl)
SELECT CAST(date AS TIMESTAMP) AS date, {_r(_over('"close"', "b5") + " - 1", "price_momentum_5d")}, {_r(_full("r", 10, "stddev_pop"), "price_volatility_10d")}, {_r(_full('"close"', 20, "avg"), "sma_20d")},
  {_r("CASE WHEN ul = 0 AND ug = 0 THEN 50.0 WHEN ul = 0 THEN 100.0 ELSE 100 - 100 / (1 + ug / ul) END", "rsi_14d")}, {_r(_over("f20", "f1") + " - 1", LABEL)} FROM av""",
    "forward_return_label": f"WITH {_BARS} SELECT ticker, date, {_r(_LAB, LABEL)} FROM bars",
    "bars_normalized": f'WITH {_BARS} SELECT ticker, date, "open", high, low, "close", volume FROM bars',
    "bar_violations": f"""WITH {_BARS}, m AS (SELECT *, (CAST(ticker AS INT) + dayofyear(date)) % 97 AS m FROM bars),
br AS (SELECT date, ticker, CASE WHEN m = 3 THEN high + 1 ELSE "open" END AS "open", CASE WHEN m = 2 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN m = 4 THEN low - 1 WHEN m = 5 THEN NULL ELSE "close" END AS "close", CASE WHEN m = 1 THEN -volume ELSE volume END AS volume,
  unnest(range(CASE WHEN m = 6 THEN 2 ELSE 1 END)) AS c FROM m),
kk AS (SELECT *, count(*) OVER (PARTITION BY date, ticker) AS same FROM br) """
    + " UNION ALL ".join(f"SELECT date, ticker, '{n}' AS rule FROM kk WHERE {c}" for n, c in _RULES.items()),
    "feature_matrix_positions": f"WITH {_MATRIX} SELECT ticker, date, pos, {_r('m5', PAIR[0])}, {_r('v10', PAIR[1])}, {_r('y', 'y')} FROM mat",
    "temporal_split_summary": f"WITH {_SPLIT} SELECT split, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM spl GROUP BY 1",
    "walk_forward_plan": f'WITH {_MATRIX}, {_WF} SELECT "window", 0::BIGINT AS train_start, e - 1 AS train_end, e AS validation_start, e + va - 1 AS validation_end, e + va AS test_start, e + va + te - 1 AS test_end FROM win',
    "scaler_params": f"WITH {_SCALED} SELECT '{PAIR[0]}' AS feature, {_r('am', 'mean')}, {_r('sm', 'std')} FROM par UNION ALL SELECT '{PAIR[1]}', round(av, 6) + 0.0, round(sv, 6) + 0.0 FROM par",
    "scaled_features": f"WITH {_SCALED} SELECT ticker, date, split, {_r('m5', PAIR[0])}, {_r('v10', PAIR[1])} FROM scl",
    "scaled_train_stats": f"WITH {_SCALED} SELECT " + ", ".join(_r(f"{f}({x})", f"{c}_{k}") for x, c in (("m5", PAIR[0]), ("v10", PAIR[1])) for k, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM scl WHERE split = 'train'",
    "supervised_counts": f"""WITH {_SPLIT} SELECT k.split, count(s.pos) AS before, count(s.y) AS "after", count(s.pos) - count(s.y) AS dropped
FROM (VALUES ('train'), ('validation'), ('test')) k(split) LEFT JOIN spl s USING (split) GROUP BY 1""",
    "baseline_eval": f"WITH {_SPLIT} "
    + " UNION ALL ".join(f"SELECT 'baseline_{n}' AS model_name, '{n}' AS method, split, {_EVAL} FROM spl, (SELECT {f}(y) AS p FROM spl WHERE split = 'train') GROUP BY split" for n, f in (("mean", "avg"), ("median", "median"))),
    "ols_coefficients": f"WITH {_SCALED}, {_OLS} SELECT 'intercept' AS term, {_r('b0', 'value')} FROM co UNION ALL SELECT '{PAIR[0]}', round(b1, 6) + 0.0 FROM co UNION ALL SELECT '{PAIR[1]}', round(b2, 6) + 0.0 FROM co",
    "ols_eval": f"WITH {_SCALED}, {_OLS}, pr AS (SELECT split, y, b0 + b1 * m5 + b2 * v10 AS p FROM lab, co) SELECT 'linear_regression' AS model_name, 'ols_with_intercept' AS method, split, {_EVAL} FROM pr GROUP BY split",
    "model_comparison": f"""WITH {_SCALED}, {_OLS}, pr AS (SELECT split, y, b0 + b1 * m5 + b2 * v10 - y AS e, ay - y AS f FROM lab, co)
SELECT 'constant_baseline' AS reference_name, 'linear_regression' AS candidate_name, split, count(*) AS row_count, count(y) AS non_missing_count, 0::BIGINT AS missing_actual_count,
  {_r("avg(abs(e)) - avg(abs(f))", "mae_delta")}, {_r("sqrt(avg(e * e)) - sqrt(avg(f * f))", "rmse_delta")}, {_r("avg(e) - avg(f)", "mean_error_delta")}, {_r("avg(e + y) - avg(f + y)", "prediction_mean_delta")}
FROM pr GROUP BY split""",
    "daily_equal_weight_return": f"WITH {_BARS}, {_RET} SELECT date, {_r('avg(r)', 'ret')} FROM ret GROUP BY date HAVING avg(r) IS NOT NULL",
    "ticker_coverage": f"WITH {_BARS}, {_RET}, {_FEAT} SELECT ticker, count(*) AS n_rows, count(y) AS n_labels, count(*) - count(y) AS n_missing, first(m5 IS NULL ORDER BY date) AS first_is_missing FROM feat GROUP BY ticker",
    "performance_summary": f"""WITH {_BARS}, {_PERF}, st AS (SELECT series_id, count(*) AS n, product(1 + ret) AS g, stddev_pop(ret) AS sd, avg(ret - 0.01 / 252) AS mn, min(equity / peak - 1) AS mdd FROM pk GROUP BY 1)
SELECT series_id, coalesce(n, 0) AS n, {_r("coalesce(g - 1, 0)", "total_return")}, {_r("CASE WHEN n IS NULL THEN 0.0 WHEN g > 0 THEN pow(g, 252.0 / n) - 1 END", "cagr")},
  {_r("coalesce(sd * sqrt(252), 0)", "annual_volatility")}, {_r("CASE WHEN n IS NULL OR sd <= 1e-8 THEN 0.0 ELSE mn / sd * sqrt(252) END", "sharpe_ratio")}, {_r("coalesce(mdd, 0)", "max_drawdown")}
FROM (SELECT DISTINCT series_id FROM ret) LEFT JOIN st USING (series_id)""",
    "drawdown_curve": f"WITH {_BARS}, {_PERF} SELECT series_id, date, {_r('ret', 'ret')}, {_r('equity', 'equity')}, {_r('peak', 'peak')}, {_r('equity / peak - 1', 'drawdown')} FROM pk",
    "walk_forward_supervised": f"""WITH {_MATRIX}, {_WF},
tr AS (SELECT "window", count(*) AS n_train, count(y) AS n_labels, avg(y) AS label_mean, avg(m5) AS am, stddev_pop(m5) AS sm, avg(v10) AS av, stddev_pop(v10) AS sv FROM win JOIN mat ON pos < e GROUP BY 1),
h AS (SELECT "window", count(*) FILTER (WHERE pos < e + va) AS vb, count(y) FILTER (WHERE pos < e + va) AS vf, count(*) FILTER (WHERE pos >= e + va) AS tb, count(y) FILTER (WHERE pos >= e + va) AS tf
  FROM win JOIN mat ON pos >= e AND pos < e + va + te GROUP BY 1)
SELECT "window", n_train, n_labels, {_r("label_mean", "label_mean")}, {_r("am", PAIR[0] + "_mean")}, {_r("sm", PAIR[0] + "_std")}, {_r("av", PAIR[1] + "_mean")}, {_r("sv", PAIR[1] + "_std")},
  vb AS validation_before, vf AS validation_after, tb AS test_before, tf AS test_after FROM tr JOIN h USING ("window")""",
    "smoke_summary": f"""WITH {_BARS}, one AS (SELECT *, {_mom(1)} AS r, lead("close", 3) OVER ({_W}) / nullif(lead("close", 1) OVER ({_W}), 0) - 1 AS y FROM bars),
c AS (SELECT count(*) AS row_count, count(DISTINCT ticker) AS ticker_count, count(y) AS label_count FROM one),
d AS (SELECT date, avg(r) AS ret FROM one GROUP BY date HAVING avg(r) IS NOT NULL),
eq AS (SELECT *, sum(ln(1 + ret)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM d),
pk AS (SELECT *, max(e) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM eq),
st AS (SELECT count(*) AS n, stddev_pop(ret) AS sd, avg(ret) AS mn, sum(ln(1 + ret)) / ln(10) AS g, min(exp(e - top) - 1) AS mdd FROM pk)
SELECT 'equal_weight' AS series_id, n, {_r("g", "log10_growth", 5)}, {_r("g * 252 / n", "log10_annual_growth", 5)}, {_r("mdd", "max_drawdown", 5)}, {_r("sd * sqrt(252)", "annual_volatility", 5)}, {_r("mn / sd * sqrt(252)", "sharpe_ratio", 5)}, row_count, ticker_count, label_count
FROM st, c""",
    "walk_forward_scaled": f"""WITH {_MATRIX}, {_WF},
tr AS (SELECT "window", avg(m5) AS am, stddev_pop(m5) AS sm, avg(v10) AS av, stddev_pop(v10) AS sv FROM win JOIN mat ON pos < e GROUP BY 1)
SELECT "window", CASE WHEN pos < e + va THEN 'validation' ELSE 'test' END AS split, pos, {_r("(m5 - am) / sm", PAIR[0])}, {_r("(v10 - av) / sv", PAIR[1])}, {_r("y", "y")}
FROM win JOIN mat ON pos >= e AND pos < e + va + te JOIN tr USING ("window")""",
    "walk_forward_dates": f"""WITH {_MATRIX}, {_WF}
SELECT "window", CASE WHEN pos < e + va THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(date) AS first_date, max(date) AS last_date
FROM win JOIN mat ON pos >= e AND pos < e + va + te GROUP BY 1, 2""",
    "baseline_modeling": f"""WITH {_BARS}, {_RET}, {_FEAT}, spl AS (SELECT y, CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' WHEN date <= DATE '{VALIDATION_END}' THEN 'validation' ELSE 'test' END AS split FROM feat)
SELECT 'constant_baseline' AS model_name, 'mean' AS method, split, {_EVAL} FROM spl, (SELECT avg(y) AS p FROM spl WHERE split = 'train') GROUP BY split""",
    "labels_by_position": f"WITH {_SPLIT} SELECT 'constant_baseline' AS model_name, 'mean' AS method, split, {_EVAL} FROM spl, (SELECT avg(y) AS p FROM spl WHERE split = 'train') GROUP BY split",
    "walk_forward_baseline_mean": _walk_sql("avg"),
    "walk_forward_baseline_median": _walk_sql("median"),
}
