"""Performance of return series, many at once: ``series_id, date, ret``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators.blocks import with_stretches
from tidemark.sources.staging import materialize

#: Rows of a block in the longest series.
BLOCK_ROWS = 1 << 16


def ticker_returns(bars: DataFrame, price: str = "close") -> DataFrame:
    return bars.select(F.col("ticker").alias("series_id"), "date", W.change(F.col(price), 1).alias("ret"))


def equal_weight_returns(bars: DataFrame, price: str = "close") -> DataFrame:
    """Mean return of all tickers by date; dates without any are left out."""
    each = bars.select("date", W.change(F.col(price), 1).alias("r"))
    return each.groupBy("date").agg(F.avg("r").alias("ret")).where("ret is not null")


def clean(returns: DataFrame) -> DataFrame:
    return returns.withColumn("ret", W.finite(F.col("ret").cast("double"))).where("ret is not null")


def drawdown_curve(returns: DataFrame) -> DataFrame:
    """Growth, running peak and drawdown. Growth starts after the first return, so that is never a drawdown."""
    line = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = clean(returns).withColumn("equity", F.product(1 + F.col("ret")).over(line))
    return grown.withColumn("peak", F.max("equity").over(line)).withColumn("drawdown", W.safe_div(F.col("equity"), F.col("peak")) - 1)


def max_drawdowns(returns: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``series_id, log_fall``: the logarithm of the deepest fall's growth, of cleaned returns above -1.

    A block of dates is summed up by its growth, its highest and lowest point from its start on, and its own deepest
    fall, all as logarithms. Such summaries compose: a fall either lies within a block or leads from
    the highest point before it to its lowest. So only rows of a block are ever put in order, and a long
    series is worked on by many tasks.
    """
    blocks = with_stretches(returns, "series_id", rows, "_block").withColumn("_step", F.log1p("ret"))
    within = Window.partitionBy("series_id", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = blocks.withColumn("_level", F.sum("_step").over(within)).withColumn("_peak", F.max("_level").over(within))
    parts = curve.groupBy("series_id", "_block").agg(
        F.sum("_step").alias("growth"), F.max("_level").alias("high"), F.min("_level").alias("low"), F.min(F.col("_level") - F.col("_peak")).alias("fall")
    )
    state = lambda level, peak, fall: F.struct(level.alias("level"), peak.alias("peak"), fall.alias("fall"))
    start = state(F.lit(0.0), F.lit(float("-inf")), F.lit(0.0))
    composed = F.aggregate(
        F.sort_array(F.collect_list(F.struct("_block", "growth", "high", "low", "fall"))), start,
        lambda s, x: state(s["level"] + x["growth"], F.greatest(s["peak"], s["level"] + x["high"]), F.least(s["fall"], x["fall"], s["level"] + x["low"] - s["peak"])),
        lambda s: s["fall"],
    )
    return parts.groupBy("series_id").agg(composed.alias("log_fall"))


def _staged(returns: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """All rows and usable rows, read from a table that is written once; whether any return ends a series (-1 or less)."""
    ended = Observation("ended")
    rows = returns.select("series_id", "date", W.finite(F.col("ret").cast("double")).alias("ret"))
    rows = materialize(rows.observe(ended, F.count_if(F.col("ret") <= -1).alias("n")), "returns")
    return rows, rows.where("ret is not null"), ended.get["n"] > 0


def performance_summary(returns: DataFrame, periods_per_year: float = 252, risk_free_rate: float = 0.0) -> DataFrame:
    """One row per series, also for series without a usable return (zeros).

    Returns of -1 or less have no logarithm: series with any are put in order as a whole, as ``drawdown_curve`` does.
    """
    ppy = float(periods_per_year)
    every, rows, some_end = _staged(returns)
    excess = F.col("ret") - risk_free_rate / ppy
    stats = every.groupBy("series_id").agg(
        F.count("ret").alias("n"), F.product(1 + F.col("ret")).alias("growth"), F.stddev_pop("ret").alias("sd"), F.avg(excess).alias("mean"), F.stddev_pop(excess).alias("esd"),
    )
    usual = rows
    if some_end:
        ended = rows.where("ret <= -1").select("series_id").distinct()
        usual = rows.join(ended, "series_id", "left_anti")
    falls = max_drawdowns(usual).select("series_id", F.expm1("log_fall").alias("mdd"))
    if some_end:
        falls = falls.union(drawdown_curve(rows.join(ended, "series_id", "left_semi")).groupBy("series_id").agg(F.min("drawdown").alias("mdd")))
    some = F.col("n") > 0
    return stats.join(falls, "series_id", "left").select(
        "series_id", "n",
        F.when(some, F.col("growth") - 1).otherwise(0.0).alias("total_return"),
        F.when(~some, 0.0).when(F.col("growth") > 0, F.pow("growth", ppy / F.col("n")) - 1).alias("cagr"),
        F.when(some, F.col("sd") * F.sqrt(F.lit(ppy))).otherwise(0.0).alias("annual_volatility"),
        F.when(~some | (F.col("esd") <= 1e-8), 0.0).otherwise(F.col("mean") / F.col("esd") * F.sqrt(F.lit(ppy))).alias("sharpe_ratio"),
        F.when(some, F.col("mdd")).otherwise(0.0).alias("max_drawdown"),
    )


def log_growth(returns: DataFrame, periods_per_year: float = 252) -> DataFrame:
    """``series_id, log10_growth, log10_annual_growth, max_drawdown`` by sums of logarithms, for series whose growth leaves a double.

    A return of -1 or less ends a series: its growth has no logarithm (NULL) and its drawdown is -1.
    Series without a usable return have zeros.
    """
    every, rows, _ = _staged(returns)
    above = F.col("ret") > -1
    ended, n = F.count_if(~above), F.count("ret")
    stats = every.groupBy("series_id").agg(F.when(ended == 0, F.sum(F.when(above, F.log1p("ret"))) / F.log(F.lit(10.0))).alias("g"), n.alias("k"), (ended > 0).alias("ended"))
    falls = max_drawdowns(rows.where(above))
    none = F.col("k") == 0
    return stats.join(falls, "series_id", "left").select(
        "series_id", F.when(none, 0.0).otherwise(F.col("g")).alias("log10_growth"),
        F.when(none, 0.0).otherwise(F.col("g") * float(periods_per_year) / F.col("k")).alias("log10_annual_growth"),
        F.when(none, 0.0).when(F.col("ended"), -1.0).otherwise(F.expm1("log_fall")).alias("max_drawdown"),
    )


def coverage(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Rows, labels and whether the first row lacks the feature, by ticker."""
    return df.groupBy("ticker").agg(
        F.count("*").alias("n_rows"), F.count(label).alias("n_labels"), F.count_if(F.col(label).isNull()).alias("n_missing"),
        F.min_by(F.struct(feature), "date")[feature].isNull().alias("first_is_missing"),
    )
