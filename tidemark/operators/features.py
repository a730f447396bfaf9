"""Window features, indicators, forward-return labels and the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators.validation import BarError

RESERVED = ("date", "ticker", "open", "high", "low", "close", "volume")


def _has(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise KeyError(c)


def add_price_volume_features(
    bars: DataFrame, momentum_windows: tuple[int, ...] = (5, 20, 60), volatility_windows: tuple[int, ...] = (10, 20),
    volume_windows: tuple[int, ...] = (5, 20), price: str = "close", volume: str = "volume",
) -> DataFrame:
    """Adds momentum, volatility and mean volume; a value at t reads rows up to t only."""
    _has(bars, price, volume)
    p, v = F.col(price), F.col(volume)
    out = bars.withColumn("_return", W.finite(W.change(p, 1)))
    made = {f"price_momentum_{n}d": W.change(p, n) for n in W.checked_windows("momentum_windows", momentum_windows)}
    made |= {f"price_volatility_{n}d": W.volatility(F.col("_return"), n) for n in W.checked_windows("volatility_windows", volatility_windows)}
    made |= {f"volume_average_{n}d": W.mean(v, n) for n in W.checked_windows("volume_windows", volume_windows)}
    return out.withColumns(made).drop("_return")


def add_technical_indicators(
    bars: DataFrame, sma_windows: tuple[int, ...] = (5, 20, 60), ema_spans: tuple[int, ...] = (12, 26),
    rsi_windows: tuple[int, ...] = (14,), price: str = "close",
) -> DataFrame:
    _has(bars, price)
    p = F.col(price)
    move = p - F.lag(p).over(W.by_ticker())
    out = bars.withColumn("_move", move)
    m = F.col("_move")
    out = out.withColumns({"_gain": F.when(m.isNotNull(), F.greatest(m, F.lit(0.0))), "_loss": F.when(m.isNotNull(), F.greatest(-m, F.lit(0.0)))})
    made = {f"sma_{n}d": W.mean(p, n) for n in W.checked_windows("sma_windows", sma_windows)}
    spans = W.checked_windows("ema_spans", ema_spans)
    made |= {f"rsi_{n}d": W.rsi(F.col("_gain"), F.col("_loss"), n) for n in W.checked_windows("rsi_windows", rsi_windows)}
    out = out.withColumns(made).drop("_move", "_gain", "_loss")
    columns = out.columns
    for n in spans:
        out = W.with_ema(out, p, n, f"ema_{n}d")
    at = len(bars.columns) + len(sma_windows)
    return out.select(*columns[:at], *[f"ema_{n}d" for n in spans], *columns[at:])


def add_forward_return_label(bars: DataFrame, horizon: int = 20, entry_lag: int = 1, price: str = "close", label: str | None = None) -> DataFrame:
    if horizon <= 0 or entry_lag < 0 or horizon <= entry_lag:
        raise ValueError("horizon must be positive and larger than entry_lag, which must not be negative")
    _has(bars, price)
    name = label or f"label_forward_return_{horizon}d_entry_lag_{entry_lag}d"
    return bars.withColumn(name, W.forward_return(F.col(price), horizon, entry_lag))


def feature_columns(df: DataFrame, label: str, chosen: Sequence[str] | None = None) -> list[str]:
    """The chosen columns, or all that are neither keys, raw bars nor labels; raises where one may not be a feature."""
    _has(df, label)
    barred = lambda c: c in RESERVED or c == label or c.startswith("label_")
    if chosen is None:
        found = [c for c in df.columns if not barred(c)]
    else:
        found = list(chosen)
        if len(set(found)) < len(found):
            raise ValueError("duplicate feature columns")
        unknown = [c for c in found if c not in df.columns]
        leaking = [c for c in found if barred(c)]
        if unknown or leaking:
            raise ValueError(f"not features: {', '.join(unknown + leaking)}")
    if not found:
        raise ValueError("no feature columns")
    return found


def with_ranks_in_dates(df: DataFrame, repeated: str | None = None) -> DataFrame:
    """Adds ``_rank``, from 0 by ticker within each date. ``repeated`` names a column to add that tells rows whose date and
    ticker equal those of the row before.
    """
    in_date = Window.partitionBy("date").orderBy("ticker")
    made = {"_rank": F.row_number().over(in_date) - 1}
    if repeated:
        made[repeated] = (F.row_number().over(in_date) > 1) & F.lag("ticker").over(in_date).eqNullSafe(F.col("ticker"))
    return df.withColumns(made)


def date_starts(df: DataFrame) -> DataFrame:
    """``_date, _start``: how many rows come before each date."""
    dates = df.groupBy(F.col("date").alias("_date")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)  # over dates alone
    return dates.select("_date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def positioned(ranked: DataFrame, starts: DataFrame) -> DataFrame:
    """``pos`` from ranks within dates and the rows before each date."""
    joined = ranked.join(starts, F.col("date").eqNullSafe(F.col("_date")))
    return joined.withColumn("pos", F.col("_start") + F.col("_rank")).drop("_date", "_start", "_rank")


def with_positions(df: DataFrame, repeated: str | None = None) -> DataFrame:
    """Adds ``pos``, 0 to N - 1 by date and ticker, without sorting the table in one task.

    Rows before a date are counted on the small table of dates; within a date they are ranked. ``repeated`` names a
    column to add that tells rows whose date and ticker equal those of the row before.
    """
    return positioned(with_ranks_in_dates(df, repeated), date_starts(df))


def check_keys(df: DataFrame) -> None:
    """Raises where a date or ticker is missing or a pair of them is found twice."""
    bad = df.where(F.col("date").isNull() | F.col("ticker").isNull()).limit(1).count()
    if bad or df.groupBy("date", "ticker").count().where("count > 1").limit(1).count():
        raise BarError("missing or duplicate date and ticker")


def feature_matrix(df: DataFrame, label: str, chosen: Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """``pos, date, ticker, <features>, y``. Rows with missing labels stay."""
    columns = feature_columns(df, label, chosen)
    if check:
        check_keys(df)
    return with_positions(df).select("pos", "date", "ticker", *columns, F.col(label).alias("y"))
