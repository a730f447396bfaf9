"""Long series in blocks: one ticker's rows spread over tasks, with as many copied rows around a block as its windows reach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK_ROWS = 1 << 16


def seconds(date: str = "date") -> Column:
    """Whole seconds of a date or time without a zone, so ascending with it."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{date}` as timestamp_ntz))")


def with_stretches(df: DataFrame, key: str, rows: int, name: str, undated_last: bool = False) -> DataFrame:
    """Adds numbers of stretches of time, ascending with ``date`` within a key, of about ``rows`` rows in the longest series.

    One aggregate by key tells how wide they are. Rows at one second lie in one stretch. Rows without a date count as
    of 1970, or with ``undated_last`` lie in a stretch after all others.
    """
    at = seconds() if undated_last else F.coalesce(seconds(), F.lit(0))
    by_key = df.groupBy(key).agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    found = by_key.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if (found["n"] or 0) <= rows or found["lo"] is None:
        return df.withColumn(name, F.lit(0).cast("long"))
    width = max(1, (found["hi"] - found["lo"] + 1) * rows // found["n"])
    return df.withColumn(name, F.coalesce(F.floor((at - found["lo"]) / width), F.lit((found["hi"] - found["lo"]) // width + 1)))


def with_ranks(df: DataFrame, key: str, rows: int, name: str) -> DataFrame:
    """Adds each row's rank (from 0, by date, at one time by the other columns, without a date last) within its key: ranks within stretches, and counts
    of the stretches before."""
    stretch = f"{name}_stretch"
    parts = with_stretches(df, key, rows, stretch, undated_last=True)
    counts = parts.groupBy(F.col(key).alias("_k"), F.col(stretch).alias("_s")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # over stretches alone
    starts = counts.select("_k", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = parts.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col(stretch) == F.col("_s")))
    ties = [c for c, kind in df.dtypes if c not in (key, "date") and not kind.startswith(("map", "variant"))]
    rank = F.col("_start") + F.row_number().over(Window.partitionBy(key, stretch).orderBy(F.asc_nulls_last("date"), *ties)) - 1
    return joined.withColumn(name, rank).drop("_k", "_s", "_start", stretch)


def in_blocks(bars: DataFrame, make: Callable[[DataFrame], DataFrame], before: int, after: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """``make(bars)`` where make adds columns by windows over a ticker in date order that reach so many rows back and ahead.

    Each block of ``rows`` rows of a ticker is worked on alone, with copies of the rows before and after it that its
    windows see; so a table of one ticker uses every task, and a long one no more memory than a block. For an
    exponential mean ``windows.ema_reach`` rows before are as good as all. Rows may share a date: while make runs, ``date`` is
    the row's rank in its ticker, so a block and its copied rows stay in the order in which they were cut. Rows without a date come last.
    """
    if max(before, after) > rows:
        raise ValueError("windows may not reach beyond the neighbouring blocks")
    ranked = with_ranks(bars, "ticker", rows, "_rank")
    own, place = F.floor(F.col("_rank") / rows), F.col("_rank") % rows
    copies = F.array_compact(F.array(own, F.when(place >= rows - before, own + 1), F.when((place < after) & (own > 0), own - 1)))
    spread = ranked.withColumns({"_own": own, "_copy": F.explode(copies)})
    # Ticker and block together stand in for the ticker.
    spread = spread.withColumns({"_date": F.col("date"), "date": F.col("_rank")})
    made = make(spread.withColumn("ticker", F.struct(F.col("ticker").alias("ticker"), F.col("_copy").alias("block"))))
    kept = made.where(F.col("_copy") == F.col("_own")).withColumns({"ticker": F.col("ticker.ticker"), "date": F.col("_date")})
    return kept.drop("_rank", "_own", "_copy", "_date")
