"""Column functions over one ticker's bars in date order. NULL is the only missing value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def checked_windows(name: str, windows: tuple[int, ...]) -> tuple[int, ...]:
    windows = tuple(int(n) for n in windows)
    if not windows or min(windows) < 1:
        raise ValueError(f"{name} must be non-empty and positive")
    return windows


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b; a signed infinity over zero, NULL for zero by zero."""
    return F.when(b == 0, F.when(a > 0, float("inf")).when(a < 0, float("-inf"))).otherwise(a / b)


def _frame(n: int):
    return by_ticker().rowsBetween(1 - n, 0)


def full(x: Column, n: int, value: Column) -> Column:
    """``value`` where all of the last n rows of x are present."""
    return F.when(F.count(x).over(_frame(n)) >= n, value)


def change(x: Column, n: int) -> Column:
    """x over x n rows before, less one."""
    return safe_div(x, F.lag(x, n).over(by_ticker())) - 1


def mean(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(_frame(n)))


def volatility(returns: Column, n: int) -> Column:
    """Population deviation of the last n returns; an infinite one is missing."""
    return full(returns, n, F.stddev_pop(returns).over(_frame(n)))


def ema_reach(span: int) -> int:
    """Rows after which a value weighs less than 1e-18 of an exponential mean, wherever values are missing in between.

    A value that comes g rows after the one before keeps r^g / (r^g + a) of it, which per row is least
    reduced at some small g.
    """
    a = 2.0 / (span + 1)
    r = 1 - a
    slowest = max((r**g / (r**g + a)) ** (1.0 / g) for g in range(1, 65))
    return math.ceil(math.log(1e-18) / math.log(slowest))


def with_ema(df: DataFrame, x: Column, span: int, name: str) -> DataFrame:
    """Adds the exponential mean of x by ticker, missing before ``span`` values are there, as a scan.

    Each value turns the mean e into A * e + B, with A = r^g / (r^g + a) and B = a * x / (r^g + a), where g is
    the number of rows since the value before (1 without gaps: A = r, B = a * x); at a missing value e stays. Such maps
    compose, so each block of a ticker's rows is one running product and one running sum, whatever the
    span, and its last row holds the block's own map. The mean before a block comes from the maps of
    the two blocks before it: a block is so long (``ema_reach``) that nothing further back is left.
    """
    rn, prev, last, block, weight, run_a, run_b, one, before, carry, value = (
        f"_ema_{c}" for c in ("rn", "prev", "last", "block", "weight", "run_a", "run_b", "one", "before", "carry", "x")
    )
    a = 2.0 / (span + 1)
    r = 1 - a
    past = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({value: x.cast("double"), rn: F.row_number().over(by_ticker())})
    there = F.col(value).isNotNull()
    if r <= 0:
        mean = F.last(F.col(value), ignorenulls=True).over(past)
        return out.withColumn(name, F.when(F.count(F.col(value)).over(past) >= span, mean)).drop(rn, value)
    size = ema_reach(span)
    block_of = lambda n: F.floor((n - 1) / size)
    out = out.withColumns({
        prev: F.last(F.when(there, F.col(rn)), ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, -1)),
        f"{value}_n": F.count(F.col(value)).over(past), block: block_of(F.col(rn)),
    })
    gap = F.col(rn) - F.col(prev)
    old = F.when(gap == 1, r).otherwise(F.pow(F.lit(r), gap))
    total = F.when(gap == 1, 1.0).otherwise(old + a)
    first = there & (F.col(prev).isNull() | (block_of(F.col(prev)) < F.col(block)))
    inner = there & ~first
    # Ordered by block and date, so that one sort serves the windows of a block and those of a ticker.
    within = Window.partitionBy("ticker", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("ticker").orderBy(block, "date").rowsBetween(Window.unboundedPreceding, -1)
    began_with = F.struct(F.when(gap.isNull(), 0.0).otherwise(old / total).alias("a"), F.col(value).alias("x"), F.col(rn).alias("rn"))
    out = out.withColumns({
        run_a: F.product(F.when(inner, total).otherwise(1.0)).over(within), weight: F.when(inner, a / total),
        last: F.last(F.when(there, F.col(rn)), ignorenulls=True).over(within), one: F.last(F.when(first, began_with), ignorenulls=True).over(within),
    })
    # A power of the rows between rather than a product of r: one rounding instead of one a row. Likewise values
    # are taken relative to the block's first one, which the maps leave where it is (A and the weight of x add up to 1).
    out = out.withColumn(run_a, F.pow(F.lit(r), F.col(last) - F.col(one)["rn"]) / F.col(run_a))
    out = out.withColumn(run_b, F.sum(F.col(weight) * (F.col(value) - F.col(one)["x"]) / F.col(run_a)).over(within))
    origin, moved = F.col(one)["x"], F.col(run_a) * F.coalesce(F.col(run_b), F.lit(0.0))
    mean_after = lambda e: origin + (F.col(run_a) * F.col(one)["a"] * (F.coalesce(e, origin) - origin) + moved)
    at_end = lambda e: F.last(F.when(F.col(rn) % size == 0, mean_after(e)), ignorenulls=True).over(earlier)
    out = out.withColumn(before, at_end(F.lit(None)))
    out = out.withColumn(carry, at_end(F.col(before)))
    mean = F.when(F.col(one).isNull(), F.col(carry)).otherwise(mean_after(F.col(carry)))
    made = out.withColumn(name, F.when(F.col(f"{value}_n") >= span, mean))
    return made.drop(rn, prev, last, block, weight, run_a, run_b, one, before, carry, value, f"{value}_n")


def rsi(gain: Column, loss: Column, n: int) -> Column:
    """100 without losses, 50 without moves; means are simple ones."""
    up, down = mean(gain, n), mean(loss, n)
    return F.when((down == 0) & (up == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))


def forward_return(x: Column, horizon: int, entry_lag: int) -> Column:
    return safe_div(F.lead(x, horizon).over(by_ticker()), F.lead(x, entry_lag).over(by_ticker())) - 1
