"""Normalising bar tables and reporting what breaks their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.sources.bars import BAR_COLUMNS
from tidemark.sources.staging import materialize

NUMBERS = ("open", "high", "low", "close", "volume")
LACKING = tuple(f"missing_{c}" for c in NUMBERS)
#: Keys that a message shows.
EXAMPLES = 5
WHOLE = ("tinyint", "smallint", "int", "bigint")


class BarError(ValueError):
    """A bar table breaks a rule; the message names the first one in order."""


def check_columns(bars: DataFrame, required: tuple[str, ...] = BAR_COLUMNS) -> None:
    missing = sorted(set(required) - set(bars.columns))
    if missing:
        raise BarError("missing required columns: " + ", ".join(missing))


def _number(c: str, kind: str) -> Column:
    """A double (whole volumes stay whole). NaN is a missing value; infinity is a number."""
    if c == "volume" and kind in WHOLE:
        return F.col(c).cast("bigint")
    x = F.expr(f"try_cast(`{c}` as double)")
    return F.when(~F.isnan(x), x)


def _date(kind: str) -> Column:
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.to_timestamp_ntz(F.col("date").cast("string"))
    return F.expr("try_cast(`date` as timestamp_ntz)")


def normalize(bars: DataFrame) -> DataFrame:
    """Dates, tickers and numbers in their types; what does not parse becomes NULL. Extra columns are kept.

    Volume is a bigint if it came as a whole number's type, else a double: nothing is cut off it.
    """
    check_columns(bars)
    kinds = dict(bars.dtypes)
    return bars.withColumns({"date": _date(kinds["date"]), "ticker": F.col("ticker").cast("string"), **{c: _number(c, kinds[c]) for c in NUMBERS}})


def row_rules() -> list[tuple[str, Column]]:
    """Rules of one row in the order in which they are reported. ``_raw`` holds the values as they came."""
    c = F.col
    raw = lambda x: c("_raw")[x]
    is_nan = lambda x: F.coalesce(F.isnan(F.expr(f"try_cast(_raw.`{x}` as double)")), F.lit(False))
    return [
        ("unreadable_date", c("date").isNull() & raw("date").isNotNull()),
        ("missing_date", raw("date").isNull()),
        ("missing_ticker", c("ticker").isNull()),
        *[(f"not_numeric_{x}", c(x).isNull() & raw(x).isNotNull() & ~is_nan(x)) for x in NUMBERS],
        *[(f"missing_{x}", raw(x).isNull() | is_nan(x)) for x in NUMBERS],
        ("negative_volume", c("volume") < 0),
        ("high_below_low", c("high") < c("low")),
        ("open_outside", (c("open") < c("low")) | (c("open") > c("high"))),
        ("close_outside", (c("close") < c("low")) | (c("close") > c("high"))),
    ]


def _raw_rows(bars: DataFrame) -> DataFrame:
    check_columns(bars)
    return normalize(bars.withColumn("_raw", F.struct(*BAR_COLUMNS))).select(*BAR_COLUMNS, "_raw")


def _broken_rows(bars: DataFrame) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(x, name) for name, x in row_rules()]))
    return _raw_rows(bars).select("date", "ticker", F.explode(broken).alias("rule"))


def _repeated_keys(bars: DataFrame) -> DataFrame:
    """``date, ticker, n``: keys found more than once, by counts. Only keys are read and shuffled, and counted before they are."""
    kinds = dict(bars.dtypes)
    keys = bars.select(_date(kinds["date"]).alias("date"), F.col("ticker").cast("string").alias("ticker"))
    return keys.groupBy("date", "ticker").agg(F.count("*").alias("n")).where("n > 1")


def violations(bars: DataFrame) -> DataFrame:
    """``date, ticker, rule``: one row for each rule that a row breaks; all rows of a duplicate key count.

    Rules of one row are read off it without a shuffle; a repeated key gives as many rows as it was counted.
    """
    by_row = _broken_rows(bars)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    by_key = _repeated_keys(bars).select("date", "ticker", each.alias("k")).select("date", "ticker", F.lit("duplicate_key").alias("rule"))
    return by_row.unionByName(by_key)


def validate_bars(bars: DataFrame) -> DataFrame:
    """Normalized bars; raises for the first rule that is broken, with five examples in order of date and ticker.

    Missing numbers are one rule: the message names every column that lacks some. The input is read once for
    the rules of a row (broken ones are counted by key and written: nothing, for a clean table) and, if none is
    broken, once for its keys.
    """
    rules = [name for name, _ in row_rules()]
    broken = materialize(_broken_rows(bars).groupBy("rule", "date", "ticker").agg(F.count("*").alias("n")), "broken")
    counts = {r["rule"]: r["n"] for r in broken.groupBy("rule").agg(F.sum("n").alias("n")).collect()}  # a row per rule
    for rule in rules:
        if rule in counts:
            names = [n for n in LACKING if n in counts] if rule in LACKING else [rule]
            keys = broken.where(F.col("rule").isin(names)).select("date", "ticker").distinct()
            raise BarError(_message({n: counts[n] for n in names}, keys.orderBy("date", "ticker").limit(EXAMPLES).collect()))
    repeated = Observation("keys")
    found = _repeated_keys(bars).observe(repeated, F.sum("n").alias("n")).orderBy("date", "ticker").limit(EXAMPLES).collect()
    if found:
        raise BarError(_message({"duplicate_key": repeated.get["n"]}, found))
    return normalize(bars)


def _message(counts: dict[str, int], examples: list) -> str:
    what = ", ".join(f"{n}: {k} rows" for n, k in counts.items())
    return f"{what}, such as " + "; ".join(f"{r['date']} {r['ticker']}" for r in examples)
