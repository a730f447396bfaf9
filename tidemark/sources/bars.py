"""Bar tables: files, bars derived from trades and events, and the synthetic sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("date", "ticker", "open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Bars from files. Formats without types of their own (csv, json) are read as text, so that nothing is lost before
    ``normalize`` and ``violations`` see it: what does not parse is reported as it came. Columns beside the bars' are kept.
    """
    reader = spark.read.options(**({"header": "true"} if fmt == "csv" else {}) | options)
    if fmt == "json":
        reader = reader.option("primitivesAsString", "true")
    return reader.format(fmt).load(path)


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One sorted run of dates per ticker and file, so that ticker filters prune row groups."""
    sorted_bars = bars.repartition("ticker").sortWithinPartitions("ticker", "date")
    sorted_bars.write.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def store_bars(bars: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """The bars as a table in buckets of tickers, each sorted by ticker and date, read back.

    Windows and joins by ticker over the stored table need no shuffle, however often it is read. Each bucket is one
    task, so buckets should be as many as a cluster has cores, or more; tickers are dealt before the write,
    so a bucket is one file. ``path`` names the table's folder, a shared one (else the warehouse).
    """
    dealt = bars.repartition(buckets, "ticker").sortWithinPartitions("ticker", "date")
    writer = dealt.write.bucketBy(buckets, "ticker").sortBy("ticker", "date").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return bars.sparkSession.table(table)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary table as lines of JSON, its columns and rows in sorted order; for results of a few rows (one file)."""
    columns = sorted(summary.columns)
    plain = [c for c, kind in summary.dtypes if not kind.startswith("map")]
    summary.select(*columns).orderBy(*[c for c in columns if c in plain]).coalesce(1).write.json(path, ignoreNullFields=False)


def _bars(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows: ticker, date, p (price), q (volume) and the columns that order a day's trades.

    Rows are dealt by ticker once and put in order by ticker and date once: that serves the bars and the windows over
    them alike, so neither deals or orders anything again.
    """
    key = F.struct(*order, "p")
    return rows.repartition("ticker").groupBy("ticker", "date").agg(
        F.min_by("p", key).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", key).alias("close"),
        F.sum("q").cast("bigint").alias("volume"),
    ).select("date", "ticker", "open", "high", "low", "close", "volume")


def trade_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker: supplier, date: ship date, price: extended price by quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_quantity").alias("q"), "l_orderkey", "l_linenumber",
    )
    return _bars(lines, ["l_orderkey", "l_linenumber"])


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker: user, date: day of the event, price: its value, volume: events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date"), F.col("value").alias("p"), F.lit(1).alias("q"), "ts"
    )
    return _bars(events, ["ts"])


#: Fixed values of the synthetic sample: ticker, first close, rise a day, first volume.
SAMPLE_TICKERS = (("2317", 50.0, 0.65, 1200), ("2330", 100.0, 1.10, 2400))


def sample_bars(spark: SparkSession, n_days: int = 12, specs: tuple = SAMPLE_TICKERS) -> DataFrame:
    """Synthetic bars of closed form: business days from 2026-01-02, one row of ``specs`` per ticker."""
    days = (
        spark.range(n_days * 7 // 5 + 7)
        .select(F.date_add(F.lit("2026-01-02").cast("date"), F.col("id").cast("int")).alias("date"))
        .where(~F.dayofweek("date").isin(1, 7))
        .orderBy("date").limit(n_days)
        .select("date", F.datediff("date", F.lit("2026-01-02").cast("date")).alias("d"))
        # Business days since a Friday: whole weeks, then days past the week-end.
        .select("date", (F.floor(F.col("d") / 7) * 5 + F.greatest(F.lit(0), F.col("d") % 7 - 2)).alias("i"))
    )
    tickers = spark.createDataFrame(specs, "ticker string, base double, step double, vol long")
    close = F.col("base") + F.col("step") * F.col("i") + F.when(F.col("i") % 3 == 0, 0.15).otherwise(-0.05)
    opened = F.col("c") - 0.20 + F.when(F.col("i") % 2 == 0, 0.05).otherwise(-0.05)
    return (
        tickers.join(days, F.lit(True))
        .withColumn("c", close).withColumn("o", opened)
        .select(
            F.col("date").cast("timestamp_ntz").alias("date"), "ticker", F.round("o", 4).alias("open"),
            F.round(F.greatest("o", "c") + 0.45, 4).alias("high"), F.round(F.least("o", "c") - 0.45, 4).alias("low"),
            F.round("c", 4).alias("close"), (F.col("vol") + 25 * F.col("i")).cast("bigint").alias("volume"),
        )
    )
