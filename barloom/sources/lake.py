"""The lake of bars: partitioned Parquet, read by symbol, timeframe and a range widened by the warm-up; raw files in, bad symbols aside."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import KEYS, MISSING, ORDER, PRICES, daily_track, drop_unclosed, fill_grid, fill_sessions, from_millis, interval, lower_headers, resample, to_millis, to_utc, with_close_time

RAW = "symbol string, timestamp bigint, open double, high double, low double, close double, volume double"


def read_raw(spark: SparkSession, path: str | list[str], kind: str = "parquet", schema: str = RAW, **options) -> DataFrame:
    """Rows of (symbol, timestamp in epoch milliseconds, prices, volume) with datetime; nothing is inferred from the files."""
    return spark.read.schema(schema).options(**options).format(kind).load(path).withColumn(ORDER, from_millis("timestamp"))


def read_wall_clock(df: DataFrame, zone: str, at: str = "datetime", symbol: str = "symbol") -> DataFrame:
    """A vendor's table with times on a local clock: headers in lower case, datetime in UTC."""
    low = lower_headers(df, drop=())
    return low.withColumnRenamed(symbol.lower(), "symbol").withColumn(ORDER, to_utc(at.lower(), zone))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store, as readers outside Spark want it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    address = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{address[5:]}" if address.startswith("file:/") and not address.startswith("file://") else address


def write_lake(bars: DataFrame, path: str, by: Iterable[str] = KEYS, epochs: bool = False, mode: str = "overwrite") -> None:
    """One folder for each symbol and timeframe. ``epochs``: times become epoch milliseconds.

    Rows are dealt by folder and month, so that a long series is written by many tasks and none writes to every folder.
    """
    month = F.date_trunc("month", ORDER)
    rows = bars.repartition(*by, month).sortWithinPartitions(*by, ORDER)
    if epochs:
        rows = rows.withColumns({f.name: to_millis(f.name) for f in bars.schema if f.dataType.simpleString().startswith("timestamp") and f.name not in by})
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def read_lake(spark: SparkSession, path: str, symbols: Iterable[str] = (), timeframe: str | None = None, start=None, end=None, warmup_bars: int = 0) -> DataFrame:
    """Bars of a lake. The range begins ``warmup_bars`` bars before ``start``: windows there need them; ``in_range`` tells which rows were asked for."""
    df = spark.read.parquet(path)
    if symbols := list(symbols):
        df = df.where(F.col("symbol").isin(symbols))
    if timeframe:
        df = df.where(F.col("timeframe") == timeframe)
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    if start is not None:
        if warmup_bars and not timeframe:
            raise ValueError("a warm-up in bars needs a timeframe")
        step = interval(timeframe).split() if timeframe else ["0", "minute"]
        widened = lit(start) - F.expr(f"INTERVAL {int(step[0]) * warmup_bars} {step[1]}")
        df = df.where(F.col(ORDER) >= widened).withColumn("in_range", F.col(ORDER) >= lit(start))
    return df.where(F.col(ORDER) < lit(end)) if end is not None else df


def continuous_lake(raw: DataFrame, frames: Iterable[str] = ("5m", "15m", "1h", "4h", "1d"), base: str = "1m") -> DataFrame:
    """From raw bars of markets that never close to full bars of all frames, each made from the base."""
    filled = with_close_time(fill_grid(raw.withColumn("timeframe", F.lit(base)), base), base)
    columns = ["symbol", "timeframe", ORDER, *PRICES, "volume", "features_mask", "features_reason", "close_time"]
    out = filled.select(columns)
    for frame in frames:
        out = out.unionByName(resample(filled, frame).select(columns))
    return out


def session_lake(intraday: DataFrame, daily: DataFrame, zone: str = "Asia/Taipei", frames: Iterable[str] = ("30m", "60m", "4h")) -> DataFrame:
    """From raw 15-minute and daily bars of a market with sessions: the unclosed bar dropped, sessions filled, wider frames without gaps."""
    columns = ["symbol", "timeframe", ORDER, *PRICES, "volume", "features_mask", "features_reason", "close_time"]
    filled = with_close_time(fill_sessions(drop_unclosed(intraday.withColumn("timeframe", F.lit("15m"))), zone), "15m")
    out = filled.select(columns)
    for frame in frames:
        out = out.unionByName(resample(filled, frame, complete_only=True).select(columns))
    return out.unionByName(daily_track(drop_unclosed(daily.withColumn("timeframe", F.lit("1d")))).select(columns))


def usable(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars of sound symbols, and a table of the others (symbol, rows, bad): one bad symbol doesn't stop the rest.

    A bar is bad if its prices are missing or contradict each other.
    """
    good = F.coalesce((F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.col("high")), F.lit(False))
    judged = bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(~good).alias("bad"))
    bad = judged.where("bad > 0")
    return bars.join(bad.select("symbol"), "symbol", "left_anti"), bad


def missing_share(bars: DataFrame) -> DataFrame:
    """Per series, the share of bars that stand for missing ones."""
    return bars.groupBy(*KEYS).agg(F.avg((F.col("features_reason") == MISSING).cast("double")).alias("missing_share"))
