"""Bars: from ticks, onto full time grids, into wider frames, and beside each other."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.buckets import SPAN, carried, ranked

KEYS, ORDER = ("symbol", "timeframe"), "datetime"
PRICES = ("open", "high", "low", "close")
#: Reason codes of the missingness channel.
PRESENT, MISSING = 0, 3
_UNITS = {"m": "minute", "h": "hour", "d": "day"}


def interval(timeframe: str) -> str:
    """'15m' as '15 minutes'."""
    found = re.fullmatch(r"([1-9]\d*)([mhd])", timeframe)
    if not found:
        raise ValueError(f"{timeframe!r} is no timeframe: a number and m, h or d")
    return f"{found[1]} {_UNITS[found[2]]}"


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def lower_headers(df: DataFrame, drop: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Column names in lower case, without those in ``drop``."""
    return df.toDF(*(c.lower() for c in df.columns)).drop(*drop)


def to_utc(at: Column | str, zone: str) -> Column:
    """A wall-clock time in ``zone`` as UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(at).cast("timestamp_ntz") if isinstance(at, str) else at.cast("timestamp_ntz"))


def from_millis(at: Column | str) -> Column:
    """Epoch milliseconds as UTC wall-clock time, whatever the session's zone."""
    at = F.col(at) if isinstance(at, str) else at
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(at / F.lit(1000)).cast("decimal(18,6)"))


def to_millis(at: Column | str) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), at).cast("long")


def with_close_time(bars: DataFrame, timeframe: str) -> DataFrame:
    """Adds close_time: a millisecond before the next bar opens."""
    return bars.withColumn("close_time", F.col(ORDER) + F.expr(f"INTERVAL {interval(timeframe)}") - F.expr("INTERVAL '0.001' SECOND"))


def bars_from_ticks(ticks: DataFrame, timeframe: str, symbol: str, at: str, price: str, tie: str, volume: Column | None = None) -> DataFrame:
    """Bars of single prices: open and close are those of the first and the last tick by time, then by ``tie``; volume counts ticks unless given.

    One aggregation with partial sums before its only shuffle. Rows without time or price are left out.
    """
    rows = ticks.where(F.col(at).isNotNull() & F.col(price).isNotNull())
    bar = F.window(at, interval(timeframe))
    order = F.struct(at, tie)
    return (
        rows.groupBy(F.col(symbol).cast("string").alias("symbol"), bar.alias("bar"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), (F.count("*") if volume is None else F.sum(volume)).cast("double").alias("volume"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("bar.start").alias(ORDER), *PRICES, "volume")
    )


def drop_unclosed(bars: DataFrame) -> DataFrame:
    """Without each symbol's latest bar, which may still change. The latest by time, not by arrival; one row for each series is joined back."""
    latest = bars.groupBy(*(F.col(k).alias(f"__{k}") for k in KEYS)).agg(F.max(ORDER).alias("__latest"))
    own = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS]
    return bars.join(latest, [*own, F.col(ORDER) < F.col("__latest")], "left_semi")


def _carried(name: str) -> Column:
    return F.last(name, ignorenulls=True).over(Window.partitionBy(*KEYS).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0))


def fill_grid(bars: DataFrame, timeframe: str) -> DataFrame:
    """Every bar from a symbol's first to its last, with features_mask and features_reason.

    Missing bars repeat the last prices, 0 before any; their volume is 0, their mask false, their reason 3. The grid
    is made where the symbol's two ends are known, so only they are shuffled for it.
    """
    ends = bars.groupBy(*KEYS).agg(F.min(ORDER).alias("first"), F.max(ORDER).alias("last"))
    grid = ends.select(*KEYS, F.explode(F.expr(f"sequence(first, last, INTERVAL {interval(timeframe)})")).alias(ORDER))
    rows = grid.join(bars, [*KEYS, ORDER], "left")
    marked = rows.withColumns({"features_mask": F.col("close").isNotNull() & (F.coalesce("volume", F.lit(0.0)) > 0), "features_reason": F.when(F.col("close").isNull(), MISSING).otherwise(PRESENT).cast("tinyint")})
    carried = {c: F.coalesce(_carried(c), F.lit(0).cast(bars.schema[c].dataType)) for c in [*PRICES, *(c for c in ("timestamp",) if c in bars.columns)]}
    return marked.withColumns(carried | {"volume": F.coalesce("volume", F.lit(0.0))})


def fill_sessions(bars: DataFrame, zone: str = "Asia/Taipei", opens: str = "09:00:00", last: str = "13:15:00", timeframe: str = "15m") -> DataFrame:
    """A full grid on each local date on which a symbol has bars; datetimes are UTC.

    Missing bars have the last close as all their prices and no volume; those before a symbol's first close are
    left out.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ORDER))
    days = bars.select(*KEYS, F.to_date(local).alias("day")).distinct()
    at = lambda clock: F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), F.lit(clock)))
    slots = days.select(*KEYS, F.explode(F.sequence(at(opens), at(last), F.expr(f"INTERVAL {interval(timeframe)}"))).alias("local"))
    grid = slots.select(*KEYS, F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("local")).alias(ORDER))
    rows = grid.join(bars, [*KEYS, ORDER], "left")
    marked = rows.withColumns({"features_mask": F.col("close").isNotNull() & (F.coalesce("volume", F.lit(0.0)) > 0), "features_reason": F.when(F.col("close").isNull(), MISSING).otherwise(PRESENT).cast("tinyint")})
    closed = marked.withColumns({"close": _carried("close"), "volume": F.coalesce("volume", F.lit(0.0))})
    return closed.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")}).where(F.col("close").isNotNull())


def resample(bars: DataFrame, timeframe: str, complete_only: bool = False) -> DataFrame:
    """Wider bars straight from the given ones, labelled by their opening, with close_time.

    The mask is true if any part's is; the reason is the largest of the parts. ``complete_only`` leaves out bars with a null.
    """
    order = F.col(ORDER)
    aggs = [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume")]
    if "features_mask" in bars.columns:
        aggs += [F.bool_or("features_mask").alias("features_mask"), F.max("features_reason").alias("features_reason")]
    out = bars.groupBy("symbol", F.window(ORDER, interval(timeframe)).alias("bar")).agg(*aggs)
    out = out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("bar.start").alias(ORDER), *(c for c in out.columns if c not in ("symbol", "bar")))
    out = with_close_time(out, timeframe)
    return out.dropna(how="any") if complete_only else out


def timeframes(bars: DataFrame, wanted: tuple[str, ...] = ("5m", "15m", "1h", "4h", "1d")) -> dict[str, DataFrame]:
    return {t: resample(bars, t) for t in wanted}


def daily_track(bars: DataFrame) -> DataFrame:
    """Bars that are taken as they are, without filling: mask, reason and close time only."""
    return with_close_time(bars.withColumns({"features_mask": F.col("close").isNotNull() & (F.coalesce("volume", F.lit(0.0)) > 0), "features_reason": F.when(F.col("close").isNull(), MISSING).otherwise(PRESENT).cast("tinyint")}), "1d")


def latest_closed(base: DataFrame, other: DataFrame, prefix: str, columns: tuple[str, ...] = (*PRICES, "volume"), span: str = SPAN) -> DataFrame:
    """Each base bar beside the last wider bar of its symbol that had closed when the base bar did: columns with ``prefix``.

    Both sides run in one order of close times, wider bars first, and the last one seen is carried on, through a bucket of ``span`` and from
    bucket to bucket: no join of ranges, and a symbol is as many tasks as it has buckets.
    """
    picked = F.struct("close_time", *columns)
    empty = F.lit(None).cast(other.select(picked.alias("x")).schema["x"].dataType)
    left = base.select("symbol", F.struct(*base.columns).alias("row"), F.col("close_time").alias("at"), F.lit(1).alias("side"), empty.alias("wide"))
    right = other.select("symbol", F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.col("close_time").alias("at"), F.lit(0).alias("side"), picked.alias("wide"))
    rows = carried(left.unionByName(right), ["symbol"], "at", {"seen": "wide"}, ["side"], span).where("side = 1")
    return rows.select("row.*", *(F.col(f"seen.{c}").alias(f"{prefix}{c}") for c in ("close_time", *columns)))


def beside(bars: DataFrame, base: str, others: dict[str, str], column: str = "close") -> DataFrame:
    """The bars of one symbol with a column of others at the same time. others: symbol by new column's name."""
    out = bars.where(F.col("symbol") == base)
    for name, symbol in others.items():
        other = bars.where(F.col("symbol") == symbol).select("timeframe", ORDER, F.col(column).alias(name))
        out = out.join(other, ["timeframe", ORDER])
    return out


def after_warmup(df: DataFrame, rows: int = 300, span: str = SPAN) -> DataFrame:
    """Without each series' first rows, in which long windows aren't full yet."""
    return ranked(df, KEYS, ORDER, "__row", span).where(F.col("__row") >= rows).drop("__row")


def sliced(bars: DataFrame, rows: int, halo: int) -> DataFrame:
    """Bars cut into slices of about ``rows`` rows that can be worked on apart: slice, in_halo, and the symbol marked with its slice.

    Each slice begins with the ``halo`` rows before it, to be dropped afterwards. For finite windows a halo of
    their length is exact; an average of span n forgets what lies 40 n rows back to within double precision. Values that
    sum up from a series' start (volume balances, last swings) can't be sliced.
    """
    at = F.row_number().over(Window.partitionBy(*KEYS).orderBy(ORDER)) - 1
    own = bars.withColumn("__at", at).withColumn("__own", F.expr(f"__at div {rows}"))
    reach = F.expr(f"sequence(__own, (__at + {halo}) div {rows})")
    ends = own.groupBy(*KEYS).agg(F.max("__own").alias("__last"))
    copies = own.join(ends, [*KEYS]).withColumn("slice", F.explode(reach)).where("slice <= __last")
    return copies.withColumns({"in_halo": F.col("slice") > F.col("__own"), "series": F.col("symbol"), "symbol": F.concat_ws("#", "symbol", F.col("slice").cast("string"))}).drop("__at", "__own", "__last")
