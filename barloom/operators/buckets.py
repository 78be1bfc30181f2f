"""Running values along series without a task that holds a series.

Series are cut into buckets of time. What a bucket hands on is one row; those rows run along the series, and come back as a marker before each
bucket's rows, so that every bucket is finished apart. Rows are read twice, and shuffled once by series and bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "28 days"
_UNITS = {"minute": 60, "hour": 3600, "day": 86400}


def seconds(span: str) -> int:
    """'28 days' in seconds."""
    n, unit = span.split()
    return int(n) * _UNITS[unit.removesuffix("s")]


def bucket(at: Column, span: str) -> Column:
    """The number of the span since 1970 in which a time lies; times that are null come before all."""
    since = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))
    return F.coalesce(F.floor(since / F.lit(seconds(span))), F.lit(-(1 << 62))).cast("long")


def _handed_on(rows: DataFrame, ends: DataFrame, keys: list[str], order: list[str], values: Mapping[str, Column]) -> tuple[DataFrame, Window]:
    """rows and, as markers before each bucket's, what ``values`` give of the buckets before it; the window over both within a bucket."""
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    markers = ends.select(*keys, "__bucket", F.lit(0).alias("__own"), *(v.over(before).alias(n) for n, v in values.items()))
    both = rows.withColumn("__own", F.lit(1)).unionByName(markers, allowMissingColumns=True)
    return both, Window.partitionBy(*keys, "__bucket").orderBy("__own", *order).rowsBetween(Window.unboundedPreceding, 0)


def ranked(rows: DataFrame, keys: Iterable[str], at: str, name: str, span: str = SPAN) -> DataFrame:
    """``rows`` with their place in the series, from 0, in column ``name``; equal times in any order."""
    keys = list(keys)
    own = rows.withColumn("__bucket", bucket(F.col(at), span))
    ends = own.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    both, within = _handed_on(own.withColumn("__rows", F.lit(1).cast("long")), ends, keys, [at], {"__rows": F.sum("__n")})
    return both.withColumn(name, F.sum("__rows").over(within) - 1).where("__own = 1").drop("__own", "__rows", "__bucket")


def carried(rows: DataFrame, keys: Iterable[str], at: str, values: Mapping[str, str], order: Iterable[str] = (), span: str = SPAN) -> DataFrame:
    """``rows`` with the last value so far that isn't null of other columns. values: those by new name; order: what follows ``at``."""
    keys, order = list(keys), [at, *order]
    own = rows.withColumn("__bucket", bucket(F.col(at), span)).withColumns({f"__v{i}": F.col(c) for i, c in enumerate(values.values())})
    names = [f"__v{i}" for i in range(len(values))]
    place = F.struct(*order)
    ends = own.groupBy(*keys, "__bucket").agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(v) for v in names))
    both, within = _handed_on(own, ends, keys, order, {v: F.last(v, ignorenulls=True) for v in names})
    out = both.withColumns({n: F.last(v, ignorenulls=True).over(within) for n, v in zip(values, names, strict=True)})
    return out.where("__own = 1").drop("__own", "__bucket", *names)
