"""Bars pulled page by page: cursors, retries with growing pauses, giving up, streams that go on where they ended."""

from __future__ import annotations

import pytest

from barloom.sources import paged
from barloom.sources.paged import PagedBars, Range, Throttled, Unreachable

ROWS = "symbol string, timestamp bigint, open double, high double, low double, close double, volume double"


class Flaky:
    """Bars at every minute but some; each page fails as often as told."""

    def __init__(self, fails, error=Throttled):
        self.fails, self.error, self.asked = fails, error, []

    def fetch(self, symbol, since, limit):
        self.asked.append(since)
        if self.asked.count(since) <= self.fails:
            raise self.error(symbol)
        return [(t, 1.0, 2.0, None, 1.5, 3.0) for t in range(since, 200) if t % 7][:limit]


def pulled(client, end=100, retries=5, give_up=False):
    pauses = []
    return list(paged.pages(client, Range("a", 0, end), 10, 1, retries, 1.0, give_up, pauses.append)), pauses


@pytest.mark.parametrize("error", [Throttled, Unreachable])
def test_pages_follow_the_cursor_and_pauses_double(error):
    client = Flaky(3, error)
    rows, pauses = pulled(client)
    assert [r[1] for r in rows] == [t for t in range(100) if t % 7] and rows[0] == ("a", 1, 1.0, 2.0, None, 1.5, 3.0)
    starts = list(dict.fromkeys(client.asked))
    assert pauses == [1.0, 2.0, 4.0] * len(starts) and len(starts) == 9
    assert all(client.asked.count(s) == 4 for s in starts)


def test_a_page_that_never_comes():
    with pytest.raises(Unreachable):
        pulled(Flaky(9))
    rows, pauses = pulled(Flaky(9), give_up=True)
    assert rows == [] and pauses == [1.0, 2.0, 4.0, 8.0, 16.0]
    with pytest.raises(KeyError):  # other errors aren't retried
        pulled(Flaky(1, KeyError))
    assert pulled(Flaky(0), end=0) == ([], [])


def options(path, **more):
    return {"client": "barloom.sources.paged:folder_client", "path": f"file://{path}", "symbols": "a,b,none", "wait": "0", "page": "3", "pages": "2", "fail_every": "2", **more}


def bars(spark, minutes, path):
    rows = [(s, m * 60_000, float(m), None, 0.0, 1.0, 2.0) for s in "ab" for m in minutes]
    spark.createDataFrame(rows, ROWS).write.mode("append").parquet(str(path))
    return {r[:2] for r in rows}


def test_reading_with_failing_pages(spark, tmp_path):
    spark.dataSource.register(PagedBars)
    want = bars(spark, [m for m in range(60) if m % 5], tmp_path / "in")
    df = spark.read.format("paged_bars").options(**options(tmp_path / "in")).load()
    assert {(r["symbol"], r["timestamp"]) for r in df.collect()} == want and df.count() == len(want)
    assert df.rdd.getNumPartitions() == 3 * 10
    part = spark.read.format("paged_bars").options(**options(tmp_path / "in", start="600000", end="1200000")).load()
    assert sorted((r["symbol"], r["timestamp"] // 60_000) for r in part.collect()) == sorted((s, m) for s in "ab" for m in range(10, 20) if m % 5)
    last = spark.read.format("paged_bars").options(**options(tmp_path / "in", last_bars="6")).load()
    assert {r["timestamp"] // 60_000 for r in last.collect()} == {54, 56, 57, 58, 59}
    with pytest.raises(Exception, match="client"):
        spark.read.format("paged_bars").options(symbols="a").load().collect()


def test_streams_go_on_where_they_ended(spark, tmp_path):
    spark.dataSource.register(PagedBars)

    def run():
        stream = spark.readStream.format("paged_bars").options(**options(tmp_path / "in")).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((r["symbol"], r["timestamp"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = bars(spark, range(20), tmp_path / "in")
    assert run() == sorted(first)
    second = bars(spark, range(25, 40), tmp_path / "in")
    assert run() == sorted(first | second)
