"""All queries over market data, with the parameters they are meant to run with, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions import series, sql
from barloom.operators import bars as ops
from barloom.operators import encoders, transitions
from barloom.operators.indicators import INDICATORS
from barloom.plans import blocks
from barloom.plans.features import FeaturePlan, columns_of, feature_sql, feature_table, plan_from, rounded, single
from barloom.plans.frame import Columns
from barloom.sources import lake, paged
from barloom.sources.shared import kept, scratch
from barloom.streaming import features as live_plans
from barloom.streaming import grids, live, scores, sessions
from barloom.streaming.ordered import state_store

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """Bars of events by type."""
    return ops.bars_from_ticks(_table(spark, sf_dir, "events"), timeframe, "event_type", "ts", "value", "event_id")


_STEP = {"1m": "1 minute", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "60m": "1 hour", "4h": "4 hours", "1d": "1 day"}


def _bars_sql(timeframe: str = "1h") -> str:
    return f"SELECT event_type AS symbol, '{timeframe}' AS timeframe, time_bucket(INTERVAL '{_STEP[timeframe]}', ts, TIMESTAMP '1970-01-01') AS datetime, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL"


_MASK = "close IS NOT NULL AND coalesce(volume, 0) > 0 AS features_mask, CAST(CASE WHEN close IS NULL THEN 3 ELSE 0 END AS TINYINT) AS features_reason"
_W = "PARTITION BY symbol, timeframe ORDER BY datetime"


def _filled_sql(source: str, timeframe: str) -> str:
    carried = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {c}" for c in ops.PRICES)
    return f"SELECT symbol, timeframe, datetime, {carried}, coalesce(volume, 0) AS volume, {_MASK} FROM (SELECT symbol, timeframe, unnest(generate_series(min(datetime), max(datetime), INTERVAL '{_STEP[timeframe]}')) AS datetime FROM ({source}) GROUP BY symbol, timeframe) AS g LEFT JOIN ({source}) AS b USING (symbol, timeframe, datetime)"


def _resampled_sql(source: str, timeframe: str) -> str:
    return f"SELECT symbol, '{timeframe}' AS timeframe, time_bucket(INTERVAL '{_STEP[timeframe]}', datetime, TIMESTAMP '1970-01-01') AS bar, arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) AS close, sum(volume) AS volume, bool_or(features_mask) AS features_mask, max(features_reason) AS features_reason FROM ({source}) GROUP BY ALL"


def _closed_sql(source: str, timeframe: str, at: str = "bar") -> str:
    return f"SELECT symbol, timeframe, {at} AS datetime, open, high, low, close, volume, features_mask, features_reason, {at} + INTERVAL '{_STEP[timeframe]}' - INTERVAL '1 millisecond' AS close_time FROM ({source})"


def filled_bars(spark, sf_dir):
    return ops.fill_grid(bars(spark, sf_dir), "1h")


def resampled(spark, sf_dir):
    base = ops.fill_grid(bars(spark, sf_dir), "1h")
    return ops.resample(base, "4h").unionByName(ops.resample(base, "1d"))


RESAMPLED_SQL = " UNION ALL ".join(_closed_sql(_resampled_sql(_filled_sql(_bars_sql(), "1h"), t), t) for t in ("4h", "1d"))

_LAKE_COLUMNS = ["symbol", "timeframe", ops.ORDER, *ops.PRICES, "volume", "features_mask", "features_reason", "close_time"]


def lake_round_trip(spark, sf_dir):
    """The continuous lake written and read again: partitions, column types and values survive."""
    raw = bars(spark, sf_dir).drop("timeframe")
    path = scratch(spark)
    lake.write_lake(lake.continuous_lake(raw, ("4h", "1d"), "1h"), path)
    return lake.read_lake(spark, path, timeframe="4h").select(_LAKE_COLUMNS)


LAKE_SQL = _closed_sql(_resampled_sql(_filled_sql(_bars_sql(), "1h"), "4h"), "4h")


def session_bars(spark, sf_dir):
    """15-minute bars on the trading grid of a market in Taipei, from ticks within its hours."""
    ticks = _table(spark, sf_dir, "events")
    raw = ops.bars_from_ticks(ticks, "15m", "event_type", "ts", "value", "event_id")
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Taipei"), F.col(ops.ORDER))
    inside = F.date_format(local, "HH:mm").between("09:00", "13:15")
    return ops.with_close_time(ops.fill_sessions(ops.drop_unclosed(raw.where(inside))), "15m").select(_LAKE_COLUMNS)


def _session_sql() -> str:
    raw = f"SELECT * FROM ({_bars_sql('15m')}) WHERE strftime(datetime + INTERVAL 8 HOUR, '%H:%M') BETWEEN '09:00' AND '13:15'"
    raw = f"SELECT * FROM ({raw}) QUALIFY datetime < max(datetime) OVER (PARTITION BY symbol, timeframe)"
    slots = f"SELECT symbol, timeframe, unnest(generate_series(day + INTERVAL 1 HOUR, day + INTERVAL 315 MINUTE, INTERVAL 15 MINUTE)) AS datetime FROM (SELECT DISTINCT symbol, timeframe, CAST(CAST(datetime + INTERVAL 8 HOUR AS DATE) AS TIMESTAMP) AS day FROM ({raw}))"
    rows = f"SELECT g.symbol, g.timeframe, g.datetime, open, high, low, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol, g.timeframe ORDER BY g.datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held, volume, {_MASK} FROM ({slots}) AS g LEFT JOIN ({raw}) AS b USING (symbol, timeframe, datetime)"
    return f"SELECT symbol, timeframe, datetime, coalesce(open, held) AS open, coalesce(high, held) AS high, coalesce(low, held) AS low, held AS close, coalesce(volume, 0) AS volume, features_mask, features_reason, datetime + INTERVAL 15 MINUTE - INTERVAL 1 MILLISECOND AS close_time FROM ({rows}) WHERE held IS NOT NULL"


def session_frames(spark, sf_dir):
    base = session_bars(spark, sf_dir)
    return ops.resample(base, "30m", complete_only=True).unionByName(ops.resample(base, "4h", complete_only=True))


def daily_bars(spark, sf_dir):
    return ops.daily_track(ops.drop_unclosed(bars(spark, sf_dir, "1d"))).select(_LAKE_COLUMNS)


def _daily_sql() -> str:
    return _closed_sql(f"SELECT *, {_MASK} FROM ({_bars_sql('1d')}) QUALIFY datetime < max(datetime) OVER (PARTITION BY symbol)", "1d", "datetime")


def aligned(spark, sf_dir):
    """Hourly bars beside the last day that had closed."""
    base = ops.with_close_time(bars(spark, sf_dir), "1h").select("symbol", ops.ORDER, "close", "close_time")
    day = ops.with_close_time(bars(spark, sf_dir, "1d"), "1d")
    return ops.latest_closed(base, day, "day_", ("close", "volume"))


def _aligned_sql() -> str:
    return f"""SELECT b.symbol, b.datetime, b.close, b.datetime + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS close_time, d.close_time AS day_close_time, d.close AS day_close, d.volume AS day_volume
FROM ({_bars_sql()}) AS b ASOF LEFT JOIN (SELECT *, datetime + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS close_time FROM ({_bars_sql('1d')})) AS d ON b.symbol = d.symbol AND b.datetime + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND >= d.close_time"""


def epoch_times(spark, sf_dir):
    """Times as epoch milliseconds, and back from them and from a local clock."""
    rows = _table(spark, sf_dir, "events").select("event_id", ops.to_millis("ts").alias("millis"), "ts")
    return rows.select("event_id", "millis", ops.from_millis("millis").alias("at"), ops.to_utc("ts", "Asia/Taipei").alias("utc"))


EPOCH_SQL = "SELECT event_id, epoch_us(ts) // 1000 AS millis, make_timestamp(epoch_us(ts) // 1000 * 1000) AS at, ts - INTERVAL 8 HOUR AS utc FROM events"


def warm_rows(spark, sf_dir):
    return ops.after_warmup(bars(spark, sf_dir).select("symbol", "timeframe", ops.ORDER, "close"), 300)


WARM_SQL = f"SELECT symbol, timeframe, datetime, close FROM ({_bars_sql()}) QUALIFY row_number() OVER ({_W}) > 300"


def _primitive_columns() -> tuple[Columns, dict[str, str]]:
    b = Columns()
    out = {
        "f_abs": "abs(close - open)", "f_floor": "floor(close)", "f_sqrt": sql.safe_sqrt("close - open"), "f_pow": sql.bounded_pow("close", 2), "f_root": sql.bounded_pow("close - open", 0.5),
        "f_max": sql.largest("open", "close"), "f_min": sql.smallest("open", "close"), "f_shift": b.lag("close", 3), "f_cumsum": series.cumulative(b, "volume"), "f_sum": series.rolling_sum(b, "volume", 10),
        "f_sma": series.sma(b, "close", 10), "f_stddev": series.stddev(b, "close", 10), "f_highest": series.highest(b, "close", 10), "f_lowest": series.lowest(b, "close", 10), "f_ema": series.ema(b, "close", 10),
        "f_rma": series.rma(b, "close", 10), "f_wilder": series.wilder(b, b.lag("close"), 10), "f_tr": series.true_range(b), "f_atr": series.atr(b, 14), "f_cmf": sql.clip(series.chaikin(b, 20), -1.0, 1.0),
        "f_zscore": series.zscore(b, "close", 20), "f_pivots": series.pivots(b, "close", 3, 3), "f_rolling_vol": sql.fill(f"stddev_samp(close) {sql.frame(9)}"),
        "f_ofi": f"{sql.div('(close - low) - (high - close)', 'greatest(abs(high - low), 1e-12)')} * volume",
    }
    return b, out


def primitives(spark, sf_dir):
    """Every building block, applied to hourly bars."""
    b, out = _primitive_columns()
    df = b.add_to(bars(spark, sf_dir), out, ())
    return df.select(*ops.KEYS, ops.ORDER, *(F.expr(rounded(f"CAST({c} AS DOUBLE)")).alias(c) for c in out))


def _primitives_sql() -> str:
    b, out = _primitive_columns()
    return f"SELECT symbol, timeframe, datetime, {', '.join(f'{rounded(f'CAST({c} AS DOUBLE)')} AS {c}' for c in out)} FROM ({b.sql(_bars_sql(), out)})"


_RELATED = {"Relative_Strength", "Global_Context", "Rolling_Correlation", "Rolling_Cointegration"}


def _indicator(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = bars(spark, sf_dir)
        if name in _RELATED:
            source = ops.beside(source, "click", {"series_b": "view", "series_c": "purchase"})
        return feature_table(source, single(name), keep=(), digits=6)

    run.__doc__ = f"{name}: raw values and features on hourly bars."
    return run


def _indicator_sql(name: str) -> str:
    source = _bars_sql()
    if name in _RELATED:
        source = f"SELECT a.*, b.close AS series_b, c.close AS series_c FROM ({source}) AS a JOIN ({source}) AS b ON b.symbol = 'view' AND a.datetime = b.datetime JOIN ({source}) AS c ON c.symbol = 'purchase' AND a.datetime = c.datetime WHERE a.symbol = 'click'"
    return feature_sql(source, single(name))


#: The light plan: momentum, bands, and market structure, 48 features.
LITE = FeaturePlan(
    (("MACD", "MACD"), ("RSI", "RSI"), ("ATR", "ATR"), ("Bollinger_Bands", "Bollinger_Bands"), ("Structure_SMC", "SMC_Context"), ("FVG_Zones", "FVG")),
    {"SMC_Context": {"adapt_macro_p": 55, "adapt_micro_p": 13, "adapt_vol_p": 34}, "FVG": {"adapt_macro_p": 21, "adapt_micro_p": 5}},
)
#: All indicators that need no other series beside their own.
FULL = FeaturePlan(tuple((n, n) for n in sorted(set(INDICATORS) - _RELATED)))


def lite_features(spark, sf_dir):
    return feature_table(bars(spark, sf_dir), LITE, raw=False, keep=(), digits=6)


def full_features(spark, sf_dir):
    """The wide table of all single-series indicators."""
    return feature_table(bars(spark, sf_dir), FULL, raw=False, keep=(), digits=6)


#: Session profiles, factors and windowed kernels have no SQL; tests hold them against plain loops.
_NO_SQL = {"Volume_Profile", "PCA", "Hurst", "Spectral", "Volume_Profile_Geometry"}
#: The full plan without these.
WIDE = FeaturePlan(tuple(x for x in FULL.entries if x[1] not in _NO_SQL))


def wide_features(spark, sf_dir):
    """The wide table of all single-series indicators that SQL can express, by blocks of series."""
    return feature_table(bars(spark, sf_dir), WIDE, raw=False, keep=(), digits=6, block_rows=300)


def static_transitions(spark, sf_dir):
    """One matrix for all bars, the identity at bars that are missing."""
    df = filled_bars(spark, sf_dir)
    matrix = transitions.frozen(transitions.static_transition(3), F.col("features_mask"), 3)
    flat = df.select("symbol", ops.ORDER, F.posexplode(F.flatten(matrix)).alias("cell", "p"))
    return flat.select("symbol", ops.ORDER, "cell", F.round("p", 6).alias("p"))


def _static_sql() -> str:
    stay, move = "exp(2.0) / (exp(2.0) + 2)", "1 / (exp(2.0) + 2)"
    return f"SELECT symbol, datetime, CAST(cell AS INTEGER) AS cell, round(CASE WHEN features_mask THEN CASE WHEN cell % 4 = 0 THEN {stay} ELSE {move} END WHEN cell % 4 = 0 THEN 1.0 ELSE 0.0 END, 6) AS p FROM ({_filled_sql(_bars_sql(), '1h')}), (SELECT unnest(range(9)) AS cell)"


def _fixed_weights(inputs: int, hidden: int, states: int) -> dict[str, list]:
    """Fixed weights from a rule."""
    wave = lambda i, j: ((i * 7 + j * 3) % 11 - 5) / 20.0
    return {"w1": [[wave(i, j) for j in range(inputs)] for i in range(hidden)], "b1": [0.0] * hidden, "w2": [[wave(i + 1, j + 2) for j in range(hidden)] for i in range(states * states)], "b2": [2.0 * (k % (states + 1) == 0) for k in range(states * states)]}


def dynamic_transitions(spark, sf_dir):
    """A matrix for each vector of ``embeddings``, from all its components over a hidden layer of 64."""
    vectors = _table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0)
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    x = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("embedding", i).cast("double"), F.lit(0.0)))  # components that are missing count as 0
    weights = {k: np.array(w) for k, w in _fixed_weights(width, 64, 3).items()}
    dense = encoders.dense(vectors.select("vec_id", x.alias("x")), "x", weights, 3, "matrix")
    flat = dense.select("vec_id", F.posexplode(F.flatten("matrix")).alias("cell", "p"))
    return flat.select("vec_id", "cell", F.round("p", 4).alias("p"))


def _encoded(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = encoders.EncoderConfig(kind, value_channels=5, metadata_dim=2, embedding_dim=128, heads=8, layers=3 if kind == "patchtst" else 2)
        df = encoders.windows(filled_bars(spark, sf_dir), [*ops.PRICES, "volume"], 32)
        table = spark.createDataFrame([("click", [1.0, 0.0]), ("view", [0.0, 1.0])], "symbol string, meta array<double>")
        scored = encoders.score(encoders.embed_metadata(df, table), config, encoders.random_weights(config))
        return scored.select("symbol", ops.ORDER, F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))

    run.__doc__ = f"The last state of the {kind} encoder for windows of 32 bars, one at each bar from the 32nd on."
    return run


def selective_scores(spark, sf_dir):
    """The last state of the selective state-space encoder for windows of 32 bars."""
    config = encoders.EncoderConfig("mamba", value_channels=5, metadata_dim=2, embedding_dim=32)
    df = encoders.windows(filled_bars(spark, sf_dir), [*ops.PRICES, "volume"], 32)
    scored = encoders.score(df, config, encoders.random_weights(config, scan=True))
    return scored.select("symbol", ops.ORDER, F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))


def _streamed(source: DataFrame, transform: Callable[[DataFrame], DataFrame], spark: SparkSession) -> DataFrame:
    """Runs a stream over what ``source`` reads now, and returns what it wrote to the shared folder."""
    folder = scratch(spark)
    with state_store(spark):
        query = transform(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_bars(spark, sf_dir):
    """Hourly bars of a stream of events: those that have closed by the watermark."""
    events = _table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    return _streamed(source, lambda s: live.live_bars(s, "1h", "event_type", "ts", "value", "event_id"), spark)


def _stream_sql() -> str:
    return f"SELECT symbol, timeframe, datetime, open, high, low, close, volume, datetime + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS close_time FROM ({_bars_sql()}) WHERE datetime + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events)"


def stream_rsi(spark, sf_dir):
    """The strength index as kept by a stream over written bars."""
    folder = scratch(spark)
    made = bars(spark, sf_dir)
    made.write.parquet(f"{folder}/bars")
    source = spark.readStream.schema(made.schema).parquet(f"{folder}/bars")
    out = _streamed(source, live.live_rsi, spark)
    return out.select("symbol", ops.ORDER, F.round("close", 6).alias("close"), F.round("rsi", 6).alias("rsi"))


def _stream_rsi_sql() -> str:
    b = Columns()
    inner = b.sql(_bars_sql(), {"close": "close", "rsi": series.rsi(b, "close", 14)})
    return f"SELECT symbol, datetime, round(close, 6) AS close, round(rsi, 6) AS rsi FROM ({inner})"


#: How late the streams below allow bars to be, beyond the bar that starts last.
_LATE = "4 hours"


def _in_parts(made: DataFrame, start: Callable[[DataFrame, str], StreamingQuery], folder: str) -> None:
    """Runs a stream over bars that come in two parts, a new run for each: some of the first part's last bars come with the second."""
    spark = made.sparkSession
    ends = made.agg(F.min(ops.ORDER).alias("first"), F.max(ops.ORDER).alias("last")).first()
    if ends["first"] is None:
        made.write.parquet(f"{folder}/bars")
        return
    middle = ends["first"] + (ends["last"] - ends["first"]) / 2
    held_back = F.col(ops.ORDER).between(F.lit(middle) - F.expr("INTERVAL 3 HOURS"), F.lit(middle)) & (F.xxhash64("symbol", ops.ORDER) % 2 == 0)
    made = kept(made.withColumn("part", F.when((F.col(ops.ORDER) > F.lit(middle)) | held_back, 1).otherwise(0)))
    for part in range(2):
        made.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/bars")
        start(spark.readStream.schema(made.drop("part").schema).parquet(f"{folder}/bars"), folder).awaitTermination()


def _appended(transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str], StreamingQuery]:
    def start(stream: DataFrame, folder: str) -> StreamingQuery:
        with state_store(stream.sparkSession):
            return transform(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")

    return start


def stream_missingness(spark, sf_dir):
    """Hourly bars of a stream, with those that are missing up to the watermark."""
    folder = scratch(spark)
    _in_parts(bars(spark, sf_dir), _appended(lambda s: grids.live_grid(s, "1h", _LATE)), folder)
    return spark.read.parquet(f"{folder}/out")


def _stream_missingness_sql() -> str:
    passed = f"(SELECT max(datetime) - INTERVAL {_LATE} FROM ({_bars_sql()}))"
    return _filled_sql(_bars_sql(), "1h").replace("generate_series(min(datetime), max(datetime), ", f"generate_series(min(datetime), {passed}, ")


def _taipei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute bars of events, those within the hours of a market in Taipei."""
    raw = ops.bars_from_ticks(_table(spark, sf_dir, "events"), "15m", "event_type", "ts", "value", "event_id")
    return raw.where(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Taipei"), F.col(ops.ORDER)), "HH:mm").between("09:00", "13:15"))


def stream_sessions(spark, sf_dir):
    """Full sessions of a stream: those that are over by the watermark."""
    folder = scratch(spark)
    _in_parts(_taipei(spark, sf_dir), _appended(lambda s: grids.live_sessions(s, lateness=_LATE)), folder)
    return ops.with_close_time(spark.read.parquet(f"{folder}/out"), "15m").select(_LAKE_COLUMNS)


def _stream_sessions_sql() -> str:
    raw = f"SELECT * FROM ({_bars_sql('15m')}) WHERE strftime(datetime + INTERVAL 8 HOUR, '%H:%M') BETWEEN '09:00' AND '13:15'"
    whole = _session_sql().replace(" QUALIFY datetime < max(datetime) OVER (PARTITION BY symbol, timeframe)", "")
    return f"SELECT * FROM ({whole}) WHERE CAST(CAST(datetime + INTERVAL 8 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 315 MINUTE <= (SELECT max(datetime) - INTERVAL {_LATE} FROM ({raw}))"


#: State machines and filters, kept by streams as a few numbers.
LEVELS = FeaturePlan(tuple((n, n) for n in ("SuperTrend", "Chandelier_Exit", "Kalman_Filter", "Order_Block")))


def _streamed_plan(plan: FeaturePlan, raw: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark)
        _in_parts(bars(spark, sf_dir), lambda s, f: live_plans.start_features(s, plan, f"{f}/out", f"{f}/state", _LATE, raw, ()), folder)
        found = live_plans.features(spark, f"{folder}/out")
        return found.selectExpr(*(c if c in (*ops.KEYS, ops.ORDER) else f"{rounded(f'CAST(`{c}` AS DOUBLE)')} AS `{c}`" for c in found.columns))

    return run


def _streamed_plan_sql(plan: FeaturePlan, raw: bool) -> str:
    """The same plan over all bars, without those that the watermark hasn't passed or that wait for bars after them."""
    b, out = columns_of(plan, raw)
    _, ahead = blocks.reaches(blocks.steps(b, out.values()), out)
    return f"SELECT * EXCLUDE (back) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) AS back FROM ({feature_sql(_bars_sql(), plan, raw)}) WHERE datetime <= (SELECT max(datetime) - INTERVAL {_LATE} FROM ({_bars_sql()}))) WHERE back > {ahead}"


def stream_scores(spark, sf_dir):
    """The recurrent encoder bar by bar over a stream: each vector sees all bars of its series so far."""
    folder = scratch(spark)
    config = encoders.EncoderConfig("lstm", value_channels=5, metadata_dim=2, embedding_dim=32, layers=2)
    _in_parts(bars(spark, sf_dir), _appended(lambda s: scores.live_scores(s, [*ops.PRICES, "volume"], config, encoders.random_weights(config), _LATE)), folder)
    return spark.read.parquet(f"{folder}/out").select("symbol", ops.ORDER, F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))


def stream_vwap(spark, sf_dir):
    """Average prices by volume of the running day, from a stream."""
    folder = scratch(spark)
    _in_parts(bars(spark, sf_dir), _appended(lambda s: sessions.live_vwap(s, lateness=_LATE)), folder)
    found = spark.read.parquet(f"{folder}/out")
    return found.select(*ops.KEYS, ops.ORDER, *(F.expr(rounded(c)).alias(f"vwap__{c.lower()}") for c in found.columns[4:]))


def _stream_vwap_sql() -> str:
    return f"SELECT * FROM ({feature_sql(_bars_sql(), single('VWAP'), features=False)}) WHERE datetime <= (SELECT max(datetime) - INTERVAL {_LATE} FROM ({_bars_sql()}))"


def stream_profiles(spark, sf_dir):
    """Volume profiles of the days of a stream that are over by the watermark."""
    folder = scratch(spark)
    _in_parts(bars(spark, sf_dir), _appended(lambda s: sessions.live_profiles(s, lateness=_LATE)), folder)
    return spark.read.parquet(f"{folder}/out")


def _one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute bars of all events together."""
    ticks = _table(spark, sf_dir, "events").withColumn("all", F.lit("all"))
    return ops.bars_from_ticks(ticks, "15m", "all", "ts", "value", "event_id")


def plan_blocks(spark, sf_dir):
    """The light plan over one long series, cut into blocks that are worked on apart."""
    return feature_table(_one_series(spark, sf_dir), LITE, raw=False, keep=(), digits=6, block_rows=500)


_PLAN_BLOCKS_SQL = feature_sql(_bars_sql("15m").replace("SELECT event_type AS symbol", "SELECT 'all' AS symbol"), LITE, raw=False)


def local_bars(spark, sf_dir):
    """A vendor's table of daily prices: headers in capitals, times on a clock in Taipei."""
    vendor = bars(spark, sf_dir, "1d").select(F.col("symbol").alias("SYMBOL"), F.col(ops.ORDER).alias("DateTime"), *(F.col(c).alias(c.capitalize()) for c in ops.PRICES), F.col("volume").alias("VOLUME"))
    return lake.read_wall_clock(vendor, "Asia/Taipei")


_LOCAL_SQL = f"SELECT symbol, datetime - INTERVAL 8 HOUR AS datetime, open, high, low, close, volume FROM ({_bars_sql('1d')})"


def _two_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session lake of a market in Taipei: intraday frames, and days as they are. Symbols whose bars contradict themselves are set aside."""
    day = bars(spark, sf_dir, "1d")
    broken = day.where("symbol = 'click'").withColumns({"symbol": F.lit("broken"), "low": F.col("high") + 1})
    sound, _ = lake.usable(day.unionByName(broken).drop("timeframe"))
    return lake.session_lake(_taipei(spark, sf_dir).drop("timeframe"), sound)


def session_lake(spark, sf_dir):
    return _two_tracks(spark, sf_dir)


def session_lake_epochs(spark, sf_dir):
    """The session lake as written with times in epoch milliseconds, and read again."""
    path = scratch(spark)
    lake.write_lake(_two_tracks(spark, sf_dir), path, epochs=True)
    return lake.read_lake(spark, path).select(_LAKE_COLUMNS)


def _session_lake_sql(times: Callable[[str], str] = lambda c: c) -> str:
    frames = " UNION ALL ".join([f"SELECT * FROM ({_session_sql()})", *(f"SELECT * FROM ({_closed_sql(_resampled_sql(_session_sql(), t), t)})" for t in ("30m", "60m", "4h")), f"SELECT * FROM ({_daily_sql()})"])
    return f"SELECT symbol, timeframe, {times('datetime')} AS datetime, open, high, low, close, volume, features_mask, features_reason, {times('close_time')} AS close_time FROM ({frames})"


def missing_shares(spark, sf_dir):
    """How much of each series stands for missing bars."""
    return lake.missing_share(filled_bars(spark, sf_dir)).select("symbol", "timeframe", F.round("missing_share", 9).alias("missing_share"))


_SHARES_SQL = f"SELECT symbol, timeframe, round(avg(CASE WHEN features_reason = 3 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS missing_share FROM ({_filled_sql(_bars_sql(), '1h')}) GROUP BY symbol, timeframe"

#: A plan as its file holds it.
PLAN_FILE = """
timeframes: [1h]
phase1_window: {warmup_bars: 100}
indicator_default_params:
  RSI: {period: 21}
  Bollinger_Bands: {period: 30}
meta_features_plan:
  - {id: FAST, indicator: RSI, params: {period: 7}}
  - {id: SLOW, indicator: RSI}
  - {id: BANDS, indicator: Bollinger_Bands}
"""


def plan_file(spark, sf_dir):
    """A plan read from YAML: parameters by indicator and by entry, two entries of one indicator, a warm-up."""
    import yaml

    return feature_table(bars(spark, sf_dir), plan_from(yaml.safe_load(PLAN_FILE)), keep=(), digits=6)


def _plan_file_sql() -> str:
    plan = FeaturePlan((("FAST", "RSI"), ("SLOW", "RSI"), ("BANDS", "Bollinger_Bands")), {"RSI": {"period": 21}, "FAST": {"period": 7}, "Bollinger_Bands": {"period": 30}})
    return f"SELECT * FROM ({feature_sql(_bars_sql(), plan)}) QUALIFY row_number() OVER ({_W}) > 100"


def _endpoint(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Minute bars of events as files of an endpoint, with times in milliseconds."""
    made = bars(spark, sf_dir, "1m").select("symbol", ops.to_millis(ops.ORDER).alias("timestamp"), *ops.PRICES, "volume")
    made.write.mode("append").parquet(f"{folder}/endpoint")
    spark.dataSource.register(paged.PagedBars)
    return made


def _pull(spark: SparkSession, folder: str) -> dict[str, str]:
    return {"client": "barloom.sources.paged:folder_client", "path": lake.qualified(spark, f"{folder}/endpoint"), "symbols": "click,error,purchase,signup,view", "wait": "0", "fail_every": "3", "pages": "5"}


_SINCE, _UNTIL = 1_704_412_800_000, 1_705_708_800_000  # 2024-01-05 and 2024-01-20


def paged_bars(spark, sf_dir):
    """Fifteen days of minute bars pulled page by page, of which a third fail at first."""
    folder = scratch(spark)
    _endpoint(spark, sf_dir, folder)
    return spark.read.format("paged_bars").options(**_pull(spark, folder), start=str(_SINCE), end=str(_UNTIL)).load()


_PAGED_SQL = f"SELECT symbol, epoch_ms(datetime) AS timestamp, open, high, low, close, volume FROM ({_bars_sql('1m')}) WHERE epoch_ms(datetime) >= {_SINCE} AND epoch_ms(datetime) < {_UNTIL} AND symbol IN ('click', 'error', 'purchase', 'signup', 'view')"


_PLAIN: dict[str, tuple[Query, str | None]] = {
    "bars_1h": (bars, _bars_sql()),
    "missingness": (filled_bars, _filled_sql(_bars_sql(), "1h")),
    "resample": (resampled, RESAMPLED_SQL),
    "session_grid": (session_bars, _session_sql()),
    "session_frames": (session_frames, " UNION ALL ".join(_closed_sql(_resampled_sql(_session_sql(), t), t) for t in ("30m", "4h"))),
    "daily_track": (daily_bars, _daily_sql()),
    "asof_align": (aligned, _aligned_sql()),
    "epoch_times": (epoch_times, EPOCH_SQL),
    "warmup": (warm_rows, WARM_SQL),
    "lake_round_trip": (lake_round_trip, LAKE_SQL),
    "primitives": (primitives, _primitives_sql()),
    "plan_lite": (lite_features, feature_sql(_bars_sql(), LITE, raw=False)),
    "plan_full": (full_features, None),
    "plan_wide": (wide_features, feature_sql(_bars_sql(), WIDE, raw=False)),
    "transition_static": (static_transitions, _static_sql()),
    "transition_dynamic": (dynamic_transitions, None),
    **{f"encoder_{k}": (_encoded(k), None) for k in ("lstm", "tcn", "patchtst", "mamba")},
    "stream_bars": (stream_bars, _stream_sql()),
    "stream_rsi": (stream_rsi, _stream_rsi_sql()),
    "stream_missingness": (stream_missingness, _stream_missingness_sql()),
    "stream_sessions": (stream_sessions, _stream_sessions_sql()),
    "stream_plan": (_streamed_plan(LITE, False), _streamed_plan_sql(LITE, False)),
    "stream_levels": (_streamed_plan(LEVELS, True), _streamed_plan_sql(LEVELS, True)),
    "stream_vwap": (stream_vwap, _stream_vwap_sql()),
    "stream_profiles": (stream_profiles, None),
    "stream_scores": (stream_scores, None),
    "plan_blocks": (plan_blocks, _PLAN_BLOCKS_SQL),
    "plan_file": (plan_file, _plan_file_sql()),
    "local_bars": (local_bars, _LOCAL_SQL),
    "session_lake": (session_lake, _session_lake_sql()),
    "session_lake_epochs": (session_lake_epochs, _session_lake_sql(lambda c: f"epoch_us({c}) // 1000")),
    "encoder_selective": (selective_scores, None),
    "paged_bars": (paged_bars, _PAGED_SQL),
    "missing_shares": (missing_shares, _SHARES_SQL),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _PLAIN.items()} | {f"ind_{n.lower()}": _indicator(n) for n in INDICATORS}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _PLAIN.items() if q is not None} | {f"ind_{n.lower()}": _indicator_sql(n) for n in INDICATORS if n not in _NO_SQL}
