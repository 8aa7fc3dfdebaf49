"""Registered queries of the time series engine, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import agent as A
from tidemark.operators import archive as V
from tidemark.operators import bars as B
from tidemark.operators import causal as K
from tidemark.operators import discovery as D
from tidemark.operators import events as E
from tidemark.operators import frames as H
from tidemark.operators import indicators as I
from tidemark.operators import labeling as L
from tidemark.operators import memory as Y
from tidemark.operators import models as M
from tidemark.operators import neighbours as N
from tidemark.operators import profiles as P
from tidemark.operators import resample as R
from tidemark.operators import scoring as S
from tidemark.operators.chunked import running_total
from tidemark.operators.series import change, ema, full, over
from tidemark.plans import sql as q
from tidemark.storage import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight symbols' price walks in whole cents, from the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select((F.col("user_id") % 8).alias("k"), "event_id", "ts", (F.round(F.col("value") * 100).cast("bigint") - 5000).alias("step"))
    e = running_total(e, F.col("step"), ["k"], ["event_id"], F.expr("event_id div 65536"), "walk")
    return e.select(
        F.concat(F.lit("S"), F.col("k").cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        ((F.col("walk") + 5000000) / F.lit(100.0)).alias("price"), (1 + F.col("event_id") % 10).cast("double").alias("qty"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ohlcv(ticks(spark, sf_dir), 30, price="price")


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return R.as_of(R.ohlcv(t, 30, price="price"), R.ohlcv(t, 240, price="price"), "4H")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with ATR, realised volatility and bands."""
    return I.bollinger(I.realized_vol(I.atr(bars(spark, sf_dir)), 30))


BAND_ARGS, CUSUM_ARGS = {"lookback": 3, "least": 0.1}, {"threshold": 0.5, "drift": 0.05, "reset": 48}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.all_events(prepared(spark, sf_dir), None, CUSUM_ARGS, BAND_ARGS)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features, the return four bars ahead and whether it is positive."""
    c = F.col("close")
    df = bars(spark, sf_dir).select(
        "symbol", "ts", change(c).alias("f1"), change(c, 6).alias("f2"), ((c - full(F.avg(c), c, 20)) / c).alias("f3"), F.col("volume").alias("f4"), (F.lead(c, 4).over(over()) / c - 1).alias("fwd")
    )
    return df.na.drop().withColumn("y", (F.col("fwd") > 0).cast("int"))


FEATURES = ["f1", "f2", "f3", "f4"]
t_ = "epoch_ms(ts) AS t"


def T() -> Column:
    return F.unix_millis("ts").alias("t")


def r6(c: Column | str, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


@query(q.with_(f"SELECT symbol, {t_}, open, high, low, close, volume FROM bars", q.TICKS, q.BARS))
def r2_resample(s, d):
    return bars(s, d).select("symbol", T(), "open", "high", "low", "close", "volume")


@query("SELECT event_id, CASE WHEN epoch_us(ts) >= 1000000000000000 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) END AS ms FROM events")
def b1_epoch_ms(s, d):
    from tidemark.sources.files import epoch_ms

    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", epoch_ms(F.unix_micros(F.col("ts").cast("timestamp"))).alias("ms"))


@query(q.with_(
    "SELECT a.symbol, seq, coalesce(0.6745 * abs(price - m) / nullif(mad, 0) > 3, false) AS outlier FROM a JOIN (SELECT symbol, median(abs(price - m)) AS mad FROM a GROUP BY 1) z ON a.symbol = z.symbol",
    q.TICKS, "a AS (SELECT ticks.*, m FROM ticks JOIN (SELECT symbol, median(price) AS m FROM ticks GROUP BY 1) x ON ticks.symbol = x.symbol)"))
def b2_mad_outliers(s, d):
    return B.mad_outliers(ticks(s, d)).select("symbol", "seq", "outlier")


@query(q.with_(f"SELECT symbol, seq, {q.r6('x', 'log_return')} FROM (SELECT symbol, seq, ln(price) - lag(ln(price)) OVER (PARTITION BY symbol ORDER BY ts, seq) AS x FROM ticks) WHERE x IS NOT NULL", q.TICKS))
def b3_log_returns(s, d):
    return B.log_returns(ticks(s, d)).select("symbol", "seq", r6("log_return"))


@query(q.with_("SELECT symbol, seq, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM ticks) WHERE rn % 25 = 0", q.TICKS))
def b4_tick_bars(s, d):
    return B.tick_bars(ticks(s, d), 25).select("symbol", "seq", "price")


def _fold(x: str, m: str) -> str:
    return q.with_("SELECT symbol, seq, price FROM f WHERE hit", q.TICKS, f"n AS (SELECT *, {x} AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM ticks)",
        f"""f AS (SELECT symbol, seq, price, rn, v >= {m} AS hit, CASE WHEN v >= {m} THEN 0 ELSE v END AS acc FROM n WHERE rn = 1
 UNION ALL SELECT n.symbol, n.seq, n.price, n.rn, f.acc + n.v >= {m}, CASE WHEN f.acc + n.v >= {m} THEN 0 ELSE f.acc + n.v END FROM f JOIN n ON n.symbol = f.symbol AND n.rn = f.rn + 1)""", recursive=True)


@query(_fold("qty", "60"))
def b5_volume_bars(s, d):
    return B.threshold_bars(ticks(s, d), "qty", 60).select("symbol", "seq", "price")


@query(_fold("price * qty", "3000000"))
def b6_dollar_bars(s, d):
    return B.threshold_bars(ticks(s, d).withColumn("value", F.col("price") * F.col("qty")), "value", 3e6, signed=True).select("symbol", "seq", "price")


_B7 = _fold("price * qty", "3000000").replace("SELECT symbol, seq, price FROM f WHERE hit", "SELECT symbol, seq, price, seq % 5 AS venue FROM f WHERE hit AND seq % 5 <> 0")


@query(_B7)
def b7_form_dollar_bars(s, d):
    t = ticks(s, d).withColumn("value", F.col("price") * F.col("qty")).withColumn("venue", F.when(F.col("seq") % 5 != 0, F.col("seq") % 5))
    return B.form_dollar_bars(t, 3e6).select("symbol", "seq", "price", "venue")


@query(q.with_(f"""SELECT symbol, {t_}, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low,
 last_value(close IGNORE NULLS) OVER w AS close, coalesce(volume, 0) AS volume FROM (SELECT sp.symbol, sp.ts, open, high, low, close, volume FROM sp LEFT JOIN g ON g.symbol = sp.symbol AND g.ts = sp.ts)
 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""", q.TICKS,
    "u AS (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) = 1)",
    "g AS (SELECT symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume FROM u GROUP BY 1, 2)",
    "sp AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 60 MINUTE)) AS ts FROM g GROUP BY 1)"))
def b8_time_bars(s, d):
    return B.time_bars(ticks(s, d), 60).select("symbol", T(), "open", "high", "low", "close", "volume")


@query(q.with_("SELECT symbol, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars) WHERE n <= 2 GROUP BY 1", q.TICKS, q.BARS))
def r1_first_step(s, d):
    return P.first_step(bars(s, d)).select("symbol", F.round("seconds", 3).alias("seconds"))


@query(q.with_("SELECT symbol, epoch_ms(time_bucket(INTERVAL 240 MINUTE, ts) + INTERVAL 240 MINUTE) AS t, sum(n_trades) AS n_trades, arg_max(tag, seq) AS tag FROM x GROUP BY 1, 2", q.TICKS, "x AS (SELECT *, seq % 3 AS n_trades, seq % 7 AS tag FROM ticks)"))
def r3_extra_columns(s, d):
    x = ticks(s, d).withColumn("n_trades", F.col("seq") % 3).withColumn("tag", F.col("seq") % 7)
    return R.ohlcv(x, 240, price="price", extra=("n_trades", "tag")).select("symbol", T(), "n_trades", "tag")


@query(q.with_(f"SELECT sp.symbol, epoch_ms(sp.ts) AS t, close, coalesce(volume, 0) AS volume FROM sp LEFT JOIN bars b ON b.symbol = sp.symbol AND b.ts = sp.ts", q.TICKS, q.BARS,
    "sp AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts FROM bars GROUP BY 1)"))
def r4_gap_bins(s, d):
    return R.with_gaps(bars(s, d), 30).select("symbol", T(), "close", "volume")


@query(q.with_(f"SELECT symbol, {t_}, epoch_ms(h_ts) AS h_t, h_open, h_high, h_low, h_close, h_volume FROM ctx", q.TICKS, q.BARS, q.H4, q.ASOF))
def r5_as_of(s, d):
    h = lambda c: F.col(f"4H_{c}").alias(f"h_{c}")
    return context(s, d).select("symbol", T(), F.unix_millis("4H_end").alias("h_t"), *[h(c) for c in R.OHLCV])


@query(q.with_(f"""SELECT symbol, {t_}, {q.r6('(h_close / h_open - 1) * 100', 'ret')}, {q.r6('(close / h_close - 1) * 100', 'dist')}, {q.r6('(h_high - h_low) / h_close * 100', 'rng')},
 {q.r6('(close - h_low) / nullif(h_high - h_low, 0) * 100', 'pos')}, CASE WHEN a > 0 AND b > 0 THEN 1 WHEN a < 0 AND b < 0 THEN -1 ELSE 0 END AS align
 FROM (SELECT *, close - lag(close) OVER ({q.W}) AS a, h_close - lag(h_close) OVER ({q.W}) AS b FROM ctx)""", q.TICKS, q.BARS, q.H4, q.ASOF))
def r7_r11_derived(s, d):
    df = R.derived(context(s, d), "4H")
    return df.select("symbol", T(), r6("4H_return", "ret"), r6("distance_from_4H", "dist"), r6("4H_range_pct", "rng"), r6("position_in_4H_range", "pos"), F.col("4H_momentum_align").alias("align"))


@query(q.with_("SELECT 'bars' AS frame, count(*) AS n_rows, epoch_ms(min(ts)) AS a, epoch_ms(max(ts)) AS b FROM bars UNION ALL SELECT 'h4', count(*), epoch_ms(min(ts)), epoch_ms(max(ts)) FROM h4", q.TICKS, q.BARS, q.H4))
def r13_frame_info(s, d):
    df = P.frame_info({"bars": bars(s, d), "h4": R.ohlcv(ticks(s, d), 240, price="price")})
    return df.select("frame", "n_rows", F.unix_millis("a").alias("a"), F.unix_millis("b").alias("b"))


@query(q.with_(f"SELECT symbol, {t_}, epoch_ms(h_ts) AS h_t FROM (SELECT *, lag(h_ts) OVER ({q.W}) AS p FROM ctx) WHERE h_ts IS NOT NULL AND (p IS NULL OR p <> h_ts)", q.TICKS, q.BARS, q.H4, q.ASOF))
def i1_new_bars(s, d):
    return I.new_bars(context(s, d), "4H").select("symbol", T(), F.unix_millis("4H_end").alias("h_t"))


@query(q.with_(f"SELECT n.symbol, epoch_ms(n.ts) AS t, CASE WHEN n.rn >= 12 THEN round(a.y, 6) END AS ema_12, CASE WHEN n.rn >= 50 THEN round(b.y, 6) END AS ema_50 FROM nb n JOIN e1 a ON a.symbol = n.symbol AND a.rn = n.rn JOIN e2 b ON b.symbol = n.symbol AND b.rn = n.rn",
    q.TICKS, q.BARS, q.NUMBERED, q.ema_cte("e1", "nb", "close", "(CAST(2 AS DOUBLE) / 13)"), q.ema_cte("e2", "nb", "close", "(CAST(2 AS DOUBLE) / 51)"), recursive=True))
def i3_ema(s, d):
    return ema(ema(bars(s, d), 12), 50).select("symbol", T(), r6("ema_12"), r6("ema_50"))


@query(q.with_(f"SELECT symbol, {t_}, {q.r6(q.full('avg(close)', 'close', 20), 'sma_20')}, {q.r6(q.full('avg(close)', 'close', 200), 'sma_200')} FROM bars", q.TICKS, q.BARS))
def i4_sma(s, d):
    return I.sma(bars(s, d), 20, 200).select("symbol", T(), r6("sma_20"), r6("sma_200"))


@query(q.with_("SELECT m.symbol, epoch_ms(m.ts) AS t, round(macd, 6) AS macd, CASE WHEN m.rn >= 9 THEN round(g.y, 6) END AS macd_signal, CASE WHEN m.rn >= 9 THEN round(macd - g.y, 6) END AS macd_hist FROM m JOIN g ON g.symbol = m.symbol AND g.rn = m.rn",
    q.TICKS, q.BARS, q.NUMBERED, q.ema_cte("e1", "nb", "close", "(CAST(2 AS DOUBLE) / 13)"), q.ema_cte("e2", "nb", "close", "(CAST(2 AS DOUBLE) / 27)"),
    "m AS (SELECT n.symbol, n.ts, n.rn - 25 AS rn, a.y - b.y AS macd FROM nb n JOIN e1 a ON a.symbol = n.symbol AND a.rn = n.rn JOIN e2 b ON b.symbol = n.symbol AND b.rn = n.rn WHERE n.rn >= 26)",
    q.ema_cte("g", "m", "macd", "(CAST(2 AS DOUBLE) / 10)"), recursive=True))
def i5_macd(s, d):
    return I.macd(bars(s, d)).where("macd is not null").select("symbol", T(), r6("macd"), r6("macd_signal"), r6("macd_hist"))


@query(q.with_("SELECT m.symbol, epoch_ms(m.ts) AS t, round(CASE WHEN b.y = 0 THEN 100 ELSE 100 - 100 / (1 + a.y / b.y) END, 6) AS rsi FROM m JOIN a ON a.symbol = m.symbol AND a.rn = m.rn JOIN b ON b.symbol = m.symbol AND b.rn = m.rn WHERE m.rn >= 14",
    q.TICKS, q.BARS, q.NUMBERED, f"m AS (SELECT symbol, ts, rn - 1 AS rn, greatest(x, 0) AS up, greatest(-x, 0) AS dn FROM (SELECT *, close - lag(close) OVER ({q.W}) AS x FROM nb) WHERE x IS NOT NULL)",
    q.ema_cte("a", "m", "up", "(CAST(1 AS DOUBLE) / 14)"), q.ema_cte("b", "m", "dn", "(CAST(1 AS DOUBLE) / 14)"), recursive=True))
def i6_rsi(s, d):
    return I.rsi(bars(s, d)).where("rsi is not null").select("symbol", T(), r6("rsi"))


@query(q.with_(f"SELECT symbol, {t_}, round(mid, 6) AS bb_middle, round(up, 6) AS bb_upper, round(lo, 6) AS bb_lower, round(coalesce((close - lo) / nullif(up - lo, 0) * 100, 50), 6) AS bb_position, round(coalesce((up - lo) / close * 100, 0), 6) AS bb_width_pct FROM bb2", q.TICKS, q.BARS, q.BB))
def i7_bollinger(s, d):
    return I.bollinger(bars(s, d)).select("symbol", T(), *[r6(c) for c in ("bb_middle", "bb_upper", "bb_lower", "bb_position", "bb_width_pct")])


@query(q.with_("SELECT m.symbol, epoch_ms(m.ts) AS t, round(a.y, 6) AS atr, round(a.y / m.close * 100, 6) AS atr_pct FROM m JOIN a ON a.symbol = m.symbol AND a.rn = m.rn",
    q.TICKS, q.BARS, q.NUMBERED, f"tr AS (SELECT symbol, ts, rn, close, CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (SELECT *, lag(close) OVER ({q.W}) AS pc FROM nb))",
    f"m AS (SELECT symbol, ts, rn - 13 AS rn, close, CASE WHEN rn = 14 THEN m14 ELSE tr END AS x FROM (SELECT *, avg(tr) OVER {q.rows(14)} AS m14 FROM tr) WHERE rn >= 14)", q.ema_cte("a", "m", "x", "(CAST(1 AS DOUBLE) / 14)"), recursive=True))
def i8_atr(s, d):
    return I.atr(bars(s, d)).where("atr is not null").select("symbol", T(), r6("atr"), r6("atr_pct"))


@query(q.with_(f"SELECT symbol, {t_}, round(m, 6) AS volume_sma, round(volume / nullif(m, 0), 6) AS volume_ratio FROM (SELECT *, {q.full('avg(volume)', 'volume', 20)} AS m FROM bars)", q.TICKS, q.BARS))
def i9_volume_ratio(s, d):
    return I.volume_ratio(bars(s, d)).select("symbol", T(), r6("volume_sma"), r6("volume_ratio"))


@query(q.with_(f"SELECT symbol, {t_}, " + ", ".join(q.r6(q.change(k), f"ret_{k}") for k in (1, 5, 6, 16, 20, 48)) + " FROM bars", q.TICKS, q.BARS))
def i12_returns(s, d):
    return I.returns(bars(s, d), 1, 5, 6, 16, 20, 48).select("symbol", T(), *[r6(f"ret_{k}") for k in (1, 5, 6, 16, 20, 48)])


@query(q.with_(f"SELECT symbol, {t_}, round({q.full('stddev_samp(r)', 'r', 20)} * sqrt(48), 6) AS vol_realized FROM rets", q.TICKS, q.BARS, q.RET))
def i13_realized_vol(s, d):
    return I.realized_vol(bars(s, d), 30).select("symbol", T(), r6("vol_realized"))


def _context_sql(src: str, s_: int, m: int, l_: int) -> tuple[str, ...]:
    """A higher frame's indicators on its own bars (h0: one row a bar), and the base rows with the last of them (hc)."""
    e = lambda name, n: q.ema_cte(name, "h0", "close", f"(CAST(2 AS DOUBLE) / {n + 1})")
    g = lambda name, x: q.ema_cte(name, "h2", x, "(CAST(1 AS DOUBLE) / 14)")
    tail = lambda x, f: f"CASE WHEN rn >= k + {int(f != 'avg')} THEN list_aggregate(list_slice(list({x}) OVER {q.rows(20)}, -k, -1), '{f}') END"
    return (
        f"hb AS (SELECT *, lag(h_ts) OVER ({q.W}) AS ph FROM {src})",
        f"h0 AS (SELECT symbol, ts, h_open AS open, h_close AS close, h_volume AS volume, row_number() OVER ({q.W}) AS rn, least(20, count(*) OVER (PARTITION BY symbol) // 2) AS k, count(*) OVER (PARTITION BY symbol) AS nn FROM hb WHERE h_ts IS NOT NULL AND (ph IS NULL OR ph <> h_ts))",
        "h1 AS (SELECT *, close - lag(close) OVER w AS x, close / lag(close) OVER w - 1 AS returns FROM h0 WINDOW w AS (PARTITION BY symbol ORDER BY rn))",
        "h2 AS (SELECT symbol, rn - 1 AS rn, greatest(x, 0) AS up, greatest(-x, 0) AS dn FROM h1 WHERE x IS NOT NULL)", e("he", s_), e("hf", m), e("hg", l_), g("hu", "up"), g("hd", "dn"),
        f"""h3 AS (SELECT h1.symbol, h1.ts, CASE WHEN nn >= 20 AND h1.rn >= {s_} THEN he.y END AS ema_short, CASE WHEN nn >= 20 AND h1.rn >= {m} THEN hf.y END AS ema_medium, CASE WHEN nn >= 20 AND h1.rn >= {l_} THEN hg.y END AS ema_long,
 CASE WHEN nn >= 20 AND h1.rn >= 15 THEN CASE WHEN hd.y = 0 THEN 100 ELSE 100 - 100 / (1 + hu.y / hd.y) END END AS rsi, CASE WHEN nn >= 20 THEN returns END AS returns,
 CASE WHEN nn >= 20 THEN close / lag(close, {s_}) OVER w - 1 END AS momentum_short, CASE WHEN nn >= 20 THEN close / lag(close, {m}) OVER w - 1 END AS momentum_medium,
 CASE WHEN nn >= 20 THEN vy END AS volatility, CASE WHEN nn >= 20 THEN vv END AS volume_sma
 FROM (SELECT *, {tail('returns', 'stddev_samp')} AS vy, {tail('volume', 'avg')} AS vv FROM h1) h1 JOIN he USING (symbol, rn) JOIN hf USING (symbol, rn) JOIN hg USING (symbol, rn)
 LEFT JOIN hu ON hu.symbol = h1.symbol AND hu.rn = h1.rn - 1 LEFT JOIN hd ON hd.symbol = h1.symbol AND hd.rn = h1.rn - 1 WINDOW w AS (PARTITION BY h1.symbol ORDER BY h1.rn))""",
        f"hc AS (SELECT c.*, {q.change(5).replace('close', 'c.close').replace('symbol', 'c.symbol').replace('ORDER BY ts', 'ORDER BY c.ts')} AS mine, h3.* EXCLUDE (symbol, ts) FROM {src} c ASOF LEFT JOIN h3 ON c.symbol = h3.symbol AND c.ts >= h3.ts)",
    )


_HIGH = ("ema_short", "ema_medium", "ema_long", "rsi", "returns", "momentum_short", "momentum_medium", "volatility", "volume_sma")
_CROSS = "round((close / h_close - 1) * 100, 6) AS pct, sign(mine) * sign(momentum_short) AS align, round(coalesce(abs(mine) / nullif(abs(momentum_short), 0), 1), 6) AS ratio"


@query(q.with_(f"SELECT symbol, {t_}, " + ", ".join(f"round({c}, 6) AS {c}" for c in _HIGH) + f", {_CROSS} FROM hc", q.TICKS, q.BARS, q.H4, q.ASOF, *_context_sql("ctx", 6, 24, 72), recursive=True))
def i19_i23_hourly_context(s, d):
    df = H.higher_context(context(s, d))
    return df.select("symbol", T(), *[r6(f"4H_{c}", c) for c in _HIGH], r6("price_vs_4H_pct", "pct"), F.col("4H_align").alias("align"), r6("4H_momentum_ratio", "ratio"))


DAY = ("d1 AS (SELECT symbol, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2)",
    "ctd AS (SELECT b.*, h.ts AS h_ts, h.open AS h_open, h.high AS h_high, h.low AS h_low, h.close AS h_close, h.volume AS h_volume FROM bars b ASOF LEFT JOIN d1 h ON b.symbol = h.symbol AND b.ts > h.ts)")


@query(q.with_(f"SELECT symbol, {t_}, " + ", ".join(f"round({c}, 6) AS {c}" for c in _HIGH) + f", {_CROSS} FROM hc", q.TICKS, q.BARS, *DAY, *_context_sql("ctd", 5, 20, 50), recursive=True))
def i19_i23_daily_context(s, d):
    t = ticks(s, d)
    df = H.higher_context(R.as_of(R.ohlcv(t, 30, price="price"), R.ohlcv(t, 1440, price="price"), "1D"))
    return df.select("symbol", T(), *[r6(f"1D_{c}", c) for c in _HIGH], r6("price_vs_1D_pct", "pct"), F.col("1D_align").alias("align"), r6("1D_momentum_ratio", "ratio"))


@query(q.with_(f"SELECT symbol, epoch_ms(ts) AS t, epoch_ms(h_ts) AS h_t FROM (SELECT *, lag(h_close) OVER ({q.W}) AS p FROM ctx WHERE h_close IS NOT NULL) WHERE p IS NULL OR p <> h_close", q.TICKS, q.BARS, q.H4, q.ASOF))
def i2_bars_by_close(s, d):
    c = context(s, d)
    at = c.select("symbol", "ts", F.unix_millis("4H_end").alias("h_t"))
    return H.bars_of(c, "4H", on="close").select("symbol", "ts").join(at, ["symbol", "ts"]).select("symbol", T(), "h_t")


@query(q.with_(f"""SELECT c.symbol, epoch_ms(c.ts) AS t, round(x.sma_20, 6) AS sma_20, round(x.bb_upper, 6) AS bb_upper, round(x.vm, 6) AS volume_sma, round(x.volume / nullif(x.vm, 0), 6) AS volume_ratio FROM ctx c ASOF LEFT JOIN x ON c.symbol = x.symbol AND c.ts >= x.ts""",
    q.TICKS, q.BARS, q.H4, q.ASOF, f"hb AS (SELECT *, lag(h_ts) OVER ({q.W}) AS ph FROM ctx)", f"h0 AS (SELECT symbol, ts, h_close AS close, h_volume AS volume FROM hb WHERE h_ts IS NOT NULL AND (ph IS NULL OR ph <> h_ts))",
    f"x AS (SELECT symbol, ts, volume, {q.full('avg(close)', 'close', 20)} AS sma_20, {q.full('avg(close)', 'close', 20)} + 2 * ({q.full('stddev_pop(close)', 'close', 20)}) AS bb_upper, {q.full('avg(volume)', 'volume', 20)} AS vm FROM h0)"))
def i10_i11_base_indicators(s, d):
    return H.base_indicators(context(s, d), "4H").select("symbol", T(), r6("sma_20"), r6("bb_upper"), r6("volume_sma"), r6("volume_ratio"))


EMA2 = (q.ema_cte("e1", "nb", "close", "(CAST(2 AS DOUBLE) / 13)"), q.ema_cte("e2", "nb", "close", "(CAST(2 AS DOUBLE) / 27)"))
RSI = (f"rs AS (SELECT symbol, ts, rn - 1 AS rn, greatest(x, 0) AS up, greatest(-x, 0) AS dn FROM (SELECT *, close - lag(close) OVER ({q.W}) AS x FROM nb) WHERE x IS NOT NULL)",
    q.ema_cte("ru", "rs", "up", "(CAST(1 AS DOUBLE) / 14)"), q.ema_cte("rd", "rs", "dn", "(CAST(1 AS DOUBLE) / 14)"))


@query(q.with_(f"""SELECT symbol, epoch_ms(ts) AS t, round((close / f12 - 1) * 100, 6) AS ema_12_dist_pct, round((close / f26 - 1) * 100, 6) AS ema_26_dist_pct, round((close - f12) / nullif(atr, 0), 6) AS ema_12_dist_atr, round((close - f26) / nullif(atr, 0), 6) AS ema_26_dist_atr,
 round((f12 - f26) / nullif(atr, 0), 6) AS macd_normalized, round((f12 - f26) / nullif(vol, 0), 6) AS macd_efficiency, round((rsi - 50) * sign(m5), 6) AS rsi_momentum, round(atr_pct, 6) AS atr_pct FROM
 (SELECT n.symbol, n.ts, n.close, atr, atr_pct, CASE WHEN n.rn >= 12 THEN e1.y END AS f12, CASE WHEN n.rn >= 26 THEN e2.y END AS f26, vol, m5, CASE WHEN n.rn >= 15 THEN CASE WHEN rd.y = 0 THEN 100 ELSE 100 - 100 / (1 + ru.y / rd.y) END END AS rsi
 FROM (SELECT *, {q.change(5)} AS m5, {q.full('stddev_samp(r)', 'r', 20)} * sqrt(48) AS vol FROM (SELECT *, {q.change()} AS r FROM nb)) n JOIN e1 ON e1.symbol = n.symbol AND e1.rn = n.rn JOIN e2 ON e2.symbol = n.symbol AND e2.rn = n.rn
 LEFT JOIN atrs ON atrs.symbol = n.symbol AND atrs.ts = n.ts LEFT JOIN ru ON ru.symbol = n.symbol AND ru.rn = n.rn - 1 LEFT JOIN rd ON rd.symbol = n.symbol AND rd.rn = n.rn - 1)""", q.TICKS, q.BARS, q.NUMBERED, *q.ATR, *EMA2, *RSI, recursive=True))
def i14_i17_derived(s, d):
    b = I.derived(I.realized_vol(I.atr(I.rsi(I.macd(ema(ema(bars(s, d), 12), 26)))), 30))
    return b.select("symbol", T(), *[r6(c) for c in ("ema_12_dist_pct", "ema_26_dist_pct", "ema_12_dist_atr", "ema_26_dist_atr", "macd_normalized", "macd_efficiency", "rsi_momentum", "atr_pct")])


@query(q.with_(f"SELECT b.symbol, epoch_ms(b.ts) AS t, b.close, h.close AS h4_close, g.close AS d_close, round((b.close / h.close - 1) * 100, 6) AS h4_distance FROM bars b ASOF LEFT JOIN h4 h ON b.symbol = h.symbol AND b.ts > h.ts ASOF LEFT JOIN d1 g ON b.symbol = g.symbol AND b.ts > g.ts", q.TICKS, q.BARS, q.H4, DAY[0]))
def r14_process(s, d):
    df = R.process(ticks(s, d), 30, ("4H", "1D"))
    return df.select("symbol", "t", "close", F.col("4H_close").alias("h4_close"), F.col("1D_close").alias("d_close"), r6("distance_from_4H", "h4_distance"))


@query(q.with_("SELECT symbol, epoch_ms(ts) AS t, round(p, 6) AS cusum_pos, round(q, 6) AS cusum_neg, e AS cusum_event FROM c0", q.TICKS, q.BARS, q.CUSUM, recursive=True))
def e1_cusum(s, d):
    return E.cusum(bars(s, d)).select("symbol", T(), r6("cusum_pos"), r6("cusum_neg"), "cusum_event")


BANDS = ["bb_upper_cross", "bb_lower_cross", "bb_middle_up", "bb_middle_down", "bb_squeeze", "bb_expansion", "bb_any_cross"]


@query(q.with_(f"SELECT symbol, {t_}, {', '.join(BANDS)} FROM band2", q.TICKS, q.BARS, q.BB, q.BAND))
def e2_e6_band_events(s, d):
    return E.band_events(I.bollinger(bars(s, d))).select("symbol", T(), *BANDS)


STATS = ["price_momentum_norm", "volume_zscore", "price_vol_corr", "vol_breakout_score", "return_zscore", "mom_short", "mom_medium", "mom_long", "momentum_score"]
ST = (q.TICKS, q.BARS, q.NUMBERED, *q.ATR, q.STATS)


@query(q.with_(f"SELECT symbol, {t_}, " + ", ".join(q.r6(c, c) for c in STATS) + " FROM st", *ST, recursive=True))
def e7_e13_statistics(s, d):
    return E.statistics(prepared(s, d)).select("symbol", T(), *[r6(c) for c in STATS])


@query(q.with_(f"SELECT symbol, {t_}, vpd_event, outlier_event, momentum_event FROM st", *ST, recursive=True))
def e14_e16_stat_events(s, d):
    return E.stat_events(E.statistics(prepared(s, d))).select("symbol", T(), "vpd_event", "outlier_event", "momentum_event")


EV = (*ST, q.BB, q.BAND, q.CUSUM, q.ALL_EVENTS)
MANY = "(vpd_event::INT + outlier_event::INT + momentum_event::INT + bb_any_cross::INT + cusum_flag::INT)"


TYPE = f"""CASE WHEN {MANY} > 1 THEN 8 + {MANY} - 2 WHEN bb_expansion THEN 7 WHEN bb_squeeze THEN 6
 WHEN bb_any_cross THEN 5 WHEN cusum_flag THEN 4 WHEN momentum_event THEN 3 WHEN outlier_event THEN 2 WHEN vpd_event THEN 1 ELSE 0 END"""


@query(q.with_(f"SELECT symbol, {t_}, traditional_event, any_event, {TYPE} AS event_type FROM ev", *EV, recursive=True))
def e17_e18_event_type(s, d):
    return events(s, d).select("symbol", T(), "traditional_event", "any_event", "event_type")


FLAGS = ["vpd_event", "outlier_event", "momentum_event", "cusum_flag"]


def _near(c: str, w: int = 2) -> str:
    return f"max({c}::INT) OVER ({q.W} ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING) = 1"


@query(q.with_(f"SELECT symbol, {t_}, {_near('outlier_event')} AND {_near('cusum_flag')} AS both, max(vpd_event::INT) OVER ({q.W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AND max(momentum_event::INT) OVER ({q.W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS causal FROM ev", *EV, recursive=True))
def c1_window_covent(s, d):
    return events(s, d).select("symbol", T(), E.together(["outlier_event", "cusum_flag"], 2).alias("both"), E.together(["vpd_event", "momentum_event"], 2, causal=True).alias("causal"))


_PAIRS = [*schema.PAIRS, *[t for t in combinations(schema.EVENTS, 2) if t not in schema.PAIRS and t[::-1] not in schema.PAIRS]]
_TRIPLES = [*schema.TRIPLES, *[t for t in combinations(schema.EVENTS[:6], 3) if t not in schema.TRIPLES]]


def _count(groups: list[tuple[str, ...]]) -> str:
    return " + ".join(f"({' AND '.join(f'n_{x}' for x in t)})::INT" for t in groups)


COV = (*EV, "nr AS (SELECT *, " + ", ".join(f"{_near(c)} AS n_{c}" for c in schema.EVENTS) + " FROM ev)", f"cv AS (SELECT *, {_count(_PAIRS[:50])} AS count_2way, {_count(_TRIPLES[:50])} AS count_3way FROM nr)",
    "cw0 AS (SELECT *, count_2way + count_3way AS total, vpd_event::INT + outlier_event::INT + momentum_event::INT + traditional_event::INT + any_event::INT + cusum_flag::INT AS single FROM cv)",
    f"""cw AS (SELECT *, total > 0 AS any_covent, {TYPE} AS event_type, cusum_flag AND momentum_event AND bb_any_cross AS trend_reversal, vpd_event AND outlier_event AND bb_expansion AS breakout,
 (coalesce(lag(bb_squeeze, 1) OVER ({q.W}), false) OR coalesce(lag(bb_squeeze, 2) OVER ({q.W}), false)) AND bb_expansion AND momentum_event AS squeeze_release FROM cw0)""")


def _covents(s, d) -> DataFrame:
    return E.covents(events(s, d), list(schema.EVENTS), 2, 50, schema.PAIRS, schema.TRIPLES)


@query(q.with_(f"""SELECT symbol, {t_}, count_2way, count_3way, count_2way > 0 AS any_2way, count_3way > 0 AS any_3way, total AS total_covents, total AS covent_intensity, any_covent, total >= 2 AS high_confluence, total >= 3 AS very_high_confluence,
 single AS individual_event_count, sum(any_covent::INT) OVER {q.rows(3)} AS covent_persistence, sum(any_covent::INT) OVER {q.rows(3)} >= 2 AS sustained, any_covent AND single >= 1 AS escalation FROM cw""", *COV, recursive=True))
def c2_c7_covents(s, d):
    return _covents(s, d).select(
        "symbol", T(), "count_2way", "count_3way", "any_2way", "any_3way", "total_covents", "covent_intensity", "any_covent", "high_confluence", "very_high_confluence", "individual_event_count", "covent_persistence", "sustained", "escalation")


@query(q.with_(f"""SELECT symbol, {t_}, n_cusum_flag AND n_bb_upper_cross AS covent_2way_cusum_flag_bb_upper_cross, n_outlier_event AND n_bb_expansion AS covent_2way_outlier_bb_expansion,
 n_vpd_event AND n_outlier_event AND n_momentum_event AS covent_3way_vpd_outlier_momentum FROM nr""", *COV[:-3], recursive=True))
def c2_c3_named_covents(s, d):
    df = E.covents(events(s, d), list(schema.EVENTS), 2, 50, schema.PAIRS[:5], schema.TRIPLES, generic=False)
    return df.select("symbol", T(), "covent_2way_cusum_flag_bb_upper_cross", "covent_2way_outlier_bb_expansion", "covent_3way_vpd_outlier_momentum")


@query(q.with_(f"""SELECT symbol, {t_}, any_event OR any_covent AS any_event_with_covent, CASE WHEN squeeze_release THEN 25 WHEN breakout THEN 24 WHEN trend_reversal THEN 23 WHEN total >= 2 THEN 22
 WHEN count_3way > 0 AND NOT any_event THEN 21 WHEN count_2way > 0 AND NOT any_event THEN 20 ELSE event_type END AS enhanced_event_type FROM cw""", *COV, recursive=True))
def c11_enhanced_type(s, d):
    return E.enhanced_type(E.confluence(_covents(s, d))).select("symbol", T(), "any_event_with_covent", "enhanced_event_type")


@query(q.with_(f"""SELECT symbol, {t_}, cusum_flag AND momentum_event AND bb_any_cross AS trend_reversal, vpd_event AND outlier_event AND bb_expansion AS breakout,
 (coalesce(lag(bb_squeeze, 1) OVER ({q.W}), false) OR coalesce(lag(bb_squeeze, 2) OVER ({q.W}), false)) AND bb_expansion AND momentum_event AS squeeze_release FROM ev""", *EV, recursive=True))
def c8_c10_confluence(s, d):
    return E.confluence(events(s, d)).select("symbol", T(), "trend_reversal", "breakout", "squeeze_release")


@query(q.with_(" UNION ALL ".join(f"SELECT '{c}' AS event, sum({c}::INT) AS n, round(avg({c}::INT), 6) AS rate FROM ev" for c in FLAGS), *EV, recursive=True))
def c14_event_summary(s, d):
    return E.summary(events(s, d), FLAGS).select("event", "n", r6("rate"))


@query(q.with_(f"SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, epoch_ms(min(ts)) AS a, epoch_ms(max(ts)) AS b FROM (SELECT ts, {TYPE} AS event_type FROM ev) GROUP BY 1", *EV, recursive=True))
def c14_type_counts(s, d):
    return E.type_counts(events(s, d)).select("event_type", "n", r6("share"), F.unix_millis("first_ts").alias("a"), F.unix_millis("last_ts").alias("b"))


@query(q.with_(f"SELECT symbol, {t_}, round(price_vol_corr, 6) AS price_vol_corr, vpd_event, outlier_event, momentum_event FROM st", *ST, recursive=True))
def c13_complete(s, d):
    df = H.complete(context(s, d), 30, None, {"cusum": CUSUM_ARGS, "bb_events": {"lookback": 3, "min_distance": 0.1}})
    return df.select("symbol", T(), r6("price_vol_corr"), "vpd_event", "outlier_event", "momentum_event")


SEL = ("sel AS (SELECT 'outlier_label' AS label_name, symbol, ts FROM ev WHERE outlier_event UNION ALL SELECT 'momentum_label', symbol, ts FROM ev WHERE momentum_event"
       " UNION ALL SELECT 'mixed_label', symbol, ts FROM ev WHERE vpd_event OR cusum_flag)")
LABELS = {"outlier_label": ["outlier_event"], "momentum_label": ["momentum_event"], "mixed_label": ["vpd_event", "cusum_flag"]}


@query(q.with_(f"SELECT label_name, symbol, {t_} FROM sel", *EV, SEL, recursive=True))
def l2_l5_select_events(s, d):
    return L.select_events(events(s, d), LABELS).select("label_name", "symbol", T())


FAC = (q.RET, f"""fa0 AS (SELECT *, CASE WHEN count(r) OVER {q.rows(20)} > 5 THEN stddev_samp(r) OVER {q.rows(20)} ELSE 0.02 END AS vol, volume / nullif(avg(volume) OVER {q.rows(51)}, 0) AS rel FROM rets),
fa1 AS (SELECT *, CASE WHEN count(*) OVER {q.rows(100, 1)} >= 10 THEN vol / nullif(avg(vol) OVER {q.rows(100, 1)}, 0) END AS share FROM fa0),
fa AS (SELECT *, CASE WHEN rel < 0.5 THEN 1.4 WHEN rel > 2 THEN 0.8 ELSE 1.0 END::DOUBLE AS liquidity, CASE WHEN share > 1.5 THEN 1.3 WHEN share < 0.7 THEN 0.8 ELSE 1.0 END::DOUBLE AS regime FROM fa1)""")


@query(q.with_(f"SELECT symbol, {t_}, round(vol, 6) AS vol, liquidity, regime FROM fa", q.TICKS, q.BARS, *FAC))
def l6_l8_factors(s, d):
    return L.factors(bars(s, d)).select("symbol", T(), r6("vol"), "liquidity", "regime")


BAR = ("""br0 AS (SELECT sel.label_name, fa.symbol, fa.ts, fa.close, greatest(0.015125, vol * regime * liquidity * 2.0) AS pt, greatest(0.6 * 0.015125, vol * regime * liquidity * 1.2) AS stop_loss FROM sel JOIN fa ON fa.symbol = sel.symbol AND fa.ts = sel.ts),
br AS (SELECT b.label_name, b.symbol, b.ts, b.close, b.stop_loss, CASE WHEN pt / stop_loss < 1.5 THEN stop_loss * 1.5 ELSE pt END AS profit_take, least(b.ts + INTERVAL 1 DAY, e.mx) AS vertical
 FROM br0 b JOIN (SELECT symbol, max(ts) AS mx FROM bars GROUP BY 1) e ON e.symbol = b.symbol)""",)


@query(q.with_(f"SELECT label_name, symbol, {t_}, round(profit_take, 6) AS profit_take, round(stop_loss, 6) AS stop_loss, epoch_ms(vertical) AS v FROM br", *EV, SEL, *FAC, *BAR, recursive=True))
def l9_l12_barriers(s, d):
    e = L.select_events(events(s, d), LABELS)
    return L.barriers(e, L.factors(bars(s, d))).select("label_name", "symbol", T(), r6("profit_take"), r6("stop_loss"), F.unix_millis("vertical").alias("v"))


TB = ("""tb0 AS (SELECT br.label_name, br.symbol, br.ts, any_value(br.close) AS close, any_value(profit_take) AS pt, any_value(stop_loss) AS sl, any_value(vertical) AS vertical, count(*) AS n,
 min(CASE WHEN p.high / br.close - 1 >= profit_take THEN p.ts END) AS up, min(CASE WHEN p.low / br.close - 1 <= -stop_loss THEN p.ts END) AS down, arg_max(p.close, p.ts) AS lc
 FROM br JOIN bars p ON p.symbol = br.symbol AND p.ts BETWEEN br.ts AND br.vertical GROUP BY 1, 2, 3),
tb AS (SELECT *, n > 1 AND up IS NOT NULL AND (down IS NULL OR up <= down) AS win, n > 1 AND down IS NOT NULL AND (up IS NULL OR down < up) AS lose FROM tb0),
tl AS (SELECT label_name, symbol, ts, CASE WHEN win THEN 1 WHEN lose THEN -1 ELSE 0 END AS label, CASE WHEN win THEN 'profit' WHEN lose THEN 'stop' ELSE 'vertical' END AS barrier,
 CASE WHEN win THEN up WHEN lose THEN down WHEN n > 1 THEN vertical ELSE ts END AS touch, CASE WHEN win THEN pt WHEN lose THEN -sl WHEN n > 1 THEN lc / close - 1 ELSE 0 END AS ret FROM tb)""",)


def _labels(s, d) -> DataFrame:
    b = L.factors(bars(s, d))
    return L.triple_barrier(L.barriers(L.select_events(events(s, d), LABELS), b), b)


@query(q.with_(f"SELECT label_name, symbol, {t_}, label, barrier, epoch_ms(touch) AS touch_t, round(ret, 6) AS ret, round((epoch_us(touch) - epoch_us(ts)) / 3.6e9, 6) AS holding_hours FROM tl", *EV, SEL, *FAC, *BAR, *TB, recursive=True))
def l13_triple_barrier(s, d):
    return _labels(s, d).select("label_name", "symbol", T(), "label", "barrier", F.unix_millis("touch_ts").alias("touch_t"), r6("ret"), r6("holding_hours"))


SUMMARY = """SELECT label_name, count(*) AS n, round(avg((label = 1)::INT), 6) AS success_rate, round(avg((label = -1)::INT), 6) AS stop_rate, round(avg((label = 0)::INT), 6) AS neutral_rate, round(avg(ret), 6) AS mean_ret,
 round(avg((epoch_us(touch) - epoch_us(ts)) / 3.6e9), 6) AS mean_hours, sum((barrier = 'profit')::INT)::BIGINT AS n_profit, sum((barrier = 'stop')::INT)::BIGINT AS n_stop, sum((barrier = 'vertical')::INT)::BIGINT AS n_vertical FROM tl GROUP BY 1"""
_SUMMARY = ("success_rate", "stop_rate", "neutral_rate", "mean_ret", "mean_hours")


def _summed(labels: DataFrame) -> DataFrame:
    return L.summary(labels).select("label_name", "n", *[r6(c) for c in _SUMMARY], "n_profit", "n_stop", "n_vertical")


@query(q.with_(SUMMARY, *EV, SEL, *FAC, *BAR, *TB, recursive=True))
def l17_label_summary(s, d):
    return _summed(_labels(s, d))


@query(q.with_(f"SELECT b.symbol, epoch_ms(b.ts) AS t, " + ", ".join(f"max(CASE WHEN label_name = '{n}' THEN {x} END) AS {n}{y}" for n in LABELS for x, y in (("label", ""), ("barrier", "_barrier"), ("round(ret, 6)", "_ret"), ("epoch_ms(touch)", "_touch_t"), ("round((epoch_us(touch) - epoch_us(tl.ts)) / 3.6e9, 6)", "_holding_hours")))
    + " FROM bars b LEFT JOIN tl ON tl.symbol = b.symbol AND tl.ts = b.ts GROUP BY 1, 2", *EV, SEL, *FAC, *BAR, *TB, recursive=True))
def l16_attach(s, d):
    df = L.attach(bars(s, d), _labels(s, d), list(LABELS))
    cols = [c for n in LABELS for c in (F.col(n), F.col(f"{n}_barrier"), r6(f"{n}_ret"), F.unix_millis(f"{n}_touch_ts").alias(f"{n}_touch_t"), r6(f"{n}_holding_hours"))]
    return df.select("symbol", T(), *cols)


@query(q.with_(f"SELECT symbol, {t_} FROM ev WHERE outlier_event AND bb_expansion", *EV, recursive=True))
def l4_simultaneous(s, d):
    return L.select_events(events(s, d), {"both_label": ["outlier_event", "bb_expansion"]}, "all").select("symbol", T())


def _barriers_sql(select: str, floor: float, pt: str, sl: str, rr: float, days: float) -> tuple[str, ...]:
    return (f"sel AS ({select})", FACTORS_ATR[0], FACTORS_ATR[1], f"br0 AS (SELECT sel.label_name, fa.symbol, fa.ts, fa.close, greatest({floor}, {pt}) AS pt, greatest(0.6 * {floor}, {sl}) AS stop_loss FROM sel JOIN fa ON fa.symbol = sel.symbol AND fa.ts = sel.ts)",
        f"""br AS (SELECT b.label_name, b.symbol, b.ts, b.close, b.stop_loss, CASE WHEN pt / stop_loss < {rr} THEN stop_loss * {rr} ELSE pt END AS profit_take, least(b.ts + INTERVAL {int(days * 24 * 60)} MINUTE, e.mx) AS vertical
 FROM br0 b JOIN (SELECT symbol, max(ts) AS mx FROM bars GROUP BY 1) e ON e.symbol = b.symbol)""", *TB)


FACTORS_ATR = (q.RET, FAC[1].replace("FROM rets),", "FROM (SELECT rets.*, atr_pct FROM rets LEFT JOIN atrs USING (symbol, ts))),", 1).replace(f"CASE WHEN count(r) OVER {q.rows(20)} > 5", f"CASE WHEN atr_pct IS NOT NULL THEN atr_pct / 100 WHEN count(r) OVER {q.rows(20)} > 5", 1))


@query(q.with_(f"SELECT symbol, {t_}, round(vol, 6) AS vol, liquidity, regime FROM fa", q.TICKS, q.BARS, q.NUMBERED, *q.ATR, *FACTORS_ATR, recursive=True))
def l6_atr_factors(s, d):
    return L.factors(I.atr(bars(s, d))).select("symbol", T(), r6("vol"), "liquidity", "regime")


@query(q.with_(SUMMARY, *EV, *_barriers_sql("SELECT 'outlier_label' AS label_name, symbol, ts FROM ev WHERE outlier_event", 0.015, "0.02", "0.015", 1.5, 1.0), recursive=True))
def l11_simple_barriers(s, d):
    return _summed(L.label_events(events(s, d), "outlier_event", dynamic=False))


@query(q.with_(SUMMARY, *EV, *_barriers_sql("SELECT 'outlier_label' AS label_name, symbol, ts FROM ev WHERE outlier_event UNION ALL SELECT 'momentum_label', symbol, ts FROM ev WHERE momentum_event", 0.015125, "vol * regime * liquidity * 2.0", "vol * regime * liquidity * 1.2", 1.5, 1.0), recursive=True))
def l18_label_all(s, d):
    return L.labeled(events(s, d), ["outlier_event", "momentum_event"])[1].select("label_name", "n", *[r6(c) for c in _SUMMARY], "n_profit", "n_stop", "n_vertical")


@query(q.with_(SUMMARY, *EV, *_barriers_sql("SELECT 'outlier_label' AS label_name, symbol, ts FROM ev WHERE outlier_event", (2 * 0.0026 + 0.0005 + 0.0002 + 0.00005) * 3, "vol * regime * liquidity * 1.5", "vol * regime * liquidity * 1.0", 2.0, 0.5), recursive=True))
def l19_preset_scalping(s, d):
    return _summed(L.preset(events(s, d), "scalping"))


@query(q.with_(SUMMARY, *EV, *_barriers_sql("SELECT 'momentum_label' AS label_name, symbol, ts FROM ev WHERE momentum_event", 0.015125, "vol * regime * 2.5", "vol * regime * 1.5", 1.8, 3.0), recursive=True))
def l19_preset_swing(s, d):
    return _summed(L.preset(events(s, d), "swing"))


_multi = [("outlier", 1.8, 1.1, 0.75, 2.2, "liquidity"), ("momentum", 2.3, 1.4, 2.5, 1.7, "1"), ("vpd", 3.0, 1.8, 1.5, 1.6, "liquidity")]


def _case(i: int, cast: str = "") -> str:
    return "CASE label_name " + " ".join(f"WHEN '{m[0]}_label' THEN {m[i]}" for m in _multi) + " END" + cast


@query(q.with_(SUMMARY, *EV, "sel AS (" + " UNION ALL ".join(f"SELECT '{m[0]}_label' AS label_name, symbol, ts FROM ev WHERE {m[0]}_event" for m in _multi) + ")", *FACTORS_ATR,
    f"br0 AS (SELECT sel.label_name, fa.symbol, fa.ts, fa.close, vol * regime * {_case(5)} AS sc FROM sel JOIN fa ON fa.symbol = sel.symbol AND fa.ts = sel.ts)", f"br1 AS (SELECT *, greatest(0.015125, sc * {_case(1)}) AS pt, greatest(0.6 * 0.015125, sc * {_case(2)}) AS stop_loss FROM br0)",
    f"""br AS (SELECT b.label_name, b.symbol, b.ts, b.close, b.stop_loss, CASE WHEN pt / stop_loss < {_case(4)} THEN stop_loss * {_case(4)} ELSE pt END AS profit_take, least(b.ts + to_minutes(({_case(3)} * 1440)::BIGINT), e.mx) AS vertical
 FROM br1 b JOIN (SELECT symbol, max(ts) AS mx FROM bars GROUP BY 1) e ON e.symbol = b.symbol)""", *TB, recursive=True))
def l19_l22_preset_multi_frame(s, d):
    return _summed(L.preset(events(s, d), "multi_frame"))


@query(q.with_(SUMMARY, *EV, *_barriers_sql("SELECT 'outlier_momentum_label' AS label_name, symbol, ts FROM ev WHERE outlier_event AND momentum_event", 0.015125, "vol * regime * liquidity * 2.8", "vol * regime * liquidity * 1.6", 1.5, 2.0), recursive=True))
def l19_preset_high_confidence(s, d):
    return _summed(L.preset(events(s, d), "high_confidence"))


@query(q.with_(SUMMARY, *EV, *_barriers_sql("SELECT 'any_label' AS label_name, symbol, ts FROM ev WHERE any_event", 0.015125, "vol * regime * liquidity * 2.0", "vol * regime * liquidity * 1.2", 1.5, 1.0), recursive=True))
def l20_quick_label_all(s, d):
    return _summed(L.quick_label_all_events(events(s, d)))


FR = (q.TICKS, q.BARS, q.FRAME)


def _each(expr: str, tail: str = "FROM fr") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {expr.replace('#', c)} {tail}" for c in FEATURES)


@query(q.with_(f"SELECT symbol, {t_}, " + ", ".join(f"round(coalesce(last_value({c} IGNORE NULLS) OVER ({q.W} ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER ({q.W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS {c}" for c in ("f1", "f2")) + f" FROM (SELECT symbol, ts, {q.change()} AS f1, {q.change(20)} AS f2 FROM bars)", q.TICKS, q.BARS))
def f3_fill(s, d):
    c = F.col("close")
    df = bars(s, d).select("symbol", "ts", change(c).alias("f1"), change(c, 20).alias("f2"))
    return S.fill(df, ["f1", "f2"]).select("symbol", T(), r6("f1"), r6("f2"))


@query(q.with_(_each("round(var_samp(#), 6) AS variance, coalesce(var_samp(#), 0) = 0 AS constant"), *FR))
def f4_variances(s, d):
    return S.variances(frame(s, d), FEATURES).select("feature", r6("variance"), "constant")


_pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query(q.with_(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM fr" for a, b in _pairs), *FR))
def f5_correlations(s, d):
    return S.correlations(frame(s, d), FEATURES).select("a", "b", r6("r"))


TWINS = "fx AS (SELECT *, f1 * 2 + f4 * 1e-9 AS f5, f2 * -1 + 0.2 * fwd AS f6, f2 + fwd AS f7 FROM fr)"
FEATURES7 = [*FEATURES, "f5", "f6", "f7"]


def _twins(s, d) -> DataFrame:
    """The frame with columns that correlate with others."""
    return frame(s, d).withColumn("f5", F.col("f1") * 2 + F.col("f4") * 1e-9).withColumn("f6", F.col("f2") * -1 + 0.2 * F.col("fwd")).withColumn("f7", F.col("f2") + F.col("fwd"))


_order7 = [(a, b) for i, a in enumerate(FEATURES7) for b in FEATURES7[i + 1 :]]
_PAIRS7 = "pc AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS ia, corr({a}, {b}) AS r FROM src" for i, a in enumerate(FEATURES7) for b in FEATURES7[i + 1 :]) + ")"


@query(q.with_("SELECT DISTINCT b AS feature FROM pc WHERE abs(r) > 0.95", *FR, TWINS, "src AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ts, symbol) AS rn, count(*) OVER () AS nn FROM fx) WHERE rn <= floor(nn * 0.5))", _PAIRS7))
def f5_correlated(s, d):
    return S.correlated(_twins(s, d), FEATURES7)


@query(q.with_("SELECT DISTINCT feature FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY t DESC, place) AS n FROM gr JOIN tg USING (feature)) WHERE n > 1", *FR, TWINS, "src AS (SELECT * FROM fx)", _PAIRS7,
    "tg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(abs(corr({c}, y)), 0) AS t FROM src" for c in FEATURES7) + ")",
    "gr AS (SELECT b AS head, a AS feature, ia AS place FROM pc WHERE abs(r) > 0.95 UNION SELECT b, b, -1 FROM pc WHERE abs(r) > 0.95)"))
def f6_correlated_worse(s, d):
    return S.correlated_worse(_twins(s, d), FEATURES7)


@query(q.with_("SELECT feature FROM (SELECT feature, count(*) OVER () AS n FROM sh WHERE share > 0.01) WHERE n < 0.9 * 4", *FR, "sh AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg((abs({c} - m) / s > 3)::INT) AS share FROM fr, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM fr)" for c in FEATURES) + ")"))
def f7_outlier_heavy(s, d):
    return S.outlier_heavy(frame(s, d), FEATURES, 0.01, 0.9)


@query(q.with_(f"SELECT symbol, {t_}, y FROM (SELECT symbol, ts, CAST(nullif(y, 1) IS NULL AS INT) AS y, volume_ok FROM (SELECT *, f4 > 2 AS volume_ok FROM fr)) WHERE volume_ok", *FR))
def f2_labelled(s, d):
    df = frame(s, d).withColumn("up_label", F.when(F.col("f4") > 2, F.col("y")))
    return S.labelled(df, "up_label").select("symbol", T(), "y")


@query(q.with_(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg((abs({c} - m) / s > 3)::INT), 6) AS share FROM fr, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM fr)" for c in FEATURES), *FR))
def f7_outlier_shares(s, d):
    return S.outlier_shares(frame(s, d), FEATURES).select("feature", r6("share"))


MI = ("lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, y, symbol, ts FROM fr" for c in FEATURES) + ")",
    "ct AS (SELECT feature, quantile_cont(x, [" + ", ".join(str(i / 8) for i in range(1, 8)) + "]) AS c FROM lg GROUP BY 1)",
    "bn AS (SELECT lg.feature, y, (c[1] < x)::INT + (c[2] < x)::INT + (c[3] < x)::INT + (c[4] < x)::INT + (c[5] < x)::INT + (c[6] < x)::INT + (c[7] < x)::INT AS bin FROM lg JOIN ct ON ct.feature = lg.feature)", "cn AS (SELECT feature, bin, y, count(*) AS n FROM bn GROUP BY 1, 2, 3)")


@query(q.with_("SELECT feature, round(sum(n / t * ln(n * t / (b * c))), 6) AS mi FROM (SELECT *, (sum(n) OVER (PARTITION BY feature))::DOUBLE AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, y) AS c FROM cn) GROUP BY 1", *FR, *MI))
def f8_mutual_information(s, d):
    return S.mutual_information(frame(s, d), FEATURES).select("feature", r6("mi"))


KNN = (
    "kc AS (SELECT *, row_number() OVER (PARTITION BY feature, y ORDER BY symbol, ts) AS i, count(*) OVER (PARTITION BY feature, y) AS c FROM lg)", "ks AS (SELECT *, least(3, c - 1) AS k FROM kc WHERE c > 1)",
    "kd AS (SELECT a.feature, a.y, a.i, any_value(a.x) AS x, any_value(a.k) AS k, any_value(a.c) AS c, min(abs(a.x - b.x), 4) AS d FROM ks a JOIN ks b ON a.feature = b.feature AND a.y = b.y GROUP BY 1, 2, 3)",
    "kr AS (SELECT *, d[k + 1] AS r FROM kd)",
    "km AS (SELECT a.feature, a.y, a.i, any_value(a.k) AS k, any_value(a.c) AS c, count(*) AS m FROM kr a JOIN ks b ON a.feature = b.feature AND CASE WHEN r = 0 THEN b.x = a.x ELSE b.x > a.x - r AND b.x < a.x + r END GROUP BY 1, 2, 3)",
    "psi AS (SELECT n, sum(CASE WHEN n = 1 THEN 0 ELSE 1.0::DOUBLE / (n - 1) END) OVER (ORDER BY n) - 0.5772156649015329 AS p FROM range(1, (SELECT max(n) + 2 FROM (SELECT count(*) AS n FROM ks GROUP BY feature))) t(n))",
)


@query(q.with_("""SELECT feature, round(greatest(0, (SELECT p FROM psi WHERE n = cnt) + s), 6) AS mi FROM (SELECT feature, count(*) AS cnt, avg(pk.p - pc.p - pm.p) AS s
 FROM km JOIN psi pk ON pk.n = k JOIN psi pc ON pc.n = c JOIN psi pm ON pm.n = m GROUP BY 1)""", *FR, MI[0], *KNN))
def f8_mutual_information_knn(s, d):
    return N.mutual_information_knn(frame(s, d), FEATURES).select("feature", r6("mi"))


@query(q.with_("SELECT feature, round((sum(n * (m - mm) * (m - mm)) / (any_value(k) - 1)) / (sum(n * v) / (any_value(nn) - any_value(k))), 4) AS f FROM (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS mm, sum(n) OVER w AS nn, count(*) OVER w AS k FROM (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM lg GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature)) GROUP BY 1", *FR, MI[0]))
def f9_anova(s, d):
    return S.anova(frame(s, d), FEATURES).select("feature", F.round("f", 4).alias("f"))


@query(q.with_(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, y)) * {w}, 6) AS r FROM fc" for c, w in (("f1", "1.2"), ("f2", "1"), ("close_gap", "1.4"))), *FR, "fc AS (SELECT *, f3 AS close_gap FROM fr)"))
def f11_target_correlation(s, d):
    df = frame(s, d).withColumnRenamed("f3", "close_gap")
    return S.target_correlation(df, ["f1", "f2", "close_gap"], ("f1",), boost=True).select("feature", r6("r"))


@query(q.with_("SELECT fold, role, count(*) AS n, epoch_ms(min(ts)) AS a, epoch_ms(max(ts)) AS b FROM (SELECT *, CASE WHEN rn <= nn - (3 - fold) * (nn // 4) THEN 'train' WHEN rn <= nn - (3 - fold) * (nn // 4) + nn // 4 THEN 'test' END AS role FROM nm, (SELECT unnest([0, 1, 2]) AS fold)) WHERE role IS NOT NULL GROUP BY 1, 2", *FR, q.NUM))
def f18_folds(s, d):
    return S.folds(frame(s, d)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.unix_millis(F.min("ts")).alias("a"), F.unix_millis(F.max("ts")).alias("b"))


PRED = "pr AS (SELECT symbol, ts, y, fwd AS ret, f2 AS score, (f2 > 0)::INT AS pred FROM fr)"


def _pred(s, d):
    return frame(s, d).select("symbol", "ts", "y", F.col("fwd").alias("ret"), F.col("f2").alias("score"), (F.col("f2") > 0).cast("int").alias("pred"))


@query(q.with_("SELECT symbol, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY symbol, score) - 1) / 2 AS rk FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY score)) GROUP BY 1", *FR, PRED))
def f20_auc(s, d):
    return S.auc(_pred(s, d), ["symbol"]).select("symbol", r6("auc"))


@query(q.with_("SELECT symbol, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM (SELECT symbol, avg((pred = y)::INT) AS a, coalesce(sum(pred * y) / nullif(sum(pred), 0), 0) AS p, coalesce(sum(pred * y) / nullif(sum(y), 0), 0) AS r FROM pr GROUP BY 1)", *FR, PRED))
def f20_confusion(s, d):
    return S.confusion(_pred(s, d), ["symbol"]).select("symbol", *[r6(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(q.with_("SELECT role, count(*) AS n, epoch_ms(min(ts)) AS a FROM (SELECT *, CASE WHEN rn <= floor(nn * 0.7) THEN 'train' ELSE 'test' END AS role FROM nm) GROUP BY 1", *FR, q.NUM))
def f22_split(s, d):
    return S.split(frame(s, d)).groupBy("role").agg(F.count("*").alias("n"), F.unix_millis(F.min("ts")).alias("a"))


@query(q.with_(f"""SELECT symbol, round(sum(g), 6) AS total, round(sum(g) / nullif(sum(pred), 0), 6) AS per_trade, sum(pred)::BIGINT AS trades, round(avg((g > 0)::INT), 6) AS win_rate_rows, round(sum((pred = 1 AND g > 0)::INT) / nullif(sum(pred), 0), 6) AS win_rate,
 round(avg(g) / nullif(stddev_samp(g), 0) * sqrt(252), 6) AS sharpe, round(sum(CASE WHEN g > 0 THEN g END) / nullif(abs(sum(CASE WHEN g < 0 THEN g END)), 0), 6) AS profit_factor, round(min(dd), 6) AS max_drawdown
 FROM (SELECT *, eq / max(eq) OVER w - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + g)) OVER w) AS eq FROM (SELECT *, pred * ret AS g FROM pr) WINDOW w AS ({q.W} ROWS UNBOUNDED PRECEDING)) WINDOW w AS ({q.W} ROWS UNBOUNDED PRECEDING)) GROUP BY 1""", *FR, PRED))
def f23_economics(s, d):
    e = S.economics(_pred(s, d))
    return e.select("symbol", r6("total"), r6("per_trade"), "trades", *[r6(c) for c in ("win_rate_rows", "win_rate", "sharpe", "profit_factor", "max_drawdown")])


MIP = ("lp AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, y, period FROM pp" for c in FEATURES) + ")",
    "cp AS (SELECT feature, period, quantile_cont(x, [" + ", ".join(str(i / 8) for i in range(1, 8)) + "]) AS c FROM lp GROUP BY 1, 2)",
    "bp AS (SELECT lp.feature, lp.period, y, (c[1] < x)::INT + (c[2] < x)::INT + (c[3] < x)::INT + (c[4] < x)::INT + (c[5] < x)::INT + (c[6] < x)::INT + (c[7] < x)::INT AS bin FROM lp JOIN cp ON cp.feature = lp.feature AND cp.period = lp.period)",
    "np AS (SELECT feature, period, bin, y, count(*) AS n FROM bp GROUP BY 1, 2, 3, 4)",
    """mp AS (SELECT feature, period, sum(n / t * ln(n * t / (b * c))) AS mi FROM (SELECT *, (sum(n) OVER (PARTITION BY feature, period))::DOUBLE AS t, sum(n) OVER (PARTITION BY feature, period, bin) AS b,
 sum(n) OVER (PARTITION BY feature, period, y) AS c FROM np) GROUP BY 1, 2)""")


@query(q.with_("SELECT feature, round(1 - stddev_pop(mi) / (avg(mi) + 1e-8), 6) AS stability, round(avg(mi), 6) AS mean_mi FROM mp GROUP BY 1", *FR, q.NUM, "pp AS (SELECT *, least((rn - 1) // (nn // 4), 3) AS period FROM nm)", *MIP))
def f25_stability(s, d):
    return S.stability(frame(s, d), FEATURES).select("feature", r6("stability"), r6("mean_mi"))


MI_SQL = "SELECT feature, sum(n / t * ln(n * t / (b * c))) AS s FROM (SELECT *, (sum(n) OVER (PARTITION BY feature))::DOUBLE AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, y) AS c FROM cn) GROUP BY 1"
ANOVA_SQL = "SELECT feature, (sum(n * (m - mm) * (m - mm)) / (any_value(k) - 1)) / (sum(n * v) / (any_value(nn) - any_value(k))) AS s FROM (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS mm, sum(n) OVER w AS nn, count(*) OVER w AS k FROM (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM lg GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature)) GROUP BY 1"


@query(q.with_("SELECT feature, round(s / max(s) OVER (), 5) AS score FROM (SELECT feature, sum(s) AS s FROM (SELECT feature, s / max(s) OVER (PARTITION BY m) AS s FROM (SELECT 'a' AS m, * FROM mi1 UNION ALL SELECT 'b', * FROM an1)) GROUP BY 1) ORDER BY s DESC, feature LIMIT 3",
    *FR, *MI, f"mi1 AS ({MI_SQL})", f"an1 AS ({ANOVA_SQL})"))
def f12_f13_combined_top(s, d):
    df = frame(s, d)
    a = S.mutual_information(df, FEATURES).select(F.lit("mi").alias("method"), "feature", F.col("mi").alias("score"))
    b = S.anova(df, FEATURES).select(F.lit("anova").alias("method"), "feature", F.col("f").alias("score"))
    return S.top_features(S.combine(a.union(b)), 3).select("feature", F.round("score", 5).alias("score"))


@query()
def f10_importances(s, d):
    return M.importances(frame(s, d), FEATURES)


@query()
def f14_genetic_selection(s, d):
    chosen = M.genetic_selection(_framed(s, d), FEATURES, "lda", 2, population=6, generations=2, least=2)
    return s.createDataFrame([(c,) for c in chosen], "feature string")


@query()
def f19_f21_model_zoo(s, d):
    return S.rank_models(M.cross_validate(frame(s, d), FEATURES, [*M.ZOO, *M.CLOSED], 3))


def _knn_parts() -> str:
    scaled = ", ".join(f"(SELECT avg({c}) FROM tr) AS m_{c}, (SELECT stddev_samp({c}) FROM tr) AS s_{c}" for c in FEATURES)
    far = " + ".join(f"power((a.{c} - b.{c}) / s_{c}, 2)" for c in FEATURES)
    return q.with_(f"""SELECT symbol, epoch_ms(ts) AS t, round(list_sum(list_transform(near, lambda v: v.y)) / 7.0, 6) AS score, pred FROM
 (SELECT symbol, ts, near, CAST(list_sum(list_transform(near, lambda v: v.y)) > 3 AS INT) AS pred FROM (SELECT a.symbol, a.ts, arg_min({{'y': b.y}}, {far}, 7) AS near FROM te a, tr b, sc GROUP BY 1, 2))""",
        *FR, q.NUM, "tr AS (SELECT * FROM nm WHERE rn <= floor(nn * 0.7))", "te AS (SELECT * FROM nm WHERE rn > floor(nn * 0.7))", f"sc AS (SELECT {scaled})")


@query(_knn_parts())
def f19_knn(s, d):
    rows = S.split(frame(s, d), 0.7)
    out = M.knn(rows.where("role = 'train'"), rows.where("role = 'test'"), FEATURES)
    return out.select("symbol", T(), r6("score"), "pred")


@query()
def f19_own_models(s, d):
    return S.rank_models(M.cross_validate(frame(s, d), FEATURES, list(M.OWN), 2))


def _framed(s, d) -> DataFrame:
    return frame(s, d).withColumn("ret", F.col("fwd"))


@query()
def f15_f17_agent_selection(s, d):
    df, r = _framed(s, d), runs(s, d)
    synergies = Y.synergies(r, 0.5)
    chosen = A.synergy_selection(df, FEATURES, synergies, 3)
    sure = A.selection_confidence(df, chosen, Y.regime_preferences(r), synergies)
    return s.createDataFrame([(A.selection_method("pattern", len(FEATURES), "CRISIS"), chosen, float(sure))], "method string, features array<string>, confidence double")


@query()
def f27_research(s, d):
    out = A.research(_framed(s, d), FEATURES, 3, ("logistic", "lda"), 2)
    return out["models"].join(out["economics"], "model")


@query()
def f29_s12_compare_sets(s, d):
    return A.compare_sets(_framed(s, d), {"price": ["f1", "f2", "f3"], "volume": ["f4"]}, ["lda", "ridge"], 3)


@query(q.with_("SELECT symbol, count(*) AS n_rows, epoch_ms(min(ts)) AS a, epoch_ms(max(ts)) AS b, arg_max(step, n * 1000000 - step) AS frequency FROM (SELECT *, count(*) OVER (PARTITION BY symbol, step) AS n FROM (SELECT symbol, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 1e6 AS step FROM bars)) GROUP BY 1", q.TICKS, q.BARS))
def f30_dataset_summary(s, d):
    return P.dataset_summary(bars(s, d)).select("symbol", "n_rows", F.unix_millis("first_ts").alias("a"), F.unix_millis("last_ts").alias("b"), "frequency")


@query(q.with_(f"""SELECT symbol, round(vol, 6) AS volatility, round(tr, 6) AS trend, CASE WHEN vol > 0.4 THEN 'CRISIS' WHEN tr > 10 AND vol <= 0.25 THEN 'RECOVERY' WHEN tr > 5 THEN CASE WHEN vol > 0.25 THEN 'BULL_HIGH_VOL' ELSE 'BULL_LOW_VOL' END
 WHEN tr < -5 THEN CASE WHEN vol > 0.25 THEN 'BEAR_HIGH_VOL' ELSE 'BEAR_LOW_VOL' END ELSE CASE WHEN vol > 0.25 THEN 'SIDEWAYS_HIGH_VOL' ELSE 'SIDEWAYS_LOW_VOL' END END AS regime
 FROM (SELECT symbol, stddev_samp(r) * sqrt(252) AS vol, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS tr FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM rets) WHERE n <= 30 GROUP BY 1)""", q.TICKS, q.BARS, q.RET))
def g1_market_regime(s, d):
    return P.market_regime(bars(s, d)).select("symbol", r6("volatility"), r6("trend"), "regime")


_prof = " UNION ALL ".join(f"SELECT '{c}' AS event, symbol, ts, {c}::INT AS hit FROM ev" for c in FLAGS)
PROFILE = (f"pf AS ({_prof})", """pg AS (SELECT event, count(*) AS n, sum(hit) AS events, avg(hit) AS frequency, sum(tr) AS tr FROM (SELECT *, (hit <> lag(hit) OVER (PARTITION BY event, symbol ORDER BY ts))::INT AS tr FROM pf) GROUP BY 1),
ph AS (SELECT event, n, events, frequency, CASE WHEN n < 10 OR events = 0 OR events = n THEN 0.5 ELSE 1 - least(tr / nullif(2 * events * (n - events) / n, 0), 1) END AS clustering FROM pg)""")


@query(q.with_("SELECT event, n, events, round(frequency, 6) AS frequency, round(clustering, 6) AS clustering, 1.0::DOUBLE AS quality FROM ph", *EV, *PROFILE, recursive=True))
def g2_g3_event_profile(s, d):
    return P.event_profile(events(s, d), FLAGS).select("event", "n", "events", r6("frequency"), r6("clustering"), "quality")


@query(q.with_("SELECT event, unnest(['BULL_HIGH_VOL', 'BULL_LOW_VOL', 'BEAR_HIGH_VOL', 'BEAR_LOW_VOL', 'SIDEWAYS_HIGH_VOL', 'SIDEWAYS_LOW_VOL', 'CRISIS', 'RECOVERY']) AS regime, 0.125::DOUBLE AS share FROM ph", *EV, *PROFILE, recursive=True))
def g4_regime_association(s, d):
    return P.regime_association(P.event_profile(events(s, d), FLAGS))


PROFILE2 = (PROFILE[0].replace(_prof, " UNION ALL ".join(f"SELECT '{c}' AS event, symbol, ts, {c}::INT AS hit FROM ev" for c in schema.EVENTS)), PROFILE[1])


@query(q.with_("""SELECT event, CASE WHEN regexp_matches(event, 'break|burst|penetration|resistance|support') THEN 'breakout' WHEN regexp_matches(event, 'revert|return|bounce|correction') THEN 'mean_reversion' WHEN regexp_matches(event, 'momentum|trend|acceleration|velocity') THEN 'momentum'
 WHEN regexp_matches(event, 'vol|volatility|variance|deviation') THEN 'volatility' WHEN regexp_matches(event, 'volume|liquidity|participation') THEN 'volume' WHEN regexp_matches(event, 'pattern|formation|signal|flag|triangle') THEN 'pattern'
 WHEN frequency < 0.05 THEN 'breakout' WHEN frequency > 0.3 THEN 'momentum' ELSE 'mean_reversion' END AS kind FROM ph""", *EV, *PROFILE2, recursive=True))
def g5_event_kind(s, d):
    return P.event_kind(P.event_profile(events(s, d), list(schema.EVENTS))).select("event", "kind")


@query(q.with_("""SELECT event, round(priority, 6) AS priority, place, round((1 + (n - place + 1) / n) / sum(1 + (n - place + 1) / n) OVER (), 6) AS time_share FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, event) AS place, count(*) OVER () AS n
 FROM (SELECT event, 0.4 * (1 - abs(frequency - 0.15)) + 0.3 + 0.3 * least(events / 100, 1) AS priority FROM ph))""", *EV, *PROFILE2, recursive=True))
def g11_strategy(s, d):
    return Y.strategy(P.event_profile(events(s, d), list(schema.EVENTS))).select("event", r6("priority"), "place", r6("time_share"))


@query(q.with_("""SELECT event, round(0.5 * CASE WHEN frequency < 0.05 THEN 0.8 WHEN frequency > 0.4 THEN 0.9 ELSE 1 END, 6) AS confidence FROM ph""", *EV, *PROFILE2, recursive=True))
def g12_reasoning(s, d):
    rows = P.event_kind(P.event_profile(events(s, d), list(schema.EVENTS))).collect()  # one row an event
    return s.createDataFrame([(r.event, round(A.reason(r.asDict(), r.kind, "BULL_LOW_VOL")["confidence"], 6)) for r in rows], "event string, confidence double")


@query()
def g13_g16_session(s, d):
    df = _framed(s, d)
    session = A.Session(s, "CRISIS", k=2, folds=2, seconds=600.0)
    return session.run(["reversion_label"], lambda label: (df, FEATURES)).select("label", "model", "auc", "ret", "sharpe", "trades", "features")


_lag1 = lambda c: f"""SELECT '{c}' AS feature, 1 AS lag, round((count(*) - 3) * power(pr, 2) / (1 - power(pr, 2)), 4) AS f FROM (SELECT *, (ryx - ryz * rxz) / sqrt((1 - ryz * ryz) * (1 - rxz * rxz)) AS pr FROM
 (SELECT corr(y0, x1) OVER () AS ryx, corr(y0, y1) OVER () AS ryz, corr(x1, y1) OVER () AS rxz FROM (SELECT fwd AS y0, lag(fwd) OVER ({q.W}) AS y1, lag({c}) OVER ({q.W}) AS x1 FROM fr) WHERE y1 IS NOT NULL AND x1 IS NOT NULL)) GROUP BY pr"""  # noqa: E731


@query(q.with_(" UNION ALL ".join(_lag1(c) for c in FEATURES), *FR))
def k1_granger(s, d):
    """One lag: F is the partial correlation's, which SQL can give."""
    return K.granger(frame(s, d), FEATURES, "fwd", max_lag=1).select("feature", "lag", F.round("f", 4).alias("f"))


@query()
def k1_granger_lags(s, d):
    return K.granger(frame(s, d), FEATURES, "fwd", max_lag=5)


@query(q.with_("SELECT feature, round(m, 6) AS mean_r, round(st, 6) AS stability, st > 0.5 AND abs(m) > 0.05 AS structural FROM (SELECT feature, avg(r) AS m, greatest(0, 1 - stddev_pop(r)) AS st FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, part, corr({c}, y) AS r FROM pt GROUP BY 2" for c in FEATURES) + ") GROUP BY 1)", *FR, q.NUM, "pt AS (SELECT *, least((rn - 1) // (nn // 3), 2) AS part FROM nm)"))
def k2_split_stability(s, d):
    return K.split_stability(frame(s, d), FEATURES).select("feature", r6("mean_r"), r6("stability"), "structural")


_ahead = ", ".join(f"lag({c}, {k}) OVER ({q.W}) AS {c}_{k}" for c in (*FEATURES, "fwd") for k in (1, 2, 3))


@query(q.with_("SELECT feature, round(lead, 6) AS lead, round(lag, 6) AS lag, lead > lag AND lead > 0.05 AS ordered FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, greatest({', '.join(f'corr({c}_{k}, fwd)' for k in (1, 2, 3))}) AS lead, greatest({', '.join(f'abs(corr({c}, fwd_{k}))' for k in (1, 2, 3))}) AS lag FROM lg3" for c in FEATURES) + ")", *FR, f"lg3 AS (SELECT *, {_ahead} FROM fr)"))
def k3_temporal_order(s, d):
    return K.temporal(frame(s, d), FEATURES, "fwd", 3).select("feature", r6("lead"), r6("lag"), "ordered")


@query(q.with_(" UNION ALL ".join(f"SELECT {k} AS shift, round(corr({'lag' if k >= 0 else 'lead'}_{abs(k)}, fwd), 6) AS r FROM lg2" for k in range(-3, 4)), *FR,
    "lg2 AS (SELECT *, " + ", ".join(f"{'lag' if k >= 0 else 'lead'}(f1, {abs(k)}) OVER ({q.W}) AS {'lag' if k >= 0 else 'lead'}_{abs(k)}" for k in range(-3, 4)) + " FROM fr)"))
def k3_lead_lag(s, d):
    return K.lead_lag(frame(s, d), "f1", "fwd", 3).select("shift", r6("r"))


RG = ("rg0 AS (SELECT *, " + q.full("stddev_samp(r)", "r", 20) + " AS sd, " + q.full("avg(r)", "r", 20) + " AS mu FROM rets)",
    f"rg1 AS (SELECT *, lag(sd) OVER ({q.W}) AS s1, lag(mu) OVER ({q.W}) AS m1, CASE WHEN count(sd) OVER {q.rows(21, 1)} = 21 THEN quantile_cont(sd, 0.7) OVER {q.rows(21, 1)} END AS bd FROM rg0)",
    "rg AS (SELECT *, CASE WHEN bd IS NULL THEN 'SIDEWAYS_LOW_VOL' ELSE CASE WHEN m1 > 0 THEN 'BULL' ELSE 'BEAR' END || CASE WHEN s1 > bd THEN '_HIGH_VOL' ELSE '_LOW_VOL' END END AS regime_name FROM rg1)")


@query(q.with_(f"SELECT symbol, {t_}, regime_name FROM rg", q.TICKS, q.BARS, q.RET, *RG))
def k4_regimes(s, d):
    return K.regimes(bars(s, d)).select("symbol", T(), "regime_name")


@query(q.with_("SELECT regime_name, count(*) AS n, round(corr(close, volume), 6) AS r, count(*) >= 20 AND coalesce(abs(corr(close, volume)) > 0.05, false) AS stable FROM rg GROUP BY 1", q.TICKS, q.BARS, q.RET, *RG))
def k5_regime_stability(s, d):
    return K.regime_stability(K.regimes(bars(s, d)), "close", "volume").select("regime_name", "n", r6("r"), "stable")


@query(q.with_("SELECT symbol, count(*) AS rows, round(any_value(bound), 6) AS bound, sum((dd > bound)::INT)::BIGINT AS n_breaks, round(greatest(0, 1 - coalesce(sum((dd > bound)::INT), 0) / nullif(count(c), 0)), 6) AS stability, sum((dd > bound)::INT) > 0.15 * count(*) AS has_breaks FROM (SELECT *, quantile_cont(dd, 0.9) OVER (PARTITION BY symbol) AS bound FROM dd) GROUP BY 1",
    q.TICKS, q.BARS, f"dd AS (SELECT *, abs(c - lag(c) OVER ({q.W})) AS dd FROM (SELECT *, CASE WHEN count(close) OVER {q.rows(30)} = 30 THEN covar_pop(close, volume) OVER {q.rows(30)} / nullif(stddev_pop(close) OVER {q.rows(30)} * stddev_pop(volume) OVER {q.rows(30)}, 0) END AS c FROM bars))"))
def k6_breaks(s, d):
    return K.breaks(bars(s, d), "close", "volume").select("symbol", "rows", r6("bound"), "n_breaks", r6("stability"), "has_breaks")


RUN = ("rx AS (" + " UNION ALL ".join(f"SELECT symbol, ts, y, fwd, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, {i} AS nf FROM fr" for i, c in enumerate(FEATURES)) + ")",
    "rp AS (SELECT *, epoch_us(date_trunc('day', ts)) // 86400000000 AS day, x > avg(x) OVER (PARTITION BY symbol, feature, date_trunc('day', ts)) AS pred FROM rx)",
    "rr AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY symbol, feature, day, x) - 1) / 2 AS rk, CASE WHEN pred THEN fwd ELSE 0 END AS g FROM rp WINDOW w AS (PARTITION BY symbol, feature, day ORDER BY x))",
    """rg AS (SELECT day * 1000 + CAST(substr(symbol, 2) AS BIGINT) * 10 + any_value(nf) AS run_id, symbol AS label, CASE WHEN avg(fwd) > 0 THEN 'BULL' ELSE 'BEAR' END AS regime, 'by_' || feature AS model, feature, day,
 (sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc, coalesce(sum(pred::INT * y) / nullif(sum(pred::INT), 0), 0) AS precision, coalesce(sum(pred::INT * y) / nullif(sum(y), 0), 0) AS recall,
 sum(g) AS ret, coalesce(avg(g) / nullif(stddev_samp(g), 0) * sqrt(252), 0) AS sharpe, coalesce(sum((pred AND fwd > 0)::INT) / nullif(sum(pred::INT), 0), 0) AS win_rate, sum(pred::INT)::BIGINT AS trades, avg(x) AS mx FROM rr GROUP BY symbol, feature, day)""",
    """runs AS (SELECT run_id, label, regime, model, auc, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, precision, ret, sharpe, win_rate, trades, list_distinct(list_concat([feature], coalesce(fs, []))) AS features
 FROM rg LEFT JOIN (SELECT label, day, list(feature ORDER BY feature) AS fs FROM rg WHERE mx > 0 GROUP BY 1, 2) USING (label, day) WHERE auc IS NOT NULL)""")
SQL_RUNS = (*FR, *RUN)


def runs(s: SparkSession, d: str) -> DataFrame:
    """A research run for each symbol, day and feature: the rows above the day's mean are called; metrics are the calls'."""
    rows = S.long(frame(s, d), FEATURES, ("symbol", "ts", "y", "fwd")).withColumn("day", F.unix_date(F.to_date("ts")).cast("long"))
    by = ["symbol", "feature", "day"]
    rows = rows.withColumn("pred", F.col("x") > F.avg("x").over(Window.partitionBy(*by))).withColumn("g", F.when(F.col("pred"), F.col("fwd")).otherwise(0.0))
    p = F.col("pred").cast("int")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), F.lit(0.0))
    g = rows.groupBy(*by).agg(
        F.when(F.avg("fwd") > 0, "BULL").otherwise("BEAR").alias("regime"), ratio(p * F.col("y"), p).alias("precision"), ratio(p * F.col("y"), F.col("y")).alias("recall"), F.sum("g").alias("ret"),
        F.coalesce(F.try_divide(F.avg("g"), F.nullif(F.stddev_samp("g"), F.lit(0.0))) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"), ratio((F.col("pred") & (F.col("fwd") > 0)).cast("int"), p).alias("win_rate"), F.sum(p).alias("trades"), F.avg("x").alias("mx"),
    )
    used = g.where("mx > 0").groupBy("symbol", "day").agg(F.array_sort(F.collect_list("feature")).alias("fs"))
    g = g.join(S.auc(rows, by, "x"), by).where("auc is not null").join(used, ["symbol", "day"], "left")
    number = F.create_map(*[F.lit(x) for i, c in enumerate(FEATURES) for x in (c, i)])[F.col("feature")]
    return g.select(
        (F.col("day") * 1000 + F.substring("symbol", 2, 9).cast("long") * 10 + number).alias("run_id"), F.col("symbol").alias("label"), "regime", F.concat(F.lit("by_"), "feature").alias("model"), "auc",
        F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"), "precision", "ret", "sharpe", "win_rate", "trades",
        F.array_distinct(F.concat(F.array("feature"), F.coalesce("fs", F.array().cast("array<string>")))).alias("features"),
    )


WIN = "auc >= 0.55 AND ret >= 0.02 AND sharpe >= 0.5 AND win_rate >= 0.52"


@query(q.with_(f"SELECT run_id, {WIN} AS success FROM runs", *SQL_RUNS))
def g6_learn(s, d):
    return Y.learn(runs(s, d)).select("run_id", "success")


@query(q.with_("SELECT a.f AS a, b.f AS b, count(*) AS n, round(avg(a.auc), 6) AS mean_auc FROM g a JOIN g b ON a.run_id = b.run_id AND a.f < b.f GROUP BY 1, 2 HAVING count(*) > 2", *SQL_RUNS, "g AS (SELECT DISTINCT run_id, auc, unnest(features) AS f FROM runs WHERE auc > 0.6)"))
def g7_synergies(s, d):
    return Y.synergies(runs(s, d)).select("a", "b", "n", r6("mean_auc"))


@query(q.with_("SELECT model, round(sum(w * auc) / sum(w), 6) AS score FROM (SELECT *, exp((count(*) OVER (PARTITION BY model) - age) / (count(*) OVER (PARTITION BY model) - 1)) AS w FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY run_id DESC) AS age FROM runs) WHERE age <= 30) GROUP BY 1", *SQL_RUNS))
def g8_model_scores(s, d):
    return Y.model_scores(runs(s, d), 30).select("model", r6("score"))


@query(q.with_(f"SELECT regime, feature, n, place FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY n DESC, feature) AS place FROM (SELECT regime, feature, count(*) AS n FROM (SELECT regime, unnest(features) AS feature FROM runs WHERE {WIN}) GROUP BY 1, 2)) WHERE place <= 3", *SQL_RUNS))
def g9_preferred_features(s, d):
    return Y.preferred_features(runs(s, d)).select("regime", "feature", "n", "place")


@query(q.with_(f"SELECT DISTINCT label, model FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.label = r.label AND x.model = r.model AND NOT ({WIN}) AND x.regime = 'BEAR')", *SQL_RUNS))
def g10_untried(s, d):
    return Y.untried(runs(s, d).select("label", "model").distinct(), runs(s, d).where("regime = 'BEAR'"))


@query(q.with_("SELECT label, run_id, model, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, run_id) AS p FROM (SELECT *, (0.3 * auc + 0.4 * (ret + 1) + 0.2 * (sharpe + 1) + 0.1 * win_rate) * least(1.0, trades / 10) AS score FROM runs)) WHERE p = 1", *SQL_RUNS))
def g14_best_models(s, d):
    return Y.best_models(runs(s, d)).select("label", "run_id", "model", r6("score"))


@query(q.with_("SELECT model, count(*) AS n, round(avg(auc), 6) AS mean_auc, round(stddev_samp(auc), 6) AS std_auc, round(avg(ret), 6) AS mean_ret, round(avg(0.3 * ret + 0.25 * sharpe + 0.25 * win_rate + 0.2 * auc), 6) AS economic, arg_max(label, auc * 1000000000000 + run_id) AS best_label FROM runs GROUP BY 1", *SQL_RUNS))
def g17_compare(s, d):
    return Y.compare(runs(s, d)).select("model", "n", r6("mean_auc"), r6("std_auc"), r6("mean_ret"), r6("economic"), "best_label")


@query(q.with_("SELECT feature, count(*) AS n FROM (SELECT unnest(features) AS feature FROM runs) GROUP BY 1 ORDER BY n DESC, feature LIMIT 5", *SQL_RUNS))
def f28_common_features(s, d):
    return Y.common_features(runs(s, d), 5)


@query(q.with_("SELECT run_id, round(0.5 * auc + 0.3 * f1 + 0.2 * precision, 6) AS score FROM runs", *SQL_RUNS))
def f26_rank_models(s, d):
    return S.rank_models(runs(s, d)).select("run_id", r6("score"))


@query(q.with_(f"SELECT regime, feature, count(*) * 0.1 AS preference FROM (SELECT regime, unnest(features) AS feature FROM runs WHERE {WIN}) GROUP BY 1, 2", *SQL_RUNS))
def g6_regime_preferences(s, d):
    return Y.regime_preferences(runs(s, d)).select("regime", "feature", r6("preference"))


@query()
def g15_recommendations(s, d):
    return s.createDataFrame([(i, t) for i, t in enumerate(A.recommendations(runs(s, d), "BULL_LOW_VOL"))], "place int, text string")


TESTED = (*SQL_RUNS, "ts_ AS (SELECT run_id, label AS event, CASE model WHEN 'by_f1' THEN 'returns' WHEN 'by_f2' THEN 'price_momentum' WHEN 'by_f3' THEN 'price_deviation' ELSE 'volume' END AS feature, greatest(0, 2 * (auc - 0.5)) AS strength, auc > 0.6 AS causal, trades % 3 AS lag, f1 > 0.6 AS structural, ret AS total FROM runs)")


def _tested(s, d) -> DataFrame:
    """Runs as tests of relationships between a feature and a symbol's returns."""
    name = F.when(F.col("model") == "by_f1", "returns").when(F.col("model") == "by_f2", "price_momentum").when(F.col("model") == "by_f3", "price_deviation").otherwise("volume")
    return runs(s, d).select("run_id", F.col("label").alias("event"), name.alias("feature"), F.greatest(F.lit(0.0), 2 * (F.col("auc") - 0.5)).alias("strength"), (F.col("auc") > 0.6).alias("causal"), (F.col("trades") % 3).alias("lag"), (F.col("f1") > 0.6).alias("structural"), F.col("ret").alias("total"))


MECH = "CASE WHEN feature = 'volume' THEN CASE WHEN lag <= 1 THEN 'order_flow_impact' ELSE 'information_asymmetry' END WHEN feature IN ('returns', 'price_momentum') THEN 'mean_reversion' ELSE 'information_asymmetry' END"


@query(q.with_(f"SELECT run_id, CASE WHEN causal THEN CASE WHEN lag <= 1 THEN 'information_flow' ELSE 'granger_causal' END WHEN structural THEN 'structural_causal' ELSE 'granger_causal' END AS relationship, {MECH} AS mechanism FROM ts_", *TESTED))
def k11_relationship(s, d):
    r = K.relationship(_tested(s, d)).withColumn("mechanism", D.mechanism_of(F.col("feature"), F.col("event"), F.col("lag")))
    return r.select("run_id", "relationship", "mechanism")


@query(q.with_("""SELECT run_id, event, true AS plausible, round(CASE WHEN feature = 'price_deviation' THEN 0.5 WHEN event = 'price' AND feature = 'volume' THEN CASE WHEN strength < 0.16 THEN 0.2 ELSE least(1, strength / 0.8) END
 WHEN event = 'price' AND feature IN ('returns', 'price_momentum') THEN 0.3 WHEN event = 'returns' AND feature IN ('returns', 'price_momentum') THEN CASE WHEN strength < 0.08 THEN 0.2 ELSE least(1, strength / 0.4) END
 ELSE 0.3 END, 6) AS confidence FROM (SELECT run_id, feature, strength, CASE WHEN run_id % 2 = 0 THEN 'price' ELSE 'returns' END AS event FROM ts_)""", *TESTED))
def k7_plausibility(s, d):
    rows = _tested(s, d).withColumn("event", F.when(F.col("run_id") % 2 == 0, "price").otherwise("returns"))
    return D.plausibility(rows, ["returns", "price_momentum", "price_deviation", "volume"], ["price", "returns"]).select("run_id", "event", "plausible", r6("confidence"))


KNOWN = (*TESTED, f"kn AS (SELECT event, feature, {MECH} AS mechanism, strength, total FROM ts_ WHERE total > -0.05)")


def _known(s, d) -> DataFrame:
    t = _tested(s, d).withColumn("mechanism", D.mechanism_of(F.col("feature"), F.col("event"), F.col("lag")))
    return t.where("total > -0.05").select("event", "feature", "mechanism", "strength", "total")


@query(q.with_("SELECT event, n, dominant, round(ts2, 6) AS total_strength, round(mr, 6) AS mean_return, round(least(1, ts2 / n), 6) AS confidence FROM (SELECT event, sum(c)::BIGINT AS n, arg_max(mechanism, c * 1000 + ascii(mechanism)) AS dominant, sum(st) AS ts2, sum(tt) / sum(c) AS mr FROM (SELECT event, mechanism, count(*) AS c, sum(strength) AS st, sum(total) AS tt FROM kn GROUP BY 1, 2) GROUP BY 1)", *KNOWN))
def k18_insight(s, d):
    return D.insight(_known(s, d)).select("event", "n", "dominant", r6("total_strength"), r6("mean_return"), r6("confidence"))


@query(q.with_("SELECT mechanism, round(avg(total), 6) AS mean_return, count(*) AS n FROM kn WHERE event = 'S1' AND strength >= 0.3 GROUP BY 1", *KNOWN))
def k18_recall(s, d):
    return D.preferred_mechanisms(D.recall_knowledge(_known(s, d), "S1")).select("mechanism", r6("mean_return"), "n")


@query(q.with_("SELECT DISTINCT t.feature, t.event FROM ts_ t WHERE NOT EXISTS (SELECT 1 FROM ts_ x WHERE x.feature = t.feature AND x.event = t.event AND x.total < -0.2)", *TESTED))
def k19_untested(s, d):
    t = _tested(s, d)
    return D.untested(t.select("feature", "event").distinct(), t.where("total < -0.2"))


_AN = "count(*) AS n, round(avg(strength), 6) AS mean_strength, round(avg(total), 6) AS mean_return, sum((total > 0.01)::INT)::BIGINT AS profitable FROM kn"


@query(q.with_(f"SELECT 'all' AS kind, 'all' AS name, {_AN} UNION ALL (SELECT 'mechanism', mechanism, {_AN} GROUP BY 2 ORDER BY count(*) DESC, mechanism LIMIT 5) UNION ALL (SELECT 'feature', feature, {_AN} GROUP BY 2 ORDER BY count(*) DESC, feature LIMIT 10)", *KNOWN))
def k20_analysis(s, d):
    return D.analysis(_known(s, d)).select("kind", "name", "n", r6("mean_strength"), r6("mean_return"), "profitable")


@query(q.with_(f"SELECT symbol, {t_}, f1, y FROM (SELECT symbol, ts, round(coalesce(last_value(f1 IGNORE NULLS) OVER ({q.W} ROWS UNBOUNDED PRECEDING), first_value(f1 IGNORE NULLS) OVER ({q.W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS f1, y FROM (SELECT symbol, ts, {q.change()} AS f1, CAST(lead(close, 4) OVER ({q.W}) > close AS INT) AS y FROM bars)) WHERE f1 IS NOT NULL AND y IS NOT NULL", q.TICKS, q.BARS))
def k17_clean(s, d):
    c = F.col("close")
    df = bars(s, d).select("symbol", "ts", change(c).alias("f1"), (F.lead(c, 4).over(over()) > c).cast("int").alias("y"))
    return K.clean(df, ["f1"], ["f1", "y"]).select("symbol", T(), r6("f1"), "y")


@query(q.with_(" UNION ALL ".join(f"SELECT '{c}' AS label, count({c}) AS n, sum({c})::BIGINT AS positive, round(avg({c}), 6) AS rate, round(count({c}) / count(*), 6) AS completeness FROM lf" for c in ("up_label", "busy_label")), *FR, "lf AS (SELECT y AS up_label, CASE WHEN f4 > 2 THEN y END AS busy_label FROM fr)"))
def k24_label_stats(s, d):
    df = frame(s, d).select(F.col("y").alias("up_label"), F.when(F.col("f4") > 2, F.col("y")).alias("busy_label"))
    return K.label_statistics(df, ["up_label", "busy_label"]).select("label", "n", "positive", r6("rate"), r6("completeness"))


@query()
def k9_k10_discover(s, d):
    return D.discover(frame(s, d), FEATURES, "fwd", 2)


_PAIRS = [("f1", "f3"), ("f3", "f4")]


def _pair(a: str, b: str) -> str:
    """F of two columns' lags beside the target's own, by taking one after the other out of what is left."""
    def rest(x: str, on: str) -> str:
        return f"{x} - avg({x}) OVER () - regr_slope({x}, {on}) OVER () * ({on} - avg({on}) OVER ()) AS {x}"

    return f"""SELECT '{a}+{b}' AS combination, round((sum(r0 * r0) - sum(y * y)) / 2 / (sum(y * y) / (count(*) - 4)), 3) AS f FROM (SELECT r0, {rest('y', 'b')} FROM (SELECT r0, {rest('y', 'a')}, {rest('b', 'a')} FROM
 (SELECT {rest('y', 'o')}, {rest('a', 'o')}, {rest('b', 'o')}, y - avg(y) OVER () - regr_slope(y, o) OVER () * (o - avg(o) OVER ()) AS r0 FROM
 (SELECT f2 AS y, lag(f2) OVER ({q.W}) AS o, lag({a}) OVER ({q.W}) AS a, lag({b}) OVER ({q.W}) AS b FROM fr) WHERE o IS NOT NULL)))"""


@query(q.with_(" UNION ALL ".join(_pair(*p) for p in _PAIRS), *FR))
def k13_multivariate(s, d):
    df = frame(s, d)
    return s.createDataFrame([("+".join(p), D.multivariate(df, p, "f2")[0]) for p in _PAIRS], "combination string, f double").select("combination", F.round("f", 3).alias("f"))


def _momentum(s, d) -> DataFrame:
    """The frame with the sign of the six-bar return as the class, which the longer deviation tells something of."""
    return frame(s, d).withColumn("y", (F.col("f2") > 0).cast("int"))


@query()
def k12_k15_combinations(s, d):
    df = _momentum(s, d)
    groups = [g for g in D.combinations_of(["f1", "f3", "f4"], 2, 2) if len(g) == 2]
    return D.best_approach(D.discover(df, ["f1", "f3", "f4"], "f2", 1), D.discover_combinations(df, groups, "lda", 2))


@query()
def k14_combination_power(s, d):
    groups = [g for g in D.combinations_of(["f1", "f3", "f4"], 2, 2) if len(g) == 2]
    return D.discover_combinations(_momentum(s, d), groups, "lda", 2)


@query()
def k16_economic_validation(s, d):
    return D.economic_validation(_framed(s, d), ["f1", "f2"])


@query()
def k21_k22_investigation(s, d):
    df = _framed(s, d)
    return D.quick(s, ["momentum_event"], lambda event: (df, FEATURES))["known"]


@query()
def k23_out_of_sample(s, d):
    return D.out_of_sample(frame(s, d), ["f1", "f2"], "2024-01-20", "fwd", 1)


@query(q.with_("SELECT run_id, label, model, round(auc, 6) AS auc, trades FROM runs WHERE label <> 'S0'", *SQL_RUNS))
def s8_saved_runs(s, d):
    """Two sessions' runs, saved and read again but for one label's."""
    path, rows = folder(s), runs(s, d)
    V.save_runs(rows.where("regime = 'BULL'"), path)
    V.save_runs(rows.where("regime <> 'BULL'"), path)
    return V.load_runs(s, path, [f"S{i}" for i in range(1, 8)]).select("run_id", "label", "model", r6("auc"), "trades")


@query(q.with_("SELECT label AS event, model AS feature, round(arg_max(ret, run_id), 6) AS total FROM runs WHERE run_id % 1000 // 10 < 4 GROUP BY 1, 2", *SQL_RUNS))
def k18_saved_knowledge(s, d):
    """Each feature's last run is kept twice; the later session's word stands."""
    w = Window.partitionBy("label", "model").orderBy(F.desc("run_id"))
    last = runs(s, d).where("run_id % 1000 div 10 < 4").withColumn("n", F.row_number().over(w)).where("n = 1")
    known = last.select(F.col("label").alias("event"), F.col("model").alias("feature"), F.lit("m").alias("mechanism"), F.col("auc").alias("strength"), F.col("ret").alias("total"))
    path = folder(s)
    V.save_knowledge(known.withColumn("total", F.col("total") - 1), path)
    V.save_knowledge(known, path)
    return V.load_knowledge(s, path, ["S0", "S1", "S2", "S3"]).select("event", "feature", r6("total"))


@query()
def f29_pipeline(s, d):
    df = _framed(s, d)
    out = V.research_pipeline(s, ["up_label"], lambda label: (df, FEATURES), folder(s), {"models": ("lda", "ridge"), "folds": 2, "quick": True})
    return out["results"].select("label", "rank", "model", "auc", "score", "ret", "trades")
