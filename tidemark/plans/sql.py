"""Fragments of the oracle SQL: shared CTEs and window expressions."""

from __future__ import annotations

TICKS = """ticks AS (SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, ts, event_id AS seq,
 (5000000 + SUM(CAST(ROUND(value * 100) AS BIGINT) - 5000) OVER (PARTITION BY user_id % 8 ORDER BY event_id)) / CAST(100.0 AS DOUBLE) AS price,
 CAST(1 + event_id % 10 AS DOUBLE) AS qty FROM events)"""
BARS = """bars AS (SELECT symbol, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS ts, arg_min(price, seq) AS open, max(price) AS high,
 min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2)"""
H4 = """h4 AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR AS ts, arg_min(price, seq) AS open, max(price) AS high,
 min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2)"""
ASOF = """ctx AS (SELECT b.*, h.ts AS h_ts, h.open AS h_open, h.high AS h_high, h.low AS h_low, h.close AS h_close, h.volume AS h_volume
 FROM bars b ASOF LEFT JOIN h4 h ON b.symbol = h.symbol AND b.ts > h.ts)"""
RET = "rets AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars)"
W = "PARTITION BY symbol ORDER BY ts"


def with_(body: str, *ctes: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(ctes) + "\n" + body


def rows(n: int, skip: int = 0) -> str:
    end = "CURRENT ROW" if not skip else f"{skip} PRECEDING"
    return f"({W} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {end})"


def full(agg: str, x: str, n: int, skip: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n, skip)} = {n} THEN {agg} OVER {rows(n, skip)} END"


def change(k: int = 1, x: str = "close") -> str:
    return f"({x} / lag({x}, {k}) OVER ({W}) - 1)"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


BB = f"""bb AS (SELECT *, {full('avg(close)', 'close', 20)} AS mid, {full('stddev_pop(close)', 'close', 20)} AS dev FROM bars),
bb2 AS (SELECT *, mid + 2 * dev AS up, mid - 2 * dev AS lo, close - mid AS dist, (4 * dev) / mid * 100 AS w FROM bb)"""


def held(cond: str, n: int) -> str:
    return f"coalesce(min(CAST({cond} AS INT)) OVER {rows(n, 1)} = 1 AND count(CAST({cond} AS INT)) OVER {rows(n, 1)} = {n}, false)"


BAND = f"""band0 AS (SELECT *, {held('close < up', 3)} AS was_low, {held('close > lo', 3)} AS was_high, lag(dist) OVER ({W}) AS pd,
 {full('avg(w)', 'w', 20)} AS wm, {full('stddev_samp(w)', 'w', 20)} AS ws FROM bb2),
band AS (SELECT *, coalesce(was_low AND close > up AND (close / up - 1) * 100 > 0.1, false) AS bb_upper_cross,
 coalesce(was_high AND close < lo AND (1 - close / lo) * 100 > 0.1, false) AS bb_lower_cross, coalesce(pd <= 0 AND dist > 0, false) AS bb_middle_up,
 coalesce(pd >= 0 AND dist < 0, false) AND NOT coalesce(pd <= 0 AND dist > 0, false) AS bb_middle_down,
 coalesce(w < wm - ws, false) AS bb_squeeze, coalesce(w > wm + ws, false) AS bb_expansion FROM band0),
band2 AS (SELECT *, bb_upper_cross OR bb_lower_cross OR bb_middle_up OR bb_middle_down AS bb_any_cross FROM band)"""

NUMBERED = f"nb AS (SELECT *, row_number() OVER ({W}) AS rn FROM bars)"


def ema_cte(name: str, src: str, x: str, alpha: str) -> str:
    """y of the affine recurrence over rows numbered rn from 1."""
    return f"""{name} AS (SELECT symbol, rn, CAST({x} AS DOUBLE) AS y FROM {src} WHERE rn = 1
 UNION ALL SELECT s.symbol, s.rn, {alpha} * s.{x} + (1 - {alpha}) * p.y FROM {name} p JOIN {src} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


ATR = (
    f"atr0 AS (SELECT symbol, ts, rn, close, CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (SELECT *, lag(close) OVER ({W}) AS pc FROM nb))",
    f"atr1 AS (SELECT symbol, ts, rn - 13 AS rn, close, CASE WHEN rn = 14 THEN m14 ELSE tr END AS x FROM (SELECT *, avg(tr) OVER {rows(14)} AS m14 FROM atr0) WHERE rn >= 14)",
    ema_cte("atr2", "atr1", "x", "(CAST(1 AS DOUBLE) / 14)"),
    "atrs AS (SELECT m.symbol, m.ts, a.y AS atr, a.y / m.close * 100 AS atr_pct FROM atr1 m JOIN atr2 a ON a.symbol = m.symbol AND a.rn = m.rn)",
)

STATS = f"""st0 AS (SELECT bars.*, atr_pct, {change()} AS r, {change(20)} AS mom20, {change(6)} AS mom_short, {change(16)} AS mom_medium, {change(48)} AS mom_long
 FROM bars LEFT JOIN atrs USING (symbol, ts)),
st1 AS (SELECT *, mom20 / nullif(atr_pct, 0) * 100 AS price_momentum_norm, {full('avg(volume)', 'volume', 20)} AS vm, {full('stddev_samp(volume)', 'volume', 20)} AS vs, {full('stddev_samp(r)', 'r', 20)} * sqrt(48) AS vol,
 CASE WHEN count(r) OVER {rows(100)} = 100 THEN coalesce((r - avg(r) OVER {rows(100)}) / nullif(stddev_samp(r) OVER {rows(100)}, 0), 0) END AS return_zscore,
 sign(mom_short) * sign(mom_medium) * sign(mom_long) AS sg FROM st0),
st2 AS (SELECT *, (volume - vm) / nullif(vs, 0) AS volume_zscore, (vol - ({full('avg(vol)', 'vol', 50)})) / nullif({full('stddev_samp(vol)', 'vol', 50)}, 0) AS vol_breakout_score, {full('avg(sg)', 'sg', 4)} AS momentum_score FROM st1),
st3 AS (SELECT *, CASE WHEN count(price_momentum_norm + volume_zscore) OVER {rows(20)} = 20 THEN covar_samp(price_momentum_norm, volume_zscore) OVER {rows(20)}
 / nullif(stddev_samp(price_momentum_norm) OVER {rows(20)} * stddev_samp(volume_zscore) OVER {rows(20)}, 0) END AS price_vol_corr FROM st2),
st AS (SELECT *, coalesce(abs(price_vol_corr) < 0.7, false) AND coalesce(abs(vol_breakout_score) > 2.0, false) AND (coalesce(abs(volume_zscore) > 1.5, false) OR coalesce(abs(price_momentum_norm) > 1.5, false)) AS vpd_event,
 coalesce(abs(return_zscore) > 2.5, false) AS outlier_event, coalesce(abs(momentum_score - lag(momentum_score) OVER ({W})) > 0.3, false) AS momentum_event FROM st3)"""

CUSUM = f"""cr AS (SELECT symbol, ts, row_number() OVER ({W}) - 1 AS i, coalesce({change()}, 0) AS r FROM bars),
c0 AS (SELECT symbol, i, ts, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS q, 0 AS e, CAST(0 AS DOUBLE) AS np, CAST(0 AS DOUBLE) AS nq FROM cr WHERE i = 0
 UNION ALL SELECT symbol, i, ts, p, q, e, CASE WHEN e = 1 OR i % 48 = 0 THEN 0 ELSE p END, CASE WHEN e = -1 OR i % 48 = 0 THEN 0 ELSE q END FROM
 (SELECT symbol, i, ts, p, q, CASE WHEN p > 0.005 THEN 1 WHEN q < -0.005 THEN -1 ELSE 0 END AS e FROM
  (SELECT cr.symbol, cr.i, cr.ts, greatest(0, c0.np + cr.r - 0.0005) AS p, least(0, c0.nq + cr.r + 0.0005) AS q FROM c0 JOIN cr ON cr.symbol = c0.symbol AND cr.i = c0.i + 1)))"""

BAND_FLAGS = ("bb_upper_cross", "bb_lower_cross", "bb_middle_up", "bb_middle_down", "bb_squeeze", "bb_expansion", "bb_any_cross")
ALL_EVENTS = f"""ev0 AS (SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close, b.volume, st.atr_pct, {', '.join(BAND_FLAGS)}, vpd_event, outlier_event, momentum_event, vpd_event OR outlier_event OR momentum_event AS traditional_event,
 e AS cusum_event, e <> 0 AS cusum_flag FROM band2 b JOIN st ON b.symbol = st.symbol AND b.ts = st.ts JOIN c0 ON b.symbol = c0.symbol AND b.ts = c0.ts),
ev AS (SELECT *, traditional_event OR cusum_flag OR bb_any_cross OR bb_squeeze OR bb_expansion AS any_event FROM ev0)"""

FRAME = f"""fr0 AS (SELECT symbol, ts, {change()} AS f1, {change(6)} AS f2, (close - {full('avg(close)', 'close', 20)}) / close AS f3, volume AS f4,
 lead(close, 4) OVER ({W}) / close - 1 AS fwd FROM bars),
fr AS (SELECT symbol, ts, f1, f2, f3, f4, fwd, CAST(fwd > 0 AS INT) AS y FROM fr0 WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AND fwd IS NOT NULL)"""
NUM = "nm AS (SELECT *, row_number() OVER (ORDER BY ts, symbol) AS rn, count(*) OVER () AS nn FROM fr)"
