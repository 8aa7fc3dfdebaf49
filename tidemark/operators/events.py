"""CUSUM, band and statistical events, and their confluence."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunked import in_blocks
from tidemark.operators.series import change, full, last, over, zscore


def close() -> Column:
    return F.col("close")


flag = lambda c: F.coalesce(c, F.lit(False))


def cusum(df: DataFrame, threshold: float = 0.5, drift: float = 0.05, reset: int = 48) -> DataFrame:
    """Two-sided cumulative sums of returns, in percent, with drift; both start again every `reset` rows.

    The reset makes segments independent, so each is folded on its own: at most `reset` rows, which
    carry their other columns along, so that nothing is joined back.
    """
    return _cusum(in_blocks(df, _steps, 1), threshold, drift, reset)


def _steps(df: DataFrame) -> DataFrame:
    return df.withColumn("_i", F.col("_rn") - 1).withColumn("_r", F.coalesce(change(close()), F.lit(0.0)))


def _cusum(df: DataFrame, threshold: float = 0.5, drift: float = 0.05, reset: int = 48) -> DataFrame:
    th, dr, names = threshold / 100, drift / 100, [c for c in df.columns if c not in ("_i", "_r")]
    rows = F.array_sort(F.collect_list(F.struct("_i", "_r", F.struct(*names).alias("_row"))), lambda a, b: (a["_i"] - b["_i"]).cast("int"))
    seg = df.withColumn("_seg", F.ceil(F.col("_i") / reset)).groupBy("symbol", "_seg").agg(rows.alias("_rows"))

    def step(acc: Column, x: Column) -> Column:
        start = x["_i"] == 0
        p = F.when(start, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), acc["p"] + x["_r"] - dr))
        q = F.when(start, F.lit(0.0)).otherwise(F.least(F.lit(0.0), acc["q"] + x["_r"] + dr))
        e = F.when(p > th, 1).when(q < -th, -1).otherwise(0)
        done = F.struct(p.alias("p"), q.alias("q"), e.alias("e"))
        return F.struct(F.when(e == 1, 0.0).otherwise(p).alias("p"), F.when(e == -1, 0.0).otherwise(q).alias("q"), F.concat(acc["out"], F.array(done)).alias("out"))

    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.array().cast("array<struct<p:double,q:double,e:int>>").alias("out"))
    out = seg.select("_rows", F.aggregate("_rows", zero, step, lambda a: a["out"]).alias("_out"))
    out = out.select(F.explode(F.arrays_zip("_rows", "_out")).alias("o"))
    return out.select("o._rows._row.*", F.col("o._out.p").alias("cusum_pos"), F.col("o._out.q").alias("cusum_neg"), F.col("o._out.e").alias("cusum_event"))


def band_events(df: DataFrame, lookback: int = 3, least: float = 0.1) -> DataFrame:
    """Crosses of the upper, lower and middle band, squeeze and expansion; needs the bollinger columns."""
    return in_blocks(df, lambda d: _band_events(d, lookback, least), max(lookback, 20) + 1)


def _band_events(df: DataFrame, lookback: int, least: float) -> DataFrame:
    up, lo, mid = F.col("bb_upper"), F.col("bb_lower"), F.col("bb_middle")
    w = last(lookback, 1)
    held = lambda cond: flag((F.min(cond.cast("int")).over(w) == 1) & (F.count(cond.cast("int")).over(w) == lookback))
    dist = close() - mid
    prev = F.lag(dist).over(over())
    width = F.try_divide(up - lo, mid) * 100
    mean, dev = full(F.avg("_w"), F.col("_w"), 20), full(F.stddev_samp("_w"), F.col("_w"), 20)
    df = df.withColumn("_w", width)
    df = df.select(
        "*", flag(held(close() < up) & (close() > up) & ((close() / up - 1) * 100 > least)).alias("bb_upper_cross"), flag(held(close() > lo) & (close() < lo) & ((1 - close() / lo) * 100 > least)).alias("bb_lower_cross"),
        flag((prev <= 0) & (dist > 0)).alias("bb_middle_up"), flag((prev >= 0) & (dist < 0) & ~flag((prev <= 0) & (dist > 0))).alias("bb_middle_down"),
        flag(F.col("_w") < mean - dev).alias("bb_squeeze"), flag(F.col("_w") > mean + dev).alias("bb_expansion"),
    ).drop("_w")
    return df.withColumn("bb_any_cross", F.col("bb_upper_cross") | F.col("bb_lower_cross") | F.col("bb_middle_up") | F.col("bb_middle_down"))


def statistics(df: DataFrame, lookback: int = 100, n: int = 20, long: int = 50) -> DataFrame:
    """Normalised momentum, volume and volatility z-scores, their correlation, return z-score, momenta and
    their regime score; needs atr_pct and vol_realized. No variance or no divisor gives null."""
    return in_blocks(df, lambda d: _statistics(d, lookback, n, long), max(lookback + 1, 2 * n, long, 52))


def _statistics(df: DataFrame, lookback: int, n: int, long: int) -> DataFrame:
    df = df.withColumn("_r", change(close())).withColumn("_v", F.col("volume").cast("double"))
    df = df.select("*", (F.try_divide(change(close(), n), F.nullif("atr_pct", F.lit(0.0))) * 100).alias("price_momentum_norm"), zscore(F.col("_v"), n).alias("volume_zscore"))
    pm, vz = F.col("price_momentum_norm"), F.col("volume_zscore")
    both = F.when(pm.isNotNull() & vz.isNotNull(), F.lit(1))
    w = last(n)
    spread = F.stddev_samp(pm).over(w) * F.stddev_samp(vz).over(w)
    df = df.select(
        "*", F.when(F.count(both).over(w) == n, F.try_divide(F.covar_samp(pm, vz).over(w), F.nullif(spread, F.lit(0.0)))).alias("price_vol_corr"),
        zscore(F.col("vol_realized"), long).alias("vol_breakout_score"),
        F.when(F.count("_r").over(last(lookback)) == lookback, F.coalesce(F.try_divide(F.col("_r") - F.avg("_r").over(last(lookback)), F.nullif(F.stddev_samp("_r").over(last(lookback)), F.lit(0.0))), F.lit(0.0))).alias("return_zscore"),
        change(close(), 6).alias("mom_short"), change(close(), 16).alias("mom_medium"), change(close(), 48).alias("mom_long"),
    )
    sign = F.signum("mom_short") * F.signum("mom_medium") * F.signum("mom_long")
    df = df.withColumn("_s", sign)
    return df.withColumn("momentum_score", full(F.avg("_s"), F.col("_s"), 4)).drop("_r", "_v", "_s")


def stat_events(df: DataFrame, outlier: float = 2.5, momentum: float = 0.3, corr: float = 0.7, breakout: float = 2.0, strong: float = 1.5) -> DataFrame:
    """Events from the statistics; a missing input makes its comparison false. traditional_event: any of the three."""
    return in_blocks(df, lambda d: _stat_events(d, outlier, momentum, corr, breakout, strong), 1)


def _stat_events(df: DataFrame, outlier: float, momentum: float, corr: float, breakout: float, strong: float) -> DataFrame:
    step = F.abs(F.col("momentum_score") - F.lag("momentum_score").over(over()))
    strength = flag(F.abs("volume_zscore") > strong) | flag(F.abs("price_momentum_norm") > strong)
    df = df.select(
        "*", (flag(F.abs("price_vol_corr") < corr) & flag(F.abs("vol_breakout_score") > breakout) & strength).alias("vpd_event"),
        flag(F.abs("return_zscore") > outlier).alias("outlier_event"), flag(step > momentum).alias("momentum_event"),
    )
    return df.withColumn("traditional_event", F.col("vpd_event") | F.col("outlier_event") | F.col("momentum_event"))


def event_type(df: DataFrame) -> DataFrame:
    """any_event and one code a row: later rules win, so the chain runs in reverse priority."""
    main = [F.col(c) for c in ("vpd_event", "outlier_event", "momentum_event", "bb_any_cross")] + [F.col("cusum_event") != 0]
    many = reduce(lambda a, b: a + b, [c.cast("int") for c in main])
    code = (
        F.when(many > 1, 8 + many - 2).when(F.col("bb_expansion"), 7).when(F.col("bb_squeeze"), 6).when(F.col("bb_any_cross"), 5)
        .when(F.col("cusum_event") != 0, 4).when(F.col("momentum_event"), 3).when(F.col("outlier_event"), 2).when(F.col("vpd_event"), 1).otherwise(0)
    )
    return df.withColumn("any_event", reduce(lambda a, b: a | b, [*main, F.col("bb_squeeze"), F.col("bb_expansion")])).withColumn("event_type", code)


def all_events(df: DataFrame, cfg: dict[str, Any] | None = None, cusum_args: dict[str, Any] | None = None, band_args: dict[str, Any] | None = None) -> DataFrame:
    """Bars with atr_pct, vol_realized and the bollinger columns: all events, any_event and event_type."""
    c = {k: v for k, v in (cfg or {}).items() if k != "lookback"}
    band, lookback = band_args or {}, (cfg or {}).get("lookback", 100)
    back = max(lookback + 1, 52, band.get("lookback", 3)) + 2
    df = in_blocks(df, lambda d: _steps(stat_events(statistics(band_events(d, **band), lookback), **c)), back)
    df = _cusum(df, **(cusum_args or {})).withColumn("cusum_flag", F.col("cusum_event") != 0)
    return event_type(df)


def together(columns: list[str], window: int, causal: bool = False) -> Column:
    """Whether each flag occurs within `window` rows before or after (only before, if causal)."""
    w = over().rowsBetween(-window, 0 if causal else window)
    return reduce(lambda a, b: a & b, [F.max(F.col(c)).over(w) for c in columns])


def chosen(events: list[str], size: int, most: int, named: tuple[tuple[str, ...], ...], generic: bool) -> list[tuple[str, list[str]]]:
    """(column, events) of the combinations: the named ones first, then all others of the events, `most` at most."""
    short = lambda c: c.replace("_event", "")
    first = [t for t in named if len(t) == size and set(t) <= set(events)][:most]
    pool = combinations(events if size == 2 else events[:6], size) if generic else ()
    known = {tuple(t) for t in named} | ({tuple(t[::-1]) for t in named} if size == 2 else set())
    rest = [t for t in pool if t not in known][: max(0, most - len(first))]
    return [(f"covent_{size}way_{'_'.join(map(short, t))}", list(t)) for t in (*first, *rest)]


def covents(
    df: DataFrame, events: list[str], window: int = 2, most: int = 50, pairs: tuple[tuple[str, ...], ...] = (), triples: tuple[tuple[str, ...], ...] = (), generic: bool = True, causal: bool = False,
) -> DataFrame:
    """Flags of pairs and triples of events (named ones first, triples of the first six), their counts and
    confluence measures. individual_event_count adds all flags named `_event`, the combined ones too, and the CUSUM's."""
    two, three = chosen(events, 2, most, pairs, generic), chosen(events, 3, most, triples, generic)
    kinds = dict(df.dtypes)
    single = [c for c in df.columns if kinds[c] == "boolean" and ("_event" in c and "covent" not in c or c == "cusum_flag")]
    df = df.select("*", *[together(cols, window, causal).alias(name) for name, cols in two + three])
    count = lambda names: reduce(lambda a, b: a + b, [F.col(n).cast("int") for n in names]) if names else F.lit(0)
    df = df.withColumn("count_2way", count([n for n, _ in two])).withColumn("count_3way", count([n for n, _ in three]))
    total = F.col("count_2way") + F.col("count_3way")
    df = df.select(
        "*", (F.col("count_2way") > 0).alias("any_2way"), (F.col("count_3way") > 0).alias("any_3way"), total.alias("total_covents"), total.alias("covent_intensity"), (total > 0).alias("any_covent"),
        (total >= 2).alias("high_confluence"), (total >= 3).alias("very_high_confluence"), count(single).alias("individual_event_count"),
    )
    near = F.sum(F.col("any_covent").cast("int")).over(last(3))
    return df.withColumn("covent_persistence", near).withColumn("sustained", near >= 2).withColumn("escalation", F.col("any_covent") & (F.col("individual_event_count") >= 1))


def enhanced_type(df: DataFrame) -> DataFrame:
    """any_event_with_covent, and the event type with codes 20 to 25 for co-events and confluence; needs covents and confluence."""
    bare = ~F.col("any_event")
    code = (
        F.when(F.col("squeeze_release"), 25).when(F.col("breakout"), 24).when(F.col("trend_reversal"), 23).when(F.col("high_confluence"), 22)
        .when(F.col("any_3way") & bare, 21).when(F.col("any_2way") & bare, 20).otherwise(F.col("event_type"))
    )
    return df.withColumn("any_event_with_covent", F.col("any_event") | F.col("any_covent")).withColumn("enhanced_event_type", code)


def confluence(df: DataFrame) -> DataFrame:
    """Trend reversal, breakout and squeeze release."""
    was = flag(F.lag("bb_squeeze", 1).over(over())) | flag(F.lag("bb_squeeze", 2).over(over()))
    return df.select(
        "*", ((F.col("cusum_event") != 0) & F.col("momentum_event") & F.col("bb_any_cross")).alias("trend_reversal"),
        (F.col("vpd_event") & F.col("outlier_event") & F.col("bb_expansion")).alias("breakout"), (was & F.col("bb_expansion") & F.col("momentum_event")).alias("squeeze_release"),
    )


def summary(df: DataFrame, flags: list[str]) -> DataFrame:
    """Count and rate of each flag."""
    pairs = ", ".join(f"'{c}', cast({c} as int)" for c in flags)
    long = df.selectExpr(f"stack({len(flags)}, {pairs}) as (event, hit)")
    return long.groupBy("event").agg(F.sum("hit").alias("n"), F.avg("hit").alias("rate"))


# What the codes of event_type mean.
LEGEND = {
    0: "No event", 1: "Volume-Price Divergence + Volatility", 2: "Return Distribution Outlier", 3: "Momentum Regime Change", 4: "CUSUM Change Detection", 5: "Bollinger Band Crossing",
    6: "Bollinger Band Squeeze", 7: "Bollinger Band Expansion", 8: "Multiple events (2 types)", 9: "Multiple events (3 types)", 10: "Multiple events (4+ types)",
}


def type_counts(df: DataFrame) -> DataFrame:
    """Per event type: meaning, rows, their share, first and last time. Types above 10 mean as 10."""
    total = df.agg(F.count("*").alias("_all"))
    names = F.create_map(*[F.lit(x) for kv in LEGEND.items() for x in kv])
    g = df.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.join(F.broadcast(total)).select("event_type", names[F.least("event_type", F.lit(10))].alias("meaning"), "n", (F.col("n") / F.col("_all")).alias("share"), "first_ts", "last_ts")


def column_counts(columns: list[str], frames: list[str]) -> dict[str, int]:
    """How many columns of each kind a data set has."""
    has = lambda *parts: sum(any(p in c.lower() for p in parts) for c in columns)
    return {
        "indicators": has("ema_", "sma_", "rsi", "macd", "bb_"), "normalized": has("_dist_", "_pct", "_normalized", "_efficiency"), "higher_frames": sum(any(f in c for f in frames) for c in columns),
        "events": has("event", "zscore", "breakout", "regime", "cusum", "bb_"), "covents": has("covent"),
    }
