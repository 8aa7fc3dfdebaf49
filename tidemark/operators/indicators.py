"""Technical indicators over bars (symbol, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.chunked import in_blocks
from tidemark.operators.series import change, ema, full, last, over, smooth


def close() -> Column:
    return F.col("close")


def new_bars(df: DataFrame, frame: str, on: str = "end") -> DataFrame:
    """One row for each higher bar carried by base rows: where its end time (or its close) changes."""
    x = F.col(f"{frame}_{on}")
    df = df.withColumn("_p", F.lag(x).over(over())).withColumn("_first", F.row_number().over(over()) == 1)
    new = F.col("_first") | (x.isNull() if on == "close" else F.lit(False)) | F.col("_p").isNull() | (F.col("_p") != x)
    return df.where(new & (x.isNotNull() if on == "end" else F.lit(True))).drop("_p", "_first")


def sma(df: DataFrame, *ns: int) -> DataFrame:
    return in_blocks(df, lambda d: d.select("*", *[full(F.avg(close()), close(), n).alias(f"sma_{n}") for n in ns]), max(ns))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, dev = full(F.avg(close()), close(), n), full(F.stddev_pop(close()), close(), n)
    df = in_blocks(df, lambda d: d.select("*", mid.alias("bb_middle"), (mid + k * dev).alias("bb_upper"), (mid - k * dev).alias("bb_lower")), n)
    width = F.col("bb_upper") - F.col("bb_lower")
    return df.select(
        "*", F.coalesce(F.try_divide(close() - F.col("bb_lower"), F.nullif(width, F.lit(0.0))) * 100, F.lit(50.0)).alias("bb_position"),
        F.coalesce(F.try_divide(width, close()) * 100, F.lit(0.0)).alias("bb_width_pct"),
    )


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(ema(df, fast, "_f"), slow, "_s").withColumn("macd", F.col("_f") - F.col("_s"))
    df = smooth(df, "macd", 2 / (signal + 1), "_g")
    seen = F.count("macd").over(over().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("macd_signal", F.when(seen >= signal, F.col("_g")))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_f", "_s", "_g")


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder smoothing of gains and losses from the second row on."""
    step = close() - F.lag(close()).over(over())
    df = df.withColumn("_up", F.greatest(step, F.lit(0.0))).withColumn("_dn", F.greatest(-step, F.lit(0.0)))
    df = df.withColumn("_up", F.when(step.isNotNull(), F.col("_up"))).withColumn("_dn", F.when(step.isNotNull(), F.col("_dn")))
    df = smooth(smooth(df, "_up", 1 / n, "_au"), "_dn", 1 / n, "_ad")
    seen = F.count("_up").over(over().rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("_ad") == 0, F.lit(100.0)).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("_au"), F.col("_ad"))))
    return df.withColumn("rsi", F.when(seen >= n, value)).drop("_up", "_dn", "_au", "_ad")


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder mean of the true range, from the mean of the first n."""
    before = F.lag(close()).over(over())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    df = df.withColumn("tr", tr).withColumn("_rn", F.row_number().over(over()))
    df = df.withColumn("_go", F.col("_rn") >= n)
    df = df.withColumn("_x", F.when(F.col("_rn") == n, F.avg("tr").over(last(n))).otherwise(F.col("tr")))
    df = smooth(df, "_x", 1 / n, "atr", start="_go")
    return df.withColumn("atr_pct", F.try_divide("atr", close()) * 100).drop("_rn", "_go", "_x")


def volume_ratio(df: DataFrame, n: int | None = 20) -> DataFrame:
    """Mean volume and the ratio to it, over n rows; without n over min(20, half of the symbol's rows)."""
    if n is None:
        held = F.collect_list(F.coalesce(F.col("volume").cast("double"), F.lit(float("nan")))).over(last(20))
        k = F.least(F.lit(20), F.expr("_n div 2")).cast("int")
        df = df.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("_h", held)
        part = F.slice("_h", F.greatest(F.size("_h") - k + 1, F.lit(1)), F.greatest(k, F.lit(1)))
        mean = F.when((k > 0) & (F.size("_h") >= k) & ~F.exists(part, F.isnan), F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / k)
        df = df.withColumn("volume_sma", mean).drop("_n", "_h")
    else:
        df = df.select("*", full(F.avg("volume"), F.col("volume"), n).alias("volume_sma"))
    return df.withColumn("volume_ratio", F.try_divide(F.col("volume"), F.nullif(F.col("volume_sma"), F.lit(0.0))))


def returns(df: DataFrame, *ks: int) -> DataFrame:
    return in_blocks(df, lambda d: d.select("*", *[change(close(), k).alias(f"ret_{k}") for k in ks]), max(ks))


def realized_vol(df: DataFrame, minutes: int, n: int = 20) -> DataFrame:
    scale = (1440 / minutes) ** 0.5
    return in_blocks(df, lambda d: d.withColumn("_r", change(close())).withColumn("vol_realized", full(F.stddev_samp("_r"), F.col("_r"), n) * scale).drop("_r"), n + 1)


def derived(df: DataFrame) -> DataFrame:
    """Distances and ratios of the indicators above; needs ema_*, macd, rsi, atr and vol_realized."""
    out = [((F.try_divide(close(), F.col(c)) - 1) * 100).alias(f"{c}_dist_pct") for c in df.columns if c.startswith("ema_")]
    out += [F.try_divide(close() - F.col(c), F.nullif("atr", F.lit(0.0))).alias(f"{c}_dist_atr") for c in df.columns if c.startswith("ema_")]
    return df.select(
        "*", *out, F.try_divide("macd", F.nullif("atr", F.lit(0.0))).alias("macd_normalized"), F.try_divide("macd", F.nullif("vol_realized", F.lit(0.0))).alias("macd_efficiency"),
        ((F.col("rsi") - 50) * F.signum(change(close(), 5))).alias("rsi_momentum"),
    )


def cross_frame(df: DataFrame, frame: str, k: int = 5) -> DataFrame:
    """The base close against a higher frame's, and the base momentum over k rows against the frame's short momentum."""
    high = F.col(f"{frame}_close")
    theirs = F.col(f"{frame}_momentum_short") if f"{frame}_momentum_short" in df.columns else F.try_divide(high, F.col(f"{frame}_open")) - 1
    mine = change(close(), k)
    return df.select(
        "*", ((F.try_divide(close(), high) - 1) * 100).alias(f"price_vs_{frame}_pct"), (F.signum(mine) * F.signum(theirs)).alias(f"{frame}_align"),
        F.coalesce(F.try_divide(F.abs(mine), F.nullif(F.abs(theirs), F.lit(0.0))), F.lit(1.0)).alias(f"{frame}_momentum_ratio"),
    )
