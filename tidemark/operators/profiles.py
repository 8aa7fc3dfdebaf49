"""Market regime and event profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import change, over


def market_regime(bars: DataFrame, lookback: int = 30, high: float = 0.40, low: float = 0.25, trend: float = 5.0) -> DataFrame:
    """Per symbol, from its last rows: annualised volatility, trend in percent and the regime's name."""
    df = bars.withColumn("_r", change(F.col("close")))
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    df = df.withColumn("_n", nth).where(F.col("_n") <= lookback)
    g = df.groupBy("symbol").agg((F.stddev_samp("_r") * F.sqrt(F.lit(252.0))).alias("volatility"), ((F.try_divide(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1) * 100).alias("trend"))
    v, t = F.col("volatility"), F.col("trend")
    name = (
        F.when(v > high, "CRISIS").when((t > 2 * trend) & (v <= low), "RECOVERY").when(t > trend, F.when(v > low, "BULL_HIGH_VOL").otherwise("BULL_LOW_VOL"))
        .when(t < -trend, F.when(v > low, "BEAR_HIGH_VOL").otherwise("BEAR_LOW_VOL")).otherwise(F.when(v > low, "SIDEWAYS_HIGH_VOL").otherwise("SIDEWAYS_LOW_VOL"))
    )
    return g.withColumn("regime", name)


def event_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per flag: rows, events, frequency, clustering (1 - transitions / expected runs) and the share of rows that have it."""
    pairs = ", ".join(f"'{c}', cast({c} as int)" for c in columns)
    rows = df.selectExpr("symbol", "ts", f"stack({len(columns)}, {pairs}) as (event, known)").withColumn("hit", F.coalesce("known", F.lit(0)))
    w = Window.partitionBy("event", "symbol").orderBy("ts")
    rows = rows.withColumn("_t", (F.col("hit") != F.lag("hit").over(w)).cast("int"))
    g = rows.groupBy("event").agg(
        F.count("*").alias("n"), F.sum("hit").alias("events"), F.avg("known").alias("frequency"), F.sum("_t").alias("transitions"), (F.count("known") / F.count("*")).alias("quality")
    )
    runs = 2 * F.col("events") * (F.col("n") - F.col("events")) / F.col("n")
    short = (F.col("n") < 10) | (F.col("events") == 0) | (F.col("events") == F.col("n"))
    clustering = F.when(short, 0.5).otherwise(1 - F.least(F.try_divide("transitions", F.nullif(runs, F.lit(0.0))), F.lit(1.0)))
    return g.select("event", "n", "events", "frequency", clustering.alias("clustering"), "quality")


# Keywords of the kinds of events; the first kind with a keyword in the name decides.
KINDS = {
    "breakout": ("break", "burst", "penetration", "resistance", "support"), "mean_reversion": ("revert", "return", "bounce", "correction"),
    "momentum": ("momentum", "trend", "acceleration", "velocity"), "volatility": ("vol", "volatility", "variance", "deviation"),
    "volume": ("volume", "liquidity", "participation"), "pattern": ("pattern", "formation", "signal", "flag", "triangle"),
}

# The regimes a market can be in.
REGIMES = ("BULL_HIGH_VOL", "BULL_LOW_VOL", "BEAR_HIGH_VOL", "BEAR_LOW_VOL", "SIDEWAYS_HIGH_VOL", "SIDEWAYS_LOW_VOL", "CRISIS", "RECOVERY")


def event_kind(profile: DataFrame) -> DataFrame:
    """Kind of an event by its name, else by its frequency: rare ones break out, common ones have momentum."""
    kind = None
    for k, words in KINDS.items():
        hit = F.lower("event").rlike("|".join(words))
        kind = F.when(hit, k) if kind is None else kind.when(hit, k)
    return profile.withColumn("kind", kind.when(F.col("frequency") < 0.05, "breakout").when(F.col("frequency") > 0.3, "momentum").otherwise("mean_reversion"))


def regime_association(profile: DataFrame) -> DataFrame:
    """(event, regime, share): uniform, as no history of regimes is kept."""
    return profile.select("event", F.explode(F.array(*map(F.lit, REGIMES))).alias("regime")).withColumn("share", F.lit(1.0 / len(REGIMES)))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Per symbol: rows, first and last time, and the commonest step between rows in seconds."""
    step = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(over()))) / 1e6
    d = df.select("symbol", "ts", step.alias("step"))
    common = d.where("step is not null").groupBy("symbol", "step").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.max_by("step", F.struct("n", -F.col("step"))).alias("frequency"))
    return d.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).join(common, "symbol", "left")


def frame_info(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows, first and last time of each frame."""
    out = None
    for name, df in frames.items():
        part = df.agg(F.lit(name).alias("frame"), F.count("*").alias("n_rows"), F.min("ts").alias("a"), F.max("ts").alias("b"))
        out = part if out is None else out.union(part)
    return out


def first_step(df: DataFrame) -> DataFrame:
    """Seconds between each symbol's first two times."""
    df = df.withColumn("_n", F.row_number().over(over())).where("_n <= 2")
    return df.groupBy("symbol").agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("seconds"))
