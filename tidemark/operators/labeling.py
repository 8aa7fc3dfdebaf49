"""Triple-barrier labels for events."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import change, last
from tidemark.schema import config

# The events, barrier parameters and costs of the presets, by label.
PRESETS: dict[str, dict[str, Any]] = {
    "scalping": {
        "labels": {"outlier_label": ["outlier_event"]}, "how": "any", "costs": {"slippage": 0.0002, "multiplier": 3.0},
        "params": {"outlier_label": {"vol_mult": 1.5, "stop_mult": 1.0, "holding_days": 0.5, "min_rr": 2.0}},
    },
    "swing": {
        "labels": {"momentum_label": ["momentum_event"]}, "how": "any", "costs": {},
        "params": {"momentum_label": {"vol_mult": 2.5, "stop_mult": 1.5, "holding_days": 3.0, "min_rr": 1.8, "volume": False}},
    },
    "multi_frame": {
        "labels": {"outlier_label": ["outlier_event"], "momentum_label": ["momentum_event"], "vpd_label": ["vpd_event"]}, "how": "any", "costs": {},
        "params": {
            "outlier_label": {"vol_mult": 1.8, "stop_mult": 1.1, "holding_days": 0.75, "min_rr": 2.2},
            "momentum_label": {"vol_mult": 2.3, "stop_mult": 1.4, "holding_days": 2.5, "min_rr": 1.7, "volume": False},
            "vpd_label": {"vol_mult": 3.0, "stop_mult": 1.8, "holding_days": 1.5, "min_rr": 1.6},
        },
    },
    "high_confidence": {
        "labels": {"outlier_momentum_label": ["outlier_event", "momentum_event"]}, "how": "all", "costs": {},
        "params": {"outlier_momentum_label": {"vol_mult": 2.8, "stop_mult": 1.6, "holding_days": 2.0, "min_rr": 1.5}},
    },
}


def validate(df: DataFrame) -> DataFrame:
    """The frame with `ts` as a timestamp; fails without symbol, ts and OHLC columns."""
    missing = [c for c in ("symbol", "ts", "open", "high", "low", "close") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def combined_name(columns: list[str]) -> str:
    return "_".join(c.replace("_event", "") for c in columns) + "_combined_label"


def select_events(df: DataFrame, labels: dict[str, list[str]], how: str = "any") -> DataFrame:
    """(label_name, symbol, ts) of the rows where any (or all) of a label's columns hold."""
    join = (lambda a, b: a | b) if how == "any" else (lambda a, b: a & b)
    if how == "all" and any(len(c) < 2 for c in labels.values()):
        raise ValueError("simultaneous labels need two columns or more")
    hit = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    parts = [F.when(reduce(join, [hit(c) for c in cols]), F.lit(name)) for name, cols in labels.items()]
    return df.select("symbol", "ts", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("label_name"))


def cost_floor(costs: dict[str, float] | None = None, funding: bool = True) -> float:
    """The move that pays twice the fee, spread, slippage (and funding), times a safety multiplier."""
    c = config({"costs": costs or {}})["costs"]
    return (2 * c["fee"] + c["spread"] + c["slippage"] + (c["funding"] if funding else 0.0)) * c["multiplier"]


def factors(df: DataFrame) -> DataFrame:
    """vol (from atr_pct, else the last 20 returns, else 0.02), liquidity and regime multipliers."""
    df = df.withColumn("_r", change(F.col("close")))
    fallback = F.when(F.count("_r").over(last(20)) > 5, F.stddev_samp("_r").over(last(20))).otherwise(F.lit(0.02))
    df = df.withColumn("vol", F.coalesce(F.col("atr_pct") / 100, fallback) if "atr_pct" in df.columns else fallback)
    rel = F.try_divide(F.col("volume"), F.nullif(F.avg("volume").over(last(51)), F.lit(0.0)))
    liquidity = F.when(rel < 0.5, 1.4).when(rel > 2, 0.8).otherwise(1.0)
    past = last(100, 1)
    whole = (F.count("vol").over(past) == F.count("*").over(past)) & (F.count("*").over(past) >= 10)
    share = F.when(whole, F.try_divide(F.col("vol"), F.nullif(F.avg("vol").over(past), F.lit(0.0))))
    regime = F.when(share > 1.5, 1.3).when(share < 0.7, 0.8).otherwise(1.0)
    return df.withColumn("liquidity", liquidity).withColumn("regime", regime).drop("_r")


def barriers(
    events: DataFrame, bars: DataFrame, params: dict[str, dict[str, Any]] | None = None, costs: dict[str, float] | None = None, defaults: dict[str, Any] | None = None,
) -> DataFrame:
    """Profit and stop distances and the vertical barrier of each event; bars carry the factors.

    A label's `params` replace the defaults. With `theory` false the distances are its fixed
    profit_take and stop_loss, above a cost floor without funding.
    """
    base = config()["barriers"] | (defaults or {})
    floor, simple = cost_floor(costs), cost_floor(costs, funding=False)

    def pick(key: str) -> Column:
        out = F.lit(base[key])
        for n in sorted(params or {}):
            out = F.when(F.col("label_name") == n, F.lit(params[n].get(key, base[key]))).otherwise(out)
        return out

    theory = pick("theory")
    e = events.join(bars.select("symbol", "ts", "close", "vol", "liquidity", "regime"), ["symbol", "ts"])
    scale = F.col("vol") * F.when(pick("regime"), F.col("regime")).otherwise(1.0) * F.when(pick("volume"), F.col("liquidity")).otherwise(1.0)
    up = F.when(theory, F.greatest(F.lit(floor), scale * pick("vol_mult"))).otherwise(F.greatest(F.lit(simple), pick("profit_take")))
    down = F.when(theory, F.greatest(F.lit(0.6 * floor), scale * pick("stop_mult"))).otherwise(F.greatest(F.lit(0.6 * simple), pick("stop_loss")))
    e = e.withColumn("_pt", up).withColumn("stop_loss", down)
    e = e.withColumn("profit_take", F.when(F.col("_pt") / F.col("stop_loss") < pick("min_rr"), F.col("stop_loss") * pick("min_rr")).otherwise(F.col("_pt"))).drop("_pt")
    ends = bars.groupBy("symbol").agg(F.max("ts").alias("_end"))
    hold = F.make_dt_interval(secs=(pick("holding_days") * 86400).cast("decimal(18,6)"))
    return e.join(ends, "symbol").withColumn("vertical", F.least(F.col("ts") + hold, F.col("_end"))).drop("_end")


def triple_barrier(events: DataFrame, bars: DataFrame, bucket_hours: float = 24.0, skip_event_bar: bool = False) -> DataFrame:
    """label (1, -1, 0), barrier, touch time, return and holding hours of each event.

    Bars are cut into time buckets; an event joins the buckets its path covers by equality, so the
    range join shuffles on (symbol, bucket), and only paths meet. The first touch wins, profit on
    ties; without a touch the last close before the vertical barrier gives the return.
    """
    size = int(bucket_hours * 3600)
    bucket = lambda c: F.floor(F.unix_timestamp(c) / size)
    path = bars.select(F.col("symbol").alias("p_symbol"), F.col("ts").alias("p_ts"), "high", "low", F.col("close").alias("p_close"), bucket(F.col("ts")).alias("p_b"))
    e = events.withColumn("_b", F.explode(F.sequence(bucket(F.col("ts")), bucket(F.col("vertical")))))
    after = F.col("p_ts") > F.col("ts") if skip_event_bar else F.col("p_ts") >= F.col("ts")
    j = e.join(path, (F.col("symbol") == F.col("p_symbol")) & (F.col("_b") == F.col("p_b")) & after & (F.col("p_ts") <= F.col("vertical")), "left")
    up = F.try_divide(F.col("high"), F.col("close")) - 1 >= F.col("profit_take")
    down = F.try_divide(F.col("low"), F.col("close")) - 1 <= -F.col("stop_loss")
    out = j.groupBy("label_name", "symbol", "ts").agg(
        F.first("close").alias("close"), F.first("profit_take").alias("profit_take"), F.first("stop_loss").alias("stop_loss"), F.first("vertical").alias("vertical"),
        F.count("p_ts").alias("n_path"), F.min(F.when(up, F.col("p_ts"))).alias("_up"), F.min(F.when(down, F.col("p_ts"))).alias("_down"), F.max_by("p_close", "p_ts").alias("_last"),
    )
    whole = (F.col("n_path") > 1) & (F.col("close") != 0)
    profit = whole & F.col("_up").isNotNull() & (F.col("_down").isNull() | (F.col("_up") <= F.col("_down")))
    stop = whole & ~profit & F.col("_down").isNotNull()
    touch = F.when(profit, F.col("_up")).when(stop, F.col("_down")).when(whole, F.col("vertical")).otherwise(F.col("ts"))
    return out.select(
        "label_name", "symbol", "ts", F.when(profit, 1).when(stop, -1).otherwise(0).alias("label"),
        F.when(profit, "profit").when(stop, "stop").when(F.col("close") == 0, "error").otherwise("vertical").alias("barrier"), touch.alias("touch_ts"),
        F.when(profit, F.col("profit_take")).when(stop, -F.col("stop_loss")).when(whole, F.try_divide(F.col("_last"), F.col("close")) - 1).otherwise(0.0).alias("ret"),
        ((F.unix_micros(touch) - F.unix_micros("ts")) / 3.6e9).alias("holding_hours"),
    )


def attach(bars: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Five columns for each label name beside the bars."""
    parts = ("label", "barrier", "touch_ts", "ret", "holding_hours")
    wide = labels.groupBy("symbol", "ts").agg(*[F.first(F.when(F.col("label_name") == n, F.col(p)), True).alias(n if p == "label" else f"{n}_{p}") for n in names for p in parts])
    return bars.join(wide, ["symbol", "ts"], "left")


def summary(labels: DataFrame) -> DataFrame:
    """Per label: events, rates of each outcome, how often each barrier was touched, mean return and hours."""
    rate = lambda v: F.avg((F.col("label") == v).cast("double"))
    touched = [F.count_if(F.col("barrier") == b).alias(f"n_{b}") for b in ("profit", "stop", "vertical", "error")]
    return labels.groupBy("label_name").agg(
        F.count("*").alias("n"), rate(1).alias("success_rate"), rate(-1).alias("stop_rate"), rate(0).alias("neutral_rate"), F.avg("ret").alias("mean_ret"), F.avg("holding_hours").alias("mean_hours"), *touched
    )


def label_all(
    df: DataFrame, labels: dict[str, list[str]] | list[str], how: str = "any", params: dict[str, dict[str, Any]] | None = None, costs: dict[str, float] | None = None,
    defaults: dict[str, Any] | None = None, skip_event_bar: bool = False,
) -> DataFrame:
    """(label_name, symbol, ts, label, barrier, ...) of bars that carry event flags; costs reach the barriers.

    labels: label name -> event columns, or a list of columns with one label each (`any_event` -> `any_label`).
    Columns that aren't there are left out, and with how="all" so is the label.
    """
    df = validate(df)
    if isinstance(labels, list):
        labels = {f"{c.removesuffix('_event')}_label": [c] for c in labels}
    if how == "all" and any(len(c) < 2 for c in labels.values()):
        raise ValueError("simultaneous labels need two columns or more")
    have = {n: [c for c in cols if c in df.columns] for n, cols in labels.items()}
    have = {n: cols for n, cols in have.items() if cols and (how != "all" or len(cols) == len(labels[n]))}
    if not have:
        raise ValueError("no event column of any label is there")
    b = factors(df)
    return triple_barrier(barriers(select_events(df, have, how), b, params, costs, defaults), b, skip_event_bar=skip_event_bar)


def labeled(df: DataFrame, labels: dict[str, list[str]] | list[str], how: str = "any", **options) -> tuple[DataFrame, DataFrame]:
    """The bars with five columns a label, and the labels' summary."""
    rows = label_all(df, labels, how, **options)
    names = list(labels) if isinstance(labels, dict) else [f"{c.removesuffix('_event')}_label" for c in labels]
    return attach(df, rows, names), summary(rows)


def preset(df: DataFrame, name: str) -> DataFrame:
    """Labels by one of the PRESETS."""
    p = PRESETS[name]
    return label_all(df, p["labels"], p["how"], p["params"], p["costs"])


def label_events(df: DataFrame, columns: str | list[str] | None = None, profit_take: float = 0.02, stop_loss: float = 0.015, holding_days: float = 1.0, dynamic: bool = True) -> DataFrame:
    """One call for one set of parameters: several columns make one combined label; not dynamic: fixed barriers."""
    columns = [columns or "any_event"] if not isinstance(columns, list) else columns
    labels = {combined_name(columns): columns} if len(columns) > 1 else columns
    fixed = {"theory": dynamic, "profit_take": profit_take, "stop_loss": stop_loss, "holding_days": holding_days, "volume": dynamic, "regime": dynamic}
    return label_all(df, labels, defaults=fixed)


def quick_label_outliers(df: DataFrame) -> DataFrame:
    return preset(df, "scalping")


def quick_label_momentum(df: DataFrame) -> DataFrame:
    return preset(df, "swing")


def quick_label_all_events(df: DataFrame) -> DataFrame:
    return label_events(df)
