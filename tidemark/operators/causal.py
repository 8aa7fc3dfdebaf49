"""Lead-lag, stability, regime and Granger statistics. Frames hold (symbol, ts, features..., y)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles
from tidemark.operators.scoring import long, numbered, safe_corr
from tidemark.operators.series import change, full, last, over


def lead_lag(df: DataFrame, x: str, y: str = "y", most: int = 5) -> DataFrame:
    """(shift, r): correlation of x, moved `shift` rows back, with y; one pass for all shifts."""
    shifts = range(-most, most + 1)
    df = df.select("*", *[F.lag(x, s).over(over()).alias(f"_x{s + most}") for s in shifts])
    row = df.agg(*[safe_corr(f"_x{s + most}", y).alias(f"r{s + most}") for s in shifts])
    return row.selectExpr(f"stack({len(shifts)}, " + ", ".join(f"{s}, r{s + most}" for s in shifts) + ") as (shift, r)")


def temporal(df: DataFrame, columns: list[str], y: str = "y", most: int = 5, least: float = 0.05) -> DataFrame:
    """(feature, lead, lag, ordered, strength): the best correlation with y of the feature moved back (signed), the best
    absolute one of y moved back, and whether the lead beats it and `least`; one pass for all features and shifts."""
    shifts = [k for k in range(-most, most + 1) if k]
    moved = {(c, k): f"_m{i}_{k + most}" for i, c in enumerate(columns) for k in shifts}
    df = df.select("*", *[F.lag(c if k > 0 else y, abs(k)).over(over()).alias(n) for (c, k), n in moved.items() if k > 0 or c == columns[0]])
    name = lambda c, k: moved[c, k] if k > 0 else moved[columns[0], k]
    row = df.agg(*[(safe_corr(name(c, k), y) if k > 0 else safe_corr(c, name(c, k))).alias(f"r{i}_{k + most}") for i, c in enumerate(columns) for k in shifts])
    lead = lambda i: F.coalesce(F.greatest(*[F.col(f"r{i}_{k + most}") for k in range(1, most + 1)]) if most > 1 else F.col(f"r{i}_{1 + most}"), F.lit(0.0))
    lag = lambda i: F.coalesce(F.greatest(*[F.abs(f"r{i}_{k + most}") for k in range(-most, 0)]) if most > 1 else F.abs(f"r{i}_{most - 1}"), F.lit(0.0))
    out = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), lead(i).alias("lead"), lag(i).alias("lag")) for i, c in enumerate(columns)])).alias("s")).select("s.*")
    ordered = (F.col("lead") > F.col("lag")) & (F.col("lead") > least)
    return out.withColumn("ordered", ordered).withColumn("strength", F.when(ordered, F.col("lead")).otherwise(0.0))


def split_stability(df: DataFrame, columns: list[str], splits: int = 3, steady: float = 0.5, strong: float = 0.05) -> DataFrame:
    """Per feature: mean correlation with y over ordered splits, 1 - their deviation (0 from 1 on), strength, and whether
    the relationship is structural: steady and strong enough."""
    df = numbered(df, ("ts", "symbol"))
    n = df.agg(F.count("*").alias("_n"))
    df = df.join(F.broadcast(n)).withColumn("part", F.least(F.expr(f"(rn - 1) div greatest(_n div {splits}, 1)"), F.lit(splits - 1)))
    per = df.groupBy("part").agg(*[safe_corr(c, "y").alias(c) for c in columns])
    rows = per.selectExpr("part", f"stack({len(columns)}, " + ", ".join(f"'{c}', {c}" for c in columns) + ") as (feature, r)").where("r is not null")
    g = rows.groupBy("feature").agg(F.count("*").alias("_k"), F.avg("r").alias("mean_r"), F.greatest(F.lit(0.0), 1 - F.stddev_pop("r")).alias("stability")).where("_k >= 2").drop("_k")
    g = g.withColumn("strength", F.abs("mean_r") * F.col("stability"))
    return g.withColumn("structural", (F.col("stability") > steady) & (F.abs("mean_r") > strong))


def regimes(df: DataFrame, inner: int = 20, outer: int = 40, q: float = 0.7) -> DataFrame:
    """Each row's regime from rows before it: direction of the mean return, volatility against its own quantile."""
    df = df.withColumn("_r", change(F.col("close")))
    df = df.withColumn("_sd", full(F.stddev_samp("_r"), F.col("_r"), inner)).withColumn("_mu", full(F.avg("_r"), F.col("_r"), inner))
    w = last(outer - inner + 1, 1)
    bound = F.when(F.count("_sd").over(w) == outer - inner + 1, F.percentile("_sd", F.lit(q)).over(w))
    sd, mu = F.lag("_sd", 1).over(over()), F.lag("_mu", 1).over(over())
    trend = F.when(mu > 0, "BULL").otherwise("BEAR")
    name = F.when(bound.isNull(), "SIDEWAYS_LOW_VOL").when(sd > bound, F.concat(trend, F.lit("_HIGH_VOL"))).otherwise(F.concat(trend, F.lit("_LOW_VOL")))
    return df.withColumn("regime_name", name).drop("_r", "_sd", "_mu")


def regime_stability(df: DataFrame, x: str, y: str = "y", least: int = 20, strong: float = 0.05) -> DataFrame:
    """Correlation by regime; stable where there are enough rows and it is strong enough."""
    g = df.groupBy("regime_name").agg(F.count("*").alias("n"), safe_corr(x, y).alias("r"))
    return g.withColumn("stable", (F.col("n") >= least) & F.coalesce(F.abs("r") > strong, F.lit(False)))


def breaks(df: DataFrame, x: str, y: str = "y", n: int = 30, q: float = 0.9, most: float = 0.15) -> DataFrame:
    """Per symbol: the quantile q of the rolling correlation's moves, how many are above it, the stability that is left,
    and has_breaks: more than `most` of the rows moved so far (which a quantile of the moves themselves hardly allows)."""
    sd = lambda c: full(F.stddev_pop(c), F.col(c), n)
    r = F.try_divide(full(F.covar_pop(x, y), F.col(x), n), F.nullif(sd(x) * sd(y), F.lit(0.0)))
    df = df.withColumn("_c", r)
    df = df.withColumn("_d", F.abs(F.col("_c") - F.lag("_c").over(over())))
    bound = quantiles(df, ["symbol"], "_d", [q], "_q").select("symbol", F.col("_q")[0].alias("bound"))
    g = df.join(bound, "symbol", "left").groupBy("symbol", "bound").agg(F.count("*").alias("rows"), F.count("_c").alias("_n"), F.count_if(F.col("_d") > F.col("bound")).alias("n_breaks"))
    stable = F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("n_breaks").cast("double"), F.col("_n")))
    return g.select("symbol", "rows", "bound", "n_breaks", F.coalesce(stable, F.lit(0.0)).alias("stability"), (F.col("n_breaks") > most * F.col("rows")).alias("has_breaks"))


def lag_sums(df: DataFrame, columns: list[str], y: str, max_lag: int) -> DataFrame:
    """(feature, lag, n, s0 ...): for every feature and number of lags the upper triangle of the normal equations of
    1, y's lags, x's lags and y, unused places 0. One pass over the rows for all of them."""
    rows = long(df.withColumn("_y", F.col(y).cast("double")), columns, ("symbol", "ts", "_y"))
    w = Window.partitionBy("symbol", "feature").orderBy("ts")
    ys, xs = ([F.lag(c, i).over(w).alias(f"{c}{i}") for i in range(1, max_lag + 1)] for c in ("_y", "x"))
    rows = rows.select("feature", "_y", "x", *ys, *xs).withColumn("lag", F.explode(F.array(*[F.lit(i) for i in range(1, max_lag + 1)])))
    used = lambda c, i: F.when(F.col("lag") >= i, F.col(f"{c}{i}")).otherwise(F.lit(0.0))
    v = [F.lit(1.0), *[used("_y", i) for i in range(1, max_lag + 1)], *[used("x", i) for i in range(1, max_lag + 1)], F.col("_y")]
    whole = F.col("_y").isNotNull() & F.col("x").isNotNull()
    for c in ("_y", "x"):
        for i in range(1, max_lag + 1):
            whole = whole & ((F.col("lag") < i) | F.col(f"{c}{i}").isNotNull())
    rows = rows.where(whole).select("feature", "lag", *[c.alias(f"v{i}") for i, c in enumerate(v)])
    return rows.groupBy("feature", "lag").agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i in range(len(v)) for j in range(i, len(v))])


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f) by the continued fraction of the incomplete beta function."""
    from math import exp, lgamma, log

    if not f > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a, lgamma, exp, log)
    return _beta(x, a, b, lgamma, exp, log)


def _beta(x, a, b, lgamma, exp, log) -> float:
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1e-300
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def granger(df: DataFrame, columns: Iterable[str], y: str = "y", max_lag: int = 5, alpha: float = 0.1, least: int = 30) -> DataFrame:
    """(feature, lag, f, p, strength, causal) at each feature's best lag.

    The sums of all features and lags come from one pass; the driver gets one row for each and solves
    at most (2 max_lag + 1) equations.
    """
    best: dict[str, tuple] = {}
    k = 2 * max_lag + 2
    for row in lag_sums(df, list(columns), y, max_lag).collect():
        s = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                s[i, j] = s[j, i] = row[f"s{i}_{j}"] or 0.0
        n, lag = s[0, 0], row.lag
        if n < max(least, 3 * (2 * lag + 2)):
            continue
        own, theirs = [0, *range(1, lag + 1)], [max_lag + i for i in range(1, lag + 1)]
        rss = []
        for use in (own, own + theirs):
            b = s[use, k - 1]
            rss.append(max(s[k - 1, k - 1] - b @ np.linalg.lstsq(s[np.ix_(use, use)], b, rcond=None)[0], 0.0))
        d2 = n - 2 * lag - 1
        f = (rss[0] - rss[1]) / lag / (rss[1] / d2) if rss[1] > 0 else float("inf")
        p = f_tail(f, lag, d2) if np.isfinite(f) else 0.0
        if row.feature not in best or (p, lag) < (best[row.feature][3], best[row.feature][1]):
            best[row.feature] = (row.feature, lag, float(f), float(p))
    out = [(*b, 1 - b[3] if b[3] < alpha else 0.0, b[3] < alpha) for b in best.values()]
    return df.sparkSession.createDataFrame(out, "feature string, lag int, f double, p double, strength double, causal boolean")


def clean(df: DataFrame, columns: list[str], critical: list[str]) -> DataFrame:
    """Features filled from before, then from after; rows without the critical columns go. Labels stay as they are."""
    back = over().rowsBetween(Window.unboundedPreceding, 0)
    ahead = over().rowsBetween(0, Window.unboundedFollowing)
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, *[F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)).alias(c) for c in columns]).na.drop(subset=critical)


def relationship(df: DataFrame) -> DataFrame:
    """Type of relationship from `causal`, `lag` and `structural`."""
    flow = F.when(F.coalesce("lag", F.lit(1)) <= 1, "information_flow").otherwise("granger_causal")
    kind = F.when(F.coalesce("causal", F.lit(False)), flow).when(F.coalesce("structural", F.lit(False)), "structural_causal").otherwise("granger_causal")
    return df.withColumn("relationship", kind)


def label_statistics(df: DataFrame, labels: list[str]) -> DataFrame:
    """Per label: rows with it, positives, their rate and the share of rows that have it."""
    pairs = ", ".join(f"'{c}', cast({c} as int)" for c in labels)
    rows = df.selectExpr(f"stack({len(labels)}, {pairs}) as (label, v)")
    return rows.groupBy("label").agg(
        F.count("v").alias("n"), F.count_if(F.col("v") == 1).alias("positive"), F.avg((F.col("v") == 1).cast("double")).alias("rate"), (F.count("v") / F.count("*")).alias("completeness")
    )
