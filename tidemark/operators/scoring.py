"""Feature preparation, scores, folds and economic metrics. Frames are (symbol, ts, features..., y)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import cut_by, quantiles
from tidemark.operators.series import over


def fill(df: DataFrame, columns: list[str], crisis: bool = False) -> DataFrame:
    """Last value before, else the next one, else the median; in a crisis the next one, the one before, else 0."""
    back = over().rowsBetween(Window.unboundedPreceding, 0)
    ahead = over().rowsBetween(0, Window.unboundedFollowing)
    kept = [c for c in df.columns if c not in columns]
    if crisis:
        return df.select(*kept, *[F.coalesce(F.first(c, True).over(ahead), F.last(c, True).over(back), F.lit(0.0)).alias(c) for c in columns])
    mid = quantiles(long(df, columns, ()), ["feature"], "x", [0.5], "m")
    mid = mid.agg(*[F.max(F.when(F.col("feature") == c, F.col("m")[0])).alias(f"_m_{c}") for c in columns])
    df = df.join(F.broadcast(mid))  # one row
    return df.select(*kept, *[F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead), F.col(f"_m_{c}")).alias(c) for c in columns])


def long(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ("symbol", "ts", "y")) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    return df.selectExpr(*keep, f"stack({len(columns)}, {pairs}) as (feature, x)")


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    return long(df, columns, ()).groupBy("feature").agg(F.var_samp("x").alias("variance"), (F.coalesce(F.var_samp("x"), F.lit(0.0)) == 0).alias("constant"))


def safe_corr(a: str, b: str) -> Column:
    """Correlation; null where a side has no variance."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns, in one pass."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[safe_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.selectExpr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs)) + ") as (a, b, r)")


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows with a label, as `y`."""
    return df.where(F.col(label).isNotNull()).withColumn("y", F.col(label).cast("int"))


def correlated(df: DataFrame, columns: list[str], limit: float = 0.95, half: bool = True) -> DataFrame:
    """Columns to drop: those correlated above the limit with one before them. half: by the first half of the rows alone."""
    return correlations(first_rows(df, 0.5) if half else df, columns).where(F.abs("r") > limit).select(F.col("b").alias("feature")).distinct()


def first_rows(df: DataFrame, share: float) -> DataFrame:
    return split(df, share).where("role = 'train'").drop("rn", "role")


def correlated_worse(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    """Columns to drop, keeping the best: of each column and those before it that correlate with it above the
    limit, all but the one most correlated with y go (on ties the later column stays)."""
    target = target_correlation(df, columns).select("feature", F.coalesce("r", F.lit(0.0)).alias("t"))
    place = F.create_map(*[F.lit(x) for kv in ((c, i) for i, c in enumerate(columns)) for x in kv])
    close = correlations(df, columns).where(F.abs("r") > limit)
    group = close.select(F.col("b").alias("head"), F.col("a").alias("feature")).union(close.select("b", "b").distinct())
    group = group.join(F.broadcast(target), "feature")  # one row a column
    # the head comes first, then the columns before it in their order
    rank = F.when(F.col("feature") == F.col("head"), -1).otherwise(place[F.col("feature")])
    nth = F.row_number().over(Window.partitionBy("head").orderBy(F.desc("t"), rank))
    return group.withColumn("_n", nth).where("_n > 1").select("feature").distinct()


def outlier_heavy(df: DataFrame, columns: list[str], most: float = 0.1, share: float = 0.3, crisis: bool = False) -> DataFrame:
    """Columns to drop for their outliers; none in a crisis, nor where that would be `share` of all columns or more."""
    bad = outlier_shares(df, columns).where((F.col("share") > most) & F.lit(not crisis)).select("feature")
    n = bad.agg(F.count("*").alias("_n"))
    return bad.join(F.broadcast(n)).where(F.col("_n") < share * len(columns)).select("feature")


def outlier_shares(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    rows = long(df, columns, ())
    stats = rows.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    rows = rows.join(stats, "feature")
    return rows.groupBy("feature").agg(F.avg((F.coalesce(F.try_divide(F.abs(F.col("x") - F.col("m")), F.nullif("s", F.lit(0.0))), F.lit(0.0)) > limit).cast("double")).alias("share"))


def bins(df: DataFrame, columns: list[str], n: int = 8) -> DataFrame:
    """(feature, bin, y): the quantile bin of each value, by exact percentiles."""
    rows = long(df, columns, ("y",))
    cuts = quantiles(rows, ["feature"], "x", [i / n for i in range(1, n)], "cuts")
    return rows.join(cuts, "feature").where("x is not null").select("feature", "y", cut_by(F.col("cuts"), F.col("x")).alias("bin"))


def mutual_information(df: DataFrame, columns: list[str], n: int = 8) -> DataFrame:
    """Of each feature's quantile bins with y, in nats: a deterministic estimate from counts."""
    c = bins(df, columns, n).groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    w = lambda *k: Window.partitionBy("feature", *k)
    total, nb, ny = F.sum("n").over(w()), F.sum("n").over(w("bin")), F.sum("n").over(w("y"))
    c = c.withColumn("t", F.col("n") / total * F.ln(F.col("n") * total / (nb * ny)))
    return c.groupBy("feature").agg(F.sum("t").alias("mi"))


def anova(df: DataFrame, columns: list[str]) -> DataFrame:
    """F statistic of each feature between the classes of y."""
    g = long(df, columns, ("y",)).where("x is not null").groupBy("feature", "y").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    all_ = g.groupBy("feature").agg(F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"), F.count("*").alias("k"))
    g = g.join(all_, "feature").groupBy("feature", "nn", "k").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mm"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    return g.select("feature", F.try_divide(F.try_divide("between", F.col("k") - 1), F.nullif(F.try_divide("within", F.col("nn") - F.col("k")), F.lit(0.0))).alias("f"))


def target_correlation(df: DataFrame, columns: list[str], preferred: tuple[str, ...] = (), boost: bool = False) -> DataFrame:
    """Absolute correlation with y; boost: 1.4 times for names of prices, 1.2 times for `preferred` ones."""
    row = df.agg(*[F.abs(safe_corr(c, "y")).alias(f"r{i}") for i, c in enumerate(columns)])
    out = row.selectExpr(f"stack({len(columns)}, " + ", ".join(f"'{c}', r{i}" for i, c in enumerate(columns)) + ") as (feature, r)")
    if not boost:
        return out
    price = F.when(F.lower("feature").rlike("open|high|low|close"), 1.4).otherwise(1.0)
    return out.withColumn("r", F.col("r") * price * F.when(F.col("feature").isin(*preferred), 1.2).otherwise(1.0))


def combine(scores: DataFrame) -> DataFrame:
    """Sum over methods of score / best score, scaled to at most 1. scores: (method, feature, score)."""
    best = F.max("score").over(Window.partitionBy("method"))
    total = scores.withColumn("s", F.coalesce(F.try_divide("score", F.nullif(best, F.lit(0.0))), F.lit(0.0))).groupBy("feature").agg(F.sum("s").alias("s"))
    top = total.agg(F.max("s").alias("top"))
    return total.join(F.broadcast(top)).select("feature", F.try_divide("s", F.nullif("top", F.lit(0.0))).alias("score"))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def folds(df: DataFrame, k: int = 3, order: tuple[str, ...] = ("ts", "symbol")) -> DataFrame:
    """(fold, role, row...) of expanding ordered folds: test parts of n div (k + 1) rows, trained on all before.

    A total order over all rows is asked for; the global row number comes from per-range counts, not
    from one task.
    """
    df = numbered(df, order)
    n = df.agg(F.count("*").alias("_n"))
    df = df.join(F.broadcast(n)).withColumn("_t", F.expr(f"_n div {k + 1}"))
    df = df.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    start = F.col("_n") - (k - F.col("fold")) * F.col("_t")
    role = F.when(F.col("rn") <= start, "train").when(F.col("rn") <= start + F.col("_t"), "test")
    return df.withColumn("role", role).where("role is not null").drop("_n", "_t")


def numbered(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows with their 1-based place `rn` in the whole order: day counts first, then places within days."""
    df = df.withColumn("_day", F.to_date(order[0]))
    days = df.groupBy("_day").agg(F.count("*").alias("_c"))
    before = days.select("_day", (F.sum("_c").over(Window.orderBy("_day")) - F.col("_c")).alias("_before"))  # one row a day
    df = df.join(F.broadcast(before), "_day")
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("_day").orderBy(*order)) + F.col("_before")).drop("_day", "_before")


def split(df: DataFrame, share: float = 0.7, order: tuple[str, ...] = ("ts", "symbol")) -> DataFrame:
    df = numbered(df, order)
    n = df.agg(F.floor(F.count("*") * share).alias("_cut"))
    return df.join(F.broadcast(n)).withColumn("role", F.when(F.col("rn") <= F.col("_cut"), "train").otherwise("test")).drop("_cut")


def auc(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Area under the ROC curve by mean ranks, from counts of each distinct score."""
    c = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(y).alias("p"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    g = c.groupBy(*by).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return g.select(*by, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def confusion(df: DataFrame, by: list[str], pred: str = "pred", y: str = "y") -> DataFrame:
    n = lambda a, b: F.sum(((F.col(pred) == a) & (F.col(y) == b)).cast("double"))
    g = df.groupBy(*by).agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"), n(0, 0).alias("tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide("tp", F.col("tp") + F.col("fp"))), zero(F.try_divide("tp", F.col("tp") + F.col("fn")))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return g.select(*by, acc.alias("accuracy"), p.alias("precision"), r.alias("recall"), zero(F.try_divide(2 * p * r, p + r)).alias("f1"))


def economics(df: DataFrame, ret: str = "ret", pred: str = "pred", order: str = "ts") -> DataFrame:
    """Per symbol: total, mean per trade, trades, win rates, Sharpe, profit factor and largest drawdown of the trades taken."""
    w = Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_s", F.when(F.col(pred) == 1, F.col(ret)).otherwise(0.0))
    df = df.withColumn("_eq", F.exp(F.sum(F.when(F.col("_s") > -1, F.log1p("_s")).otherwise(-50.0)).over(w)))
    df = df.withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    taken = F.when(F.col(pred) == 1, F.col("_s"))
    g = df.groupBy("symbol").agg(
        F.sum("_s").alias("total"), F.avg(taken).alias("per_trade"), F.count(taken).alias("trades"), F.avg((F.col("_s") > 0).cast("double")).alias("win_rate_rows"),
        F.try_divide(F.sum((taken > 0).cast("double")), F.nullif(F.count(taken), F.lit(0))).alias("win_rate"),
        (F.try_divide(F.avg("_s"), F.nullif(F.stddev_samp("_s"), F.lit(0.0))) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.try_divide(F.sum(F.when(F.col("_s") > 0, F.col("_s"))), F.nullif(F.abs(F.sum(F.when(F.col("_s") < 0, F.col("_s")))), F.lit(0.0))).alias("profit_factor"), F.min("_dd").alias("max_drawdown"),
    )
    return g


def stability(df: DataFrame, columns: list[str], periods: int = 4, n: int = 8) -> DataFrame:
    """1 - std / mean of a feature's information over ordered periods; one pass for all periods."""
    df = numbered(df, ("ts", "symbol"))
    total = df.agg(F.count("*").alias("_n"))
    df = df.join(F.broadcast(total)).withColumn("period", F.least(F.expr(f"(rn - 1) div greatest(_n div {periods}, 1)"), F.lit(periods - 1)))
    rows = long(df, columns, ("period", "y")).where("x is not null")
    key = ["feature", "period"]
    cuts = quantiles(rows, key, "x", [i / n for i in range(1, n)], "cuts")
    c = rows.join(cuts, key).groupBy(*key, "y", cut_by(F.col("cuts"), F.col("x")).alias("bin")).agg(F.count("*").alias("n"))
    w = lambda *k: Window.partitionBy(*key, *k)
    all_, nb, ny = F.sum("n").over(w()), F.sum("n").over(w("bin")), F.sum("n").over(w("y"))
    mi = c.withColumn("t", F.col("n") / all_ * F.ln(F.col("n") * all_ / (nb * ny))).groupBy(*key).agg(F.sum("t").alias("mi"))
    g = mi.groupBy("feature").agg(F.count("*").alias("_k"), (1 - F.stddev_pop("mi") / (F.avg("mi") + 1e-8)).alias("stability"), F.avg("mi").alias("mean_mi"))
    return g.where("_k >= 2").drop("_k")


def rank_models(metrics: DataFrame) -> DataFrame:
    """metrics: (model, auc, f1, precision)."""
    return metrics.withColumn("score", 0.5 * F.col("auc") + 0.3 * F.col("f1") + 0.2 * F.col("precision")).orderBy(F.desc("score"), "model")
