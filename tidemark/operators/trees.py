"""Trees grown from histograms: randomised forests and second-order boosting.

Features become codes by their exact quantiles once. A pass over the stored codes walks each row down the trees so far and
sums its values by (tree, node, candidate feature, code) within the task; the sums are added up by key, and the driver, which only ever
holds trees * nodes * candidates * codes of them, chooses the splits. All nodes of a level (or the best leaves of a
wave) share one pass. Given a seed, trees don't depend on how rows are dealt out, but for rounding in the sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.quantiles import quantiles
from tidemark.operators.scoring import long
from tidemark.storage import store

CODES = 64


class Tree:
    """Nodes in arrays; a row goes left where its feature's code is not above the cut. Leaves have feature -1."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value, self.depth = [-1], [0], [0], [0], [0.0], [0]

    def split(self, node: int, feature: int, cut: int, left: float, right: float) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for v in (left, right):
            for a, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, v), (self.depth, self.depth[node] + 1)):
                a.append(x)
        return self.left[node], self.right[node]

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        for _ in range(max(self.depth)):
            f = feature[at]
            at = np.where(f < 0, at, np.where(codes[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]))
        return at

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(codes)]


def cuts_of(df: DataFrame, columns: list[str], codes: int = CODES) -> list[np.ndarray]:
    """Distinct quantiles of each column, in order; a code is how many of them are below the value."""
    rows = {r.feature: r.cuts for r in quantiles(long(df, columns, ()), ["feature"], "x", [i / codes for i in range(1, codes)], "cuts").collect()}  # one row a column
    return [np.unique(rows.get(c, [])) for c in columns]


def _codes(batch: pa.RecordBatch, columns: list[str], cuts: list[np.ndarray]) -> np.ndarray:
    """Nulls and NaN get the last code."""
    out = np.empty((batch.num_rows, len(columns)), np.uint8)
    for i, (c, cut) in enumerate(zip(columns, cuts)):
        x = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
        out[:, i] = np.where(np.isnan(x), len(cut), np.searchsorted(cut, x))
    return out


def coded(df: DataFrame, columns: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """(codes binary, y double), stored."""

    def run(batches):
        for b in batches:
            codes = _codes(b, columns, cuts)
            yield pa.record_batch({"codes": pa.array([r.tobytes() for r in codes], pa.binary()), "y": b.column("y")})

    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col("y").cast("double").alias("y")).where("y is not null")
    return store(numbers.mapInArrow(run, "codes binary, y double"))


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, width)
    return codes, batch.column("y").to_numpy(zero_copy_only=False)


def histograms(rows: DataFrame, trees: list[Tree], open_: list[dict[int, list[int]]], width: int, codes: int, weigh) -> dict[tuple[int, int], np.ndarray]:
    """For each tree's open node: sums (candidate, code, value), where open_ gives the node's candidate features and
    weigh(codes, y) the values of each row: an array (values, rows)."""
    most = max((len(c) for o in open_ for c in o.values()), default=0)
    places = [(t, n) for t, o in enumerate(open_) for n in sorted(o)]
    index = {p: i for i, p in enumerate(places)}
    values = weigh(np.zeros((0, width), np.uint8), np.zeros(0)).shape[0]

    def run(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _matrix(b, width)
            v, at = weigh(x, y), np.arange(len(x))
            total = np.zeros((values, len(places) * most * codes)) if total is None else total
            for t, o in enumerate(open_):
                if not o:
                    continue
                size = len(trees[t].feature)
                slot, cand = np.full(size, -1), np.zeros((size, most), np.int64)
                for n, c in o.items():
                    slot[n], cand[n, : len(c)] = index[t, n], c
                leaf = trees[t].leaf(x)
                here = np.flatnonzero(slot[leaf] >= 0)
                s, leaf = slot[leaf[here]], leaf[here]
                for j in range(most):
                    key = (s * most + j) * codes + x[at[here], cand[leaf, j]]
                    for i in range(values):
                        total[i] += np.bincount(key, v[i][here], total.shape[1])
        if total is not None:
            some = np.flatnonzero(np.abs(total).sum(axis=0))
            yield pa.record_batch({"key": pa.array(some), **{f"v{i}": pa.array(total[i][some]) for i in range(values)}})

    schema = "key long, " + ", ".join(f"v{i} double" for i in range(values))
    sums = rows.mapInArrow(run, schema).groupBy("key").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(values)]).toArrow()
    out = np.zeros((values, len(places) * most * codes))
    key = sums.column("key").to_numpy()
    for i in range(values):
        out[i][key] = sums.column(f"v{i}").to_numpy()
    out = out.reshape(values, len(places), most, codes)
    return {p: out[:, i, : len(open_[p[0]][p[1]])] for i, p in enumerate(places)}


def _gini(n, a):
    p = np.divide(a, n, out=np.zeros_like(a, dtype=float), where=n > 0)
    return n * 2 * p * (1 - p)


def extra_trees(train: DataFrame, columns: list[str], trees: int = 20, depth: int = 6, least: int = 10, seed: int = 42, codes: int = CODES) -> tuple[list[Tree], list[np.ndarray]]:
    """Trees whose nodes draw sqrt(columns) features and for each one threshold, evenly between the node's least and largest value
    (to the next quantile), and take the one that lowers the Gini impurity most. Nodes with fewer than `least` rows stay leaves."""
    cuts = cuts_of(train, columns, codes)
    rows = coded(train, columns, cuts)
    many = max(1, int(len(columns) ** 0.5))
    forest = [Tree() for _ in range(trees)]
    draw = lambda t, n: np.random.default_rng([seed, t, n])
    pick = lambda t, n: sorted(draw(t, n).permutation(len(columns))[:many].tolist())
    open_ = [{0: pick(t, 0)} for t in range(trees)]
    for _ in range(depth):
        if not any(open_):
            break
        found = histograms(rows, forest, open_, len(columns), codes, lambda x, y: np.stack([np.ones(len(y)), y]))
        after: list[dict[int, list[int]]] = [{} for _ in forest]
        for (t, node), (n, a) in found.items():
            rng, total, ones, best = draw(t, node), n[0].sum(), a[0].sum(), None
            rng.permutation(len(columns))
            forest[t].value[node] = ones / total if total else 0.0
            if total < least or ones in (0, total):
                continue
            for f, nn, aa in zip(open_[t][node], n, a):
                u, held = rng.random(), np.flatnonzero(nn)
                if len(held) < 2:
                    continue
                edge = cuts[f][held[0] : held[-1]]  # borders between the node's least and largest code
                cut = int(held[0] + min(np.searchsorted(edge, edge[0] + u * (edge[-1] - edge[0])), len(edge) - 1))
                left = nn[: cut + 1].sum(), aa[: cut + 1].sum()
                gain = _gini(total, ones) - _gini(*map(np.float64, left)) - _gini(total - left[0], ones - left[1])
                if 0 < left[0] < total and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, cut, left)
            if best:
                _, f, cut, (ln, la) = best
                for child in forest[t].split(node, f, cut, la / ln, (ones - la) / (total - ln)):
                    after[t][child] = pick(t, child)
        open_ = after
    return forest, cuts


def boosted(
    train: DataFrame, columns: list[str], rounds: int = 10, leaves: int = 16, depth: int = 4, rate: float = 0.1, ridge: float = 1.0, penalty: float = 0.0, least: float = 1.0, codes: int = CODES,
) -> tuple[list[Tree], list[np.ndarray], float]:
    """Logistic boosting by gradients and Hessians: the gain of a split is G^2 / (H + ridge) of its sides less that of the whole, less
    `penalty`; leaves are -rate * G / (H + ridge). Of all open leaves the best by gain are split first, until there are
    `leaves`; a side needs `least` of Hessian. Returns the trees, the cuts and the first log odds."""
    cuts = cuts_of(train, columns, codes)
    rows = coded(train, columns, cuts)
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    share = min(max((ones or 0.0) / max(n, 1), 1e-6), 1 - 1e-6)
    first, done = float(np.log(share / (1 - share))), []
    every = list(range(len(columns)))
    for _ in range(rounds):
        tree, before = Tree(), list(done)

        def weigh(x, y):
            p = 1 / (1 + np.exp(-sum((t.values(x) for t in before), np.full(len(y), first))))
            return np.stack([p - y, p * (1 - p)])

        open_, waiting, count = {0: every}, {}, 1
        while open_ and count < leaves:
            for (_, node), (g, h) in histograms(rows, [tree], [open_], len(columns), codes, weigh).items():
                gt, ht = g[0].sum(), h[0].sum()
                gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                gain = 0.5 * (gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)) - penalty
                gain = np.round(np.where((hl >= least) & (ht - hl >= least), gain, -np.inf), 9)
                tree.value[node] = -rate * gt / (ht + ridge)
                f, c = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, c] > 1e-9 and tree.depth[node] < depth:
                    waiting[node] = (gain[f, c], int(f), int(c), gl[f, c], hl[f, c], gt, ht)
            best = sorted(waiting, key=lambda k: (-waiting[k][0], k))[: max(1, min(leaves - count, (len(waiting) + 1) // 2 if count > 2 else len(waiting)))]
            open_ = {}
            for node in best:
                _, f, c, gl, hl, gt, ht = waiting.pop(node)
                for child in tree.split(node, f, c, -rate * gl / (hl + ridge), -rate * (gt - gl) / (ht - hl + ridge)):
                    open_[child] = every
                count += 1
        if len(tree.feature) == 1:
            break
        done.append(tree)
    return done, cuts, first


def scored(test: DataFrame, columns: list[str], trees: list[Tree], cuts: list[np.ndarray], first: float | None = None) -> DataFrame:
    """The test rows with `score`: the mean of the trees' values, or, with a start, the chance that their sum makes."""
    names, kinds = test.columns, test.schema

    def run(batches):
        for b in batches:
            x = _codes(b, [f"_{c}" for c in columns], cuts)
            total = sum((t.values(x) for t in trees), np.zeros(len(x)))
            score = total / max(len(trees), 1) if first is None else 1 / (1 + np.exp(-(total + first)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(score)], [*names, "score"])

    wide = test.select("*", *[F.col(c).cast("double").alias(f"_{c}") for c in columns])
    return wide.mapInArrow(run, StructType([*kinds.fields, StructField("score", DoubleType())]))
