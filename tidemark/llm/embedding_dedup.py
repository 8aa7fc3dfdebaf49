"""Near-duplicate embeddings by NN-descent on a neighbour graph.

1. Equal vectors are one class; a class's weight is its number of rows.
2. Start: in each of several tables random hyperplanes cut the classes into blocks. A task compares a block's classes and returns each one's `k` nearest.
3. Refinement: the lists in both directions form neighbourhoods; the neighbours around a class are
   compared with each other in the task that holds them, and pairs that would enter either's list
   come out. Each class keeps its k nearest; `rounds` rounds.
4. Each comparison of 2 and 3 also gives a spanning forest of its links, apart from the lists, so no
   link that was compared is lost for want of a place in a list. Forests and lists give components.
5. A list whose k neighbours are all within the threshold is saturated: more links may exist. Inside
   its component they are all counted, as members are compared in blocks. Outside it, each saturated
   list is doubled by its k nearest members of other components with saturated lists (a class whose
   list has a free place holds its links itself), and both halves are compared with each other. Links
   join components; this goes on with new hyperplanes until no doubled list holds a link.
6. Audit: a fixed number of classes is compared with all others, in blocks. A vector's recall is the
   share of its links that the lists alone put into its component; the score is the least of the means
   over the vectors in and outside the largest component, so a hot group can't hide the others. While
   it is below `recall`, twice as many tables with new hyperplanes and a round of refinement follow;
   after `retries` times the operator fails. The audit's links are added as edges afterwards.

The number of tables grows with the number of hyperplanes: a pair at the threshold, alone, shares a block
with a probability of 1 - (1 - recall) / 2 before refinement, and `tables` is the least. Blocks above
`block` are cut by as many more hyperplanes as they need, and by a hash only where those leave them whole.

Cosines are in double precision on full vectors. No group is unbounded: blocks and component blocks are
split, lists are cut to k or 2k. Components are joined by alternating large-star and small-star.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import components


def _units(dim: int):
    """Unit vectors as bytes with a digest of the original; none for vectors that link with nothing."""

    def run(batches):
        for b in batches:
            units, keys = [], []
            for v in b.column("v").to_pylist():
                x = np.zeros(dim)
                good = v is not None and len(v) > 0 and None not in v
                if good:
                    x[: len(v)] = v
                    norm = np.sqrt((x / max(np.abs(x).max(), 1e-300)) @ x * max(np.abs(x).max(), 1e-300)) if np.isfinite(x).all() else 0.0
                    good = bool(np.isfinite(norm) and norm > 0)
                units.append((x / norm).tobytes() if good else None)
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if good else None)
            yield pa.record_batch({"vec_id": b.column("vec_id"), "key": pa.array(keys, pa.binary()), "unit": pa.array(units, pa.binary())})

    return run


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


SPARE = 20  # hyperplanes kept for cutting blocks that are too large


def _bits(n: int) -> int:
    return max(1, min(30, int(np.ceil(np.log2(max(2, n / 48))))))


def _tables(bits: int, tables: int, recall: float, threshold: float) -> int:
    """Tables that put a pair at the threshold into one block with probability 1 - (1 - recall) / 2, `tables` at least."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    miss = min(max((1 - recall) / 2, 1e-6), 0.5)
    return tables if together >= 1 else max(tables, int(np.ceil(np.log(miss) / np.log1p(-together))))


def _hashed(tables: int, bits: int, dim: int, seed: int):
    """One row a table: code of `bits` hyperplanes and `fine` of SPARE others."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("unit").to_pylist())
            for t in range(tables):
                planes = np.random.default_rng([seed, t]).standard_normal((dim, bits + SPARE))
                sign = (x @ planes > 0).astype(np.int64)
                code, fine = sign[:, :bits] @ (1 << np.arange(bits)), sign[:, bits:] @ (1 << np.arange(SPARE))
                yield pa.record_batch({"t": pa.array(np.full(b.num_rows, t, np.int32)), "code": pa.array(code), "fine": pa.array(fine), "id": b.column("id"), "c": b.column("c"), "unit": b.column("unit")})

    return run


def _forest(link: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of a symmetric matrix of links that join whatever the links join, at most one a row."""
    left, pairs = link.any(axis=1), []
    while left.any():
        todo = [int(left.argmax())]
        left[todo] = False
        while todo and left.any():
            i = todo.pop()
            new = np.flatnonzero(link[i] & left).tolist()
            left[new] = False
            pairs += [(i, j) for j in new]
            todo += new
    return np.array(pairs, np.int64).reshape(-1, 2)


def _nearest(k: int, threshold: float):
    """Each class's k nearest of other components (c) in the block, and a forest of the block's links."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, c, x = rows["id"].to_numpy(), rows["c"].to_numpy(), _matrix(rows["unit"].tolist())
        out, n = [], min(k, len(ids) - 1)
        link = np.zeros((len(ids), len(ids)), bool)
        for at in range(0, len(ids) if n > 0 else 0, 256):
            sim = x[at : at + 256] @ x.T
            sim[c[at : at + 256, None] == c[None, :]] = -2
            link[at : at + 256] = sim >= threshold
            top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
            out.append(pd.DataFrame({"a": np.repeat(ids[at : at + 256], n), "b": ids[top.ravel()], "sim": np.take_along_axis(sim, top, 1).ravel(), "tie": False}))
        i, j = _forest(link | link.T).T
        out.append(pd.DataFrame({"a": ids[i], "b": ids[j], "sim": (x[i] * x[j]).sum(axis=1), "tie": True}))
        out = pd.concat(out)
        return out[out["sim"] > -1.5].astype({"tie": bool})

    return run


def _around(threshold: float):
    """Compare the members of each neighbourhood; batches hold whole neighbourhoods as lists."""

    def run(batches):
        for b in batches:
            for ids, units, worst in zip(b.column("ids").to_pylist(), b.column("units").to_pylist(), b.column("worst").to_pylist()):
                ids, x, worst = np.array(ids), _matrix(units), np.array(worst)
                sim = x @ x.T
                other = ids[:, None] != ids[None, :]
                i, j = np.nonzero(np.triu((sim > np.minimum(worst[:, None], worst[None, :])) & other, 1))
                u, v = _forest((sim >= threshold) & (sim.T >= threshold) & other).T
                if len(i) or len(u):
                    tie = np.arange(len(i) + len(u)) >= len(i)
                    i, j = np.append(i, u), np.append(j, v)
                    yield pa.record_batch({"a": pa.array(ids[i]), "b": pa.array(ids[j]), "sim": pa.array(sim[i, j]), "tie": pa.array(tie)})

    return run


EDGES = "a long, b long, sim double, tie boolean"


def _top(edges: DataFrame, k: int) -> DataFrame:
    """Each class's k nearest of (a, b, sim, tie), each neighbour once (listed), and the ties beyond them."""
    edges = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("tie").alias("tie"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return edges.withColumn("listed", nth <= k).where("listed or tie")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "sim", "tie").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "tie"))


def _blocks(classes: DataFrame, n: int, dim: int, tables: int, k: int, block: int, seed: int, recall: float, threshold: float) -> DataFrame:
    """Comparisons within the blocks of (id, c, unit); members of one component c are not compared."""
    bits = _bits(n)
    cut = classes.mapInArrow(_hashed(_tables(bits, tables, recall, threshold), bits, dim, seed), "t int, code long, fine long, id long, c long, unit binary")
    # the more members, the more of the spare hyperplanes
    size = cut.groupBy("t", "code").agg(F.greatest(F.lit(0), F.least(F.lit(SPARE), F.ceil(F.log2(F.count("*") / block)))).cast("int").alias("more"))
    cut = cut.join(common.cut(size), ["t", "code"]).withColumn("fine", F.expr("fine % shiftleft(1L, more)"))
    size = cut.groupBy("t", "code", "fine").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.col("parts")).alias("part")
    cut = cut.join(common.cut(size), ["t", "code", "fine"]).select("t", "code", "fine", part, "id", "c", "unit")
    return cut.groupBy("t", "code", "fine", "part").applyInPandas(_nearest(k, threshold), EDGES)


def _compared(near: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """What the neighbours b of each a of `near` are to each other; `held` has (b, unit, worst)."""
    around = near.select("a", "b").join(held, "b").groupBy("a").agg(F.collect_list(F.struct("b", "unit", "worst")).alias("m")).where(F.size("m") > 1)
    around = around.select(F.col("m.b").alias("ids"), F.col("m.unit").alias("units"), F.col("m.worst").alias("worst"))
    return _both(around.mapInArrow(_around(threshold), EDGES))


def _refine(lists: DataFrame, classes: DataFrame, k: int, threshold: float) -> DataFrame:
    worst = lists.where("listed").groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    held = classes.select(F.col("id").alias("b"), "unit").join(worst.withColumnRenamed("a", "b"), "b")
    near = _top(_both(lists.where("listed")), 2 * k).where("listed")
    return common.store(_top(lists.select("a", "b", "sim", "tie").union(_compared(near, held, threshold)), k))


def _linked(lists: DataFrame, threshold: float) -> DataFrame:
    return lists.where(F.col("sim") >= threshold).select("a", "b")


def _enlarge(lists: DataFrame, classes: DataFrame, dim: int, tables: int, k: int, block: int, seed: int, recall: float, threshold: float) -> DataFrame:
    """The lists and what joins their components: saturated lists doubled until none holds a link outside its component."""
    full = common.cut(lists.where(F.col("listed") & (F.col("sim") >= threshold)).groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") >= k).select(F.col("a").alias("id")))
    n = full.count()
    held = classes.join(full, "id")
    own = lists.where("listed").join(full.withColumnRenamed("id", "a"), "a", "left_semi")
    while n:
        comp = common.cut(components(_linked(lists, threshold), "a", "b").select(F.col("node").alias("id"), F.col("component_id").alias("c")))
        seed += 1
        out = common.store(_top(_blocks(held.join(comp, "id"), n, dim, tables, k, block, 7919 * seed, recall, threshold), k))
        near = own.select("a", "b").union(out.where("listed").select("a", "b")).distinct()
        met = _compared(near, classes.select(F.col("id").alias("b"), "unit", F.lit(2.0).alias("worst")), threshold)
        new = out.select("a", "b", "sim", "tie").union(met).where(F.col("sim") >= threshold)
        side = lambda x: comp.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"))
        new = new.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")
        new = common.store(new.groupBy("a", "b").agg(F.max("sim").alias("sim")))
        if new.isEmpty():
            break
        lists = common.store(lists.union(new.select("a", "b", "sim", F.lit(True).alias("tie"), F.lit(False).alias("listed"))))
    return lists


def _against(shared, threshold: float):
    """Links of the audited classes with each row."""

    def run(batches):
        ids, x = shared.value
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            mine = b.column("id").to_numpy()
            y = _matrix(b.column("unit").to_pylist())
            for at in range(0, len(y), 1024):
                i, j = np.nonzero(y[at : at + 1024] @ x.T >= threshold)
                other = mine[at + i] != ids[j]
                yield pa.record_batch({"a": pa.array(ids[j][other]), "b": pa.array(mine[at + i][other])})

    return run


def _score(known: DataFrame, comp: DataFrame, true: DataFrame) -> float:
    """Mean recall of the audited vectors a of `known`, in the largest component and outside it; the lower one."""
    side = lambda x: comp.select(F.col("node").alias(x), F.col("component_id").alias(f"c{x}"))
    each = known.join(side("a"), "a", "left").join(side("b"), "b", "left")
    each = each.groupBy("a").agg(F.avg(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("double")).alias("hit"))
    true = common.cut(true)
    hot = true.groupBy("component_id").count().orderBy(F.desc("count"), "component_id").first()
    means = each.join(true, each.a == true.node).groupBy(F.col("component_id") == F.lit(hot.component_id if hot else None)).agg(F.avg("hit").alias("mean")).collect()
    return min((r["mean"] for r in means), default=1.0)


def _links(threshold: float):
    """Weighted link counts between two blocks of a component (i <= j), or within one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, w, ids, own = _matrix(rows["unit"].tolist()), rows["w"].to_numpy(), rows["id"].to_numpy(), rows["own"].to_numpy()
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        if not same:
            link &= own[:, None] != own[None, :]
        return pd.DataFrame({"id": ids, "links": link @ w})

    return run


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.95, k: int = 8, tables: int = 8, rounds: int = 2, block: int = 512, recall: float = 0.99, retries: int = 3,
    audited: int = 1000, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id, kept, audit_recall.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; they
    are their own component and kept. Shorter vectors count as padded with zeros. Repeated rows share
    an id but count as vectors of their own. A null id has no component id. Other columns are not
    read. An empty table gives an empty result. Fails if the audit's recall stays below `recall`.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = common.store(rows.mapInArrow(_units(max(dim, 1)), "vec_id long, key binary, unit binary"))
    classes = rows.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("unit").alias("unit"))
    classes = common.store(classes)
    n = classes.count()
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audit_recall"))
    bare = classes.select("id", "unit")
    lists = common.store(_top(_blocks(bare.select("id", F.col("id").alias("c"), "unit"), n, dim, tables, k, block, 1, recall, threshold), k))
    for _ in range(rounds):
        lists = _refine(lists, bare, k, threshold)
    lists = _enlarge(lists, bare, dim, tables, k, block, 1, recall, threshold)

    picked = bare.where(F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(max(1, n // audited))) == 0).toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((picked.column("id").to_numpy(), _matrix(picked.column("unit").to_pylist()) if picked.num_rows else np.zeros((0, dim))))
    known = common.cut(bare.mapInArrow(_against(shared, threshold), "a long, b long"))
    seed = 1
    while True:
        edges = _linked(lists, threshold).union(known)
        comp = common.cut(components(_linked(lists, threshold), "a", "b"))
        score = _score(known, comp, components(edges, "a", "b"))
        if score >= recall:
            break
        if seed > retries:
            raise RuntimeError(f"audit: recall {score:.4f} of the links is below {recall} after {retries} retries; raise tables, k or retries")
        seed += 1
        tables = 2 * _tables(_bits(n), tables, recall, threshold)
        more = _blocks(bare.select("id", F.col("id").alias("c"), "unit"), n, dim, tables, k, block, seed, recall, threshold)
        lists = common.store(_top(lists.select("a", "b", "sim", "tie").union(more), k))
        lists = _enlarge(_refine(lists, bare, k, threshold), bare, dim, tables, k, block, seed, recall, threshold)
    comp = common.cut(components(edges, "a", "b"))

    members = classes.join(comp, classes.id == comp.node).select("id", "w", "unit", "component_id")
    size = common.cut(members.groupBy("component_id").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    members = members.join(size, "component_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("component_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "w", "unit")
    links = members.groupBy("component_id", "i", "j").applyInPandas(_links(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    known_of = classes.select("key", "id", "w").join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    out = rows.select("vec_id", "key").join(known_of, "key", "left")
    whole = F.coalesce("component_id", "id", "vec_id")
    n_links = F.when(F.col("vec_id").isNull() | F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("w") - 1)
    return out.select("vec_id", n_links.cast("long").alias("n_links"), whole.alias("component_id"), F.coalesce(F.col("vec_id") == whole, F.lit(True)).alias("kept"), F.lit(float(score)).alias("audit_recall"))
