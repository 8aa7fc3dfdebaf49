"""Secrets in texts, with corpus-wide ownership. DataFrame functions only.

Base spans come from three patterns (leftmost, not overlapping within a kind). The method adds to
them: long mixed tokens outside every base span are candidates too, and the hash of each candidate secret (of
an assignment, what is assigned) is counted over the whole corpus by distinct repositories and owners. A value that
many owners or many repositories hold is a copied example; one that few hold is live-looking. A mixed token becomes a span of
kind `owned` only if it is owner-specific; base spans stay whatever their owners, and are told
apart in n_live and n_example.

Counts go value+owner+repository, value+owner, value, each with partial sums in the map tasks, so
a value held by a third of all rows never gathers in one task; the join back is on plain exchanges,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

# Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
MIXED = r"[A-Za-z0-9+/_-]{20,}+"
PART, PIECE = 128, 4096  # matches summed together, code points redacted together
SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def _in_parts(n: Column, f) -> Column:
    """f(first index from 1) of each part of `PART` elements of an array of n."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / PART).cast("int")), lambda i: f((i * PART + 1).cast("int")))


def _spans(text: Column, pattern: str, kind: int, passes=None) -> Column:
    """Spans of all matches: match i starts after the first i + 1 pieces of split() and i matches. The lengths are summed in
    parts of `PART` matches and the parts then moved to their places, so that the work grows with the matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def place(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("base"), part["out"].alias("spans")))).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))
    parts = _in_parts(F.size(hits), lambda at: F.aggregate(F.slice(pairs, at, PART), begin, step))
    placed = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<struct<base:long,spans:{SPAN}>>").alias("out")), place, lambda acc: acc["out"])
    moved = lambda p: F.transform(p["spans"], lambda s: F.struct((s["start"] + p["base"]).alias("start"), s["kind"].alias("kind"), (s["end"] + p["base"]).alias("end"), s["value"].alias("value")))
    found = F.flatten(F.transform(placed, moved))
    if passes is not None:
        found = F.filter(found, lambda s: passes(s["value"]))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))))


def secret_scan(
    docs: DataFrame, max_owners: int = 3, max_repos: int = 6, owner_cols: tuple[str, ...] = ("source",), repo_cols: tuple[str, ...] = ("source", "lang"),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found.

    text_sha256 tells the text that the spans belong to, where an id occurs with several texts. `found` holds the spans as (start, kind number, end, value, live), in code points, sorted. Null
    and empty texts have none. Null owners and repositories count as one each. Repeated rows are
    each returned with the spans of their own text; their values are counted once per repository. A null
    id is a row like any other. Overlapping spans of different kinds all stay. Texts of any length are
    searched whole. Other columns are not read. An empty table gives an empty result.
    """
    key = lambda cols: F.md5(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(cols)])))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key(owner_cols).alias("owner"), key(repo_cols).alias("repo")
    )
    long_value = lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= 6
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9][^0-9]*[0-9]")
    text = F.col("text")
    rows = rows.select(
        "doc_id", "owner", "repo", F.sha2("text", 256).alias("text_sha256"),
        F.array_sort(F.concat(_spans(text, ASSIGN, 0, long_value), _spans(text, ACCESS, 1), _spans(text, HEX, 2))).alias("base"),
        _spans(text, MIXED, 3, mixed).alias("wide"),
    )
    clear = F.filter("wide", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    rows = common.store(rows.withColumn("wide", clear).withColumn("row", F.monotonically_increasing_id()))

    secret = F.when(F.col("s.kind") == 0, F.regexp_extract("s.value", ASSIGN, 2)).otherwise(F.col("s.value"))
    hits = rows.select("row", "owner", "repo", F.explode(F.concat("base", "wide")).alias("s")).withColumn("vh", F.sha2(secret, 256))
    owned = hits.groupBy("vh", "owner", "repo").agg(F.count("*").alias("n")).groupBy("vh", "owner").agg(F.count("*").alias("repos"))
    owned = common.cut(owned.groupBy("vh").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos")))
    live = ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("live")
    told = hits.join(owned, "vh").select("row", F.struct("s.start", "s.kind", "s.end", "s.value", live).alias("s"))
    told = told.where("s.kind < 3 or s.live").groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("found"))

    out = rows.select("row", "doc_id", "text_sha256", "base").join(told, "row", "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:long,kind:int,end:long,value:string,live:boolean>>"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    out = out.withColumn("found", found)
    return out.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"), "text_sha256", "found",
    )


def redact(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every live span replaced; spans that overlap get one mark. The text is cut into pieces of `PIECE` code points,
    each rebuilt from the spans that reach into it, so that the work grows with the text."""
    live = F.filter(found, lambda s: s["live"])
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def rebuilt(piece: Column, i: Column) -> Column:
        low = (i * PIECE).cast("long")
        high = low + F.char_length(piece)

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(piece, (acc["at"] - low + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            put = F.when((s["start"] >= acc["at"]) & (s["start"] >= low), F.lit(mark)).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], F.least(s["end"], high)).alias("at"), F.concat(acc["out"], gap, put).alias("out"))

        inside = F.filter(live, lambda s: (s["start"] < high) & (s["end"] > low))
        begin = F.struct(low.alias("at"), F.lit("").alias("out"))
        return F.aggregate(inside, begin, step, lambda acc: F.concat(acc["out"], F.substring(piece, (acc["at"] - low + 1).cast("int"), F.lit(PIECE))))

    return F.when(F.coalesce(F.size(live), F.lit(0)) > 0, F.array_join(F.transform(pieces, rebuilt), "")).otherwise(text)
