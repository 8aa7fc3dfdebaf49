"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality

    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(common.table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(common.table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(common.table(spark, sf_dir, "documents"), size=400).drop("kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring_dedup import substring_dedup

    out = substring_dedup(common.table(spark, sf_dir, "documents"), min_words=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity

    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minhash_dedup import minhash_dedup

    return minhash_dedup(common.table(spark, sf_dir, "documents"), shingle=3, similarity="0.85")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secret_scan import secret_scan

    return secret_scan(common.table(spark, sf_dir, "documents")).drop("found", "text_sha256")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import decontaminate

    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lm_score import lm_score

    return lm_score(common.table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.resample import resample

    out = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tidemark.llm.token_output import token_output

    return token_output(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.filter_audit import filter_audit

    return filter_audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("filter")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_mixing, op3_embedding_dedup, op4_suffix_dedup, op5_substring_dedup, op6_toxicity, op7_minhash_dedup, op8_secret_scan, op9_decontaminate, op10_lm_score, op11_resample, op12_token_output, op13_filter_audit, pipeline)
}


_WORDS = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept, 1.0::DOUBLE AS audit_recall
FROM v JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY 1) k ON k.a = v.vec_id""",
    "op5_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM h) WHERE c > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
u AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS k FROM d),
t AS (SELECT u.doc_id, string_agg(v, ' ' ORDER BY k) AS kept FROM u ANTI JOIN x ON x.doc_id = u.doc_id AND x.j = u.k GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM x GROUP BY 1) g ON g.doc_id = d.doc_id""",
    "op7_minhash_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = d.doc_id""",
    "op11_resample": r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, doc FROM
 (SELECT doc_id, text, true AS doc FROM documents UNION ALL SELECT item_id, text, false FROM benchmark)),
grams AS (SELECT doc_id, doc, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM low CROSS JOIN range(1, 4) r(n) WHERE len(w) >= n),
tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
said AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)),
bytes AS (SELECT g, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT)) AS b FROM said),
crc AS (SELECT g, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes CROSS JOIN tab),
f AS (SELECT doc_id, doc, bucket, count(*) AS n FROM grams JOIN crc USING (g) GROUP BY 1, 2, 3),
c AS (SELECT bucket, sum(n) FILTER (WHERE doc) AS s, sum(n) FILTER (WHERE NOT doc) AS t FROM f GROUP BY 1),
z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM c),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM c CROSS JOIN z),
v AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE doc GROUP BY 1),
d AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, substr(sha256('42:' || doc_id), 1, 8) AS h8 FROM low LEFT JOIN v USING (doc_id) WHERE doc),
h AS (SELECT *, list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', h8[i]) - 1 AS BIGINT))), lambda c, x: c * 16 + x)::DOUBLE AS h FROM d),
e AS (SELECT doc_id, able, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY able) AS m FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 5 * m // 100 THEN k END AS rank FROM k""",
    "op13_filter_audit": f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, part, x, regexp_extract_all(x, '{_WORDS}') AS w, min(doc_id) OVER (PARTITION BY x) AS first_id FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT i, substr('ABCDE', i, 1) AS c FROM range(1, 6) r(i)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM g a JOIN g b ON b.c <> a.c JOIN g c ON c.c NOT IN (a.c, b.c) JOIN g d ON d.c NOT IN (a.c, b.c, c.c) JOIN g e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
k AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
p AS (SELECT part, filter_order, list_transform([1, 2, 3, 4, 5], lambda s: fails[instr('ABCDE', substr(filter_order, s, 1))]) AS v, n, good, toxic FROM k CROSS JOIN o),
q AS (SELECT part, filter_order, step, v[step] AS bad, list_position(v, true) AS hit, list_sum(list_transform(v, lambda b: CAST(b AS INT))) AS many, n, good, toxic FROM p CROSS JOIN range(1, 6) s(step)),
m AS (SELECT part, filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS c, CAST(sum(n) FILTER (WHERE hit IS NULL OR hit > step OR hit = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE hit = step) AS BIGINT) AS removed,
 CAST(sum(n) FILTER (WHERE bad AND hit < step) AS BIGINT) AS redundant, CAST(sum(n) FILTER (WHERE bad AND many = 1) AS BIGINT) AS unique_fails,
 CAST(sum(good) FILTER (WHERE hit = step) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (WHERE hit = step) AS BIGINT) AS toxic_lost FROM q GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
 coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, c), 0) AS BIGINT) AS shapley FROM m""",
}
