"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.annulus import cluster_report
from pairloom.llm.common import fold, table, tokenizer_path
from pairloom.llm.covertree import near_vectors
from pairloom.llm.hilbert import hilbert_shards, law_column
from pairloom.llm.langid import predict_language, train_language_model
from pairloom.llm.mixing import mix_sources
from pairloom.llm.packing import pack_documents
from pairloom.llm.partenum import jaccard_components
from pairloom.llm.pieces import encode_digests
from pairloom.llm.pii import find_spans, train_spans
from pairloom.llm.quality import predict_quality, train_quality
from pairloom.llm.spann import nearest
from pairloom.llm.toxicity import predict_toxicity, train_toxicity
from pairloom.llm.turntrie import prefix_trie


def op1_fuzzy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    model = train_toxicity(docs, learn)
    out = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), predict_toxicity(docs, model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), room=150_000)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op5_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    model = train_language_model(learn)
    out = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), predict_language(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_cover_tree_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", find_spans(docs, train_spans(docs)).alias("p"))
    return found.select("doc_id", *(f"p.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", law_column().alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    weights = train_quality(docs, learn)
    out = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), predict_quality(docs, weights).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_piece_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: crc32 of a decimal text, bit by bit
CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({x}, ''), lambda s: ascii(s)::BIGINT)), lambda a, s: list_reduce(list_prepend(xor(a, s), range(8)), lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)), 4294967295)"
TRIE_SQL = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
cv AS (SELECT DISTINCT c, {CRC32.format(x="c::VARCHAR")} % 4 AS h FROM t),
r AS (SELECT cv.c, 0 AS own, p, role, txt FROM cv JOIN t ON t.c = cv.c - cv.c % 20 AND p <= h UNION ALL SELECT c, 1, p, role, txt FROM cv JOIN t USING (c) WHERE p > h),
l AS (SELECT cv.c, coalesce(list(struct_pack(role, txt) ORDER BY own, p) FILTER (WHERE txt IS NOT NULL), []) AS turns FROM cv LEFT JOIN r USING (c) GROUP BY 1),
pre AS (SELECT c, len(turns) AS length, d, list_slice(turns, 1, d) AS k FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM l)),
n AS (SELECT min(c) AS conv_id, d AS depth, k, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE length = d), '')) AS ends_sha256, CASE WHEN d > 0 THEN len(regexp_extract_all(k[d].txt, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS w FROM pre GROUP BY d, k),
up AS (SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.k = list_slice(n.k, 1, n.depth - 1)),
ch AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (conv_id, depth)),
s AS (SELECT a.conv_id, a.depth, sum((b.n_children = 0)::INT)::BIGINT AS n_leaves, sum((b.n_convs - 1) * b.w)::BIGINT AS saved_tokens FROM f a JOIN f b ON b.depth >= a.depth AND list_slice(b.k, 1, a.depth) = a.k GROUP BY 1, 2)
SELECT f.conv_id, f.depth, parent_conv_id, n_convs, f.n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN s USING (conv_id, depth) JOIN up USING (conv_id, depth)"""


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    ok = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    sql = f"WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {ok}), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k}))"
    for i in range(rounds + 1):
        sql += f", a{i} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min(struct_pack(d, c)) AS near FROM (SELECT vec_id, v.q, c, list_sum(list_transform(list_zip(v.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i} m) GROUP BY 1)"
        if i < rounds:
            sql += f", u{i} AS (SELECT c, list(x ORDER BY pos) AS q FROM (SELECT c, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT near.c AS c, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM a{i}) GROUP BY 1, 2) GROUP BY 1), c{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(u.q, m.q) AS q FROM c{i} m LEFT JOIN u{i} u USING (c))"
    return sql + f" SELECT vec_id, near.c::INT AS cluster, near.d::BIGINT AS distance, (sum(near.d) OVER (PARTITION BY near.c))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} m ON m.c = a.near.c"


def oracle_sql() -> dict[str, str]:
    return {"op11_turn_trie": TRIE_SQL, "op13_annulus_clusters": clusters_sql()}
