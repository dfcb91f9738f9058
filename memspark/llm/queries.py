"""Registered queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import alignment, common, cross_polytope, dual_tree, fingerprints, jaccard, langid, main_text, mixing, packing, sharding, token_counts, toxicity, warc

Q: dict = {}
SQL: dict = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards whose row counts differ by one at most."""
    placed = sharding.shard(common.table(spark, sf_dir, "documents"), "doc_id", "text", 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "home_shard")


@query
def op2_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, "html").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op3_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return cross_polytope.search(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


@query
def op4_multi_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.join(common.table(spark, sf_dir, "documents"), "doc_id", "text", words=4, percent=85)
    return joined.select("doc_id", "n_shingles", "component_id")


SQL["op4_multi_match_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS z FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.z),
k AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""


@query
def op5_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL["op5_fair_queue_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || doc_id) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n
       FROM d GROUP BY source),
s1 AS (SELECT *, (n % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS lim FROM s0),
s2 AS (SELECT *, lim / weight AS full_at FROM s1),
s3 AS (SELECT *, row_number() OVER o AS k,
         ((SELECT sum(source_size) FROM s0) - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
       FROM s2 WINDOW o AS (ORDER BY full_at, n)),
lv AS (SELECT arg_min(share, k) AS v FROM s3 WHERE share <= full_at),
s AS (SELECT source, source_size, weight, least(lim, weight * coalesce((SELECT v FROM lv), 0)) AS target FROM s3),
q AS (SELECT d.*, s.source_size, s.weight, s.target,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS fin
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t AS (SELECT doc_id, size, sum(size) OVER (
             ORDER BY (e * source_size + fin)::DOUBLE / weight, source NULLS FIRST, h, doc_id ROWS UNBOUNDED PRECEDING) AS run
      FROM q, range(3) r(e) WHERE size > 0),
c AS (SELECT doc_id, count(*) FILTER (run <= (SELECT sum(size) FROM d)) AS copies FROM t GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(copies, 0) * q.size)::BIGINT AS taken,
       coalesce(copies, 0)::INTEGER AS copies
FROM q LEFT JOIN c USING (doc_id)"""


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op6_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    remainder = common.id_remainder(F.col("doc_id"), 4)
    model = langid.fit(docs, "doc_id", "text", "lang", piece_vocabulary(), remainder != 2)
    return docs.select("doc_id", (remainder == 2).alias("held_out"), langid.predict(model, F.col("text")).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str, learn) -> toxicity.Model:
    """Fitted on the documents for which ``learn`` (a condition on doc_id) holds."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.fit(docs, "doc_id", "text", labels, "toxic", learn)


@query
def op7_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    remainder = common.id_remainder(F.col("doc_id"), 5)
    model = toxicity_model(spark, docs, sf_dir, remainder > 0)
    return docs.select("doc_id", (remainder == 0).alias("held_out"), toxicity.score(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op8_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(common.table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, "text", piece_vocabulary()).select("doc_id", "n_tokens", "n_pretokens")


@query
def op10_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), "doc_id", "text", packing.default_vocabulary())


@query
def op11_salvage_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.through_archives(pages, "page_id", "url", "html").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op11_salvage_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
             min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(common.table(spark, sf_dir, "documents"), "doc_id", "text",
                           public_tokenizers.path("byte_bpe_50k.json"), piece_vocabulary())


@query
def op13_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.compress(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def _codes_sql(rounds: int = 6) -> str:
    """Lloyd's rounds as a chain of common table expressions, for vectors whose length is a multiple of eight."""
    steps = ["""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v,
  row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """comp AS (SELECT vec_id, place, p, i, v[p * (len(v) // 8) + i + 1] AS x
  FROM kept, range(8) a(p), range((SELECT max(len(v)) // 8 FROM kept)) b(i))""",
             "c0 AS (SELECT p, place AS e, i, x AS y FROM comp WHERE place < 16)"]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (SELECT vec_id, p, min(d * 16 + e) AS best FROM (SELECT vec_id, p, e, sum((x - y) * (x - y))::BIGINT AS d
  FROM comp JOIN c{k} USING (p, i) GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS (SELECT p, e, i, coalesce(z, y) AS y FROM c{k} LEFT JOIN (SELECT p, best % 16 AS e, i,
  floor(sum(x)::DOUBLE / count(*))::BIGINT AS z FROM comp JOIN a{k} USING (vec_id, p) GROUP BY ALL) USING (p, e, i))""")
    return "WITH " + ",\n".join(steps) + f""",
r AS (SELECT vec_id, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, sum(best // 16)::BIGINT AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM r JOIN kept USING (vec_id), h"""


SQL["op13_dual_tree_codes"] = _codes_sql()
