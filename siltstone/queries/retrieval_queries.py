"""Queries of the keyword index, vector search, fusion and context packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import models
from siltstone.operators import index, leakage, ledger, retrieval
from siltstone.queries.text_queries import keyword_tokens, norm

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TERMS = f"""WITH tok AS MATERIALIZED (SELECT doc_id, {keyword_tokens('text')} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS dl FROM tok),
 post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, n GROUP BY term),
 idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
"""
BM25 = f"""{TERMS}, q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({keyword_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
 bm AS (SELECT query_id, doc_id, CAST(floor(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) * 1000000 + 0.5) AS BIGINT) AS score_millionths FROM q JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), n GROUP BY ALL HAVING sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) > 0),
 top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_millionths DESC, doc_id) AS rank FROM bm)
"""


@query(TERMS + "SELECT term, df, CAST(floor(idf * 1e6 + 0.5) AS BIGINT) AS idf_millionths FROM idf")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(table(spark, sf_dir, "documents")).terms.select("term", "df", F.floor(F.col("idf") * 1e6 + 0.5).cast("long").alias("idf_millionths"))


#: Some documents go and others are amended: what SQL sees is the table as it is then.
AMENDED_TERMS, AMENDED = (sql.replace("FROM documents", "FROM amended").replace("WITH tok", "WITH amended AS (SELECT doc_id, CASE WHEN doc_id % 50 = 8 THEN text || ' amended addendum' ELSE text END AS text FROM documents WHERE doc_id % 50 <> 7), tok") for sql in (TERMS, BM25))


def _amended(spark: SparkSession, sf_dir: str):
    """The knowledge base of all documents, written, then changed by a segment."""
    from siltstone.plans import ingest
    from siltstone.tables import shared_dir

    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), F.coalesce("text", F.lit("")).alias("content"), F.lit(False).alias("is_table"))
    docs = docs.withColumn("sha256", F.sha2("content", 256))
    path = f"{shared_dir(spark)}/amended-{uuid.uuid4().hex}"
    ingest.write_version(docs, path, {})
    store = ingest.Store.open(spark, path)
    fresh = docs.filter("doc_id % 50 = 8").withColumn("content", F.concat("content", F.lit(" amended addendum")))
    ingest.replace(store, fresh, store.chunks.filter("doc_id % 50 in (7, 8)"), {})
    return ingest.Store.open(spark, path).index


@query(AMENDED_TERMS + "SELECT term, df, CAST(floor(idf * 1e6 + 0.5) AS BIGINT) AS idf_millionths FROM idf")
def amended_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amended(spark, sf_dir).terms.select("term", "df", F.floor(F.col("idf") * 1e6 + 0.5).cast("long").alias("idf_millionths"))


@query(AMENDED + "SELECT query_id, doc_id, score_millionths, rank FROM top WHERE rank <= 10")
def amended_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.top_k(asked, _amended(spark, sf_dir), 10).select("query_id", "doc_id", "score_millionths", "rank")


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.top_k(asked, index.build(table(spark, sf_dir, "documents")), k).select("query_id", "doc_id", "score_millionths", "rank")


@query(BM25 + "SELECT query_id, doc_id, score_millionths, rank FROM top WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10)


def _grams(x: str) -> str:
    """Character 5-grams of text that is normalised and without spaces; cut as windows of the string's characters."""
    return f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < 5 THEN [{x}] ELSE list_distinct(list_transform(list_zip(string_split({x}, ''), string_split(substr({x}, 2), ''), string_split(substr({x}, 3), ''), string_split(substr({x}, 4), ''), string_split(substr({x}, 5), ''))[1:length({x}) - 4], lambda g: g[1] || g[2] || g[3] || g[4] || g[5])) END"


AUDIT = BM25 + f""", pool AS (SELECT query_id, doc_id, score_millionths FROM top WHERE rank <= 50), qn AS MATERIALIZED (SELECT item_id AS query_id, {norm('text')} AS q_norm FROM benchmark), qs AS MATERIALIZED (SELECT query_id, q_norm, {_grams("replace(q_norm, ' ', '')")} AS q_grams FROM qn),
 dn AS MATERIALIZED (SELECT doc_id, {norm('text')} AS d_norm FROM documents WHERE doc_id IN (SELECT doc_id FROM pool)), ds AS MATERIALIZED (SELECT doc_id, d_norm, {_grams("replace(d_norm, ' ', '')")} AS d_grams FROM dn),
 m AS (SELECT query_id, doc_id, score_millionths, q_norm <> '' AND d_norm <> '' AND (contains(d_norm, q_norm) OR contains(q_norm, d_norm)) AS exact, len(list_intersect(q_grams, d_grams)) AS i, len(q_grams) + len(d_grams) AS s FROM pool JOIN qs USING (query_id) JOIN ds USING (doc_id)),
 j AS (SELECT query_id, doc_id, score_millionths, exact, CASE WHEN s - i = 0 THEN 1.0 ELSE i / (s - i) END AS jaccard FROM m),
 r AS (SELECT *, bool_or(exact) OVER (PARTITION BY query_id) OR max(jaccard) OVER (PARTITION BY query_id) >= 0.75 AS suspected, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, jaccard DESC, score_millionths DESC, doc_id) AS rank FROM j)
"""


@query(AUDIT + "SELECT query_id, doc_id, score_millionths, exact, jaccard, suspected, rank FROM r WHERE rank <= 5")
def leakage_audit_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leakage_audit(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(AUDIT + "SELECT query_id, max(jaccard) AS best_jaccard, bool_or(exact) AS exact FROM r WHERE suspected AND rank <= 5 GROUP BY query_id")
def leakage_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leakage.leakage_audit(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return rows.filter("suspected").groupBy("query_id").agg(F.max("jaccard").alias("best_jaccard"), F.max("exact").alias("exact"))


#: Grams in rows, as all pairs of questions and documents meet by what they share.
LEAKS = f"""WITH q AS MATERIALIZED (SELECT item_id AS query_id, {norm('text')} AS q FROM benchmark), d AS MATERIALIZED (SELECT doc_id, {norm('text')} AS d FROM documents),
 qg AS MATERIALIZED (SELECT query_id, unnest({_grams("replace(q, ' ', '')")}) AS g FROM q), dg AS MATERIALIZED (SELECT doc_id, unnest({_grams("replace(d, ' ', '')")}) AS g FROM d),
 qn AS (SELECT query_id, count(*) AS qn FROM qg GROUP BY ALL), dn AS (SELECT doc_id, count(*) AS dn FROM dg GROUP BY ALL), i AS MATERIALIZED (SELECT query_id, doc_id, count(*) AS i FROM qg JOIN dg USING (g) GROUP BY ALL),
 p AS (SELECT query_id, doc_id, q <> '' AND d <> '' AND (contains(d, q) OR contains(q, d)) AS exact, CASE WHEN coalesce(qn, 0) + coalesce(dn, 0) = 0 THEN 1.0 ELSE coalesce(i, 0) / (coalesce(qn, 0) + coalesce(dn, 0) - coalesce(i, 0)) END AS jaccard
  FROM q CROSS JOIN d LEFT JOIN i USING (query_id, doc_id) LEFT JOIN qn USING (query_id) LEFT JOIN dn USING (doc_id))
"""


@query(LEAKS + "SELECT query_id, doc_id, exact, jaccard FROM p WHERE exact OR jaccard >= 0.75")
def leakage_all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
VECTOR = f"v AS (SELECT a.vec_id AS query_id, b.vec_id, {COSINE} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v)\n"


def _vectors(spark: SparkSession, sf_dir: str, k: int, **options) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.vector_top_k(rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows, k, exclude_self=True, **options)


@query("WITH " + VECTOR + "SELECT query_id, vec_id, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score_millionths, rank FROM vt WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir, 10).select("query_id", "vec_id", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_millionths"), "rank")


@query("WITH " + VECTOR.replace("WHERE a.vec_id % 50 = 0", "WHERE a.vec_id % 50 = 0 AND b.label = 1") + "SELECT query_id, vec_id, CAST(floor(greatest(0, least(1, 1 - (1 - score) / 2)) * 1e6 + 0.5) AS BIGINT) AS distance_score_millionths, rank FROM vt WHERE rank <= 5")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.functions.text import distance_score

    rows = _vectors(spark, sf_dir, 5, where=F.col("label") == 1)
    return rows.select("query_id", "vec_id", F.floor(distance_score(1 - F.col("score")) * 1e6 + 0.5).cast("long").alias("distance_score_millionths"), "rank")


#: Vectors and documents have ids of one range, so a query of either list is that of the same number.
LISTS = BM25 + ", " + VECTOR + """, lists AS (SELECT query_id * 50 AS query_id, doc_id AS id, rank, 1 AS source FROM top WHERE rank <= 20 UNION ALL SELECT query_id, vec_id, rank, 0 FROM vt WHERE rank <= 20)
"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _bm25(spark, sf_dir, 20).select((F.col("query_id") * 50).alias("query_id"), F.col("doc_id").alias("id"), "rank", F.lit(1).alias("source"))
    return words.unionByName(_vectors(spark, sf_dir, 20).select("query_id", F.col("vec_id").alias("id"), "rank", F.lit(0).alias("source")))


RRF = LISTS + """, f AS (SELECT query_id, id, coalesce(max(0.5::DOUBLE / (60 + rank)) FILTER (WHERE source = 0), 0.0::DOUBLE) + coalesce(max(0.5::DOUBLE / (60 + rank)) FILTER (WHERE source = 1), 0.0::DOUBLE) AS score, min(source) AS s0, arg_min(rank, source) AS r0 FROM lists GROUP BY ALL),
 rr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s0, r0, id) AS rank FROM f)
"""


def _fused(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.rrf(_lists(spark, sf_dir), k, key="id")


@query(RRF + "SELECT query_id, id, CAST(floor(score * 1e9 + 0.5) AS BIGINT) AS score_billionths, rank FROM rr WHERE rank <= 10")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 10).select("query_id", "id", F.floor(F.col("score") * 1e9 + 0.5).cast("long").alias("score_billionths"), "rank")


BATCH = LISTS + """, b AS (SELECT query_id, id AS key, sum((CASE WHEN source = 0 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END) / (1.0::DOUBLE + 0.25::DOUBLE * (source)) * (0.7::DOUBLE / (10.0::DOUBLE + rank) + 0.3::DOUBLE * greatest(1.0::DOUBLE / rank, 0.0::DOUBLE))) AS score, max(1.0::DOUBLE / rank) AS best_score FROM lists GROUP BY ALL),
 bs AS (SELECT query_id, key, best_score, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score_millionths FROM b)
"""


@query(BATCH + "SELECT * FROM (SELECT query_id, key, CAST(floor(best_score * 1e6 + 0.5) AS BIGINT) AS best_millionths, score_millionths, row_number() OVER (PARTITION BY query_id ORDER BY score_millionths DESC, best_score DESC, key) AS rank FROM bs) WHERE rank <= 15")
def batch_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir).select("query_id", F.col("id").alias("key"), F.col("rank").alias("batch_rank"), (F.col("source") == 0).alias("is_original"), F.col("source").alias("iteration"), (1.0 / F.col("rank")).alias("rerank_score"))
    return retrieval.fuse_batches(rows, 15).select("query_id", "key", F.floor(F.col("best_score") * 1e6 + 0.5).cast("long").alias("best_millionths"), "score_millionths", "rank")


@query("WITH " + VECTOR + """, t AS (SELECT query_id, vec_id, score, rank, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS top FROM vt WHERE rank <= 10),
 u AS (SELECT *, score >= greatest(0.3, top * 0.75) AS inside FROM t), w AS (SELECT *, count(*) FILTER (WHERE inside) OVER (PARTITION BY query_id) AS n FROM u)
SELECT query_id, vec_id, rank FROM w WHERE top <= 0.15 OR CASE WHEN n >= 2 THEN inside ELSE rank <= 2 END""")
def relevance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.relevance_filtered(_vectors(spark, sf_dir, 10), floor=0.3).select("query_id", "vec_id", "rank")


PACK = BM25 + """, c AS (SELECT query_id, rank, doc_id, '[Source: ' || source || CASE WHEN doc_id % 4 <> 0 THEN ', p.' || (doc_id % 4) ELSE '' END || ']' || chr(10) || text || chr(10) AS part FROM top JOIN documents USING (doc_id) WHERE rank <= 10),
 s AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM c),
 p AS (SELECT query_id, coalesce(string_agg(part, chr(10) || '---' || chr(10) ORDER BY rank) FILTER (WHERE running <= 6000), '') AS context_text, count(*) FILTER (WHERE running <= 6000) AS n_packed FROM s GROUP BY query_id)
"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.nullif(F.col("doc_id") % 4, F.lit(0)).alias("page"), F.col("text").alias("content"))
    return retrieval.packed_context(_bm25(spark, sf_dir, 10).join(docs, "doc_id"), 6000)


@query(PACK + "SELECT query_id, n_packed, length(context_text) AS context_chars, sha256(context_text) AS context_hash FROM p")
def context_pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("query_id", "n_packed", F.col("context_chars").cast("long").alias("context_chars"), "context_hash")


@query(PACK + "SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'no_rag' WHEN length(context_text) = 0 THEN 'empty_context' WHEN length(context_text) < 1500 THEN 'context_too_short' WHEN n_packed < 3 THEN 'too_few_chunks' WHEN n_packed / 10 < 0.5 THEN 'low_top_score' ELSE 'pass' END AS reason FROM p")
def rag_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packed(spark, sf_dir)
    reason = retrieval.rag_gate(F.col("query_id"), F.col("context_chars"), F.col("n_packed"), F.col("n_packed") / 10, F.col("query_id") % 5 != 0, min_chars=1500, min_chunks=3, min_score=0.5)
    return rows.select("query_id", reason.alias("reason"))


@query("SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_documents_seen FROM documents")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.collection_stats(table(spark, sf_dir, "documents"), F.col("source"))


@query(f"WITH n AS (SELECT item_id, replace({norm('text')}, ' ', '') AS s FROM benchmark), g AS (SELECT item_id, {_grams('s')} AS g FROM n) SELECT a.item_id AS a_id, b.item_id AS b_id, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS jaccard FROM g a JOIN g b ON a.item_id + 1 = b.item_id")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.functions.text import char_grams, jaccard

    g = table(spark, sf_dir, "benchmark").select("item_id", char_grams(F.col("text")).alias("g"))
    a, b = g.select(F.col("item_id").alias("a_id"), F.col("g").alias("a")), g.select(F.col("item_id").alias("b_id"), F.col("g").alias("b"))
    return a.join(b, F.col("a_id") + 1 == F.col("b_id")).select("a_id", "b_id", jaccard(F.col("a"), F.col("b")).alias("jaccard"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(None).cast("int").alias("page"), F.col("lang").alias("section"), F.col("text").alias("content"))


@query()
def retrieval_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.plans.retrieval import snapshot

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return snapshot(asked, _chunks(spark, sf_dir), index.build(table(spark, sf_dir, "documents"))).drop("chunks")


# the words of the scorer, and those that it leaves out
_SCORED = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ('the', 'a', 'an', 'is', 'are', 'was', 'were', 'be', 'been', 'being', 'have', 'has', 'had', 'do', 'does', 'did', 'will', 'would', 'could', 'should', 'may', 'might', 'must', 'and', 'or', 'but', 'if', 'then', 'than', 'that', 'this', 'to', 'of', 'in', 'on', 'at', 'for', 'with', 'by', 'from')))"


@query(BM25 + f""", w AS MATERIALIZED (SELECT query_id, doc_id, rank AS retrieval_rank, {_SCORED.format('b.text')} AS q, {_SCORED.format('d.text')} AS t FROM top JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 20),
 x AS (SELECT *, CASE WHEN len(q) = 0 THEN -4.0::DOUBLE ELSE 8.0::DOUBLE * len(list_intersect(q, t)) / len(q) - 4.0::DOUBLE END AS raw FROM w)
SELECT query_id, doc_id, CAST(floor(1e6 / (1 + exp(-raw)) + 0.5) AS BIGINT) AS score_millionths, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, retrieval_rank) AS rank FROM x""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.plans.retrieval import rerank as order

    top = _bm25(spark, sf_dir, 20).join(_chunks(spark, sf_dir), "doc_id").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return order(top.withColumnRenamed("rank", "retrieval_rank")).select("query_id", "doc_id", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_millionths"), "rank")


@query()
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", models.embedded("text").alias("embedding"))


@query()
def experiment_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.plans.retrieval import experiment

    samples = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("sample_id"), F.lit("mcq").alias("track"), F.col("text").alias("question"), F.array(F.lit("yes"), F.lit("no")).alias("options"), F.lit("A").alias("answer_key"), F.lit(None).cast("string").alias("reference_answer"))
    conditions = spark.createDataFrame([(s, r) for s in ("ZS", "COT") for r in (True, False)], "strategy string, rag_enabled boolean")
    model_rows = spark.createDataFrame([("m1", True)], "model_id string, enabled boolean")
    packed = _packed(spark, sf_dir).select(F.col("query_id").cast("string").alias("query_id"), "context_text", "context_chars", F.col("n_packed").alias("returned_count"), F.array(F.struct(F.lit(0.9).alias("score"))).alias("chunks"))
    return experiment(samples, conditions, model_rows, packed).drop("prompt", "context_text", "question", "options", "response_text")


def _failing(prompts: list[str]) -> list[tuple[str, int]]:
    """A stand-in that answers with what the question starts with, takes a token for each word, and fails on some."""
    out = []
    for p in prompts:
        question = p.split("Question: ", 1)[1].split("\n", 1)[0]
        if "an" in question[:20].lower():
            raise RuntimeError("refused")
        out.append(("Answer: " + "ABCD"[len(question) % 4], len(question.split())))
    return out


#: What the stand-in makes of a question: its first line, trimmed.
_ASKED = "WITH b AS (SELECT item_id, split_part(trim(text), chr(10), 1) AS q FROM benchmark), g AS (SELECT item_id, q, strategy, repeat_index FROM b, (SELECT unnest(['ZS', 'COT']) AS strategy), (SELECT unnest([0, 1]) AS repeat_index))"


@query(_ASKED + " SELECT CAST(item_id AS VARCHAR) AS sample_id, strategy, CAST(repeat_index AS INTEGER) AS repeat_index, CASE WHEN contains(lower(q[1:20]), 'an') THEN 'refused' END AS error, CASE WHEN NOT contains(lower(q[1:20]), 'an') THEN ['A', 'B', 'C', 'D'][length(q) % 4 + 1] END AS parsed_answer, CASE WHEN NOT contains(lower(q[1:20]), 'an') THEN length(q) % 4 = item_id % 4 END AS correct, CAST(CASE WHEN contains(lower(q[1:20]), 'an') THEN 0 ELSE len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) END AS INTEGER) AS tokens_used, TRUE AS timed FROM g")
def experiment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid that is broken off after its first repeat and goes on from its ledger; calls fail on some questions."""
    from siltstone.plans.retrieval import experiment
    from siltstone.tables import materialise

    key = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("item_id") % 4 + 1).cast("int"))
    samples = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("sample_id"), F.lit("mcq").alias("track"), F.col("text").alias("question"), F.array(F.lit("w"), F.lit("x"), F.lit("y"), F.lit("z")).alias("options"), key.alias("answer_key"), F.lit(None).cast("string").alias("reference_answer"))
    conditions = spark.createDataFrame([(s, False) for s in ("ZS", "COT")], "strategy string, rag_enabled boolean")
    model_rows = spark.createDataFrame([("m1", True)], "model_id string, enabled boolean")
    snapshots = spark.createDataFrame([], "query_id string, context_text string, context_chars int, returned_count int, chunks array<struct<score: double>>")
    run = lambda repeats, done: materialise(experiment(samples, conditions, model_rows, snapshots, repeats, _failing, done=done, calls=4), "runs")
    first = run(1, None)
    rest = run(2, first)
    # failed cells are tried again, and fail again
    runs = ledger.without_superseded(first.unionByName(rest))
    return runs.select("sample_id", "strategy", "repeat_index", "error", "parsed_answer", "correct", "tokens_used", (F.col("latency_ms") >= 0).alias("timed"))
