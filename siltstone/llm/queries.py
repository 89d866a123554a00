"""Queries of the training-data operators, and their SQL where SQL expresses them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, clustering, decontaminate, exact_dedup, lexical, licenses, near_dedup, nearest, packing, secrets, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import quality

    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), 85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(_table(spark, sf_dir, "documents"))
    return lexical.search(index, _table(spark, sf_dir, "benchmark"), 50).withColumnRenamed("query_id", "item_id")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_exact_dedup, op3_byte_bpe, op4_packing, op5_warc, op6_quality, op7_near_dedup, op8_toxicity, op9_nearest, op10_licenses, op11_clustering, op12_lexical, op13_decontaminate)
    return {f.__name__: f for f in own}


OP2_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS sha FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id ASC NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha AS text_sha256 FROM g
"""

OP5_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


_ASSIGNED = """d{n} AS (SELECT r, j, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{n} c USING (i) GROUP BY r, j),
a{n} AS MATERIALIZED (SELECT r, arg_min(j, d * 1000 + j) AS j, min(d) AS d FROM d{n} GROUP BY r)"""
_MOVED = """s{n} AS (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{last} USING (r) GROUP BY j, i),
c{n} AS MATERIALIZED (SELECT j, i, CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM c{last} c LEFT JOIN s{n} s USING (j, i))"""
OP11_SQL = (
    """WITH k AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: CAST(floor(256 * e::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
v AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(x) AS x FROM k),
o AS (SELECT x, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j FROM k QUALIFY j < 40),
c0 AS MATERIALIZED (SELECT j, unnest(range(64)) AS i, unnest(x) AS x FROM o),
"""
    + _ASSIGNED.format(n=0) + ",\n"
    + "".join(f"{_MOVED.format(n=n, last=n - 1)},\n{_ASSIGNED.format(n=n)},\n" for n in range(1, 6))
    + """h AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY j)
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a5 a JOIN k USING (r) JOIN h USING (j)"""
)

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP12_SQL = f"""
WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM t WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE text IS NOT NULL),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, s GROUP BY term, s.n),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(w) * s.n) // s.l) AS m FROM t, s WHERE len(w) > 0),
g AS (SELECT item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM g QUALIFY rank <= 50
"""

OP13_SQL = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
p AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
x AS (SELECT r, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + m - 1], ' ')}})) AS s FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
h AS MATERIALIZED (SELECT r, item, x.m, s.i AS i FROM x JOIN p ON s.g = p.g AND x.m = p.m),
n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS at FROM h) GROUP BY r),
e AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN e USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_warc": OP5_SQL, "op11_clustering": OP11_SQL, "op12_lexical": OP12_SQL, "op13_decontaminate": OP13_SQL}
