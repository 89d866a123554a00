"""Queries written in SQL over the engine's functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone import sql
from siltstone.operators import ledger as L
from siltstone.queries import ledger_queries, text_queries

QUERIES, SQL = {}, {}


def query(same_as: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if same_as:
            SQL[f.__name__] = same_as
        return f

    return register


def _over(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """A query of SQL over named tables, which are arguments of it and leave no view behind."""
    sql.register(spark)
    return spark.sql(text, **tables)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.valid(ledger_queries.ledger(spark, sf_dir)).filter("track = 'mcq'")


@query(ledger_queries.SQL["wilson_ci"])
def sql_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, """WITH c AS (SELECT model_id, strategy, rag_enabled, count_if(correct) AS k, count(*) AS n FROM {runs} GROUP BY ALL),
 e AS (SELECT *, wilson_interval(k, n) AS interval FROM c) SELECT model_id, strategy, rag_enabled, k, n, interval.p_hat, interval.ci_low, interval.ci_high FROM e""", runs=_ledger(spark, sf_dir))  # fmt: skip


@query(ledger_queries.SQL["inter_rater_kappa"])
def sql_cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, """WITH one AS (SELECT * FROM {runs} WHERE repeat_index = 0),
 cells AS (SELECT strategy, rag_enabled, a.model_id AS model_a, b.model_id AS model_b, a.parsed_answer AS answer_a, b.parsed_answer AS answer_b, count(*) AS n
   FROM one a JOIN one b USING (strategy, rag_enabled, sample_id) WHERE a.model_id < b.model_id GROUP BY ALL)
SELECT strategy, rag_enabled, model_a, model_b, sum(n) AS n, kappa_of_cells(collect_list(struct(answer_a, answer_b, n))) AS cohen_kappa FROM cells GROUP BY ALL""", runs=_ledger(spark, sf_dir))  # fmt: skip


@query(ledger_queries.SQL["fleiss_kappa"])
def sql_fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, """WITH counts AS (SELECT model_id, strategy, rag_enabled, sample_id, parsed_answer, count(*) AS m FROM {runs} GROUP BY ALL),
 items AS (SELECT model_id, strategy, rag_enabled, sample_id, sum(m) AS raters, sum(m * m) AS squares FROM counts GROUP BY ALL HAVING sum(m) >= 2),
 sizes AS (SELECT model_id, strategy, rag_enabled, raters, count(*) AS items, sum(squares) AS squares FROM items GROUP BY ALL),
 placed AS (SELECT *, row_number() OVER (PARTITION BY model_id, strategy, rag_enabled ORDER BY items DESC, raters) AS place FROM sizes), kept AS (SELECT * FROM placed WHERE place = 1),
 labels AS (SELECT model_id, strategy, rag_enabled, raters, parsed_answer, sum(m) AS c FROM counts JOIN items USING (model_id, strategy, rag_enabled, sample_id) GROUP BY ALL),
 each AS (SELECT model_id, strategy, rag_enabled, raters, collect_list(c) AS labels FROM labels GROUP BY ALL)
SELECT model_id, strategy, rag_enabled, items, raters, kappa_of_counts(items, raters, squares, labels) AS fleiss_kappa FROM kept JOIN each USING (model_id, strategy, rag_enabled, raters)""", runs=_ledger(spark, sf_dir))  # fmt: skip


@query(text_queries.SQL["query_decompose"])
def sql_query_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _over(spark, """WITH q AS (SELECT item_id AS query_id, substr('An infant.. what dose, and which risk? ' || trim(regexp_replace(text, R'[ \\t\\n\\r\\f]+', ' ')), 1, 600) AS text FROM {asked})
SELECT query_id, part AS plan_text, part_no = 0 AS is_original, part_no AS plan_no FROM q, LATERAL query_parts(text)""", asked=asked)  # fmt: skip


@query()
def sql_recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _over(spark, "SELECT doc_id, c.* FROM {docs}, LATERAL recursive_chunks(text, 600, 100) c", docs=docs)


@query()
def sql_semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _over(spark, "SELECT doc_id, c.* FROM {docs}, LATERAL semantic_chunks(text) c", docs=docs)
