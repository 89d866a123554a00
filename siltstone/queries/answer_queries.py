"""Queries of prompts, answer chains, report shapes and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import index, retrieval
from siltstone.operators import ledger as L
from siltstone.plans import answering
from siltstone.queries.retrieval_queries import BM25, _bm25, _chunks
from siltstone.sources import files

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


_KIND = "CASE WHEN regexp_matches(lower(text), 'calculate|compute|dose|dosing|mg/kg|g/kg|ml/kg') THEN 'Show the formula with units before the result.' WHEN regexp_matches(lower(text), 'normal range|reference|lab value|level') THEN 'Give the range with its unit and for whom it holds.' WHEN regexp_matches(lower(text), 'which of the following|best describes|most likely|least likely') THEN 'Weigh every option before choosing.' WHEN regexp_matches(lower(text), 'why|explain|mechanism|pathophysiology') THEN 'Name the cause before its consequence.' END"


@query(f"""WITH s AS (SELECT unnest(['ZS', 'COT']) AS strategy, unnest(['Answer the question. End with ''Answer: X''.', 'Think step by step, then end with ''Answer: X''.']) AS told),
 p AS (SELECT item_id, strategy, concat_ws(chr(10) || chr(10), told, {_KIND}, CASE WHEN item_id % 2 = 0 THEN 'Context:' || chr(10) || 'About item ' || item_id END, 'Question: ' || trim(text), 'Options:' || chr(10) || 'A. yes' || chr(10) || 'B. no') AS prompt FROM benchmark, s)
SELECT item_id, strategy, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM p""")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = spark.createDataFrame([("ZS",), ("COT",)], "strategy string")
    n = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.lit("mcq").alias("track"), F.col("text").alias("question"), F.array(F.lit("A. yes"), F.lit("b) no")).alias("options"), F.when(n % 2 == 0, F.concat(F.lit(" About item "), n.cast("string"))).alias("context_text"))
    prompts = answering.rendered(rows.crossJoin(F.broadcast(conditions)))
    return prompts.select("item_id", "strategy", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def _choose(prompts: list[str]) -> list[str]:
    """A stand-in whose answer hangs on the length of the question's first line."""
    return ["Answer: " + "AB"[len(p.rsplit("Question: ", 1)[1].split("\n", 1)[0]) % 2] for p in prompts]


_CHOSEN = "['A', 'B'][length(split_part(trim({}), chr(10), 1)) % 2 + 1]"


def _search(spark: SparkSession, sf_dir: str):
    """Keyword search over the documents, indexed once."""
    own, chunks = index.build(table(spark, sf_dir, "documents")), _chunks(spark, sf_dir)

    def search(queries: DataFrame, k: int) -> DataFrame:
        return index.top_k(queries, own, k).drop("score").withColumn("score", F.col("score_millionths") / 1e6).join(chunks, "doc_id")

    return search


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.array(F.lit("yes"), F.lit("no")).alias("options"))


@query(BM25 + """, f AS (SELECT query_id, doc_id, score_millionths, rank, source, lang FROM top JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT b.item_id AS query_id, """ + _CHOSEN.format("any_value(b.text)") + """ AS answer, coalesce(count(f.rank), 0) AS n_scores, string_agg(f.source || '/' || f.lang, ',' ORDER BY f.rank) FILTER (WHERE f.rank <= 3) AS sources FROM benchmark b LEFT JOIN f ON f.query_id = b.item_id GROUP BY b.item_id""")
def answer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _questions(spark, sf_dir)
    out = answering.choice_chain(asked, _search(spark, sf_dir)(asked.select("query_id", F.col("question").alias("text")), 5), _choose)
    listed = F.array_join(F.transform("sources", lambda x: F.concat_ws("/", x["source"], x["section"])), ",")
    return out.select("query_id", "answer", F.coalesce(F.size("retrieval_scores"), F.lit(0)).cast("long").alias("n_scores"), F.when(F.size("sources") > 0, listed).alias("sources"))


@query("SELECT item_id AS query_id, " + _CHOSEN.format("CASE WHEN item_id % 3 = 0 THEN 'third: ' ELSE '' END || text") + " AS answer, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS rewrite_count, true AS context_used FROM benchmark")
def agentic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge rejects what every third question finds, until it is asked anew; the question is told by its mark."""
    asked = _questions(spark, sf_dir).withColumn("question", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("third: "), "question")).otherwise(F.col("question")))
    judge = lambda prompts: ["no" if p.split("\n")[1].startswith("third: ") else "yes" for p in prompts]
    rewrite = lambda prompts: [p.split("\n", 1)[1].replace("third: ", "") for p in prompts]
    out = answering.agentic(asked, _search(spark, sf_dir), _choose, grade=judge, rewrite=rewrite)
    return out.select("query_id", "answer", "rewrite_count", "context_used")


@query(BM25 + """, h AS (SELECT query_id, md5(substr(text, 1, 500)) AS k, min(rank) AS first, arg_min(doc_id, rank) AS doc_id, arg_min(score_millionths, rank) AS score FROM top JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY ALL)
SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM h) WHERE rank <= 10""")
def multi_query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the second wording says the same again, so that its hits are all known
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return answering.multi_query(asked, _search(spark, sf_dir), 10, expand=lambda q: [q, f"{q} "]).select("query_id", "doc_id", "rank")


@query(BM25 + "SELECT query_id, doc_id, rank FROM top WHERE rank <= 10 AND score_millionths / 1e6 >= 12.5")
def min_score_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bm25(spark, sf_dir, 10).withColumn("score", F.col("score_millionths") / 1e6)
    return retrieval.min_score(rows, 12.5).select("query_id", "doc_id", "rank")


@query(BM25 + "SELECT query_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS source_diversity FROM top JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY query_id")
def hit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _bm25(spark, sf_dir, 10).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return retrieval.source_sets(hits).withColumn("sources", F.array_join("sources", ","))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 50 AS VARCHAR) WHEN doc_id % 3 = 1 THEN CAST(doc_id % 40 AS VARCHAR) ELSE '0' END AS page, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Unknown' END AS section FROM documents")
def metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("doc_id"), lambda c: c.cast("string")
    held = F.map_filter(F.create_map(F.lit("page"), F.when(n % 3 == 0, s(n % 50)), F.lit("page_num"), F.when(n % 3 <= 1, s(n % 40)), F.lit("section_header"), F.when(n % 2 == 0, F.col("lang"))), lambda _, v: v.isNotNull())
    rows = table(spark, sf_dir, "documents").select("doc_id", held.alias("m"))
    return rows.select("doc_id", retrieval.metadata(F.col("m"), "page", "page_num", default="0").alias("page"), retrieval.metadata(F.col("m"), "section", "section_header", default="Unknown").alias("section"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE lang END AS lang, n_chars, md5(text) AS text_md5 FROM documents")
def records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"), "n_chars", "text")
    back = files.from_records(files.to_records(rows), "doc_id long, lang string, n_chars long, text string", {"lang": "none"})
    return back.select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


@query("WITH m AS (SELECT unnest(['COT', 'ZS']) AS strategy, unnest([1, 2]) AS place), s AS (SELECT DISTINCT o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN 'COT' WHEN o_orderstatus = 'O' THEN 'ZS' ELSE o_orderstatus END AS strategy FROM orders) SELECT strategy, row_number() OVER (ORDER BY coalesce(place, 3), strategy) AS place FROM s LEFT JOIN m USING (strategy)")
def custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.when(status == "P", "COT").when(status == "O", "ZS").otherwise(status).alias("strategy")).distinct()
    # a value of the order is a row, so they are few
    return L.in_order(rows, strategy=["COT", "ZS"]).coalesce(1).select("strategy", (F.monotonically_increasing_id() + 1).alias("place"))


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en'")
def open_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents in English are the open runs without error; labels their samples
    docs = table(spark, sf_dir, "documents")
    runs = docs.select(F.col("doc_id").alias("sample_id"), "source", F.when(F.col("lang") == "en", "open_ended").otherwise("mcq").alias("track"), F.lit(None).cast("string").alias("error"))
    samples = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), "quality")
    return L.open_records(runs, samples).select(F.col("sample_id").alias("doc_id"), "source", "quality")


@query("SELECT 'doc' AS dataset, count(*) AS input_rows, count(*) FILTER (WHERE trim(source) <> '' AND length(text) >= 200) AS kept_rows, count(*) FILTER (WHERE NOT (trim(source) <> '' AND length(text) >= 200)) AS skipped_rows FROM documents")
def conversion_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from siltstone.tables import shared_dir

    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.length("text") >= 200, F.col("text")).alias("body"))
    out = files.convert(rows, ("source", "body"), "doc", "doc_id", f"{shared_dir(spark)}/convert-{uuid.uuid4().hex}")
    return out.select("dataset", "input_rows", "kept_rows", "skipped_rows")
