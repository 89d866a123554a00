"""Queries of splits, change sets, selections and joins that prepare datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import leakage, prep, retrieval
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


SPLIT = "CASE WHEN doc_id % 5 = 0 THEN 'holdout' WHEN doc_id % 5 = 1 THEN 'test' ELSE 'train' END"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("split", F.expr(SPLIT))


@query(f"WITH q AS (SELECT doc_id, lower(trim(text)) AS question, {SPLIT} = 'holdout' AS o FROM documents), g AS (SELECT question, count(*) FILTER (WHERE o) AS n_held_out, count(*) FILTER (WHERE NOT o) AS n_train, min(doc_id) FILTER (WHERE o) AS first_held_out, min(doc_id) FILTER (WHERE NOT o) AS first_train FROM q GROUP BY question) SELECT md5(question) AS question_md5, n_held_out, n_train, first_held_out, first_train FROM g WHERE n_held_out > 0 AND n_train > 0")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leakage.split_leakage(_records(spark, sf_dir), "doc_id", "text", "split")
    return out.select(F.md5("question").alias("question_md5"), "n_held_out", "n_train", "first_held_out", "first_train")


@query(f"""WITH r AS (SELECT source || '/' || lang AS id, lower(trim(text)) AS question, {SPLIT} = 'holdout' AS o FROM documents),
 q AS (SELECT question FROM r GROUP BY question HAVING bool_or(o) AND NOT bool_and(o)), i AS (SELECT id FROM r GROUP BY id HAVING bool_or(o) AND NOT bool_and(o))
SELECT (SELECT count(*) FROM r) AS total_records, (SELECT count(*) FROM r WHERE o) AS holdout_records, (SELECT count(*) FROM r WHERE NOT o) AS train_like_records, (SELECT count(*) FROM q) AS question_overlap_count, (SELECT count(*) FROM i) AS sample_id_overlap_count,
 (SELECT md5(string_agg(question, '|' ORDER BY question)) FROM (SELECT question FROM q ORDER BY question LIMIT 20)) AS questions_md5, coalesce((SELECT string_agg(id, '|' ORDER BY id) FROM (SELECT id FROM i ORDER BY id LIMIT 20)), '') AS ids, EXISTS (SELECT 1 FROM q) OR EXISTS (SELECT 1 FROM i) AS leakage_detected""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("id", F.concat_ws("/", "source", "lang"))
    out = leakage.split_report(rows, "id", "text", "split")
    return out.select("total_records", "holdout_records", "train_like_records", "question_overlap_count", "sample_id_overlap_count", F.md5(F.array_join("question_overlap_examples", "|")).alias("questions_md5"), F.array_join("sample_id_overlap_examples", "|").alias("ids"), "leakage_detected")


@query(f"SELECT doc_id, source FROM documents WHERE {SPLIT} = 'holdout'")
def holdout_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).filter("split = 'holdout'").select("doc_id", "source")


#: Two versions of the files: of some the text has changed, and some go by another name in one of them.
_FILES = "SELECT CASE WHEN doc_id % 13 = 0 THEN 'new' ELSE 'f' END || doc_id AS source, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS sha256 FROM documents"
_MANIFEST = "SELECT CASE WHEN doc_id % 17 = 0 THEN 'old' ELSE 'f' END || doc_id AS source, sha256(text) AS sha256 FROM documents"


def _named(k: int, other: str):
    return F.concat(F.when(F.col("doc_id") % k == 0, other).otherwise("f"), F.col("doc_id").cast("string")).alias("source")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(_named(13, "new"), F.sha2(text, 256).alias("sha256"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(_named(17, "old"), F.sha2("text", 256).alias("sha256"))


@query(f"SELECT source, CASE WHEN m.sha256 IS NULL THEN 'added' WHEN c.sha256 IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({_FILES}) c FULL JOIN ({_MANIFEST}) m USING (source) WHERE m.sha256 IS NULL OR c.sha256 IS NULL OR m.sha256 <> c.sha256")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.changed(_current(spark, sf_dir), _manifest(spark, sf_dir))


@query(f"SELECT source FROM ({_MANIFEST}) m ANTI JOIN ({_FILES}) c USING (source)")
def removed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.changed(_current(spark, sf_dir), _manifest(spark, sf_dir)).filter("change = 'removed'").select("source")


@query("SELECT source, count(*) AS chunk_count, min(sha256(text)) AS sha256, sha256('size=1000') AS config_sha256 FROM documents GROUP BY source")
def ingestion_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.min(F.sha2("text", 256)).alias("sha256"), F.count("*").alias("n"))
    per_chunk = rows.select("source", "sha256", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    return files.ingestion_manifest(per_chunk, {"size": "1000"})


CALC = """SELECT doc_id, CAST(doc_id AS VARCHAR) AS no, CASE WHEN doc_id % 3 = 0 THEN 'Calculate the dose of item ' || doc_id ELSE 'What is item ' || doc_id END AS question, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 50) || ' mg/kg/day, max ' || (doc_id % 9) || '-10 mL/hr' || CASE WHEN doc_id % 12 = 0 THEN ', later 77 mg/kg/day' ELSE '' END || CASE WHEN doc_id % 18 = 0 THEN ', target 5 g/dose' ELSE '' END ELSE 'see text' END AS reference_answer,
  (['Basic', ' intermediate', 'ADVANCED', 'other'])[doc_id % 4 + 1] AS complexity, CAST((doc_id % 100) / 100 AS VARCHAR) AS confidence FROM documents"""


def _calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: c.cast("string")
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        s(n).alias("S.No"), F.lit("p").alias("Provider"), F.when(n % 3 == 0, F.concat(F.lit("Calculate the dose of item "), s(n))).otherwise(F.concat(F.lit("What is item "), s(n))).alias("Question"),
        F.when(n % 2 == 0, F.concat(s(n % 50), F.lit(" mg/kg/day, max "), s(n % 9), F.lit("-10 mL/hr"), F.when(n % 12 == 0, ", later 77 mg/kg/day").otherwise(""), F.when(n % 18 == 0, ", target 5 g/dose").otherwise(""))).otherwise("see text").alias("Answer"),
        F.element_at(F.array(*map(F.lit, ("Basic", " intermediate", "ADVANCED", "other"))), (n % 4 + 1).cast("int")).alias("Complexity"), F.col("source").alias("Source Document"), s((n % 100) / 100).alias("Verification Confidence"),
    )
    return prep.calc_records(rows)


_ELIGIBLE = f"WITH c AS ({CALC}), e AS (SELECT 'calc_' || CASE WHEN doc_id < 1000 THEN lpad(no, 3, '0') ELSE no END AS sample_id, CASE lower(trim(complexity)) WHEN 'basic' THEN 1 WHEN 'intermediate' THEN 2 WHEN 'advanced' THEN 3 ELSE 0 END AS weight, CAST(confidence AS DOUBLE) AS confidence, 2 + CAST(doc_id % 12 = 0 AS INT) + CAST(doc_id % 18 = 0 AS INT) AS density, CASE WHEN doc_id % 12 = 0 THEN 4 ELSE 0 END + CASE WHEN doc_id % 18 = 0 THEN 4 ELSE 0 END AS more FROM c WHERE doc_id <> 0 AND doc_id % 3 = 0 AND doc_id % 2 = 0)"


@query(_ELIGIBLE + " SELECT sample_id, weight, confidence FROM e")
def calc_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.calc_scored(_calc(spark, sf_dir)).select("sample_id", "weight", "confidence")


# all have two quantities of different units, a range and a messy word; a second value of a key, or another key and word, adds four
@query(_ELIGIBLE + """, o AS (SELECT *, weight * 10 + 10 + more AS messy, row_number() OVER (ORDER BY weight DESC, confidence DESC, density DESC, sample_id DESC) AS place FROM e)
SELECT sample_id, weight, messy FROM o WHERE place <= 25 UNION ALL SELECT sample_id, weight, messy FROM (SELECT * FROM o WHERE place > 25 ORDER BY messy DESC, weight DESC, confidence DESC, density DESC, sample_id DESC LIMIT 25)""")
def calc_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.calc_selected(prep.calc_scored(_calc(spark, sf_dir)), 50, 25).select("sample_id", "weight", "messy")


@query("SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    # nation and region are fixed dimensions of a few rows
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT doc_id, d.source AS base_source, l.quality AS rag_quality FROM (SELECT doc_id, source FROM documents) d FULL JOIN (SELECT -doc_id * (doc_id % 2) + doc_id * (1 - doc_id % 2) AS doc_id, quality FROM labels) l USING (doc_id)")
def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels of odd ids go by the negative one, so that both sides have rows without a partner
    odd = F.col("doc_id") % 2
    other = table(spark, sf_dir, "labels").select((-F.col("doc_id") * odd + F.col("doc_id") * (1 - odd)).alias("doc_id"), "quality")
    return files.merged_judgements(table(spark, sf_dir, "documents").select("doc_id", "source"), other, "doc_id")


@query("SELECT l.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 7 <> 3 AND d.doc_id % 2 = 0")
def judge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # open runs, some of them with errors, and their samples
    from siltstone.operators.ledger import open_records

    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "source", F.when(F.col("doc_id") % 2 == 0, "open_ended").otherwise("mcq").alias("track"), F.when(F.col("doc_id") % 7 == 3, "timeout").alias("error"))
    samples = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), "quality")
    return open_records(runs, samples).select(F.col("sample_id").alias("doc_id"), "source", "quality")


@query("SELECT doc_id, CASE WHEN trim(source) = '' THEN 'missing_source' WHEN length(text) < 100 THEN 'missing_body' END AS skip_reason FROM documents")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("body", F.when(F.length("text") >= 100, F.col("text")))
    return prep.required(rows, ("source", "body")).select("doc_id", "skip_reason")


@query("SELECT 'documents' AS name, 'Documents' AS display, doc_id AS id FROM documents UNION ALL SELECT 'pages', NULL, page_id FROM pages UNION ALL SELECT 'benchmark', 'Benchmark', item_id FROM benchmark")
def union_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id"))}
    names = spark.createDataFrame([(t, t.title()) for t in tables if t != "pages"], "model_id string, display string")
    return files.csv_union(tables, names).select(F.col("model_id").alias("name"), "display", "id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT source, text_md5, doc_id FROM (SELECT source, md5(substr(text, 1, 500)) AS text_md5, doc_id FROM documents) QUALIFY row_number() OVER (PARTITION BY text_md5 ORDER BY doc_id) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", retrieval.content_key(F.col("text")).alias("text_md5"), "doc_id")
    return retrieval.first_of_each(rows, ("text_md5",), ("doc_id",))


@query("""WITH f AS (SELECT source AS name, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS sha FROM documents GROUP BY source)
SELECT string_agg(name, ',' ORDER BY name) AS included, count(*) AS n, sha256('[' || string_agg('{"name":"' || name || '","sha256":"' || sha || '"}', ',' ORDER BY name) || ']') AS manifest_sha256 FROM f""")
def kb_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source stands for a file: its hash is that of its texts' sorted hashes
    texts = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha"))
    rows = texts.groupBy(F.col("source").alias("name")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha")), ""), 256).alias("sha256"))
    found = prep.kb_manifest(rows)
    return found.select(F.array_join("included_files", ",").alias("included"), F.size("file_sha256").cast("long").alias("n"), "manifest_sha256")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS hour_us, count(*) AS n, floor(sum(value) * 1e3 + 0.5)::BIGINT AS total_thousandths FROM events GROUP BY ALL")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.streaming.ingest import event_counts

    # what is a watermark to a stream is nothing to a table
    rows = event_counts(table(spark, sf_dir, "events"), "1 hour")
    return rows.select("event_type", F.unix_micros(F.col("window.start").cast("timestamp")).alias("hour_us"), "n", F.floor(F.col("total") * 1e3 + 0.5).cast("long").alias("total_thousandths"))


@query("SELECT doc_id, source, lang, length(text) AS n_chars FROM documents")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rows of a table as workbooks and back
    import uuid

    from siltstone.sources import formats
    from siltstone.tables import shared_dir

    formats.register(spark)
    path = f"{shared_dir(spark)}/workbooks-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("Source"), F.col("lang").alias("Lang."), F.length("text").alias("No. of Characters"))
    rows.write.format("workbook").mode("append").save(path)
    back = spark.read.format("workbook").schema("doc_id string, source string, lang string, no_of_characters string").load(path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("no_of_characters").cast("int").alias("n_chars"))
