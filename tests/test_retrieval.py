import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import models
from siltstone.operators import grounding, index, leakage, prep, retrieval
from siltstone.plans import retrieval as plans

DOCS = [(1, "protein needs of preterm infants are 3-4 g/kg/day"), (2, "lipid emulsions and protein in infants"), (3, "glucose infusion rate"), (4, "protein protein protein"), (5, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_bm25(spark, docs):
    own = index.build(docs)
    terms = {r["term"]: (r["df"], r["idf"]) for r in own.terms.collect()}
    raw = {t: math.log(5 - df + 0.5) - math.log(df + 0.5) for t, (df, _) in terms.items()}
    mean = sum(raw.values()) / len(raw)
    assert all(idf == pytest.approx(raw[t] if raw[t] >= 0 else 0.25 * mean) for t, (_, idf) in terms.items())
    got = index.top_k(spark.createDataFrame([(7, "Protein for infants"), (8, "zebra")], "query_id long, text string"), own, 2).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(7, 1), (7, 2)]
    assert {r["doc_id"] for r in got} <= {1, 2, 4}


def test_index_round_trip(spark, docs, tmp_path):
    index.build(docs).write(str(tmp_path / "i"))
    own = index.KeywordIndex.read(spark, str(tmp_path / "i"))
    assert own.postings.count() == index.build(docs).postings.count() and own.documents.count() == 5


def test_leakage(spark, docs):
    questions = spark.createDataFrame([(1, "Lipid emulsions, and protein in infants!"), (2, "unrelated zebra glucose question here")], "item_id long, text string")
    rows = {(r["query_id"], r["rank"]): r for r in leakage.leakage_audit(questions, docs).collect()}
    assert rows[1, 1]["exact"] and rows[1, 1]["suspected"] and rows[1, 1]["doc_id"] == 2 and not rows[2, 1]["suspected"]


def test_rrf(spark):
    lists = spark.createDataFrame([(1, 10, 0, 1), (1, 11, 0, 2), (1, 11, 1, 1), (1, 12, 1, 2)], "query_id int, doc_id int, source int, rank int")
    got = sorted(retrieval.rrf(lists, 3).collect(), key=lambda r: r["rank"])
    assert [r["doc_id"] for r in got] == [11, 10, 12] and got[0]["score"] == pytest.approx(0.5 / 61 + 0.5 / 62)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "a"), (4, [0.0, 0.0], "a")], "vec_id long, embedding array<double>, kind string")
    asked = rows.filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    assert [r["vec_id"] for r in retrieval.vector_top_k(asked, rows, 2, exclude_self=True).orderBy("rank").collect()] == [2, 3]
    assert [r["vec_id"] for r in retrieval.vector_top_k(asked, rows, 2, where=F.col("kind") == "a").orderBy("rank").collect()] == [1, 3]


def test_filters_and_packing(spark):
    rows = [(1, k, f"s{k}", None, f"content number {k} that is long enough to be kept as it is", s) for k, s in ((1, 0.9), (2, 0.8), (3, 0.2), (4, 0.1))] + [(2, 1, "t", 3, "short", 0.1), (2, 2, "t", 0, "tiny", 0.05)]
    chunks = spark.createDataFrame(rows, "query_id int, rank int, source string, page int, content string, score double")
    kept = {(r["query_id"], r["rank"]) for r in retrieval.relevance_filtered(chunks).collect()}
    assert kept == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert retrieval.quality_filtered(chunks).filter("query_id = 1").count() == 4
    packed = {r["query_id"]: r for r in retrieval.packed_context(chunks, 150).collect()}
    assert packed[1]["n_packed"] == 2 and packed[2]["context_text"] == "[Source: t, p.3]\nshort\n\n---\n[Source: t]\ntiny\n"
    assert {r["n_packed"] for r in retrieval.packed_context(chunks, 1).collect()} == {0}


def test_gate(spark):
    df = spark.createDataFrame([(1, 500, 3, 0.9, True), (1, 500, 3, 0.9, False), (None, None, None, None, True), (1, 0, 0, 0.0, True), (1, 100, 3, 0.9, True), (1, 500, 1, 0.9, True), (1, 500, 3, 0.1, True)], "s int, c int, n int, t double, r boolean")
    got = [r[0] for r in df.select(retrieval.rag_gate(*(F.col(x) for x in "scntr"))).collect()]
    assert got == ["pass", "no_rag", "no_snapshot", "empty_context", "context_too_short", "too_few_chunks", "low_top_score"]


def test_snapshot_and_experiment(spark, docs):
    chunks = docs.select("doc_id", F.lit("src.md").alias("source"), F.lit(None).cast("int").alias("page"), F.lit("Needs").alias("section"), F.col("text").alias("content"))
    asked = spark.createDataFrame([("q1", "what protein dose do preterm infants need")], "query_id string, text string")
    own = index.build(docs)
    row = plans.snapshot(asked, chunks, own).first()
    assert row["returned_count"] >= 1 and "protein" in row["context_text"] and row["iteration_count"] == 2
    none = plans.snapshot(asked.unionByName(spark.createDataFrame([("q0", "zzz qqq")], asked.schema)), chunks, own).filter("query_id = 'q0'").collect()
    assert [(r["chunks"], r["context_text"], r["candidate_count"], r["returned_count"], r["iteration_count"]) for r in none] == [([], "", 0, 0, 0)]
    samples = spark.createDataFrame([("q1", "mcq", "which", ["x", "y"], "A", None), ("q2", "open_ended", "say it", None, None, "say it")], "sample_id string, track string, question string, options array<string>, answer_key string, reference_answer string")
    conditions = spark.createDataFrame([("ZS", True), ("COT", False)], "strategy string, rag_enabled boolean")
    model = spark.createDataFrame([("m", True)], "model_id string, enabled boolean")
    out = {(r["sample_id"], r["rag_enabled"]): r for r in plans.experiment(samples, conditions, model, plans.snapshot(asked, chunks, own), min_chars=10, min_chunks=1, min_score=0.0).collect()}
    assert out["q1", True]["correct"] and out["q1", True]["rag_gate_reason"] == "pass" and out["q2", True]["rag_gate_reason"] == "no_snapshot" and out["q2", False]["f1"] > 0


def test_judging(spark):
    top = spark.createDataFrame([("q", k, "query", f"content {k}") for k in (1, 2, 3)], "query_id string, rank int, query string, content string")
    yes = lambda prompts: ['"yes"' if "content 2" in p else '"no"' for p in prompts]
    assert [r["content"] for r in plans.judged(top, yes).collect()] == ["content 2"]
    again = spark.createDataFrame([("q", 1, "query", "more"), ("q", 2, "query", "content 2")], "query_id string, rank int, query string, content string")
    assert {r["content"] for r in plans.judged(top, yes, again, least=3).collect()} == {"content 2", "more"}


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "Protein needs are 3 g/kg/day in preterm infants [Fake Book, p.9]. Something else entirely unrelated follows here."), (2, "")], "answer_id int, answer string")
    chunks = spark.createDataFrame([(1, 1, "Real_Guide.md", 4, "protein needs are 3 g/kg/day in preterm infants"), (1, 2, "Other.md", 0, "zebra")], "answer_id int, rank int, source string, page int, content string")
    got = {r["answer_id"]: r for r in grounding.grounded(answers, chunks).collect()}
    assert "Fake Book" not in got[1]["grounded_text"] and "[Real Guide, p.4]" in got[1]["grounded_text"] and "References:\n1. Real Guide, page 4" in got[1]["grounded_text"]
    assert got[1]["citations_removed"] == 1 and got[1]["citations_added"] == 1 and 0 < got[1]["confidence"] <= 1 and got[2]["confidence"] == 0.0
    scores = {r["answer_id"]: r for r in grounding.citation_scores(answers, chunks.withColumn("source", F.lit("the fake_book.pdf"))).collect()}
    assert scores[1]["source_accuracy"] > 0 and scores[2]["extracted"] == 0
    assert "Source(s): Real_Guide.md (p.4)" in {r["answer_id"]: r["text"] for r in grounding.source_line(answers, chunks).collect()}[1]


def test_models(spark):
    rows = spark.createDataFrame([("protein dose", "a dose of protein"), ("protein", None)], "q string, t string")
    got = rows.select(models.pair_scored("q", "t").alias("s"), models.nli_blended(F.lit(0.5), "q", "t").alias("n"), models.embedded("q").alias("e")).collect()
    assert got[0]["s"] > 0.9 > got[1]["s"] and got[0]["n"] == 0.75 and len(got[0]["e"]) == 64 and sum(x * x for x in got[0]["e"]) == pytest.approx(1)
    assert models.expanded(rows.select(F.col("q").alias("text"))).count() == 6 and models.hyde(["protein?"])[0].startswith("Protein requirements")


def test_prep(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "source string, sha256 string")
    assert {(r["source"], r["change"]) for r in prep.changed(new, old).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    row = spark.createDataFrame([("Case context:\nx\n\nQuestion:\n why? ", "1. first query\n- \"second one\"\nno")], "q string, m string").select(prep.question_only(F.col("q")).alias("q"), prep.multi_query_lines(F.col("m")).alias("m")).first()
    assert row["q"] == "why?" and row["m"] == ["first query", "second one"]
    calc = spark.createDataFrame([(str(k), "P", "Calculate the dose", f"{k} mg/kg/day", "advanced", "s", "0.9") for k in range(1, 7)] + [("0", "P", "q", "a", "", "", ""), ("x", "P", "q", "a", "", "", "")], "`S.No` string, Provider string, Question string, Answer string, Complexity string, `Source Document` string, `Verification Confidence` string")
    records = prep.calc_records(calc)
    assert records.count() == 6 and prep.calc_selected(prep.calc_scored(records), 4, 2).count() == 4
    assert [r["sample_id"] for r in prep.calc_selected(prep.calc_scored(records), 2).collect()] == ["calc_006", "calc_005"]


CALC = "`S.No` string, Provider string, Question string, Answer string, Complexity string, `Source Document` string, `Verification Confidence` string"


def test_stratified_selection(spark):
    """Two of the highest weight, then two by their messy scores."""
    rows = [
        ("10", "p", "Calculate dose: 2 g/kg/day for 2 kg.", "Dose is 4 g/day.", "advanced", "DocA", "0.95"), ("11", "p", "Calculate GIR for 1 kg at 3 mL/hr D10.", "GIR is 5 mg/kg/min.", "advanced", "DocB", "0.94"),
        ("12", "p", "Calculate infusion rate for a PN bag over 24 hours.", "Initial 0.1 mL/hr, then advance to 0.2 mL/hr as tolerated.", "intermediate", "DocC", "0.90"), ("13", "p", "Calculate infusion rate for 12 mL over 24 hours.", "0.5 mL/hr.", "intermediate", "DocD", "0.70"),
        ("14", "p", "Calculate recommended fluids.", "Recommended fluids: 100-120 mL/kg/day.", "basic", "DocE", "0.98"), ("15", "p", "Calculate GIR.", "5 mg/kg/min.", "basic", "DocF", "0.99"),
    ]
    scored = prep.calc_scored(prep.calc_records(spark.createDataFrame(rows, CALC)))
    assert [r["sample_id"] for r in prep.calc_selected(scored, 4, 2).orderBy("sample_id").collect()] == ["calc_010", "calc_011", "calc_012", "calc_013"]
    # weight * 10, keys * 2, keys of several values * 3, ranges * 3, words, density
    assert {r["sample_id"]: (r["density"], r["messy"]) for r in scored.collect()} == {"calc_010": (2, 36), "calc_011": (2, 37), "calc_012": (2, 20 + 2 + 3 + 2 + 2), "calc_013": (2, 20 + 4 + 2), "calc_014": (1, 10 + 2 + 3 + 1), "calc_015": (1, 14)}


def test_messy_bounds(spark):
    """Words count once and up to 6, the density up to 12; spellings of a unit or per are one key."""
    words = " ".join(["max", "limit", "target", "initial"] * 3)
    answer = words + " " + ", ".join(f"{k} mg/kg/d" for k in range(1, 15)) + ", 3 mg/kg/day, 2 ug, 2 mcg, 1 mg/dL"
    row = prep.calc_scored(prep.calc_records(spark.createDataFrame([("1", "p", "Calculate it", answer, "basic", "s", "1")], CALC))).first()
    assert row["density"] == 16 and row["messy"] == 10 + 3 * 2 + 1 * 3 + 0 + 6 + 12


def test_collection_stats_counts_all_rows(spark):
    """One source fills the first 6,000 rows; 40 others and a null one come after it."""
    rows = spark.range(6041).coalesce(1).select(F.when(F.col("id") < 6000, "hot").when(F.col("id") < 6040, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"))
    assert retrieval.collection_stats(rows, F.col("source")).first().asDict() == {"n_chunks": 6041, "n_documents_seen": 41}


def test_vectors_in_blocks(spark, monkeypatch):
    """More queries than a block holds find what they find at once."""
    import random

    rng = random.Random(4)
    rows = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(60)] + [(60, [0.0] * 6)], "vec_id int, embedding array<double>")
    asked = rows.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    once = sorted(tuple(r) for r in retrieval.vector_top_k(asked, rows, 4, exclude_self=True).collect())
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 6)
    assert sorted(tuple(r) for r in retrieval.vector_top_k(asked, rows, 4, exclude_self=True).collect()) == once and len(once) == 80
