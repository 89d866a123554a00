"""Prompts, generation, answer chains, and the shapes of records and reports, on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.operators import ledger, retrieval
from siltstone.plans import answering as A
from siltstone.plans import retrieval as plans
from siltstone.sources import files


def test_names():
    assert A.strategies() == ["ZS", "FEW_SHOT", "COT"] and A.strategies("all") == list(A.STRATEGIES)
    assert A.strategies("zero-shot, Few, cot, COT") == ["ZS", "FEW_SHOT", "COT"]
    for bad in ("nonsense", ","):
        with pytest.raises(ValueError):
            A.strategies(bad)
    assert A.model_spec("hf:a/b:c") == ("huggingface", "a/b:c") and A.model_spec("x:y") == ("x", "y")
    with pytest.raises(ValueError):
        A.model_spec("none")


def test_temperature(spark):
    rows = spark.createDataFrame([("GPT-5-mini",), ("gemini-3-pro",), ("other",)], "m string")
    assert [r[0] for r in rows.select(A.temperature(F.col("m"), 0.2)).collect()] == [None, 1.0, 0.2]


SAMPLES = "sample_id string, strategy string, track string, question string, options array<string>, context_text string"


def test_prompts(spark):
    rows = [
        ("a", "ZS", "mcq", " Which? ", ["A. x", "b) y"], None), ("b", "FEW_SHOT", "mcq", "Calculate it", ["x"], "ctx"), ("c", "COT", "open_ended", "Why?", ["x"], None), ("d", "FEW_SHOT", "open_ended", "Say", None, " c "),
    ]
    got = {r["sample_id"]: (r["system"], r["prompt"]) for r in A.rendered(spark.createDataFrame(rows, SAMPLES)).collect()}
    assert got["a"] == (A.SYSTEM[False, False], f"{A.CHOICE['ZS']}\n\nQuestion: Which?\n\nOptions:\nA. x\nB. y")
    assert got["b"][0] == A.SYSTEM[False, True] and "Examples:\nQ: How many millilitres" in got["b"][1] and A.KINDS["dosage_calculation"] in got["b"][1] and "Context:\nctx\n\nQuestion: Calculate it\n\nOptions:\nA. x" in got["b"][1]
    assert got["c"] == (A.SYSTEM[True, False], f"{A.OPEN['COT']}\n\n{A.KINDS['clinical_reasoning']}\n\nQuestion: Why?")
    assert got["d"][0] == A.SYSTEM[True, True] and "Final answer: 6 g/day" in got["d"][1] and "Options" not in got["d"][1]
    own = spark.createDataFrame(rows, SAMPLES).withColumn("examples", F.when(F.col("sample_id") == "b", F.array(F.struct(F.lit("q1").alias("question"), F.lit("a1").alias("answer")), F.struct(F.lit(" ").alias("question"), F.lit("a").alias("answer")))))
    assert "Examples:\nQ: q1\nA: a1\n\nContext" in {r["sample_id"]: r["prompt"] for r in A.rendered(own).collect()}["b"]


PROMPTS = "sample_id string, strategy string, track string, prompt string"


def test_votes_retries_and_rescue(spark):
    """The majority of three; a third try; what only the structured model knows; an open answer as it is."""
    said = {"vote": ["Answer: B", "Answer: C", "Answer: C, surely"], "late": ["hm", "well", "Answer: D"], "never": ["?"] * 9, "open": ["six"]}

    def model(prompts, turn={}):  # noqa: B006
        out = []
        for p in prompts:
            turn[p] = turn.get(p, -1) + 1
            out.append(said[p][turn[p] % len(said[p])])
        return out

    rows = [(p, "COT_SC" if p == "vote" else "ZS", "open_ended" if p == "open" else "mcq", p) for p in said]
    got = {r["sample_id"]: r for r in A.answered(spark.createDataFrame(rows, PROMPTS).coalesce(1), model, lambda ps: ['{"answer": "E, A"}' for _ in ps]).collect()}
    assert (got["vote"]["answer"], got["vote"]["response_text"]) == ("C", "Answer: C") and got["late"]["answer"] == "D"
    assert (got["never"]["answer"], got["never"]["structured_output_used"]) == ("A,E", True) and not got["late"]["structured_output_used"]
    assert (got["open"]["answer"], got["open"]["response_text"]) == ("", "six")
    assert A.answered(spark.createDataFrame([], PROMPTS)).count() == 0


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    for name, text in {"lipids": "# Lipids\nLipid emulsions start early in preterm infants.", "glucose": "# Glucose\nThe glucose infusion rate is titrated in steps.", "sodium": "# Sodium\nSodium is measured every day in the first week."}.items():
        (folder / f"{name}.md").write_text(text)
    own = Engine(spark, str(tmp_path_factory.mktemp("kb") / "kb"))
    own.ingest_directory(str(folder))
    return own


QUESTIONS = "query_id string, question string, options array<string>"


def test_chain_and_loop(spark, engine):
    asked = spark.createDataFrame([("1", "When do lipid emulsions start?", ["early", "late"]), ("2", "zzz", ["x"])], QUESTIONS)
    got = {r["query_id"]: r for r in engine.answer(asked, 2).collect()}
    assert got["1"]["answer"] == "A" and got["1"]["sources"][0]["source"] == "lipids.md" and len(got["1"]["retrieval_scores"]) == 2 and got["1"]["sources"][0]["content"].endswith("...")
    turns = []
    search = lambda q, k: engine.search(q, k)
    judge = lambda ps: ["yes" if "lipid" in p.split("\n")[1].lower() else "no" for p in ps]
    better = lambda ps: ["Lipid emulsions?" if "sodium" in p else "again" for p in ps]
    asked = spark.createDataFrame([("1", "When do lipid emulsions start?", ["early"]), ("2", "what of sodium", ["x"]), ("3", "never good", ["x"])], QUESTIONS)
    got = {r["query_id"]: r["rewrite_count"] for r in A.agentic(asked, search, grade=judge, rewrite=better).collect()}
    assert got == {"1": 0, "2": 1, "3": 2} and not turns
    assert {r["rewrite_count"] for r in A.agentic(asked, search).collect()} == {0}
    nothing = lambda q, k: engine.search(q, k).filter("false")
    assert {(r["rewrite_count"], r["context_used"]) for r in A.agentic(asked, nothing, most=1).collect()} == {(1, False)}


def test_wordings_and_passages(spark, engine):
    asked = spark.createDataFrame([("1", "glucose"), ("2", "protein")], "query_id string, text string")
    hits = engine.search(asked, 2, way="multi_query").collect()
    for q in "12":
        own = sorted((r["rank"], r["content"], r["score"]) for r in hits if r["query_id"] == q)
        assert [k for k, *_ in own] == [1, 2] and own[0][2] >= own[1][2] and own[0][1] != own[1][1]
    assert engine.search(asked, 1, way="hyde").count() == 2
    answers = {r["query_id"]: r for r in engine.ask(asked).collect()}
    assert answers["1"]["n_chunks"] > 0


def test_hybrid_snapshot(spark, engine):
    asked = spark.createDataFrame([("1", "When do lipid emulsions start?"), ("2", "zzz")], "query_id string, text string")
    chunks = engine.chunks.withColumn("page", F.lit(None).cast("int"))
    words = {r["query_id"]: r for r in plans.snapshot(asked, chunks, engine.index).collect()}
    both = {r["query_id"]: r for r in plans.snapshot(asked, chunks, engine.index, embed=engine.embed).collect()}
    assert words["2"]["candidate_count"] == 0 and both["1"]["candidate_count"] == 3 and both["1"]["chunks"][0]["source"] == "lipids.md"
    assert {r["returned_count"] for r in plans.snapshot(asked, chunks, engine.index, min_score=1.1).collect()} == {0}


def test_experiment_with_open_questions(spark):
    samples = spark.createDataFrame([("m", "mcq", "which", ["x", "y"], "A", None, None), ("o", "open_ended", "2 g/kg/day for 3 kg", None, None, "6 g/day [Book]", "book.md"), ("p", "open_ended", "say", None, None, "nothing", None)], "sample_id string, track string, question string, options array<string>, answer_key string, reference_answer string, source_doc string")
    conditions = spark.createDataFrame([("ZS", True), ("COT", True), ("FEW_SHOT", False)], "strategy string, rag_enabled boolean")
    model_rows = spark.createDataFrame([("m1", True)], "model_id string, enabled boolean")
    chunk = "array<struct<source: string, score: double>>"
    found = spark.createDataFrame([("o", "COT", "long enough", 11, 2, [("Book.md", 0.9)])], f"query_id string, strategy string, context_text string, context_chars int, returned_count int, chunks {chunk}")
    say = lambda ps: ["Answer: A" if "Options:" in p else "Work: 60 mg\nFinal answer: 6 g/day [book]" for p in ps]
    pool = spark.createDataFrame([("3 g/kg/day for 2 kg", "6 g/day"), ("name a unit", "gram"), ("which letter", "Answer: A")], "question string, answer string")
    runs = plans.experiment(samples, conditions, model_rows, found, model=say, pool=pool, min_chars=1)
    got = {(r["sample_id"], r["strategy"]): r for r in runs.collect()}
    # a snapshot is that of the sample and strategy
    assert {k: r["rag_gate_reason"] for k, r in got.items() if k[0] == "o"} == {("o", "COT"): "pass", ("o", "ZS"): "no_snapshot", ("o", "FEW_SHOT"): "no_rag"}
    o = got["o", "COT"]
    assert (o["quantity_recall"], o["quantity_precision"], o["final_quantity_f1"], o["ref_is_single_target"]) == (1.0, 0.5, 1.0, 1.0)
    assert (o["doc_citation_present"], o["doc_cites_gold_source"], o["doc_cited_in_retrieved_context"]) == (1.0, 1.0, 1.0) and got["o", "ZS"]["doc_cited_in_retrieved_context"] == 0.0
    assert got["p", "ZS"]["doc_cites_gold_source"] is None and got["m", "ZS"]["f1"] is None and got["m", "ZS"]["correct"]
    assert "Q: 3 g/kg/day for 2 kg\nA: 6 g/day" in got["o", "FEW_SHOT"]["prompt"]
    table = ledger.summary(runs.withColumn("latency_ms", F.lit(1.0)).withColumn("error", F.lit(None).cast("string")), plans.OPEN_METRICS, plans.GOLD_METRICS, ("final_key_f1",))
    row = {(r["strategy"], r["track"]): r for r in table.collect()}["COT", "open_ended"]
    assert (row["n"], row["quantity_precision_mean"], row["doc_cites_gold_source_rate"], row["final_key_f1_mean_ctx_used"]) == (2, pytest.approx(0.25), 1.0, 1.0)
    assert row["final_key_f1_mean_single_target"] == pytest.approx(0.5) and row["final_key_f1_mean_ctx_not_used"] == 0.0


def test_report_shapes(spark):
    rows = spark.createDataFrame([("b", "COT", "rag", 0.5, 2000.0), ("a", "ZS", "rag", 1.0, 1000.0), ("a", "RAP", "rag", 0.1, 1.0), ("a", "COT", "no_rag", 0.2, 500.0)], "model_id string, strategy string, rag_mode string, accuracy double, latency_ms_mean double")
    assert [(r["model_id"], r["strategy"]) for r in ledger.in_order(rows, strategy=["ZS", "COT"], model_id=["b", "a"]).collect()] == [("a", "ZS"), ("b", "COT"), ("a", "COT"), ("a", "RAP")]
    assert [(r["model_id"], r["rag_mode"], r["strategy"]) for r in ledger.report_order(rows).collect()] == [("a", "no_rag", "COT"), ("a", "rag", "RAP"), ("a", "rag", "ZS"), ("b", "rag", "COT")]
    units = {r["label"]: (r["latency_s"], r["accuracy_percent"]) for r in ledger.report_units(rows).collect()}
    assert units == {"b / COT": (2.0, 50.0), "a / ZS": (1.0, 100.0), "a / COT": (0.5, 20.0)}
    assert {r["strategy"]: (r["accuracy_mean"], r["accuracy_max"]) for r in ledger.group_means(rows, "strategy").collect()}["COT"] == (0.35, 0.5)
    assert {r["model_id"]: r["n_strategies"] for r in ledger.model_means(rows).collect()} == {"a": 3, "b": 1}
    assert ledger.spread(rows, "rag_mode", "accuracy").filter("rag_mode = 'rag'").first()["quartiles"] == pytest.approx([0.3, 0.5, 0.75])


def test_records_and_metadata(spark):
    rows = spark.createDataFrame([(1, None, [1.5]), (2, "x", None)], "a int, b string, c array<double>")
    back = files.from_records(files.to_records(rows), "a int, b string, c array<double>, d string", {"b": "none", "d": "new"}).collect()
    assert [tuple(r) for r in sorted(back)] == [(1, "none", [1.5], "new"), (2, "x", None, "new")]
    held = spark.createDataFrame([({"page_num": "3"},), ({"page": "4", "page_num": "3"},), ({},)], "m map<string,string>")
    assert [r[0] for r in held.select(retrieval.metadata(F.col("m"), "page", "page_num", default="0")).collect()] == ["3", "4", "0"]
    hits = spark.createDataFrame([("q", 1, "c", "s", 2, None, 0.5)], "query_id string, rank int, content string, source string, page int, section string, score double")
    assert retrieval.simple_results(hits).first()["metadata"] == {"source": "s", "page": "2"}


def test_manifests(spark, tmp_path):
    assert files.fingerprint({"b": 1, "a": [2]}) == files.fingerprint({"a": [2], "b": 1}) != files.fingerprint({"a": [3], "b": 1})
    data = spark.createDataFrame([("1", "why", "a"), ("2", " ", "b"), ("3", "how", None)], "row string, question string, answer string")
    out = files.convert(data, ("question", "answer"), "open", "row", str(tmp_path)).first()
    assert (out["input_rows"], out["kept_rows"], out["skipped_rows"], out["sample_id_scheme"]) == (3, 1, 2, "open_<row>") and len(out["output_sha256"]) == 64
    assert [r["sample_id"] for r in files.strict(spark, str(tmp_path / "open"), "sample_id string, question string").collect()] == ["open_1"]
    assert {(r["row"], r["skip_reason"]) for r in spark.read.json(str(tmp_path / "open_skipped")).collect()} == {("2", "missing_question"), ("3", "missing_answer")}
    run = files.run_manifest(spark, {"include_rag": True, "rag_gating_enabled": False}, {"open": str(tmp_path / "open")}, templates={"ZS": "x"}).first()
    assert run["rag_policy"] == "always" and json.loads(run["datasets"])["open"]["sha256"] == out["output_sha256"] and run["prompt_templates_sha256"] == files.fingerprint({"ZS": "x"})
    files.write_snapshots(spark.createDataFrame([("1", "ctx")], "query_id string, context_text string"), str(tmp_path / "snap"), {"k": 5})
    assert json.loads(files.snapshots(spark, str(tmp_path / "snap")).first()["snapshot"])["context_text"] == "ctx"
    audit = spark.createDataFrame([(1, True, 1.0, True), (2, False, 0.2, False)], "query_id int, suspected boolean, jaccard double, exact boolean")
    assert files.write_audit(audit, str(tmp_path / "audit")).first().asDict() == {"questions": 2, "suspected": 1, "best_jaccard": 1.0, "exact_matches": 1}
    merged = files.merged_judgements(spark.createDataFrame([("a", 0.5)], "name string, s double"), spark.createDataFrame([("a", 1.0), ("b", 0.0)], "name string, s double"))
    assert files.write_judgements(merged, ("s",), str(tmp_path / "judge")).first().asDict() == {"n": 2, "base_s_mean": 0.5, "rag_s_mean": 0.5}


def test_documents_of_any_kind(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.md").write_text("# A\ntext")
    (tmp_path / "b_response.json").write_text(json.dumps({"markdown": "", "metadata": {"filename": "b.pdf", "page_count": 1}, "chunks": [{"markdown": "A first chunk that is long enough.", "type": "text", "id": "1", "grounding": {"page": 0}}, {"markdown": "A second chunk that is long enough.", "type": "text", "id": "2", "grounding": {"page": 0}}]}))
    got = {r["source"]: (r["kind"], r["text"]) for r in files.any_documents(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ("markdown", "# A\ntext") and got["b.pdf"][0] == "chunked" and got["b.pdf"][1].index("first") < got["b.pdf"][1].index("second")
    (tmp_path / "deep" / "c.pdf").write_bytes(b"%PDF")
    with pytest.raises(NotImplementedError):
        files.any_documents(spark, str(tmp_path))


def test_command_line(spark, engine, tmp_path, capsys):
    from siltstone.__main__ import main

    (tmp_path / "q.jsonl").write_text(json.dumps({"sample_id": "s1", "split": "holdout", "question": "When do lipid emulsions start?", "options": '["early", "late"]', "answer_key": "A"}) + "\n")
    common = ["--path", engine.path, "--input", str(tmp_path / "q.jsonl")]
    for command in ("status", "preview-prompts", "list-models", "answer"):
        main([command, *common])
    main(["precompute", *common, "--output", str(tmp_path / "snap")])
    main(["audit-kb", *common, "--output", str(tmp_path / "audit")])
    main(["benchmark", *common, "--output", str(tmp_path / "run"), "--strategies", "zs"])
    assert files.snapshots(spark, str(tmp_path / "snap")).count() == 1 and spark.read.json(str(tmp_path / "run" / "summary")).count() == 2
    assert "Options" in capsys.readouterr().out
