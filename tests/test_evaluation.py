"""What the evaluation's texts say of records, snapshots, citations and runs, on literal rows."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.functions import models
from siltstone.functions.text import faithfulness, hallucination_risk
from siltstone.operators import grounding, index, ledger
from siltstone.plans import answering
from siltstone.plans import retrieval as plans
from siltstone.sources import files


def lines(path, *rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / "x.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_legacy_records(spark, tmp_path):
    say = lambda role, text: {"role": role, "content": text}
    both = [say("user", "first"), say("user", "second"), say("assistant", "reply")]
    path = lines(tmp_path / "d", {"id": "L1", "messages": both}, {"id": "L2", "split": "train", "messages": both}, {"messages": []}, {"sample_id": "N1", "split": "holdout", "question": "q", "reference_answer": "r"}, {"sample_id": "N2", "question": "no split"})
    rows = {r["sample_id"]: r for r in files.dataset(spark, path, "open_ended", holdout_only=False).collect()}
    assert len(rows) == 5 and (rows["L1"]["split"], rows["L1"]["question"], rows["L1"]["reference_answer"]) == ("holdout", "second", "reply")
    assert rows["L2"]["split"] == "train" and rows["N1"]["reference_answer"] == "r"
    nameless = next(r for i, r in rows.items() if i not in ("L1", "L2", "N1", "N2"))
    assert len(nameless["sample_id"]) == 12 and nameless["question"] == "" and nameless["split"] == "holdout"
    kept = {r["sample_id"]: r["reference_answer"] for r in files.dataset(spark, path, "mcq").collect()}
    # of a choice question a message is no reference
    assert set(kept) == {"L1", "N1", nameless["sample_id"]} and kept["L1"] is None and kept["N1"] == "r"


def test_snapshot_lines(spark, tmp_path):
    many = [{"sample_id": f"s{n % 5}", "snapshot": {"n": n}} for n in range(400)]
    path = lines(tmp_path / "s", {"sample_id": "", "snapshot": {"n": 1}, "meta": {"k": "not this"}}, {"sample_id": "s0", "snapshot": {"n": -1}, "meta": {}}, *many[:200], {"sample_id": "s1", "snapshot": {"n": -2}, "meta": {"k": "first"}}, *many[200:], {"sample_id": "s1", "meta": {"k": "late"}}, {"sample_id": "s2", "snapshot": {"n": 1000}, "meta": {"k": "second"}})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r["sample_id"]: json.loads(r["snapshot"])["n"] for r in files.snapshots(spark, path).collect()}
        assert got == {"s0": 395, "s1": 396, "s2": 1000, "s3": 398, "s4": 399} and json.loads(files.snapshot_meta(spark, path)) == {"k": "first"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert files.snapshot_meta(spark, lines(tmp_path / "t", {"sample_id": "a", "snapshot": {"n": 1}})) is None


def test_ledger_keeps_metrics(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "s", 1.5, 1, True, None, "pass", 7), ("m2", "s", None, 0, None, "boom", "no_rag", 8)], "model_id string, sample_id string, f1 double, rag_context_used int, correct boolean, error string, rag_gate_reason string, tokens_used int")
    files.write_ledger(rows, str(tmp_path / "l"))
    got = {r["model_id"]: r for r in files.ledger(spark, str(tmp_path / "l"), ("f1", "rag_context_used", "other")).collect()}
    assert got["m1"]["metrics"] == {"f1": 1.5, "rag_context_used": 1.0} and (got["m1"]["f1"], got["m1"]["rag_context_used"], got["m1"]["other"]) == (1.5, 1.0, None)
    assert got["m2"]["metrics"] == {"rag_context_used": 0.0} and got["m2"]["error"] == "boom" and got["m1"]["correct"] and got["m1"]["rag_gate_reason"] == "pass" and got["m2"]["tokens_used"] == 8
    # a record's own metrics stay, columns of the same name count
    again = files.with_metrics(spark.createDataFrame([("m", {"a": 1.0, "b": 2.0}, 5.0)], "model_id string, metrics map<string, double>, b double")).first()
    assert again["metrics"] == {"a": 1.0, "b": 5.0}


def test_strings_beyond_the_shared_table(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>a</t></si><si><t>b</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>99</v></c><c r="B2" t="s"><v>0</v></c></row></sheetData></worksheet>')
    assert [r["values"] for r in files.xlsx(spark, str(tmp_path / "b.xlsx")).collect()] == [{"a": "", "b": "a"}]


# --- snapshots


def test_snapshot_plan(spark):
    """Hints come from every query of the first round, in the plan's order; fused scores enter the fusion of batches."""
    docs = [(1, "S1", "alpha", "alpha beta gamma delta words in the first clause of it all"), (2, "S2", "omega", "omega psi chi phi words in the second clause of it all"), (3, "S3", "HEAD", "OMEGA")]
    chunks = spark.createDataFrame([(i, s, None, sec, t) for i, s, sec, t in docs], "doc_id long, source string, page int, section string, content string")
    own = index.build(chunks, text_col="content")
    asked = spark.createDataFrame([("q", "alpha beta gamma delta; omega psi chi phi"), ("none", "zebra")], "query_id string, text string")
    got = {r["query_id"]: r for r in plans.snapshot(asked, chunks, own, scorer=None).collect()}
    plan = got["q"]["query_plan"]
    assert plan[:4] == ["[focused] alpha beta gamma delta; omega psi chi phi", "alpha beta gamma delta; omega psi chi phi", "alpha beta gamma delta", "omega psi chi phi"]
    # the original query's hits lead, so its best hit's section is the first hint
    assert len(plan) == 6 and all(" section " in p for p in plan[4:]) and got["q"]["refinement_used"] and got["q"]["iteration_count"] == 2
    assert {p.split(" section ")[1] for p in plan[4:]} == {"alpha", "omega"}
    assert (got["none"]["query_plan"], got["none"]["refinement_used"], got["none"]["iteration_count"], got["none"]["candidate_count"]) == (["[focused] zebra", "zebra"], False, 0, 0)
    assert len(got["q"]["cache_key"]) == 64 != got["none"]["cache_key"]
    # one query, one round: rank 1 gives 0.7 / 11 + 0.3 * 0.4 / 61
    one = plans.snapshot(spark.createDataFrame([("q", "psi")], "query_id string, text string"), chunks, own, iterations=1, scorer=None).first()
    assert one["chunks"][0]["score"] == pytest.approx(0.7 / 11 + 0.3 * 0.4 / 61, abs=1e-6)


def test_hints_of_later_plan_queries(spark):
    """A clause's hits give hints where the original query has none of its own."""
    plan = spark.createDataFrame([("q", "x", True, 0), ("q", "y", False, 1)], "query_id string, plan_text string, is_original boolean, plan_no int")
    hits = spark.createDataFrame([("q", 0, 1, " ", "src"), ("q", 1, 1, "late", "src"), ("q", 0, 11, "too far", "other")], "query_id string, plan_no int, rank int, section string, source string")
    got = plans.refined(spark.createDataFrame([("q", "x")], "query_id string, text string"), hits, plan).orderBy("plan_no").collect()
    assert [r["plan_text"] for r in got] == ["x section late", "x source src"]


def test_candidates_are_counted_after_the_quality_filter(spark):
    docs = [(n, "S", None, "sec", f"psi content that is long enough to be of use, number {n}") for n in range(4)] + [(9, "S", None, "sec", "psi")] + [(20 + n, "T", None, "sec", f"omega {n}") for n in range(9)]
    chunks = spark.createDataFrame(docs, "doc_id long, source string, page int, section string, content string")
    got = plans.snapshot(spark.createDataFrame([("q", "psi")], "query_id string, text string"), chunks, index.build(chunks, text_col="content"), iterations=1, scorer=None).first()
    assert got["candidate_count"] == 4


# --- citations


def test_citations_as_a_whole(spark):
    answers = spark.createDataFrame(
        [
            (1, "Give 3 g/kg of protein [Guide One, p.4]. Also (Source: Handbook, p.9).", "guide_one.md", 4), (2, "No citation, always 7 mg/kg.", "guide_one.md", 4), (3, "As said [Guide One, p.5].", "Guide One", 4),
            (4, "See [Nothing Known].", None, None), (5, "No chunks [Guide One, p.4].", "guide one", 4),
        ],
        "answer_id long, answer string, ground_truth_source string, ground_truth_page int",
    )
    three = [(1, "guide_one.md", 4, "protein of 3 g/kg is given"), (2, "the handbook.pdf", 8, "other"), (3, "Third.md", 1, "third"), (4, "Fourth.md", 1, "fourth")]
    chunks = spark.createDataFrame([(a, *c) for a in (1, 3, 4) for c in three] + [(2, *c) for c in three[1:]], "answer_id long, rank int, source string, page int, content string")
    got = {r["answer_id"]: r for r in grounding.evaluate(answers, chunks).collect()}
    # citations: both paged brackets, and the bracket form without a page once more
    assert got[1]["source_accuracy"] == 1.0 and got[1]["completeness"] == pytest.approx(2 / 3) and got[1]["ground_truth_source_found"] and got[1]["ground_truth_page_found"]
    assert got[2]["completeness"] == 0.0 and not got[2]["ground_truth_source_found"] and not got[2]["ground_truth_page_found"]
    # the first citation of the source has another page, the first chunk has the page
    assert got[3]["ground_truth_page_found"] and got[3]["completeness"] == pytest.approx(1 / 3)
    assert not got[4]["ground_truth_source_found"] and got[4]["completeness"] == 0.0
    assert got[5]["completeness"] == 0.0 and got[5]["ground_truth_source_found"] and got[5]["ground_truth_page_found"] and got[5]["hallucination_risk"] == 1.0 and got[5]["faithfulness_score"] == 0.0
    context = "\n".join(c[3] for c in three)
    want = spark.range(1).select(faithfulness(F.lit("Give 3 g/kg of protein [Guide One, p.4]. Also (Source: Handbook, p.9)."), F.lit(context)).alias("f"), hallucination_risk(F.lit("Give 3 g/kg of protein [Guide One, p.4]. Also (Source: Handbook, p.9)."), F.lit(context)).alias("h")).first()
    assert (got[1]["faithfulness_score"], got[1]["hallucination_risk"]) == (want["f"], want["h"])
    for r in got.values():
        assert r["overall_citation_score"] == pytest.approx(0.3 * r["source_accuracy"] + 0.2 * r["page_precision"] + 0.3 * r["faithfulness_score"] + 0.1 * r["completeness"] + 0.1 * (1 - r["hallucination_risk"]))
    means = grounding.batch_means(grounding.evaluate(answers, chunks)).first()
    assert means["n"] == 5 and means["ground_truth_found_rate"] == 3 / 5
    for m in grounding.BATCH_MEANS:
        assert means[m] == pytest.approx(sum(r[m] for r in got.values()) / 5)
    assert grounding.batch_means(grounding.evaluate(answers.limit(0), chunks)).collect() == []


# --- calls that fail


def test_called():
    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [(p.upper(), len(p)) for p in prompts]

    got = models.called(model, ["a", "bad", "ccc"])
    assert [(r.text, r.tokens, r.error) for r in got] == [("A", 1, None), ("", 0, "no"), ("CCC", 3, None)] and all(r.latency_ms >= 0 for r in got)
    assert models.called(model, []) == [] and models.called(lambda p: [], ["x"])[0].error == "0 answers to 1 prompts"


def test_answers_of_failing_calls(spark):
    calls = {"n": 0}

    def model(prompts):
        out = []
        for p in prompts:
            if "fail" in p:
                raise RuntimeError("down")
            out.append(("Answer: B" if "sure" in p else "hm", 2))
        return out

    rows = spark.createDataFrame([("fail", "ZS", "mcq"), ("sure", "ZS", "mcq"), ("hm", "ZS", "mcq"), ("fail too", "COT_SC", "mcq"), ("sure", "COT_SC", "mcq"), ("fail", "ZS", "open_ended"), ("open", "ZS", "open_ended")], "prompt string, strategy string, track string").coalesce(1)
    got = [(r["prompt"], r["answer"], r["error"], r["tokens_used"]) for r in answering.answered(rows, model, lambda ps: ['{"answer": "C"}'] * len(ps)).collect()]
    assert got == [("fail", None, "down", 0), ("sure", "B", None, 2), ("hm", "C", None, 2), ("fail too", None, "down", 0), ("sure", "B", None, 6), ("fail", None, "down", 0), ("open", "", None, 2)]
    assert calls["n"] == 0


def test_superseded_runs(spark):
    rows = [("a", "x"), ("a", None), ("b", "x"), ("b", "y"), ("c", None)]
    runs = spark.createDataFrame([("m", "ZS", True, s, 0, e) for s, e in rows], "model_id string, strategy string, rag_enabled boolean, sample_id string, repeat_index int, error string")
    got = sorted((r["sample_id"], r["error"] is None) for r in ledger.without_superseded(runs).collect())
    assert got == [("a", True), ("b", False), ("c", True)]
