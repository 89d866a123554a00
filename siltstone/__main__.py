"""Command line over an engine's folder: ingest, update, search and answer; prepare, run and analyze experiments."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import tables
from siltstone.engine import Engine
from siltstone.operators import leakage, ledger
from siltstone.plans import answering, retrieval
from siltstone.sources import files

COMMANDS = ("status", "ingest", "update", "search", "ask", "answer", "analyze", "check-leakage", "audit-kb", "convert", "preview-prompts", "precompute", "benchmark", "list-models")


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--path", required=True, help="the engine's folder, or that of the ledger, the questions or the models")
    p.add_argument("--input", help="a folder of documents or of workbooks, or a dataset of questions")
    p.add_argument("--output", help="where results are written")
    p.add_argument("--question", default="")
    p.add_argument("--track", default="mcq", choices=("mcq", "open_ended"))
    p.add_argument("--strategies", default="default", help="names with commas, default or all")
    p.add_argument("--models", default="test:echo", help="provider:model, with commas")
    p.add_argument("--repeats", type=int, default=1)
    p.add_argument("--agentic", action="store_true")
    return p.parse_args(argv)


def samples_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return files.dataset(spark, a.input, a.track).filter("question is not null")


def snapshots_of(engine: Engine, samples: DataFrame) -> DataFrame:
    chunks = engine.chunks.withColumn("page", F.lit(None).cast("int"))
    return retrieval.snapshot(samples.select(F.col("sample_id").alias("query_id"), F.col("question").alias("text")), chunks, engine.index, embed=engine.embed)


def model_rows(spark: SparkSession, specs: str) -> DataFrame:
    rows = [(spec.strip(), *answering.model_spec(spec.strip()), True) for spec in specs.split(",")]
    return spark.createDataFrame(rows, "model_id string, provider string, model_name string, enabled boolean")


def benchmark(engine: Engine, a: argparse.Namespace) -> DataFrame:
    """Runs the grid, appends its ledger, writes its summary and manifest, and returns the summary (C11)."""
    spark, samples = engine.spark, samples_of(engine.spark, a)
    chosen = answering.strategies(a.strategies)
    conditions = spark.createDataFrame([(s, r) for s in chosen for r in (True, False)], "strategy string, rag_enabled boolean")
    done = files.ledger(spark, f"{a.output}/ledger") if tables.exists(spark, f"{a.output}/ledger") else None
    runs = retrieval.experiment(samples, conditions, model_rows(spark, a.models).select("model_id", "enabled"), snapshots_of(engine, samples), a.repeats, engine.generate, done=done)
    files.write_ledger(runs.drop("context_text", "retrieved_sources", "options", "system"), f"{a.output}/ledger")
    # a cell that was run again after an error has a row for each time
    runs = ledger.without_superseded(files.ledger(spark, f"{a.output}/ledger", ("rag_context_used", "partial_match", *retrieval.OPEN_METRICS, *retrieval.GOLD_METRICS)))
    table = ledger.report_order(ledger.summary(runs, retrieval.OPEN_METRICS, retrieval.GOLD_METRICS, ("final_key_f1", "final_quantity_f1")))
    files.write_report({"summary": table}, a.output)
    config = {"strategies": chosen, "models": a.models, "repeats": a.repeats, "include_rag": True, "include_no_rag": True, "rag_gating_enabled": True}
    files.run_manifest(spark, config, {a.track: a.input}, a.path, templates={**answering.CHOICE, **{f"open:{k}": v for k, v in answering.OPEN.items()}}).write.mode("append").json(f"{a.output}/manifests")
    return table


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    engine = Engine(spark, a.path)
    asked = spark.createDataFrame([("q1", a.question)], "query_id string, text string")
    if a.command == "status":
        print(json.dumps(engine.healthy()))
    elif a.command == "ingest":
        engine.ingest_directory(a.input).show()
    elif a.command == "update":
        engine.update_directory(a.input).show()
    elif a.command == "search":
        engine.search(asked).show(truncate=80)
    elif a.command == "ask":
        engine.ask(asked).show(truncate=False)
    elif a.command == "answer":
        engine.answer(samples_of(spark, a).select(F.col("sample_id").alias("query_id"), "question", "options"), agentic=a.agentic).show(truncate=80)
    elif a.command == "analyze":
        runs = files.ledger(spark, a.path)
        files.write_report({"accuracy": ledger.accuracy(runs), "intra_rater_fleiss": ledger.intra_rater(runs), "inter_rater": ledger.inter_rater(runs), "rag_lift": ledger.rag_lift(runs)}, a.output or a.input)
    elif a.command == "check-leakage":
        rows = files.dataset(spark, a.path, a.track, holdout_only=False)
        leakage.split_report(rows.withColumn("q", F.coalesce("question", F.lit(""))), "sample_id", "q", "split").show(truncate=60)
    elif a.command == "audit-kb":
        rows = leakage.kb_audit(samples_of(spark, a).select("sample_id", F.col("question").alias("text")), engine.chunks.select("doc_id", F.col("content").alias("text")), engine.index, question_id="sample_id")
        files.write_audit(rows, a.output).show()
    elif a.command == "convert":
        cells = files.xlsx(spark, a.input)
        want = ("question", "options", "answer") if a.track == "mcq" else ("question", "answer")
        rows = cells.select("row", *[F.try_element_at("values", F.lit(c)).alias(c) for c in ("question", "options", "answer", "source_doc", "page")])
        files.convert(rows, want, "mcq" if a.track == "mcq" else "open", "row", a.output, a.input).show(truncate=False)
    elif a.command == "preview-prompts":
        conditions = spark.createDataFrame([(s,) for s in answering.strategies(a.strategies)], "strategy string")
        answering.rendered(samples_of(spark, a).withColumn("context_text", F.lit(None).cast("string")).crossJoin(F.broadcast(conditions))).select("sample_id", "strategy", "system", "prompt").show(truncate=False)
    elif a.command == "precompute":
        samples = samples_of(spark, a)
        files.write_snapshots(snapshots_of(engine, samples), a.output, {"dataset_sha256": files.folder_sha256(spark, a.input), "kb": a.path})
    elif a.command == "benchmark":
        benchmark(engine, a).show(truncate=False)
    else:
        model_rows(spark, a.models).select("*", answering.temperature(F.col("model_name"), 0.0).alias("temperature")).show(truncate=False)


if __name__ == "__main__":
    main()
