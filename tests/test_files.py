import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.sources import files
from siltstone.streaming.ingest import event_counts, file_stream, ingest_stream


def write(folder, **texts):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_text_directory(spark, tmp_path):
    path = write(tmp_path / "d", a__md="A", b__md="B\nb", c__txt="C")
    rows = files.text_directory(spark, path)
    assert {(r["source"], r["text"]) for r in rows.collect()} == {("a.md", "A"), ("b.md", "B\nb")}
    manifest = spark.createDataFrame([(["b.md", "z.md", "c.txt"],)], "included_files array<string>")
    assert [r["source"] for r in files.of_manifest(rows, manifest).collect()] == ["b.md"]
    with pytest.raises(Exception):
        files.text_directory(spark, str(tmp_path / "missing")).count()


def test_json_sources(spark, tmp_path):
    native = {"sample_id": "1", "split": "holdout", "question": "q", "options": "a|b", "answer_key": "A"}
    legacy = {"sample_id": "2", "split": "holdout", "messages": [{"role": "user", "content": "old"}, {"role": "user", "content": "new"}, {"role": "assistant", "content": "ans"}]}
    path = write(tmp_path / "j", d__jsonl="\n".join(map(json.dumps, (native, legacy, native | {"sample_id": "3", "split": "train"}))))
    got = {r["sample_id"]: r for r in files.dataset(spark, path, "mcq").collect()}
    assert set(got) == {"1", "2"} and got["1"]["options"] == ["a", "b"] and got["2"]["question"] == "new" and got["2"]["reference_answer"] is None
    assert {r["sample_id"]: r["reference_answer"] for r in files.dataset(spark, path, "open_ended").collect()}["2"] == "ans"
    assert files.dataset(spark, path, "mcq", holdout_only=False).count() == 3
    snaps = write(tmp_path / "s", s__jsonl='{"sample_id":"1","snapshot":"x"}\n{"sample_id":"1","snapshot":"y"}\n{"sample_id":"2"}')
    assert [tuple(r) for r in files.snapshots(spark, snaps).collect()] == [("1", "y")]
    bad = write(tmp_path / "b", b__jsonl="{not json")
    with pytest.raises(Exception):
        files.strict(spark, bad, "a int").collect()
    chunk = {"chunks": [{"markdown": "# Lipids\nSome text that is long enough", "type": "text", "grounding": {"page": 3}}, {"markdown": "tiny"}, {"markdown": "CAPTION ERROR in here it is"}], "metadata": {"filename": "doc.pdf", "page_count": 9}}
    rows = files.chunk_files(spark, write(tmp_path / "c", x_response__json=json.dumps(chunk))).collect()
    assert len(rows) == 1 and rows[0]["section"] == "Lipids" and rows[0]["chunk_id"] == "doc.pdf_chunk_0" and rows[0]["content"].startswith("Source: doc.pdf\nSection: Lipids\n\n")
    summary = write(tmp_path / "r", summary_1__json=json.dumps({"rows": [{"n": 1}, {"n": 2}]}), summary_2__json="{broken", other__json="{}")
    assert sorted(r["n"] for r in files.summaries(spark, summary, "n int").collect()) == [1, 2]
    assert files.latest_file(spark, summary, "summary_*").endswith("summary_2.json")


def test_csv_and_sinks(spark, tmp_path):
    path = write(tmp_path / "c", x__csv='a,b\n" x ","line\r\none"\n,2\n')
    assert [tuple(r) for r in files.csv_rows(spark, path).collect()] == [("x", "line\none"), ("", "2")]
    one, two = spark.createDataFrame([(1, 0.5)], "n int, accuracy double"), spark.createDataFrame([(2,)], "n int")
    names = spark.createDataFrame([("m1", "Model One")], "model_id string, display string")
    out = {r["model_id"]: r for r in files.csv_union({"m1": one, "m2": two}, names).collect()}
    assert out["m1"]["display"] == "Model One" and out["m2"]["display"] is None and out["m2"]["accuracy"] is None
    files.write_ragged_csv([one, two], str(tmp_path / "ragged"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ragged")).count() == 2
    files.write_ledger(spark.createDataFrame([("m1", "r1", None), ("m2", "r2", "boom")], "model_id string, run_id string, error string"), str(tmp_path / "ledger"))
    assert files.ledger(spark, str(tmp_path / "ledger") + "/model_id=m1").count() == 1 and (tmp_path / "ledger" / "model_id=m2").is_dir()
    files.write_report({"t": one}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "t")).count() == 1
    assert files.sampled(spark.range(100), "id", 7).count() == 7
    left = files.without_documents(spark.createDataFrame([("a",), ("b",)], "doc_id string"), spark.createDataFrame([("b",)], "doc_id string"))
    assert [r[0] for r in left.collect()] == ["a"]


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>S. No</t></si><si><r><t>Ques</t></r><r><t>tion</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t> why </t></is></c></row><row><c r="A3"/></row></sheetData></worksheet>')
    rows = files.xlsx(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0]["values"]["s_no"] == "7" and rows[0]["values"]["question"] == "why"


def test_engine(spark, tmp_path):
    folder = tmp_path / "docs"
    write(folder, lipids__md="# Lipids\nLipid emulsions start early in preterm infants.", glucose__md="# Glucose\nThe glucose infusion rate is titrated.")
    engine = Engine(spark, str(tmp_path / "kb"))
    assert engine.ingest_directory(str(folder)).first()["total_chunks"] == 2 and all(engine.healthy().values())
    asked = spark.createDataFrame([("q1", "When do lipid emulsions start?"), ("q2", "What is the glucose infusion rate?")], "query_id string, text string")
    best = {r["query_id"]: r["source"] for r in engine.search(asked, 2).filter("rank = 1").collect()}
    assert best == {"q1": "lipids.md", "q2": "glucose.md"}
    assert engine.ask(asked).count() == 2
    write(folder, glucose__md="# Glucose\nIt has changed.", new__md="Sodium is new here.")
    (folder / "lipids.md").unlink()
    assert {(r["source"], r["change"]) for r in engine.update_directory(str(folder)).collect()} == {("glucose.md", "changed"), ("new.md", "added"), ("lipids.md", "removed")}
    assert {r["source"] for r in engine.chunks.collect()} == {"glucose.md", "new.md"}
    engine.delete(spark.createDataFrame([("new.md",)], "source string"))
    assert {r["source"] for r in engine.chunks.collect()} == {"glucose.md"} and engine.stats().first()["n_chunks"] == 1
    one = engine.chunks
    engine.upsert(one.withColumn("content", F.lit("anew")).unionByName(one.withColumn("doc_id", F.lit("z")).withColumn("source", F.lit("z.md"))))
    assert {(r["source"], r["content"]) for r in engine.chunks.collect()} == {("glucose.md", "anew"), ("z.md", one.first()["content"])}
    # a version that was not finished is not seen
    (tmp_path / "kb" / "v99" / "chunks").mkdir(parents=True)
    assert engine.stats().first()["n_chunks"] == 2 and all(engine.healthy().values())
    engine.reset()
    assert engine.chunks.count() == 0 and not engine.healthy()["chunks"]


def test_streams(spark, tmp_path):
    source = write(tmp_path / "in", a__md="First file about lipids.", b__md="Second file.")
    q = ingest_stream(file_stream(spark, source), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r["source"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a.md", "b.md"}
    spark.createDataFrame([(1, "2024-01-01 00:01:00", 2.0), (2, "2024-01-01 00:02:00", 3.0), (3, "2024-01-01 00:07:00", 4.0)], "event_id int, t string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), F.lit("x").alias("event_type"), "value").write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("event_id int, ts timestamp, event_type string, value double").parquet(str(tmp_path / "events"))
    q = event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["n"], r["total"]) for r in spark.sql("select * from counts").collect()) == [(1, 4.0), (2, 5.0)]
