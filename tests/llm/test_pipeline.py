"""The pipeline's stages, one after the other, against what the operators' brute-force versions keep."""

import brute

import corpus_pipeline
from pyspark.sql import functions as F
from siltstone.llm import toxicity


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stays = {i: t for i, t in texts.items() if model.score(toxicity.word_buckets(t)) < 0.5}
    stays = {i: t for i, t in stays.items() if brute.exact(stays.items())[i][2]}
    near = brute.near(stays.items())
    stays = {i: t for i, t in stays.items() if near[i][2]}
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == set(stays)
    assert all(r["length"] <= 1024 for r in rows)


def test_stages_keep_columns_and_redact(spark):
    rows = [(1, "the token = abcdef123 is here", "en", "s", 29), (1, "the token = abcdef123 is here", "en", "s", 29), (2, "the  token = abcdef123 is here", "en", "s", 30), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "alone and kept", "en", "s", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_copies(spark, docs, "/root/testdata/sf0.001")
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [2, 3, None] and out.columns == corpus_pipeline.COLUMNS
    near = corpus_pipeline.drop_near_copies(spark, out, "/root/testdata/sf0.001")
    assert near.count() == 3
    clean = corpus_pipeline.redact_secrets(spark, near, "/root/testdata/sf0.001")
    assert {r["text"] for r in clean.collect()} == {"the  token = [SECRET] is here", None, "alone and kept"}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "packing"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_with_null_and_repeated_ids(spark):
    """Of five rows -- one text under id 1, near copies of it under null and 7, unrelated texts under null and 7 -- three stay."""
    one, other, third = (" ".join(f"{c}{i}" for i in range(120)) for c in "abc")
    rows = [(1, one), (None, one + " end"), (7, "start " + one), (None, other), (7, third)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, one), (None, other), (7, third)], key=str)
    # where no copy has an id, one stays
    docs = spark.createDataFrame([(None, one + x, "en", "s", 1) for x in ("", " p", " q")] + [(None, None, None, None, None)] * 2, SCHEMA)
    got = corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.001").collect()
    assert len(got) == 3 and sum(r["text"] is not None for r in got) == 1


def test_run_on_odd_tables(spark, tmp_path):
    """An empty table; then null ids and texts, repeated rows, a very long text and columns with clashing names."""
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(4)], "doc_id long, quality int, toxic int")
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(9, "alone in the table", "en", "s", 3), (9, "alone in the table", "en", "s", 3), (None, None, None, None, None), (None, "", "en", "s", 0), (10, long, "en", "s", len(long)), (None, "of no id but kept all the same", None, None, 1)]
    rows += [(k, f"good words {k}" if k % 2 == 0 else f"vile words {k}", "en", "s", 9) for k in range(4)]
    for name, data, want in (("empty", [], 0), ("odd", rows, None)):
        folder = str(tmp_path / name)
        docs = spark.createDataFrame(data, SCHEMA)
        for c in ("toxicity", "score", "kept", "_h", "gone_id", "group", "start", "h"):
            docs = docs.withColumn(c, F.lit("x"))
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        if want == 0:
            assert out == []
        else:
            whole = {(r["doc_id"], r["doc_tokens"]) for r in out}
            assert {i for i, _ in whole} >= {9, 10, None} and sum(i == 9 for i, _ in whole) == 1
            assert sum(r["length"] for r in out if r["doc_id"] == 10) > 200_000
