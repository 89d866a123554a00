"""Knowledge bases that change, against one that is built anew; streams of changes against the same done at once."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone import tables
from siltstone.plans import ingest
from siltstone.streaming import ingest as streaming

WORDS = [f"word{n}" for n in range(50)]


def text(rng, n=None):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30) if n is None else n)) + "."


def chunk_rows(spark, rows):
    """rows: (doc_id, source, content)."""
    df = spark.createDataFrame(rows, "doc_id string, source string, content string")
    return df.withColumn("sha256", F.sha2(F.concat("source", "content"), 256)).withColumn("is_table", F.lit(False))


def state(store):
    index = store.index
    return {
        "chunks": sorted((r["doc_id"], r["source"], r["content"]) for r in store.chunks.select("doc_id", "source", "content").collect()), "terms": sorted((r["term"], r["df"], round(r["idf"], 9)) for r in index.terms.collect()), "totals": (index.n, index.total),
        "postings": Counter(tuple(r) for r in index.postings.collect()), "documents": Counter(tuple(r) for r in index.documents.collect()), "manifest": sorted((r["source"], r["chunk_count"]) for r in store.manifest.collect()),
    }


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    held = {f"s{n}::{k}": (f"s{n}", text(rng)) for n in range(40) for k in range(rng.randint(1, 4))}
    held["empty::0"] = ("empty", "")
    path, ready = str(tmp_path / "kb"), lambda: [(i, s, t) for i, (s, t) in held.items()]
    ingest.write_version(chunk_rows(spark, ready()), path, {})
    asked = spark.createDataFrame([(n, text(rng, 5)) for n in range(10)], "query_id long, text string")
    from siltstone.operators import index as keyword

    seen = set()
    for step in range(6):
        store = ingest.Store.open(spark, path)
        if step % 3 == 2:  # sources go
            gone = [f"s{n}" for n in rng.sample(range(40), 3)] + ["never"]
            ingest.delete(spark, spark.createDataFrame([(g,) for g in gone], "source string"), path)
            held = {i: v for i, v in held.items() if v[0] not in gone}
        else:  # chunks are replaced, some move to another source, and new ones come
            fresh = {i: (held[i][0] if rng.random() < 0.7 else "moved", text(rng)) for i in rng.sample(sorted(held), 4)} | {f"new{step}::{k}": (f"new{step}", text(rng)) for k in range(3)}
            ingest.upsert(chunk_rows(spark, [(i, s, t) for i, (s, t) in fresh.items()]), path)
            held |= fresh
        now = ingest.Store.open(spark, path)
        seen.add(len(now.segments))
        if step in (1, 5):
            anew = str(tmp_path / f"anew{step}")
            ingest.write_version(chunk_rows(spark, ready()), anew, {})
            other = ingest.Store.open(spark, anew)
            assert state(now) == state(other)
            best = lambda i: sorted(map(tuple, keyword.top_k(asked, i, 5).select("query_id", "doc_id", "score_millionths", "rank").collect()))
            assert best(now.index) == best(other.index)
        # a reader of the version before still sees it
        assert store.chunks.count() > 0
    assert max(seen) > 3
    before = state(ingest.Store.open(spark, path))
    ingest.compact(ingest.Store.open(spark, path))
    after = ingest.Store.open(spark, path)
    assert len(after.segments) == 1 and state(after) == before


def test_a_change_writes_what_it_changes(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{n}::0", f"s{n}", text(rng, 40)) for n in range(400)]
    path = str(tmp_path / "kb")
    ingest.write_version(chunk_rows(spark, rows), path, {})
    whole = ingest.Store.open(spark, path)
    ingest.upsert(chunk_rows(spark, [(i, s, "fresh words stand") for i, s, _ in rows[:4]]), path)
    now = ingest.Store.open(spark, path)
    assert now.segments == (1, 2)
    part = lambda name: spark.read.parquet(f"{path}/v2/{name}")
    assert part("chunks").count() == 4 and part("ranges").agg(F.sum("n"), F.sum("total")).first()[:] == (4, 12) and part("gone").count() == 4 and part("manifest").count() == 4
    assert part("terms").filter("df < 0").count() <= len(WORDS) and part("terms").filter("term = 'words'").first()["df"] == 4
    assert whole.index.postings.count() > 50 * part("ranges").select(F.explode("dfs").alias("d")).agg(F.sum("d")).first()[0]


def test_compacted_when_due(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    ingest.write_version(chunk_rows(spark, [(f"{n}", f"s{n}", f"word{n} infants") for n in range(8)]), path, {})
    monkeypatch.setattr(ingest, "MAX_GONE", 2.0)
    monkeypatch.setattr(ingest, "MAX_SEGMENTS", 3)
    for n in range(2):
        ingest.upsert(chunk_rows(spark, [(f"{n}", f"s{n}", "anew")]), path)
    store = ingest.Store.open(spark, path)
    assert len(store.segments) == 1 and store.chunks.filter("content = 'anew'").count() == 2 and store.totals == (8, 12 + 2)
    monkeypatch.setattr(ingest, "MAX_GONE", 0.25)
    ingest.delete(spark, spark.createDataFrame([(f"s{n}",) for n in range(4)], "source string"), path)
    assert len(ingest.Store.open(spark, path).segments) == 1 and ingest.Store.open(spark, path).totals == (4, 8)
    ingest.delete(spark, spark.createDataFrame([(f"s{n}",) for n in range(8)], "source string"), path)
    empty = ingest.Store.open(spark, path)
    assert empty.totals == (0, 0) and empty.chunks.count() == 0 and empty.index.terms.count() == 0 and empty.manifest.count() == 0


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "kb")
    ingest.write_version(chunk_rows(spark, [("1", "a", "x y")]), path, {})
    one, two = tables.upcoming(spark, path), tables.upcoming(spark, path)
    assert one != two
    store = ingest.Store.open(spark, path)
    ingest.upsert(chunk_rows(spark, [("2", "b", "z z")]), path)
    with pytest.raises(tables.Outdated):
        ingest.replace(store, chunk_rows(spark, [("3", "c", "w w")]), store.chunks.limit(0), {})
    assert sorted(r["doc_id"] for r in ingest.Store.open(spark, path).chunks.collect()) == ["1", "2"]


def test_many_sources_are_joined(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    ingest.write_version(chunk_rows(spark, [(f"{n}", f"s{n}", "x") for n in range(20)]), path, {})
    store, some = ingest.Store.open(spark, path), spark.createDataFrame([(f"s{n}",) for n in range(7)], "source string")
    pushed = sorted(r["doc_id"] for r in store.chunks_from(some).collect())
    assert "EqualNullSafe" in store.chunks_from(some)._jdf.queryExecution().toString() or "<=>" in store.chunks_from(some)._jdf.queryExecution().toString()
    monkeypatch.setattr(ingest, "PUSHED_SOURCES", 3)
    assert sorted(r["doc_id"] for r in store.chunks_from(some).collect()) == pushed == [str(n) for n in range(7)]


def test_stream_of_changes(spark, tmp_path):
    """Files are added, rewritten, left alone and removed between runs of the stream; after each, what it keeps is what an
    ingestion of the folder gives."""
    feed, path, folder = str(tmp_path / "feed"), str(tmp_path / "kb"), {}
    steps = [{"a.md": "Lipid emulsions start early in infants.", "b.md": "Glucose is titrated."}, {"a.md": "Lipids were rewritten."}, {}, {"b.md": None, "c.md": "Sodium is new here."}, {"b.md": "Glucose is back."}]
    for n, step in enumerate(steps):
        folder = {s: t for s, t in (folder | step).items() if t is not None}
        streaming.folder_feed(spark.createDataFrame(list(folder.items()), "source string, text string"), feed)
        streaming.sync_stream(streaming.feed_stream(spark, feed), path, str(tmp_path / "cp")).awaitTermination(120)
        got = sorted((r["source"], r["content"]) for r in ingest.Store.open(spark, path).chunks.collect())
        assert got == sorted(folder.items())
        if n == 1:
            version = ingest.Store.open(spark, path).version
        if n == 2:
            assert ingest.Store.open(spark, path).version == version
    other = str(tmp_path / "other")
    ingest.ingest(spark.createDataFrame(list(folder.items()), "source string, text string"), other)
    assert state(ingest.Store.open(spark, path)) == state(ingest.Store.open(spark, other))


def test_changes_in_one_batch(spark, tmp_path):
    """The last of several events counts; older ones, equal texts and removals of what is not there are none."""
    rows = [("a", "one", 1), ("a", "two", 3), ("a", "late", 2), ("b", None, 1), ("c", "x", 1)]
    folder, out = str(tmp_path / "e"), []

    def run():
        q = streaming.changes(spark.readStream.schema(streaming.EVENTS).json(folder)).writeStream.foreachBatch(lambda b, _: out.append(sorted(map(tuple, b.collect()), key=str))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    spark.createDataFrame(rows, streaming.EVENTS).coalesce(1).write.json(folder)
    run()
    assert out.pop() == [("a", "two", "added"), ("c", "x", "added")]
    spark.createDataFrame([("a", "old", 2), ("b", None, 5), ("c", None, 4), ("d", "y", 1)], streaming.EVENTS).coalesce(1).write.option("ignoreNullFields", False).mode("append").json(folder)
    run()
    assert out.pop() == [("c", None, "removed"), ("d", "y", "added")]
