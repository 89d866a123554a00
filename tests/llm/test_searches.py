"""Clustering, lexical search and decontamination against brute force, and on the cases that must not crash."""

import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import lower
from pyspark.sql import functions as F

from siltstone.llm import clustering, decontaminate, lexical
from siltstone.llm.words import word_runs

ODD = [None, "", " \t\n", "word", "A b-C", "é" * 40 + " Ünïcode\x00x", "\U0001f642 ok", "x" * 5000, "a " * 3000, "1 2 3 4 5 6 7 8 9 10 11 12", "_under_score_ [x]"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def prose(rng, n, vocabulary=60):
    return " ".join(f"W{int(vocabulary * rng.random() ** 2)}" + rng.choice(["", "", ",", ". "]) for _ in range(n))


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_words(size):
    rng = random.Random(size)
    for text in [*ODD, prose(rng, 300)]:
        assert [w.decode() for run in word_runs((text or "").encode(), size) for w in run] == words(text)


# --- clustering


def cluster_brute(rows, k, rounds, dims):
    keep = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in keep)
    centroids = [v for _, _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in keep]
        new = []
        for j, c in enumerate(centroids):
            mine = [v for (_, v), o in zip(keep, own) if o == j]
            new.append([sum(col) // len(mine) for col in zip(*mine)] if mine else c)
        centroids = new
    last = [(i, *nearest(v)) for i, v in keep]
    inertia = {j: sum(d for _, d, o in last if o == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in last), key=str)


def clustered(spark, rows, k, rounds, dims, kind="float"):
    df = spark.createDataFrame([(i, v, 5, 6.0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance double, x string").repartition(3)
    got = clustering.cluster(df, k, rounds, dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_clusters(spark):
    rng = np.random.default_rng(1)
    # on a coarse grid, so that many distances are equal
    rows = [(n, [float(x) / 256 for x in rng.integers(-2, 3, 4)]) for n in range(300)]
    rows += rows[:40] + [(None, [0.0, 0.0, 0.0, 0.0]), (None, None), (900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [-0.001, 0.001, -1.0, 0.999])]
    for k, rounds in ((1, 2), (2, 0), (12, 5), (200, 3)):
        assert clustered(spark, rows, k, rounds, 4) == cluster_brute(rows, k, rounds, 4)


def test_clusters_of_few_and_of_extreme_vectors(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-4.0, 0.5])]
    assert clustered(spark, few, 40, 5, 2) == cluster_brute(few, 40, 5, 2)
    assert clustered(spark, [], 40, 5, 2) == []
    assert clustered(spark, [(1, None)], 40, 5, 2) == []
    most = clustering.MOST / 256
    far = [(n, [s * most, t * most]) for n, (s, t) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1), (0, 0), (0.5, 0.25)])]
    assert clustered(spark, far, 3, 4, 2, "double") == cluster_brute(far, 3, 4, 2)
    beyond = clustered(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0])], 2, 1, 2, "double")
    assert [r[2] for r in beyond] == [0, 0]


def test_ball_search_skips_what_is_far():
    rng = np.random.default_rng(2)
    centers = rng.integers(-4000, 4000, (30, 8))
    x = (centers[rng.integers(0, 30, 3000)] + rng.integers(-200, 200, (3000, 8))).astype(np.int64)
    balls = clustering.Balls(centers.astype(np.int64))
    cluster, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros(3000)
    balls.search(x, cluster, upper, lower)
    every = np.stack([clustering.squares(x, c) for c in balls.centroids], axis=1)
    assert (cluster == every.argmin(axis=1)).all()
    second = np.sort(every, axis=1)[:, 1]
    assert (lower <= np.sqrt(second) + 1e-6).all() and (upper >= np.sqrt(every.min(axis=1)) - 1e-6).all()
    # bounds that hold leave nothing to measure, and a small move little
    assert balls.search(x, cluster, upper, lower) == 0
    moved = balls.centroids + rng.integers(-9, 9, (30, 8))
    way = np.sqrt(clustering.squares(moved, balls.centroids).astype(float))
    upper += way[cluster]
    lower -= way.max()
    assert clustering.Balls(moved).search(x, cluster, upper, lower) < 3000 * 3
    assert (cluster == np.stack([clustering.squares(x, c) for c in moved], axis=1).argmin(axis=1)).all()


# --- lexical search


def search_brute(docs, items, k):
    counted = [(i, words(t)) for i, t in docs]
    counted = [(i, w) for i, w in counted if w]
    n_docs, total = len(counted), sum(len(w) for _, w in counted)
    df = {}
    for _, w in counted:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in counted:
            m = 100 - 50 + (50 * len(w) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in terms if t in w)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs = [(n, prose(rng, rng.randint(1, 120))) for n in range(150)]
    docs += [(1000 + n, t) for n, t in enumerate(ODD)] + docs[:20] + [(2000 + n, docs[3][1]) for n in range(30)] + [(None, docs[3][1]), (None, "w1 w2")]
    items = [(n, prose(rng, 8)) for n in range(12)] + [(3, "w50 w51"), (20, None), (21, ""), (22, "unmet words"), (23, docs[3][1]), (None, "W1 ok é")]
    return docs, items


def frames(spark, docs, items, parts=5):
    d = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in docs], "doc_id long, text string, score int, rank string, df int").repartition(parts)
    return d, spark.createDataFrame([(i, t, 7, 8) for i, t in items], "item_id long, text string, doc_id int, score int")


def test_search(spark, corpus, tmp_path, monkeypatch):
    d, q = frames(spark, *corpus)
    index = lexical.build(d)
    for k in (1, 7, 50, 1000):
        assert sorted(map(tuple, lexical.search(index, q, k).collect()), key=str) == search_brute(*corpus, k)
    index.write(str(tmp_path / "index"))
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 3)
    again = lexical.search(lexical.LexicalIndex.read(spark, str(tmp_path / "index")), q, 7)
    assert sorted(map(tuple, again.collect()), key=str) == search_brute(*corpus, 7)


def test_search_of_nothing(spark):
    d, q = frames(spark, [], [(1, "a")], 1)
    assert lexical.search(lexical.build(d), q).collect() == []
    d, q = frames(spark, [(1, None), (2, " ")], [(1, "a")], 1)
    assert lexical.search(lexical.build(d), q).collect() == []
    d, q = frames(spark, [(1, "a")], [], 1)
    assert lexical.search(lexical.build(d), q).collect() == []
    strings = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.search(lexical.build(d), strings).collect()] == [("x", 1, 1)]


def test_shards_are_cut(monkeypatch, corpus):
    docs, _ = corpus
    monkeypatch.setattr(lexical, "SHARD_TERMS", 200)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    rows = [r for b in lexical.sharded(iter([batch])) for r in b.to_pylist()]
    assert len(rows) > 10 and sum(r["terms"] for r in rows) == sum(len(words(t)) for _, t in docs)
    found = {}
    for r in rows:
        ids, start, doc, tf = (np.frombuffer(r[c], t) for c, t in (("doc_id", np.int64), ("start", np.int64), ("doc", np.int32), ("tf", np.int32)))
        assert (np.diff(ids[: len(ids) - r["none"]]) >= 0).all()
        for n, term in enumerate(r["term"].split(b" ")):
            for p in range(start[n], start[n + 1]):
                key = (ids[doc[p]], term.decode())
                found[key] = found.get(key, 0) + int(tf[p])
    want = {}
    for i, t in docs:
        for w in words(t):
            want[i or 0, w] = want.get((i or 0, w), 0) + 1
    assert found == want


def test_cut_keeps_ties_by_id():
    score, ids = np.array([5, 5, 5, 9, 5]), np.array([4, 2, 3, 9, 1])
    assert ids[lexical.cut(score, np.array([False, False, True, False, False]), ids, 3)].tolist() == [9, 1, 2]


def test_row_groups_of_shards_are_small(spark):
    """A reader holds a row group of a column at once: it has a few shards, not all of a task."""
    texts = spark.range(6, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + lexical.SHARD_TERMS).cast("array<string>")).alias("text"))
    built = lexical.build(texts)
    files = [pq.ParquetFile(f).metadata for f in Path(built.shards.written_at.removeprefix("file:")).glob("*.parquet")]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 6 and max(g.num_rows for g in groups) <= 2
    q = spark.createDataFrame([(1, "0"), (2, f"{lexical.SHARD_TERMS + 5} 3")], "item_id long, text string")
    assert {(r["query_id"], r["doc_id"]) for r in lexical.search(built, q).filter("rank = 1").collect()} == {(1, 0), (2, 5)}


# --- decontamination


def contaminated_brute(docs, items, m=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(len(w) - m, 0) + 1):
            if w:
                windows.setdefault(tuple(w[j : j + m]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, who = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if own := windows.get(tuple(w[j : j + size])):
                    hit.update(range(j, j + size))
                    who |= own
        out.append((i, len(w), len(hit), sorted(who)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(5)
    items = [(n, prose(rng, rng.randint(8, 40), 40)) for n in range(30)]
    items += [(30, "w1 w2"), (31, "seldom"), (32, None), (33, ""), (34, "a a a a a a a a a a a"), (3, items[4][1]), (3, "one more text of item three"), (35, items[5][1]), (None, "no id here"), (36, "é ü É")]
    docs = [(n, prose(rng, rng.randint(0, 200), 40)) for n in range(120)]
    docs += [(200 + n, prose(rng, 5) + " " + t.upper() + "! " + prose(rng, 5)) for n, (_, t) in enumerate(items) if t] + [(400 + n, t) for n, t in enumerate(ODD)]
    return docs + docs[-40:] + [(None, items[0][1]), (None, None)], items


@pytest.mark.parametrize("block_words", [1 << 20, 100])
def test_windows(spark, leaks, block_words):
    d, q = frames(spark, *leaks)
    got = decontaminate.scan(d, q, block_words=block_words).collect()
    assert sorted([(r["doc_id"], r["n_words"], sum(b - a for a, b in r["spans"]), r["items"]) for r in got], key=str) == contaminated_brute(*leaks)
    for r in got:
        assert all(a[1] < b[0] for a, b in zip(r["spans"], r["spans"][1:]))


@pytest.mark.parametrize("size", [1, 9, 64])
def test_windows_across_runs(leaks, monkeypatch, size):
    docs, items = leaks
    every = decontaminate.tables([("" if i is None else str(i), (t or "").encode()) for i, t in items])
    want = {str(r): r for r in contaminated_brute(docs, items)}
    monkeypatch.setattr(decontaminate, "word_runs", lambda text: word_runs(text, size))
    for i, t in docs:
        n, spans, who = decontaminate.search((t or "").encode(), every)
        assert str((i, n, sum(b - a for a, b in spans), sorted(who))) in want


def test_shifts_skip_most_words():
    every = decontaminate.tables([("1", b" ".join(b"i%d" % n for n in range(40)))])
    looked = []

    class Counted(list):
        def __getitem__(self, k):
            if isinstance(k, int):
                looked.append(k)
            return super().__getitem__(k)

    assert list(every[0].search(Counted([b"x"] * 9000), 0)) == [] and len(looked) <= 1001


def test_no_items_and_no_documents(spark):
    d, q = frames(spark, [(1, "a b"), (2, None)], [], 1)
    assert sorted((r["doc_id"], r["n_words"], r["spans"], r["items"]) for r in decontaminate.scan(d, q).collect()) == [(1, 2, [], []), (2, 0, [], [])]
    d, q = frames(spark, [], [(1, "a b")], 1)
    assert decontaminate.scan(d, q).collect() == []


# --- the SQL of the queries


@pytest.mark.parametrize("name", ["op11_clustering", "op12_lexical", "op13_decontaminate"])
def test_queries_against_sql(spark, name):
    import duckdb

    from siltstone.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, folder)
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
