"""Ranges of postings, vectors and leaks against plain versions of them."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone.functions.text import char_grams, keyword_tokens, normalized
from siltstone.operators import index, leakage, retrieval


def prose(rng, n, vocabulary=80):
    return " ".join(f"w{int(vocabulary * rng.random() ** 3)}x" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    docs = [(n, prose(rng, rng.randint(0, 90))) for n in range(400)] + [(1000 + n, "w0x w1x w70x rare") for n in range(25)] + [(2000, ""), (2001, None), (2002, "of the and")]
    asked = [(n, prose(rng, 6)) for n in range(30)] + [(40, "rare"), (41, "w0x w0x w0x"), (42, "zebra"), (43, "")]
    tokens = dict(spark.createDataFrame(docs, "i long, t string").select("i", keyword_tokens(F.coalesce("t", F.lit("")))).collect())
    terms = dict(spark.createDataFrame(asked, "i long, t string").select("i", keyword_tokens(F.col("t"))).collect())
    return docs, asked, tokens, terms


def bm25_brute(tokens, terms, k):
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for own in tokens.values() for t in set(own))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    out = []
    for q, asked in terms.items():
        scores = []
        for d, own in tokens.items():
            tf = Counter(own)
            score = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(own) / mean)) for t in asked if t in tf)
            if score > 0:
                scores.append((-math.floor(score * 1e6 + 0.5), d))
        out += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def top(spark, docs, asked, k, parts=3):
    built = index.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts))
    return built, sorted(tuple(r) for r in index.top_k(spark.createDataFrame(asked, "query_id long, text string"), built, k).select("query_id", "doc_id", "score_millionths", "rank").collect())


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_top_k(spark, corpus, k, monkeypatch):
    docs, asked, tokens, terms = corpus
    monkeypatch.setattr(index, "BLOCK_QUERIES", 1 << 20 if k == 5 else 11)
    built, got = top(spark, docs, asked, k)
    assert got == bm25_brute(tokens, terms, k)
    assert built.documents.count() == len(docs) and built.postings.count() == sum(len(set(t)) for t in tokens.values())


def batches_of(docs, tokens, size=50):
    for at in range(0, len(docs), size):
        some = docs[at : at + size]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([tokens[i] for i, _ in some], pa.list_(pa.string()))], names=["doc_id", "tokens"])


class Task:
    def partitionId(self):
        return 3


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(index, "RANGE_TOKENS", 700)
    monkeypatch.setattr(index, "TaskContext", type("T", (), {"get": staticmethod(Task)}))


def test_ranges_and_their_bounds(corpus, small_ranges):
    docs, asked, tokens, terms = corpus
    rows = [r for b in index.ranged(batches_of(docs, tokens)) for r in index.rows_of(b)]
    assert len(rows) > 10 and len({r["range_id"] for r in rows}) == len(rows) and sum(r["n"] for r in rows) == len(docs)
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    every, brute = sorted({t for own in terms.values() for t in own}), {}
    for q, d, s, _ in bm25_brute(tokens, terms, 3):
        brute.setdefault(q, []).append((-s, d))
    df = Counter(t for own in tokens.values() for t in set(own))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    ranges, looked = [index.Range(r, pa.array(every), mean) for r in rows], 0
    for q, own in terms.items():
        counts = Counter(t for t in own if t in idf)
        if not counts:
            continue
        at, weights = np.array([every.index(t) for t in counts]), np.array([c * idf[t] for t, c in counts.items()])
        best = []
        for r, own_range in zip(rows, ranges):
            places, scores = own_range.best(at, weights, 3, -best[-1][0] if len(best) == 3 else None)
            looked += len(places)
            best = sorted([*best, *((-math.floor(s * 1e6 + 0.5), r["ids"][int(p)].as_py()) for p, s in zip(places, scores))])[:3]
        assert best == sorted(brute.get(q, []))
    # bounds leave out most of what shares a term with a query
    assert looked < sum(1 for own in terms.values() for d in tokens.values() if set(own) & set(d)) / 3


def test_compacted(corpus, small_ranges):
    docs, _, tokens, _ = corpus
    batches, dead = [], set()
    for b in index.ranged(batches_of(docs, tokens)):
        row = next(index.rows_of(b))
        gone = list(range(0, row["n"], 3))
        dead |= {row["ids"][g].as_py() for g in gone}
        batches.append(b.set_column(b.schema.get_field_index("dead"), "dead", pa.array([gone], pa.list_(pa.int32()))))
    live = {i: t for i, t in tokens.items() if i not in dead}
    unpacked = lambda bs: Counter((i, t, tf, dl) for b in index._unpacked(bs) for i, dl, t, tf in zip(*(c.to_pylist() for c in b.columns)))
    want = Counter((i, t, c, len(own)) for i, own in live.items() for t, c in Counter(own).items())
    assert unpacked(iter(batches)) == want
    merged = list(index.compacted(iter(batches)))
    assert unpacked(iter(merged)) == want and sum(r["n"] for b in merged for r in index.rows_of(b)) == len(live) and len(merged) < len(batches)


# --- vectors


def nearest_brute(queries, rows, k, exclude):
    out = []
    for q, a in queries:
        scores = []
        for i, b in rows:
            if b is None or None in b or len(a) != len(b) or not all(map(math.isfinite, b)) or not any(b) or exclude and i == q or not any(a):
                continue
            dot = lambda x, y: sum(p * r for p, r in zip(x, y))
            scores.append((-dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))), i))
        out += [(q, i, r) for r, (_, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_vectors(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    rows = [(n, [float(x) for x in rng.integers(-3, 4, 5)]) for n in range(300)]
    rows += [(500, None), (501, [0.0] * 5), (502, [1.0, None, 1.0, 1.0, 1.0]), (503, [float("nan")] * 5), (504, [1.0, 2.0]), (505, []), (506, [float("inf")] * 5)]
    rows = [(i if kind == "long" else f"v{i}", v) for i, v in rows]
    queries = rows[:20] + [(rows[-3][0], [2.0, 1.0]), (rows[301][0], [0.0] * 5)]
    df, asked = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>").repartition(4), spark.createDataFrame(queries, f"query_id {kind}, embedding array<double>")
    for exclude, block in ((False, 2000), (True, 7)):
        monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", block)
        got = sorted((r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.vector_top_k(asked, df, 4, exclude_self=exclude).collect())
        assert got == nearest_brute(queries, rows, 4, exclude)


# --- leaks


def leaks_brute(spark, questions, docs, threshold):
    def sets(rows):
        df = spark.createDataFrame(rows, "i long, t string").select("i", normalized(F.coalesce("t", F.lit(""))).alias("n"), char_grams(F.coalesce("t", F.lit(""))).alias("g"))
        return [(r["i"], r["n"], set(r["g"])) for r in df.collect()]

    out = []
    for q, qn, qg in sets(questions):
        for d, dn, dg in sets(docs):
            exact = bool(qn) and bool(dn) and (qn in dn or dn in qn)
            jaccard = len(qg & dg) / len(qg | dg) if qg | dg else 1.0
            if exact or jaccard >= threshold:
                out.append((q, d, exact, round(jaccard, 12)))
    return sorted(out)


@pytest.mark.parametrize("chars", [1 << 20, 300])
def test_leaks(spark, monkeypatch, chars):
    rng = random.Random(6)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", chars)
    questions = [(n, prose(rng, 12, 500)) for n in range(25)] + [(50, ""), (51, None), (52, "a b"), (53, "é"), (54, "a" * 60), (55, "..."), (56, "Zebra crossing, at noon?")]
    docs = [(n, prose(rng, rng.randint(1, 60), 500)) for n in range(60)]
    for n, (_, t) in enumerate(questions[:25]):
        words = t.split()
        docs += [(100 + n, f"before {t.upper()}! after {prose(rng, 30)}"), (200 + n, " ".join(words[: -1 - n % 4] + ["other"])), (300 + n, " ".join(words[3:6]))]
    docs += [(400, ""), (401, None), (402, "a"), (403, "x é y"), (404, "a" * 300), (405, "a" * 9), (406, "zebra"), (407, "b c"), (408, "!"), (409, "a b c d e f g h")]
    q, d = spark.createDataFrame(questions, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r["query_id"], r["doc_id"], r["exact"], round(r["jaccard"], 12)) for r in leakage.leaks(q, d).collect())
    assert got == leaks_brute(spark, questions, docs, 0.75)
    assert any(j < 0.75 and e for _, _, e, j in got) and any(j >= 0.75 and not e for _, _, e, j in got)


def test_compared_by_shuffle(spark, monkeypatch):
    rng = random.Random(7)
    docs, asked = [(n, prose(rng, 20)) for n in range(30)], [(n, prose(rng, 10)) for n in range(5)]
    q, d = spark.createDataFrame(asked, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, leakage.leakage_audit(q, d, pool=10).collect()))
    monkeypatch.setattr(leakage, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(leakage, "LISTED_PAIRS", 7)
    assert sorted(map(tuple, leakage.leakage_audit(q, d, pool=10).collect())) == want and len(want) == 25


def test_knowledge_base_audit(spark):
    # the case is no part of the question; a leak beyond the candidates counts
    docs = [(1, "A child of two years. protein needs of infants are high"), (2, "protein"), (3, "unrelated"), (4, "protein needs of infants are high")]
    asked = spark.createDataFrame([("a", "Case context:\nA child of two years.\n\nQuestion:\nProtein needs of infants are high?"), ("b", "what is lipid")], "sample_id string, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = leakage.kb_audit(asked, d, index.build(d), question_id="sample_id", report=1).collect()
    assert [(r["query_id"], r["doc_id"], r["exact"], r["suspected"], r["leaks_anywhere"]) for r in got] == [("a", 4, True, True, 3)]


def test_split_report(spark):
    rows = spark.createDataFrame([("1", " What? ", "holdout"), ("2", "what?", "train"), ("2", "other", "holdout"), ("3", "third", None), ("4", "fourth", "valid")], "sample_id string, question string, split string")
    r = leakage.split_report(rows, "sample_id", "question", "split").first()
    assert (r["total_records"], r["holdout_records"], r["train_like_records"]) == (5, 2, 3)
    assert (r["question_overlap_count"], r["question_overlap_examples"], r["sample_id_overlap_count"], r["sample_id_overlap_examples"], r["leakage_detected"]) == (1, ["what?"], 1, ["2"], True)
    clean = leakage.split_report(rows.filter("sample_id in ('3', '4')"), "sample_id", "question", "split").first()
    assert not clean["leakage_detected"] and clean["question_overlap_examples"] == []


def test_batches_of_one_score_go_by_their_best(spark):
    # two lists give either key the same score: what counts then is the better rerank score, even below zero
    rows = [(1, "a", 1, True, 0, -0.5), (1, "b", 1, True, 0, 0.0)]
    got = retrieval.fuse_batches(spark.createDataFrame(rows, "query_id long, key string, batch_rank int, is_original boolean, iteration int, rerank_score double"), 5).orderBy("rank").collect()
    assert [r["key"] for r in got] == ["b", "a"]


def test_row_groups_of_ranges_are_small(spark):
    """A reader holds a row group of a column at once: it has a few ranges, not all of a task."""
    tokens = F.sequence(F.col("doc_id"), F.col("doc_id") + index.RANGE_TOKENS).cast("array<string>")
    built = index.ranges_of(spark.range(8, numPartitions=1).withColumnRenamed("id", "doc_id"), tokens=tokens)
    files = [pq.ParquetFile(f).metadata for f in Path(built.written_at.removeprefix("file:")).glob("*.parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == 8 and max(groups) == 1
