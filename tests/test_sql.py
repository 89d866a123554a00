"""Functions of SQL against the library's own, and against plain versions on small groups."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone import sql
from siltstone.functions.text import decompose_query
from siltstone.operators import chunking
from siltstone.queries import queries

FOLDER = "/root/testdata/sf0.001"
TEXTS = ["", None, "   ", "dose", "What dose is safe in infants; and which monitoring labs follow then? AND WHICH MONITORING LABS FOLLOW", "risk of a\n\ttoxicity while the patient is fed, vs. the child is not fed at all", "one two three four and One Two Three Four", "ümlaut müll straße groß then δοκιμή ένα δύο τρία"]


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    sql.register(spark)
    return spark


def test_query_parts(session):
    rows = session.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    for most in (1, 3, 9):
        want = {(r["k"], r["pos"], r["col"]) for r in rows.select("k", F.posexplode(decompose_query(F.col("text"), most))).collect()}
        got = session.sql(f"SELECT k, p.* FROM {{rows}}, LATERAL query_parts(text, {most}) p", rows=rows)
        assert {tuple(r) for r in got.collect()} == want and want
    # the function is unfolded into the query: no worker
    assert "Python" not in session.sql("SELECT p.* FROM {rows}, LATERAL query_parts(text) p", rows=rows)._jdf.queryExecution().toString()


def kappa(cells):
    cells = [c for c in cells if None not in c]
    n = sum(c[2] for c in cells)
    a, b = Counter(), Counter()
    for x, y, m in cells:
        a[x] += m
        b[y] += m
    chance = sum(a[x] * b[x] for x in a)
    return 0.0 if n * n == chance else (sum(m for x, y, m in cells if x == y) * n - chance) / (n * n - chance)


@pytest.mark.parametrize("cells", [[], [("A", "A", 3)], [("A", "A", 3), ("A", "B", 2), ("B", "B", 4), ("C", "A", 1)], [("A", None, 5), ("A", "B", 2), ("B", "B", 1)], [("A", "B", 1), ("B", "A", 1)]])
def test_kappa_of_cells(session, cells):
    rows = session.createDataFrame([(cells,)], "cells array<struct<x: string, y: string, m: long>>")
    assert session.sql("SELECT kappa_of_cells(cells) FROM {rows}", rows=rows).first()[0] == pytest.approx(kappa(cells), abs=1e-12)


def test_statistics_at_the_edges(session):
    one = lambda text: session.sql(f"SELECT {text}").first()[0]
    assert one("kappa_of_cells(NULL)") == 0.0
    assert tuple(one("wilson_interval(0, 0)")) == (0.0, 0.0, 0.0) and tuple(one("wilson_interval(NULL, NULL)")) == (0.0, 0.0, 0.0)
    low, high = tuple(one("wilson_interval(8, 10)"))[1:]
    assert (round(low, 4), round(high, 4)) == (0.4902, 0.9433)
    assert one("wilson_interval(12, 10)") == one("wilson_interval(10, 10)") and one("wilson_interval(12, 10).ci_high") == pytest.approx(1.0, abs=1e-12)
    # all raters agree, on two labels; all on one; one rater
    assert one("kappa_of_counts(2, 3, 18, array(3, 3))") == 1.0 and one("kappa_of_counts(2, 3, 18, array(6))") == 0.0 and one("kappa_of_counts(2, 1, 2, array(1, 1))") is None


def test_chunks(session):
    got = {}
    for r in queries()["sql_recursive_chunks"](session, FOLDER).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["content"], r["is_table"]))
    docs = session.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: [(k, c, t) for k, (c, t) in enumerate(chunking.chunked(d["text"], 600, 100))] for d in docs}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_semantic_chunks(session):
    key = lambda rows: sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in rows.collect())
    assert key(queries()["sql_semantic_chunks"](session, FOLDER)) == key(queries()["chunk_semantic"](session, FOLDER))


def test_chunks_of_odd_texts(session):
    rows = session.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "short"), (5, "x" * 2500), (6, "| a | b |\n|---|---|\n| 1 | 2 |\n")], "k int, text string")
    got = session.sql("SELECT k, c.* FROM {rows}, LATERAL recursive_chunks(text) c", rows=rows).collect()
    assert {r["k"] for r in got} == {4, 5, 6} and all(len(r["content"]) <= 1000 for r in got) and [r["is_table"] for r in got if r["k"] == 6] == [True]
    assert session.sql("SELECT c.* FROM {rows}, LATERAL semantic_chunks(text) c", rows=rows.filter("k < 4")).count() == 0
