"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from siltstone import queries as registered

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: "null" if v is None else f"{v:.10g}" if isinstance(v, float) else str(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)
    number = lambda v: plain(float(v)) if isinstance(v, int) and not isinstance(v, bool) else plain(v)
    return [columns[k] for k in order], sorted(tuple(number(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_sql(spark, duck, name):
    df = registered.queries()[name](spark, FOLDER)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(registered.oracle_sql()[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["rag_lift", "inter_rater", "bootstrap_ci", "citation_strip", "query_decompose", "chunk_semantic", "clean_documents", "parse_mcq", "calc_metrics", "calc_selected"])
def test_others_run(spark, name):
    assert registered.queries()[name](spark, FOLDER).count() > 0
