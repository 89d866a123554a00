"""The engine's functions for queries in SQL (``spark.sql``): ``register`` makes them known to a session.

Statistics and the parts of a query are SQL functions, which the optimiser unfolds into the query, so nothing of them leaves
the JVM. Chunkers are table functions around an Arrow UDF: one batch of texts goes to a worker, and a generator makes rows
of what comes back.

A statistic over a group takes its counts, not its rows: count by label first, which Spark does in part before it shuffles,
then hand the function the few counts of a group. A Python aggregate would need each group whole in one task.

| Function | Rows or value |
|-|-|
| ``wilson_interval(k, n)`` | struct of p_hat, ci_low, ci_high; zeros where n is not positive; k counts as between 0 and n |
| ``kappa_of_cells(cells)`` | Cohen's kappa of an array of (label a, label b, count); cells with a null label are left out; 0 without cells, or where chance agreement is complete |
| ``kappa_of_counts(items, raters, squares, labels)`` | Fleiss' kappa of items with as many raters each: the sum of squared counts per item and label, and the count of each label in all; null below two raters |
| ``query_parts(text)`` | part_no, part: the query, its clauses and its expansions, at most ``most``; none of an empty or null text |
| ``recursive_chunks(text)`` | chunk_index, content, is_table; none of an empty or null text; size, overlap and least may follow |
| ``semantic_chunks(text)`` | chunk_index, content; likewise; threshold, least and most may follow |
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.functions import models
from siltstone.functions.text import CLAUSE, EXPANSIONS, SPACE
from siltstone.operators import chunking


def literal(text: str) -> str:
    """A string of SQL in which nothing is an escape."""
    if "'" in text:
        raise ValueError("the text of a raw literal holds no quote")
    return f"R'{text}'"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, {literal(SPACE)}, ' '))"


def let(value: str, name: str, body: str) -> str:
    """The body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


WILSON = """wilson_interval(k BIGINT, n BIGINT, z DOUBLE DEFAULT 1.959963984540054D) RETURNS STRUCT<p_hat: DOUBLE, ci_low: DOUBLE, ci_high: DOUBLE>
RETURN CASE WHEN n > 0 THEN """ + let(
    "struct(CAST(greatest(0, least(k, n)) AS DOUBLE) / n AS p, CAST(n AS DOUBLE) AS m, z * z AS z2)", "s",
    let(
        "struct(s.p AS p, (s.p + s.z2 / (2 * s.m)) / (1 + s.z2 / s.m) AS center, (z * sqrt((s.p * (1 - s.p) + s.z2 / (4 * s.m)) / s.m)) / (1 + s.z2 / s.m) AS half)", "t",
        "named_struct('p_hat', t.p, 'ci_low', greatest(0D, t.center - t.half), 'ci_high', least(1D, t.center + t.half))",
    ),
) + " ELSE named_struct('p_hat', 0D, 'ci_low', 0D, 'ci_high', 0D) END"

_SUM = "aggregate({cells}, 0L, (s, c) -> s + {value})"

COHEN = "kappa_of_cells(cells ARRAY<STRUCT<a: STRING, b: STRING, n: BIGINT>>) RETURNS DOUBLE RETURN " + let(
    "filter(coalesce(cells, array()), c -> c.a IS NOT NULL AND c.b IS NOT NULL AND c.n IS NOT NULL)", "held",
    let(
        "struct(" + _SUM.format(cells="held", value="c.n") + " AS n, " + _SUM.format(cells="held", value="IF(c.a = c.b, c.n, 0L)") + " AS agreed, aggregate(array_distinct(transform(held, c -> c.a)), 0L, (e, l) -> e + "
        + _SUM.format(cells="held", value="IF(c.a = l, c.n, 0L)") + " * " + _SUM.format(cells="held", value="IF(c.b = l, c.n, 0L)") + ") AS chance)", "t",
        "IF(t.n * t.n = t.chance, 0D, CAST(t.agreed * t.n - t.chance AS DOUBLE) / CAST(t.n * t.n - t.chance AS DOUBLE))",
    ),
)

FLEISS = "kappa_of_counts(items BIGINT, raters BIGINT, squares BIGINT, labels ARRAY<BIGINT>) RETURNS DOUBLE RETURN CASE WHEN items > 0 AND raters > 1 THEN " + let(
    "struct(CAST(squares - items * raters AS DOUBLE) / (items * raters * (raters - 1)) AS p, CAST(aggregate(labels, 0L, (s, c) -> s + c * c) AS DOUBLE) / (items * raters * items * raters) AS e)", "t",
    "IF(abs(1 - t.e) < 1e-9, 0D, (t.p - t.e) / (1 - t.e))",
) + " END"

_EXPANDED = ", ".join(f"CASE WHEN lower(q) RLIKE {literal(words)} THEN concat_ws(' ', q, {literal(suffix)}) END" for words, suffix in EXPANSIONS)
_EVERY = f"concat(array(q), filter(transform(split(q, {literal(CLAUSE)}), c -> {squeezed('c')}), c -> size(array_remove(split(c, ' '), '')) >= 4), filter(array({_EXPANDED}), x -> x IS NOT NULL))"
_FIRST = let(_EVERY, "every", "slice(filter(every, (x, i) -> NOT exists(slice(every, 1, i), y -> lower(y) = lower(x))), 1, most)")
PARTS = f"query_parts(query STRING, most INT DEFAULT 3) RETURNS TABLE(part_no INT, part STRING) RETURN SELECT posexplode({let(squeezed("coalesce(query, '')"), 'q', f"IF(q = '', CAST(array() AS ARRAY<STRING>), {_FIRST})")})"

RECURSIVE = """recursive_chunks(body STRING, size INT DEFAULT 1000, overlap INT DEFAULT 200, least INT DEFAULT 100) RETURNS TABLE(chunk_index INT, content STRING, is_table BOOLEAN)
RETURN SELECT pos, col.content, col.is_table FROM (SELECT posexplode(_recursive_pieces(body, size, overlap, least)))"""
SEMANTIC = """semantic_chunks(body STRING, threshold DOUBLE DEFAULT 0.3D, least INT DEFAULT 200, most INT DEFAULT 1500) RETURNS TABLE(chunk_index INT, content STRING)
RETURN SELECT pos, col FROM (SELECT posexplode(_semantic_pieces(body, threshold, least, most)))"""


def register(spark: SparkSession, embed: models.Embedder = models.hashed_embedding) -> None:
    """Makes the functions known to a session; again is no error. embed: vectors of the sentences of semantic chunks."""

    @F.pandas_udf("array<struct<content: string, is_table: boolean>>")
    def recursive_pieces(texts: pd.Series, size: pd.Series, overlap: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([[{"content": c, "is_table": table} for c, table in chunking.chunked(t, int(s), int(o), int(m))] for t, s, o, m in zip(texts, size, overlap, least)])

    @F.pandas_udf("array<string>")
    def semantic_pieces(texts: pd.Series, threshold: pd.Series, least: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for t, h, a, b in zip(texts, threshold, least, most):
            found = chunking.sentences(t)
            out.append(chunking.semantic_groups(found, embed(found), float(h), int(a), int(b)) if found else [])
        return pd.Series(out)

    spark.udf.register("_recursive_pieces", recursive_pieces)
    spark.udf.register("_semantic_pieces", semantic_pieces)
    for function in (WILSON, COHEN, FLEISS, PARTS, RECURSIVE, SEMANTIC):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}")
