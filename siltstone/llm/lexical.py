"""Ranked lexical search over document shards.

A shard is one row: some documents in ascending id, and their postings as a matrix in compressed rows - for each term a
range of ``doc`` (places in the shard) and ``impact``. A task cuts its documents into shards as it reads them, so building
shuffles nothing. An impact is the part of a score that hangs on the term's count and the document's length alone; it is
computed once, when the numbers of documents and terms of the whole table are known. What a term weighs in all documents
is applied to its range as a whole when it is asked for.

A search goes over each shard once for a block of queries: term at a time, a query's impacts are added to one dense
accumulator over the shard's documents, and the k best are cut out by partition, ties to the smaller id. A task hands on k
documents of a query at most, from all of its shards; these are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import LARGE_ROWS, discard, materialise, small_batches
from siltstone.llm.words import each_bytes, word_runs

#: Terms, with repeats, and documents of a shard, about; a longer document is a shard of its own.
SHARD_TERMS, SHARD_DOCUMENTS = 1 << 20, 1 << 16
#: Queries, and their terms, that go over the shards together, about.
BLOCK_QUERIES, BLOCK_TERMS = 10_000, 1_000_000

SHARDS = "doc_id binary, none long, n binary, term binary, start binary, doc binary, tf binary, documents long, terms long"
INDEX = "doc_id binary, none long, term binary, start binary, doc binary, impact binary"


class Places(dict):
    """Numbers of terms in the order in which they are first met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = place = len(self)
        return place


def shard(ids: list, runs: list[np.ndarray], places: Places) -> dict:
    """The columns of a shard's row from its documents' ids and the places of their terms."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    n = np.array([len(runs[k]) for k in order], np.int64)
    pairs = np.concatenate([runs[k].astype(np.int64) for k in order]) * len(order) + np.repeat(np.arange(len(order)), n)
    pairs, tf = np.unique(pairs, return_counts=True)
    start = np.searchsorted(pairs, np.arange(len(places) + 1) * len(order))
    return {
        "doc_id": np.array([ids[k] or 0 for k in order], np.int64).tobytes(), "none": sum(i is None for i in ids), "n": n.tobytes(), "term": b" ".join(places), "start": start.astype(np.int64).tobytes(),
        "doc": (pairs % len(order)).astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes(), "documents": len(order), "terms": int(n.sum()),
    }


def row(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([columns[f.name]], f.type) for f in schema], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], {"binary": pa.binary(), "long": pa.int64()}[c.split()[1]]) for c in ddl.split(", ")])


def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a task's documents (doc_id, text); documents without terms are in none."""
    schema = arrow_schema(SHARDS)
    ids, runs, places, held = [], [], Places(), 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), each_bytes(batch.column(1))):
            own = [np.fromiter(map(places.__getitem__, words), np.int32, len(words)) for words in word_runs(text or b"")]
            own = np.concatenate(own) if own else np.empty(0, np.int32)
            if len(own):
                ids.append(i)
                runs.append(own)
                held += len(own)
            if held >= SHARD_TERMS or len(ids) >= SHARD_DOCUMENTS:
                yield row(shard(ids, runs, places), schema)
                ids, runs, places, held = [], [], Places(), 0
    if ids:
        yield row(shard(ids, runs, places), schema)


def weight(documents: int, df: int) -> int:
    """What a term weighs."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(n: np.ndarray, doc: np.ndarray, tf: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The integer impact of each posting; lengths times documents do not fit in 64 bits for very many documents."""
    m = np.array([100 - 50 + (50 * int(x) * documents) // terms for x in n], np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])


@dataclass(frozen=True)
class LexicalIndex:
    """shards, and the numbers of documents with terms and of terms with repeats."""

    shards: DataFrame
    documents: int
    terms: int

    def write(self, path: str) -> None:
        self.shards.write.mode("overwrite").options(**LARGE_ROWS).parquet(f"{path}/shards")
        totals = self.shards.sparkSession.createDataFrame([(self.documents, self.terms)], "documents long, terms long")
        totals.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def read(spark: SparkSession, path: str) -> LexicalIndex:
        return LexicalIndex(spark.read.parquet(f"{path}/shards"), *spark.read.parquet(f"{path}/totals").first())


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """The index of all documents. Each row is a document, repeated and unnamed ones too; null texts have no terms, very long
    ones are split in runs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    counted = materialise(rows.mapInArrow(sharded, SHARDS), "shards", **LARGE_ROWS)
    documents, terms = (x or 0 for x in counted.agg(F.sum("documents"), F.sum("terms")).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(INDEX)
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                n, doc, tf = (np.frombuffer(r.pop(c), t) for c, t in (("n", np.int64), ("doc", np.int32), ("tf", np.int32)))
                yield row(r | {"doc": doc.tobytes(), "impact": impacts(n, doc, tf, documents, terms).astype(np.int32).tobytes()}, schema)

    index = materialise(counted.select("doc_id", "none", "n", "term", "start", "doc", "tf").mapInArrow(run, INDEX), "impacts", **LARGE_ROWS)
    discard(counted)
    return LexicalIndex(index, documents, terms)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, terms: the distinct terms of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({w for words in word_runs(text or b"") for w in words}) for text in each_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["query_id", "terms"])

    kind = queries.schema[id_col].dataType.simpleString()
    each = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"query_id {kind}, terms array<binary>")
    return each.select("query_id", F.explode("terms").alias("term")).groupBy("query_id").agg(F.collect_set("term").alias("terms"))


def places_of(asked: pa.Array, terms: bytes) -> np.ndarray:
    """For each asked term its number in a shard, or -1."""
    return pc.fill_null(pc.index_in(asked, value_set=pa.array(terms.split(b" "), pa.binary())), -1).to_numpy(zero_copy_only=False)


def frequencies(index: LexicalIndex, asked: pa.Array) -> np.ndarray:
    """In how many documents each asked term stands: shards count their own, and the counts are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, start = places_of(asked, terms), np.frombuffer(start, np.int64)
                found += np.where(at >= 0, start[at + 1] - start[at], 0)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], names=["term", "df"])

    counts = index.shards.select("term", "start").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(asked), np.int64)
    for t, df in counts.collect():
        out[t] = df
    return out


def cut(score: np.ndarray, none: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of any documents, best first, equal ones by ascending id, those without an id last."""
    if len(score) > k:
        least = score[np.argpartition(score, len(score) - k)[len(score) - k :]].min()
        some = np.flatnonzero(score >= least)  # all that tie with the last one
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], none[some], -score[some]))[:k]]


def searched(index: LexicalIndex, ids: list, queries: list[np.ndarray], asked: pa.Array, weights: np.ndarray, kind: str, k: int) -> DataFrame:
    """query_id, doc_id, score: of each query the k best of each task's shards. queries: places of their terms in ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty(0, np.int64)
        best = [(nothing, np.empty(0, bool), nothing)] * len(queries)
        for batch in batches:
            for at_row in range(batch.num_rows):
                r = batch.slice(at_row, 1).to_pylist()[0]
                doc_id, start = np.frombuffer(r["doc_id"], np.int64), np.frombuffer(r["start"], np.int64)
                doc, impact = np.frombuffer(r["doc"], np.int32), np.frombuffer(r["impact"], np.int32).astype(np.int64)
                none = np.arange(len(doc_id)) >= len(doc_id) - r["none"]
                at = places_of(asked, r["term"])
                for q, terms in enumerate(queries):
                    total = np.zeros(len(doc_id), np.int64)
                    for t in terms[at[terms] >= 0]:
                        part = slice(start[at[t]], start[at[t] + 1])
                        total[doc[part]] += weights[t] * impact[part]
                    score, gone, own = best[q]
                    # a document below the k-th so far cannot enter; one that ties may have the smaller id
                    hit = np.flatnonzero(total >= (score[-1] if len(score) == k else 1))
                    if len(hit):
                        hit = hit[cut(total[hit], none[hit], doc_id[hit], k)]
                        every = np.concatenate([score, total[hit]]), np.concatenate([gone, none[hit]]), np.concatenate([own, doc_id[hit]])
                        first = cut(*every, k)
                        best[q] = tuple(x[first] for x in every)
        for q, (score, gone, own) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(score), ARROW[kind]), pa.array(own, pa.int64(), mask=gone), pa.array(score, pa.int64())], names=["query_id", "doc_id", "score"])

    return index.shards.select("doc_id", "none", "term", "start", "doc", "impact").mapInArrow(run, f"query_id {kind}, doc_id long, score long")


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def search(index: LexicalIndex, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the k highest-scoring documents of each query, with a score above 0; equal scores by
    ascending id, documents without an id last.

    Rows of one query id, null among them, are one query with the terms of all of them. Queries without terms, and all
    queries of an empty index, have no rows. Queries go over the shards in blocks of bounded size, each once.
    """
    small_batches(queries.sparkSession)
    kind = queries.schema[id_col].dataType.simpleString()
    if kind not in ARROW:
        raise TypeError(f"query ids of type {kind} are not supported")
    terms = materialise(query_terms(queries, id_col, text_col), "query-terms")
    number, held = terms.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-number // BLOCK_QUERIES), -(-(held or 0) // BLOCK_TERMS))
    found = []
    for block in range(blocks):
        some = terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        every = sorted({bytes(t) for r in some for t in r["terms"]})
        place = {t: n for n, t in enumerate(every)}
        asked = pa.array(every, pa.binary())
        weights = np.array([weight(index.documents, int(df)) for df in frequencies(index, asked)], np.int64)
        lists = [np.array(sorted(place[bytes(t)] for t in r["terms"]), np.int64) for r in some]
        hits = searched(index, [r["query_id"] for r in some], lists, asked, weights, kind, k)
        order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(top if blocks == 1 else materialise(top, f"found-{block}"))
    out = found[0] if blocks == 1 else queries.sparkSession.read.schema(found[0].schema).parquet(*[t.written_at for t in found])
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
