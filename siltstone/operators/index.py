"""The keyword index over ranges of documents, and BM25 over it.

ranges: a row for some documents in ascending id, with the postings of their terms as compressed rows (places in the range
and counts) and, for each term, the largest count and the shortest document that it has there. A task cuts ranges as it
reads tokens, so that building shuffles nothing but counts of terms. terms: term, df, idf.

All queries of a block go over each range once. A range's bounds say what a term can add at most: terms that even together
cannot lift a document to a query's k-th best so far are looked up only for documents that the others have found, and a
range where all terms together cannot is left out (MaxScore). A task hands on k rows of a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import keyword_tokens
from siltstone.tables import LARGE_ROWS, exists, materialise, small_batches, spread

# The Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Tokens, and documents, of a range, about; a longer document is a range of its own.
RANGE_TOKENS, RANGE_DOCUMENTS = 1 << 20, 1 << 15
#: Queries that go over the ranges together, about.
BLOCK_QUERIES = 5_000


def range_schema(kind: str) -> str:
    """Numbers are packed, 32 bits each. dead: the places of documents that do not count any more, or null."""
    return f"range_id long, ids array<{kind}>, dl binary, terms array<string>, dfs array<int>, doc binary, tf binary, most binary, least binary, n long, total long, dead array<int>"


@dataclass(frozen=True)
class KeywordIndex:
    """ranges and terms; the number of documents, and of their tokens."""

    ranges: DataFrame
    terms: DataFrame
    n: int
    total: int

    @property
    def kind(self) -> str:
        return self.ranges.schema["ids"].dataType.elementType.simpleString()

    @property
    def postings(self) -> DataFrame:
        """doc_id, dl, term, tf, row by row."""
        return self.ranges.mapInArrow(_unpacked, f"doc_id {self.kind}, dl long, term string, tf long")

    @property
    def documents(self) -> DataFrame:
        """doc_id, dl."""
        return self.ranges.select("ids", "dl", "dead").mapInArrow(_lengths, f"doc_id {self.kind}, dl long")

    def write(self, path: str) -> None:
        """Parquet tables below path."""
        self.ranges.write.mode("overwrite").options(**LARGE_ROWS).parquet(f"{path}/ranges")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.ranges.sparkSession.createDataFrame([(self.n, self.total)], "n long, total long").write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def read(spark: SparkSession, path: str) -> KeywordIndex | None:
        """The index below path; None where a table is missing, so that its side of a retrieval is left out."""
        if not all(exists(spark, f"{path}/{t}") for t in ("ranges", "terms", "totals")):
            return None
        return KeywordIndex(spark.read.parquet(f"{path}/ranges"), spark.read.parquet(f"{path}/terms"), *spark.read.parquet(f"{path}/totals").first())


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of ranges, lists as arrays."""
    for k in range(batch.num_rows):
        row = {name: column[k] for name, column in zip(batch.schema.names, batch.columns)}
        yield {name: value.values if isinstance(value, pa.ListScalar) else value.as_py() for name, value in row.items()}


def packed(x: np.ndarray) -> bytes:
    return x.astype(np.int32).tobytes()


def numbers(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", np.int32)


def range_row(ids: pa.Array, tokens: pa.Array) -> dict:
    """A range's columns, from its documents' ids and lists of tokens."""
    n = len(ids)
    order = pc.sort_indices(ids).to_numpy()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    dl = np.empty(n, np.int64)
    dl[place] = lengths
    words = tokens.flatten().dictionary_encode()
    vocabulary, codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, tf = np.unique(codes * n + np.repeat(place, lengths), return_counts=True)
    return posted(ids.take(pa.array(order)), dl, vocabulary, pairs // max(n, 1), pairs % max(n, 1), tf)


def posted(ids: pa.Array, dl: np.ndarray, vocabulary: pa.Array, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> dict:
    """The columns of a range whose postings are sorted by term and place; terms without any are left out."""
    dfs = np.bincount(term, minlength=len(vocabulary))
    held = np.flatnonzero(dfs)
    start = np.cumsum(dfs[held]) - dfs[held]
    most, least = (np.maximum.reduceat(tf, start), np.minimum.reduceat(dl[doc], start)) if len(held) else (tf, dl[:0])
    return {
        "ids": ids.to_pylist(), "dl": packed(dl), "terms": vocabulary.take(pa.array(held)).to_pylist(), "dfs": dfs[held].tolist(), "doc": packed(doc), "tf": packed(tf), "most": packed(most), "least": packed(least),
        "n": len(dl), "total": int(dl.sum()), "dead": None,
    }


def as_batch(row: dict, number: int, ids: pa.DataType) -> pa.RecordBatch:
    kinds = {"range_id": pa.int64(), "ids": pa.list_(ids), "terms": pa.list_(pa.string()), "dfs": pa.list_(pa.int32()), "dead": pa.list_(pa.int32()), "n": pa.int64(), "total": pa.int64()}
    row = {"range_id": (TaskContext.get().partitionId() << 24) + number} | row
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(c, pa.binary())) for c, v in row.items()], names=list(row))


def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of a task's documents (doc_id, tokens)."""
    number, ids, tokens, held = 0, [], [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        block = np.maximum(np.cumsum(lengths) // RANGE_TOKENS, np.arange(len(lengths)) // RANGE_DOCUMENTS)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            ids.append(batch.column(0).slice(a, b - a))
            tokens.append(batch.column(1).slice(a, b - a))
            held += int(lengths[a:b].sum())
            if held >= RANGE_TOKENS or sum(map(len, ids)) >= RANGE_DOCUMENTS:
                yield as_batch(range_row(pa.concat_arrays(ids), pa.concat_arrays(tokens)), number, batch.column(0).type)
                number, ids, tokens, held = number + 1, [], [], 0
    if sum(map(len, ids)):
        yield as_batch(range_row(pa.concat_arrays(ids), pa.concat_arrays(tokens)), number, ids[0].type)


def alive(dead: pa.Array | None, n: int) -> np.ndarray:
    """Which places of a range count."""
    out = np.ones(n, bool)
    if dead is not None:
        out[dead.to_numpy()] = False
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in rows_of(batch):
            doc, tf, dl = numbers(r["doc"]), numbers(r["tf"]).astype(np.int64), numbers(r["dl"]).astype(np.int64)
            live = alive(r["dead"], len(dl))[doc]
            term = np.repeat(np.arange(len(r["terms"])), r["dfs"].to_numpy())[live]
            doc, tf = doc[live], tf[live]
            yield pa.RecordBatch.from_arrays([r["ids"].take(pa.array(doc)), pa.array(dl[doc]), r["terms"].take(pa.array(term)), pa.array(tf)], names=["doc_id", "dl", "term", "tf"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in rows_of(batch):
            dl = numbers(r["dl"]).astype(np.int64)
            live = np.flatnonzero(alive(r["dead"], len(dl)))
            yield pa.RecordBatch.from_arrays([r["ids"].take(pa.array(live)), pa.array(dl[live])], names=["doc_id", "dl"])


def compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's ranges without dead documents, neighbours merged up to the size of a range; nothing is tokenised again."""
    number, ids, tokens, held = 0, [], [], 0
    for batch in batches:
        kind = batch.schema.field("ids").type.value_type
        for r in rows_of(batch):
            dl, doc = numbers(r["dl"]).astype(np.int64), numbers(r["doc"])
            # each document's tokens anew, as repeats of its terms; their order does not matter
            order = np.argsort(doc, kind="stable")
            term = np.repeat(np.repeat(np.arange(len(r["terms"])), r["dfs"].to_numpy())[order], numbers(r["tf"])[order])
            offsets = np.concatenate([[0], np.cumsum(dl)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), r["terms"].take(pa.array(term)))
            live = np.flatnonzero(alive(r["dead"], len(dl)))
            ids.append(r["ids"].take(pa.array(live)))
            tokens.append(lists.take(pa.array(live)))
            held += int(dl[live].sum())
            if held >= RANGE_TOKENS or sum(map(len, ids)) >= RANGE_DOCUMENTS:
                yield as_batch(range_row(pa.concat_arrays(ids), pa.concat_arrays(tokens)), number, kind)
                number, ids, tokens, held = number + 1, [], [], 0
    if sum(map(len, ids)):
        yield as_batch(range_row(pa.concat_arrays(ids), pa.concat_arrays(tokens)), number, kind)


def ranges_of(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The ranges of documents, written."""
    small_batches(chunks.sparkSession)
    own = keyword_tokens(F.coalesce(F.col(text_col), F.lit(""))) if tokens is None else tokens
    rows = spread(chunks).select(F.col(id_col).alias("doc_id"), own.alias("tokens"))
    return materialise(rows.mapInArrow(ranged, range_schema(chunks.schema[id_col].dataType.simpleString())), "index-ranges", **LARGE_ROWS)


def counted_terms(ranges: DataFrame) -> DataFrame:
    """term, df of ranges without dead documents: each range counts its own."""
    each = ranges.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
    return each.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))


def build(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> KeywordIndex:
    """Tokenises, counts and weighs; ids are distinct. Documents without tokens count as documents."""
    ranges = ranges_of(chunks, id_col, text_col, tokens)
    n, total = (x or 0 for x in ranges.agg(F.sum("n"), F.sum("total")).first())
    return KeywordIndex(ranges, term_stats(counted_terms(ranges), n), n, total)


def term_stats(counts: DataFrame, n: int) -> DataFrame:
    """term, df, idf. Terms in more than half of the documents have a negative idf, which becomes EPSILON times the mean idf
    of the vocabulary (A30). The mean is one row, which is broadcast."""
    df = materialise(counts.select("term", "df"), "index-df")
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def rounded(score: Column) -> Column:
    """A score in millionths, so that ranks do not hang on the order in which it was summed."""
    return F.floor(score * 1_000_000 + 0.5).cast("long")


def query_terms(queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
    """query_id, term, qtf: a repeated query term counts again."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(keyword_tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(queries: DataFrame, index: KeywordIndex, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, score of every document that shares a term with a query (M08, F04: scores of 0 and less have no
    row). For rankings top_k is the way; this is for filters that hold before them."""
    weighed = query_terms(queries, query_id, text_col).join(index.terms.select("term", "idf"), "term")
    hits = index.postings.join(weighed, "term")
    tf, mean = F.col("tf"), F.lit(index.total / max(index.n, 1))
    part = F.col("qtf") * F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / mean))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).filter("score > 0")


def ranked(scores: DataFrame, k: int, by: str = "query_id", score: Column | None = None, ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first k of each query, best first and ties by the given columns, with rank from 1."""
    order = W.partitionBy(by).orderBy((F.col("score") if score is None else score).desc(), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def saturated(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    """What a term's count adds at a weight of 1; more for a larger count and for a shorter document."""
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / mean))


class Range:
    """A range that queries are asked of."""

    def __init__(self, row: dict, asked: pa.Array, mean: float) -> None:
        self.dl, self.doc, self.tf = numbers(row["dl"]).astype(np.float64), numbers(row["doc"]), numbers(row["tf"])
        self.live = alive(row["dead"], len(self.dl))
        self.at = pc.fill_null(pc.index_in(asked, value_set=row["terms"]), -1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(row["dfs"].to_numpy(), dtype=np.int64)
        self.start = np.concatenate([[0], ends]).astype(np.int64)
        self.bound = saturated(numbers(row["most"]).astype(np.float64), numbers(row["least"]), mean)
        self.mean, self.parts = mean, {}

    def part(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of a term's documents, ascending, and what it adds to each."""
        if t not in self.parts:
            s = slice(self.start[t], self.start[t + 1])
            self.parts[t] = self.doc[s], saturated(self.tf[s].astype(np.float64), self.dl[self.doc[s]], self.mean)
        return self.parts[t]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of documents that may be among a query's k best, given the k-th so far in millionths. Those
        that are left out are not; a millionth of room covers what the order of sums changes."""
        own = self.at[terms]
        terms, weights, own = terms[own >= 0], weights[own >= 0], own[own >= 0]
        low = -np.inf if least is None else (least - 1.5) / 1e6
        bounds = np.maximum(weights * self.bound[own], 0.0)
        order = np.argsort(bounds, kind="stable")
        sums = np.cumsum(bounds[order])
        needed = int(np.searchsorted(sums, low))  # terms before it cannot lift a document to the k-th
        if needed >= len(order) and least is not None or not len(order):
            return np.empty(0, np.int64), np.empty(0)
        score, seen = np.zeros(len(self.dl)), np.zeros(len(self.dl), bool)
        for i in order[needed:]:
            doc, adds = self.part(own[i])
            score[doc] += weights[i] * adds
            seen[doc] = True
        found = np.flatnonzero(seen & self.live)
        for p in range(needed - 1, -1, -1):
            found = found[score[found] + sums[p] >= low]
            doc, adds = self.part(own[order[p]])
            there = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
            has = doc[there] == found
            score[found[has]] += weights[order[p]] * adds[there[has]]
        found = found[score[found] >= low]
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k] - 2e-6]
        # the scores that count are summed in the order of the terms
        exact = np.zeros(len(found))
        for i in np.argsort(terms):
            doc, adds = self.part(own[i])
            there = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
            exact += np.where(doc[there] == found, weights[i] * adds[there], 0.0)
        return found[exact > 0], exact[exact > 0]


def searched(index: KeywordIndex, asked: list[str], queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """q, doc_id, score: each query's k best of each task's ranges. queries: places of terms in ``asked``, and weights."""
    mean, kind = index.total / max(index.n, 1), index.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        terms, ids = pa.array(asked, pa.string()), None
        for batch in batches:
            ids = batch.schema.field("ids").type.value_type
            for row in rows_of(batch):
                own = Range(row, terms, mean)
                for q, (at, weights) in enumerate(queries):
                    places, scores = own.best(at, weights, k, -best[q][-1][0] if len(best[q]) == k else None)
                    if len(places):
                        millionths = np.floor(scores * 1_000_000 + 0.5).astype(np.int64)
                        best[q] = sorted([*best[q], *zip((-millionths).tolist(), row["ids"].take(pa.array(places)).to_pylist(), scores.tolist())])[:k]
        for q, rows in enumerate(best):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(rows), pa.int32()), pa.array([r[1] for r in rows], ids), pa.array([r[2] for r in rows])], names=["q", "doc_id", "score"])

    rows = index.ranges.select("ids", "dl", "terms", "dfs", "doc", "tf", "most", "least", "dead")
    return rows.mapInArrow(run, f"q int, doc_id {kind}, score double")


def top_k(queries: DataFrame, index: KeywordIndex, k: int, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, score, score_millionths, rank: BM25 top-k in millionths of score, ties to the smaller id.

    Queries go over the ranges in blocks of bounded size, each once; what a block finds is written where there are several.
    """
    spark = queries.sparkSession
    small_batches(spark)
    asked = query_terms(queries, query_id, text_col)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    asked = asked if blocks == 1 else materialise(asked, "query-terms")
    found = []
    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        weighed = some.join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
        lists = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t")).collect()
        every = sorted({x["term"] for r in lists for x in r["t"]})
        place = {t: i for i, t in enumerate(every)}
        own = [(np.array([place[x["term"]] for x in r["t"]], np.int64), np.array([x["w"] for x in r["t"]])) for r in lists]
        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(lists)], f"q int, query_id {asked.schema['query_id'].dataType.simpleString()}")
        hits = searched(index, every, own, k).join(F.broadcast(names), "q").select("query_id", "doc_id", "score")
        top = ranked(hits.withColumn("score_millionths", rounded(F.col("score"))), k, score=F.col("score_millionths"))
        found.append(top if blocks == 1 else materialise(top, "top-k"))
    return found[0] if blocks == 1 else spark.read.schema(found[0].schema).parquet(*[t.written_at for t in found])
