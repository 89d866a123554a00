"""Vector search, rank fusion, and what becomes of a ranked list: dedupe, thresholds, gates and context packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import low_value
from siltstone.operators.index import ranked
from siltstone.tables import materialise

# The reciprocal-rank constant, and the batch fusion's weights.
RRF_K = 60
OTHER_QUERY, LATER, RANK_BASE, RANK_SHARE, SCORE_SHARE = 0.85, 0.25, 10.0, 0.7, 0.3
# The least score of a chunk, and its share of the best one.
FLOOR, RATIO = 0.45, 0.75
#: Query vectors of a block, which is broadcast to the collection.
BROADCAST_QUERIES = 2_000


def vector_top_k(queries: DataFrame, collection: DataFrame, k: int, query_id: str = "query_id", id_col: str = "vec_id", vector: str = "embedding", where: Column | None = None, exclude_self: bool = False) -> DataFrame:
    """Exact cosine top-k of every query over the collection, ties to the smaller id (J11, T02). where: a filter of the
    collection, which holds before ranking (F03). Vectors that are null or zero, hold null or non-finite components, or
    differ in length from a query, are not among its hits, and such queries have none.

    A stated set of queries meets all rows, in blocks of BROADCAST_QUERIES queries, about, each of which goes over the
    collection once: a batch of vectors is multiplied with the block, only what may be among a query's k best so far is
    measured again in order, and a task hands on k rows of a query at most. What a block finds is written where there are
    several.
    """
    spark = collection.sparkSession
    rows = (collection if where is None else collection.filter(where)).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
    blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))
    asked = asked if blocks == 1 else materialise(asked, "asked-vectors")
    found = []
    for block in range(blocks):
        some = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).collect()
        names = spark.createDataFrame([(q, r["query_id"]) for q, r in enumerate(some)], f"q int, query_id {asked.schema['query_id'].dataType.simpleString()}")
        hits = rows.mapInArrow(nearest(some, k, exclude_self), f"q int, id {rows.schema['id'].dataType.simpleString()}, score double")
        top = ranked(hits.join(F.broadcast(names), "q").select("query_id", F.col("id").alias(id_col), "score"), k, ties=(id_col,))
        found.append(top if blocks == 1 else materialise(top, "nearest"))
    return found[0] if blocks == 1 else spark.read.schema(found[0].schema).parquet(*[t.written_at for t in found])


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, summed in order, so that equal vectors give equal sums wherever they stand."""
    return np.cumsum(x * y, axis=1)[:, -1]


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the column's vectors that have a direction, for each length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
        fit = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield at[fit], x[fit]


def nearest(asked: list, k: int, exclude_self: bool):
    """From batches of (id, vector): q, id, score of the k nearest to each of ``asked`` (query_id, v) in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array([r["v"] for r in asked], pa.list_(pa.float64()))
        queries = {y.shape[1]: (q, y, np.sqrt(dots(y, y))) for q, y in matrices(own)}
        names = [r["query_id"] for r in asked]
        held = {n: (np.empty(0, np.int64), None, np.empty(0), np.full(len(q), -np.inf)) for n, (q, _, _) in queries.items()}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for at, x in matrices(batch.column(1)):
                if not len(at) or x.shape[1] not in queries:
                    continue
                q, y, norms = queries[x.shape[1]]
                for a in range(0, len(at), 4096):
                    part, ids = x[a : a + 4096], batch.column(0).take(pa.array(at[a : a + 4096])).to_pylist()
                    mine: dict = {}
                    for p, i in enumerate(ids if exclude_self else ()):
                        mine.setdefault(i, []).append(p)
                    size = np.sqrt(dots(part, part))
                    near = (y / norms[:, None]) @ (part / size[:, None]).T
                    for row in range(len(q)) if exclude_self else ():
                        near[row, mine.get(names[q[row]], [])] = -np.inf
                    who, has, score, least = held[x.shape[1]]
                    if near.shape[1] > k:
                        least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
                    # a product's rounding is far below this
                    r, c = np.nonzero((near >= least[:, None] - 1e-9) & (near > -np.inf))
                    if not len(r):
                        continue
                    exact = dots(y[r], part[c]) / (norms[r] * size[c])
                    who, score = np.concatenate([who, r]), np.concatenate([score, exact])
                    has = [*(has or []), *[ids[p] for p in c]]
                    first = np.lexsort((np.array(has), -score, who))
                    starts = np.searchsorted(who[first], np.arange(len(q)))
                    first = first[np.arange(len(first)) - starts[who[first]] < k]
                    who, score, has = who[first], score[first], [has[p] for p in first]
                    ends = np.searchsorted(who, np.arange(len(q)), side="right")
                    full = np.bincount(who, minlength=len(q)) == k
                    held[x.shape[1]] = who, has, score, np.where(full, score[ends - 1], -np.inf)
        for n, (who, has, score, _) in held.items():
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(queries[n][0][who], pa.int32()), pa.array(has, kind), pa.array(score)], names=["q", "id", "score"])

    return run


def rrf(lists: DataFrame, k: int, by: str = "query_id", key: str = "doc_id", source: str = "source", rank: str = "rank", weight: Column | None = None, constant: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists; ties to the earlier list, then the better rank.

    source: the lists' order, from 0. weight: of a row's list, 0.5 each by default.
    """
    term = (F.lit(0.5) if weight is None else weight) / (constant + F.col(rank))
    # each list gives a term at most, so summing in the lists' order makes the sum the same everywhere
    fused = lists.groupBy(by, key).agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct(F.col(source).alias("s"), term.alias("t")))), lambda x: x["t"]), F.lit(0.0), lambda a, b: a + b).alias("score"), F.min(F.struct(F.col(source).alias("s"), F.col(rank).alias("r"))).alias("_seen"))
    return ranked(fused, k, by, ties=("_seen", key)).drop("_seen")


def fuse_batches(batches: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """Fuses the lists of a query's plan (M10, T04). batches: key, batch_rank, is_original, iteration, rerank_score.

    A list of another query than the original weighs OTHER_QUERY, later iterations weigh less; a hit adds its rank's
    and its score's share. Order: score, then best score of any list, then key.
    """
    weight = F.when(F.col("is_original"), 1.0).otherwise(OTHER_QUERY) / (1.0 + LATER * F.col("iteration"))
    share = RANK_SHARE / (RANK_BASE + F.col("batch_rank")) + SCORE_SHARE * F.greatest(F.col("rerank_score"), F.lit(0.0))
    fused = batches.groupBy(by, "key").agg(F.sum(weight * share).alias("score"), F.max("rerank_score").alias("best_score"))
    millionths = F.floor(F.col("score") * 1_000_000 + 0.5).cast("long")
    return ranked(fused.withColumn("score_millionths", millionths).withColumn("_worst", -F.col("best_score")), k, by, score=F.col("score_millionths"), ties=("_worst", "key")).drop("score", "_worst")


def content_key(content: Column, chars: int = 500) -> Column:
    """The key of duplicate contents: md5 of the first characters."""
    return F.md5(F.substring(content, 1, chars))


def candidate_key(source: Column, page: Column, chunk_id: Column, content: Column) -> Column:
    """sha256 of source, page, chunk and the content's first 256 characters."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", text(source), text(page), text(chunk_id), F.substring(content, 1, 256)), 256)


def first_of_each(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key in the given order; a partial minimum rather than a sort."""
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*by, "r.*").select(*rows.columns)


def quality_filtered(chunks: DataFrame, by: str = "query_id", text: str = "content", least: int = 3) -> DataFrame:
    """Drops low-value chunks of a query, but only where min(least, all) others stay."""
    whole = W.partitionBy(by)
    bad = low_value(F.col(text))
    rows = chunks.withColumn("_bad", bad).withColumn("_good", F.count_if(~F.col("_bad")).over(whole)).withColumn("_all", F.count("*").over(whole))
    return rows.filter(~F.col("_bad") | (F.col("_good") < F.least(F.lit(least), F.col("_all")))).drop("_bad", "_good", "_all")


def min_score(rows: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Rows of at least that score; a threshold of 0 or less keeps all."""
    return rows.filter(F.col(score) >= threshold) if threshold > 0 else rows


def metadata(held: Column, *names: str, default: str | None = None) -> Column:
    """The first of several keys of a metadata map that has a value, else a default: page or page_num, and so on."""
    return F.coalesce(*[F.try_element_at(held, F.lit(n)) for n in names], F.lit(default))


def simple_results(rows: DataFrame, fields: tuple[str, ...] = ("source", "page", "section")) -> DataFrame:
    """query_id, rank, content, metadata (map), score: what a service hands out."""
    held = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]), lambda _, v: v.isNotNull())
    return rows.select("query_id", "rank", "content", held.alias("metadata"), "score")


def source_sets(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """The distinct sources of each query's hits, sorted, and their number."""
    return hits.groupBy(by).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.countDistinct("source").alias("source_diversity"))


def relevance_filtered(chunks: DataFrame, by: str = "query_id", score: str = "score", rank: str = "rank", floor: float = FLOOR, ratio: float = RATIO, small: float = 0.15) -> DataFrame:
    """Keeps chunks of a score near the top one: all where the top is small, two at least."""
    order = W.partitionBy(by).orderBy(rank)
    whole = W.partitionBy(by)
    rows = chunks.withColumn("_top", F.first(score).over(order)).withColumn("_in", F.col(score) >= F.greatest(F.lit(floor), F.col("_top") * ratio))
    rows = rows.withColumn("_n", F.count_if("_in").over(whole)).withColumn("_k", F.row_number().over(order))
    keep = (F.col("_top") <= small) | F.when(F.col("_n") >= 2, F.col("_in")).otherwise(F.col("_k") <= 2)
    return rows.filter(keep).drop("_top", "_in", "_n", "_k")


def context_part(source: Column, page: Column, content: Column) -> Column:
    paged = F.when(page.isNotNull() & (page != 0), F.concat(F.lit(", p."), page.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("[Source: "), source, paged, F.lit("]\n"), content, F.lit("\n"))


def packed_context(chunks: DataFrame, budget: int, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The parts of each query's chunks in order, up to the first that would pass the budget, joined (W03, X32):
    context_text, n_packed, context_chars, context_hash. chunks: source, page, content. The joiner is not budgeted."""
    part = context_part(F.col("source"), F.col("page"), F.col("content"))
    running = W.partitionBy(by).orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    rows = chunks.withColumn("_part", part).withColumn("_chars", F.sum(F.length("_part")).over(running)).filter(F.col("_chars") <= budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("_part").alias("p")))), lambda x: x["p"]), "\n---\n")
    packed = rows.groupBy(by).agg(text.alias("context_text"), F.count("*").alias("n_packed"))
    # a query whose first part is too long has an empty context
    out = chunks.select(by).distinct().join(packed, by, "left").select(by, F.coalesce("context_text", F.lit("")).alias("context_text"), F.coalesce("n_packed", F.lit(0)).alias("n_packed"))
    return out.withColumn("context_chars", F.length("context_text")).withColumn("context_hash", F.sha2("context_text", 256))


def rag_gate(snapshot: Column, context_chars: Column, n_chunks: Column, top_score: Column, rag: Column, enabled: bool = True, min_chars: int = 200, min_chunks: int = 2, min_score: float = 0.62) -> Column:
    """Why a run uses its context or not, by the first condition that holds (F09). Too short a context is never used;
    the later conditions hold only where gating is enabled."""
    return (
        F.when(~rag, "no_rag").when(snapshot.isNull(), "no_snapshot").when(F.coalesce(context_chars, F.lit(0)) == 0, "empty_context").when(context_chars < min_chars, "context_too_short")
        .when(F.lit(not enabled), "gating_disabled").when(n_chunks < min_chunks, "too_few_chunks").when(top_score < min_score, "low_top_score").otherwise("pass")
    )


def cache_key(*parts: Column) -> Column:
    """sha256 of the parameters of a retrieval."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def collection_stats(rows: DataFrame, doc: Column) -> DataFrame:
    """Rows of a collection, and distinct documents of all of them; the service counts those of its first 5,000."""
    return rows.agg(F.count("*").alias("n_chunks"), F.countDistinct(doc).alias("n_documents_seen"))
