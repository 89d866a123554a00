"""Leakage of questions into documents, and between the splits of a dataset.

Two texts leak if one contains the other, or if the Jaccard coefficient of their sets of character 5-grams is high enough;
both are normalised first, and grams are cut from the text without spaces. Containment and similarity both show in how many
grams a question and a document share, and a document's grams that no question has cannot be shared: so a document is held
against an inverted list of the questions' grams, in one pass over all documents and without a shuffle. Only where the
shared number allows it is a text searched, or a document's set counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import normalized
from siltstone.operators import index as keyword
from siltstone.tables import materialise, spread

GRAM = 5
#: Characters of the questions that are held against the documents together, about.
BLOCK_CHARS = 4_000_000
#: Pairs of question and document that are broadcast to the documents, at most; pairs for which a document's are one list more.
BROADCAST_PAIRS, LISTED_PAIRS = 500_000, 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(norm: str) -> np.ndarray:
    """64-bit hashes of the character 5-grams of normalised text without spaces, in order; a shorter text is one gram."""
    x = np.frombuffer(norm.replace(" ", "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(x):
        return np.empty(0, np.uint64)
    width = min(len(x), GRAM)
    h = np.full(len(x) - width + 1, np.uint64(width))
    for k in range(width):
        h = (h ^ x[k : len(x) - width + 1 + k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Questions:
    """An inverted list of the grams of questions (number, normalised text)."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        sets = [np.unique(grams(t)) for t in texts]
        self.sizes, self.longest = np.array([len(s) for s in sets], np.int64), max((len(t) for t in texts), default=0)
        every, who = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.grams, start = np.unique(every[order], return_index=True)
        self.who, self.start = who[order], np.append(start, len(every))
        #: Texts that are shorter than a gram do not show in the list.
        self.short = [q for q, t in enumerate(texts) if 0 < len(t.replace(" ", "")) < GRAM]

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many distinct grams each question shares with those of a document."""
        if not len(self.grams):
            return np.zeros(len(self.texts), np.int64)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        met = np.unique(at[self.grams[at] == own])
        lists = [self.who[self.start[g] : self.start[g + 1]] for g in met]
        return np.bincount(np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64), minlength=len(self.texts))

    def leaks(self, norm: str, threshold: float) -> list[tuple[int, bool, float]]:
        """(question, exact, jaccard) of the questions that leak into a document's normalised text."""
        own = grams(norm)
        both = self.shared(own)
        short = bool(norm) and len(norm.replace(" ", "")) < GRAM
        # all of a question's grams, or all of the document's, or so many that the union is small enough
        near = both >= threshold * self.sizes
        some = set(np.flatnonzero((both > 0) & near).tolist()) | set(self.short)
        size = None
        if short or len(own) <= self.longest:
            size = len(np.unique(own))
            some |= set(np.flatnonzero((both > 0) & (both == size)).tolist())
        if short:
            some |= set(range(len(self.texts)))
        out = []
        for q in sorted(some):
            text = self.texts[q]
            exact = bool(norm) and bool(text) and (text in norm or norm in text)
            size = len(np.unique(own)) if size is None else size
            union = int(self.sizes[q]) + size - int(both[q])
            jaccard = int(both[q]) / union if union else 1.0
            if exact or jaccard >= threshold:
                out.append((q, exact, jaccard))
        return out


def leaks(questions: DataFrame, documents: DataFrame, threshold: float = 0.75, question_id: str = "item_id", doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, exact, jaccard of every pair of a question and a document of which one contains the other, or whose
    coefficient is at least the threshold, which is above 0 (U05, C13): all pairs that there are, over all documents.

    Null texts are empty; an empty text is contained in none, and two of them are equal sets (1). Repeated rows give rows
    each. Questions go over the documents in blocks of bounded size, each once.
    """
    spark, kind = documents.sparkSession, documents.schema[doc_id].dataType.simpleString()
    rows = spread(documents).select(F.col(doc_id).alias("doc_id"), normalized(F.coalesce(F.col(text_col), F.lit(""))).alias("d"))
    asked = questions.select(F.col(question_id).alias("query_id"), normalized(F.coalesce(F.col(text_col), F.lit(""))).alias("q"))
    blocks = max(1, -(-(asked.agg(F.sum(F.length("q"))).first()[0] or 0) // BLOCK_CHARS))
    asked, out = asked if blocks == 1 else materialise(asked, "questions"), []
    for block in range(blocks):
        some = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)) == block)).collect()
        names = spark.createDataFrame([(q, r["query_id"]) for q, r in enumerate(some)], f"q int, query_id {asked.schema['query_id'].dataType.simpleString()}")
        found = rows.mapInArrow(_leaking([r["q"] for r in some], threshold), f"q int, doc_id {kind}, exact boolean, jaccard double")
        pairs = found.join(F.broadcast(names), "q").select("query_id", "doc_id", "exact", "jaccard")
        out.append(pairs if blocks == 1 else materialise(pairs, "leaks"))
    return out[0] if blocks == 1 else spark.read.schema(out[0].schema).parquet(*[t.written_at for t in out])


def _leaking(texts: list[str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Questions(texts)
        empty = [(q, False, 1.0) for q, t in enumerate(texts) if not t]
        for batch in batches:
            at, found = [], []
            for k, norm in enumerate(batch.column(1).to_pylist()):
                own = asked.leaks(norm, threshold) if norm else empty
                found += own
                at += [k] * len(own)
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.float64())], names=["q", "doc_id", "exact", "jaccard"])

    return run


def compared(pairs: DataFrame, questions: DataFrame, documents: DataFrame, question_id: str, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pairs(query_id, doc_id, ...) with exact and jaccard. Pairs up to BROADCAST_PAIRS go to the documents, whose texts then
    stay where they are; more of them meet the texts by shuffles. A document's grams are cut once for all its questions."""
    pairs = materialise(pairs, "pairs")
    number = pairs.count()
    few, slots = number <= BROADCAST_PAIRS, 1 + number // LISTED_PAIRS
    asked = pairs.join(questions.select(F.col(question_id).alias("query_id"), normalized(F.coalesce(F.col(text_col), F.lit(""))).alias("q")), "query_id")
    rest = [c for c in pairs.columns if c != "doc_id"]
    # many questions of one document are several lists
    of_document = asked.groupBy("doc_id", F.pmod(F.xxhash64("query_id"), F.lit(slots))).agg(F.collect_list(F.struct(*rest, "q")).alias("asked"))
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("d"))
    met = spread(texts).join(F.broadcast(of_document) if few else of_document, "doc_id")
    met = met.select("doc_id", "asked", normalized(F.coalesce("d", F.lit(""))).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, jaccard = [], []
            for questions, norm in zip(batch.column(1), batch.column(2).to_pylist()):
                own = np.unique(grams(norm))
                for q in questions.values.field("q").to_pylist():
                    other = np.unique(grams(q))
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    union = len(own) + len(other) - both
                    exact.append(bool(norm) and bool(q) and (q in norm or norm in q))
                    jaccard.append(both / union if union else 1.0)
            lists = batch.column(1)
            held = lists.flatten()
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())))
            yield pa.RecordBatch.from_arrays([ids, *[held.field(c) for c in rest], pa.array(exact, pa.bool_()), pa.array(jaccard, pa.float64())], names=["doc_id", *rest, "exact", "jaccard"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in rest)
    return met.mapInArrow(run, f"doc_id {met.schema['doc_id'].dataType.simpleString()}, {kinds}, exact boolean, jaccard double").select(*pairs.columns, "exact", "jaccard")


def leakage_audit(questions: DataFrame, documents: DataFrame, pool: int = 50, report: int = 5, threshold: float = 0.75, question_id: str = "item_id", index: keyword.KeywordIndex | None = None) -> DataFrame:
    """For each question its best matches among the BM25 candidates: by exact containment, then Jaccard of character
    5-grams, then BM25 (J10, T07). suspected: the question has an exact or near match among them (C13). index: that of
    the documents, where there is one already. ``leaks`` looks beyond the candidates."""
    asked = questions.select(F.col(question_id).alias("query_id"), "text")
    own = keyword.build(documents) if index is None else index
    candidates = keyword.top_k(asked, own, pool).select("query_id", "doc_id", "score_millionths")
    both = compared(candidates, asked, documents, "query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("jaccard"), F.desc("score_millionths"), "doc_id")
    whole = W.partitionBy("query_id")
    suspected = F.max(F.col("exact")).over(whole) | (F.max("jaccard").over(whole) >= threshold)
    return both.withColumn("suspected", suspected).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= report)


def kb_audit(questions: DataFrame, documents: DataFrame, index: keyword.KeywordIndex | None = None, threshold: float = 0.75, report: int = 5, question_id: str = "item_id") -> DataFrame:
    """The audit of a knowledge base (C13): the questions themselves, without the case that they are embedded in (X35), held
    against its chunks; the candidates come from its persisted index (S13). leaks_anywhere: how many chunks a question
    leaks into among all."""
    from siltstone.operators.prep import question_only

    asked = questions.select(F.col(question_id).alias("query_id"), question_only(F.coalesce("text", F.lit(""))).alias("text"))
    every = leaks(asked, documents, threshold, "query_id").groupBy("query_id").agg(F.count("*").alias("leaks_anywhere"))
    found = leakage_audit(asked, documents, report=report, threshold=threshold, question_id="query_id", index=index)
    return found.join(every, "query_id", "left").withColumn("leaks_anywhere", F.coalesce("leaks_anywhere", F.lit(0)))


def split_report(records: DataFrame, id_col: str, text_col: str, split_col: str, held_out: str = "holdout", examples: int = 20) -> DataFrame:
    """One row on a dataset's splits (U01): records, held-out and other ones, how many normalised questions and how many ids
    stand on both sides, the first ``examples`` of each, and whether there are any."""
    rows = records.select(F.col(id_col).alias("id"), F.lower(F.trim(F.col(text_col))).alias("question"), F.coalesce(F.col(split_col) == held_out, F.lit(False)).alias("out"))
    counts = rows.agg(F.count("*").alias("total_records"), F.count_if("out").alias("holdout_records"), F.count_if(~F.col("out")).alias("train_like_records"))
    for c, name in (("question", "question"), ("id", "sample_id")):
        both = rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("x")).agg(F.max("out").alias("o"), F.min("out").alias("i")).filter("o and not i")
        first = both.orderBy("x").limit(examples).agg(F.array_sort(F.collect_list("x")).alias(f"{name}_overlap_examples"))
        counts = counts.crossJoin(F.broadcast(both.agg(F.count("*").alias(f"{name}_overlap_count")))).crossJoin(F.broadcast(first))
    return counts.withColumn("leakage_detected", (F.col("question_overlap_count") > 0) | (F.col("sample_id_overlap_count") > 0))


def split_leakage(records: DataFrame, id_col: str, text_col: str, split_col: str, held_out: str = "holdout") -> DataFrame:
    """Normalised questions that stand both in the held-out split and in another, with the ids of either side."""
    q = records.select(F.col(id_col).alias("id"), F.lower(F.trim(F.col(text_col))).alias("question"), (F.col(split_col) == held_out).alias("out"))
    both = q.groupBy("question").agg(F.count_if("out").alias("n_held_out"), F.count_if(~F.col("out")).alias("n_train"), F.min(F.when(F.col("out"), F.col("id"))).alias("first_held_out"), F.min(F.when(~F.col("out"), F.col("id"))).alias("first_train"))
    return both.filter("n_held_out > 0 and n_train > 0")
