"""The facade: one object from corpus to answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import tables
from siltstone.functions import models
from siltstone.functions.text import grounding_estimate
from siltstone.operators.index import KeywordIndex
from siltstone.operators.retrieval import collection_stats
from siltstone.plans import answering, ingest, retrieval
from siltstone.sources import files


@dataclass
class Engine:
    """search, ask, stats and delete over an ingested folder; all questions of a table at once."""

    spark: SparkSession
    path: str
    embed: models.Embedder = field(default=models.hashed_embedding)
    generate: models.Generator = field(default=models.echo)

    def ingest_directory(self, folder: str, **options) -> DataFrame:
        return ingest.ingest(files.text_directory(self.spark, folder), self.path, **options)

    def update_directory(self, folder: str, **options) -> DataFrame:
        return ingest.update(self.spark, files.text_directory(self.spark, folder), self.path, **options)

    @property
    def chunks(self) -> DataFrame:
        return ingest.Store.open(self.spark, self.path).chunks

    @property
    def index(self) -> KeywordIndex | None:
        """The persisted index; None where a table of it is missing, so that its side of a retrieval is left out."""
        store = ingest.Store.open(self.spark, self.path)
        whole = all(tables.exists(self.spark, f"{self.path}/v{n}/{t}") for n in store.segments for t in ("ranges", "terms", "totals"))
        return store.index if whole else None

    def search(self, questions: DataFrame, k: int = 5, way: str = "plain", **options) -> DataFrame:
        """questions: query_id, text. The k best chunks of each by fused rank (C06). way: plain, hyde or multi_query, the
        wordings of a query searched each and put together (ML4, ML5). Where the keyword index is missing, by vectors."""
        if way != "plain":
            return {"hyde": answering.hyde, "multi_query": answering.multi_query}[way](questions, lambda q, n: self.search(q, n, **options), k)
        asked = questions.withColumn("embedding", models.embedded("text", self.embed))
        index = self.index
        hits = retrieval.hybrid(asked, self.chunks, index, k, use_keyword=index is not None, **options)
        return hits.join(self.chunks.drop("embedding"), "doc_id").withColumn("page", F.lit(None).cast("int"))

    def answer(self, questions: DataFrame, k: int = 5, agentic: bool = False, structured: models.Generator | None = None) -> DataFrame:
        """query_id, answer, thinking, confidence and more of choice questions (query_id, question, options), by the answer
        chain (C04) or, agentic, by the loop that judges and asks anew, with this engine's generator in each part (C05)."""
        if agentic:
            return answering.agentic(questions, self.search, self.generate, self.generate, self.generate, k)
        return answering.choice_chain(questions, self.search(questions.select("query_id", F.col("question").alias("text")), k), self.generate, structured)

    def ask(self, questions: DataFrame, k: int = 5, budget: int = 6000) -> DataFrame:
        """query_id, answer, grounding, n_chunks: generated from the packed context; refused where it is not grounded
        (C06, C07). A question without hits is refused without a call."""
        from siltstone.operators.retrieval import packed_context

        context = packed_context(self.search(questions, k), budget)
        rows = questions.join(context, "query_id", "left").withColumnRenamed("text", "question").withColumn("options", F.lit(None).cast("array<string>"))
        rows = tables.materialise(answering.rendered(rows.withColumn("strategy", F.lit("ZS")).withColumn("track", F.lit("open_ended"))), "asked")
        known = F.coalesce("n_packed", F.lit(0)) > 0
        asked = models.generated(rows.filter(known), model=self.generate).unionByName(rows.filter(~known).withColumn("response_text", F.lit("")))
        grounding = grounding_estimate(F.col("response_text"), F.col("context_text"))
        return asked.select("query_id", retrieval.grounded_answer(F.col("response_text"), grounding, known).alias("answer"), grounding.alias("grounding"), F.coalesce("n_packed", F.lit(0)).alias("n_chunks"))

    def stats(self) -> DataFrame:
        return collection_stats(self.chunks, F.col("source"))

    def upsert(self, chunks: DataFrame) -> None:
        """Replaces or adds chunks by id."""
        ingest.upsert(chunks, self.path)

    def delete(self, documents: DataFrame) -> None:
        """Removes the chunks of sources."""
        ingest.delete(self.spark, documents, self.path)

    def reset(self) -> None:
        ingest.reset(self.spark, self.path)

    def healthy(self) -> dict[str, bool]:
        """Which artifacts of the current version can be read and have rows."""
        out, found = {}, tables.versions(self.spark, self.path)
        segments = ingest.segments_of(self.spark, self.path, found[-1]) if found else ()
        for name in ("chunks", "manifest", "ranges", "terms"):
            folders = [f"{self.path}/v{n}/{name}" for n in segments]
            out[name] = bool(folders) and all(tables.exists(self.spark, f) for f in folders)
        if out["chunks"]:
            store = ingest.Store.open(self.spark, self.path)
            for name in ("chunks", "manifest"):
                out[name] = bool(getattr(store, name).limit(1).collect())
            for name in ("ranges", "terms"):
                out[name] = out[name] and bool(store.totals[0])
        return out
