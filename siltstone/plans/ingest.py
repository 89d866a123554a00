"""Ingestion: clean, chunk, index; whole corpora, or only what has changed.

A knowledge base is a row of segments. Each version below its folder holds what it has added - chunks in the order of their
sources, ranges of postings, and what its sources' manifest rows are now - and what it has taken away: the ids of chunks
that earlier segments hold no more, their places in ranges, and the counts of their terms with a minus sign. A version names
the segments that it consists of. Numbers of documents, of tokens and of documents by term are sums over segments, so a
change tokenises what it adds and what it removes, and writes as much; readers leave out what is gone. Where segments get
many, or much is gone, they are compacted into one, without tokenising anything.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import tables
from siltstone.functions import models
from siltstone.operators import chunking
from siltstone.operators import index as keyword
from siltstone.operators.prep import changed
from siltstone.sources.files import ingestion_manifest

#: Segments of a version, and the share of documents that are gone, at which it is compacted.
MAX_SEGMENTS, MAX_GONE = 8, 0.25
#: Sources up to this number are sought by a filter that reaches the files, whose pages are in the order of sources.
PUSHED_SOURCES = 200


def chunks_of(files: DataFrame, size: int = 1000, overlap: int = 200, kind: str = "recursive", embed: models.Embedder = models.hashed_embedding) -> DataFrame:
    """Cleaned chunks of files(source, text) with id, sha256 of the file, section and vector."""
    rows = files.select("source", F.sha2("text", 256).alias("sha256"), chunking.cleaned(F.col("text")).alias("text"))
    cut = chunking.recursive_chunks(rows, size=size, overlap=overlap) if kind == "recursive" else chunking.semantic_chunks(rows, embed)
    from siltstone.functions.text import section_heading

    named = cut.withColumn("doc_id", F.concat_ws("::", "source", F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string")))).withColumn("section", section_heading(F.col("content")))
    return named.withColumn("embedding", models.embedded("content", embed))


@dataclass(frozen=True)
class Store:
    """A version of a knowledge base, by its segments, oldest first."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[int, ...]

    @staticmethod
    def open(spark: SparkSession, path: str) -> Store:
        n = int(tables.current(spark, path).rsplit("/v", 1)[1])
        return Store(spark, path, n, segments_of(spark, path, n))

    def _all(self, name: str, segments: tuple[int, ...] | None = None) -> DataFrame:
        """A table of all segments, or some, with each row's segment; there are MAX_SEGMENTS of them at most, about."""
        parts = [self.spark.read.parquet(f"{self.path}/v{n}/{name}").withColumn("_segment", F.lit(n)) for n in segments or self.segments]
        return reduce(DataFrame.unionByName, parts)

    @property
    def chunks(self) -> DataFrame:
        """The chunks that count."""
        rows = self._all("chunks")
        if len(self.segments) == 1:
            return rows.drop("_segment")
        gone = self._all("gone", self.segments[1:]).select(F.col("doc_id").alias("_gone"), F.col("_segment").alias("_since"))
        return rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("_segment") < F.col("_since")), "left_anti").drop("_segment")

    def chunks_from(self, sources: DataFrame) -> DataFrame:
        """The chunks that count of some sources (source, distinct)."""
        few = [r[0] for r in sources.select("source").limit(PUSHED_SOURCES + 1).collect()]
        if len(few) > PUSHED_SOURCES:
            return self.chunks.join(sources.select("source"), "source", "left_semi")
        # each equality reaches the files' statistics, a long list of values would not
        return self.chunks.filter(_any_of([F.col("source").eqNullSafe(F.lit(x)) for x in few]))

    @property
    def ranges(self) -> DataFrame:
        rows = self._all("ranges")
        if len(self.segments) == 1:
            return rows.drop("_segment")
        dead = self._all("dead", self.segments[1:]).groupBy(F.col("segment").alias("_segment"), "range_id").agg(F.flatten(F.collect_list("places")).alias("dead"))
        return rows.drop("dead").join(dead, ["_segment", "range_id"], "left").select(*[c for c in rows.columns if c != "_segment"])

    @property
    def counts(self) -> DataFrame:
        """term, df of what counts."""
        return self._all("terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    @property
    def totals(self) -> tuple[int, int]:
        """How many chunks count, and how many tokens they have."""
        return tuple(x or 0 for x in self._all("totals").agg(F.sum("n"), F.sum("total")).first())

    @property
    def index(self) -> keyword.KeywordIndex:
        """The keyword index of what counts."""
        n, total = self.totals
        return keyword.KeywordIndex(self.ranges, keyword.term_stats(self.counts, n), n, total)

    @property
    def manifest(self) -> DataFrame:
        """source, sha256, chunk_count, config_sha256 of the sources that count."""
        last = self._all("manifest").groupBy("source").agg(F.max_by(F.struct("sha256", "chunk_count", "config_sha256"), "_segment").alias("m"))
        return last.select("source", "m.*").filter("chunk_count > 0")

    def statistics(self) -> DataFrame:
        """Counts and sizes of the chunks that count."""
        return chunking.chunk_stats(self.chunks)


def _any_of(conditions: list):
    """Conditions under one or, halved again and again so that the tree stays flat."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return _any_of(conditions[:half]) | _any_of(conditions[half:])


def segments_of(spark: SparkSession, path: str, version: int) -> tuple[int, ...]:
    return tuple(sorted(r[0] for r in spark.read.parquet(f"{path}/v{version}/segments").collect()))


def _texted(options: dict) -> dict[str, str]:
    return {k: str(v) for k, v in options.items()}


def _finish(spark: SparkSession, folder: str, segments: tuple[int, ...], base: int) -> None:
    root = folder.rsplit("/v", 1)[0]
    spark.createDataFrame([(n,) for n in segments], "segment int").write.mode("overwrite").parquet(f"{folder}/segments")
    tables.commit(spark, folder, base=base, needs=lambda n: set(segments_of(spark, root, n)))


def _base(spark: SparkSession, path: str) -> int:
    return (tables.versions(spark, path) or [0])[-1]


def _write_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """In the order of their sources; a source with very many chunks is several partitions."""
    chunks.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id").write.mode("overwrite").parquet(f"{folder}/chunks")
    return chunks.sparkSession.read.schema(chunks.schema).parquet(f"{folder}/chunks")


def write_version(chunks: DataFrame, path: str, options: dict) -> str:
    """Writes chunks, and keyword index, manifest and statistics of these, as a new version of one segment."""
    spark = chunks.sparkSession
    base, folder = _base(spark, path), tables.upcoming(spark, path)
    chunks = _write_chunks(chunks, folder)
    _write_postings(keyword.ranges_of(chunks, text_col="content"), None, folder)
    ingestion_manifest(chunks, _texted(options)).write.mode("overwrite").parquet(f"{folder}/manifest")
    chunking.chunk_stats(chunks).write.mode("overwrite").json(f"{folder}/stats")
    _finish(spark, folder, (int(folder.rsplit("/v", 1)[1]),), base)
    return folder


def _write_postings(ranges: DataFrame, removed: DataFrame | None, folder: str) -> None:
    """Ranges, and terms and totals of these without those of ``removed``."""
    ranges.write.mode("overwrite").options(**tables.LARGE_ROWS).parquet(f"{folder}/ranges")
    terms, totals = keyword.counted_terms(ranges), ranges.select("n", "total")
    if removed is not None:
        terms = terms.unionByName(keyword.counted_terms(removed).select("term", (-F.col("df")).alias("df")))
        totals = totals.unionByName(removed.select((-F.col("n")).alias("n"), (-F.col("total")).alias("total")))
    terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").write.mode("overwrite").parquet(f"{folder}/terms")
    totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{folder}/totals")


def ingest(files: DataFrame, path: str, **options) -> DataFrame:
    """Ingests all files as a new version and returns its statistics."""
    return files.sparkSession.read.json(f"{write_version(chunks_of(files, **options), path, options)}/stats")


def replace(store: Store, fresh: DataFrame, gone: DataFrame, options: dict) -> str:
    """A version with chunks added and others taken away (K05, K15). gone: chunks that count now. The old version is what
    readers see until the new one is whole."""
    spark, path = store.spark, store.path
    folder = tables.upcoming(spark, path)
    number = int(folder.rsplit("/v", 1)[1])
    gone = tables.materialise(gone.select("doc_id", "source", "content"), "gone")
    fresh = _write_chunks(fresh, folder)
    # what is removed is tokenised anew, which takes its own texts only; where it stands is found by the ranges' ids
    removed = keyword.ranges_of(gone, text_col="content")
    _write_postings(keyword.ranges_of(fresh, text_col="content"), removed, folder)
    gone.select("doc_id").write.mode("overwrite").parquet(f"{folder}/gone")
    places = store._all("ranges").select(F.col("_segment").alias("segment"), "range_id", F.posexplode("ids").alias("place", "doc_id")).join(gone.select("doc_id"), "doc_id", "left_semi")
    places.groupBy("segment", "range_id").agg(F.collect_list("place").alias("places")).write.mode("overwrite").parquet(f"{folder}/dead")
    touched = tables.materialise(gone.select("source").union(fresh.select("source")).distinct(), "touched")
    now = store.chunks_from(touched).select("source", "sha256", "doc_id").join(gone.select("doc_id"), "doc_id", "left_anti").unionByName(fresh.select("source", "sha256", "doc_id"))
    named = ingestion_manifest(now, _texted(options))
    empty = touched.join(named.select("source"), "source", "left_anti").select("source", F.lit(None).cast("string").alias("sha256"), F.lit(0).cast("long").alias("chunk_count"), F.lit(None).cast("string").alias("config_sha256"))
    named.unionByName(empty).write.mode("overwrite").parquet(f"{folder}/manifest")
    chunking.chunk_stats(fresh).write.mode("overwrite").json(f"{folder}/stats")
    _finish(spark, folder, (*store.segments, number), store.version)
    tables.discard(gone, touched, removed)
    compact_if_due(spark, path)
    return folder


def compact_if_due(spark: SparkSession, path: str) -> bool:
    store = Store.open(spark, path)
    if len(store.segments) == 1:
        return False
    gone = store._all("gone", store.segments[1:]).count()
    if len(store.segments) < MAX_SEGMENTS and gone <= MAX_GONE * (store.totals[0] + gone):
        return False
    compact(store)
    return True


def compact(store: Store) -> str:
    """A version of one segment with what counts of all: ranges lose what is dead and are merged, counts are added up."""
    spark = store.spark
    folder = tables.upcoming(spark, store.path)
    _write_chunks(store.chunks, folder)
    ranges = store.ranges
    ranges.mapInArrow(keyword.compacted, keyword.range_schema(ranges.schema["ids"].dataType.elementType.simpleString())).write.mode("overwrite").options(**tables.LARGE_ROWS).parquet(f"{folder}/ranges")
    store.counts.write.mode("overwrite").parquet(f"{folder}/terms")
    spark.createDataFrame([store.totals], "n long, total long").write.mode("overwrite").parquet(f"{folder}/totals")
    store.manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    store.statistics().write.mode("overwrite").json(f"{folder}/stats")
    _finish(spark, folder, (int(folder.rsplit("/v", 1)[1]),), store.version)
    return folder


def update(spark: SparkSession, files: DataFrame, path: str, **options) -> DataFrame:
    """Re-ingests only sources that are new or changed, drops removed ones, and returns the change set.
    Another configuration than the manifest's makes every source a changed one."""
    store = Store.open(spark, path)
    config = ingestion_manifest(files.select("source", F.sha2("text", 256).alias("sha256")), _texted(options))
    manifest = store.manifest
    changes = changed(config, manifest, sha="config_sha256").unionByName(changed(config, manifest)).groupBy("source").agg(F.min("change").alias("change"))
    changes = tables.materialise(changes, "changes")
    if changes.limit(1).collect():
        fresh = chunks_of(files.join(changes.filter("change <> 'removed'").select("source"), "source", "left_semi"), **options)
        replace(store, fresh, store.chunks_from(changes.filter("change <> 'added'")), options)
    return changes


def upsert(chunks: DataFrame, path: str, **options) -> None:
    """Chunks by id: those of known ids replace theirs, others are added."""
    store = Store.open(chunks.sparkSession, path)
    fresh = tables.materialise(chunks.select(*store.chunks.columns), "upsert")
    replace(store, fresh, store.chunks.join(fresh.select("doc_id"), "doc_id", "left_semi"), options)


def upsert_sources(spark: SparkSession, files: DataFrame, removed: DataFrame, path: str, **options) -> None:
    """The chunks of files(source, text), whole sources, in place of what their sources had, and without removed(source)."""
    store = Store.open(spark, path) if tables.versions(spark, path) else None
    if store is None:
        write_version(chunks_of(files, **options), path, options)
        return
    replace(store, chunks_of(files, **options), store.chunks_from(files.select("source").union(removed.select("source")).distinct()), options)


def delete(spark: SparkSession, documents: DataFrame, path: str, **options) -> None:
    """Removes the chunks of sources; what is left is not indexed anew."""
    store = Store.open(spark, path)
    replace(store, store.chunks.limit(0), store.chunks_from(documents.select("source").distinct()), options)


def reset(spark: SparkSession, path: str, **options) -> None:
    """A new version without any chunk."""
    write_version(Store.open(spark, path).chunks.filter("false"), path, options)
