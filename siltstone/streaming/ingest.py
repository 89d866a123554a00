"""Ingestion as a stream: of files as they arrive, or of changes to sources, by the hash of what they held before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A source's text at a time; null when it was removed.
EVENTS = "source string, text string, at long"


def file_stream(spark: SparkSession, path: str, pattern: str = "*.md", per_batch: int = 1000) -> DataFrame:
    """source, text of files as they arrive. Spark's file source sees a path once: for files that change see folder_feed."""
    rows = spark.readStream.schema("value string").format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.col("value").alias("text"))


def ingest_stream(files: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends the chunks of each micro-batch, under its number, so that a batch run again replaces its own rows."""
    from siltstone.plans.ingest import chunks_of

    def each(batch: DataFrame, number: int) -> None:
        chunks_of(batch, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folder_feed(files: DataFrame, feed: str) -> int:
    """Appends to a feed (JSON lines of EVENTS) what has changed in files(source, text) since the feed's last events: new and
    changed texts, and the sources that are gone. Returns the feed's new time; each call is one step of it."""
    from siltstone.tables import exists

    spark = files.sparkSession
    past = spark.read.schema(EVENTS).json(feed) if exists(spark, feed) else spark.createDataFrame([], EVENTS)
    last = past.groupBy("source").agg(F.max("at").alias("at"), F.max_by(F.sha2("text", 256), "at").alias("old"))
    at = (past.agg(F.max("at")).first()[0] or 0) + 1
    both = files.select("source", "text").withColumn("new", F.sha2("text", 256)).join(last.select("source", "old"), "source", "full")
    both.filter(~F.col("new").eqNullSafe(F.col("old"))).select("source", "text", F.lit(at).cast("long").alias("at")).write.mode("append").option("ignoreNullFields", False).json(feed)
    return at


def feed_stream(spark: SparkSession, feed: str, per_batch: int = 1000) -> DataFrame:
    """The events of a feed as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).json(feed)


def changes(events: DataFrame) -> DataFrame:
    """source, text, change (added, changed, removed) of a stream of events: the state of a source is the hash of its text
    and the time of the last event; an event of the same text, or an older one, changes nothing. Of several events of a
    micro-batch the last counts. A source that was never there, or is gone already, is not removed."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import hashlib

        held, when = state.get if state.exists else (None, -1)
        text, at = None, None
        for frame in frames:
            for t, a in zip(frame["text"], frame["at"]):
                if a > (when if at is None else at):
                    text, at = t, int(a)
        if at is None:
            return
        new = None if text is None else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        state.update((new, at))
        if new != held:
            yield pd.DataFrame({"source": [key[0]], "text": [text], "change": ["removed" if new is None else "added" if held is None else "changed"]})

    return events.groupBy("source").applyInPandasWithState(step, "source string, text string, change string", "sha256 string, at long", "append", GroupStateTimeout.NoTimeout)


def sync_stream(events: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Keeps a knowledge base like the sources that a stream of events tells of: a changed source replaces its chunks, a
    removed one takes them away, and the keyword index follows by segments. A micro-batch that runs again replaces the
    same sources by the same chunks."""
    from siltstone.plans.ingest import upsert_sources
    from siltstone.tables import materialise

    def each(batch: DataFrame, number: int) -> None:
        rows = materialise(batch, f"changes-{number}")
        if rows.limit(1).collect():
            upsert_sources(rows.sparkSession, rows.filter("change <> 'removed'").select("source", "text"), rows.filter("change = 'removed'").select("source"), path, **options)

    return changes(events).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type of a stream of events; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
