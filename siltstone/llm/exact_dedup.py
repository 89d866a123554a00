"""Exact deduplication with an extendible-hash index on shared files.

Texts are equal when they are identical after all ASCII white space is deleted. A first native pass writes one small
key row per document (id, length, SHA-256 of the normalised text). Digests met once are settled by that alone. The
others are entries of an extendible hash table: its directory doubles and overfull buckets split, by a histogram of
hash prefixes of bounded size, until each bucket holds at most ``capacity`` texts; owner tasks take whole buckets,
chain the texts of equal hashes, compare their bytes, and write the index entries to the shared folder. Only texts
that share a digest are shuffled, and each map task first merges its own copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import attach, materialise, text_of

#: Depth of the histogram of hash prefixes: the directory never has more than 2**MAX_DEPTH slots.
MAX_DEPTH = 16
#: Digests up to this number (8 bytes each, and overhead) are broadcast to find the texts that share them.
BROADCAST_DIGESTS = 500_000
HASH_BITS = 60


def normalised(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def hash_of(sha: Column, bits: int = HASH_BITS) -> Column:
    """The first bits of a hex digest as a number."""
    return F.shiftrightunsigned(F.conv(F.substring(sha, 1, 15), 16, 10).cast("long"), HASH_BITS - bits)


def directory(histogram: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int], list[int]]:
    """Global depth, the bucket of each directory slot, and the local depth of each bucket.

    histogram: entries by prefix of max_depth bits. An overfull bucket splits by its next bit; where its local depth
    equals the global one, the directory doubles first. Buckets at max_depth stay as they are, however full.
    """
    sums = [[0] * (1 << d) for d in range(max_depth + 1)]
    for prefix, n in histogram.items():
        for d in range(max_depth + 1):
            sums[d][prefix >> (max_depth - d)] += n
    depth, slots, local, prefix_of = 0, [0], [0], [0]
    todo = [0]
    while todo:
        bucket = todo.pop()
        if sums[local[bucket]][prefix_of[bucket]] <= capacity or local[bucket] == max_depth:
            continue
        if local[bucket] == depth:
            slots = [b for b in slots for _ in range(2)]
            depth += 1
        local[bucket] += 1
        prefix_of[bucket] *= 2
        local.append(local[bucket])
        prefix_of.append(prefix_of[bucket] + 1)
        first = prefix_of[-1] << (depth - local[-1])
        slots[first : first + (1 << (depth - local[-1]))] = [len(local) - 1] * (1 << (depth - local[-1]))
        todo += [bucket, len(local) - 1]
    return depth, slots, local


def better(a: tuple[int, int | None], b: tuple[int, int | None]) -> bool:
    """Whether a (length, id) stays rather than b: more code points, then the smaller id, null last."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


class Best:
    """The document that stays of those seen, how many rows are that document, and how many rows there are."""

    __slots__ = ("rows", "tied", "top")

    def __init__(self, top: tuple[int, int | None], tied: int, rows: int):
        self.top, self.tied, self.rows = top, tied, rows

    def add(self, top: tuple[int, int | None], tied: int, rows: int) -> None:
        self.rows += rows
        if top == self.top:
            self.tied += tied
        elif better(top, self.top):
            self.top, self.tied = top, tied


def combined(held_bytes: int):
    """Merges the copies within a map task; what it holds is passed on whenever texts of held_bytes are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Best] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys, best = list(held), list(held.values())
            columns = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [k[3] for k in keys], [b.top[0] for b in best], [b.top[1] for b in best], [b.tied for b in best], [b.rows for b in best]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=ENTRY)

        for batch in batches:
            for bucket, h, sha, text, n, doc in zip(*(c.to_pylist() for c in batch.columns)):
                key = (bucket, h, sha, text)
                if key in held:
                    held[key].add((n, doc), 1, 1)
                else:
                    held[key] = Best((n, doc), 1, 1)
                    size += len(text) * 2 + 200
                    if size > held_bytes:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()

    return run


ENTRY = ["bucket", "h", "sha", "text", "n_chars", "doc_id", "tied", "rows"]
ENTRY_SCHEMA = "bucket int, h long, sha string, text string, n_chars int, doc_id long, tied long, rows long"
INDEX = ["bucket", "h", "chain", "sha", "keep_id", "keep_chars", "tied", "group_size"]
INDEX_SCHEMA = "bucket int, h long, chain int, sha string, keep_id long, keep_chars int, tied long, group_size long"


def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's buckets, sorted by hash: the texts of a hash are chained, and compared byte by byte."""
    now, chain, done = None, [], []

    def settled() -> list[tuple]:
        return [(*now, k, sha, best.top[1], best.top[0], best.tied, best.rows) for k, (sha, _, best) in enumerate(chain)]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=INDEX)

    for batch in batches:
        for bucket, h, sha, text, n, doc, tied, rows in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, h) != now:
                done += settled()
                now, chain = (bucket, h), []
            for of, held, best in chain:
                if held == text:
                    best.add((n, doc), tied, rows)
                    break
                if of == sha:
                    raise ValueError(f"two different texts have the SHA-256 {sha}")
            else:
                chain.append((sha, text, Best((n, doc), tied, rows)))
        if len(done) > 5000:
            yield out(done)
            done = []
    if done := done + settled():
        yield out(done)


def build_index(docs: DataFrame, keys: DataFrame, capacity: int, hash_bits: int, held_bytes: int) -> DataFrame:
    """The index table of all digests that two rows or more share, written to the shared folder."""
    spark = docs.sparkSession
    depth = min(MAX_DEPTH, hash_bits)
    shared = keys.groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialise(shared.select("sha", hash_of(F.col("sha"), hash_bits).alias("h")), "dedup-digests")
    prefix = F.shiftrightunsigned(F.col("h"), hash_bits - depth)
    histogram = {r[0]: r[1] for r in shared.groupBy(prefix.alias("p")).count().collect()}  # 2**depth rows at most
    deep, slots, _ = directory(histogram, capacity, depth)
    slot = spark.createDataFrame([(k, b) for k, b in enumerate(slots)], "slot long, bucket int")
    # the digests' own join column, so that a digest found by its number is checked in full
    wanted = shared.select(F.col("sha").alias("_sha"), "h").join(F.broadcast(slot), F.shiftrightunsigned(F.col("h"), hash_bits - deep) == F.col("slot")).select("_sha", "h", "bucket")
    if sum(histogram.values()) <= BROADCAST_DIGESTS:
        wanted = F.broadcast(wanted)
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).alias("n_chars"), normalised(text_of()).alias("norm"))
    found = norm.withColumn("sha", F.sha2("norm", 256)).join(wanted, F.col("sha") == F.col("_sha")).select("bucket", "h", "sha", "norm", "n_chars", "doc_id")
    entries = found.mapInArrow(combined(held_bytes), ENTRY_SCHEMA)
    index = entries.repartition("bucket").sortWithinPartitions("bucket", "h").mapInArrow(owned, INDEX_SCHEMA)
    return materialise(index, "dedup-index")


def exact_dedup(docs: DataFrame, capacity: int = 256, hash_bits: int = HASH_BITS, held_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts are equal to one another and to texts of white space alone. Of equal texts
    the row with most code points stays, then the smallest doc_id, null ids last. Repeated rows (same id and text) all
    count in group_size; one of them is kept. An empty table gives no rows. Other columns are not read.
    """
    sha = F.sha2(normalised(text_of()), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).alias("n_chars"), sha.alias("sha"))
    keys = materialise(rows, "dedup-keys")
    index = build_index(docs, keys, capacity, hash_bits, held_bytes).select("sha", "keep_id", "keep_chars", "tied", "group_size")
    out = attach(keys, index, "sha", "group_size", F.xxhash64("doc_id", "sha"))
    single = F.col("group_size").isNull()
    out = out.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"), F.col("sha").alias("text_sha256"), F.coalesce("tied", F.lit(1)).alias("_tied"),
    )
    if not index.filter("tied > 1").limit(1).collect():
        return out.drop("_tied")
    # rows of one id with equal texts: the longest are candidates to stay, and one of them is kept
    repeated = F.col("kept") & (F.col("_tied") > 1)
    one = out.filter(repeated).groupBy("doc_id", "keep_id", "group_size", "text_sha256").agg(F.count("*").alias("n"))
    one = one.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k")).select("doc_id", "keep_id", "group_size", (F.col("k") == 1).alias("kept"), "text_sha256")
    return out.filter(~repeated).drop("_tied").unionByName(one)
