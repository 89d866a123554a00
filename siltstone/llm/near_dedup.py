"""MinHash near-deduplication by a multi-index Hamming join of b-bit signatures.

A document's signature has SYMBOLS symbols of 16 bits, each cut from the least hash of its word shingles under one hash
function. The signature is split into CHUNKS chunks. By the pigeonhole principle two signatures that differ in at most
2 * CHUNKS - 1 symbols have a chunk with one differing symbol at most; so each chunk enumerates its one allowed error,
as one index key for each symbol left out, and every such pair meets under a key. What meets there is filtered by the
signatures, and linked on the full shingle sets.

Identical sets are one class from the start. An index bucket passes on edges that span its similar members, never all
their pairs; the tentative components of these edges hold every link. The members' sets then meet: those of a small
component in one task, which searches for true links with an inverted list and passes on edges that span the linked
members. Of a large component, such as very many near copies of a text, a few pivots meet all members first, in as many
tasks as it takes, and all that are linked through them are one cluster; only what is outside of the largest cluster
meets the others, in pairs of blocks. The components of all these edges are the result.

With SYMBOLS = 36 in 9 chunks, a pair of similarity 0.85 differs in more than 17 symbols, and so may fail to meet, with a
chance of 1e-6 at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import attach, cache_cleared_by, claim, discard, each_text, materialise, text_of
from siltstone.llm.components import components

SHINGLE = 5
SYMBOLS, CHUNK = 36, 4
CHUNKS = SYMBOLS // CHUNK
#: Signatures that differ in more symbols than this are not similar: the index finds all that differ in so many.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Larger buckets count as connected without a look at their signatures; their members' sets decide.
BUCKET = 20_000
#: In a batch of classes, a key of more rows than this sends one of them, and edges from it to the others.
LOCAL_BUCKET = 500
#: Bytes of shingle sets, and members, that one task holds of one component, or of a block of a large one.
BLOCK_BYTES, BLOCK_MEMBERS = 4 << 20, 128
#: Members of a large component that all the others meet first.
PIVOTS = 8
#: Members up to this number are broadcast to find their texts.
BROADCAST_MEMBERS = 100_000

_RANDOM = np.random.default_rng(20)
_MULTIPLIERS = _RANDOM.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; so many are kept."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


_WORDS = WordHashes()
cache_cleared_by("words", _WORDS.clear)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    x = h[: n - width + 1] * _PLACES[0]
    for k in range(1, width):
        x ^= x >> np.uint64(29)
        x += h[k : n - width + 1 + k] * _PLACES[k]
    x ^= x >> np.uint64(32)
    x *= _MIX + np.uint64(2 * (SHINGLE - width))
    x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(x: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of 16 bits; in parts, so that a very long text takes no more memory than a long one."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 4096):
        np.minimum(low, (x[at : at + 4096, None] * _MULTIPLIERS).min(axis=0), out=low)
    return ((low * _MIX) >> np.uint64(48)).astype(np.uint16)


def set_digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("words")
    for batch in batches:
        n, digests, signatures = [], [], []
        for text in each_text(batch.column(2)):
            x = shingles(text)
            n.append(len(x))
            digests.append(set_digest(x) if len(x) else None)
            signatures.append(signature(x).tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "h", "n_shingles", "digest", "signature"])


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


#: What goes with a key: the class's digest, its signature in half bytes, its size and whether its bucket is too large; or
#: both ends of an edge.
DIGEST, HALF = 16, SYMBOLS // 2
ENTRY = DIGEST + HALF + 5


def halved(sig: np.ndarray) -> np.ndarray:
    """The low half byte of each symbol, two to a byte: unequal ones are from unequal symbols."""
    low = (sig & 15).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many half bytes rows differ."""
    x = a ^ b
    return ((x >> 4 != 0).sum(axis=-1) + (x & 15 != 0).sum(axis=-1)).astype(np.int64)


def index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CHUNKS * CHUNK keys for each class: its chunk, the symbol left out, and the chunk's other symbols. A row with a
    negative key is an edge."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, size, sig = matrix(batch.column(0), np.uint8, DIGEST), batch.column(1).to_numpy(), matrix(batch.column(2), np.uint16, SYMBOLS)
        entry = np.zeros((len(ids), ENTRY), np.uint8)
        entry[:, :DIGEST], entry[:, DIGEST : DIGEST + HALF] = ids, halved(sig)
        entry[:, DIGEST + HALF : -1] = size.astype("<u4").view(np.uint8).reshape(-1, 4)
        for c in range(CHUNKS):
            part = sig[:, c * CHUNK : (c + 1) * CHUNK].astype(np.int64)
            for out in range(CHUNK):
                a, b, d = (part[:, k] for k in range(CHUNK) if k != out)
                key = np.int64((c * CHUNK + out) << 48) | a << 32 | b << 16 | d
                _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                hot = count > LOCAL_BUCKET
                stays = ~hot[inverse]
                stays[first[hot]] = True
                entry[:, -1] = hot[inverse]
                yield keyed(key[stays], entry[stays])
                gone = np.flatnonzero(~stays)
                if len(gone):
                    yield keyed(-1 - (gone.astype(np.int64) * 7919 + c), np.concatenate([ids[gone], ids[first[inverse[gone]]]], axis=1))


def keyed(key: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])
    return pa.RecordBatch.from_arrays([pa.array(key), data.cast(pa.binary())], names=["key", "entry"])


KEYED_SCHEMA = "key long, entry binary"


def spanning(low: np.ndarray, size: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that span the components of a bucket's similar members: what is reached is not compared again."""
    rest = np.arange(len(low))
    edges = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = (apart(low[rest], low[at]) <= MAX_DISTANCE) & (np.minimum(size[rest], size[at]) * 100 >= np.maximum(size[rest], size[at]) * percent)
            if near.any():
                found = rest[near]
                edges += [(at, b) for b in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def bucket_edges(percent: int):
    """From rows sorted by key: edges that span each bucket's similar members."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ends = (pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary()) for x in (a, b))
        return pa.RecordBatch.from_arrays(list(ends), names=["a", "b"])

    def closed(key: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets."""
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[start, len(key)])
        ids, low, large = rows[:, :DIGEST], rows[:, DIGEST : DIGEST + HALF], rows[:, -1] != 0
        size = np.ascontiguousarray(rows[:, DIGEST + HALF : -1]).view("<u4")[:, 0].astype(np.int64)
        two = start[length == 2]
        two = two[~large[two] & ~large[two + 1]]
        near = (apart(low[two], low[two + 1]) <= MAX_DISTANCE) & (np.minimum(size[two], size[two + 1]) * 100 >= np.maximum(size[two], size[two + 1]) * percent)
        a, b = two[near].tolist(), (two[near] + 1).tolist()
        for at, n in zip(start[length > 1].tolist(), length[length > 1].tolist()):
            part = slice(at, at + n)
            if large[part].any() or n > BUCKET:
                pairs = [(0, k) for k in range(1, n)]
            elif n == 2:
                continue
            else:
                pairs = spanning(low[part], size[part], percent)
            a += [at + x for x, _ in pairs]
            b += [at + y for _, y in pairs]
        if a:
            yield out(ids[a], ids[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None
        star: tuple[int, np.ndarray] | None = None  # key and first member of a bucket that is too large
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            edge = key < 0
            if edge.any():
                ends = matrix(batch.column(1).filter(pa.array(edge)), np.uint8, 2 * DIGEST)
                yield out(ends[:, :DIGEST], ends[:, DIGEST:])
            key, rows = key[~edge], matrix(batch.column(1).filter(pa.array(~edge)), np.uint8, ENTRY)
            if star is not None and len(key):
                same = key == star[0]
                if same.any():
                    yield out(rows[same][:, :DIGEST], np.repeat(star[1][None], same.sum(), axis=0))
                key, rows = key[~same], rows[~same]
                star = None if len(key) else star
            if not len(key):
                continue
            if held is not None:
                key, rows = np.r_[held[0], key], np.concatenate([held[1], rows])
            last = key == key[-1]
            if not last.all():
                yield from closed(key[~last], rows[~last])
            held = key[last], rows[last]
            if len(held[0]) > BUCKET:
                star = int(held[0][0]), held[1][0, :DIGEST]
                yield out(held[1][:, :DIGEST], np.repeat(star[1][None], len(held[0]), axis=0))
                held = None
        if held is not None:
            yield from closed(*held)

    return run


def member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, shingles, root and blocks of texts (digest, text, root, blocks) that are members: of a class, one in each
    task."""
    claim("words")
    seen: set[bytes] = set()
    for batch in batches:
        at, sets = [], []
        digests = batch.column(0).to_pylist()
        for k, text in enumerate(each_text(batch.column(1))):
            if digests[k] not in seen:
                x = shingles(text)
                if set_digest(x) == digests[k]:
                    seen.add(digests[k])
                    at.append(k)
                    sets.append(x.tobytes())
        own = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 2, 3)]
        yield pa.RecordBatch.from_arrays([own[0], pa.array(sets, pa.binary()), *own[1:]], names=["digest", "shingles", "root", "blocks"])


def is_linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked(sets: list[np.ndarray], block: list[int], percent: int) -> list[tuple[int, int]]:
    """Edges that span the members linked on their full sets; with two blocks, only links between these are sought."""
    n = len(sets)
    if n == 2:
        return [(0, 1)] if is_linked(*sets, percent) else []
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[inverse] > 1  # a shingle of one member alone is in no intersection
    owner, inverse = owner[shared], inverse[shared]
    order = np.argsort(inverse, kind="stable")
    posting, start = owner[order], np.searchsorted(inverse[order], np.arange(len(count) + 1))
    begin = np.searchsorted(owner, np.arange(n + 1))
    side, two = np.array(block), len(set(block)) > 1
    waiting, edges = np.ones(n, bool), []
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            lists = [posting[start[s] : start[s + 1]] for s in inverse[begin[at] : begin[at + 1]]]
            if not lists:
                continue
            both = np.bincount(np.concatenate(lists), minlength=n)
            found = waiting & (100 * both >= percent * (size + size[at] - both))
            if two:
                found &= side != side[at]
            found = np.flatnonzero(found)
            if len(found):
                waiting[found] = False
                edges += [(at, b) for b in found]
                queue += list(found)
    return edges


def unit_links(percent: int):
    """From rows sorted by task unit: the edges that span each unit's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, {}

        def closed() -> tuple[list[bytes], list[bytes]]:
            if len(members) < 2:
                return [], []
            ids = list(members)
            edges = linked([np.frombuffer(members[i][1], np.uint64) for i in ids], [members[i][0] for i in ids], percent)
            return [ids[a] for a, _ in edges], [ids[b] for _, b in edges]

        for batch in batches:
            a, b = [], []
            for root, i, j, block, digest, held in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, i, j) != now:
                    x, y = closed()
                    a += x
                    b += y
                    now, members = (root, i, j), {}
                members[digest] = (block, held)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        a, b = closed()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def pivot_links(percent: int):
    """From rows sorted by root, part and pivots first: root, digest and the pivots that it is linked with, itself if it is
    one. Of each root the first part's pivots alone have a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots = None, []
        for batch in batches:
            out = [], [], []
            for root, part, is_member, digest, held in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, part) != now:
                    now, pivots = (root, part), []
                x = np.frombuffer(held, np.uint64)
                found = [other for other, y in pivots if other != digest and is_linked(x, y, percent)]
                if not is_member:
                    pivots.append((digest, x))
                    found.append(digest)
                if is_member or not part:
                    for column, value in zip(out, (root, digest, found)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.binary()))], names=["root", "digest", "linked"])

    return run


def pivot_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From roots and the distinct sets of pivots that members of each are linked with: pivot, cluster. Sets that share a
    pivot are of one cluster."""
    for batch in batches:
        pivot, cluster = [], []
        for sets in batch.column(1).to_pylist():
            parent: dict[bytes, bytes] = {}

            def top(x: bytes, parent: dict[bytes, bytes] = parent) -> bytes:
                while parent.setdefault(x, x) != x:
                    x = parent[x]
                return x

            for some in sets:
                for p in some:
                    a, b = top(some[0]), top(p)
                    parent[max(a, b)] = min(a, b)
            for p in parent:
                pivot.append(p)
                cluster.append(top(p))
        yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.binary()), pa.array(cluster, pa.binary())], names=["_pivot", "cluster"])


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * intersection >= percent * union of their sets of 5-word shingles (percent 80 or more).
    Null and empty texts and texts of white space have an empty set, link with nothing and are components of
    their own. Texts under five words have their whole word sequence as one shingle. Repeated rows have equal sets and
    one component. component_id is the smallest id reachable, null ids aside; where all ids of a component are null it
    is null. kept: doc_id equals component_id, or both are null. Columns other than doc_id and text, whatever their
    names, are not read. An empty table gives no rows.
    """
    out = grouped(docs, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """As near_dedup(), with h, a hash of the text that tells rows of one id apart, and group: what rows of one component
    share, null where a row's set is empty or it is alone."""
    if not 80 <= percent <= 100:
        raise ValueError("percent is from 80 to 100")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    sketches = materialise(rows.mapInArrow(sketched, "doc_id long, h long, n_shingles long, digest binary, signature binary"), "near-sketches")
    # a class is found again by the id and the text of one of its rows
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h"))
    classes = sketches.filter("digest is not null").groupBy("digest").agg(one.alias("one"), F.min("n_shingles").cast("int").alias("size"), F.min("signature").alias("signature"), F.count("*").alias("copies"))
    classes = materialise(classes.select("digest", F.col("one.doc_id").alias("low_id"), F.col("one.h").alias("low_h"), "size", "signature", "copies"), "near-classes")
    index = classes.select("digest", "size", "signature").mapInArrow(index_keys, KEYED_SCHEMA)
    edges = index.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_edges(percent), "a binary, b binary")
    roots = components(edges, "near-tentative")
    scratch = [materialise(roots, "near-members")]
    linked_to = components(confirmed(rows, classes, scratch[0], percent, scratch), "near-linked")
    discard(*scratch)
    nodes = classes.join(linked_to, F.col("digest") == F.col("node"), "left")
    lowest = nodes.filter("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("low_id").alias("lowest"), F.sum("copies").alias("n"))
    whole = nodes.filter("root is not null or copies > 1").join(lowest, F.col("root") == F.col("_root"), "left")
    groups = materialise(whole.select(F.hex("digest").alias("hex"), F.coalesce("lowest", "low_id").alias("component"), "copies", F.hex(F.coalesce("root", "digest")).alias("group")), "near-groups")
    own = F.coalesce(F.hex("digest"), F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")))
    out = attach(sketches.select("doc_id", "h", "n_shingles", own.alias("hex")), groups, "hex", "copies", F.xxhash64("doc_id", "h"))
    return out.select("doc_id", "h", "n_shingles", F.when(F.col("group").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def confirmed(rows: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, scratch: list[DataFrame]) -> DataFrame:
    """Edges (a, b) that span the true links within the tentative components. scratch is given the written tables that are
    read for the edges, and for nothing else."""
    members = classes.join(roots, F.col("digest") == F.col("node")).select("digest", "root", "low_id", "low_h", "size")
    total = members.groupBy("root").agg(F.count("*").alias("n"), (F.sum("size") * 8).alias("bytes"))
    is_large = (F.col("n") > 2 * BLOCK_MEMBERS) | (F.col("bytes") > BLOCK_BYTES)
    total = materialise(total.select("root", is_large.alias("large"), F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "near-roots")
    members = materialise(members.drop("size"), "near-places")
    # a root has many members: it is not what rows are dealt by
    hot = total.filter("large").select(F.col("root").alias("_root"), "blocks")
    wanted = members.join(F.broadcast(hot) if hot.count() <= BROADCAST_MEMBERS else hot, F.col("root") == F.col("_root"), "left").select(F.col("digest").alias("_digest"), "low_id", "low_h", "root", "blocks")
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST_MEMBERS else wanted
    # root and blocks ride with the text, so that sets are not shuffled to find them
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("low_id")) & (F.col("h") == F.col("low_h"))).select("_digest", "text", "root", "blocks")
    sets = materialise(found.mapInArrow(member_sets, "digest binary, shingles binary, root binary, blocks int"), "near-sets")
    scratch += [total, members, sets]
    edge = "a binary, b binary"
    small = sets.filter("blocks is null").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "digest", "shingles")
    links = small.repartition("root").sortWithinPartitions("root", "i", "j").mapInArrow(unit_links(percent), edge)
    if not hot.limit(1).collect():
        return links
    large = sets.filter("blocks is not null")
    # pivots are the members whose signatures are most like those of all: of copies that were each edited, the original
    signatures = large.select("root", "digest").distinct().join(classes.select("digest", "signature"), "digest")
    symbols = signatures.select("root", "digest", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(SYMBOLS - 1)), lambda k: F.substring("signature", 2 * k + 1, F.lit(2)))).alias("at", "symbol"))
    common = materialise(symbols.groupBy("root", "at", "symbol").agg(F.count("*").alias("n")).filter("n > 1"), "near-symbols")
    scratch.append(common)
    like = symbols.join(F.broadcast(common) if common.count() <= BROADCAST_MEMBERS else common, ["root", "at", "symbol"]).groupBy("root", "digest").agg(F.sum("n").alias("n"))
    best = W.partitionBy("root").orderBy(F.desc("n"), "digest")
    pivots = like.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= PIVOTS).select(F.col("digest").alias("_pivot"))
    chosen = large.join(pivots, F.col("digest") == F.col("_pivot"), "left")
    part = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    led = chosen.filter("_pivot is not null").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(False).alias("member"), "digest", "shingles")
    rest = chosen.filter("_pivot is null").select("root", part.alias("part"), F.lit(True).alias("member"), "digest", "shingles")
    met = led.unionByName(rest).repartition("root", "part").sortWithinPartitions("root", "part", "member").mapInArrow(pivot_links(percent), "root binary, digest binary, linked array<binary>")
    met = materialise(met, "near-pivots")
    scratch.append(met)
    through = met.select(F.explode("linked").alias("a"), F.col("digest").alias("b")).filter("a <> b")
    # a root has PIVOTS pivots, and so 2 ** PIVOTS sets of them at most
    sets_of = met.filter(F.size("linked") > 0).groupBy("root").agg(F.collect_set("linked").alias("sets"))
    clusters = materialise(sets_of.mapInArrow(pivot_clusters, "_pivot binary, cluster binary"), "near-clusters")
    clusters = F.broadcast(clusters) if clusters.count() <= BROADCAST_MEMBERS else clusters
    own = met.withColumn("first", F.get("linked", F.lit(0))).join(clusters, F.col("first") == F.col("_pivot"), "left").select("digest", "root", F.coalesce("cluster", "digest").alias("cluster"))
    own = materialise(own.join(F.broadcast(hot) if hot.count() <= BROADCAST_MEMBERS else hot, F.col("root") == F.col("_root")).select("digest", "root", "blocks", "cluster"), "near-own")
    sizes = own.groupBy("root", "cluster").agg(F.count("*").alias("n"))
    most = sizes.groupBy("root").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("every"))
    # outside of the largest cluster: blocks of its own, which meet one another and those of the cluster
    left = most.filter("every > n").select(F.col("root").alias("_root"), "main", F.ceil((F.col("every") - F.col("n")) / BLOCK_MEMBERS).cast("int").alias("others"))
    left = materialise(left, "near-left")
    if not left.limit(1).collect():
        return links.unionByName(through)
    placed = own.join(F.broadcast(left) if left.count() <= BROADCAST_MEMBERS else left, F.col("root") == F.col("_root"))
    h = F.xxhash64("digest")
    outside = F.col("cluster") != F.col("main")
    # blocks of the cluster have negative numbers
    placed = placed.select("digest", F.when(outside, F.pmod(h, F.col("others"))).otherwise(-1 - F.pmod(h, F.col("blocks"))).cast("int").alias("own_block"), F.when(outside, F.col("blocks")).otherwise(F.lit(0)).alias("down"), "others")
    placed = placed.withColumn("with", F.explode(F.sequence(-F.col("down"), F.col("others") - 1)))
    units = large.select("digest", "root", "shingles").join(placed, "digest")
    units = units.select("root", F.least("own_block", "with").alias("i"), F.greatest("own_block", "with").alias("j"), F.col("own_block").alias("block"), "digest", "shingles")
    between = units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(unit_links(percent), edge)
    return links.unionByName(through).unionByName(between)
