"""Approximate nearest neighbours by multi-index hashing.

Rotations learnt by iterative quantisation on a bounded sample turn vectors into binary codes of several hundred bits.
A code splits into substrings of ``width`` bits, and each substring has a table of its own: the rows of one keyed table,
whose key is the substring's number and value. A query probes each table with its own value and all that differ from it
in ``errors`` bits at most. By the pigeonhole principle that retrieves every code within a Hamming distance of
``substrings * (errors + 1) - 1``; codes farther away are retrieved when any one of the substrings is near enough, which
the fit makes likely for true neighbours. What is retrieved and lies within ``radius`` on the code's first words is ranked
by cosine on the original vectors in double precision.

Tables and probes meet in a join on the key, and the distance on those words is a condition of that join, so that what a
bucket holds by chance never becomes a row; no vector is copied to where it is not asked for. The fit takes the width,
errors and number of substrings that reach the wanted recall on the sample at the least cost of rows shuffled and codes
compared, so the more vectors there are the longer the substrings get, and the smaller the share of codes that a query
meets.

Equal vectors are one class from the start: it is indexed once, asks once, and hands on its smallest ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import attach, materialise

#: Vectors that rotations, widths and the radius are fitted on, at most; bits of the longest code.
SAMPLE, MAX_BITS = 8_192, 1_536
#: 64-bit words of a code that the radius is measured on.
WORDS = 12
#: Share of the sample's neighbours that the tables, and then the radius, must let through.
PROBED, REACHED = 0.965, 0.975
#: Queries whose true neighbours the fit looks up, by comparing them with all vectors.
FITTED_QUERIES = 256
#: What a shuffled row costs, in codes compared within the join.
ROW_COST = 3
#: Queries of the exact search that a task holds at once, about.
EXACT_BLOCK = 2_048


@dataclass(frozen=True)
class Codes:
    """mean and rotation give a code's bits, in substrings of ``width`` bits, packed in 64-bit words so that none crosses
    a word. ``substrings`` of them have tables; a code is longer than these where they fill fewer than WORDS words, as
    distances are measured on so many. errors and radius: how far queries look. met: the share of other codes that a
    query is expected to meet in its buckets."""

    mean: np.ndarray
    rotation: np.ndarray
    width: int
    substrings: int
    errors: int
    radius: int
    met: float = 1.0

    @property
    def each(self) -> int:
        """Substrings in a word."""
        return 64 // self.width

    @property
    def length(self) -> int:
        """Substrings of the whole code."""
        return max(self.substrings, WORDS * self.each)

    def words(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 64-bit words."""
        on = bits(unit(x), self.mean, self.rotation[:, : self.width * self.length])
        value = (on.reshape(len(on), self.length, self.width) << np.arange(self.width, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
        out = np.zeros((len(on), -(-self.length // self.each)), np.uint64)
        for s in range(self.length):
            out[:, s // self.each] |= value[:, s] << np.uint64(s % self.each * self.width)
        return out.view(np.int64)

    def masks(self) -> list[int]:
        """Every pattern of ``errors`` set bits at most."""
        return [sum(1 << b for b in at) for n in range(self.errors + 1) for at in combinations(range(self.width), n)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest part is divided out first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bits(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return ((x - mean) @ rotation > 0).astype(np.uint64)


def rotations(x: np.ndarray, total: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and ``total`` directions: one iterative quantisation after another, each from another random start."""
    mean, dim = x.mean(axis=0), x.shape[1]
    z = x[rng.permutation(len(x))[:2048]] - mean
    found = []
    while sum(t.shape[1] for t in found) < total:
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(z.T @ np.where(z @ turn > 0, 1.0, -1.0), full_matrices=False)
            turn = left @ right
        found.append(turn)
    return mean, np.concatenate(found, axis=1)[:, :total]


def fit(sample: np.ndarray, near: tuple[np.ndarray, np.ndarray], vectors: int, asking: int, rounds: int = 8, seed: int = 9) -> Codes:
    """Learns the codes from the sample, and from pairs of true neighbours chooses width, errors, substrings and radius for
    so many vectors and queries."""
    rng = np.random.default_rng(seed)
    x = unit(np.unique(sample, axis=0))
    mean, turn = rotations(x, MAX_BITS, rounds, rng)
    if not len(near[0]):
        return Codes(mean, turn, 8, 1, 0, 64 * WORDS)
    code = lambda v: bits(unit(v), mean, turn).astype(bool)
    own = code(x)
    close, other = code(near[0]) != code(near[1]), own[rng.integers(0, len(x), 4096)] != own[rng.integers(0, len(x), 4096)]
    best = None
    for width in range(6, 25):
        tables = MAX_BITS // width
        apart, chance = (d[:, : tables * width].reshape(len(d), tables, width).sum(axis=2) for d in (close, other))
        for errors in range(4):
            recall = np.maximum.accumulate(apart <= errors, axis=1).mean(axis=0)
            enough = np.flatnonzero(recall >= PROBED)
            n = int(enough[0]) + 1 if len(enough) else tables
            probes = sum(1 for e in range(errors + 1) for _ in combinations(range(width), e))
            met = max((chance[:, :n] <= errors).any(axis=1).mean(), 1 - (1 - min(1.0, probes / 2**width)) ** n)
            cost = (recall[n - 1] < PROBED, -min(recall[n - 1], PROBED), ROW_COST * (vectors * n + asking * n * probes) + asking * vectors * met)
            if best is None or cost < best[0]:
                best = cost, width, errors, n, met
    _, width, errors, n, met = best
    codes = Codes(mean, turn, width, n, errors, 0, float(met))
    far = close[:, : WORDS * codes.each * width].sum(axis=1)
    return replace(codes, radius=int(np.ceil(np.quantile(far, REACHED))))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the vectors that take part: not null, not zero, no null or non-finite part, and as long as most are."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))
    repeated = rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")) if repeated else rows


def parts(column: pa.Array) -> np.ndarray:
    """A batch's vectors as the rows of a matrix."""
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def coded(rows: DataFrame, codes: Codes) -> DataFrame:
    """vec_id, digest (equal for equal vectors), code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = parts(batch.column(1)) + 0.0  # no negative zeros
                digests = [hashlib.blake2b(r.tobytes(), digest_size=16).hexdigest() for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array(list(codes.words(x)), pa.list_(pa.int64()))], names=["vec_id", "digest", "code"])

    return rows.mapInArrow(run, "vec_id long, digest string, code array<long>")


def keys(codes: Codes) -> Column:
    """The keys of a code's substrings: number and value."""

    def key(s: Column) -> Column:
        word = F.get("code", F.floor(s / codes.each).cast("int"))
        value = F.call_function("shiftrightunsigned", word, (s % codes.each * codes.width).cast("int"))
        return s.cast("long") * F.lit(1 << codes.width) + value.bitwiseAND(F.lit((1 << codes.width) - 1))

    return F.transform(F.sequence(F.lit(0), F.lit(codes.substrings - 1)), key)


def retrieved(classes: DataFrame, codes: Codes) -> DataFrame:
    """qid, cid: the classes that each asking class finds in a table and within the radius."""
    words = lambda name: [F.get("code", F.lit(i)).alias(f"{name}{i}") for i in range(WORDS)]
    entries = classes.select("cid", *words("w"), F.explode(keys(codes)).alias("key"))
    masks = F.array(*[F.lit(m).cast("long") for m in codes.masks()])
    probes = classes.filter("asks").select(F.col("cid").alias("qid"), *words("q"), F.explode(keys(codes)).alias("own"))
    probes = probes.select("*", F.explode(masks).alias("mask")).withColumn("probed", F.col("own").bitwiseXOR(F.col("mask"))).drop("own", "mask")
    apart = sum((F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(WORDS)), F.lit(0))
    return entries.join(probes, (F.col("key") == F.col("probed")) & (apart <= codes.radius)).select("qid", "cid").distinct()


def cosines(pairs: DataFrame) -> DataFrame:
    """qid, cid, score of pairs(qid, cid, q, v): cosine in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = (unit(parts(batch.column(2))) * unit(parts(batch.column(3)))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["qid", "cid", "score"])

    return pairs.select("qid", "cid", "q", "v").mapInArrow(run, "qid long, cid long, score double")


def exact(rows: DataFrame, asked: list, keep: int) -> DataFrame:
    """qid, vec_id, score: the ``keep`` nearest of each query of a bounded list (qid, v), from all vectors. Of a batch of
    vectors only each query's nearest leave the task."""
    ids, q = np.array([i for i, _ in asked]), unit(np.array([v for _, v in asked], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec, x = batch.column(0).to_numpy(), unit(parts(batch.column(1)))
            out = []
            for i, y in zip(ids, q):
                score = (x * y).sum(axis=1)
                # all that tie with the last one stay, then ids decide
                some = np.flatnonzero(score >= np.partition(score, -keep)[-keep]) if len(score) > keep else np.arange(len(score))
                out += [(i, vec[t], score[t]) for t in some[np.lexsort((vec[some], -score[some]))[:keep]]]
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["qid", "vec_id", "score"])

    return rows.select("vec_id", "v").mapInArrow(run, "qid long, vec_id long, score double")


def true_neighbours(rows: DataFrame, asked: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a bounded list of queries (qid, v), and of their k nearest others, pair by pair."""
    pairs = best(exact(rows, asked, k + 1), k + 1, "vec_id").filter("qid <> vec_id").select("qid", "vec_id")
    near = pairs.join(rows, "vec_id").select("qid", "v").collect()  # (k + 1) * FITTED_QUERIES rows at most
    of = dict(asked)
    return np.array([of[r["qid"]] for r in near], np.float64), np.array([r["v"] for r in near], np.float64)


def best(rows: DataFrame, n: int, ident: str) -> DataFrame:
    """Each qid's first n by score, ties to the smaller id."""
    order = W.partitionBy("qid").orderBy(F.desc("score"), ident)
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """For each vector whose id is divisible by ``every``, its k nearest others by cosine: query_id, rank, vec_id, score.

    Vectors that are null or zero, hold null or non-finite parts, or differ in length from most, take no part, nor do
    rows without an id. Ties go to the smaller id. Repeated rows of an id are one vector (of different ones, the least
    counts). A query that finds fewer than k in the index is compared with all vectors, so with fewer than k others all
    are returned; an empty table gives no rows. Other columns are not read.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    is_asking = F.col("vec_id") % every == 0
    total, asking = rows.agg(F.count("*"), F.count_if(is_asking)).first()
    near = true_neighbours(rows, [(r["vec_id"], r["v"]) for r in first[:FITTED_QUERIES]], k)
    codes = fit(np.array([r["v"] for r in first], np.float64), near, total, asking)
    every_one = materialise(coded(rows, codes), "nearest-codes")
    # a class hands on its k + 1 smallest ids: one of them may be the query itself
    members = every_one.select("digest", "vec_id").withColumn("n", F.row_number().over(W.partitionBy("digest").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    members = members.groupBy("digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = every_one.groupBy("digest").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"), F.max(is_asking).alias("asks"), F.first("code").alias("code"))
    classes = materialise(classes.join(members, "digest"), "nearest-classes")
    pairs = materialise(retrieved(classes, codes), "nearest-pairs")
    asked = rows.select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    scored = cosines(pairs.join(rows, F.col("cid") == F.col("vec_id")).join(asked, "qid"))
    # the k + 1 best classes hold the k + 1 best ids
    ids = best(scored, k + 1, "cid").select("qid", "cid", "score").join(classes.select("cid", "ids"), "cid").select("qid", F.explode("ids").alias("vec_id"), "score")
    found = materialise(best(ids, k + 1, "vec_id").select("qid", "vec_id", "score"), "nearest-found")
    number = found.groupBy("qid").agg(F.count("*").alias("n"))
    wanting = classes.filter("asks").select(F.col("cid").alias("qid")).join(number, "qid", "left").filter(F.coalesce("n", F.lit(0)) < min(k + 1, total)).select("qid")
    # these are few, and are compared with all vectors in blocks of bounded size
    wanting = materialise(wanting.join(asked, "qid").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(1, asking // EXACT_BLOCK)))), "nearest-wanting")
    for block in [r[0] for r in wanting.groupBy("block").count().orderBy("block").collect()]:
        some = [(r["qid"], r["q"]) for r in wanting.filter(F.col("block") == block).collect()]
        found = found.join(wanting.filter(F.col("block") == block), "qid", "left_anti").unionByName(best(exact(rows, some, k + 1), k + 1, "vec_id").select("qid", "vec_id", "score"))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))), lambda x: F.struct(x["i"].alias("i"), (-x["s"]).alias("s")))
    lists = found.groupBy("qid").agg(ranked.alias("near")).join(classes.select("digest", "copies", F.col("cid").alias("qid")), "qid")
    lists = materialise(lists.select("digest", "copies", "near"), "nearest-lists")
    queries = every_one.filter(is_asking).select(F.col("vec_id").alias("query_id"), "digest")
    out = attach(queries, lists, "digest", "copies", F.col("query_id"))
    own = F.slice(F.filter("near", lambda x: x["i"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), F.col("x.s").alias("score"))
