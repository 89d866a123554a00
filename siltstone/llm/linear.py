"""Linear models over hashed words, fitted on all rows of a table by sums that its partitions contribute to.

A text is a bag: the sorted hash buckets of its distinct words and of their beginnings. Every pass of a fit is one job in
which each task adds up a vector of fixed size (a gradient, a histogram, document frequencies); the vectors are summed by
place, so that shuffles and the driver hold that size, whatever the number of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cache_cleared_by, claim, each_text, materialise, text_of

#: Words, and beginnings of words of PREFIX bytes, are hashed to so many bits.
BITS, PREFIX = 20, 6
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Buckets(dict):
    """Hash buckets of words; so many are kept. A word over PREFIX bytes also stands for its beginning."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        h = lambda x: xxhash.xxh3_64_intdigest(x) >> (64 - BITS)
        b = (h(word), h(b"^" + word[:PREFIX])) if len(word) > PREFIX else (h(word),)
        if len(self) < self.LIMIT:
            self[word] = b
        return b


_BUCKETS = Buckets()
cache_cleared_by("buckets", _BUCKETS.clear)


def word_buckets(text: str) -> np.ndarray:
    """A text's bag, A-Z in lower case."""
    words = set(_WORD.findall(text.encode("utf-8", "surrogatepass").lower()))
    return np.unique(np.fromiter((b for w in words for b in _BUCKETS[w]), np.int32))


def bags(docs: DataFrame, others: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns and ``words``, the bag of each whole text, as a written table; null texts have an empty one."""
    rows = docs.select(*others, text_of().alias("_bag_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("buckets")
        for batch in batches:
            found = [word_buckets(t).tobytes() for t in each_text(batch.column(len(others)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=[*others, "words"])

    return materialise(rows.mapInArrow(run, rows.drop("_bag_text").schema.add("words", "binary")), "bags")


def held_out() -> Column:
    """Rows whose label is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def summed(rows: DataFrame, size: int, vector: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of the batches' vectors of that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += vector(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "v"])

    found = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[found["k"].to_numpy()] = found["v"].to_numpy()
    return out


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's numbers one after the other, and the row of each."""
    parts = column.to_pylist()
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), np.repeat(np.arange(len(parts)), [len(x) // width for x in parts])


def frequencies(bag: DataFrame, wanted: np.ndarray | None = None) -> np.ndarray:
    """How many bags hold each bucket; only the wanted ones, where given (a boolean for each bucket)."""

    def vector(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(1 << BITS)
        for at in range(0, batch.num_rows, 1024):
            n = np.bincount(flat(batch.column(0).slice(at, 1024), np.int32)[0], minlength=1 << BITS)
            out += n if wanted is None else np.where(wanted, n, 0)
        return out

    return summed(bag.select("words"), 1 << BITS, vector)


def telling(p: np.ndarray, a: float, u: np.ndarray, b: float, features: int, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The buckets, sorted, whose shares of a and of b texts differ most, in standard errors, and for each a scale: the
    square of these errors' share of the largest. A feature's value is its scale, so that a penalty on weights holds back
    what may be chance, and all the rest is used."""
    a, b = max(a, 1), max(b, 1)
    pooled = (p + u + 1) / (a + b + 2)
    z = np.abs((p / a - u / b) / np.sqrt(pooled * (1 - pooled) * (1 / a + 1 / b)))
    z[p + u < least] = 0
    best = np.argsort(-z, kind="stable")[:features]
    best = np.sort(best[z[best] > 0])
    return best.astype(np.int32), (z[best] / max(z.max(), 1e-9)) ** 2


def places(found: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The places among the features (sorted buckets) that a bag holds."""
    at = np.searchsorted(buckets, found)
    at[at == len(buckets)] = 0
    return at[buckets[at] == found].astype(np.uint16) if len(buckets) else np.empty(0, np.uint16)


def reduced(bag: DataFrame, buckets: np.ndarray, name: str) -> DataFrame:
    """A written table of the bags' other columns and ``at``, their places among the features."""
    others = [c for c in bag.columns if c != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [places(np.frombuffer(x, np.int32), buckets).tobytes() for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at, pa.binary())], names=[*others, "at"])

    rows = bag.select(*others, "words")
    return materialise(rows.mapInArrow(run, rows.drop("words").schema.add("at", "binary")), name)


def logits(index: np.ndarray, row: np.ndarray, rows: int, w: np.ndarray) -> np.ndarray:
    """Of rows of places; the last weight is the bias."""
    return np.bincount(row, weights=w[index], minlength=rows) + w[-1]


def gradient(index: np.ndarray, row: np.ndarray, slope: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows' gradients, their slopes at the logit given; the bias last."""
    return np.r_[np.bincount(index, weights=slope[row], minlength=size), slope.sum()]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, calls: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with at most so many calls of value, which gives the value and its gradient. A step that does
    not lower the value enough, or leaves where it is defined (infinite), is shortened."""
    f, g = value(w)
    used, past = 1, []
    while used < calls and np.abs(g).max() > 1e-5:
        q, weights = g.copy(), []
        for s, y, r in reversed(past):
            weights.append(r * (s @ q))
            q -= weights[-1] * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, y, r), a in zip(past, reversed(weights)):
            q += s * (a - r * (y @ q))
        step, slope = 1.0, g @ q
        if slope <= 0:
            past.clear()
            continue
        while used < calls:
            near = w - step * q
            f2, g2 = value(near)
            used += 1
            if f2 <= f - 1e-4 * step * slope:
                s, y = near - w, g2 - g
                if s @ y > 1e-12:
                    past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
                w, f, g = near, f2, g2
                break
            step *= 0.3
            if step < 1e-3:
                return w
        else:
            return w
    return w
