"""Quality classification by co-training.

Two views of a document are classified apart: its content (hashed words and beginnings of words) and its page metadata
(source, language, length and the make-up of the page: shares of digits, capitals, punctuation, repeated and short
lines). Over some rounds each classifier labels those unlabelled texts that it is surest of, and the other one learns
from them. At the end both views are calibrated on labelled rows that neither has learnt from, and their log-odds are
averaged to score all documents.

The labelled rows are bounded by a parameter. The pool is every other text that may be learnt from: what a view passes
on is a pair of cuts of its logits, found from a histogram over the whole pool, and the gradients of what the other view
learns are summed over the pool's rows wherever they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import linear
from siltstone.llm.common import claim, discard, each_text, materialise, text_of
from siltstone.llm.linear import held_out, word_buckets

#: Labelled rows of the fit, at most; rounds; the share of the pool that a view passes on in each round more.
MAX_LABELLED, ROUNDS, PASSED_ON = 6_000, 3, 0.1
#: Passes over the pool in a round and at the end; weight of the pool beside the labelled rows; of the squared weights.
PASSES, LAST_PASSES, POOL_WEIGHT, DECAY = 6, 10, 0.3, 1e-3
#: Hashed one-hot places of source and language, and numeric parts of the metadata.
PLACES, NUMBERS = 256, 8
META = PLACES + NUMBERS
#: Buckets that are features of the content view.
FEATURES = 4_096
#: A view passes on texts of logits beyond this only; logits are counted in bins of this width.
SURE, BIN = 2.0, 0.01
BINS = round(60 / BIN) + 1


def metadata(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """The metadata view: one-hot places of source and language, then numbers between 0 and about 1."""
    x = np.zeros(META, np.float32)
    for name, value in (("lang", lang), ("source", source)):
        x[xxhash.xxh3_64_intdigest(f"{name}={value}") % PLACES] = 1
    n = max(len(text), 1)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(data, minlength=256)
    lines = text.split("\n")
    x[PLACES:] = (
        np.log2(n) / 20, kinds[48:58].sum() / n, kinds[65:91].sum() / n, (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / n,
        kinds[32] / n, 1 - len(set(lines)) / len(lines), sum(len(s) < 20 for s in lines) / len(lines), min(len(lines), 100) / 100,
    )
    return x


def packed_metadata(text: str, lang: str | None, source: str | None) -> bytes:
    """Its places that are not zero, and their values."""
    x = metadata(text, lang, source)
    at = np.flatnonzero(x)
    return np.array(list(zip(at, x[at])), [("k", "<u2"), ("v", "<f4")]).tobytes()


_META = np.dtype([("k", "<u2"), ("v", "<f4")])


def unpacked(column: pa.Array) -> np.ndarray:
    data, row = linear.flat(column, _META)
    x = np.zeros((len(column), META), np.float32)
    x[row, data["k"]] = data["v"]
    return x


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a view's logits into log-odds of the labels (one-dimensional logistic fit)."""
    a, b = 1.0, 0.0
    z = np.clip(z, -30, 30)
    for _ in range(50):
        p = linear.sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -2, 2))
    return max(a, 0.0), b


@dataclass(frozen=True)
class Model:
    """buckets: the content view's features. views: weights of content and metadata, the bias last, and their scales."""

    buckets: np.ndarray
    views: tuple[np.ndarray, np.ndarray]
    scales: tuple[tuple[float, float], tuple[float, float]]

    def logits(self, at: np.ndarray, row: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return linear.logits(at, row, len(meta), self.views[0]), meta @ self.views[1][:-1] + self.views[1][-1]

    def score(self, content: list[np.ndarray], meta: np.ndarray) -> np.ndarray:
        """Of bags and metadata."""
        found = [linear.places(x, self.buckets) for x in content]
        row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        z = self.logits(np.concatenate(found) if found else np.empty(0, np.uint16), row, meta)
        return linear.sigmoid(sum(a * x + b for x, (a, b) in zip(z, self.scales)) / 2)


def constant(logit: float) -> Model:
    flat = (np.array([logit]), np.r_[np.zeros(META), logit])
    return Model(np.empty(0, np.int32), flat, ((1.0, 0.0), (1.0, 0.0)))


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes half of 1."""
    return np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))


def cuts(counts: np.ndarray, share: float, passed_on: float) -> tuple[float, float, float, float]:
    """Below which logit a view calls a text bad, above which good, and how many texts of the pool these are. counts: the
    pool's histogram; share: of good ones among the labelled."""
    edges, below = np.arange(BINS) * BIN - 30, np.cumsum(counts)
    total = max(below[-1], 1)
    low = min(-SURE, float(edges[np.searchsorted(below, passed_on * (1 - share) * total)]))
    high = max(SURE, float(edges[min(np.searchsorted(below, (1 - passed_on * share) * total), BINS - 1)]))
    return low, high, float(counts[edges < low].sum()), float(counts[edges > high].sum())


def co_train(words: list[np.ndarray], meta: np.ndarray, y: np.ndarray, pool: DataFrame, buckets: np.ndarray, scale: np.ndarray, rounds: int = ROUNDS) -> Model:
    """words: places of features of the labelled rows, meta their metadata, y 0 or 1; pool: at, meta. Every fourth
    labelled row is kept for calibration."""
    aside, learnt = np.arange(len(y))[3::4], np.delete(np.arange(len(y)), np.s_[3::4])
    size = len(buckets) + 1
    scale = np.r_[scale, 1.0]
    of = lambda rows: (np.concatenate([words[i] for i in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(words[i]) for i in rows]))
    own, row = of(learnt)
    x, t = meta[learnt], y[learnt]
    weight, share = balanced(t), float(t.mean())

    def view_logits(v: np.ndarray, at: np.ndarray, rows: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return linear.logits(at, rows, len(m), v[:size] * scale), m @ v[size:-1] + v[-1]

    def slopes(at: np.ndarray, rows: np.ndarray, m: np.ndarray, s: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.r_[linear.gradient(at, rows, s[0], size - 1) * scale, m.T @ s[1], s[1].sum()]

    def loss(z: np.ndarray, target: np.ndarray, each: np.ndarray) -> tuple[float, np.ndarray]:
        return float(((linear.softplus(z) - target * z) * each).sum()), (linear.sigmoid(z) - target) * each

    def labelled(v: np.ndarray) -> tuple[float, np.ndarray]:
        both = [loss(z, t, weight) for z in view_logits(v, own, row, x)]
        plain = np.r_[v[: size - 1], 0, v[size:-1], 0]
        return sum(f for f, _ in both) + DECAY / 2 * (plain @ plain), slopes(own, row, x, tuple(s for _, s in both)) + DECAY * plain

    def taught(teacher: np.ndarray, limits: list[tuple[float, float, float, float]]):
        """Labelled rows, and the pool as the teacher's views label it for each other."""

        def value(v: np.ndarray) -> tuple[float, np.ndarray]:
            def vector(batch: pa.RecordBatch) -> np.ndarray:
                at, rows = linear.flat(batch.column(0), np.uint16)
                m = unpacked(batch.column(1))
                said, z = view_logits(teacher, at, rows, m), view_logits(v, at, rows, m)
                parts = []
                for k in (0, 1):
                    low, high, bad, good = limits[1 - k]
                    other = said[1 - k]
                    each = np.where(other > high, 0.5 / max(good, 1), 0.0) + np.where(other < low, 0.5 / max(bad, 1), 0.0)
                    parts.append(loss(z[k], (other > high).astype(float), each * POOL_WEIGHT))
                return np.r_[slopes(at, rows, m, tuple(s for _, s in parts)), sum(f for f, _ in parts)]

            f, g = labelled(v)
            more = linear.summed(pool.select("at", "meta"), len(v) + 1, vector)
            return f + more[-1], g + more[:-1]

        return value

    def histograms(v: np.ndarray) -> list[np.ndarray]:
        def vector(batch: pa.RecordBatch) -> np.ndarray:
            z = view_logits(v, *linear.flat(batch.column(0), np.uint16), unpacked(batch.column(1)))
            return np.concatenate([np.bincount(np.rint((np.clip(p, -30, 30) + 30) / BIN).astype(np.int64), minlength=BINS) for p in z])

        found = linear.summed(pool.select("at", "meta"), 2 * BINS, vector)
        return [found[:BINS], found[BINS:]]

    v = linear.minimise(labelled, np.zeros(size + META + 1), 200)
    for k in range(1, rounds + 1):
        limits = [cuts(n, share, PASSED_ON * k) for n in histograms(v)]
        v = linear.minimise(taught(v, limits), v, PASSES if k < rounds else LAST_PASSES)
    check = aside if len(np.unique(y[aside])) == 2 else learnt
    z = view_logits(v, *of(check), meta[check])
    return Model(buckets, (v[:size] * scale, v[size:]), tuple(calibrated(p, y[check]) for p in z))


COLUMNS = ["lang", "source"]


def viewed(docs: DataFrame) -> DataFrame:
    """doc_id, meta and words of every row, as a written table: whole texts are read once."""
    rows = docs.select("doc_id", *[F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS], text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("buckets")
        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [(packed_metadata(t, a, b), word_buckets(t).tobytes()) for t, a, b in zip(each_text(batch.column(3)), langs, sources)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for m, _ in found], pa.binary()), pa.array([w for _, w in found], pa.binary())], names=["doc_id", "meta", "words"])

    return materialise(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, meta binary, words binary"), "quality-views")


def train(views: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on the labelled rows that come first by a hash of their ids, and on all texts, none of them held out. Repeated
    labels of an id count as good if any does, repeated rows of a labelled id once."""
    own = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("y"))
    # ids alone are put in order; the bound holds for what is broadcast too
    first = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = views.filter("doc_id is not null").filter(~held_out())
    known = rows.join(first, "doc_id")
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return constant(30.0 if 1 in count else -30.0 if 0 in count else 0.0)
    bad, good = (linear.frequencies(known.filter(F.col("y") == k)) for k in (0, 1))
    buckets, scale = linear.telling(bad, count[0], good, count[1], FEATURES)
    places = linear.reduced(rows, buckets, "quality-places")
    found = places.join(first, "doc_id").groupBy("doc_id").agg(F.min(F.struct("at", "meta")).alias("x"), F.max("y").alias("y")).collect()
    found.sort(key=lambda r: r["doc_id"])
    meta = unpacked(pa.array([bytes(r["x"]["meta"]) for r in found], pa.binary()))
    pool = places.join(first, "doc_id", "left_anti")
    model = co_train([np.frombuffer(r["x"]["at"], np.uint16) for r in found], meta, np.array([r["y"] for r in found], np.int64), pool, buckets, np.sqrt(scale))
    discard(places)
    return model


def quality(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: better), predicted (1 where score >= 0.5).

    Null texts count as empty, null or missing lang and source are a value of their own. Rows without an id are scored
    and not held out. Labels that are null, repeated or of unknown ids are no error; with labels of one value alone all
    texts score near it, with none 0.5. Repeated rows get equal scores; a score of just 0.5 is predicted 1. An empty
    table gives no rows. Columns other than doc_id, text, lang and source are not read.
    """
    views = viewed(docs)
    model = train(views, labels, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores.append(model.score([np.frombuffer(x, np.int32) for x in part.column(2).to_pylist()], unpacked(part.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    scored = views.mapInArrow(run, f"doc_id {views.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
