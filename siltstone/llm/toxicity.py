"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all texts that may be learnt from, whatever they are, are the unlabelled ones. A
linear model over hashed words and beginnings of words is trained in numpy on the non-negative risk estimator

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

whose class prior corrects for the toxic texts among the unlabelled. With the logistic loss the part over the unlabelled
is a sum over their rows, so the fit takes all of them: each pass is a job whose tasks add up risk and gradient. Only the
positives, whose number a parameter bounds, are gathered on the driver, as places of features. Every whole text is
scored, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import linear
from siltstone.llm.common import claim, discard, each_text, text_of
from siltstone.llm.linear import held_out, word_buckets

#: Confirmed toxic texts of the fit, at most; the unlabelled have no bound.
MAX_POSITIVE = 4_000
#: Buckets that are features of the model; weight of the squared weights; passes over the unlabelled.
FEATURES, DECAY, PASSES = 4_096, 1e-3, 40
#: Logits are counted in bins of this width, between -30 and 30.
BIN = 0.01


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # the features, sorted
    weights: np.ndarray  # the bias last

    def score(self, found: np.ndarray) -> float:
        z = self.weights[linear.places(found, self.buckets)].sum() + self.weights[-1]
        return float(linear.sigmoid(z))


NOTHING = Model(np.empty(0, np.int32), np.array([-30.0]))


def fit(positive: list[np.ndarray], unlabelled: DataFrame, total: int, buckets: np.ndarray, scale: np.ndarray, prior: float, passes: int = PASSES, decay: float = DECAY) -> Model:
    """Minimises the risk from the positives' places among the features and the table of all others' (at).

    A step that would take the estimate of the negative part below zero is shortened: beyond that the model only learns
    the rows by heart. At the end the scores are cut where the prior-corrected risk of wrong decisions is least.
    """
    size, scale = len(buckets), np.r_[scale, 1.0]
    index, row = np.concatenate(positive).astype(np.int64), np.repeat(np.arange(len(positive)), [len(x) for x in positive])

    def sums(w: np.ndarray) -> np.ndarray:
        def vector(batch: pa.RecordBatch) -> np.ndarray:
            at, of = linear.flat(batch.column(0), np.uint16)
            z = linear.logits(at, of, batch.num_rows, w)
            return np.r_[linear.gradient(at, of, linear.sigmoid(z), size), linear.softplus(z).sum()]

        return linear.summed(unlabelled.select("at"), size + 2, vector) / total

    def risk(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = linear.logits(index, row, len(positive), w * scale)
        u = sums(w * scale)
        # logistic loss: l(z, +) = log(1 + e^-z), l(z, -) = log(1 + e^z); their difference is -z
        negative = u[-1] - prior * linear.softplus(z).mean()
        gradient = u[:-1] - prior * linear.gradient(index, row, np.full(len(positive), 1 / len(positive)), size)
        value = negative + prior * linear.softplus(-z).mean() + decay / 2 * (w[:-1] @ w[:-1])
        return (value if negative >= 0 else np.inf), gradient * scale + decay * np.r_[w[:-1], 0]

    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    w = linear.minimise(risk, w, passes) * scale

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        at, of = linear.flat(batch.column(0), np.uint16)
        return np.bincount(binned(linear.logits(at, of, batch.num_rows, w)), minlength=BINS)

    counts = linear.summed(unlabelled.select("at"), BINS, histogram)
    w[-1] -= threshold(np.bincount(binned(linear.logits(index, row, len(positive), w)), minlength=BINS), counts, prior)
    return Model(buckets, w)


BINS = round(60 / BIN) + 1


def binned(z: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(z, -30, 30) + 30) / BIN).astype(np.int64)


def threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut between bins of logits of the least non-negative risk of wrong decisions, and of such cuts the middle of
    the widest run.

    The logistic fit separates the classes but is unsure of texts with few telling words; the cut says where, by the
    class prior, the unlabelled texts above are no more than the positives account for.
    """
    above = lambda n: 1 - np.r_[0, np.cumsum(n)] / max(n.sum(), 1)  # noqa: E731  of each cut, below bin 0 to above the last
    found = above(positive)
    risk = prior * (1 - found) + np.maximum(0, above(unlabelled) - prior * found)
    good = np.flatnonzero(risk <= risk.min() + 0.002)
    runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
    run = max(runs, key=len)
    return float((run[0] + run[-1]) / 2 - 0.5) * BIN - 30


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, bag: DataFrame | None = None) -> Model:
    """Fits on the positives that come first by a hash of their ids and on all texts, none of them held out.

    The class prior is the share of toxic rows among the labels that may be learnt from. Repeated rows of a positive id
    count once among the positives. bag: as of linear.bags(), where it is there already.
    """
    own = labels.filter("toxic is not null and doc_id is not null").filter(~held_out())
    share = own.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return NOTHING
    prior = min(max(share, 0.001), 0.9)
    bag = (linear.bags(docs) if bag is None else bag).filter("doc_id is not null").filter(~held_out())
    # ids alone are put in order; the bound holds for what is broadcast too
    first = own.filter("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    known = bag.join(F.broadcast(first), "doc_id", "left_semi")
    p, total, known_n = linear.frequencies(known), bag.count(), known.count()
    if not known_n or not p.any():
        return NOTHING
    buckets, scale = linear.telling(np.where(p >= 2, p, 0), known_n, linear.frequencies(bag, p >= 2), total, FEATURES)
    if not len(buckets):
        return NOTHING
    rows = linear.reduced(bag, buckets, "toxicity-places")
    positive = rows.join(F.broadcast(first), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("at").alias("at")).collect()
    model = fit([np.frombuffer(r["at"], np.uint16) for r in sorted(positive)], rows, total, buckets, scale, prior)
    discard(rows)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``toxicity`` (double, 0 to 1) to the rows of docs. Null and empty texts get the score of a text without words."""
    others = [c for c in docs.columns if c != "toxicity"]
    rows = docs.select(*others, text_of().alias("_toxicity_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("buckets")
        for batch in batches:
            scores = [model.score(word_buckets(t)) for t in each_text(batch.column(len(others)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*others, "toxicity"])

    return rows.mapInArrow(run, rows.drop("_toxicity_text").schema.add("toxicity", "double"))


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 where score >= 0.5).

    Rows without an id are scored, not held out and not learnt from. Labels of unknown ids, null labels and repeated
    labels are no error; where no row is labelled toxic all scores are near 0. Repeated rows get equal scores; a score of
    just 0.5 is predicted 1. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    bag = linear.bags(docs)
    model = train(docs, labels, bag=bag, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(np.frombuffer(x, np.int32)) for x in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = bag.mapInArrow(run, f"doc_id {bag.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
