"""What the classifiers minimise, against the estimators written out over dense rows, and their gradients against differences."""

import math

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import linear, quality, toxicity


def rows_of(rng, n, features, tell=0.0):
    """Places of features; a row tells by its first features more often."""
    out = []
    for _ in range(n):
        p = np.full(features, 0.25)
        p[: features // 4] += tell
        out.append(np.flatnonzero(rng.random(features) < p).astype(np.uint16))
    return out


def dense(rows, scale):
    x = np.zeros((len(rows), len(scale)))
    for k, r in enumerate(rows):
        x[k, r] = scale[r]
    return np.c_[x, np.ones(len(rows))]


def log1p_exp(z):
    return np.array([math.log1p(math.exp(-abs(x))) + max(x, 0.0) for x in z])


def differences(value, w, places, step=1e-5):
    out = []
    for k in places:
        up, down = w.copy(), w.copy()
        up[k] += step
        down[k] -= step
        out.append((value(up)[0] - value(down)[0]) / (2 * step))
    return np.array(out)


@pytest.fixture
def captured(monkeypatch):
    """The functions that a fit minimises, and where it starts."""
    seen, own = [], linear.minimise

    def minimise(value, w, calls, *rest):
        seen.append((value, w.copy()))
        return own(value, w, min(calls, 12), *rest)

    monkeypatch.setattr(linear, "minimise", minimise)
    return seen


@pytest.fixture(scope="module")
def unlabelled(spark):
    rng = np.random.default_rng(1)
    rows = rows_of(rng, 60, 16, 0.5) + rows_of(rng, 140, 16)
    return rows, spark.createDataFrame([(bytearray(r.tobytes()),) for r in rows], "at binary").repartition(3)


def test_risk_of_positive_and_unlabelled(unlabelled, captured):
    """prior * R_p(+) + R_u(-) - prior * R_p(-), infinite where the last two are below zero, and the squared weights."""
    rng = np.random.default_rng(2)
    rows, table = unlabelled
    positive, scale, prior, decay = rows_of(rng, 40, 16, 0.5), rng.random(16) + 0.2, 0.3, 1e-3
    model = toxicity.fit(positive, table, len(rows), np.arange(16, dtype=np.int32), scale, prior, 12, decay)
    value, start = captured[0]
    assert start[-1] == pytest.approx(math.log(prior / (1 - prior))) and not start[:-1].any()
    p, u = dense(positive, scale), dense(rows, scale)
    negative = lambda w: log1p_exp(u @ w).mean() - prior * log1p_exp(p @ w).mean()
    brute = lambda w: prior * log1p_exp(-(p @ w)).mean() + max(0.0, negative(w)) + decay / 2 * float(w[:-1] @ w[:-1])
    tried = 0
    for size in (0.0, 0.1, 0.5, 1.0):
        w = start + size * rng.normal(size=17)
        f, g = value(w)
        if negative(w) < 0:
            assert f == math.inf
            continue
        tried += 1
        assert f == pytest.approx(brute(w))
        assert g[[0, 5, 15, 16]] == pytest.approx(differences(value, w, [0, 5, 15, 16]), abs=1e-6)
    wall = start.copy()
    wall[-1] = 20.0  # all are called positive by far: positives alone account for less than the unlabelled
    wall[:-1] = 0
    assert tried >= 3 and value(wall)[0] == pytest.approx(brute(wall))
    inside = start.copy()
    inside[:4], inside[-1] = 30.0, -25.0  # positives are told by heart
    assert negative(inside) >= 0 or value(inside)[0] == math.inf
    # the fit's weights, before the cut moves the bias, lower the risk as far as plain descent does
    w = start.copy()
    for _ in range(3000):
        z_u, z_p = u @ w, p @ w
        slope = u.T @ (1 / (1 + np.exp(-z_u))) / len(u) - prior * p.mean(axis=0) + decay * np.r_[w[:-1], 0]
        near = w - 0.5 * slope
        if negative(near) < 0:
            break
        w = near
    fitted = np.r_[model.weights[:-1] / scale, w[-1]]
    best = min(brute(np.r_[fitted[:-1], b]) for b in np.linspace(-8, 8, 321))
    assert best <= brute(start) and best <= brute(w) + 0.02


def test_cut_of_least_risk():
    """Of all cuts of the logits, by trying each."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        z_p, z_u, prior = rng.normal(2, 1, 40), np.r_[rng.normal(2, 1, 30), rng.normal(-2, 1, 100)], 0.25
        count = lambda z: np.bincount(toxicity.binned(z), minlength=toxicity.BINS)
        cut = toxicity.threshold(count(z_p), count(z_u), prior)
        risk = lambda c: prior * (z_p < c).mean() + max(0.0, (z_u >= c).mean() - prior * (z_p >= c).mean())
        least = min(risk(c) for c in np.arange(-8, 8, 0.01))
        assert risk(cut) <= least + 0.002 + 0.03  # a bin holds what lies within half its width


def test_loss_of_two_views(spark, captured):
    """Both views' balanced losses over the labelled rows, and then what each takes from the other's sure labels."""
    rng = np.random.default_rng(4)
    y = (rng.random(120) < 0.7).astype(np.int64)
    words = [rows_of(rng, 1, 16, 0.5 * (1 - k))[0] for k in y]
    meta = rng.normal(size=(120, quality.META)).astype(np.float32).astype(np.float64)
    meta[:, 0] += 2 * y
    pool_words, pool_meta = rows_of(rng, 100, 16, 0.25), rng.normal(size=(100, quality.META)).astype(np.float32)
    pool_meta[:, 0] += 2 * (np.arange(100) % 2)
    packed = lambda m: bytearray(np.array(list(enumerate(m)), quality._META).tobytes())
    stored = [packed(m) for m in pool_meta]
    seen_meta = pool_meta.astype(np.float64)
    pool = spark.createDataFrame([(bytearray(r.tobytes()), m) for r, m in zip(pool_words, stored)], "at binary, meta binary").repartition(2)
    scale = rng.random(16) + 0.3
    quality.co_train(words, meta, y, pool, np.arange(16, dtype=np.int32), scale, rounds=2)
    learnt = [k for k in range(120) if k % 4 != 3]
    x, m, t = dense([words[k] for k in learnt], np.ones(16)), meta[learnt], y[learnt]
    weight = np.where(t == 1, 0.5 / (t == 1).sum(), 0.5 / (t == 0).sum())
    split = lambda v: (np.r_[v[:16] * scale, v[16]], v[17:-1], v[-1])

    def labelled(v):
        a, b, c = split(v)
        plain = float(v[:16] @ v[:16] + v[17:-1] @ v[17:-1])
        return sum(float((weight * (log1p_exp(z) - t * z)).sum()) for z in (x @ a, m @ b + c)) + quality.DECAY / 2 * plain

    assert len(captured) == 3
    for size in (0.0, 0.3, 1.0):
        v = size * rng.normal(size=17 + quality.META + 1)
        f, g = captured[0][0](v)
        assert f == pytest.approx(labelled(v))
        places = [0, 7, 16, 17, len(v) - 1]
        assert g[places] == pytest.approx(differences(captured[0][0], v, places), abs=1e-6)
    # the second round: pseudo-labels come from the other view of the weights that it starts with
    value, teacher = captured[1]
    q = dense(pool_words, np.ones(16))
    a, b, c = split(teacher)
    said = [q @ a, seen_meta @ b + c]
    share = float(t.mean())
    limits = []
    for z in said:
        bins = np.rint((np.clip(z, -30, 30) + 30) / quality.BIN).astype(np.int64)
        limits.append(quality.cuts(np.bincount(bins, minlength=quality.BINS).astype(float), share, quality.PASSED_ON))
    for size in (0.0, 0.5):
        v = teacher + size * rng.normal(size=len(teacher))
        a, b, c = split(v)
        more = 0.0
        for k, z in enumerate((q @ a, seen_meta @ b + c)):
            low, high, bad, good = limits[1 - k]
            other = said[1 - k]
            each = np.where(other > high, 0.5 / max(good, 1), 0) + np.where(other < low, 0.5 / max(bad, 1), 0)
            more += quality.POOL_WEIGHT * float((each * (log1p_exp(z) - (other > high) * z)).sum())
        f, g = value(v)
        assert f == pytest.approx(labelled(v) + more) and more > 0
        places = [0, 7, 16, 17, len(v) - 1]
        assert g[places] == pytest.approx(differences(value, v, places), abs=1e-6)
    for low, high, bad, good in limits:
        assert low < 0 < high and bad + good > 0


def test_a_score_of_one_half_is_predicted(spark):
    """Neither has a word that tells: toxicity's bias and quality's logit of 0 are scores of one half, and so predicted 1."""
    model = toxicity.Model(np.empty(0, np.int32), np.zeros(1))
    assert model.score(np.array([1, 2], np.int32)) == 0.5
    docs, none = spark.createDataFrame([(1, "x", "en", "s")], "doc_id long, text string, lang string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r["score"], r["predicted"]) for r in quality.quality(docs, none).collect()] == [(0.5, 1)]
