"""Registered queries that SQL does not express, against plain Python over the smallest tables."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest

from siltstone import queries as registered

FOLDER = "/root/testdata/sf0.001"


def rows_of(sql):
    return duckdb.sql(sql.replace("FROM documents", f"FROM '{FOLDER}/documents.parquet'")).fetchall()


def run(spark, name):
    return registered.queries()[name](spark, FOLDER).collect()


def test_embedded_documents(spark):
    stop = set("the a an is are was were be been being have has had do does did will would could should may might must and or but if then than that this to of in on at for with by from".split())
    got = {r["doc_id"]: r["embedding"] for r in run(spark, "embedded_documents")}
    for i, text in rows_of("SELECT doc_id, text FROM documents"):
        v = [0.0] * 64
        for word in re.findall(r"\w+", text.lower()):
            if word not in stop:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % 64] += 1 if h >= 2**63 else -1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert got[i] == pytest.approx([x / norm for x in v])


FORMS = (r"\s*\[([^\]]+?),?\s*(?:p\.?|page)\s*\d+\]", r"\s*\[([^\]]+?)\](?!\()", r"\s*\((?:Source:\s*)?([^)]+?),?\s*(?:p\.?|page)\s*\d+\)", r"\s*According to (?:the )?[^(]+?\s*\((?:p\.?|page)\s*\d+\)")


def test_citation_strip(spark):
    got = {r["doc_id"]: r for r in run(spark, "citation_strip")}
    for i, source, lang, text in rows_of("SELECT doc_id, source, lang, text FROM documents"):
        t = f"See [{source}_notes.md; Doc-{lang}] and (Source: {source}, p.{i % 90}). {text} According to the {lang} guide (page {i % 7}) [12; {source}]"
        removed = 0
        for form in FORMS:
            t, n = re.subn(form, "", t, flags=re.IGNORECASE | re.ASCII)
            removed += n
        t = re.sub(r"\s+([.,;:])", r"\1", re.sub(r"\s+", " ", t, flags=re.ASCII), flags=re.ASCII).strip(" ")
        assert (got[i]["n_chars_left"], got[i]["text_md5"], got[i]["removed"]) == (len(t), hashlib.md5(t.encode()).hexdigest(), removed)


def tail(x, df):
    """The upper tail of chi-square by Simpson's rule over its density, from 0."""
    if df <= 0 or x <= 0:
        return 1.0
    t = np.linspace(0, math.sqrt(x), 20_001)  # with u = t * t the density has no pole
    y = 2 * t ** (df - 1) * np.exp(-t * t / 2) / (2 ** (df / 2) * math.gamma(df / 2))
    return 1 - float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (t[1] - t[0]) / 3)


def ledger_rows(spark):
    from siltstone.queries.ledger_queries import ledger

    return [r.asDict() for r in ledger(spark, FOLDER).collect() if r["track"] == "mcq" and not r["error"]]


def test_inter_rater(spark):
    answers = {}
    for r in ledger_rows(spark):
        if r["repeat_index"] == 0:
            answers.setdefault((r["strategy"], r["rag_enabled"]), {}).setdefault(r["model_id"], {})[r["sample_id"]] = r["parsed_answer"] or "UNKNOWN"
    got = {(r["strategy"], r["rag_enabled"], r["model_a"], r["model_b"]): r for r in run(spark, "inter_rater")}
    seen = 0
    for (s, g), models in answers.items():
        for a in models:
            for b in (x for x in models if x > a):
                both = sorted(set(models[a]) & set(models[b]))
                if not both:
                    continue
                pairs, n, seen = [(models[a][k], models[b][k]) for k in both], len(both), seen + 1
                labels = sorted({x for p in pairs for x in p})
                agreed = sum(x == y for x, y in pairs) / n
                chance = sum(sum(x == k for x, _ in pairs) * sum(y == k for _, y in pairs) for k in labels) / n**2
                cells = {(x, y): (sum(p == (x, y) for p in pairs), sum(p == (y, x) for p in pairs)) for i, x in enumerate(labels) for y in labels[i + 1 :]}
                statistic, df = sum((u - v) ** 2 / (u + v) for u, v in cells.values() if u + v), sum(u + v > 0 for u, v in cells.values())
                r = got[s, g, a, b]
                assert r["cohen_kappa"] == pytest.approx(0.0 if chance == 1 else (agreed - chance) / (1 - chance))
                assert (r["bowker_statistic"], r["df"]) == (pytest.approx(statistic), df) and r["bowker_pvalue"] == pytest.approx(tail(statistic, df), abs=1e-7)
    assert seen == len(got) > 0


def test_rag_lift(spark):
    cells = {}
    for r in ledger_rows(spark):
        if r["strategy"] != "RAP":
            cells.setdefault((r["model_id"], r["strategy"]), {}).setdefault((r["sample_id"], r["repeat_index"]), {})[r["rag_enabled"]] = int(bool(r["correct"]))
    got = {(r["model_id"], r["strategy"]): r for r in run(spark, "rag_lift")}
    own = {(r["model_id"], r["strategy"]): r for r in run(spark, "bootstrap_ci")}
    want = {k: [(c[True], c[False]) for c in v.values() if len(c) == 2] for k, v in cells.items()}
    want = {k: v for k, v in want.items() if v}
    assert set(got) == set(own) == set(want)
    rng, tests = np.random.default_rng(3), {}
    for k, pairs in want.items():
        d = np.array([a - b for a, b in pairs])
        b, c = int((d == -1).sum()), int((d == 1).sum())
        p = min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0
        r = got[k]
        assert (r["n"], r["only_no_rag"], r["only_rag"]) == (len(d), b, c) and r["delta"] == pytest.approx(d.mean())
        assert r["cohens_d"] == pytest.approx(d.mean() / d.std(ddof=1) if len(d) > 1 and d.std() else 0.0)
        drawn = np.sort(d[rng.integers(0, len(d), (4000, len(d)))].mean(axis=1))
        for x in (r, own[k]):
            assert x["ci_low"] == pytest.approx(drawn[100], abs=0.03) and x["ci_high"] == pytest.approx(drawn[3899], abs=0.03)
        assert r["mcnemar_pvalue"] == pytest.approx(p)
        # the proxy says whether the interval holds zero
        tests[k] = r["pvalue"]
        assert r["pvalue"] == (0.01 if r["ci_low"] > 0 or r["ci_high"] < 0 else 0.5)
    step = sorted(tests, key=lambda k: (tests[k], k))
    passed = [all(tests[j] <= 0.05 / (len(step) - i) for i, j in enumerate(step[: at + 1])) for at in range(len(step))]
    assert {k: got[k]["significant_holm"] for k in step} == dict(zip(step, passed))


def test_bootstrap_replayed(spark):
    """Python's own generator, draw by draw."""
    import random

    cells = {}
    for r in ledger_rows(spark):
        if r["strategy"] != "RAP":
            cells.setdefault((r["model_id"], r["strategy"]), {}).setdefault((r["sample_id"], r["repeat_index"]), {})[r["rag_enabled"]] = int(bool(r["correct"]))
    want = {k: [c[True] - c[False] for _, c in sorted(v.items()) if len(c) == 2] for k, v in cells.items()}
    got = {(r["model_id"], r["strategy"]): r for r in run(spark, "bootstrap_replayed")}
    assert set(got) == {k for k, d in want.items() if d}
    for k in sorted(got)[:5]:
        random.seed(42)
        n = len(want[k])
        means = sorted(float(np.mean([float(want[k][random.randrange(n)]) for _ in range(n)])) for _ in range(5000))
        assert (got[k]["mean_delta"], got[k]["ci_low"], got[k]["ci_high"]) == (float(np.mean(want[k])), means[125], means[4874])


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_drawn_indices(n):
    import random

    from siltstone.functions.stats import drawn_indices

    random.seed(7)
    assert np.concatenate(list(drawn_indices(n, 30, 7))).ravel().tolist() == [random.randrange(n) for _ in range(30 * n)]
