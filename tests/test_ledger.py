import pytest
from pyspark.sql import functions as F

from siltstone.operators import ledger as L

SCHEMA = "model_id string, strategy string, rag_enabled boolean, track string, sample_id string, repeat_index int, parsed_answer string, correct boolean, latency_ms double, error string, rag_context_used int, partial_match int"


@pytest.fixture(scope="module")
def runs(spark):
    rows = []
    for i in range(12):
        for rag in (True, False):
            for rep in (0, 1):
                for m in ("m1", "m2"):
                    right = (i + rep * rag + (m == "m2")) % 3 != 0 or rag
                    rows.append((m, "ZS", rag, "mcq", f"s{i}", rep, "ABC"[(i + rep) % 3], right, 10.0 * i, "timeout" if i == 11 else None, int(rag), 0))
    rows.append(("m3", "ZS", True, "mcq", "s0", 0, "A", True, 1.0, "failed", 0, 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_summary(runs):
    rows = {(r["model_id"], r["rag_mode"]): r for r in L.summary(runs).collect()}
    assert ("m3", "rag") not in rows and rows["m1", "rag"]["n"] == 22 and rows["m1", "rag"]["error_rate"] == pytest.approx(2 / 24)
    assert rows["m1", "rag"]["accuracy"] == 1.0 and rows["m1", "no_rag"]["n_ctx_used"] is None and rows["m1", "rag"]["n_ctx_used"] == 22


def test_lift(spark, runs):
    out = {r["model_id"]: r for r in L.rag_lift(runs).collect()}
    assert out["m1"]["n"] == 22 and out["m1"]["delta"] > 0 and out["m1"]["ci_low"] <= out["m1"]["delta"] <= out["m1"]["ci_high"] and out["m1"]["only_no_rag"] == 0


def test_kappa(spark):
    agree = spark.createDataFrame([("A", "A", 2), ("B", "B", 2), ("C", "C", 1)], "a string, b string, n int").withColumn("g", F.lit(1))
    assert L.cohen_kappa(agree, ("g",), "a", "b").first()["cohen_kappa"] == 1.0
    flat = spark.createDataFrame([("A", "A", 5)], "a string, b string, n int").withColumn("g", F.lit(1))
    assert L.cohen_kappa(flat, ("g",), "a", "b").first()["cohen_kappa"] == 0.0
    cells = spark.createDataFrame([("A", "B", 4), ("B", "A", 1), ("A", "A", 3)], "a string, b string, n int").withColumn("g", F.lit(1))
    got = L.bowker(cells, ("g",), "a", "b").first()
    assert got["bowker_statistic"] == pytest.approx(9 / 5) and got["df"] == 1
    assert L.bowker(flat, ("g",), "a", "b").first()["df"] == 0


def test_raters(runs):
    assert {(r["model_a"], r["model_b"]) for r in L.inter_rater(runs).collect()} == {("m1", "m2")}
    assert all(-1 <= r["fleiss_kappa"] <= 1 and r["raters"] == 2 for r in L.intra_rater(runs).collect())


def test_holm(spark):
    tests = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.2), ("d", 0.04)], "name string, pvalue double")
    assert {r["name"]: r["significant_holm"] for r in L.holm(tests).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_vote_and_wilson(spark):
    votes = spark.createDataFrame([(1, 0, "B", "x"), (1, 1, "A", "y"), (1, 2, "A", "z"), (2, 0, "C", "u"), (2, 1, "D", "v")], "s int, pass int, answer string, response_text string")
    got = {r["s"]: (r["answer"], r["response_text"]) for r in L.majority_vote(votes, ("s",)).collect()}
    assert got == {1: ("A", "y"), 2: ("C", "u")}
    row = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int").select(*L.wilson(F.col("k"), F.col("n"))).collect()
    assert row[0]["ci_low"] == pytest.approx(0.4901625) and row[0]["ci_high"] == pytest.approx(0.9433178) and row[1]["p_hat"] == 0.0


def test_latest_and_grid(spark, runs):
    twice = runs.withColumn("at", F.lit(1)).unionByName(runs.withColumn("at", F.lit(2)).withColumn("parsed_answer", F.lit("Z")))
    assert L.latest(twice, "at").filter("parsed_answer <> 'Z'").count() == 0
    models = spark.createDataFrame([("m1", True), ("m2", False)], "model_id string, enabled boolean")
    conditions = spark.createDataFrame([("ZS", True), ("ZS", False)], "strategy string, rag_enabled boolean")
    assert L.grid(spark.createDataFrame([(1,), (2,)], "sample_id int"), conditions, models, 3).count() == 12


def test_bootstrap(spark):
    """Graded differences are resampled as they are; the interval is that of drawing pairs."""
    import numpy as np

    from siltstone.functions.stats import bootstrap_ci

    rng = np.random.default_rng(1)
    a, b = rng.random(200).round(2), rng.random(200).round(2)
    pairs = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, b)] + [("h", 0.75, 0.5)] * 9 + [("h", None, 1.0)], "g string, a double, b double")
    got = {r["g"]: (r["ci_low"], r["ci_high"]) for r in bootstrap_ci(pairs, ("g",), "a", "b", 4000).collect()}
    means = np.sort([(a - b)[rng.integers(0, 200, 200)].mean() for _ in range(4000)])
    assert got["g"] == pytest.approx((means[100], means[3899]), abs=0.01) and got["h"] == pytest.approx((0.25, 0.25))
    small = spark.createDataFrame([("g", 0.8, 0.7), ("g", 0.7, 0.6), ("g", 0.9, 0.85), ("g", 0.6, 0.5)], "g string, a double, b double")
    row = bootstrap_ci(small, ("g",), "a", "b", 200, 1).first()
    assert 0.05 <= row["ci_low"] <= 0.0875 <= row["ci_high"] <= 0.1 + 1e-12


def test_rollup_of_no_runs(spark, runs):
    """All runs failed: SQL's rollup still has its row over all, 0 / 0 being no number."""
    (row,) = L.rollup_summary(runs.withColumn("error", F.lit("timeout"))).collect()
    assert (row["model_id"], row["strategy"], row["n"]) == ("all", "all", 0) and row["accuracy"] != row["accuracy"]
    rows = {(r["model_id"], r["strategy"]): r["n"] for r in L.rollup_summary(runs).collect()}
    assert rows == {("all", "all"): 88, ("m1", "all"): 44, ("m1", "ZS"): 44, ("m2", "all"): 44, ("m2", "ZS"): 44}
