"""Queries over a run ledger that is derived from the line items by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import ledger as L

CELL = ["model_id", "strategy", "rag_enabled", "sample_no", "repeat_index"]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (model, strategy, rag, sample, repeat); line items of the same cell are reduced by minima."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")).alias("model_id"), F.element_at(F.array(*map(F.lit, ("ZS", "FEW_SHOT", "COT"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("strategy"),
        (F.col("l_orderkey") % 2 == 1).alias("rag_enabled"), (F.col("l_partkey") % 124).alias("sample_no"), (F.floor("l_quantity").cast("int") % 3).alias("repeat_index"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 10).alias("r"), F.floor("l_extendedprice").cast("long").alias("latency"),
        ((F.col("l_partkey") + F.col("l_suppkey") * 5 + F.col("l_linenumber")) % 97).alias("e"), ((F.col("l_orderkey") + F.col("l_partkey")) % 11).alias("u"), ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % 4).alias("a"),
    )
    rows = rows.groupBy(*CELL).agg(*[F.min(c).alias(c) for c in ("r", "latency", "e", "u")], F.max("a").alias("a"))
    choice = F.col("sample_no") < 100
    return rows.select(
        "model_id", "strategy", "rag_enabled", F.concat(F.lit("s"), F.col("sample_no").cast("string")).alias("sample_id"), "repeat_index", F.when(choice, "mcq").otherwise("open_ended").alias("track"),
        F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("a") + 1).cast("int")).alias("parsed_answer"), (F.col("r") < 7).alias("correct"), F.col("latency").alias("latency_ms"), F.when(F.col("e") == 0, "timeout").alias("error"),
        (F.col("rag_enabled") & (F.col("u") % 3 > 0)).cast("int").alias("rag_context_used"), (F.col("r") == 7).cast("int").alias("partial_match"), F.col("r").alias("f1_tenths"), F.when(F.col("u") < 6, F.col("u") % 2).alias("cites_gold"),
    )


LEDGER = """WITH cells AS (
  SELECT 'm' || (l_suppkey % 5) AS model_id, (['ZS', 'FEW_SHOT', 'COT'])[CAST(l_linenumber % 3 + 1 AS INT)] AS strategy, l_orderkey % 2 = 1 AS rag_enabled, l_partkey % 124 AS sample_no, CAST(floor(l_quantity) AS INT) % 3 AS repeat_index,
    min((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 10) AS r, min(CAST(floor(l_extendedprice) AS BIGINT)) AS latency, min((l_partkey + l_suppkey * 5 + l_linenumber) % 97) AS e, min((l_orderkey + l_partkey) % 11) AS u, max((l_partkey * 3 + l_suppkey) % 4) AS a
  FROM lineitem GROUP BY ALL
), ledger AS (
  SELECT model_id, strategy, rag_enabled, 's' || sample_no AS sample_id, repeat_index, CASE WHEN sample_no < 100 THEN 'mcq' ELSE 'open_ended' END AS track, (['A', 'B', 'C', 'D'])[CAST(a + 1 AS INT)] AS parsed_answer, r < 7 AS correct, latency AS latency_ms,
    CASE WHEN e = 0 THEN 'timeout' END AS error, CAST(rag_enabled AND u % 3 > 0 AS INT) AS rag_context_used, CAST(r = 7 AS INT) AS partial_match, r AS f1_tenths, CASE WHEN u < 6 THEN u % 2 END AS cites_gold
  FROM cells
), mcq AS (SELECT * FROM ledger WHERE error IS NULL AND track = 'mcq')
"""
ACCURACY = "SELECT model_id, strategy, rag_enabled, track, count(*) AS n, count(*) FILTER (WHERE correct) / count(*) AS accuracy FROM mcq GROUP BY ALL"
PAIRS = """pairs AS (
  SELECT model_id, strategy, sample_id, repeat_index, max(CAST(correct AS INT)) FILTER (WHERE rag_enabled) AS rag, max(CAST(correct AS INT)) FILTER (WHERE NOT rag_enabled) AS no_rag
  FROM mcq GROUP BY ALL HAVING rag IS NOT NULL AND no_rag IS NOT NULL)
"""
CONFUSION = """confusion AS (
  SELECT a.strategy, a.rag_enabled, a.model_id AS model_a, b.model_id AS model_b, a.parsed_answer AS answer_a, b.parsed_answer AS answer_b, count(*) AS n
  FROM mcq a JOIN mcq b ON a.strategy = b.strategy AND a.rag_enabled = b.rag_enabled AND a.sample_id = b.sample_id AND a.model_id < b.model_id
  WHERE a.repeat_index = 0 AND b.repeat_index = 0 GROUP BY ALL)
"""

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(LEDGER + """SELECT model_id, strategy, CASE WHEN rag_enabled THEN 'rag' ELSE 'no_rag' END AS rag_mode, track, count(*) FILTER (WHERE ok) AS n, avg(latency_ms) FILTER (WHERE ok) AS latency_ms_mean,
  count(*) FILTER (WHERE NOT ok) / count(*) AS error_rate, count(*) FILTER (WHERE ok AND used) / count(*) FILTER (WHERE ok) AS rag_context_used_rate,
  CASE WHEN bool_or(rag_enabled) THEN count(*) FILTER (WHERE ok AND used) END AS n_ctx_used, CASE WHEN bool_or(rag_enabled) THEN count(*) FILTER (WHERE ok AND NOT used) END AS n_ctx_not_used,
  avg(CAST(correct AS INT)) FILTER (WHERE ok AND track = 'mcq') AS accuracy, avg(partial_match) FILTER (WHERE ok AND track = 'mcq') AS partial_rate,
  avg(CAST(correct AS INT)) FILTER (WHERE ok AND track = 'mcq' AND rag_enabled AND used) AS accuracy_ctx_used, avg(CAST(correct AS INT)) FILTER (WHERE ok AND track = 'mcq' AND rag_enabled AND NOT used) AS accuracy_ctx_not_used,
  avg(f1_tenths) FILTER (WHERE ok AND track <> 'mcq') AS f1_tenths_mean, avg(f1_tenths) FILTER (WHERE ok AND track <> 'mcq' AND rag_enabled AND used) AS f1_tenths_mean_ctx_used, avg(cites_gold) FILTER (WHERE ok AND track <> 'mcq') AS cites_gold_rate
FROM (SELECT *, error IS NULL AS ok, rag_context_used > 0 AS used FROM ledger) GROUP BY model_id, strategy, rag_enabled, track HAVING count(*) FILTER (WHERE ok) > 0""")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.summary(ledger(spark, sf_dir), ("f1_tenths",), ("cites_gold",))


@query(LEDGER + ACCURACY)
def ledger_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.accuracy(ledger(spark, sf_dir))


@query(LEDGER + "SELECT coalesce(model_id, 'all') AS model_id, coalesce(strategy, 'all') AS strategy, count(*) AS n, count(*) FILTER (WHERE correct) / count(*) AS accuracy FROM mcq GROUP BY ROLLUP (model_id, strategy)")
def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rollup_summary(ledger(spark, sf_dir))


@query(LEDGER + ", " + PAIRS + "SELECT * FROM pairs")
def rag_lift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lift_pairs(ledger(spark, sf_dir))


LIFT = """lift AS (SELECT model_id, strategy, count(*) AS n, avg(rag) AS rag_accuracy, avg(no_rag) AS no_rag_accuracy, sum(rag - no_rag) / count(*) AS delta, count(*) FILTER (WHERE rag = 0 AND no_rag = 1) AS only_no_rag,
  count(*) FILTER (WHERE rag = 1 AND no_rag = 0) AS only_rag, CAST(count(*) * sum((rag - no_rag) * (rag - no_rag)) - sum(rag - no_rag) * sum(rag - no_rag) AS DOUBLE) AS spread FROM pairs GROUP BY ALL)
"""


@query(LEDGER + ", " + PAIRS + ", " + LIFT + "SELECT model_id, strategy, n, rag_accuracy, no_rag_accuracy, delta, only_no_rag, only_rag, CASE WHEN n < 2 OR spread = 0 THEN 0.0 ELSE delta / sqrt(spread / (n * (n - 1))) END AS cohens_d FROM lift")
def cohen_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lift(L.lift_pairs(ledger(spark, sf_dir)))


@query(LEDGER + ", " + PAIRS + ", " + LIFT + """, t AS (SELECT model_id, strategy, least(only_rag, only_no_rag) / (only_rag + only_no_rag + 1) / 4 AS pvalue FROM lift),
 s AS (SELECT *, CAST(pvalue <= 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY pvalue, model_id, strategy) + 1) AS INT) AS passed FROM t)
SELECT model_id, strategy, pvalue, min(passed) OVER (ORDER BY pvalue, model_id, strategy ROWS UNBOUNDED PRECEDING) = 1 AS significant_holm FROM s""")
def holm_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = L.lift(L.lift_pairs(ledger(spark, sf_dir)))
    p = F.least("only_rag", "only_no_rag") / (F.col("only_rag") + F.col("only_no_rag") + 1) / 4
    return L.holm(table.select("model_id", "strategy", p.alias("pvalue")), order=("model_id", "strategy"))


@query()
def rag_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rag_lift(ledger(spark, sf_dir))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.functions.stats import bootstrap_ci as ci

    return ci(L.lift_pairs(ledger(spark, sf_dir)), ("model_id", "strategy"), "rag", "no_rag")


@query()
def bootstrap_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.functions.stats import bootstrap_replayed as ci

    return ci(L.lift_pairs(ledger(spark, sf_dir)), ("model_id", "strategy"), "rag", "no_rag", ("sample_id", "repeat_index"))


@query()
def inter_rater(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.inter_rater(ledger(spark, sf_dir))


@query(LEDGER + ", " + CONFUSION + """, t AS (SELECT strategy, rag_enabled, model_a, model_b, sum(n) AS n, sum(CASE WHEN answer_a = answer_b THEN n ELSE 0 END) AS agreed FROM confusion GROUP BY ALL),
 a AS (SELECT strategy, rag_enabled, model_a, model_b, answer_a AS label, sum(n) AS na FROM confusion GROUP BY ALL), b AS (SELECT strategy, rag_enabled, model_a, model_b, answer_b AS label, sum(n) AS nb FROM confusion GROUP BY ALL),
 e AS (SELECT strategy, rag_enabled, model_a, model_b, sum(na * nb) AS pe FROM a JOIN b USING (strategy, rag_enabled, model_a, model_b, label) GROUP BY ALL)
SELECT strategy, rag_enabled, model_a, model_b, CAST(n AS BIGINT) AS n, CASE WHEN n * n = coalesce(pe, 0) THEN 0.0 ELSE CAST(agreed * n - coalesce(pe, 0) AS DOUBLE) / CAST(n * n - coalesce(pe, 0) AS DOUBLE) END AS cohen_kappa FROM t LEFT JOIN e USING (strategy, rag_enabled, model_a, model_b)""")
def inter_rater_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cohen_kappa(L.rater_pairs(ledger(spark, sf_dir)), L.PAIR, "answer_a", "answer_b")


@query(LEDGER + ", " + CONFUSION + """, c AS (SELECT strategy, rag_enabled, model_a, model_b, least(answer_a, answer_b) AS lo, greatest(answer_a, answer_b) AS hi, sum(CASE WHEN answer_a < answer_b THEN n ELSE -n END) AS d, sum(n) AS t FROM confusion WHERE answer_a <> answer_b GROUP BY ALL)
SELECT strategy, rag_enabled, model_a, model_b, CAST(floor(coalesce(sum(CAST(d * d AS DOUBLE) / CAST(t AS DOUBLE)), 0) * 1e6 + 0.5) AS BIGINT) AS statistic_millionths, count(d) AS df
FROM (SELECT DISTINCT strategy, rag_enabled, model_a, model_b FROM confusion) LEFT JOIN c USING (strategy, rag_enabled, model_a, model_b) GROUP BY ALL""")
def bowker_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.bowker(L.rater_pairs(ledger(spark, sf_dir)), L.PAIR, "answer_a", "answer_b")
    return out.select(*L.PAIR, F.floor(F.col("bowker_statistic") * 1e6 + 0.5).cast("long").alias("statistic_millionths"), "df")


@query(LEDGER + """, c AS (SELECT model_id, strategy, rag_enabled, sample_id, parsed_answer, count(*) AS m FROM mcq GROUP BY ALL),
 i AS (SELECT model_id, strategy, rag_enabled, sample_id, sum(m) AS r, sum(m * m) AS s2 FROM c GROUP BY ALL HAVING r >= 2),
 y AS (SELECT model_id, strategy, rag_enabled, r, count(*) AS items, sum(s2) AS s2 FROM i GROUP BY ALL), z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY model_id, strategy, rag_enabled ORDER BY items DESC, r) = 1),
 k AS (SELECT model_id, strategy, rag_enabled, r, parsed_answer, sum(m) AS c FROM c JOIN i USING (model_id, strategy, rag_enabled, sample_id) GROUP BY ALL),
 e AS (SELECT model_id, strategy, rag_enabled, r, sum(c * c) AS c2 FROM k GROUP BY ALL),
 p AS (SELECT model_id, strategy, rag_enabled, items, r, CAST(s2 - items * r AS DOUBLE) / CAST(items * r * (r - 1) AS DOUBLE) AS p, CAST(c2 AS DOUBLE) / CAST(items * r * items * r AS DOUBLE) AS e FROM z JOIN e USING (model_id, strategy, rag_enabled, r))
SELECT model_id, strategy, rag_enabled, items, CAST(r AS BIGINT) AS raters, CASE WHEN abs(1 - e) < 1e-9 THEN 0.0 ELSE (p - e) / (1 - e) END AS fleiss_kappa FROM p""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.intra_rater(ledger(spark, sf_dir))


@query(LEDGER + ", " + PAIRS + "SELECT model_id, strategy, count(*) AS n, count(*) FILTER (WHERE rag = 0 AND no_rag = 1) AS only_no_rag, count(*) FILTER (WHERE rag = 1 AND no_rag = 0) AS only_rag FROM pairs GROUP BY ALL")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lift(L.lift_pairs(ledger(spark, sf_dir))).select("model_id", "strategy", "n", "only_no_rag", "only_rag")


@query(LEDGER + """, k AS (SELECT model_id, strategy, rag_enabled, count(*) FILTER (WHERE correct) AS k, count(*) AS n, 1.959963984540054 AS z FROM mcq GROUP BY ALL),
 d AS (SELECT *, CAST(k AS DOUBLE) / CAST(n AS DOUBLE) AS p, CAST(n AS DOUBLE) AS m, CAST(z AS DOUBLE) * CAST(z AS DOUBLE) AS z2 FROM k),
 h AS (SELECT *, (p + z2 / (2 * m)) / (1 + z2 / m) AS center, (CAST(z AS DOUBLE) * sqrt((p * (1 - p) + z2 / (4 * m)) / m)) / (1 + z2 / m) AS half FROM d)
SELECT model_id, strategy, rag_enabled, k, n, p AS p_hat, greatest(0.0, center - half) AS ci_low, least(1.0, center + half) AS ci_high FROM h""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.valid(ledger(spark, sf_dir)).filter("track = 'mcq'").groupBy(*L.CONDITION).agg(F.count_if("correct").alias("k"), F.count("*").alias("n"))
    return rows.select(*L.CONDITION, "k", "n", *L.wilson(F.col("k"), F.col("n")))


@query(LEDGER + """, c AS (SELECT model_id, strategy, rag_enabled, sample_id, parsed_answer AS answer, count(*) AS votes, min(repeat_index) AS seen, arg_min(latency_ms, repeat_index) AS response_text FROM mcq GROUP BY ALL)
SELECT model_id, strategy, rag_enabled, sample_id, answer, votes, response_text FROM c QUALIFY row_number() OVER (PARTITION BY model_id, strategy, rag_enabled, sample_id ORDER BY votes DESC, seen) = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.valid(ledger(spark, sf_dir)).filter("track = 'mcq'").select(*L.CONDITION, "sample_id", F.col("parsed_answer").alias("answer"), "repeat_index", F.col("latency_ms").alias("response_text"))
    return L.majority_vote(rows, (*L.CONDITION, "sample_id"), order="repeat_index")


CONDITIONS = [f"{s}_{r}" for s in ("ZS", "FEW_SHOT", "COT") for r in ("rag", "no_rag")]


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.accuracy(ledger(spark, sf_dir))


@query(LEDGER + ", t AS (" + ACCURACY + ") SELECT model_id, " + ", ".join(f"max(accuracy) FILTER (WHERE strategy = '{c.split('_no_rag')[0] if c.endswith('no_rag') else c[:-4]}' AND {'NOT ' if c.endswith('no_rag') else ''}rag_enabled) AS {c}" for c in CONDITIONS) + " FROM t GROUP BY model_id")
def pivot_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir).withColumn("condition", F.concat_ws("_", "strategy", F.when(F.col("rag_enabled"), "rag").otherwise("no_rag")))
    return L.pivot_conditions(table, "accuracy", CONDITIONS)


@query(LEDGER + ", t AS (" + ACCURACY + "), s AS (SELECT model_id, strategy, max(accuracy) FILTER (WHERE rag_enabled) AS rag, max(accuracy) FILTER (WHERE NOT rag_enabled) AS no_rag FROM t GROUP BY ALL) SELECT *, rag - no_rag AS lift, CASE WHEN no_rag > 0 THEN (rag - no_rag) / no_rag * 100 END AS lift_pct FROM s WHERE rag IS NOT NULL AND no_rag IS NOT NULL")
def lift_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lift_by_strategy(_table(spark, sf_dir))


@query(LEDGER + ", t AS (" + ACCURACY + ") SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY accuracy DESC, strategy, rag_enabled) = 1")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.leaderboard(_table(spark, sf_dir))


@query(LEDGER + ", t AS (" + ACCURACY + "), l AS (SELECT model_id, strategy, rag_enabled, avg(latency_ms) AS latency FROM mcq GROUP BY ALL) SELECT strategy, floor(avg(accuracy) * 1e9 + 0.5)::BIGINT AS mean_billionths, floor(max(accuracy) * 1e9 + 0.5)::BIGINT AS max_billionths, floor(avg(latency) * 1e3 + 0.5)::BIGINT AS latency_us FROM t JOIN l USING (model_id, strategy, rag_enabled) GROUP BY strategy")
def strategy_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = L.valid(ledger(spark, sf_dir)).filter("track = 'mcq'").groupBy(*L.CONDITION).agg(F.avg("latency_ms").alias("latency"))
    out = L.group_means(_table(spark, sf_dir).join(latency, list(L.CONDITION)), "strategy", latency="latency")
    whole = lambda c, n: F.floor(F.col(c) * n + 0.5).cast("long")
    return out.select("strategy", whole("accuracy_mean", 1e9).alias("mean_billionths"), whole("accuracy_max", 1e9).alias("max_billionths"), whole("latency_mean", 1e3).alias("latency_us"))


@query(LEDGER + "SELECT model_id, quantile_cont(latency_ms, 0.25) AS q1, quantile_cont(latency_ms, 0.5) AS median, quantile_cont(latency_ms, 0.75) AS q3, avg(latency_ms) AS mean FROM mcq GROUP BY ALL")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.spread(L.valid(ledger(spark, sf_dir)).filter("track = 'mcq'"), "model_id", "latency_ms")
    return out.select("model_id", *[F.get("quartiles", F.lit(k)).alias(n) for k, n in enumerate(("q1", "median", "q3"))], "mean")


@query(LEDGER + ", t AS (SELECT model_id, parsed_answer AS category, count(*) FILTER (WHERE correct) / count(*) AS accuracy FROM mcq GROUP BY ALL) SELECT m.model_id, c.category, coalesce(t.accuracy, 0.0) AS accuracy FROM (SELECT DISTINCT model_id FROM t) m CROSS JOIN (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS category) c LEFT JOIN t USING (model_id, category)")
def radar_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.valid(ledger(spark, sf_dir)).filter("track = 'mcq'")
    table = rows.groupBy("model_id", F.col("parsed_answer").alias("category")).agg(L.share(F.col("correct")).alias("accuracy"))
    categories = spark.createDataFrame([(c,) for c in "ABCDE"], "category string")
    return L.radar(table, table.select("model_id").distinct(), categories, "category", "accuracy").select("model_id", "category", "accuracy")


@query(LEDGER + ", t AS (" + ACCURACY + ") SELECT model_id, floor(avg(accuracy) * 1e9 + 0.5)::BIGINT AS accuracy_billionths, count(DISTINCT strategy) AS n_strategies FROM t GROUP BY ALL")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.model_means(_table(spark, sf_dir)).select("model_id", F.floor(F.col("accuracy_mean") * 1e9 + 0.5).cast("long").alias("accuracy_billionths"), "n_strategies")


@query(LEDGER + "SELECT model_id, strategy, rag_enabled, count(*) AS n, avg(f1_tenths) AS relevance_mean, avg(cites_gold) AS gold_mean, avg(CAST(f1_tenths >= 5 AS INT)) AS relevance_pass_rate, avg(CAST(cites_gold = 1 AS INT)) AS gold_pass_rate FROM ledger GROUP BY ALL")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select(*L.CONDITION, F.col("f1_tenths").alias("relevance_score"), (F.col("f1_tenths") >= 5).alias("relevance_pass"), F.col("cites_gold").alias("gold_score"), (F.col("cites_gold") == 1).alias("gold_pass"))
    return L.judge_summary(rows, L.CONDITION, ("relevance", "gold"))


@query("SELECT b.item_id, s.strategy, r.rag_enabled, m.model_id, k.repeat_index FROM benchmark b, (SELECT unnest(['ZS', 'COT']) AS strategy) s, (SELECT unnest([true, false]) AS rag_enabled) r, (SELECT unnest(['m1', 'm3']) AS model_id) m, (SELECT unnest([0, 1]) AS repeat_index) k")
def grid_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id")
    conditions = spark.createDataFrame([(s, r) for s in ("ZS", "COT") for r in (True, False)], "strategy string, rag_enabled boolean")
    models = spark.createDataFrame([("m1", True), ("m2", False), ("m3", True)], "model_id string, enabled boolean")
    return L.grid(samples, conditions, models, 2)


@query("""WITH l AS (SELECT * FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS agreed, sum(quality) AS q, sum(toxic) AS x FROM l)
SELECT n, CAST(agreed * n - (q * x + (n - q) * (n - x)) AS DOUBLE) / CAST(n * n - (q * x + (n - q) * (n - x)) AS DOUBLE) AS cohen_kappa FROM t""")
def label_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality is not null and toxic is not null")
    confusion = labels.groupBy("quality", "toxic").agg(F.count("*").alias("n")).withColumn("all", F.lit("labels"))
    return L.cohen_kappa(confusion, ("all",), "quality", "toxic").drop("all")
