"""Analysis of run ledgers: summaries, agreement between runs and models, and paired comparisons.

A ledger has a row per run: model_id, strategy, rag_enabled, track, sample_id, repeat_index, parsed_answer, correct,
latency_ms, error, and numeric metrics as columns. Rows of one (model, strategy, rag, sample, repeat) cell are meant to
be unique; latest() makes them so. Every operator aggregates before it joins, so only cells and groups are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONDITION = ("model_id", "strategy", "rag_enabled")
CELL = (*CONDITION, "sample_id", "repeat_index")


def valid(ledger: DataFrame) -> DataFrame:
    """Runs without an error."""
    return ledger.filter(F.coalesce(F.col("error"), F.lit("")) == "")


def latest(ledger: DataFrame, ordinal: str) -> DataFrame:
    """The last row of each cell by an ordinal column; later records overwrite earlier ones."""
    rest = [c for c in ledger.columns if c not in CELL]
    last = ledger.groupBy(*CELL).agg(F.max_by(F.struct(*rest), ordinal).alias("r"))
    return last.select(*CELL, "r.*")


def without_superseded(ledger: DataFrame) -> DataFrame:
    """Without the failed runs of cells that have one without an error; of other cells one failed run."""
    good = valid(ledger).select(*CELL).distinct()
    failed = ledger.filter(F.coalesce(F.col("error"), F.lit("")) != "")
    return valid(ledger).unionByName(failed.join(good, list(CELL), "left_anti").select(*ledger.columns).dropDuplicates(list(CELL)))


def mean_if(condition: Column, value: Column) -> Column:
    """Mean of value over the rows where condition holds, null where none does."""
    return F.avg(F.when(condition, value))


def share(condition: Column) -> Column:
    """The share of rows where condition holds; null counts as not."""
    return F.count_if(condition) / F.count(F.lit(1))


def summary(ledger: DataFrame, metrics: tuple[str, ...] = (), nullable_metrics: tuple[str, ...] = (), single_target: tuple[str, ...] = ()) -> DataFrame:
    """Per model, strategy, rag mode and track: runs without error, mean latency, error rate, use of context, and for
    choice questions accuracy and partial matches, for open ones the means of metrics (null counts as 0) and of
    nullable_metrics (nulls skipped). single_target: metrics that are also averaged over references of a single target,
    and over runs with retrieval that did not use its context. Groups without a run that is free of errors are left out
    (A01-A03)."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    used, rag, choice = F.coalesce(F.col("rag_context_used"), F.lit(0)) > 0, F.col("rag_enabled"), F.col("track") == "mcq"
    hit = F.coalesce(F.col("correct"), F.lit(False))
    n = F.count_if(ok)
    per = lambda c: F.count_if(ok & c) / n
    out = ledger.groupBy("model_id", "strategy", F.when(rag, "rag").otherwise("no_rag").alias("rag_mode"), "track").agg(
        n.alias("n"), mean_if(ok, F.col("latency_ms")).alias("latency_ms_mean"), (F.count_if(~ok) / F.count(F.lit(1))).alias("error_rate"),
        F.when(n > 0, per(used)).alias("rag_context_used_rate"), F.when(F.max(rag.cast("int")) == 1, F.count_if(ok & used)).alias("n_ctx_used"), F.when(F.max(rag.cast("int")) == 1, F.count_if(ok & ~used)).alias("n_ctx_not_used"),
        mean_if(ok & choice, hit.cast("int")).alias("accuracy"), mean_if(ok & choice, F.coalesce(F.col("partial_match"), F.lit(0))).alias("partial_rate"),
        mean_if(ok & choice & rag & used, hit.cast("int")).alias("accuracy_ctx_used"), mean_if(ok & choice & rag & ~used, hit.cast("int")).alias("accuracy_ctx_not_used"),
        *[mean_if(ok & ~choice, F.coalesce(F.col(m), F.lit(0))).alias(f"{m}_mean") for m in metrics],
        *[mean_if(ok & ~choice & rag & used, F.coalesce(F.col(m), F.lit(0))).alias(f"{m}_mean_ctx_used") for m in metrics],
        *[mean_if(ok & ~choice, F.col(m)).alias(f"{m}_rate") for m in nullable_metrics],
        *[mean_if(ok & ~choice & (F.coalesce(F.col("ref_is_single_target"), F.lit(0.0)) >= 0.5), F.coalesce(F.col(m), F.lit(0))).alias(f"{m}_mean_single_target") for m in single_target],
        *[mean_if(ok & ~choice & rag & ~used, F.coalesce(F.col(m), F.lit(0))).alias(f"{m}_mean_ctx_not_used") for m in single_target],
    )
    return out.filter("n > 0")


def accuracy(ledger: DataFrame) -> DataFrame:
    """Accuracy of choice questions per condition."""
    rows = valid(ledger).filter("track = 'mcq'")
    return rows.groupBy(*CONDITION, "track").agg(F.count("*").alias("n"), share(F.coalesce(F.col("correct"), F.lit(False))).alias("accuracy"))


def _answers(ledger: DataFrame) -> DataFrame:
    return valid(ledger).filter("track = 'mcq'").select(*CELL, F.coalesce(F.nullif(F.col("parsed_answer"), F.lit("")), F.lit("UNKNOWN")).alias("answer"))


def fleiss_kappa(ratings: DataFrame, by: tuple[str, ...], item: str, label: str) -> DataFrame:
    """Fleiss' kappa of each group over its items of the most frequent number of ratings (two at least); items with
    another number are left out, as the statistic needs equal ones. 0 where chance agreement is complete (A05)."""
    counts = ratings.groupBy(*by, item, label).agg(F.count("*").alias("m"))
    per_item = counts.groupBy(*by, item).agg(F.sum("m").alias("r"), F.sum(F.col("m") * F.col("m")).alias("s2")).filter("r >= 2")
    order = W.partitionBy(*by).orderBy(F.desc("items"), "r")
    sizes = per_item.groupBy(*by, "r").agg(F.count("*").alias("items"), F.sum("s2").alias("s2")).withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
    # column sums over the items that count
    columns = counts.join(per_item.select(*by, item, "r"), [*by, item]).groupBy(*by, "r", label).agg(F.sum("m").alias("c"))
    chance = columns.groupBy(*by, "r").agg(F.sum(F.col("c") * F.col("c")).alias("c2"))
    n, r = F.col("items"), F.col("r")
    p = (F.col("s2") - n * r).cast("double") / (n * r * (r - 1))
    e = F.col("c2").cast("double") / (n * r * n * r)
    return sizes.join(chance, [*by, "r"]).select(*by, F.col("items"), F.col("r").alias("raters"), F.when(F.abs(1 - e) < 1e-9, 0.0).otherwise((p - e) / (1 - e)).alias("fleiss_kappa"))


def intra_rater(ledger: DataFrame) -> DataFrame:
    """Agreement of repeated runs per condition."""
    return fleiss_kappa(_answers(ledger), CONDITION, "sample_id", "answer")


def rater_pairs(ledger: DataFrame, repeat_index: int = 0) -> DataFrame:
    """strategy, rag_enabled, model_a < model_b, answer_a, answer_b, n: the confusion counts of each pair of models on
    the samples that both answered (J05)."""
    one = _answers(ledger).filter(F.col("repeat_index") == repeat_index)
    side = lambda s: one.select("strategy", "rag_enabled", "sample_id", F.col("model_id").alias(f"model_{s}"), F.col("answer").alias(f"answer_{s}"))
    pairs = side("a").join(side("b"), ["strategy", "rag_enabled", "sample_id"]).filter("model_a < model_b")
    return pairs.groupBy("strategy", "rag_enabled", "model_a", "model_b", "answer_a", "answer_b").agg(F.count("*").alias("n"))


PAIR = ("strategy", "rag_enabled", "model_a", "model_b")


def cohen_kappa(confusion: DataFrame, by: tuple[str, ...], a: str, b: str, n: str = "n") -> DataFrame:
    """Cohen's kappa from confusion counts, in ratios of whole numbers; 0 where chance agreement is complete."""
    side = lambda c: confusion.groupBy(*by, F.col(c).alias("label")).agg(F.sum(n).alias(f"{c}_n"))
    chance = side(a).join(side(b), [*by, "label"]).groupBy(*by).agg(F.sum(F.col(f"{a}_n") * F.col(f"{b}_n")).alias("pe"))
    total = confusion.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col(n)).otherwise(0)).alias("agreed"))
    out = total.join(chance, list(by), "left").withColumn("pe", F.coalesce("pe", F.lit(0)))
    free = F.col("n") * F.col("n") - F.col("pe")
    return out.select(*by, F.col("n"), F.when(free == 0, 0.0).otherwise((F.col("agreed") * F.col("n") - F.col("pe")).cast("double") / free).alias("cohen_kappa"))


def bowker(confusion: DataFrame, by: tuple[str, ...], a: str, b: str, n: str = "n") -> DataFrame:
    """McNemar-Bowker statistic and its degrees of freedom: unlike answer pairs that occur."""
    low, high = F.least(a, b), F.greatest(a, b)
    cells = confusion.filter(F.col(a) != F.col(b)).groupBy(*by, low.alias("low"), high.alias("high")).agg(F.sum(F.when(F.col(a) == low, F.col(n)).otherwise(-F.col(n))).alias("d"), F.sum(n).alias("t"))
    found = cells.groupBy(*by).agg(F.sum((F.col("d") * F.col("d")) / F.col("t")).alias("bowker_statistic"), F.count("*").alias("df"))
    every = confusion.select(*by).distinct()
    return every.join(found, list(by), "left").select(*by, F.coalesce("bowker_statistic", F.lit(0.0)).alias("bowker_statistic"), F.coalesce("df", F.lit(0)).alias("df"))


def inter_rater(ledger: DataFrame, repeat_index: int = 0) -> DataFrame:
    """Kappa, Bowker statistic and its p-value for each pair of models under one condition."""
    from siltstone.functions.stats import chi2_sf

    confusion = rater_pairs(ledger, repeat_index)
    kappa = cohen_kappa(confusion, PAIR, "answer_a", "answer_b")
    out = kappa.join(bowker(confusion, PAIR, "answer_a", "answer_b"), list(PAIR))
    return out.withColumn("bowker_pvalue", chi2_sf("bowker_statistic", "df"))


def lift_pairs(ledger: DataFrame) -> DataFrame:
    """model_id, strategy, sample_id, repeat_index, rag, no_rag (0 or 1): cells run both with and without retrieval;
    the strategy RAP is not compared (J04)."""
    rows = valid(ledger).filter("track = 'mcq' and strategy <> 'RAP'")
    hit = F.coalesce(F.col("correct"), F.lit(False)).cast("int")
    both = rows.groupBy("model_id", "strategy", "sample_id", "repeat_index").agg(F.max(F.when(F.col("rag_enabled"), hit)).alias("rag"), F.max(F.when(~F.col("rag_enabled"), hit)).alias("no_rag"))
    return both.filter("rag is not null and no_rag is not null")


def lift(pairs: DataFrame, a: str = "rag", b: str = "no_rag", by: tuple[str, ...] = ("model_id", "strategy")) -> DataFrame:
    """Accuracies, their difference, discordant pairs and Cohen's d of paired 0/1 outcomes."""
    n, d = F.count("*"), F.col(a) - F.col(b)
    s, s2 = F.sum(d), F.sum(d * d)
    # sums of whole numbers: n * s2 - s * s is n * (n - 1) times the variance
    spread = (n * s2 - s * s).cast("double")
    return pairs.groupBy(*by).agg(
        n.alias("n"), F.avg(a).alias("rag_accuracy"), F.avg(b).alias("no_rag_accuracy"), (s / n).alias("delta"),
        F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_no_rag"), F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_rag"),
        F.when((n < 2) | (spread == 0), 0.0).otherwise((s / n) / F.sqrt(spread / (n * (n - 1)))).alias("cohens_d"),
    )


def holm(tests: DataFrame, p: str = "pvalue", alpha: float = 0.05, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds significant_holm: Holm's step-down over all rows. There is a row per comparison, so they are few."""
    every = W.partitionBy(F.lit(1))
    step = every.orderBy(p, *order)
    passed = (F.col(p) <= alpha / (F.count("*").over(every) - F.row_number().over(step) + 1)).cast("int")
    out = tests.withColumn("_pass", passed)
    return out.withColumn("significant_holm", F.min("_pass").over(step.rowsBetween(W.unboundedPreceding, 0)) == 1).drop("_pass")


def rag_lift(ledger: DataFrame, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """The lift table: accuracies, difference, bootstrap interval, Cohen's d, the proxy p-value that says whether the
    interval holds zero, its Holm decision, and McNemar's exact p-value (A13)."""
    from siltstone.functions.stats import bootstrap_ci, mcnemar_exact

    pairs = lift_pairs(ledger)
    ci = bootstrap_ci(pairs, ("model_id", "strategy"), "rag", "no_rag", resamples, seed)
    out = lift(pairs).join(ci, ["model_id", "strategy"])
    out = out.withColumn("pvalue", F.when((F.col("ci_low") > 0) | (F.col("ci_high") < 0), 0.01).otherwise(0.5)).withColumn("mcnemar_pvalue", mcnemar_exact("only_no_rag", "only_rag"))
    return holm(out, "pvalue", order=("model_id", "strategy"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> list[Column]:
    """p_hat, ci_low, ci_high of the Wilson score interval; zeros where n is not positive."""
    k = F.greatest(F.lit(0), F.least(k, n)).cast("double")
    m = F.when(n > 0, n.cast("double"))
    p, z2 = k / m, F.lit(z * z)
    denominator = 1 + z2 / m
    center = (p + z2 / (2 * m)) / denominator
    half = (F.lit(z) * F.sqrt((p * (1 - p) + z2 / (4 * m)) / m)) / denominator
    zero = F.lit(0.0)
    return [F.coalesce(p, zero).alias("p_hat"), F.when(n > 0, F.greatest(zero, center - half)).otherwise(zero).alias("ci_low"), F.when(n > 0, F.least(F.lit(1.0), center + half)).otherwise(zero).alias("ci_high")]


def majority_vote(passes: DataFrame, by: tuple[str, ...], answer: str = "answer", order: str = "pass", text: str = "response_text") -> DataFrame:
    """The most frequent answer of each group, ties to that seen first, and the first text that gave it."""
    counts = passes.groupBy(*by, answer).agg(F.count("*").alias("votes"), F.min(order).alias("_first"), F.min_by(text, order).alias(text))
    best = counts.groupBy(*by).agg(F.max_by(F.struct(answer, "votes", text), F.struct("votes", -F.col("_first"))).alias("r"))
    return best.select(*by, "r.*")


def pivot_conditions(table: DataFrame, value: str, conditions: list[str]) -> DataFrame:
    """A row per model and a column per condition."""
    return table.groupBy("model_id").pivot("condition", conditions).agg(F.first(value))


def lift_by_strategy(table: DataFrame) -> DataFrame:
    """rag less no_rag accuracy of each model and strategy, and its share of the latter."""
    sides = table.groupBy("model_id", "strategy").agg(F.max(F.when(F.col("rag_enabled"), F.col("accuracy"))).alias("rag"), F.max(F.when(~F.col("rag_enabled"), F.col("accuracy"))).alias("no_rag"))
    sides = sides.filter("rag is not null and no_rag is not null").withColumn("lift", F.col("rag") - F.col("no_rag"))
    return sides.withColumn("lift_pct", F.when(F.col("no_rag") > 0, F.col("lift") / F.col("no_rag") * 100))


def leaderboard(table: DataFrame) -> DataFrame:
    """The best condition of each model, ties to the first strategy without retrieval."""
    order = W.partitionBy("model_id").orderBy(F.desc("accuracy"), "strategy", "rag_enabled")
    return table.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def radar(table: DataFrame, models: DataFrame, categories: DataFrame, key: str, value: str) -> DataFrame:
    """A cell for every model and category, missing ones 0 (A26); both dimensions are distinct values of small tables."""
    grid = models.crossJoin(F.broadcast(categories))
    return grid.join(table, ["model_id", key], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def grid(samples: DataFrame, conditions: DataFrame, models: DataFrame, repeats: int) -> DataFrame:
    """The run grid: samples by conditions by models by repeats; conditions and models are a few configured rows."""
    small = conditions.crossJoin(models.filter("enabled").drop("enabled")).withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return samples.crossJoin(F.broadcast(small))


def judge_summary(judged: DataFrame, by: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """Mean score and pass rate of each judged metric, nulls skipped (A27). Columns: <metric>_score, <metric>_pass."""
    return judged.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(f"{m}_score").alias(f"{m}_mean") for m in metrics], *[F.avg(F.col(f"{m}_pass").cast("int")).alias(f"{m}_pass_rate") for m in metrics])


def rollup_summary(ledger: DataFrame) -> DataFrame:
    """Runs and accuracy of each model with and without strategy, and over all: one pass over the ledger. As in SQL, the row
    over all is there without any run too, with an accuracy that is not a number."""
    rows = valid(ledger).filter("track = 'mcq'").select("model_id", "strategy", "correct", F.lit(1).alias("run"))
    # a row that is no run: a rollup of no rows gives none in Spark
    rows = rows.unionByName(ledger.sparkSession.range(1).select(F.lit(0).alias("run")), allowMissingColumns=True)
    out = rows.rollup("model_id", "strategy").agg(F.sum("run").alias("n"), F.count_if("correct").alias("right"), F.grouping_id().alias("level"))
    out = out.filter("n > 0 or level = 3").withColumn("accuracy", F.when(F.col("n") > 0, F.col("right") / F.col("n")).otherwise(F.lit(float("nan"))))
    return out.select(F.coalesce("model_id", F.lit("all")).alias("model_id"), F.coalesce("strategy", F.lit("all")).alias("strategy"), "n", "accuracy")


def open_records(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Runs of open questions without error beside their samples' own columns, for a judge."""
    return valid(runs).filter("track = 'open_ended'").join(samples.select("sample_id", *[c for c in samples.columns if c not in runs.columns]), "sample_id")


def in_order(rows: DataFrame, **orders: list[str]) -> DataFrame:
    """Rows sorted by columns whose values have an order of their own, in the order in which these are named; other values
    come last, by name (T12)."""
    keys = []
    for column, values in orders.items():
        place = F.array_position(F.array(*map(F.lit, values)), F.col(column))
        keys += [F.when(F.coalesce(place, F.lit(0)) == 0, len(values) + 1).otherwise(place), F.col(column)]
    return rows.orderBy(*keys)


def report_order(rows: DataFrame) -> DataFrame:
    """By model, then retrieval, then strategy."""
    return rows.orderBy("model_id", "rag_mode" if "rag_mode" in rows.columns else "rag_enabled", "strategy")


def report_units(rows: DataFrame, core: tuple[str, ...] = ("ZS", "FEW_SHOT", "COT")) -> DataFrame:
    """Core strategies with latency in seconds, shares in percent and a label."""
    return rows.filter(F.col("strategy").isin(*core)).select("*", (F.col("latency_ms_mean") / 1000).alias("latency_s"), (F.col("accuracy") * 100).alias("accuracy_percent"), F.concat_ws(" / ", "model_id", "strategy").alias("label"))


def group_means(rows: DataFrame, by: str, value: str = "accuracy", latency: str | None = None) -> DataFrame:
    """Mean and best of a value, and where asked mean latency, of strategies or tiers."""
    return rows.groupBy(by).agg(F.avg(value).alias(f"{value}_mean"), F.max(value).alias(f"{value}_max"), *([F.avg(latency).alias(f"{latency}_mean")] if latency else []))


def model_means(rows: DataFrame, value: str = "accuracy") -> DataFrame:
    """A model's mean over its strategies and how many these are."""
    return rows.groupBy("model_id").agg(F.avg(value).alias(f"{value}_mean"), F.countDistinct("strategy").alias("n_strategies"))


def spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles and mean of a value, interpolated."""
    return rows.groupBy(by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("quartiles"), F.avg(value).alias("mean"))
