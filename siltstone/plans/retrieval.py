"""Composite plans: retrieval from query to packed context, over all queries at once, and what is asked with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import models
from siltstone.functions.text import decompose_query, focus_query, judge_verdict
from siltstone.operators import index as keyword
from siltstone.operators import retrieval as r
from siltstone.tables import materialise


def hybrid(queries: DataFrame, chunks: DataFrame, index: keyword.KeywordIndex, k: int = 10, each: int = 20, weights: tuple[float, float] = (0.5, 0.5), use_vector: bool = True, use_keyword: bool = True, where: Column | None = None) -> DataFrame:
    """Vector and keyword top lists, fused by reciprocal rank (C01, C03, J16). queries: query_id, text, embedding.
    chunks: doc_id, embedding and what ``where`` reads; the filter holds for both sides."""
    rows = chunks if where is None else chunks.filter(where)
    lists = []
    if use_vector:
        lists.append(r.vector_top_k(queries, rows, each, id_col="doc_id").select("query_id", "doc_id", "rank", F.lit(0).alias("source")))
    if use_keyword:
        scores = keyword.bm25(queries, index)
        scores = scores if where is None else scores.join(rows.select("doc_id"), "doc_id", "left_semi")
        top = keyword.ranked(scores.withColumn("score_millionths", keyword.rounded(F.col("score"))), each, score=F.col("score_millionths"))
        lists.append(top.select("query_id", "doc_id", "rank", F.lit(1).alias("source")))
    if not lists:
        raise ValueError("neither side is enabled")
    both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    weight = F.when(F.col("source") == 0, weights[0]).otherwise(weights[1])
    return r.rrf(both, k, weight=weight)


def planned(queries: DataFrame, most: int = 3) -> DataFrame:
    """query_id, plan_text, is_original: the focused query and its decomposition."""
    focus = queries.select("query_id", focus_query(F.col("text")).alias("focus"))
    return focus.select("query_id", F.posexplode(decompose_query(F.col("focus"), most)).alias("n", "plan_text")).select("query_id", "plan_text", (F.col("n") == 0).alias("is_original"), F.col("n").alias("plan_no"))


def refined(queries: DataFrame, hits: DataFrame, asked: DataFrame, hints: int = 2, most: int = 2) -> DataFrame:
    """Second-round queries from the sections and sources of the first ten hits of every query of the plan, in the plan's
    order (X30, T11). hits: query_id, plan_no, rank, section, source."""
    first = hits.filter("rank <= 10").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("plan_no", "rank", "section", "source"))).alias("h"))
    distinct = lambda f: F.slice(F.array_distinct(F.filter(F.transform("h", lambda x: F.coalesce(F.trim(x[f]), F.lit(""))), lambda x: x != "")), 1, hints)
    rows = queries.join(first, "query_id").select("query_id", F.concat(F.transform(distinct("section"), lambda s: F.concat_ws(" section ", "text", s)), F.transform(distinct("source"), lambda s: F.concat_ws(" source ", "text", s))).alias("q"))
    seen = asked.groupBy("query_id").agg(F.collect_set(F.lower("plan_text")).alias("seen"))
    rows = rows.join(seen, "query_id", "left")
    fresh = F.slice(F.filter("q", lambda x: ~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), F.lower(x))), 1, most)
    return rows.select("query_id", F.posexplode(fresh).alias("plan_no", "plan_text")).withColumn("is_original", F.lit(False))


def snapshot(queries: DataFrame, chunks: DataFrame, index: keyword.KeywordIndex, top_k: int = 5, candidates: int = 40, budget: int = 6000, most: int = 3, iterations: int = 2, scorer: models.PairScorer | None = models.overlap_score, embed: models.Embedder | None = None, weights: tuple[float, float] = (0.6, 0.4), min_score: float = 0.0) -> DataFrame:
    """The retrieval snapshot of every query (C02, C09): plan, retrieval of each planned query, a second round on hints of
    the first, fusion, rerank, quality and relevance filters, and packed context. Retrieval is by keywords, and with an
    embedder, for chunks with an embedding, by vectors too, fused with these weights. min_score drops reranked chunks
    below it (F05).

    chunks: doc_id, source, page, section, content. Returns query_id, chunks (structs by rank), context_text,
    context_hash, context_chars, candidate_count (after the quality filter), returned_count, source_diversity,
    iteration_count, refinement_used, query_plan and cache_key (H04). A query without hits has no chunks, an empty context
    and counts of 0.
    """
    def round_of(asked: DataFrame, iteration: int) -> DataFrame:
        own = asked.withColumn("pid", F.concat_ws("#", F.col("query_id").cast("string"), F.lit(iteration), F.col("plan_no").cast("string")))
        if embed is None:
            # one list is fused like two
            hits = keyword.top_k(own.select("pid", "plan_text"), index, candidates, "pid", "plan_text").withColumn("score", weights[1] / (r.RRF_K + F.col("rank")))
        else:
            vectors = materialise(own.select(F.col("pid").alias("query_id"), F.col("plan_text").alias("text"), models.embedded("plan_text", embed).alias("embedding")), "snapshot-plan")
            hits = hybrid(vectors, chunks, index, candidates, candidates, weights)
        hits = hits.withColumnRenamed("query_id", "pid")
        # retrieval hands on its fused score where it does not rerank, and that is what the batches' fusion takes
        return hits.join(own, "pid").select("query_id", "doc_id", "plan_no", F.col("rank").alias("batch_rank"), "is_original", F.lit(iteration).alias("iteration"), F.col("score").alias("rerank_score"))

    plan = planned(queries, most)
    batches, asked = round_of(plan, 0), plan.withColumn("iteration", F.lit(0))
    if iterations > 1:
        batches = materialise(batches, "snapshot-first")
        hits = batches.join(chunks.select("doc_id", "section", "source"), "doc_id").select("query_id", "plan_no", F.col("batch_rank").alias("rank"), "section", "source")
        focus = queries.select("query_id", focus_query(F.col("text")).alias("text"))
        more = materialise(refined(focus, hits, plan), "snapshot-refined")
        batches = batches.unionByName(round_of(more, 1))
        asked = asked.unionByName(more.withColumn("iteration", F.lit(1)))
    # hits of few ids and numbers, which several of the following steps read
    batches = materialise(batches, "snapshot-hits")
    fused = r.fuse_batches(batches.withColumnRenamed("doc_id", "key"), candidates).withColumnRenamed("key", "doc_id").withColumnRenamed("rank", "retrieval_rank")
    rows = fused.join(chunks, "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    if scorer is None:
        rows = rows.withColumn("score", F.col("score_millionths") / 1_000_000).withColumn("rank", F.col("retrieval_rank"))
    else:
        rows = rerank(rows, scorer)
    rows = r.min_score(rows, min_score)
    good = r.quality_filtered(rows)
    kept = r.relevance_filtered(good)
    kept = kept.withColumn("rank", F.row_number().over(r.W.partitionBy("query_id").orderBy("rank")))
    top = kept.filter(F.col("rank") <= top_k)
    context = r.packed_context(top, budget)
    listed = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "source", "page", "section", "score", "retrieval_rank", "content"))).alias("chunks"), F.count("*").alias("returned_count"), F.countDistinct("source").alias("source_diversity"))
    counted = good.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    # the queries of both rounds, led by the focused one
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("iteration", "plan_no", "plan_text"))), lambda x: x["plan_text"])
    rounds = asked.groupBy("query_id").agg((F.max("iteration") + 1).alias("iteration_count"), (F.max("iteration") > 0).alias("refinement_used"), ordered.alias("query_plan"))
    focused = focus_query(F.col("text"))
    parameters = (top_k, candidates, budget, iterations > 1, iterations, most, r.FLOOR, r.RATIO)
    rounds = rounds.join(queries.select("query_id", focused.alias("_focus"), r.cache_key(F.col("query_id"), focused, *map(F.lit, parameters)).alias("cache_key")), "query_id", "right")
    rounds = rounds.join(batches.select("query_id", F.lit(True).alias("_found")).distinct(), "query_id", "left")
    rounds = rounds.select("query_id", F.when(F.col("_found"), F.col("iteration_count")).alias("iteration_count"), "refinement_used", F.concat(F.array(F.concat(F.lit("[focused] "), "_focus")), F.coalesce("query_plan", F.array().cast("array<string>"))).alias("query_plan"), "cache_key")
    out = queries.select("query_id")
    for part in (listed, context, counted, rounds):
        out = out.join(part, "query_id", "left")
    nothing = F.sha2(F.lit(""), 256)
    empty = {"context_text": F.lit(""), "context_hash": nothing, "context_chars": F.lit(0), "candidate_count": F.lit(0), "returned_count": F.lit(0), "source_diversity": F.lit(0), "iteration_count": F.lit(0), "refinement_used": F.lit(False), "query_plan": F.array().cast("array<string>"), "cache_key": F.lit(""), "n_packed": F.lit(0), "chunks": F.from_json(F.lit("[]"), listed.schema["chunks"].dataType)}
    return out.select("query_id", *[F.coalesce(c, empty[c]).alias(c) for c in out.columns if c != "query_id"])


def rerank(rows: DataFrame, scorer: models.PairScorer = models.overlap_score, query: str = "query", text: str = "content") -> DataFrame:
    """Rows reordered by the scorer's squashed score, ties to the better retrieval rank (T05, ML2)."""
    scored = rows.withColumn("score", models.pair_scored(query, text, scorer))
    return scored.withColumn("rank", F.row_number().over(r.W.partitionBy("query_id").orderBy(F.desc("score"), "retrieval_rank")))


def judged(top: DataFrame, judge: models.Generator, again: DataFrame | None = None, least: int = 1, k: int = 5) -> DataFrame:
    """Drops chunks that the judge rejects; queries left with fewer than ``least`` are merged with a second retrieval's
    chunks: distinct contents, by rank, k at most (ML7). top, again: query_id, rank, query, content."""
    prompt = F.concat_ws("\n", F.lit("Is this passage relevant? Answer yes or no."), "query", "content")
    kept = models.generated(top.withColumn("prompt", prompt), model=judge, retries=1).filter(judge_verdict(F.col("response_text"))).drop("prompt", "response_text")
    if again is None:
        return kept
    number = kept.groupBy("query_id").agg(F.count("*").alias("n"))
    weak = top.select("query_id").distinct().join(number, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < least).select("query_id")
    every = kept.unionByName(again.join(weak, "query_id", "left_semi").select(*kept.columns))
    distinct = r.first_of_each(every.withColumn("_key", F.sha2(F.substring("content", 1, 256), 256)), ("query_id", "_key"), ("rank",)).drop("_key")
    return keyword.ranked(distinct.withColumn("_old", F.col("rank")).drop("rank"), k, score=-F.col("_old"), ties=("content",)).drop("_old")


# Token budgets of strategies.
TOKENS = {"ZS": 256, "FEW_SHOT": 256, "COT": 1024, "COT_SC": 1024}


def token_budget(strategy: Column, other: int = 512) -> Column:
    """The budget of a strategy."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv]), strategy), F.lit(other))


def few_shot(queries: DataFrame, pool: DataFrame, k: int = 2) -> DataFrame:
    """The k examples nearest to each query by cosine (T10, ML9). pool: doc_id, embedding: a curated table of few rows."""
    return r.vector_top_k(queries, pool, k, id_col="doc_id")


#: Metrics of open answers in a ledger; the last has no value without a gold source.
OPEN_METRICS = ("f1", "citation_match", "quantity_f1", "quantity_recall", "quantity_precision", "key_f1", "key_recall", "key_precision", "final_quantity_f1", "final_key_f1", "ref_is_single_target", "doc_citation_present", "doc_cited_in_retrieved_context")
GOLD_METRICS = ("doc_cites_gold_source",)


def open_metrics(rows: DataFrame) -> DataFrame:
    """Adds the metrics of open answers (A03, X15, M04-M06). rows: response_text, reference_answer, source_doc, page,
    retrieved_sources. Calculations are scored on the whole response, and with final_ on its final answer alone."""
    from siltstone.functions import parsing, text
    from siltstone.operators.grounding import doc_citation_scores

    said, want = F.col("response_text"), F.coalesce("reference_answer", F.lit(""))
    rows = rows.withColumn("_said", F.coalesce(said, F.lit(""))).withColumn("_want", want).withColumn("_final", text.final_answer(said))
    rows = rows.withColumn("_whole", parsing.scored_calculation("_want", "_said")).withColumn("_last", parsing.scored_calculation("_want", "_final")).withColumn("_target", parsing.targets("_want"))
    rows = rows.withColumn("_cited", text.doc_citations(F.col("_said")))
    present, _, gold, context = doc_citation_scores(F.col("_cited"), F.col("source_doc"), F.col("retrieved_sources"))
    out = rows.select(
        *[c for c in rows.columns if not c.startswith("_")], text.token_f1(F.col("_said"), F.col("_want")).alias("f1"), text.exact_match(F.col("_said"), F.col("_want")).alias("exact_match"), text.key_phrase_overlap(F.col("_said"), F.col("_want")).alias("key_phrase_overlap"),
        text.citation_match(F.col("_said"), F.col("source_doc"), F.col("page")).cast("double").alias("citation_match"), "_whole.*", *[F.col(f"_last.{c}").alias(f"final_{c}") for c in parsing.CALC_FIELDS if not c.startswith(("expected", "matched"))],
        F.col("_target.is_single_target").cast("double").alias("ref_is_single_target"), present.cast("double").alias("doc_citation_present"), gold.cast("double").alias("doc_cites_gold_source"), context.cast("double").alias("doc_cited_in_retrieved_context"),
    )
    return out


def experiment(samples: DataFrame, conditions: DataFrame, model_rows: DataFrame, snapshots: DataFrame, repeats: int = 1, model: models.Generator = models.echo, structured: models.Generator | None = None, pool: DataFrame | None = None, embed: models.Embedder = models.hashed_embedding, done: DataFrame | None = None, calls: int | None = None, **gate) -> DataFrame:
    """The run ledger of a grid (C11): conditions and models by samples, context where the gate passes, prompts, answers,
    and their scores. samples: sample_id, track, question, options, answer_key, reference_answer, and where they are
    known source_doc and page. snapshots: query_id, context_text, context_chars, returned_count, chunks; a sample's
    snapshot is that of its id, or where snapshots have a strategy of its id and strategy (J02). pool: worked examples
    (question, answer), of which a FEW_SHOT prompt gets the two nearest to its question.

    A call that fails is a run with its error and no scores. done: a ledger; cells that have a run without an error there
    are left out, so that a run of the grid that was broken off, or had errors, goes on with what is missing. calls: at
    most so many tasks, each of which calls one batch after the other, ask the model at once."""
    from siltstone.functions.text import answers_match
    from siltstone.operators.ledger import CELL, grid, valid
    from siltstone.plans.answering import answered, rendered

    for c, kind in (("source_doc", "string"), ("page", "int")):
        samples = samples if c in samples.columns else samples.withColumn(c, F.lit(None).cast(kind))
    cells = grid(samples, conditions, model_rows, repeats)
    if done is not None:
        cells = cells.join(valid(done).select(*CELL).distinct(), list(CELL), "left_anti")
    by = ["sample_id", "strategy"] if "strategy" in snapshots.columns else ["sample_id"]
    first = F.get("chunks", F.lit(0))
    fields = snapshots.schema["chunks"].dataType.elementType.names
    sources = F.transform("chunks", lambda x: x["source"]) if "source" in fields else F.array().cast("array<string>")
    found = snapshots.withColumnRenamed("query_id", "sample_id").select(*by, F.col("context_text").alias("_context"), "context_chars", "returned_count", first["score"].alias("top_score"), sources.alias("retrieved_sources"), F.lit(1).alias("_has"))
    rows = cells.join(found, by, "left")
    reason = r.rag_gate(F.col("_has"), F.col("context_chars"), F.col("returned_count"), F.col("top_score"), F.col("rag_enabled"), **gate)
    rows = rows.withColumn("rag_gate_reason", reason).withColumn("rag_context_used", F.col("rag_gate_reason").isin("pass", "gating_disabled").cast("int"))
    rows = rows.withColumn("context_text", F.when(F.col("rag_context_used") == 1, F.col("_context"))).drop("_context", "_has")
    if pool is not None:
        rows = rows.join(shots_for(samples, pool, embed), "sample_id", "left")
    rows = rendered(rows)
    rows = answered(rows.repartition(calls) if calls else rows, model, structured)
    exact, partial = answers_match(F.col("answer"), F.coalesce("answer_key", F.lit("")))
    choice = F.col("track") == "mcq"
    scored = open_metrics(rows.withColumn("parsed_answer", F.when(choice, F.col("answer"))).withColumn("correct", F.when(choice, exact)).withColumn("partial_match", F.when(choice, partial.cast("int"))))
    own = [c for c in scored.columns if c not in rows.columns and c not in ("parsed_answer", "correct", "partial_match")]
    return scored.select(*[c for c in scored.columns if c not in own], *[F.when(~choice & F.col("error").isNull(), F.col(c)).alias(c) for c in own]).drop("answer")


def shots_for(samples: DataFrame, pool: DataFrame, embed: models.Embedder = models.hashed_embedding, k: int = 2) -> DataFrame:
    """sample_id, examples: the k worked examples of a pool (question, answer) nearest to each sample's question (T10, ML9)."""
    asked = samples.select(F.col("sample_id").alias("query_id"), models.embedded("question", embed).alias("embedding"))
    held = materialise(pool.select("question", "answer", models.embedded("question", embed).alias("embedding")).withColumn("doc_id", F.sha2(F.concat_ws("\n", "question", "answer"), 256)).dropDuplicates(["doc_id"]), "shots")
    near = few_shot(asked, held, k).join(held.drop("embedding"), "doc_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "question", "answer"))), lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer")))
    return near.groupBy(F.col("query_id").alias("sample_id")).agg(listed.alias("examples"))


def grounded_answer(answer: Column, grounding: Column, has_context: Column, least: float = 0.5) -> Column:
    """The answer if it is grounded, else a fixed refusal."""
    return F.when((grounding >= least) & has_context, answer).otherwise("INSUFFICIENT_CONTEXT")
