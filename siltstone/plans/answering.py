"""Answers: prompts by mode, strategy and kind of question; generation with retries, rescue and votes; the answer chain
over retrieved chunks, and the loop that judges what was retrieved and asks anew."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import models
from siltstone.functions.parsing import parse_choice, parsed_choice
from siltstone.functions.text import judge_verdict, question_kind
from siltstone.operators import retrieval as r
from siltstone.tables import materialise

#: search(queries, k): the k best chunks (query_id, rank, score, source, page, section, content) of queries (query_id, text).
Search = Callable[[DataFrame, int], DataFrame]

# --- strategies and models ---------------------------------------------------------------------------------------

# Names of strategies, what else they are called, what "default" means, and models whose temperature is set.
STRATEGIES = ("ZS", "FEW_SHOT", "COT", "COT_SC", "RAP")
ALIASES = {"ZERO_SHOT": "ZS", "ZEROSHOT": "ZS", "FEWSHOT": "FEW_SHOT", "FEW": "FEW_SHOT", "CHAIN_OF_THOUGHT": "COT", "COTSC": "COT_SC"}
DEFAULT_STRATEGIES = ("ZS", "FEW_SHOT", "COT")
TEMPERATURES = (("gpt-5", None), ("gemini-3", 1.0), ("kimi-k2.5", 1.0), ("kimi-k2-5", 1.0))


def strategies(names: str = "") -> list[str]:
    """The strategies of a comma-separated list, "default" or "all", each once."""
    asked = names.strip().lower()
    if asked in ("", "default", "all"):
        return list(STRATEGIES if asked == "all" else DEFAULT_STRATEGIES)
    out = [ALIASES.get(n, n) for n in (p.strip().replace("-", "_").upper() for p in names.split(",")) if n]
    if unknown := [n for n in out if n not in STRATEGIES]:
        raise ValueError(f"unknown strategies: {', '.join(unknown)}")
    if not out:
        raise ValueError("no strategy is named")
    return list(dict.fromkeys(out))


def model_spec(spec: str) -> tuple[str, str]:
    """Provider and model of "provider:model" (X42)."""
    provider, colon, model = spec.partition(":")
    if not colon:
        raise ValueError(f"{spec!r} is not provider:model")
    return {"hf": "huggingface"}.get(provider, provider), model


def temperature(model: Column, asked: float) -> Column:
    """The temperature for a model, null where none may be given."""
    out = F.lit(asked)
    for part, value in reversed(TEMPERATURES):
        out = F.when(F.contains(F.lower(model), F.lit(part)), F.lit(value).cast("double")).otherwise(out)
    return out


# --- prompts -----------------------------------------------------------------------------------------------------

#: What a model is told first, by whether the question is open and whether context is given.
SYSTEM = {
    (False, False): "You answer multiple-choice questions from your own knowledge. Choose among the given options only.",
    (False, True): "You answer multiple-choice questions. Rely on the given context before your own knowledge, and choose among the given options only.",
    (True, False): "You answer questions in short sentences with values and units. Do not name sources.",
    (True, True): "You answer questions in short sentences with values and units. Prefer values of the given context, never invent one that it lacks, and name the source of each in square brackets.",
}
#: The instruction of a strategy for choice questions, and for open ones.
CHOICE = {
    "ZS": "Answer the question. End with 'Answer: X'.",
    "FEW_SHOT": "Answer as in the examples. End with 'Answer: X'.",
    "COT": "Think step by step, then end with 'Answer: X'.",
    "COT_SC": "Think step by step, then end with 'Answer: X'.",
    "RAP": "Plan, reason over the plan, then end with 'Answer: X'.",
}
OPEN = {
    "ZS": "Answer the question under 'Final answer:'.",
    "FEW_SHOT": "Answer as in the examples, under 'Final answer:'.",
    "COT": "Write the steps under 'Work:', then the result under 'Final answer:'.",
}
#: What a kind of question asks for beyond that (F16).
KINDS = {
    "dosage_calculation": "Show the formula with units before the result.",
    "reference_values": "Give the range with its unit and for whom it holds.",
    "board_style": "Weigh every option before choosing.",
    "clinical_reasoning": "Name the cause before its consequence.",
}
#: Examples where no pool is given: question and answer, for choice and for open questions.
SHOTS = {
    False: (("How many millilitres are in 0.25 L?\nA. 25\nB. 250\nC. 2500", "0.25 L x 1000 mL/L = 250 mL.\nAnswer: B"), ("Which unit is one of mass?\nA. g\nB. mL", "The gram measures mass.\nAnswer: A")),
    True: (("How much is 2 g/kg/day for 3 kg?", "Work: 2 g/kg/day x 3 kg\nFinal answer: 6 g/day"), ("How many mg are 0.4 g?", "Work: 0.4 g x 1000 mg/g\nFinal answer: 400 mg")),
}


def _lookup(of: dict[str, str], key: Column, otherwise: str = "") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), key), F.lit(otherwise))


def shots(examples: Column) -> Column:
    """Worked examples (array of structs question, answer) as text; those without either are left out."""
    good = F.filter(examples, lambda x: (F.trim(x["question"]) != "") & (F.trim(x["answer"]) != ""))
    return F.array_join(F.transform(good, lambda x: F.concat(F.lit("Q: "), F.trim(x["question"]), F.lit("\nA: "), F.trim(x["answer"]))), "\n\n")


def default_shots(is_open: Column) -> Column:
    listed = lambda k: F.array(*[F.struct(F.lit(q).alias("question"), F.lit(a).alias("answer")) for q, a in SHOTS[k]])
    return F.when(is_open, listed(True)).otherwise(listed(False))


def lettered(options: Column) -> Column:
    """Options under letters of their own, old labels stripped."""
    return F.array_join(F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda x, i: F.concat(F.char(i + 65), F.lit(". "), F.regexp_replace(x, r"^[A-Fa-f][.)]\s*", ""))), "\n")


def rendered(samples: DataFrame) -> DataFrame:
    """Adds system and prompt (X33, S15). samples: strategy, track, question, options, context_text (null without), and
    examples (array of structs question, answer) where a pool was asked, else the default ones.

    The prompt is the strategy's instruction, what the question's kind asks for, examples for FEW_SHOT, the context
    where there is any, the question, and its lettered options.
    """
    is_open, context = F.col("track") != "mcq", F.trim(F.coalesce("context_text", F.lit("")))
    told = F.when(is_open, _lookup(OPEN, F.col("strategy"), OPEN["ZS"])).otherwise(_lookup(CHOICE, F.col("strategy"), CHOICE["ZS"]))
    system = F.lit(None)
    for (o, c), text in SYSTEM.items():
        system = F.when((is_open == F.lit(o)) & ((context != "") == F.lit(c)), text).otherwise(system)
    examples = F.coalesce("examples", default_shots(is_open)) if "examples" in samples.columns else default_shots(is_open)
    options = F.when(is_open, "").otherwise(lettered(F.col("options")))
    part = lambda condition, *texts: F.when(condition, F.concat(*texts))
    kind = _lookup(KINDS, question_kind(F.col("question")))
    parts = [
        told, part(kind != "", kind), part(F.col("strategy") == "FEW_SHOT", F.lit("Examples:\n"), shots(examples)), part(context != "", F.lit("Context:\n"), context),
        F.concat(F.lit("Question: "), F.trim("question")), part(options != "", F.lit("Options:\n"), options),
    ]
    return samples.withColumn("system", system).withColumn("prompt", F.concat_ws("\n\n", *parts))


# --- generation --------------------------------------------------------------------------------------------------


def answered(rows: DataFrame, model: models.Generator = models.echo, structured: models.Generator | None = None, retries: int = 3, passes: int = 3) -> DataFrame:
    """Adds response_text, answer, thinking, confidence, structured_output_used, latency_ms, tokens_used and error (ML6).
    rows: prompt, strategy, track.

    A COT_SC prompt is answered ``passes`` times, and the first response with the most frequent answer counts. A choice
    answer that cannot be parsed is asked for again, ``retries`` times at most, then of the structured model, whose
    response is an answer or JSON with one. What an open question is answered is not parsed. latency_ms is that of the
    first call, tokens_used the sum over the calls whose answers count. A call that fails is a row with its error, no text
    and no answer; retries that fail are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts, choice = frame["prompt"].tolist(), (frame["track"] == "mcq").tolist()
            first = models.called(model, prompts)
            texts, tokens, errors = [r.text for r in first], [r.tokens for r in first], [r.error for r in first]
            voting = [k for k, s in enumerate(frame["strategy"]) if s == "COT_SC" and choice[k]]
            said = {k: [first[k].text] * (first[k].error is None) for k in voting}
            for _ in range(passes - 1):
                for k, reply in zip(voting, models.called(model, [prompts[k] for k in voting])):
                    if reply.error is None:
                        said[k].append(reply.text)
                        tokens[k] += reply.tokens
            for k, every in said.items():
                if every:
                    found = [parse_choice(t)[0] for t in every]
                    texts[k], errors[k] = every[found.index(Counter(found).most_common(1)[0][0])], None
            parsed = [(None, None, None) if e is not None else parse_choice(t) if c else ("", "", "medium") for t, c, e in zip(texts, choice, errors)]
            rescued = [False] * len(frame)
            todo = [k for k, p in enumerate(parsed) if p[0] == "UNKNOWN"]
            for _ in range(retries):
                for k, reply in zip(todo, models.called(model, [prompts[k] for k in todo])):
                    if reply.error is None and (again := parse_choice(reply.text))[0] != "UNKNOWN":
                        texts[k], parsed[k] = reply.text, again
                        tokens[k] += reply.tokens
                todo = [k for k in todo if parsed[k][0] == "UNKNOWN"]
            for k, reply in zip(todo, models.called(structured, [prompts[k] for k in todo]) if structured else ()):
                letters = sorted(set(x for x in reply.text.upper().replace('"ANSWER"', "") if x in "ABCDEF"))
                if letters:
                    parsed[k], rescued[k] = (",".join(letters), parsed[k][1], parsed[k][2]), True
            out = {"response_text": texts, "answer": [p[0] for p in parsed], "thinking": [p[1] for p in parsed], "confidence": [p[2] for p in parsed], "structured_output_used": rescued}
            yield frame.assign(**out, latency_ms=[r.latency_ms for r in first], tokens_used=tokens, error=errors)

    added = {"response_text": T.StringType(), "answer": T.StringType(), "thinking": T.StringType(), "confidence": T.StringType(), "structured_output_used": T.BooleanType(), "latency_ms": T.DoubleType(), "tokens_used": T.IntegerType(), "error": T.StringType()}
    rest = rows.drop(*added)
    return rest.mapInPandas(run, T.StructType([*rest.schema.fields, *(T.StructField(n, t) for n, t in added.items())]))


# --- retrieval around it -----------------------------------------------------------------------------------------


def multi_query(queries: DataFrame, search: Search, k: int = 10, expand: Callable[[str], list[str]] = models.paraphrases) -> DataFrame:
    """Every wording of a query is searched; of equal contents the first hit by wording and rank stays, and the k best by
    score remain (ML5). queries: query_id, text."""
    asked = models.expanded(queries, expand=expand).select(F.col("query_id").alias("_of"), "variant", F.col("variant_text").alias("text"))
    asked = materialise(asked.withColumn("query_id", F.concat_ws("#", F.col("_of").cast("string"), F.col("variant").cast("string"))), "multi-query")
    hits = search(asked.select("query_id", "text"), k).join(asked.select("query_id", "_of", "variant"), "query_id")
    first = r.first_of_each(hits.withColumn("_key", r.content_key(F.col("content"))), ("_of", "_key"), ("variant", "rank"))
    order = r.W.partitionBy("_of").orderBy(F.desc("score"), "variant", "rank")
    best = first.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    return best.drop("query_id", "_key", "variant", "rank").withColumnRenamed("_of", "query_id").withColumnRenamed("_n", "rank")


def hyde(queries: DataFrame, search: Search, k: int = 10, write: Callable[[list[str]], list[str]] = models.hyde) -> DataFrame:
    """The hits of a passage that would answer the query, with the query (ML4)."""

    @F.pandas_udf("string")
    def passage(texts: pd.Series) -> pd.Series:
        return pd.Series(write(texts.fillna("").tolist()))

    return search(queries.select("query_id", passage("text").alias("text")), k)


def choice_chain(questions: DataFrame, hits: DataFrame, model: models.Generator = models.echo, structured: models.Generator | None = None, budget: int = 6000, strategy: str = "ZS") -> DataFrame:
    """query_id, answer, thinking, confidence, response_text, sources (the first three), retrieval_scores of each choice
    question (C04). questions: query_id, question, options. hits: query_id, rank, score, source, page, section, content.
    A question without hits is asked without context."""
    context = r.packed_context(hits, budget).select("query_id", "context_text")
    source = F.struct(F.concat(F.substring("content", 1, 200), F.lit("...")).alias("content"), "source", "section")
    listed = F.array_sort(F.collect_list(F.struct("rank", "score", source.alias("of"))))
    found = hits.groupBy("query_id").agg(listed.alias("_h")).select("query_id", F.slice(F.transform("_h", lambda x: x["of"]), 1, 3).alias("sources"), F.transform("_h", lambda x: x["score"]).alias("retrieval_scores"))
    rows = questions.join(context, "query_id", "left").join(found, "query_id", "left").withColumn("strategy", F.lit(strategy)).withColumn("track", F.lit("mcq"))
    return answered(rendered(rows), model, structured).select("query_id", "answer", "thinking", "confidence", "response_text", "structured_output_used", "sources", "retrieval_scores")


def agentic(questions: DataFrame, search: Search, model: models.Generator = models.echo, grade: models.Generator | None = None, rewrite: models.Generator | None = None, k: int = 5, most: int = 2, least: int = 50) -> DataFrame:
    """query_id, answer, thinking, confidence, rewrite_count, context_used (C05). questions: query_id, question, options, and
    case_context where there is one.

    What is retrieved is graded as a whole; a question whose context is rejected, or too short, is rewritten and searched
    again, ``most`` times at most, then answered from what there is. Each round is a written table of the questions still
    open, so that only these are searched again.
    """
    case = F.coalesce("case_context", F.lit("")) if "case_context" in questions.columns else F.lit("")
    open_ = questions.select("query_id", F.col("question").alias("asked"), F.trim(F.concat_ws(" ", case, "question")).alias("text"))
    done = None
    for turn in range(most + 1):
        hits = search(open_.select("query_id", "text"), k).select("query_id", "rank", "source", "content")
        part = F.concat(F.lit("[Source: "), F.coalesce("source", F.lit("Unknown")), F.lit("]\n"), "content")
        context = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n---\n\n").alias("context_text"))
        rows = open_.join(context, "query_id", "left").withColumn("context_text", F.coalesce("context_text", F.lit("")))
        enough = F.length(F.trim("context_text")) >= least
        prompt = F.concat_ws("\n", F.lit("Does this context help to answer the question? Answer yes or no."), "asked", F.substring("context_text", 1, 2000))
        graded = models.generated(rows.withColumn("prompt", prompt), model=grade, retries=1) if grade else rows.withColumn("response_text", F.lit("yes"))
        last = turn == most
        good = F.lit(True) if last else enough & judge_verdict(F.col("response_text"))
        graded = materialise(graded.select("query_id", "asked", "text", "context_text", good.alias("good"), F.lit(turn).alias("rewrite_count")), "agentic")
        now = graded.filter("good")
        done = now if done is None else done.unionByName(now)
        if last or not graded.filter("not good").limit(1).collect():
            break
        again = graded.filter("not good").withColumn("prompt", F.concat_ws("\n", F.lit("Rewrite this question so that a search finds more."), "asked"))
        again = models.generated(again, model=rewrite or models.echo, retries=1)
        new = F.coalesce(F.nullif(F.trim("response_text"), F.lit("")), F.col("asked"))
        open_ = materialise(again.select("query_id", new.alias("asked"), new.alias("text")), "agentic-open")
    rows = questions.drop("context_text").join(done.select("query_id", "context_text", "rewrite_count"), "query_id").withColumn("strategy", F.lit("ZS")).withColumn("track", F.lit("mcq"))
    return answered(rendered(rows), model).select("query_id", "answer", "thinking", "confidence", "rewrite_count", (F.col("context_text") != "").alias("context_used"))


__all__ = ["agentic", "answered", "choice_chain", "hyde", "lettered", "model_spec", "multi_query", "parsed_choice", "rendered", "strategies", "temperature"]
