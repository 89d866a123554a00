"""Citations of answers: extraction, matching with retrieved chunks, and grounding of answers in them."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import ANSWER_STOPWORDS, covered, let, source_name, sources_match, split_words, squeezed, terms, without_citations
from siltstone.operators.chunking import SENTENCE_END

# The forms of citations with a source and, but for the last, a page.
CITATIONS = (
    r"\[([^\]]+?),?\s*(?:p\.?|page)\s*(\d+)\]",
    r"\((?:Source:\s*)?([^)]+?),?\s*(?:p\.?|page)\s*(\d+)\)",
    r"According to (?:the )?([^(]+?)\s*\((?:p\.?|page)\s*(\d+)\)",
    r"([^,]+?)\s+(?:states?|indicates?|recommends?)\s*\((?:p\.?|page)\s*(\d+)\)",
    r"\[([^\]]+?)\](?!\()",
)
#: What a text must have for a form to be sought in it: the forms themselves are slow on long texts without any.
SIGNS = (r"(?:p\.?|page)\s*\d+\]", r"(?:p\.?|page)\s*\d+\)", r"According to ", r"(?:states?|indicates?|recommends?)\s*\((?:p\.?|page)\s*\d+\)", r"\[")
# Fixed value: numbers with their units.
UNIT_NUMBER = r"\d+\.?\d*(?:\s*(?:mg|g|kg|ml|mcg|%|days?|hours?|weeks?))?"


def citations(text: Column) -> Column:
    """array(source, page) in the forms' order, distinct by lower-case source and page (X22). The bracket form without
    page finds paged brackets once more, as sources of their own."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for k, form in enumerate(CITATIONS):
        seen, none = text.rlike(f"(?i){SIGNS[k]}"), F.array().cast("array<string>")
        names = F.when(seen, F.regexp_extract_all(text, F.lit(f"(?i){form}"), F.lit(1))).otherwise(none)
        pages = F.when(seen, F.regexp_extract_all(text, F.lit(f"(?i){form}"), F.lit(2))).otherwise(none) if k < len(CITATIONS) - 1 else F.array_repeat(F.lit(None).cast("string"), F.size(names))
        found.append(F.zip_with(names, pages, lambda n, p: F.struct(F.trim(n).alias("source"), p.cast("int").alias("page"))))
    same = lambda x, y: (F.lower(x["source"]) == F.lower(y["source"])) & x["page"].eqNullSafe(y["page"])
    return let(F.concat(*found), lambda every: F.filter(every, lambda x, i: ~F.exists(F.slice(every, 1, i), lambda y: same(x, y))))


def citation_scores(answers: DataFrame, chunks: DataFrame, by: str = "answer_id", answer: str = "answer") -> DataFrame:
    """Of each answer: citations, those whose source is a retrieved one, pages that agree, and their shares.

    chunks: by, rank, source, page. A citation is held against the first chunk, by rank, whose source matches; an
    answer's citations and chunks are a few each, and meet under the answer's key alone.
    """
    cited = answers.select(by, F.posexplode(citations(F.col(answer))).alias("n", "c")).select(by, "n", "c.*")
    kept = chunks.select(by, "rank", F.col("source").alias("chunk_source"), F.col("page").alias("chunk_page"))
    met = cited.join(kept, by).filter(sources_match(F.col("source"), F.col("chunk_source")))
    first = met.groupBy(by, "n").agg(F.min_by(F.struct("page", "chunk_page"), "rank").alias("m"))
    page_ok = F.coalesce(F.col("m.page") == F.col("m.chunk_page"), F.lit(True)) | (F.col("m.page") == 0) | (F.col("m.chunk_page") == 0)
    matched = first.groupBy(by).agg(F.count("*").alias("matched"), F.count_if(page_ok).alias("pages"))
    number = cited.groupBy(by).agg(F.count("*").alias("extracted"))
    out = answers.select(by).join(number, by, "left").join(matched, by, "left").na.fill(0, ["extracted", "matched", "pages"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select(by, "extracted", "matched", share("matched", "extracted").alias("source_accuracy"), share("pages", "matched").alias("page_precision"))


def overall_citation_score(source_accuracy: Column, page_precision: Column, faithfulness: Column, completeness: Column, risk: Column) -> Column:
    """The weighted whole."""
    return 0.3 * source_accuracy + 0.2 * page_precision + 0.3 * faithfulness + 0.1 * completeness + 0.1 * (1 - risk)


#: What evaluate() averages over answers.
BATCH_MEANS = ("source_accuracy", "page_precision", "faithfulness_score", "completeness", "hallucination_risk", "overall_citation_score")


def evaluate(answers: DataFrame, chunks: DataFrame, by: str = "answer_id", answer: str = "answer", top: int = 3) -> DataFrame:
    """The whole evaluation of each answer's citations (A18, M13): what citation_scores gives, and faithfulness and risk
    against the retrieved contents together, completeness (the share of distinct sources of the first ``top`` chunks that a
    citation names; 0 without citations or chunks), whether the true source and page were found by the first citation or
    the first chunk of that source, and the weighted whole.

    answers: by, answer, and where they are known ground_truth_source and ground_truth_page. chunks: by, rank, source,
    page, content; those of an answer are a few. An answer without chunks has no context: it is not faithful, and at risk.
    """
    from siltstone.functions.text import faithfulness, hallucination_risk

    for c, kind in (("ground_truth_source", "string"), ("ground_truth_page", "int")):
        answers = answers if c in answers.columns else answers.withColumn(c, F.lit(None).cast(kind))
    listed = F.array_sort(F.collect_list(F.struct("rank", "source", F.col("page").cast("int").alias("page"), "content")))
    rows = answers.select(by, F.col(answer).alias("_answer"), F.coalesce("ground_truth_source", F.lit("")).alias("_source"), F.coalesce(F.col("ground_truth_page").cast("int"), F.lit(0)).alias("_page"), citations(F.col(answer)).alias("_cited"))
    rows = rows.join(chunks.groupBy(by).agg(listed.alias("_chunks")), by, "left")
    none = F.from_json(F.lit("[]"), rows.schema["_chunks"].dataType)
    rows = rows.withColumn("_chunks", F.coalesce("_chunks", none)).withColumn("_context", F.array_join(F.transform("_chunks", lambda c: F.coalesce(c["content"], F.lit(""))), "\n"))
    known = F.array_distinct(F.transform(F.slice("_chunks", 1, top), lambda c: source_name(c["source"])))
    named = F.array_distinct(F.transform("_cited", lambda c: source_name(c["source"])))
    rows = rows.withColumn("_known", known).withColumn("_named", named)
    met = F.size(F.filter("_known", lambda s: F.exists("_named", lambda c: sources_match(s, c))))
    first = lambda of: F.get(F.filter(of, lambda x: sources_match(x["source"], F.col("_source"))), F.lit(0))
    rows = rows.withColumn("_first_cited", first("_cited")).withColumn("_first_chunk", first("_chunks"))
    paged = lambda x: (F.col("_page") != 0) & (F.coalesce(x["page"], F.lit(0)) == F.col("_page"))
    found = F.col("_first_cited").isNotNull() | F.col("_first_chunk").isNotNull()
    rows = rows.select(
        by, F.when(F.size("_named") == 0, 0.0).when(F.size("_known") == 0, 0.0).otherwise(met / F.size("_known")).alias("completeness"), ((F.col("_source") != "") & found).alias("ground_truth_source_found"),
        ((F.col("_source") != "") & (F.coalesce(paged(F.col("_first_cited")), F.lit(False)) | F.coalesce(paged(F.col("_first_chunk")), F.lit(False)))).alias("ground_truth_page_found"),
        faithfulness(F.col("_answer"), F.col("_context")).alias("faithfulness_score"), hallucination_risk(F.col("_answer"), F.col("_context")).alias("hallucination_risk"),
    )
    out = citation_scores(answers, chunks, by, answer).join(rows, by)
    return out.withColumn("overall_citation_score", overall_citation_score(F.col("source_accuracy"), F.col("page_precision"), F.col("faithfulness_score"), F.col("completeness"), F.col("hallucination_risk")))


def batch_means(evaluated: DataFrame) -> DataFrame:
    """The seven means over a batch of evaluated answers, as one row; no row without answers."""
    rate = F.avg(F.col("ground_truth_source_found").cast("int")).alias("ground_truth_found_rate")
    means = evaluated.agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in BATCH_MEANS], rate)
    return means.filter("n > 0")


def match_score(segment: Column, content: Column) -> Column:
    """How well a segment matches a chunk: shares of its terms, numbers and words, weighed 0.4, 0.4, 0.2, or evenly where
    only two of them are there (X27)."""
    stop = F.array(*map(F.lit, ANSWER_STOPWORDS))
    words = lambda t: F.array_except(split_words(squeezed(F.lower(t))), stop)
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(UNIT_NUMBER), F.lit(0)))
    share = lambda f: covered(f(segment), f(content), -1.0)
    present = F.filter(F.array(share(terms), share(numbers), share(words)), lambda x: x >= 0)

    empty = (F.coalesce(segment, F.lit("")) == "") | (F.coalesce(content, F.lit("")) == "")
    return F.when(empty, 0.0).otherwise(let(present, _mean))


def _mean(s: Column) -> Column:
    at = lambda k: F.coalesce(F.get(s, F.lit(k)), F.lit(0.0))
    return F.when(F.size(s) == 3, 0.4 * at(0) + 0.4 * at(1) + 0.2 * at(2)).when(F.size(s) == 2, 0.5 * at(0) + 0.5 * at(1)).otherwise(at(0))


def answer_sentences(text: str | None) -> list[str]:
    """Sentences with their ends; fragments of 20 characters or less go with what follows."""
    text = text or ""
    out, start = [], 0
    for m in SENTENCE_END.finditer(text):
        if len(text[start : m.end()].strip()) > 20:
            out.append(text[start : m.end()].strip())
            start = m.end()
    if rest := text[start:].strip():
        out.append(rest)
    return out or [text.strip()]


def grounded(answers: DataFrame, chunks: DataFrame, by: str = "answer_id", answer: str = "answer", least: float = 0.3, reranked: Column | None = None) -> DataFrame:
    """Answers whose citations are replaced by those of the retrieved chunks that their sentences match.

    Of a sentence, the chunk of the best score of ``least`` or more counts, the first by rank on ties. Returns by,
    grounded_text, citations_removed, citations_added, confidence (0.6 mean score + 0.4 share of matched sentences).
    """

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(answer_sentences)

    clean = answers.select(by, without_citations(F.col(answer)).alias("c")).select(by, F.col("c.text").alias("text"), F.col("c.removed").alias("citations_removed"))
    parts = clean.select(by, "citations_removed", F.posexplode(split(F.col("text"))).alias("n", "sentence"))
    score = match_score(F.col("sentence"), F.col("content")) if reranked is None else reranked
    met = parts.select(by, "n", "sentence").join(chunks.select(by, "rank", "source", "page", "content"), by).withColumn("score", score).filter(F.col("score") >= least)
    best = met.groupBy(by, "n").agg(F.max_by(F.struct("source", "page", "score", "rank"), F.struct("score", -F.col("rank"))).alias("best"))
    name = squeezed(F.replace(F.regexp_replace(F.col("best.source"), r"(?i)\.(md|json|pdf|txt)$", ""), F.lit("_"), F.lit(" ")))
    paged = (F.col("best.page").isNotNull()) & (F.col("best.page") != 0)
    cite = F.concat(F.lit("["), name, F.when(paged, F.concat(F.lit(", p."), F.col("best.page").cast("string"))).otherwise(F.lit("")), F.lit("]"))
    rows = parts.join(best, [by, "n"], "left").select(by, "n", "citations_removed", F.when(F.col("best").isNull(), F.col("sentence")).otherwise(F.concat_ws(" ", "sentence", cite)).alias("part"), F.col("best.score").alias("score"), F.when(F.col("best").isNotNull(), F.concat(name, F.when(paged, F.concat(F.lit(", page "), F.col("best.page").cast("string"))).otherwise(F.lit("")))).alias("reference"))
    joined = rows.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("n", "part"))).alias("parts"), F.array_sort(F.collect_list(F.struct("n", "reference"))).alias("references"), F.first("citations_removed").alias("citations_removed"),
        F.count("score").alias("citations_added"), F.coalesce(0.6 * F.avg("score") + 0.4 * F.count("score") / F.count("*"), F.lit(0.0)).alias("confidence"),
    )
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["part"]), " "), r"\s+", " "), r"\s+([.,;:!?])", "$1")
    known = F.array_distinct(F.filter(F.transform("references", lambda x: x["reference"]), lambda x: x.isNotNull()))
    listed = F.when(F.size(known) > 0, F.concat(F.lit("\n\nReferences:\n"), F.array_join(F.transform(known, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))).otherwise(F.lit(""))
    return joined.select(by, F.concat(text, listed).alias("grounded_text"), "citations_removed", "citations_added", "confidence")


def source_line(answers: DataFrame, chunks: DataFrame, by: str = "answer_id", answer: str = "answer", least: float = 0.3, k: int = 3) -> DataFrame:
    """The answer without citations, and its k best matching sources on a line."""
    clean = answers.select(by, without_citations(F.col(answer))["text"].alias("text"))
    met = clean.join(chunks.select(by, "rank", "source", "page", "content"), by).withColumn("score", match_score(F.col("text"), F.col("content"))).filter(F.col("score") >= least)
    top = met.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "rank"))).filter(F.col("k") <= k)
    shown = F.when(F.col("page").isNotNull() & (F.col("page") != 0), F.concat("source", F.lit(" (p."), F.col("page").cast("string"), F.lit(")"))).otherwise(F.col("source"))
    lines = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", shown.alias("s")))).alias("s"))
    sources = F.concat(F.lit("\n\nSource(s): "), F.array_join(F.transform("s", lambda x: x["s"]), ", "))
    return clean.join(lines, by, "left").select(by, F.concat("text", F.coalesce(sources, F.lit(""))).alias("text"))


def doc_citation_scores(cited: Column, gold: Column, retrieved: Column) -> list[Column]:
    """citation_present, cited_doc_count, cites_gold (null without gold), cited_in_context, of normalised names."""
    name = source_name(gold)
    known = F.transform(F.coalesce(retrieved, F.array().cast("array<string>")), source_name)
    return [(F.size(cited) > 0).alias("citation_present"), F.size(cited).alias("cited_doc_count"), F.when(name != "", F.array_contains(cited, name)).alias("cites_gold"), F.arrays_overlap(cited, known).alias("cited_in_context")]
