"""Queries of the text functions, chunkers and parsers over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import parsing, text as T
from siltstone.operators import chunking, grounding, prep

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL pieces, with the same explicit classes as the functions -------------------------------------------------

S = "[ \\t\\n\\r\\f]+"
NON_WORD = "[^\\p{L}\\p{N}_ \\t\\n\\r\\f]"


def sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S}', ' ', 'g'))"


def norm(x: str) -> str:
    return sq(f"regexp_replace(lower({x}), '{NON_WORD}', ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def answer_tokens(x: str) -> str:
    return f"list_filter({words(sq(f'lower({x})'))}, lambda w: NOT list_contains({sql_list(T.ANSWER_STOPWORDS)}, w))"


def keyword_tokens(x: str) -> str:
    gap, edge, after = "[ \\t\\n\\r\\f]*/[ \\t\\n\\r\\f]*", "(^|[^\\p{L}_])", "($|[^\\p{L}\\p{N}_])"
    t = f"regexp_replace(lower({x}), '([0-9]+(?:\\.[0-9]+)?)[ \\t\\n\\r\\f]*[-–][ \\t\\n\\r\\f]*([0-9]+(?:\\.[0-9]+)?)', '\\1-\\2 ', 'g')"
    t = f"regexp_replace({t}, '{edge}({T.UNITS}){gap}({T.PER}){gap}({T.PER}){after}', '\\1 \\2_per_\\3_per_\\4 \\5', 'g')"
    t = f"regexp_replace({t}, '{edge}({T.UNITS}){gap}({T.PER}){after}', '\\1 \\2_per_\\3 \\4', 'g')"
    t = f"regexp_replace({t}, '([0-9]+(?:\\.[0-9]+)?-[0-9]+(?:\\.[0-9]+)?)|[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f]', '\\1 ', 'g')"
    return f"list_filter(list_transform({words(sq(t))}, lambda w: regexp_replace(w, '^_+|_+$', '', 'g')), lambda w: (length(w) > 1 AND NOT list_contains({sql_list(T.KEYWORD_STOPWORDS)}, w)) OR w IN ('k', 'l'))"


def grams3(w: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - 1, 1)), lambda i: array_to_string({w}[i:i + 2], ' ')))"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def found(x: str, pattern: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '{pattern}'))"


def terms(x: str, families) -> str:
    return "list_distinct(list_transform(flatten([" + ", ".join(f"regexp_extract_all(lower({x}), '{p}')" for p in families) + "]), lambda w: trim(w)))"


# --- tokens and normal forms -------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {keyword_tokens('text')} AS t FROM documents)")
def keyword_tokens_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.keyword_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("SELECT item_id, " + keyword_tokens("'Give ' || (item_id % 7) || ' - ' || (item_id % 9 + 1) || ' g/kg/day or ' || item_id || ' mL / hr, not 0.5-1.0 mEq/dL: ' || text") + " AS tokens FROM benchmark")
def keyword_tokens_doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lambda c: c.cast("string")
    n = F.col("item_id")
    # a dose is put before each passage, so that both meet the tokenizer
    text = F.concat(F.lit("Give "), i(n % 7), F.lit(" - "), i(n % 9 + 1), F.lit(" g/kg/day or "), i(n), F.lit(" mL / hr, not 0.5-1.0 mEq/dL: "), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", T.keyword_tokens(text).alias("tokens"))


@query(f"SELECT doc_id, length(n) AS n_chars_normal, md5(n) AS normal_md5 FROM (SELECT doc_id, {norm('text')} AS n FROM documents)")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text")).alias("n"))
    return rows.select("doc_id", F.length("n").cast("long").alias("n_chars_normal"), F.md5("n").alias("normal_md5"))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, question, answer: the last user and assistant message of each conversation."""
    return prep.legacy_records(table(spark, sf_dir, "conversations"))


EXCHANGES = "WITH x AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS question, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer, count(*) AS n_messages FROM conversations GROUP BY conv_id), e AS (SELECT conv_id, coalesce(question, '') AS q, coalesce(answer, '') AS a FROM x)\n"


@query(EXCHANGES + "SELECT conv_id, md5(question) AS question_md5, md5(answer) AS answer_md5, n_messages FROM x")
def legacy_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges(spark, sf_dir).select("conv_id", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"), "n_messages")


def _qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.lit("")
    return exchanges(spark, sf_dir).select("conv_id", F.coalesce("question", e).alias("q"), F.coalesce("answer", e).alias("a"))


@query(EXCHANGES + f", t AS (SELECT *, list_distinct({answer_tokens('a')}) AS g, list_distinct({answer_tokens('q')}) AS r FROM e) SELECT conv_id, CASE WHEN len(g) = 0 AND len(r) = 0 THEN 1.0 WHEN len(g) = 0 OR len(r) = 0 THEN 0.0 ELSE 2 * {shared('g', 'r')} / (len(g) + len(r)) END AS f1, CAST({norm('a')} = {norm('q')} AS DOUBLE) AS exact_match FROM t")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qa(spark, sf_dir).select("conv_id", T.token_f1(F.col("a"), F.col("q")).alias("f1"), T.exact_match(F.col("a"), F.col("q")).alias("exact_match"))


def _cover(a: str, c: str, other: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN {other} ELSE {shared(a, c)} / len({a}) END"


#: A document answers with its text; the context is the passage of the benchmark item whose place is its id modulo the items.
CONTEXT = "WITH n AS (SELECT greatest(count(*), 1) AS n FROM benchmark), p AS (SELECT text, row_number() OVER (ORDER BY item_id, text) - 1 AS place FROM benchmark), c AS (SELECT d.doc_id, d.text AS a, p.text AS c FROM documents d CROSS JOIN n LEFT JOIN p ON p.place = coalesce(d.doc_id, 0) % n.n), w AS (SELECT *, {aw} AS aw, {cw} AS cw FROM c), s AS (SELECT *, {at} AS a_t, {ct} AS c_t, {ag} AS ag, {cg} AS cg, {an} AS an, {cn} AS cn FROM w)\n".format(
    aw=words(sq("lower(a)")), cw=words(sq("lower(c)")), at=terms("a", T.CITATION_TERMS), ct=terms("c", T.CITATION_TERMS), ag=f"CASE WHEN len(aw) < 3 THEN [] ELSE {grams3('aw')} END", cg=f"CASE WHEN len(cw) < 3 THEN [] ELSE {grams3('cw')} END", an=found("a", "\\d+\\.?\\d*"), cn=found("c", "\\d+\\.?\\d*"),
)


def _numbered(items: DataFrame) -> DataFrame:
    """n: the place of each item by id, from 0. Places are counted within blocks of 4,096 ids, so that no task sorts all items."""
    block = F.coalesce(F.floor(F.col("item_id") / 4096), F.lit(-1))
    items = items.withColumn("block", block)
    sizes = items.groupBy("block").agg(F.count("*").alias("size"))
    starts = sizes.select("block", (F.sum("size").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("start"))
    place = F.row_number().over(W.partitionBy("block").orderBy("item_id", "text")) - 1
    return items.withColumn("place", place).join(starts, "block").withColumn("n", F.col("start") + F.col("place")).drop("block", "start", "place")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with one benchmark item: document ids modulo the number of items meet the items' places, so that
    ids without gaps reach every item, whatever the item ids are. Without any item a document stands alone."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    total = items.agg(F.count("*").alias("n_items"))
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(total)).withColumn("n", F.pmod(F.coalesce("doc_id", F.lit(0)), F.greatest("n_items", F.lit(1))))
    return docs.drop("n_items").join(_numbered(items).withColumnRenamed("text", "passage"), "n", "left").drop("n")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).select("doc_id", F.col("text").alias("a"), F.col("passage").alias("c"))


@query(CONTEXT + f"SELECT doc_id, CAST(floor((CASE WHEN a = '' OR c = '' THEN 0.0 ELSE least(1.0, 0.4 * ({_cover('a_t', 'c_t', '1.0')}) + 0.3 * ({_cover('ag', 'cg', '0.0')}) + 0.3 * ({_cover('an', 'cn', '1.0')})) END) * 1e6 + 0.5) AS BIGINT) AS faithfulness_millionths FROM s")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).select("doc_id", F.floor(T.faithfulness(F.col("a"), F.col("c")) * 1e6 + 0.5).cast("long").alias("faithfulness_millionths"))


_CLAIMS = f"list_filter({sql_list(T.ABSOLUTE)}, lambda w: regexp_matches(lower({{}}), '\\b' || w || '\\b'))"


@query(CONTEXT + f""", f AS (SELECT doc_id, a, c, CASE WHEN len(an) > 0 THEN 1 - {shared('an', 'cn')} / len(an) END AS f1, {_CLAIMS.format('a')} AS cl, c AS cc FROM s),
 g AS (SELECT *, CASE WHEN len(cl) > 0 THEN 1 - len(list_filter(cl, lambda w: regexp_matches(lower(cc), '\\b' || w || '\\b'))) / len(cl) END AS f2, CASE WHEN len(list_filter(list_distinct(regexp_extract_all(lower(a), '\\b(?:mg|mcg|g|ml)/(?:kg|day|hr)\\b')), lambda x: NOT list_contains(regexp_extract_all(lower(c), '\\b(?:mg|mcg|g|ml)/(?:kg|day|hr)\\b'), x))) > 0 THEN 0.8 END AS f3 FROM f)
SELECT doc_id, CAST(floor((CASE WHEN a = '' THEN 0.0 WHEN c = '' THEN 1.0 WHEN f1 IS NULL AND f2 IS NULL AND f3 IS NULL THEN 0.2 ELSE (coalesce(f1, 0) + coalesce(f2, 0) + coalesce(f3, 0)) / ((f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT + (f3 IS NOT NULL)::INT) END) * 1e6 + 0.5) AS BIGINT) AS risk_millionths FROM g""")
def hallucination_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).select("doc_id", F.floor(T.hallucination_risk(F.col("a"), F.col("c")) * 1e6 + 0.5).cast("long").alias("risk_millionths"))


@query(f"SELECT doc_id, len(t) AS n_terms, array_to_string(list_sort(t), ',') AS terms FROM (SELECT doc_id, {terms('text', T.TERMS)} AS t FROM documents)")
def clinical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.terms(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.array_join(F.array_sort("t"), ",").alias("terms"))


# --- citations ---------------------------------------------------------------------------------------------------

CITED = "'See [' || source || '_notes.md; Doc-' || lang || '] and (Source: ' || source || ', p.' || (doc_id % 90) || '). ' || text || ' According to the ' || lang || ' guide (page ' || (doc_id % 7) || ') [12; ' || source || ']'"


def cited(c: str = "text") -> Column:
    s = lambda x: x.cast("string")
    n = F.col("doc_id")
    return F.concat(F.lit("See ["), "source", F.lit("_notes.md; Doc-"), "lang", F.lit("] and (Source: "), "source", F.lit(", p."), s(n % 90), F.lit("). "), c, F.lit(" According to the "), "lang", F.lit(" guide (page "), s(n % 7), F.lit(") [12; "), "source", F.lit("]"))


_DOC_NAMES = f"""list_distinct(list_filter(list_transform(list_filter(list_transform(flatten(list_transform(regexp_extract_all({CITED}, '\\[([^\\[\\]]+?)\\]', 1), lambda x: regexp_split_to_array(x, '[;,]\\s*'))), lambda p: trim(p)), lambda p: regexp_matches(p, '[A-Za-z]')),
  lambda p: {sq("regexp_replace(regexp_replace(lower(p), '\\.(md|json|pdf|txt)$', ''), '[_\\-]+', ' ', 'g')")}), lambda p: p <> ''))"""


@query(f"SELECT doc_id, array_to_string(list_sort(c), '|') AS cited, len(c) AS cited_doc_count, list_contains(c, source || ' notes') AS cites_gold FROM (SELECT doc_id, source, {_DOC_NAMES} AS c FROM documents)")
def doc_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", T.doc_citations(cited()).alias("c"))
    scores = grounding.doc_citation_scores(F.col("c"), F.concat("source", F.lit("-notes.pdf")), F.array("source"))
    return rows.select("doc_id", F.array_join(F.array_sort("c"), "|").alias("cited"), *scores[1:3])


@query()
def citation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.without_citations(cited()).alias("c"))
    return rows.select("doc_id", F.length("c.text").alias("n_chars_left"), F.md5("c.text").alias("text_md5"), F.col("c.removed").alias("removed"))


@query()
def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    answers = docs.select(F.col("doc_id").alias("answer_id"), cited().alias("answer"))
    chunks = docs.select(F.col("doc_id").alias("answer_id"), F.posexplode(F.array(F.concat("source", F.lit(".md")), F.concat("lang", F.lit("_guide.pdf")))).alias("rank", "source"), (F.col("doc_id") % 90).cast("int").alias("page"))
    return grounding.citation_scores(answers, chunks)


@query()
def ground_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _paired(spark, sf_dir)
    answers = pairs.select(F.col("doc_id").alias("answer_id"), cited().alias("answer"))
    chunks = pairs.select(F.col("doc_id").alias("answer_id"), F.lit(1).alias("rank"), F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("source"), F.lit(3).alias("page"), F.col("passage").alias("content"))
    return grounding.grounded(answers, chunks)


# --- answers -----------------------------------------------------------------------------------------------------

RAW = ("a, c", "ALL of the above", "none", " b ", "C, A and B", "not a letter")
#: Every other answer is what stands at some place of the document, as far as it is letters.
_SAID = "regexp_replace(substr(text, 1 + doc_id % 40, 14), '[^A-Za-z ,.]', '', 'g')"
PREDICTED = f"CASE WHEN doc_id % 2 = 0 THEN ({sql_list(RAW)})[doc_id % 6 + 1] ELSE {_SAID} END"
EXPECTED = f"CASE WHEN doc_id % 4 < 2 THEN ({sql_list(RAW)})[doc_id % 5 + 1] ELSE {_SAID} END"


def sql_answer(x: str) -> str:
    a = f"upper(trim({x}))"
    return f"CASE WHEN {a} IN ('ALL', 'ALL OF THE ABOVE') THEN 'ALL' WHEN {a} IN ('NONE', 'NONE OF THE ABOVE') THEN 'NONE' WHEN regexp_matches({a}, '\\b[A-F]\\b') THEN array_to_string(list_sort(list_distinct(regexp_extract_all({a}, '\\b([A-F])\\b', 1))), ',') ELSE {a} END"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(*map(F.lit, RAW))
    pick = lambda k: F.element_at(raw, (F.col("doc_id") % k + 1).cast("int"))
    said = F.regexp_replace(F.substring("text", 1 + F.col("doc_id") % 40, F.lit(14)), "[^A-Za-z ,.]", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, pick(6)).otherwise(said).alias("predicted"), F.when(F.col("doc_id") % 4 < 2, pick(5)).otherwise(said).alias("expected"))


@query(f"SELECT doc_id, {sql_answer(PREDICTED)} AS answer FROM documents")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("doc_id", T.normalize_answer(F.col("predicted")).alias("answer"))


@query(f"SELECT doc_id, p = e AS exact, p <> e AND contains(e, ',') AND len(list_intersect(string_split(p, ','), string_split(e, ','))) > 0 AS partial FROM (SELECT doc_id, {sql_answer(PREDICTED)} AS p, {sql_answer(EXPECTED)} AS e FROM documents)")
def answers_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact, partial = T.answers_match(F.col("predicted"), F.col("expected"))
    return _answers(spark, sf_dir).select("doc_id", exact.alias("exact"), partial.alias("partial"))


@query("""WITH r AS (SELECT item_id, item_id % 4 AS k, replace(text, '. ', (['||', chr(10), ' | ', '; '])[item_id % 4 + 1]) AS raw FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)),
 o AS (SELECT item_id, CASE WHEN k < 3 AND (k = 0 OR len(p) >= 2) AND contains(raw, (['||', chr(10), '|'])[k + 1]) THEN p END AS o FROM (SELECT *, list_filter(list_transform(string_split(raw, (['||', chr(10), '|', ';'])[k + 1]), lambda x: trim(x)), lambda x: x <> '') AS p FROM r))
SELECT item_id, len(o) AS n_options, o[1] AS first_option FROM o""")
def coerce_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sentences of an item, under each kind of delimiter and under none
    mark = F.element_at(F.array(F.lit("||"), F.lit("\n"), F.lit(" | "), F.lit("; ")), (F.col("item_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.coerce_options(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(". "), mark)).alias("o"))
    return rows.select("item_id", F.when(F.col("o").isNotNull(), F.size("o").cast("long")).alias("n_options"), F.get("o", F.lit(0)).alias("first_option"))


@query("SELECT item_id, 'the answer is ' || trim(split_part(trim(text), chr(10), 1)) AS final, item_id % 2 = 0 AS relevant, CASE WHEN item_id % 2 = 0 THEN '{\"answer\": \"C\"}' END AS json FROM benchmark")
def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("item_id") % 2 == 0
    answer = F.concat(F.lit("<think>Final answer: no</think> Final Answer: the answer is "), F.trim(F.substring_index(F.trim("text"), "\n", 1)), F.lit("\nWork: 1 + 1\nCitations: (none)"))
    verdict = F.when(even, 'Verdict: "Yes"').otherwise('It is "no", not yes')
    said = F.when(even, 'Here: {"answer": "C"} done').otherwise("nothing here")
    return table(spark, sf_dir, "benchmark").select("item_id", T.final_answer(T.without_thinking(answer)).alias("final"), T.judge_verdict(verdict).alias("relevant"), T.json_rescue(said).alias("json"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'calculate|compute|dose|dosing|mg/kg|g/kg|ml/kg') THEN 'dosage_calculation' WHEN regexp_matches(lower(text), 'normal range|reference|lab value|level') THEN 'reference_values' WHEN regexp_matches(lower(text), 'which of the following|best describes|most likely|least likely') THEN 'board_style' WHEN regexp_matches(lower(text), 'why|explain|mechanism|pathophysiology') THEN 'clinical_reasoning' ELSE 'general' END AS kind FROM documents")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.question_kind(F.col("text")).alias("kind"))


@query(EXCHANGES + f", t AS (SELECT conv_id, list_distinct({words(sq('lower(a)'))}) AS aw, list_distinct({words(sq('lower(q)'))}) AS qw FROM e) SELECT conv_id, CASE WHEN len(aw) = 0 THEN 0.0 ELSE least(1.0, {shared('aw', 'qw')} / least(len(aw), 50)) END AS grounding FROM t")
def grounding_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qa(spark, sf_dir).select("conv_id", T.grounding_estimate(F.col("a"), F.col("q")).alias("grounding"))


# --- queries and chunks ------------------------------------------------------------------------------------------

_T = sq("unnest(string_split(text, chr(10)))")


@query(f"WITH l AS (SELECT doc_id, {_T} AS t FROM documents), s AS (SELECT *, len({words('t')}) AS w, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS capitals FROM l) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE t = '' OR (NOT regexp_matches(t, '[0-9]') AND (length(t) < 40 OR w <= 6)) OR (letters > 0 AND capitals * 10 > letters * 9 AND w <= 10 AND length(t) <= 120)) AS n_low FROM s GROUP BY doc_id")
def low_value_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a count over a row's own lines needs no shuffle
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, T.low_value)).cast("long").alias("n_low"))


_CLAUSES = "(?i)\\s*(?:;|,|\\band\\b|\\bthen\\b|\\bwhile\\b|\\bversus\\b|\\bvs\\.?\\b)\\s*"


@query(f"""WITH f AS (SELECT item_id, trim(substr('An infant.. what dose, and which risk? ' || {sq('text')}, 1, 600)) AS t FROM benchmark),
 e AS (SELECT item_id, [t] || list_filter(list_transform(regexp_split_to_array(t, '{_CLAUSES}'), lambda c: {sq('c')}), lambda c: len({words('c')}) >= 4) || [t || ' recommended dosing range lower upper limits']
   || CASE WHEN regexp_matches(lower(t), 'monitor|lab|follow-up|surveillance') THEN [t || ' monitoring frequency thresholds safety parameters'] ELSE [] END || [t || ' complications prevention contraindications management'] AS every FROM f),
 d AS (SELECT item_id, list_filter(every, lambda x, i: list_position(list_transform(every, lambda y: lower(y)), lower(x)) = i)[1:3] AS kept FROM e)
SELECT item_id AS query_id, kept[k] AS plan_text, k = 1 AS is_original, k - 1 AS plan_no FROM d, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= len(kept)""")
def query_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.plans.retrieval import planned

    return planned(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Case context: An infant. Question: what dose, and which risk? "), "text").alias("text")))


@query(f"SELECT item_id, substr('A first note. ' || {sq('text')}, 1, 600) AS focus FROM benchmark")
def query_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Case  context: A first note. And a second one.\n\nQUESTION: "), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", T.focus_query(text).alias("focus"))


@query("SELECT doc_id, source, lang, CASE WHEN length(text) > 100 THEN 'long' ELSE 'short' END AS kind, md5(substr(text, 1, 500)) AS content_md5, 'Source: ' || source || chr(10) || 'Section: ' || lang || chr(10) || chr(10) || text AS contextual FROM documents WHERE NOT contains(text, 'CAPTION ERROR') AND (length(text) >= 20 OR starts_with(text, '#'))")
def contextual_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators.retrieval import content_key

    rows = prep.noise_chunks(table(spark, sf_dir, "documents"), "text")
    return rows.select("doc_id", "source", "lang", F.when(F.length("text") > 100, "long").otherwise("short").alias("kind"), content_key(F.col("text")).alias("content_md5"), prep.contextual(F.col("source"), F.col("lang"), F.col("text")).alias("contextual"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<a\\s+id=[''\"][0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}[''\"]\\s*>\\s*</a>', '', 'gi'), '(?s)<::.*?::>', '', 'g'), '(?im)^[ \\t]*CAPTION[ \\t]+ERROR[ \\t]*$', '', 'g'), '\\s+id=\"[^\"]*\"', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@query(f"SELECT page_id, length(t) AS n_chars_clean, md5(t) AS clean_md5 FROM (SELECT page_id, regexp_replace(regexp_replace({_CLEAN}, '[^\\S\\n]+(\\n|$)', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM pages)")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", chunking.cleaned_native(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars_clean"), F.md5("t").alias("clean_md5"))


@query()
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<::logo: a mark::>\n<::Step 1. Calculate the mg/kg dose.\nStep 2. Monitor it for some hours, then go on.::>\n\n\n\nCAPTION ERROR\n"), "html").alias("text"))
    return chunking.cleaning_stats(rows.withColumn("clean", chunking.cleaned(F.col("text")))).drop("text").withColumn("clean", F.md5("clean"))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.functions.models import hashed_embedding

    return chunking.semantic_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), hashed_embedding)


@query()
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(chunk_recursive(spark, sf_dir))


@query()
def parse_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, ("The answer is not A. Answer: C", r"So \boxed{B}", "Answer: A, C, D", "Answer: B. Actually, Answer: C", "I would choose D, highly confident", "**E**", "unsure", "A and C", "")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", F.element_at(said, (F.col("doc_id") % 9 + 1).cast("int"))).alias("response"))
    return rows.withColumn("p", parsing.parsed_choice("response")).select("doc_id", "p.answer", "p.confidence", F.length("p.thinking").alias("n_thinking"))


@query()
def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(parsing.extracted_quantities("text")).alias("q")).select("doc_id", "q.*")


@query()
def calc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(n, F.lit(" g/day and 3-4 mL/kg/hr. "), "text").alias("expected"), F.concat(n, F.lit("000 mg/day, then 5 mL/kg/day")).alias("output"))
    return rows.select("doc_id", parsing.scored_calculation("expected", "output").alias("m"), parsing.targets("expected").alias("t")).select("doc_id", "m.*", "t.multi_value_key_count", "t.is_single_target")
