"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the keyword tokenizer drops.
KEYWORD_STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought",
    "used", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above", "below",
    "between", "out", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "each",
    "every", "both", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "and", "but", "or", "if", "while", "because", "until", "that",
    "which", "who", "whom", "this", "these", "those", "it", "its",
    "i", "me", "my", "we", "our", "you", "your", "he", "him", "his",
    "she", "her", "they", "them", "their", "what",
)
# Words that token F1 drops.
ANSWER_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "and", "or", "but", "if", "then",
    "than", "that", "this", "to", "of", "in", "on", "at", "for", "with",
    "by", "from",
)
# The families of clinical terms, for lower-case text. The last is not part of the citation metrics.
DOSE = r"\d+\.?\d*\s*(?:mg|g|kg|ml|mcg|iu|mmol|meq)/(?:kg|day|hr|l)"
AMOUNT_RANGE = r"\d+\s*(?:to|-)\s*\d+\s*(?:mg|g|kg|ml|%)"
POPULATION = r"(?:preterm|term|neonate|infant|pediatric)"
NUTRIENT, NUTRIENT_FAT = r"(?:protein|amino acid|lipid|glucose|dextrose)", r"(?:protein|amino acid|lipid|glucose|dextrose|fat)"
MINERAL, MINERAL_ZINC = r"(?:calcium|phosphorus|sodium|potassium|magnesium)", r"(?:calcium|phosphorus|sodium|potassium|magnesium|zinc)"
GUIDELINE = r"(?:aspen|espghan|aap)"
TERMS = (DOSE, AMOUNT_RANGE, POPULATION, NUTRIENT_FAT, MINERAL_ZINC, GUIDELINE)
CITATION_TERMS = (DOSE, AMOUNT_RANGE, POPULATION, NUTRIENT, MINERAL)
NUMBER = r"\d+\.?\d*"
# Absolute claims, and doses per weight or time.
ABSOLUTE = ("always", "never", "must", "exactly", "definitely", "required", "mandatory")
DOSE_UNIT = r"\b(?:mg|mcg|g|ml)/(?:kg|day|hr)\b"

#: White space and word characters by explicit classes, which mean the same to every engine.
SPACE, NON_WORD = r"[ \t\n\r\f]+", r"[^\p{L}\p{N}_ \t\n\r\f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeezed(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalized(text: Column) -> Column:
    """Lower case, punctuation to spaces, white space collapsed."""
    return squeezed(F.regexp_replace(F.lower(text), NON_WORD, " "))


def split_words(text: Column) -> Column:
    """The words of squeezed text; none for an empty one."""
    return F.array_remove(F.split(text, " "), "")


def answer_tokens(text: Column) -> Column:
    """Lower-case words without the answer stopwords, punctuation kept."""
    stop = F.array(*map(F.lit, ANSWER_STOPWORDS))
    return let(stop, lambda s: F.filter(split_words(squeezed(F.lower(text))), lambda w: ~F.array_contains(s, w)))


# Units of doses and what they are given per, longest first.
UNITS = "mcg|mmol|kcal|meq|units|unit|cal|mg|ml|iu|g"
PER = "dose|hour|day|min|kg|dl|hr|d|l"


#: A numeric range with what word characters lead it, or a run of word characters.
TOKEN = r"[\p{L}\p{N}_]*?[0-9]+(?:\.[0-9]+)?-[0-9]+(?:\.[0-9]+)?|[\p{L}\p{N}_]+"


def keyword_tokens(text: Column) -> Column:
    """Tokens of the keyword index (X01, X02): numeric ranges stay whole, doses such as g/kg/day become one token with
    _per_ between, other punctuation parts words; stopwords and single characters but k and l are dropped.

    Each pass is taken only by texts that have its signs, which a look for a character or two tells.
    """
    edge, after, gap = r"(^|[^\p{L}_])", r"($|[^\p{L}\p{N}_])", r"[ \t\n\r\f]*/[ \t\n\r\f]*"

    def ranged(t: Column) -> Column:
        joined = F.regexp_replace(t, r"([0-9]+(?:\.[0-9]+)?)[ \t\n\r\f]*[-–][ \t\n\r\f]*([0-9]+(?:\.[0-9]+)?)", "$1-$2 ")
        return F.when(t.rlike(r"[0-9][ \t\n\r\f]*[-–][ \t\n\r\f]*[0-9]"), joined).otherwise(t)

    def dosed(t: Column) -> Column:
        twice = F.regexp_replace(t, f"{edge}({UNITS}){gap}({PER}){gap}({PER}){after}", "$1 $2_per_$3_per_$4 $5")
        return F.when(t.contains("/"), F.regexp_replace(twice, f"{edge}({UNITS}){gap}({PER}){after}", "$1 $2_per_$3 $4")).otherwise(t)

    def parted(t: Column) -> Column:
        words = F.when(t.rlike("[0-9]-[0-9]"), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))).otherwise(F.split(t, r"[^\p{L}\p{N}_]+"))
        words = F.when(t.contains("_"), F.transform(words, lambda w: F.btrim(w, F.lit("_")))).otherwise(words)
        # a list of this length is looked up in a hash set
        return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*KEYWORD_STOPWORDS) | w.isin("k", "l"))

    return let(let(let(F.lower(text), ranged), dosed), parted)


def char_grams(text: Column, n: int = 5, hashed: bool = False) -> Column:
    """The distinct character n-grams of normalised text without spaces; a shorter text is one itself (X19). hashed: as
    64-bit numbers, which sets compare faster."""
    packed = F.replace(normalized(text), F.lit(" "), F.lit(""))

    def grams(t: Column) -> Column:
        # a character is consumed and the window looked ahead to, so that windows overlap and no character is split
        windows = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
        whole = F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(windows)
        return F.array_distinct(F.transform(whole, lambda g: F.xxhash64(g)) if hashed else whole)

    return let(packed, grams)


def word_grams(words: Column, n: int = 3, hashed: bool = False) -> Column:
    """The distinct word n-grams (X18). hashed: as 64-bit numbers."""
    one = F.xxhash64 if hashed else lambda *parts: F.concat_ws(" ", *parts)

    def grams(w: Column) -> Column:
        every = F.transform(w, lambda x, i: one(x, *[F.get(w, i + k) for k in range(1, n)]))
        return F.when(F.size(w) < n, F.array().cast("array<bigint>" if hashed else "array<string>")).otherwise(F.array_distinct(F.slice(every, 1, F.greatest(F.size(w) - (n - 1), F.lit(1)))))

    return let(words, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays of distinct items; two empty ones are equal."""
    def of(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        union = F.size(x["a"]) + F.size(x["b"]) - both
        return F.when(union == 0, 1.0).otherwise(both / union)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def covered(part: Column, whole: Column, otherwise: float) -> Column:
    """The share of distinct items of part that are in whole; otherwise, where part is empty."""
    return let(F.struct(part.alias("a"), whole.alias("b")), lambda x: F.when(F.size(x["a"]) == 0, otherwise).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_distinct(x["a"]))))


def found(text: Column, pattern: str) -> Column:
    """The distinct matches of a pattern."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def terms(text: Column, families: tuple[str, ...] = TERMS) -> Column:
    """The distinct clinical terms of a text, in lower case."""
    low = F.lower(text)
    return let(low, lambda t: F.array_distinct(F.transform(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in families])), lambda x: F.trim(x))))


def token_f1(generated: Column, reference: Column) -> Column:
    """F1 of the token sets; 1 if both are empty."""
    def f1(x: Column) -> Column:
        g, r = F.size(F.array_distinct(x["g"])), F.size(F.array_distinct(x["r"]))
        both = F.size(F.array_intersect(x["g"], x["r"]))
        # 2pr / (p + r) with p = both / g and r = both / r
        return F.when((g == 0) & (r == 0), 1.0).when((g == 0) | (r == 0), 0.0).otherwise(2 * both / (g + r))

    return let(F.struct(answer_tokens(generated).alias("g"), answer_tokens(reference).alias("r")), f1)


def exact_match(generated: Column, reference: Column) -> Column:
    return (normalized(generated) == normalized(reference)).cast("double")


def key_phrase_overlap(generated: Column, reference: Column) -> Column:
    """The share of the reference's terms that the answer has; without such terms 1 if the answer has none either."""
    return let(F.struct(terms(generated).alias("g"), terms(reference).alias("r")), lambda x: F.when(F.size(x["r"]) > 0, F.size(F.array_intersect(x["g"], x["r"])) / F.size(x["r"])).when(F.size(x["g"]) == 0, 1.0).otherwise(0.0))


def citation_match(generated: Column, source: Column, page: Column) -> Column:
    """Whether the answer names the source, or a source's page as p.N."""
    clean = F.trim(F.lower(F.replace(F.regexp_replace(source, r"(?i)\.(md|json|pdf|txt)$", ""), F.lit("_"), F.lit(" "))))
    named = (clean != "") & F.contains(F.lower(generated), clean)
    paged = page.isNotNull() & F.contains(generated, F.concat(F.lit("p."), page.cast("string")))
    return F.coalesce((F.coalesce(source, F.lit("")) != "") & (F.coalesce(named, F.lit(False)) | F.coalesce(paged, F.lit(False))), F.lit(False))


def faithfulness(answer: Column, context: Column) -> Column:
    """How much of an answer the context supports: 0.4 terms, 0.3 word 3-grams, 0.3 numbers."""
    a, c = F.lower(answer), F.lower(context)
    words = lambda t: split_words(squeezed(t))
    score = 0.4 * covered(terms(answer, CITATION_TERMS), terms(context, CITATION_TERMS), 1.0) + 0.3 * covered(word_grams(words(a), hashed=True), word_grams(words(c), hashed=True), 0.0) + 0.3 * covered(found(answer, NUMBER), found(context, NUMBER), 1.0)
    empty = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(context, F.lit("")) == "")
    return F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), score))


def hallucination_risk(answer: Column, context: Column) -> Column:
    """The mean of the risk factors that apply: numbers, absolute claims and doses which the context lacks."""
    low_a, low_c = F.lower(answer), F.lower(context)
    numbers = covered(found(answer, NUMBER), found(context, NUMBER), -1.0)
    claims = F.filter(F.array(*map(F.lit, ABSOLUTE)), lambda w: F.regexp_like(low_a, F.concat(F.lit(r"\b"), w, F.lit(r"\b"))))
    backed = lambda ws: F.size(F.filter(ws, lambda w: F.regexp_like(low_c, F.concat(F.lit(r"\b"), w, F.lit(r"\b")))))
    absolute = let(claims, lambda ws: F.when(F.size(ws) > 0, 1 - backed(ws) / F.size(ws)))
    doses = F.when(F.size(F.array_except(found(low_a, DOSE_UNIT), found(low_c, DOSE_UNIT))) > 0, 0.8)
    factors = F.filter(F.array(F.when(numbers >= 0, 1 - numbers), absolute, doses), lambda x: x.isNotNull())
    mean = let(factors, lambda f: F.when(F.size(f) == 0, 0.2).otherwise(F.aggregate(f, F.lit(0.0), lambda s, x: s + x) / F.size(f)))
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).when(F.coalesce(context, F.lit("")) == "", 1.0).otherwise(mean)


def source_name(source: Column) -> Column:
    """A source name for comparison (X23, X24): lower case, no article or file extension, separators as single spaces."""
    s = F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), r"^(the |a )", "")
    s = F.regexp_replace(F.trim(s), r"\.(md|json|pdf|txt)$", "")
    return squeezed(F.regexp_replace(s, r"[_\-]+", " "))


def sources_match(a: Column, b: Column) -> Column:
    """Equal, one within the other, or half of the shorter one's words in common."""
    def of(x: Column) -> Column:
        words = lambda s: F.array_distinct(split_words(s))
        shared = F.size(F.array_intersect(words(x["a"]), words(x["b"])))
        fewest = F.least(F.size(words(x["a"])), F.size(words(x["b"])))
        return (x["a"] != "") & (x["b"] != "") & (F.contains(x["a"], x["b"]) | F.contains(x["b"], x["a"]) | (2 * shared >= fewest) & (fewest > 0))

    return let(F.struct(source_name(a).alias("a"), source_name(b).alias("b")), of)


def doc_citations(text: Column) -> Column:
    """The normalised names in square brackets, parted by semicolons or commas, that have a letter."""
    inside = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+?)\]"), F.lit(1))
    parts = F.flatten(F.transform(inside, lambda x: F.split(x, r"[;,]\s*")))
    named = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: p.rlike("[A-Za-z]"))
    clean = lambda p: squeezed(F.regexp_replace(F.regexp_replace(F.lower(p), r"\.(md|json|pdf|txt)$", ""), r"[_\-]+", " "))
    return F.array_distinct(F.filter(F.transform(named, clean), lambda p: p != ""))


# The forms of citations, in the order in which they are removed.
CITATION_FORMS = (
    r"\s*\[([^\]]+?),?\s*(?:p\.?|page)\s*\d+\]",
    r"\s*\[([^\]]+?)\](?!\()",
    r"\s*\((?:Source:\s*)?([^)]+?),?\s*(?:p\.?|page)\s*\d+\)",
    r"\s*According to (?:the )?[^(]+?\s*\((?:p\.?|page)\s*\d+\)",
)


def without_citations(text: Column) -> Column:
    """The text without citations of any form, and how many were removed: struct(text, removed)."""
    steps = F.array(*[F.lit(f"(?i){p}") for p in CITATION_FORMS])
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).alias("removed"))
    done = F.aggregate(steps, start, lambda acc, p: F.struct(F.regexp_replace(acc["text"], p, F.lit("")).alias("text"), (acc["removed"] + F.regexp_count(acc["text"], p)).alias("removed")))
    tidy = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\s+([.,;:])", "$1"))
    return let(done, lambda x: F.struct(tidy(x["text"]).alias("text"), x["removed"].alias("removed")))


def low_value(text: Column) -> Column:
    """Chunks that waste context: empty, short without digits, or short headings in capitals."""
    def of(t: Column) -> Column:
        words, digit = F.size(split_words(t)), t.rlike("[0-9]")
        letters, capitals = F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
        heading = (letters > 0) & (capitals * 10 > letters * 9) & (words <= 10) & (F.length(t) <= 120)
        return (t == "") | ~digit & ((F.length(t) < 40) | (words <= 6)) | heading

    return let(squeezed(F.coalesce(text, F.lit(""))), of)


def focus_query(text: Column, most: int = 600) -> Column:
    """The question after 'question:', led by the first sentence of what stands before it."""
    def of(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(r"(?i)\bquestion\s*:"))
        before = F.trim(F.regexp_replace(F.substring(t, F.lit(1), at - 1), r"(?i)\bcase\s*context\s*:\s*", ""))
        after = F.trim(F.regexp_replace(F.substring(t, at, F.length(t)), r"(?i)^question\s*:\s*", ""))
        hint = F.trim(F.substring_index(before, ". ", 1))
        both = F.when((hint != "") & (after != ""), F.concat_ws(". ", hint, after)).when(after != "", after).when(hint != "", hint).otherwise(t)
        return F.substring(F.when(at == 0, t).otherwise(both), 1, most)

    return let(squeezed(F.coalesce(text, F.lit(""))), of)


# What a query about such words is also asked for.
EXPANSIONS = (
    ("dose|dosage|requirement|mg/kg|g/kg", "recommended dosing range lower upper limits"),
    ("monitor|lab|follow-up|surveillance", "monitoring frequency thresholds safety parameters"),
    ("risk|complication|toxicity|adverse", "complications prevention contraindications management"),
)
CLAUSE = r"(?i)\s*(?:;|,|\band\b|\bthen\b|\bwhile\b|\bversus\b|\bvs\.?\b)\s*"


def decompose_query(text: Column, most: int = 3) -> Column:
    """The query, its clauses of four words or more, then its expansions; distinct but for case, at most so many."""
    def of(t: Column) -> Column:
        clauses = F.filter(F.transform(F.split(t, CLAUSE), squeezed), lambda c: F.size(split_words(c)) >= 4)
        more = F.filter(F.array(*[F.when(F.lower(t).rlike(words), F.concat_ws(" ", t, F.lit(suffix))) for words, suffix in EXPANSIONS]), lambda x: x.isNotNull())
        every = F.concat(F.array(t), clauses, more)
        first = F.filter(every, lambda x, i: ~F.exists(F.slice(every, 1, i), lambda y: F.lower(y) == F.lower(x)))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.slice(first, 1, most))

    return let(squeezed(F.coalesce(text, F.lit(""))), of)


def normalize_answer(answer: Column) -> Column:
    """ALL, NONE, the sorted distinct letters A-F, or the trimmed text in capitals."""
    def of(a: Column) -> Column:
        letters = F.array_sort(F.array_distinct(F.regexp_extract_all(a, F.lit(r"\b([A-F])\b"), F.lit(1))))
        return F.when(a.isin("ALL", "ALL OF THE ABOVE"), "ALL").when(a.isin("NONE", "NONE OF THE ABOVE"), "NONE").when(F.size(letters) > 0, F.array_join(letters, ",")).otherwise(a)

    return let(F.upper(F.trim(answer)), of)


def answers_match(predicted: Column, expected: Column) -> tuple[Column, Column]:
    """Whether answers are equal, and whether they share a letter of several expected ones (X11)."""
    p, e = normalize_answer(predicted), normalize_answer(expected)
    return p == e, (p != e) & F.contains(e, F.lit(",")) & F.arrays_overlap(F.split(p, ","), F.split(e, ","))


def coerce_options(raw: Column) -> Column:
    """Options from one delimited text: by ||, by lines (two at least), or by |; else null."""
    parts = lambda sep: F.filter(F.transform(F.split(raw, sep), lambda x: F.trim(x)), lambda x: x != "")
    lines = parts("\n")
    return F.when(F.contains(raw, F.lit("||")), parts(r"\|\|")).when(F.size(lines) >= 2, lines).when(F.contains(raw, F.lit("|")), parts(r"\|"))


def final_answer(text: Column) -> Column:
    """What stands after 'Final answer:' up to the work or citations; the whole text if there is no such header."""
    t = F.trim(F.coalesce(text, F.lit("")))
    got = F.trim(F.regexp_extract(t, r"(?is)final\s*answer\s*:\s*(.+?)(?:\n\s*(?:work|citations|sources)\s*:|$)", 1))
    return F.when(got != "", got).otherwise(t)


def without_thinking(text: Column) -> Column:
    """The text without <think> blocks."""
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def judge_verdict(text: Column) -> Column:
    """A relevance judge's verdict: a quoted yes or no, else whether it says yes; an error (null) keeps the chunk."""
    t = F.lower(text)
    return F.when(t.isNull() | F.contains(t, F.lit('"yes"')), True).when(F.contains(t, F.lit('"no"')), False).otherwise(F.contains(t, F.lit("yes")))


def json_rescue(text: Column) -> Column:
    """The text itself if it is JSON, else what stands from its first to its last brace if that is, else null."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(text).isNotNull(), text).when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


# Words that route a question to a kind of prompt, in order.
QUESTION_KINDS = (
    ("dosage_calculation", "calculate|compute|dose|dosing|mg/kg|g/kg|ml/kg"),
    ("reference_values", "normal range|reference|lab value|level"),
    ("board_style", "which of the following|best describes|most likely|least likely"),
    ("clinical_reasoning", "why|explain|mechanism|pathophysiology"),
)


def question_kind(text: Column) -> Column:
    """The first kind whose words a question has, else general (F16)."""
    out = F.lit("general")
    for kind, words in reversed(QUESTION_KINDS):
        out = F.when(F.lower(text).rlike(words), kind).otherwise(out)
    return out


def section_heading(text: Column) -> Column:
    """A # or ** heading among the first five lines, else the first line over 20 characters that is no tag, cut at 100,
    else Content (X34)."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 5), lambda x: F.trim(x))
    bold = lambda x: x.startswith("**") & x.endswith("**")

    def of(ls: Column) -> Column:
        head = F.get(F.filter(ls, lambda x: x.startswith("#") | bold(x)), F.lit(0))
        long = F.get(F.filter(ls, lambda x: (F.length(x) > 20) & ~x.startswith("<")), F.lit(0))
        name = F.when(head.startswith("#"), F.replace(head, F.lit("#"), F.lit(""))).otherwise(F.replace(head, F.lit("**"), F.lit("")))
        return F.coalesce(F.trim(name), F.substring(long, 1, 100), F.lit("Content"))

    return let(lines, of)


def grounding_estimate(answer: Column, context: Column) -> Column:
    """Shared distinct words over the answer's (50 at most counting), capped at 1."""
    words = lambda t: F.array_distinct(split_words(squeezed(F.lower(F.coalesce(t, F.lit(""))))))
    return let(F.struct(words(answer).alias("a"), words(context).alias("c")), lambda x: F.when(F.size(x["a"]) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(x["a"], x["c"])) / F.least(F.size(x["a"]), F.lit(50)))))


def sigmoid(x: Column) -> Column:
    """Without overflow for either sign."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def distance_score(distance: Column, space: str = "cosine") -> Column:
    """A score between 0 and 1 from a distance of that space."""
    score = {"cosine": 1 - distance / 2, "l2": 1 / (1 + distance), "ip": (1 - distance) / 2}[space]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def cosine(a: Column, b: Column) -> Column:
    """In double precision, summed in order; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
