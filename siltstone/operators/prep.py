"""Preparation of datasets: legacy records, options, calculation questions, splits and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import squeezed

# What marks a calculation question and a quantity, and the weights of complexities.
CALC_INTENT = r"(?i)\b(calculate|infusion\s*rate|gir|dose|meq|mmol|mosm|m\s*l\s*/\s*hr|g\s*/\s*kg\s*/\s*day|mg\s*/\s*kg\s*/\s*min)\b"
CALC_QUANTITY = r"(?i)(-?\d+(?:\.\d+)?)\s*(mcg|µg|ug|mg|g|iu|mmol|meq|kcal|mosm|ml|dl|l|%)(?:\s*/\s*(kg|day|hr|min|ml|dl|d|h|m|l))?(?:\s*/\s*(kg|day|hr|min|ml|dl|d|h|m|l))?"
CALC_PER = {"h": "hr", "d": "day", "m": "min"}
COMPLEXITY = ("basic", "intermediate", "advanced")
MESSY_WORDS = r"(?i)\b(?:max(?:imum)?|min(?:imum)?|initial|advance|titrate|target|limit|osm(?:ol|olar)?)\b"
MESSY_RANGE = r"(?i)\d+\s*(?:to|–|-)\s*\d+"


def legacy_records(messages: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """question: the last user message; answer: the last assistant message."""
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col(order)))
    return messages.groupBy(by).agg(last("user").alias("question"), last("assistant").alias("answer"), F.count("*").alias("n_messages"))


def first_filled(*columns: str) -> Column:
    """The first of several columns that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def required(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Adds skip_reason: the first required field that is blank, else null."""
    out = F.lit(None).cast("string")
    for f in reversed(fields):
        out = F.when(F.coalesce(F.trim(F.col(f)), F.lit("")) == "", f"missing_{f}").otherwise(out)
    return rows.withColumn("skip_reason", out)


def calc_records(rows: DataFrame) -> DataFrame:
    """Calculation rows normalised: sample_id calc_NNN, safe numbers; rows without number, question or answer go."""
    text = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\r\n?", "\n"))
    number = F.coalesce(F.try_cast(F.trim(F.col("`S.No`")), "int") if hasattr(F, "try_cast") else F.expr("try_cast(trim(`S.No`) as int)"), F.lit(0))
    out = rows.select(
        number.alias("number"), text("Question").alias("question"), text("Answer").alias("reference_answer"), text("Provider").alias("provider"), text("Complexity").alias("complexity"),
        F.nullif(text("Source Document"), F.lit("")).alias("source_doc"), F.coalesce(F.expr("try_cast(trim(`Verification Confidence`) as double)"), F.lit(0.0)).alias("confidence"),
    )
    out = out.filter("number <> 0 and question <> '' and reference_answer <> ''")
    padded = F.when(F.length(F.col("number").cast("string")) >= 3, F.col("number").cast("string")).otherwise(F.lpad(F.col("number").cast("string"), 3, "0"))
    return out.select(F.concat(F.lit("calc_"), padded).alias("sample_id"), *[c for c in out.columns if c != "number"])


def complexity_weight(value: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, COMPLEXITY)), F.lower(F.trim(value))), F.lit(0)), F.lit(0)).cast("int")


def quantities_of(text: Column) -> Column:
    """A text's quantities, parsed: array of (value, unit, per)."""
    group = lambda k: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CALC_QUANTITY), F.lit(k))
    names = F.create_map(*[F.lit(x) for kv in CALC_PER.items() for x in kv])
    unit = lambda u: F.when(u.isin("µg", "ug"), "mcg").otherwise(u)
    parts = F.arrays_zip(group(1).alias("v"), F.transform(group(2), F.lower).alias("u"), F.transform(group(3), F.lower).alias("p"), F.transform(group(4), F.lower).alias("r"))
    pers = lambda x: F.transform(F.filter(F.array(x["p"], x["r"]), lambda p: p != ""), lambda p: F.coalesce(F.try_element_at(names, p), p))
    return F.transform(parts, lambda x: F.struct(x["v"].cast("double").alias("value"), unit(x["u"]).alias("unit"), pers(x).alias("per")))


def calc_scored(records: DataFrame) -> DataFrame:
    """Eligible calculation questions with weight, density and messy (F11, M12): a calculation is asked for and a
    quantity answered. density: the distinct quantities. messy: weights of the complexity, of distinct keys (unit and
    pers), of keys with several values in the answer, of ranges, of messy words and of the density, each but the first
    up to a bound."""
    q, a = F.col("question"), F.col("reference_answer")
    rows = records.filter(q.rlike(CALC_INTENT) & a.rlike(CALC_QUANTITY)).withColumn("weight", complexity_weight(F.col("complexity")))
    rows = rows.withColumn("_own", quantities_of(a)).withColumn("_all", F.concat(quantities_of(q), "_own"))
    key = lambda x: F.struct(x["unit"], x["per"])
    keys = F.array_distinct(F.transform("_all", key))
    values = lambda k: F.array_distinct(F.transform(F.filter("_own", lambda x: key(x) == k), lambda x: F.round(x["value"], 6)))
    several = F.size(F.filter(keys, lambda k: F.size(values(k)) > 1))
    words, ranges = F.regexp_count(F.concat_ws(" ", q, a), F.lit(MESSY_WORDS)), F.regexp_count(a, F.lit(MESSY_RANGE))
    rows = rows.withColumn("density", F.size(F.array_distinct("_all")))
    cap = lambda c, n: F.least(c, F.lit(n))
    messy = F.col("weight") * 10 + cap(F.size(keys), 6) * 2 + cap(several, 4) * 3 + cap(ranges, 3) * 3 + cap(words, 6) + cap(F.col("density"), 12)
    return rows.withColumn("messy", messy).drop("_own", "_all")


def calc_selected(scored: DataFrame, total: int = 50, high: int | None = None) -> DataFrame:
    """The first ``total`` by weight, confidence, density and id, all falling (T08); with ``high``, so many of these, and
    of the remainder those of the highest messy score (T09). The limits are the selection itself."""
    order = [F.desc(c) for c in ("weight", "confidence", "density", "sample_id")]
    if high is None:
        return scored.orderBy(*order).limit(total)
    first = scored.orderBy(*order).limit(min(high, total))
    rest = scored.join(first.select("sample_id"), "sample_id", "left_anti").select(*scored.columns)
    return first.unionByName(rest.orderBy(F.desc("messy"), *order).limit(max(total - high, 0)))


def changed(current: DataFrame, manifest: DataFrame, key: str = "source", sha: str = "sha256") -> DataFrame:
    """added, changed and removed sources of a corpus against its manifest."""
    old = manifest.select(F.col(key), F.col(sha).alias("_old"))
    both = current.select(key, F.col(sha).alias("_new")).join(old, key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def question_only(text: Column) -> Column:
    """What stands after the question marker of an embedded case, else the text, trimmed."""
    at = F.locate("\n\nquestion:\n", F.lower(text))
    return F.trim(F.when(at > 0, F.substring(text, at + len("\n\nquestion:\n"), F.length(text))).otherwise(text))


def case_question(case: Column, question: Column) -> Column:
    return F.when(F.coalesce(F.trim(case), F.lit("")) == "", question).otherwise(F.concat(F.lit("Case context:\n"), case, F.lit("\n\nQuestion:\n"), question))


def header_name(text: Column) -> Column:
    """A column header for matching: lower case, other characters to single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(squeezed(text)), "[^a-z0-9]+", "_"), "^_|_$", "")


def multi_query_lines(response: Column) -> Column:
    """The queries of a model's list: bullets, numbers and quotes stripped, over five characters."""
    lines = F.transform(F.split(response, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:[-*•]|\d+[.)])\s*", ""), "^[\"']|[\"']$", "")))
    return F.filter(lines, lambda x: F.length(x) > 5)


def noise_chunks(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Without chunks of a caption error, or of under 20 characters that are no heading."""
    c = F.col(content)
    return chunks.filter(~F.contains(c, F.lit("CAPTION ERROR")) & ((F.length(c) >= 20) | c.startswith("#")))


def contextual(source: Column, section: Column, content: Column) -> Column:
    """Content led by its source and section."""
    return F.concat(F.lit("Source: "), source, F.lit("\nSection: "), section, F.lit("\n\n"), content)


def kb_manifest(files: DataFrame) -> DataFrame:
    """One row: the sorted file names, sha256 by name, and the sha256 of the whole (K08). files: name, sha256."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "sha256")))
    return files.agg(pairs.alias("p")).select(F.transform("p", lambda x: x["name"]).alias("included_files"), F.map_from_entries("p").alias("file_sha256"), F.sha2(F.to_json("p"), 256).alias("manifest_sha256"))
