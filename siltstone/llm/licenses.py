"""License scans by diagonal voting, in native expressions only.

Every rolling k-gram of a text's words is hashed, and the hashes are joined to the places of the templates' k-grams.
The templates are fixed phrases of this module, so that side of the join is small at any size of the input and is
broadcast; their hashes are known beforehand, and what equals none of them is left out where it is made. A hit votes for
its diagonal, the offset of the text's place from the template's; neighbouring diagonals are merged, which lets a few
words be missing or added. A merged span has a first and a last word, and counts the template's places that voted, each
once. It is verified: the text's words, which each hit has carried along from its surroundings, are read again against
the template's on the span's diagonals. Short templates have too few k-grams for that, as one word breaks up to K of
them: they are also looked for word by word, with one word added, missing or replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, text_of
from siltstone.llm.spans import let

# Phrases whose words, standing together, give a label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# License phrases that are looked for with words missing or added.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("reserved", "copyright all rights reserved"),
)
#: Words of a k-gram; k-grams that a template needs at least, as a share; how far apart merged diagonals are.
K, COVER, DRIFT = 3, 0.7, 2
#: Words that a hit carries along from before and after it: a span that holds it lies within these.
AROUND = max(len(phrase.split()) for _, phrase in TEMPLATES) + 4 * DRIFT
# Of the templates that one missing word takes below COVER, the words that name the license and always stand.
NAMING = {
    "licensed under the apache license version 2 0": ("apache", "2"), "licensed under cc by nc": ("nc",), "licensed under cc by sa": ("sa",),
    "this work is licensed under the gnu general public license version": ("gnu",), "released under the mit license": ("mit",), "copyright all rights reserved": ("reserved",),
}
# Words that make it another license, or none, where one of them is added or put for a word.
TURNING = ("afl", "agpl", "apache", "bsd", "cc", "gnu", "gpl", "lgpl", "lesser", "affero", "mit", "mpl", "mozilla", "nc", "nd", "no", "non", "not", "sa", "some", "without")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; runs of other ASCII characters than letters and digits part them."""
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATORS, -1), "")


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, phrase (its words), grams (their number), t (place), gram (its words): as many rows as the fixed
    templates have k-grams."""
    rows = []
    for n, (label, phrase) in enumerate(TEMPLATES):
        w = phrase.split()
        rows += [(n, label, w, len(w) - K + 1, t, w[t : t + K]) for t in range(len(w) - K + 1)]
    known = spark.createDataFrame(rows, "template int, label string, phrase array<string>, grams int, t int, gram array<string>")
    return known.withColumn("g_hash", F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(K)]))


def gram_hits(w: Column) -> Column:
    """(p, g, start, around) of the k-grams that may be a template's: place, hash, and the words around from start on."""
    grams = {tuple(x[t : t + K]) for x in (phrase.split() for _, phrase in TEMPLATES) for t in range(len(x) - K + 1)}
    known = [F.xxhash64(*map(F.lit, gram)) for gram in sorted(grams)]

    def hit(x: Column, i: Column) -> Column:
        g, start = F.xxhash64(x, *[F.get(w, i + k) for k in range(1, K)]), F.greatest(i - AROUND, F.lit(0))
        return F.when(g.isin(*known), F.struct(i.alias("p"), g.alias("g"), start.alias("start"), F.slice(w, start + 1, F.lit(2 * AROUND)).alias("around")))

    return F.array_compact(F.transform(w, hit))


def borne_out(phrase: Column, around: Column, low: Column, high: Column) -> Column:
    """How many of a phrase's words stand in the text on one of the diagonals from low to high, counted from around's start."""

    def stands(word: Column, j: Column) -> Column:
        first = F.greatest(low + j, F.lit(0))
        return F.array_contains(F.slice(around, first + 1, F.greatest(high + j - first + 1, F.lit(0))), word)

    return F.size(F.filter(phrase, stands))


def phrase_places(w: Column) -> Column:
    """(p, label) for each place where a phrase's words stand consecutively. Only texts with its rarest word are searched."""
    none = F.expr("cast(array() as array<struct<p:int,label:string>>)")
    found = []
    for phrase, label in PHRASES:
        parts = phrase.split()

        def stands(w: Column, parts: list[str] = parts, label: str = label) -> Column:
            last = F.size(w) - len(parts)
            at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _all([F.get(w, i + k).eqNullSafe(F.lit(x)) for k, x in enumerate(parts)]))
            return F.transform(at, lambda i: F.struct(i.cast("int").alias("p"), F.lit(label).alias("label")))

        seen = _all([F.array_contains(w, x) for x in dict.fromkeys(parts)])
        found.append(F.when(seen, stands(w)).otherwise(none))
    return F.concat(*found)


def edited_pattern(phrase: str, naming: tuple[str, ...]) -> str:
    """A pattern of the phrase with one word added inside, missing or replaced, for words that each follow a space. The
    last word and the naming ones stand, and no turning word comes in."""
    w = phrase.split()
    other = f" (?!(?:{'|'.join(TURNING)}) )[^ ]+"
    rest = ["".join(f" {x}" for x in w[i:]) for i in range(len(w))]
    out = other + rest[-1]
    for i in range(len(w) - 2, 0, -1):
        without = [] if w[i] in naming else [rest[i + 1], other + rest[i + 1]]
        out = "(?:" + "|".join([f" {w[i]}{out}", other + rest[i], *without]) + ")"
    # where the first word is missing or replaced, the others stand
    return f"(?: {w[0]}{out}|{rest[1]}) "


def edited_labels(w: Column) -> Column:
    """The labels of short templates that stand with one word added, missing or replaced. Only texts with the words that
    always stand are searched."""
    found = []
    for label, phrase in TEMPLATES:
        if phrase in NAMING:
            parts = phrase.split()
            seen = _all([F.array_contains(w, x) for x in dict.fromkeys((*NAMING[phrase], parts[-1]))])
            found.append(F.when(seen, F.when(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).rlike(edited_pattern(phrase, NAMING[phrase])), F.lit(label))))
    return F.array_compact(F.array(*found))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def spans(hits: DataFrame) -> DataFrame:
    """uid, label, first, last (words), share: the merged and verified spans of hits(uid, p, g, start, around).

    share: the lesser of the share of the template's k-grams that voted, and of its words that are read again on the span's
    diagonals. A span much longer than its template has share 0.
    """
    known = F.broadcast(template_grams(hits.sparkSession))
    same = F.slice("around", F.col("p") - F.col("start") + 1, F.lit(K)) == F.col("gram")
    votes = hits.join(known, (F.col("g") == F.col("g_hash")) & same).withColumn("diagonal", F.col("p") - F.col("t"))
    order = W.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(True)).cast("int")
    merged = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = merged.groupBy("uid", "template", "label", "grams", "span").agg(
        F.countDistinct("t").alias("voted"), F.min("p").alias("first"), (F.max("p") + K - 1).alias("last"), F.min_by(F.struct("start", "around"), "p").alias("text"), F.first("phrase").alias("phrase"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"),
    )
    length, start = F.col("last") - F.col("first") + 1, F.col("text.start")
    read = borne_out(F.col("phrase"), F.col("text.around"), F.col("low") - start, F.col("high") - start)
    share = F.least(F.col("voted") / F.col("grams"), read / F.size("phrase"))
    return merged.select("uid", "label", "first", "last", F.when(length <= F.size("phrase") + 2 * DRIFT, share).otherwise(0.0).alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Null texts count as empty: no words, no labels, score 0. Repeated rows and null ids each keep a row. A text may
    hold a phrase many times; each place counts. score: 1 where a phrase stands in full, else the largest share of a
    template's k-grams on merged diagonals that the span's words bear out, also where that is too low for a label or a
    short template stands with one word changed. spans: label:first:last of the spans that give a label, by their words.
    An empty table gives no rows; columns other than doc_id and text, whatever their names, are not read.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), words(text_of()).alias("w"))
    rows = rows.select("doc_id", "uid", F.size("w").cast("long").alias("n_words"), let(F.col("w"), phrase_places).alias("places"), let(F.col("w"), edited_labels).alias("edited"), let(F.col("w"), gram_hits).alias("hits"))
    # written once, so that a number stays with its row whenever it is read
    rows = materialise(rows, "license-rows")
    found = spans(rows.select("uid", F.explode("hits").alias("x")).select("uid", "x.*"))
    good = F.col("share") >= COVER
    listed = F.array_sort(F.collect_list(F.when(good, F.struct("first", "last", "label"))))
    found = found.groupBy("uid").agg(F.collect_set(F.when(good, F.col("label"))).alias("others"), F.max("share").alias("share"), F.transform(listed, lambda x: F.concat_ws(":", x["label"], x["first"], x["last"])).alias("spans"))
    out = rows.drop("hits").join(found, "uid", "left")
    p, own, none = F.transform("places", lambda x: x["p"]), F.array_distinct(F.transform("places", lambda x: x["label"])), F.array().cast("array<string>")
    every = F.array_sort(F.array_union(F.array_union(own, "edited"), F.coalesce("others", none)))
    n = F.size("places").cast("long")
    return out.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min(p).cast("long").alias("first_word"), F.array_max(p).cast("long").alias("last_word"), F.array_join(F.array_sort(own), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), F.array_join(F.coalesce("spans", none), ",").alias("spans"),
    )
