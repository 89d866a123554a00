"""Places of regex matches as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches are laid out in runs of this number, so that the work stays near linear for texts with very many matches.
RUN = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(start: Column, end: Column, value: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"), value.cast("int").alias("v"))


_KIND = "array<struct<s:int,e:int,v:int>>"
_NONE = f"cast(array() as {_KIND})"


def _run_placed(run: Column, at: Column) -> Column:
    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        return F.struct((s + x["len"]).alias("at"), F.concat(acc["out"], F.array(_placed(s, s + x["len"], x["v"]))).alias("out"))

    return F.aggregate(run, F.struct(at.cast("int").alias("at"), F.expr(_NONE).alias("out")), step)


def match_spans(text: Column, pattern: str, value_group: int = 0) -> Column:
    """The leftmost non-overlapping matches of a Java pattern: array of (s, e, v), code points, end exclusive; v is the
    length of the value group. The pieces between the matches give the places; a text without match is scanned once."""
    p = F.lit(pattern)
    whole, value = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(value_group))
    widths = F.zip_with(F.transform(whole, F.length), F.transform(value, F.length), lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    steps = F.zip_with(F.split(text, pattern, -1), widths, lambda g, w: F.struct(F.length(g).alias("gap"), w["m"].alias("len"), w["v"].alias("v")))

    def laid(steps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda i: F.slice(steps, i * RUN + 1, F.lit(RUN)))
        nothing = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_KIND}>)").alias("out"))
        merged = F.aggregate(runs, nothing, lambda acc, run: let(_run_placed(run, acc["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), lambda acc: acc["out"])
        return F.flatten(merged)

    found = let(F.filter(steps, lambda x: x["len"].isNotNull()), laid)
    return F.when(text.rlike(pattern), found).otherwise(F.expr(_NONE))


def masked(text: Column, pattern: str) -> Column:
    """The text with each match overwritten by as many NUL characters. The text is bound once, so that masks may be
    nested without the expression growing with each."""

    def cover(t: Column) -> Column:
        whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        parts = F.zip_with(F.split(t, pattern, -1), whole, lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit("\0"), F.length(m)), F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(parts, "")).otherwise(t)

    return let(text, cover)
