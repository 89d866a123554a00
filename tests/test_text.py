import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema or "x string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("3-4 g/kg/day protein for preterm infants", ["3-4", "g_per_kg_per_day", "protein", "preterm", "infants"]),
        ("dose range of 3 - 4 units", ["dose", "range", "3-4", "units"]),
        ("give 5 mg / dL; k and x", ["give", "mg_per_dl", "k"]),
        ("0.5–1.0 mEq/L", ["0.5-1.0", "meq_per_l"]),
        ("   ", []),
        ("", []),
    ],
)
def test_keyword_tokens(spark, text, tokens):
    assert one(spark, T.keyword_tokens(F.col("t")), t=text) == tokens


@pytest.mark.parametrize(("a", "b", "f1"), [("same words", "same words", 1.0), ("", "", 1.0), ("x", "", 0.0), ("protein 3 g", "protein 4 g", 2 / 3)])
def test_token_f1(spark, a, b, f1):
    assert one(spark, T.token_f1(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(f1)


def test_citation_match(spark):
    match = T.citation_match(F.col("g"), F.col("s"), F.col("p"))
    assert one(spark, match, g="see aspen guidelines 2020", s="ASPEN_Guidelines_2020.md", p=1)
    assert one(spark, match, g="as in p.44", s="other.md", p=44)
    assert not one(spark, match, g="nothing", s="other.md", p=44)


@pytest.mark.parametrize(("answer", "normal"), [("a, b", "A,B"), ("B,A,B", "A,B"), ("all of the above", "ALL"), (" none ", "NONE"), ("maybe", "MAYBE")])
def test_normalize_answer(spark, answer, normal):
    assert one(spark, T.normalize_answer(F.col("a")), a=answer) == normal


def test_answers_match(spark):
    exact, partial = T.answers_match(F.col("p"), F.col("e"))
    assert one(spark, exact, p="c, a", e="A,C")
    assert one(spark, partial, p="a", e="A,C") and not one(spark, partial, p="b", e="A,C")


def test_options(spark):
    options = T.coerce_options(F.col("o"))
    assert one(spark, options, o="a || b||c") == ["a", "b", "c"]
    assert one(spark, options, o="a\n b\n") == ["a", "b"]
    assert one(spark, options, o="a|b") == ["a", "b"]
    assert one(spark, options, o="one") is None


def test_grams_and_jaccard(spark):
    assert one(spark, T.char_grams(F.col("t")), t="Ab-c, d") == ["abcd"]
    assert one(spark, T.char_grams(F.col("t")), t="abcdef") == ["abcde", "bcdef"]
    assert one(spark, T.char_grams(F.col("t")), t="") == []
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    assert one(spark, T.word_grams(F.col("w")), w=["a", "b", "c", "d"]) == ["a b c", "b c d"]


def test_faithfulness_and_risk(spark):
    f, r = T.faithfulness(F.col("a"), F.col("c")), T.hallucination_risk(F.col("a"), F.col("c"))
    assert one(spark, f, a="give 3 g protein now", c="give 3 g protein now") == pytest.approx(1.0)
    assert one(spark, f, a="", c="x") == 0.0
    assert one(spark, r, a="must give 5 mg/kg", c="give 4") == pytest.approx((1 + 1 + 0.8) / 3)
    assert one(spark, r, a="words", c="words") == 0.2
    assert one(spark, r, a="words", c="") == 1.0


def test_citations(spark):
    assert one(spark, T.doc_citations(F.col("t")), t="x [TPN_Considerations.md; Doc B, 12] [tpn considerations]") == ["tpn considerations", "doc b"]
    done = one(spark, T.without_citations(F.col("t")), t="A fact [Doc, p.4] . More (Source: Doc, page 3), see [X].")
    assert done["text"] == "A fact. More, see." and done["removed"] == 3


def test_low_value(spark):
    low = T.low_value(F.col("t"))
    assert one(spark, low, t="") and one(spark, low, t="Short heading") and one(spark, low, t="A VERY LOUD HEADING WITH MANY LETTERS AND 1 DIGIT")
    assert not one(spark, low, t="5 mg daily") and not one(spark, low, t="a plain sentence that is long enough to be kept as context")


def test_queries(spark):
    assert one(spark, T.focus_query(F.col("t")), t="Case context: One. Two. Question: why so?") == "One. why so?"
    assert one(spark, T.focus_query(F.col("t")), t="no marker") == "no marker"
    plan = one(spark, T.decompose_query(F.col("t"), 3), t="what dose of lipid is given, and when is it to be stopped")
    assert plan[0].startswith("what dose") and len(plan) == 3 and "dosing range" in one(spark, T.decompose_query(F.col("t"), 9), t="the dose")[1]


def test_blocks(spark):
    assert one(spark, T.final_answer(F.col("t")), t="Final answer: 5 mg/kg/min\nWork: 1\nCitations: (none)") == "5 mg/kg/min"
    assert one(spark, T.final_answer(F.col("t")), t="no header") == "no header"
    assert one(spark, T.json_rescue(F.col("t")), t='Here:\n{"answer": "C"}\nDone.') == '{"answer": "C"}'
    assert one(spark, T.section_heading(F.col("t")), t="## Lipids\ntext") == "Lipids"
    assert one(spark, T.section_heading(F.col("t")), t="") == "Content"
    assert one(spark, T.question_kind(F.col("t")), t="Calculate why") == "dosage_calculation"


def test_scores(spark):
    assert one(spark, T.sigmoid(F.col("x").cast("double")), x="-1000") == 0.0
    assert one(spark, T.distance_score(F.col("x").cast("double")), x="0.5") == 0.75
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(T.cosine(F.col("a"), F.col("b")).alias("c"), T.cosine(F.col("a"), F.col("z")).alias("n")).first()
    assert got["c"] == pytest.approx(0.5**0.5) and got["n"] is None
