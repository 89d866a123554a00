"""Documents meet every benchmark item, whatever the items' number and ids."""

import pytest

from siltstone.queries import text_queries as Q

IDS = (5, 9, 70, 5000, *range(9000, 9050))


def passage(k):
    return f"passage w{k}a w{k}b w{k}c never gives {k + 1000} units of w{k}d"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """54 items with gaps in their ids; document d holds the passage of the item in place d % 54."""
    path = str(tmp_path_factory.mktemp("pairing"))
    spark.createDataFrame([(i, passage(k)) for k, i in enumerate(IDS)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(d, passage(d % len(IDS)), "en", "s") for d in range(120)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_every_document_meets_its_item(spark, folder):
    assert {r["doc_id"]: r["faithfulness_millionths"] for r in Q.faithfulness(spark, folder).collect()} == dict.fromkeys(range(120), 1_000_000)
    assert {r["doc_id"]: r["risk_millionths"] for r in Q.hallucination_risk(spark, folder).collect()} == dict.fromkeys(range(120), 0)


def test_every_item_grounds(spark, folder):
    got = {r["answer_id"]: r["grounded_text"] for r in Q.ground_citations(spark, folder).collect()}
    assert len(got) == 120 and all(f"[item {IDS[d % len(IDS)]}, p.3]" in text for d, text in got.items())


def test_no_items(spark, folder, tmp_path):
    for t in ("benchmark", "documents"):
        spark.read.parquet(f"{folder}/{t}.parquet").filter("text is not null" if t == "documents" else "item_id < 0").write.parquet(f"{tmp_path}/{t}.parquet")
    assert {r["faithfulness_millionths"] for r in Q.faithfulness(spark, str(tmp_path)).collect()} == {0}
    assert Q.ground_citations(spark, str(tmp_path)).count() == 120
