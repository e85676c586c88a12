"""64-bit ids beside a null id come back whole from every operator that runs Python."""

import pytest

from tallyspark.llm import decontaminate, language_id, near_dup, quality, secrets, toxicity

BIG = [2**53 + 1, 2**53 + 3]
TEXT = "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, TEXT, "en", "s"), (BIG[0], TEXT + " eleven", "en", "s"), (BIG[1], "der hund liegt auf dem sofa und schl\u00e4ft", "de", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["op3", "op4", "op6", "op7", "op8", "op9"])
def test_ids(spark, docs, name):
    items = spark.createDataFrame([(BIG[0], TEXT)], "item_id long, text string")
    out = {
        "op3": lambda: language_id.identify(docs, language_id.fit(docs)), "op4": lambda: secrets.find_secrets(docs), "op6": lambda: near_dup.near_duplicates(docs), "op7": lambda: quality.quality(docs, labels(spark)),
        "op8": lambda: decontaminate.leaks(docs, items), "op9": lambda: toxicity.score(docs, None),
    }[name]()
    rows = out.collect()
    want = {None, BIG[0]} if name == "op8" else {None, *BIG}
    assert {r["doc_id"] for r in rows} == want
    if name == "op8":
        assert {r["item_id"] for r in rows} == {BIG[0]}
