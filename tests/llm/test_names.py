"""Clashing column names and other key types in the operators that pass whole rows on."""

import pytest
from pyspark.sql import functions as F

from dialsieve.llm import decontaminate, minhash, mixing
from dialsieve.llm.common import free_name

CLASH = ["_i", "_s", "_h", "_sum", "_n", "_c", "_copy", "_gone", "__gone"]


@pytest.fixture()
def rows(docs):
    words = " ".join(f"w{i}" for i in range(30))
    return docs([(1, words, "a"), (2, words, "a"), (2, words, "a"), (3, "other text here now", "b"), (None, None, None)]) \
        .withColumns({c: F.lit(7) for c in CLASH})


def test_free_name(rows):
    assert free_name(rows, "gone") == "___gone" and free_name(rows, "new") == "_new" and free_name(rows, "I") == "__I"


def test_mix_with_clashing_names(rows):
    got = mixing.mix(rows)
    assert got.columns == rows.columns and got.count() > 0 and got.where("_sum <> 7 OR _copy <> 7").count() == 0


def test_drop_near_with_clashing_names(rows):
    got = minhash.drop_near(rows)
    assert got.columns == rows.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "None"]


@pytest.mark.parametrize("kind", ["int", "smallint", "string", "long"])
def test_item_ids_of_any_type(spark, rows, kind):
    items = spark.createDataFrame([("5", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id string, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
    got = decontaminate.find_leaks(rows, items)
    assert {str(r["item_id"]) for r in got.collect()} == {"5"} and got.schema["item_id"].dataType == items.schema["item_id"].dataType
