"""Building a plan: few jobs, lists stored once, one tagging per query."""

import pytest
from pyspark.sql import functions as F

from conftest import strings
from dialsieve.operators.joins import Marks, by_size, measured
from dialsieve.plans import catalog as C
from dialsieve.schema import with_labels
from dialsieve.sources.lists import direct_dial_keys, suppression_keys

SF = "/root/testdata/sf0.001"


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


@pytest.mark.parametrize("name", ["dial_limit_tag", "contact_run", "rechurn_run", "limit_breakdown"])
def test_few_jobs_while_a_plan_is_built(spark, name):
    C.QUERIES[name](spark, SF)                       # the first call reads the tables' footers
    before = jobs(spark)
    C.QUERIES[name](spark, SF)
    assert jobs(spark) - before <= 8


@pytest.mark.parametrize("name", ["audit_rows", "run_metrics", "audit_summary"])
def test_rows_are_tagged_once(spark, name):
    plan = C.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "Scan ExistingRDD" in plan


def test_measured_counts_in_the_job_that_stores(spark):
    df = strings(spark, [("a", "xx"), ("a", "y"), ("b", None)], ["k", "v"]).groupBy("k", "v").count().drop("count")
    before = jobs(spark)
    stored, sizes = measured(df, "k", ["a", "b", "c"])
    assert jobs(spark) - before <= 2 and stored.count() == 3
    assert sizes == {"a": (2, 2 * 16 + 2 + 3), "b": (1, 16 + 1), "c": (0, 0)}
    assert measured(df.limit(0))[1] == {"": (0, 0)}
    assert by_size(df, 5, 10, 5, 10)[1] and not by_size(df, 6, 10, 5, 10)[1] and not by_size(df, 5, 11, 5, 10)[1]
    assert not by_size(df, 0, 0, 0)[1]


def test_marks_keep_the_first_list_and_drop_repeats(spark):
    keys = lambda *v: strings(spark, [(x,) for x in v], ["key"])
    m = Marks(keys("a", "a"), keys("a", "b", "b"), keys("a"), strings(spark, [("1",)], ["phone"]))
    rows = strings(spark, [("a",), ("b",), ("",), ("1",)], ["v"])
    got = {k: [r["hit"] for r in m.join(rows, k, "v", "hit").orderBy("v").collect()] for k in ("email", "domain", "direct")}
    assert got == {"email": [None, None, 1, 2], "domain": [None, None, 1, None], "direct": [None, 1, None, None]}
    assert Marks().join(rows, "email", "v", "hit").where("hit IS NOT NULL").count() == 0


def test_list_columns_are_found_by_rank(spark):
    both = strings(spark, [("x", " E@a ", "f@b")], ["Name", " EMAIL ", "Email ID"])
    assert [r["key"] for r in suppression_keys(both, ["email id", "email"]).collect()] == ["f@b"]
    assert [r["key"] for r in suppression_keys(both, ["email", "email id"]).collect()] == ["e@a"]
    assert [r["key"] for r in suppression_keys(both, ["domain"]).collect()] == ["x"]
    d = strings(spark, [("n", "1-2", "34")], ["Name", "Dialled Number", "Phone"])
    assert [r["phone"] for r in direct_dial_keys(d).collect()] == ["12"]
    assert suppression_keys(both.union(both), ["email"], distinct=False).count() == 2


def test_labels_in_one_step(spark):
    df = with_labels(strings(spark, [("1", "2")], ["a", "b"]), {"a": "Header A"})
    assert df.schema["a"].metadata == {"label": "Header A"} and df.schema["b"].metadata == {}
    assert df.select(F.col("a")).first()["a"] == "1"
