"""Generated inputs: properties that the column rules keep, whatever the value."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialsieve.functions import clean_url, fingerprint, with_phone_validity

SEPARATORS = " ()-+.[]"
digits = st.text(alphabet="0123456789", min_size=1, max_size=18)
phones = st.text(alphabet="0123456789  ()-+.[]x 1", min_size=0, max_size=18)
urls = st.text(alphabet="abHT:/?=.#- p", min_size=0, max_size=14)
CLASSES = {"valid", "possible", "invalid", "empty"}


def validity(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, tel string")
    return [(r["tel_valid"], r["tel_reason"]) for r in with_phone_validity(df, "tel").orderBy("i").collect()]


@settings(max_examples=1, deadline=None)
@given(st.lists(phones, min_size=200, max_size=200))
def test_every_phone_has_one_class_and_a_reason(spark, values):
    got = validity(spark, values)
    assert all(c in CLASSES and reason for c, reason in got)
    assert all((c == "empty") == (v.strip(" ") in ("", "-")) for v, (c, _) in zip(values, got, strict=True))
    assert all("non-numeric" in reason for v, (c, reason) in zip(values, got, strict=True) if "x" in v)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(digits, st.integers(0, 17), st.sampled_from(SEPARATORS)), min_size=200, max_size=200))
def test_separators_never_change_the_class(spark, cases):
    plain = validity(spark, [d for d, _, _ in cases])
    spread = validity(spark, [d[:i] + s + d[i:] for d, i, s in cases])
    assert plain == spread


def test_length_decides_at_the_boundaries(spark):
    made = {n: ("23456789" * 3)[:n] for n in range(1, 19)}
    got = dict(zip(made, validity(spark, list(made.values())), strict=True))
    assert {n for n, (c, _) in got.items() if c == "invalid"} == {*range(1, 7), 16, 17, 18}
    assert {n for n, (c, _) in got.items() if c == "possible"} == {7, 8, 9}
    assert validity(spark, ["1" + made[10]])[0] == got[10]                 # a leading 1 does not count


@settings(max_examples=1, deadline=None)
@given(st.lists(urls, min_size=200, max_size=200))
def test_url_cleaning_is_idempotent_and_ignores_case_blanks_and_query(spark, us):
    df = spark.createDataFrame(list(enumerate(us)), "i int, u string").withColumn("c", clean_url("u"))
    df = df.withColumn("cc", clean_url("c")).withColumn("v", F.concat(F.lit("  "), F.upper("u"), F.lit("?x=1 "))).withColumn("cv", clean_url("v"))
    for r in df.collect():
        assert r["c"] == "" or r["c"].startswith("http")
        assert "?" not in r["c"] and not r["c"].endswith("/") and r["c"] == r["c"].strip(" ").lower() or r["c"] == "https://"
        if r["u"].strip(" ") and "?" not in r["u"] and not r["u"].rstrip(" ").endswith("/"):
            assert r["cv"].rstrip() == r["c"].rstrip() or " " in r["u"]
        if r["c"].startswith("http") and r["c"] != "https://":
            assert r["cc"] == r["c"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(urls, urls), min_size=200, max_size=200))
def test_fingerprints_ignore_case_and_outer_blanks(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    df = df.withColumns({"f": fingerprint("a", "b"), "a2": F.concat(F.lit(" "), F.upper("a")), "b2": F.concat(F.lower("b"), F.lit("  "))})
    for r in df.withColumn("g", fingerprint("a2", "b2")).collect():
        assert r["f"] == r["g"] and len(r["f"]) in (0, 32)
        assert (r["f"] == "") == (not r["a"].strip(" ") and not r["b"].strip(" "))
