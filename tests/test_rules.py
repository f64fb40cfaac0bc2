"""Rule tables for the scalar column functions (one row per branch / boundary)."""

import datetime as dt

import pytest

from dialsieve.functions import clean_url, fingerprint, parse_date, timezone, with_phone_validity
from dialsieve.functions.dates import iso_week, iso_year, week_start
from dialsieve.functions.geo import area_code
from dialsieve.operators.output import first_usable_phone
from dialsieve.schema import canonicalize, CONTACT_LAYOUT, resolve

from conftest import strings

PHONES = [
    ("", "empty", "No phone number"),
    (" ", "empty", "No phone number"),
    ("-", "empty", "No phone number"),
    ("NA", "empty", "No phone number"),
    ("Na", "invalid", "Contains non-numeric characters"),
    ("123456", "invalid", "Too short - 6 digits (min 7)"),
    ("1234567", "possible", "7-digit number"),
    ("123456789", "possible", "9-digit number"),
    ("2125550101", "valid", "NANP (212-555-0101)"),
    ("12125550101", "valid", "NANP (212-555-0101)"),
    ("1995550101", "invalid", "Invalid NANP area code 199"),
    ("2121995555", "invalid", "Invalid NANP exchange 199"),
    ("99999999", "invalid", "All same digit - 9"),
    ("123456789012345", "valid", "International E.164 (15 digits)"),
    ("1234567890123456", "invalid", "Too long - 16 digits (E.164 max 15)"),
    ("212-555-0101 x5", "invalid", "Contains non-numeric characters"),
    ("[212] 555.0101", "valid", "NANP (212-555-0101)"),
    ("+442079460000", "valid", "International E.164 (12 digits)"),
    ("()", "invalid", "Contains non-numeric characters"),
    ("²125550101", "invalid", "Contains non-numeric characters"),
]


def test_phone_validation_table(spark):
    df = strings(spark, [(p,) for p, _, _ in PHONES], ["tel"])
    got = {r["tel"]: (r["tel_valid"], r["tel_reason"]) for r in with_phone_validity(df, "tel").collect()}
    for raw, st, reason in PHONES:
        assert got[raw] == (st, reason), raw


def test_timezone_table(spark):
    rows = [("USA", "ny", "EST"), ("usa", "Texas", "EST"), ("CA", "BC", "PST"), ("Canada", "", "EST"),
            ("US", "PR", "EST"), (" India ", "x", "India"), ("", "", ""), ("u.s.a.", " tx ", "CST"),
            ("can", "nl", "NST"), ("United States", "HI", "HST")]
    df = strings(spark, rows, ["country", "state", "want"])
    for r in df.select("want", timezone("country", "state").alias("tz")).collect():
        assert r["tz"] == r["want"]


def test_url_rule_edges(spark):
    rows = [("", ""), ("/", "https://"), ("?a=1", "https://"), ("-", "https://-"), ("HTTP://X/", "http://x"),
            ("ftp://a", "https://ftp://a"), ("https://", "https:"), (" LinkedIn.com/in/U1/?trk=2 ", "https://linkedin.com/in/u1"),
            ("https://a.com/b#frag", "https://a.com/b#frag"), ("https://a.com///", "https://a.com")]
    df = strings(spark, rows, ["u", "want"])
    for r in df.select("want", clean_url("u").alias("c")).collect():
        assert r["c"] == r["want"]


def test_fingerprint_rules(spark):
    import hashlib
    df = strings(spark, [("", " "), ("ab", "c"), ("a", "bc"), (" AB ", "C")], ["a", "b"])
    got = [r[0] for r in df.select(fingerprint("a", "b")).collect()]
    h = hashlib.md5(b"abc").hexdigest()
    assert got == ["", h, h, h]


def test_first_usable_direct_number(spark):
    df = strings(spark, [("-", "nan", "", "555"), ("-", "None", " ", "")],
                 ["Direct Number-1", "Direct Number-2", "Direct Number-3", "Direct Number"])
    f = canonicalize(df, CONTACT_LAYOUT)
    assert [r[0] for r in f.select(first_usable_phone(f)).collect()] == ["555", ""]


def test_area_code(spark):
    df = strings(spark, [("212-555-0101",), ("1 212 555 0101",), ("555-0101",), ("",)], ["p"])
    assert [r[0] for r in df.select(area_code("p")).collect()] == ["212", "121", "", ""]


def test_date_parse_and_iso_week(spark):
    rows = [("2024-01-05",), ("2024-01-05 10:00:00",), ("05/01/2024",), ("-",), ("",), ("x",)]
    df = strings(spark, rows, ["v"])
    got = [r[0] for r in df.select(parse_date("v")).collect()]
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(2024, 5, 1), None, None, None]
    d = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2025, 1, 1),), (dt.date(2021, 1, 3),),
                               (dt.date(2024, 2, 29),)], "d date")
    got = [tuple(r) for r in d.select(iso_year("d"), iso_week("d"), week_start("d")).collect()]
    assert got == [(2025, 1, dt.date(2024, 12, 30)), (2025, 1, dt.date(2024, 12, 30)),
                   (2020, 53, dt.date(2020, 12, 28)), (2024, 9, dt.date(2024, 2, 26))]


@pytest.mark.parametrize("cols,cands,want", [
    (["campaignName", "Campaign Name"], ["Campaign Name", "campaignName"], "Campaign Name"),
    (["campaign_name"], ["Campaign Name"], "campaign_name"),
    (["CAMPAIGN NAME"], ["campaign name"], "CAMPAIGN NAME"),
    (["x"], ["y"], None),
])
def test_alias_resolution(cols, cands, want):
    assert resolve(cols, cands) == want


def test_strip_matches_python_whitespace(spark):
    from dialsieve.functions import norm
    samples = ["\u3000 a b\x1c", "\t\n x \u00a0", "\u2028y\u2029", "  ", "z", "\x0b\x1fq\x1e"]
    df = spark.createDataFrame([(v,) for v in samples], "v string")
    assert [r[0] for r in df.select(norm("v")).collect()] == [v.strip() for v in samples]


def test_phone_separators_include_unicode_space(spark):
    df = strings(spark, [("212\u00a0555\u30000101",), ("212\x1c555-0101",)], ["tel"])
    got = [r["tel_reason"] for r in with_phone_validity(df, "tel").collect()]
    assert got == ["NANP (212-555-0101)", "NANP (212-555-0101)"]
