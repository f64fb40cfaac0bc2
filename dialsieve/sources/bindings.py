"""Bindings of the library's inputs to the driver's parquet tables.

The driver ships TPC-H-like tables; these functions shape them into the
layouts the library consumes (contact files, call files, list files, the run
log).  Every binding reads a whole table; the derived columns are pure
functions of the row and keys are built from whole ids, so each binding, and
the number of its e-mails, domains and phones, grows with the data.  Lists come
from the whole call log, by the calls' outcomes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# --- fixed values: binding parameters shared with the SQL oracle
CHECK_DATE = dt.date(2024, 1, 18)
MAX_DIRECT = 15
MAX_DAY = 3
RUN_TS = "2024-02-01 09:30:00"
BATCH_ID = "20240201_093000_a1b2c3"
AS_OF = dt.datetime(2024, 2, 10, 0, 0, 0)
RPC_LIST_DATE = "2024-01-12"
STORE_BEFORE = dt.date(2024, 1, 20)
BATCH_FROM = dt.date(2024, 1, 13)
F1_MAX_NATION = 16   # Format-1 file: customers of nations 0..16
F2_MIN_NATION = 8    # Format-2 file: customers of nations 8..24 (8..16 in both)


# contact headers beyond the ones with a rule of their own: "<field> <id>"
FILLED = [("Data_Source", "data_source"), ("First name", "first_name"), ("Last name", "last_name"),
          ("Home Location", "home_location"), ("Organization Title 1", "org_title"),
          ("Organization Description 1", "org_description"), ("Work Location", "work_location"),
          ("Organization LI URL 1", "org_li_url"), ("Skills", "skills"), ("Address1", "address1"), ("City", "city"),
          ("Zip Code/Postal Code", "postal_code"), ("Employee Size", "employee_size"),
          ("Industry Type", "industry_type"), ("Revenue Size", "revenue_size"), ("Revenue Link", "revenue_link"),
          ("SIC Code", "sic_code"), ("NAIC Code", "naic_code"), ("SIC/NAICS Code Link", "sic_naics_link"),
          ("Job Level", "job_level"), ("Job Function", "job_function"), ("QS", "qs"),
          ("AC_List_Mapping", "ac_list_mapping"), ("WP Status", "wp_status")]


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  Its schema is read from a file's footer once a session; the tables
    of a directory do not change."""
    key = (spark.sparkContext.applicationId, f"{sf_dir.rstrip('/')}/{name}.parquet")
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(key[1]).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(key[1])


def _padded(x: str) -> str:
    """An id as text of at least four digits (never cut)."""
    return f"lpad(CAST({x} AS STRING), greatest(4, length(CAST({x} AS STRING))), '0')"


def _txt(c: Column) -> Column:
    return c.cast("string")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contact per customer, with messy emails, phones, states, countries and URLs."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS row_ord", "c_nationkey AS nation",
        "CASE c_custkey % 16 WHEN 3 THEN '' WHEN 9 THEN ' - ' ELSE c_mktsegment END AS campaign", "c_name AS full_name",
        "concat('Org ', CAST(c_custkey div 100 AS STRING)) AS org",
        "CASE WHEN c_custkey % 50 = 0 THEN '' ELSE concat(CASE WHEN c_custkey % 3 = 0 THEN ' U' ELSE 'u' END, "
        "CAST(c_custkey AS STRING), '@Corp', CAST(c_custkey div 10 AS STRING), '.com ') END AS email",
        "concat('corp', CAST(c_custkey div 10 AS STRING), '.COM') AS domain",
        "CASE c_custkey % 12 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN 'call me 555' WHEN 3 THEN '12345' "
        "WHEN 4 THEN '1234567890123456' WHEN 5 THEN '777-777-7777' WHEN 6 THEN '(123) 555-0100' "
        "WHEN 7 THEN '212-100-0000' "
        "WHEN 8 THEN concat('+1 (212) 555-', " + _padded("c_custkey") + ") "
        "WHEN 9 THEN concat('+44 20 7946 ', " + _padded("c_custkey") + ") "
        "WHEN 10 THEN concat('555-', " + _padded("c_custkey") + ") "
        "ELSE concat('212.555.', " + _padded("c_custkey div 12") + ") END AS tel",
        "CASE c_custkey % 7 WHEN 0 THEN 'CA' WHEN 1 THEN 'tx ' WHEN 2 THEN 'NY' WHEN 3 THEN 'ON' WHEN 4 THEN 'BC' "
        "WHEN 5 THEN 'ZZ' ELSE '' END AS state",
        "CASE c_custkey % 8 WHEN 0 THEN 'USA' WHEN 1 THEN 'u.s.' WHEN 2 THEN 'Canada' WHEN 3 THEN 'ca' "
        "WHEN 4 THEN 'Germany' WHEN 5 THEN ' India ' WHEN 6 THEN 'United States' ELSE '' END AS country",
        "concat('https://LinkedIn.com/in/u', CAST(c_custkey AS STRING), "
        "CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '?trk=1' END) AS profile_url",
        "CASE WHEN c_acctbal >= 5000 THEN 'High Intent' ELSE '' END AS intent",
        *[f"concat('{c} ', CAST(c_custkey AS STRING)) AS {c}" for _, c in FILLED])


def contact_file(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """A Format-1 (with Intent) or Format-2 (without) contact file with its headers.

    The two files split customers by nation with an overlap (nations 8..16 are
    in both), so the collated input holds every customer at least once."""
    c = contacts(spark, sf_dir)
    cols = ["row_ord", "campaign AS `Campaign Name`", "full_name AS `Full name`", "org AS `Organization 1`",
            "email AS EmailAddress", "domain AS Domain", "tel AS TelephoneNumber", "state AS State", "country AS Country",
            "profile_url AS `Profile url`", *[f"{c} AS `{h}`" for h, c in FILLED]]
    if fmt == "1":
        return c.where(F.col("nation") <= F1_MAX_NATION).selectExpr(*cols, "intent AS Intent")
    return c.where(F.col("nation") >= F2_MIN_NATION).selectExpr(*cols)


def contact_files(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str]]:
    return [(contact_file(spark, sf_dir, "1"), "1"), (contact_file(spark, sf_dir, "2"), "2")]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per event; ``(call_id, dialed_number)`` repeats on purpose."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS row_ord", "CAST(user_id * 1000 + event_id % 50 AS STRING) AS call_id",
        f"concat('(212) 555-', {_padded('user_id')}) AS dialed_raw",
        f"concat('212555', {_padded('user_id')}) AS dialed_number",
        "CAST(ts AS DATE) AS pbx_dialing_date",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS pbx_text",
        "concat('U', CAST(user_id AS STRING), '@corp', CAST(user_id div 10 AS STRING), '.com') AS email",
        "CASE event_type WHEN 'click' THEN if(event_id % 20 = 0, 'Prospect Call Back', 'Left Message') "
        "WHEN 'view' THEN 'Ringing No Response' WHEN 'error' THEN if(event_id % 30 = 0, 'Dead Contact', 'Wrong Number') "
        "WHEN 'signup' THEN if(event_id % 20 = 0, 'BANT Lead', 'Information Sent') "
        "ELSE if(event_id % 30 = 0, 'DNC Prospect', 'Hang Up') END AS dgs",
        "event_type",
        "CASE user_id % 5 WHEN 0 THEN 'automobile' WHEN 1 THEN 'building' WHEN 2 THEN 'furniture' "
        "WHEN 3 THEN 'household' ELSE 'machinery' END AS campaign",
        "concat('https://linkedin.com/in/u', CAST(user_id AS STRING), '/') AS contact_link")


def call_file(spark: SparkSession, sf_dir: str, date_from: dt.date | None = None,
              date_to: dt.date | None = None, event_type: str | None = None) -> DataFrame:
    """Calls as a Format-3 file (headers as uploaded), optionally one upload window."""
    c = calls(spark, sf_dir)
    if date_from is not None:
        c = c.where(F.col("pbx_dialing_date") >= F.lit(date_from))
    if date_to is not None:
        c = c.where(F.col("pbx_dialing_date") < F.lit(date_to))
    if event_type is not None:
        c = c.where(F.col("event_type") == event_type)
    return c.selectExpr(
        "row_ord", "call_id", "dialed_raw AS `Dialed Number`", "pbx_text AS `PBX DialingDate`", "email AS EmailAddress",
        "dgs AS `DGS Disposition`", "event_type AS `System Disposition`", "campaign AS campaignName",
        "contact_link AS `Contact Link`")


def extract_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Format-3 call extract: one row per order, keyed by (campaign, contact link)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.selectExpr(
        "o_orderkey AS row_ord",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE lower(c_mktsegment) END AS campaignName",
        "concat(' https://linkedin.com/in/u', CAST(o_custkey AS STRING), "
        "CASE WHEN o_custkey % 2 = 0 THEN '/' ELSE '?trk=1' END) AS `Contact Link`",
        "CASE o_orderstatus WHEN 'F' THEN 'GTG' WHEN 'O' THEN 'Failed' ELSE 'Pending' END AS QA_Final_Status",
        "concat('u', CAST(o_custkey AS STRING), '@corp', CAST(o_custkey div 10 AS STRING), '.com') AS EmailAddress",
        f"concat('(212) 555-', {_padded('o_custkey')}) AS `Dialed Number`",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') "
        f"THEN concat('212-555-', {_padded('o_custkey')}) ELSE '' END AS `Direct Number`",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Ringing No Response' WHEN '2-HIGH' THEN 'RPC VM Reached' "
        "WHEN '3-MEDIUM' THEN 'Lead Scored' WHEN '4-NOT SPECIFIED' THEN 'Toll Free Number' ELSE 'Completed' END "
        "AS `DGS Disposition`",
        "c_name AS Full_Name", "concat('Asset ', o_orderpriority) AS `Asset Pitched`",
        "CAST(o_orderkey AS STRING) AS call_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log rows (one per order); many ties on ``logged_at``."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderdate AS logged_at", "concat('user', CAST(o_custkey % 5 AS STRING)) AS username",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'rechurn' ELSE 'contact' END AS pipeline",
        "concat('b', CAST(o_orderkey % 200 AS STRING)) AS batch_id",
        "CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_orderpriority END AS campaign_name",
        "o_orderkey % 1000 AS total_rows", "o_orderkey % 700 AS gtg_rows",
        "o_orderkey % 200 AS suppressed", "o_orderkey % 100 AS over_limit")


# --- list files derived from the call log ----------------------------------

DEAD_DGS = ["Dead Contact", "DNC Prospect"]
RPC_DGS = ["Prospect Call Back", "BANT Lead"]


def _outcome(spark: SparkSession, sf_dir: str, dgs: list[str], before: dt.date | None) -> DataFrame:
    """Calls of the whole log (or of the uploads before a day) with one of the outcomes."""
    c = calls(spark, sf_dir).where(F.col("dgs").isin(dgs))
    return c if before is None else c.where(F.col("pbx_dialing_date") < F.lit(before))


def dead_list_file(spark: SparkSession, sf_dir: str, before: dt.date | None = None) -> DataFrame:
    """Do-not-call list: emails of the dead/DNC calls."""
    return _outcome(spark, sf_dir, DEAD_DGS, before).select("row_ord", F.col("email").alias("Email ID"))


def rpc_list_file(spark: SparkSession, sf_dir: str, before: dt.date | None = None) -> DataFrame:
    """RPC+ list: emails of the right-party calls."""
    return _outcome(spark, sf_dir, RPC_DGS, before).select(
        "row_ord", F.col("email").alias("email"), F.col("dgs").alias("disposition"),
        F.lit(RPC_LIST_DATE).alias("dialing_date"))


def domain_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company do-not-call domains: one per supplier of region ASIA."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    asia = n.join(r, n.n_regionkey == r.r_regionkey).where(F.col("r_name") == "ASIA")
    s = table(spark, sf_dir, "supplier").join(asia, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return s.select(F.concat(F.lit("Corp"), _txt(F.col("s_suppkey")), F.lit(".com ")).alias("Domain"))


def direct_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct-dial list: numbers of the BANT-lead calls."""
    return _outcome(spark, sf_dir, ["BANT Lead"], None).select(F.col("dialed_raw").alias("Phone"), F.lit("1").alias("dial_count"))
