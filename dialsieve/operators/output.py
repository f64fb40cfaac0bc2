"""Cleaning chain and the 66-column output layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sql as X
from ..functions.geo import timezone_sql
from ..functions.phone import with_phone_validity
from ..schema import OUTPUT_COLUMNS, first_present, q, sql_or_blank

PHONE_CLEAN = ["telephone", "phone_office", "phone_direct", "dialed_number", "direct_number", "board_direct_no"]
URL_CLEAN = ["profile_url", "contact_li_url", "contact_link", "org_li_url", "company_li_url"]
DIRECT_PICK = ["direct_number_1", "direct_number_2", "direct_number_3", "direct_number_4",
               "direct_number", "phone_direct"]

# output column -> canonical source column, for the plain copies
COPIES = {
    "firstname": "first_name", "lastname": "last_name", "fullname": "full_name", "email_address": "email_address",
    "job_title": "org_title", "job_level": "job_level", "extension": "ext", "new_function": "job_function",
    "c_street": "address1", "c_city": "city", "c_state": "state", "c_postalcode": "postal_code",
    "c_country": "country", "datascore": "qs", "Home Location": "home_location",
    "Work Location": "work_location", "Skills": "skills", "contactsource": "data_source",
    "company_name": "org_name", "company_li_url": "org_li_url", "website": "domain", "sic_code": "sic_code",
    "naic_code": "naic_code", "li_industry": "industry_type", "emp_range": "employee_size",
    "rev_range": "revenue_size", "companySource": "data_source", "street": "address1", "city": "city",
    "state": "state", "postalcode": "postal_code", "country": "country", "campaign_code": "campaign_name",
    "Revenue Link": "revenue_link", "SIC/NAICS Code Link": "sic_naics_link", "WP Status": "wp_status",
    "comp_desc": "org_description", "AC_List_Mapping": "ac_list_mapping", "asset_title": "asset_pitched",
    "open_click_status": "open_click_status", "intent": "intent", "contact_li_url": "profile_url",
    "phone_office": "telephone", "contactphone1": "telephone", "timezone": "timezone",
    "tel_valid": "tel_valid", "tel_reason": "tel_reason",
}


def add_phone_validity(df: DataFrame) -> DataFrame:
    """C2 on the raw telephone value: ``tel_valid``, ``tel_reason``."""
    tel = first_present(df, ["telephone", "phone_office"])
    if tel is None:
        return df.withColumns({"tel_valid": F.lit("unknown"), "tel_reason": F.lit("No telephone column in input")})
    return with_phone_validity(df, tel)


def clean_columns(df: DataFrame) -> DataFrame:
    """C1 digits-only phones, C5 time zone, C3/C4 profile URLs (in place)."""
    repl = {c: F.expr(X.digits(q(c))) for c in PHONE_CLEAN if c in df.columns}
    repl.update({c: F.expr(X.clean_url(q(c))) for c in URL_CLEAN if c in df.columns})
    country = first_present(df, ["country", "c_country"])
    state = first_present(df, ["state", "c_state"])
    repl["timezone"] = F.expr(timezone_sql(sql_or_blank(df, country), sql_or_blank(df, state)))
    return df.withColumns(repl)


def first_usable_phone_sql(df: DataFrame) -> str:
    """H5: the first direct number that is not '', '-', 'nan' or 'None'."""
    return X.first_usable([q(c) for c in DIRECT_PICK if c in df.columns])


def first_usable_phone(df: DataFrame):
    return F.expr(first_usable_phone_sql(df))


def output_exprs(df: DataFrame, run_ts: str) -> dict[str, str]:
    """SQL text of the 66 output columns over a validated, cleaned frame."""
    g = lambda name: sql_or_blank(df, name)
    camp_lc = X.norm_lower(g("campaign_name"))
    url, full, org, country = g("profile_url"), g("full_name"), g("org_name"), g("country")
    office = g("telephone")
    e = {c: X.BLANK for c in OUTPUT_COLUMNS}
    e.update({o: g(src) for o, src in COPIES.items()})
    e.update({
        "contactid": X.fingerprint(url, full),
        "companyid": X.fingerprint(org, country),
        "phone_direct": first_usable_phone_sql(df),
        "updated_on": X.lit(run_ts), "created_on": X.lit(run_ts),
        "ph_area_code": f"CASE WHEN {office} <> '' THEN {X.area_code(office)} ELSE '' END",
        "li_cmp_md1": X.fingerprint(url, camp_lc),
        "fnln_comp_cmp_md2": X.fingerprint(full, org, camp_lc),
    })
    return e


def output_projection(df: DataFrame, run_ts: str) -> DataFrame:
    """H4: one ``selectExpr`` of the 66 output expressions (plus order columns).

    Expects a frame that went through ``add_phone_validity`` and
    ``clean_columns``; ``run_ts`` ('yyyy-MM-dd HH:mm:ss') fills created/updated."""
    e = output_exprs(df, run_ts)
    order = [c for c in ("src_ord", "row_ord") if c in df.columns]
    return df.selectExpr(*order, *[f"{v} AS {q(k)}" for k, v in e.items()])


def contacted(df: DataFrame):
    """MD5(first + last + profile url) - offered, not part of the 66 columns."""
    return F.expr(X.fingerprint(sql_or_blank(df, "first_name"), sql_or_blank(df, "last_name"),
                                sql_or_blank(df, "profile_url")))


def output_dedup(out: DataFrame) -> DataFrame:
    """Keep the first row (upload order) per (contactid, campaign_code).
    ``row_number() = 1`` plans a partial WindowGroupLimit before the shuffle,
    so a hot key (e.g. every blank-name contact) is cut map-side."""
    w = Window.partitionBy("contactid", "campaign_code").orderBy("src_ord", "row_ord")
    return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def transform_and_output(df: DataFrame, run_ts: str, dedup: bool = True) -> DataFrame:
    """Steps 8-16: validate, clean, project, dedup.  Keeps src_ord/row_ord."""
    out = output_projection(clean_columns(add_phone_validity(df)), run_ts)
    return output_dedup(out) if dedup else out
