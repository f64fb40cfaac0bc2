"""DuckDB SQL twins of the query catalog (the correctness oracle).

Each string runs on the driver's raw tables only (customer, orders, events,
nation, region, pages are pre-registered views); the input bindings are
inlined as CTEs.  The SQL is written from the operator rules directly (CASE
chains, IN-subqueries, COUNT(DISTINCT CASE ...)), not from the Spark plan, so
the two sides are independent formulations of the same semantics.
"""

from __future__ import annotations

from ..functions.geo import CA_NAMES, CA_PROVINCE_ZONES, US_NAMES, US_STATE_ZONES
from ..schema import HISTORY_COLUMNS, OUTPUT_COLUMNS

RUN_TS = "2024-02-01 09:30:00"
BATCH_ID = "20240201_093000_a1b2c3"
OLD_BATCH_ID = "20240101_000000_f0e1d2"


BLANK = "''"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


# --- scalar rule helpers (DuckDB dialect) ------------------------------------

def nl(x: str) -> str:
    return f"lower(trim({x}))"


def dg(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def url(x: str) -> str:
    u = f"rtrim(regexp_replace(lower(trim({x})), '\\?.*$', ''), '/')"
    return (f"(CASE WHEN lower(trim({x})) = '' THEN '' WHEN starts_with({u}, 'http') THEN {u} "
            f"ELSE 'https://' || {u} END)")


def fp(*parts: str) -> str:
    joined = "concat(" + ", ".join(nl(p) for p in parts) + ")"
    return f"(CASE WHEN {joined} = '' THEN '' ELSE md5({joined}) END)"


def tz(country: str, state: str) -> str:
    st = f"upper(trim({state}))"
    us = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in US_STATE_ZONES.items())
    ca = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in CA_PROVINCE_ZONES.items())
    return (f"(CASE WHEN {nl(country)} IN {_in(US_NAMES)} THEN (CASE {st} {us} ELSE 'EST' END) "
            f"WHEN {nl(country)} IN {_in(CA_NAMES)} THEN (CASE {st} {ca} ELSE 'EST' END) "
            f"ELSE trim({country}) END)")


def area(x: str) -> str:
    return f"(CASE WHEN length({dg(x)}) >= 10 THEN substr({dg(x)}, 1, 3) ELSE '' END)"


SEP = "regexp_replace({x}, '[\\[\\]\\s\\(\\)\\-\\+\\.]', '', 'g')"


def phone_cols(raw: str, c: str) -> tuple[str, str]:
    """(status, reason) CASE expressions; ``c`` = raw with separators removed."""
    n = f"length({c})"
    nanp = f"(CASE WHEN {n} = 11 AND {c} LIKE '1%' THEN substr({c}, 2) ELSE {c} END)"
    cond = [
        (f"trim({raw}) IN ('', '-', 'nan', 'None', 'NA', 'na')", "'empty'", "'No phone number'"),
        (f"NOT regexp_full_match({c}, '[0-9]+')", "'invalid'", "'Contains non-numeric characters'"),
        (f"{n} < 7", "'invalid'", f"'Too short - ' || CAST({n} AS VARCHAR) || ' digits (min 7)'"),
        (f"{n} > 15", "'invalid'", f"'Too long - ' || CAST({n} AS VARCHAR) || ' digits (E.164 max 15)'"),
        (f"replace({c}, substr({c}, 1, 1), '') = ''", "'invalid'", f"'All same digit - ' || substr({c}, 1, 1)"),
        (f"length({nanp}) = 10 AND CAST(substr({nanp}, 1, 3) AS INTEGER) < 200", "'invalid'",
         f"'Invalid NANP area code ' || substr({nanp}, 1, 3)"),
        (f"length({nanp}) = 10 AND CAST(substr({nanp}, 4, 3) AS INTEGER) < 200", "'invalid'",
         f"'Invalid NANP exchange ' || substr({nanp}, 4, 3)"),
        (f"length({nanp}) = 10", "'valid'",
         f"'NANP (' || substr({nanp}, 1, 3) || '-' || substr({nanp}, 4, 3) || '-' || substr({nanp}, 7) || ')'"),
        (f"{n} >= 10", "'valid'", f"'International E.164 (' || CAST({n} AS VARCHAR) || ' digits)'"),
    ]
    status = "(CASE " + " ".join(f"WHEN {w} THEN {s}" for w, s, _ in cond) + " ELSE 'possible' END)"
    reason = ("(CASE " + " ".join(f"WHEN {w} THEN {r}" for w, _, r in cond)
              + f" ELSE CAST({n} AS VARCHAR) || '-digit number' END)")
    return status, reason


def pdate(x: str) -> str:
    v = f"trim({x})"
    fmts = ["%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ",
            "%Y-%m-%d %H:%M:%S.%f", "%m/%d/%Y", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %I:%M %p",
            "%m/%d/%Y %I:%M:%S %p", "%d-%b-%Y", "%Y%m%d", "%Y/%m/%d"]
    tries = ", ".join(f"try_strptime({v}, '{f}')" for f in fmts)
    return f"(CASE WHEN {v} IN ('', '-', 'nan', 'NaT', 'NAT') THEN NULL ELSE CAST(coalesce({tries}) AS DATE) END)"


# --- bindings ----------------------------------------------------------------

def padded(x: str) -> str:
    """An id as text of at least four digits (never cut)."""
    return f"lpad(CAST({x} AS VARCHAR), greatest(4, length(CAST({x} AS VARCHAR)))::INTEGER, '0')"


FILLED = ["data_source", "first_name", "last_name", "home_location", "org_title", "org_description", "work_location",
          "org_li_url", "skills", "address1", "city", "postal_code", "employee_size", "industry_type", "revenue_size",
          "revenue_link", "sic_code", "naic_code", "sic_naics_link", "job_level", "job_function", "qs",
          "ac_list_mapping", "wp_status"]

FILLED_LABELS = list(zip(FILLED, [
    "Data_Source", "First name", "Last name", "Home Location", "Organization Title 1", "Organization Description 1",
    "Work Location", "Organization LI URL 1", "Skills", "Address1", "City", "Zip Code/Postal Code", "Employee Size",
    "Industry Type", "Revenue Size", "Revenue Link", "SIC Code", "NAIC Code", "SIC/NAICS Code Link", "Job Level",
    "Job Function", "QS", "AC_List_Mapping", "WP Status"], strict=True))

CONTACTS = f"""contacts AS (
  SELECT c_custkey AS row_ord, c_nationkey AS nation,
    CASE c_custkey % 16 WHEN 3 THEN '' WHEN 9 THEN ' - ' ELSE c_mktsegment END AS campaign, c_name AS full_name,
    concat('Org ', CAST(c_custkey // 100 AS VARCHAR)) AS org,
    CASE WHEN c_custkey % 50 = 0 THEN '' ELSE concat(CASE WHEN c_custkey % 3 = 0 THEN ' U' ELSE 'u' END,
      CAST(c_custkey AS VARCHAR), '@Corp', CAST(c_custkey // 10 AS VARCHAR), '.com ') END AS email,
    concat('corp', CAST(c_custkey // 10 AS VARCHAR), '.COM') AS domain,
    CASE c_custkey % 12 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN 'call me 555' WHEN 3 THEN '12345'
      WHEN 4 THEN '1234567890123456' WHEN 5 THEN '777-777-7777' WHEN 6 THEN '(123) 555-0100'
      WHEN 7 THEN '212-100-0000'
      WHEN 8 THEN concat('+1 (212) 555-', {padded('c_custkey')})
      WHEN 9 THEN concat('+44 20 7946 ', {padded('c_custkey')})
      WHEN 10 THEN concat('555-', {padded('c_custkey')})
      ELSE concat('212.555.', {padded('c_custkey // 12')}) END AS tel,
    CASE c_custkey % 7 WHEN 0 THEN 'CA' WHEN 1 THEN 'tx ' WHEN 2 THEN 'NY' WHEN 3 THEN 'ON' WHEN 4 THEN 'BC'
      WHEN 5 THEN 'ZZ' ELSE '' END AS state,
    CASE c_custkey % 8 WHEN 0 THEN 'USA' WHEN 1 THEN 'u.s.' WHEN 2 THEN 'Canada' WHEN 3 THEN 'ca'
      WHEN 4 THEN 'Germany' WHEN 5 THEN ' India ' WHEN 6 THEN 'United States' ELSE '' END AS country,
    concat('https://LinkedIn.com/in/u', CAST(c_custkey AS VARCHAR),
      CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '?trk=1' END) AS profile_url,
    CASE WHEN c_acctbal >= 5000 THEN 'High Intent' ELSE '' END AS intent,
    {", ".join(f"concat('{c} ', CAST(c_custkey AS VARCHAR)) AS {c}" for c in FILLED)}
  FROM customer)"""

_CONTACT_COLS = ("row_ord, campaign AS campaign_name, full_name, org AS org_name, email AS email_address, domain, "
                 "tel AS telephone, state, country, profile_url, " + ", ".join(FILLED))

COLLATED = f"""collated AS (
  SELECT CAST(1 AS BIGINT) AS src_ord, {_CONTACT_COLS}, intent FROM contacts WHERE nation <= 16
  UNION ALL
  SELECT CAST(2 AS BIGINT) AS src_ord, {_CONTACT_COLS}, 'No Intent' AS intent FROM contacts WHERE nation >= 8)"""

CONTACT_PRESENT = ["campaign_name", "full_name", "org_name", "email_address", "domain", "telephone", "state",
                   "country", "profile_url", *FILLED, "intent"]

CALLS = f"""calls AS (
  SELECT event_id AS row_ord, CAST(user_id * 1000 + event_id % 50 AS VARCHAR) AS call_id,
    concat('(212) 555-', {padded('user_id')}) AS dialed_raw,
    concat('212555', {padded('user_id')}) AS dialed_number,
    CAST(ts AS DATE) AS pbx_dialing_date,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS pbx_text,
    concat('U', CAST(user_id AS VARCHAR), '@corp', CAST(user_id // 10 AS VARCHAR), '.com') AS email,
    CASE WHEN event_type = 'view' THEN 'Ringing No Response'
      WHEN event_type = 'click' THEN CASE WHEN event_id % 20 = 0 THEN 'Prospect Call Back' ELSE 'Left Message' END
      WHEN event_type = 'error' THEN CASE WHEN event_id % 30 = 0 THEN 'Dead Contact' ELSE 'Wrong Number' END
      WHEN event_type = 'signup' THEN CASE WHEN event_id % 20 = 0 THEN 'BANT Lead' ELSE 'Information Sent' END
      WHEN event_id % 30 = 0 THEN 'DNC Prospect' ELSE 'Hang Up' END AS dgs,
    event_type,
    CASE user_id % 5 WHEN 0 THEN 'automobile' WHEN 1 THEN 'building' WHEN 2 THEN 'furniture'
      WHEN 3 THEN 'household' ELSE 'machinery' END AS campaign,
    concat('https://linkedin.com/in/u', CAST(user_id AS VARCHAR), '/') AS contact_link
  FROM events)"""


def _blank_sent(x: str) -> str:
    return f"(CASE WHEN trim({x}) IN ('nan', '<NA>', 'None', 'NaT', 'NAT', 'NaN') THEN '' ELSE trim({x}) END)"


_HIST_SRC = {
    "call_id": "call_id", "email_address": "email", "dgs_disposition": "dgs",
    "system_disposition": "event_type", "campaign_name": "campaign", "contact_link": "contact_link",
}


def hist_select(where: str = "") -> str:
    """A call upload aligned to the 61 history columns (from ``calls``)."""
    cols = []
    for c in HISTORY_COLUMNS:
        if c == "pbx_dialing_date":
            cols.append(f"{pdate('pbx_text')} AS pbx_dialing_date")
        elif c == "dialed_number":
            cols.append(f"{dg('dialed_raw')} AS dialed_number")
        elif c in _HIST_SRC:
            cols.append(f"{_blank_sent(_HIST_SRC[c])} AS {c}")
        else:
            cols.append(f"'' AS {c}")
    w = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(cols)}, CAST(1 AS BIGINT) AS src_ord, row_ord FROM calls{w}"


EXTRACT = f"""extract AS (
  SELECT CAST(1 AS BIGINT) AS src_ord, o.o_orderkey AS row_ord,
    CASE WHEN o.o_orderkey % 7 = 0 THEN 'other' ELSE lower(c.c_mktsegment) END AS campaign_name,
    concat(' https://linkedin.com/in/u', CAST(o.o_custkey AS VARCHAR),
      CASE WHEN o.o_custkey % 2 = 0 THEN '/' ELSE '?trk=1' END) AS contact_link,
    CASE o.o_orderstatus WHEN 'F' THEN 'GTG' WHEN 'O' THEN 'Failed' ELSE 'Pending' END AS qa_final_status,
    concat('u', CAST(o.o_custkey AS VARCHAR), '@corp', CAST(o.o_custkey // 10 AS VARCHAR), '.com') AS email_address,
    concat('(212) 555-', {padded('o.o_custkey')}) AS dialed_number,
    CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH')
      THEN concat('212-555-', {padded('o.o_custkey')}) ELSE '' END AS direct_number,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Ringing No Response' WHEN '2-HIGH' THEN 'RPC VM Reached'
      WHEN '3-MEDIUM' THEN 'Lead Scored' WHEN '4-NOT SPECIFIED' THEN 'Toll Free Number' ELSE 'Completed' END
      AS dgs_disposition,
    c.c_name AS full_name, concat('Asset ', o.o_orderpriority) AS asset_pitched,
    CAST(o.o_orderkey AS VARCHAR) AS call_id
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)"""

EXTRACT_PRESENT = ["campaign_name", "contact_link", "qa_final_status", "email_address", "dialed_number",
                   "direct_number", "dgs_disposition", "full_name", "asset_pitched", "call_id"]

LISTS = f"""dead AS (
  SELECT DISTINCT {nl('email')} AS key FROM calls WHERE dgs IN ('Dead Contact', 'DNC Prospect') AND {nl('email')} <> ''),
rpc AS (
  SELECT DISTINCT {nl('email')} AS key FROM calls WHERE dgs IN ('Prospect Call Back', 'BANT Lead') AND {nl('email')} <> ''),
domains AS (
  SELECT DISTINCT {nl("concat('Corp', CAST(s.s_suppkey AS VARCHAR), '.com ')")} AS key
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE r.r_name = 'ASIA'),
direct AS (
  SELECT DISTINCT {dg('dialed_raw')} AS phone FROM calls WHERE dgs = 'BANT Lead' AND {dg('dialed_raw')} NOT IN ('', '0'))"""

HIST = f"""hist AS ({hist_select()})"""

SNAP = f"""snap AS (
  SELECT CAST(1 AS BIGINT) AS src_ord, {_CONTACT_COLS}, intent, '{OLD_BATCH_ID}' AS batch_id,
    TIMESTAMP '2024-01-01 00:00:00' AS loaded_at, {nl('campaign')} AS _campaign_name, {nl('profile_url')} AS _contact_link
  FROM contacts WHERE nation <= 16
  UNION ALL
  SELECT CAST(1 AS BIGINT) AS src_ord, {_CONTACT_COLS}, 'No Intent' AS intent, '{BATCH_ID}' AS batch_id,
    TIMESTAMP '{RUN_TS}' AS loaded_at, {nl('campaign')} AS _campaign_name, {nl('profile_url')} AS _contact_link
  FROM contacts WHERE nation >= 8),
latest AS (
  SELECT * FROM snap
  QUALIFY row_number() OVER (PARTITION BY _campaign_name, _contact_link ORDER BY batch_id DESC, src_ord, row_ord) = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def tag_ctes(src: str, tel: str, dtel: str, has_domain: bool, prefix: str = "") -> list[str]:
    """Suppression + dial-limit tagging of CTE ``src`` -> CTE ``{prefix}tagged``."""
    p = prefix
    dom = f"WHEN {nl('s.domain')} IN (SELECT key FROM domains) THEN 'Company Domain DNC' " if has_domain else ""
    supp = (f"{p}supp AS (SELECT s.*, CASE WHEN {nl('s.email_address')} IN (SELECT key FROM dead) THEN 'DEAD/DNC Email' "
            f"WHEN {nl('s.email_address')} IN (SELECT key FROM rpc) THEN 'RPC+ Email' {dom}"
            f"ELSE '' END AS suppression_reason FROM {src} s)")
    keyed = (f"{p}keyed AS (SELECT k.*, {dg(tel)} AS _tel, {dg(dtel)} AS _dtel, "
             f"({dg(dtel)} <> '' AND {dg(dtel)} IN (SELECT phone FROM direct)) AS _is_direct FROM {p}supp k)")
    universe = (f"{p}universe AS (SELECT _tel AS phone FROM {p}keyed WHERE suppression_reason = '' AND _tel <> '' "
                f"UNION SELECT _dtel FROM {p}keyed WHERE suppression_reason = '' AND _is_direct AND _dtel <> '')")
    counts = (f"{p}counts AS (SELECT u.phone AS dialed_number, "
              "COUNT(DISTINCT CASE WHEN h.pbx_dialing_date = DATE '2024-01-18' THEN h.call_id END) AS daily_count, "
              "COUNT(DISTINCT CASE WHEN isoyear(h.pbx_dialing_date) = 2024 AND week(h.pbx_dialing_date) = 3 "
              f"THEN h.call_id END) AS weekly_count FROM {p}universe u LEFT JOIN hist h ON h.dialed_number = u.phone "
              "GROUP BY u.phone)")
    dw, dd = "coalesce(cd.weekly_count, 0)", "coalesce(cd.daily_count, 0)"
    w, d = "coalesce(ct.weekly_count, 0)", "coalesce(ct.daily_count, 0)"
    reason = ("CASE WHEN k.suppression_reason <> '' THEN '' WHEN k._tel = '' THEN '' "
              f"WHEN k._is_direct AND {dw} > 15 THEN 'Direct-dial weekly limit exceeded: ' || CAST({dw} AS VARCHAR) "
              "|| ' dials this ISO week (max 15, Direct Number in repo)' "
              f"WHEN k._is_direct AND {dd} > 15 THEN 'Direct-dial daily limit exceeded: ' || CAST({dd} AS VARCHAR) "
              "|| ' dials on 2024-01-18 (max 15, Direct Number in repo)' "
              f"WHEN {w} > 15 THEN 'Weekly dial limit exceeded: ' || CAST({w} AS VARCHAR) || ' dials this ISO week (max 15)' "
              f"WHEN {d} > 3 THEN 'Daily dial limit exceeded: ' || CAST({d} AS VARCHAR) || ' dials on 2024-01-18 (max 3)' "
              "ELSE '' END")
    tagged0 = (f"{p}tagged0 AS (SELECT k.*, {reason} AS dial_limit_reason FROM {p}keyed k "
               f"LEFT JOIN {p}counts ct ON ct.dialed_number = k._tel "
               f"LEFT JOIN {p}counts cd ON k._is_direct AND cd.dialed_number = k._dtel)")
    tagged = (f"{p}tagged AS (SELECT *, CASE WHEN suppression_reason <> '' THEN 'SUPPRESSED' "
              f"WHEN dial_limit_reason <> '' THEN 'OVER_LIMIT' ELSE 'GTG' END AS row_status FROM {p}tagged0)")
    return [supp, keyed, universe, counts, tagged0, tagged]


# output column -> canonical source column (None = constant '')
_OUT_SRC = {
    "firstname": "first_name", "lastname": "last_name", "fullname": "full_name", "email_address": "email_address",
    "job_title": "org_title", "job_level": "job_level", "extension": "ext", "new_function": "job_function",
    "c_street": "address1", "c_city": "city", "c_state": "state", "c_postalcode": "postal_code",
    "c_country": "country", "datascore": "qs", "Home Location": "home_location", "Work Location": "work_location",
    "Skills": "skills", "contactsource": "data_source", "company_name": "org_name", "website": "domain",
    "sic_code": "sic_code", "naic_code": "naic_code", "li_industry": "industry_type", "emp_range": "employee_size",
    "rev_range": "revenue_size", "companySource": "data_source", "street": "address1", "city": "city",
    "state": "state", "postalcode": "postal_code", "country": "country", "campaign_code": "campaign_name",
    "Revenue Link": "revenue_link", "SIC/NAICS Code Link": "sic_naics_link", "WP Status": "wp_status",
    "comp_desc": "org_description", "AC_List_Mapping": "ac_list_mapping", "asset_title": "asset_pitched",
    "open_click_status": "open_click_status", "intent": "intent",
}


def output_ctes(src: str, present: list[str], prefix: str = "o") -> tuple[list[str], str]:
    """Validation, cleaning and the 66-column projection of CTE ``src``
    (columns ``present`` + src_ord, row_ord).  Returns (ctes, final CTE name)."""
    p = prefix
    col = lambda c: (c if c in present else "''")
    tel = col("telephone")
    stat, reas = phone_cols(tel, "_pc")
    v1 = f"{p}v1 AS (SELECT *, {SEP.format(x=tel)} AS _pc FROM {src})"
    if "telephone" in present:
        v2 = f"{p}v2 AS (SELECT *, {stat} AS tel_valid, {reas} AS tel_reason FROM {p}v1)"
    else:
        v2 = f"{p}v2 AS (SELECT *, 'unknown' AS tel_valid, 'No telephone column in input' AS tel_reason FROM {p}v1)"
    url_c = url(col("profile_url"))
    tel_c = dg(tel)
    dn = dg(col("direct_number")) if "direct_number" in present else "''"
    cl = (f"{p}cl AS (SELECT *, {url_c} AS _url, {tel_c} AS _tel_c, {dn} AS _dn, "
          f"{tz(col('country'), col('state'))} AS _tz FROM {p}v2)")
    e = {}
    camp = col("campaign_name")
    for o in OUTPUT_COLUMNS:
        if o in _OUT_SRC:
            e[o] = col(_OUT_SRC[o])
        else:
            e[o] = "''"
    e.update({
        "contactid": fp("_url", col("full_name")), "companyid": fp(col("org_name"), col("country")),
        "contact_li_url": "_url", "phone_office": "_tel_c", "contactphone1": "_tel_c",
        "phone_direct": "(CASE WHEN trim(_dn) NOT IN ('', '-', 'nan', 'None') THEN _dn ELSE '' END)",
        "company_li_url": url(col("org_li_url")), "updated_on": f"'{RUN_TS}'", "created_on": f"'{RUN_TS}'",
        "ph_area_code": f"(CASE WHEN _tel_c <> '' THEN {area('_tel_c')} ELSE '' END)", "timezone": "_tz",
        "li_cmp_md1": fp("_url", nl(camp)), "fnln_comp_cmp_md2": fp(col("full_name"), col("org_name"), nl(camp)),
        "tel_valid": "tel_valid", "tel_reason": "tel_reason",
    })
    sel = ", ".join(f'{v} AS "{k}"' for k, v in e.items())
    proj = f"{p}proj AS (SELECT src_ord, row_ord, {sel} FROM {p}cl)"
    return [v1, v2, cl, proj], f"{p}proj"


def dedup(src: str) -> str:
    return (f"SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY contactid, campaign_code "
            "ORDER BY src_ord, row_ord) = 1")


def out66(src: str) -> str:
    return "SELECT " + ", ".join(f'"{c}"' for c in OUTPUT_COLUMNS) + f" FROM ({dedup(src)})"


CONTACT_TAG = tag_ctes("collated", "k.telephone", "k.telephone", True)


def _merged() -> str:
    """J8 merge of GTG extract rows with the latest snapshot rows."""
    cols = sorted(set(EXTRACT_PRESENT) | set(CONTACT_PRESENT))
    sel = []
    override = {"email_address", "dialed_number", "direct_number"}
    for c in cols:
        f_val = f"f.{c}" if c in EXTRACT_PRESENT else "''"
        s_val = f"l.{c}" if c in CONTACT_PRESENT else "''"
        m_val = f_val if c in override else s_val
        sel.append(f"CASE WHEN l._campaign_name IS NOT NULL THEN {m_val} ELSE {f_val} END AS {c}")
    return ("merged AS (SELECT f.src_ord, f.row_ord, " + ", ".join(sel)
            + ", (l._campaign_name IS NOT NULL) AS _matched FROM xtagged f LEFT JOIN latest l "
            f"ON {nl('f.campaign_name')} = l._campaign_name AND {nl('f.contact_link')} = l._contact_link "
            f"AND {nl('f.campaign_name')} <> '')")


def _merged_all() -> str:
    return _merged().replace("FROM xtagged f", "FROM extract f").replace("merged AS", "merged_all AS")


def _contact_lists_ctes():
    return [CONTACTS, COLLATED, CALLS, LISTS, HIST]


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    base = _contact_lists_ctes()

    # S1 / C9
    toks = _in(["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])
    q["scan_blank_tokens"] = f"""
WITH raw AS (
  SELECT c_custkey AS row_ord,
    CASE c_custkey % 10 WHEN 0 THEN 'NA' WHEN 1 THEN 'N/A' WHEN 2 THEN 'null' WHEN 3 THEN 'None' WHEN 4 THEN ' nan'
      WHEN 5 THEN '#N/A' WHEN 6 THEN '' ELSE c_mktsegment END AS state,
    CASE c_nationkey % 5 WHEN 0 THEN 'NULL' WHEN 1 THEN 'n/a' WHEN 2 THEN '<NA>' ELSE CAST(c_nationkey AS VARCHAR) END AS country,
    c_name AS name FROM customer)
SELECT row_ord, CASE WHEN state IN {toks} THEN '' ELSE state END AS state,
  CASE WHEN country IN {toks} THEN '' ELSE country END AS country,
  CASE WHEN name IN {toks} THEN '' ELSE name END AS name FROM raw"""

    q["collate_formats"] = with_(CONTACTS, COLLATED) + (
        "SELECT src_ord, row_ord, campaign_name, full_name, org_name, email_address, domain, telephone, state, "
        "country, profile_url, intent FROM collated")
    q["suppression_keys"] = with_(CALLS, LISTS) + (
        "SELECT 'dead' AS list, key FROM dead UNION ALL SELECT 'rpc', key FROM rpc "
        "UNION ALL SELECT 'domain', key FROM domains")
    q["direct_dial_keys"] = with_(CALLS, LISTS) + "SELECT phone FROM direct"
    q["suppression_sizes"] = with_(CALLS, LISTS) + (
        "SELECT 'dead' AS list, COUNT(*) AS n FROM dead UNION ALL SELECT 'rpc', COUNT(*) FROM rpc "
        "UNION ALL SELECT 'domain', COUNT(*) FROM domains UNION ALL SELECT 'direct', COUNT(*) FROM direct")

    tag = with_(*base, *CONTACT_TAG)
    q["suppression_tag"] = tag + "SELECT src_ord, row_ord, email_address, domain, suppression_reason FROM supp"
    q["suppression_summary"] = tag + "SELECT suppression_reason, COUNT(*) AS n FROM supp GROUP BY suppression_reason"
    q["phone_universe"] = tag + "SELECT phone FROM universe"
    q["dial_counts"] = tag + "SELECT dialed_number, daily_count, weekly_count FROM counts"
    q["phone_coverage"] = tag + (
        "SELECT 'tel_nonblank' AS metric, COUNT(*) FILTER (WHERE _tel <> '') AS value FROM keyed WHERE suppression_reason = '' "
        "UNION ALL SELECT 'dtel_nonblank', COUNT(*) FILTER (WHERE _dtel <> '') FROM keyed WHERE suppression_reason = '' "
        "UNION ALL SELECT 'direct_in_list', COUNT(DISTINCT _dtel) FILTER (WHERE _is_direct AND _dtel <> '') FROM keyed "
        "WHERE suppression_reason = '' UNION ALL SELECT 'phones_queried', COUNT(*) FROM universe")
    q["dial_limit_tag"] = tag + "SELECT src_ord, row_ord, suppression_reason, dial_limit_reason, row_status FROM tagged"
    q["limit_breakdown"] = tag + (
        "SELECT dial_limit_reason, COUNT(*) AS n FROM tagged WHERE row_status = 'OVER_LIMIT' GROUP BY dial_limit_reason")

    q["phone_clean"] = with_(CONTACTS) + f"SELECT row_ord, tel, {dg('tel')} AS tel_digits FROM contacts"
    st, rs = phone_cols("tel", "_pc")
    q["phone_validate"] = with_(CONTACTS) + (
        f"SELECT row_ord, tel, {st} AS tel_valid, {rs} AS tel_reason FROM "
        f"(SELECT row_ord, tel, {SEP.format(x='tel')} AS _pc FROM contacts)")
    st2, _ = phone_cols("telephone", "_pc")
    val = (f"val AS (SELECT src_ord, row_ord, telephone, {st2} AS tel_valid FROM "
           f"(SELECT *, {SEP.format(x='telephone')} AS _pc FROM collated))")
    q["phone_profile"] = with_(CONTACTS, COLLATED, val) + (
        "SELECT s.tel_valid, COUNT(v.tel_valid) AS n, CAST(round(CAST(100.0 * COUNT(v.tel_valid) AS DOUBLE) / "
        "(SELECT COUNT(*) FROM val), 1) AS DOUBLE) AS pct FROM (VALUES ('valid'), ('possible'), ('invalid'), ('empty')) "
        "s(tel_valid) LEFT JOIN val v ON v.tel_valid = s.tel_valid GROUP BY s.tel_valid")
    q["invalid_sample"] = with_(CONTACTS, COLLATED, val) + (
        "SELECT src_ord, row_ord, telephone AS tel FROM val WHERE tel_valid = 'invalid' ORDER BY src_ord, row_ord LIMIT 5")
    q["url_clean"] = f"SELECT page_id AS row_ord, url, {url('url')} AS url_clean FROM pages"
    q["timezone_map"] = with_(CONTACTS) + f"SELECT row_ord, country, state, {tz('country', 'state')} AS timezone FROM contacts"
    q["area_code"] = with_(CONTACTS) + f"SELECT row_ord, tel, {area('tel')} AS ph_area_code FROM contacts"
    q["fingerprints"] = with_(CONTACTS, COLLATED) + (
        f"SELECT src_ord, row_ord, {fp(url('profile_url'), 'full_name')} AS contactid, "
        f"{fp('org_name', 'country')} AS companyid, {fp(url('profile_url'), nl('campaign_name'))} AS li_cmp_md1, "
        f"{fp('full_name', 'org_name', nl('campaign_name'))} AS fnln_comp_cmp_md2, "
        f"{fp('first_name', 'last_name', url('profile_url'))} AS contacted FROM collated")
    dn = ("SELECT row_ord, CASE event_type WHEN 'click' THEN '-' WHEN 'view' THEN 'nan' WHEN 'error' THEN ' ' "
          "ELSE dialed_raw END AS d1, CASE event_type WHEN 'error' THEN 'None' WHEN 'view' THEN '' "
          "ELSE concat('+1 ', dialed_number) END AS d2, CASE WHEN event_type = 'view' THEN dialed_number ELSE '' END AS d0 "
          "FROM calls")
    us = "NOT IN ('', '-', 'nan', 'None')"
    q["first_usable_phone"] = with_(CALLS, f"dn AS ({dn})") + (
        f"SELECT row_ord, CASE WHEN trim(d1) {us} THEN d1 WHEN trim(d2) {us} THEN d2 WHEN trim(d0) {us} THEN d0 "
        "ELSE '' END AS phone_direct FROM dn")
    spelled = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y", "%-m/%-d/%Y", "%Y-%m-%d %H:%M", "%-m/%-d/%Y %-I:%M:%S %p",
               "%d-%b-%Y", "%Y-%m-%dT%H:%M:%SZ", "%Y%m%d", "%Y-%-m-%-d", "%-m/%-d/%Y %-H:%M", "%Y/%-m/%-d"]
    rawd = ("CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '-' ELSE 'x' END "
            + " ".join(f"WHEN event_id % 13 = {i} THEN strftime(ts, '{f}')" for i, f in enumerate(spelled)) + " ELSE '' END")
    q["date_parse"] = (f"SELECT row_ord, raw, {pdate('raw')} AS parsed FROM "
                       f"(SELECT event_id AS row_ord, {rawd} AS raw FROM events)")
    q["iso_week"] = ("SELECT row_ord, d, CAST(isoyear(d) AS INTEGER) AS iso_year, CAST(week(d) AS INTEGER) AS iso_week, "
                     "CAST(date_trunc('week', d) AS DATE) AS week_start FROM "
                     "(SELECT event_id AS row_ord, CAST(ts AS DATE) AS d FROM events)")

    # history
    hist_cols = ", ".join(HISTORY_COLUMNS)
    q["history_align"] = with_(CALLS) + f"SELECT {hist_cols}, row_ord FROM ({hist_select()})"
    hx = [CALLS,
          f"s0 AS ({hist_select('pbx_dialing_date < DATE ' + chr(39) + '2024-01-20' + chr(39))})",
          "store AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY call_id, dialed_number ORDER BY src_ord, row_ord) = 1)",
          f"b AS ({hist_select('pbx_dialing_date >= DATE ' + chr(39) + '2024-01-13' + chr(39))})",
          "bd AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY call_id, dialed_number ORDER BY src_ord, row_ord) = 1)",
          "fresh AS (SELECT * FROM bd WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.call_id = bd.call_id "
          "AND s.dialed_number = bd.dialed_number))",
          "store2 AS (SELECT * FROM store UNION ALL SELECT * FROM fresh)"]
    hout = "row_ord, call_id, dialed_number, pbx_dialing_date, email_address, dgs_disposition, system_disposition, campaign_name, contact_link"
    q["history_ingest"] = with_(*hx) + f"SELECT {hout} FROM fresh"
    q["history_ingest_counts"] = with_(*hx) + (
        "SELECT (SELECT COUNT(*) FROM b) AS total, (SELECT COUNT(*) FROM fresh) AS inserted, "
        "(SELECT COUNT(*) FROM b) - (SELECT COUNT(*) FROM fresh) AS skipped")
    q["history_profile"] = with_(*hx) + (
        "SELECT COUNT(*) AS total_rows, COUNT(DISTINCT campaign_name) AS campaigns, COUNT(DISTINCT contact_link) AS contacts, "
        "MIN(pbx_dialing_date) AS earliest_date, MAX(pbx_dialing_date) AS latest_date FROM store2")
    q["history_profile_kept"] = with_(*hx) + (
        "SELECT COUNT(*) AS total_rows, TRUE AS campaigns_near, TRUE AS contacts_near, "
        "MIN(pbx_dialing_date) AS earliest_date, MAX(pbx_dialing_date) AS latest_date FROM store2")
    q["history_match"] = with_(*hx, EXTRACT) + (
        "SELECT e.row_ord, e.campaign_name, e.contact_link FROM extract e JOIN (SELECT DISTINCT "
        f"{nl('campaign_name')} AS camp, {nl('contact_link')} AS link FROM store2) pc "
        f"ON {nl('e.campaign_name')} = pc.camp AND {nl('e.contact_link')} = pc.link")
    q["history_ingest_stream"] = with_(CALLS, f"a AS ({hist_select()})") + (
        f"SELECT {hout} FROM a QUALIFY row_number() OVER (PARTITION BY call_id, dialed_number "
        "ORDER BY src_ord, row_ord) = 1")
    batches = (f"SELECT *, '{OLD_BATCH_ID}' AS batch_id FROM store UNION ALL SELECT *, '{BATCH_ID}' AS batch_id FROM fresh")
    q["history_store"] = with_(*hx) + f"SELECT {hout}, batch_id FROM ({batches})"
    q["history_loads"] = with_(*hx) + (
        f"SELECT '{OLD_BATCH_ID}' AS batch_id, TIMESTAMP '2024-01-01 00:00:00' AS loaded_at, "
        "(SELECT COUNT(*) FROM s0) AS total, (SELECT COUNT(*) FROM store) AS inserted UNION ALL "
        f"SELECT '{BATCH_ID}', TIMESTAMP '{RUN_TS}', (SELECT COUNT(*) FROM b), (SELECT COUNT(*) FROM fresh) UNION ALL "
        f"SELECT '{BATCH_ID}', TIMESTAMP '{RUN_TS}', (SELECT COUNT(*) FROM b), 0")
    week = ("kept AS (SELECT dialed_number, COUNT(*) FILTER (WHERE pbx_dialing_date = DATE '2024-01-18') AS daily_count, "
            "COUNT(*) AS weekly_count FROM store2 WHERE pbx_dialing_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' "
            "GROUP BY dialed_number)")
    q["dial_counts_kept"] = with_(*hx, week) + "SELECT * FROM kept"
    q["dial_limit_kept"] = with_(CONTACTS, COLLATED, CALLS, LISTS, *hx[1:], "hist AS (SELECT * FROM store2)", *CONTACT_TAG) + (
        "SELECT src_ord, row_ord, suppression_reason, dial_limit_reason, row_status FROM tagged")
    q["history_preview"] = with_(*hx) + (
        "SELECT row_ord, call_id, dialed_number, pbx_dialing_date FROM store2 ORDER BY src_ord, row_ord LIMIT 200")

    # output
    gtg = "gtg AS (SELECT * FROM tagged WHERE row_status = 'GTG')"
    octes, last = output_ctes("gtg", CONTACT_PRESENT)
    q["output_projection"] = with_(*base, *CONTACT_TAG, gtg, *octes) + f"SELECT * FROM {last}"
    q["contact_run"] = with_(*base, *CONTACT_TAG, gtg, *octes) + out66(last)
    octes2, last2 = output_ctes("collated", CONTACT_PRESENT, "w")
    q["output_dedup"] = with_(CONTACTS, COLLATED, *octes2) + (
        f"SELECT src_ord, row_ord, contactid, campaign_code, fullname, contact_li_url FROM ({dedup(last2)})")

    # snapshot
    q["snapshot_rows"] = with_(CONTACTS, COLLATED) + (
        f"SELECT src_ord, row_ord, '{BATCH_ID}' AS batch_id, TIMESTAMP '{RUN_TS}' AS loaded_at, "
        f"{nl('campaign_name')} AS campaign_key, {nl('profile_url')} AS link_key, campaign_name, profile_url FROM collated")
    idx = ("idx AS (SELECT batch_id, _campaign_name AS campaign_name, _contact_link AS contact_link, loaded_at FROM snap "
           "WHERE _campaign_name <> '' AND _contact_link <> '' QUALIFY row_number() OVER "
           "(PARTITION BY _campaign_name, _contact_link ORDER BY batch_id DESC, src_ord, row_ord) = 1)")
    q["snapshot_latest"] = with_(CONTACTS, SNAP, idx) + "SELECT * FROM idx"
    q["snapshot_index"] = q["snapshot_latest"]
    q["snapshot_profile"] = with_(CONTACTS, SNAP, idx) + (
        "SELECT COUNT(*) AS total_rows, COUNT(DISTINCT campaign_name) AS campaigns, MIN(loaded_at) AS earliest, "
        "MAX(loaded_at) AS latest FROM idx")
    q["snapshot_profile_kept"] = with_(CONTACTS, SNAP, idx) + (
        "SELECT COUNT(*) AS total_rows, TRUE AS campaigns_near, MIN(loaded_at) AS earliest, MAX(loaded_at) AS latest FROM idx")
    q["snapshot_lookup"] = with_(CONTACTS, SNAP, EXTRACT) + (
        "SELECT batch_id, src_ord, row_ord, campaign_name, profile_url, full_name FROM latest l WHERE EXISTS "
        f"(SELECT 1 FROM extract e WHERE {nl('e.campaign_name')} = l._campaign_name AND {nl('e.contact_link')} = l._contact_link)")
    q["snapshot_index_lookup"] = q["snapshot_lookup"]
    q["rechurn_merge"] = with_(CONTACTS, SNAP, EXTRACT, _merged_all()) + (
        "SELECT src_ord, row_ord, campaign_name, full_name, profile_url, contact_link, email_address, dialed_number, "
        "direct_number, asset_pitched, org_name, telephone, qa_final_status, _matched FROM merged_all")

    # QA filters
    from ..operators.qa import GTG_VALUES, NON_GTG_VALUES, RECHURN_KEYWORDS
    kw = " OR ".join(f"contains(lower(trim(dgs)), {_q(k)})" for k in RECHURN_KEYWORDS)
    q["rechurn_filter"] = with_(CALLS) + f"SELECT row_ord, dgs AS dgs_disposition FROM calls WHERE {kw}"
    g = f"{nl('qa_final_status')} IN {_in(GTG_VALUES)}"
    ng = f"{nl('qa_final_status')} IN {_in(NON_GTG_VALUES)}"
    q["gtg_filter"] = with_(EXTRACT, f"flags AS (SELECT bool_or({g}) AS has_g, bool_or({ng}) AS has_n FROM extract)") + (
        f"SELECT e.row_ord, e.qa_final_status FROM extract e, flags WHERE CASE WHEN flags.has_g THEN {g} "
        f"WHEN flags.has_n THEN NOT ({ng}) ELSE TRUE END")

    # P2
    xtag = tag_ctes("extract", "k.dialed_number", "k.direct_number", False, "x")
    xallowed = "xgtg AS (SELECT * FROM xtagged WHERE row_status = 'GTG')"
    merged = _merged().replace("FROM xtagged f", "FROM xgtg f")
    mpresent = sorted(set(EXTRACT_PRESENT) | set(CONTACT_PRESENT))
    octes3, last3 = output_ctes("merged", mpresent, "r")
    q["rechurn_run"] = with_(*base, SNAP, EXTRACT, *xtag, xallowed, merged, *octes3) + out66(last3)

    q["rechurn_removed"] = with_(*base, EXTRACT, *xtag) + (
        "SELECT row_ord, suppression_reason, dial_limit_reason, row_status FROM xtagged WHERE row_status <> 'GTG'")

    # extract's GTG output: latest snapshot rows matched by extract keys (no QA column -> all kept)
    gm = ("gmatch AS (SELECT * FROM latest l WHERE EXISTS (SELECT 1 FROM extract e WHERE "
          f"{nl('e.campaign_name')} = l._campaign_name AND {nl('e.contact_link')} = l._contact_link))")
    octes4, last4 = output_ctes("gmatch", CONTACT_PRESENT, "g")
    q["rechurn_gtg_output"] = with_(CONTACTS, SNAP, EXTRACT, gm, *octes4) + out66(last4)

    # audit
    labels = [("campaign_name", "Campaign Name"), ("full_name", "Full name"), ("org_name", "Organization 1"),
              ("email_address", "EmailAddress"), ("domain", "Domain"), ("telephone", "TelephoneNumber"),
              ("state", "State"), ("country", "Country"), ("profile_url", "Profile url"), *FILLED_LABELS,
              ("intent", "Intent")]
    jbase = ", ".join(f"{_q(lbl)}, {c}" for c, lbl in labels) + ", 'suppression_reason', suppression_reason"
    row_json = (f"CASE WHEN row_status = 'SUPPRESSED' THEN CAST(json_object({jbase}) AS VARCHAR) "
                f"ELSE CAST(json_object({jbase}, 'dial_limit_reason', dial_limit_reason) AS VARCHAR) END")
    bc = ("bc AS (SELECT coalesce((SELECT trim(campaign_name) FROM tagged WHERE trim(campaign_name) <> '' ORDER BY "
          "CASE row_status WHEN 'GTG' THEN 1 WHEN 'SUPPRESSED' THEN 2 ELSE 3 END, src_ord, row_ord LIMIT 1), '') AS camp)")
    camp = "CASE WHEN trim(campaign_name) IN ('', 'nan', 'None', '-') THEN (SELECT camp FROM bc) ELSE trim(campaign_name) END"
    audit = (f"audit AS (SELECT src_ord, row_ord, '{BATCH_ID}' AS batch_id, TIMESTAMP '{RUN_TS}' AS processed_at, "
             f"{camp} AS campaign_code, {camp} AS campaign_name, 'NON-DELL' AS campaign_type, row_status, suppression_reason, "
             f"CASE WHEN row_status = 'OVER_LIMIT' THEN dial_limit_reason ELSE '' END AS dial_limit_reason, "
             f"{row_json} AS row_json FROM tagged)")
    q["audit_rows"] = with_(*base, *CONTACT_TAG, bc, audit) + "SELECT * FROM audit"
    q["audit_summary"] = with_(*base, *CONTACT_TAG, bc, audit) + (
        "SELECT batch_id, coalesce(nullif(trim(campaign_name), ''), nullif(trim(campaign_code), ''), '—') AS campaign, "
        "campaign_type, MIN(processed_at) AS processed_at, COUNT(*) AS total_rows, "
        "CAST(SUM(CASE WHEN row_status = 'GTG' THEN 1 ELSE 0 END) AS BIGINT) AS gtg, "
        "CAST(SUM(CASE WHEN row_status = 'SUPPRESSED' THEN 1 ELSE 0 END) AS BIGINT) AS suppressed, "
        "CAST(SUM(CASE WHEN row_status = 'OVER_LIMIT' THEN 1 ELSE 0 END) AS BIGINT) AS over_limit "
        "FROM audit GROUP BY ALL ORDER BY processed_at DESC")
    q["export_removed"] = tag + (
        "SELECT full_name, email_address, profile_url, suppression_reason, dial_limit_reason, row_status "
        "FROM tagged WHERE row_status <> 'GTG'")
    q["run_metrics"] = with_(*base, *CONTACT_TAG, gtg, *octes) + (
        "SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE row_status = 'GTG') AS gtg_rows, "
        "COUNT(*) FILTER (WHERE row_status = 'SUPPRESSED') AS suppressed, "
        "COUNT(*) FILTER (WHERE row_status = 'OVER_LIMIT') AS over_limit, "
        f"COUNT(*) FILTER (WHERE row_status = 'GTG') - (SELECT COUNT(*) FROM ({dedup(last)})) AS dedup_removed FROM tagged")
    q["campaign_list"] = with_(CONTACTS, COLLATED) + (
        "SELECT coalesce(string_agg(c, ', ' ORDER BY c), '') AS campaigns FROM "
        "(SELECT DISTINCT trim(campaign_name) AS c FROM collated WHERE trim(campaign_name) <> '')")
    q["campaign_first"] = with_(CONTACTS, COLLATED) + (
        "SELECT coalesce((SELECT trim(campaign_name) FROM collated WHERE trim(campaign_name) <> '' "
        "ORDER BY src_ord, row_ord LIMIT 1), '') AS campaign_code")

    runs = """runs AS (
  SELECT o_orderkey AS id, o_orderdate AS logged_at, concat('user', CAST(o_custkey % 5 AS VARCHAR)) AS username,
    CASE o_orderkey % 3 WHEN 0 THEN 'rechurn' ELSE 'contact' END AS pipeline,
    concat('b', CAST(o_orderkey % 200 AS VARCHAR)) AS batch_id,
    CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_orderpriority END AS campaign_name,
    o_orderkey % 1000 AS total_rows, o_orderkey % 700 AS gtg_rows, o_orderkey % 200 AS suppressed,
    o_orderkey % 100 AS over_limit
  FROM orders)"""
    q["run_stats"] = with_(runs) + (
        "SELECT pipeline, COUNT(*) AS runs, CAST(SUM(total_rows) AS BIGINT) AS total_rows, "
        "CAST(SUM(gtg_rows) AS BIGINT) AS gtg_rows, CAST(SUM(suppressed) AS BIGINT) AS suppressed, "
        "CAST(SUM(over_limit) AS BIGINT) AS over_limit, MAX(logged_at) AS last_run FROM runs GROUP BY pipeline "
        "ORDER BY last_run DESC")
    q["grand_totals"] = with_(runs) + (
        "SELECT CAST(SUM(total_rows) AS BIGINT) AS total_rows, CAST(SUM(gtg_rows) AS BIGINT) AS gtg_rows, "
        "CAST(SUM(suppressed) AS BIGINT) AS suppressed, CAST(SUM(over_limit) AS BIGINT) AS over_limit FROM runs")
    q["activity_topk"] = with_(runs) + (
        "SELECT id, logged_at, username, pipeline, batch_id, coalesce(nullif(trim(campaign_name), ''), '—') AS campaign, "
        "total_rows, gtg_rows, suppressed, over_limit FROM runs ORDER BY logged_at DESC, id DESC LIMIT 1000")

    # list maintenance (K5)
    up = "up AS (SELECT * FROM calls WHERE pbx_dialing_date >= DATE '2024-01-13')"
    olddead = ("olddead AS (SELECT email AS ex FROM calls WHERE pbx_dialing_date < DATE '2024-01-20' "
               "AND dgs IN ('Dead Contact', 'DNC Prospect'))")
    q["dead_list_update"] = with_(CALLS, up, olddead) + (
        f"SELECT DISTINCT email FROM (SELECT {nl('ex')} AS email FROM olddead UNION ALL "
        f"SELECT {nl('email')} FROM up WHERE {nl('dgs')} IN ('dead contact', 'dnc prospect') AND {nl('email')} <> '')")
    oldrpc = ("oldrpc AS (SELECT email, dgs AS disposition, '2024-01-12' AS dialing_date, row_ord FROM calls "
              "WHERE pbx_dialing_date < DATE '2024-01-20' AND dgs IN ('Prospect Call Back', 'BANT Lead'))")
    from ..operators.suppress import RPC_DISPOSITIONS
    q["rpc_list_update"] = with_(CALLS, up, oldrpc) + (
        "SELECT email, disposition, dialing_date FROM ("
        f"SELECT {nl('email')} AS email, disposition, dialing_date, 1 AS ver, row_ord FROM oldrpc UNION ALL "
        f"SELECT {nl('email')}, trim(dgs), '2024-02-10', 2, row_ord FROM up WHERE {nl('dgs')} IN {_in(RPC_DISPOSITIONS)} "
        f"AND {pdate('pbx_text')} >= DATE '2024-01-10' AND {nl('email')} <> '') "
        "QUALIFY row_number() OVER (PARTITION BY email ORDER BY ver DESC, row_ord DESC) = 1")
    # two uploads (before 01-20, from 01-13), each extending the lists
    ups = ("ups AS (SELECT *, 1 AS ver FROM calls WHERE pbx_dialing_date < DATE '2024-01-20' UNION ALL "
           "SELECT *, 2 FROM calls WHERE pbx_dialing_date >= DATE '2024-01-13')")
    q["list_growth"] = with_(CALLS, ups) + (
        f"SELECT DISTINCT 'dead' AS list, {nl('email')} AS email, '' AS disposition FROM ups "
        f"WHERE {nl('dgs')} IN ('dead contact', 'dnc prospect') AND {nl('email')} <> '' UNION ALL "
        f"SELECT 'rpc', email, disposition FROM (SELECT {nl('email')} AS email, trim(dgs) AS disposition, ver, row_ord FROM ups "
        f"WHERE {nl('dgs')} IN {_in(RPC_DISPOSITIONS)} AND {pdate('pbx_text')} >= DATE '2024-01-10' AND {nl('email')} <> '') "
        "QUALIFY row_number() OVER (PARTITION BY email ORDER BY ver DESC, row_ord DESC) = 1")
    return q
