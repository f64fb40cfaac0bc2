"""CSV / Parquet scans, NA tokens, duplicate headers, collation order."""

from dialsieve.sources.lists import direct_dial_keys, suppression_keys
from dialsieve.sources.tabular import collate, read_table


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_scan_tokens_and_duplicate_headers(spark, scratch):
    _write(f"{scratch}/f1.csv", "row_ord, Campaign Name ,EmailAddress,EmailAddress,State\n"
                                "1,C1,a@x.com,dup@x.com,NA\n2,C1,N/A,,tx\n3,,null,x,None\n")
    df = read_table(spark, f"{scratch}/f1.csv", "csv")
    assert df.columns == ["row_ord", "Campaign Name", "EmailAddress", "State"]
    rows = [tuple(r) for r in df.orderBy("row_ord").collect()]
    assert rows == [("1", "C1", "a@x.com", ""), ("2", "C1", "", "tx"), ("3", "", "", "")]


def test_collate_formats_and_order(spark, scratch):
    _write(f"{scratch}/a.csv", "row_ord,Campaign Name,Full name,Intent\n1,C,Ann,Hot\n2,C,Bob,\n")
    _write(f"{scratch}/b.csv", "row_ord,campaign name,Full_Name\n1,D,Cy\n")
    a = read_table(spark, f"{scratch}/a.csv", "csv")
    b = read_table(spark, f"{scratch}/b.csv", "csv")
    c = collate([(a, "1"), (b, "2")])
    got = sorted((r["src_ord"], r["row_ord"], r["campaign_name"], r["full_name"], r["intent"]) for r in c.collect())
    assert got == [(1, "1", "C", "Ann", "Hot"), (1, "2", "C", "Bob", ""), (2, "1", "D", "Cy", "No Intent")]


def test_list_loaders(spark, scratch):
    _write(f"{scratch}/dead.csv", "Email ID,other\n A@X.com ,1\na@x.com,2\n,3\n")
    dead = suppression_keys(read_table(spark, f"{scratch}/dead.csv", "csv"), ["email id", "email"])
    assert sorted(r[0] for r in dead.collect()) == ["a@x.com"]
    _write(f"{scratch}/dd.csv", "dial_count,Phone Number\n3,(212) 555-0100\n1,0\n2,\n")
    dd = direct_dial_keys(read_table(spark, f"{scratch}/dd.csv", "csv"))
    assert [r[0] for r in dd.collect()] == ["2125550100"]
