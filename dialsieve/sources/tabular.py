"""String-typed tabular scans and multi-file collation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as X
from ..functions.text import SCAN_NA_TOKENS
from ..schema import CALL_LAYOUT, CONTACT_LAYOUT, ORDER_COLUMNS, canonicalize, dedupe_columns, q, with_labels


def blank_na(df: DataFrame, keep: Sequence[str] = ORDER_COLUMNS, tokens=SCAN_NA_TOKENS) -> DataFrame:
    """Every data column as a string; NA spellings and nulls become ''.  Headers trimmed."""
    df = dedupe_columns(df)
    return df.selectExpr(*[q(c) if c in keep else f"{X.blank_tokens(q(c), tokens)} AS {q(c)}"
                           for c in df.columns])


def read_table(spark: SparkSession, path: str, fmt: str = "csv", options: dict | None = None) -> DataFrame:
    """String-typed scan: no inference, NA tokens -> '', headers trimmed.

    CSV is read with every column as a string; Parquet/ORC columns are cast.
    ``row_ord`` is taken from the file when present, else numbered in scan
    order right after the scan (stable for a given file split)."""
    # multiLine stays off by default: a multi-line CSV file cannot be split and
    # would be read by one task; pass options={"multiLine": "true"} for files
    # with line breaks inside quoted cells
    opts = {"header": "true", "inferSchema": "false", "multiLine": "false", "escape": '"'}
    opts.update(options or {})
    if fmt == "csv":
        df = spark.read.options(**opts).csv(path)
        # the CSV reader renames duplicate headers (appending their index);
        # restore the header line's names so keep-first applies (metadata only)
        header = _csv_header(spark, path, opts)
        if header and len(header) == len(df.columns):
            df = df.toDF(*header)
    else:
        df = spark.read.format(fmt).load(path)
    if "row_ord" not in [c.strip() for c in df.columns]:
        df = df.withColumn("row_ord", F.monotonically_increasing_id())
    return blank_na(df)


def read_if_written(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet dataset, or None where the path does not exist or holds no file yet.
    Every other error is raised."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _csv_header(spark: SparkSession, path: str, opts: dict) -> list[str] | None:
    import csv
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return None
    sep = opts.get("sep", opts.get("delimiter", ","))
    return next(csv.reader([first[0][0].lstrip("\ufeff")], delimiter=sep))


def collate(files: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Union contact files of Format-1 / Format-2 by canonical name.

    ``files`` = [(frame, "1"|"2"), ...] in upload order; ``src_ord`` is the
    1-based position.  Format-2 rows get intent 'No Intent' (overwriting);
    Format-1 rows without an Intent column get ''.  Missing columns -> ''."""
    if not files:
        raise ValueError("No input files provided.")
    frames = []
    for i, (raw, fmt) in enumerate(files, start=1):
        df = canonicalize(raw, CONTACT_LAYOUT)
        if fmt == "2":
            df = df.withColumn("intent", F.lit("No Intent"))
        elif "intent" not in df.columns:
            df = df.withColumn("intent", F.lit(""))
        df = df.withColumn("src_ord", F.lit(i).cast("long"))
        frames.append(df)
    return union_blank(frames)


def collate_calls(frames: Sequence[DataFrame]) -> DataFrame:
    """Union call-extract (Format-3) files by canonical name (S3)."""
    if not frames:
        raise ValueError("No input files provided.")
    out = []
    for i, raw in enumerate(frames, start=1):
        out.append(canonicalize(raw, CALL_LAYOUT).withColumn("src_ord", F.lit(i).cast("long")))
    return union_blank(out)


def union_blank(frames: Sequence[DataFrame]) -> DataFrame:
    """unionByName with missing columns filled by '' (order columns by null)."""
    acc = frames[0]
    for f in frames[1:]:
        acc = acc.unionByName(f, allowMissingColumns=True)
    fill = [c for c in acc.columns if c not in ORDER_COLUMNS]
    out = acc.fillna("", subset=fill) if fill else acc
    labels: dict[str, str] = {}          # of the first file that has the column
    for f in frames:
        for field in f.schema:
            if field.name in fill:
                labels.setdefault(field.name, field.metadata.get("label", ""))
    return with_labels(out, {c: label for c, label in labels.items() if label})
