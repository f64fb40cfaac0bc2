"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than space and the controls 0x09-0x0D
(in UTF-8 those bytes never occur inside a longer character).  The numpy
helpers work on one Arrow slice at a time, so a task holds a few MB of text
however many rows its partition has.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize, observed

#: Bytes of text that one numpy step handles (a longer single text is handled alone).
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch between the JVM and Python (documents can be long).
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20

WORD_RE = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: small Arrow batches, shared checkpoint folder, and
    shuffle files that go as soon as an execution has ended (results that are used again
    are checkpointed, so no later job reads them)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package, so Python tasks import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_dialsieve_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="dialsieve-"), f"{root.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(out)
    sc._dialsieve_shipped = True


def save(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder (survives lost executors)."""
    return materialize(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below the session's checkpoint folder (not yet created)."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


#: Rows of a few numbers that one task writes.
FILE_ROWS = 1 << 17


def narrowed(df: DataFrame, rows: int, per: int = FILE_ROWS) -> DataFrame:
    """The same rows in as many partitions as ``rows`` of them need, one a core at least and never more than
    before.  Small tables between wide steps cost as many tasks as the session shuffles large ones in, else."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per)))


def counted(df: DataFrame, save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(the saved rows, their number, which the job that writes them takes on the way)."""
    rows, seen = observed(df, rows=F.count(F.lit(1)))
    return save(rows), int(seen.get["rows"])


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet below the shared folder and read again.  Unlike a checkpoint, whose size
    estimate is that of its plan, the files give their true size: use it where rounds build on each other,
    for there the estimates of joins multiply until they are numbers of millions of digits."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def frequent(rows: DataFrame, key: str, per: int, most: int | None = None) -> DataFrame:
    """(key, _slots) of the keys with more than ``per`` rows, ceil(n / ``per``) slots each: counted with partial sums,
    so no task meets a key's rows, and stored, so that joins know how few they are.  ``most``: a bound of the rows' number."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per)
    counts = counts.select(key, F.ceil(F.col("n") / per).cast("int").alias("_slots"))
    return stored(counts if most is None else narrowed(counts, most), "frequent")


def dealt(rows: DataFrame, many: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with a column slot: a ``frequent`` key's rows are dealt to its slots by the hash of ``by``, others have slot 0."""
    return (rows.join(many, key, "left").withColumn("slot", F.pmod(F.xxhash64(F.lit(1), by), F.coalesce("_slots", F.lit(1))).cast("int"))
            .drop("_slots"))


def to_slots(rows: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """``rows`` once for each slot of their key."""
    return (rows.join(many, key, "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)))
            .drop("_slots"))


def spread(rows: DataFrame, key: str, by: str, per: int) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with a column slot, (key, slot) of all slots): what has to meet a key's rows goes to each
    of its slots, and no (key, slot) has many more than ``per`` rows, however frequent the key is."""
    many = frequent(rows, key, per)
    return dealt(rows, many, key, by), to_slots(rows.select(key).distinct(), many, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}".lower() in taken:
        name = f"_{name}"
    return f"_{name}"


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """All rows of a lookup table that must be small; raises beyond ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, too many to hold on the driver")
    return rows


# --- Arrow slices ------------------------------------------------------------

def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in ``column`` (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64)) if len(col) else []
    i = 0
    while i < len(col):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, n+1 offsets); null is empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return buf, offsets - offsets[0]


# --- words and n-grams as 64-bit values --------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), a bijection for a given seed."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 11)
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, grown when needed."""
    if len(_pow.get("f", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, b in (("f", _BASE), ("i", _BASE_INV)):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:  # doubling: p[have:2*have] = p[:have] * b**have
                out[have:2 * have] = out[:have] * np.uint64(pow(b, have, 1 << 64))
                have *= 2
            _pow[key] = out
    return _pow["f"][:n], _pow["i"][:n]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row) of every word, in order."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit value of each byte span (in order, apart), independent of where it stands."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):                      # bounded arrays for long inputs
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        part = buf[base:int(ends[j - 1])]
        f, inv = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[part] * f[:-1], out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * inv[a])
        i = j
    return out


def grams(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64-bit value of every k consecutive values (len(values) - k + 1 of them)."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    f, inv = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values if not seed else mix(values, seed)) * f[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * inv[:n - k + 1], seed)


def counts_by_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def as_long(x: np.ndarray) -> np.ndarray:
    """uint64 bits as Spark longs."""
    return x.view(np.int64)


def size_of(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, bytes of ``column``): one narrow aggregate, used to choose partition counts."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return int(r[0]), int(r[1] or 0)
