"""Corpus preparation: five stages over ``documents``, each one of the training-data operators.

Every stage works on all that its predecessor kept and returns the columns of ``documents``;
the last one writes the token files and returns what it reads back from them.  Between stages
the result is written as Parquet in the shared folder and read again, so a lost executor
costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialsieve.llm import decontaminate, idfiles, minhash, mixing, quality
from dialsieve.llm.common import prepare, shared_folder, table
from dialsieve.llm.queries import HELD_OUT, tokenizer_file


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least its threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=f"not ({HELD_OUT})")
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of every group of near copies."""
    return minhash.drop_near(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source asks for."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the token files."""
    folder = shared_folder(spark, "ids")
    manifest = idfiles.write_files(docs, folder, tokenizer_file("byte_bpe_50k.json"))
    return idfiles.read_files(spark, folder, manifest, kind=docs.schema["doc_id"].dataType)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_files),
]

#: The classifier, the tilts and the tokenizer cannot be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
