"""The driver's ``opN_*`` queries: each applies its operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, idfiles, lexical, linededup, minhash, mixing, phrases, quality, secrets, sharding, spotsigs,
               tokencount, whitening)
from .common import shared_folder, table

#: Documents whose labels never train: crc32 of the id's text, mod 4, is 2.
HELD_OUT = "crc32(cast(id as string)) % 4 = 2"


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file, from the installed package that holds them."""
    import public_tokenizers
    return os.fspath(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    return (mixing.plan(table(spark, d, "documents"))
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "rate"))


def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    pieces, byte_fallback = tokencount.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    return tokencount.count_tokens(table(spark, d, "documents"), pieces, byte_fallback)


def op4_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return (linededup.drop_repeats(table(spark, d, "documents"))
            .select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2("kept_text", 256).alias("kept_sha256")))


def op5_token_files(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "ids")
    docs = table(spark, d, "documents")
    manifest = idfiles.write_files(docs, folder, tokenizer_file("byte_bpe_50k.json"))
    return idfiles.read_files(spark, folder, manifest, kind=docs.schema["doc_id"].dataType)


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality.fit(docs, table(spark, d, "labels"), train=f"not ({HELD_OUT})")
    return (quality.score(docs, model)
            .select("doc_id", F.coalesce(F.expr(HELD_OUT.replace("id", "doc_id")), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")))


def op7_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_groups(table(spark, d, "documents"))


def op8_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return spotsigs.edited_digest(table(spark, d, "documents"))


def op9_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, d, "documents")))


def op10_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, d, "documents"), texts=False)


def op11_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.digest(sharding.assign(table(spark, d, "documents")))


def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    model = whitening.fit(rows)
    return whitening.components_of(whitening.whiten(rows, model), model)


def op13_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_near_dedup": op7_near_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_sharding": op11_sharding,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}

#: DuckDB SQL where SQL expresses the query; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op4_line_dedup": linededup.ORACLE,
    "op7_near_dedup": minhash.oracle(),
    "op9_secret_scan": secrets.oracle(),
    "op10_substring_dedup": phrases.oracle(),
    "op11_sharding": sharding.oracle(),
    "op13_lexical_search": lexical.oracle(),
}
