"""One query per operator of this subpackage over its whole table, and the SQL that states what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverloom.llm import (
    common,
    decontaminate,
    embeddings,
    hosts,
    language,
    licenses,
    minhash,
    mixture,
    oracles,
    pseudonyms,
    token_files,
    warc,
)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabularies lie; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonyms.pseudonymise(docs, key="riverloom-1")
    return found.select("doc_id", "text", "n_pseudonyms", F.array_join("kinds", ",").alias("kinds"))


def op2_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hosts.judge(common.table(spark, sf_dir, "pages"))
    scores = [F.round(c, 5).alias(c) for c in ("trust", "distrust")]
    return found.select("page_id", "host", "path", "rule", "verdict", *scores)


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(common.table(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.wide_rows(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, common.table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.wide_rows(spark)
    folder = common.new_folder(spark, "tokens")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write_token_files(docs, folder, tokenizer_path(), end_id=2)
    return token_files.read_token_files(spark, folder, manifest)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.wide_rows(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = language.learn(docs.where(~held_out))
    found = language.predict(docs.select("doc_id", "text"), model, keep_text=False, spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.wide_rows(spark)
    pages = common.table(spark, sf_dir, "pages")
    streams = warc.write_archives(pages, common.new_folder(spark, "warc-streams"))
    archives = warc.normalise(streams, common.new_folder(spark, "warc"))
    return warc.read_archives(spark, archives)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    slim = common.written(docs.select("doc_id", "source", mixture.n_words("text").alias("n"), F.xxhash64("text").alias("h")), "sizes")
    return mixture.mix(slim, size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.known_licenses(spark)).select("doc_id", "canon_sha256", "license")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.wide_rows(spark)
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pseudonyms, op2_hosts, op3_near_vectors, op4_decontaminate, op5_token_files, op6_language, op7_warc, op8_licenses, op9_near_duplicates, op10_mixture, pipeline)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
