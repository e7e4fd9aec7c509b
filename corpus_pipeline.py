"""The corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``, and any others that docs have, whatever their names.

Texts of any length are judged whole. Documents whose text is null, empty or without letters go in the first stage. Rows
that repeat an id are judged each by its own text, and of rows that repeat id and words one stays. Documents without
an id are no duplicates of any. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverloom.llm import common, decontaminate, language, minhash, mixture, token_files
from riverloom.llm.queries import tokenizer_path

#: A text whose best language holds less of its letters than this is rejected, as is one without letters.
LEAST_SCORE = 0.3


def _aside(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that an operator's own would replace under other names, and what restores them all."""
    other = {c: f"__own_{c}" for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model is fitted on a bounded sample of the labelled ones."""
    common.wide_rows(spark)
    docs, columns = _aside(docs, ("lang_pred", "score", "spans"))
    model = language.learn(docs)
    found = language.predict(docs, model, spans=False)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest id; see ``minhash.keep_one``."""
    common.wide_rows(spark)
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no phrase of a benchmark item stands."""
    common.wide_rows(spark)
    docs, columns = _aside(docs, ("n_words", "spans", "items"))
    found = decontaminate.scan(docs, common.table(spark, sf_dir, "benchmark"), keep_text=True)
    return found.where(F.size("spans") == 0).select(*columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the partial round counts from half a document on."""
    docs, columns = _aside(docs, ("size", "source_size", "target", "taken"))
    return mixture.copies(mixture.mix(docs)).select(*columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what a reader finds in them: doc_id, start, n_tokens, ids_crc32."""
    common.wide_rows(spark)
    folder = common.new_folder(spark, "tokens")
    manifest = token_files.write_token_files(docs, folder, tokenizer_path(), end_id=2)
    return token_files.read_token_files(spark, folder, manifest)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: Learnt models, hashing and tokens can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again.

    Tables between the stages are deleted at the end; the token files and the returned digest stay.
    """
    with common.Scratch(spark) as scratch:
        docs = common.table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
