"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one:
language identification drops what has no language, line dedup cuts repeated runs of lines, near-dedup keeps one
document of each group, decontamination drops documents that hold benchmark phrases, packing deals tokens out to
sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import language, lines, near_duplicates, packing, postings
from docflow.llm.common import recorded, remove, shared_path, write_to
from docflow.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised.  Rejected: null texts, texts without a letter, and texts of which
    no n-gram is known in any language."""
    found = language.predict(docs.select(F.struct("*").alias("doc"), "text"), language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") > 0)).select("doc.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; one of which nothing but white space is left goes."""
    # The other columns go along as one; the text, which line dedup writes with them, only once.
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")
    found = lines.dedup(docs.select(others, "doc_id", "text"))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.where(~F.coalesce(emptied, F.lit(False))).select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays.  Documents with a null or empty text, or without words, are in no group and
    stay.
    """
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten consecutive words of a benchmark item occur.

    Null and empty texts stay, repeated rows are judged alike, and items without words match nothing.
    """
    return postings.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their places in sequences of at most 2048 tokens.

    A null text counts as empty: one piece with the end token.  Which sequence takes which of equally long pieces is free.
    """
    return packing.assign(packing.tokenize(docs, tokenizer_path()))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Languages, near duplicates and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`.  What a stage leaves in the shared folder goes once its result is written; the
    result of the last one is read from its own tables, which stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        left: list[str] = []
        with recorded(left):
            docs = write_to(stage(spark, docs, sf_dir), shared_path(spark, name))
        remove(spark, *left)
    return STAGES[-1][1](spark, docs, sf_dir)
