"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns the columns of documents; the last returns the ids of the
encoded texts and digests. Stages are written and read again between them, so a lost
executor costs its tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe, decontam, linededup, neardup, toxicity
from quernel.llm.scratch import Scratch

#: Documents that score this much or more are rejected.
TOXIC_FROM = 0.3


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts the class-conditional models do not call toxic; null and empty texts and null ids stay.

    The models learn from the labelled documents outside the held-out
    quarter. Rows are judged one by one, those that share a doc_id too.
    """
    labels = _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.train(docs.filter(~out), labels.filter(~out))
    return toxicity.keep_clean(docs, model, TOXIC_FROM)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller doc_id has; n_chars follows the text."""
    cut = linededup.dedup_lines(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates: 5-word shingles, similarity of 80 %.

    Line dedup has taken the lines that a near copy shares with its original,
    so what is left of it resembles nothing. Documents are therefore compared
    as they are now and, where that differs, as the table of documents has
    them, and blank remnants of copies go with them. A document that lost all
    its lines to several others, without being a near copy of one, stays as
    an empty text. Null ids stay, rows that share an id
    go or stay together, other columns are carried along.
    """
    return neardup.keep_one(docs, k=5, per_cent=80, further=_read(spark, sf_dir, "documents").select("doc_id", "text"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks. Null ids stay; rows that share an id go if an item leaks into one; other columns are carried along."""
    return decontam.drop_leaks(docs, _read(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and digests of the ids and of the decoded text; null and empty texts have no ids."""
    return bpe.encode_texts(docs.select("doc_id", "text"), digest=True, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: Models, similarity groups and token ids are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has read goes when its result is kept."""
    scratch = Scratch(spark, "pipeline")
    docs, before = _read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
