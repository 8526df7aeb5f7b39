"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows the one before kept. All
but the last return the columns of ``documents`` that docs has, in that order, and leave others
out; n_chars follows the text. Null texts count as empty and null keys are kept apart, as each
stage's operator says; an empty table passes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm import decontam, lines, minhash, packing, quality
from citewright.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select([F.col(f"`{c}`") for c in COLUMNS if c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Rows are judged one by one, so repeated rows fare alike; a null or empty text has a score of its
    own, from its structure. Without n_chars the text's length stands for it. Without any label
    of use all documents score 0.5 and stay.
    """
    length = F.col("n_chars") if "n_chars" in docs.columns else None
    machine = quality.train(docs, table(spark, sf_dir, "labels"), length=length)
    return _documents(quality.score(docs, machine, length=length).filter("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of three lines that occurred before, in a smaller key or further up, go.

    A document left without any text stays, empty, as does one without a key, whole; a null text
    becomes an empty one. n_chars, if there is one, is that of what is left.
    """
    left = lines.line_dedup(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _documents(left)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Rows that share a key are one document and stay or go together. Documents without words, and
    rows without a key, have no duplicates and stay.
    """
    return _documents(minhash.near_dedup(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark passage occurs go.

    Rows are judged one by one; null and empty texts hold no passage and stay, and without any
    benchmark item all documents do.
    """
    return _documents(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as pieces, each with its place in a sequence of 1024 tokens.

    Null and empty texts are one piece, of the end alone; rows that share a key, or have none, are
    packed like others.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage's scores come from a fitted model, which SQL cannot express.
ORACLE_SQL = None
