"""From raw documents to packed training sequences: every stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.llm.common import packed, stored, table
from freshet.llm.decontaminate import decontaminate
from freshet.llm.line_dedup import line_dedup
from freshet.llm.minhash import keep_one_of_each
from freshet.llm.packing import pack, token_pieces
from freshet.llm.queries import fold, prepared
from freshet.llm.toxicity import toxicity


def held(docs: DataFrame) -> DataFrame:
    """Id and text beside the whole row, so that no column of the documents can clash with a result's."""
    return docs.select(packed(docs, "held"), "doc_id", "text")


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go."""
    scored = toxicity(held(docs), table(spark, sf_dir, "labels"), learn_from=fold("doc_id", 5) != 0)
    return scored.where(F.col("predicted") == 0).select("held.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go; the documents stay with their other lines."""
    kept = line_dedup(held(docs))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[new.get(c, F.col("held").getField(c)).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity of 0.8 or more."""
    return keep_one_of_each(docs, shingle=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain too much of the benchmark go."""
    judged = decontaminate(held(docs), table(spark, sf_dir, "benchmark"), play=None)
    return judged.where(~F.col("contaminated")).select("held.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return pack(token_pieces(docs))


STAGES = [
    ("toxicity", toxic_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: A trained classifier decides in the first stage; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is stored in the shared folder before the next one."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
