"""Corpus pipeline: stages over the documents table, each an operator of
``tidewatch.llm``; every stage is written as Parquet and reread.

Rows that share a doc_id share the decisions of the filtering stages; rows
with a null doc_id are decided together. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import exact, jaccard, language, mixing, packing
from tidewatch.llm.common import Scratch, read_table

#: A document whose best language has a mean probability below this is rejected.
LEAST_SCORE = 0.35

#: The language model and the packing have no form in SQL.
ORACLE_SQL = None


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``kept`` (column ``id``)."""
    return docs.alias("d").join(kept.select("id").alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.id")), "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; those without letters and those
    that no language fits go. Without any label to learn from all stay."""
    model = language.train_language_model(docs)
    if model is None:
        return docs
    found = language.language_id(docs, model)
    return _keep(docs, found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return _keep(docs, exact.exact_dedup(docs, keep="largest").where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by similar sets of 5-word shingles (0.8) the one
    with the smallest doc_id stays."""
    classes = jaccard.ngram_jaccard_join(docs, width=5, percent=80)
    return _keep(docs, classes.where(F.col("id").eqNullSafe(F.col("component_id"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = mixing.pareto_mix(docs).select("id", "source", F.col("copies").cast("int").alias("n")).distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("k.id")) & F.col("d.source").eqNullSafe(F.col("k.source"))
    taken = docs.alias("d").join(copies.where("n > 0").alias("k"), same)
    return taken.select(F.explode(F.array_repeat(F.struct("d.*"), F.col("k.n"))).alias("row")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", identify_language), ("exact_dedup", exact_dedup), ("ngram_jaccard", near_dedup),
          ("mix_sources", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
