"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet in the shared folder and read back as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfold.llm.common import read_table
from counterfold.llm.line_dedup import drop_repeated_lines
from counterfold.llm.mixing import mix_documents
from counterfold.llm.ngram_join import near_duplicates
from counterfold.llm.packing import pack_documents
from counterfold.llm.toxicity import fit_toxicity, score_toxicity
from counterfold.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The sizes and shares of a stage's random choices and toxic fits are those of the operators.
ORACLE_SQL: str | None = None  # a fitted classifier, random rounding and a tokenizer have no SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labels of the given documents."""
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(*COLUMNS), model).where(F.col("predicted") == 0).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least ten of them share; ``n_chars`` is counted anew."""
    kept = drop_repeated_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id; documents without words all stay."""
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs).where(
        F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids; a document taken twice is packed twice."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
