"""The corpus pipeline: each stage is an operator over all that its predecessor kept.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows and
columns whose names clash with an operator's; what becomes of them stands at each stage. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.decontamination import find_contamination
from keystrata.llm.near_dedup import drop_near_duplicates
from keystrata.llm.packing import pack_documents
from keystrata.llm.quality import classify_quality
from keystrata.llm.secret_scan import find_secrets, labelled_samples, redacted
from keystrata.llm.shared import scratch, stored


def _added(found: DataFrame) -> Column:
    """The column that an operator has added last, whatever its name had to be."""
    return F.col(f"`{found.columns[-1]}`")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go.

    A null text counts as an empty one, null sources and languages as sites of their own; repeated
    rows are judged alike. Without labels of two classes all stay.
    """
    judged = classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter(_added(judged)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each class of near duplicates stays.

    Null, empty and wordless texts are copies of nothing and stay, as do rows of null id. Rows of the
    same id and text stay or go together; other texts of an id are judged by themselves.
    """
    return drop_near_duplicates(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: contaminated documents go. Null and wordless texts stay."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~_added(found)["contaminated"]).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: all documents stay, each secret in their texts is replaced by a mark.

    n_chars follows the text where it changes; null texts stay null.
    """
    found = find_secrets(docs, labelled_samples(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    spans = _added(found)["spans"]
    hit = F.size(spans) > 0
    clean = F.when(hit, redacted(F.col("text"), spans)).otherwise(F.col("text"))
    return found.withColumn("text", clean).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the pieces of all remaining documents, with their ids. A null text is only its end id."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]
#: SQL can't express the trained and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread.

    What a stage has written besides, and its input, are deleted as soon as its result is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (last, final) = STAGES
    with scratch(spark):
        for name, stage in first:
            with scratch(spark):
                docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        return stored(final(spark, docs, sf_dir), f"pipeline-{last}", keep=True)
