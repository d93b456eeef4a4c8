"""The corpus pipeline: from raw documents to token counts, each stage one operator of skein.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; the result is written as Parquet
and read again as the docs of the next one. All but the last return the columns of documents, so a stage can be left out,
repeated or run alone. Near-duplicates are taken at a similarity of 0.8, the usual one for word shingles; the smallest
doc_id of a group stays.

Defined results, for every stage: null and empty texts count as empty, are not toxic by themselves, hold no benchmark item and
are near copies of nothing, but equal to each other, so that exact dedup keeps one of them; a row with a null doc_id takes part
by its text and goes where another row stays for it; repeated rows are told apart by their texts and share their fate; of
equal texts the largest doc_id stays, of near copies the smallest; an empty table gives an empty one; extra columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, exact_dedup, near_dup, pieces, toxicity
from skein.plans.storage import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents predicted toxic go."""
    return toxicity.without_toxic(spark, docs, sf_dir)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near-duplicates stays."""
    return near_dup.without_near_copies(docs, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark item go."""
    return decontaminate.without_benchmark(spark, docs, sf_dir)


def code_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every text encoded and decoded; counts and digests for each document."""
    return pieces.coded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pieces", code_pieces),
]

#: The first and third stages are models and sketches that SQL cannot say; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; between them the rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
