"""Operator 3 [native]: exact duplicates by content sort.

Texts are lower-cased in A-Z only. Spark samples splitters over (first bytes, digest, slot) and range-partitions by them;
in each range an external sort places equal texts side by side, and neighbours are compared in full by a sort aggregate.
A text that fills more than one range by itself (at most as many texts as ranges, found by counting digests) is dealt over
slots, and its few slot heads are compared in full once more. Which texts are equal is decided by these comparisons; the rows
of the result then find their text's group by its SHA-256 digest.

Defined results: null counts as the empty text; of equal texts the row with the largest doc_id stays; rows that repeat a
doc_id with an equal text all carry its fate; a null doc_id stays only where its whole group has none; extra columns are
ignored; long texts are compared whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import keyed_text, scratch, table

#: Characters of a text that its splitters see; the digest behind them tells longer common beginnings apart.
HEAD = 24


def normalised(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and (digest, keep_id, group_size) of every distinct normalised text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed_text(docs).select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    ids = scratch(spark, rows.select("doc_id", "digest"), "digests")
    total = ids.count()
    # fewer than `parts` texts can each hold more than a share of 1 / parts of the rows, so this broadcast is bounded
    hot = ids.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > max(total // parts, 16)).select("digest", F.lit(True).alias("hot"))
    dealt = (
        rows.join(F.broadcast(hot), "digest", "left")
        .withColumn("slot", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).otherwise(-1))
        .select("doc_id", "norm", "digest", "slot", F.left("norm", F.lit(HEAD)).alias("head"))
        .repartitionByRange(parts, "head", "digest", "slot")
    )
    # first() of a string keeps the aggregate sort-based: neighbours of the sorted range are compared in full
    heads = dealt.groupBy("head", "digest", "slot", "norm").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"), F.first("digest").alias("same"))
    heads = scratch(spark, heads.select(F.col("same").alias("digest"), "slot", "top", "n", F.when(F.col("slot") >= 0, F.col("norm")).alias("norm")), "heads")
    cold = heads.where("slot < 0").select("digest", F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
    joined = heads.where("slot >= 0").groupBy("digest", "norm").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size")).drop("norm")
    return ids, cold.unionByName(joined)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row; a large group's rows join in parts (AQE skew join)."""
    ids, of = groups(docs)
    return ids.join(of, "digest").select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text no row of larger doc_id repeats; columns untouched."""
    kept = deduplicated(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_kept_id")) & (F.sha2(normalised(F.coalesce(docs["text"], F.lit(""))), 256) == F.col("_kept_text"))
    return docs.join(kept, same, "left_semi")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for it."""
    return deduplicated(table(spark, sf_dir, "documents"))


ORACLE = """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
    FROM d"""
