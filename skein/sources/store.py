"""Where books are kept: chapters, paragraphs, chunks, matches, the registry and feedback, as Parquet by book.

A write replaces the partitions of the books that it brings and leaves the others, so a book that is read again is written
again as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_books(rows: DataFrame, path: str) -> None:
    """Write rows by their column book; only the books in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(path)


def drop_book(spark: SparkSession, path: str, book) -> None:
    """Delete a book's partition, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/book={book}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def chapter_id(book: Column, number: Column) -> Column:
    return F.concat(book.cast("string"), F.lit("-ch"), number.cast("string"))


def matches_json(matches: DataFrame, key: list[str]) -> DataFrame:
    """key, regex_matches (their number), regex_json (in order of start): one row a chapter."""
    rest = [c for c in matches.columns if c not in key]
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", F.to_json(F.struct(*rest)).alias("m"))))
    return matches.groupBy(*key).agg(F.count("*").alias("regex_matches"), F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x.m), ","), F.lit("]")).alias("regex_json"))


def registry_rows(registry: DataFrame, version: str) -> DataFrame:
    """The registry as it is saved: name, aliases, type, last chapter, and the ontology's version beside each row."""
    return registry.withColumn("ontology_version", F.lit(version))


def feedback(rows: DataFrame) -> DataFrame:
    """Ratings of 1 or -1; others are no feedback."""
    return rows.where(F.col("rating").isin(-1, 1))
