"""State as of a chapter, from a ledger of changes or from intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import valid_at

KEY = ["character", "category", "name"]


def stat_ledger(ledger: DataFrame, chapter: int) -> DataFrame:
    """Sum of deltas (null as 0) and last chapter of each stat up to a chapter; one partial aggregate, one shuffle."""
    return ledger.where(F.col("chapter") <= chapter).groupBy(*KEY).agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("value"), F.max("chapter").alias("last_chapter"))


def latest(ledger: DataFrame, chapter: int) -> DataFrame:
    """The last change of each character up to a chapter, ties by ord: an as-of join without a sort."""
    last = F.max(F.struct("chapter", "ord", "category", "name", "delta")).alias("m")
    return ledger.where(F.col("chapter") <= chapter).groupBy("character").agg(last).select("character", "m.*")


def last_wins(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """One change a key: the one of the largest ord."""
    return ledger.groupBy(*keys).agg(F.max_by("delta", "ord").alias("delta"), F.max("ord").alias("ord"))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def compare(ledger: DataFrame, a: int, b: int) -> DataFrame:
    """Stats at two chapters and their nonzero difference, in one pass of conditional sums."""
    at = [F.coalesce(F.sum(F.when(F.col("chapter") <= c, F.col("delta"))), F.lit(0)) for c in (a, b)]
    out = ledger.where(F.col("chapter") <= max(a, b)).groupBy(*KEY).agg(at[0].alias("before"), at[1].alias("after"))
    return out.withColumn("change", F.col("after") - F.col("before")).where("change <> 0")


def gained_lost(ledger: DataFrame, a: int, b: int, gain: str, lose: str) -> DataFrame:
    """Names gained and lost by a character in (a, b], as sorted lists."""
    def names(kind):
        return F.array_join(F.sort_array(F.collect_set(F.when(F.col("category") == kind, F.col("name")))), ",")
    span = ledger.where((F.col("chapter") > a) & (F.col("chapter") <= b) & F.col("category").isin(gain, lose))
    return span.groupBy("character").agg(names(gain).alias("gained"), names(lose).alias("lost"))


def intervals(ledger: DataFrame) -> DataFrame:
    """SCD-2: the value (name) of each (character, category) holds until the chapter before the next one with another value.

    Of several changes in a chapter the last by ord is its value.
    """
    w = W.partitionBy("character", "category").orderBy("chapter")
    last = ledger.groupBy("character", "category", "chapter").agg(F.max_by("name", "ord").alias("name"))
    turns = last.withColumn("before", F.lag("name").over(w)).withColumn("nth", F.row_number().over(w)).where((F.col("nth") == 1) | ~F.col("name").eqNullSafe(F.col("before")))
    return turns.select("character", "category", "name", F.col("chapter").alias("valid_from"), (F.lead("chapter").over(w) - 1).alias("valid_to"))


def holding(spans: DataFrame, chapter: int, half_open: bool = False) -> DataFrame:
    return spans.where(valid_at(chapter, F.col("valid_from"), F.col("valid_to"), half_open))


def snapshots(ledger: DataFrame, every: int, last: int, top: int) -> DataFrame:
    """Distinct categories and names of the `top` busiest characters every so many chapters; the rest is pruned first."""
    busiest = ledger.groupBy("character").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "character").limit(top).select("character")
    marks = ledger.sparkSession.range(every, last + 1, every).select(F.col("id").cast("int").alias("at"))
    rows = ledger.join(F.broadcast(busiest), "character").join(F.broadcast(marks), F.col("chapter") <= F.col("at"))
    return rows.groupBy("at", "character").agg(F.countDistinct("category").alias("categories"), F.countDistinct("name").alias("names"), F.count("*").alias("changes"))


def consecutive(ledger: DataFrame) -> DataFrame:
    """Each change with the next one of its character."""
    w = W.partitionBy("character").orderBy("chapter", "ord")
    return ledger.select("character", F.col("ord").alias("src"), F.lead("ord").over(w).alias("dst")).where("dst IS NOT NULL")


def islands(ledger: DataFrame, gap: int = 1) -> DataFrame:
    """Runs of chapters with the same category whose steps are at most `gap`."""
    w = W.partitionBy("character", "category").orderBy("chapter")
    days = ledger.select("character", "category", "chapter").distinct().withColumn("new", (F.col("chapter") - F.lag("chapter").over(w) > gap).cast("int"))
    runs = days.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w))
    return runs.groupBy("character", "category", "run").agg(F.min("chapter").alias("first"), F.max("chapter").alias("last"), F.count("*").alias("chapters")).drop("run")


def within(ledger: DataFrame, spans: DataFrame, width: int = 8) -> DataFrame:
    """Changes inside intervals of the same character: equal bucket of chapters, then the exact range."""
    buckets = F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))
    cut = spans.withColumn("bucket", F.explode(buckets))
    keyed = ledger.withColumn("bucket", F.floor(F.col("chapter") / width))
    return keyed.join(cut.withColumnRenamed("category", "sequence"), ["character", "bucket"]).where("chapter BETWEEN first AND last").drop("bucket")


def keep_open(spans: DataFrame, ends: DataFrame) -> DataFrame:
    """Close open intervals that a list of ends names: ends (character, category, ended_at)."""
    return spans.join(ends, ["character", "category"], "left").withColumn("valid_to", F.when(F.col("valid_to").isNull() & (F.col("ended_at") >= F.col("valid_from")), F.col("ended_at")).otherwise(F.col("valid_to"))).drop("ended_at")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """MERGE of two states with longest, largest, union, first and counter policies.

    Columns beside the key: description, confidence, aliases, first_chapter, occurrences. The batch is reduced to a row a
    key before the full outer join, so both sides join one to one.
    """
    longest = F.max_by("description", F.struct(F.length("description"), "description")).alias("description")
    b = incoming.groupBy(*key).agg(longest, F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.min("first_chapter").alias("first_chapter"), F.sum("occurrences").alias("occurrences"))
    e, n = existing.alias("e"), b.alias("n")
    on = [F.col(f"e.{k}") == F.col(f"n.{k}") for k in key]
    newer = F.coalesce(F.length("n.description"), F.lit(-1)) > F.coalesce(F.length("e.description"), F.lit(-1))
    empty = F.array().cast("array<string>")
    return e.join(n, on, "full_outer").select(
        *(F.coalesce(f"e.{k}", f"n.{k}").alias(k) for k in key),
        F.when(newer, F.col("n.description")).otherwise(F.col("e.description")).alias("description"),
        F.greatest("e.confidence", "n.confidence").alias("confidence"),
        F.array_sort(F.array_union(F.coalesce("e.aliases", empty), F.coalesce("n.aliases", empty))).alias("aliases"),
        F.coalesce("e.first_chapter", "n.first_chapter").alias("first_chapter"),
        (F.coalesce("e.occurrences", F.lit(0)) + F.coalesce("n.occurrences", F.lit(0))).alias("occurrences"),
    )
