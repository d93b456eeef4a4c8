"""Readers of the driver's tables, shaped as ledgers, nodes, edges, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes: character, category, name, delta, chapter (day of the stream), ord."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("character"), F.col("event_type").alias("category"), (k % 10).alias("name"),
        F.round("value").cast("long").alias("delta"), (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).alias("chapter"), F.col("event_id").alias("ord"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, name) of regions, nations, customers, suppliers, parts and orders."""
    parts = [("region", "Region", "r_regionkey", "r_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("customer", "Customer", "c_custkey", "c_name"), ("supplier", "Supplier", "s_suppkey", "s_name"), ("part", "Part", "p_partkey", "p_name"), ("orders", "Order", "o_orderkey", "o_orderkey")]
    out = None
    for t, label, key, name in parts:
        one = read(spark, sf_dir, t).select(F.concat(F.lit(label + ":"), F.col(key)).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rel, dst, chapter): chapter is the month of an order since 1992, null for lasting relations."""
    def tag(label, key):
        return F.concat(F.lit(label + ":"), F.col(key))
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    none = F.lit(None).cast("int")
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return (
        read(spark, sf_dir, "nation").select(tag("Nation", "n_nationkey").alias("src"), F.lit("IN_REGION").alias("rel"), tag("Region", "n_regionkey").alias("dst"), none.alias("chapter"))
        .unionByName(read(spark, sf_dir, "customer").select(tag("Customer", "c_custkey").alias("src"), F.lit("IN_NATION").alias("rel"), tag("Nation", "c_nationkey").alias("dst"), none.alias("chapter")))
        .unionByName(read(spark, sf_dir, "supplier").select(tag("Supplier", "s_suppkey").alias("src"), F.lit("IN_NATION").alias("rel"), tag("Nation", "s_nationkey").alias("dst"), none.alias("chapter")))
        .unionByName(o.select(tag("Customer", "o_custkey").alias("src"), F.lit("PLACED").alias("rel"), tag("Order", "o_orderkey").alias("dst"), month.alias("chapter")))
        .unionByName(li.select(tag("Order", "l_orderkey").alias("src"), F.lit("CONTAINS").alias("rel"), tag("Part", "l_partkey").alias("dst"), none.alias("chapter")))
        .unionByName(li.select(tag("Part", "l_partkey").alias("src"), F.lit("SUPPLIED_BY").alias("rel"), tag("Supplier", "l_suppkey").alias("dst"), none.alias("chapter")).distinct())
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs: doc_id, position from 0, text."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("position", "text"))
