"""Lines of a graph in three exchange formats, and the cost of making it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat_ws(",", quoted(F.col("id")), quoted(F.col("label")), quoted(F.col("name"))).alias("line"))


def statement_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One CREATE line a node and one MATCH ... CREATE line an edge."""
    n = nodes.select(F.format_string("CREATE (:%s {id: '%s'})", "label", "id").alias("line"))
    return n.unionByName(edges.select(F.format_string("MATCH (a {id: '%s'}), (b {id: '%s'}) CREATE (a)-[:%s]->(b)", "src", "dst", "rel").alias("line")))


def json_lines(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct(F.col("id").alias("@id"), F.col("label").alias("@type"), F.col("name"))).alias("line"))


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage: book, chapter, model, tokens. Cost by (book, chapter), book, model and in all, as grouping sets."""
    priced = usage.join(prices, "model").withColumn("cost", (F.col("tokens") * F.col("price")).cast("decimal(38,6)"))
    out = priced.groupingSets([["book", "chapter"], ["book"], ["model"], []], "book", "chapter", "model").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return out.withColumn("cost", F.round(F.col("cost").cast("double") / 1e6, 4))


def statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One CREATE line a node and one MATCH ... CREATE line an edge, with properties that are not null as JSON."""
    props = F.to_json(F.struct(*(c for c in nodes.columns if c != "label")))
    n = nodes.select(F.concat(F.lit("CREATE (:"), "label", F.lit(" "), props, F.lit(");")).alias("line"))
    kept = F.to_json(F.struct(*(c for c in edges.columns if c not in ("src", "rel", "dst"))))
    text = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    e = edges.select(F.concat(F.lit("MATCH (a {name: "), text("src"), F.lit("}), (b {name: "), text("dst"), F.lit("}) CREATE (a)-[:"), "rel", F.when(kept != "{}", F.concat(F.lit(" "), kept)).otherwise(""), F.lit("]->(b);")).alias("line"))
    return n.unionByName(e)


def json_ld(nodes: DataFrame, edges: DataFrame, context: dict[str, str]) -> DataFrame:
    """(part, line): opening with the context, a line a node, a line a relationship, and the end; a writer joins the lines of
    parts 1 and 2 with commas."""
    import json

    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, json.dumps({"@context": context}, separators=(",", ":"))[:-1] + ',"@graph":['), (3, "]}")], "part int, line string")
    n = nodes.select(F.lit(1).alias("part"), F.to_json(F.struct(F.col("label").alias("@type"), F.col("name"), F.nullif(F.col("summary"), F.lit("")).alias("description"))).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.to_json(F.struct(F.lit("Relationship").alias("@type"), F.col("src").alias("source"), F.col("rel").alias("predicate"), F.col("dst").alias("target"))).alias("line"))
    return frame.unionByName(n).unionByName(e)


def csv_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, part, line): the heading (part 0) and the quoted rows of entities and of relationships."""
    spark = nodes.sparkSession
    heads = spark.createDataFrame([("entities", 0, "name,type,summary"), ("relationships", 0, "source,relationship,target")], "file string, part int, line string")
    row = lambda *c: F.concat_ws(",", *(quoted(F.col(x)) for x in c)).alias("line")
    return heads.unionByName(nodes.select(F.lit("entities").alias("file"), F.lit(1).alias("part"), row("name", "label", "summary"))).unionByName(edges.select(F.lit("relationships").alias("file"), F.lit(1).alias("part"), row("src", "rel", "dst")))
