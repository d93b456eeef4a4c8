"""Traversal, profiles and repair of a graph held as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.plans.storage import scratch


def label_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("type")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("type")).agg(F.count("*").alias("n")))


def label_of(node: Column) -> Column:
    return F.substring_index(node, ":", 1)


def triples(edges: DataFrame) -> DataFrame:
    """(source label, relation, target label) with counts and whether any edge is dated; ids carry their label."""
    return edges.groupBy(label_of(F.col("src")).alias("src_label"), "rel", label_of(F.col("dst")).alias("dst_label")).agg(F.count("*").alias("n"), F.max(F.col("chapter").isNotNull()).alias("temporal"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, rel, b, direction): each edge from either end, in one pass over the edges."""
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("rel").alias("rel"), F.col("dst").alias("b"), F.lit("out").alias("direction")), F.struct(F.col("dst").alias("a"), F.col("rel").alias("rel"), F.col("src").alias("b"), F.lit("in").alias("direction")))
    return edges.select(F.explode(ends).alias("x")).select("x.*")


def from_either(edges: DataFrame) -> DataFrame:
    """The same as a union of two scans: for one node, whose filter reaches both of them."""
    out = edges.select(F.col("src").alias("a"), "rel", F.col("dst").alias("b"), F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("a"), "rel", F.col("src").alias("b"), F.lit("in").alias("direction")))


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node and their share of the largest; pairs are made distinct before they are counted."""
    n = both_ways(edges).select("a", "b").where("a <> b").distinct().groupBy("a").agg(F.count("*").alias("degree"))
    top = n.agg(F.max("degree").alias("top"))
    return n.join(F.broadcast(top)).select(F.col("a").alias("id"), "degree", F.round(F.col("degree") / F.col("top"), 6).alias("importance"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """The edges of one node, either way; the filter reaches both scans."""
    return from_either(edges).where(F.col("a") == node).select("rel", "direction", F.col("b").alias("id"))


def ego(edges: DataFrame, node: str, depth: int) -> DataFrame:
    """(id, hops) within so many undirected steps: the frontier meets the edges from either end, rows stay at their first hop."""
    spark = edges.sparkSession
    links = edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x")).select("x.a", "x.b")
    seen = spark.createDataFrame([(node, 0)], "id string, hops int")
    frontier = seen
    for k in range(1, depth + 1):
        met = links.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"))
        step = met.distinct().join(seen, "id", "left_anti")
        frontier = scratch(spark, step.withColumn("hops", F.lit(k)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def two_hops(edges: DataFrame, node: str) -> DataFrame:
    """Distinct second neighbours other than the start, with the number of ways there; the filter reaches both scans."""
    links = both_ways(edges).select("a", "b")
    one = from_either(edges).where(F.col("a") == node).select(F.col("b").alias("via")).distinct()
    return one.join(links, F.col("via") == F.col("a")).where(F.col("b") != node).select("via", "b").distinct().groupBy(F.col("b").alias("id")).agg(F.count("*").alias("ways"))


def subgraph(edges: DataFrame, kept: DataFrame, chapter: int) -> DataFrame:
    """Edges valid by a chapter whose ends are both among the kept nodes."""
    ids = kept.select("id")
    dated = edges.where(F.col("chapter").isNull() | (F.col("chapter") <= chapter))
    return dated.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame, rel: str, label: str) -> DataFrame:
    """Nodes of a label without an outgoing relation."""
    return nodes.where(F.col("label") == label).join(edges.where(F.col("rel") == rel).select(F.col("src").alias("id")), "id", "left_anti")


def shared_names(nodes: DataFrame, priority: list[str]) -> DataFrame:
    """Names under more than one label, and the label that takes the name by priority."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("label"))
    out = nodes.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.countDistinct("label").alias("labels"), F.min_by("label", rank).alias("winner"))
    return out.where("labels > 1")


def violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges whose end labels break their relation's rule; rules: rel, src_label, dst_label (a small dimension table)."""
    kinds = edges.select("src", "rel", "dst", label_of(F.col("src")).alias("s"), label_of(F.col("dst")).alias("d"))
    known = kinds.join(rules, "rel")
    bad = known.where("s <> src_label").select("rel", "src", "dst", F.lit("domain").alias("broken"))
    return bad.unionByName(known.where("d <> dst_label").select("rel", "src", "dst", F.lit("range").alias("broken")))


def consolidate(edges: DataFrame) -> DataFrame:
    """One edge for each (src, rel, dst): first and last chapter and occurrences."""
    return edges.groupBy("src", "rel", "dst").agg(F.min("chapter").alias("valid_from"), F.max("chapter").alias("last_seen"), F.count("*").alias("occurrences"))


def merge_entity(edges: DataFrame, source: str, target: str) -> DataFrame:
    """All edges of source moved to target; edges that would become loops are dropped."""
    def moved(c):
        return F.when(F.col(c) == source, target).otherwise(F.col(c)).alias(c)
    return edges.select(moved("src"), "rel", moved("dst"), "chapter").where("src <> dst").distinct()


def reify(edges: DataFrame, rel: str) -> DataFrame:
    """Each edge of a relation becomes a node with two INVOLVED_IN edges; other edges stay."""
    hit = edges.where(F.col("rel") == rel).select("src", "dst").distinct()
    node = F.concat(F.lit("Relation:"), F.left(F.sha2(F.concat_ws("|", "src", "dst"), 256), F.lit(16)))
    made = hit.select(F.explode(F.array("src", "dst")).alias("src"), node.alias("dst")).select("src", F.lit("INVOLVED_IN").alias("rel"), "dst")
    return edges.where(F.col("rel") != rel).select("src", "rel", "dst").unionByName(made)


def co_members(edges: DataFrame, rel: str, asked: Column) -> DataFrame:
    """(a, b, shared): for each source that is asked for, the others that share targets with it, and how many.

    A target's members meet only the ones that are asked; a hot target is dealt anew by the adaptive skew join.
    """
    e = edges.where(F.col("rel") == rel).select("src", "dst").distinct()
    asking = e.where(asked).select(F.col("src").alias("a"), "dst")
    return asking.join(e, "dst").where("a <> src").groupBy("a", F.col("src").alias("b")).agg(F.count("*").alias("shared"))


def spread_labels(pairs: DataFrame, rounds: int) -> DataFrame:
    """Communities by label propagation in rounds: every node takes the label with most links, ties to the smallest."""
    spark = pairs.sparkSession
    links = scratch(spark, pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = links.select(F.col("a").alias("id"), F.col("a").alias("community")).distinct()
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        labels = scratch(spark, votes.groupBy("a").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community")).withColumnRenamed("a", "id"), "labels")
    return labels


def communities(pairs: DataFrame, resolution: float = 1.0, rounds: int = 10) -> DataFrame:
    """(id, community): local moves that raise the modularity of undirected edges (a, b) at a resolution.

    In each round a half of the nodes, by hash, may move to the neighbouring community of the largest gain,
    links to it less resolution * own degree * its degrees / all degrees, ties to the smallest name; a node that gains nothing
    stays. The halves keep neighbours from changing places for ever. Parallel edges weigh as many as they are.
    """
    spark = pairs.sparkSession
    one = pairs.where("a <> b").select("a", "b")
    links = scratch(spark, one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("w")), "links")
    degree = scratch(spark, links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "degrees")
    total = degree.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("t")).first()["t"]
    labels = degree.select("id", "k", F.col("id").alias("community"))
    still = 0
    for turn in range(2 * rounds):
        sums = labels.groupBy("community").agg(F.sum("k").alias("s"))
        near = links.join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("w"))
        mine = labels.where(F.pmod(F.xxhash64("id"), F.lit(2)) == turn % 2).select("id", "k", F.col("community").alias("old"))
        stay = mine.select("id", F.col("old").alias("community")).join(near, ["id", "community"], "left_anti").withColumn("w", F.lit(0).cast("long"))
        options = near.unionByName(stay.select("id", "community", "w")).join(mine, "id").join(sums, "community")
        own = F.col("community") == F.col("old")
        gain = F.col("w") - F.lit(resolution) * F.col("k") * (F.col("s") - F.when(own, F.col("k")).otherwise(0)) / F.lit(float(max(total, 1)))
        best = options.groupBy("id", "old").agg(F.min_by("community", F.struct(F.round(-gain, 9), ~own, "community")).alias("community"))
        moved = scratch(spark, best.where("community <> old").select("id", F.col("community").alias("_to")), "moves")
        if moved.isEmpty():
            still += 1
            if still == 2:
                break
            continue
        still = 0
        labels = scratch(spark, labels.join(moved, "id", "left").select("id", "k", F.coalesce("_to", "community").alias("community")), "labels")
    return labels.select("id", "community")


def named_communities(found: DataFrame, book: str, level: int, least: int = 3) -> DataFrame:
    """(id, community): communities of enough members under ids `book:comm:Llevel:place`, the largest first."""
    sizes = found.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= least)
    # one row a community is numbered, not one a member
    place = sizes.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "first")) - 1).select("community", F.format_string(f"{book}:comm:L{level}:%d", "place").alias("name"))
    return found.join(place, "community").select("id", F.col("name").alias("community"))


def parents_by_vote(members: DataFrame) -> DataFrame:
    """members: child, parent, one row a member. Each child's parent is the one most members are in, ties to the smallest."""
    votes = members.groupBy("child", "parent").agg(F.count("*").alias("n"))
    return votes.groupBy("child").agg(F.min_by("parent", F.struct(-F.col("n"), "parent")).alias("parent"), F.max("n").alias("votes"))


def rare_types(typed: DataFrame, longest: int) -> DataFrame:
    """Rows of types that occur once and have an overlong name are pruned."""
    w = typed.groupBy("type").agg(F.count("*").alias("n")).where((F.col("n") == 1) & (F.length("type") > longest)).select("type")
    return typed.join(w, "type", "left_anti")


def top_of_each(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
