"""Connected components by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.storage import release, scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).collect()[0]
    return row["n"], row["h"]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Union-find over an edge list whose size has been checked."""

    def run(batches):
        import pyarrow as pa

        up: dict = {}

        def find(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y] if up[y] != y else y
            return x

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                up[max(x, y)] = min(x, y)
        if kind is not None:
            names = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([find(x) for x in names], kind)], ["node", "component"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", one_task: int = 300_000) -> DataFrame:
    """(node, component) for every node of an undirected edge list; the component is its smallest node.

    Up to `one_task` edges, counted first, one task suffices. Beyond that, each round writes its edges, as many as before at
    most, to the shared folder, so lineage stays short; it ends when a round changes nothing, after O(log n) rounds. Loops
    and null ends are dropped; a node that only has loops is not returned.
    """
    spark = edges.sparkSession
    a, b = F.col(left), F.col(right)
    given = scratch(spark, edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), "edges")
    if given.count() <= one_task:
        return _in_one_task(given)
    now = scratch(spark, given.distinct(), "edges")
    release(spark, given)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # every edge of `large` leads from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old, now = now, scratch(spark, small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        release(spark, old)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    tails = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return tails.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
