"""Connected components by star contraction on an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.skew import lookup_join
from docflow.session import cut_lineage

#: So many edges fit one task, where the rounds need no shuffle.
ONE_TASK_EDGES = 100_000


def _with_least(neighbours: DataFrame, min_rows: int | None) -> DataFrame:
    """(u, v) rows with m = the least of u and all v.  A hub may hold most rows, so the least comes from
    an aggregate with map-side combine.  It returns by a join whose long partitions adaptive execution
    splits; with `min_rows` given, by one that sends hot keys another way (see skew)."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("_least"))
    least = least.select("u", F.least("u", "_least").alias("m"))
    if min_rows is None:
        return neighbours.join(least, "u")
    return lookup_join(neighbours, least, ["u"], min_rows=min_rows)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, vertices: DataFrame | None = None, min_rows: int | None = None) -> DataFrame:
    """Label every node with the least node of its component: node, component.

    Alternates large-star and small-star steps (logarithmic number of rounds); every round is cut by a
    reliable checkpoint, and only a row count and a checksum reach the driver.
    """
    cur = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    cur = cut_lineage(cur.where(F.col("u") != F.col("v")).distinct())
    before = _fingerprint(cur)
    if before[0] <= ONE_TASK_EDGES and min_rows is None:
        cur = cur.coalesce(1)
    while True:
        # Large star: link every larger neighbour of a node to the node's least neighbour.
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both, min_rows)
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = cut_lineage(large)
        # Small star: link a node and its smaller neighbours to the least of them.
        if before[0] <= ONE_TASK_EDGES and min_rows is None:
            large = large.coalesce(1)
        near = _with_least(large, min_rows)
        small = (
            near.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(near.select("u", F.col("m").alias("v")))
            .distinct()
        )
        cur = cut_lineage(small)
        if before[0] <= ONE_TASK_EDGES and min_rows is None:
            cur = cur.coalesce(1)
        after = _fingerprint(cur)
        if after == before:
            break
        before = after
    labels = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node")).distinct()
    out = labels.unionByName(roots.withColumn("component", F.col("node")))
    if vertices is not None:
        alone = vertices.select("node").distinct().join(out, "node", "left_anti")
        out = out.unionByName(alone.withColumn("component", F.col("node")))
    return out
