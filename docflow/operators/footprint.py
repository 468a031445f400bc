"""Tables over activity pairs: directly-follows counts, footprint, causal measures, distances."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.eventlog import follows


def dfg(
    events: DataFrame,
    case: str = "case_id",
    activity: str = "activity",
    order: tuple = ("ts", "event_id"),
    hot=None,
) -> DataFrame:
    """Directly-follows counts a, b, n."""
    pairs = follows(events, case, activity, order, hot=hot).where(F.col("next_activity").isNotNull())
    return pairs.groupBy(F.col(activity).alias("a"), F.col("next_activity").alias("b")).agg(
        F.count("*").alias("n")
    )


def _both_ways(graph: DataFrame) -> DataFrame:
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("n_back"))
    return graph.join(back, ["a", "b"], "left").withColumn("n_back", F.coalesce("n_back", F.lit(0)))


def footprint(graph: DataFrame) -> DataFrame:
    """Relation of every pair that occurs: `sequence` (a before b only) or `parallel` (both ways)."""
    return _both_ways(graph).select(
        "a", "b", F.when(F.col("n_back") > 0, "parallel").otherwise("sequence").alias("rel")
    )


def unrelated(graph: DataFrame, activities: DataFrame) -> DataFrame:
    """Activity pairs a < b that never follow each other (a table over the alphabet, not over events)."""
    names = activities.select("activity").distinct()
    left, right = names.select(F.col("activity").alias("a")), names.select(F.col("activity").alias("b"))
    seen = graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return left.join(right, F.col("a") < F.col("b")).join(seen, ["a", "b"], "left_anti")


def dependency(graph: DataFrame) -> DataFrame:
    """Dependency (ab - ba) / (ab + ba + 1), self loops ab / (ab + 1), and the causal flag."""
    both = _both_ways(graph)
    loop = F.col("a") == F.col("b")
    measure = F.when(loop, F.col("n") / (F.col("n") + 1)).otherwise(
        (F.col("n") - F.col("n_back")) / (F.col("n") + F.col("n_back") + 1)
    )
    return both.select("a", "b", "n", "n_back", measure.alias("dependency")).withColumn(
        "is_causal", (F.col("n_back") == 0) & ~(F.col("a") == F.col("b"))
    )


def hops(graph: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Least number of steps from any start node (no incoming edge); 0 where no start reaches a node.

    By doubling: round k has the pairs of nodes that 2^k steps join, takes every known distance that much farther, and
    joins the pairs with themselves.  Any distance is a sum of different powers of two, and every stretch of a shortest way
    is a shortest way itself, so pairs that a smaller power joins are left out.  A way of n steps takes log2(n) + 1 rounds,
    each a checkpoint.  `max_rounds` ends the search early; farther nodes then count as not reached.
    """
    from docflow.session import cut_lineage

    edges = cut_lineage(graph.select("a", "b").distinct())
    nodes = cut_lineage(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    starts = nodes.join(edges.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
    known = cut_lineage(starts.withColumn("hops", F.lit(0).cast("long")))
    longest = nodes.count() - 1
    power, step, rounds = edges.where(F.col("a") != F.col("b")), 1, 0
    seen = power
    while step <= longest and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        farther = known.join(power, known["node"] == power["a"]).select(F.col("b").alias("node"), (F.col("hops") + step).alias("hops"))
        known = cut_lineage(known.unionByName(farther).groupBy("node").agg(F.min("hops").alias("hops")))
        first = power.select("a", F.col("b").alias("_over"))
        second = power.select(F.col("a").alias("_over"), "b")
        twice = first.join(second, "_over").select("a", "b").where(F.col("a") != F.col("b")).distinct()
        power = cut_lineage(twice.join(seen, ["a", "b"], "left_anti"))
        if power.isEmpty():
            break
        seen, step = seen.unionByName(power), 2 * step
    found = nodes.join(known, "node", "left")
    return found.select("node", F.coalesce("hops", F.lit(0)).cast("int").alias("hops"))
