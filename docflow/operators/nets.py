"""Net tables: places, transitions, arcs, and how often the cases use them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions.names import activity_inputs, activity_outputs
from docflow.operators.eventlog import follows
from docflow.operators.skew import small_join


def net(io: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, transitions, arcs) of activities.

    `io`: activity, direction, object.  An input object gives the arc place -> transition, an output
    object the arc transition -> place.
    """
    places = io.select(F.col("object").alias("place")).distinct()
    transitions = io.select(F.col("activity").alias("transition")).distinct()
    is_in = F.col("direction") == "input"
    arcs = io.select(
        F.when(is_in, F.col("object")).otherwise(F.col("activity")).alias("source"),
        F.when(is_in, F.col("activity")).otherwise(F.col("object")).alias("target"),
        F.when(is_in, "place_to_transition").otherwise("transition_to_place").alias("kind"),
    ).distinct()
    return places, transitions, arcs


def schema_net(io: DataFrame, schemas: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The net with place labels from the type schemas and transition labels from the rules.

    `schemas`: object, schema; `rules`: activity, rule (text).
    """
    places, transitions, arcs = net(io)
    labelled = places.join(schemas.select(F.col("object").alias("place"), "schema"), "place", "left")
    texts = rules.groupBy("activity").agg(F.array_join(F.array_sort(F.collect_set("rule")), "; ").alias("rules"))
    return labelled, transitions.join(texts, F.col("transition") == F.col("activity"), "left").drop("activity"), arcs


def decision_points(arcs: DataFrame) -> DataFrame:
    """Places with more than one outgoing transition: place, n_paths."""
    return (
        arcs.where(F.col("kind") == "place_to_transition")
        .groupBy(F.col("source").alias("place"))
        .agg(F.count_distinct("target").alias("n_paths"))
        .where(F.col("n_paths") > 1)
    )


def place_labels(arcs: DataFrame) -> DataFrame:
    """Place label from the activities around it: parts common to the outputs of incoming and the inputs
    of outgoing activities, else the inputs, else the outputs, else the place itself."""
    outgoing = arcs.where(F.col("kind") == "place_to_transition").select(
        F.col("source").alias("place"), F.explode(activity_inputs(F.col("target"))).alias("part")
    )
    incoming = arcs.where(F.col("kind") == "transition_to_place").select(
        F.col("target").alias("place"), F.explode(activity_outputs(F.col("source"))).alias("part")
    )
    places = arcs.select(
        F.when(F.col("kind") == "place_to_transition", F.col("source")).otherwise(F.col("target")).alias("place")
    ).distinct()
    front = outgoing.groupBy("place").agg(F.collect_set("part").alias("front"))
    back = incoming.groupBy("place").agg(F.collect_set("part").alias("back"))
    both = F.array_intersect("front", "back")
    chosen = (
        F.when(F.size(both) > 0, both)
        .when(F.size("front") > 0, F.col("front"))
        .otherwise(F.col("back"))
    )
    text = F.concat(F.lit("("), F.array_join(F.array_sort(chosen), ","), F.lit(")"))
    return (
        places.join(front, "place", "left")
        .join(back, "place", "left")
        .withColumn("front", F.coalesce("front", F.array().cast("array<string>")))
        .withColumn("back", F.coalesce("back", F.array().cast("array<string>")))
        .select("place", F.when(F.size(chosen) > 0, text).otherwise(F.col("place")).alias("label"))
    )


def arc_usage(
    events: DataFrame,
    allowed: DataFrame,
    case: str = "case_id",
    activity: str = "activity",
    order: tuple = ("ts", "event_id"),
    hot=None,
) -> DataFrame:
    """How often conforming cases use each step a -> b of the net: a, b, n_used, n_cases.

    A case conforms when all its consecutive pairs are in `allowed` (a, b).  Pairs are reduced to counts
    per case before the conforming cases are joined.
    """
    pairs = follows(events, case, activity, order, hot=hot).where(F.col("next_activity").isNotNull())
    per_case = pairs.groupBy(case, F.col(activity).alias("a"), F.col("next_activity").alias("b")).agg(
        F.count("*").alias("n")
    )
    known = allowed.select("a", "b").distinct().withColumn("_ok", F.lit(True))
    marked = small_join(per_case, known, ["a", "b"], "left")
    bad = marked.where(F.col("_ok").isNull()).select(case).distinct()
    used = (
        marked.where(F.col("_ok"))
        .join(bad, case, "left_anti")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n_used"), F.count("*").alias("n_cases"))
    )
    return (
        allowed.select("a", "b")
        .distinct()
        .join(used, ["a", "b"], "left")
        .select("a", "b", F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("n_cases", F.lit(0)).alias("n_cases"))
    )
