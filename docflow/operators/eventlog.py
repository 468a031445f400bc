"""Event logs from documents of cases: order, neighbours, pairs, durations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.names import activity_name
from docflow.operators.skew import neighbour, number_rows, small_join


def object_name(cluster: Column, variant: Column) -> Column:
    return F.concat(cluster.cast("string"), F.lit("_"), variant.cast("string"))


def case_events(case_docs: DataFrame) -> DataFrame:
    """Documents of cases that take part in time order: no reference data, with a time."""
    return case_docs.where(~F.col("is_shared") & F.col("final_ts").isNotNull())


def ordered(
    events: DataFrame, case: str = "case_id", order: tuple = ("ts", "event_id"), hot=None
) -> DataFrame:
    """Events with their 1-based position `seq` in the case."""
    return number_rows(events, [case], list(order), "seq", hot)


def follows(
    events: DataFrame,
    case: str = "case_id",
    activity: str = "activity",
    order: tuple = ("ts", "event_id"),
    carry: dict[str, str] | None = None,
    hot=None,
) -> DataFrame:
    """Every event with the activity of the next event of its case in `next_activity` (null at the end).

    `carry` names further columns to take from the next event.
    """
    take = {activity: "next_activity", **(carry or {})}
    return neighbour(events, [case], list(order), take, 1, hot)


def starts_and_ends(
    events: DataFrame,
    case: str = "case_id",
    activity: str = "activity",
    order: tuple = ("ts", "event_id"),
) -> DataFrame:
    """How many cases start and end with each activity: kind, activity, n.

    First and last are plain aggregates with map-side combine, so a large case does no harm.
    """
    key = F.struct(*order)
    edge = events.groupBy(case).agg(
        F.min_by(activity, key).alias("start"), F.max_by(activity, key).alias("end")
    )
    return (
        edge.select(F.explode(F.create_map(F.lit("start"), "start", F.lit("end"), "end")).alias("kind", "activity"))
        .groupBy("kind", "activity")
        .agg(F.count("*").alias("n"))
    )


def time_relations(
    events: DataFrame,
    case: str = "case_id",
    activity: str = "activity",
    order: tuple = ("ts", "event_id"),
    hot=None,
) -> DataFrame:
    """Consecutive pairs of a case: a, b, number of occurrences and of cases."""
    pairs = follows(events, case, activity, order, hot=hot).where(F.col("next_activity").isNotNull())
    per_case = pairs.groupBy(F.col(activity).alias("a"), F.col("next_activity").alias("b"), case).agg(
        F.count("*").alias("n")
    )
    return per_case.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("*").alias("n_cases"))


def pair_events(
    events: DataFrame,
    case: str = "case_id",
    activity: str = "activity",
    ts: str = "ts",
    order: tuple = ("ts", "event_id"),
    hot=None,
) -> DataFrame:
    """One event per consecutive pair: name `((a), (b))`, start, end, midpoint and duration.

    start and end are the times of the two documents; the duration may be negative in merged logs and
    is kept as it is.
    """
    pairs = follows(events, case, activity, order, {ts: "end_ts"}, hot).where(
        F.col("next_activity").isNotNull()
    )
    start, end = F.unix_micros(F.col(ts).cast("timestamp")), F.unix_micros(F.col("end_ts").cast("timestamp"))
    return pairs.select(
        case,
        F.col(activity).alias("a"),
        F.col("next_activity").alias("b"),
        activity_name(F.array(activity), F.array("next_activity")).alias("activity"),
        start.alias("start_us"),
        end.alias("end_us"),
        ((start + end) / 2).cast("long").alias("time_us"),
        ((end - start) / 1e6).alias("duration_s"),
    )


def merged_events(pairs: DataFrame, activity_map: DataFrame, case: str = "case_id") -> DataFrame:
    """Event log after AND-merging: pairs whose (a, b) belongs to a merged activity become one event
    per case with the plain mean of their starts and ends.

    `activity_map`: a, b, activity.  Pairs without an entry keep their own name.
    """
    named = small_join(pairs, activity_map.withColumnRenamed("activity", "_merged"), ["a", "b"], "left")
    named = named.withColumn("activity", F.coalesce("_merged", "activity"))
    single = named.where(F.col("_merged").isNull()).select(
        case, "activity", F.col("start_us").cast("double"), F.col("end_us").cast("double")
    )
    merged = (
        named.where(F.col("_merged").isNotNull())
        .groupBy(case, "activity")
        .agg(F.avg("start_us").alias("start_us"), F.avg("end_us").alias("end_us"))
    )
    return single.unionByName(merged).select(
        case,
        "activity",
        F.col("start_us").cast("long"),
        F.col("end_us").cast("long"),
        ((F.col("start_us") + F.col("end_us")) / 2).cast("long").alias("time_us"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"),
    )


def trace_variants(
    events: DataFrame,
    case: str = "case_id",
    activity: str = "activity",
    order: tuple = ("ts", "event_id"),
    hot=None,
) -> DataFrame:
    """Cases with the same activity sequence: length, number of cases, smallest case.

    A sequence is told by two independent 64-bit hashes over (position, activity), so no trace is ever
    collected into one row.
    """
    placed = ordered(events, case, order, hot)
    per_case = placed.groupBy(case).agg(
        F.count("*").alias("n_events"),
        F.bit_xor(F.xxhash64("seq", activity)).alias("_h1"),
        F.bit_xor(F.xxhash64(activity, "seq", F.lit(17))).alias("_h2"),
    )
    return per_case.groupBy("n_events", "_h1", "_h2").agg(
        F.count("*").alias("n_cases"), F.min(case).alias("first_case")
    ).drop("_h1", "_h2")
