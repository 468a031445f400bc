"""Queries over event logs: order, neighbours, footprints, cases."""

from pyspark.sql import functions as F

from docflow.operators import cases, eventlog, footprint
from docflow.plans.inputs import (
    DAY_LOG,
    FLOW_ORDER,
    ORDER_FLOW,
    USER_LOG,
    day_log,
    flow_documents,
    order_flow,
    user_log,
)
from docflow.plans.registry import query, table

STEPS = """steps AS (SELECT case_id, activity AS a, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS b
  FROM log)"""
DFG = "dfg AS (SELECT a, b, count(*) AS n FROM steps WHERE b IS NOT NULL GROUP BY a, b)"
BOTH = """bothways AS (SELECT x.a, x.b, x.n, coalesce(y.n, 0) AS n_back
  FROM dfg x LEFT JOIN dfg y ON x.a = y.b AND x.b = y.a)"""
FLOW_STEPS = """steps AS (SELECT case_id, activity AS a, ts AS ts_a,
    lead(activity) OVER w AS b, lead(ts) OVER w AS ts_b
  FROM flow WINDOW w AS (PARTITION BY case_id ORDER BY ts, activity))"""


@query("dfg_counts", f"WITH {USER_LOG}, {STEPS}, {DFG} SELECT a, b, n FROM dfg")
def dfg_counts(spark, folder):
    return footprint.dfg(user_log(spark, folder))


@query(
    "footprint",
    f"""WITH {USER_LOG}, {STEPS}, {DFG}, {BOTH}
    SELECT a, b, CASE WHEN n_back > 0 THEN 'parallel' ELSE 'sequence' END AS rel FROM bothways""",
)
def footprint_relations(spark, folder):
    return footprint.footprint(footprint.dfg(user_log(spark, folder)))


@query(
    "footprint_order_flow",
    f"""WITH {ORDER_FLOW}, {FLOW_STEPS}, {DFG}, {BOTH}
    SELECT a, b, CASE WHEN n_back > 0 THEN 'parallel' ELSE 'sequence' END AS rel FROM bothways""",
)
def footprint_order_flow(spark, folder):
    return footprint.footprint(footprint.dfg(order_flow(spark, folder), order=FLOW_ORDER))


@query(
    "unrelated_activities",
    f"""WITH {DAY_LOG}, {STEPS}, {DFG}, names AS (SELECT DISTINCT activity FROM log)
    SELECT x.activity AS a, y.activity AS b FROM names x JOIN names y ON x.activity < y.activity
    WHERE NOT EXISTS (SELECT 1 FROM dfg WHERE (a = x.activity AND b = y.activity) OR (a = y.activity AND b = x.activity))""",
)
def unrelated_activities(spark, folder):
    log = day_log(spark, folder)
    return footprint.unrelated(footprint.dfg(log), log)


PRIORITY_FLOW = (
    "flow AS (SELECT o_orderkey AS case_id, 'order ' || o_orderpriority AS activity, o_orderdate AS ts FROM orders "
    "UNION ALL SELECT l_orderkey, 'ship_' || l_returnflag, l_shipdate FROM lineitem)"
)


@query(
    "unrelated_priorities",
    f"""WITH {PRIORITY_FLOW}, {FLOW_STEPS}, {DFG}, names AS (SELECT DISTINCT activity FROM flow)
    SELECT x.activity AS a, y.activity AS b FROM names x JOIN names y ON x.activity < y.activity
    WHERE NOT EXISTS (SELECT 1 FROM dfg WHERE (a = x.activity AND b = y.activity) OR (a = y.activity AND b = x.activity))""",
)
def unrelated_priorities(spark, folder):
    """Orders by priority and their shipments: orders never follow each other, as a case holds one."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.concat_ws(" ", F.lit("order"), "o_orderpriority").alias("activity"), F.col("o_orderdate").alias("ts")
    )
    log = order_flow(spark, folder).where(F.col("activity") != "order").unionByName(orders)
    return footprint.unrelated(footprint.dfg(log, order=FLOW_ORDER), log)


@query(
    "start_end_activities",
    f"""WITH {USER_LOG}, edge AS (SELECT case_id,
      first(activity ORDER BY ts, event_id) AS s, last(activity ORDER BY ts, event_id) AS e FROM log GROUP BY case_id)
    SELECT 'start' AS kind, s AS activity, count(*) AS n FROM edge GROUP BY s
    UNION ALL SELECT 'end', e, count(*) FROM edge GROUP BY e""",
)
def start_end(spark, folder):
    return eventlog.starts_and_ends(user_log(spark, folder))


@query(
    "dependency_measure",
    f"""WITH {USER_LOG}, {STEPS}, {DFG}, {BOTH}
    SELECT a, b, n, n_back,
      round(CASE WHEN a = b THEN n / (n + 1.0) ELSE (n - n_back) / (n + n_back + 1.0) END, 9) AS dependency,
      (n_back = 0 AND a <> b) AS is_causal FROM bothways""",
)
def dependency_measure(spark, folder):
    out = footprint.dependency(footprint.dfg(user_log(spark, folder)))
    return out.withColumn("dependency", F.round("dependency", 9))


@query(
    "traces",
    f"""WITH {USER_LOG} SELECT case_id, event_id, activity,
      row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS seq FROM log""",
)
def traces(spark, folder):
    return eventlog.ordered(user_log(spark, folder)).select("case_id", "event_id", "activity", "seq")


@query(
    "object_traces",
    """WITH numbered AS (SELECT user_id AS case_id, event_id, event_type || '_' ||
        (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) AS object,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
    SELECT case_id, seq, object FROM numbered""",
)
def object_traces(spark, folder):
    docs = table(spark, folder, "events").select(
        F.col("user_id").alias("case_id"),
        F.col("event_id").alias("doc_id"),
        F.col("event_type").alias("cluster"),
        F.col("ts").alias("final_ts"),
    )
    indexed = cases.repeat_index(docs)
    ordered = eventlog.ordered(indexed, order=("final_ts", "doc_id"))
    return ordered.select(
        "case_id", "seq", eventlog.object_name(F.col("cluster"), F.col("variant_id")).alias("object")
    )


@query(
    "trace_variants",
    f"""WITH {DAY_LOG}, per AS (SELECT case_id, count(*) AS n_events,
        string_agg(activity, '>' ORDER BY ts, event_id) AS t FROM log GROUP BY case_id)
    SELECT n_events, count(*) AS n_cases, min(case_id) AS first_case FROM per GROUP BY n_events, t""",
)
def trace_variants(spark, folder):
    return eventlog.trace_variants(day_log(spark, folder))


@query(
    "time_relations",
    f"""WITH {ORDER_FLOW}, {FLOW_STEPS}
    SELECT a, b, count(*) AS n, count(DISTINCT case_id) AS n_cases FROM steps WHERE b IS NOT NULL GROUP BY a, b""",
)
def time_relations(spark, folder):
    return eventlog.time_relations(order_flow(spark, folder), order=FLOW_ORDER)


PAIRS = f"""{ORDER_FLOW}, {FLOW_STEPS}, pairs AS (SELECT case_id, a, b,
      '((''' || a || '''), (''' || b || '''))' AS activity, epoch_us(ts_a) AS start_us, epoch_us(ts_b) AS end_us
    FROM steps WHERE b IS NOT NULL)"""


@query(
    "event_log_pairs",
    f"""WITH {PAIRS} SELECT case_id, a, b, activity, start_us, end_us,
      CAST((start_us + end_us) // 2 AS BIGINT) AS time_us, (end_us - start_us) / 1e6 AS duration_s FROM pairs""",
)
def event_log_pairs(spark, folder):
    return eventlog.pair_events(order_flow(spark, folder), order=FLOW_ORDER)


@query(
    "event_log_merged",
    f"""WITH {PAIRS}, named AS (SELECT *, CASE WHEN a = 'order' THEN 'shipping starts' END AS merged FROM pairs),
    together AS (SELECT case_id, activity, start_us::DOUBLE AS s, end_us::DOUBLE AS e FROM named WHERE merged IS NULL
      UNION ALL SELECT case_id, merged, avg(start_us), avg(end_us) FROM named WHERE merged IS NOT NULL GROUP BY case_id, merged)
    SELECT case_id, activity, s::BIGINT AS start_us, e::BIGINT AS end_us, ((s + e) / 2)::BIGINT AS time_us,
      (e - s) / 1e6 AS duration_s FROM together""",
)
def event_log_merged(spark, folder):
    pairs = eventlog.pair_events(order_flow(spark, folder), order=FLOW_ORDER)
    merged = (
        pairs.where(F.col("a") == "order")
        .select("a", "b")
        .distinct()
        .withColumn("activity", F.lit("shipping starts"))
    )
    return eventlog.merged_events(pairs, merged)


@query(
    "event_order",
    f"""WITH {PAIRS} SELECT case_id, activity, start_us, end_us,
      row_number() OVER (PARTITION BY case_id ORDER BY start_us, end_us, activity) AS seq FROM pairs""",
)
def event_order(spark, folder):
    pairs = eventlog.pair_events(order_flow(spark, folder), order=FLOW_ORDER)
    ordered = eventlog.ordered(pairs, order=("start_us", "end_us", "activity"))
    return ordered.select("case_id", "activity", "start_us", "end_us", "seq")


@query(
    "repeat_index",
    """WITH t AS (SELECT user_id AS case_id, event_id AS doc_id, event_type AS cluster, ts FROM events),
    c AS (SELECT case_id, cluster, count(*) AS n, count(DISTINCT ts) AS k FROM t GROUP BY 1, 2)
    SELECT t.case_id, t.doc_id, t.cluster,
      row_number() OVER (PARTITION BY t.case_id, t.cluster ORDER BY ts, doc_id) - 1 AS variant_id,
      c.n > 1 AS has_variants, c.k < c.n AS multiple
    FROM t JOIN c ON t.case_id = c.case_id AND t.cluster = c.cluster""",
)
def repeat_index(spark, folder):
    docs = table(spark, folder, "events").select(
        F.col("user_id").alias("case_id"),
        F.col("event_id").alias("doc_id"),
        F.col("event_type").alias("cluster"),
        F.col("ts").alias("final_ts"),
    )
    return cases.repeat_index(docs).drop("final_ts")


COMPOSITION = "comp AS (SELECT case_id, activity AS cluster, count(*) AS n_docs, count(*) AS n_own FROM flow GROUP BY 1, 2)"


@query("case_composition", f"WITH {ORDER_FLOW}, {COMPOSITION} SELECT * FROM comp")
def case_composition(spark, folder):
    return cases.composition(flow_documents(spark, folder))


@query(
    "case_variants",
    f"""WITH {ORDER_FLOW}, {COMPOSITION}, per AS (SELECT case_id,
        string_agg(cluster || '=' || n_own, ',' ORDER BY cluster || '=' || n_own) AS variant FROM comp GROUP BY case_id)
    SELECT case_id, variant, count(*) OVER (PARTITION BY variant) AS variant_count FROM per""",
)
def case_variants(spark, folder):
    return cases.case_variants(cases.composition(flow_documents(spark, folder)))


@query(
    "case_stats",
    f"""WITH {ORDER_FLOW} SELECT case_id, count(*) AS n_docs, count(DISTINCT activity) AS n_types,
      epoch_us(min(ts)) AS earliest_us, epoch_us(max(ts)) AS latest_us,
      (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS range_days FROM flow GROUP BY case_id""",
)
def case_stats(spark, folder):
    stats = cases.case_stats(flow_documents(spark, folder))
    return stats.select(
        "case_id",
        "n_docs",
        "n_types",
        F.unix_micros("earliest").alias("earliest_us"),
        F.unix_micros("latest").alias("latest_us"),
        "range_days",
    )


@query(
    "similar_cases",
    f"""WITH {ORDER_FLOW}, per AS (SELECT case_id, string_agg(DISTINCT activity, ',' ORDER BY activity) AS type_set
        FROM flow GROUP BY case_id)
    SELECT type_set, count(*) AS n_cases, min(case_id) AS first_case FROM per GROUP BY type_set""",
)
def similar_cases(spark, folder):
    return cases.similar_cases(flow_documents(spark, folder))


@query(
    "shared_documents",
    """SELECT 'customer:' || o_custkey AS doc_id, count(DISTINCT o_orderkey) AS n_cases FROM orders
    GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) > 1""",
)
def shared_documents(spark, folder):
    docs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("doc_id"),
    )
    return cases.shared_documents(docs)


@query(
    "median_time",
    "SELECT l_orderkey AS doc_id, floor(quantile_cont(epoch_us(l_shipdate)::DOUBLE, 0.5))::BIGINT AS final_us FROM lineitem GROUP BY l_orderkey",
)
def median_time(spark, folder):
    from docflow.operators.leaves import document_time

    stamps = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_shipdate").alias("ts"))
    return document_time(stamps).select("doc_id", F.unix_micros("final_ts").alias("final_us"))


@query(
    "sequence_distance",
    f"""WITH RECURSIVE {DAY_LOG}, ordered AS (SELECT case_id, activity || '_' || (row_number() OVER
        (PARTITION BY case_id, activity ORDER BY ts, event_id) - 1) AS node, ts, event_id FROM log),
    st AS (SELECT case_id, node AS a, lead(node) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS b FROM ordered),
    e AS (SELECT DISTINCT a, b FROM st WHERE b IS NOT NULL),
    nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e),
    walk(node, hops) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT b FROM e)
      UNION SELECT e.b, walk.hops + 1 FROM walk JOIN e ON e.a = walk.node WHERE walk.hops < 60)
    SELECT nodes.node, coalesce(min(walk.hops), 0)::INTEGER AS hops FROM nodes LEFT JOIN walk USING (node) GROUP BY nodes.node""",
)
def sequence_distance(spark, folder):
    docs = day_log(spark, folder).select(
        "case_id", F.col("event_id").alias("doc_id"), F.col("activity").alias("cluster"), F.col("ts").alias("final_ts")
    )
    indexed = cases.repeat_index(docs).withColumn(
        "activity", eventlog.object_name(F.col("cluster"), F.col("variant_id"))
    )
    graph = footprint.dfg(indexed, order=("final_ts", "doc_id"))
    return footprint.hops(graph)
