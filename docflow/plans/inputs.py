"""Views of the driver tables as logs, documents and leaves, with the same views in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.plans.registry import table
from docflow.sources.tables import row_leaves


def user_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log: case = user."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("activity"), "ts", "event_id"
    )


USER_LOG = "log AS (SELECT user_id AS case_id, event_type AS activity, ts, event_id FROM events)"


def day_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log: case = user and day."""
    day = F.date_format("ts", "yyyyMMdd")
    return table(spark, folder, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), day).alias("case_id"),
        F.col("event_type").alias("activity"),
        "ts",
        "event_id",
    )


DAY_LOG = (
    "log AS (SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS case_id, "
    "event_type AS activity, ts, event_id FROM events)"
)


def order_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and their shipments as a log: case = order.  Rows equal in (ts, activity) act alike."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.lit("order").alias("activity"), F.col("o_orderdate").alias("ts")
    )
    ships = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.concat(F.lit("ship_"), "l_returnflag").alias("activity"),
        F.col("l_shipdate").alias("ts"),
    )
    return orders.unionByName(ships)


FLOW_ORDER = ("ts", "activity")

ORDER_FLOW = (
    "flow AS (SELECT o_orderkey AS case_id, 'order' AS activity, o_orderdate AS ts FROM orders "
    "UNION ALL SELECT l_orderkey, 'ship_' || l_returnflag, l_shipdate FROM lineitem)"
)


def flow_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The order flow as case documents: case_id, doc_id, cluster, is_shared, final_ts."""
    flow = order_flow(spark, folder)
    return flow.select(
        "case_id",
        F.concat_ws(":", "activity", F.col("case_id").cast("string")).alias("doc_id"),
        F.col("activity").alias("cluster"),
        F.lit(False).alias("is_shared"),
        F.col("ts").cast("timestamp").alias("final_ts"),
    )


def key_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Key columns of orders, customers, suppliers and nations as leaves of row documents."""
    specs = [
        ("orders", "o_orderkey", {"o_orderkey": "orderkey", "o_custkey": "custkey"}),
        ("customer", "c_custkey", {"c_custkey": "custkey", "c_nationkey": "nationkey"}),
        ("supplier", "s_suppkey", {"s_suppkey": "suppkey", "s_nationkey": "nationkey"}),
        ("nation", "n_nationkey", {"n_nationkey": "nationkey", "n_regionkey": "regionkey"}),
    ]
    out = None
    for name, key, columns in specs:
        rows = table(spark, folder, name).select(
            F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("doc_id"),
            *[F.col(c).cast("long").alias(alias) for c, alias in columns.items()],
        )
        leaf = row_leaves(rows, {"doc_id": "doc_id"}, list(columns.values()), name)
        out = leaf if out is None else out.unionByName(leaf)
    return out


KEY_LEAVES = """keyrows AS (
  SELECT 'orders:' || o_orderkey AS doc_id, 'orders' AS cluster, 'orderkey' AS key, o_orderkey AS v FROM orders
  UNION ALL SELECT 'orders:' || o_orderkey, 'orders', 'custkey', o_custkey FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'custkey', c_custkey FROM customer
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'nationkey', c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'suppkey', s_suppkey FROM supplier
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'nationkey', s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 'nationkey', n_nationkey FROM nation
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 'regionkey', n_regionkey FROM nation),
leafrows AS (SELECT DISTINCT doc_id, cluster, key, 'n:' || v AS norm FROM keyrows)"""


def event_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a nested JSON document with one entry and its properties inside."""
    body = F.struct(
        F.col("event_id").alias("Event_ID"),
        F.col("user_id").alias("User_ID"),
        F.col("event_type").alias("Type"),
        F.col("value").alias("Value"),
        F.from_json("props", "struct<k: bigint>").alias("Props"),
    )
    return table(spark, folder, "events").select(
        F.col("event_id").alias("doc_id"), F.to_json(F.struct(F.array(body).alias("Event"))).alias("content")
    )


def line_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every text document as a JSON document whose array holds one object per text line; `Size` is
    missing for empty lines, so entries may differ in their keys."""
    lines = F.split("text", "\n")
    entries = F.transform(
        lines,
        lambda line, i: F.struct(
            i.alias("No"),
            line.alias("Line"),
            F.when(F.length(line) > 0, F.length(line)).alias("Size"),
        ),
    )
    return table(spark, folder, "documents").select(
        "doc_id", F.to_json(F.struct("lang", entries.alias("Lines"))).alias("content")
    )


LINES = (
    "lines AS (SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, "
    "unnest(string_split(text, chr(10))) AS line FROM documents)"
)
