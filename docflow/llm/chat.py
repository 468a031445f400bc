"""Chat formatting with tool calls: linking by identifier, topological order, schema checks, canonical JSON.

Everything is joins, aggregates and JSON functions over rows of messages; a conversation is never gathered into one
row, so its length does not matter.

Messages: conv_id, turn, role, text, call_id, name, arguments (JSON text), needs (ids of calls whose results a call
uses).  A call is a row with a name, a result a row of role `tool`; all others are plain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import written
from docflow.operators.skew import lookup_join, small_join

_COLUMNS = ("conv_id", "turn", "role", "text", "call_id", "name", "arguments", "needs")
_KEY = ["conv_id", "call_id"]


def canonical(json: Column) -> Column:
    """JSON text with sorted keys, no white space and plain numbers; null if it is not valid or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def _kind(of: Column) -> Column:
    """JSON-schema type of a variant."""
    name = F.schema_of_variant(of)
    return (
        F.when(name == "VOID", "null")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), "integer")
        .when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(name.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add errors (sorted) to calls: `tool` for an unknown name, `arguments` for what is no JSON object, and
    `missing:`, `unknown:`, `type:` and `value:` with the parameter.

    schemas: tool, param, type (string, integer, number, boolean, array, object or null; null: any), required,
    allowed (texts, null: any).  A tool without parameters has one row with param null.
    """
    tools = schemas.groupBy(F.col("tool").alias("name")).agg(
        F.array_sort(F.collect_set(F.struct("param", "type", "required", "allowed"))).alias("_tool")
    )
    known = small_join(calls, tools, ["name"], "left")
    given = F.expr("map_entries(from_json(arguments, 'map<string,variant>'))")
    known = known.withColumn("_valid", F.try_parse_json("arguments").isNotNull() & F.startswith(F.ltrim("arguments"), F.lit("{")))
    known = known.withColumn(
        "_given",
        F.when(F.col("_valid"), F.transform(given, lambda e: F.struct(e["key"].alias("key"), _kind(e["value"]).alias("type"), e["value"].try_cast("string").alias("value")))),
    )

    def check(p: Column) -> Column:
        own = F.filter("_given", lambda g: g["key"] == p["param"])
        one = F.get(own, F.lit(0))
        wrong = p["type"].isNotNull() & (one["type"] != p["type"]) & ~((p["type"] == "number") & (one["type"] == "integer"))
        found = F.when(F.size(own) == 0, F.when(F.coalesce(p["required"], F.lit(False)), F.lit("missing:"))).when(wrong, F.lit("type:"))
        banned = p["allowed"].isNotNull() & ~F.coalesce(F.array_contains(p["allowed"], one["value"]), F.lit(False))
        return F.when(p["param"].isNull(), F.lit(None)).otherwise(
            F.concat(F.coalesce(found, F.when((F.size(own) > 0) & banned, F.lit("value:"))), p["param"])
        )

    extra = F.transform(
        F.filter("_given", lambda g: ~F.exists("_tool", lambda p: F.coalesce(p["param"] == g["key"], F.lit(False)))),
        lambda g: F.concat(F.lit("unknown:"), g["key"]),
    )
    checked = F.filter(F.concat(F.transform("_tool", check), extra), lambda e: e.isNotNull())
    errors = F.when(F.col("_tool").isNull(), F.array(F.lit("tool"))).when(F.coalesce("_valid", F.lit(False)), F.array_sort(checked))
    return known.withColumn("errors", F.coalesce(errors, F.array(F.lit("arguments")))).drop("_tool", "_given", "_valid")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level of distinct calls: 0 without needs, else one more than the highest need's.

    Needs that no call of the conversation answers do not count.  Calls in a circle, or that need one in a circle,
    are left out.  There are as many rounds as levels, each a join on (conversation, call).
    """
    nodes = written(calls.select(*_KEY).distinct(), "calls")
    asked = calls.select("conv_id", F.col("call_id").alias("of"), F.explode("needs").alias("call_id")).distinct()
    edges = written(asked.join(nodes, _KEY, "left_semi"), "needs")
    heads = edges.select("conv_id", F.col("of").alias("call_id")).distinct()
    known = written(nodes.join(heads, _KEY, "left_anti").withColumn("level", F.lit(0)), "levels")
    open_edges = edges
    while True:
        met = open_edges.join(known, _KEY, "left").groupBy("conv_id", F.col("of").alias("call_id"))
        met = met.agg(F.count("*").alias("n"), F.count("level").alias("n_known"), F.max("level").alias("level"))
        ready = written(met.where("n = n_known").select(*_KEY, (F.col("level") + 1).alias("level")), "levels")
        if ready.isEmpty():
            return known
        known = known.unionByName(ready)
        done = ready.select("conv_id", F.col("call_id").alias("of"))
        open_edges = written(open_edges.join(done, ["conv_id", "of"], "left_anti"), "needs")


def format_chat(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, call_id, level, status, errors and line, its canonical JSON.

    status: `message`; for calls `linked`, `no_result`, `repeated_id` (the id was used at an earlier turn), `circular`
    or `no_id`; for results `linked`, `no_call`, `repeated_result` (an earlier turn answers the call) or `no_id`.
    level: of calls, and of the results linked to them; reading a conversation by (level, turn) has every call after
    the results it needs.  Rows equal in all columns act alike.  Missing columns are taken as null, others ignored.
    """
    have = {c.lower() for c in messages.columns}
    kinds = {"needs": "array<string>", "turn": "long"}
    rows = messages.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, "string")).alias(c) if c != "conv_id" else F.col(c) for c in _COLUMNS]
    )
    is_call, is_result = F.col("name").isNotNull(), F.col("name").isNull() & (F.col("role") == "tool")
    linkable = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    calls = argument_errors(rows.where(is_call), schemas)
    first_calls = rows.where(is_call & linkable).groupBy(*_KEY).agg(F.min("turn").alias("called"))
    first_results = rows.where(is_result & linkable).groupBy(*_KEY).agg(F.min("turn").alias("answered"))
    ordered = levels(rows.where(is_call & linkable).join(first_calls, _KEY).where(F.col("turn").eqNullSafe(F.col("called"))))
    ids = first_calls.withColumn("_call", F.lit(True)).join(first_results.withColumn("_result", F.lit(True)), _KEY, "full")
    ids = written(ids.join(ordered, _KEY, "left"), "ids")
    call = lookup_join(calls, ids, _KEY, "left").withColumn(
        "status",
        F.when(~linkable, "no_id")
        .when(~F.col("turn").eqNullSafe(F.col("called")), "repeated_id")
        .when(F.col("level").isNull(), "circular")
        .when(F.col("_result").isNull(), "no_result")
        .otherwise("linked"),
    )
    none = F.lit(None).cast("array<string>")
    result = lookup_join(rows.where(is_result).withColumn("errors", none), ids, _KEY, "left").withColumn(
        "status",
        F.when(~linkable, "no_id")
        .when(F.col("_call").isNull(), "no_call")
        .when(~F.col("turn").eqNullSafe(F.col("answered")), "repeated_result")
        .otherwise("linked"),
    )
    plain = rows.where(~is_call & ~F.coalesce(is_result, F.lit(False))).select(
        *_COLUMNS, none.alias("errors"), F.lit(None).cast("int").alias("level"), F.lit("message").alias("status")
    )
    shown = F.when(F.col("status").isin("linked", "no_result"), F.col("level")).alias("level")
    parts = [x.select(*_COLUMNS, "errors", shown, "status") for x in (call, result)]
    every = plain.unionByName(parts[0]).unionByName(parts[1])
    parsed = F.try_parse_json("arguments")
    line = F.to_json(
        F.struct(
            parsed.alias("arguments"),
            F.when(parsed.isNull(), F.col("arguments")).alias("arguments_text"),
            "call_id",
            F.col("text").alias("content"),
            "conv_id",
            "name",
            F.when(F.size("needs") > 0, F.array_sort("needs")).alias("needs"),
            "role",
            "turn",
        )
    )
    return every.select("conv_id", "turn", "role", "call_id", "level", "status", "errors", line.alias("line"))
