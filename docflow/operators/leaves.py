"""Nested documents as a leaf table: one row per scalar, found in a single narrow pass.

Every nesting level is one outer `variant_explode`; scalars met early are carried along.  There is no
shuffle and no re-parse per level, and a row carries only the part of the document it still has to
open.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.dates import normalize_date, parse_date, parse_unified
from docflow.functions.values import clean_key, long_norm, number_norm, string_norm
from docflow.session import cut_lineage

#: Levels opened in one plan; deeper content goes on from a written table.
PLAN_LEVELS = 8


def _is_container(schema):
    return schema.startswith("OBJECT") | schema.startswith("ARRAY")


def parsed_content(documents: DataFrame) -> Column:
    """`content` as a variant; malformed text is null."""
    content = F.col("content")
    return F.try_parse_json(content) if dict(documents.dtypes)["content"] == "string" else content


def nesting(documents: DataFrame) -> int:
    """The deepest nesting of containers in `content`: one pass that sends one number to the driver."""
    content = F.col("content") if dict(documents.dtypes)["content"] == "string" else F.to_json("content")
    brackets = F.regexp_replace(content, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++', "")
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    depth = F.aggregate(F.split(brackets, ""), state, step, lambda acc: acc["most"])
    return documents.select(depth.alias("d")).agg(F.max("d")).first()[0] or 0


def walk(documents: DataFrame, keep: list[str] | None = None, levels: int | None = None) -> DataFrame:
    """Open `content` (JSON text or variant) level by level.

    Adds path, key, keys (all object keys above), entry_idx (position in the outermost array),
    list_path/list_idx (nearest array), in_list (scalar directly in a list) and the value `v`.
    As many levels are opened as the documents have, which is looked up first; a stream cannot be looked
    through, so there `levels` must say how many, and what lies deeper stays whole as a container value.
    """
    keep = keep or ["doc_id"]
    if levels is None:
        if documents.isStreaming:
            raise ValueError("give the levels of streamed documents")
        levels = nesting(documents)
    content = parsed_content(documents)
    spark = documents.sparkSession
    none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    cur = documents.select(
        *keep,
        F.lit("").alias("path"),
        none_text.alias("name"),
        F.array().cast("array<string>").alias("keys"),
        none_int.alias("entry_idx"),
        none_text.alias("list_path"),
        none_int.alias("list_idx"),
        F.lit(False).alias("in_list"),
        content.alias("v"),
    )
    finished = None
    for level in range(levels):
        if level and level % PLAN_LEVELS == 0 and not documents.isStreaming:
            is_open = _is_container(F.coalesce(F.schema_of_variant("v"), F.lit("")))
            finished = _both(finished, cur.where(~is_open))
            cur = cut_lineage(cur.where(is_open))
        exploded = cur.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
        stop = F.col("pos").isNull()
        field = F.col("key").isNotNull()
        dotted = F.when(F.col("path") == "", F.col("key")).otherwise(
            F.concat("path", F.lit("."), "key")
        )
        indexed = F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))
        cur = exploded.select(
            *keep,
            F.when(stop, F.col("path")).when(field, dotted).otherwise(indexed).alias("path"),
            F.when(field, F.col("key")).otherwise(F.col("name")).alias("name"),
            F.when(field, F.concat("keys", F.array("key"))).otherwise(F.col("keys")).alias("keys"),
            F.when(stop | field, F.col("entry_idx"))
            .otherwise(F.coalesce("entry_idx", "pos"))
            .alias("entry_idx"),
            F.when(stop | field, F.col("list_path")).otherwise(F.col("path")).alias("list_path"),
            F.when(stop | field, F.col("list_idx")).otherwise(F.col("pos")).alias("list_idx"),
            F.when(stop, F.col("in_list")).otherwise(~field).alias("in_list"),
            F.when(stop, F.col("v")).otherwise(F.col("value")).alias("v"),
        )
    return _both(finished, cur)


def _both(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def leaves(documents: DataFrame, keep: list[str] | None = None, levels: int | None = None) -> DataFrame:
    """Leaf table: keep columns, path, key, value, vtype, num, norm, entry_idx, list_path, list_idx,
    in_list.

    `norm` is the comparison form: 1, 1.0 and true are equal, text never equals a number, null equals
    null.  Empty containers give no row.
    """
    keep = keep or ["doc_id"]
    opened = walk(documents, keep, levels).withColumn("_schema", F.schema_of_variant("v"))
    schema = F.col("_schema")
    vtype = (
        F.when(schema == "VOID", "NULL")
        .when(schema == "BOOLEAN", "BOOLEAN")
        .when(schema == "STRING", "STRING")
        .when(_is_container(schema), "NESTED")
        .when(schema == "BIGINT", "LONG")
        .otherwise("DOUBLE")
    )
    empty = schema.isin("OBJECT<>", "ARRAY<VOID>") & (F.to_json("v").isin("{}", "[]"))
    text = F.try_variant_get("v", "$", "string")
    out = (
        # Malformed content is a null value here; testing it before the walk would parse it twice.
        opened.where(F.col("v").isNotNull() & ~empty)
        .withColumn("vtype", vtype)
        .withColumn(
            "value",
            F.when(F.col("vtype") == "NESTED", F.to_json("v"))
            .when(F.col("vtype") == "NULL", F.lit(None).cast("string"))
            .otherwise(text),
        )
        .withColumn(
            "num",
            F.when(F.col("vtype").isin("LONG", "DOUBLE"), F.try_variant_get("v", "$", "double")).when(
                F.col("vtype") == "BOOLEAN",
                F.try_variant_get("v", "$", "boolean").cast("int").cast("double"),
            ),
        )
    )
    norm = (
        F.when(F.col("vtype") == "NULL", F.lit("z"))
        .when(F.col("vtype") == "LONG", long_norm(F.try_variant_get("v", "$", "bigint")))
        .when(F.col("vtype").isin("DOUBLE", "BOOLEAN"), number_norm(F.col("num")))
        .otherwise(string_norm(F.col("value")))
    )
    return out.select(
        *keep,
        "path",
        F.col("name").alias("key"),
        "value",
        "vtype",
        "num",
        norm.alias("norm"),
        "entry_idx",
        "list_path",
        "list_idx",
        "in_list",
    )


def key_signature(documents: DataFrame, keep: list[str] | None = None, levels: int | None = None) -> DataFrame:
    """Distinct nested keys of every document, sorted and joined by blanks, whatever the arrays mix."""
    keep = keep or ["doc_id"]
    per_doc = walk(documents, keep, levels).groupBy(*keep).agg(F.collect_set("keys").alias("_sets"))
    keys = F.array_sort(F.array_distinct(F.flatten("_sets")))
    return per_doc.select(*keep, keys.alias("key_set")).withColumn("key_text", F.array_join("key_set", " "))


def normalize_dates(leaf: DataFrame, extended: bool = True) -> DataFrame:
    """Write every text leaf that is a date in the unified format."""
    is_text = F.col("vtype") == "STRING"
    value = F.when(is_text, normalize_date(F.col("value"), extended)).otherwise(F.col("value"))
    out = leaf.withColumn("value", value)
    if "norm" in leaf.columns:
        out = out.withColumn(
            "norm", F.when(is_text, string_norm(F.col("value"))).otherwise(F.col("norm"))
        )
    return out


def timestamp_leaves(leaf: DataFrame, normalized: bool = False, extended: bool = True) -> DataFrame:
    """Leaves that are dates, with `ts`."""
    text = F.col("value")
    ts = parse_unified(text) if normalized else parse_date(text, extended)
    dated = leaf.where(F.col("vtype") == "STRING").withColumn("ts", ts)
    return dated.where(F.col("ts").isNotNull())


def numeric_leaves(leaf: DataFrame) -> DataFrame:
    return leaf.where(F.col("vtype").isin("LONG", "DOUBLE"))


def categorized_numbers(leaf: DataFrame) -> DataFrame:
    """Numeric leaves with the category their key name tells: price, quantity, weight or other."""
    low = F.lower("key")
    category = (
        F.when(low.contains("preis") | low.contains("betrag"), "price")
        .when(low.contains("menge") | low.contains("anzahl"), "quantity")
        .when(low.contains("gewicht"), "weight")
        .otherwise("other")
    )
    return numeric_leaves(leaf).withColumn("category", category)


def numeric_wide(leaf: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    """One row per document entry, numeric leaves as columns; of several values of a key, that with the
    least path."""
    entry = F.coalesce("entry_idx", F.lit(0)).alias("entry_idx")
    return (
        numeric_leaves(leaf)
        .select(*ids, entry, "key", "num", "path")
        .groupBy(*ids, "entry_idx")
        .pivot("key", keys)
        .agg(F.min_by("num", "path"))
    )


def find_value(leaf: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """First value of a key in document order, keys compared without case, `_` and `-`.

    The least deep occurrence wins, then the smallest path.
    """
    by = by or ["doc_id"]
    wanted = key.lower().replace("_", "").replace("-", "")
    depth = F.size(F.split("path", r"[.\[]"))
    return (
        leaf.where(clean_key(F.col("key")) == wanted)
        .groupBy(*by)
        .agg(F.min_by("value", F.struct(depth, "path")).alias("value"))
    )


def entry_leaves(leaf: DataFrame, key: str, norm) -> DataFrame:
    """All leaves of those array entries that hold `key` = `norm` (partial content).

    `key` may be dotted; its last part names the leaf and the others its parents.  What lies outside all
    arrays counts as one entry.
    """
    parts = key.split(".")
    hit = F.col("key") == parts[-1]
    for parent in parts[:-1]:
        quoted = parent.replace("\\E", r"\E\\E\Q")
        hit = hit & F.col("path").rlike(rf"(^|\.)\Q{quoted}\E(\[\d+\])*\.")
    hits = leaf.where(hit & (F.col("norm") == norm)).select("doc_id", "entry_idx").distinct()
    same = (leaf["doc_id"] == hits["doc_id"]) & leaf["entry_idx"].eqNullSafe(hits["entry_idx"])
    return leaf.join(hits, same, "left_semi")


def entry_at(documents: DataFrame, path: str, index: int) -> DataFrame:
    """One entry of the array at `path`, as JSON text (null when it does not exist)."""
    content = F.col("content")
    if dict(documents.dtypes)["content"] == "string":
        content = F.try_parse_json(content)
    return documents.select(
        "doc_id", F.to_json(F.try_variant_get(content, f"$.{path}[{index}]", "variant")).alias("entry")
    )


def document_time(stamps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Representative time of a document: median of its timestamps, midpoint on an even count."""
    by = by or ["doc_id"]
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        stamps.groupBy(*by)
        .agg(F.percentile(micros, F.lit(0.5)).alias("_m"))
        .select(*by, F.timestamp_micros(F.col("_m").cast("long")).alias("final_ts"))
    )


def word_counts(documents: DataFrame, text: str = "key_text") -> DataFrame:
    """Frequency of every blank-separated word."""
    return (
        documents.select(F.explode(F.split(text, r"\s+")).alias("word"))
        .where(F.col("word") != "")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def mode_value(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value per group, smallest value on a tie."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value), F.max("n").alias("n"))


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of every group."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(window)).where(F.col("_rk") <= k).drop("_rk")
