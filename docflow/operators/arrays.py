"""Arrays of objects inside documents: discovery, uniformity, reference documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from docflow.config import DEFAULTS, Params
from docflow.operators.leaves import PLAN_LEVELS, nesting, parsed_content
from docflow.session import cut_lineage


def _entry_keys(v: Column) -> Column:
    """Sorted keys of every entry when `v` is a non-empty array of objects, else null."""
    entries = F.try_variant_get(v, "$", "array<map<string,variant>>")
    return F.transform(entries, lambda e: F.array_sort(F.map_keys(e)))


def _profile(keys: Column, path: Column, threshold: float) -> Column:
    """Key profile of one array of objects, computed on the row that holds it.

    Every entry is compared with the first one (Jaccard of the key sets).
    """
    base = F.element_at(keys, 1)
    rest = F.slice(keys, 2, F.greatest(F.size(keys) - 1, F.lit(0)))

    def jaccard(k: Column) -> Column:
        union = F.size(F.array_union(base, k))
        return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(base, k)) / union)

    similarities = F.transform(rest, jaccard)
    uniform = (F.size(keys) >= 2) & F.forall(similarities, lambda s: s >= threshold)
    # Entries mostly repeat a few key sets, so the differences are taken over distinct ones.
    kinds = F.array_distinct(rest)
    return F.struct(
        path.alias("path"),
        F.size(keys).alias("n_entries"),
        base.alias("base_keys"),
        F.transform(similarities, lambda s: F.round(s, 3)).alias("similarities"),
        F.array_distinct(F.flatten(F.transform(kinds, lambda k: F.array_except(base, k)))).alias(
            "missing_keys"
        ),
        F.array_distinct(F.flatten(F.transform(kinds, lambda k: F.array_except(k, base)))).alias(
            "extra_keys"
        ),
        uniform.alias("is_uniform"),
    )


def array_profiles(
    documents: DataFrame,
    keep: list[str] | None = None,
    params: Params = DEFAULTS,
    levels: int | None = None,
) -> DataFrame:
    """One row per array of objects: path, n_entries, base_keys, similarities, missing/extra keys,
    is_uniform.

    The walk is the one of the leaf table; the profile of an array rides on the row of its first entry.
    """
    keep = keep or ["doc_id"]
    levels = nesting(documents) if levels is None else levels
    content = parsed_content(documents)
    spark = documents.sparkSession
    cur = documents.select(
        *keep, F.lit("").alias("path"), content.alias("v"), F.lit(None).alias("_done")
    )
    profile_type, finished = None, None
    for level in range(max(levels, 1)):
        if level and level % PLAN_LEVELS == 0:
            kind = F.coalesce(F.schema_of_variant("v"), F.lit(""))
            is_open = kind.startswith("OBJECT") | kind.startswith("ARRAY")
            done = cur.where(~is_open & F.col("_done").isNotNull())
            finished = done if finished is None else finished.unionByName(done)
            cur = cut_lineage(cur.where(is_open))
        # The keys are a column of their own: the profile reads them many times.
        cur = cur.withColumn("_keys", _entry_keys(F.col("v")))
        objects = (F.size("_keys") > 0) & F.forall("_keys", lambda k: k.isNotNull())
        profile = F.when(objects, _profile(F.col("_keys"), F.col("path"), params.similarity_threshold))
        cur = cur.withColumn("_p", profile).drop("_keys")
        if profile_type is None:
            profile_type = cur.schema["_p"].dataType
            cur = cur.withColumn("_done", F.lit(None).cast(ArrayType(profile_type)))
        exploded = cur.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
        stop = F.col("pos").isNull()
        field = F.col("key").isNotNull()
        first = stop | (F.col("pos") == 0)
        dotted = F.when(F.col("path") == "", F.col("key")).otherwise(
            F.concat("path", F.lit("."), "key")
        )
        indexed = F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))
        # Null stands for "no profile carried"; only the row of a first entry carries them on.
        carried = F.when(first, F.col("_done"))
        found = F.when(first & F.col("_p").isNotNull(), F.array("_p"))
        grown = F.when(carried.isNull(), found).when(found.isNull(), carried).otherwise(F.concat(carried, found))
        cur = exploded.select(
            *keep,
            F.when(stop, F.col("path")).when(field, dotted).otherwise(indexed).alias("path"),
            F.when(stop, F.col("v")).otherwise(F.col("value")).alias("v"),
            grown.alias("_done"),
        )
    cur = cur if finished is None else finished.unionByName(cur)
    return cur.where(F.col("_done").isNotNull()).select(*keep, F.explode("_done").alias("_p")).select(
        *keep, "_p.*"
    )


def document_structure(
    documents: DataFrame, profiles: DataFrame, keep: list[str] | None = None
) -> DataFrame:
    """Reference flag and instance count per document.

    A document is reference data when it has arrays of objects and all of them are uniform; it then
    counts as many instances as its longest array, any other document counts as one.
    """
    keep = keep or ["doc_id"]
    per_doc = profiles.groupBy(*keep).agg(
        F.bool_and("is_uniform").alias("is_reference"),
        F.max("n_entries").alias("_longest"),
        F.count("*").alias("n_arrays"),
    )
    flag = F.coalesce("is_reference", F.lit(False))
    return (
        documents.select(*keep)
        .join(per_doc, keep, "left")
        .select(
            *keep,
            flag.alias("is_reference"),
            F.when(flag, F.col("_longest")).otherwise(F.lit(1)).cast("long").alias("arrays_found"),
            F.coalesce("n_arrays", F.lit(0)).alias("n_arrays"),
        )
    )


def repeating_arrays(leaf: DataFrame) -> DataFrame:
    """Arrays in which some key takes more than one but fewer than half as many values as entries."""
    inside = leaf.where(F.col("list_path").isNotNull() & ~F.col("in_list"))
    per_key = inside.groupBy("doc_id", "list_path", "key").agg(
        F.count_distinct("norm").alias("n_values"), F.max("list_idx").alias("_last")
    )
    return per_key.groupBy("doc_id", "list_path").agg(
        (F.max("_last") + 1).cast("long").alias("n_entries"),
        F.bool_or((F.col("n_values") > 1) & (F.col("n_values") < (F.col("_last") + 1) / 2)).alias(
            "is_repeating"
        ),
    )


def uniformity_summary(structure: DataFrame) -> DataFrame:
    """Counts of documents with arrays, with uniform arrays only, and of all instances."""
    return structure.agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("n_arrays") > 0).alias("n_with_arrays"),
        F.count_if("is_reference").alias("n_reference"),
        F.sum("arrays_found").alias("n_instances"),
    )


def explode_reference(documents: DataFrame, structure: DataFrame, array_path: str) -> DataFrame:
    """One row per entry for reference documents, other documents unchanged (entry_idx null)."""
    flagged = documents.join(structure.select("doc_id", "is_reference"), "doc_id")
    array = F.try_variant_get(F.try_parse_json("content"), f"$.{array_path}", "array<variant>")
    parts = F.when(F.col("is_reference"), F.transform(array, lambda e: F.to_json(e)))
    columns = [c for c in documents.columns if c != "content"]
    return flagged.withColumn("_parts", parts).select(
        *columns, "content", "is_reference", F.posexplode_outer("_parts").alias("entry_idx", "_part")
    ).withColumn("content", F.coalesce("_part", "content")).drop("_part")
