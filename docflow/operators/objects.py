"""Object types: schema, attributes, required fields, category; process layers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Params


def type_schemas(documents: DataFrame) -> DataFrame:
    """Merged schema text and document count per type (one aggregate with partial merging)."""
    content = F.col("content")
    if dict(documents.dtypes)["content"] == "string":
        content = F.try_parse_json(content)
    return documents.groupBy("doc_type").agg(
        F.schema_of_variant_agg(content).alias("schema"), F.count("*").alias("n_docs")
    )


def attributes(leaf: DataFrame) -> DataFrame:
    """Attributes of every type: path without positions, value types seen, documents holding it, and
    `required` when every document of the type holds it.

    `leaf` carries doc_type.  Types are merged as set flags, so no value list is collected.
    """
    flat = leaf.withColumn("attribute", F.regexp_replace("path", r"\[\d+\]", "[]"))
    per_doc = flat.groupBy("doc_type", "attribute", "doc_id").agg(
        *[
            F.bool_or(F.col("vtype") == kind).alias(kind.lower())
            for kind in ("STRING", "LONG", "DOUBLE", "BOOLEAN", "NULL", "NESTED")
        ]
    )
    totals = leaf.groupBy("doc_type").agg(F.count_distinct("doc_id").alias("n_type_docs"))
    flags = [F.bool_or(k).alias(k) for k in ("string", "long", "double", "boolean", "null", "nested")]
    per_attribute = per_doc.groupBy("doc_type", "attribute").agg(F.count("*").alias("n_docs"), *flags)
    names = F.array_compact(
        F.array(
            F.when(F.col("boolean"), "boolean"),
            F.when(F.col("long") & ~F.col("double"), "integer"),
            F.when(F.col("null"), "null"),
            F.when(F.col("double"), "number"),
            F.when(F.col("nested"), "object"),
            F.when(F.col("string"), "string"),
        )
    )
    return per_attribute.join(totals, "doc_type").select(
        "doc_type",
        "attribute",
        F.array_join(names, "|").alias("types"),
        "n_docs",
        (F.col("n_docs") == F.col("n_type_docs")).alias("required"),
    )


def categories(assignments: DataFrame) -> DataFrame:
    """Category of every type from the number of cases its documents belong to.

    `assignments`: doc_type, n_cases per document.
    """
    flags = assignments.groupBy("doc_type").agg(
        F.bool_and(F.col("n_cases") == 1).alias("_one"),
        F.bool_or(F.col("n_cases") > 1).alias("_many"),
        F.bool_and(F.col("n_cases") == 0).alias("_none"),
    )
    return flags.select(
        "doc_type",
        F.when(F.col("_one"), "process_instance")
        .when(F.col("_many"), "process_instance_independent")
        .when(F.col("_none"), "independent")
        .otherwise("mixed")
        .alias("category"),
    )


def object_types(schemas: DataFrame, structure: DataFrame, assignments: DataFrame) -> DataFrame:
    """doc_type, schema, n_docs, n_instances, category.  `structure`: doc_type, arrays_found."""
    instances = structure.groupBy("doc_type").agg(F.sum("arrays_found").alias("n_instances"))
    return schemas.join(instances, "doc_type", "left").join(categories(assignments), "doc_type", "left")


def case_assignments(documents: DataFrame, case_docs: DataFrame) -> DataFrame:
    """Number of cases per document (0 for unused documents): doc_id, doc_type, n_cases."""
    counts = (
        case_docs.select("doc_id", "case_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_cases"))
    )
    return (
        documents.select("doc_id", "doc_type")
        .join(counts, "doc_id", "left")
        .withColumn("n_cases", F.coalesce("n_cases", F.lit(0)))
    )


def layers(documents: DataFrame, n_cases, params: Params = DEFAULTS) -> DataFrame:
    """Process layer per type: reference, main (documents per case above the share) or exception.

    `documents`: cluster, is_reference.  `n_cases` is a column or a number.
    """
    total = n_cases if hasattr(n_cases, "alias") else F.lit(n_cases)
    per_type = documents.groupBy("cluster").agg(
        F.count("*").alias("n_docs"), F.bool_or("is_reference").alias("_ref")
    )
    return per_type.select(
        "cluster",
        "n_docs",
        F.when(F.col("_ref"), "reference")
        .when(F.col("n_docs") / total > params.main_layer_share, "main")
        .otherwise("exception")
        .alias("layer"),
    )
