"""Cases (process instances): members, composition, variants, statistics, repeat index."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.skew import hot_keys, lookup_join, number_rows
from docflow.session import cut_lineage


def case_documents(
    labels: DataFrame, documents: DataFrame, reference: DataFrame | None = None
) -> DataFrame:
    """Bridge table case_id, doc_id, cluster, is_shared, is_partial, entry_idx, final_ts.

    `labels`: node, component; `documents`: doc_id, cluster, final_ts; `reference`: the entries of
    reference documents claimed by cases.  A shared document keeps all its cases.
    """
    own = (
        labels.select(F.col("node").alias("doc_id"), F.col("component").alias("case_id"))
        .join(documents.select("doc_id", "cluster", "final_ts"), "doc_id")
        .select(
            "case_id",
            "doc_id",
            "cluster",
            F.lit(False).alias("is_shared"),
            F.lit(False).alias("is_partial"),
            F.lit(None).cast("int").alias("entry_idx"),
            "final_ts",
        )
    )
    if reference is None:
        return own
    joined = reference.select(
        "case_id",
        "doc_id",
        "cluster",
        F.lit(True).alias("is_shared"),
        F.col("entry_idx").isNotNull().alias("is_partial"),
        F.col("entry_idx").cast("int").alias("entry_idx"),
        F.lit(None).cast("timestamp").alias("final_ts"),
    )
    return own.unionByName(joined)


def composition(case_docs: DataFrame) -> DataFrame:
    """Documents per case and type, with and without shared ones."""
    return case_docs.groupBy("case_id", "cluster").agg(
        F.count("*").alias("n_docs"), F.count_if(~F.col("is_shared")).alias("n_own")
    )


def case_variants(counts: DataFrame) -> DataFrame:
    """Cases with the same composition form a variant: case_id, variant, variant_count.

    `counts`: case_id, cluster, n_own.  A variant is named by its composition text, which is as long as
    the number of document types, not of documents.
    """
    entry = F.concat(F.col("cluster").cast("string"), F.lit("="), F.col("n_own").cast("string"))
    per_case = (
        counts.where(F.col("n_own") > 0)
        .groupBy("case_id")
        .agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("variant"))
    )
    # Read twice, to count the cases of a variant and to name it in each.
    per_case = cut_lineage(per_case)
    sizes = per_case.groupBy("variant").agg(F.count("*").alias("variant_count"))
    return per_case.join(sizes, "variant").select("case_id", "variant", "variant_count")


def variant_sizes(counts: DataFrame) -> DataFrame:
    return case_variants(counts).groupBy("variant").agg(F.count("*").alias("variant_count"))


def case_stats(case_docs: DataFrame) -> DataFrame:
    """Totals, number of types, first and last time and range in whole days per case."""
    return case_docs.groupBy("case_id").agg(
        F.count("*").alias("n_docs"),
        F.count_distinct("cluster").alias("n_types"),
        F.min("final_ts").alias("earliest"),
        F.max("final_ts").alias("latest"),
        F.floor(
            (F.unix_micros(F.max("final_ts")) - F.unix_micros(F.min("final_ts"))) / F.lit(86_400_000_000)
        ).alias("range_days"),
    )


def repeat_index(case_docs: DataFrame, order: tuple = ("final_ts", "doc_id"), hot=None) -> DataFrame:
    """Number repeated types of a case by time: variant_id from 0, and the flags `has_variants` (more
    than one document of the type) and `multiple` (fewer different times than documents)."""
    by = ["case_id", "cluster"]
    hot = hot_keys(case_docs, by) if hot is None else hot
    numbered = number_rows(case_docs, by, list(order), "_no", hot)
    counts = case_docs.groupBy(*by).agg(
        F.count("*").alias("_n"), F.count_distinct("final_ts").alias("_times")
    )
    return (
        lookup_join(numbered, counts, by, hot=hot)
        .withColumn("variant_id", F.col("_no") - 1)
        .withColumn("has_variants", F.col("_n") > 1)
        .withColumn("multiple", F.col("_times") < F.col("_n"))
        .drop("_no", "_n", "_times")
    )


def similar_cases(case_docs: DataFrame) -> DataFrame:
    """Cases by the set of their document types: type_set, n_cases, first_case."""
    sets = (
        case_docs.select("case_id", "cluster")
        .distinct()
        .groupBy("case_id")
        .agg(F.array_join(F.array_sort(F.collect_list(F.col("cluster").cast("string"))), ",").alias("type_set"))
    )
    return sets.groupBy("type_set").agg(F.count("*").alias("n_cases"), F.min("case_id").alias("first_case"))


def shared_documents(case_docs: DataFrame) -> DataFrame:
    """Documents that belong to more than one case, with the number of cases."""
    return (
        case_docs.select("doc_id", "case_id")
        .distinct()
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_cases"))
        .where(F.col("n_cases") > 1)
    )
