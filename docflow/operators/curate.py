"""User edits as tables, and the tables shown to users."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.skew import small_join


def reassign(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Move documents to another cluster, optionally setting the reference flag.

    `labels`: doc_id, cluster, is_reference; `overrides`: doc_id, new_cluster, new_reference (null keeps).
    """
    return labels.join(overrides, "doc_id", "left").select(
        "doc_id",
        F.coalesce("new_cluster", "cluster").alias("cluster"),
        F.coalesce("new_reference", "is_reference").alias("is_reference"),
    )


def mark_reference_clusters(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mark whole clusters as reference data.  `clusters`: cluster."""
    marks = clusters.select("cluster").distinct().withColumn("_mark", F.lit(True))
    return small_join(labels, marks, ["cluster"], "left").select(
        *[c for c in labels.columns if c != "is_reference"],
        (F.col("is_reference") | F.coalesce("_mark", F.lit(False))).alias("is_reference"),
    )


def rename(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Rename types or activities.  `mapping`: old_name, new_name."""
    renamed = mapping.select(F.col("old_name").alias(column), "new_name")
    joined = small_join(df, renamed, [column], "left")
    return joined.withColumn(column, F.coalesce("new_name", column)).select(*df.columns)


# Fixed value: what a relation the user likes adds to its score.
USER_BONUS = 5.0


def user_scores(ids: DataFrame, chosen: DataFrame, column: str = "activity_id") -> DataFrame:
    """Score of every activity: the bonus for chosen ones, else 0."""
    marks = chosen.select(column).distinct().withColumn("score", F.lit(USER_BONUS))
    return ids.select(column).distinct().join(marks, column, "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def case_view(case_docs: DataFrame) -> DataFrame:
    """Cases with their members: one row per case and type with the documents' count, range of ids and
    times; the members themselves stay rows of `case_docs`."""
    return case_docs.groupBy("case_id", "cluster").agg(
        F.count("*").alias("n_docs"),
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        F.count_if("is_shared").alias("n_shared"),
    )


def type_view(types: DataFrame, attributes: DataFrame) -> DataFrame:
    """Types with their attributes as one text each (as long as the type's schema)."""
    texts = attributes.groupBy("doc_type").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.concat("attribute", F.lit(":"), "types"))), ", "
        ).alias("attributes")
    )
    return types.join(texts, "doc_type", "left")


def relation_view(judged: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with type names instead of cluster numbers.  `names`: cluster, doc_type."""
    one = names.select(F.col("cluster").alias("cluster_1"), F.col("doc_type").alias("type_1"))
    two = names.select(F.col("cluster").alias("cluster_2"), F.col("doc_type").alias("type_2"))
    return judged.join(one, "cluster_1", "left").join(two, "cluster_2", "left")


def cluster_view(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Files per cluster: cluster, doc_id, path."""
    return labels.select("doc_id", "cluster").join(documents.select("doc_id", "path"), "doc_id")
