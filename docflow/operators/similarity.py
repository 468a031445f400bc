"""Similarity of given record pairs: attributes, business keys, text, time."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Params
from docflow.operators.skew import hot_keys, lookup_join
from docflow.functions.values import KEY_TIERS, TIER_WEIGHTS, number_similarity, string_similarity

# Weights of the parts of a pair's similarity.
WEIGHTS = {"text": 0.30, "attributes": 0.30, "business_keys": 0.25, "temporal": 0.15}


def value_similarity(vtype_1: Column, v_1: Column, num_1: Column, vtype_2: Column, v_2: Column, num_2: Column) -> Column:
    numeric = vtype_1.isin("LONG", "DOUBLE", "BOOLEAN") & vtype_2.isin("LONG", "DOUBLE", "BOOLEAN")
    text = (vtype_1 == "STRING") & (vtype_2 == "STRING")
    either_empty = (F.length(v_1) == 0) | (F.length(v_2) == 0)
    return (
        F.when(numeric, number_similarity(num_1, num_2))
        .when(text & either_empty, F.lit(0.0))
        .when(text, string_similarity(v_1, v_2))
        .when((vtype_1 == "NULL") & (vtype_2 == "NULL"), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def _meet(pairs: DataFrame, one: DataFrame, two: DataFrame, *keys: str) -> DataFrame:
    """Pairs with the rows of both documents, those of equal `keys`.

    Documents in very many pairs are looked for among the pairs, so that no join runs for that alone; only where there
    are any, and `keys`, the joined rows are searched.
    """
    given = pairs.select("doc_1", "doc_2")
    hot = hot_keys(given, ["doc_2"])
    first = lookup_join(given, one, ["doc_1"])
    return lookup_join(first, two, ["doc_2", *keys], hot=None if hot and keys else hot)


def attribute_similarity(pairs: DataFrame, leaf: DataFrame) -> DataFrame:
    """Mean similarity over common attributes: doc_1, doc_2, n_common, attributes.

    `pairs`: doc_1, doc_2 (given, not generated here); `leaf`: doc_id, key, value, vtype, num with one
    row per document and key.  The leaves of a document travel to its pairs; documents are never crossed.
    """
    def side(n: str) -> DataFrame:
        return leaf.select(
            F.col("doc_id").alias(f"doc_{n}"), "key", *[F.col(c).alias(f"{c}_{n}") for c in ("value", "vtype", "num")]
        )

    met = _meet(pairs, side("1"), side("2"), "key")
    score = value_similarity(*[F.col(c) for c in ("vtype_1", "value_1", "num_1", "vtype_2", "value_2", "num_2")])
    return met.groupBy("doc_1", "doc_2").agg(F.count("*").alias("n_common"), F.avg(score).alias("attributes"))


def business_key_similarity(pairs: DataFrame, leaf: DataFrame, tiers: dict = KEY_TIERS, weights: dict = TIER_WEIGHTS) -> DataFrame:
    """Weight of the business keys with equal, non-empty values over the weight of all business keys."""
    weight = {key: weights[tier] for tier, keys in tiers.items() for key in keys}
    total = float(sum(weight.values()))
    mapping = F.create_map(*[F.lit(x) for kv in weight.items() for x in kv])
    keyed = leaf.where(F.col("key").isin(*weight)).where(~F.col("norm").isin("z", "s:", "n:0"))

    def side(n: str) -> DataFrame:
        return keyed.select(F.col("doc_id").alias(f"doc_{n}"), "key", F.col("norm").alias(f"norm_{n}"))

    met = _meet(pairs, side("1"), side("2"), "key")
    return (
        met.where(F.col("norm_1") == F.col("norm_2"))
        .select("doc_1", "doc_2", "key")
        .distinct()
        .groupBy("doc_1", "doc_2")
        .agg((F.sum(mapping[F.col("key")]) / total).alias("business_keys"))
    )


def token_similarity(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Jaccard of the word sets of both texts.  `texts`: doc_id, tokens (array of words)."""
    one = texts.select(F.col("doc_id").alias("doc_1"), F.array_distinct("tokens").alias("_t1"))
    two = texts.select(F.col("doc_id").alias("doc_2"), F.array_distinct("tokens").alias("_t2"))
    union = F.size(F.array_union("_t1", "_t2"))
    jaccard = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("_t1", "_t2")) / union)
    met = _meet(pairs, one, two)
    return met.select("doc_1", "doc_2", jaccard.alias("text"))


def temporal_similarity(pairs: DataFrame, times: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """exp(-days apart / pattern length).  `times`: doc_id, final_ts."""
    one = times.select(F.col("doc_id").alias("doc_1"), F.col("final_ts").alias("_a"))
    two = times.select(F.col("doc_id").alias("doc_2"), F.col("final_ts").alias("_b"))
    days = F.abs(F.unix_micros(F.col("_a").cast("timestamp")) - F.unix_micros(F.col("_b").cast("timestamp"))) / 8.64e10
    met = _meet(pairs, one, two)
    return met.select("doc_1", "doc_2", F.exp(-days / params.max_pattern_days).alias("temporal"))


def document_similarity(pairs: DataFrame, parts: dict[str, DataFrame], weights: dict = WEIGHTS) -> DataFrame:
    """Weighted sum of the parts present (a missing part of a pair counts 0)."""
    out = pairs.select("doc_1", "doc_2").distinct()
    total = F.lit(0.0)
    for name, part in parts.items():
        out = out.join(part.select("doc_1", "doc_2", name), ["doc_1", "doc_2"], "left")
        total = total + weights[name] * F.coalesce(F.col(name), F.lit(0.0))
    return out.withColumn("similarity", total)
