"""Numeric relations: derivations inside a case, correlations, grouped statistics."""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Params


def numeric_derivations(
    wide: DataFrame, sources: list[str], targets: list[str], params: Params = DEFAULTS, ids: tuple = ("case_id",)
) -> DataFrame:
    """Target values that are a sum of one to three source values or a product of two.

    `wide` has one row per case with one column per (type, field).  The candidates are combinations of
    columns, fixed by the schema, and are tested in one narrow pass.
    Result: ids, operation, source_fields, target_field, target_value.
    """
    tests = []
    for target in targets:
        for depth in range(1, params.max_terms + 1):
            for combo in combinations(sources, depth):
                options = [("sum", sum((F.col(c) for c in combo[1:]), F.col(combo[0])))]
                if depth == 2:
                    options.append(("product", F.col(combo[0]) * F.col(combo[1])))
                for name, value in options:
                    hit = F.abs(value - F.col(target)) < params.tolerance
                    tests.append(
                        F.when(
                            hit,
                            F.struct(
                                F.lit(name).alias("operation"),
                                F.lit(",".join(combo)).alias("source_fields"),
                                F.lit(target).alias("target_field"),
                                F.col(target).alias("target_value"),
                            ),
                        )
                    )
    return wide.select(*ids, F.explode(F.array_compact(F.array(*tests))).alias("_t")).select(*ids, "_t.*")


def derivation_counts(
    wide: DataFrame, sources: list[str], targets: list[str], params: Params = DEFAULTS
) -> DataFrame:
    """Number of cases per derivation."""
    found = numeric_derivations(wide, sources, targets, params)
    return found.groupBy("operation", "source_fields", "target_field").agg(F.count("*").alias("n_cases"))


def correlations(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair a < b, overall or per group: [by], a, b, r.

    All pairs come from one aggregate with map-side combine.
    """
    pairs = list(combinations(sorted(columns), 2))
    aggs = [F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    grouped = df.groupBy(*(by or [])).agg(*aggs)
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return grouped.select(*(by or []), F.inline(F.array(*cells)))


def correlation_relations(matrix: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Column pairs with a strong correlation as relations."""
    strong = F.abs("r") > params.strong_correlation
    kind = F.when(F.abs("r") > params.exact_correlation, "SAME_KEY_VALUE_PAIR").otherwise("SAME_VALUE")
    return matrix.where(strong).withColumn("rule_type", kind)


def correlation_values(df: DataFrame, relations: DataFrame, columns: list[str], ids: tuple = ("case_id",)) -> DataFrame:
    """The values behind correlation relations, one row per id and relation: ids, a, b, value_a, value_b."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*ids, F.inline(cells)).where(F.col("value").isNotNull())
    first = long.select(*ids, F.col("name").alias("a"), F.col("value").alias("value_a"))
    second = long.select(*ids, F.col("name").alias("b"), F.col("value").alias("value_b"))
    return first.join(relations.select("a", "b"), "a").join(second, [*ids, "b"])


def grouped_stats(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """sum, mean and sample deviation per group, rounded to two digits."""
    aggs = []
    for c in columns:
        aggs += [
            F.round(F.sum(c), 2).alias(f"{c}_sum"),
            F.round(F.avg(c), 2).alias(f"{c}_mean"),
            F.round(F.stddev_samp(c), 2).alias(f"{c}_std"),
        ]
    return df.groupBy(*by).agg(*aggs)
