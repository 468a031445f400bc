"""What decides the path of a case: flows, case features, decision trees, factors, pattern checks."""

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Params
from docflow.operators.eventlog import follows
from docflow.operators.skew import lookup_join, small_join

# Document types with their expected neighbours and required fields.
BUSINESS_PATTERNS = {
    "Bestellung": {
        "followed_by": ("Auftragsbestätigung", "Rechnung", "Lieferschein"),
        "follows": (),
        "max_days": 30,
        "required_fields": ("Bestellungsnummer", "Kundennummer"),
    },
    "Auftragsbestätigung": {
        "followed_by": ("Rechnung", "Lieferschein"),
        "follows": ("Bestellung",),
        "max_days": None,
        "required_fields": ("Auftragsnummer", "Bestellungsnummer"),
    },
    "Rechnung": {
        "followed_by": (),
        "follows": ("Auftragsbestätigung", "Lieferschein"),
        "max_days": None,
        "required_fields": ("Rechnungsnummer", "Bestellungsnummer"),
    },
    "Lieferschein": {
        "followed_by": ("Rechnung",),
        "follows": ("Auftragsbestätigung",),
        "max_days": None,
        "required_fields": ("Lieferadresse", "Bestellungsnummer"),
    },
}


def first_times(events: DataFrame, case: str, activity: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(case, activity).agg(F.min(ts).alias("first_ts"))


def verified_flows(
    events: DataFrame, paths: DataFrame, case: str = "case_id", activity: str = "activity", ts: str = "ts"
) -> DataFrame:
    """Cases that took a path: the first source document is earlier than the first target document.

    `paths`: place, transition, target.  Times are reduced to one row per case and type first, so the
    join inside a case is bounded by the number of types.
    """
    times = first_times(events, case, activity, ts)
    source = times.select(case, F.col(activity).alias("place"), F.col("first_ts").alias("source_ts"))
    target = times.select(case, F.col(activity).alias("target"), F.col("first_ts").alias("target_ts"))
    return (
        small_join(source, paths, ["place"])
        .join(target, [case, "target"])
        .where(F.col("target_ts") > F.col("source_ts"))
        .select(case, "place", "transition")
    )


def flow_frequency(flows: DataFrame) -> DataFrame:
    """Cases per place and transition with the share among the place's flows."""
    counts = flows.groupBy("place", "transition").agg(F.count("*").alias("n"))
    totals = counts.groupBy("place").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "place").select(
        "place", "transition", "n", (F.col("n") / F.col("_total")).alias("frequency")
    )


def number_features(numbers: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: statistics of all numbers, prices, quantities and weights.  `numbers`: category, num."""
    def of(kind: str):
        return F.when(F.col("category") == kind, F.col("num"))

    return numbers.groupBy(case).agg(
        F.max("num").alias("max_amount"),
        F.min("num").alias("min_amount"),
        F.avg("num").alias("avg_amount"),
        (F.max("num") - F.min("num")).alias("amount_range"),
        F.max(of("price")).alias("max_price"),
        F.min(of("price")).alias("min_price"),
        F.avg(of("price")).alias("avg_price"),
        F.sum(of("price")).alias("total_value"),
        F.sum(of("quantity")).alias("total_quantity"),
        F.max(of("quantity")).alias("max_quantity"),
        F.avg(of("quantity")).alias("avg_quantity"),
        F.sum(of("weight")).alias("total_weight"),
        F.avg(of("weight")).alias("avg_weight"),
    )


def time_features(
    events: DataFrame, case: str = "case_id", activity: str = "activity", ts: str = "ts"
) -> DataFrame:
    """Per case: first hour, weekday (Monday = 0), weekend, duration in hours, morning, evening, document
    and type counts."""
    agg = events.groupBy(case).agg(
        F.min(ts).cast("timestamp").alias("_first"),
        F.max(ts).cast("timestamp").alias("_last"),
        F.count("*").alias("total_documents"),
        F.count_distinct(activity).alias("unique_doc_types"),
    )
    day = F.weekday("_first")
    return agg.select(
        case,
        F.hour("_first").alias("hour"),
        day.alias("day_of_week"),
        (day >= 5).cast("int").alias("is_weekend"),
        ((F.unix_micros("_last") - F.unix_micros("_first")) / 3.6e9).alias("process_duration"),
        (F.hour("_first") < 12).cast("int").alias("morning_start"),
        (F.hour("_first") >= 18).cast("int").alias("evening_start"),
        "total_documents",
        "unique_doc_types",
    )


def follow_flags(
    events: DataFrame,
    pairs: list[tuple[str, str]],
    case: str = "case_id",
    activity: str = "activity",
    order: tuple = ("ts", "event_id"),
    hot=None,
) -> DataFrame:
    """Per case, 1 for every listed pair a -> b of consecutive documents: columns seq_a_to_b."""
    steps = follows(events, case, activity, order, hot=hot)
    flags = [
        F.max(F.when((F.col(activity) == a) & (F.col("next_activity") == b), 1).otherwise(0)).alias(
            f"seq_{a}_to_{b}"
        )
        for a, b in pairs
    ]
    return steps.groupBy(case).agg(*flags)


def activity_flags(evidence: DataFrame, names: list[str], case: str = "case_id") -> DataFrame:
    """Per case, 1 for every activity with an instance in it: columns has_at_name."""
    flags = [
        F.max(F.when(F.col("activity_id") == n, 1).otherwise(0)).alias(f"has_at_{n.replace(' ', '_').lower()}")
        for n in names
    ]
    return evidence.groupBy(case).agg(*flags)


def case_features(parts: list[DataFrame], case: str = "case_id") -> DataFrame:
    """Feature vector of every case from the parts above; a part without the case gives nulls."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, case, "full")
    return out


def prepare_features(features: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """Mean imputation and z-score (sample deviation); constant columns are left out.

    One aggregate over the data; its single row decides which columns stay and is used as literals.
    """
    stats = features.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    kept = []
    for i, c in enumerate(columns):
        mean, dev = stats[f"m{i}"], stats[f"s{i}"]
        if mean is None or not dev:
            continue
        kept.append(((F.coalesce(F.col(c).cast("double"), F.lit(mean)) - mean) / dev).alias(c))
    rest = [c for c in features.columns if c not in columns]
    return features.select(*rest, *kept)


def fit_rules(
    features: DataFrame, columns: list[str], label: str, params: Params = DEFAULTS, seed: int = 42
) -> tuple[object, DataFrame, str]:
    """Decision tree over case features: (model, importances, rule text).

    Classes are weighted to balance.  importances: feature, importance, sorted, above the cut.
    """
    counts = features.groupBy(label).agg(F.count("*").alias("_n"))
    weighted = small_join(features, counts, [label])
    n = features.count()
    classes = counts.count()
    weighted = weighted.withColumn("_weight", F.lit(float(n)) / (F.lit(float(classes)) * F.col("_n")))
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(weighted)
    assembled = VectorAssembler(inputCols=columns, outputCol="_features").transform(indexer.transform(weighted))
    tree = DecisionTreeClassifier(
        featuresCol="_features",
        labelCol="_label",
        weightCol="_weight",
        maxDepth=params.tree_depth,
        minInstancesPerNode=params.tree_min_rows,
        seed=seed,
    )
    model = tree.fit(assembled.select("_features", "_label", "_weight"))
    spark = features.sparkSession
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    importances = spark.createDataFrame(rows, "feature string, importance double")
    importances = importances.where(F.col("importance") > params.min_importance).orderBy(
        F.desc("importance"), "feature"
    )
    text = model.toDebugString
    for i, name in enumerate(columns):
        text = text.replace(f"feature {i} ", f"{name} ")
    return model, importances, text


def decision_factors(paths: DataFrame, attributes: DataFrame, case: str = "case_id") -> DataFrame:
    """Importance of attributes at a decision: path share x distinctness of the values, best path,
    divided by the largest.

    `paths`: case, path; `attributes`: case, attribute, value.  Value counts are exact and need no value
    list.
    """
    sizes = paths.groupBy("path").agg(F.count_distinct(case).alias("_cases"))
    total = paths.agg(F.count_distinct(case).alias("_all")).scalar()
    held = lookup_join(attributes, paths.distinct(), [case])
    per_value = held.groupBy("path", "attribute", "value").agg(F.count("*").alias("_n"))
    per_path = per_value.groupBy("path", "attribute").agg(
        (F.count("*") / F.sum("_n")).alias("_distinctness")
    )
    scored = (
        per_path.join(sizes, "path")
        .withColumn("_total", total)
        .groupBy("attribute")
        .agg(F.max(F.col("_cases") / F.col("_total") * F.col("_distinctness")).alias("factor"))
    )
    top = scored.agg(F.max("factor").alias("_top")).scalar()
    return scored.select("attribute", (F.col("factor") / top).alias("importance"))


def missing_neighbours(
    events: DataFrame,
    patterns: dict = BUSINESS_PATTERNS,
    case: str = "case_id",
    activity: str = "activity",
    ts: str = "ts",
    doc: str = "doc_id",
) -> DataFrame:
    """Documents whose case lacks every expected follower (in time) or predecessor: doc, activity, check.

    Only the last time of a follower type and the first time of a predecessor type in the case matter
    for "none at all"; with a limit in days the nearest follower is found through days, not pairs.
    """
    checks = []
    for name, rule in patterns.items():
        docs = events.where(F.col(activity) == name).select(case, doc, activity, ts)
        for kind in ("followed_by", "follows"):
            others = list(rule[kind])
            if not others:
                continue
            near = events.where(F.col(activity).isin(others))
            if kind == "followed_by" and rule["max_days"] is not None:
                ok = _within_days(docs, near, case, doc, ts, rule["max_days"])
                found = docs.join(ok, doc, "left_anti")
            else:
                edge = F.max(ts) if kind == "followed_by" else F.min(ts)
                bound = near.groupBy(case).agg(edge.alias("_edge"))
                good = F.col("_edge") >= F.col(ts) if kind == "followed_by" else F.col("_edge") <= F.col(ts)
                found = lookup_join(docs, bound, [case], "left").where(F.col("_edge").isNull() | ~good)
            checks.append(found.select(doc, activity, F.lit(f"{kind} missing").alias("check")))
    out = checks[0]
    for other in checks[1:]:
        out = out.unionByName(other)
    return out


def _within_days(docs: DataFrame, near: DataFrame, case: str, doc: str, ts: str, days: int) -> DataFrame:
    """Documents with a follower at most `days` later.

    Time is cut into buckets of `days`; a follower lies in the document's bucket or the next one, and of
    each bucket only the first time from the next bucket and, inside the same bucket, the nearest later
    time matter.  Both sides are reduced to distinct (case, time) rows first.
    """
    width = days * 86_400_000_000
    def micros(c: str):
        return F.unix_micros(F.col(c).cast("timestamp"))

    d = docs.select(case, doc, micros(ts).alias("_t")).withColumn("_b", F.floor(F.col("_t") / width))
    times = near.select(case, micros(ts).alias("_n")).distinct().withColumn("_b", F.floor(F.col("_n") / width))
    edges = times.groupBy(case, "_b").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    here = edges.select(case, "_b", F.col("_hi").alias("_last_here"))
    after = edges.select(case, (F.col("_b") - 1).alias("_b"), F.col("_lo").alias("_first_after"))
    around = here.join(after, [case, "_b"], "full")
    joined = lookup_join(d, around, [case, "_b"], "left")
    # Inside a bucket any later time is within `days`, so its last time decides; in the next bucket its
    # first time is the nearest one.
    ok = (F.col("_last_here") >= F.col("_t")) | (F.col("_first_after") - F.col("_t") <= width)
    return joined.where(ok).select(doc).distinct()


def missing_fields(leaf: DataFrame, patterns: dict = BUSINESS_PATTERNS, doc: str = "doc_id") -> DataFrame:
    """Required fields a document lacks: doc, doc_type, field.  `leaf` carries doc_type."""
    required = F.create_map(
        *[
            x
            for name, rule in patterns.items()
            for x in (F.lit(name), F.array(*[F.lit(f) for f in rule["required_fields"]]))
        ]
    )
    docs = leaf.select(doc, "doc_type").distinct()
    wanted = docs.select(doc, "doc_type", F.explode(required[F.col("doc_type")]).alias("field"))
    held = leaf.select(doc, F.col("key").alias("field")).distinct()
    return wanted.join(held, [doc, "field"], "left_anti")
