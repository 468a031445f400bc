"""Relations between object types: rule occurrences per case, significance, pruning, minimal cover."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Params
from docflow.operators.pairs import rule_of
from docflow.operators.skew import dealt_by, hot_and_rows, hot_keys, lookup_join, running_sum, small_join
from docflow.session import cut_lineage

PAIR = ["cluster_1", "variant_1", "cluster_2", "variant_2"]
RULE = ["rule_type", "key_lo", "key_hi"]


def relation_instances(case_leaf: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Rule occurrences: case_id, PAIR, RULE, w_1 (-1 when object 1 is the input, else 1), and of either side the
    key, the first time and the least document; evidence_documents gives all documents behind them.

    `case_leaf`: case_id, cluster, variant_id, doc_id, key, norm, final_ts, is_shared.  An object is a
    (cluster, variant); pass variant_id 0 throughout to compare types instead of numbered documents.
    Values of a case are first reduced to one row per object, key and value, so the join inside a case
    meets at most (objects x keys) rows per value however many documents the case holds.

    Direction: reference data is input; between case documents the earlier one; within a type the lower
    variant.
    """
    # Dealt by case once, for the cells and for their pairs: rows of a case lie side by side and so take little room.  A
    # hot case is dealt by value, and a hot value is combined before it moves.
    case_leaf = case_leaf.where(F.col("case_id").isNotNull() & F.col("norm").isNotNull())
    hot, n = hot_and_rows(case_leaf, ["case_id"], min_rows)
    if not hot:
        case_leaf = dealt_by(case_leaf, ["case_id"], n)
    elif not hot_keys(case_leaf, ["case_id", "norm"], min_rows):
        case_leaf = dealt_by(case_leaf, ["case_id", "norm"], n)
    # A hash leads the sort order: it tells most rows apart without a look at them.
    case_leaf = case_leaf.withColumn("_h", F.xxhash64("case_id"))
    cells = case_leaf.groupBy("_h", "case_id", "norm", "cluster", "variant_id", "key").agg(
        F.min("final_ts").alias("ts"),
        F.bool_or("is_shared").alias("shared"),
        F.min("doc_id").alias("doc"),
    )
    cols = ["cluster", "variant_id", "key", "ts", "shared", "doc"]

    # In one pass over the sorted cells each meets those before it.  The list held is as long as a value's cells, of
    # which the result has all pairs.
    names = {n: [f"{c.replace('_id', '')}_{n}" for c in cols] for n in ("1", "2")}
    before = Window.partitionBy("_h", "case_id", "norm").orderBy("cluster", "variant_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    cell = F.struct(*[F.col(c).alias(name) for c, name in zip(cols, names["1"], strict=True)])
    two = [F.col(c).alias(name) for c, name in zip(cols, names["2"], strict=True)]
    met = cells.withColumn("_before", F.collect_list(cell).over(before)).select("case_id", "norm", *two, F.inline("_before"))
    met = met.where(F.struct("cluster_1", "variant_1") < F.struct("cluster_2", "variant_2"))
    both_own = ~F.col("shared_1") & ~F.col("shared_2")
    weight = (
        F.when(both_own & (F.col("cluster_1") == F.col("cluster_2")), F.lit(-1))
        .when(both_own & (F.col("ts_1") < F.col("ts_2")), F.lit(-1))
        .when(both_own, F.lit(1))
        .when(F.col("shared_1") & ~F.col("shared_2"), F.lit(-1))
        .when(F.col("shared_2") & ~F.col("shared_1"), F.lit(1))
        .otherwise(F.lit(0))
    )
    return met.select(
        "case_id",
        *PAIR,
        rule_of(F.col("key_1"), F.col("key_2"), F.col("norm")).alias("rule_type"),
        F.least("key_1", "key_2").alias("key_lo"),
        F.greatest("key_1", "key_2").alias("key_hi"),
        weight.alias("w_1"),
        "key_1",
        "key_2",
        "ts_1",
        "ts_2",
        "doc_1",
        "doc_2",
        "norm",
    )


def evidence_documents(
    instances: DataFrame, case_leaf: DataFrame, carry: list[str] | None = None, min_rows: int | None = None
) -> DataFrame:
    """All documents behind rule occurrences: `carry`, PAIR, RULE, case_id, norm, side, cluster, variant, key, doc, ts.

    An occurrence stands for every document of its first cell with every one of its second: (case, value, type,
    variant, key) on either side.  Instead of these pairs each side lists its own documents, so the result grows with the
    documents and not with their square; pairs of one occurrence are the combinations of its two sides.

    `case_leaf` as in relation_instances; `instances` may be any part of its result (accepted rules, activities), with
    further columns named in `carry`.  A document that holds a value twice is listed once.  A cell meets as many rows as
    there are rules on it, which the types bound; a cell of very many documents is dealt out.
    """
    kept = [*(carry or []), *PAIR, *RULE, "case_id", "norm"]
    cell = ["case_id", "norm", "cluster", "variant", "key"]
    ends = F.inline(F.array(*[F.struct(F.lit(n).alias("side"), *[F.col(f"{c}_{n}").alias(c) for c in cell[2:]]) for n in (1, 2)]))
    leaf = case_leaf.withColumnsRenamed({"variant_id": "variant", "doc_id": "doc"}).select(*cell, "doc", "final_ts")
    leaf = leaf.where(F.col("case_id").isNotNull() & F.col("norm").isNotNull())
    # Leaves of other types and keys than the occurrences have take no part.
    leaf = small_join(leaf, instances.select(ends).select(*cell[2:]).distinct(), cell[2:], "left_semi")
    # Hot cases are looked for among the leaves, before anything moves.  Without any, occurrences and leaves are dealt by
    # case once and meet by cell, so an occurrence moves once for its two sides.
    hot, n = hot_and_rows(leaf, ["case_id"], min_rows)
    if hot:
        occurrences = instances.select(*kept, ends).distinct()
        members = leaf.groupBy(*cell, "doc").agg(F.min("final_ts").alias("ts"))
        out = lookup_join(members, occurrences, cell, min_rows=min_rows)
        return out.select(*kept, "side", "cluster", "variant", "key", "doc", "ts")
    own = [c for c in kept if c not in cell]
    keys = ["key_1", "key_2"]
    kinds = {f.name: f.dataType for f in instances.schema.fields}
    # A document's first time with a date comes first, then its leaves without one.
    place = F.struct("doc", F.col("final_ts").isNull().alias("undated"), "final_ts")
    leaf = leaf.select("case_id", "norm", *[F.lit(None).cast(kinds[c]).alias(c) for c in [*own, *keys]], "cluster", "variant", "key", place.alias("_doc"))
    given = instances.select("case_id", "norm", *own, *keys, *[F.lit(None).cast(t).alias(c) for c, t in leaf.dtypes if c in [*cell[2:], "_doc"]])
    met = dealt_by(given.unionByName(leaf), ["case_id"], 2 * n)
    one_two = [F.struct(F.lit(k).alias("side"), *[F.col(f"{c}_{k}").alias(c) for c in cell[2:]]) for k in (1, 2)]
    itself = F.struct(F.lit(0).alias("side"), *cell[2:])
    placed = met.select("case_id", "norm", *own, "_doc", F.inline(F.when(F.col("_doc").isNull(), F.array(*one_two)).otherwise(F.array(itself))))
    occurrence = F.struct("side", *own)
    cells = placed.groupBy(*cell).agg(
        F.collect_set(F.when(F.col("_doc").isNull(), occurrence)).alias("_on"), F.array_sort(F.collect_set("_doc")).alias("_docs")
    )
    first = F.filter("_docs", lambda d, i: (i == 0) | ~d["doc"].eqNullSafe(F.get("_docs", i - 1)["doc"]))
    cells = cells.where(F.size("_on") > 0).select(*cell, "_on", first.alias("_docs"))
    out = cells.select(*cell, "_on", F.explode("_docs").alias("_doc"))
    out = out.select(*cell, F.col("_doc.doc").alias("doc"), F.col("_doc.final_ts").alias("ts"), F.inline("_on"))
    return out.select(*kept, "side", "cluster", "variant", "key", "doc", "ts")


def document_directions(evidence: DataFrame) -> DataFrame:
    """Over all document pairs of two sides: PAIR, n_pairs, n_before (first side earlier), n_after, weight.

    `evidence`: evidence_documents.  Weight is the mean over the pairs of -1 where the first document is earlier and 1
    otherwise, as for single documents; within a type the lower variant counts as earlier.  Pairs are counted, not
    listed: in order of time every document of the second side adds the number of first-side documents before it.
    Documents without a time take no part.
    """
    occurrence = [*PAIR, *RULE, "case_id", "norm"]
    timed = evidence.where(F.col("ts").isNotNull())
    per_time = timed.groupBy(*occurrence, "ts").agg(
        F.count(F.when(F.col("side") == 1, 1)).alias("_one"), F.count(F.when(F.col("side") == 2, 1)).alias("_two")
    )
    # Read twice, to find hot occurrences and to sum.
    per_time = cut_lineage(per_time)
    before = running_sum(per_time, occurrence, ["ts"], "_one", "_earlier")
    per_case = before.groupBy(*occurrence).agg(
        F.sum(F.col("_earlier") * F.col("_two")).alias("_b"), (F.sum("_one") * F.sum("_two")).alias("_n")
    )
    first = F.when(F.col("cluster_1") == F.col("cluster_2"), F.col("_n")).otherwise(F.col("_b"))
    totals = per_case.groupBy(*PAIR).agg(F.sum("_n").alias("n_pairs"), F.sum(first).alias("n_before"))
    after = F.col("n_pairs") - F.col("n_before")
    return totals.where(F.col("n_pairs") > 0).select(
        *PAIR, "n_pairs", "n_before", after.alias("n_after"), ((after - F.col("n_before")) / F.col("n_pairs")).alias("weight")
    )


def relation_counts(instances: DataFrame, variants: DataFrame) -> DataFrame:
    """Cases per pair and rule, and the expected number: the cases of all variants in which it occurs.

    `variants`: case_id, variant, variant_count.
    """
    # Dealt by case once, to tell the cases apart and to join.
    per_case = instances.select(*PAIR, *RULE, "case_id").repartition("case_id").distinct()
    per_variant = (
        per_case.join(variants, "case_id")
        .groupBy(*PAIR, *RULE, "variant")
        .agg(F.count("*").alias("_n"), F.max("variant_count").alias("_v"))
    )
    return per_variant.groupBy(*PAIR, *RULE).agg(
        F.sum("_n").alias("n_cases"), F.sum("_v").alias("n_expected")
    )


def judge_relations(counts: DataFrame, types: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Every pair and rule with `accepted` and the `reason` of a rejection.

    Order of the tests: a rule that shares a key with a stronger one of the same pair loses (fewer
    cases; on a tie the weaker rule type); then a rule well below the pair's best; then significance.
    `types`: cluster, n_instances, any_reference.
    """
    strength = (
        F.when(F.col("rule_type") == "SAME_KEY_VALUE_PAIR", 3)
        .when(F.col("rule_type") == "SAME_VALUE", 2)
        .otherwise(1)
    )
    ranked = counts.withColumn("_s", strength)
    keyed = ranked.withColumn("_key", F.explode(F.array_distinct(F.array("key_lo", "key_hi"))))
    best = Window.partitionBy(*PAIR, "_key")
    keyed = keyed.withColumn("_best", F.max(F.struct("n_cases", "_s")).over(best))
    lost = F.struct("n_cases", "_s") < F.col("_best")
    per_rule = keyed.groupBy(*PAIR, *RULE, "n_cases", "n_expected").agg(F.bool_or(lost).alias("_lost"))
    survivors = Window.partitionBy(*PAIR)
    top = F.max(F.when(~F.col("_lost"), F.col("n_cases"))).over(survivors)
    one = types.select(
        F.col("cluster").alias("cluster_1"), F.col("n_instances").alias("_i1"), F.col("any_reference").alias("_r1")
    )
    two = types.select(
        F.col("cluster").alias("cluster_2"), F.col("n_instances").alias("_i2"), F.col("any_reference").alias("_r2")
    )
    share = F.when(
        F.col("rule_type") == "SAME_COMMON_VALUE", F.lit(params.same_common_value_threshold)
    ).otherwise(F.lit(params.same_value_threshold))
    significant = (
        (F.col("n_cases") > share * F.col("n_expected"))
        | (~F.col("_r1") & (F.col("n_cases") > params.significant_instance_threshold * F.col("_i1")))
        | (~F.col("_r2") & (F.col("n_cases") > params.significant_instance_threshold * F.col("_i2")))
    )
    reason = (
        F.when(F.col("_lost"), "weaker rule on the same key")
        .when(
            F.col("n_cases") < params.rule_significance_threshold * F.col("_top"),
            "well below the best rule",
        )
        .when(~significant, "not significant")
    )
    return (
        per_rule.withColumn("_top", top)
        .join(one, "cluster_1")
        .join(two, "cluster_2")
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .select(*PAIR, *RULE, "n_cases", "n_expected", "accepted", "reason")
    )


def relation_objects(instances: DataFrame, accepted: DataFrame) -> DataFrame:
    """Mean direction of both objects of every accepted pair: PAIR, cluster, variant, weight."""
    kept = small_join(instances, accepted.select(*PAIR, *RULE).distinct(), [*PAIR, *RULE], "left_semi")
    mean = kept.groupBy(*PAIR).agg(F.avg("w_1").alias("_w"))
    first = mean.select(
        *PAIR, F.col("cluster_1").alias("cluster"), F.col("variant_1").alias("variant"), F.col("_w").alias("weight")
    )
    second = mean.select(
        *PAIR, F.col("cluster_2").alias("cluster"), F.col("variant_2").alias("variant"), (-F.col("_w")).alias("weight")
    )
    return first.unionByName(second)


def set_overlap(left: DataFrame, group: list[str], item: str) -> DataFrame:
    """Jaccard of the item sets of two groups that share an item: group_1, group_2, n_1, n_2, n_both,
    jaccard.

    `left` has one row per (group, item).  The groups are rules or activities, so an item (a document or
    a case) meets at most (number of groups) rows.
    """
    rows = left.select(*group, item).distinct()
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    one = rows.select(item, *[F.col(g).alias(g + "_1") for g in group])
    two = rows.select(item, *[F.col(g).alias(g + "_2") for g in group])
    ids1, ids2 = [g + "_1" for g in group], [g + "_2" for g in group]
    both = (
        one.join(two, item)
        .where(F.struct(*ids1) < F.struct(*ids2))
        .groupBy(*ids1, *ids2)
        .agg(F.count("*").alias("n_both"))
    )
    s1 = sizes.select(*[F.col(g).alias(g + "_1") for g in group], F.col("n").alias("n_1"))
    s2 = sizes.select(*[F.col(g).alias(g + "_2") for g in group], F.col("n").alias("n_2"))
    return (
        both.join(s1, ids1)
        .join(s2, ids2)
        .withColumn("jaccard", F.col("n_both") / (F.col("n_1") + F.col("n_2") - F.col("n_both")))
    )


def minimal_relations(relations: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Smallest covering choice: strongest type pairs first, keeping attribute pairs that bring an
    attribute not yet covered on either side.

    `relations`: obj1, obj2, attr1, attr2; `weights`: attr, weight (missing = 1).  All attribute pairs
    of one type pair are judged against what came before that pair, hence rank() with the pair as unit.
    """
    if weights is not None:
        w1 = weights.select(F.col("attr").alias("attr1"), F.col("weight").alias("_w1"))
        w2 = weights.select(F.col("attr").alias("attr2"), F.col("weight").alias("_w2"))
        relations = relations.join(w1, "attr1", "left").join(w2, "attr2", "left")
    else:
        relations = relations.withColumn("_w1", F.lit(1.0)).withColumn("_w2", F.lit(1.0))
    pair = F.coalesce("_w1", F.lit(1.0)) + F.coalesce("_w2", F.lit(1.0))
    per_edge = relations.groupBy("obj1", "obj2").agg(F.sum(pair).alias("edge_weight"))
    scored = relations.drop("_w1", "_w2").join(per_edge, ["obj1", "obj2"])
    order = [F.desc("edge_weight"), F.asc("obj1"), F.asc("obj2")]
    one = Window.partitionBy("obj1", "attr1").orderBy(*order)
    two = Window.partitionBy("obj2", "attr2").orderBy(*order)
    first = (F.rank().over(one) == 1) | (F.rank().over(two) == 1)
    return scored.withColumn("_keep", first).where("_keep").drop("_keep")
