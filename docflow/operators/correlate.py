"""Which keys correlate documents: correlators, their corroboration, key classes, links."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Params
from docflow.operators.pairs import SIDES, common_norm, cross_pair_counts
from docflow.operators.skew import hot_keys, lookup_join, salted_join, small_join
from docflow.session import cut_lineage

VALUE_RULES = ("SAME_KEY_VALUE_PAIR", "SAME_VALUE")


def type_instances(structure: DataFrame) -> DataFrame:
    """Instances per type and whether all / any of its documents are reference data.

    `structure`: doc_id, cluster, is_reference, arrays_found.
    """
    return structure.groupBy("cluster").agg(
        F.sum("arrays_found").alias("n_instances"),
        F.count("*").alias("n_docs"),
        F.bool_and("is_reference").alias("all_reference"),
        F.bool_or("is_reference").alias("any_reference"),
    )


def frequent_rules(rules: DataFrame, types: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Rules found in at least key_frequency of the smaller type's instances, with `kind`:
    `independent` when one side is reference data, else `key` or `synonym`."""
    side1 = types.select(
        F.col("cluster").alias("cluster_1"), F.col("n_instances").alias("_i1"), F.col("all_reference").alias("_r1")
    )
    side2 = types.select(
        F.col("cluster").alias("cluster_2"), F.col("n_instances").alias("_i2"), F.col("all_reference").alias("_r2")
    )
    kind = (
        F.when(F.col("_r1") | F.col("_r2"), "independent")
        .when(F.col("rule_type") == "SAME_KEY_VALUE_PAIR", "key")
        .otherwise("synonym")
    )
    return (
        rules.where(F.col("rule_type").isin(*VALUE_RULES))
        .join(side1, "cluster_1")
        .join(side2, "cluster_2")
        .where(F.col("n") >= params.key_frequency * F.least("_i1", "_i2"))
        .select(*SIDES, "rule_type", "n", kind.alias("kind"))
    )


def rule_overlap(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Jaccard of the document pairs behind two rules of the same type pair.

    A pair obeys both rules when it shares a combined value (value of rule a, value of rule b), so the
    intersection is counted like any rule, on combined values.  Result: cluster_1, cluster_2, the keys
    and rule types of both rules, n_a, n_b, n_both, jaccard.
    """
    named = rules.where(F.col("rule_type").isin(*VALUE_RULES)).select(*SIDES, "rule_type", "n")
    mode = F.when(F.col("rule_type") == "SAME_VALUE", "v:").otherwise("k:")
    named = named.withColumn("_f1", F.concat(mode, "key_1")).withColumn("_f2", F.concat(mode, "key_2"))
    # A table over keys, used six times below: computed once.  Rules are numbered, and each has a bit of a mask.
    named = named.withColumn("_rule", F.row_number().over(Window.orderBy(*SIDES, "rule_type")))
    named = cut_lineage(named)
    cols = ["key_1", "key_2", "rule_type", "n", "_rule"]
    rule_a = named.select("cluster_1", "cluster_2", *[F.col(c).alias(c + "_a") for c in cols])
    rule_b = named.select("cluster_1", "cluster_2", *[F.col(c).alias(c + "_b") for c in cols])
    order_a = F.struct("key_1_a", "key_2_a", "rule_type_a")
    order_b = F.struct("key_1_b", "key_2_b", "rule_type_b")
    both = rule_a.join(rule_b, ["cluster_1", "cluster_2"]).where(order_a < order_b)
    pair_id = lambda a, b: F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
    both = both.withColumn("_pair", pair_id("_rule_a", "_rule_b"))

    # Only values that both sides of a rule hold can be shared, so the others go before values are combined.
    sides = [
        named.select(F.xxhash64("cluster_1", "cluster_2").alias("_scope"), "_rule", F.lit(n).alias("_side"), F.col(f"cluster_{n}").alias("cluster"), F.col(f"_f{n}").alias("_f"))
        for n in (1, 2)
    ]
    moded = rows.withColumn("_f", F.concat(F.lit("k:"), "key")).unionByName(
        rows.where(~common_norm(F.col("norm"))).withColumn("_f", F.concat(F.lit("v:"), "key"))
    )
    moded = moded.withColumn("_v", F.coalesce("norm", F.lit("")))
    held = small_join(moded, sides[0].union(sides[1]).distinct(), ["cluster", "_f"])
    held = held.select("doc_id", "cluster", "_scope", "_rule", "_side", "_v")
    met = held.groupBy("_rule", "_v").agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    held = lookup_join(held, met.where(F.col("_lo") < F.col("_hi")).select("_rule", "_v"), ["_rule", "_v"], "left_semi")
    # A combined value is shared only where either of its values is held on both sides by documents that also hold the
    # other rule, so a value is told the rules (of a mask, where rules beyond 63 share bits) that it can combine with.
    bit = lambda rule: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(rule) % 63)
    held = held.withColumn("_all", F.bit_or(bit("_rule")).over(Window.partitionBy("doc_id", "cluster", "_scope")))
    held = cut_lineage(held)
    ends = [F.bit_or(F.when(F.col("_side") == n, F.col("_all"))) for n in (1, 2)]
    reach = held.groupBy("_rule", "_v").agg(ends[0].bitwiseAND(ends[1]).alias("_may"))
    held = lookup_join(held, reach, ["_rule", "_v"])
    held = held.withColumn("_may", F.col("_may").bitwiseAND(F.col("_all"))).where(F.col("_may") != 0)
    held = cut_lineage(held.select("doc_id", "cluster", "_scope", "_rule", "_v", "_may"))
    left, right = (held.withColumnsRenamed({c: c + n for c in ("_rule", "_v", "_may")}) for n in ("_a", "_b"))
    can_meet = (F.col("_may_a").bitwiseAND(bit("_rule_b")) != 0) & (F.col("_may_b").bitwiseAND(bit("_rule_a")) != 0)
    # Both sides of a pair combine their values in the same order of the two rules.
    combined = (
        left.join(right, ["doc_id", "cluster", "_scope"])
        .where((F.col("_rule_a") < F.col("_rule_b")) & can_meet)
        .withColumn("_pair", pair_id("_rule_a", "_rule_b"))
        .select(
            "doc_id",
            "cluster",
            F.col("_pair").alias("key"),
            F.concat_ws("\u0001", "_pair", "_v_a", "_v_b").alias("norm"),
        )
    )
    # Combined values held on one side only belong to no pair; most of them end here.
    combined = cut_lineage(combined)
    shared = (
        combined.groupBy("norm")
        .agg(F.min("cluster").alias("_lo"), F.max("cluster").alias("_hi"))
        .where(F.col("_lo") < F.col("_hi"))
        .select("norm")
    )
    combined = lookup_join(combined, shared, ["norm"], "left_semi")
    inter = cross_pair_counts(combined).select(F.col("key_1").alias("_pair"), F.col("n").alias("n_both"))
    joined = both.join(inter, "_pair", "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    return joined.select(
        "cluster_1",
        "cluster_2",
        "key_1_a",
        "key_2_a",
        "rule_type_a",
        "key_1_b",
        "key_2_b",
        "rule_type_b",
        F.col("n_a"),
        F.col("n_b"),
        "n_both",
        (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard"),
    )


def corroborated(overlap: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Rules that share more than half of their pairs with another rule: SIDES, rule_type."""
    good = overlap.where(F.col("jaccard") > params.corroboration)
    first = good.select(
        "cluster_1", F.col("key_1_a").alias("key_1"), "cluster_2", F.col("key_2_a").alias("key_2"),
        F.col("rule_type_a").alias("rule_type"),
    )
    second = good.select(
        "cluster_1", F.col("key_1_b").alias("key_1"), "cluster_2", F.col("key_2_b").alias("key_2"),
        F.col("rule_type_b").alias("rule_type"),
    )
    return first.union(second).distinct()


def drop_reference_keys(correlators: DataFrame, reference_keys: DataFrame) -> DataFrame:
    """Leave out key correlators and synonyms whose key is one of reference data and links both types to
    reference data already.  `reference_keys`: key."""
    independent = correlators.where(F.col("kind") == "independent")
    touch = (
        independent.select("cluster_1", "cluster_2", F.explode(F.array("key_1", "key_2")).alias("key"))
        .select("key", F.explode(F.array("cluster_1", "cluster_2")).alias("cluster"))
        .distinct()
        .join(reference_keys.select("key").distinct(), "key", "left_semi")
    )
    normal = correlators.where(F.col("kind") != "independent")
    keys = normal.select(*SIDES, "rule_type", F.explode(F.array("key_1", "key_2")).alias("key"))
    hit = keys.join(
        touch.select("key", F.col("cluster").alias("cluster_1")), ["key", "cluster_1"], "left_semi"
    ).join(touch.select("key", F.col("cluster").alias("cluster_2")), ["key", "cluster_2"], "left_semi")
    kept = normal.join(hit.select(*SIDES, "rule_type").distinct(), [*SIDES, "rule_type"], "left_anti")
    return kept.unionByName(independent)


def correlators(
    rows: DataFrame,
    rules: DataFrame,
    types: DataFrame,
    reference_keys: DataFrame | None = None,
    require_corroboration: bool = True,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Accepted correlators: SIDES, rule_type, n, kind."""
    found = frequent_rules(rules, types, params)
    if reference_keys is not None:
        found = drop_reference_keys(found, reference_keys)
    if require_corroboration:
        good = corroborated(rule_overlap(rows, rules), params)
        kept = found.where(F.col("kind") != "independent").join(good, [*SIDES, "rule_type"], "left_semi")
        found = kept.unionByName(found.where(F.col("kind") == "independent"))
    return found


def transitive(correlators: DataFrame) -> DataFrame:
    """Type pairs linked to a common type by the same key pair: center, type_1 < type_2, keys."""
    keys = correlators.select(
        "cluster_1", "cluster_2", F.least("key_1", "key_2").alias("key_lo"), F.greatest("key_1", "key_2").alias("key_hi")
    )
    ends = keys.select(
        F.col("cluster_1").alias("center"), F.col("cluster_2").alias("other"), "key_lo", "key_hi"
    ).union(keys.select("cluster_2", "cluster_1", "key_lo", "key_hi")).distinct()
    a = ends.withColumnRenamed("other", "type_1")
    b = ends.withColumnRenamed("other", "type_2")
    return a.join(b, ["center", "key_lo", "key_hi"]).where(F.col("type_1") < F.col("type_2"))


def key_classes(rows: DataFrame, n_docs: int | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Keys by coverage and mean pairwise value overlap of the documents that hold them.

    The overlap of two documents is |common values| / |smaller value set|.  Its sum over all pairs is a
    sum over values, and a value's part needs only the number of documents per set size, so documents
    are never paired.
    """
    # A document's values under one key came out of one row, so this window stays small.
    own = Window.partitionBy("key", "doc_id")
    per_size = (
        rows.select("key", "doc_id", "norm")
        .withColumn("size", F.count("*").over(own))
        .groupBy("key", "norm", "size")
        .agg(F.count("*").alias("c"))
    )
    if n_docs is None:
        n_all = rows.agg(F.count_distinct("doc_id").alias("n_all")).scalar()
    else:
        n_all = F.lit(n_docs)
    larger = (
        Window.partitionBy("key", "norm").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    )
    part = (F.col("c") * F.coalesce(F.sum("c").over(larger), F.lit(0)) + F.col("c") * (F.col("c") - 1) / 2) / F.col(
        "size"
    )
    # Every document of a given size stands in exactly that many rows, which counts the documents.
    shared = (
        per_size.withColumn("_part", part)
        .groupBy("key", "size")
        .agg(F.sum("_part").alias("_part"), F.sum("c").alias("_rows"))
        .groupBy("key")
        .agg(F.sum("_part").alias("_sum"), F.sum((F.col("_rows") / F.col("size")).cast("long")).alias("n_docs"))
    )
    pairs = F.col("n_docs") * (F.col("n_docs") - 1) / 2
    overlap = F.when(pairs > 0, F.col("_sum") / pairs).otherwise(F.lit(0.0))
    out = (
        shared.select(
            "key",
            "n_docs",
            (F.col("n_docs") / n_all).alias("coverage"),
            overlap.alias("overlap"),
        )
    )
    klass = (
        F.when(
            (F.col("coverage") >= params.primary_coverage) & (F.col("overlap") > params.value_overlap),
            "primary",
        )
        .when(F.col("coverage") >= params.secondary_coverage, "secondary")
        .otherwise("none")
    )
    return out.withColumn("key_class", klass)


def links(rows: DataFrame, accepted: DataFrame, extra: list[str] | None = None, min_rows: int | None = None) -> DataFrame:
    """Edges (src, dst) that connect all documents joined by accepted correlators.

    Documents sharing a value under a correlator form a hub; each of them is linked to the hub's
    smallest document.  That is one edge per document and hub instead of one per pair, and the
    connected parts are the same.  `extra` names columns that must agree as well.
    """
    extra = extra or []
    accepted = accepted.select(*SIDES).distinct()
    rule_id = F.xxhash64(*SIDES)
    sides = accepted.select(rule_id.alias("rule_id"), F.col("cluster_1").alias("cluster"), F.col("key_1").alias("key"), F.lit(1).alias("side")).union(
        accepted.select(rule_id, "cluster_2", "key_2", F.lit(2))
    )
    held = small_join(rows, sides, ["cluster", "key"]).select(*extra, "doc_id", "rule_id", "norm", "side")
    on = [*extra, "rule_id", "norm"]
    hubs = (
        held.groupBy(*on)
        .agg(F.min("doc_id").alias("dst"), F.min("side").alias("_lo"), F.max("side").alias("_hi"))
        .where(F.col("_lo") < F.col("_hi"))
        .select(*on, "dst")
    )
    joined = lookup_join(held, hubs, on, min_rows=min_rows)
    return joined.select(F.col("doc_id").alias("src"), "dst").where(F.col("src") != F.col("dst")).distinct()


def _claim_sides(case_rows: DataFrame, reference_rows: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, rule_id, norm) of the cases and (rule_id, norm, doc_id, cluster, entry_idx) of the reference entries."""
    both = accepted.where(F.col("kind") == "independent").select(*SIDES).distinct()
    turned = both.union(both.select("cluster_2", "key_2", "cluster_1", "key_1")).distinct()
    rule_id = F.xxhash64(*SIDES)
    turned = turned.withColumn("rule_id", rule_id)
    own = turned.select("rule_id", F.col("cluster_1").alias("cluster"), F.col("key_1").alias("key"))
    other = turned.select("rule_id", F.col("cluster_2").alias("cluster"), F.col("key_2").alias("key"))
    left = small_join(case_rows.select("case_id", "cluster", "key", "norm"), own, ["cluster", "key"])
    left = left.select("case_id", "rule_id", "norm").distinct()
    right = reference_rows.select("doc_id", "cluster", "key", "norm", "entry_idx").distinct()
    right = small_join(right, other, ["cluster", "key"]).select("rule_id", "norm", "doc_id", "cluster", "entry_idx")
    return left, right


def reference_links(
    case_rows: DataFrame, reference_rows: DataFrame, accepted: DataFrame, min_rows: int | None = None
) -> DataFrame:
    """Reference entries claimed by cases: case_id, doc_id and entry_idx of the reference entry, cluster.

    `case_rows`: case_id, cluster, key, norm of the case's own documents; `reference_rows`: doc_id,
    cluster, key, norm, entry_idx.  Case values are reduced to distinct ones before they move.
    """
    left, right = _claim_sides(case_rows, reference_rows, accepted)
    return (
        salted_join(left, right, ["rule_id", "norm"], hot_keys(left, ["rule_id", "norm"], min_rows))
        .select("case_id", "doc_id", "cluster", "entry_idx")
        .distinct()
    )


def claim_groups(case_rows: DataFrame, reference_rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Claims by what they rest on: rule_id, norm, n_cases, n_entries.  Every case that holds the value claims every entry
    that holds it; the pairs, n_cases * n_entries, are not listed."""
    left, right = _claim_sides(case_rows, reference_rows, accepted)
    on = ["rule_id", "norm"]
    cases = left.groupBy(*on).agg(F.count("*").alias("n_cases"))
    return cases.join(right.groupBy(*on).agg(F.count("*").alias("n_entries")), on)


def claim_counts(
    case_rows: DataFrame, reference_rows: DataFrame, accepted: DataFrame, min_rows: int | None = None
) -> DataFrame:
    """Cases per reference entry without listing claims: doc_id, entry_idx, n_cases, is_ambiguous; as entry_claims of
    reference_links.

    An entry that one rule and value claims has as many cases as these hold, a number of one row.  Where several do, a
    case may come by more than one of them: entries with the same rules and values have the same cases, so the cases are
    told apart once for such a set of claims, however many entries share it.  All cases of the claim with most cases
    count as they stand; only those of the smaller claims are listed, and count where they do not hold the largest.
    """
    left, right = _claim_sides(case_rows, reference_rows, accepted)
    on = ["rule_id", "norm"]
    left = cut_lineage(left)
    sizes = cut_lineage(left.groupBy(*on).agg(F.count("*").alias("_n")))
    entry = ["doc_id", "entry_idx"]
    held = lookup_join(right.select(*entry, *on).distinct(), sizes, on, min_rows=min_rows)
    marks = [F.bit_xor(F.xxhash64(*on)).alias("_s1"), F.bit_xor(F.xxhash64(*on, F.lit(29))).alias("_s2")]
    sets = held.groupBy(*entry).agg(*marks, F.count("*").alias("_k"), F.max(F.struct("_n", *on)).alias("_most"))
    sets = cut_lineage(sets)
    several = sets.where(F.col("_k") > 1)
    shared = several.groupBy("_s1", "_s2").agg(F.min(F.struct(*entry, "_most")).alias("_e"))
    shared = shared.select("_s1", "_s2", *[F.col(f"_e.{c}").alias(c) for c in entry], F.col("_e._most.rule_id").alias("_r"), F.col("_e._most.norm").alias("_v"))
    claims = held.select(*entry, *on).join(shared, entry).where((F.col("rule_id") != F.col("_r")) | (F.col("norm") != F.col("_v")))
    claims = cut_lineage(claims.select("_s1", "_s2", *on, "_r", "_v"))
    # A value that is only ever the largest claim is not listed, so hot keys are looked for among the claimed.
    small = left.join(claims.select(*on).distinct(), on, "left_semi")
    met = salted_join(small, claims, on, hot_keys(small, on, min_rows))
    met = met.select("_s1", "_s2", "case_id", F.col("_r").alias("rule_id"), F.col("_v").alias("norm")).distinct()
    largest = left.select(F.col("case_id").alias("_case"), *on)
    is_held = F.col("case_id").eqNullSafe(F.col("_case"))
    for c in on:
        is_held = is_held & (met[c] == largest[c])
    told = met.join(largest.hint("merge"), is_held, "left_anti").groupBy("_s1", "_s2").agg(F.count("*").alias("_told"))
    counted = sets.join(told, ["_s1", "_s2"], "left")
    n = F.col("_most._n") + F.when(F.col("_k") == 1, 0).otherwise(F.coalesce("_told", F.lit(0)))
    return counted.select(*entry, n.alias("n_cases"), (n > 1).alias("is_ambiguous"))


def entry_claims(reference: DataFrame) -> DataFrame:
    """Cases per reference entry; more than one makes the entry ambiguous (shared)."""
    return (
        reference.select("doc_id", "entry_idx", "case_id")
        .distinct()
        .groupBy("doc_id", "entry_idx")
        .agg(F.count("*").alias("n_cases"))
        .withColumn("is_ambiguous", F.col("n_cases") > 1)
    )


def unused(documents: DataFrame, case_docs: DataFrame) -> DataFrame:
    """Documents in no case."""
    return documents.join(case_docs.select("doc_id").distinct(), "doc_id", "left_anti")


def entry_links(entries: DataFrame, keys: list[str] | None = None, min_rows: int | None = None) -> DataFrame:
    """Edges between array entries of different documents that share a value of a correlating key.

    `entries`: doc_id, entry_idx, key, norm.  Entries holding the value form a hub and are linked to its
    smallest entry: doc_id, entry_idx, to_doc, to_entry, key.
    """
    rows = entries if keys is None else entries.where(F.col("key").isin(keys))
    rows = rows.select("doc_id", "entry_idx", "key", "norm").distinct()
    hubs = (
        rows.groupBy("key", "norm")
        .agg(
            F.min(F.struct("doc_id", "entry_idx")).alias("_to"),
            F.max("doc_id").alias("_last"),
        )
        .where(F.col("_to.doc_id") < F.col("_last"))
        .select("key", "norm", "_to")
    )
    return (
        lookup_join(rows, hubs, ["key", "norm"], min_rows=min_rows)
        .where(F.struct("doc_id", "entry_idx") != F.col("_to"))
        .select("doc_id", "entry_idx", F.col("_to.doc_id").alias("to_doc"), F.col("_to.entry_idx").alias("to_entry"), "key")
        .distinct()
    )
