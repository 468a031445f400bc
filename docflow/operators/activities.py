"""Activities: from relations to scored, selected and merged activity types.

All tables here are over object types and their pairs; only the evidence (activity instances) grows with
the number of cases, and it is reduced by aggregates before anything is compared.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Params
from docflow.functions.names import activity_name
from docflow.operators.graph import components
from docflow.operators.relations import PAIR, RULE, set_overlap
from docflow.operators.skew import lookup_join, small_join
from docflow.session import cut_lineage

OBJECT = ["cluster", "variant"]


def directed_objects(objects: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Input / output / unclear by mean direction, with the second chance for unclear relations.

    `objects`: PAIR, cluster, variant, weight.  A relation with a clear input and a clear output is kept
    as it is.  In the others, objects that are inputs of a clear relation count as +0.15 and outputs of
    one as -0.15 (a later clear relation overrides an earlier one; input wins over output here), and the
    relation stays if it then has both sides.  Result: PAIR, cluster, variant, weight, direction.
    """
    cut = params.direction_cut
    first = (
        F.when(F.col("weight") < -cut, "input").when(F.col("weight") > cut, "output").otherwise("unclear")
    )
    own = Window.partitionBy(*PAIR)
    marked = objects.withColumn("direction", first)
    marked = marked.withColumn(
        "_clear",
        F.bool_or(F.col("direction") == "input").over(own)
        & F.bool_or(F.col("direction") == "output").over(own),
    )
    clear = marked.where("_clear").where(F.col("direction") != "unclear")
    use = clear.groupBy(*OBJECT).agg(
        F.bool_or(F.col("direction") == "input").alias("_in"),
        F.bool_or(F.col("direction") == "output").alias("_out"),
    )
    shift = params.unclear_shift
    retried = (
        marked.where(~F.col("_clear"))
        .join(use, OBJECT, "left")
        .withColumn(
            "weight",
            F.when(F.col("_in"), F.lit(shift)).when(F.col("_out"), F.lit(-shift)).otherwise(F.col("weight")),
        )
        .withColumn(
            "direction",
            F.when(F.col("weight") < -params.unclear_cut, "input")
            .when(F.col("weight") > params.unclear_cut, "output")
            .otherwise("unclear"),
        )
        .withColumn(
            "_kept",
            F.bool_or(F.col("direction") == "input").over(own)
            & F.bool_or(F.col("direction") == "output").over(own),
        )
        .where("_kept")
        .where(F.col("direction") != "unclear")
    )
    out = [*PAIR, *OBJECT, "weight", "direction"]
    return clear.select(*out).unionByName(retried.select(*out))


def activity_id(pair: list[str] = PAIR):
    return F.concat_ws("|", *[F.col(c).cast("string") for c in pair])


def content_activities(
    directed: DataFrame, accepted: DataFrame, instances: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(io, rules, evidence) of the content-based activities, one per accepted type pair.

    io: activity_id, direction, cluster, variant; rules: activity_id, RULE;
    evidence: activity_id, case_id, norm, RULE, and cluster, variant, key, ts, doc of both sides.
    """
    io = directed.select(activity_id().alias("activity_id"), "direction", *OBJECT).distinct()
    ids = io.select("activity_id").distinct()
    rules = accepted.select(activity_id().alias("activity_id"), *RULE).distinct().join(ids, "activity_id", "left_semi")
    evidence = (
        small_join(instances.withColumn("activity_id", activity_id()), rules, ["activity_id", *RULE], "left_semi")
        .select("activity_id", "case_id", "norm", *RULE, *[f"{c}_{n}" for n in (1, 2) for c in ("cluster", "variant", "key", "ts", "doc")])
    )
    return io, rules, evidence


def name_activities(io: DataFrame, type_names: DataFrame) -> DataFrame:
    """activity_id, name, kind of its type lists.  `type_names`: cluster, doc_type."""
    named = io.join(type_names, "cluster")
    sides = named.groupBy("activity_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("direction") == "input", F.col("doc_type")))).alias("inputs"),
        F.array_sort(F.collect_set(F.when(F.col("direction") == "output", F.col("doc_type")))).alias("outputs"),
    )
    return sides.withColumn("name", activity_name(F.col("inputs"), F.col("outputs")))


def attribute_weights(rules: DataFrame) -> DataFrame:
    """1 - frequency / largest frequency of a key over all activities: attr, weight."""
    keys = F.when(F.col("rule_type") == "SAME_KEY_VALUE_PAIR", F.array("key_lo")).when(
        F.col("rule_type") == "SAME_VALUE", F.array("key_lo", "key_hi")
    )
    counts = (
        rules.select(F.explode(keys).alias("attr")).groupBy("attr").agg(F.count("*").alias("_n"))
    )
    top = counts.agg(F.max("_n").alias("_top")).scalar()
    return counts.select("attr", (1 - F.col("_n") / top).alias("weight"))


def temporal_proximity(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """Mean exp(-pair time / case duration) per activity.  `spans`: case_id, span_s."""
    gap = F.abs(F.unix_micros(F.col("ts_1").cast("timestamp")) - F.unix_micros(F.col("ts_2").cast("timestamp"))) / 1e6
    timed = evidence.where(F.col("ts_1").isNotNull() & F.col("ts_2").isNotNull())
    return (
        lookup_join(timed, spans.where(F.col("span_s") > 0), ["case_id"])
        .groupBy("activity_id")
        .agg(F.avg(F.exp(-gap / F.col("span_s"))).alias("proximity"))
    )


def case_spans(events: DataFrame, case: str = "case_id", ts: str = "ts") -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.groupBy(case).agg(((F.max(micros) - F.min(micros)) / 1e6).alias("span_s"))


def score_activities(
    io: DataFrame,
    rules: DataFrame,
    graph: DataFrame,
    distances: DataFrame,
    relations: DataFrame,
    layer: DataFrame,
    proximity: DataFrame,
    user_scores: DataFrame | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """activity_id, base_score, score.

    `graph`: a, b, n over object names `cluster_variant`; `distances`: node, hops; `relations`: a, b,
    rel; `layer`: cluster, layer; `proximity`: activity_id, proximity; `user_scores`: activity_id, score.
    """
    named = io.withColumn("node", F.concat_ws("_", *OBJECT))
    mean = distances.agg(F.avg("hops").alias("_m")).scalar()
    placed = named.join(distances, "node", "left").withColumn("_mean", mean)
    position = placed.groupBy("activity_id").agg(
        F.sum(
            F.when(F.col("hops") < F.col("_mean"), params.early_bonus).otherwise(params.late_penalty)
        ).alias("position"),
        F.sum(
            F.when(
                F.col("direction") == "output",
                params.reference_weight / F.coalesce(F.col("hops") + 1, F.lit(1)),
            ).otherwise(0.0)
        ).alias("_refpart"),
        (F.count_if(F.col("variant") < 1) * params.variant_weight).alias("variant_part"),
    )
    has_reference = (
        io.where(F.col("direction") == "input")
        .join(layer.where(F.col("layer") == "reference"), "cluster", "left_semi")
        .select("activity_id")
        .distinct()
        .withColumn("_ref", F.lit(True))
    )
    ins = named.where(F.col("direction") == "input").select("activity_id", F.col("node").alias("a"))
    outs = named.where(F.col("direction") == "output").select("activity_id", F.col("node").alias("b"))
    pairs = ins.join(outs, "activity_id")
    sequence = (
        pairs.join(graph, ["a", "b"])
        .groupBy("activity_id")
        .agg((F.sum("n") * params.sequence_weight).alias("sequence_part"))
    )
    parallel = (
        pairs.join(relations.where(F.col("rel") == "parallel"), ["a", "b"])
        .groupBy("activity_id")
        .agg((F.count("*") * params.parallel_factor * params.parallel_penalty).alias("parallel_part"))
    )
    weights = attribute_weights(rules)
    keyed = rules.select("activity_id", F.explode(F.array("key_lo", "key_hi")).alias("attr"))
    attribute = (
        keyed.join(weights, "attr", "left")
        .groupBy("activity_id")
        .agg((F.avg(F.coalesce("weight", F.lit(1.0))) * params.attribute_weight).alias("attribute_part"))
    )
    sides = io.groupBy("activity_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("direction") == "input", F.col("cluster")))).alias("_ci"),
        F.array_sort(F.collect_set(F.when(F.col("direction") == "output", F.col("cluster")))).alias("_co"),
    )
    joined = position.join(has_reference, "activity_id", "left").join(sides, "activity_id")
    for part in (sequence, parallel, attribute, proximity):
        joined = joined.join(part, "activity_id", "left")
    if user_scores is not None:
        joined = joined.join(user_scores.withColumnRenamed("score", "user_score"), "activity_id", "left")
    else:
        joined = joined.withColumn("user_score", F.lit(0.0))

    def part_or_zero(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    base = (
        part_or_zero("user_score")
        + F.col("position")
        + F.when(F.col("_ref"), F.col("_refpart") * params.position_factor).otherwise(0.0)
        + part_or_zero("sequence_part")
        - part_or_zero("parallel_part")
        + part_or_zero("attribute_part")
        + F.when(F.col("_ci") == F.col("_co"), params.loop_weight).otherwise(0.0)
        + part_or_zero("proximity") * params.temporal_weight
        + F.col("variant_part")
    )
    scored = cut_lineage(joined.select("activity_id", "_ci", "_co", base.alias("base_score")))
    return _variant_adjusted(scored, io).select("activity_id", "base_score", "score")


def _variant_adjusted(scored: DataFrame, io: DataFrame) -> DataFrame:
    """Adjust for activities with the same input and output types in other variants, by base scores."""
    ins = io.where(F.col("direction") == "input").select(
        "activity_id", F.col("cluster").alias("ci"), F.col("variant").alias("vi")
    )
    outs = io.where(F.col("direction") == "output").select(
        "activity_id", F.col("cluster").alias("co"), F.col("variant").alias("vo")
    )
    full = scored.join(ins, "activity_id").join(outs, "activity_id")
    other = full.select(
        F.col("activity_id").alias("other_id"),
        "_ci",
        "_co",
        "ci",
        "co",
        F.col("vi").alias("ovi"),
        F.col("vo").alias("ovo"),
        F.col("base_score").alias("other_score"),
    )
    met = full.join(other, ["_ci", "_co", "ci", "co"]).where(F.col("activity_id") != F.col("other_id"))
    change = (
        F.when((F.col("vo") != F.col("ovo")) & (F.col("vi") != F.col("ovi")), F.lit(2.0))
        .when((F.col("ovo") < F.col("vo")) & (F.col("ovi") == F.col("vi")), -2 * F.col("other_score"))
        .when((F.col("ovo") == F.col("vo")) & (F.col("ovi") > F.col("vi")), F.col("other_score") / 2)
        .otherwise(0.0)
    )
    changes = met.groupBy("activity_id").agg(F.sum(change).alias("_change"))
    return scored.join(changes, "activity_id", "left").withColumn(
        "score", F.col("base_score") + F.coalesce("_change", F.lit(0.0))
    )


def select_cover(
    io: DataFrame,
    rules: DataFrame,
    scores: DataFrame,
    layer: DataFrame | None = None,
    params: Params = DEFAULTS,
    each_attribute_by_object: bool = False,
) -> DataFrame:
    """Activities worth keeping, best first: activity_id, score, reason.

    Greedy choice "take the next best if it brings something new" is the same as "keep what is first in
    score order for at least one of its items", because a skipped activity adds nothing new.  First pass:
    new (direction, object) items, reference inputs counting on their own; second pass: activities left
    over that bring a key pair no kept activity has.  With `each_attribute_by_object` a pair counts once for every
    output object: an activity stays that is the best to bring a pair to an output which no kept activity brings it to,
    though other objects have it.  Activities with equal input and output types bring no attributes there.
    """
    ranked = scores.where(F.col("score") >= params.min_score).groupBy("activity_id", "score").agg(F.count("*").alias("_copies"))
    # Numbered in score order: the first of an item is then the least number, which tasks find before anything moves,
    # however many activities an object has.
    ranked = ranked.orderBy(F.desc("score"), F.asc("activity_id")).withColumn("_rank", F.monotonically_increasing_id())
    ranked = cut_lineage(ranked)
    own = ["direction", *OBJECT]
    items = io.join(ranked.drop("score"), "activity_id")
    first = cut_lineage(items.groupBy(*own).agg(F.min("_rank").alias("_first")))
    kept = first.select(F.col("_first").alias("_rank")).distinct()
    if layer is not None:
        reference = layer.where(F.col("layer") == "reference").select("cluster")
        inputs = small_join(items, kept, ["_rank"], "left_semi").join(reference, "cluster")
        inputs = inputs.groupBy("_rank", *own).agg(F.sum("_copies").alias("_n"))
        same = F.lit(True)
        for c in own:
            same = same & inputs[c].eqNullSafe(first[c])
        late = inputs.join(first, same).where((F.col("_n") > 1) | (F.col("_first") != F.col("_rank")))
        kept = kept.join(late.select("_rank").distinct(), "_rank", "left_anti")
    kept = cut_lineage(ranked.join(kept, "_rank"))
    item = ["key_lo", "key_hi"]
    if each_attribute_by_object:
        types = lambda side: F.array_sort(F.collect_set(F.when(F.col("direction") == side, F.col("cluster"))))
        outputs = F.collect_set(F.when(F.col("direction") == "output", F.struct(*OBJECT)))
        sides = io.groupBy("activity_id").agg(types("input").alias("_in"), types("output").alias("_out"), outputs.alias("_outputs"))
        holders = sides.where(F.col("_in") != F.col("_out")).select("activity_id", "_outputs")
        rules = rules.where(F.col("rule_type").isin("SAME_KEY_VALUE_PAIR", "SAME_VALUE"))
    else:
        holders = io.select("activity_id").distinct()
    taken = kept.select("activity_id", F.lit(True).alias("_kept")).distinct()
    holders = small_join(holders.join(ranked.select("activity_id", "_rank"), "activity_id"), taken, ["activity_id"], "left")
    pair_items = rules.select("activity_id", *item).join(holders, "activity_id")
    if each_attribute_by_object:
        pair_items = pair_items.select("_rank", "_kept", *item, F.inline("_outputs"))
        item = [*OBJECT, *item]
    best = pair_items.groupBy(*item).agg(
        F.min(F.when(F.col("_kept").isNull(), F.col("_rank"))).alias("_rank"), F.bool_or(F.col("_kept").isNotNull()).alias("_covered")
    )
    # An item with a null in it equals none, so no kept activity covers it.
    for c in item:
        best = best.withColumn("_covered", F.col("_covered") & F.col(c).isNotNull())
    second = best.where(F.col("_rank").isNotNull() & ~F.col("_covered")).select("_rank").distinct()
    second = ranked.join(second, "_rank").select("activity_id", "score", F.lit("new attributes").alias("reason"))
    return kept.select("activity_id", "score", F.lit("new objects").alias("reason")).unionByName(second)


def first_cover(items: DataFrame, order_by: list, group: list[str], unit: str) -> DataFrame:
    """Units that are first in the given order for at least one item of `group`: unit, n_items."""
    window = Window.partitionBy(*group).orderBy(*order_by)
    return (
        items.withColumn("_rk", F.row_number().over(window))
        .where(F.col("_rk") == 1)
        .groupBy(unit)
        .agg(F.count("*").alias("n_items"))
    )


def prune_rules(io: DataFrame, rules: DataFrame, scores: DataFrame) -> DataFrame:
    """Drop a rule where another activity with a common object uses one of its keys with a better score.

    Result: activity_id, RULE, kept.
    """
    keyed = (
        rules.withColumn("key", F.explode(F.array_distinct(F.array("key_lo", "key_hi"))))
        .join(io.select("activity_id", *OBJECT).distinct(), "activity_id")
        .join(scores.select("activity_id", "score"), "activity_id")
    )
    best = Window.partitionBy(*OBJECT, "key").orderBy(F.desc("score"), F.asc("activity_id"))
    winner = F.first("activity_id").over(best)
    return (
        keyed.withColumn("_won", winner == F.col("activity_id"))
        .groupBy("activity_id", *RULE)
        .agg(F.bool_or("_won").alias("kept"))
    )


def merge_identical(io: DataFrame, uses: DataFrame | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Activities with equal input types and equal output types that become one: activity_id, merged_id.

    Without `uses` every group of equal sides is one.  With it (see document_uses) two activities of a group belong
    together where their documents overlap by more than `identical_overlap` on both sides, and groups are closed
    transitively: one whose activities use different documents falls apart.
    """
    sides = io.groupBy("activity_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("direction") == "input", F.col("cluster")))).alias("_in"),
        F.array_sort(F.collect_set(F.when(F.col("direction") == "output", F.col("cluster")))).alias("_out"),
    )
    if uses is None:
        groups = sides.groupBy("_in", "_out").agg(F.min("activity_id").alias("merged_id"))
        return sides.join(groups, ["_in", "_out"]).select("activity_id", "merged_id")
    sides = cut_lineage(sides)
    one, two = (sides.select("_in", "_out", F.col("activity_id").alias(n)) for n in ("id_1", "id_2"))
    equal = one.join(two, ["_in", "_out"]).where(F.col("id_1") < F.col("id_2")).select("id_1", "id_2")
    close = (
        side_overlap(uses)
        .groupBy("id_1", "id_2")
        .agg(F.min("overlap").alias("_least"), F.count("*").alias("_sides"))
        .where((F.col("_sides") == 2) & (F.col("_least") > params.identical_overlap))
    )
    return merge_groups(io, equal.join(close, ["id_1", "id_2"], "left_semi"))


def merge_candidates(io: DataFrame, relations: DataFrame, layer: DataFrame | None = None) -> DataFrame:
    """Pairs of activities that may be one: id_1 < id_2, why.

    Same inputs with outputs that are mostly parallel; same outputs with inputs that are mostly parallel,
    or only reference data on one side; votes are +1 for a parallel object pair and -1 otherwise, and the
    sum must be positive.  `relations`: a, b, rel over object names.
    """
    named = io.withColumn("node", F.concat_ws("_", *OBJECT))
    parallel = relations.where(F.col("rel") == "parallel").select("a", "b").distinct()

    def candidates(same: str, other: str, why: str) -> DataFrame:
        shared = named.where(F.col("direction") == same).groupBy("activity_id").agg(
            F.array_join(F.array_sort(F.collect_set("node")), ",").alias("_same")
        )
        nodes = named.where(F.col("direction") == other).select("activity_id", "node")
        full = shared.join(nodes, "activity_id")
        one = full.select("_same", F.col("activity_id").alias("id_1"), F.col("node").alias("a"))
        two = full.select("_same", F.col("activity_id").alias("id_2"), F.col("node").alias("b"))
        met = one.join(two, "_same").where((F.col("id_1") < F.col("id_2")) & (F.col("a") != F.col("b")))
        voted = met.join(parallel.withColumn("_par", F.lit(1)), ["a", "b"], "left")
        return (
            voted.groupBy("id_1", "id_2")
            .agg(F.sum(F.when(F.col("_par") == 1, 1).otherwise(-1)).alias("votes"))
            .where(F.col("votes") > 0)
            .select("id_1", "id_2", F.lit(why).alias("why"))
        )

    out = candidates("input", "output", "parallel outputs").unionByName(
        candidates("output", "input", "parallel inputs")
    )
    if layer is not None:
        reference = layer.where(F.col("layer") == "reference").select("cluster")
        ins = named.where(F.col("direction") == "input")
        pure = (
            ins.join(reference.withColumn("_r", F.lit(True)), "cluster", "left")
            .groupBy("activity_id")
            .agg(F.bool_and(F.coalesce("_r", F.lit(False))).alias("_pure"))
        )
        outs = named.where(F.col("direction") == "output").groupBy("activity_id").agg(
            F.array_join(F.array_sort(F.collect_set("node")), ",").alias("_same")
        )
        full = outs.join(pure, "activity_id")
        one = full.select("_same", F.col("activity_id").alias("id_1"), F.col("_pure").alias("p1"))
        two = full.select("_same", F.col("activity_id").alias("id_2"), F.col("_pure").alias("p2"))
        by_reference = one.join(two, "_same").where(
            (F.col("id_1") < F.col("id_2")) & (F.col("p1") | F.col("p2"))
        )
        out = out.unionByName(by_reference.select("id_1", "id_2", F.lit("reference inputs").alias("why")))
    return out.distinct()


def object_links(evidence: DataFrame) -> DataFrame:
    """Which objects an activity relates to each other, both ways: activity_id, node, partner."""
    one, two = (F.concat_ws("_", f"cluster_{n}", f"variant_{n}") for n in (1, 2))
    pairs = evidence.select("activity_id", one.alias("node"), two.alias("partner")).distinct()
    return pairs.unionByName(pairs.select("activity_id", F.col("partner").alias("node"), F.col("node").alias("partner"))).distinct()


def related_candidates(io: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs of activities that may be one because their objects follow each other or are parallel: id_1 < id_2, why,
    votes.

    Two activities that share an input are judged by their outputs, two that share an output by their inputs.  Every
    object of the one with every object of the other votes if both are related to a common third object (`links`, see
    object_links): +1 where the footprint has them in sequence, either way, or parallel, and -1 otherwise, also for an
    object with itself.  Outputs need a positive sum; for inputs a tie is enough, so no vote at all passes too.
    `relations`: a, b, rel over object names.
    """
    named = io.select("activity_id", "direction", F.concat_ws("_", *OBJECT).alias("node")).distinct()
    near = relations.where(F.col("rel").isin("sequence", "parallel")).select("a", "b")
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("_near", F.lit(1))

    def side(rows: DataFrame, n: int, node: str) -> DataFrame:
        return rows.select(F.col("activity_id").alias(f"id_{n}"), F.col("node").alias(node))

    def candidates(same: str, other: str, least: int, why: str) -> DataFrame:
        shared, judged = (named.where(F.col("direction") == d) for d in (same, other))
        pairs = side(shared, 1, "_same").join(side(shared, 2, "_same"), "_same")
        pairs = pairs.where(F.col("id_1") < F.col("id_2")).select("id_1", "id_2").distinct()
        related = judged.join(links, ["activity_id", "node"])
        one = related.select(F.col("activity_id").alias("id_1"), F.col("node").alias("a"), "partner")
        two = related.select(F.col("activity_id").alias("id_2"), F.col("node").alias("b"), "partner")
        met = pairs.join(one, "id_1").join(two, ["id_2", "partner"]).select("id_1", "id_2", "a", "b").distinct()
        vote = F.when(F.col("_near") == 1, 1).otherwise(-1)
        votes = met.join(near, ["a", "b"], "left").groupBy("id_1", "id_2").agg(F.sum(vote).alias("votes"))
        counted = pairs.join(votes, ["id_1", "id_2"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
        return counted.where(F.col("votes") >= least).select("id_1", "id_2", F.lit(why).alias("why"), "votes")

    return candidates("input", "output", 1, "related outputs").unionByName(candidates("output", "input", 0, "related inputs"))


def document_uses(evidence: DataFrame, io: DataFrame) -> DataFrame:
    """Documents an activity uses on each side: activity_id, direction, cluster, doc.

    `evidence` lists activity_id, cluster, variant, doc (see relations.evidence_documents with activity_id carried): a
    document is used on the side that its type and variant have in `io`.  Evidence of one document a side (cluster_1,
    doc_1, cluster_2, doc_2) goes by the type alone.
    """
    if "doc" in evidence.columns:
        sides = io.select("activity_id", "direction", *OBJECT).distinct()
        used = small_join(evidence.select("activity_id", *OBJECT, "doc"), sides, ["activity_id", *OBJECT])
        return used.select("activity_id", "cluster", "doc", "direction").distinct()
    used = evidence.select(
        "activity_id", F.col("cluster_1").alias("cluster"), F.col("doc_1").alias("doc")
    ).unionByName(
        evidence.select("activity_id", F.col("cluster_2").alias("cluster"), F.col("doc_2").alias("doc"))
    )
    sides = io.select("activity_id", "direction", "cluster").distinct()
    return small_join(used, sides, ["activity_id", "cluster"]).distinct()


def side_overlap(uses: DataFrame) -> DataFrame:
    """Per activity pair and side, the mean Jaccard of the documents over the types both use there:
    id_1 < id_2, direction, overlap."""
    by = ["direction", "cluster"]
    rows = uses.select("activity_id", *by, "doc").distinct()
    sizes = cut_lineage(rows.groupBy("activity_id", *by).agg(F.count("*").alias("n")))
    one = rows.select(*by, "doc", F.col("activity_id").alias("id_1"))
    two = rows.select(*by, "doc", F.col("activity_id").alias("id_2"))
    both = one.join(two, [*by, "doc"]).where(F.col("id_1") < F.col("id_2"))
    both = both.groupBy("id_1", "id_2", *by).agg(F.count("*").alias("_both"))
    s1 = sizes.select(*by, F.col("activity_id").alias("id_1"), F.col("n").alias("_n1"))
    s2 = sizes.select(*by, F.col("activity_id").alias("id_2"), F.col("n").alias("_n2"))
    met = s1.join(s2, by).where(F.col("id_1") < F.col("id_2")).join(both, ["id_1", "id_2", *by], "left")
    shared = F.coalesce("_both", F.lit(0))
    return met.groupBy("id_1", "id_2", "direction").agg(
        F.avg(shared / (F.col("_n1") + F.col("_n2") - shared)).alias("overlap")
    )


def temporal_contradictions(io: DataFrame, events: DataFrame) -> DataFrame:
    """Activities with an input that comes after all documents of an output in some case: activity_id.

    `events`: case_id, activity (object name), ts.  Times are reduced to first and last per case and
    object before they meet.
    """
    spans = events.groupBy("case_id", "activity").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    named = io.withColumn("node", F.concat_ws("_", *OBJECT))
    ins = named.where(F.col("direction") == "input").select("activity_id", F.col("node").alias("a"))
    outs = named.where(F.col("direction") == "output").select("activity_id", F.col("node").alias("b"))
    steps = ins.join(outs, "activity_id")
    start = spans.select("case_id", F.col("activity").alias("a"), F.col("_first").alias("_a"))
    end = spans.select("case_id", F.col("activity").alias("b"), F.col("_last").alias("_b"))
    return (
        small_join(start, steps, ["a"])
        .join(end, ["case_id", "b"])
        .where(F.col("_a") > F.col("_b"))
        .select("activity_id")
        .distinct()
    )


def validate_merges(
    candidates: DataFrame,
    io: DataFrame,
    evidence: DataFrame,
    events: DataFrame | None = None,
    uses: DataFrame | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Candidates that stay: id_1, id_2, why, overlap.

    Their cases overlap enough (Jaccard); the inputs of one are not outputs of the other; neither runs
    against time in a case (`events`, see temporal_contradictions); and where both use a type on the same
    side, they use mostly the same documents (`uses`, see document_uses).
    """
    cases = evidence.select("activity_id", "case_id").distinct()
    overlap = set_overlap(cases, ["activity_id"], "case_id").select(
        F.col("activity_id_1").alias("id_1"), F.col("activity_id_2").alias("id_2"), F.col("jaccard").alias("overlap")
    )
    ins = io.where(F.col("direction") == "input").select(F.col("activity_id").alias("id_1"), *OBJECT)
    outs = io.where(F.col("direction") == "output").select(F.col("activity_id").alias("id_2"), *OBJECT)
    turned = ins.join(outs, OBJECT).select("id_1", "id_2").where(F.col("id_1") != F.col("id_2"))
    turned = turned.select(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2")).distinct()
    out = (
        candidates.join(overlap, ["id_1", "id_2"])
        .where(F.col("overlap") >= params.case_overlap)
        .join(turned, ["id_1", "id_2"], "left_anti")
    )
    if events is not None:
        against = cut_lineage(temporal_contradictions(io, events))
        for side in ("id_1", "id_2"):
            out = out.join(against.select(F.col("activity_id").alias(side)), side, "left_anti")
    if uses is not None:
        apart = side_overlap(uses).where(F.col("overlap") < params.document_overlap)
        out = out.join(apart.select("id_1", "id_2").distinct(), ["id_1", "id_2"], "left_anti")
    return out


def merge_groups(io: DataFrame, valid: DataFrame) -> DataFrame:
    """activity_id, merged_id: valid merges closed transitively."""
    edges = valid.select(F.col("id_1").alias("src"), F.col("id_2").alias("dst"))
    nodes = io.select(F.col("activity_id").alias("node")).distinct()
    return components(edges, nodes).select(
        F.col("node").alias("activity_id"), F.col("component").alias("merged_id")
    )


#: What the rest of an activity that merges in part is called.
REST = "#rest"


def merge_parts(valid: DataFrame, evidence: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """What stays outside a merge: activity_id, case_id of the cases that an activity keeps for itself.

    `valid`: validate_merges.  Where the cases of two activities overlap by less than `partial_overlap`, only the cases
    that they share merge; an activity's others are its rest.  In a group of several a case is shared as soon as one of
    the activity's own partners has it.
    """
    both = valid.select("id_1", "id_2", "overlap").unionByName(
        valid.select(F.col("id_2").alias("id_1"), F.col("id_1").alias("id_2"), "overlap")
    )
    both = both.distinct().select(F.col("id_1").alias("activity_id"), F.col("id_2").alias("_other"), "overlap")
    cases = evidence.select("activity_id", "case_id").distinct()
    partial = both.where(F.col("overlap") < params.partial_overlap).select("activity_id").distinct()
    own = cut_lineage(small_join(cases, partial, ["activity_id"]))
    other = cases.withColumnRenamed("activity_id", "_other")
    shared = small_join(own, both.drop("overlap"), ["activity_id"]).join(other, ["_other", "case_id"], "left_semi")
    return own.join(shared.select("activity_id", "case_id").distinct(), ["activity_id", "case_id"], "left_anti")


def part_documents(rest: DataFrame, groups: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of merged and rest activities: activity_id, doc.

    `documents`: activity_id, case_id, doc.  A rest keeps the documents of its own cases that no merged case of its group
    uses; one that both use (a shared reference) belongs to the merged part.
    """
    rows = small_join(documents.select("activity_id", "case_id", "doc").distinct(), groups, ["activity_id"])
    rows = rows.join(rest.withColumn("_rest", F.lit(True)), ["activity_id", "case_id"], "left")
    is_rest = F.coalesce("_rest", F.lit(False))
    marked = rows.select("merged_id", "activity_id", "doc", is_rest.alias("_rest"))
    per_doc = marked.groupBy("merged_id", "doc").agg(
        F.bool_and("_rest").alias("_only"), F.collect_set(F.when(F.col("_rest"), F.col("activity_id"))).alias("_ids")
    )
    merged = per_doc.where(~F.col("_only")).select(F.col("merged_id").alias("activity_id"), "doc")
    kept = per_doc.where("_only").select(F.explode("_ids").alias("activity_id"), "doc")
    return merged.unionByName(kept.select(F.concat("activity_id", F.lit(REST)).alias("activity_id"), "doc"))


def apply_merge(
    groups: DataFrame, io: DataFrame, rules: DataFrame, evidence: DataFrame, rest: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """io, rules and evidence of the merged activities, as set unions.

    With `rest` (see merge_parts) the evidence of those cases goes to an activity of its own with the sides and rules of
    the whole, named by its id and REST.
    """
    def moved(df: DataFrame) -> DataFrame:
        moved_rows = small_join(df, groups, ["activity_id"]).drop("activity_id")
        return moved_rows.withColumnRenamed("merged_id", "activity_id")

    if rest is None:
        return moved(io).distinct(), moved(rules).distinct(), moved(evidence).distinct()
    rest = cut_lineage(rest.select("activity_id", "case_id").distinct())
    ids = cut_lineage(rest.select("activity_id").distinct())
    named = F.concat("activity_id", F.lit(REST)).alias("activity_id")

    def with_rest(df: DataFrame) -> DataFrame:
        own = small_join(df, ids, ["activity_id"])
        return moved(df).unionByName(own.select(named, *[c for c in own.columns if c != "activity_id"])).distinct()

    keys = ["activity_id", "case_id"]
    left = evidence.join(rest, keys, "left_semi")
    merged = moved(evidence.join(rest, keys, "left_anti"))
    return with_rest(io), with_rest(rules), merged.unionByName(left.withColumn("activity_id", named), allowMissingColumns=True).distinct()


def _documents(evidence: DataFrame) -> DataFrame:
    """activity_id, doc from evidence with all its documents (doc) or with one a side (doc_1, doc_2)."""
    doc = F.col("doc") if "doc" in evidence.columns else F.explode(F.array("doc_1", "doc_2"))
    return evidence.select("activity_id", doc.alias("doc")).distinct()


def clean_up(io: DataFrame, evidence: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """After merging: where two activities with a common object on the same side use mostly the same
    documents, the one with fewer documents gives the object up.  Result: io without those rows."""
    docs = _documents(evidence)
    close = set_overlap(docs, ["activity_id"], "doc").where(F.col("jaccard") > params.document_overlap)
    loser = close.select(
        F.when(F.col("n_1") < F.col("n_2"), F.col("activity_id_1")).otherwise(F.col("activity_id_2")).alias("activity_id"),
        F.when(F.col("n_1") < F.col("n_2"), F.col("activity_id_2")).otherwise(F.col("activity_id_1")).alias("_winner"),
    )
    winners = io.select(F.col("activity_id").alias("_winner"), "direction", *OBJECT)
    given_up = loser.join(io, "activity_id").join(winners, ["_winner", "direction", *OBJECT], "left_semi")
    # An object is given up only where the activity keeps another one on that side.
    side = Window.partitionBy("activity_id", "direction")
    marked = io.join(
        given_up.select("activity_id", "direction", *OBJECT).distinct().withColumn("_gone", F.lit(True)),
        ["activity_id", "direction", *OBJECT],
        "left",
    ).withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    keep_side = F.bool_or(~F.col("_gone")).over(side)
    return marked.withColumn("_side", keep_side).where(~F.col("_gone") | ~F.col("_side")).drop("_gone", "_side")


def used_same_documents(evidence: DataFrame) -> DataFrame:
    """Jaccard of the documents behind two activities."""
    docs = _documents(evidence)
    return set_overlap(docs, ["activity_id"], "doc")


def compatible_rules(rules: DataFrame) -> DataFrame:
    """Activity pairs that use the same key in different rules: id_1 < id_2, key."""
    keyed = rules.withColumn("key", F.explode(F.array_distinct(F.array("key_lo", "key_hi"))))
    one = keyed.select("key", F.col("activity_id").alias("id_1"), F.struct(*RULE).alias("_r1"))
    two = keyed.select("key", F.col("activity_id").alias("id_2"), F.struct(*RULE).alias("_r2"))
    met = one.join(two, "key").where(F.col("id_1") < F.col("id_2"))
    return met.where(F.col("_r1") != F.col("_r2")).select("id_1", "id_2", "key").distinct()


def time_activities(pairs: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Time-based activities after AND-aggregation: (activities, activity_map).

    `pairs`: a, b, n_cases of consecutive types; `relations`: a, b, rel (footprint).  Every pair of parallel
    types A, B is looked at by itself: all Y with A->Y and B->Y make the join {A, B} -> {Y, ...}, all X with
    X->A and X->B the split {X, ...} -> {A, B}.  A neighbour that is parallel to something keeps the
    orientation with more cases.  Steps between parallel types are consumed, and so are those of joins and
    splits; each other step is an activity of its own.
    activities: activity, kind, inputs, outputs; activity_map: a, b, activity (for the merged event log).
    """
    pairs = cut_lineage(pairs.select("a", "b", "n_cases"))
    par = relations.where((F.col("rel") == "parallel") & (F.col("a") != F.col("b"))).select("a", "b")
    par = cut_lineage(par.unionByName(par.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    outer = pairs.join(par, ["a", "b"], "left_anti").where(F.col("a") != F.col("b"))
    couples = par.where(F.col("a") < F.col("b")).select(F.col("a").alias("p"), F.col("b").alias("q"))

    def met(inner: str, far: str, name: str) -> DataFrame:
        """Neighbours that both types of a couple share on one side, with their cases."""
        one = outer.select(F.col(inner).alias("p"), F.col(far).alias("other"), F.col("n_cases").alias("_p"))
        two = outer.select(F.col(inner).alias("q"), F.col(far).alias("other"), F.col("n_cases").alias("_q"))
        both = couples.join(one, "p").join(two, ["q", "other"])
        return both.groupBy("p", "q", "other").agg(F.sum(F.col("_p") + F.col("_q")).alias(name))

    sides = met("a", "b", "n_out").join(met("b", "a", "n_in"), ["p", "q", "other"], "full")
    partners = par.select(F.col("a").alias("other"), F.lit(True).alias("_par")).distinct()
    sides = cut_lineage(sides.join(partners, "other", "left"))
    n_out, n_in = F.coalesce("n_out", F.lit(0)), F.coalesce("n_in", F.lit(0))
    alone = F.col("_par").isNull()
    others = F.array_sort(F.collect_set("other"))
    joins = sides.where((n_out > 0) & (alone | (n_out >= n_in))).groupBy("p", "q").agg(others.alias("outputs"))
    splits = sides.where((n_in > 0) & (alone | (n_in > n_out))).groupBy("p", "q").agg(others.alias("inputs"))
    couple = F.array("p", "q")
    merged = joins.select(couple.alias("inputs"), "outputs", F.lit("join").alias("kind")).unionByName(
        splits.select("inputs", couple.alias("outputs"), F.lit("split").alias("kind"))
    )
    merged = cut_lineage(merged.withColumn("activity", activity_name(F.col("inputs"), F.col("outputs"))))
    covered = merged.select(F.explode("inputs").alias("a"), "outputs", "activity").select(
        "a", F.explode("outputs").alias("b"), "activity"
    )
    # Where an orientation was chosen, the steps against it are consumed as well.
    turned = sides.where(~alone & (n_out > 0) & (n_in > 0)).select(F.explode(couple).alias("a"), F.col("other").alias("b"))
    back = turned.select(F.col("b").alias("a"), F.col("a").alias("b"))
    used = covered.select("a", "b").unionByName(par).unionByName(turned).unionByName(back).distinct()
    single = pairs.join(used, ["a", "b"], "left_anti").select(
        F.array("a").alias("inputs"),
        F.array("b").alias("outputs"),
        F.lit("single").alias("kind"),
        activity_name(F.array("a"), F.array("b")).alias("activity"),
    )
    activities = merged.select("activity", "kind", "inputs", "outputs").unionByName(
        single.select("activity", "kind", "inputs", "outputs")
    )
    return activities, covered


def plausibility(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """How plausible both objects of a relation are: 0.5 plus 0.1 per sign.

    Signs: the type has dates, is reference data, stands on both sides of relations, has prices.
    `relations`: obj1, obj2; `facts`: obj, has_date, is_reference, has_price.
    """
    both_sides = (
        relations.select(F.col("obj1").alias("obj"))
        .distinct()
        .join(relations.select(F.col("obj2").alias("obj")).distinct(), "obj", "left_semi")
        .withColumn("_both", F.lit(True))
    )
    signs = ("has_date", "is_reference", "has_price", "_both")
    total = F.lit(0.5)
    for sign in signs:
        total = total + F.when(F.col(sign), 0.1).otherwise(0.0)
    per_object = facts.join(both_sides, "obj", "left").select("obj", F.round(total, 1).alias("p"))
    one = per_object.select(F.col("obj").alias("obj1"), F.col("p").alias("p1"))
    two = per_object.select(F.col("obj").alias("obj2"), F.col("p").alias("p2"))
    return relations.select("obj1", "obj2").distinct().join(one, "obj1").join(two, "obj2")
