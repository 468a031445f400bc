"""From documents to process knowledge: the operators in the order a user runs them."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Params
from docflow.functions.names import type_name
from docflow.operators import activities as act
from docflow.operators import arrays, cases, correlate, doctypes, eventlog, footprint, leaves, objects, pairs, relations
from docflow.operators.graph import components
from docflow.operators.skew import lookup_join
from docflow.session import cut_lineage


@dataclass
class Cases:
    """Documents put into cases."""

    documents: DataFrame  # doc_id, cluster, is_reference, arrays_found, final_ts
    leaf: DataFrame  # doc_id, cluster, key, norm, entry_idx, ...
    rules: DataFrame
    correlators: DataFrame
    case_docs: DataFrame  # case_id, doc_id, cluster, is_shared, is_partial, entry_idx, final_ts, variant_id


def type_documents(documents: DataFrame, typing: str = "names") -> DataFrame:
    """doc_id, cluster: by file name, by key set, or by k-means over the key text."""
    if typing == "names":
        return documents.select("doc_id", type_name(F.col("path")).alias("cluster"))
    signed = leaves.key_signature(documents)
    if typing == "keys":
        labels = doctypes.type_by_keys(signed)
    elif typing == "kmeans":
        vectors = doctypes.tfidf(doctypes.tokens(signed))
        best = doctypes.sweep_k(vectors).where("is_best").first()["k"]
        labels = doctypes.label_documents(vectors, best)
    else:
        raise ValueError(f"unknown typing {typing}")
    return labels.select("doc_id", F.col("cluster").cast("string").alias("cluster"))


def build_cases(
    documents: DataFrame,
    labels: DataFrame,
    params: Params = DEFAULTS,
    require_corroboration: bool = True,
    lone_cases: bool = True,
) -> Cases:
    """Correlate documents and group them into cases.

    `documents`: doc_id, path, content; `labels`: doc_id, cluster.  With `lone_cases` a document without
    any link is a case of its own, else it stays unused.
    """
    labelled = documents.join(labels, "doc_id")
    structure = arrays.document_structure(labelled, arrays.array_profiles(labelled, params=params))
    leaf = leaves.normalize_dates(leaves.leaves(labelled, ["doc_id", "cluster"]))
    leaf = cut_lineage(leaf.join(structure.select("doc_id", "is_reference"), "doc_id"))
    times = leaves.document_time(leaves.timestamp_leaves(leaf, normalized=True))
    typed = cut_lineage(labels.join(structure, "doc_id").join(times, "doc_id", "left"))

    rows = cut_lineage(pairs.members(leaf))
    rules = cut_lineage(pairs.rule_counts(rows))
    types = correlate.type_instances(typed)
    reference_keys = leaf.where("is_reference").select("key").distinct()
    accepted = cut_lineage(
        correlate.correlators(rows, rules, types, reference_keys, require_corroboration, params)
    )
    own = typed.where(~F.col("is_reference"))
    joining = accepted.where(F.col("kind") != "independent")
    edges = correlate.links(rows.join(own.select("doc_id"), "doc_id", "left_semi"), joining)
    vertices = own.select(F.col("doc_id").alias("node")) if lone_cases else None
    labels_of = components(edges, vertices)
    members = cases.case_documents(labels_of, own)
    case_rows = members.select("case_id", "doc_id").join(rows, "doc_id")
    reference = correlate.reference_links(case_rows, leaf.where("is_reference"), accepted)
    bridge = cut_lineage(cases.case_documents(labels_of, own, reference))
    numbered = cases.repeat_index(bridge.where(~F.col("is_shared"))).select("case_id", "doc_id", "variant_id")
    bridge = bridge.join(numbered, ["case_id", "doc_id"], "left").withColumn(
        "variant_id", F.coalesce("variant_id", F.lit(0)).cast("long")
    )
    return Cases(typed, leaf, rules, accepted, cut_lineage(bridge))


def case_leaves(found: Cases, by_variant: bool = True) -> DataFrame:
    """Leaves of the case documents; a reference document gives the claimed entry and what
    lies outside its arrays.

    `by_variant=False` compares types instead of numbered documents; use it where a case may repeat a
    type very often, since the number of object pairs grows with the square of the repeats.
    """
    own = found.case_docs.where(~F.col("is_shared"))
    shared = found.case_docs.where(F.col("is_shared"))
    leaf = found.leaf.where(~F.col("in_list") & (F.col("vtype") != "NESTED"))
    columns = ["case_id", "doc_id", "cluster", "variant_id", "final_ts", "is_shared", "key", "norm"]
    first = own.join(leaf.select("doc_id", "key", "norm"), "doc_id").select(*columns)
    # An entry may be claimed by very many cases; its own leaves are few.  What lies outside all arrays
    # (entry -1 here) goes along with every claim, and is all that a claim without an entry brings.
    part = F.coalesce("entry_idx", F.lit(-1)).alias("_part")
    claims = [c for c in columns if c not in ("key", "norm")]
    claimed = shared.select(*claims, part).unionByName(shared.select(*claims, F.lit(-1).alias("_part"))).distinct()
    second = lookup_join(claimed, leaf.select("doc_id", part, "key", "norm"), ["doc_id", "_part"]).select(*columns)
    out = first.unionByName(second)
    return out if by_variant else out.withColumn("variant_id", F.lit(0).cast("long"))


def content_relations(found: Cases, params: Params = DEFAULTS, by_variant: bool = True) -> tuple[DataFrame, DataFrame]:
    """(instances, judged) of the content-based relations."""
    instances = cut_lineage(relations.relation_instances(case_leaves(found, by_variant)))
    variants = cases.case_variants(cases.composition(found.case_docs))
    counts = relations.relation_counts(instances, variants)
    judged = relations.judge_relations(counts, correlate.type_instances(found.documents), params)
    return instances, cut_lineage(judged)


def case_log(found: Cases, by_variant: bool = False) -> DataFrame:
    """Documents of cases as a log: case_id, activity, ts, event_id."""
    name = eventlog.object_name(F.col("cluster"), F.col("variant_id")) if by_variant else F.col("cluster")
    return eventlog.case_events(found.case_docs).select(
        "case_id", name.alias("activity"), F.col("final_ts").alias("ts"), F.col("doc_id").alias("event_id")
    )


def content_activities(found: Cases, params: Params = DEFAULTS) -> dict[str, DataFrame]:
    """Scored, selected and merged content-based activities: io, rules, evidence, documents (all behind the selected
    ones), scores, selected, merged_io, merged_rules, merged_evidence."""
    instances, judged = content_relations(found, params)
    case_leaf = case_leaves(found)
    accepted = judged.where("accepted")
    directed = cut_lineage(act.directed_objects(relations.relation_objects(instances, accepted), params))
    io, rules, evidence = (cut_lineage(t) for t in act.content_activities(directed, accepted, instances))
    log = cut_lineage(case_log(found, by_variant=True))
    graph = cut_lineage(footprint.dfg(log))
    steps = cut_lineage(footprint.footprint(graph))
    distances = cut_lineage(footprint.hops(graph))
    n_cases = found.case_docs.agg(F.count_distinct("case_id").alias("n")).scalar()
    layer = cut_lineage(objects.layers(found.documents, n_cases, params))
    proximity = act.temporal_proximity(evidence, act.case_spans(log))
    scores = cut_lineage(
        act.score_activities(io, rules, graph, distances, steps, layer, proximity, params=params)
    )
    selected = cut_lineage(act.select_cover(io, rules, scores, layer, params))
    chosen_io = cut_lineage(io.join(selected.select("activity_id"), "activity_id", "left_semi"))
    chosen_evidence = evidence.join(selected.select("activity_id"), "activity_id", "left_semi")
    documents = cut_lineage(relations.evidence_documents(chosen_evidence, case_leaf, carry=["activity_id"]))
    uses = cut_lineage(act.document_uses(documents, chosen_io))
    identical = act.merge_identical(chosen_io, uses, params).where(F.col("activity_id") != F.col("merged_id"))
    # The activity that gives a group of identical ones its name, with each of the others.
    same = identical.select(F.col("merged_id").alias("id_1"), F.col("activity_id").alias("id_2"), F.lit("identical").alias("why"))
    related = act.related_candidates(chosen_io, cut_lineage(act.object_links(chosen_evidence)), steps).drop("votes")
    candidates = cut_lineage(act.merge_candidates(chosen_io, steps, layer).unionByName(related))
    valid = act.validate_merges(candidates, chosen_io, chosen_evidence, log, uses, params)
    valid = cut_lineage(valid.unionByName(same.withColumn("overlap", F.lit(1.0))))
    groups = cut_lineage(act.merge_groups(chosen_io, valid))
    rest = cut_lineage(act.merge_parts(valid, chosen_evidence, params))
    merged_io, merged_rules, merged_evidence = act.apply_merge(groups, chosen_io, rules, chosen_evidence, rest)
    merged_documents = act.part_documents(rest, groups, documents)
    return {
        "io": io,
        "rules": rules,
        "evidence": evidence,
        "scores": scores,
        "selected": selected,
        "merged_io": act.clean_up(merged_io, merged_documents, params),
        "merged_rules": merged_rules,
        "merged_evidence": merged_evidence,
        "documents": documents,
        "judged": judged,
    }
