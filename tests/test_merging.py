"""Complete evidence of relations and what merging decides on it, on small planted tables."""

import random
from datetime import datetime

import pytest

from docflow.operators import activities as act
from docflow.operators import relations, skew

LEAF = "case_id long, norm string, cluster string, variant_id int, key string, doc_id string, final_ts timestamp, is_shared boolean"


def at(day):
    return datetime(2024, 1, day)


@pytest.fixture(scope="module")
def leaf(spark):
    rows = [
        (1, "n:7", "order", 0, "nr", "o1", at(1), False),
        (1, "n:7", "order", 0, "nr", "o2", at(5), False),
        (1, "n:7", "bill", 0, "ref", "b1", at(3), False),
        (1, "n:7", "bill", 0, "ref", "b2", at(6), False),
        (1, "n:7", "bill", 0, "ref", "b2", at(6), False),
        (1, "n:7", "bill", 0, "other", "b3", None, False),
        (2, "n:7", "order", 0, "nr", "o3", at(1), False),
    ]
    return spark.createDataFrame(rows, LEAF)


def test_evidence_lists_every_document_of_both_cells(leaf):
    found = relations.relation_instances(leaf)
    rows = relations.evidence_documents(found, leaf).collect()
    assert sorted((r.key_lo, r.key_hi, r.side, r.doc) for r in rows) == [
        ("nr", "other", 1, "b3"), ("nr", "other", 2, "o1"), ("nr", "other", 2, "o2"),
        ("nr", "ref", 1, "b1"), ("nr", "ref", 1, "b2"), ("nr", "ref", 2, "o1"), ("nr", "ref", 2, "o2"),
    ]
    # A part of the occurrences has the documents of that part.
    part = relations.evidence_documents(found.where("key_1 = 'other'"), leaf)
    assert {r.doc for r in part.collect()} == {"b3", "o1", "o2"}


def test_evidence_does_not_depend_on_its_route(spark, leaf, monkeypatch):
    found = relations.relation_instances(leaf)
    plain = sorted(map(str, relations.evidence_documents(found, leaf).collect()))
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 1)
    assert sorted(map(str, relations.evidence_documents(found, leaf).collect())) == plain


def test_directions_count_document_pairs(leaf):
    evidence = relations.evidence_documents(relations.relation_instances(leaf), leaf)
    row = relations.document_directions(evidence).collect()
    # bill is the first side: b1 (3) is before o2 (5) only; b3 has no time.
    assert [(r.cluster_1, r.cluster_2, r.n_pairs, r.n_before, r.n_after, r.weight) for r in row] == [("bill", "order", 4, 1, 3, 0.5)]


def test_running_sum_on_both_routes(spark):
    rows = [(i % 3, i, i * i) for i in range(200)] + [(9, 1, 5)]
    frame = spark.createDataFrame(rows, "k long, o long, v long")
    expected = {(k, o): sum(w for a, b, w in rows if a == k and b < o) for k, o, _ in rows}
    for hot in ([], None):
        found = skew.running_sum(frame, ["k"], ["o"], "v", "s", hot=hot, min_rows=1).collect()
        assert {(r.k, r.o): r.s for r in found} == expected


def test_uses_keep_the_direction_of_the_variant(spark):
    io = spark.createDataFrame(
        [("x", "input", "bill", 1), ("x", "output", "bill", 2)], "activity_id string, direction string, cluster string, variant int"
    )
    documents = spark.createDataFrame([("x", "bill", 1, "b1"), ("x", "bill", 2, "b2")], "activity_id string, cluster string, variant int, doc string")
    found = act.document_uses(documents, io).collect()
    assert {(r.direction, r.doc) for r in found} == {("input", "b1"), ("output", "b2")}


IO = "activity_id string, direction string, cluster string, variant int"


def sides(*activities):
    return [(i, d, c, 0) for i, ins, outs in activities for d, own in (("input", ins), ("output", outs)) for c in own]


def test_equal_sides_with_other_documents_stay_apart(spark):
    io = spark.createDataFrame(sides(("a", "p", "q"), ("b", "p", "q"), ("c", "p", "q"), ("d", "p", "r")), IO)
    own = {"a": range(8), "b": range(9), "c": range(20, 30), "d": range(8)}
    uses = spark.createDataFrame(
        [(i, d, "q" if d == "output" else "p", n) for i, docs in own.items() for d in ("input", "output") for n in docs],
        "activity_id string, direction string, cluster string, doc long",
    )
    found = {r.activity_id: r.merged_id for r in act.merge_identical(io, uses).collect()}
    assert found == {"a": "a", "b": "a", "c": "c", "d": "d"}
    # Close on one side only is not enough.
    one_side = uses.where("not (activity_id = 'b' and direction = 'output' and doc < 8)")
    assert {r.activity_id: r.merged_id for r in act.merge_identical(io, one_side).collect()}["b"] == "b"
    assert {r.merged_id for r in act.merge_identical(io).collect()} == {"a", "d"}


def test_votes_sign_and_ties(spark):
    io = spark.createDataFrame(sides(("a", "s", "x"), ("b", "s", "y"), ("c", "s", "z"), ("d", "u", "x"), ("e", "v", "x")), IO)
    links = spark.createDataFrame(
        [(i, f"{n}_0", f"{p}_0") for i, n, p in ("asx", "bsy", "csz", "dux", "evx") for n, p in ((n, p), (p, n))],
        "activity_id string, node string, partner string",
    )
    steps = spark.createDataFrame([("x_0", "y_0", "sequence"), ("u_0", "v_0", "sequence"), ("z_0", "x_0", "none")], "a string, b string, rel string")
    found = {(r.id_1, r.id_2, r.why): r.votes for r in act.related_candidates(io, links, steps).collect()}
    # x and y follow each other; x and z do not, nor y and z; d and e share their output, u and v follow each other; a and
    # d share x, and s and u are both related to it but not near: -1.
    assert found == {("a", "b", "related outputs"): 1, ("d", "e", "related inputs"): 1}
    # Inputs of activities that share an output but no third object do not vote, which is a tie and enough.
    apart = links.where("not (activity_id = 'a' and partner = 'x_0')")
    found = {(r.id_1, r.id_2): r.votes for r in act.related_candidates(io, apart, steps).collect()}
    assert found[("a", "d")] == 0 and ("a", "e") in found


def test_merging_in_part(spark):
    own = {"a": range(0, 18), "b": range(2, 20), "c": range(0, 18)}
    evidence = spark.createDataFrame(
        [(i, case, doc) for i, cases in own.items() for case in cases for doc in (f"{i}{case}", "shared")] + [("a", 1, "only a1")],
        "activity_id string, case_id long, doc string",
    )
    valid = spark.createDataFrame([("a", "b", 0.8), ("a", "c", 1.0), ("b", "c", 0.8)], "id_1 string, id_2 string, overlap double")
    rest = act.merge_parts(valid, evidence)
    # Cases 0 and 1 of a are shared with c, those of b with nobody.
    assert {(r.activity_id, r.case_id) for r in rest.collect()} == {("b", 18), ("b", 19)}
    groups = spark.createDataFrame([(i, "a") for i in "abc"], "activity_id string, merged_id string")
    docs = {}
    for r in act.part_documents(rest, groups, evidence).collect():
        docs.setdefault(r.activity_id, set()).add(r.doc)
    assert docs["b#rest"] == {"b18", "b19"} and "shared" in docs["a"] and "only a1" in docs["a"]
    io = spark.createDataFrame(sides(("a", "p", "q"), ("b", "p", "r"), ("c", "p", "q")), IO)
    rules = spark.createDataFrame([(i, "SAME_VALUE", "k", i) for i in "abc"], "activity_id string, rule_type string, key_lo string, key_hi string")
    new_io, new_rules, new_evidence = act.apply_merge(groups, io, rules, evidence, rest)
    assert {(r.activity_id, r.direction, r.cluster) for r in new_io.collect()} == {
        ("a", "input", "p"), ("a", "output", "q"), ("a", "output", "r"), ("b#rest", "input", "p"), ("b#rest", "output", "r")
    }
    assert {(r.activity_id, r.key_hi) for r in new_rules.collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("b#rest", "b")}
    assert {r.case_id for r in new_evidence.where("activity_id = 'b#rest'").collect()} == {18, 19}
    # From an overlap of 0.9 on everything merges.
    assert act.merge_parts(valid.selectExpr("id_1", "id_2", "0.95D AS overlap"), evidence).count() == 0


def test_cover_by_object_keeps_what_the_global_cover_drops(spark):
    io = spark.createDataFrame(sides(("best", "p", "xy"), ("second", "p", "x"), ("same", "x", "x")), IO)
    scores = spark.createDataFrame([("best", 9.0), ("second", 5.0), ("same", 4.0)], "activity_id string, score double")
    rules = [("best", "SAME_VALUE", "k1", "k2"), ("second", "SAME_VALUE", "k1", "k2"), ("second", "SAME_VALUE", "k1", "k3")]
    rules += [("same", "SAME_VALUE", "k4", "k5")]
    rules = spark.createDataFrame(rules, "activity_id string, rule_type string, key_lo string, key_hi string")
    kept = lambda **how: {r.activity_id: r.reason for r in act.select_cover(io, rules, scores, **how).collect()}
    # "same" is the first with x as an input.
    assert kept()["second"] == "new attributes"
    assert kept(each_attribute_by_object=True) == {"best": "new objects", "second": "new attributes", "same": "new objects"}
    only = rules.where("not (activity_id = 'best' and key_hi = 'k2')").unionByName(
        spark.createDataFrame([("same", "SAME_VALUE", "k1", "k3"), ("same", "SAME_VALUE", "k1", "k2")], rules.schema)
    )
    # Another kept activity has both pairs, but brings none to x as its types are the same on both sides.
    found = lambda **how: {r.activity_id for r in act.select_cover(io, only, scores, **how).collect()}
    assert "second" not in found() and "second" in found(each_attribute_by_object=True)


# Graph distances, name groups, claims, files ----------------------------------------------------------------------------


def test_hops_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from docflow import session
    from docflow.operators import footprint

    n, rounds = 10_000, []
    plain = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: rounds.append(1) or plain(df))
    graph = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    found = footprint.hops(graph)
    assert found.where("hops != node").count() == 0 and found.count() == n
    # Two tables a round, edges and nodes and the starts before.
    assert len(rounds) <= 3 + 2 * 15


def test_hops_against_breadth_first_search(spark):
    import random

    from docflow.operators import footprint

    rng = random.Random(7)
    for case in range(4):
        n = 24
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range((12, 26, 40, 90)[case])} | {(100, rng.randrange(n)), (101, 3), (7, 7)}
        nodes = {x for e in edges for x in e}
        level = {x: 0 for x in nodes if all(b != x for _, b in edges)}
        front = set(level)
        while front:
            front = {b for a, b in edges if a in front and b not in level}
            level |= {b: max(level.values()) + 1 for b in front}
        found = {r.node: r.hops for r in footprint.hops(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
        assert found == {x: level.get(x, 0) for x in nodes}


def test_names_meet_by_their_rarest_stretch(spark):
    from docflow.operators import doctypes

    names = ["order", "orders", "preorder", "bill", "billing", "a", "xay", "ab", "zz", "unlike", "order", "aaaa", "aaaaaa"]
    docs = spark.createDataFrame([(i, f"/in/{n}{i}.json") for i, n in enumerate(names)], "doc_id long, path string")
    found = {r.name: r.name_group for r in doctypes.group_by_names(docs).collect()}
    distinct = set(names)
    parent = {n: n for n in distinct}
    for _ in distinct:
        for x in distinct:
            for y in distinct:
                if x in y:
                    low = min(parent[x], parent[y])
                    parent[x] = parent[y] = low
    assert found == parent


def test_claims_are_counted_without_listing_them(spark):
    from docflow.operators import correlate

    accepted = spark.createDataFrame([("c", "k", "r", "k", "independent"), ("c", "m", "r", "m", "independent")], "cluster_1 string, key_1 string, cluster_2 string, key_2 string, kind string")
    cases = [(i, "c", "k", f"n:{i % 3}") for i in range(20)] + [(i, "c", "m", f"n:{i % 4}") for i in range(15)] + [(1, "c", "k", "n:1")]
    reference = [(f"r{i}", "r", "k", f"n:{i % 5}", 0) for i in range(10)] + [(f"r{i}", "r", "m", f"n:{i % 4}", 0) for i in range(0, 10, 2)]
    cases = spark.createDataFrame(cases, "case_id long, cluster string, key string, norm string")
    reference = spark.createDataFrame(reference, "doc_id string, cluster string, key string, norm string, entry_idx int")
    listed = correlate.entry_claims(correlate.reference_links(cases, reference, accepted))
    for min_rows in (None, 1):
        counted = correlate.claim_counts(cases, reference, accepted, min_rows)
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, listed.select(*counted.columns).collect()))
    groups = correlate.claim_groups(cases, reference, accepted).collect()
    assert sum(r.n_cases * r.n_entries for r in groups) >= listed.agg({"n_cases": "sum"}).first()[0]
    assert correlate.claim_counts(cases.limit(0), reference, accepted).count() == 0


def test_xml_of_any_shape(spark):
    import json

    from docflow.sources import files

    texts = {
        "a": "<c id='1'><key>5</key><n>x y</n></c>",
        "b": "<o><no>7</no><pos><p>1</p></pos><pos><p>2</p></pos><empty/></o>",
        "bad": "<a><b></a>", "none": "no xml", "blank": "",
    }
    raw = spark.createDataFrame([(f"/in/{k}.xml", v) for k, v in texts.items()], "path string, value string")
    documents, rejects = files.parse_raw(raw, files.ANY_XML)
    found = {r.title: json.loads(r.content) for r in documents.collect()}
    assert found == {"a": {"key": 5, "n": "x y"}, "b": {"no": 7, "pos": [{"p": 1}, {"p": 2}], "empty": None}}
    assert {(r.path, r.reason) for r in rejects.collect()} == {(f"/in/{k}.xml", "malformed content") for k in ("bad", "none", "blank")}
    with pytest.raises(ValueError):
        files.parse_raw(raw, files.ANY_XML, last_wins=True)


def _cover(io, rules, scores, reference):
    """The greedy choice as it reads, per (activity, score)."""
    ranked = sorted({(-s, a) for a, s in scores if s is not None and s >= 2})
    rows = [(n, a, d, (d, c, v), c in reference) for n, (_, a) in enumerate(ranked) for b, d, c, v in io if a == b]
    first = {}
    for n, _, _, item, _ in rows:
        first[item] = min(n, first.get(item, n))
    seen = [(n, item) for n, _, _, item, _ in rows for _ in range(scores.count((ranked[n][1], -ranked[n][0])))]
    kept = {n for n, _, _, item, _ in rows if first[item] == n} - {
        n for n, _, _, item, ref in rows if ref and (first[item] != n or seen.count((n, item)) > 1)
    }
    names = {ranked[n][1] for n in kept}
    left = {r[0] for r in rows if r[1] not in names}
    pairs = [(n, k) for n, (_, a) in enumerate(ranked) for b, _, *k in rules if a == b]
    covered = [k for n, k in pairs if ranked[n][1] in names and None not in k]
    second = {min(n for n, other in pairs if n in left and other == k) for m, k in pairs if m in left and k not in covered}
    return sorted((ranked[n][1], -ranked[n][0], why) for ids, why in ((kept, "new objects"), (second, "new attributes")) for n in ids)


def test_cover_sorts_no_object_in_one_task(spark, monkeypatch):
    rng = random.Random(5)
    ids = [f"a{i}" for i in range(40)]
    io = [(rng.choice(ids), rng.choice(["input", "output"]), rng.choice(["p", "q", "r", None]), rng.choice([0, 1, None])) for _ in range(120)]
    rules = [(rng.choice(ids), "SAME_VALUE", f"k{rng.randrange(9)}", rng.choice(["z", None])) for _ in range(90)]
    scores = [(a, float(rng.randrange(9))) for a in ids] + [("a1", 7.0), ("a1", 7.0), ("a2", None)]
    tables = (
        spark.createDataFrame(io + io[:9], "activity_id string, direction string, cluster string, variant int"),
        spark.createDataFrame(rules + rules[:9], "activity_id string, rule_type string, key_lo string, key_hi string"),
        spark.createDataFrame(scores, "activity_id string, score double"),
    )
    layer = spark.createDataFrame([("p", "reference"), ("q", "case")], "cluster string, layer string")
    monkeypatch.setattr(act, "cut_lineage", lambda df: df)
    for reference, given in ((set(), None), ({"p"}, layer)):
        out = act.select_cover(*tables, layer=given)
        assert sorted(map(tuple, out.collect())) == _cover(io + io[:9], rules + rules[:9], scores, reference)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
