import pytest
from pyspark.sql import functions as F

import scenarios
from docflow.operators import activities as act
from docflow.operators import eventlog, footprint, nets, pairs
from docflow.plans import discover

EXPECTED = {
    "sequence": {("Bestellung", "Lieferschein"): 5, ("Lieferschein", "Rechnung"): 5},
    "parallel": {
        ("Bestellung", "Lieferschein"): 2,
        ("Bestellung", "Rechnung"): 2,
        ("Lieferschein", "Rechnung"): 2,
        ("Rechnung", "Lieferschein"): 2,
        ("Lieferschein", "Zahlung"): 2,
        ("Rechnung", "Zahlung"): 2,
        ("Zahlung", "Abschluss"): 4,
    },
    "loop": {("Bestellung", "Rechnung"): 4, ("Rechnung", "Zahlung"): 2},
    "choice": {
        ("Bestellung", "Lieferschein"): 4,
        ("Bestellung", "Rechnung"): 2,
        ("Lieferschein", "Rechnung"): 4,
        ("Rechnung", "Zahlung"): 6,
        ("Zahlung", "Abholschein"): 2,
        ("Zahlung", "Abschluss"): 4,
        ("Abholschein", "Abschluss"): 2,
    },
    "iteration": {
        ("Bestellung", "Ablehnung"): 1,
        ("Bestellung", "Lieferschein"): 3,
        ("Bestellung", "Rechnung"): 4,
        ("Lieferschein", "Bestellung"): 1,
        ("Lieferschein", "Rechnung"): 3,
        ("Rechnung", "Bestellung"): 1,
        ("Rechnung", "Lieferschein"): 4,
        ("Rechnung", "Zahlung"): 1,
    },
}


def _cases(spark, name):
    docs = spark.createDataFrame(scenarios.documents(name), "doc_id int, path string, content string")
    return discover.build_cases(docs, discover.type_documents(docs))


@pytest.fixture(scope="module")
def parallel(spark):
    return _cases(spark, "parallel")


def _partition(pairs_):
    groups = {}
    for doc, case in pairs_:
        groups.setdefault(case, set()).add(doc)
    return sorted(map(sorted, groups.values()))


def _check_cases(found, name):
    own = found.case_docs.where(~F.col("is_shared")).select("doc_id", "case_id").collect()
    assert _partition((r["doc_id"], r["case_id"]) for r in own) == _partition(scenarios.case_of(name).items())
    graph = footprint.dfg(discover.case_log(found))
    assert {(r["a"], r["b"]): r["n"] for r in graph.collect()} == EXPECTED[name] == scenarios.follows(name)


def test_parallel_documents_form_the_expected_cases(parallel):
    _check_cases(parallel, "parallel")


def test_master_data_is_reference_and_attached(parallel):
    flags = {r["cluster"]: r["is_reference"] for r in parallel.documents.select("cluster", "is_reference").distinct().collect()}
    assert flags["Kunden"] and flags["Produkte"] and not flags["Bestellung"]
    shared = parallel.case_docs.where("is_shared").groupBy("cluster").agg(F.count_distinct("case_id").alias("n"))
    assert {r["cluster"]: r["n"] for r in shared.collect()} == {"Kunden": 4, "Produkte": 4}


def test_parallel_pair_becomes_split_and_join(parallel):
    log = discover.case_log(parallel)
    times = eventlog.time_relations(log)
    rel = footprint.footprint(times.select("a", "b", "n"))
    both = {(r["a"], r["b"]) for r in rel.where("rel = 'parallel'").collect()}
    assert both == {("Lieferschein", "Rechnung"), ("Rechnung", "Lieferschein")}
    found, mapping = act.time_activities(times, rel)
    names = {(r["kind"], r["activity"]) for r in found.collect()}
    assert names == {
        ("split", "(('Bestellung'), ('Lieferschein', 'Rechnung'))"),
        ("join", "(('Lieferschein', 'Rechnung'), ('Zahlung'))"),
        ("single", "(('Zahlung'), ('Abschluss'))"),
    }
    merged = eventlog.merged_events(eventlog.pair_events(log), mapping)
    per_case = merged.where(F.col("activity").startswith("(('Bestellung')")).groupBy("case_id").count().collect()
    assert [r["count"] for r in per_case] == [1, 1, 1, 1]


def test_content_activities_start_from_the_order(parallel):
    out = discover.content_activities(parallel)
    judged = out["judged"].where("accepted").collect()
    assert any({r["cluster_1"], r["cluster_2"]} == {"Bestellung", "Lieferschein"} for r in judged)
    io = {(r["activity_id"], r["direction"], r["cluster"]) for r in out["io"].collect()}
    order_sides = {d for (a, d, c) in io if c == "Bestellung" and "Zahlung" in a}
    assert order_sides <= {"input"}
    ids = {r["activity_id"] for r in out["selected"].collect()}
    assert ids and ids <= {r["activity_id"] for r in out["io"].collect()}
    sides = out["merged_io"].groupBy("activity_id").agg(F.count_distinct("direction").alias("n")).collect()
    assert all(r["n"] == 2 for r in sides)


def test_iteration_cases_and_variants(spark):
    found = _cases(spark, "iteration")
    _check_cases(found, "iteration")
    top = found.case_docs.groupBy("cluster").agg(F.max("variant_id").alias("v")).collect()
    assert {r["cluster"]: r["v"] for r in top}["Bestellung"] == 1


def test_choice_cases_and_decision_points(spark):
    found = _cases(spark, "choice")
    _check_cases(found, "choice")
    graph = footprint.dfg(discover.case_log(found))
    name = eventlog.activity_name(F.array("a"), F.array("b"))
    rows = graph.select(name.alias("activity"), "a", "b")
    io = rows.select("activity", F.lit("input").alias("direction"), F.col("a").alias("object")).unionByName(
        rows.select("activity", F.lit("output").alias("direction"), F.col("b").alias("object"))
    )
    points = {r["place"]: r["n_paths"] for r in nets.decision_points(nets.net(io)[2]).collect()}
    assert points == {"Bestellung": 2, "Zahlung": 2}


@pytest.mark.parametrize("name", ["sequence", "loop"])
def test_logs_of_given_cases(spark, name):
    rows = []
    for case, trace in enumerate(scenarios.TRACES[name]):
        rows += [(case, scenarios.NAMES[k], i, i) for i, k in enumerate(trace)]
    log = spark.createDataFrame(rows, "case_id int, activity string, ts int, event_id int")
    graph = footprint.dfg(log)
    assert {(r["a"], r["b"]): r["n"] for r in graph.collect()} == EXPECTED[name]
    ends = {(r["kind"], r["activity"]): r["n"] for r in eventlog.starts_and_ends(log).collect()}
    assert ends[("start", "Bestellung")] == len(scenarios.TRACES[name])


def test_rules_do_not_depend_on_partitioning(parallel):
    rows = pairs.members(parallel.leaf)
    one = {tuple(r) for r in pairs.rule_counts(rows.repartition(7)).collect()}
    two = {tuple(r) for r in pairs.rule_counts(rows.coalesce(1)).collect()}
    assert one == two


def test_parallel_pairs_are_joined_one_by_one(spark):
    """A || B and B || C, but A and C are not parallel: only A and B share the follower Y."""
    steps = [("A", "B"), ("B", "A"), ("B", "C"), ("C", "B"), ("A", "Y"), ("B", "Y"), ("X", "C"), ("C", "C")]
    pairs = spark.createDataFrame([(a, b, 3) for a, b in steps], "a string, b string, n_cases long")
    relations = spark.createDataFrame([(a, b, "parallel") for a, b in steps[:4]], "a string, b string, rel string")
    found, mapping = act.time_activities(pairs, relations)
    assert sorted((r["kind"], r["inputs"], r["outputs"]) for r in found.collect()) == [
        ("join", ["A", "B"], ["Y"]),
        ("single", ["C"], ["C"]),
        ("single", ["X"], ["C"]),
    ]
    assert sorted((r["a"], r["b"]) for r in mapping.collect()) == [("A", "Y"), ("B", "Y")]


def test_parallel_neighbours_keep_the_busier_orientation(spark):
    """A || B and Y || Z; A and B lead to Y in five cases and follow it in two."""
    steps = [("A", "B", 1), ("B", "A", 1), ("Y", "Z", 1), ("Z", "Y", 1), ("A", "Y", 3), ("B", "Y", 2), ("Y", "A", 1), ("Y", "B", 1)]
    pairs = spark.createDataFrame(steps, "a string, b string, n_cases long")
    relations = spark.createDataFrame([(a, b, "parallel") for a, b, _ in steps[:4]], "a string, b string, rel string")
    found, _ = act.time_activities(pairs, relations)
    assert [(r["kind"], r["inputs"], r["outputs"]) for r in found.collect()] == [("join", ["A", "B"], ["Y"])]
