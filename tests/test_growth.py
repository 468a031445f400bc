"""What must not grow faster than the input: rows listed, shuffles, rows of one task."""

from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from docflow.operators import cases, correlate, pairs, relations, similarity, skew
from docflow.session import cut_lineage
from docflow.sources.files import ANY_XML, parse_raw

LEAF = "case_id int, norm string, cluster string, variant_id int, key string, doc_id string, final_ts timestamp, is_shared boolean"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_tables_are_compressed_columns(spark):
    cut = cut_lineage(spark.range(10).withColumn("text", F.lit("a")))
    assert all(f.endswith(".zstd.parquet") for f in cut.inputFiles()) and cut.inputFiles()
    assert cut.count() == 10
    assert cut_lineage(spark.range(2).withColumn("none", F.lit(None))).count() == 2
    twice = spark.range(2).join(spark.range(2).withColumnRenamed("id", "ID"), F.lit(True))
    assert cut_lineage(twice).count() == 4


def test_subsets_grow_only_from_values_that_can_meet(spark):
    rows = [(f"a{d}", "x", "k", f"n:{8 * d + i + 1000}") for d in range(5) for i in range(8)]
    rows += [(f"b{d}", "y", "k", f"n:{8 * d + i + 5000}") for d in range(5) for i in range(8)]
    rows += [(d, c, "k", f"n:{v}") for d, c in (("a0", "x"), ("b0", "y")) for v in (3, 4)]
    short = [r for r in rows if r[0] not in ("a0", "b0")] + [(d, c, "k", f"n:{v}") for d, c in (("a0", "x"), ("b0", "y")) for v in (3, 4)]
    frame = spark.createDataFrame(short, "doc_id string, cluster string, key string, norm string")
    found = pairs._subsets(pairs._value_sets(frame, ["cluster", "key"]), ["cluster", "key"], 8, False)
    assert found.where("size > 1").count() == 2
    assert pairs.rule_counts(frame).first()["n"] == 1
    # A null is no common literal and no plain value.
    lone = spark.createDataFrame([("a", "x", "k", None), ("b", "y", "l", None), ("a", "x", "m", "n:7"), ("a", "x", "m", "n:8")], frame.schema)
    assert pairs.rule_counts(lone).count() == 0


def test_short_sets_meet_long_ones_once(spark):
    long = {f"l{d}": set(range(d, d + 12)) for d in range(6)} | {"twin": set(range(12))}
    short = {f"s{d}": {d, d + 1, 40 + d} for d in range(10)}
    rows = [(d, "y", "k", f"n:{v + 100}") for d, vs in long.items() for v in vs] + [(d, "x", "k", f"n:{v + 100}") for d, vs in short.items() for v in vs]
    frame = spark.createDataFrame(rows, "doc_id string, cluster string, key string, norm string")
    want = sum(bool(a & b) for a in long.values() for b in short.values())
    assert [r["n"] for r in pairs.rule_counts(frame).collect()] == [want]


def test_the_largest_claim_is_not_listed(spark, monkeypatch):
    accepted = spark.createDataFrame(
        [("line", "supp", "supplier", "supp", "independent"), ("order", "nation", "supplier", "nation", "independent")],
        "cluster_1 string, key_1 string, cluster_2 string, key_2 string, kind string",
    )
    cases = [(c, "order", "nation", f"n:{c % 2}") for c in [None, *range(200)] if c is not None] + [(None, "order", "nation", "n:0")]
    cases += [(c, "line", "supp", f"n:{c % 20}") for c in range(200)] + [(c, "line", "supp", f"n:{(c + 1) % 20}") for c in range(200)] + [(None, "line", "supp", "n:2")]
    entries = [(f"s{s}", "supplier", k, f"n:{v}", 0) for s in range(20) for k, v in (("supp", s), ("nation", s % 2))]
    rows = spark.createDataFrame(cases, "case_id int, cluster string, key string, norm string")
    reference = spark.createDataFrame(entries, "doc_id string, cluster string, key string, norm string, entry_idx int")
    listed, join = [], correlate.salted_join

    def counted(*args):
        out = join(*args)
        listed.append(out.count())
        return out

    monkeypatch.setattr(correlate, "salted_join", counted)
    held = defaultdict(set)
    for case, cluster, _, norm in cases:
        held["supp" if cluster == "line" else "nation", norm].add(case)
    want = {f"s{s}": len(held["supp", f"n:{s}"] | held["nation", f"n:{s % 2}"]) for s in range(20)}
    assert {r["doc_id"]: r["n_cases"] for r in correlate.claim_counts(rows, reference, accepted).collect()} == want
    assert listed == [sum(len(held["supp", f"n:{s}"]) for s in range(20))]


def test_only_shared_values_are_combined(spark, monkeypatch):
    rows = [(f"o{i}", "order", k, v) for i in range(10) for k, v in (("id", f"n:{100 + i}"), ("buyer", f"n:{500 + i % 3}"))]
    rows += [(f"l{i}", "line", k, v) for i in range(10) for k, v in (("id", f"n:{100 + i}"), ("buyer", f"n:{500 + i % 3}"))]
    rows += [(f"l{i}", "line", "id", f"n:{9000 + 10 * i + j}") for i in range(10) for j in range(6)]
    frame = spark.createDataFrame(rows, "doc_id string, cluster string, key string, norm string")
    sizes, cut = [], correlate.cut_lineage

    def counted(df):
        if df.columns == ["doc_id", "cluster", "key", "norm"]:
            sizes.append(df.count())
        return cut(df)

    monkeypatch.setattr(correlate, "cut_lineage", counted)
    found = correlate.rule_overlap(frame, pairs.rule_counts(frame)).collect()
    assert [(r["n_a"] + r["n_b"], r["n_both"]) for r in found] == [(10 + 34, 10)]
    assert sizes == [20]


def test_values_combine_only_where_their_rules_meet(spark, monkeypatch):
    # Every id and buyer is shared, but no order holds both, except o9.
    rows = [(f"o{i}", "order", "id", f"n:{100 + i}") for i in range(5)] + [(f"o{i}", "order", "buyer", f"n:{500 + i}") for i in range(5, 9)]
    rows += [("o9", "order", "id", "n:109"), ("o9", "order", "buyer", "n:509")]
    rows += [(f"l{i}", "line", k, f"n:{v}") for i in range(10) for k, v in (("id", 100 + i), ("buyer", 505 + i % 5), ("buyer", 504))]
    frame = spark.createDataFrame(rows, "doc_id string, cluster string, key string, norm string")
    sizes, cut = [], correlate.cut_lineage

    def counted(df):
        if df.columns == ["doc_id", "cluster", "key", "norm"]:
            sizes.append(df.count())
        return cut(df)

    monkeypatch.setattr(correlate, "cut_lineage", counted)
    found = correlate.rule_overlap(frame, pairs.rule_counts(frame)).collect()
    assert [(r["n_a"], r["n_b"], r["n_both"]) for r in found] == [(10, 6, 1)] and sizes == [2]


def test_rules_beyond_a_mask_still_combine(spark):
    rows = [(d, c, k, "n:5") for d, c in (("a", "x"), ("b", "y")) for k in "klmnopqr"]
    frame = spark.createDataFrame(rows, "doc_id string, cluster string, key string, norm string")
    found = correlate.rule_overlap(frame, pairs.rule_counts(frame)).collect()
    assert len(found) == 64 * 63 // 2 and {r["n_both"] for r in found} == {1}


def test_a_lookup_is_not_broadcast_by_its_size_on_disk(spark):
    left, right = spark.range(5), spark.range(5).withColumn("v", F.lit(1))
    plan = _plan(skew.lookup_join(left, right, ["id"]))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_windows_get_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 5)
    rows = spark.range(100).select((F.col("id") % 50).alias("k"), "id")
    out = skew.neighbour(rows, ["k"], ["id"], {"id": "next"})
    assert out.rdd.getNumPartitions() == 20
    assert {(r["id"], r["next"]) for r in out.collect()} == {(i, i + 50 if i < 50 else None) for i in range(100)}
    assert skew.number_rows(rows, ["k"], ["id"], "no").rdd.getNumPartitions() == 20


def test_case_leaves_are_dealt_once(spark):
    leaf = spark.createDataFrame([], LEAF)
    found = relations.relation_instances(leaf)
    assert "hashpartitioning(case_id#" in _plan(found) and ", variant_id#" not in "".join(x for x in _plan(found).splitlines() if "hashpartitioning" in x)
    variants = spark.createDataFrame([], "case_id int, variant string, variant_count long")
    dealt = [x for x in _plan(relations.relation_counts(found, variants)).splitlines() if "hashpartitioning" in x and "case_id#" in x and "rule_type#" in x]
    assert not dealt


def test_files_are_parsed_once(spark):
    raw = spark.createDataFrame([("/a.xml", "<r><x>1</x></r>"), ("/b.xml", "<r><x>1</r>"), ("/c.json", '{"x": 1}')], "path string, value string")
    documents, rejects = parse_raw(raw, ANY_XML)
    assert documents.inputFiles() and documents.count() == 2 and rejects.count() == 1


def test_relations_get_tasks_by_rows(spark, monkeypatch):
    rows = [(c, v, t, 0, "k", t, None, False) for c in range(20) for v in ("n:5", "n:6") for t in ("a", "b")]
    leaf = spark.createDataFrame(rows, LEAF)
    plain = relations.evidence_documents(relations.relation_instances(leaf), leaf)
    want = sorted(map(str, plain.collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 8)
    found = relations.relation_instances(leaf)
    assert ", 10), REPARTITION_BY_NUM" in _plan(found)
    assert sorted(map(str, relations.evidence_documents(found, leaf).collect())) == want and len(want) == 80


def test_evidence_moves_once_by_case(spark, monkeypatch):
    day = lambda d: datetime(2024, 1, d)
    rows = [(1, "n:5", "a", 0, "k", "a0", t, False) for t in (day(3), None, day(2), day(2))]
    rows += [(1, "n:5", "b", 0, "k", d, None, False) for d in ("b0", "b0", None)] + [(None, "n:5", "b", 0, "k", "b1", None, False)]
    rows += [(1, f"n:{v}", "a", 0, "other", "a0", None, False) for v in range(100, 150)]
    leaf = spark.createDataFrame(rows, LEAF)
    found = cut_lineage(relations.relation_instances(leaf))
    out = relations.evidence_documents(found, leaf)
    dealt = {x.split("hashpartitioning(")[1] for x in _plan(out).splitlines() if "hashpartitioning(case_id#" in x}
    assert len(dealt) == 1 and "norm#" not in dealt.pop() and "SortMergeJoin" not in _plan(out)
    want = [("a0", 1, day(2)), ("b0", 2, None), (None, 2, None)]
    assert sorted(((r.doc, r.side, r.ts) for r in out.collect()), key=str) == sorted(want, key=str)
    # Cases with many rows, and values with many, take other routes.
    for least in (1, 20):
        monkeypatch.setattr(skew, "HOT_MIN_ROWS", least)
        again = relations.evidence_documents(relations.relation_instances(leaf), leaf)
        assert sorted(((r.doc, r.side, r.ts) for r in again.collect()), key=str) == sorted(want, key=str)


def test_cells_of_a_value_meet_in_one_pass(spark):
    rows = [(1, "n:5", t, v, k, f"{t}{v}", None, False) for t, v in (("a", 0), ("a", 1), ("b", 0)) for k in ("k", "l")]
    rows += [(c, n, t, 0, "k", t, None, False) for c, n in ((None, "n:5"), (1, None), (2, "n:9")) for t in ("a", "b") if (c, t) != (2, "b")]
    found = relations.relation_instances(spark.createDataFrame(rows + rows, LEAF))
    assert "Join" not in _plan(found)
    met = sorted((r["doc_1"], r["key_1"], r["doc_2"], r["key_2"]) for r in found.collect())
    pairs_of = [("a0", "a1"), ("a0", "b0"), ("a1", "b0")]
    assert met == sorted((x, k, y, j) for x, y in pairs_of for k in "kl" for j in "kl")


def test_variants_are_composed_once(spark):
    counts = spark.createDataFrame([(1, "a", 2), (2, "a", 2), (3, "a", 1), (3, "b", 0)], "case_id int, cluster string, n_own long")
    found = cases.case_variants(counts)
    assert found.inputFiles() and "Scan ExistingRDD" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, "a=2", 2), (2, "a=2", 2), (3, "a=1", 1)]


def test_no_join_runs_to_find_hot_documents(spark, monkeypatch):
    searched, search = [], skew.hot_and_rows
    monkeypatch.setattr(skew, "hot_and_rows", lambda df, cols, *rest: searched.append(_plan(df)) or search(df, cols, *rest))
    given = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 3)], "doc_1 int, doc_2 int")
    texts = spark.createDataFrame([(d, ["a", "b"][:d]) for d in (1, 2, 3)], "doc_id int, tokens array<string>")
    leaf = spark.createDataFrame([(d, k, "x", "STRING", None, "s:x") for d in (1, 2, 3) for k in "kl"], "doc_id int, key string, value string, vtype string, num double, norm string")

    def parts():
        words = {(r["doc_1"], r["doc_2"]): r["text"] for r in similarity.token_similarity(given, texts).collect()}
        alike = {(r["doc_1"], r["doc_2"]): (r["n_common"], r["attributes"]) for r in similarity.attribute_similarity(given, leaf).collect()}
        return words, alike

    plain = parts()
    assert plain == ({(1, 2): 0.5, (1, 3): 0.5, (2, 3): 1.0, (3, 3): 1.0}, dict.fromkeys([(1, 2), (1, 3), (2, 3), (3, 3)], (2, 1.0)))
    assert searched and not any("Join" in plan for plan in searched)
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 1)
    assert parts() == plain
