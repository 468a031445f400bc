import random
from collections import defaultdict
from itertools import combinations

import pytest

from docflow.operators.graph import components
from docflow.operators.pairs import (
    cross_pair_counts,
    members,
    rule_counts,
    same_key_counts,
    same_type_pair_counts,
    value_blocks,
)
from docflow.operators.correlate import corroborated, key_classes, links, rule_overlap

COMMON = {"s:yes", "s:no", "n:1", "n:0", "z"}


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    rows = set()
    for doc in range(60):
        cluster = "ABC"[doc % 3]
        rows.add((doc, cluster, "id", f"n:{rnd.randrange(2, 30)}"))
        rows.add((doc, cluster, "flag", rnd.choice(["s:yes", "s:no", "n:7"])))
        for _ in range(rnd.randrange(0, 5)):
            rows.add((doc, cluster, "item", f"n:{rnd.choice([1, 7, rnd.randrange(2, 25)])}"))
        if cluster != "B":
            rows.add((doc, cluster, "other", f"n:{rnd.randrange(2, 12)}"))
    frame = spark.createDataFrame(sorted(rows), "doc_id int, cluster string, key string, norm string")
    return rows, frame


def _rules(rows):
    by_doc = defaultdict(set)
    cluster = {}
    for doc, c, key, norm in rows:
        by_doc[doc].add((key, norm))
        cluster[doc] = c
    pairs = defaultdict(set)
    for a, b in combinations(sorted(by_doc), 2):
        if cluster[a] == cluster[b]:
            continue
        if cluster[a] > cluster[b]:
            a, b = b, a
        for k1, v1 in by_doc[a]:
            for k2, v2 in by_doc[b]:
                if v1 == v2:
                    kind = "SAME_KEY_VALUE_PAIR" if k1 == k2 else "SAME_COMMON_VALUE" if v1 in COMMON else "SAME_VALUE"
                    pairs[(cluster[a], k1, cluster[b], k2, kind)].add((a, b))
    return pairs


@pytest.mark.parametrize("heavy,short", [(1000, 8), (1000, 2), (2, 1), (0, 3)])
def test_rule_counts_match_brute_force(data, heavy, short):
    rows, frame = data
    expected = {k: len(v) for k, v in _rules(rows).items()}
    got = {tuple(r)[:5]: r["n"] for r in rule_counts(frame, heavy, short=short).collect()}
    assert got == expected


@pytest.mark.parametrize("heavy,short", [(1000, 8), (1000, 2), (1, 1)])
def test_same_type_counts_match_brute_force(spark, data, heavy, short):
    rows, _ = data
    scoped = [(doc % 2, doc, c, k, v) for doc, c, k, v in rows]
    frame = spark.createDataFrame(scoped, "case_id int, doc_id int, cluster string, key string, norm string")
    held = defaultdict(set)
    for case, doc, c, k, v in scoped:
        held[(case, c, k, doc)].add(v)
    expected = defaultdict(int)
    for a, b in combinations(held, 2):
        if a[:3] == b[:3] and held[a] & held[b]:
            expected[a[:3]] += 1
    got = {tuple(r)[:3]: r["n"] for r in same_type_pair_counts(frame, ["case_id"], heavy, short).collect()}
    assert got == dict(expected)


def test_overlap_matches_brute_force(data):
    rows, frame = data
    rules = rule_counts(frame)
    pairs = {k: v for k, v in _rules(rows).items() if k[4] != "SAME_COMMON_VALUE"}
    expected = {}
    for a, b in combinations(pairs, 2):
        if (a[0], a[2]) == (b[0], b[2]):
            both = len(pairs[a] & pairs[b])
            key = frozenset([(a[1], a[3], a[4]), (b[1], b[3], b[4])])
            expected[(a[0], a[2], key)] = (both, round(both / len(pairs[a] | pairs[b]), 9))
    got = {}
    for r in rule_overlap(frame, rules).collect():
        key = frozenset([(r["key_1_a"], r["key_2_a"], r["rule_type_a"]), (r["key_1_b"], r["key_2_b"], r["rule_type_b"])])
        got[(r["cluster_1"], r["cluster_2"], key)] = (r["n_both"], round(r["jaccard"], 9))
    assert got == expected
    good = {(a, b) for (a, b, _), (_, j) in expected.items() if j > 0.5}
    assert {(r[0], r[2]) for r in corroborated(rule_overlap(frame, rules)).collect()} == good


def test_blocks_and_same_key(data):
    rows, frame = data
    blocks = value_blocks(frame).collect()
    assert all(r["n_docs_1"] > 0 and r["n_docs_2"] > 0 and r["cluster_1"] < r["cluster_2"] for r in blocks)
    for r in same_key_counts(frame).collect():
        assert 0 <= r["n_equal"] <= r["n_pairs"]


def test_key_classes_match_brute_force(data):
    rows, frame = data
    held = defaultdict(lambda: defaultdict(set))
    for doc, _, key, norm in rows:
        held[key][doc].add(norm)
    for r in key_classes(frame).collect():
        docs = held[r["key"]]
        overlaps = [len(docs[a] & docs[b]) / min(len(docs[a]), len(docs[b])) for a, b in combinations(docs, 2)]
        assert r["n_docs"] == len(docs)
        assert r["overlap"] == pytest.approx(sum(overlaps) / len(overlaps))


@pytest.mark.parametrize("min_rows", [None, 5])
def test_links_give_the_components_of_all_pairs(spark, data, min_rows):
    rows, frame = data
    accepted = spark.createDataFrame(
        [("A", "id", "B", "id"), ("B", "id", "C", "id"), ("A", "other", "C", "id")],
        "cluster_1 string, key_1 string, cluster_2 string, key_2 string",
    )
    accepted_set = {tuple(r) for r in accepted.collect()}
    parent = {doc: doc for doc, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for rule, pairs in _rules(rows).items():
        if rule[:4] in accepted_set:
            for a, b in pairs:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    expected = {doc: root(doc) for doc in parent}
    edges = links(frame, accepted, min_rows=min_rows)
    nodes = frame.selectExpr("doc_id as node")
    got = {r["node"]: r["component"] for r in components(edges, nodes, min_rows).collect()}
    assert got == expected


def test_long_chain_components(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "src int, dst int")
    labels = components(edges).collect()
    assert len(labels) == n and {r["component"] for r in labels} == {0}


def test_members_leave_list_scalars_out(spark):
    leaf = spark.createDataFrame(
        [(1, "A", "k", "n:1", "LONG", False), (1, "A", "k", "n:2", "LONG", True), (1, "A", "k", "n:1", "LONG", False)],
        "doc_id int, cluster string, key string, norm string, vtype string, in_list boolean",
    )
    assert [tuple(r) for r in members(leaf).collect()] == [(1, "A", "k", "n:1")]
    assert cross_pair_counts(members(leaf)).count() == 0
