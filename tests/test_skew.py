import random

import pytest
from pyspark.sql import functions as F

from docflow.operators.skew import hot_keys, lookup_join, neighbour, number_rows, salted_join


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        case = 0 if i % 3 == 0 else rnd.randrange(1, 60)
        rows.append((case, rnd.randrange(0, 40), i, rnd.choice("abc")))
    return spark.createDataFrame(rows, "case int, ts int, id int, act string").repartition(7)


def _expected(events):
    rows = sorted(events.collect(), key=lambda r: (r["case"], r["ts"], r["id"]))
    nxt, prv, pos = {}, {}, {}
    for i, row in enumerate(rows):
        same_next = i + 1 < len(rows) and rows[i + 1]["case"] == row["case"]
        same_prev = i > 0 and rows[i - 1]["case"] == row["case"]
        nxt[row["id"]] = rows[i + 1]["act"] if same_next else None
        prv[row["id"]] = rows[i - 1]["act"] if same_prev else None
        pos[row["id"]] = pos[rows[i - 1]["id"]] + 1 if same_prev else 1
    return nxt, prv, pos


def test_hot_keys_finds_the_large_case(spark, events):
    expected = events.where("case = 0").select(F.xxhash64("case")).first()[0]
    assert hot_keys(events, ["case"], min_rows=500) == [expected]
    assert hot_keys(events, ["case"]) == []


@pytest.mark.parametrize("min_rows", [None, 500, 20])
def test_neighbour_and_number_agree_on_every_route(events, min_rows):
    nxt, prv, pos = _expected(events)
    args = (["case"], ["ts", "id"])
    got = neighbour(events, *args, {"act": "near"}, 1, min_rows=min_rows).collect()
    assert {r["id"]: r["near"] for r in got} == nxt
    got = neighbour(events, *args, {"act": "near"}, -1, min_rows=min_rows).collect()
    assert {r["id"]: r["near"] for r in got} == prv
    got = number_rows(events, *args, "no", min_rows=min_rows).collect()
    assert {r["id"]: r["no"] for r in got} == pos


def test_joins_agree_on_every_route(spark, events):
    names = spark.createDataFrame([(c, f"n{c}") for c in range(0, 60, 2)], "case int, name string")
    plain = sorted(map(tuple, events.join(names, ["case"]).collect()))
    assert sorted(map(tuple, lookup_join(events, names, ["case"], min_rows=500).collect())) == plain
    twice = names.union(names.withColumn("name", F.lit("z")))
    plain = sorted(map(tuple, events.join(twice, ["case"]).collect()))
    hot = hot_keys(events, ["case"], min_rows=500)
    assert sorted(map(tuple, salted_join(events, twice, ["case"], hot, 4).collect())) == plain
