import json

import pytest
from pyspark.sql import functions as F

import scenarios
from docflow.functions import names
from docflow.functions.dates import normalize_date, parse_date
from docflow.functions.values import number_similarity, string_similarity
from docflow.operators import arrays, cases, curate, doctypes, leaves, objects
from docflow.sources import files
from docflow.streaming import stream_leaves, stream_raw

DOC = {
    "Bestellung": [
        {"Nr": 1, "Preis": 1.0, "Ok": True, "Leer": None, "Text": "1", "Tags": ["a", "b"], "Sub": {"Nr": 2}, "Nix": [], "Obj": {}}
    ]
}


def _docs(spark, *contents):
    rows = [(i, c if isinstance(c, str) else json.dumps(c, ensure_ascii=False)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "doc_id int, content string")


def test_leaves_carry_path_type_and_comparison_form(spark):
    got = {r["path"]: r for r in leaves.leaves(_docs(spark, DOC, "{broken")).collect()}
    assert set(got) == {
        f"Bestellung[0].{p}" for p in ("Nr", "Preis", "Ok", "Leer", "Text", "Tags[0]", "Tags[1]", "Sub.Nr")
    }
    norm = {p.removeprefix("Bestellung[0]."): r["norm"] for p, r in got.items()}
    assert norm["Nr"] == norm["Preis"] == norm["Ok"] == "n:1"
    assert norm["Text"] == "s:1" and norm["Leer"] == "z"
    assert got["Bestellung[0].Tags[1]"]["in_list"] and not got["Bestellung[0].Nr"]["in_list"]
    assert got["Bestellung[0].Sub.Nr"]["key"] == "Nr" and got["Bestellung[0].Sub.Nr"]["entry_idx"] == 0


def test_content_of_any_depth_is_opened(spark):
    deep = {"v": 7, "list": [{"id": 1}, {"id": 2}]}
    for i in range(20):
        deep = {"k": [deep, {"m": i}]} if i % 2 else {"k": deep}
    docs = _docs(spark, deep, {"a": 1}, {"text": "[[[{\"", "b": []})
    assert leaves.nesting(docs) == 33
    got = {r["key"]: r["value"] for r in leaves.leaves(docs).where("key != 'm'").collect()}
    assert got == {"v": "7", "id": got["id"], "a": "1", "text": "[[[{\""}
    assert leaves.leaves(docs).where("vtype = 'NESTED'").count() == 0
    profiles = {r["path"].rsplit(".", 1)[-1]: r["n_entries"] for r in arrays.array_profiles(docs).collect()}
    assert profiles["list"] == 2
    row = leaves.leaves(docs, levels=2).where("doc_id = 0").first()
    assert row["vtype"] == "NESTED"


def test_key_signature_of_mixed_arrays(spark):
    docs = _docs(spark, {"a": [{"b": 1}, 2]}, {"a": [{"b": {"c": 1}}, {"b": 2}]}, {"a": {}, "e": []})
    got = {r["doc_id"]: r["key_text"] for r in leaves.key_signature(docs).collect()}
    assert got == {0: "a b", 1: "a b c", 2: "a e"}


def test_broken_xml_is_rejected(spark):
    rows = [("/x/a1.xml", "<c><key>1</key><p><z>1</z><z>2</z></p></c>"), ("/x/a2.xml", "<c><key>1</key>"), ("/x/a3.xml", "not xml")]
    raw = spark.createDataFrame(rows, "path string, value string")
    documents, rejects = files.parse_raw(raw, "key STRING, p STRUCT<z: ARRAY<STRING>>", last_wins=True)
    assert [(r["title"], json.loads(r["content"])) for r in documents.collect()] == [("a1", {"key": "1", "p": {"z": "2"}})]
    assert sorted((r["path"], r["reason"]) for r in rejects.collect()) == [("/x/a2.xml", "malformed content"), ("/x/a3.xml", "malformed content")]


def test_claimed_entries_bring_what_lies_outside_arrays(spark):
    from docflow.plans.discover import Cases, case_leaves

    leaf = leaves.leaves(_docs(spark, {"Name": "n", "P": [{"id": 1}, {"id": 2}]}), ["doc_id"])
    claims = [("c1", 0, "P", True, True, 1, None, 0), ("c2", 0, "P", True, False, None, None, 0)]
    docs = spark.createDataFrame(
        claims, "case_id string, doc_id long, cluster string, is_shared boolean, is_partial boolean, entry_idx int, final_ts timestamp, variant_id long"
    )
    got = case_leaves(Cases(None, leaf, None, None, docs))
    assert sorted((r["case_id"], r["key"], r["norm"]) for r in got.collect()) == [("c1", "Name", "s:n"), ("c1", "id", "n:2"), ("c2", "Name", "s:n")]


def test_key_signature_and_structural_typing(spark):
    docs = _docs(spark, DOC, {"x": 1, "y y": [{"z": 1}, {"w": 2}]}, {"y y": [{"w": 5, "z": 2}], "x": 3})
    got = {r["doc_id"]: r["key_text"] for r in leaves.key_signature(docs).collect()}
    assert got[1] == got[2] == "w x y y z"
    assert got[0].split() == sorted({"Bestellung", "Nr", "Preis", "Ok", "Leer", "Text", "Tags", "Sub", "Nix", "Obj"})
    labels = {r["doc_id"]: r["cluster"] for r in doctypes.type_by_keys(leaves.key_signature(docs)).collect()}
    assert labels == {0: 0, 1: 1, 2: 1}  # a type is named by its smallest document


@pytest.mark.parametrize(
    "text,iso,strict",
    [
        ("02/01/2024", "2024-01-02 00:00:00", True),
        ("2024/01/02", "2024-01-02 00:00:00", True),
        ("02.01.2024", "2024-01-02 00:00:00", True),
        ("02.01.24", "2024-01-02 00:00:00", True),
        ("02.01.69", "1969-01-02 00:00:00", True),
        ("2024-01-02", "2024-01-02 00:00:00", True),
        ("2024-01-02T03:04:05", "2024-01-02 03:04:05", True),
        ("02.01.24 03:04:05", "2024-01-02 03:04:05", True),
        ("2024.01.02", "2024-01-02 00:00:00", False),
        ("2024-01-02 03:04:05", "2024-01-02 03:04:05", False),
        ("31.02.2024", None, True),
        ("02.01/2024", None, True),
        ("am 02.01.2024", None, True),
        ("hallo", None, True),
    ],
)
def test_dates(spark, text, iso, strict):
    t = F.lit(text)
    row = spark.range(1).select(
        parse_date(t).cast("string").alias("wide"), parse_date(t, False).cast("string").alias("narrow"), normalize_date(t).alias("n")
    ).first()
    assert row["wide"] == iso
    assert row["narrow"] == (iso if strict else None)
    assert row["n"] == (text if iso is None else f"{iso[8:10]}.{iso[5:7]}.{iso[:4]} {iso[11:]}")


def test_array_profiles_and_reference_flag(spark):
    same = {"K": [{"a": 1, "b": 2}, {"a": 3, "b": 4}, {"a": 5, "b": 6}]}
    near = {"K": [{"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}, {"a": 1, "b": 2, "c": 3, "d": 4}]}
    far = {"K": [{"a": 1, "b": 2}, {"a": 1, "c": 2}]}
    mixed = {"K": [{"a": 1, "P": [{"x": 1}, {"x": 2}]}]}
    docs = _docs(spark, same, near, far, mixed, {"K": [1, 2]}, {"K": [{"a": 1}, 5]})
    profiles = arrays.array_profiles(docs)
    by = {(r["doc_id"], r["path"]): r for r in profiles.collect()}
    assert set(by) == {(0, "K"), (1, "K"), (2, "K"), (3, "K"), (3, "K[0].P")}
    assert by[(1, "K")]["is_uniform"] and by[(1, "K")]["missing_keys"] == ["e"]
    assert not by[(2, "K")]["is_uniform"] and by[(2, "K")]["extra_keys"] == ["c"]
    assert not by[(3, "K")]["is_uniform"] and by[(3, "K[0].P")]["is_uniform"]
    flags = {r["doc_id"]: (r["is_reference"], r["arrays_found"]) for r in arrays.document_structure(docs, profiles).collect()}
    assert flags == {0: (True, 3), 1: (True, 2), 2: (False, 1), 3: (False, 1), 4: (False, 1), 5: (False, 1)}


def test_find_value_and_partial_content(spark):
    docs = _docs(spark, {"K": [{"Kunden_Nr": 5, "N": "x"}, {"Kunden_Nr": 6, "N": "y"}]})
    leaf = leaves.leaves(docs)
    assert leaves.find_value(leaf, "kunden-nr").first()["value"] == "5"
    part = leaves.entry_leaves(leaf, "K.Kunden_Nr", "n:6")
    assert sorted(r["value"] for r in part.collect()) == ["6", "y"]
    assert json.loads(leaves.entry_at(docs, "K", 1).first()["entry"]) == {"Kunden_Nr": 6, "N": "y"}
    assert leaves.entry_at(docs, "K", 9).first()["entry"] is None


def test_document_time_is_the_median(spark):
    rows = [(1, "2024-01-01"), (1, "2024-01-03"), (2, "2024-01-01"), (2, "2024-01-02"), (2, "2024-01-09")]
    stamps = spark.createDataFrame(rows, "doc_id int, d string").select("doc_id", F.to_timestamp("d").alias("ts"))
    got = {r["doc_id"]: str(r["final_ts"]) for r in leaves.document_time(stamps).collect()}
    assert got == {1: "2024-01-02 00:00:00", 2: "2024-01-02 00:00:00"}


def test_names(spark):
    row = spark.range(1).select(
        names.type_name(F.lit("/in/Bestellung12.json")).alias("t"),
        names.activity_inputs(F.lit("(('A', 'B'), ('C'))")).alias("i"),
        names.activity_outputs(F.lit("(('A', 'B'), ('C'))")).alias("o"),
        names.activity_inputs(F.lit("other")).alias("none"),
        names.target_type(F.lit("(('A'), ('None', 'C'))")).alias("last"),
        names.target_type(F.lit("('A')")).alias("single"),
        string_similarity(F.lit("abcd"), F.lit("abxd")).alias("s"),
        number_similarity(F.lit(10.0), F.lit(8.0)).alias("n"),
    ).first()
    assert (row["t"], row["i"], row["o"], row["none"]) == ("Bestellung", ["A", "B"], ["C"], None)
    assert (row["last"], row["single"], row["s"], round(row["n"], 9)) == ("C", "A", 0.75, 0.8)


def test_object_types_and_categories(spark):
    docs = _docs(spark, {"a": 1, "b": "x"}, {"a": 2.5}).withColumn("doc_type", F.lit("T"))
    got = {r["attribute"]: (r["types"], r["required"]) for r in objects.attributes(leaves.leaves(docs, ["doc_type", "doc_id"])).collect()}
    assert got == {"a": ("number", True), "b": ("string", False)}
    assert "a" in objects.type_schemas(docs).first()["schema"]
    rows = [("one", 1), ("one", 1), ("many", 2), ("none", 0), ("mix", 1), ("mix", 0)]
    cats = objects.categories(spark.createDataFrame(rows, "doc_type string, n_cases int")).collect()
    assert {r["doc_type"]: r["category"] for r in cats} == {
        "one": "process_instance", "many": "process_instance_independent", "none": "independent", "mix": "mixed",
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    for _, path, content in scenarios.documents("loop"):
        target = root / path.removeprefix("/in/")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content, encoding="utf-8")
    (root / "x.xml").write_text("<Auftrag id='9'><Nr>5</Nr><Pos>a</Pos><Pos>b</Pos></Auftrag>", encoding="utf-8")
    (root / "note.txt").write_text("only text", encoding="utf-8")
    (root / "bad.json").write_text('{"a": ', encoding="utf-8")
    (root / "skip.csv").write_text("a,b", encoding="utf-8")
    return str(root)


def test_folder_is_read_with_rejects(spark, folder):
    raw = files.read_raw(spark, folder)
    schema = files.infer_xml_schema(spark, folder, "Auftrag")
    documents, rejects = files.parse_raw(raw, schema)
    assert documents.count() == 10 + 2 + 1
    assert {r["reason"] for r in rejects.collect()} == {"unsupported extension", "malformed content"}
    xml = documents.where("kind = 'xml'").first()["content"]
    assert json.loads(xml) == {"Nr": "5", "Pos": ["a", "b"]}
    last = files.parse_raw(raw, schema, last_wins=True)[0].where("kind = 'xml'").first()["content"]
    assert json.loads(last) == {"Nr": "5", "Pos": "b"}
    assert documents.where("file_size > 0 AND modified_at IS NOT NULL").count() == 13


def test_export_round_trip(spark, folder, tmp_path):
    documents, _ = files.parse_raw(files.read_raw(spark, folder))
    labels = doctypes.group_by_names(documents)
    assert {r["name"] for r in labels.collect()} == {"bestellung", "rechnung", "zahlung", "kunden", "produkte"}
    files.export_json(labels, str(tmp_path / "j"))
    files.export_parquet(labels, str(tmp_path / "p"), by=["name"])
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 12


def test_stream_of_files_gives_the_same_leaves(spark, folder, tmp_path):
    batch = leaves.leaves(files.parse_raw(files.read_raw(spark, folder))[0]).select("path", "norm")
    writer = stream_leaves(
        files.parse_raw(stream_raw(spark, folder))[0],
        lambda found, _: found.select("path", "norm").write.mode("append").parquet(str(tmp_path / "out")),
    )
    query = writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_typing_by_clusters(spark):
    words = [("rechnung betrag steuer",), ("bestellung produkt menge",), ("kunde name adresse",)] * 6
    docs = spark.createDataFrame([(i, w[0]) for i, w in enumerate(words)], "doc_id int, key_text string")
    vectors = doctypes.tfidf(doctypes.tokens(docs))
    from docflow.config import Params

    few = Params(max_clusters=4, restarts=3)
    sweep = doctypes.sweep_k(vectors, few).collect()
    assert [r["k"] for r in sweep] == [2, 3, 4] and all(-1 <= r["silhouette"] <= 1 for r in sweep)
    assert [r["k"] for r in sweep if r["is_best"]] == [3]
    labels = {r["doc_id"]: r["cluster"] for r in doctypes.label_documents(vectors, 3, few).collect()}
    assert labels == {i: i % 3 for i in range(18)}


def test_case_tables_and_curation(spark):
    rows = [(1, "a", "X", 1), (1, "b", "X", 1), (1, "c", "Y", 2), (2, "d", "X", 1), (2, "e", "X", 3), (2, "f", "Y", 4), (3, "g", "X", 1)]
    docs = spark.createDataFrame(rows, "case_id int, doc_id string, cluster string, t int").select(
        "case_id", "doc_id", "cluster", F.timestamp_seconds(F.col("t") * 86400).alias("final_ts"), F.lit(False).alias("is_shared")
    )
    variants = {r["case_id"]: (r["variant"], r["variant_count"]) for r in cases.case_variants(cases.composition(docs)).collect()}
    assert variants == {1: ("X=2,Y=1", 2), 2: ("X=2,Y=1", 2), 3: ("X=1", 1)}
    index = {r["doc_id"]: (r["variant_id"], r["multiple"]) for r in cases.repeat_index(docs).collect()}
    assert index["a"] == (0, True) and index["b"] == (1, True) and index["e"] == (1, False)
    stats = {r["case_id"]: r["range_days"] for r in cases.case_stats(docs).collect()}
    assert stats == {1: 1, 2: 3, 3: 0}
    labels = docs.select("doc_id", "cluster", F.lit(False).alias("is_reference"))
    moved = spark.createDataFrame([("a", "Z", True), ("c", "X", None)], "doc_id string, new_cluster string, new_reference boolean")
    got = {r["doc_id"]: (r["cluster"], r["is_reference"]) for r in curate.reassign(labels, moved).collect()}
    assert got["a"] == ("Z", True) and got["c"] == ("X", False) and got["b"] == ("X", False)
