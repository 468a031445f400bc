"""Packing, neighbours, chat, archives and pages on small tables with awkward rows; the pipeline; registration."""

import base64
import glob
import gzip
import hashlib
import json
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docflow.llm import chat, html, neighbours, packing, queries, warc
from docflow.llm.common import shared_path

FOLDER = "/root/testdata/sf0.001"
TOKENIZERS = pytest.importorskip("public_tokenizers")


# Packing --------------------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = TOKENIZERS.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\nb c", "don't 's  \n x", "<|endoftext|> x <|endoftext|>y", "é 日本 語\t12 34", "x" * 5000, "a b c  d", "1 +2 -3"]
    words = packing.encoder(path)
    assert [np.frombuffer(packing.encode(t, words), "<u4").tolist() for t in texts] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_pieces_and_sequences(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(str(rng.randrange(1000)) for _ in range(rng.choice([0, 1, 5, 40, 90])))) for i in range(120)] + [(200, None), (201, ""), (202, "w " * 3000), (5, "again")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS rank")
    packed = packing.assign(packing.tokenize(frame, TOKENIZERS.path("byte_bpe_50k.json"), capacity=64), capacity=64)
    rows = packed.collect()
    by_sequence: dict[int, list] = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 256
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 64
    words = packing.encoder(TOKENIZERS.path("byte_bpe_50k.json"))
    for d, text in docs[:-1]:
        if d != 5:
            own = sorted((r.piece, r.start, r.ids) for r in rows if r.doc_id == d)
            assert b"".join(x[2] for x in own) == packing.encode(text or "", words) + bytes(4)
            assert all(len(x[2]) == 256 for x in own[1:])
    whole = {r.sequence_id: r.n_tokens for r in packing.sequences(packed).collect()}
    assert whole == {k: sum(n for _, n in v) for k, v in by_sequence.items()}
    assert packing.assign(packing.tokenize(frame.limit(0), TOKENIZERS.path("byte_bpe_50k.json"))).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(5.5, 1, 20000).astype(int), 1, 2047)
    histogram = np.bincount(lengths, minlength=2049)
    assert packing.plan(histogram).sequences <= -(-int(lengths.sum()) // 2048) * 1.01
    # One length holds most pieces, and a histogram without pieces has no sequence.
    assert packing.plan(np.bincount([1500] * 1000 + [548] * 10, minlength=2049)).sequences == 1000
    assert packing.plan(np.zeros(2049, dtype=int)).sequences == 0


# Neighbours -----------------------------------------------------------------------------------------------------------


def test_neighbours_recall_and_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16)) * 3
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(4000, None), (4100, [0.0] * 16), (4200, [float("nan")] * 16), (4300, [None] * 16), (4400, [1.0]), (None, [1.0] * 16)]
    rows += [(5000 + i, x[0].tolist()) for i in range(700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS part", "2 AS score")
    router = neighbours.fit(neighbours.usable(frame, "vec_id", "embedding"), rows_per_part=300)
    assert router.parts > 3
    got = neighbours.search(frame, frame.where("vec_id % 100 = 0"), router=router).toPandas()
    ids = np.array([i for i, v in rows if i is not None and not 4000 <= i < 5000])
    y = np.array([v for i, v in rows if i is not None and not 4000 <= i < 5000], dtype=np.float32).astype(float)
    assert set(got.query_id) == {i for i in ids if i % 100 == 0}
    hits = total = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        d = np.sqrt(((y - y[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert list(own["rank"]) == list(range(1, 11))
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id], rtol=0, atol=1e-12)
        assert list(zip(own.score, own.vec_id)) == sorted(zip(own.score, own.vec_id))
        hits, total = hits + len(set(own.vec_id) & set(ids[best])), total + 10
        if q == 0:
            assert list(own.vec_id) == list(range(5000, 5010))
    assert hits / total >= 0.9


def test_neighbours_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.search(few, few.where("vec_id = 0")).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 2)]
    assert neighbours.search(few.limit(0), few).count() == 0
    assert neighbours.search(few, few.limit(0)).count() == 0


# Chat -----------------------------------------------------------------------------------------------------------------

SCHEMAS = "tool string, param string, type string, required boolean, allowed array<string>"
MESSAGES = "conv_id long, turn long, role string, text string, call_id string, name string, arguments string, needs array<string>"


def test_chat_links_levels_and_errors(spark):
    tools = [("t", "q", "string", True, None), ("t", "n", "number", False, None), ("t", "k", "string", False, ["a", "b"]), ("none", None, None, None, None)]
    call = lambda turn, ident, args="{\"q\":\"x\"}", needs=(), name="t", conv=1: (conv, turn, "assistant", None, ident, name, args, list(needs))
    rows = [
        (1, 0, "user", "hi", None, None, None, None),
        call(1, "a"), call(2, "b", needs=["a", "zz"]), call(3, "c", needs=["b", "a"]), call(4, "a"), call(5, "x", needs=["y"]), call(6, "y", needs=["x"]), call(7, "z", needs=["x"]),
        call(8, None), call(9, "e1", '{"n":1.5,"k":"c"}'), call(10, "e2", '{"q":1,"n":2,"o":{}}'), call(11, "e3", "[1]"), call(12, "e4", None), call(13, "e5", '{"q":"x","q":"y"}'),
        call(14, "e6", "{}", name="none"), call(15, "e7", name="lost"),
        (1, 20, "tool", "r", "a", None, None, None), (1, 21, "tool", "r2", "a", None, None, None), (1, 22, "tool", "r", "qq", None, None, None), (1, 23, "tool", "r", None, None, None, None),
        (None, 1, "user", None, None, None, None, None), call(1, "a", conv=2),
    ]
    frame = spark.createDataFrame(rows, MESSAGES).selectExpr("*", "1 AS level", "2 AS status", "3 AS _tool")
    got = {(r.conv_id, r.turn): r for r in chat.format_chat(frame, spark.createDataFrame(tools, SCHEMAS)).collect()}
    assert len(got) == len(rows)
    states = {t: (r.status, r.level) for (c, t), r in got.items() if c == 1}
    assert states[0] == ("message", None)
    assert [states[t] for t in range(1, 9)] == [
        ("linked", 0), ("no_result", 1), ("no_result", 2), ("repeated_id", None), ("circular", None), ("circular", None), ("circular", None), ("no_id", None),
    ]
    assert [states[t][0] for t in range(20, 24)] == ["linked", "repeated_result", "no_call", "no_id"]
    errors = [got[1, t].errors for t in range(9, 16)]
    assert errors == [["missing:q", "value:k"], ["type:q", "unknown:o"], ["arguments"], ["arguments"], ["arguments"], [], ["tool"]]
    for r in got.values():
        line = json.loads(r.line)
        assert r.line == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[2, 1].status == "no_result"
    assert chat.format_chat(frame.limit(0), spark.createDataFrame(tools, SCHEMAS)).count() == 0


def test_canonical_json(spark):
    given = ['{"b": 1.50, "a": [ {"z":1, "y":null} ]}', "nope", None, "3"]
    got = spark.createDataFrame(list(enumerate(given)), "i int, x string").select("i", chat.canonical(F.col("x")).alias("c"))
    assert [r.c for r in got.orderBy("i").collect()] == ['{"a":[{"y":null,"z":1}],"b":1.5}', None, None, "3"]


# Archives -------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_archives_come_back_whole(spark):
    pages = [(i, f"http://x/{i}", "é" * (i % 7) + "\x1f\x08".join(str(i % 5))) for i in range(60)]
    pages += [(100, None, None), (101, "u", ""), (102, "a\r\nb", "x" * (17 << 20)), (103, "w", "WARC/1.1\r\n\r\n")]
    frame = spark.createDataFrame(pages, PAGES).repartition(3).selectExpr("*", "1 AS own", "2 AS refers_to")
    heads: dict[str, int] = {}
    for i, _, body in pages:
        heads[body or ""] = max(heads.get(body or "", -1), i)
    want = []
    for i, _, body in pages:
        raw, head = (body or "").encode(), heads[body or ""]
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), sha, "response" if head == i else "revisit", None if head == i else head))
    assert sorted(tuple(r) for r in warc.round_trip(frame).collect()) == sorted(want)
    folder = shared_path(spark, "archive")
    warc.write(frame, folder)
    files = glob.glob(f"{folder.removeprefix('file:')}/part-*")
    assert sum(gzip.decompress(open(f, "rb").read()).count(b"WARC-Type: ") for f in files) == len(pages)
    for split in (997, 1 << 20):
        found = warc.read(spark, folder, split_bytes=split).collect()
        assert sorted(r.record_id for r in found) == sorted(f"<urn:page:{i}>" for i, _, _ in pages)
        bodies = {r.record_id: bytes(r.payload) for r in found if r.type == "response"}
        assert all(bodies[f"<urn:page:{h}>"] == b.encode() for b, h in heads.items())


def test_archives_of_awkward_rows(spark):
    rows = [(None, None, "p"), (3, None, "p"), (3, None, "p"), (1, None, "p"), (None, None, "q")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (0, "revisit", 3), (1, "revisit", 3), (3, "response", 0), (3, "response", 0)]
    least = warc.round_trip(spark.createDataFrame(rows, PAGES), least_bytes=2).collect()
    assert {r.record_type for r in least} == {"response"}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


# Pages ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>one<br>two  <b>th</b>ree<p>&copy; x</article><footer>f</footer>", "T & U one two three"),
        ('<main><div class="ad">no</div>yes<form><input>no</form><aside>no</aside><script>if(a<b)"</p>"</script> <i>and</i> no<i></i>w</main>', "yes and now"),
        ("<article>A<table><tr><td>1<td>2</table><ul><li>k<li>l</ul></article><section id=comments><p>me too</section>", "A 1 2 k l"),
        ('<div id="content"><p title="a>b">x &#8364; y</p><div class="comment-list"><p>reply</p></div></div><div class=sidebar>s</div>', "x € y"),
        ("<p", ""),
    ],
)
def test_main_text_of_marked_pages(page, text):
    assert html.main_text(page) == text


def test_main_text_by_context():
    story = "The man who was in the house with his dog and the cat said that it was not for him to be there when they had it all, and so he went out to the garden and sat down. "
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><p>{story * 2}</p><p>He sat.</p><p>{story * 2}</p><div>© somebody</div><div>Imprint</div>"
    assert html.main_text(page) == " ".join(f"{story * 2} He sat. {story * 2}".split())


STORY = "The man who was in the house with his dog said that it was not for him to be there when they had it all, and so he went out to the garden and sat down by the water for an hour, as he had done on all the other days. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article style="overflow:hidden"><p>{}</article><footer>f</footer>', "{}"),
        ('<div data-hidden="1"><p>{}</div>', "{}"),
        ('<div class="banner-free no-sidebar"><p>{}</div><div class="sidebar">s</div>', "{}"),
        ("<head><title>t</title><body><p>{}", "{}"),
        ("<html><head><meta charset=x><style>b</style><div><p>{}</div>", "{}"),
        ('<div class="text-center">x y</div><p>{}<p>{}', "x y {} {}"),
        ('<div class="post-meta">by me</div><p>{}', "by me {}"),
        ('<nav><a href=1>Home</a></nav><div class="post-content">Short.</div><div role="main"><p>{}</div><p>' + "Order now. " * 9, "{}"),
        ("<article>Teaser</article><div><p>{}<p>{}</div>", "Teaser {} {}"),
        ("<div hidden>{}</div><p>{}", "{}"),
        ("<div><a href=1>One</a> <a href=2>two</a></div><h2>Day</h2><p>{}<div><a href=3>More</a></div>", "Day {}"),
    ],
)
def test_main_text_by_rules(page, text):
    assert html.main_text(page.replace("{}", STORY)) == " ".join(text.replace("{}", STORY).split())


def test_neighbours_against_brute_force():
    rng = random.Random(8)
    kinds = [(STORY, 0), (STORY[:120], 0), ("Short one", 0), ("Link", 4), (STORY, 200), ("zq " * 90, 0), ("!", 0)]
    for _ in range(400):
        page = [html.Block([text], linked, rng.random() < 0.1, False, rng.random() < 0.1, rng.random() < 0.2) for text, linked in rng.choices(kinds, k=rng.randrange(12))]
        first = html._first_pass(page, html.Rules())
        for weaker in (html.NEAR, html.SHORT):
            first = first if html.GOOD in first else [html.GOOD if x == weaker else x for x in first]
        decided = [i for i, x in enumerate(first) if x in (html.GOOD, html.BAD)]
        want = []
        for i, x in enumerate(first):
            left = max((j for j in decided if j < i), default=None)
            right = min((j for j in decided if j > i), default=None)
            good = [j for j in (left, right) if j is not None and first[j] == html.GOOD]
            bad = [j for j in (left, right) if j is not None and first[j] == html.BAD]
            if i in decided:
                want.append(x == html.GOOD)
            elif not good:
                want.append(False)
            else:
                nearer = not bad or abs(good[0] - i) < abs(bad[0] - i)
                want.append(nearer or x == html.NEAR or page[i].heading and right in good)
        assert html.labels(page) == want


def test_main_text_of_deep_and_long_pages():
    assert html.main_text("<div><b>" * 30000 + STORY) == STORY.strip()
    assert html.main_text(f"<p>{STORY}" * 20000) == " ".join([STORY.strip()] * 20000)


def test_extract_keeps_rows(spark):
    frame = spark.createDataFrame([(1, "u", "<article>é</article>"), (1, "u", "<article>é</article>"), (2, None, None)], PAGES).selectExpr("*", "1 AS TEXT")
    got = html.extract(frame)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, "é", 1), (1, "é", 1), (2, "", 0)]
    assert html.extract(frame.limit(0)).count() == 0


# Registration and pipeline --------------------------------------------------------------------------------------------


def test_all_operators_are_registered():
    found = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in found) == 1
    assert "pipeline" in found
    assert set(queries.oracle_sql()) <= set(found)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    assert want == sorted((tuple(r) for r in queries.queries()[name](spark, FOLDER).select(*columns).collect()), key=repr)


def test_pipeline_decisions_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80))
    a, b, leak, notice = text(), text(), text(), text()
    near = " ".join([*a.split()[:-1], "zzzzz"])
    rows = [(1, f"{a}\n{notice}"), (2, near), (3, b), (4, b), (5, "123"), (6, None), (7, f"{text()} {leak} {text()}"), (8, f"{text()}\n{notice}"), (9, "")]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(leak.split()[10:24]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = frame.columns
        frame = stage(spark, frame, str(tmp_path)).cache()
        assert frame.columns == columns or set(frame.columns) == set(columns)
        kept.append({r.doc_id for r in frame.collect()})
    assert kept[0] == {1, 2, 3, 4, 7, 8}
    assert kept[1] == {1, 2, 3, 7, 8}
    assert kept[3] == kept[2] - {7}
    assert {3, 8} <= kept[3]
    eight = frame.where("doc_id = 8").first()
    assert "\n" not in eight.text and eight.n_chars == len(eight.text)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept[3]
    again = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "piece", "length"]
    assert sorted(packed.select(columns).collect()) == sorted(again.select(columns).collect())


def test_line_dedup_writes_a_text_once(spark):
    import corpus_pipeline
    from docflow.llm.common import recorded

    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    left = []
    with recorded(left):
        found = corpus_pipeline.dedup_lines(spark, docs, "")
    assert found.columns == docs.columns and sorted(found.collect()) == sorted(docs.collect())
    assert sum(spark.read.parquet(path).schema.simpleString().count("text:string") for path in left) == 1


@pytest.mark.parametrize("n", [0, 3])
def test_stages_take_empty_tables_repeated_rows_and_clashing_columns(spark, tmp_path, n):
    import corpus_pipeline

    extra = "id long, line string, token long, _slot long, component_id string, score double, spans int"
    values = (7, "l", 8, 9, "c", 0.5, 1)
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, "en"), (1, text, "en"), (2, "other words stand in this text", None)][:n]
    docs = spark.createDataFrame([(*r, "s", 5, *values) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    items = [("a", "nothing of the kind"), ("b", None)] if n else []
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert set(kept.columns) == set(docs.columns)
        found = kept.collect()
        assert {r.doc_id for r in found} == ({1, 2} if n else set())
        assert all((r.id, r.line, r.token, r._slot, r.component_id, r.score, r.spans) == values for r in found)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ({1, 2} if n else set())
