"""Language, lines, near duplicates, decontamination and repeated substrings on small tables with awkward rows."""

import hashlib
import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from docflow.llm import language, lines, near_duplicates, postings, queries, suffixes

DOCS = "doc_id long, text string, lang string"
ENGLISH = "the cat and the dog were in the garden with the old man and his friends"
GERMAN = "der Hund und die Katze waren in dem Garten mit dem alten Mann und seinen Freunden"


def _words(rng, n, base=40):
    return " ".join(f"w{rng.randrange(base)}" for _ in range(n))


# Language -------------------------------------------------------------------------------------------------------------


def test_language_of_awkward_texts(spark):
    rows = [(i, f"{ENGLISH} {i}", "en") for i in range(20)] + [(100 + i, f"{GERMAN} {i}", "de") for i in range(20)]
    model = language.fit(spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None)], DOCS))
    assert set(model.languages) == {"en", "de"}
    asked = [(1, "The dog and the man", "zz"), (2, "Die Katze und der Mann", None), (3, None, "en"), (4, "", "en"), (5, "12 !?", "en"), (1, "The dog and the man", "zz")]
    got = language.predict(spark.createDataFrame(asked, DOCS).selectExpr("*", "1 AS SCORE", "'q' AS extra"), model)
    assert got.columns == ["doc_id", "text", "lang", "extra", "lang_pred", "score"]
    found = sorted((r.doc_id, r.lang_pred) for r in got.collect())
    assert found == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_language_without_labels(spark):
    model = language.fit(spark.createDataFrame([], DOCS))
    got = language.predict(spark.createDataFrame([(1, "some text", None)], DOCS), model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_language_scores_take_little_memory():
    texts = ["ein kurzer satz mit vielen worten " * 60] * 4000
    model = language.LanguageFilters(("en", "de"), np.full((1, 1 << language.SLOT_BITS), 2, dtype=np.uint64), np.zeros(2))
    tracemalloc.start()
    names, _ = language._scores(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(names) == {"de"} and peak < 40e6


def test_language_long_text_and_many_languages(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02d}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choices(words, k=30)), lang) for i, (lang, words) in enumerate(own.items()) for _ in range(3)]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    assert model.masks.shape[0] == 2
    long = " ".join(own["l69"]) + " "
    got = language.predict(spark.createDataFrame([(1, long * 60_000, None), (2, long, None)], DOCS), model).collect()
    assert {r.lang_pred for r in got} == {"l69"}


# Lines ----------------------------------------------------------------------------------------------------------------


def _brute_lines(docs, run, long):
    places = []
    for k, (doc_id, text) in enumerate(docs):
        own = [(i, line) for i, line in enumerate((text or "").split("\n")) if line.strip()] if text is not None else []
        places += [(tuple(x for _, x in own[i : i + run]), (doc_id, k, i), [p for p, _ in own[i : i + run]]) for i in range(len(own) - run + 1)]
        places += [((x,), (doc_id, k, i), [p]) for i, (p, x) in enumerate(own) if len(x) >= long]
    first, gone = {}, {}
    for content, place, _ in sorted(places, key=lambda x: x[1]):
        first.setdefault(content, place)
    for content, place, covers in places:
        if first[content] != place:
            gone.setdefault(place[1], set()).update(covers)
    return [
        (d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())), len(gone.get(k, ())))
        for k, (d, t) in enumerate(docs)
    ]


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", "  ", "x" * 30, "y" * 30]) for _ in range(rng.randrange(14)))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "\n\n\n"), (53, docs[3][1]), (54, "a\n" * 2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).selectExpr("*", "1 AS _row", "2 AS _ID", "3 AS N_lines")
    got = lines.dedup(frame, run=3, long=30)
    assert got.columns == ["doc_id", "text", "_row", "_ID", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got.collect() if r.text is not None) == sorted(x for x in _brute_lines(docs, 3, 30) if x[1] is not None)
    assert [r.n_lines for r in got.where("doc_id = 50").collect()] == [0]


def test_lines_of_equal_rows_and_empty_table(spark):
    rows = [(1, "x\ny\nz"), (1, "x\ny\nz"), (None, "x\ny\nz")]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.n_removed for r in got.collect()) == [0, 3, 3]
    assert [r.doc_id for r in got.where("n_removed = 0").collect()] == [None]
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Near duplicates ------------------------------------------------------------------------------------------------------


def _shingles(text, k):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _brute_components(docs, k):
    sets = [(d, _shingles(t, k)) for d, t in docs]
    head = {d: d for d, _ in docs}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((root(a), root(b)))
            head[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets)


@pytest.mark.parametrize("method", [{}, {"small": 64, "few": 64}, {"small": 2}, {"few": 0}])
def test_near_duplicates_against_brute_force(spark, monkeypatch, method):
    if method.get("few") == 0:  # blocks of a few members, some sets too long to come along
        monkeypatch.setattr(near_duplicates, "BLOCK_MEMBERS", 7)
        monkeypatch.setattr(near_duplicates, "CARRIED_BYTES", 1200)
        monkeypatch.setattr(near_duplicates, "NAMED_NODES", 3)
    rng = random.Random(2)
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "word " * 5000)]
    for family in range(12):
        base = _words(rng, 60, 400).split()
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(12)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    docs += [(1000 + i, docs[20][1].upper()) for i in range(30)]
    method = near_duplicates.Method(words=2, **method)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS id", "2 AS path")
    got = near_duplicates.link(frame, method)
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got.collect()) == _brute_components(docs, 2)
    kept = near_duplicates.keep_one(frame, method)
    assert sorted(kept.columns) == ["doc_id", "id", "path", "text"]
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in _brute_components(docs, 2)}


def test_near_duplicates_of_missing_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "A b c d e f")]
    got = near_duplicates.link(spark.createDataFrame(rows, "doc_id long, text string"), near_duplicates.Method(words=2))
    assert sorted((r.id or 0, r.component_id or 0) for r in got.collect()) == [(0, 0), (7, 7), (7, 7), (8, 7)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates.link(empty).count() == 0
    assert near_duplicates.keep_one(empty).count() == 0


@pytest.mark.parametrize("depth", [3, 9, 15])
def test_near_duplicates_trees_keep_pairs_of_a_family_of_thousands(depth):
    rng = np.random.default_rng(8)
    shared, method, trees, met = rng.integers(0, 1 << 63, 70, dtype=np.uint64), near_duplicates.Method(), [], set()
    sets = []
    for _ in range(1000):
        both = np.concatenate((shared, rng.integers(0, 1 << 63, 19, dtype=np.uint64)))
        sets += [np.unique(np.concatenate((both, rng.integers(0, 1 << 63, 11, dtype=np.uint64)))) for _ in "ab"]
    for at in range(method.depth, depth + 1, method.depth):
        trees.append(max(method.more_trees(trees, at), 0 if trees else method.trees))
    for draw, n in enumerate(trees):
        hashed = near_duplicates._hashed(2018, draw) if draw else (near_duplicates._FACTORS, near_duplicates._SHIFTS)
        tokens = near_duplicates._minwise(sets, *hashed)[:, : near_duplicates.TOKENS]
        paths = near_duplicates._rooted(tokens, range(sum(trees[:draw]), sum(trees[:draw]) + n), depth)
        met |= {i for i in range(1000) if len(np.intersect1d(paths[2 * i], paths[2 * i + 1]))}
    assert len(met) >= 998


def test_near_duplicates_trees_meet_the_recall_at_every_depth():
    method = near_duplicates.Method()
    trees = []
    for depth in range(3, 31, 3):
        trees.append(max(method.more_trees(trees, depth), 0 if trees else method.trees))
        assert method.missed(trees, depth) <= 1 - method.recall
    assert trees[0] >= 10


# Decontamination ------------------------------------------------------------------------------------------------------


def _brute_hits(docs, items, n):
    out = []
    for d, t in docs:
        w, hit, own = postings.words(t), set(), set()
        for item, text in items:
            for window in postings._windows(postings.words(text), n):
                for i in range(len(w) - len(window) + 1):
                    if w[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        own.add(str(item))
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(own), sha, bool(hit)))
    return sorted(out)


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, _words(rng, rng.randrange(0, 14), 6)) for i in range(12)] + [(50, None), (51, "?!"), (9, items_text := "W1 w2")]
    docs = [(i, _words(rng, rng.randrange(0, 60), 6)) for i in range(30)] + [(40, None), (41, ""), (42, items_text + ", W1-w2!"), (43, "é w1 w2")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS bad_id", "2 AS term")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (postings.BLOCK_WORDS, 10):
        monkeypatch.setattr(postings, "BLOCK_WORDS", block)
        found = postings.digest(postings.search(postings.build_index(frame), bench, n=4)).collect()
        assert sorted((int(r.id), *r[1:]) for r in found) == _brute_hits(docs, items, 4)
    clean = postings.decontaminate(frame, bench, n=4)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in _brute_hits(docs, items, 4) if not x[5]}


def test_decontamination_by_proximity_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a x x x b x x x c"), (3, "c b a")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    near = postings.search(postings.build_index(docs), bench, span=5).where("size(items) > 0")
    assert {r.id: [tuple(s) for s in r.spans] for r in near.collect()} == {"1": [(0, 5)], "3": [(0, 3)]}
    assert postings.decontaminate(docs, bench.limit(0)).count() == 3
    assert postings.search(postings.build_index(docs.limit(0)), bench).count() == 0


# Repeated substrings --------------------------------------------------------------------------------------------------


def _brute_substrings(docs, n):
    seen = Counter()
    bodies = [(d, (t or "").encode()) for d, t in docs]
    for _, b in bodies:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for d, b in bodies:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i + 1 : i + 1 + n] = True
        inner = gone[1 : len(b) + 1]
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(inner.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~inner].tobytes()).hexdigest()))
    return sorted(out)


def test_substrings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 500)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(200)) for _ in range(5)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(4)):
            a = rng.randrange(150)
            parts.append(rng.choice(base)[a : a + rng.randrange(1, 150)] + "".join(rng.choice("abc") for _ in range(rng.randrange(30))))
        docs.append((i, "".join(parts)))
    docs += [(60, None), (61, ""), (62, "a" * 1500), (63, "ab" * 100), docs[4], docs[4], (64, docs[6][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS gram", "2 AS id")
    got = suffixes.dedup(frame, length=40, gram=20)
    want = _brute_substrings(docs, 40)
    assert sum(x[2] for x in want) > 1000
    assert sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())
    assert suffixes.dedup(frame.limit(0)).count() == 0


def test_substrings_planted_in_documents(spark, tmp_path):
    # Passages of over 50 words that documents share: those of 400 bytes go, shorter ones stay, and n_bytes tells neither.
    rng = random.Random(7)
    prose = lambda n, letters: " ".join("".join(rng.choice("abcdefghij") for _ in range(letters)) for _ in range(n))
    around = lambda passage="": f"{prose(rng.randrange(20, 90), 6)} {passage} {prose(rng.randrange(20, 90), 6)}"
    long, short = [prose(60, 7) for _ in range(8)], [prose(60, 4) for _ in range(8)]
    texts = {"long": [around(p) for p in long for _ in range(3)], "short": [around(p) for p in short for _ in range(3)], "clean": [around() for _ in range(30)]}
    docs = list(enumerate(t for kind in texts.values() for t in kind))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op9_repeated_substrings(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == _brute_substrings(docs, 400)
    assert [n_bytes for _, n_bytes, *_ in got] == [len(t) for _, t in docs]
    assert all(n_removed >= len(long[0]) and n_spans == 1 for _, _, n_removed, n_spans, _ in got[:24])
    assert all(n_removed == 0 for _, _, n_removed, *_ in got[24:])


def test_substrings_of_a_passage_in_many_texts(spark):
    # As contexts: one gram and right side, every left side its own.
    rows = [(7, i, 100, b"%0100d" % i, b"r" * 500) for i in range(3000)] + [(8, 1, 100, b"l" * 100, b"s" * 500)]
    contexts = spark.createDataFrame(rows, "gram long, context long, before int, left binary, right binary")
    assert sorted((r.gram, r.n, bytes(r.right)) for r in suffixes.right_sides(contexts).collect()) == [(7, 3000, b"r" * 500), (8, 1, b"s" * 500)]
    assert suffixes._group_reaches([(7, 1, 3000, b"r" * 500)], 200, False, False).column(2).to_pylist() == [500]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    asked = []

    def batches():
        for i in range(0, 3000, 100):
            asked.append(i)
            columns = zip(*[(*r, 500) for r in rows[i : i + 100]], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list("abcdef"))

    starts = suffixes._bounded_starts(400)(batches())
    assert next(starts).num_rows == 100 * 201 and asked == [0]
    assert sum(b.num_rows for b in starts) == 2900 * 201


def test_suffix_sorting():
    rng = random.Random(6)
    for _ in range(300):
        depth, n = rng.choice([0, 3]), rng.randrange(1, 30)
        items = [b"q" * depth + bytes(rng.choice(b"ab") for _ in range(rng.randrange(rng.choice([3, 20, 60])))) for _ in range(n)]
        for ranked in (suffixes.deep_shallow(items, depth, rng.choice([0, 16])), suffixes.blind_trie(items, list(range(n)), depth)):
            order = [items[k] for k, _ in ranked]
            assert order == sorted(items)
            assert [p for _, p in ranked[1:]] == [suffixes.common_prefix(a, b) for a, b in zip(order, order[1:])]
