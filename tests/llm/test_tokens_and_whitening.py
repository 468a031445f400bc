"""Token counts, cross-tokenizer alignment and whitening against the libraries and brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from docflow.llm import alignment, packing, token_counts, whitening

TOKENIZERS = pytest.importorskip("public_tokenizers")
LEFT, RIGHT = TOKENIZERS.path("byte_bpe_50k.json"), TOKENIZERS.path("piece_bpe_32k.model")

BITS = [*"aaeerstvlmd'''   \n\t012!<|>.,", "'s", "'re", "'ll", "'ve", "<|endoftext|>", "<|endof", "é", "ß", "日本", "\xa0", "　", "😀", "ization", "   ", " '", "▁", "\x00", "<0x41>"]


def scraps(seed: int, n: int, longest: int = 60) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(longest))) for _ in range(n)]


def library_counts(texts):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(LEFT)
    return [len(e.ids) for e in library.encode_batch(list(texts), add_special_tokens=False)]


# Token counts ---------------------------------------------------------------------------------------------------------


def test_transducer_counts_like_the_library():
    machine = token_counts.Transducer(LEFT)
    texts = scraps(1, 4000) + ["", " ", "'", "x" * 3000, "<|endoftext|>" * 3, " 's", "a  b", "\n\n x", "ꟍ\U000105c0's"]
    assert [machine.count(t.encode()) for t in texts] == library_counts(texts)
    # Characters of every class beside letters, digits and an apostrophe.
    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    texts = [form % c for form in ("a%s", "%s1", "%s's", " %s ") for c in chars]
    assert [machine.count(t.encode()) for t in texts] == library_counts(texts)


def test_state_maps_compose_in_any_order():
    machine = token_counts.Transducer(LEFT)
    rng = random.Random(2)
    texts = [t for t in scraps(3, 1500) if t]
    for text, expected in zip(texts, library_counts(texts), strict=True):
        data, size = text.encode(), rng.randrange(1, 12)
        maps = [token_counts.state_map(machine, data[i : i + size]) for i in range(0, len(data), size)]
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [token_counts.compose(machine, maps[i], maps[i + 1])]
        assert token_counts.total(machine, maps[0]) == expected


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "MOST_WORDS", 5)
    machine = token_counts.Transducer(LEFT)
    texts = scraps(4, 200)
    for text, expected in zip(texts, library_counts(texts), strict=True):
        machine.trim()
        assert machine.count(text.encode()) == expected


def test_counts_of_awkward_tables(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN", 3)
    long = [" ".join(scraps(5, 300)), "é" * 2000, "<|endoftext|>" * 200, "  " * 900]
    rows = [(1, None), (2, ""), (3, "same words"), (3, "same words"), (None, "x"), *enumerate(long, 10), (10, long[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS id", "'h' AS head", "1 AS `row`")
    # 64 bytes a chunk: with three to a group, two rounds do not reach the longest texts, which a fan of 256 does.
    monkeypatch.setattr(token_counts, "FAN", 256)
    found = token_counts.count(docs, LEFT, limit=100, chunk=64)
    expected = [(i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, library_counts([t or "" for _, t in rows]), strict=True)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert token_counts.count(docs.limit(0), LEFT).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.Vocabulary(TOKENIZERS.path("word_bpe_49k.json"))


# Alignment ------------------------------------------------------------------------------------------------------------


def aligned_by_hand(rows):
    """Cut by common ends, over whole texts."""
    import sentencepiece

    left, right = packing.encoder(LEFT).encoding, sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    counts, own = collections.Counter(), []
    for _, text in rows:
        a = left.encode_ordinary(" " + text) if text else []
        b = right.encode(text) if text else []
        a_bytes = [left.decode_single_token_bytes(t) for t in a]
        b_bytes = [bytes([int(right.id_to_piece(t)[3:5], 16)]) if right.is_byte(t) else right.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            own.append((0, 0, "", []))
            continue
        a_ends, b_ends = (np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes))
        links, parts, i, j = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            k, m = a_ends.index(end) + 1, b_ends.index(end) + 1
            parts.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links.append((a[k - 1], b[m - 1]))
            i, j = k, m
        counts.update(links)
        own.append((len(a), len(b), hashlib.sha256(";".join(parts).encode()).hexdigest(), links))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (i, n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for (i, _), (n_a, n_b, digest, links) in zip(rows, own, strict=True)
    ]


@pytest.mark.parametrize("broadcast", [True, False])
def test_alignment_agrees_with_common_ends(spark, monkeypatch, broadcast):
    pytest.importorskip("sentencepiece")
    if not broadcast:
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    texts = scraps(6, 150) + ["hello " * 3000, "antidisestablishmentarianism", " lead", "trail ", "<|endoftext|> <s>"]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "twice the same"), (902, "twice the same"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS part", "1 AS nth", "2 AS pairs")
    found = alignment.align(docs, LEFT, RIGHT)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(aligned_by_hand(rows), key=str)


def test_alignment_of_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), LEFT, RIGHT).count() == 0


def test_pointers_reach_the_last_token_of_their_group():
    left, right = np.array([1, 4, 6, 9, 10]), np.array([3, 5, 8, 9, 10])
    assert alignment.terminals(left, right).tolist() == [3, 3, 3, 3, 4, 3, 3, 3, 3, 4]
    assert alignment.terminals(np.zeros(0, dtype=int), np.zeros(0, dtype=int)).tolist() == []
    # One group as long as the arrays: two tokens apart at every place but the last.
    odd, even = np.append(np.arange(1, 9999, 2), 10000), np.arange(2, 10001, 2)
    assert set(alignment.terminals(odd, even).tolist()) == {len(odd) - 1}


# Whitening ------------------------------------------------------------------------------------------------------------


def test_inertia_and_contours():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 40):
        own, _ = np.linalg.qr(rng.normal(size=(size, size)))
        for values in (rng.normal(size=size), np.repeat(rng.normal(size=1), size), np.round(rng.normal(size=size)), 10.0 ** -np.arange(size)):
            matrix = own * values @ own.T
            matrix = (matrix + matrix.T) / 2
            for shift in (-0.71, 0.013, 0.9):
                assert whitening.inertia(matrix, shift) == (values > shift).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    base = rng.normal(size=(60, 30))
    for matrix in (base.T @ base, np.diag([5.0, 5.0, 5.0, 2.0, 1.0]), np.diag([1e6, 1.0, 0.5, 0.0]), np.eye(6)):
        values, vectors = whitening.leading(matrix, 3)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:3], rtol=1e-10, atol=1e-12 * matrix.max())
        assert np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-10)
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-10 * matrix.max()
    assert len(whitening.leading(np.diag([3.0, 0.0, 0.0]), 3)[0]) == 1
    assert len(whitening.leading(np.zeros((4, 4)), 3)[0]) == 0


def test_whitened_against_a_dense_solution(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[3].tolist())]
    awkward = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11), (904, [float("inf")] * 12), (905, [1.0, 2.0]), (906, [1e30] * 12)]
    frame = spark.createDataFrame(rows + awkward, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS n", "3 AS whitened")
    found = whitening.whiten(frame, components=8).collect()
    whole = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64) + 100_000
    n, sums = len(whole), whole.sum(axis=0)
    centred = whole - sums / n
    matrix = centred.T @ centred / n
    values, vectors = (a[..., ::-1][..., :8] for a in np.linalg.eigh(matrix))
    white = centred @ vectors / np.sqrt(values)
    deviation = ((n * whole - sums) ** 2).sum(axis=1)
    assert len(found) == 8 * n
    sign = {}
    for r in found:
        i = {7: None}.get(r.id, 401 if r.id is None else r.id)
        if i is None:
            continue
        s = sign.setdefault(r.component, np.sign(r.whitened * white[i, r.component - 1]))
        assert abs(s * r.whitened - white[i, r.component - 1]) < 1e-9
        assert r.n == n and int(r.deviation) == deviation[i]
        assert abs(r.explained / (values[r.component - 1] / np.trace(matrix)) - 1) < 1e-9
        assert r.identity_error < 1e-9
    assert sum(r.id == 7 for r in found) == 16 and {r.id for r in found}.isdisjoint(range(900, 907))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_vectors_without_spread_have_no_component(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame).collect() == []


def test_few_directions_give_few_components(spark):
    frame = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(50)], "vec_id long, embedding array<double>")
    found = whitening.whiten(frame).collect()
    assert {r.component for r in found} == {1} and all(r.identity_error < 1e-9 and abs(r.explained - 1) < 1e-9 for r in found)


def test_large_deviations_stay_exact():
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL("id long, deviation decimal(38,0), whitened array<double>"))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[1000.0, -1000.0]])], ["id", "embedding"])
    sums, n = np.array([5, 7], dtype=np.int64), 10**9
    own = next(whitening._whiten(sums, n, np.eye(2), schema)(iter([batch]))).to_pylist()[0]
    assert int(own["deviation"]) == (n * 1_124_000 - 5) ** 2 + (n * -924_000 - 7) ** 2
