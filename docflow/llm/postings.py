"""Benchmark decontamination with a distributed positional inverted index.

The index is cut into shards of whole documents.  A shard stores, for every term, the increasing places at which it
stands; documents of a shard follow each other with one free place between them, so no phrase can cross a border.  A
search reads only the terms of the test items, and intersects the offset-adjusted lists of a phrase from its rarest
term on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import fresh, written

#: A shard is closed once it holds so many words; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
#: Test items are searched in blocks of about so many words, which bounds what is sent to each executor.
BLOCK_WORDS = 2_000_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_INDEX = "shard long, term binary, places binary, doc_no int, id string, text_hash long, base long, n_words long"


def words(text: str | None) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _shard_batches(shard: int, docs: list[tuple], tokens: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    number: dict[bytes, int] = {}
    codes, places, bases, base = [], [], [], 0
    for own in tokens:
        codes += [number.setdefault(w, len(number)) for w in own]
        places.append(np.arange(base, base + len(own), dtype=np.uint32))
        bases.append(base)
        base += len(own) + 1
    schema = pa.schema(
        [("shard", pa.int64()), ("term", pa.binary()), ("places", pa.binary()), ("doc_no", pa.int32()), ("id", pa.string()), ("text_hash", pa.int64()), ("base", pa.int64()), ("n_words", pa.int64())]
    )
    n = len(docs)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()),
            pa.array([d[0] for d in docs], pa.string()), pa.array([d[1] for d in docs], pa.int64()),
            pa.array(bases, pa.int64()), pa.array([len(t) for t in tokens], pa.int64()),
        ],
        schema=schema,
    )
    if not number:
        return
    code = np.array(codes, dtype=np.int64)
    order = np.argsort(code, kind="stable")
    counts = np.bincount(code, minlength=len(number))
    ends = np.cumsum(counts)
    sorted_places = np.concatenate(places)[order]
    steps = np.diff(sorted_places, prepend=np.uint32(0))  # gaps compress better than places
    firsts = ends - counts
    steps[firsts] = sorted_places[firsts]
    offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
    lists = pa.BinaryArray.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(offsets), pa.py_buffer(steps.astype("<u4"))])
    m = len(number)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(m, shard)), pa.array(list(number), pa.binary()), lists, pa.nulls(m, pa.int32()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
        schema=schema,
    )


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId() << 32
    docs, tokens, size = [], [], 0
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(3)), strict=True):
            own = words(row[2].as_py())
            docs.append((row[0].as_py(), row[1].as_py()))
            tokens.append(own)
            size += len(own)
            if size >= SHARD_WORDS:
                yield from _shard_batches(shard, docs, tokens)
                shard, docs, tokens, size = shard + 1, [], [], 0
    if docs:
        yield from _shard_batches(shard, docs, tokens)


def text_key(text: str = "text"):
    """With the id, what tells rows of documents apart; rows equal in both have equal results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of every token of every document, written to the shared folder.

    A row is either a document (term null) or a term of a shard with its places.  Null and empty texts are documents
    without words.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_key(text).alias("text_hash"), F.col(text).alias("text"))
    return written(rows.mapInArrow(_index_rows, _INDEX), "postings")


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype="<u4").astype(np.int64))


def _among(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = np.searchsorted(places, values)
    return places[np.minimum(at, len(places) - 1)] == values


def _phrase_starts(phrase: list[bytes], lists: dict[bytes, np.ndarray]) -> np.ndarray:
    """Places where the phrase starts: lists shifted by their offset, intersected from the shortest on."""
    order = sorted(range(len(phrase)), key=lambda i: len(lists[phrase[i]]))
    starts = lists[phrase[order[0]]] - order[0]
    for i in order[1:]:
        if not len(starts):
            break
        starts = starts[_among(starts + i, lists[phrase[i]])]
    return starts


def _near_spans(terms: list[bytes], lists: dict[bytes, np.ndarray], span: int, doc_of) -> list[tuple[int, int]]:
    """Shortest stretches of at most `span` places of one document around a rarest term that hold all terms."""
    terms = sorted(set(terms), key=lambda t: len(lists[t]))
    found = []
    for p in lists[terms[0]]:
        around = []
        for k, t in enumerate(terms):
            own = lists[t]
            own = own[np.searchsorted(own, p - span + 1) : np.searchsorted(own, p + span)] if k else np.array([p])
            around += [(int(x), k) for x in own if doc_of(x) == doc_of(p)]
        around.sort()
        last: dict[int, int] = {}
        best = None
        for place, k in around:
            last[k] = place
            if len(last) == len(terms):
                low = min(last.values())
                if place - low < span and (best is None or place - low < best[1] - 1 - best[0]):
                    best = (low, place + 1)
        if best:
            found.append(best)
    return found


def _windows(tokens: list[bytes], n: int) -> list[list[bytes]]:
    return [tokens] if 0 < len(tokens) < n else [tokens[i : i + n] for i in range(len(tokens) - n + 1)] if tokens else []


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def search(index: DataFrame, items: DataFrame, n: int = 10, span: int | None = None, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Match every item against the index; per document: id, text_hash, n_words, items, spans (word ranges, merged).

    Exact phrases: every `n` consecutive words of an item, or all of an item with fewer words.  With `span` given, a
    proximity match instead: all words of the item, in any order, within `span` places.  Items without words match
    nothing.  Documents without a match have empty arrays.
    """
    spark = index.sparkSession
    own = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    length = F.length(F.coalesce(F.col("text"), F.lit("")))
    total = own.agg(F.sum(length)).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK_WORDS * 5)))
    parts = []
    for block in range(blocks):
        mine = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        wanted = [(r["item"], words(r["text"])) for r in mine]
        vocabulary = sorted({w for _, tokens in wanted for w in tokens})
        terms = F.broadcast(spark.createDataFrame([(bytearray(w),) for w in vocabulary], "term binary"))
        rows = index.where(F.col("term").isNull()).unionByName(index.where(F.col("term").isNotNull()).join(terms, "term", "left_semi"))
        shared = spark.sparkContext.broadcast(wanted)
        parts.append(rows.groupBy("shard").applyInArrow(_matcher(shared, n, span), _FOUND))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("shard", "doc_no", "id", "text_hash", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )


_FOUND = "shard long, doc_no int, id string, text_hash long, n_words long, items array<string>, spans array<struct<first: long, after: long>>"


def _matcher(shared, n: int, span: int | None):
    def match(shard: pa.Table) -> pa.Table:
        is_doc = np.array(shard["term"].is_null())
        docs = shard.filter(pa.array(is_doc)).sort_by("base")
        posts = shard.filter(pa.array(~is_doc))
        lists = {t: _places(p) for t, p in zip(posts["term"].to_pylist(), posts["places"].to_pylist(), strict=True)}
        bases = docs["base"].to_numpy()

        def doc_of(place):
            return int(np.searchsorted(bases, place, side="right")) - 1

        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str | None]] = {}
        for item, tokens in shared.value:
            if span is None:
                hits = [
                    (int(a), int(a) + len(w))
                    for w in _windows(tokens, n)
                    if all(t in lists for t in w)
                    for a in _phrase_starts(w, lists)
                ]
            else:
                hits = _near_spans(tokens, lists, span, doc_of) if tokens and all(t in lists for t in tokens) else []
            for a, b in hits:
                d = doc_of(a)
                spans.setdefault(d, []).append((a - int(bases[d]), b - int(bases[d])))
                items.setdefault(d, set()).add(item)
        rows = len(docs)
        merged = [_merge(spans.get(d, [])) for d in range(rows)]
        return pa.table(
            {
                "shard": docs["shard"],
                "doc_no": docs["doc_no"],
                "id": docs["id"],
                "text_hash": docs["text_hash"],
                "n_words": docs["n_words"],
                "items": pa.array([sorted(x for x in items.get(d, ()) if x is not None) for d in range(rows)], pa.list_(pa.string())),
                "spans": pa.array(
                    [[{"first": a, "after": b} for a, b in m] for m in merged], pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
                ),
            }
        )

    return match


def hit_words(spans: str = "spans"):
    """Number of words inside any of the spans, which are sorted and may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["after"] - F.greatest(s["first"], acc["upto"]), F.lit(0))).alias("n"),
        F.greatest(acc["upto"], s["after"]).alias("upto"),
    )
    return F.aggregate(F.col(spans), zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in which no phrase of an item occurs, with all their columns; rows with null or no text stay."""
    found = search(build_index(docs, id_col, text), items, n)
    bad_id, bad_hash = fresh(docs, "bad_id"), fresh(docs, "bad_hash")
    bad = found.where(F.size("spans") > 0).select(F.col("id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    same = F.col(id_col).cast("string").eqNullSafe(F.col(bad_id)) & (text_key(text) == F.col(bad_hash))
    return docs.join(bad, same, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    n_hit = hit_words()
    return found.select(
        "id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
