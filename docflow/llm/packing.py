"""Packing tokenized documents into fixed-length sequences by patterns of few documents.

Only lengths matter for a plan, and there are at most `capacity` of them.  Patterns of two or three lengths that fill
a sequence exactly are given repeat counts by non-negative least squares against the histogram of lengths; the counts
are rounded within the histogram, and what is left goes best fit, longest first.  The plan is as large as the number
of lengths allows, not as the data; Spark deals the pieces out to its slots by their rank within their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docflow.llm.common import written

CAPACITY = 2048
END = 0
#: Fixed value: how byte-level BPE of this vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of a worker whose ids are kept; the others are encoded again.
CACHE_WORDS = 400_000
_ODD_SPACE = re.compile(r"\s\s|\A\s|\s\Z")


class _WordIds(dict):
    """Little-endian ids of words that follow a single space."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        out = self.ids(" " + word)
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out


_WORKER: dict[str, _WordIds] = {}


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def encoder(tokenizer_path: str) -> _WordIds:
    """The tokenizer in a file of the tokenizers library, run by tiktoken, which gives the same ids in a quarter of
    the CPU time; kept for the life of a worker."""
    if tokenizer_path not in _WORKER:
        import tiktoken

        with open(tokenizer_path, encoding="utf-8") as file:
            stored = json.load(file)
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in stored["model"]["vocab"].items() if t not in special}
        _WORKER[tokenizer_path] = _WordIds(tiktoken.Encoding("stored", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special))
    return _WORKER[tokenizer_path]


def encode(text: str, words: _WordIds) -> bytes:
    """Ids of a text.  A single space between other characters always starts a token, so words are encoded apart."""
    if not text or _ODD_SPACE.search(text):
        return words.ids(text)
    first, *rest = text.split(" ")
    return words.ids(first) + b"".join(map(words.__getitem__, rest))


def _cut(tokenizer_path: str, capacity: int, keep_ids: bool, schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for ident, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "", words) + END.to_bytes(4, "little")
                total = len(ids) // 4
                pieces = -(-total // capacity)
                after = total - capacity * (pieces - 1)
                start = 0
                for piece in range(pieces):
                    own = ids[start * 4 : after * 4]
                    length = after - start
                    rows.append((ident.as_py(), piece, start, length, zlib.crc32(own), part, int(seen[length])) + ((own,) if keep_ids else ()))
                    seen[length] += 1
                    start, after = after, after + capacity
                size += len(ids)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return cut


def tokenize(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = True
) -> DataFrame:
    """Cut every document's ids, closed by END, into pieces of at most `capacity`; of several, the first may be shorter.

    doc_id, piece, start, length, ids_crc32, part and nth (the piece's number among those of its length in its
    task), with `keep_ids` also ids, little-endian unsigned 32-bit.  A null or empty text is one piece of END alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spec = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * keep_ids
    schema = to_arrow_schema(StructType.fromDDL(spec))
    rows = docs.select(F.col(id_col), F.col(text))
    return written(rows.mapInArrow(_cut(tokenizer_path, capacity, keep_ids, schema), spec), "pieces")


@dataclass
class Plan:
    """Slots of pieces by length and rank.  A slot serves `repeats` sequences from `sequence` on, `copies` pieces of
    its length in each, standing from `offset` on."""

    length: np.ndarray
    rank: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def exact_patterns(histogram: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """All pairs and triples of lengths at hand that fill `capacity` exactly, the most plentiful first."""
    have = histogram > 0
    lengths = np.flatnonzero(have)
    found: list[tuple[int, tuple[int, ...]]] = []
    for a in lengths.tolist():
        if 2 * a <= capacity and have[capacity - a] and (2 * a < capacity or histogram[a] > 1):
            found.append((int(min(histogram[a], histogram[capacity - a])), (a, capacity - a)))
        b = np.arange(a, (capacity - a) // 2 + 1)
        if len(b):
            b = b[have[b] & have[capacity - a - b]]
            low = np.minimum(np.minimum(histogram[a], histogram[b]), histogram[capacity - a - b])
            found += [(m, (a, x, capacity - a - x)) for x, m in zip(b.tolist(), low.tolist(), strict=True)]
    found.sort(key=lambda x: -x[0])
    return [p for _, p in found]


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 4) -> list[float]:
    """Non-negative least squares of the patterns' lengths against the histogram, by cyclic coordinate descent."""
    left = histogram.astype(float).tolist()
    counts = [0.0] * len(patterns)
    norms = [sum(p.count(x) ** 2 for x in set(p)) for p in patterns]
    for _ in range(sweeps):
        for i, p in enumerate(patterns):
            old = counts[i]
            new = old + sum(left[x] for x in p) / norms[i]
            if new < 0.0:
                new = 0.0
            if new != old:
                counts[i] = new
                step = new - old
                for x in p:
                    left[x] -= step
    return counts


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Slots for histogram[length] pieces of every length below `capacity`."""
    left = histogram.astype(np.int64).copy()
    left[capacity:] = 0
    groups: list[tuple[tuple[int, ...], int]] = []
    patterns = exact_patterns(left, capacity)
    counts = fit_counts(patterns, left)
    for i in sorted(range(len(patterns)), key=lambda i: -counts[i]):
        p = patterns[i]
        n = min(int(counts[i] + 0.5), min(int(left[x]) // p.count(x) for x in p))
        if n > 0:
            groups.append((p, n))
            for x in p:
                left[x] -= n
    # Best fit, longest first, over bins that are alike: open[space] holds (lengths so far, number of bins).
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in range(capacity - 1, 0, -1):
        rest = int(left[size])
        while rest:
            space = min((s for s in open_bins if s >= size), default=None)
            bins, n = open_bins[space].pop() if space else ((), rest)
            if space and not open_bins[space]:
                del open_bins[space]
            space = space or capacity
            each = min(space // size, rest)
            used = min(n, rest // each)
            open_bins.setdefault(space - size * each, []).append((bins + (size,) * each, used))
            if bins and used < n:
                open_bins.setdefault(space, []).append((bins, n - used))
            rest -= used * each
    groups += [g for own in open_bins.values() for g in own]
    taken = np.zeros(capacity + 1, dtype=np.int64)
    slots, sequence = [], 0
    for p, n in groups:
        offset = 0
        for size in sorted(set(p), reverse=True):
            copies = p.count(size)
            slots.append((size, int(taken[size]), copies, sequence, offset))
            taken[size] += copies * n
            offset += copies * size
        sequence += n
    slots.sort()
    columns = np.array(slots, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence)


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to written pieces (see tokenize).

    Full pieces are sequences of their own, numbered after the plan's.  Ties and repeated rows take the next rank.
    """
    spark = pieces.sparkSession
    sizes = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast((slots.length, slots.rank, slots.copies, slots.sequence, slots.offset))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        lengths, ranks, copies, sequences, offsets = shared.value
        own, at = np.asarray(length), np.asarray(rank)
        # Slots are in order of (length, rank): the last one not beyond the piece is its own.
        key = lengths * (1 << 44) + ranks
        i = np.searchsorted(key, own * (1 << 44) + at, side="right") - 1
        nth = at - ranks[i]
        return pa.StructArray.from_arrays(
            [pa.array(sequences[i] + nth // copies[i]), pa.array(offsets[i] + nth % copies[i] * own)], ["sequence_id", "offset"]
        )

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.where(F.col("length") < capacity).select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    short = pieces.where(F.col("length") < capacity).join(firsts, ["part", "length"])
    placed = short.withColumn("_placed", place("length", F.col("nth") + F.col("_before")))
    placed = placed.select(*pieces.columns, "_placed.sequence_id", "_placed.offset")
    full = pieces.where(F.col("length") == capacity).select(
        "*",
        (F.monotonically_increasing_id() + F.lit(slots.sequences)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return placed.unionByName(full).drop("part", "nth")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in order (little-endian) and how many there are; a sequence's size is bounded."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(own.alias("own"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("own", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), "n_tokens")
