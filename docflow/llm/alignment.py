"""Aligning the tokens of two tokenizers over the bytes of the same text, by pointer jumping.

Both tokenizers cut the same bytes.  Every token points to the token of the other side that covers its last byte, which
is the overlapping one that reaches farthest right; where both end together, to the first side's token, which points to
itself.  Replacing every pointer by its target's pointer, over whole arrays at once, doubles its reach until all stand on
the last token of their group; that token labels the group.

Both tokenizers begin a new token at a single space after another character, so the stretches between such spaces are
aligned apart and the result of frequent ones is kept by the worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from contextlib import suppress
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docflow.llm import packing
from docflow.llm.common import written
from docflow.operators.skew import lookup_join

#: Stretches whose alignment a worker keeps; one longer than LONGEST_KEPT characters is aligned anew.
KEPT, LONGEST_KEPT = 250_000, 48
#: Text that is aligned at once.
BLOCK_CHARS = 2_000_000
#: Rows of the table of id pairs up to which it is broadcast, some 30 MB; beyond it is joined by hot pairs.
BROADCAST_PAIRS = 1_000_000

_ODD_SPACE = re.compile(r"\s\s|\A\s|\s\Z")
_BORDER = re.compile(r"(?<=\S) ")


def terminals(left_ends: np.ndarray, right_ends: np.ndarray) -> np.ndarray:
    """For every token of both sides (the left ones first) the left token at the end of its group.

    The arguments are the ascending byte offsets at which tokens end; both sides end together.
    """
    n = len(left_ends)
    over_left = np.searchsorted(right_ends, left_ends)
    over_right = np.searchsorted(left_ends, right_ends)
    together = right_ends[over_left] == left_ends if n else np.zeros(0, dtype=bool)
    pointer = np.concatenate([np.where(together, np.arange(n), n + over_left), over_right])
    while True:
        farther = pointer[pointer]
        if np.array_equal(farther, pointer):
            return pointer
        pointer = farther


class Aligner:
    """Both tokenizers, and the alignments of stretches so far: stretch -> (tokens on either side, groups, their text,
    linked id pairs), or None where a side's bytes are not those of the text."""

    def __init__(self, left_path: str, right_path: str):
        import sentencepiece

        self.left = packing.encoder(left_path).encoding
        self.right = sentencepiece.SentencePieceProcessor(model_file=right_path)
        spaced = [p for p in map(self.right.id_to_piece, range(self.right.get_piece_size())) if "▁" in p.lstrip("▁")]
        if spaced:
            raise ValueError("pieces that go on after a space cannot be aligned by stretches")
        self.space = self.right.piece_to_id("▁")
        self.left_sizes = np.zeros(self.left.n_vocab, dtype=np.int64)
        for token in range(self.left.n_vocab):
            # Numbers without a token stand for special strings, which plain encoding never gives.
            with suppress(KeyError):
                self.left_sizes[token] = len(self.left.decode_single_token_bytes(token))
        self.right_bytes = [self._bytes(piece) for piece in range(self.right.get_piece_size())]
        self.right_sizes = np.array([len(b) for b in self.right_bytes], dtype=np.int64)
        self.digits = [str(i) for i in range(max(len(self.left_sizes), len(self.right_sizes)))]
        self.known: dict[str, tuple | None] = {}

    def _bytes(self, piece: int) -> bytes:
        text = self.right.id_to_piece(piece)
        return bytes([int(text[3:5], 16)]) if self.right.is_byte(piece) else text.replace("▁", " ").encode()

    def learn(self, stretches: Sequence[str]) -> None:
        """Align stretches, written without the space before them, all at once."""
        fit, left_ids, right_ids = [], [], []
        left_count, right_count = [], []
        spell = self.right_bytes.__getitem__
        for stretch, right in zip(stretches, self.right.encode(list(stretches), num_threads=1), strict=True):
            right = right or [self.space]
            text = " " + stretch
            # The left side's tokens are the bytes themselves; the right side's may not be.
            if b"".join(map(spell, right)) != text.encode():
                self.known[stretch] = None
                continue
            left = self.left.encode_ordinary(text)
            fit.append(stretch)
            left_ids += left
            right_ids += right
            left_count.append(len(left))
            right_count.append(len(right))
        if not fit:
            return
        lefts, rights = np.array(left_ids), np.array(right_ids)
        left_ends, right_ends = np.cumsum(self.left_sizes[lefts]), np.cumsum(self.right_sizes[rights])
        terminal = terminals(left_ends, right_ends)
        n = len(lefts)
        # A group's last tokens end together: one link.
        last = np.flatnonzero(terminal[:n] == np.arange(n))
        pairs = lefts[last] << 32 | rights[np.searchsorted(right_ends, left_ends[last])]
        # Tokens by group, the left ones first, each followed by what stands between it and the next.
        order = np.argsort(terminal, kind="stable")
        group, right_side = terminal[order], order >= n
        mark = np.where(group[1:] != group[:-1], ";", np.where(right_side[1:] != right_side[:-1], "|", ","))
        ids = np.concatenate([lefts, rights])[order].tolist()
        spelled = list(map(add, map(self.digits.__getitem__, ids), [*mark.tolist(), ""]))
        token_to = np.cumsum(np.add(left_count, right_count)).tolist()
        group_to = np.searchsorted(last, np.cumsum(left_count)).tolist()
        token_from, group_from = 0, 0
        for stretch, n_a, n_b, token, end in zip(fit, left_count, right_count, token_to, group_to, strict=True):
            text = "".join(spelled[token_from:token]).rstrip(";")
            self.known[stretch] = n_a, n_b, end - group_from, text, pairs[group_from:end].tobytes()
            token_from, group_from = token, end

    def align(self, texts: Sequence[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups_sha256, distinct linked pairs, how often each) of every text."""
        cut = [None if not t else _BORDER.split(t) if _ODD_SPACE.search(t) else t.split(" ") for t in texts]
        room = KEPT - len(self.known)
        new = {s for own in cut if own for s in own if s not in self.known}
        if new:
            self.learn(list(new))
        out = []
        for own in cut:
            parts = [self.known[s] for s in own or ()]
            if not parts or None in parts:
                out.append((0, 0, 0, "", [], []))
                continue
            n_a, n_b, n_groups, found, pairs = zip(*parts, strict=True)
            digest = hashlib.sha256(";".join(found).encode()).hexdigest()
            codes, times = np.unique(np.frombuffer(b"".join(pairs), dtype=np.int64), return_counts=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), digest, codes, times))
        for i, s in enumerate(new):
            if i >= room or len(s) > LONGEST_KEPT:
                del self.known[s]
        return out


_WORKER: dict[tuple[str, str], Aligner] = {}


def aligner(left_path: str, right_path: str) -> Aligner:
    """The aligner of two files, kept for the life of a worker."""
    key = (left_path, right_path)
    if key not in _WORKER:
        _WORKER[key] = Aligner(*key)
    return _WORKER[key]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some BLOCK_CHARS of text, or one row."""
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)]
    start, size = 0, 0
    for i, own in enumerate(sizes):
        if i > start and size + own > BLOCK_CHARS:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += own
    if start < len(sizes):
        yield batch.slice(start)


def _align(left_path: str, right_path: str, schema: pa.Schema):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = aligner(left_path, right_path)
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in _blocks(batch):
                found = tokens.align(block.column(1).to_pylist())
                rows = [pa.array([part] * len(found), pa.int32()), pa.array(range(nth, nth + len(found)), pa.int64()), block.column(0)]
                columns = zip(list(zip(*found, strict=True)), list(schema)[3:], strict=True)
                yield pa.RecordBatch.from_arrays(rows + [pa.array(list(c), f.type) for c, f in columns], schema=schema)
                nth += len(found)

    return align


def groups(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write and read again: part, nth (the row's own number), id, n_a, n_b, n_groups, groups_sha256, pairs (distinct
    linked id pairs, left id * 2^32 + right id), times (how often each is linked in the text)."""
    kind = docs.schema[id_col].dataType.simpleString()
    spec = f"part int, nth long, id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
    schema = to_arrow_schema(StructType.fromDDL(spec))
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    return written(rows.mapInArrow(_align(left_path, right_path, schema), spec), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links that hold it, over all texts), best (no pair of its right id has more), written."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("link.*")
    counts = written(links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")), "pairs")
    right = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(right.alias("right")).agg(F.max("count").alias("most"))
    joined = counts.withColumn("right", right).join(most, "right")
    return written(joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "best")


def align(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    The left tokenizer reads a space and the text, the right one adds its own.  A null or empty text, or one whose
    bytes a side does not keep, has zeros and ''.  Repeated rows and null ids keep a row of their own and their links
    all count; other columns, whatever their names, take no part.  A pair of ids has one count over all texts; ties for
    a right id's highest count are all best.
    """
    aligned = groups(docs, left_path, right_path, id_col, text)
    counts = pair_counts(aligned)
    links = aligned.select("part", "nth", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    links = links.select("part", "nth", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    if counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(counts), "pair")
    else:
        met = lookup_join(links, counts, ["pair"])
    sums = met.groupBy("part", "nth").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum")
    )
    n_links = F.col("n_groups").alias("n_links")
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_best", "count_sum")]
    rows = aligned.drop("pairs", "times").join(sums, ["part", "nth"], "left")
    return rows.select("id", "n_a", "n_b", "n_groups", n_links, *zero, "groups_sha256")
