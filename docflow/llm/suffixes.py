"""Exact repeated substrings by a sparse suffix order.

A byte is removed if a string of `length` bytes that covers it starts anywhere else as well.  Every such string is
represented by one suffix: that at its anchor, the place within it where a hash of the next `gram` bytes is least, so
equal strings have equal anchors.  Anchors whose gram occurs once are done with.  Distinct suffixes at the others are dealt out
in order by Spark and sorted in the tasks, multikey quicksort down to a shallow depth and blind tries for what is still
equal there; the longest common prefix with a neighbour bounds how far any repeat reaches to the right, and so which
starts of strings can repeat at all.  Those are confirmed by hashes of their whole content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import maybe_in, written

LENGTH = 400
GRAM = 200
#: Multikey quicksort looks at so many bytes beyond the gram, a word at a time; blind tries do the rest.
SHALLOW = 32
_WORD = 8
#: Texts are worked on in stretches of about this many bytes; places in a stretch fit into 24 bits.
BLOCK_BYTES = 500_000
#: Starts are handed on when there are so many; contexts meet the reach of their right side in so many shares.
STARTS = 100_000
SALTS = 16

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64), 0x61)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses."""
    if len(_TABLES.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1024), base, dtype=np.uint64)
            p[0] = 1
            _TABLES[name] = np.cumprod(p)
    return _TABLES["up"][:n], _TABLES["down"][:n]


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data))
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[data] * up)))


def _hashes(sums: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [first, after)."""
    _, down = _powers(len(sums))
    return _mix((sums[after] - sums[first]) * down[first])


def _window_least(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive keys, from running minima to both ends of blocks of w."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.uint64(_MASK), dtype=np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[: n - w + 1], behind[w - 1 : n])


def _runs(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts with a common anchor: stretch-wide first and last start, anchor, gram hash, sums.

    starts: increasing places where a string of `length` bytes begins that lies within one text.
    """
    sums = _sums(data)
    grams = np.arange(len(data) - gram + 1)
    hashed = _hashes(sums, grams, grams + gram)
    low = np.uint64((1 << 24) - 1)
    least = _window_least((hashed & ~low) | grams.astype(np.uint64), length - gram + 1)
    anchor = (least[starts] & low).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(starts) != 1))))
    last = np.concatenate((edge[1:], [len(starts)])) - 1
    return starts[edge], starts[last], anchor[edge], hashed[anchor[edge]], sums


def _stretches(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Parts (text, where the part begins in it, bytes), gathered to stretches; parts of a text overlap by all but one
    byte of a string, so each string lies in exactly one part."""
    own, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, BLOCK_BYTES):
            part = text[at : at + BLOCK_BYTES + length - 1]
            own.append((i, at, part))
            size += len(part)
            if size >= BLOCK_BYTES:
                yield own
                own, size = [], 0
    if own:
        yield own


def _anchors(length: int, gram: int, with_context: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(batch.num_columns - 1)]
            for parts in _stretches(texts, length):
                data = np.frombuffer(b"".join(p for _, _, p in parts), dtype=np.uint8)
                sizes = np.array([len(p) for _, _, p in parts])
                begins = np.cumsum(sizes) - sizes
                starts = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begins, sizes, strict=True)])
                lo, hi, anchor, grams, sums = _runs(data, starts, length, gram)
                if not with_context:
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])
                    continue
                part = np.searchsorted(begins, lo, side="right") - 1
                shift = np.array([at for _, at, _ in parts])[part] - begins[part]
                text = pa.array(np.array([i for i, _, _ in parts])[part])
                shape = (anchor - lo).astype(np.uint64) << np.uint64(16) | (hi - lo).astype(np.uint64)
                context = _mix(_hashes(sums, lo, hi + length) ^ _mix(shape, 0x71))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(text), batch.column(1).take(text), pa.array(grams.view(np.int64)), pa.array(context.view(np.int64)),
                        pa.array(lo + shift), pa.array((anchor - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32)),
                    ],
                    ["id", "text_hash", "gram", "context", "first", "before", "more"],
                )

    return rows


def _cut_contexts(length: int):
    """Bytes of the contexts asked for in each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for text, asked in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for a in asked.as_py():
                    own = data[a["first"] : a["first"] + a["more"] + length]
                    out.append((a["gram"], a["context"], a["before"], own[: a["before"]], own[a["before"] :]))
                    size += len(own)
                if size > BLOCK_BYTES:
                    yield _contexts_batch(out)
                    out, size = [], 0
            if out:
                yield _contexts_batch(out)

    return rows


def _contexts_batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["gram", "context", "before", "left", "right"])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, of which `known` bytes are known."""
    end = min(len(a), len(b))
    step = 64
    while known < end and a[known : known + step] == b[known : known + step]:
        known += step
    known = min(known, end)
    while known < end and a[known] == b[known]:
        known += 1
    return known


def blind_trie(items: list[bytes], order: list[int], depth: int) -> list[tuple[int, int]]:
    """Sort items that agree in `depth` bytes: their numbers, each with its common prefix with the one before.

    A trie of the places where items branch.  An item goes down by the bytes at those places alone, is compared with the
    one item it arrives at, and branches off where the two part.
    """
    root: list = [len(items[order[0]]), {}, [order[0]]]  # place, children by byte, items that end here
    for k in order[1:]:
        own = items[k]
        node = root
        while node[1]:
            node = node[1].get(own[node[0]] if node[0] < len(own) else -1) or next(iter(node[1].values()))
        other = items[node[2][0]]
        place = common_prefix(own, other, depth)
        if place == len(own) == len(other):
            node[2].append(k)
            continue
        mine, theirs = (own[place] if place < len(own) else -1), (other[place] if place < len(other) else -1)
        above, key, node = None, 0, root
        while node[1] and node[0] < place:
            key = own[node[0]] if node[0] < len(own) else -1
            above, node = node, node[1][key]
        leaf = [len(own), {}, [k]]
        if node[1] and node[0] == place:
            node[1][mine] = leaf
            continue
        fork = [place, {mine: leaf, theirs: node}, []]
        if above is None:
            root = fork
        else:
            above[1][key] = fork
    out: list[tuple[int, int]] = []
    todo: list[tuple[list, int]] = [(root, depth)]
    while todo:
        node, shared = todo.pop()
        if not node[1]:
            out += [(k, shared if i == 0 else len(items[k])) for i, k in enumerate(node[2])]
            continue
        keys = sorted(node[1])
        for i in range(len(keys) - 1, -1, -1):
            todo.append((node[1][keys[i]], shared if i == 0 else node[0]))
    return out


def deep_shallow(items: list[bytes], depth: int, shallow: int = SHALLOW) -> list[tuple[int, int]]:
    """Sort items that agree in `depth` bytes: their numbers, each with its common prefix with the one before (the first:
    with whatever came before, `depth`)."""
    out: list[tuple[int, int]] = []
    todo = [(list(range(len(items))), depth, depth)]
    limit = depth + shallow
    while todo:
        order, at, shared = todo.pop()
        if len(order) == 1:
            out.append((order[0], shared))
        elif at >= limit:
            got = blind_trie(items, order, at)
            out += [(got[0][0], shared), *got[1:]]
        else:
            words = {k: items[k][at : at + _WORD] for k in order}
            pivot = words[order[len(order) // 2]]
            less = [k for k in order if words[k] < pivot]
            same = [k for k in order if words[k] == pivot]
            more = [k for k in order if words[k] > pivot]
            near = lambda group, side: at + common_prefix(side(words[k] for k in group), pivot)  # noqa: E731, B023
            after = [(more, at, near(more, min))] if more else []
            if len(pivot) < _WORD:  # items that end here are equal
                middle = [([k], at, shared if i == 0 else at + len(pivot)) for i, k in enumerate(same)]
            else:
                middle = [(same, at + _WORD, shared)]
            if less:
                middle[0] = (*middle[0][:2], near(less, max))
                before = [(less, at, shared)]
            else:
                before = []
            todo += after + middle[::-1] + before
    return out


def right_sides(contexts: DataFrame) -> DataFrame:
    """gram, side, n and right: the distinct right sides of contexts, with a hash and the number of their contexts."""
    return contexts.groupBy("gram", F.xxhash64("right").alias("side")).agg(F.count("*").alias("n"), F.first("right").alias("right"))


def _reaches(gram: int):
    """How far right sides, dealt out in order, agree with any other; in full if several contexts share one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        first = True
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if held and row[0] != held[-1][0]:
                    yield _group_reaches(held, gram, first, False)
                    held, first = [], False
                held.append(row)
        if held:
            yield _group_reaches(held, gram, first, True)

    return rows


def _group_reaches(held: list[tuple], gram: int, first: bool, last: bool) -> pa.RecordBatch:
    rights = [r[3] for r in held]
    ranked = deep_shallow(rights, gram)
    reach = [0] * len(held)
    for i, (k, shared) in enumerate(ranked):
        behind = shared if i or not first else len(rights[k])
        ahead = ranked[i + 1][1] if i + 1 < len(ranked) else len(rights[k]) if last else gram
        reach[k] = len(rights[k]) if held[k][2] > 1 else max(behind, ahead)
    columns = [pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int64()), pa.array(reach, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["gram", "side", "reach"])


def _bounded_starts(length: int):
    """Starts of strings that may repeat, with hashes of their content, from contexts one by one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for g, context, before, left, right, far in zip(*batch.columns, strict=True):
                before, data = before.as_py(), left.as_py() + right.as_py()
                # A string that starts `place` bytes into the context ends length - (before - place) bytes behind the anchor.
                most = min(len(data) - length, far.as_py() + before - length)
                if most < 0:
                    continue
                own = np.arange(most + 1)
                keys = _hashes(_sums(np.frombuffer(data, dtype=np.uint8)), own, own + length)
                out.append((np.full(len(own), g.as_py()), np.full(len(own), context.as_py()), own, keys))
                size += len(own)
                if size >= STARTS:
                    yield _starts_batch(out)
                    out, size = [], 0
            if out:
                yield _starts_batch(out)

    return rows


def _starts_batch(out: list[tuple]) -> pa.RecordBatch:
    grams, contexts, places, keys = (np.concatenate(c) for c in zip(*out, strict=True))
    columns = [pa.array(grams, pa.int64()), pa.array(contexts, pa.int64()), pa.array(places.astype(np.int32)), pa.array(keys.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["gram", "context", "place", "content"])


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, text_hash, first and last: ranges of starts in a text whose strings of `length` bytes start elsewhere too.

    docs: id, text_hash, text; rows equal in all of them count as texts of their own.
    """
    kind = docs.schema["id"].dataType.simpleString()
    grams = docs.select("text").mapInArrow(_anchors(length, gram, False), "gram long")
    repeated = written(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    spec = f"id {kind}, text_hash long, gram long, context long, first long, before int, more int"
    anchors = docs.select("id", "text_hash", "text").mapInArrow(_anchors(length, gram, True), spec)
    anchors = written(maybe_in(anchors, repeated, ["gram"]).join(repeated, "gram", "left_semi"), "anchors")
    # Equal contexts repeat in all their strings.  Grams with several contexts are looked at more closely.
    one = F.struct("id", "text_hash", "first", "before", "more")
    classes = written(anchors.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(one).alias("one")), "classes")
    several = classes.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    asked = classes.join(several, "gram", "left_semi").select("gram", "context", "one.*")
    asked = written(asked.groupBy("id", "text_hash").agg(F.collect_list(F.struct("gram", "context", "first", "before", "more")).alias("asked")), "asked")
    texts = maybe_in(docs, asked, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    found = asked.join(texts, _same(asked, texts)).select(texts["text"], "asked")
    spec = "gram long, context long, before int, left binary, right binary"
    contexts = written(found.mapInArrow(_cut_contexts(length), spec), "contexts")
    # A passage in many texts has one right side: right sides are sorted once, and their reach meets the contexts by salt.
    sides = written(right_sides(contexts), "sides")
    size = sides.agg(F.sum(F.octet_length("right") + 64)).first()[0] or 0
    dealt = sides.repartitionByRange(max(1, -(-size // (32 << 20))), "gram", "right").sortWithinPartitions("gram")
    reaches = dealt.mapInArrow(_reaches(gram), "gram long, side long, reach long")
    reaches = reaches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = contexts.withColumn("side", F.xxhash64("right")).withColumn("salt", F.pmod("context", F.lit(SALTS)).cast("int"))
    bounded = salted.join(reaches, ["gram", "side", "salt"]).select("gram", "context", "before", "left", "right", "reach")
    starts = bounded.mapInArrow(_bounded_starts(length), "gram long, context long, place int, content long")
    starts = written(starts, "starts")
    # Equal strings have equal grams, so gram and content are two hashes of a string.
    twice = starts.groupBy("gram", "content").agg(F.count("*").alias("n")).where("n > 1").select("gram", "content")
    some = starts.join(twice, ["gram", "content"], "left_semi").groupBy("gram", "context").agg(F.array_sort(F.collect_set("place")).alias("places"))
    # Per class: every string, or the places of the confirmed ones.
    decided = classes.join(some, ["gram", "context"], "left").where((F.col("n") > 1) | F.col("places").isNotNull())
    decided = written(decided.select("gram", "context", F.when(F.col("n") == 1, F.col("places")).alias("places")), "decided")
    hits = anchors.join(decided, ["gram", "context"])
    whole = hits.where(F.col("places").isNull()).select("id", "text_hash", "first", (F.col("first") + F.col("more")).alias("last"))
    single = hits.where(F.col("places").isNotNull()).select("id", "text_hash", "first", F.explode("places").alias("place"))
    single = single.select("id", "text_hash", (F.col("first") + F.col("place")).alias("first"))
    return whole.unionByName(single.withColumn("last", F.col("first")))


def _same(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["text_hash"] == b["text_hash"])


def _cut(length: int):
    """Texts without the bytes that strings from the given starts cover."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ranges, ends = batch.column(3).flatten(), np.asarray(batch.column(3).offsets)
            first, last = np.asarray(ranges.field("first")), np.asarray(ranges.field("last"))
            for text, a, b in zip(batch.column(2), ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                size = len(data) + 1
                change = np.bincount(first[a:b], minlength=size) - np.bincount(last[a:b] + length, minlength=size)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            new = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["id", "text_hash", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and with `keep_text` kept (bytes).

    Texts are UTF-8 bytes, null is empty; strings never cross texts.  All places of a repeated string are removed, and
    strings are judged on the texts as they come.  Rows that repeat an id and its text are places of their own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    ranges = repeated_starts(rows, length, gram)
    ranges = written(ranges.groupBy("id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
    texts = maybe_in(rows, ranges, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    joined = ranges.join(texts, _same(ranges, texts)).select(ranges["id"], ranges["text_hash"], "text", "ranges")
    kind = rows.schema["id"].dataType.simpleString()
    spec = f"id {kind}, text_hash long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = joined.mapInArrow(_cut(length), spec)
    if not keep_text:
        cut = cut.drop("kept")
    plain = rows.select("id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), *(["text"] if keep_text else []))
    both = plain.join(cut, _same(plain, cut), "left")
    return both.select(
        plain["id"],
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("kept", F.col("text").cast("binary")).alias("kept")] if keep_text else []),
    )
