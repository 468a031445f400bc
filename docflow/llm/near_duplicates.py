"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles.  Documents with the same set form a class with one representative.  In
each of several trees a node sends a document on to one child per selected minwise token; two documents of similarity
0.8 or more meet in a node at full depth of one tree in about two of three cases, and the trees are independent.

Nodes are compared without ever listing the pairs of a large group:
  1. every document is confirmed against one pivot it met (the least document of a shared node), which joins copies;
  2. nodes inside one component have nothing left to find and are dropped;
  3. nodes with few members outside their largest component are compared exhaustively across components, which takes
     a number of comparisons in proportion to the node's size, however large it is: a handful by a join, up to some
     thousands by blocks of the node in one task each, where the full sets decide, so that of a family of loose copies
     links leave the task and not its pairs;
  4. nodes of many components are compared with one pivot and branch further, until none is left.  The deeper a tree
     goes, the less often a pair stays together in it, so the documents of these nodes get more trees, with minwise
     tokens of their own, until a pair of the least similarity is missed no more often than `recall` allows.
Sketches of two bits per minwise token reject hopeless pairs; every link is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docflow.llm.common import maybe_in, remove, shared_path, write_to, written
from docflow.operators.graph import components

#: Minwise tokens of a document: those that trees branch by, and all, of which the sketch holds two bits each.
TOKENS = 96
SKETCHED = 256
BLOCK_BYTES = 4_000_000
#: Blocks of a node: members, bytes of a set that comes along (a longer one is confirmed apart), and how many of its nodes
#: a member names so that a pair is compared in the first node that both name.
BLOCK_MEMBERS = 4096
CARRIED_BYTES = 16_384
NAMED_NODES = 64

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64), 0x51)


def _hashed(*seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of minwise hashing."""
    draw = np.random.default_rng(seed)
    factors = (draw.integers(0, 1 << 32, SKETCHED, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    return factors, draw.integers(0, 1 << 32, SKETCHED, dtype=np.uint64).astype(np.uint32)


_FACTORS, _SHIFTS = _hashed(2018)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of an ASCII-lower-cased text; a shorter text is one
    shingle, a text without words none.  Words are runs of anything but ASCII white space."""
    data = np.frombuffer(text, dtype=np.uint8)
    blank = np.concatenate(([True], (data == 32) | ((data >= 9) & (data <= 13)), [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, after = edges[0::2], edges[1::2]
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[data] * up[:-1])))
    words = _mix((sums[after] - sums[first]) * down[first])
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(words))):
        out = _mix(out * np.uint64(_BASE) + words[j : j + n])
    return np.unique(out)


def _branch(paths: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, row): one per coordinate that the node selects, 1.25 of them in the mean."""
    first = (_mix(paths, 0xA1) % np.uint64(TOKENS)).astype(np.int64)
    step = (_mix(paths, 0xA2) % np.uint64(TOKENS - 1)).astype(np.int64)
    two = (_mix(paths, 0xA3) & np.uint64(3)) == 0
    at = np.concatenate((first, ((first + 1 + step) % TOKENS)[two]))
    parent = np.concatenate((paths, paths[two]))
    own = np.concatenate((rows, rows[two]))
    chosen = tokens[own, at].astype(np.uint64) * np.uint64(TOKENS) + at.astype(np.uint64)
    return _mix(parent * np.uint64(3) + _mix(chosen, 0xA4)), own


def _minwise(sets: list[np.ndarray], factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Minwise tokens of non-empty sets, one row each."""
    joined = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), len(factors)), dtype=np.uint32)
    for i in range(len(factors)):
        out[:, i] = np.minimum.reduceat(joined * factors[i] + shifts[i], starts)
    return out


def _rooted(tokens: np.ndarray, trees: range, depth: int) -> list[np.ndarray]:
    """Per row of tokens, its nodes in the given trees at a depth."""
    roots = _mix(np.arange(trees.start, trees.stop, dtype=np.uint64), 0xD1)
    nodes, own = np.repeat(roots, len(tokens)), np.tile(np.arange(len(tokens)), len(trees))
    for _ in range(depth):
        nodes, own = _branch(nodes, own, tokens)
    order = np.argsort(own, kind="stable")
    return np.split(nodes[order].view(np.int64), np.searchsorted(own[order], np.arange(1, len(tokens))))


def _sketch(tokens: np.ndarray) -> np.ndarray:
    two = (_mix(tokens.astype(np.uint64), 0xB1) & np.uint64(3)).reshape(len(tokens), -1, 32)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64)


@dataclass(frozen=True)
class Method:
    """words: shingle length; share: least similarity; trees and depth: of the first branching; small: most members
    outside a node's largest component for it to be compared exhaustively, and few: by a join; recall: least share of the pairs of least
    similarity that are to meet in a node that is compared, at whatever depth."""

    words: int = 5
    share: tuple[int, int] = (80, 100)
    trees: int = 10
    depth: int = 3
    small: int = 2048
    few: int = 8
    recall: float = 0.9998

    def missed(self, trees: Sequence[int], depth: int) -> float:
        """Share of the pairs of least similarity that meet in no tree at a depth.  trees: the number of trees for each
        draw of tokens; the trees of a draw all depend on how many of its tokens a pair has in common."""
        j = self.share[0] / self.share[1]
        agree = np.arange(TOKENS + 1)
        weights = np.array([math.comb(TOKENS, k) * j**k * (1 - j) ** (TOKENS - k) for k in range(TOKENS + 1)])
        apart = np.zeros(TOKENS + 1)
        for _ in range(depth):
            lost = 1 - agree / TOKENS * (1 - apart)
            apart = (3 * lost + lost**2) / 4
        return float(np.prod([(weights * apart**n).sum() for n in trees]))

    def more_trees(self, trees: Sequence[int], depth: int) -> int:
        """Trees of a new draw that, besides the given ones, lead to the recall at a depth."""
        n = 0
        while self.missed([*trees, n], depth) > 1 - self.recall:
            n += 1
        return n

    @property
    def least_matches(self) -> int:
        """Agreeing sketch tokens of a pair that is worth confirming: four standard deviations below the mean."""
        j = self.share[0] / self.share[1]
        p = (1 + 3 * j) / 4
        return int(SKETCHED * p - 4 * (SKETCHED * p * (1 - p)) ** 0.5)


_SKETCH_NAMES = tuple(f"s{i}" for i in range(SKETCHED // 32))
_LONGS = ", ".join(f"{s} long" for s in _SKETCH_NAMES)
_SIGNED = f"n_shingles long, h1 long, h2 long, {_LONGS}, tokens binary, paths array<long>"


def _signed(method: Method, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            start = 0
            while start < len(texts):
                sets, size, end = [], 0, start
                while end < len(texts) and size < BLOCK_BYTES:
                    text = (texts[end].as_py() or "").encode("utf-8", "surrogatepass").lower()
                    sets.append(shingle_hashes(text, method.words))
                    size, end = size + len(text) + 1, end + 1
                yield _block(batch.column(0).slice(start, end - start), sets, method, schema)
                start = end

    return rows


def _block(ids: pa.Array, sets: list[np.ndarray], method: Method, schema: pa.Schema) -> pa.RecordBatch:
    n = len(sets)
    full = np.array([i for i in range(n) if len(sets[i])], dtype=np.int64)
    h1 = np.array([_mix(s, 0xC1).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64)
    h2 = np.array([np.bitwise_xor.reduce(_mix(s, 0xC2)) if len(s) else 0 for s in sets], dtype=np.uint64)
    sketches = np.zeros((n, SKETCHED // 32), dtype=np.uint64)
    tokens: list[bytes | None] = [None] * n
    paths: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * n
    if len(full):
        minwise = _minwise([sets[i] for i in full], _FACTORS, _SHIFTS)
        sketches[full] = _sketch(minwise)
        minwise = np.ascontiguousarray(minwise[:, :TOKENS])
        parts = _rooted(minwise, range(max(method.trees, method.more_trees([], method.depth))), method.depth)
        for k, i in enumerate(full):
            tokens[i] = minwise[k].tobytes()
            paths[i] = parts[k]
    as_long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array([len(s) for s in sets], pa.int64()), as_long(h1), as_long(h2),
            *[as_long(sketches[:, j]) for j in range(SKETCHED // 32)], pa.array(tokens, pa.binary()), pa.array(paths, pa.list_(pa.int64())),
        ],
        schema=schema,
    )


def _packed(hashes: np.ndarray) -> bytes:
    """48 of the 64 bits of each hash; sets stay sorted."""
    return (hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _set_rows(words: int, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, size = [], [], 0
            for ident, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(ident.as_py())
                sets.append(_packed(shingle_hashes(text.as_py().encode("utf-8", "surrogatepass").lower(), words)))
                size += len(sets[-1])
                if size > BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, schema.types[0]), pa.array(sets, pa.binary())], schema=schema)
                    ids, sets, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, schema.types[0]), pa.array(sets, pa.binary())], schema=schema)

    return rows


def _confirmed(share: tuple[int, int], schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, dtype=np.uint64))
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = a.as_py(), b.as_py()
                if a != last[0]:
                    last = (a, _unpacked(a))
                other = _unpacked(b)
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(share[1] * common >= share[0] * (len(last[1]) + len(other) - common))
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], schema=schema)

    return rows


def _similar(method: Method):
    """Whether sizes and sketches of the rows a and b leave the wanted similarity possible."""
    few, many = method.share
    sizes = (F.col("a.n_shingles") * many >= F.col("b.n_shingles") * few) & (F.col("b.n_shingles") * many >= F.col("a.n_shingles") * few)
    return sizes & (_matches() >= method.least_matches)


def _matches():
    """Minwise tokens whose two sketch bits agree."""
    lost = F.lit(0)
    for s in _SKETCH_NAMES:
        x = F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))
        lost = lost + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return F.lit(SKETCHED) - lost


def confirm(texts: DataFrame, pairs: DataFrame, method: Method) -> DataFrame:
    """Those of the pairs (src, dst) whose full shingle sets are similar enough."""
    spark = texts.sparkSession
    at = [shared_path(spark, name) for name in ("pairs", "sets")]
    pairs = write_to(pairs, at[0])
    members = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id")))
    kind = texts.schema["id"].dataType.simpleString()
    spec = f"id {kind}, words binary"
    sets = maybe_in(texts, members, ["id"]).mapInArrow(_set_rows(method.words, to_arrow_schema(StructType.fromDDL(spec))), spec)
    sets = write_to(sets.join(members.distinct(), "id", "left_semi"), at[1])
    both = (
        pairs.join(sets.select(F.col("id").alias("dst"), F.col("words").alias("other")), "dst")
        .join(sets.select(F.col("id").alias("src"), F.col("words").alias("own")), "src")
        .select("src", "dst", "own", "other")
    )
    spec = f"src {kind}, dst {kind}"
    links = written(both.mapInArrow(_confirmed(method.share, to_arrow_schema(StructType.fromDDL(spec))), spec).distinct(), "links")
    remove(spark, *at)
    return links


def _met_before(places: list[np.ndarray], a: int, others: np.ndarray, path: int) -> np.ndarray:
    """Whether a and each of the others name a common node before this one."""
    mine = places[a][places[a] < path]
    if not len(mine) or not len(others):
        return np.zeros(len(others), dtype=bool)
    joined = np.concatenate([places[b] for b in others])
    starts = np.concatenate(([0], np.cumsum([len(places[b]) for b in others])[:-1]))
    found = mine[np.minimum(np.searchsorted(mine, joined), len(mine) - 1)] == joined
    return np.logical_or.reduceat(found, starts)


def _linked_in_block(method: Method, schema: pa.Schema):
    """Of one block of a node: links (sure) between the probes and the block's members that join two components, and the
    pairs with a long set, which are left to be confirmed."""
    least, (few, many) = method.least_matches, method.share

    def links(table: pa.Table) -> pa.Table:
        plain = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        path, probe, outside, size = int(table.column("path")[0].as_py()), plain("probe"), plain("outside"), plain("n_shingles")
        rank, part = (np.unique(plain(name), return_inverse=True)[1] for name in ("id", "part"))
        sketches = np.stack([plain(s) for s in _SKETCH_NAMES], axis=1).view(np.uint64)
        places = [np.asarray(x.values) for x in table.column("places").combine_chunks()]
        sets = [None if x is None else _unpacked(x) for x in table.column("words").to_pylist()]
        carried = np.array([x is not None for x in sets])
        stored = np.flatnonzero(~probe)
        out: list[tuple[int, int, bool]] = []
        for a in np.flatnonzero(probe):
            near = (part[stored] != part[a]) & (~outside[stored] | (rank[a] < rank[stored]))
            near &= (size[stored] * many >= size[a] * few) & (size[a] * many >= size[stored] * few)
            others = stored[near]
            lost = sketches[others] ^ sketches[a]
            lost = np.bitwise_count((lost | (lost >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
            others = others[SKETCHED - lost >= least]
            others = others[~_met_before(places, a, others, path)]
            exact = carried[others] & carried[a]
            out.extend((a, b, False) for b in others[~exact])
            others = others[exact]
            if not len(others):
                continue
            joined = np.concatenate([sets[b] for b in others])
            starts = np.concatenate(([0], np.cumsum([len(sets[b]) for b in others])[:-1]))
            own = sets[a]
            held = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
            common = np.add.reduceat(held.astype(np.int64), starts)
            found = others[many * common >= few * (len(own) + np.array([len(sets[b]) for b in others]) - common)]
            parts, first = np.unique(part[found], return_index=True)
            out.extend((a, b, True) for b in found[first])
            part[np.isin(part, parts)] = part[a]
        ids = table.column("id").combine_chunks()
        ends = [ids.take(pa.array([x[i] for x in out], pa.int64())) for i in (0, 1)]
        return pa.Table.from_arrays([*ends, pa.array([x[2] for x in out], pa.bool_())], schema=schema)

    return links


def _linked_in_blocks(texts: DataFrame, nodes: DataFrame, method: Method) -> DataFrame:
    """src, dst, sure over the nodes (path, id, part, outside, n and sketches): every member outside the largest component
    meets all others in blocks of bounded size."""
    spark, kind = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    members = nodes.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("path")), 1, NAMED_NODES).alias("places"))
    spec = f"id {kind}, words binary"
    sets = maybe_in(texts, members, ["id"]).mapInArrow(_set_rows(method.words, to_arrow_schema(StructType.fromDDL(spec))), spec)
    carried = F.when(F.length("words") <= CARRIED_BYTES, F.col("words")).alias("words")
    at = shared_path(spark, "members")
    members = write_to(members.join(sets.select("id", carried), "id"), at)
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    own = nodes.withColumn("block", F.pmod(F.hash("id"), blocks)).withColumn("probe", F.lit(False))
    probes = nodes.where("outside").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("probe", F.lit(True))
    columns = ["path", "block", "probe", "id", "part", "outside", *_SKETCH]
    rows = own.select(columns).unionByName(probes.select(columns)).join(members, "id")
    spec = f"src {kind}, dst {kind}, sure boolean"
    found = rows.groupBy("path", "block").applyInArrow(_linked_in_block(method, to_arrow_schema(StructType.fromDDL(spec))), spec)
    found = written(found, "block-links")
    remove(spark, at)
    return found


def _branched(nodes: DataFrame, tokens: DataFrame, depth: int) -> DataFrame:
    """The nodes (path, draw, id) some levels down."""
    spec = f"path long, draw int, id {nodes.schema['id'].dataType.simpleString()}"
    schema = to_arrow_schema(StructType.fromDDL(spec))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                minwise = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
                paths, own = np.asarray(batch.column(0)).view(np.uint64), np.arange(len(batch))
                for _ in range(depth):
                    paths, own = _branch(paths, own, minwise)
                taken = [batch.column(i).take(pa.array(own)) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), *taken], schema=schema)

    return nodes.select("path", "draw", "id").join(tokens, ["id", "draw"]).select("path", "draw", "id", "tokens").mapInArrow(rows, spec).distinct()


def _replanted(texts: DataFrame, ids: DataFrame, method: Method, draw: int, trees: range, depth: int) -> DataFrame:
    """id, draw, tokens and paths of the documents with the given ids in new trees, by tokens of a new draw."""
    spec = f"id {texts.schema['id'].dataType.simpleString()}, draw int, tokens binary, paths array<long>"
    schema = to_arrow_schema(StructType.fromDDL(spec))
    factors, shifts = (x[:TOKENS] for x in _hashed(2018, draw))
    most = max(1, int(BLOCK_BYTES / (8 * len(trees) * 1.25**depth)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sets, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                found = shingle_hashes(data, method.words)
                if len(found):
                    own, sets, size = [*own, i], [*sets, found], size + len(data)
                if size > BLOCK_BYTES or len(own) == most:
                    yield block(batch.column(0), own, sets)
                    own, sets, size = [], [], 0
            if own:
                yield block(batch.column(0), own, sets)

    def block(ids: pa.Array, own: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        minwise = _minwise(sets, factors, shifts)
        columns = [
            ids.take(pa.array(own)), pa.array([draw] * len(own), pa.int32()), pa.array([x.tobytes() for x in minwise], pa.binary()),
            pa.array(_rooted(minwise, trees, depth), pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return maybe_in(texts, ids, ["id"]).mapInArrow(rows, spec).join(ids, "id", "left_semi")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (id, part) after links between parts; what has no label is a part of its own."""
    if links.isEmpty():
        return labels
    parts = links
    for end in ("src", "dst"):
        own = labels.select(F.col("id").alias(end), F.col("part").alias("_part"))
        parts = parts.join(own, end, "left").withColumn(end, F.coalesce("_part", end)).drop("_part")
    joined = written(components(parts.distinct()), "parts")
    moved = labels.join(joined, labels["part"] == joined["node"], "left").select("id", F.coalesce("component", "part").alias("part"))
    new = joined.join(labels, joined["node"] == labels["id"], "left_anti").select(F.col("node").alias("id"), F.col("component").alias("part"))
    return written(moved.unionByName(new), "labels")


_SKETCH = ("n_shingles", *_SKETCH_NAMES)


def link(docs: DataFrame, method: Method = Method(), id_col: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """Per row of docs: id, n_shingles and component_id, the smallest id reachable over similar documents.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing.  Rows that repeat an
    id with another text may be linked through either text.  Rows without an id come back with component_id null.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    spec = f"id {kind}, {_SIGNED}"
    signed = written(texts.mapInArrow(_signed(method, to_arrow_schema(StructType.fromDDL(spec))), spec), "signed")
    known = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    # One representative per distinct set: copies need no comparison.
    same = ["n_shingles", "h1", "h2"]
    head = F.struct("id", *_SKETCH[1:], "tokens", "paths")
    heads = written(known.groupBy(*same).agg(F.min_by(head, "id").alias("head")).select(*same, "head.*"), "heads")
    classes = heads.select(*same, F.col("id").alias("rep"))
    sketches = heads.select("id", *_SKETCH)
    rows = heads.select(F.explode(F.array_distinct("paths")).alias("path"), "id")

    # 1. One pivot per document: the one whose sketch agrees best.
    nodes = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1")
    spark = docs.sparkSession
    at_nodes = shared_path(spark, "nodes")
    nodes = write_to(rows.join(nodes, "path").select("path", F.lit(0).alias("draw"), "id", "n", "pivot"), at_nodes)
    met = nodes.where(F.col("id") != F.col("pivot")).select("pivot", "id").distinct()
    scored = (
        met.join(sketches.select(F.col("id"), F.struct(*_SKETCH).alias("b")), "id")
        .join(sketches.select(F.col("id").alias("pivot"), F.struct(*_SKETCH).alias("a")), "pivot")
        .where(_similar(method))
        .groupBy("id")
        .agg(F.max_by("pivot", F.struct(_matches().alias("m"), F.col("pivot"))).alias("pivot"))
    )
    links = confirm(texts, scored.select(F.col("pivot").alias("src"), F.col("id").alias("dst")), method)

    tokens = heads.select("id", F.lit(0).alias("draw"), "tokens")
    depth, trees = method.depth, [max(method.trees, method.more_trees([], method.depth))]
    labels = written(components(links).select(F.col("node").alias("id"), F.col("component").alias("part")), "labels")
    while True:
        labelled = nodes.join(labels, "id", "left").select("path", "draw", "id", F.coalesce("part", "id").alias("part"))
        shares = labelled.groupBy("path", "part").agg(F.count("*").alias("m"), F.min("id").alias("least"))
        shares = shares.groupBy("path").agg(
            F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("part", F.struct("m", "part")).alias("main"), F.min("least").alias("pivot")
        )
        mixed = labelled.join(shares.where(F.col("most") < F.col("n")), "path").join(sketches, "id")
        at_mixed = shared_path(spark, "mixed")
        mixed = write_to(mixed.withColumn("outside", F.col("part") != F.col("main")), at_mixed)
        remove(spark, at_nodes)
        # 3. Nodes with few members outside their largest component: these against all of other components.
        rest = F.col("n") - F.col("most")
        few = mixed.where(rest <= min(method.few, method.small))
        once = ~F.col("b.outside") | (F.col("a.id") < F.col("b.id"))
        across = (F.col("a.path") == F.col("b.path")) & (F.col("a.part") != F.col("b.part")) & once
        pairs = few.where("outside").alias("a").join(few.alias("b"), across & _similar(method))
        # 4. The others are compared with one pivot, which joins what is alike, and branch on.
        large = mixed.where(rest > method.small)
        star = (F.col("a.path") == F.col("b.path")) & (F.col("a.part") != F.col("b.part"))
        stars = large.where(F.col("id") == F.col("pivot")).alias("a").join(large.alias("b"), star & _similar(method))
        pairs = pairs.select("a.id", F.col("b.id").alias("other")).unionByName(stars.select("a.id", F.col("b.id").alias("other")))
        pairs = pairs.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"))
        blocks = mixed.where((rest > method.few) & (rest <= method.small))
        sure = None
        if not blocks.isEmpty():
            found = _linked_in_blocks(texts, blocks, method)
            sure = found.where("sure").select("src", "dst")
            pairs = pairs.unionByName(found.where("not sure").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
        links = confirm(texts, pairs.distinct(), method)
        labels = _merged(labels, links.unionByName(sure) if sure is not None else links)
        if large.isEmpty():
            remove(spark, at_mixed)
            break
        rows = _branched(large, tokens, method.depth)
        depth += method.depth
        n = method.more_trees(trees, depth)
        if n:
            ids = large.select("id").distinct()
            new = written(_replanted(texts, ids, method, len(trees), range(sum(trees), sum(trees) + n), depth), "trees")
            tokens = tokens.unionByName(new.select("id", "draw", "tokens"))
            rows = rows.unionByName(new.select(F.explode("paths").alias("path"), "draw", "id").distinct())
        trees.append(n)
        nodes = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        at_nodes = shared_path(spark, "nodes")
        nodes = write_to(rows.join(nodes, "path").select("path", "draw", "id"), at_nodes)
        remove(spark, at_mixed)
    labels = labels.select(F.col("id").alias("rep"), F.col("part").alias("component_id"))
    placed = classes.join(labels, "rep", "left").select(*same, F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("id", *same).join(placed, same, "left")
    return out.select(
        "id", "n_shingles",
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, method: Method = Method(), id_col: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """Documents with all their columns, without those whose component has a smaller id.  Rows without an id stay."""
    linked = link(docs, method, id_col, text)
    gone = linked.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
