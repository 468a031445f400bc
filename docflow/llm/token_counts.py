"""Counting tokens with a byte-level BPE tokenizer that is compiled to a deterministic finite-state transducer.

Inside one word the last token of the encoding of every prefix is unique: the token t that ends there and whose
predecessor p, the last token of the encoding before it, encodes with it to (p, t) again.  What the next bytes can still
change lies within the longest suffix that begins some token, so a state holds that suffix and, for its positions, the
last token and the count relative to here.  These states are finite, every transition has one target, and it is annotated
with the number of tokens by which the count changes.  Around them stand the states of the word pattern (letters, digits,
others, contractions, the space that joins the next word) and of the special strings.  States and transitions are compiled
when first met; words that end in a space are transitions of their own.

Texts longer than a chunk are cut at byte offsets and their chunks are dealt out.  A chunk's state map needs no start
state: up to the first white space after another character it depends on where it came from (its head), from there on the
state is known.  The map is (head, count after it, bytes since the last such place); maps compose associatively, and two
rounds of composing neighbours, 256 at a time, cover every text that a row can hold.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docflow.llm.packing import _byte_letters

CHUNK = 1 << 16
FAN = 256
LIMIT = 1024
#: A worker starts to compile anew beyond so many states, and keeps so many words of so many bytes.
MOST_STATES, MOST_WORDS, LONGEST_WORD = 250_000, 300_000, 64
#: Transitions are kept in an array for so many different bytes; those of other bytes are worked out each time.
COLUMNS = 64
_NONE = [0] * COLUMNS
#: The difference zero between two counts, as stored.
ZERO = 1 << 15

#: The contractions that this kind of tokenizer cuts off, by what follows the apostrophe.
SHORT_CONTRACTIONS = "stmd"
LONG_CONTRACTIONS = {"r": "e", "v": "e", "l": "l"}
#: Fixed value: white space of Unicode.
SPACES = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

#: White space after a byte that ends another character (never a byte that may end white space).
KNOWN_STATE = re.compile(rb"[!-~\x90-\x9e\xb0-\xbf][\t-\r ]")


class Vocabulary:
    """Tokens as bytes with their merges, read from a file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        cut, model = stored["pre_tokenizer"], stored["model"]
        if stored["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE with the standard word pattern and no normalizer can be compiled")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in stored["added_tokens"]):
            raise ValueError("special strings that take in their surroundings cannot be compiled")
        self.special = [t["content"].encode() for t in stored["added_tokens"]]
        if len(self.special) > 1 or any(re.search(rb"\s", s) or s[:1] in s[1:] for s in self.special):
            raise ValueError("one special string whose first byte does not come again can be compiled")
        letters = _byte_letters()
        added = {t["content"] for t in stored["added_tokens"]}
        own = (bytes(letters[c] for c in t) for t in model["vocab"] if t not in added)
        self.tokens = {t: i for i, t in enumerate(own, 1)}
        self.starts = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.ranks: dict[int, int] = {}
        # The merge that makes a token; its parts are listed before it.
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (bytes(letters[c] for c in side) for side in (pair.split(" ") if isinstance(pair, str) else pair))
            ids = self.tokens[left], self.tokens[right]
            self.ranks[ids[0] << 20 | ids[1]] = rank
            self.made.setdefault(self.tokens[left + right], (rank, *ids))
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._together: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at the left (1) or right (2) edge of a token while it is merged, each with the rank that ends it."""
        found = self._edges.get((token, side))
        if found is None:
            found = [(token, len(self.ranks))]
            while found[-1][0] in self.made:
                merge = self.made[found[-1][0]]
                found.append((merge[side], merge[0]))
            self._edges[token, side] = found
        return found

    def together(self, before: int, token: int) -> bool:
        """Whether `token` can follow `before` (0: the start of a word) in an encoding: no merge across their border
        comes first.

        Merges run in order of their ranks, equal ones from the left, and up to the first merge across the border both
        sides go on as if alone.  So one of their edge pieces would have to merge with one of the other side while both
        are there.
        """
        if not before:
            return True
        key = before << 20 | token
        found = self._together.get(key)
        if found is None:
            if len(self._together) > MOST_WORDS:
                self._together.clear()
            ranks, right = self.ranks, self._edge(token, 1)
            found = True
            for left, left_until in self._edge(before, 2):
                for piece, until in right:
                    rank = ranks.get(left << 20 | piece)
                    if rank is not None and rank < left_until and rank <= until:
                        found = False
            self._together[key] = found
        return found


class _Words(dict):
    """Transitions of one state over words that end in a space: word -> (the next state's table, change of the count)."""

    def __init__(self, machine: Transducer, state: int):
        self.machine, self.state = machine, state

    def __missing__(self, word: bytes) -> tuple[_Words, int]:
        state, count = self.machine.run(self.state, word + b" ")
        found = self.machine.words(state), count
        if len(word) <= LONGEST_WORD and self.machine.stored < MOST_WORDS:
            self[word] = found
            self.machine.stored += 1
        return found


class Transducer:
    """A deterministic transducer over bytes; `run` gives the state reached and the count of tokens on the way.

    Its state is (held bytes of a special string, bytes of an unfinished character, word state).  Word states are
    ("start",), (class, prefix) for letters, digits and others, ("quote", prefix), ("contraction", letter, prefix) and
    ("space", prefix, last): white space without its last character, which may join the next word and is not counted.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.special = self.vocabulary.special[0] if self.vocabulary.special else b""
        self.empty = (b"", (ZERO,))
        self.clear()

    def clear(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        # Transitions over the bytes met first, COLUMNS a state: (next state * COLUMNS) << 8 | change + 128, 0 if not compiled.
        self._steps = array("I")
        self._columns = bytearray(256)
        self._bytes = b"\0"
        self._tables: dict[int, _Words] = {}
        self._endings: dict[bytes, tuple] = {}
        self.stored = 0
        self.start = self._intern((b"", b"", ("start",)))

    def trim(self) -> None:
        """Forget what was compiled once it is too much; call between texts only."""
        if len(self._states) > MOST_STATES:
            self.clear()

    def _intern(self, state: tuple) -> int:
        found = self._ids.setdefault(state, len(self._states))
        if found == len(self._states):
            self._states.append(state)
            self._steps.extend(_NONE)
        return found

    def words(self, state: int) -> _Words:
        if state not in self._tables:
            self._tables[state] = _Words(self, state)
        return self._tables[state]

    # One word: states of byte pair encoding.

    def _ending(self, suffix: bytes) -> tuple:
        """What can follow from a suffix: its longest end that begins a token; sizes and ids of the tokens that may end
        here; for every position of that end, its size if it still matters and else 0."""
        found = self._endings.get(suffix)
        if found is None:
            starts, tokens = self.vocabulary.starts, self.vocabulary.tokens
            sizes = [size if suffix[-size:] in starts else 0 for size in range(len(suffix), 0, -1)]
            while not sizes[0]:
                del sizes[0]
            ends = [(size, tokens[suffix[-size:]]) for size in sizes if suffix[-size:] in tokens and size]
            found = self._endings[suffix] = suffix[-sizes[0] :], ends, sizes
        return found

    def _push(self, prefix: tuple, byte: bytes) -> tuple[tuple, int]:
        """The state after one more byte of a word and the change of the count.

        A state is (suffix, past): for the places before every byte of the suffix and at the end, the last token's id
        << 16 | the count there less the count here + ZERO; 0 for places that no longer matter.
        """
        suffix, past = prefix
        suffix, ends, sizes = self._ending(suffix + byte)
        together = self.vocabulary.together
        for size, token in ends:
            before = past[-size]
            if together(before >> 16, token):
                break
        change = (before & 0xFFFF) - ZERO + 1
        return (suffix, (*[past[-size] - change if size else 0 for size in sizes], token << 16 | ZERO)), change

    def _extend(self, prefix: tuple, char: str) -> tuple[tuple, int]:
        total = 0
        for byte in char.encode():
            prefix, change = self._push(prefix, bytes([byte]))
            total += change
        return prefix, total

    # The word pattern.

    def _begin(self, char: str, joined: bool = False) -> tuple[tuple, int]:
        """The state after a word's first character that is no white space, with or without the space before it."""
        prefix, count = self._extend(self.empty, " ") if joined else (self.empty, 0)
        prefix, more = self._extend(prefix, char)
        kind = "quote" if char == "'" and not joined else _kind(char)
        return (kind, prefix), count + more

    def _char(self, state: tuple, char: str) -> tuple[tuple, int]:
        kind, given = state[0], _kind(char)
        if kind == "space":
            _, prefix, last = state
            if given == "space":
                prefix, count = self._extend(prefix, last)
                return ("space", prefix, char), count
            if last == " ":
                return self._begin(char, joined=True)
            own = self._extend(self.empty, last)[1]
            after, count = self._begin(char)
            return after, own + count
        if given == "space":
            return ("space", self.empty, char), 0
        if kind == "quote":
            if char in SHORT_CONTRACTIONS:
                return ("start",), self._extend(state[1], char)[1]
            if char in LONG_CONTRACTIONS:
                # Counted as an apostrophe and a letter until the next character decides.
                return ("contraction", char, self._extend(self.empty, char)[0]), 1
            kind = "other"
        if kind == "contraction":
            _, letter, prefix = state
            if char == LONG_CONTRACTIONS[letter]:
                whole = self._extend(self.empty, "'" + letter + char)[1]
                return ("start",), whole - 2
            kind, state = "letter", ("letter", prefix)
        if kind == given:
            prefix, count = self._extend(state[1], char)
            return (kind, prefix), count
        return self._begin(char)

    # Bytes: characters, and special strings with the bytes that may yet become one.

    def _byte(self, part: bytes, word: tuple, byte: bytes) -> tuple[bytes, tuple, int]:
        part += byte
        need = 1 if part[0] < 0x80 else 2 if part[0] < 0xE0 else 3 if part[0] < 0xF0 else 4
        if len(part) < need:
            return part, word, 0
        # A chunk may begin inside a character; its head is read again after the bytes before it.
        word, count = self._char(word, part.decode(errors="replace"))
        return b"", word, count

    def _compile(self, state: int, code: int) -> tuple[int, int]:
        held, part, word = self._states[state]
        byte, total = bytes([code]), 0
        if word[0] == "letter" and byte.isalpha() and not held and not part and byte != self.special[:1]:
            prefix, total = self._push(word[1], byte)
            return self._intern((b"", b"", ("letter", prefix))), total
        if self.special[len(held) : len(held) + 1] == byte:
            held += byte
            if held == self.special:
                held, word, total = b"", ("start",), self.finish(word) + 1
        else:
            again = self.special[:1] == byte
            for one in held if again else held + byte:
                part, word, count = self._byte(part, word, bytes([one]))
                total += count
            held = byte if again else b""
        return self._intern((held, part, word)), total

    def finish(self, word: tuple) -> int:
        """By how much the count changes at the end of a text."""
        return self._extend(word[1], word[2])[1] if word[0] == "space" else 0

    def _slow_step(self, state: int, code: int) -> tuple[int, int]:
        """Compile a transition, and store it if its byte has a column."""
        if not self._columns[code] and len(self._bytes) < COLUMNS:
            self._columns[code] = len(self._bytes)
            self._bytes += bytes([code])
        after, change = self._compile(state, code)
        if self._columns[code] and -128 < change < 128:
            self._steps[state * COLUMNS + self._columns[code]] = after * COLUMNS << 8 | change + 128
        return after, change

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        total, steps = 0, self._steps
        at = state * COLUMNS
        for i, column in enumerate(data.translate(self._columns)):
            # Column 0 stands for all bytes without one and holds nothing.
            step = steps[at + column]
            if step:
                at = step >> 8
                total += (step & 255) - 128
            else:
                state, change = self._slow_step(at // COLUMNS, data[i])
                at = state * COLUMNS
                total += change
        return at // COLUMNS, total

    def read(self, data: bytes) -> tuple[int, int]:
        """State and count after `data`, from the start of a text."""
        table, total = self.words(self.start), 0
        *most, last = data.split(b" ")
        for word in most:
            table, count = table[word]
            total += count
        state, count = self.run(table.state, last)
        return state, total + count

    def end(self, state: int) -> int:
        held, part, word = self._states[state]
        total = 0
        for one in held:
            part, word, count = self._byte(part, word, bytes([one]))
            total += count
        return total + self.finish(word)

    def count(self, text: bytes) -> int:
        state, total = self.read(text)
        return total + self.end(state)


def _kind(char: str) -> str:
    if char in SPACES:
        return "space"
    category = unicodedata.category(char)
    if category == "Cn":
        return _kind_unassigned(char)
    return {"L": "letter", "N": "digit"}.get(category[0], "other")


@cache
def _kind_unassigned(char: str) -> str:
    """Characters that are newer than Python's tables: the library tells by what it joins them with."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    return "letter" if len(cut("a" + char)) == 1 else "digit" if len(cut("0" + char)) == 1 else "other"


_WORKER: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a file, kept for the life of a worker."""
    if path not in _WORKER:
        _WORKER[path] = Transducer(path)
    return _WORKER[path]


# State maps of chunks ------------------------------------------------------------------------------------------------

#: head, count after it, tail (bytes from the last known state on), known (whether there is one at all).
Map = tuple[bytes, int, bytes, bool]


def _tail(data: bytes) -> bytes:
    """What decides the state after `data`, which begins in a known state: its bytes from the last such place on."""
    for size in (256, 8192, len(data)):
        places = [m.end() - 1 for m in KNOWN_STATE.finditer(data, max(len(data) - size, 0))]
        if places:
            return data[places[-1] :]
    return data


def state_map(machine: Transducer, chunk: bytes) -> Map:
    place = KNOWN_STATE.search(chunk)
    if not place:
        return chunk, 0, b"", False
    rest = chunk[place.end() - 1 :]
    return chunk[: place.end()], machine.read(rest)[1], _tail(rest), True


def compose(machine: Transducer, first: Map, second: Map) -> Map:
    """The map of two neighbouring stretches; associative."""
    head, count, tail, known = first
    next_head, next_count, next_tail, next_known = second
    if not known:
        return head + next_head, next_count, next_tail, next_known
    between = machine.read(tail + next_head)[1] - machine.read(tail)[1]
    return head, count + between + next_count, next_tail if next_known else _tail(tail + next_head), True


def total(machine: Transducer, whole: Map) -> int:
    """The tokens of a text with this map."""
    head, count, tail, known = whole
    if not known:
        return machine.count(head)
    return machine.read(head)[1] + count + machine.end(machine.read(tail)[0])


# Spark ---------------------------------------------------------------------------------------------------------------

_MAP = "head binary, count long, tail binary, known boolean"


def _count_short(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            found = []
            for text in batch.column(2):
                machine.trim()
                found.append(machine.count(text.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return count


def _map_chunks(path: str, schema: pa.Schema):
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            found: list[Map] = []
            for chunk in batch.column(4):
                machine.trim()
                found.append(state_map(machine, chunk.as_py()))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(schema)[4:], strict=True)] if found else [pa.array([], f.type) for f in list(schema)[4:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], schema=schema)

    return maps


def _compose_group(path: str, schema: pa.Schema, fan: int):
    def composed(own: pa.Table) -> pa.Table:
        machine = transducer(path)
        rows = sorted(own.to_pylist(), key=lambda r: r["at"])
        whole: Map | None = None
        for r in rows:
            machine.trim()
            one = (r["head"], r["count"], r["tail"], r["known"])
            whole = compose(machine, whole, one) if whole else one
        first = rows[0]
        out = [first["row"], first["at"] // fan, first["id"], first["n_bytes"], *whole]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    return composed


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row.

    A null or empty text has no byte and no token.  Repeated rows and null ids each keep a row of their own; other
    columns, whatever their names, take no part.  A text above `chunk` bytes is cut, and its chunks are read by other
    tasks; nothing is left out at any length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))
    size = F.octet_length("data").cast("long")
    short = rows.where(size <= chunk).select("id", size.alias("n_bytes"), "data")
    short = short.mapInArrow(_count_short(path), f"id {kind}, n_bytes long, n_tokens long")

    spec = f"row long, at long, id {kind}, n_bytes long, {_MAP}"
    schema = to_arrow_schema(StructType.fromDDL(spec))
    places = F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / chunk).cast("long"))
    cuts = F.transform(places, lambda i: F.substring(F.col("data"), (i * chunk + 1).cast("int"), F.lit(chunk)))
    long = rows.where(size > chunk).select(F.monotonically_increasing_id().alias("row"), "id", size.alias("n_bytes"), "data")
    maps = long.select("row", "id", "n_bytes", F.posexplode(cuts).alias("at", "data"))
    maps = maps.select("row", F.col("at").cast("long").alias("at"), "id", "n_bytes", "data")
    maps = maps.repartition(F.col("row"), F.col("at")).mapInArrow(_map_chunks(path, schema), spec)
    near = maps.groupBy("row", F.floor(F.col("at") / FAN).alias("_near")).applyInArrow(_compose_group(path, schema, FAN), spec)
    whole = near.groupBy("row").applyInArrow(_compose_group(path, schema, FAN), spec)

    @F.arrow_udf("long")
    def tokens(head: pa.Array, count: pa.Array, tail: pa.Array, known: pa.Array) -> pa.Array:
        machine = transducer(path)
        found = zip(head.to_pylist(), count.to_pylist(), tail.to_pylist(), known.to_pylist(), strict=True)
        return pa.array([total(machine, m) for m in found], pa.int64())

    counted = short.unionByName(whole.select("id", "n_bytes", tokens("head", "count", "tail", "known").alias("n_tokens")))
    return counted.select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
