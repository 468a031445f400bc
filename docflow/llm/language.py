"""Language identification with bit-sliced Bloom filters over byte n-grams.

Every slot of the filter holds one bit per language.  An n-gram is looked up once, in two slots, and the AND of
their masks names all languages that hold it.  A text's languages are compared by the popcounts of their bits,
after taking off the share that chance alone would set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import without

#: Bytes of an n-gram; log2 of the filter's slots; odd multipliers of the two slot functions.
GRAM = 4
SLOT_BITS = 20
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77)
UNDETERMINED = "und"
#: Texts are worked on in blocks of about this many bytes, whatever a batch holds.
BLOCK_BYTES = 4_000_000
#: Scoring takes some 40 bytes for each byte of a block.
SCORE_BYTES = 250_000

_KEEP = bytes(c if c >= 128 or chr(c).isalpha() or c == 39 else 32 for c in range(256))


@dataclass(frozen=True)
class LanguageFilters:
    """languages: names in bit order; masks: one row of slots per 64 languages; chance: false-positive rate of each."""

    languages: tuple[str, ...]
    masks: np.ndarray
    chance: np.ndarray


def _blocks(texts: list[str | None], most: int) -> Iterator[tuple[int, list[bytes]]]:
    start, size, block = 0, 0, []
    for i, text in enumerate(texts):
        words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()
        block.append(b"  " + b" ".join(words) + b"  \n")
        size += len(block[-1])
        if size >= most:
            yield start, block
            start, size, block = i + 1, 0, []
    if block:
        yield start, block


def _grams(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram codes of the joined texts, whether each lies inside one text, and where the texts start."""
    data = np.frombuffer(b"".join(block) + b"\n" * (GRAM - 1), dtype=np.uint8)
    n = len(data) - GRAM + 1
    codes = np.zeros(n, dtype=np.uint32)
    inside = np.ones(n, dtype=bool)
    for k in range(GRAM):
        part = data[k : k + n]
        codes = (codes << np.uint32(8)) | part
        inside &= part != 10
    starts = np.concatenate(([0], np.cumsum([len(b) for b in block])[:-1])).astype(np.int64)
    return codes, inside, starts


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    return [(codes * np.uint32(m)) >> np.uint32(32 - SLOT_BITS) for m in MULTIPLIERS]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for _, block in _blocks([t for t, x in zip(texts, langs, strict=True) if x == lang], BLOCK_BYTES):
                codes, inside, _ = _grams(block)
                grams, n = np.unique(codes[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample_per_language: int = 4000,
    share: float = 0.5,
    min_count: int = 3,
    seed: int = 7,
) -> LanguageFilters:
    """Learn the filters from a bounded sample of labelled rows.

    sample_per_language: about so many rows of each language are read in full; which ones, a hash of the text decides.
    share: a language holds an n-gram if its rate there is at least this share of the n-gram's highest rate.
    min_count: and if it occurs so often in that language's sample.
    Rows without text or label teach nothing.  No rows: no languages, and every prediction is undetermined.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes, key=lambda x: (-sizes[x], x)))
    words = max(1, -(-len(languages) // 64))
    masks = np.zeros((words, 1 << SLOT_BITS), dtype=np.uint64)
    if not languages:
        return LanguageFilters((), masks, np.zeros(0))
    spark = labelled.sparkSession
    order = {name: i for i, name in enumerate(languages)}
    wanted = spark.createDataFrame(
        [(x, order[x], min(1.0, sample_per_language / sizes[x])) for x in languages], "lang string, bit int, rate double"
    )
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    sample = rows.join(F.broadcast(wanted), "lang").where(draw < F.col("rate")).select("lang", "text")
    counts = sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rates.groupBy("gram").agg(
        F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate", "n")).alias("held")
    )
    members = top.select("gram", "top", F.inline("held")).where(
        (F.col("rate") >= F.col("top") * share) & (F.col("n") >= min_count)
    )
    bits = members.join(F.broadcast(wanted.select("lang", "bit")), "lang")
    # The slots of an n-gram, computed as in _slots, so that no n-gram reaches the driver: only slots do.
    slots = [
        F.shiftright((F.col("gram") * F.lit(m)).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - SLOT_BITS) for m in MULTIPLIERS
    ]
    filled = (
        bits.select((F.col("bit") / 64).cast("int").alias("word"), (F.col("bit") % 64).alias("at"), F.explode(F.array(*slots)).alias("slot"))
        .groupBy("word", "slot")
        .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    )
    found = filled.toArrow()
    masks[found["word"].to_numpy(), found["slot"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    fill = [float((masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(languages))]
    return LanguageFilters(languages, masks, np.array(fill) ** len(MULTIPLIERS))


def _scores(texts: list[str | None], model: LanguageFilters) -> tuple[list[str], list[float]]:
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return names, scores
    for start, block in _blocks(texts, SCORE_BYTES):
        codes, inside, starts = _grams(block)
        first, second = _slots(codes)
        n = np.add.reduceat(inside.astype(np.int64), starts)
        corrected = np.zeros((len(model.languages), len(block)))
        for word, masks in enumerate(model.masks):
            held = np.where(inside, masks[first] & masks[second], np.uint64(0))
            for bit in range(min(64, len(model.languages) - 64 * word)):
                i = 64 * word + bit
                hits = np.add.reduceat((held >> np.uint64(bit) & np.uint64(1)).astype(np.int64), starts)
                corrected[i] = np.maximum(0.0, hits - n * model.chance[i]) / max(1e-9, 1 - model.chance[i])
        best = corrected.argmax(axis=0)
        total = corrected.sum(axis=0)
        for k in range(len(block)):
            text = texts[start + k]
            if text is not None and any(c.isalpha() for c in text):
                names[start + k] = model.languages[best[k]]
                scores[start + k] = float(min(1.0, corrected[best[k], k] / total[k])) if total[k] > 0 else 0.0
    return names, scores


def predict(docs: DataFrame, model: LanguageFilters, text: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1: the best language's share of all corrected popcounts).

    A text that is null or has no letter is `und` with score 0; letters that no language knows give the
    language with most labelled rows and score 0, and so are ties decided.  Columns of these names in the
    input are replaced, all other columns and repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.chance))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def identify(texts: pa.Array) -> pa.Array:
        names, scores = _scores(texts.to_pylist(), LanguageFilters(*shared.value))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    kept = without(docs, "lang_pred", "score")
    found = kept.withColumn("_identified", identify(F.col(text)))
    return found.select(*[f"`{c}`" for c in kept.columns], "_identified.lang_pred", "_identified.score")
