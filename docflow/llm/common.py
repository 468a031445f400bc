"""Shared helpers: tables written to the cluster's shared folder, and column-name safety."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables written inside a `recorded` block, oldest first; None outside.
_record: list[str] | None = None


def write_to(df: DataFrame, path: str) -> DataFrame:
    """Write `df` as a compressed table and read it again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a new table in the shared folder and read it again.

    The result has no lineage: a lost executor costs the tasks that ran on it, not the work before.
    """
    path = shared_path(df.sparkSession, name)
    if _record is not None:
        _record.append(path)
    return write_to(df, path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of `write_to` that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Note in `paths` the tables that `written` makes inside the block."""
    global _record
    before, _record = _record, paths
    try:
        yield
    finally:
        _record = before


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names (in any case) an operator is about to write."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of the filter below, in words of 64: some 4 MB to broadcast, whatever the data.
FILTER_BITS = 1 << 24


def maybe_in(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `df` whose key may be among the members': a bitmap of hashed keys keeps most others out of the shuffle
    of the exact join that has to follow.  Its size is fixed; with more members it only lets more rows through."""
    slot, word, mask = fresh(df, "slot"), fresh(df, "word"), fresh(df, "mask")
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))
    words = (
        members.select(place.alias(slot))
        .groupBy(F.shiftright(slot, 6).alias(word))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{slot}` % 64 as int))")).alias(mask))
    )
    placed = df.withColumn(slot, place).withColumn(word, F.shiftright(slot, 6))
    held = F.getbit(F.col(mask), (F.col(slot) % 64).cast("int")) == 1
    return placed.join(F.broadcast(words), word).where(held).drop(slot, word, mask)
