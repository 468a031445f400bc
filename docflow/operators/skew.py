"""Hot-key handling shared by joins and ordered windows.

A key may hold a large share of all rows.  Plain windows and plain joins put every row of a key into
one task, so rows of such keys take another route here.  Routing never changes results: a key that is
wrongly taken for hot (or missed) only changes where its rows are processed.

`hot_keys` asks for keys with more than 1/limit of all rows, so by counting there are at most `limit`
of them, whatever the size of the data.  That is the proof behind every broadcast in this module.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.session import cut_lineage

HOT_LIMIT = 1000
HOT_MIN_ROWS = 1_000_000
SMALL_ROWS = 50_000
#: Rows that a task of an ordered window sorts and buffers.
TASK_ROWS = 500_000


def key_hash(cols: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def hot_keys(
    df: DataFrame, cols: Sequence[str], min_rows: int | None = None, limit: int = HOT_LIMIT
) -> list[int]:
    """Hashes of the keys holding more than 1/limit of the rows and at least `min_rows` rows.

    One pass over the key columns only, with a frequent-items sketch merged from the tasks, so it
    needs no shuffle by key.
    """
    return hot_and_rows(df, cols, min_rows, limit)[0]


def hot_and_rows(
    df: DataFrame, cols: Sequence[str], min_rows: int | None = None, limit: int = HOT_LIMIT
) -> tuple[list[int], int]:
    """hot_keys, and the number of all rows."""
    min_rows = HOT_MIN_ROWS if min_rows is None else min_rows
    row = (
        df.select(key_hash(cols).alias("h"))
        .agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {limit}, {limit * 10})").alias("top"))
        .first()
    )
    cut = max(min_rows, row["n"] / limit)
    return sorted(item["item"] for item in row["top"] if item["count"] >= cut), row["n"]


def _dealt(df: DataFrame, part: Sequence[str], rows: int) -> DataFrame:
    """`df` dealt by key over so many tasks that each gets about TASK_ROWS rows, where the session has fewer."""
    n = -(-rows // TASK_ROWS)
    if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(n, *part)


def dealt_by(df: DataFrame, part: Sequence[str], rows: int) -> DataFrame:
    """`df` dealt by key once, for an aggregate and a join after it, over so many tasks that `rows` rows ask for."""
    out = _dealt(df, part, rows)
    return df.repartition(*part) if out is df else out


def _is_hot(cols: Sequence[str], hot: Sequence[int]) -> Column:
    return key_hash(cols).isin(list(hot))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot: Sequence[int] | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Join a large `left` to a `right` holding one row per key (or a few, bounded by the schema).

    Rows of hot keys meet a broadcast of the right rows of at most HOT_LIMIT keys; all others go through
    an ordinary shuffle join: `right` grows with the data, and its size on disk, which Spark would go by, says little of
    its size in memory once leaves are exploded from it.
    """
    on = list(on)
    if hot is None:
        hot = hot_keys(left, on, min_rows)
    if not hot:
        return left.join(right.hint("merge"), on, how)
    cold = left.where(~_is_hot(on, hot)).join(right.where(~_is_hot(on, hot)).hint("merge"), on, how)
    warm = left.where(_is_hot(on, hot)).join(F.broadcast(right.where(_is_hot(on, hot))), on, how)
    return cold.unionByName(warm)


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], hot: Sequence[int], salts: int = 32
) -> DataFrame:
    """Inner join whose hot left keys are spread over `salts` copies of the matching right rows."""
    on = list(on)
    if not hot:
        return left.join(right, on)
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    cold = left.where(~_is_hot(on, hot)).join(right.where(~_is_hot(on, hot)), on)
    copies = right.where(_is_hot(on, hot)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    warm = left.where(_is_hot(on, hot)).withColumn("_salt", spread).join(copies, [*on, "_salt"]).drop("_salt")
    return cold.unionByName(warm)


def small_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = SMALL_ROWS
) -> DataFrame:
    """Join a large `left` to a table over types, keys or rules, whose keys are few and therefore hot.

    The right side is computed once and counted; up to `max_rows` rows it is broadcast, which spares the
    shuffle of `left`, and beyond that the join goes by hot keys.
    """
    right = cut_lineage(right)
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), list(on), how)
    return lookup_join(left, right, on, how)


def _range_pieces(df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cut the ordered rows of every key into evenly filled range partitions; `_piece` numbers them in
    order.

    Range bounds come from a sample, and a second run of the same plan may sample other bounds, so the
    pieces are fixed by a reliable checkpoint before two branches read them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = df.repartitionByRange(n, *part, *order).withColumn("_piece", F.spark_partition_id())
    return cut_lineage(pieces)


def _shifted_hot(df, part, order, struct, offset):
    # Inside a piece the neighbour comes from a window over (key, piece); across pieces it comes from
    # the edge rows, of which there are at most keys + partitions, because the pieces are ranges.
    pieces = _range_pieces(df, part, order)
    shift = F.lead if offset > 0 else F.lag
    inner = Window.partitionBy(*part, "_piece").orderBy(*order)
    rows = pieces.withColumn("_near", shift(struct).over(inner))
    order_struct = F.struct(*order)
    pick = F.min_by if offset > 0 else F.max_by
    edges = pieces.groupBy(*part, "_piece").agg(pick(struct, order_struct).alias("_edge"))
    across = Window.partitionBy(*part).orderBy("_piece")
    edges = edges.withColumn("_edge", shift("_edge").over(across))
    return (
        rows.join(F.broadcast(edges), [*part, "_piece"], "left")
        .withColumn("_near", F.coalesce("_near", "_edge"))
        .drop("_edge", "_piece")
    )


def neighbour(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    take: dict[str, str],
    offset: int = 1,
    hot: Sequence[int] | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Add columns of the next (offset=1) or previous (offset=-1) row of the same key.

    `take` maps source column to new column.  `order` must be a total order within the key for a
    deterministic result.
    """
    if offset not in (1, -1):
        raise ValueError("offset must be 1 or -1")
    part, order = list(part), list(order)
    rows = 0
    if hot is None:
        hot, rows = hot_and_rows(df, part, min_rows)
    struct = F.struct(*[F.col(c) for c in take])
    shift = F.lead if offset > 0 else F.lag
    window = Window.partitionBy(*part).orderBy(*order)
    if hot:
        cold = _dealt(df.where(~_is_hot(part, hot)), part, rows).withColumn("_near", shift(struct).over(window))
        warm = _shifted_hot(df.where(_is_hot(part, hot)), part, order, struct, offset)
        out = cold.unionByName(warm)
    else:
        out = _dealt(df, part, rows).withColumn("_near", shift(struct).over(window))
    for source, target in take.items():
        out = out.withColumn(target, F.col("_near")[source])
    return out.drop("_near")


def number_rows(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    name: str,
    hot: Sequence[int] | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Add `name` = 1-based position of the row in its key's order."""
    part, order = list(part), list(order)
    rows = 0
    if hot is None:
        hot, rows = hot_and_rows(df, part, min_rows)
    window = Window.partitionBy(*part).orderBy(*order)
    plain = F.row_number().over(window).cast("long")
    if not hot:
        return _dealt(df, part, rows).withColumn(name, plain)
    cold = _dealt(df.where(~_is_hot(part, hot)), part, rows).withColumn(name, plain)
    pieces = _range_pieces(df.where(_is_hot(part, hot)), part, order)
    inner = Window.partitionBy(*part, "_piece").orderBy(*order)
    before = Window.partitionBy(*part).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*part, "_piece")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    warm = (
        pieces.withColumn(name, F.row_number().over(inner).cast("long"))
        .join(F.broadcast(offsets), [*part, "_piece"])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_piece", "_before")
    )
    return cold.unionByName(warm)


def running_sum(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    hot: Sequence[int] | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Add `name` = sum of `value` over the rows before this one in its key's order (0 for the first).

    `order` must be a total order within the key.
    """
    part, order = list(part), list(order)
    rows = 0
    if hot is None:
        hot, rows = hot_and_rows(df, part, min_rows)
    before = Window.unboundedPreceding, -1

    def total(window):
        return F.coalesce(F.sum(value).over(window.rowsBetween(*before)), F.lit(0))

    plain = total(Window.partitionBy(*part).orderBy(*order))
    if not hot:
        return _dealt(df, part, rows).withColumn(name, plain)
    cold = _dealt(df.where(~_is_hot(part, hot)), part, rows).withColumn(name, plain)
    pieces = _range_pieces(df.where(_is_hot(part, hot)), part, order)
    per_piece = pieces.groupBy(*part, "_piece").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*part).orderBy("_piece").rowsBetween(*before)
    offsets = per_piece.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    warm = (
        pieces.withColumn(name, total(Window.partitionBy(*part, "_piece").orderBy(*order)))
        .join(F.broadcast(offsets), [*part, "_piece"])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_piece", "_before")
    )
    return cold.unionByName(warm)
