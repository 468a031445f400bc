"""Line dedup by winnowing, with DataFrame functions only.

Every window of `run` consecutive lines selects the least of its line hashes, so a run of that length shared by two
places has the same line selected in both.  Selected lines that occur once are done with.  At the others the windows
around the selected line are compared, which extends a match line by line in both directions, and of equal windows all
but the first are repeats.  What repeats of several windows cover makes up the repeated runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import fresh, without, written
from docflow.operators.skew import lookup_join

RUN = 3
LONG = 120


def _signed_lines(text: Column) -> Column:
    """Lines with anything but white space: place, two hashes and length."""
    placed = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    return F.transform(
        F.filter(placed, lambda s: s["line"].rlike(r"\S")),
        lambda s: F.struct(
            s["at"].alias("at"),
            F.xxhash64(s["line"]).alias("h"),
            F.xxhash64(F.lit(17), s["line"]).alias("g"),
            F.length(s["line"]).alias("n"),
        ),
    )


def _windows(run: int) -> Column:
    """All windows of `run` lines: selected hash and its place, hashes of the content, places of the lines."""
    starts = F.when(F.size("lines") >= run, F.sequence(F.lit(1), F.size("lines") - (run - 1)))

    def window(i: Column) -> Column:
        h = F.slice("lines.h", i, run)
        least = F.array_min(h)
        return F.struct(
            i.alias("start"),
            least.alias("selected"),
            (i + F.array_position(h, least).cast("int") - 1).alias("place"),
            F.xxhash64(h).alias("w1"),
            F.xxhash64(F.slice("lines.g", i, run)).alias("w2"),
            F.slice("lines.at", i, run).alias("covers"),
        )

    return F.explode(F.transform(starts, window))


def repeated_lines(signed: DataFrame, order: list[str], run: int = RUN, long: int = LONG) -> DataFrame:
    """_row and the places (array) of its lines that are later repeats.

    signed: _row (unique), the columns of `order`, and lines from _signed_lines.  The first of equal windows is the
    one least in (order, _row, start).
    """
    keys = [*order, "_row"]
    windows = signed.select(*keys, _windows(run).alias("w")).select(*keys, "w.*")
    marks = windows.select("_row", "place", "selected").distinct().groupBy("selected").agg(F.count("*").alias("_n"))
    shared = lookup_join(windows, marks.where("_n > 1").select("selected"), ["selected"])
    # A long line is a run by itself and its own mark.
    numbered = F.explode(F.transform("lines", lambda s, i: F.struct((i + 1).alias("start"), s.alias("s"))))
    alone = signed.select(*keys, numbered.alias("x")).where(F.col("x.s.n") >= long)
    alone = alone.select(
        *keys, F.col("x.start").alias("start"), F.col("x.s.h").alias("w1"), F.col("x.s.g").alias("w2"), F.array("x.s.at").alias("covers")
    )
    place = F.struct(*keys, "start").alias("_place")
    units = shared.select("w1", "w2", "covers", place, F.lit(run).alias("size"))
    units = written(units.unionByName(alone.select("w1", "w2", "covers", place, F.lit(1).alias("size"))), "units")
    firsts = units.groupBy("w1", "w2", "size").agg(F.count("*").alias("_n"), F.min("_place").alias("_first")).where("_n > 1")
    later = lookup_join(units, firsts.select("w1", "w2", "size", "_first"), ["w1", "w2", "size"]).where(F.col("_place") != F.col("_first"))
    return later.groupBy(F.col("_place._row").alias("_row")).agg(F.array_distinct(F.flatten(F.collect_list("covers"))).alias("_gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = RUN, long: int = LONG) -> DataFrame:
    """docs with later repeated runs of lines cut out of the text, and n_lines and n_removed added.

    A repeated run is `run` or more consecutive lines, or a single line of at least `long` characters, that also
    stand at an earlier place: in a document with a smaller id (null first), in an equal row read before, or further
    up in the same document.  Lines of white space do not count and stay.  Null texts stay null, with 0 lines; input
    columns n_lines and n_removed are replaced.
    """
    kept = without(docs, "n_lines", "n_removed")
    row, key = fresh(kept, "_row"), fresh(kept, "_id")
    placed = written(kept.withColumn(row, F.monotonically_increasing_id()), "lines")
    signed = placed.select(F.col(row).alias("_row"), F.col(id_col).alias(key), _signed_lines(F.col(text)).alias("lines"))
    gone = repeated_lines(signed, [key], run, long).withColumnRenamed("_row", row)
    found = placed.join(gone, row, "left")
    lines = F.split(F.col(text), "\n")
    left = F.filter(lines, lambda line, i: ~F.array_contains("_gone", i))
    new = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return found.select(
        *[(new if c == text else F.col(c)).alias(c) for c in kept.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )
