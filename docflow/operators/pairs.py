"""Equal values between documents, counted without listing document pairs.

The number of document pairs that share a value grows with the square of its frequency, so pairs are
never listed.  A pair must count once however many values it shares (array entries give a document
several values under one key), which is had from grouped rows:

* Documents with at most SHORT_SET values under a key (nearly all): by inclusion and exclusion over
  value subsets.  A pair sharing the values S adds +1 for every odd and -1 for every even subset of S,
  which is 1 in total, so the pairs are the signed sum over subsets T of n1(T) * n2(T).  A document
  gives at most 2**SHORT_SET - 1 rows, and they are counted before they meet.
* Longer value sets against one-value documents: the sum over values of n1(v) * n2(v).
* Longer value sets against others: documents with the same set act alike, so different sets meet once
  per pair of sets.  A short set takes the long ones from the lists of its few values, and two long
  sets meet as rows; two short ones never do.  Values held by very many sets ("heavy") meet through the heavy part of the sets
  only; light values meet in groups of bounded size, leaving out pairs already found through a heavy
  value.

A rule keeps its direction: key_1 belongs to cluster_1 and key_2 to cluster_2.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.values import NULL, is_common, norm_text, rule_type
from docflow.operators.skew import lookup_join
from docflow.session import cut_lineage

HEAVY_SETS = 1_000
SHORT_SET = 8
SIDES = ["cluster_1", "key_1", "cluster_2", "key_2"]


def members(leaf: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Distinct (doc_id, cluster, key, norm) of scalar leaves; scalars directly in lists are left out."""
    scalar = leaf.where(F.col("vtype") != "NESTED")
    if "in_list" in leaf.columns:
        scalar = scalar.where(~F.col("in_list"))
    return scalar.select(*(extra or []), "doc_id", "cluster", "key", "norm").distinct()


def common_norm(norm: Column) -> Column:
    return (norm == NULL) | is_common(norm_text(norm), F.lit(""))


def rule_of(key_1: Column, key_2: Column, norm: Column) -> Column:
    return rule_type(key_1, key_2, common_norm(norm))


def _value_sets(rows: DataFrame, by: list[str]) -> DataFrame:
    # The window covers the values of one document under one key, which came out of one row.
    own = Window.partitionBy(*by, "doc_id")
    return (
        rows.withColumn("_k", F.count("*").over(own))
        .withColumn("_g1", F.bit_xor(F.xxhash64("norm")).over(own))
        .withColumn("_g2", F.bit_xor(F.xxhash64("norm", F.lit(29))).over(own))
        # Sets of one value are told by the value.
        .withColumn("_g1", F.when(F.col("_k") > 1, F.col("_g1")))
        .withColumn("_g2", F.when(F.col("_k") > 1, F.col("_g2")))
    )


def _subsets(sets: DataFrame, by: list[str], short: int, same: bool) -> DataFrame:
    """Value subsets of the short sets with their number of documents, as far as they can meet: by, h1, h2, size, kind, n.

    A subset is told by two independent 64-bit hashes; `kind` is p (no common literal), c (only common
    literals) or m (mixed).  Single values are counted as they stand.  A larger subset meets only where each of its
    values is held by short sets of several values of two clusters, so unless `same`, where documents of one cluster
    meet, other values are left out before subsets grow.
    """
    plain, common = F.lit("p"), F.lit("c")
    few = sets.where(F.col("_k") <= short)
    single = few.groupBy(*by, "norm").agg(F.count("*").alias("n")).select(
        *by,
        F.xxhash64("norm").alias("h1"),
        F.xxhash64("norm", F.lit(29)).alias("h2"),
        F.lit(1).alias("size"),
        F.when(~common_norm(F.col("norm")), plain).when(common_norm(F.col("norm")), common).otherwise("m").alias("kind"),
        "n",
    )
    several = few.where(F.col("_k") > 1).select(*by, "doc_id", "norm")
    if not same:
        if several.select("cluster").distinct().limit(2).count() < 2:
            return single
        # By hashes, as subsets meet: there a null is a value as others are.
        hashes = ["h1", "h2"]
        several = several.select("*", F.xxhash64("norm").alias("h1"), F.xxhash64("norm", F.lit(29)).alias("h2"))
        ends = [F.min("cluster").alias("_lo"), F.max("cluster").alias("_hi")]
        held = several.groupBy(*hashes).agg(*ends).where(F.col("_lo") < F.col("_hi")).select(*hashes)
        several = lookup_join(several, held, hashes, "left_semi")
    value = F.struct(
        F.xxhash64("norm").alias("h1"),
        F.xxhash64("norm", F.lit(29)).alias("h2"),
        common_norm(F.col("norm")).alias("common"),
    )
    per_doc = several.groupBy(*by, "doc_id").agg(F.collect_list(value).alias("_v")).where(F.size("_v") > 1)
    empty = F.struct(
        F.lit(0).cast("long").alias("h1"),
        F.lit(0).cast("long").alias("h2"),
        F.lit(0).alias("size"),
        F.lit(True).alias("plain"),
        F.lit(True).alias("common"),
    )

    def with_value(s: Column, v: Column) -> Column:
        return F.struct(
            s["h1"].bitwiseXOR(v["h1"]).alias("h1"),
            s["h2"].bitwiseXOR(v["h2"]).alias("h2"),
            (s["size"] + 1).alias("size"),
            (s["plain"] & ~v["common"]).alias("plain"),
            (s["common"] & v["common"]).alias("common"),
        )

    grown = F.aggregate(
        "_v", F.array(empty), lambda acc, v: F.concat(acc, F.transform(acc, lambda s: with_value(s, v)))
    )
    found = per_doc.select(*by, F.explode(grown).alias("_s")).where(F.col("_s.size") > 1)
    kind = F.when(F.col("_s.plain"), plain).when(F.col("_s.common"), common).otherwise("m")
    grouped = found.groupBy(
        *by,
        F.col("_s.h1").alias("h1"),
        F.col("_s.h2").alias("h2"),
        F.col("_s.size").alias("size"),
        kind.alias("kind"),
    ).agg(F.count("*").alias("n"))
    return single.unionByName(grouped)


def _sign() -> Column:
    return F.when(F.col("size") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))


def _cells(sets: DataFrame, by: list[str], short: int) -> DataFrame:
    """Per key and value: documents with this value only (one) and documents with a long set (long)."""
    return sets.groupBy(*by, "norm").agg(
        F.count_if(F.col("_k") == 1).alias("one"), F.count_if(F.col("_k") > short).alias("long")
    )


def _sided(df: DataFrame, cols: list[str], side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + side) if c in cols else F.col(c) for c in df.columns])


def _rule_names(
    sets: DataFrame, scope: list[str], kind: Callable[[Column, Column, Column], Column], same: bool
) -> DataFrame:
    """scope, SIDES, rule_type, rule_id: the names behind rule numbers, from the distinct (cluster, key, common)."""
    by = ["cluster", "key"]
    keys = sets.select(*scope, *by, common_norm(F.col("norm")).alias("_c")).distinct()
    sample = F.when(F.col("_c"), F.lit("z")).otherwise(F.lit("s:"))
    keys = keys.withColumn("norm", sample).drop("_c")
    named = _sided(keys, by, "_1").join(_sided(keys, by, "_2"), [*scope, "norm"])
    if not same:
        named = named.where(F.col("cluster_1") < F.col("cluster_2"))
    named = named.withColumn("rule_type", kind(F.col("key_1"), F.col("key_2"), F.col("norm")))
    named = named.select(*scope, *SIDES, "rule_type").distinct().withColumn("rule_id", F.xxhash64(*SIDES, "rule_type"))
    return named


def _short_long_pairs(
    light: DataFrame, scope: list[str], kind: Callable[[Column, Column, Column], Column], same: bool, named: DataFrame
) -> DataFrame:
    """Pairs of a short and a long set that share a light value: scope, SIDES, rule_type, n.

    Every value lists the long sets that hold it, one list for each cluster and key and no longer than the bound on light
    values; a short set joins the lists of its few values and counts each long set once.  A list holds one number
    for each set; sets that different numbers of documents have stand in different lists.
    """
    by = ["cluster", "key"]
    # Short numbers, from 64 counters: the number is all that a list moves.
    counter = F.pmod("_g1", F.lit(64))
    place = F.row_number().over(Window.partitionBy("_counter").orderBy("_g1", "_g2"))
    ids = light.where("_long").select("_g1", "_g2").distinct().withColumn("_counter", counter)
    ids = cut_lineage(ids.select("_g1", "_g2", (place * 64 + F.col("_counter")).cast("int").alias("_set")))
    numbered = light.where("_long").join(ids, ["_g1", "_g2"])
    listed = numbered.groupBy(
        *scope, "norm", F.col("cluster").alias("_lc"), F.col("key").alias("_lk"), F.col("n").alias("_ln")
    ).agg(F.collect_list("_set").alias("_sets"))
    short = light.where(~F.col("_long")).select(*scope, "norm", *by, "_g1", "_g2", "n")
    met = short.join(listed, [*scope, "norm"])
    if same:
        met = met.where((F.col("cluster") == F.col("_lc")) & (F.col("key") == F.col("_lk")))
    else:
        met = met.where(F.col("cluster") != F.col("_lc"))
    first = F.col("cluster") <= F.col("_lc")
    for one, two in (("cluster", "_lc"), ("key", "_lk")):
        met = met.withColumn(f"{one}_1", F.when(first, F.col(one)).otherwise(F.col(two)))
        met = met.withColumn(f"{one}_2", F.when(first, F.col(two)).otherwise(F.col(one)))
    met = met.withColumn("rule_type", kind(F.col("key_1"), F.col("key_2"), F.col("norm")))
    names = [*scope, *SIDES, "rule_type"]
    # Lists are the bulk of what moves, so their rows carry the rule by its number.
    met = met.select(*scope, F.xxhash64(*SIDES, "rule_type").alias("rule_id"), first.alias("_first"), "_g1", "_g2", "n", "_ln", "_sets")
    per_set = met.groupBy(*scope, "rule_id", "_first", "_g1", "_g2", "n", "_ln").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_sets")))).alias("_held")
    )
    counted = per_set.groupBy(*scope, "rule_id").agg(F.sum(F.col("n") * F.col("_ln") * F.col("_held")).alias("n"))
    return counted.join(named, [*scope, "rule_id"]).select(*names, "n")


def _set_pairs(
    sets: DataFrame,
    scope: list[str],
    kind: Callable[[Column, Column, Column], Column],
    same: bool,
    heavy: int,
    short: int,
) -> DataFrame:
    """Pairs of documents with several values each, one of them with a long set, that share a value:
    scope, SIDES, rule_type, n."""
    by = ["cluster", "key"]
    cells = (
        sets.where(F.col("_k") > 1)
        .withColumn("_long", F.col("_k") > short)
        .groupBy(*scope, *by, "norm", "_g1", "_g2", "_long")
        .agg(F.count("*").alias("n"))
    )
    cells = cut_lineage(cells)
    heavy_values = (
        cells.groupBy(*scope, *by, "norm")
        .agg(F.count("*").alias("_sets"))
        .where(F.col("_sets") > heavy)
        .select(*scope, "norm")
        .distinct()
        .withColumn("_heavy", F.lit(True))
    )
    out = [*scope, "rule_id"]
    names = [*scope, *SIDES, "rule_type"]
    by_lists = heavy_values.isEmpty()
    if by_lists:
        from_lists = _short_long_pairs(cells, scope, kind, same, _rule_names(sets, scope, kind, same))
        cells = cells.where("_long")
    one_set = Window.partitionBy(*scope, *by, "_g1", "_g2", "_long")
    marked = (
        cells.join(heavy_values, [*scope, "norm"], "left")
        .withColumn("_heavy", F.coalesce("_heavy", F.lit(False)))
        .withColumn("_hp", F.bit_xor(F.when(F.col("_heavy"), F.xxhash64("norm", F.lit(43)))).over(one_set))
        .withColumn("_hp", F.coalesce("_hp", F.lit(0)))
    )
    def meet(table: DataFrame, ids: list[str]) -> DataFrame:
        cols = [*by, *ids, "_long", "n"]
        met = _sided(table, cols, "_1").join(_sided(table, cols, "_2"), [*scope, "norm"])
        met = met.where(F.col("_long_1") | F.col("_long_2"))
        if same:
            first, second = (F.struct(*[F.col(i + s) for i in ("_long", *ids)]) for s in ("_1", "_2"))
            equal = (F.col("cluster_1") == F.col("cluster_2")) & (F.col("key_1") == F.col("key_2"))
            met = met.where(equal & (first <= second))
        else:
            met = met.where(F.col("cluster_1") < F.col("cluster_2"))
        met = met.withColumn("rule_type", kind(F.col("key_1"), F.col("key_2"), F.col("norm")))
        met = met.withColumn("rule_id", F.xxhash64(*SIDES, "rule_type"))
        # Rows stay narrow where they are many: hashes and counts, the rule by its number.
        ends = [i + s for s in ("_1", "_2") for i in ("_long", *ids)]
        return met.select(*out, *ends, "n_1", "n_2").distinct()

    def total(met: DataFrame, ids: list[str]) -> DataFrame:
        pairs = F.col("n_1") * F.col("n_2")
        if same:
            equal = F.lit(True)
            for i in ("_long", *ids):
                equal = equal & (F.col(i + "_1") == F.col(i + "_2"))
            pairs = F.when(equal, (F.col("n_1") * (F.col("n_1") - 1) / 2).cast("long")).otherwise(pairs)
        return met.groupBy(*out).agg(F.sum(pairs).alias("n"))

    if by_lists:
        counted = total(meet(cells, ["_g1", "_g2"]), ["_g1", "_g2"])
        return counted.join(_rule_names(sets, scope, kind, same), out).select(*names, "n").unionByName(from_lists)
    classes = marked.where("_heavy").groupBy(*scope, *by, "norm", "_hp", "_long").agg(F.sum("n").alias("n"))
    heavy_met = meet(classes, ["_hp"])
    ends = ["_hp_1", "_long_1", "_hp_2", "_long_2"]
    found = heavy_met.select(*out, *ends)
    if same:
        turned = [F.col(b).alias(a) for a, b in zip(ends, ends[2:] + ends[:2], strict=True)]
        found = found.union(found.select(*out, *turned))
    light = marked.where(~F.col("_heavy")).drop("_heavy")
    light_met = meet(light, ["_g1", "_g2", "_hp"]).join(found, [*out, *ends], "left_anti")
    counted = (
        total(heavy_met, ["_hp"])
        .unionByName(total(light_met, ["_g1", "_g2"]))
        .groupBy(*out)
        .agg(F.sum("n").alias("n"))
    )
    return counted.join(_rule_names(sets, scope, kind, same), out).select(*names, "n")


def cross_pair_counts(
    rows: DataFrame,
    typed: bool = False,
    heavy: int = HEAVY_SETS,
    short: int = SHORT_SET,
) -> DataFrame:
    """Distinct document pairs of different clusters sharing a value: SIDES, rule_type, n.

    `rows`: distinct doc_id, cluster, key, norm.  With `typed`, the values are told apart by rule type,
    else all count alike under `ANY`.  Where no document has several values under a key, which is looked
    up first, the parts for value sets are spared.
    """
    by = ["cluster", "key"]
    crossed = F.col("cluster_1") < F.col("cluster_2")
    if rows.groupBy("doc_id", *by).count().where("count > 1").isEmpty():
        cells = rows.groupBy(*by, "norm").agg(F.count("*").alias("n"))
        cols = [*by, "n"]
        kind = rule_of(F.col("key_1"), F.col("key_2"), F.col("norm")) if typed else F.lit("ANY")
        return (
            _sided(cells, cols, "_1")
            .join(_sided(cells, cols, "_2"), "norm")
            .where(crossed)
            .groupBy(*SIDES, kind.alias("rule_type"))
            .agg(F.sum(F.col("n_1") * F.col("n_2")).alias("n"))
        )
    sets = cut_lineage(_value_sets(rows, by))
    subsets = _subsets(sets, by, short, False)
    cols = [*by, "n", "kind"]
    same_key = F.col("key_1") == F.col("key_2")
    subset_type = (
        F.when(same_key, "SAME_KEY_VALUE_PAIR")
        .when(F.col("kind_1") == "p", "SAME_VALUE")
        .when(F.col("kind_1") == "c", "SAME_COMMON_VALUE")
        if typed
        else F.lit("ANY")
    )
    from_short = (
        _sided(subsets, cols, "_1")
        .join(_sided(subsets, cols, "_2"), ["h1", "h2", "size"])
        .where(crossed)
        .withColumn("rule_type", subset_type)
        .where(F.col("rule_type").isNotNull())
        .groupBy(*SIDES, "rule_type")
        .agg(F.sum(_sign() * F.col("n_1") * F.col("n_2")).alias("n"))
    )
    totals = F.sum("n").alias("n")
    if sets.where(F.col("_k") > short).isEmpty():
        return from_short.groupBy(*SIDES, "rule_type").agg(totals).where(F.col("n") > 0)
    cells = _cells(sets, by, short)
    kind = rule_of if typed else (lambda a, b, v: F.lit("ANY"))
    cols = [*by, "one", "long"]
    mixed = (
        _sided(cells, cols, "_1")
        .join(_sided(cells, cols, "_2"), "norm")
        .where(crossed & ((F.col("long_1") > 0) | (F.col("long_2") > 0)))
        .withColumn("rule_type", kind(F.col("key_1"), F.col("key_2"), F.col("norm")))
        .groupBy(*SIDES, "rule_type")
        .agg(F.sum(F.col("one_1") * F.col("long_2") + F.col("long_1") * F.col("one_2")).alias("n"))
    )
    return (
        from_short.unionByName(mixed)
        .unionByName(_set_pairs(sets, [], kind, False, heavy, short))
        .groupBy(*SIDES, "rule_type")
        .agg(totals)
        .where(F.col("n") > 0)
    )


def same_type_pair_counts(
    rows: DataFrame, scope: list[str] | None = None, heavy: int = HEAVY_SETS, short: int = SHORT_SET
) -> DataFrame:
    """Unordered document pairs of one cluster sharing a value of the same key, inside a scope.

    `rows`: scope columns (usually case_id), doc_id, cluster, key, norm.  Result: scope, cluster, key, n.
    """
    scope = scope or []
    by = ["cluster", "key"]
    sets = cut_lineage(_value_sets(rows, [*scope, *by]))
    choose = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    from_short = _subsets(sets, [*scope, *by], short, True).groupBy(*scope, *by).agg(F.sum(_sign() * choose).alias("n"))
    mixed = (
        _cells(sets, [*scope, *by], short)
        .where(F.col("long") > 0)
        .groupBy(*scope, *by)
        .agg(F.sum(F.col("one") * F.col("long")).alias("n"))
    )
    sets_met = _set_pairs(sets, scope, lambda a, b, v: F.lit("ANY"), True, heavy, short).select(
        *scope, F.col("cluster_1").alias("cluster"), F.col("key_1").alias("key"), "n"
    )
    return (
        from_short.unionByName(mixed)
        .unionByName(sets_met)
        .groupBy(*scope, *by)
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > 0)
    )


def value_blocks(rows: DataFrame) -> DataFrame:
    """Equal-value matches in grouped form: one row per (cluster, key) pair and value, with the number
    of documents on each side; n_docs_1 * n_docs_2 document pairs stand behind a row."""
    cells = rows.groupBy("cluster", "key", "norm").agg(F.count("*").alias("n_docs"))
    cols = ["cluster", "key", "n_docs"]
    met = (
        _sided(cells, cols, "_1")
        .join(_sided(cells, cols, "_2"), "norm")
        .where(F.col("cluster_1") < F.col("cluster_2"))
    )
    return met.select(
        *SIDES,
        rule_of(F.col("key_1"), F.col("key_2"), F.col("norm")).alias("rule_type"),
        "norm",
        "n_docs_1",
        "n_docs_2",
    )


def rule_counts(
    rows: DataFrame, heavy: int = HEAVY_SETS, short: int = SHORT_SET
) -> DataFrame:
    """Rules (SIDES, rule_type) with their number of distinct document pairs `n`."""
    return cross_pair_counts(rows, True, heavy, short)


def same_key_counts(rows: DataFrame) -> DataFrame:
    """Pairs of different clusters that share a key, split by equal and different value.

    n_equal: pairs sharing a value of the key; n_pairs: pairs both holding the key.
    """
    holders = rows.groupBy("cluster", "key").agg(F.count_distinct("doc_id").alias("n_docs"))
    cols = ["cluster", "n_docs"]
    both = (
        _sided(holders, cols, "_1")
        .join(_sided(holders, cols, "_2"), "key")
        .where(F.col("cluster_1") < F.col("cluster_2"))
        .select(
            "cluster_1", "cluster_2", "key", (F.col("n_docs_1") * F.col("n_docs_2")).alias("n_pairs")
        )
    )
    equal = (
        cross_pair_counts(rows)
        .where(F.col("key_1") == F.col("key_2"))
        .select("cluster_1", "cluster_2", F.col("key_1").alias("key"), F.col("n").alias("n_equal"))
    )
    return both.join(equal, ["cluster_1", "cluster_2", "key"], "left").withColumn(
        "n_equal", F.coalesce("n_equal", F.lit(0))
    )
