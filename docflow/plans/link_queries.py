"""Queries that correlate documents: equal values, correlators, links, components, reference data."""

from pyspark.sql import functions as F

from docflow.operators import correlate, leaves, numeric, pairs, relations, similarity
from docflow.operators.graph import components
from docflow.operators.skew import neighbour
from docflow.plans.inputs import KEY_LEAVES, LINES, key_leaves, line_documents
from docflow.plans.registry import query, table
from docflow.session import cut_lineage
from docflow.sources.tables import row_leaves

RULE_TYPE = """CASE WHEN x.key = y.key THEN 'SAME_KEY_VALUE_PAIR'
  WHEN lower(substr(x.norm, 3)) IN ('true','false','none','yes','no','1','0','null') OR x.norm = 'z' THEN 'SAME_COMMON_VALUE'
  ELSE 'SAME_VALUE' END"""
MATCH = f"""matches AS (SELECT x.cluster AS cluster_1, x.key AS key_1, y.cluster AS cluster_2, y.key AS key_2,
    {RULE_TYPE} AS rule_type, x.norm, x.doc_id AS d1, y.doc_id AS d2
  FROM leafrows x JOIN leafrows y ON x.norm = y.norm AND x.cluster < y.cluster)"""
RULES = """rules AS (SELECT cluster_1, key_1, cluster_2, key_2, rule_type, count(DISTINCT (d1, d2)) AS n
  FROM matches GROUP BY 1, 2, 3, 4, 5)"""
TYPES = """types AS (SELECT cluster, count(DISTINCT doc_id) AS n_instances, cluster IN ('nation') AS ref FROM leafrows GROUP BY cluster)"""
FREQUENT = f"""{TYPES}, frequent AS (SELECT r.*, CASE WHEN a.ref OR b.ref THEN 'independent'
    WHEN rule_type = 'SAME_KEY_VALUE_PAIR' THEN 'key' ELSE 'synonym' END AS kind
  FROM rules r JOIN types a ON a.cluster = cluster_1 JOIN types b ON b.cluster = cluster_2
  WHERE rule_type <> 'SAME_COMMON_VALUE' AND n >= 0.8 * least(a.n_instances, b.n_instances))"""


def _types(spark, folder):
    """Instances per type, with nations as reference data."""
    rows = key_leaves(spark, folder)
    structure = rows.select("doc_id", "cluster").distinct().select(
        "doc_id", "cluster", (F.col("cluster") == "nation").alias("is_reference"), F.lit(1).alias("arrays_found")
    )
    return correlate.type_instances(structure)


@query(
    "value_blocks",
    f"""WITH {KEY_LEAVES}, {MATCH} SELECT cluster_1, key_1, cluster_2, key_2, rule_type, norm,
      count(DISTINCT d1) AS n_docs_1, count(DISTINCT d2) AS n_docs_2 FROM matches GROUP BY 1, 2, 3, 4, 5, 6""",
)
def value_blocks(spark, folder):
    return pairs.value_blocks(pairs.members(key_leaves(spark, folder)))


@query("rule_counts", f"WITH {KEY_LEAVES}, {MATCH}, {RULES} SELECT * FROM rules")
def rule_counts(spark, folder):
    return pairs.rule_counts(pairs.members(key_leaves(spark, folder)))


BASKETS = """leafrows AS (SELECT DISTINCT 'o' || l_orderkey AS doc_id, 'basket' AS cluster, 'part' AS key, 'n:' || l_partkey AS norm FROM lineitem
  UNION SELECT DISTINCT 'o' || l_orderkey, 'basket', 'supp', 'n:' || l_suppkey FROM lineitem
  UNION SELECT DISTINCT 's' || l_suppkey, 'catalog', 'part', 'n:' || l_partkey FROM lineitem)"""


def basket_members(spark, folder):
    """Baskets (orders) with several parts and suppliers, and catalogs (suppliers) with their parts."""
    lines = table(spark, folder, "lineitem")

    def rows(prefix, doc, cluster, key, value):
        return lines.select(
            F.concat(F.lit(prefix), F.col(doc).cast("string")).alias("doc_id"),
            F.lit(cluster).alias("cluster"),
            F.lit(key).alias("key"),
            F.concat(F.lit("n:"), F.col(value).cast("string")).alias("norm"),
        )

    return (
        rows("o", "l_orderkey", "basket", "part", "l_partkey")
        .unionByName(rows("o", "l_orderkey", "basket", "supp", "l_suppkey"))
        .unionByName(rows("s", "l_suppkey", "catalog", "part", "l_partkey"))
        .distinct()
    )


@query("rule_counts_arrays", f"WITH {BASKETS}, {MATCH}, {RULES} SELECT * FROM rules")
def rule_counts_arrays(spark, folder):
    return pairs.rule_counts(cut_lineage(basket_members(spark, folder)))


@query(
    "same_key_counts",
    f"""WITH {KEY_LEAVES}, h AS (SELECT DISTINCT cluster, key, doc_id FROM leafrows),
    c AS (SELECT cluster, key, count(*) AS n FROM h GROUP BY 1, 2), {MATCH},
    e AS (SELECT cluster_1, cluster_2, key_1 AS key, count(DISTINCT (d1, d2)) AS n_equal FROM matches WHERE key_1 = key_2 GROUP BY 1, 2, 3)
    SELECT x.cluster AS cluster_1, y.cluster AS cluster_2, x.key, x.n * y.n AS n_pairs, coalesce(n_equal, 0) AS n_equal
    FROM c x JOIN c y ON x.key = y.key AND x.cluster < y.cluster
    LEFT JOIN e ON e.cluster_1 = x.cluster AND e.cluster_2 = y.cluster AND e.key = x.key""",
)
def same_key_counts(spark, folder):
    return pairs.same_key_counts(pairs.members(key_leaves(spark, folder)))


@query(
    "same_type_pairs",
    """WITH t AS (SELECT user_id AS case_id, event_id AS doc_id, event_type AS cluster, json_extract_string(props, '$.k') AS k FROM events)
    SELECT x.case_id, x.cluster, 'k' AS key, count(*) AS n FROM t x JOIN t y
      ON x.case_id = y.case_id AND x.cluster = y.cluster AND x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2""",
)
def same_type_pairs(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("case_id"),
        F.col("event_id").alias("doc_id"),
        F.col("event_type").alias("cluster"),
        F.lit("k").alias("key"),
        F.concat(F.lit("n:"), F.get_json_object("props", "$.k")).alias("norm"),
    )
    return pairs.same_type_pair_counts(rows, ["case_id"])


@query(
    "correlators",
    f"WITH {KEY_LEAVES}, {MATCH}, {RULES}, {FREQUENT} SELECT * FROM frequent",
)
def frequent_correlators(spark, folder):
    rows = pairs.members(key_leaves(spark, folder))
    return correlate.frequent_rules(pairs.rule_counts(rows), _types(spark, folder))


@query(
    "transitive_correlations",
    f"""WITH {KEY_LEAVES}, {MATCH}, {RULES}, {FREQUENT}, ends AS (
      SELECT cluster_1 AS center, cluster_2 AS other, least(key_1, key_2) AS key_lo, greatest(key_1, key_2) AS key_hi FROM frequent
      UNION SELECT cluster_2, cluster_1, least(key_1, key_2), greatest(key_1, key_2) FROM frequent)
    SELECT x.center, x.key_lo, x.key_hi, x.other AS type_1, y.other AS type_2 FROM ends x JOIN ends y
      ON x.center = y.center AND x.key_lo = y.key_lo AND x.key_hi = y.key_hi AND x.other < y.other""",
)
def transitive_correlations(spark, folder):
    rows = pairs.members(key_leaves(spark, folder))
    found = correlate.frequent_rules(pairs.rule_counts(rows), _types(spark, folder))
    return correlate.transitive(found)


TOUCH = """touch AS (SELECT DISTINCT key, cluster FROM (
    SELECT unnest([key_1, key_2]) AS key, cluster_1 AS a, cluster_2 AS b FROM frequent WHERE kind = 'independent') q,
    LATERAL (SELECT unnest([a, b]) AS cluster) WHERE key IN (SELECT key FROM leafrows WHERE cluster = 'nation'))"""


@query(
    "correlators_without_reference_keys",
    f"""WITH {KEY_LEAVES}, {MATCH}, {RULES}, {FREQUENT}, {TOUCH}
    SELECT f.* FROM frequent f WHERE kind = 'independent' OR NOT EXISTS (SELECT 1 FROM touch a JOIN touch b ON a.key = b.key
      WHERE a.cluster = f.cluster_1 AND b.cluster = f.cluster_2 AND a.key IN (f.key_1, f.key_2))""",
)
def correlators_without_reference_keys(spark, folder):
    rows = pairs.members(key_leaves(spark, folder))
    found = cut_lineage(correlate.frequent_rules(pairs.rule_counts(rows), _types(spark, folder)))
    keys = rows.where(F.col("cluster") == "nation").select("key").distinct()
    return correlate.drop_reference_keys(found, keys)


INVOICES = """keyrows AS (
  SELECT 'o' || o_orderkey AS doc_id, 'order' AS cluster, 'orderkey' AS key, 'n:' || o_orderkey AS norm FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 'order', 'custkey', 'n:' || o_custkey FROM orders
  UNION ALL SELECT 'l' || l_orderkey, 'line', 'orderkey', 'n:' || l_orderkey FROM lineitem
  UNION ALL SELECT 'l' || o_orderkey, 'line', 'customer', 'n:' || o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION ALL SELECT 'l' || l_orderkey, 'line', 'suppkey', 'n:' || l_suppkey FROM lineitem),
leafrows AS (SELECT DISTINCT * FROM keyrows)"""


def invoice_members(spark, folder):
    """Orders, and delivery documents holding the order, the customer under another key, and suppliers."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")

    def rows(df, prefix, doc, cluster, key, value):
        return df.select(
            F.concat(F.lit(prefix), F.col(doc).cast("string")).alias("doc_id"),
            F.lit(cluster).alias("cluster"),
            F.lit(key).alias("key"),
            F.concat(F.lit("n:"), F.col(value).cast("string")).alias("norm"),
        )

    shipped = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    return (
        rows(orders, "o", "o_orderkey", "order", "orderkey", "o_orderkey")
        .unionByName(rows(orders, "o", "o_orderkey", "order", "custkey", "o_custkey"))
        .unionByName(rows(lines, "l", "l_orderkey", "line", "orderkey", "l_orderkey"))
        .unionByName(rows(shipped, "l", "o_orderkey", "line", "customer", "o_custkey"))
        .unionByName(rows(lines, "l", "l_orderkey", "line", "suppkey", "l_suppkey"))
        .distinct()
    )


@query(
    "rule_overlap",
    f"""WITH {INVOICES}, {MATCH}, {RULES}, p AS (SELECT DISTINCT cluster_1, key_1, cluster_2, key_2, rule_type, d1, d2 FROM matches
        WHERE rule_type <> 'SAME_COMMON_VALUE'),
    both_ AS (SELECT a.cluster_1, a.cluster_2, a.key_1 AS key_1_a, a.key_2 AS key_2_a, a.rule_type AS rule_type_a,
        b.key_1 AS key_1_b, b.key_2 AS key_2_b, b.rule_type AS rule_type_b, count(*) AS n_both
      FROM p a JOIN p b ON a.d1 = b.d1 AND a.d2 = b.d2 AND (a.key_1, a.key_2, a.rule_type) < (b.key_1, b.key_2, b.rule_type)
      GROUP BY ALL)
    SELECT a.cluster_1, a.cluster_2, a.key_1 AS key_1_a, a.key_2 AS key_2_a, a.rule_type AS rule_type_a, b.key_1 AS key_1_b,
      b.key_2 AS key_2_b, b.rule_type AS rule_type_b, a.n AS n_a, b.n AS n_b, coalesce(n_both, 0) AS n_both,
      round(coalesce(n_both, 0) / (a.n + b.n - coalesce(n_both, 0))::DOUBLE, 9) AS jaccard
    FROM rules a JOIN rules b ON a.cluster_1 = b.cluster_1 AND a.cluster_2 = b.cluster_2
      AND (a.key_1, a.key_2, a.rule_type) < (b.key_1, b.key_2, b.rule_type)
    LEFT JOIN both_ c ON c.cluster_1 = a.cluster_1 AND c.cluster_2 = a.cluster_2 AND c.key_1_a = a.key_1 AND c.key_2_a = a.key_2
      AND c.rule_type_a = a.rule_type AND c.key_1_b = b.key_1 AND c.key_2_b = b.key_2 AND c.rule_type_b = b.rule_type
    WHERE a.rule_type <> 'SAME_COMMON_VALUE' AND b.rule_type <> 'SAME_COMMON_VALUE'""",
)
def rule_overlap(spark, folder):
    rows = cut_lineage(invoice_members(spark, folder))
    out = correlate.rule_overlap(rows, pairs.rule_counts(rows))
    return out.withColumn("jaccard", F.round("jaccard", 9))


@query(
    "key_classes",
    f"""WITH {INVOICES}, s AS (SELECT key, doc_id, count(*) AS sz FROM leafrows GROUP BY 1, 2),
    h AS (SELECT key, count(*) AS n_docs FROM s GROUP BY 1), al AS (SELECT count(DISTINCT doc_id) AS n FROM leafrows),
    sh AS (SELECT x.key, sum(1.0::DOUBLE / least(a.sz, b.sz)) AS total FROM leafrows x JOIN leafrows y ON x.key = y.key AND x.norm = y.norm AND x.doc_id < y.doc_id
      JOIN s a ON a.key = x.key AND a.doc_id = x.doc_id JOIN s b ON b.key = y.key AND b.doc_id = y.doc_id GROUP BY x.key),
    r AS (SELECT h.key, n_docs, n_docs / al.n::DOUBLE AS coverage,
      CASE WHEN n_docs > 1 THEN coalesce(total, 0) / (n_docs * (n_docs - 1) / 2.0) ELSE 0 END AS overlap
      FROM h CROSS JOIN al LEFT JOIN sh ON sh.key = h.key)
    SELECT key, n_docs, round(coverage, 9) AS coverage, round(overlap, 9) AS overlap,
      CASE WHEN coverage >= 0.5 AND overlap > 0.3 THEN 'primary' WHEN coverage >= 0.3 THEN 'secondary' ELSE 'none' END AS key_class FROM r""",
)
def key_classes(spark, folder):
    out = correlate.key_classes(invoice_members(spark, folder))
    return out.withColumn("coverage", F.round("coverage", 9)).withColumn("overlap", F.round("overlap", 9))


@query(
    "document_cases",
    """SELECT 'l' || o_orderkey AS doc_id, 'l' || o_orderkey AS case_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'o' || o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'l' ELSE 'o' END || o_orderkey FROM orders""",
)
def document_cases(spark, folder):
    """Orders and deliveries joined by the accepted correlators, and the cases they form."""
    rows = cut_lineage(invoice_members(spark, folder))
    rules = pairs.rule_counts(rows)
    types = correlate.type_instances(
        rows.select("doc_id", "cluster").distinct().select(
            "doc_id", "cluster", F.lit(False).alias("is_reference"), F.lit(1).alias("arrays_found")
        )
    )
    # Customers glue cases together, so the order key alone links; it is the strongest rule of the pair.
    found = cut_lineage(correlate.frequent_rules(rules, types).where(F.col("rule_type") == "SAME_KEY_VALUE_PAIR"))
    labels = components(correlate.links(rows, found), rows.select(F.col("doc_id").alias("node")))
    return labels.select(F.col("node").alias("doc_id"), F.col("component").alias("case_id"))


@query(
    "components",
    f"""WITH RECURSIVE {LINES}, l AS (SELECT DISTINCT doc_id, line FROM lines WHERE length(line) > 0),
    hub AS (SELECT line, min(doc_id) AS d FROM l GROUP BY line HAVING count(*) > 1),
    e AS (SELECT DISTINCT l.doc_id AS a, hub.d AS b FROM l JOIN hub USING (line) WHERE l.doc_id <> hub.d),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    walk(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, walk.root FROM walk JOIN u ON u.a = walk.node)
    SELECT node, min(root) AS component FROM walk GROUP BY node""",
)
def document_components(spark, folder):
    """Text documents that share a whole line."""
    docs = table(spark, folder, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0)
    entries = lines.select("doc_id", F.lit(0).alias("entry_idx"), F.lit("line").alias("key"), F.col("line").alias("norm"))
    edges = correlate.entry_links(entries).select(F.col("doc_id").alias("src"), F.col("to_doc").alias("dst"))
    return components(edges, docs.select(F.col("doc_id").alias("node")))


@query(
    "entry_links",
    f"""WITH {LINES}, h AS (SELECT line, min(doc_id) AS d, max(doc_id) AS last FROM lines WHERE length(line) > 0 GROUP BY line HAVING min(doc_id) < max(doc_id)),
    t AS (SELECT l.line, l.doc_id AS to_doc, min(l.no) AS to_entry FROM lines l JOIN h ON h.line = l.line AND h.d = l.doc_id GROUP BY ALL)
    SELECT DISTINCT l.doc_id, l.no AS entry_idx, t.to_doc, t.to_entry, 'Line' AS key FROM lines l JOIN t ON t.line = l.line
    WHERE NOT (l.doc_id = t.to_doc AND l.no = t.to_entry)""",
)
def entry_links(spark, folder):
    leaf = leaves.leaves(line_documents(spark, folder))
    lines = leaf.where((F.col("key") == "Line") & (F.col("norm") != "s:"))
    return correlate.entry_links(lines, ["Line"])


@query(
    "reference_entries",
    """SELECT o_orderkey AS case_id, 'customer:' || o_custkey AS doc_id, 'customer' AS cluster, 0 AS entry_idx FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
)
def reference_entries(spark, folder):
    """Customer rows as reference entries claimed by orders."""
    rows, reference, accepted = _reference(spark, folder)
    return correlate.reference_links(rows, reference, accepted)


def _reference(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    rows = orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.lit("order").alias("cluster"),
        F.lit("custkey").alias("key"),
        F.concat(F.lit("n:"), F.col("o_custkey").cast("string")).alias("norm"),
    )
    reference = customer.select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("doc_id"),
        F.lit("customer").alias("cluster"),
        F.lit("custkey").alias("key"),
        F.concat(F.lit("n:"), F.col("c_custkey").cast("string")).alias("norm"),
        F.lit(0).alias("entry_idx"),
    )
    accepted = spark.createDataFrame(
        [("customer", "custkey", "order", "custkey", "independent")],
        "cluster_1 string, key_1 string, cluster_2 string, key_2 string, kind string",
    )
    return rows, reference, accepted


@query(
    "reference_claims",
    """SELECT 'customer:' || c_custkey AS doc_id, 0 AS entry_idx, count(*) AS n_cases, count(*) > 1 AS is_ambiguous
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def reference_claims(spark, folder):
    return correlate.entry_claims(correlate.reference_links(*_reference(spark, folder)))


@query(
    "reference_claim_counts",
    """WITH c AS (SELECT 'supplier:' || s_suppkey AS doc_id, l_orderkey AS case_id FROM supplier JOIN lineitem ON l_suppkey = s_suppkey
      UNION SELECT 'supplier:' || s_suppkey, o_orderkey FROM supplier JOIN customer ON c_nationkey = s_nationkey JOIN orders ON o_custkey = c_custkey)
    SELECT doc_id, 0 AS entry_idx, count(*) AS n_cases, count(*) > 1 AS is_ambiguous FROM c GROUP BY 1""",
)
def reference_claim_counts(spark, folder):
    """Suppliers claimed by the orders that they deliver and by those of customers of their nation, counted by groups."""
    number = lambda c: F.concat(F.lit("n:"), F.col(c).cast("string")).alias("norm")
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    own = bought.select(F.col("o_orderkey").alias("case_id"), F.lit("order").alias("cluster"), F.lit("nationkey").alias("key"), number("c_nationkey"))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.lit("line").alias("cluster"), F.lit("suppkey").alias("key"), number("l_suppkey"))
    supplier = table(spark, folder, "supplier")
    doc = F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("doc_id")
    reference = [supplier.select(doc, F.lit("supplier").alias("cluster"), F.lit(k).alias("key"), number(f"s_{k}"), F.lit(0).alias("entry_idx")) for k in ("suppkey", "nationkey")]
    accepted = spark.createDataFrame(
        [("line", "suppkey", "supplier", "suppkey", "independent"), ("order", "nationkey", "supplier", "nationkey", "independent")],
        "cluster_1 string, key_1 string, cluster_2 string, key_2 string, kind string",
    )
    return correlate.claim_counts(own.unionByName(lines), reference[0].unionByName(reference[1]), accepted)


@query("unused_docs", "SELECT c_custkey AS doc_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unused_docs(spark, folder):
    docs = table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"))
    used = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc_id"))
    return correlate.unused(docs, used)


@query(
    "orders_without_returns",
    "SELECT o_orderkey AS doc_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
)
def orders_without_returns(spark, folder):
    docs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"))
    returned = table(spark, folder, "lineitem").where(F.col("l_returnflag") == "R")
    return correlate.unused(docs, returned.select(F.col("l_orderkey").alias("doc_id")))


@query(
    "case_members",
    """SELECT o_orderkey AS case_id, 'order' AS cluster, false AS is_shared, count(*) AS n FROM orders GROUP BY 1
    UNION ALL SELECT o_orderkey, 'customer', true, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def case_members(spark, folder):
    """Bridge rows of cases: the case's own documents and the reference entries they claim."""
    from docflow.operators.cases import case_documents

    docs = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.lit("order").alias("cluster"),
        F.col("o_orderdate").cast("timestamp").alias("final_ts"),
        F.col("o_orderkey").alias("component"),
    )
    labels = docs.select(F.col("doc_id").alias("node"), "component")
    bridge = case_documents(labels, docs, correlate.reference_links(*_reference(spark, folder)))
    return bridge.groupBy("case_id", "cluster", "is_shared").agg(F.count("*").alias("n"))


@query(
    "attribute_similarity",
    """WITH p AS (SELECT p_partkey AS doc_2, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS doc_1 FROM part),
    m AS (SELECT doc_1, doc_2, a.p_name AS n1, b.p_name AS n2, a.p_type AS t1, b.p_type AS t2, a.p_size::DOUBLE AS s1, b.p_size::DOUBLE AS s2,
      a.p_retailprice AS r1, b.p_retailprice AS r2 FROM p JOIN part a ON a.p_partkey = doc_1 JOIN part b ON b.p_partkey = doc_2)
    SELECT doc_1, doc_2, 4 AS n_common, round(((1 - levenshtein(n1, n2) / greatest(length(n1), length(n2))::DOUBLE)
      + (1 - levenshtein(t1, t2) / greatest(length(t1), length(t2))::DOUBLE)
      + (CASE WHEN greatest(abs(s1), abs(s2)) = 0 THEN 1 ELSE 1 - abs(s1 - s2) / greatest(abs(s1), abs(s2)) END)
      + (CASE WHEN greatest(abs(r1), abs(r2)) = 0 THEN 1 ELSE 1 - abs(r1 - r2) / greatest(abs(r1), abs(r2)) END)) / 4, 6) AS attributes FROM m""",
)
def attribute_similarity(spark, folder):
    out = similarity.attribute_similarity(part_pairs(spark, folder), part_leaves(spark, folder))
    return out.withColumn("attributes", F.round("attributes", 6))


def part_pairs(spark, folder):
    """Every part with the part before it in its brand."""
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    near = neighbour(parts, ["p_brand"], ["p_partkey"], {"p_partkey": "doc_1"}, -1)
    return near.where(F.col("doc_1").isNotNull()).select("doc_1", F.col("p_partkey").alias("doc_2"))


def part_leaves(spark, folder):
    return row_leaves(
        table(spark, folder, "part"), {"p_partkey": "doc_id"}, ["p_name", "p_type", "p_size", "p_retailprice"]
    )


@query(
    "document_similarity",
    """WITH p AS (SELECT p_partkey AS doc_2, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS doc_1 FROM part),
    m AS (SELECT doc_1, doc_2, a.p_type = b.p_type AS same_type, a.p_size = b.p_size AS same_size,
      list_distinct(string_split(a.p_name, ' ')) AS x, list_distinct(string_split(b.p_name, ' ')) AS y
      FROM p JOIN part a ON a.p_partkey = doc_1 JOIN part b ON b.p_partkey = doc_2)
    SELECT doc_1, doc_2, round(0.25 * ((CASE WHEN same_type THEN 0.8 ELSE 0 END + CASE WHEN same_size THEN 0.5 ELSE 0 END) / 1.3)
      + 0.30 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS similarity FROM m""",
)
def document_similarity(spark, folder):
    given = part_pairs(spark, folder)
    leaf = part_leaves(spark, folder)
    tiers, weights = {"primary": ("p_type",), "secondary": ("p_size",)}, {"primary": 0.8, "secondary": 0.5}
    words = table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ").alias("tokens"))
    parts = {
        "business_keys": similarity.business_key_similarity(given, leaf, tiers, weights),
        "text": similarity.token_similarity(given, words),
    }
    out = similarity.document_similarity(given, parts)
    return out.select("doc_1", "doc_2", F.round("similarity", 6).alias("similarity"))


ORDER_PAIRS = """p AS (SELECT o_orderkey AS doc_2, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS doc_1 FROM orders),
    m AS (SELECT doc_1, doc_2, a.o_totalprice AS v1, b.o_totalprice AS v2, a.o_orderstatus AS s1, b.o_orderstatus AS s2,
      a.o_orderpriority AS t1, b.o_orderpriority AS t2, exp(-abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) / 8.64e10 / 30) AS near
      FROM p JOIN orders a ON a.o_orderkey = doc_1 JOIN orders b ON b.o_orderkey = doc_2)"""


def order_pairs(spark, folder):
    """Every order with the one before it of its customer."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    near = neighbour(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"o_orderkey": "doc_1"}, -1)
    return near.where(F.col("doc_1").isNotNull()).select("doc_1", F.col("o_orderkey").alias("doc_2"))


def order_times(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("final_ts"))


@query("temporal_similarity", f"WITH {ORDER_PAIRS} SELECT doc_1, doc_2, round(near, 6) AS temporal FROM m")
def temporal_similarity(spark, folder):
    """How near in time every order is to the one before it of its customer."""
    out = similarity.temporal_similarity(order_pairs(spark, folder), order_times(spark, folder))
    return out.withColumn("temporal", F.round("temporal", 6))


@query(
    "order_similarity",
    f"""WITH {ORDER_PAIRS}, w AS (SELECT *, list_distinct(string_split(t1, '-')) AS x, list_distinct(string_split(t2, '-')) AS y,
      (CASE WHEN greatest(abs(v1), abs(v2)) = 0 THEN 1 ELSE 1 - abs(v1 - v2) / greatest(abs(v1), abs(v2)) END
        + 1 - levenshtein(t1, t2) / greatest(length(t1), length(t2))::DOUBLE) / 2 AS attributes FROM m)
    SELECT doc_1, doc_2, round(0.30 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE + 0.30 * attributes
      + 0.25 * (CASE WHEN s1 = s2 THEN 0.8 ELSE 0 END + CASE WHEN t1 = t2 THEN 0.5 ELSE 0 END) / 1.3 + 0.15 * near, 6) AS similarity FROM w""",
)
def order_similarity(spark, folder):
    """All four parts of the similarity of orders: text, attributes, business keys and time."""
    given = cut_lineage(order_pairs(spark, folder))
    orders = table(spark, folder, "orders")
    leaf = row_leaves(orders, {"o_orderkey": "doc_id"}, ["o_totalprice", "o_orderpriority"])
    keyed = row_leaves(orders, {"o_orderkey": "doc_id"}, ["o_orderstatus", "o_orderpriority"])
    tiers, weights = {"primary": ("o_orderstatus",), "secondary": ("o_orderpriority",)}, {"primary": 0.8, "secondary": 0.5}
    words = orders.select(F.col("o_orderkey").alias("doc_id"), F.split("o_orderpriority", "-").alias("tokens"))
    parts = {
        "text": similarity.token_similarity(given, words),
        "attributes": similarity.attribute_similarity(given, leaf),
        "business_keys": similarity.business_key_similarity(given, keyed, tiers, weights),
        "temporal": similarity.temporal_similarity(given, order_times(spark, folder)),
    }
    out = similarity.document_similarity(given, parts)
    return out.select("doc_1", "doc_2", F.round("similarity", 6).alias("similarity"))


@query(
    "numeric_derivation",
    """WITH w AS (SELECT l_orderkey AS case_id, count(*)::DOUBLE AS n_lines, max(l_linenumber)::DOUBLE AS last_line,
        min(l_linenumber)::DOUBLE AS first_line, sum(l_linenumber)::DOUBLE AS line_sum, count(DISTINCT l_suppkey)::DOUBLE AS n_supp FROM lineitem GROUP BY 1),
    t AS (
      SELECT 'sum' AS operation, 'n_lines' AS source_fields, abs(n_lines - line_sum) < 0.01 AS hit FROM w
      UNION ALL SELECT 'sum', 'last_line', abs(last_line - line_sum) < 0.01 FROM w
      UNION ALL SELECT 'sum', 'first_line', abs(first_line - line_sum) < 0.01 FROM w
      UNION ALL SELECT 'sum', 'n_lines,last_line', abs(n_lines + last_line - line_sum) < 0.01 FROM w
      UNION ALL SELECT 'product', 'n_lines,last_line', abs(n_lines * last_line - line_sum) < 0.01 FROM w
      UNION ALL SELECT 'sum', 'n_lines,first_line', abs(n_lines + first_line - line_sum) < 0.01 FROM w
      UNION ALL SELECT 'product', 'n_lines,first_line', abs(n_lines * first_line - line_sum) < 0.01 FROM w
      UNION ALL SELECT 'sum', 'last_line,first_line', abs(last_line + first_line - line_sum) < 0.01 FROM w
      UNION ALL SELECT 'product', 'last_line,first_line', abs(last_line * first_line - line_sum) < 0.01 FROM w
      UNION ALL SELECT 'sum', 'n_lines,last_line,first_line', abs(n_lines + last_line + first_line - line_sum) < 0.01 FROM w)
    SELECT operation, source_fields, 'line_sum' AS target_field, count(*) AS n_cases FROM t WHERE hit GROUP BY 1, 2""",
)
def numeric_derivation(spark, folder):
    wide = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.count("*").cast("double").alias("n_lines"),
        F.max("l_linenumber").cast("double").alias("last_line"),
        F.min("l_linenumber").cast("double").alias("first_line"),
        F.sum("l_linenumber").cast("double").alias("line_sum"),
    )
    return numeric.derivation_counts(wide, ["n_lines", "last_line", "first_line"], ["line_sum"])


AMOUNTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue"]


def amounts(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))


def _corr_sql(by: str = "") -> str:
    from itertools import combinations

    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    parts = [
        f"SELECT {head}'{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM amounts{tail}"
        for a, b in combinations(sorted(AMOUNTS), 2)
    ]
    return (
        "WITH amounts AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem) "
        + " UNION ALL ".join(parts)
    )


@query("corr_matrix", _corr_sql())
def corr_matrix(spark, folder):
    out = numeric.correlations(amounts(spark, folder), AMOUNTS)
    return out.withColumn("r", F.round("r", 9))


@query("corr_per_supplier", _corr_sql("l_suppkey"))
def corr_per_supplier(spark, folder):
    out = numeric.correlations(amounts(spark, folder), AMOUNTS, ["l_suppkey"])
    return out.withColumn("r", F.round("r", 9))


@query(
    "correlation_relations",
    f"""WITH m AS ({_corr_sql()}) SELECT a, b, r, CASE WHEN abs(r) > 0.99 THEN 'SAME_KEY_VALUE_PAIR' ELSE 'SAME_VALUE' END AS rule_type
    FROM m WHERE abs(r) > 0.9""",
)
def correlation_relations(spark, folder):
    matrix = numeric.correlations(amounts(spark, folder), AMOUNTS)
    return numeric.correlation_relations(matrix).withColumn("r", F.round("r", 9))


@query(
    "correlation_values",
    """SELECT l_orderkey AS case_id, 'l_extendedprice' AS a, 'revenue' AS b, count(*) AS n,
       round(sum(l_extendedprice - l_extendedprice * (1 - l_discount)), 4) AS gap FROM lineitem GROUP BY 1""",
)
def correlation_values(spark, folder):
    """The values behind the strong correlations, with the reduced price told apart from the price."""
    per_order = amounts(spark, folder).groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.count("*").alias("n"), F.sum("l_extendedprice").alias("l_extendedprice"), F.sum("revenue").alias("revenue")
    )
    matrix = numeric.correlations(amounts(spark, folder), AMOUNTS)
    strong = numeric.correlation_relations(matrix)
    values = numeric.correlation_values(per_order, strong, ["l_extendedprice", "revenue"])
    return values.join(per_order.select("case_id", "n"), "case_id").select(
        "case_id", "a", "b", "n", F.round(F.col("value_a") - F.col("value_b"), 4).alias("gap")
    )


@query(
    "grouped_stats",
    """SELECT l_returnflag, l_linestatus, """
    + ", ".join(
        f"round(sum({c}), 2) AS {c}_sum, round(avg({c}), 2) AS {c}_mean, round(stddev_samp({c}), 2) AS {c}_std"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    )
    + " FROM lineitem GROUP BY 1, 2",
)
def grouped_stats(spark, folder):
    return numeric.grouped_stats(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"]
    )


@query(
    "set_overlap",
    """WITH r AS (SELECT DISTINCT o_orderpriority AS g, o_custkey AS c FROM orders), s AS (SELECT g, count(*) AS n FROM r GROUP BY g),
    b AS (SELECT x.g AS g1, y.g AS g2, count(*) AS n FROM r x JOIN r y ON x.c = y.c AND x.g < y.g GROUP BY 1, 2)
    SELECT g1 AS o_orderpriority_1, g2 AS o_orderpriority_2, s1.n AS n_1, s2.n AS n_2, b.n AS n_both,
      round(b.n / (s1.n + s2.n - b.n)::DOUBLE, 9) AS jaccard FROM b JOIN s s1 ON s1.g = g1 JOIN s s2 ON s2.g = g2""",
)
def set_overlap(spark, folder):
    out = relations.set_overlap(table(spark, folder, "orders"), ["o_orderpriority"], "o_custkey")
    return out.withColumn("jaccard", F.round("jaccard", 9))


@query(
    "set_operations",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer)
    SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b)
    UNION ALL SELECT 'intersection', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
    UNION ALL SELECT 'difference', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""",
)
def set_operations(spark, folder):
    a = table(spark, folder, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    parts = [("union", a.union(b).distinct()), ("intersection", a.intersect(b)), ("difference", b.exceptAll(a))]
    out = None
    for name, part in parts:
        counted = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out
