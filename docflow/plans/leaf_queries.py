"""Queries over nested documents and row documents: leaves, keys, dates, arrays, names, types."""

from pyspark.sql import functions as F

from docflow.functions import names as nm
from docflow.functions.dates import normalize_date
from docflow.operators import arrays, doctypes, leaves, objects
from docflow.plans.inputs import LINES, event_documents, line_documents, order_flow
from docflow.plans.registry import query, table
from docflow.sources.files import ANY_XML, parse_raw
from docflow.sources.tables import row_documents, row_leaves

NUM = "CASE WHEN {0} = floor({0}) THEN ({0})::BIGINT::VARCHAR ELSE ({0})::VARCHAR END"


@query(
    "leaves_orders",
    """SELECT o_orderkey AS doc_id, 'o_custkey' AS key, 'LONG' AS vtype, o_custkey::DOUBLE AS num, NULL AS text FROM orders
    UNION ALL SELECT o_orderkey, 'o_orderstatus', 'STRING', NULL, o_orderstatus FROM orders
    UNION ALL SELECT o_orderkey, 'o_totalprice', 'DOUBLE', o_totalprice, NULL FROM orders
    UNION ALL SELECT o_orderkey, 'o_orderdate', 'STRING', NULL, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders
    UNION ALL SELECT o_orderkey, 'o_orderpriority', 'STRING', NULL, o_orderpriority FROM orders""",
)
def leaves_orders(spark, folder):
    orders = table(spark, folder, "orders")
    columns = [c for c in orders.columns if c != "o_orderkey"]
    leaf = row_leaves(orders, {"o_orderkey": "doc_id"}, columns)
    text = F.when(F.col("vtype") == "STRING", F.col("value"))
    return leaf.select("doc_id", "key", "vtype", "num", text.alias("text"))


@query(
    "json_leaves",
    """SELECT event_id AS doc_id, 'Event[0].Event_ID' AS path, 'Event_ID' AS key, 'LONG' AS vtype, event_id::DOUBLE AS num,
      'n:' || event_id AS norm, 0 AS entry_idx FROM events
    UNION ALL SELECT event_id, 'Event[0].User_ID', 'User_ID', 'LONG', user_id::DOUBLE, 'n:' || user_id, 0 FROM events
    UNION ALL SELECT event_id, 'Event[0].Type', 'Type', 'STRING', NULL, 's:' || event_type, 0 FROM events
    UNION ALL SELECT event_id, 'Event[0].Value', 'Value', 'DOUBLE', value, 'n:' || CASE WHEN value = floor(value)
      THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END, 0 FROM events
    UNION ALL SELECT event_id, 'Event[0].Props.k', 'k', 'LONG', json_extract(props, '$.k')::DOUBLE,
      'n:' || json_extract_string(props, '$.k'), 0 FROM events""",
)
def json_leaves(spark, folder):
    found = leaves.leaves(event_documents(spark, folder))
    return found.select("doc_id", "path", "key", "vtype", "num", "norm", "entry_idx")


@query(
    "key_signature",
    """SELECT 'Event Event_ID Props Type User_ID Value k' AS key_text, count(*) AS n_docs, min(event_id) AS first_doc FROM events""",
)
def key_signature(spark, folder):
    signed = leaves.key_signature(event_documents(spark, folder))
    return signed.groupBy("key_text").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


MIXED = """mixed AS (SELECT o_orderkey * 4 AS doc_id, 'Order custkey orderkey' AS key_text FROM orders
  UNION ALL SELECT c_custkey * 4 + 1, 'Customer custkey name' FROM customer
  UNION ALL SELECT s_suppkey * 4 + 2, 'Supplier name suppkey' FROM supplier)"""


def mixed_documents(spark, folder):
    parts = [
        ("orders", "o_orderkey", 0, "Order", {"o_orderkey": "orderkey", "o_custkey": "custkey"}),
        ("customer", "c_custkey", 1, "Customer", {"c_custkey": "custkey", "c_name": "name"}),
        ("supplier", "s_suppkey", 2, "Supplier", {"s_suppkey": "suppkey", "s_name": "name"}),
    ]
    out = None
    for name, key, shift, root, columns in parts:
        rows = table(spark, folder, name).select(
            (F.col(key) * 4 + shift).alias("doc"), *[F.col(c).alias(a) for c, a in columns.items()]
        )
        docs = row_documents(rows, F.col("doc"), root, root, list(columns.values()))
        out = docs if out is None else out.unionByName(docs)
    return out


@query(
    "structural_typing",
    f"WITH {MIXED} SELECT min(doc_id) AS cluster, count(*) AS n_docs FROM mixed GROUP BY key_text",
)
def structural_typing(spark, folder):
    docs = mixed_documents(spark, folder)
    return doctypes.cluster_sizes(doctypes.type_by_keys(leaves.key_signature(docs)))


@query(
    "date_normalize",
    """WITH shown AS (SELECT o_orderkey AS doc_id, o_orderdate AS d, CASE o_orderkey % 5
        WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
        WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M:%S')
        ELSE o_orderpriority END AS raw FROM orders)
    SELECT doc_id, raw, CASE WHEN doc_id % 5 = 4 THEN raw ELSE strftime(d, '%d.%m.%Y %H:%M:%S') END AS value FROM shown""",
)
def date_normalize(spark, folder):
    day = F.col("o_orderdate")
    turn = F.col("o_orderkey") % 5
    raw = (
        F.when(turn == 0, F.date_format(day, "dd.MM.yyyy"))
        .when(turn == 1, F.date_format(day, "yyyy/MM/dd"))
        .when(turn == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(turn == 3, F.date_format(day, "dd/MM/yyyy HH:mm:ss"))
        .otherwise(F.col("o_orderpriority"))
    )
    shown = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), raw.alias("raw"))
    return shown.withColumn("value", normalize_date(F.col("raw")))


@query(
    "timestamp_leaves",
    """SELECT o_orderkey AS doc_id, 'Order[0].Datum' AS path, epoch_us(o_orderdate) AS ts_us FROM orders
    UNION ALL SELECT o_orderkey, 'Order[0].Lieferung.Datum', epoch_us(o_orderdate) + 3 * 86400000000 FROM orders""",
)
def timestamp_leaves(spark, folder):
    day = F.col("o_orderdate")
    later = F.date_format(F.date_add(day, 3), "dd/MM/yyyy")
    body = F.struct(
        F.date_format(day, "dd.MM.yyyy").alias("Datum"),
        F.struct(later.alias("Datum"), F.col("o_orderpriority").alias("Art")).alias("Lieferung"),
    )
    docs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct(F.array(body).alias("Order"))).alias("content")
    )
    found = leaves.timestamp_leaves(leaves.leaves(docs))
    return found.select("doc_id", "path", F.unix_micros("ts").alias("ts_us"))


@query(
    "numeric_wide",
    """SELECT event_id AS doc_id, 0 AS entry_idx, value AS "Value", json_extract(props, '$.k')::DOUBLE AS k FROM events""",
)
def numeric_wide(spark, folder):
    return leaves.numeric_wide(leaves.leaves(event_documents(spark, folder)), ["doc_id"], ["Value", "k"])


@query("find_value", "SELECT event_id AS doc_id, user_id::VARCHAR AS value FROM events")
def find_value(spark, folder):
    return leaves.find_value(leaves.leaves(event_documents(spark, folder)), "userid")


PROFILE = f"""{LINES}, prof AS (SELECT doc_id, count(*) AS n_entries,
    first(length(line) > 0 ORDER BY no) AS base_full,
    count(*) FILTER (WHERE length(line) > 0) AS n_full FROM lines GROUP BY doc_id),
  flagged AS (SELECT *, n_entries >= 2 AND (CASE WHEN base_full THEN n_full = n_entries ELSE n_full = 0 END) AS is_uniform FROM prof)"""


@query(
    "array_profiles",
    f"""WITH {PROFILE} SELECT doc_id, 'Lines' AS path, n_entries, CASE WHEN base_full THEN 'Line,No,Size' ELSE 'Line,No' END AS base_keys,
      CASE WHEN base_full AND n_full < n_entries THEN 'Size' ELSE '' END AS missing_keys,
      CASE WHEN NOT base_full AND n_full > 0 THEN 'Size' ELSE '' END AS extra_keys, is_uniform FROM flagged""",
)
def array_profiles(spark, folder):
    found = arrays.array_profiles(line_documents(spark, folder))
    return found.select(
        "doc_id",
        "path",
        "n_entries",
        *[F.array_join(c, ",").alias(c) for c in ("base_keys", "missing_keys", "extra_keys")],
        "is_uniform",
    )


@query(
    "document_structure",
    f"""WITH {PROFILE} SELECT doc_id, is_uniform AS is_reference,
      CASE WHEN is_uniform THEN n_entries ELSE 1 END AS arrays_found FROM flagged""",
)
def document_structure(spark, folder):
    docs = line_documents(spark, folder)
    return arrays.document_structure(docs, arrays.array_profiles(docs)).drop("n_arrays")


@query(
    "uniformity_summary",
    f"""WITH {PROFILE} SELECT count(*) AS n_docs, count(*) AS n_with_arrays, count(*) FILTER (WHERE is_uniform) AS n_reference,
      sum(CASE WHEN is_uniform THEN n_entries ELSE 1 END)::BIGINT AS n_instances FROM flagged""",
)
def uniformity_summary(spark, folder):
    docs = line_documents(spark, folder)
    return arrays.uniformity_summary(arrays.document_structure(docs, arrays.array_profiles(docs)))


@query(
    "repeating_arrays",
    f"""WITH {LINES}, per AS (SELECT doc_id, 'No' AS key, count(DISTINCT no) AS k FROM lines GROUP BY doc_id
      UNION ALL SELECT doc_id, 'Line', count(DISTINCT line) FROM lines GROUP BY doc_id
      UNION ALL SELECT doc_id, 'Size', count(DISTINCT CASE WHEN length(line) > 0 THEN length(line) END) FROM lines GROUP BY doc_id),
    sizes AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
    SELECT doc_id, 'Lines' AS list_path, n AS n_entries, bool_or(k > 1 AND k < n / 2.0) AS is_repeating
    FROM per JOIN sizes USING (doc_id) GROUP BY doc_id, n""",
)
def repeating_arrays(spark, folder):
    return arrays.repeating_arrays(leaves.leaves(line_documents(spark, folder)))


@query(
    "explode_reference",
    f"""WITH {PROFILE} SELECT f.doc_id, l.no AS entry_idx, l.line AS line FROM flagged f JOIN lines l USING (doc_id) WHERE is_uniform
    UNION ALL SELECT doc_id, NULL, NULL FROM flagged WHERE NOT is_uniform""",
)
def explode_reference(spark, folder):
    docs = line_documents(spark, folder)
    structure = arrays.document_structure(docs, arrays.array_profiles(docs))
    rows = arrays.explode_reference(docs, structure, "Lines")
    line = F.when(F.col("is_reference"), F.get_json_object("content", "$.Line"))
    return rows.select("doc_id", "entry_idx", line.alias("line"))


@query(
    "entry_leaves",
    f"""WITH {LINES} SELECT doc_id, 'No' AS key, no::VARCHAR AS value FROM lines WHERE no = 2
    UNION ALL SELECT doc_id, 'Line', line FROM lines WHERE no = 2
    UNION ALL SELECT doc_id, 'Size', length(line)::VARCHAR FROM lines WHERE no = 2 AND length(line) > 0""",
)
def entry_leaves(spark, folder):
    leaf = leaves.leaves(line_documents(spark, folder))
    return leaves.entry_leaves(leaf, "Lines.No", "n:2").select("doc_id", "key", "value")


@query(
    "entry_at",
    f"""WITH {LINES} SELECT d.doc_id, l.line FROM documents d LEFT JOIN (SELECT * FROM lines WHERE no = 1) l USING (doc_id)""",
)
def entry_at(spark, folder):
    entry = leaves.entry_at(line_documents(spark, folder), "Lines", 1)
    return entry.select("doc_id", F.get_json_object("entry", "$.Line").alias("line"))


STOP = ("the", "and", "of", "to", "le", "la", "les", "der", "die", "das", "und", "el", "los", "de")


@query(
    "word_counts",
    f"""WITH t AS (SELECT CASE WHEN regexp_extract(text, '"([^"]+)"', 1) <> '' THEN regexp_extract(text, '"([^"]+)"', 1) || ' ' || text
        ELSE text END AS x FROM documents),
    w AS (SELECT unnest(regexp_split_to_array(lower(x), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM t)
    SELECT word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN {STOP} GROUP BY word""",
)
def word_counts(spark, folder):
    words = table(spark, folder, "documents").select(nm.prepared_tokens(F.col("text"), list(STOP)).alias("w"))
    return words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    "type_names",
    """SELECT lang AS cluster, lang || '_report' AS doc_type, count(*) AS n_docs FROM documents GROUP BY lang""",
)
def type_names(spark, folder):
    doc_id = F.col("doc_id")
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("/in/"), "source", F.lit("/"), "lang", F.lit("_report"), doc_id.cast("string"), F.lit(".json")).alias("path"),
        F.col("lang").alias("cluster"),
    )
    names = doctypes.name_types(docs, docs.select("doc_id", "cluster"))
    return names.join(doctypes.cluster_sizes(docs), "cluster")


@query(
    "name_groups",
    """WITH RECURSIVE raw AS (SELECT p_partkey AS doc_id, p_name AS f FROM part UNION ALL SELECT 10000000000 + r_regionkey, r_name FROM region
        UNION ALL SELECT 20000000000 + n_nationkey, n_name FROM nation),
    named AS (SELECT doc_id, lower(regexp_replace(regexp_replace(f, '[0-9]+', '', 'g'), '\\s+', '', 'g')) AS name FROM raw),
    names AS (SELECT DISTINCT name FROM named WHERE name <> ''),
    e AS (SELECT x.name AS s, y.name AS d FROM names x JOIN names y ON x.name <> y.name AND (contains(x.name, y.name) OR contains(y.name, x.name))),
    walk(name, root) AS (SELECT name, name FROM names UNION SELECT e.d, walk.root FROM walk JOIN e ON e.s = walk.name),
    grp AS (SELECT name, min(root) AS name_group FROM walk GROUP BY name)
    SELECT doc_id, name, name_group FROM named JOIN grp USING (name)""",
)
def name_groups(spark, folder):
    def files(name, key, text, shift):
        return table(spark, folder, name).select(
            (F.col(key).cast("long") + shift).alias("doc_id"), F.concat(F.lit("/in/"), text, F.lit(".json")).alias("path")
        )

    docs = (
        files("part", "p_partkey", "p_name", 0)
        .unionByName(files("region", "r_regionkey", "r_name", 10_000_000_000))
        .unionByName(files("nation", "n_nationkey", "n_name", 20_000_000_000))
    )
    return doctypes.group_by_names(docs)


@query(
    "activity_parts",
    """WITH p AS (SELECT DISTINCT p_type, p_brand, p_name FROM part),
    named AS (SELECT '((''' || p_type || ''', ''' || p_brand || '''), (''' || p_name || '''))' AS activity, p_type, p_brand, p_name FROM p)
    SELECT activity, least(p_type, p_brand) || ',' || greatest(p_type, p_brand) AS inputs, replace(p_name, ' ', '') AS outputs,
      p_name AS target, replace(lower(activity), ' ', '') AS normal FROM named""",
)
def activity_parts(spark, folder):
    parts = table(spark, folder, "part").select("p_type", "p_brand", "p_name").distinct()
    named = parts.select(nm.activity_name(F.array("p_type", "p_brand"), F.array("p_name")).alias("activity"))
    return named.select(
        "activity",
        F.array_join(nm.activity_inputs(F.col("activity")), ",").alias("inputs"),
        F.array_join(nm.activity_outputs(F.col("activity")), ",").alias("outputs"),
        nm.target_type(F.col("activity")).alias("target"),
        nm.normalize_activity(F.col("activity")).alias("normal"),
    )


def german_lines(spark, folder):
    """Order lines with the business names of their amounts."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_quantity").alias("Menge"),
        F.col("l_extendedprice").alias("Gesamtpreis"),
        F.col("l_discount").alias("Rabattbetrag"),
        F.col("l_tax").alias("Steuer"),
    )


@query(
    "number_categories",
    """SELECT 'quantity' AS category, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem
    UNION ALL SELECT 'price', 2 * count(*), round(sum(l_extendedprice) + sum(l_discount), 2) FROM lineitem
    UNION ALL SELECT 'other', count(*), round(sum(l_tax), 2) FROM lineitem""",
)
def number_categories(spark, folder):
    leaf = row_leaves(german_lines(spark, folder), {"doc_id": "doc_id"}, ["Menge", "Gesamtpreis", "Rabattbetrag", "Steuer"])
    numbers = leaves.categorized_numbers(leaf)
    return numbers.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("num"), 2).alias("total"))


@query(
    "type_mode",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rk FROM c)
    SELECT user_id, event_type, n FROM r WHERE rk = 1""",
)
def type_mode(spark, folder):
    return leaves.mode_value(table(spark, folder, "events"), ["user_id"], "event_type")


@query(
    "top_files",
    """WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents)
    SELECT source, doc_id, n_chars FROM r WHERE rk <= 3""",
)
def top_files(spark, folder):
    docs = table(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return leaves.top_per_group(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


@query(
    "schema_attributes",
    """WITH n AS (SELECT count(*) AS n FROM events)
    SELECT 'event' AS doc_type, 'Event[].' || k AS attribute, t AS types, n AS n_docs, true AS required FROM n,
      (VALUES ('Event_ID', 'integer'), ('User_ID', 'integer'), ('Type', 'string'), ('Value', 'number'), ('Props.k', 'integer')) v(k, t)
    UNION ALL SELECT 'lines', 'lang', 'string', count(*), true FROM documents
    UNION ALL SELECT 'lines', 'Lines[].No', 'integer', count(*), true FROM documents
    UNION ALL SELECT 'lines', 'Lines[].Line', 'string', count(*), true FROM documents
    UNION ALL SELECT 'lines', 'Lines[].Size', 'integer', count(*) FILTER (WHERE length(replace(text, chr(10), '')) > 0),
      bool_and(length(replace(text, chr(10), '')) > 0) FROM documents""",
)
def schema_attributes(spark, folder):
    events = event_documents(spark, folder).withColumn("doc_type", F.lit("event"))
    lines = line_documents(spark, folder).withColumn("doc_type", F.lit("lines"))
    leaf = leaves.leaves(events, ["doc_type", "doc_id"]).unionByName(leaves.leaves(lines, ["doc_type", "doc_id"]))
    return objects.attributes(leaf)


@query(
    "type_schemas",
    """SELECT 'Order' AS doc_type, 'OBJECT<Order: ARRAY<OBJECT<custkey: BIGINT, orderkey: BIGINT>>>' AS schema, count(*) AS n_docs FROM orders
    UNION ALL SELECT 'Customer', 'OBJECT<Customer: ARRAY<OBJECT<custkey: BIGINT, name: STRING>>>', count(*) FROM customer
    UNION ALL SELECT 'Supplier', 'OBJECT<Supplier: ARRAY<OBJECT<name: STRING, suppkey: BIGINT>>>', count(*) FROM supplier""",
)
def type_schemas(spark, folder):
    return objects.type_schemas(mixed_documents(spark, folder))


@query(
    "object_categories",
    """WITH a AS (SELECT 'order' AS doc_type, 1 AS n FROM orders
      UNION ALL SELECT 'customer', (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) FROM customer
      UNION ALL SELECT 'supplier', 0 FROM supplier)
    SELECT doc_type, CASE WHEN bool_and(n = 1) THEN 'process_instance' WHEN bool_or(n > 1) THEN 'process_instance_independent'
      WHEN bool_and(n = 0) THEN 'independent' ELSE 'mixed' END AS category FROM a GROUP BY doc_type""",
)
def object_categories(spark, folder):
    orders, customer, supplier = (table(spark, folder, t) for t in ("orders", "customer", "supplier"))

    def doc(kind, key):
        return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("doc_id")

    docs = (
        orders.select(doc("order", "o_orderkey"), F.lit("order").alias("doc_type"))
        .unionByName(customer.select(doc("customer", "c_custkey"), F.lit("customer").alias("doc_type")))
        .unionByName(supplier.select(doc("supplier", "s_suppkey"), F.lit("supplier").alias("doc_type")))
    )
    members = orders.select(doc("order", "o_orderkey"), F.col("o_orderkey").alias("case_id")).unionByName(
        orders.select(doc("customer", "o_custkey"), F.col("o_orderkey").alias("case_id"))
    )
    return objects.categories(objects.case_assignments(docs, members))


@query(
    "process_layers",
    """WITH n AS (SELECT count(DISTINCT case_id) AS n FROM (SELECT o_orderkey AS case_id FROM orders UNION ALL SELECT l_orderkey FROM lineitem)),
    d AS (SELECT 'order' AS cluster, count(*) AS n_docs, false AS r FROM orders
      UNION ALL SELECT 'ship_' || l_returnflag, count(*), false FROM lineitem GROUP BY 1
      UNION ALL SELECT 'customer', count(*), true FROM customer)
    SELECT cluster, n_docs, CASE WHEN r THEN 'reference' WHEN n_docs / n::DOUBLE > 0.8 THEN 'main' ELSE 'exception' END AS layer FROM d, n""",
)
def process_layers(spark, folder):
    flow = order_flow(spark, folder)
    docs = flow.select(F.col("activity").alias("cluster"), F.lit(False).alias("is_reference")).unionByName(
        table(spark, folder, "customer").select(F.lit("customer").alias("cluster"), F.lit(True).alias("is_reference"))
    )
    return objects.layers(docs, flow.agg(F.count_distinct("case_id").alias("n")).scalar())


@query(
    "parse_xml_shapes",
    """SELECT 'customer' AS shape, c_custkey AS number, c_nationkey AS nation, c_mktsegment AS label, 1 AS n_positions FROM customer WHERE c_custkey % 5 <> 0
    UNION ALL SELECT 'order', o_orderkey, NULL, o_orderstatus, greatest(n, 1) FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    UNION ALL SELECT 'broken', NULL, NULL, NULL, count(*) FROM customer WHERE c_custkey % 5 = 0""",
)
def parse_xml_shapes(spark, folder):
    """Two kinds of XML files, one of them with a list, and broken ones, read without naming any tag beforehand."""
    text = lambda c: F.col(c).cast("string")
    customer = table(spark, folder, "customer")
    shaped = F.concat(
        F.lit("<?xml version='1.0'?><kunde art='x'><nr>"), text("c_custkey"), F.lit("</nr><anschrift><land>"), text("c_nationkey"),
        F.lit("</land></anschrift><segment>"), text("c_mktsegment"), F.when(F.col("c_custkey") % 5 == 0, "</kunde>").otherwise("</segment></kunde>"),
    )
    customers = customer.select(F.concat(F.lit("/in/customer/"), text("c_custkey"), F.lit(".xml")).alias("path"), shaped.alias("value"))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.concat_ws("", F.collect_list(F.concat(F.lit("<pos><teil>"), text("l_partkey"), F.lit("</teil></pos>")))).alias("pos")
    )
    orders = table(spark, folder, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    orders = orders.select(
        F.concat(F.lit("/in/order/"), text("o_orderkey"), F.lit(".xml")).alias("path"),
        F.concat(F.lit("<auftrag><id>"), text("o_orderkey"), F.lit("</id><status>"), text("o_orderstatus"), F.lit("</status>"), F.col("pos"), F.lit("</auftrag>")).alias("value"),
    )
    documents, rejects = parse_raw(customers.unionByName(orders), ANY_XML)
    got = lambda *paths: F.coalesce(*[F.get_json_object("content", p) for p in paths])
    listed = F.coalesce(F.json_array_length(got("$.pos")), F.lit(1)).cast("long")
    good = documents.select(
        F.regexp_extract("path", "/in/([^/]+)/", 1).alias("shape"), got("$.nr", "$.id").cast("long").alias("number"),
        got("$.anschrift.land").cast("int").alias("nation"), got("$.segment", "$.status").alias("label"), listed.alias("n_positions"),
    )
    none = [F.lit(None).cast(t).alias(n) for n, t in (("number", "long"), ("nation", "int"), ("label", "string"))]
    bad = rejects.groupBy(F.lit("broken").alias("shape")).agg(F.count("*").alias("n_positions")).select("shape", *none, "n_positions")
    return good.unionByName(bad)


@query(
    "parse_files",
    """SELECT 'orders' AS folder, 'json' AS kind, count(*) AS n_documents, 0 AS n_rejects, sum(o_custkey)::BIGINT AS checksum FROM orders
    UNION ALL SELECT 'customers', 'xml', count(*), 0, sum(c_nationkey)::BIGINT FROM customer
    UNION ALL SELECT 'notes', 'txt', 0, count(*), NULL FROM supplier
    UNION ALL SELECT 'broken', 'json', 0, count(*), NULL FROM part""",
)
def parse_files(spark, folder):
    """File contents made of table rows: JSON orders, XML customers, text notes and malformed JSON."""
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("/in/orders/Order"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("path"),
        F.to_json(F.struct(F.col("o_custkey").alias("key"))).alias("value"),
    )
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("/in/customers/Customer"), F.col("c_custkey").cast("string"), F.lit(".xml")).alias("path"),
        F.concat(F.lit("<c id='1'><key>"), F.col("c_nationkey").cast("string"), F.lit("</key></c>")).alias("value"),
    )
    notes = table(spark, folder, "supplier").select(
        F.concat(F.lit("/in/notes/"), F.col("s_name"), F.lit(".txt")).alias("path"), F.col("s_name").alias("value")
    )
    broken = table(spark, folder, "part").select(
        F.concat(F.lit("/in/broken/"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"),
        F.concat(F.lit('{"name": '), "p_name").alias("value"),
    )
    raw = orders.unionByName(customers).unionByName(notes).unionByName(broken)
    documents, rejects = parse_raw(raw, "key STRING")
    place = [
        F.regexp_extract("path", r"/in/([^/]+)/", 1).alias("folder"),
        F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"),
    ]
    good = documents.select(*place, F.lit(1).alias("d"), F.lit(0).alias("r"), F.get_json_object("content", "$.key").cast("long").alias("k"))
    bad = rejects.select(*place, F.lit(0).alias("d"), F.lit(1).alias("r"), F.lit(None).cast("long").alias("k"))
    return (
        good.unionByName(bad)
        .groupBy("folder", "kind")
        .agg(F.sum("d").alias("n_documents"), F.sum("r").alias("n_rejects"), F.sum("k").alias("checksum"))
    )


@query("doc_typing")
def doc_typing(spark, folder):
    """Words of the text documents, clustered with the best k; cluster sizes."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("key_text"))
    vectors = doctypes.tfidf(doctypes.tokens(docs))
    sweep = doctypes.sweep_k(vectors)
    best = sweep.where("is_best").first()["k"]
    return doctypes.cluster_sizes(doctypes.label_documents(vectors, best))
