"""Queries from relations to activities, nets and decisions."""

from pyspark.sql import functions as F

from docflow.operators import activities as act
from docflow.operators import cases, curate, decisions, eventlog, footprint, nets, objects, relations
from docflow.plans.inputs import FLOW_ORDER, ORDER_FLOW, USER_LOG, flow_documents, order_flow, user_log
from docflow.plans.leaf_queries import german_lines
from docflow.plans.log_queries import BOTH, COMPOSITION, DFG, FLOW_STEPS, STEPS
from docflow.plans.registry import query, table
from docflow.session import cut_lineage
from docflow.sources.tables import row_leaves

# ---------------------------------------------------------------- relations of the order cases


def case_leaf(spark, folder):
    """Leaves of order cases: the order, its shipments by kind, and the customer as reference data."""
    orders, lines, customer = (table(spark, folder, t) for t in ("orders", "lineitem", "customer"))

    def rows(df, case, doc, cluster, ts, shared, keys):
        head = df.select(
            F.col(case).alias("case_id"),
            doc.alias("doc_id"),
            cluster.alias("cluster"),
            ts.cast("timestamp").alias("final_ts"),
            *[F.col(c).cast("long").alias(a) for c, a in keys.items()],
        )
        leaf = row_leaves(
            head,
            {c: c for c in ("case_id", "doc_id", "cluster", "final_ts")},
            list(keys.values()),
        )
        return leaf.select("case_id", "doc_id", "cluster", "final_ts", "key", "norm").withColumn(
            "is_shared", F.lit(shared)
        )

    own = rows(
        orders, "o_orderkey", F.lit("order"), F.lit("order"), F.col("o_orderdate"), False,
        {"o_orderkey": "orderkey", "o_custkey": "custkey"},
    )
    ship = F.concat(F.lit("ship_"), "l_returnflag")
    shipped = rows(
        lines, "l_orderkey", ship, ship, F.col("l_shipdate"), False,
        {"l_orderkey": "orderkey", "l_partkey": "partkey", "l_suppkey": "suppkey"},
    )
    buyers = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(customer, "c_custkey")
    bought = rows(
        buyers, "o_orderkey", F.lit("customer"), F.lit("customer"), F.lit(None), True,
        {"c_custkey": "custkey", "c_nationkey": "nationkey"},
    )
    return own.unionByName(shipped).unionByName(bought).withColumn("variant_id", F.lit(0))


INSTANCES = """cl AS (
    SELECT o_orderkey AS case_id, 'order' AS cluster, o_orderdate AS ts, false AS shared, 'orderkey' AS key, o_orderkey AS v FROM orders
    UNION ALL SELECT o_orderkey, 'order', o_orderdate, false, 'custkey', o_custkey FROM orders
    UNION ALL SELECT l_orderkey, 'ship_' || l_returnflag, l_shipdate, false, 'orderkey', l_orderkey FROM lineitem
    UNION ALL SELECT l_orderkey, 'ship_' || l_returnflag, l_shipdate, false, 'partkey', l_partkey FROM lineitem
    UNION ALL SELECT l_orderkey, 'ship_' || l_returnflag, l_shipdate, false, 'suppkey', l_suppkey FROM lineitem
    UNION ALL SELECT o_orderkey, 'customer', NULL, true, 'custkey', c_custkey FROM orders JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT o_orderkey, 'customer', NULL, true, 'nationkey', c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey),
  cells AS MATERIALIZED (SELECT case_id, cluster, key, v, min(ts) AS ts, bool_or(shared) AS shared FROM cl GROUP BY 1, 2, 3, 4),
  met AS MATERIALIZED (SELECT case_id, v, list({'cluster': cluster, 'key': key, 'v': v, 'ts': ts, 'shared': shared}) AS l
    FROM cells GROUP BY case_id, v HAVING count(*) > 1),
  met_x AS (SELECT case_id, l, unnest(l) AS x FROM met), met_xy AS (SELECT case_id, x, unnest(l) AS y FROM met_x),
  inst AS (SELECT case_id, x.cluster AS cluster_1, y.cluster AS cluster_2,
      CASE WHEN x.key = y.key THEN 'SAME_KEY_VALUE_PAIR' WHEN x.v IN (0, 1) THEN 'SAME_COMMON_VALUE' ELSE 'SAME_VALUE' END AS rule_type,
      least(x.key, y.key) AS key_lo, greatest(x.key, y.key) AS key_hi, 'n:' || x.v AS norm,
      CASE WHEN NOT x.shared AND NOT y.shared THEN CASE WHEN x.ts < y.ts THEN -1 ELSE 1 END
        WHEN x.shared AND NOT y.shared THEN -1 WHEN y.shared AND NOT x.shared THEN 1 ELSE 0 END AS w_1, x.ts AS ts_1, y.ts AS ts_2,
      x.key AS key_1, y.key AS key_2
    FROM met_xy WHERE x.cluster < y.cluster)"""


@query(
    "relation_instances",
    f"WITH {INSTANCES} SELECT case_id, cluster_1, cluster_2, rule_type, key_lo, key_hi, norm, w_1 FROM inst",
)
def relation_instances(spark, folder):
    found = relations.relation_instances(case_leaf(spark, folder))
    return found.select("case_id", "cluster_1", "cluster_2", *relations.RULE, "norm", "w_1")


COUNTS = f"""{ORDER_FLOW}, {COMPOSITION}, vs AS (SELECT case_id,
      string_agg(cluster || '=' || n_own, ',' ORDER BY cluster || '=' || n_own) AS variant FROM comp GROUP BY case_id),
  vc AS (SELECT variant, count(*) AS variant_count FROM vs GROUP BY variant),
  pc AS (SELECT DISTINCT cluster_1, cluster_2, rule_type, key_lo, key_hi, case_id FROM inst),
  pv AS (SELECT cluster_1, cluster_2, rule_type, key_lo, key_hi, variant, count(*) AS n FROM pc JOIN vs USING (case_id) GROUP BY ALL),
  cnt AS (SELECT cluster_1, cluster_2, rule_type, key_lo, key_hi, sum(n)::BIGINT AS n_cases, sum(variant_count)::BIGINT AS n_expected
    FROM pv JOIN vc USING (variant) GROUP BY ALL)"""
JUDGED = """ty AS (SELECT 'order' AS cluster, count(*) AS n, false AS ref FROM orders UNION ALL
    SELECT 'ship_' || l_returnflag, count(*), false FROM lineitem GROUP BY 1 UNION ALL SELECT 'customer', count(*), true FROM customer),
  st AS (SELECT *, CASE rule_type WHEN 'SAME_KEY_VALUE_PAIR' THEN 3 WHEN 'SAME_VALUE' THEN 2 ELSE 1 END AS s FROM cnt),
  ks AS (SELECT DISTINCT cluster_1, cluster_2, rule_type, key_lo, key_hi, n_cases, s, k FROM st, LATERAL (SELECT unnest([key_lo, key_hi]) AS k)),
  mx AS (SELECT cluster_1, cluster_2, k, max((n_cases, s)) AS best FROM ks GROUP BY 1, 2, 3),
  lost AS (SELECT ks.cluster_1, ks.cluster_2, rule_type, key_lo, key_hi, bool_or((n_cases, s) < best) AS lost
    FROM ks JOIN mx ON mx.cluster_1 = ks.cluster_1 AND mx.cluster_2 = ks.cluster_2 AND mx.k = ks.k GROUP BY 1, 2, 3, 4, 5),
  withtop AS (SELECT st.*, lost, max(CASE WHEN NOT lost THEN n_cases END) OVER (PARTITION BY st.cluster_1, st.cluster_2) AS top
    FROM st JOIN lost USING (cluster_1, cluster_2, rule_type, key_lo, key_hi)),
  judged AS (SELECT w.cluster_1, w.cluster_2, rule_type, key_lo, key_hi, n_cases, n_expected,
      CASE WHEN lost THEN 'weaker rule on the same key' WHEN n_cases < 0.9 * top THEN 'well below the best rule'
        WHEN NOT (n_cases > (CASE WHEN rule_type = 'SAME_COMMON_VALUE' THEN 1.0 ELSE 0.8 END) * n_expected
          OR (NOT a.ref AND n_cases > 0.9 * a.n) OR (NOT b.ref AND n_cases > 0.9 * b.n)) THEN 'not significant' END AS reason
    FROM withtop w JOIN ty a ON a.cluster = cluster_1 JOIN ty b ON b.cluster = cluster_2)"""


def _variants(spark, folder):
    return cases.case_variants(cases.composition(flow_documents(spark, folder)))


def _types(spark, folder):
    docs = order_flow(spark, folder).select(F.col("activity").alias("cluster"), F.lit(False).alias("ref"))
    customers = table(spark, folder, "customer").select(F.lit("customer").alias("cluster"), F.lit(True).alias("ref"))
    return docs.unionByName(customers).groupBy("cluster").agg(
        F.count("*").alias("n_instances"), F.bool_or("ref").alias("any_reference")
    )


def _judged(spark, folder, instances):
    counts = relations.relation_counts(instances, _variants(spark, folder))
    return cut_lineage(relations.judge_relations(cut_lineage(counts), _types(spark, folder)))


@query(
    "relation_counts",
    f"WITH {INSTANCES}, {COUNTS} SELECT * FROM cnt",
)
def relation_counts(spark, folder):
    found = relations.relation_instances(case_leaf(spark, folder))
    return relations.relation_counts(found, _variants(spark, folder)).drop("variant_1", "variant_2")


@query(
    "content_relations",
    f"WITH {INSTANCES}, {COUNTS}, {JUDGED} SELECT *, reason IS NULL AS accepted FROM judged",
)
def content_relations(spark, folder):
    found = relations.relation_instances(case_leaf(spark, folder))
    return _judged(spark, folder, found).drop("variant_1", "variant_2")


OBJECTS = """w AS (SELECT i.cluster_1, i.cluster_2, avg(w_1) AS w FROM inst i JOIN judged j ON j.reason IS NULL AND i.cluster_1 = j.cluster_1
      AND i.cluster_2 = j.cluster_2 AND i.rule_type = j.rule_type AND i.key_lo = j.key_lo AND i.key_hi = j.key_hi GROUP BY 1, 2),
  obj AS (SELECT cluster_1, cluster_2, cluster_1 AS cluster, w AS weight FROM w UNION ALL SELECT cluster_1, cluster_2, cluster_2, -w FROM w)"""
DIRECTED = f"""{OBJECTS}, d1 AS (SELECT *, CASE WHEN weight < -0.2 THEN 'input' WHEN weight > 0.2 THEN 'output' ELSE 'unclear' END AS direction FROM obj),
  d2 AS (SELECT *, bool_or(direction = 'input') OVER p AND bool_or(direction = 'output') OVER p AS clear FROM d1 WINDOW p AS (PARTITION BY cluster_1, cluster_2)),
  u AS (SELECT cluster, bool_or(direction = 'input') AS i, bool_or(direction = 'output') AS o FROM d2 WHERE clear AND direction <> 'unclear' GROUP BY cluster),
  d3 AS (SELECT d2.cluster_1, d2.cluster_2, d2.cluster, CASE WHEN i THEN 0.15 WHEN o THEN -0.15 ELSE weight END AS weight FROM d2 LEFT JOIN u USING (cluster) WHERE NOT clear),
  d4 AS (SELECT *, CASE WHEN weight < -0.1 THEN 'input' WHEN weight > 0.1 THEN 'output' ELSE 'unclear' END AS direction FROM d3),
  d5 AS (SELECT *, bool_or(direction = 'input') OVER p AND bool_or(direction = 'output') OVER p AS kept FROM d4 WINDOW p AS (PARTITION BY cluster_1, cluster_2)),
  directed AS (SELECT cluster_1, cluster_2, cluster, weight, direction FROM d2 WHERE clear AND direction <> 'unclear'
    UNION ALL SELECT cluster_1, cluster_2, cluster, weight, direction FROM d5 WHERE kept AND direction <> 'unclear')"""


@query(
    "directed_objects",
    f"""WITH {INSTANCES}, {COUNTS}, {JUDGED}, {DIRECTED}
    SELECT cluster_1, cluster_2, cluster, round(weight, 9) AS weight, direction FROM directed""",
)
def directed_objects(spark, folder):
    found = relations.relation_instances(case_leaf(spark, folder))
    found = cut_lineage(found.select("case_id", *relations.PAIR, *relations.RULE, "w_1"))
    accepted = _judged(spark, folder, found).where("accepted")
    out = act.directed_objects(relations.relation_objects(found, accepted))
    return out.select("cluster_1", "cluster_2", "cluster", F.round("weight", 9).alias("weight"), "direction")


def line_leaf(spark, folder):
    """case_leaf with every order line as a document of its own, so that a case holds several of a type."""
    lines = table(spark, folder, "lineitem")
    head = lines.select(
        F.col("l_orderkey").alias("case_id"),
        F.concat(F.lit("line_"), "l_linenumber").alias("doc_id"),
        F.concat(F.lit("ship_"), "l_returnflag").alias("cluster"),
        F.col("l_shipdate").cast("timestamp").alias("final_ts"),
        *[F.col(f"l_{k}").cast("long").alias(k) for k in ("orderkey", "partkey", "suppkey")],
    )
    leaf = row_leaves(head, {c: c for c in ("case_id", "doc_id", "cluster", "final_ts")}, ["orderkey", "partkey", "suppkey"])
    shipped = leaf.select("case_id", "doc_id", "cluster", "final_ts", "key", "norm", F.lit(False).alias("is_shared"), F.lit(0).alias("variant_id"))
    return case_leaf(spark, folder).where(~F.col("cluster").startswith("ship_")).unionByName(shipped)


DOCUMENTS = f"""{INSTANCES}, {COUNTS}, {JUDGED}, hit AS MATERIALIZED (SELECT DISTINCT i.case_id, i.cluster_1, i.cluster_2, i.rule_type, i.key_lo, i.key_hi, norm,
      i.key_1, i.key_2 FROM inst i JOIN judged j ON j.reason IS NULL AND j.cluster_1 = i.cluster_1 AND j.cluster_2 = i.cluster_2
      AND j.rule_type = i.rule_type AND j.key_lo = i.key_lo AND j.key_hi = i.key_hi),
  own AS MATERIALIZED (SELECT o_orderkey AS case_id, 'order' AS cluster, 'orderkey' AS key, 'n:' || o_orderkey AS norm, 'order' AS doc, o_orderdate AS ts FROM orders
    UNION ALL SELECT o_orderkey, 'order', 'custkey', 'n:' || o_custkey, 'order', o_orderdate FROM orders
    UNION ALL SELECT o_orderkey, 'customer', 'custkey', 'n:' || c_custkey, 'customer', NULL FROM orders JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT o_orderkey, 'customer', 'nationkey', 'n:' || c_nationkey, 'customer', NULL FROM orders JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT l_orderkey, 'ship_' || l_returnflag, k.key, 'n:' || k.v, 'line_' || l_linenumber, l_shipdate FROM lineitem,
      LATERAL (SELECT unnest([{{'key': 'orderkey', 'v': l_orderkey}}, {{'key': 'partkey', 'v': l_partkey}}, {{'key': 'suppkey', 'v': l_suppkey}}]) AS k)),
  side AS (SELECT case_id, cluster_1, cluster_2, rule_type, key_lo, key_hi, norm, 1 AS side, cluster_1 AS cluster, key_1 AS key FROM hit
    UNION SELECT case_id, cluster_1, cluster_2, rule_type, key_lo, key_hi, norm, 2, cluster_2, key_2 FROM hit),
  docs AS MATERIALIZED (SELECT case_id, cluster_1, cluster_2, rule_type, key_lo, key_hi, norm, side, cluster, key, doc, min(ts) AS ts
    FROM side JOIN own USING (case_id, cluster, key, norm) GROUP BY ALL)"""


def _documents(spark, folder):
    """(accepted relations, all documents behind their occurrences) with order lines as documents."""
    leaf = line_leaf(spark, folder)
    found = cut_lineage(relations.relation_instances(leaf))
    accepted = _judged(spark, folder, found).where("accepted")
    hits = relations.small_join(found, accepted.select(*relations.PAIR, *relations.RULE), [*relations.PAIR, *relations.RULE], "left_semi")
    return accepted, found, relations.evidence_documents(hits, leaf)


@query(
    "relation_documents",
    f"WITH {DOCUMENTS} SELECT case_id, cluster_1, cluster_2, rule_type, key_lo, key_hi, norm, side, doc, ts FROM docs",
)
def relation_documents(spark, folder):
    found = _documents(spark, folder)[2]
    return found.select("case_id", "cluster_1", "cluster_2", *relations.RULE, "norm", "side", "doc", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "relation_document_directions",
    f"""WITH {DOCUMENTS}, one AS MATERIALIZED (SELECT * FROM docs WHERE side = 1 AND ts IS NOT NULL), two AS MATERIALIZED (SELECT * FROM docs WHERE side = 2 AND ts IS NOT NULL),
    dp AS (SELECT cluster_1, cluster_2, count(*) AS n_pairs, count(*) FILTER (WHERE x.ts < y.ts) AS n_before
      FROM one x JOIN two y USING (case_id, cluster_1, cluster_2, rule_type, key_lo, key_hi, norm) GROUP BY 1, 2)
    SELECT cluster_1, cluster_2, n_pairs, n_before, n_pairs - n_before AS n_after, round((n_pairs - 2 * n_before) / n_pairs::DOUBLE, 9) AS weight FROM dp""",
)
def relation_document_directions(spark, folder):
    found = relations.document_directions(_documents(spark, folder)[2])
    return found.select("cluster_1", "cluster_2", "n_pairs", "n_before", "n_after", F.round("weight", 9).alias("weight"))


@query(
    "activity_document_uses",
    f"""WITH {DOCUMENTS}, {DIRECTED} SELECT d.cluster_1 || '|0|' || d.cluster_2 || '|0' AS activity_id, g.direction, d.cluster, count(DISTINCT d.case_id || ':' || d.doc) AS n_docs
    FROM docs d JOIN (SELECT DISTINCT cluster_1, cluster_2, cluster, direction FROM directed) g USING (cluster_1, cluster_2, cluster) GROUP BY 1, 2, 3""",
)
def activity_document_uses(spark, folder):
    """Documents of several a type and case that activities use on either side."""
    accepted, found, documents = _documents(spark, folder)
    directed = cut_lineage(act.directed_objects(relations.relation_objects(found, accepted)))
    io = cut_lineage(directed.select(act.activity_id().alias("activity_id"), "direction", *act.OBJECT).distinct())
    named = documents.withColumn("activity_id", act.activity_id()).withColumn("doc", F.concat_ws(":", "case_id", "doc"))
    return act.document_uses(named, io).groupBy("activity_id", "direction", "cluster").agg(F.count("*").alias("n_docs"))


def _activities(spark, folder):
    """io, rules and evidence of the content activities of the order cases."""
    found = cut_lineage(relations.relation_instances(case_leaf(spark, folder)))
    accepted = _judged(spark, folder, found).where("accepted")
    directed = cut_lineage(act.directed_objects(relations.relation_objects(found, accepted)))
    io, rules, evidence = act.content_activities(directed, accepted, found)
    return cut_lineage(io), cut_lineage(rules), evidence


IO = f"""{INSTANCES}, {COUNTS}, {JUDGED}, {DIRECTED},
  io AS (SELECT DISTINCT cluster_1 || '|0|' || cluster_2 || '|0' AS activity_id, direction, cluster FROM directed),
  ru AS (SELECT DISTINCT cluster_1 || '|0|' || cluster_2 || '|0' AS activity_id, rule_type, key_lo, key_hi FROM judged
    WHERE reason IS NULL AND cluster_1 || '|0|' || cluster_2 || '|0' IN (SELECT activity_id FROM io)),
  ev AS (SELECT i.cluster_1 || '|0|' || i.cluster_2 || '|0' AS activity_id, i.case_id, i.ts_1, i.ts_2 FROM inst i JOIN ru
    ON ru.activity_id = i.cluster_1 || '|0|' || i.cluster_2 || '|0' AND ru.rule_type = i.rule_type AND ru.key_lo = i.key_lo AND ru.key_hi = i.key_hi)"""


@query(
    "content_activities",
    f"""WITH {IO}, s AS (SELECT activity_id, string_agg(DISTINCT cluster, ''', ''' ORDER BY cluster) FILTER (WHERE direction = 'input') AS i,
      string_agg(DISTINCT cluster, ''', ''' ORDER BY cluster) FILTER (WHERE direction = 'output') AS o FROM io GROUP BY 1)
    SELECT activity_id, '((''' || i || '''), (''' || o || '''))' AS name FROM s""",
)
def content_activities(spark, folder):
    io, _, _ = _activities(spark, folder)
    names = io.select("cluster", F.col("cluster").alias("doc_type")).distinct()
    return act.name_activities(io, names).select("activity_id", "name")


@query(
    "attribute_weights",
    f"""WITH {IO}, k AS (SELECT key_lo AS attr FROM ru WHERE rule_type = 'SAME_KEY_VALUE_PAIR'
      UNION ALL SELECT unnest([key_lo, key_hi]) FROM ru WHERE rule_type = 'SAME_VALUE'),
    c AS (SELECT attr, count(*) AS n FROM k GROUP BY attr)
    SELECT attr, 1 - n / (SELECT max(n) FROM c)::DOUBLE AS weight FROM c""",
)
def attribute_weights(spark, folder):
    return act.attribute_weights(_activities(spark, folder)[1])


PROXIMITY = """sp AS (SELECT case_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM flow GROUP BY case_id),
  px AS (SELECT activity_id, avg(exp(-abs(epoch_us(ts_1) - epoch_us(ts_2)) / 1e6 / span)) AS proximity
    FROM ev JOIN sp USING (case_id) WHERE span > 0 AND ts_1 IS NOT NULL AND ts_2 IS NOT NULL GROUP BY 1)"""


@query(
    "temporal_proximity",
    f"WITH {IO}, {PROXIMITY} SELECT activity_id, round(proximity, 9) AS proximity FROM px",
)
def temporal_proximity(spark, folder):
    _, _, evidence = _activities(spark, folder)
    out = act.temporal_proximity(evidence, act.case_spans(order_flow(spark, folder)))
    return out.withColumn("proximity", F.round("proximity", 9))


def _scored(spark, folder):
    io, rules, evidence = _activities(spark, folder)
    flow = order_flow(spark, folder).withColumn("activity", F.concat("activity", F.lit("_0")))
    graph = cut_lineage(footprint.dfg(flow, order=FLOW_ORDER))
    distances = cut_lineage(footprint.hops(graph))
    layer = _layers(spark, folder)
    proximity = act.temporal_proximity(evidence, act.case_spans(flow))
    scores = act.score_activities(io, rules, graph, distances, footprint.footprint(graph), layer, proximity)
    return io, rules, evidence, scores, layer, graph


def _layers(spark, folder):
    flow = order_flow(spark, folder)
    docs = flow.select(F.col("activity").alias("cluster"), F.lit(False).alias("is_reference")).unionByName(
        table(spark, folder, "customer").select(F.lit("customer").alias("cluster"), F.lit(True).alias("is_reference"))
    )
    return objects.layers(docs, flow.agg(F.count_distinct("case_id").alias("n")).scalar())


SCORE = f"""{FLOW_STEPS}, {DFG}, {BOTH},
  nodes AS (SELECT a AS node FROM dfg UNION SELECT b FROM dfg), starts AS (SELECT node FROM nodes WHERE node NOT IN (SELECT b FROM dfg)),
  hop1 AS (SELECT DISTINCT b AS node FROM dfg WHERE a IN (SELECT node FROM starts)),
  ho AS (SELECT node, CASE WHEN node IN (SELECT node FROM starts) THEN 0 WHEN node IN (SELECT node FROM hop1) THEN 1 ELSE 0 END AS hops FROM nodes),
  {PROXIMITY},
  pos AS (SELECT activity_id, sum(CASE WHEN hops < (SELECT avg(hops) FROM ho) THEN 1.5 ELSE 0.5 END) AS position,
      sum(CASE WHEN direction = 'output' THEN 2.0 / coalesce(hops + 1, 1) ELSE 0 END) AS refpart, count(*) * 0.5 AS vpart,
      bool_or(direction = 'input' AND cluster = 'customer') AS ref FROM io LEFT JOIN ho ON ho.node = io.cluster GROUP BY 1),
  pr AS (SELECT i.activity_id, i.cluster AS a, o.cluster AS b FROM io i JOIN io o ON i.activity_id = o.activity_id AND i.direction = 'input' AND o.direction = 'output'),
  sq AS (SELECT activity_id, sum(n) * 1.5 AS sq FROM pr JOIN dfg USING (a, b) GROUP BY 1),
  pl AS (SELECT activity_id, count(*) * 18.0 AS pl FROM pr JOIN bothways USING (a, b) WHERE n_back > 0 GROUP BY 1),
  ak AS (SELECT key_lo AS attr FROM ru WHERE rule_type = 'SAME_KEY_VALUE_PAIR' UNION ALL SELECT unnest([key_lo, key_hi]) FROM ru WHERE rule_type = 'SAME_VALUE'),
  ac AS (SELECT attr, count(*) AS n FROM ak GROUP BY attr), aw AS (SELECT attr, 1 - n / (SELECT max(n) FROM ac)::DOUBLE AS weight FROM ac),
  ap AS (SELECT activity_id, avg(coalesce(weight, 1.0)) * 1.2 AS ap FROM (SELECT activity_id, unnest([key_lo, key_hi]) AS attr FROM ru) LEFT JOIN aw USING (attr) GROUP BY 1),
  sc AS (SELECT activity_id, position + CASE WHEN ref THEN refpart * 2.0 ELSE 0 END + coalesce(sq, 0) - coalesce(pl, 0) + coalesce(ap, 0)
      + coalesce(proximity, 0) * 2.0 + vpart AS score FROM pos LEFT JOIN sq USING (activity_id) LEFT JOIN pl USING (activity_id)
      LEFT JOIN ap USING (activity_id) LEFT JOIN px USING (activity_id))"""


@query("activity_scores", f"WITH {IO}, {SCORE} SELECT activity_id, round(score, 6) AS base_score, round(score, 6) AS score FROM sc")
def activity_scores(spark, folder):
    scores = _scored(spark, folder)[3]
    return scores.select("activity_id", *[F.round(c, 6).alias(c) for c in ("base_score", "score")])


COVER = """ranked AS (SELECT * FROM sc WHERE score >= 2.0),
  it AS (SELECT io.*, score, row_number() OVER (PARTITION BY direction, cluster ORDER BY score DESC, activity_id) = 1 AS first,
    cluster = 'customer' AS ref FROM io JOIN ranked USING (activity_id)),
  pa AS (SELECT activity_id, score, bool_or(first) AS nw, bool_and(first OR NOT ref) AS rn FROM it GROUP BY 1, 2),
  kept AS (SELECT activity_id, score, 'new objects' AS reason FROM pa WHERE nw AND rn),
  fresh AS (SELECT DISTINCT ru.activity_id, ru.key_lo, ru.key_hi, pa.score FROM ru JOIN pa USING (activity_id)
    WHERE activity_id NOT IN (SELECT activity_id FROM kept) AND (key_lo, key_hi) NOT IN (SELECT (r.key_lo, r.key_hi) FROM ru r JOIN kept USING (activity_id))),
  second AS (SELECT DISTINCT activity_id, score, 'new attributes' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY key_lo, key_hi ORDER BY score DESC, activity_id) AS rk FROM fresh) WHERE rk = 1)"""


@query(
    "activity_selection",
    f"WITH {IO}, {SCORE}, {COVER} SELECT activity_id, round(score, 6) AS score, reason FROM (SELECT * FROM kept UNION ALL SELECT * FROM second)",
)
def activity_selection(spark, folder):
    io, rules, _, scores, layer, _ = _scored(spark, folder)
    out = act.select_cover(io, rules, scores, layer)
    return out.withColumn("score", F.round("score", 6))


def _line_activities(spark, folder):
    """Ranked activities over real keys: every part is an activity that brings its suppliers, as attributes, to the return
    flags of its lines."""
    part = F.concat(F.lit("part_"), F.col("l_partkey").cast("string"))
    seen = table(spark, folder, "lineitem").groupBy(part.alias("activity_id"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("key")).agg(F.sum("l_quantity").alias("n"))
    seen = cut_lineage(seen)
    scores = seen.groupBy("activity_id").agg((F.sum("n").cast("double") + 10).alias("score"))
    io = seen.select("activity_id", F.lit("output").alias("direction"), F.concat(F.lit("flag_"), "flag").alias("cluster"), F.lit(0).alias("variant")).distinct()
    source = seen.select("activity_id", F.lit("input").alias("direction"), F.lit("part").alias("cluster"), F.lit(0).alias("variant")).distinct()
    name = F.concat(F.lit("k"), F.col("key").cast("string"))
    brought = seen.where(F.col("key") % 7 != F.length("activity_id") % 7).select("activity_id", "key")
    # Dealt by activity once, to tell its keys apart and to join.
    brought = brought.repartition("activity_id").distinct()
    rules = brought.select("activity_id", F.lit("SAME_VALUE").alias("rule_type"), name.alias("key_lo"), F.lit("z").alias("key_hi"))
    return io.unionByName(source), rules, scores


LINE_COVER = """la AS MATERIALIZED (SELECT 'part_' || l_partkey AS activity_id, l_returnflag AS flag, l_suppkey AS key, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2, 3),
  ls AS MATERIALIZED (SELECT activity_id, sum(n)::DOUBLE + 10 AS score FROM la GROUP BY 1),
  li AS (SELECT DISTINCT activity_id, 'output' AS direction, 'flag_' || flag AS cluster FROM la UNION SELECT DISTINCT activity_id, 'input', 'part' FROM la),
  lr AS (SELECT DISTINCT activity_id, 'k' || key AS k FROM la WHERE key % 7 <> length(activity_id) % 7),
  lk AS MATERIALIZED (SELECT DISTINCT activity_id FROM (SELECT activity_id, row_number() OVER (PARTITION BY direction, cluster ORDER BY score DESC, activity_id) AS r FROM li JOIN ls USING (activity_id)) WHERE r = 1),
  lo AS MATERIALIZED (SELECT activity_id, k, cluster FROM lr JOIN li USING (activity_id) WHERE direction = 'output')"""


@query(
    "activity_cover_by_object",
    f"""WITH {LINE_COVER}, cv AS (SELECT DISTINCT k, cluster FROM lo WHERE activity_id IN (SELECT activity_id FROM lk)),
    nw AS (SELECT activity_id, row_number() OVER (PARTITION BY cluster, k ORDER BY score DESC, activity_id) AS r FROM lo JOIN ls USING (activity_id)
      WHERE activity_id NOT IN (SELECT activity_id FROM lk) AND (k, cluster) NOT IN (SELECT (k, cluster) FROM cv))
    SELECT activity_id, score, 'new objects' AS reason FROM ls WHERE activity_id IN (SELECT activity_id FROM lk)
    UNION ALL SELECT DISTINCT activity_id, score, 'new attributes' FROM ls JOIN nw USING (activity_id) WHERE r = 1""",
)
def activity_cover_by_object(spark, folder):
    """Activities by what they bring to every output object instead of to all together."""
    io, rules, scores = _line_activities(spark, folder)
    return act.select_cover(io, rules, scores, each_attribute_by_object=True)


@query(
    "activity_rule_pruning",
    f"""WITH {IO}, {SCORE}, kk AS (SELECT DISTINCT ru.activity_id, rule_type, key_lo, key_hi, k, cluster, score FROM ru,
        LATERAL (SELECT unnest([key_lo, key_hi]) AS k), io, sc WHERE io.activity_id = ru.activity_id AND sc.activity_id = ru.activity_id),
    win AS (SELECT *, first(activity_id) OVER (PARTITION BY cluster, k ORDER BY score DESC, activity_id) = activity_id AS won FROM kk)
    SELECT activity_id, rule_type, key_lo, key_hi, bool_or(won) AS kept FROM win GROUP BY 1, 2, 3, 4""",
)
def activity_rule_pruning(spark, folder):
    io, rules, _, scores, _, _ = _scored(spark, folder)
    return act.prune_rules(io, rules, scores)


def _steps_io(spark, folder):
    """Consecutive steps of users as activities: io, rules and evidence for the merge operators."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("activity"), "ts", "event_id"
    )
    steps = eventlog.follows(events, carry={"event_id": "next_id", "ts": "next_ts"}).where(F.col("next_activity").isNotNull())
    named = steps.withColumn("activity_id", F.concat_ws(">", "activity", "next_activity"))
    evidence = named.select(
        "activity_id", "case_id", F.col("event_id").alias("doc_1"), F.col("next_id").alias("doc_2"),
        F.col("ts").alias("ts_1"), F.col("next_ts").alias("ts_2"),
    )
    kinds = cut_lineage(named.select("activity_id", "activity", "next_activity").distinct())
    io = kinds.select("activity_id", F.lit("input").alias("direction"), F.col("activity").alias("cluster")).unionByName(
        kinds.select("activity_id", F.lit("output").alias("direction"), F.col("next_activity").alias("cluster"))
    )
    return io.withColumn("variant", F.lit(0)), evidence


STEPS_IO = f"""{USER_LOG}, st AS (SELECT case_id, activity AS a, event_id AS d1, lead(activity) OVER w AS b, lead(event_id) OVER w AS d2
    FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)),
  acts AS (SELECT DISTINCT a || '>' || b AS activity_id, a, b FROM st WHERE b IS NOT NULL),
  evi AS (SELECT a || '>' || b AS activity_id, case_id, d1, d2 FROM st WHERE b IS NOT NULL)"""


@query(
    "merge_identical",
    f"""WITH {STEPS_IO} SELECT activity_id, least(activity_id, activity_id) AS merged_id FROM acts""",
)
def merge_identical(spark, folder):
    return act.merge_identical(_steps_io(spark, folder)[0])


def _groups_io(spark, folder):
    """Every step of users as four activities with equal sides, by groups of users: the last digits 0-7, 0-8, 8-9, and
    8-9 without those ending in 08."""
    _, evidence = _steps_io(spark, folder)
    digit, ending = F.col("case_id") % 10, F.col("case_id") % 100
    copies = F.filter(
        F.array(
            F.when(digit <= 7, F.lit("a")), F.when(digit <= 8, F.lit("b")),
            F.when(digit >= 8, F.lit("c")), F.when((digit >= 8) & (ending != 8), F.lit("d")),
        ),
        lambda c: c.isNotNull(),
    )
    step = F.split("activity_id", ">")
    rows = evidence.withColumn("copy", F.explode(copies)).select(
        F.concat_ws("#", "activity_id", "copy").alias("activity_id"), "case_id",
        step[0].alias("cluster_1"), step[1].alias("cluster_2"), "doc_1", "doc_2",
    )
    rows = cut_lineage(rows)
    kinds = rows.select("activity_id", "cluster_1", "cluster_2").distinct()
    sides = [kinds.select("activity_id", F.lit(d).alias("direction"), F.col(c).alias("cluster"), F.lit(0).alias("variant")) for d, c in (("input", "cluster_1"), ("output", "cluster_2"))]
    docs = [rows.select("activity_id", "case_id", F.col(f"cluster_{n}").alias("cluster"), F.lit(0).alias("variant"), F.col(f"doc_{n}").alias("doc")) for n in (1, 2)]
    return cut_lineage(sides[0].unionByName(sides[1])), rows, docs[0].unionByName(docs[1])


GROUPS_IO = f"""{STEPS_IO}, gr AS MATERIALIZED (SELECT a || '>' || b || '#' || g AS activity_id, a, b, d1, d2, case_id FROM st,
    LATERAL (SELECT unnest(list_filter([CASE WHEN case_id % 10 <= 7 THEN 'a' END, CASE WHEN case_id % 10 <= 8 THEN 'b' END,
      CASE WHEN case_id % 10 >= 8 THEN 'c' END, CASE WHEN case_id % 10 >= 8 AND case_id % 100 <> 8 THEN 'd' END], lambda x: x IS NOT NULL)) AS g) WHERE b IS NOT NULL),
  gk AS (SELECT DISTINCT activity_id, a, b FROM gr)"""


@query(
    "merge_identical_documents",
    f"""WITH RECURSIVE {GROUPS_IO}, ud AS MATERIALIZED (SELECT DISTINCT activity_id, a, b, 'input' AS side, d1 AS doc FROM gr UNION SELECT activity_id, a, b, 'output', d2 FROM gr
      UNION SELECT activity_id, a, b, 'input', d2 FROM gr WHERE a = b UNION SELECT activity_id, a, b, 'output', d1 FROM gr WHERE a = b),
    us AS (SELECT activity_id, side, count(*) AS n FROM ud GROUP BY 1, 2),
    bo AS (SELECT x.activity_id AS i1, y.activity_id AS i2, side, count(*) AS k FROM ud x JOIN ud y USING (a, b, side, doc) WHERE x.activity_id <> y.activity_id GROUP BY 1, 2, 3),
    jc AS (SELECT i1, i2, min(k / (p.n + q.n - k)::DOUBLE) AS lo, count(*) AS sides FROM bo JOIN us p ON p.activity_id = i1 AND p.side = bo.side
      JOIN us q ON q.activity_id = i2 AND q.side = bo.side GROUP BY 1, 2),
    e AS (SELECT i1, i2 FROM jc WHERE sides = 2 AND lo > 0.7),
    walk(node, root) AS (SELECT activity_id, activity_id FROM gk UNION SELECT e.i2, walk.root FROM walk JOIN e ON e.i1 = walk.node)
    SELECT node AS activity_id, min(root) AS merged_id FROM walk GROUP BY node""",
)
def merge_identical_documents(spark, folder):
    """Equal sides, different documents: the group of every step falls in two."""
    io, _, documents = _groups_io(spark, folder)
    return act.merge_identical(io, cut_lineage(act.document_uses(documents, io)))


@query(
    "merge_related",
    f"""WITH {STEPS_IO}, {STEPS}, {DFG}, near AS (SELECT a, b FROM dfg UNION SELECT b, a FROM dfg),
    pr AS (SELECT x.activity_id AS id_1, y.activity_id AS id_2, x.a AS a1, y.a AS a2, x.b AS b1, y.b AS b2 FROM acts x JOIN acts y ON x.activity_id < y.activity_id),
    ln AS (SELECT activity_id, a AS n, b AS p FROM acts UNION SELECT activity_id, b, a FROM acts),
    vo AS (SELECT id_1, id_2, 'related outputs' AS why, b1 AS u, b2 AS v, 1 AS least FROM pr WHERE a1 = a2 UNION ALL SELECT id_1, id_2, 'related inputs', a1, a2, 0 FROM pr WHERE b1 = b2),
    vt AS (SELECT vo.*, EXISTS (SELECT 1 FROM ln k JOIN ln m ON k.p = m.p WHERE k.activity_id = id_1 AND m.activity_id = id_2 AND k.n = u AND m.n = v) AS met,
      EXISTS (SELECT 1 FROM near WHERE near.a = u AND near.b = v) AS ok FROM vo),
    sm AS (SELECT id_1, id_2, why, least, sum(CASE WHEN NOT met THEN 0 WHEN ok THEN 1 ELSE -1 END)::BIGINT AS votes FROM vt GROUP BY 1, 2, 3, 4)
    SELECT id_1, id_2, why, votes FROM sm WHERE votes >= least""",
)
def merge_related(spark, folder):
    """Steps of users that may be one because what they lead to, or come from, follows each other."""
    io, evidence = _steps_io(spark, folder)
    step = F.split("activity_id", ">")
    sides = evidence.select("activity_id", *[x for n in (1, 2) for x in (step[n - 1].alias(f"cluster_{n}"), F.lit(0).alias(f"variant_{n}"))])
    return act.related_candidates(io, cut_lineage(act.object_links(sides)), cut_lineage(_named_footprint(spark, folder)))


def _partial(spark, folder):
    """Three activities over users: clicks of those ending in 00-89, views of 05-99, purchases of 00-87."""
    events = table(spark, folder, "events")
    ending = F.col("user_id") % 100
    kind = (
        F.when((F.col("event_type") == "click") & (ending < 90), "click")
        .when((F.col("event_type") == "view") & (ending >= 5), "view")
        .when((F.col("event_type") == "purchase") & (ending < 88), "purchase")
    )
    rows = events.select(kind.alias("activity_id"), F.col("user_id").alias("case_id"), F.col("event_id").alias("doc"))
    # All events of a user also use the user's group as a document.
    shared = rows.select("activity_id", "case_id", (-1 - F.col("case_id") % 10).alias("doc"))
    evidence = cut_lineage(rows.unionByName(shared).where(F.col("activity_id").isNotNull()).distinct())
    ids = ["click", "purchase", "view"]
    pairs = spark.createDataFrame([(x, y, "planted") for x in ids for y in ids if x < y], "id_1 string, id_2 string, why string")
    # Each of them turns a document of its own kind into a receipt.
    io = spark.createDataFrame([(x, d, c, 0) for x in ids for d, c in (("input", x), ("output", "receipt"))], "activity_id string, direction string, cluster string, variant int")
    valid = cut_lineage(act.validate_merges(pairs, io, evidence))
    return evidence, valid, cut_lineage(act.merge_groups(io, valid))


PARTIAL = """pe AS MATERIALIZED (SELECT DISTINCT k AS activity_id, user_id AS case_id, doc FROM (SELECT user_id, unnest([event_id, -1 - user_id % 10]) AS doc,
      CASE WHEN event_type = 'click' AND user_id % 100 < 90 THEN 'click' WHEN event_type = 'view' AND user_id % 100 >= 5 THEN 'view'
        WHEN event_type = 'purchase' AND user_id % 100 < 88 THEN 'purchase' END AS k FROM events) WHERE k IS NOT NULL),
  pc AS MATERIALIZED (SELECT DISTINCT activity_id, case_id FROM pe), pn AS (SELECT activity_id, count(*) AS n FROM pc GROUP BY 1),
  po AS (SELECT x.activity_id AS i1, y.activity_id AS i2, count(*) AS k FROM pc x JOIN pc y USING (case_id) WHERE x.activity_id <> y.activity_id GROUP BY 1, 2),
  pv AS MATERIALIZED (SELECT i1, i2, k / (p.n + q.n - k)::DOUBLE AS o FROM po JOIN pn p ON p.activity_id = i1 JOIN pn q ON q.activity_id = i2 WHERE k / (p.n + q.n - k)::DOUBLE >= 0.8),
  pr AS MATERIALIZED (SELECT activity_id, case_id FROM pc WHERE activity_id IN (SELECT i1 FROM pv WHERE o < 0.9)
    AND NOT EXISTS (SELECT 1 FROM pv JOIN pc q ON q.activity_id = i2 WHERE i1 = pc.activity_id AND q.case_id = pc.case_id))"""


@query("merge_partial", f"WITH {PARTIAL} SELECT activity_id, case_id FROM pr")
def merge_partial(spark, folder):
    """Cases that activities keep for themselves where they merge in part."""
    evidence, valid, _ = _partial(spark, folder)
    return act.merge_parts(valid, evidence)


@query(
    "merge_partial_documents",
    f"""WITH RECURSIVE {PARTIAL}, walk(node, root) AS (SELECT activity_id, activity_id FROM pn UNION SELECT i2, walk.root FROM walk JOIN pv ON pv.i1 = walk.node),
    g AS (SELECT node AS activity_id, min(root) AS merged_id FROM walk GROUP BY node),
    m AS MATERIALIZED (SELECT merged_id, activity_id, case_id, doc, (activity_id, case_id) IN (SELECT (activity_id, case_id) FROM pr) AS rest FROM pe JOIN g USING (activity_id)),
    l AS (SELECT DISTINCT merged_id AS activity_id, doc FROM m WHERE NOT rest),
    r AS (SELECT DISTINCT activity_id || '#rest' AS activity_id, doc FROM m WHERE rest AND NOT EXISTS (SELECT 1 FROM l WHERE l.activity_id = m.merged_id AND l.doc = m.doc))
    SELECT activity_id, count(*) AS n_docs, min(doc) AS least_doc FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY 1""",
)
def merge_partial_documents(spark, folder):
    """Documents of the merged part and of the rests."""
    evidence, valid, groups = _partial(spark, folder)
    docs = act.part_documents(cut_lineage(act.merge_parts(valid, evidence)), groups, evidence)
    return docs.groupBy("activity_id").agg(F.count("*").alias("n_docs"), F.min("doc").alias("least_doc"))


CANDIDATES = f"""{STEPS}, {DFG}, {BOTH}, par AS (SELECT a || '_0' AS a, b || '_0' AS b FROM bothways WHERE n_back > 0),
  cand AS (SELECT x.activity_id AS id_1, y.activity_id AS id_2, 'parallel outputs' AS why FROM acts x JOIN acts y ON x.a = y.a AND x.b <> y.b
      AND x.activity_id < y.activity_id WHERE EXISTS (SELECT 1 FROM par WHERE par.a = x.b || '_0' AND par.b = y.b || '_0')
    UNION ALL SELECT x.activity_id, y.activity_id, 'parallel inputs' FROM acts x JOIN acts y ON x.b = y.b AND x.a <> y.a
      AND x.activity_id < y.activity_id WHERE EXISTS (SELECT 1 FROM par WHERE par.a = x.a || '_0' AND par.b = y.a || '_0'))"""


def _named_log(spark, folder):
    return user_log(spark, folder).withColumn("activity", F.concat("activity", F.lit("_0")))


def _named_footprint(spark, folder):
    return footprint.footprint(footprint.dfg(_named_log(spark, folder)))


@query("merge_candidates", f"WITH {STEPS_IO}, {CANDIDATES} SELECT * FROM cand")
def merge_candidates(spark, folder):
    return act.merge_candidates(_steps_io(spark, folder)[0], cut_lineage(_named_footprint(spark, folder)))


VALID = """cs AS (SELECT DISTINCT activity_id, case_id FROM evi), sz AS (SELECT activity_id, count(*) AS n FROM cs GROUP BY 1),
  ov AS (SELECT x.activity_id AS id_1, y.activity_id AS id_2, count(*) AS n FROM cs x JOIN cs y ON x.case_id = y.case_id AND x.activity_id < y.activity_id GROUP BY 1, 2),
  sp AS (SELECT case_id, activity, min(ts) AS lo, max(ts) AS hi FROM log GROUP BY 1, 2),
  contra AS (SELECT DISTINCT activity_id FROM acts JOIN sp x ON x.activity = a JOIN sp y ON y.case_id = x.case_id AND y.activity = b WHERE x.lo > y.hi),
  valid AS (SELECT c.id_1, c.id_2, c.why, ov.n / (s1.n + s2.n - ov.n)::DOUBLE AS overlap FROM cand c JOIN ov USING (id_1, id_2) JOIN sz s1 ON s1.activity_id = c.id_1
    JOIN sz s2 ON s2.activity_id = c.id_2 JOIN acts a1 ON a1.activity_id = c.id_1 JOIN acts a2 ON a2.activity_id = c.id_2
    WHERE ov.n / (s1.n + s2.n - ov.n)::DOUBLE >= 0.8 AND a1.a <> a2.b AND a2.a <> a1.b
      AND c.id_1 NOT IN (SELECT activity_id FROM contra) AND c.id_2 NOT IN (SELECT activity_id FROM contra))"""


@query(
    "merge_validation",
    f"WITH {STEPS_IO}, {CANDIDATES}, {VALID} SELECT id_1, id_2, why, round(overlap, 9) AS overlap FROM valid",
)
def merge_validation(spark, folder):
    io, evidence = _steps_io(spark, folder)
    found = act.merge_candidates(io, cut_lineage(_named_footprint(spark, folder)))
    return act.validate_merges(found, io, evidence, _named_log(spark, folder)).withColumn("overlap", F.round("overlap", 9))


@query(
    "merge_groups",
    f"""WITH RECURSIVE {STEPS_IO}, {CANDIDATES}, {VALID}, e AS (SELECT id_1 AS a, id_2 AS b FROM valid UNION SELECT id_2, id_1 FROM valid),
    walk(node, root) AS (SELECT activity_id, activity_id FROM acts UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.node)
    SELECT node AS activity_id, min(root) AS merged_id FROM walk GROUP BY node""",
)
def merge_groups(spark, folder):
    io, evidence = _steps_io(spark, folder)
    found = act.merge_candidates(io, cut_lineage(_named_footprint(spark, folder)))
    return act.merge_groups(io, act.validate_merges(found, io, evidence, _named_log(spark, folder)))


DOCS = """dd AS (SELECT DISTINCT activity_id, unnest([d1, d2]) AS doc FROM evi), ds AS (SELECT activity_id, count(*) AS n FROM dd GROUP BY 1),
  dov AS (SELECT x.activity_id AS activity_id_1, y.activity_id AS activity_id_2, count(*) AS n_both FROM dd x JOIN dd y ON x.doc = y.doc
    AND x.activity_id < y.activity_id GROUP BY 1, 2)"""


@query(
    "activity_document_overlap",
    f"""WITH {STEPS_IO}, {DOCS} SELECT activity_id_1, activity_id_2, a.n AS n_1, b.n AS n_2, n_both,
      round(n_both / (a.n + b.n - n_both)::DOUBLE, 9) AS jaccard FROM dov JOIN ds a ON a.activity_id = activity_id_1 JOIN ds b ON b.activity_id = activity_id_2""",
)
def activity_document_overlap(spark, folder):
    _, evidence = _steps_io(spark, folder)
    return act.used_same_documents(evidence).withColumn("jaccard", F.round("jaccard", 9))


@query(
    "activity_clean_up",
    f"""WITH {IO}, d AS (SELECT DISTINCT activity_id, case_id, c FROM (SELECT i.cluster_1 || '|0|' || i.cluster_2 || '|0' AS activity_id, i.case_id,
        unnest([i.cluster_1, i.cluster_2]) AS c FROM inst i JOIN ru ON ru.activity_id = i.cluster_1 || '|0|' || i.cluster_2 || '|0'
        AND ru.rule_type = i.rule_type AND ru.key_lo = i.key_lo AND ru.key_hi = i.key_hi)),
    n AS (SELECT activity_id, count(*) AS n FROM d GROUP BY 1),
    o AS (SELECT x.activity_id AS i1, y.activity_id AS i2, count(*) AS k FROM d x JOIN d y ON x.case_id = y.case_id AND x.c = y.c AND x.activity_id < y.activity_id GROUP BY 1, 2),
    cl2 AS (SELECT CASE WHEN a.n < b.n THEN i1 ELSE i2 END AS loser, CASE WHEN a.n < b.n THEN i2 ELSE i1 END AS winner FROM o
      JOIN n a ON a.activity_id = i1 JOIN n b ON b.activity_id = i2 WHERE k / (a.n + b.n - k)::DOUBLE > 0.8),
    gone AS (SELECT DISTINCT io.* FROM cl2 JOIN io ON io.activity_id = loser JOIN io w ON w.activity_id = winner AND w.direction = io.direction AND w.cluster = io.cluster),
    m AS (SELECT io.*, g.activity_id IS NOT NULL AS gone FROM io LEFT JOIN gone g USING (activity_id, direction, cluster)),
    s AS (SELECT *, bool_or(NOT gone) OVER (PARTITION BY activity_id, direction) AS side FROM m)
    SELECT activity_id, direction, cluster FROM s WHERE NOT gone OR NOT side""",
)
def activity_clean_up(spark, folder):
    io, _, evidence = _activities(spark, folder)
    named = [F.concat_ws(":", "case_id", d).alias(d) for d in ("doc_1", "doc_2")]
    docs = evidence.select("activity_id", *named)
    return act.clean_up(io, docs).select("activity_id", "direction", "cluster")


@query(
    "compatible_rules",
    f"""WITH {IO}, k AS (SELECT DISTINCT activity_id, rule_type, key_lo, key_hi, key FROM ru, LATERAL (SELECT unnest([key_lo, key_hi]) AS key))
    SELECT DISTINCT x.activity_id AS id_1, y.activity_id AS id_2, x.key FROM k x JOIN k y ON x.key = y.key AND x.activity_id < y.activity_id
    WHERE (x.rule_type, x.key_lo, x.key_hi) <> (y.rule_type, y.key_lo, y.key_hi)""",
)
def compatible_rules(spark, folder):
    return act.compatible_rules(_activities(spark, folder)[1])


@query(
    "time_activities",
    """WITH l AS (SELECT l_orderkey, 'ship_' || l_returnflag AS a, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS n,
      lead('ship_' || l_returnflag) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_returnflag)),
    r AS (SELECT DISTINCT a, b FROM l WHERE b IS NOT NULL),
    par AS (SELECT x.a AS p, x.b AS q FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b),
    heads AS (SELECT DISTINCT a FROM l WHERE k = 1), tails AS (SELECT DISTINCT a FROM l WHERE k = n),
    splits AS (SELECT p, q FROM par WHERE p IN (FROM heads) AND q IN (FROM heads)),
    joins AS (SELECT p, q FROM par WHERE p IN (FROM tails) AND q IN (FROM tails))
    SELECT '((''placed''), (''' || p || ''', ''' || q || '''))' AS activity, 'split' AS kind, 'placed' AS inputs, p || ',' || q AS outputs FROM splits
    UNION ALL SELECT '((''' || p || ''', ''' || q || '''), (''closed''))', 'join', p || ',' || q, 'closed' FROM joins
    UNION ALL SELECT '((''' || a || '''), (''' || b || '''))', 'single', a, b FROM r WHERE NOT EXISTS (FROM par WHERE (p = a AND q = b) OR (p = b AND q = a))
    UNION ALL SELECT '((''placed''), (''' || a || '''))', 'single', 'placed', a FROM heads WHERE NOT EXISTS (FROM splits WHERE p = a OR q = a)
    UNION ALL SELECT '((''' || a || '''), (''closed''))', 'single', a, 'closed' FROM tails WHERE NOT EXISTS (FROM joins WHERE p = a OR q = a)""",
)
def time_activities(spark, folder):
    """Shipments of an order between its placing and its closing: the shipments run in parallel."""
    ships = order_flow(spark, folder).where(F.col("activity") != "order").withColumn("rank", F.lit(1))
    edge = ships.groupBy("case_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    placed = edge.select("case_id", F.lit("placed").alias("activity"), F.col("first").alias("ts"), F.lit(0).alias("rank"))
    closed = edge.select("case_id", F.lit("closed").alias("activity"), F.col("last").alias("ts"), F.lit(2).alias("rank"))
    flow = ships.unionByName(placed).unionByName(closed)
    pairs = cut_lineage(eventlog.time_relations(flow, order=("rank", "ts", "activity")))
    found, _ = act.time_activities(pairs, footprint.footprint(pairs.select("a", "b", "n")))
    return found.select("activity", "kind", F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs"))


@query(
    "plausibility",
    """WITH rel AS (SELECT DISTINCT 'order' AS obj1, 'ship_' || l_returnflag AS obj2 FROM lineitem UNION SELECT 'customer', 'order' FROM orders),
    f AS (SELECT 'order' AS obj, bool_or(o_orderdate IS NOT NULL) AS d, false AS r, sum(o_totalprice) > 0 AS p FROM orders
      UNION ALL SELECT 'ship_' || l_returnflag, bool_or(l_shipdate IS NOT NULL), false, sum(l_extendedprice) > 0 FROM lineitem GROUP BY 1
      UNION ALL SELECT 'customer', false, count(*) > 0, false FROM customer),
    s AS (SELECT obj, round(0.5 + 0.1 * (d::INT + r::INT + p::INT + (obj IN (SELECT obj1 FROM rel) AND obj IN (SELECT obj2 FROM rel))::INT), 1) AS p FROM f)
    SELECT obj1, obj2, a.p AS p1, b.p AS p2 FROM rel JOIN s a ON a.obj = obj1 JOIN s b ON b.obj = obj2""",
)
def plausibility(spark, folder):
    orders, lines, customer = (table(spark, folder, t) for t in ("orders", "lineitem", "customer"))
    ship = F.concat(F.lit("ship_"), "l_returnflag")
    rel = lines.select(F.lit("order").alias("obj1"), ship.alias("obj2")).union(
        orders.select(F.lit("customer"), F.lit("order"))
    ).distinct()
    rows = (
        orders.select(F.lit("order").alias("obj"), F.col("o_orderdate").isNotNull().alias("d"), F.lit(False).alias("r"), F.col("o_totalprice").alias("p"))
        .unionByName(lines.select(ship.alias("obj"), F.col("l_shipdate").isNotNull().alias("d"), F.lit(False).alias("r"), F.col("l_extendedprice").alias("p")))
        .unionByName(customer.select(F.lit("customer").alias("obj"), F.lit(False).alias("d"), F.lit(True).alias("r"), F.lit(0.0).alias("p")))
    )
    facts = rows.groupBy("obj").agg(
        F.bool_or("d").alias("has_date"), F.bool_or("r").alias("is_reference"), (F.sum("p") > 0).alias("has_price")
    )
    return act.plausibility(rel, facts)


# ---------------------------------------------------------------- covers


@query(
    "first_cover",
    """WITH r AS (SELECT l_suppkey, l_partkey, sum((l_extendedprice * 100)::BIGINT) AS rev FROM lineitem GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY rev DESC, l_suppkey) AS rk FROM r)
    SELECT l_suppkey, count(*) AS n_items FROM k WHERE rk = 1 GROUP BY 1""",
)
def first_cover(spark, folder):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    revenue = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(cents).alias("rev"))
    return act.first_cover(revenue, [F.desc("rev"), F.asc("l_suppkey")], ["l_partkey"], "l_suppkey")


@query(
    "minimal_relations",
    """WITH rel AS (SELECT DISTINCT p_brand AS obj1, p_type AS obj2, split_part(p_name, ' ', 1) AS attr1, split_part(p_name, ' ', 2) AS attr2 FROM part),
    e AS (SELECT obj1, obj2, count(*) * 2.0 AS edge_weight FROM rel GROUP BY 1, 2),
    s AS (SELECT rel.*, edge_weight, rank() OVER (PARTITION BY obj1, attr1 ORDER BY edge_weight DESC, obj1, obj2) AS r1,
      rank() OVER (PARTITION BY obj2, attr2 ORDER BY edge_weight DESC, obj1, obj2) AS r2 FROM rel JOIN e USING (obj1, obj2))
    SELECT obj1, obj2, attr1, attr2, edge_weight FROM s WHERE r1 = 1 OR r2 = 1""",
)
def minimal_relations(spark, folder):
    words = F.split("p_name", " ")
    rel = table(spark, folder, "part").select(
        F.col("p_brand").alias("obj1"), F.col("p_type").alias("obj2"), words[0].alias("attr1"), words[1].alias("attr2")
    ).distinct()
    return relations.minimal_relations(rel)


# ---------------------------------------------------------------- nets and decisions


def _net_io(spark, folder):
    """Steps between different event types as activities of a net."""
    graph = footprint.dfg(user_log(spark, folder)).where(F.col("a") != F.col("b"))
    name = eventlog.activity_name(F.array("a"), F.array("b"))
    both = graph.select(name.alias("activity"), "a", "b")
    return both.select("activity", F.lit("input").alias("direction"), F.col("a").alias("object")).unionByName(
        both.select("activity", F.lit("output").alias("direction"), F.col("b").alias("object"))
    )


ARCS = f"""{USER_LOG}, {STEPS}, {DFG}, nt AS (SELECT '((''' || a || '''), (''' || b || '''))' AS t, a, b FROM dfg WHERE a <> b),
  arcs AS (SELECT a AS source, t AS target, 'place_to_transition' AS kind FROM nt UNION ALL SELECT t, b, 'transition_to_place' FROM nt)"""


@query("net_arcs", f"WITH {ARCS} SELECT * FROM arcs")
def net_arcs(spark, folder):
    return nets.net(_net_io(spark, folder))[2]


@query(
    "net_labelled",
    f"""WITH {ARCS}, v AS (SELECT event_type AS place, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
    SELECT DISTINCT source AS place, lo || '..' || hi AS schema FROM arcs JOIN v ON v.place = source WHERE kind = 'place_to_transition'""",
)
def net_labelled(spark, folder):
    """Places labelled with what their documents hold."""
    span = table(spark, folder, "events").groupBy(F.col("event_type").alias("object")).agg(
        F.concat(F.min("value").cast("string"), F.lit(".."), F.max("value").cast("string")).alias("schema")
    )
    io = cut_lineage(_net_io(spark, folder))
    rules = io.select("activity", F.concat(F.lit("sequence of "), "object").alias("rule"))
    return nets.schema_net(io, span, rules)[0]


@query(
    "decision_points",
    f"WITH {ARCS} SELECT source AS place, count(DISTINCT target) AS n_paths FROM arcs WHERE kind = 'place_to_transition' GROUP BY 1 HAVING count(DISTINCT target) > 1",
)
def decision_points(spark, folder):
    return nets.decision_points(nets.net(_net_io(spark, folder))[2])


@query("place_labels", f"WITH {ARCS} SELECT DISTINCT a AS place, '(' || a || ')' AS label FROM nt")
def place_labels(spark, folder):
    return nets.place_labels(nets.net(_net_io(spark, folder))[2])


@query(
    "arc_usage",
    f"""WITH {ORDER_FLOW}, {FLOW_STEPS}, pc AS (SELECT case_id, a, b, count(*) AS n FROM steps WHERE b IS NOT NULL GROUP BY 1, 2, 3),
    al AS (SELECT a, b FROM pc GROUP BY a, b HAVING a <= b), bad AS (SELECT DISTINCT case_id FROM pc WHERE a > b),
    us AS (SELECT a, b, sum(n)::BIGINT AS n_used, count(*) AS n_cases FROM pc WHERE case_id NOT IN (SELECT case_id FROM bad) GROUP BY 1, 2)
    SELECT al.a, al.b, coalesce(n_used, 0) AS n_used, coalesce(n_cases, 0) AS n_cases FROM al LEFT JOIN us USING (a, b)""",
)
def arc_usage(spark, folder):
    flow = order_flow(spark, folder)
    allowed = cut_lineage(footprint.dfg(flow, order=FLOW_ORDER).where(F.col("a") <= F.col("b")).select("a", "b"))
    return nets.arc_usage(flow, allowed, order=FLOW_ORDER)


FLOWS = """ft AS (SELECT case_id, activity, min(ts) AS t FROM log GROUP BY 1, 2),
  fl AS (SELECT s.case_id, s.activity AS place, '((''' || s.activity || '''), (''' || g.activity || '''))' AS transition, g.activity AS target
    FROM ft s JOIN ft g ON s.case_id = g.case_id AND s.activity <> g.activity AND g.t > s.t)"""


def _flows(spark, folder):
    log = user_log(spark, folder)
    # Paths of the net: every step a -> b between different types that occurs.
    graph = footprint.dfg(log).where(F.col("a") != F.col("b"))
    paths = graph.select(
        F.col("a").alias("place"),
        eventlog.activity_name(F.array("a"), F.array("b")).alias("transition"),
        F.col("b").alias("target"),
    )
    return decisions.verified_flows(log, cut_lineage(paths))


@query("verified_flows", f"WITH {USER_LOG}, {FLOWS} SELECT case_id, place, transition FROM fl")
def verified_flows(spark, folder):
    return _flows(spark, folder)


@query(
    "flow_frequency",
    f"""WITH {USER_LOG}, {FLOWS}, c AS (SELECT place, transition, count(*) AS n FROM fl GROUP BY 1, 2)
    SELECT place, transition, n, round(n / sum(n) OVER (PARTITION BY place), 9) AS frequency FROM c""",
)
def flow_frequency(spark, folder):
    out = decisions.flow_frequency(_flows(spark, folder))
    return out.withColumn("frequency", F.round("frequency", 9))


@query(
    "number_features",
    """WITH x AS (SELECT l_orderkey AS case_id, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem),
    l AS (SELECT case_id, 'quantity' AS c, q AS v FROM x UNION ALL SELECT case_id, 'price', p FROM x UNION ALL SELECT case_id, 'price', d FROM x
      UNION ALL SELECT case_id, 'other', t FROM x)
    SELECT case_id, max(v) AS max_amount, min(v) AS min_amount, round(avg(v), 6) AS avg_amount, round(max(v) - min(v), 6) AS amount_range,
      max(v) FILTER (WHERE c = 'price') AS max_price, round(sum(v) FILTER (WHERE c = 'price'), 4) AS total_value,
      sum(v) FILTER (WHERE c = 'quantity') AS total_quantity, round(avg(v) FILTER (WHERE c = 'quantity'), 6) AS avg_quantity FROM l GROUP BY 1""",
)
def number_features(spark, folder):
    from docflow.operators.leaves import categorized_numbers

    leaf = row_leaves(german_lines(spark, folder), {"doc_id": "case_id"}, ["Menge", "Gesamtpreis", "Rabattbetrag", "Steuer"])
    out = decisions.number_features(categorized_numbers(leaf))
    return out.select(
        "case_id", "max_amount", "min_amount", F.round("avg_amount", 6).alias("avg_amount"),
        F.round("amount_range", 6).alias("amount_range"), "max_price", F.round("total_value", 4).alias("total_value"),
        "total_quantity", F.round("avg_quantity", 6).alias("avg_quantity"),
    )


@query(
    "time_features",
    """SELECT user_id AS case_id, hour(min(ts))::INT AS hour, (isodow(min(ts)) - 1)::INT AS day_of_week, (isodow(min(ts)) >= 6)::INT AS is_weekend,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS process_duration, (hour(min(ts)) < 12)::INT AS morning_start,
      (hour(min(ts)) >= 18)::INT AS evening_start, count(*) AS total_documents, count(DISTINCT event_type) AS unique_doc_types FROM events GROUP BY 1""",
)
def time_features(spark, folder):
    out = decisions.time_features(user_log(spark, folder))
    return out.withColumn("process_duration", F.round("process_duration", 6))


SEQ_PAIRS = [("order", "ship_A"), ("order", "ship_N"), ("order", "ship_R"), ("ship_A", "order")]


@query(
    "follow_flags",
    f"WITH {ORDER_FLOW}, {FLOW_STEPS} SELECT case_id, "
    + ", ".join(f"max(CASE WHEN a = '{a}' AND b = '{b}' THEN 1 ELSE 0 END) AS seq_{a}_to_{b}" for a, b in SEQ_PAIRS)
    + " FROM steps GROUP BY 1",
)
def follow_flags(spark, folder):
    return decisions.follow_flags(order_flow(spark, folder), SEQ_PAIRS, order=FLOW_ORDER)


@query(
    "activity_flags",
    f"""WITH {STEPS_IO} SELECT case_id, max((activity_id = 'click>purchase')::INT) AS "has_at_click>purchase",
      max((activity_id = 'view>click')::INT) AS "has_at_view>click" FROM evi GROUP BY 1""",
)
def activity_flags(spark, folder):
    _, evidence = _steps_io(spark, folder)
    return decisions.activity_flags(evidence, ["click>purchase", "view>click"])


@query(
    "feature_prep",
    """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d, avg(o_custkey) AS m2, stddev_samp(o_custkey) AS d2 FROM orders)
    SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS o_totalprice, round((o_custkey - m2) / d2, 6) AS o_custkey FROM orders, s""",
)
def feature_prep(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey", F.lit(1.0).alias("constant"))
    out = decisions.prepare_features(rows, ["o_totalprice", "o_custkey", "constant"])
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in out.columns if c != "o_orderkey"])


@query("tree_rules")
def tree_rules(spark, folder):
    """Decision tree for the quality label of text documents over simple text features."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    words = F.split("text", r"\s+")
    features = docs.select(
        "quality",
        "n_chars",
        F.size(words).alias("n_words"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
        F.size(F.split("text", "\n")).alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^0-9]", "")).alias("n_digits"),
    )
    columns = ["n_chars", "n_words", "n_distinct", "n_lines", "n_digits"]
    prepared = decisions.prepare_features(features, columns)
    kept = [c for c in columns if c in prepared.columns]
    return decisions.fit_rules(prepared, kept, "quality")[1]


@query(
    "decision_factors",
    """WITH p AS (SELECT DISTINCT o_orderkey AS case_id, o_orderpriority AS path FROM orders),
    a AS (SELECT l_orderkey AS case_id, unnest(['quantity', 'discount', 'line']) AS attribute, unnest([l_quantity, l_discount, l_linenumber::DOUBLE]) AS value FROM lineitem),
    s AS (SELECT path, count(DISTINCT case_id) AS c FROM p GROUP BY 1), t AS (SELECT count(DISTINCT case_id) AS n FROM p),
    d AS (SELECT path, attribute, count(DISTINCT value) / count(*)::DOUBLE AS dn FROM p JOIN a USING (case_id) GROUP BY 1, 2),
    f AS (SELECT attribute, max(c / n::DOUBLE * dn) AS factor FROM d JOIN s USING (path), t GROUP BY 1)
    SELECT attribute, round(factor / (SELECT max(factor) FROM f), 9) AS importance FROM f""",
)
def decision_factors(spark, folder):
    paths = table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("path"))
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("attribute"), F.col(c).cast("double").alias("value"))
            for n, c in (("quantity", "l_quantity"), ("discount", "l_discount"), ("line", "l_linenumber"))
        ]
    )
    attributes = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.inline(cells))
    out = decisions.decision_factors(paths, attributes)
    return out.withColumn("importance", F.round("importance", 9))


FLOW_PATTERN = {
    "order": {"followed_by": ("ship_A", "ship_R"), "follows": (), "max_days": 30, "required_fields": ()},
    "ship_N": {"followed_by": (), "follows": ("order",), "max_days": None, "required_fields": ()},
}


@query(
    "business_pattern",
    f"""WITH {ORDER_FLOW} SELECT case_id AS doc_id, 'order' AS activity, 'followed_by missing' AS "check" FROM flow f WHERE activity = 'order' AND NOT EXISTS
      (SELECT 1 FROM flow g WHERE g.case_id = f.case_id AND g.activity IN ('ship_A', 'ship_R') AND g.ts >= f.ts AND g.ts <= f.ts + INTERVAL 30 DAY)
    UNION ALL SELECT case_id, 'ship_N', 'follows missing' FROM flow f WHERE activity = 'ship_N' AND NOT EXISTS
      (SELECT 1 FROM flow g WHERE g.case_id = f.case_id AND g.activity = 'order' AND g.ts <= f.ts)""",
)
def business_pattern(spark, folder):
    flow = order_flow(spark, folder).withColumn("doc_id", F.col("case_id"))
    return decisions.missing_neighbours(flow, FLOW_PATTERN)


@query(
    "required_fields",
    """SELECT o_orderkey AS doc_id, 'Bestellung' AS doc_type, 'Bestellungsnummer' AS field FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, 'Bestellung', 'Kundennummer' FROM orders WHERE o_orderstatus = 'O'""",
)
def required_fields(spark, folder):
    """Orders whose finished ones lack the order number and open ones the customer number."""
    orders = table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    keys = F.array_compact(
        F.array(
            F.when(status != "F", F.lit("Bestellungsnummer")), F.when(status != "O", F.lit("Kundennummer")), F.lit("Datum")
        )
    )
    leaf = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("Bestellung").alias("doc_type"), F.explode(keys).alias("key"))
    return decisions.missing_fields(leaf)


# ---------------------------------------------------------------- curation


@query(
    "curate_reassign",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE o_orderpriority END AS cluster,
      CASE WHEN o_orderstatus = 'P' THEN true ELSE false END AS is_reference FROM orders""",
)
def curate_reassign(spark, folder):
    orders = table(spark, folder, "orders")
    labels = orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("cluster"), F.lit(False).alias("is_reference"))
    moved = orders.where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("doc_id"), F.lit("partial").alias("new_cluster"), F.lit(True).alias("new_reference")
    )
    return curate.reassign(labels, moved)


@query(
    "curate_reference_clusters",
    """SELECT o_orderkey AS doc_id, o_orderpriority AS cluster, o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1
      HAVING count(*) > (SELECT count(*) / 5.0 FROM orders)) AS is_reference FROM orders""",
)
def curate_reference_clusters(spark, folder):
    orders = table(spark, folder, "orders")
    labels = orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("cluster"), F.lit(False).alias("is_reference"))
    n = orders.agg((F.count("*") / 5.0).alias("n")).scalar()
    big = labels.groupBy("cluster").agg(F.count("*").alias("_n")).withColumn("_cut", n).where(F.col("_n") > F.col("_cut"))
    return curate.mark_reference_clusters(labels, big.select("cluster")).select("doc_id", "cluster", "is_reference")


@query(
    "curate_rename",
    "SELECT event_id, coalesce(upper(CASE WHEN event_type IN ('click', 'view') THEN event_type END), event_type) AS event_type FROM events",
)
def curate_rename(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    mapping = events.where(F.col("event_type").isin("click", "view")).select(
        F.col("event_type").alias("old_name"), F.upper("event_type").alias("new_name")
    ).distinct()
    return curate.rename(events, "event_type", mapping).select("event_id", "event_type")


@query(
    "curate_scores",
    f"WITH {STEPS_IO} SELECT activity_id, CASE WHEN a = b THEN 5.0 ELSE 0.0 END AS score FROM acts",
)
def curate_scores(spark, folder):
    io, _ = _steps_io(spark, folder)
    loops = io.groupBy("activity_id").agg(F.count_distinct("cluster").alias("n")).where(F.col("n") == 1)
    return curate.user_scores(io, loops)


@query(
    "case_view",
    f"""WITH {ORDER_FLOW} SELECT case_id, activity AS cluster, count(*) AS n_docs, activity || ':' || case_id AS first_doc,
      activity || ':' || case_id AS last_doc, 0 AS n_shared FROM flow GROUP BY 1, 2""",
)
def case_view(spark, folder):
    return curate.case_view(flow_documents(spark, folder))


@query(
    "relation_view",
    f"""WITH {INSTANCES}, {COUNTS}, {JUDGED} SELECT upper(cluster_1) AS type_1, upper(cluster_2) AS type_2, rule_type, key_lo, key_hi, n_cases,
      reason IS NULL AS accepted FROM judged""",
)
def relation_view(spark, folder):
    found = relations.relation_instances(case_leaf(spark, folder))
    judged = _judged(spark, folder, found)
    names = _types(spark, folder).select("cluster", F.upper("cluster").alias("doc_type"))
    return curate.relation_view(judged, names).select("type_1", "type_2", *relations.RULE, "n_cases", "accepted")


@query("type_view", "SELECT lang AS doc_type, count(*) AS n_docs, 'lang:string, source:string' AS attributes FROM documents GROUP BY 1")
def type_view(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("doc_type"), "lang", "source")
    leaf = row_leaves(docs, {"doc_id": "doc_id", "doc_type": "doc_type"}, ["lang", "source"]).withColumn("path", F.col("key"))
    types = docs.groupBy("doc_type").agg(F.count("*").alias("n_docs"))
    return curate.type_view(types, objects.attributes(leaf))


@query("cluster_view", "SELECT lang AS cluster, doc_id, '/in/' || doc_id || '.json' AS path FROM documents")
def cluster_view(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", "lang", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path")
    )
    return curate.cluster_view(docs, docs.select("doc_id", F.col("lang").alias("cluster")))


@query(
    "temporal_contradictions",
    f"""WITH {STEPS_IO}, sp AS (SELECT case_id, activity, min(ts) AS lo, max(ts) AS hi FROM log GROUP BY 1, 2)
    SELECT DISTINCT activity_id FROM acts JOIN sp x ON x.activity = a JOIN sp y ON y.case_id = x.case_id AND y.activity = b WHERE x.lo > y.hi""",
)
def temporal_contradictions(spark, folder):
    return act.temporal_contradictions(_steps_io(spark, folder)[0], _named_log(spark, folder))


@query(
    "activity_side_overlap",
    f"""WITH {STEPS_IO}, us AS (SELECT DISTINCT activity_id, d.direction, d.cluster, d.doc FROM (SELECT a || '>' || b AS activity_id,
        unnest([{{'direction': 'input', 'cluster': a, 'doc': case_id}}, {{'direction': 'output', 'cluster': b, 'doc': case_id}}]) AS d FROM st WHERE b IS NOT NULL)),
    sz AS (SELECT activity_id, direction, cluster, count(*) AS n FROM us GROUP BY 1, 2, 3),
    bo AS (SELECT x.activity_id AS i1, y.activity_id AS i2, direction, cluster, count(*) AS k FROM us x JOIN us y USING (direction, cluster, doc)
      WHERE x.activity_id < y.activity_id GROUP BY 1, 2, 3, 4)
    SELECT x.activity_id AS id_1, y.activity_id AS id_2, x.direction, round(avg(coalesce(k, 0) / (x.n + y.n - coalesce(k, 0))::DOUBLE), 9) AS overlap
    FROM sz x JOIN sz y ON x.direction = y.direction AND x.cluster = y.cluster AND x.activity_id < y.activity_id
    LEFT JOIN bo ON bo.i1 = x.activity_id AND bo.i2 = y.activity_id AND bo.direction = x.direction AND bo.cluster = x.cluster GROUP BY 1, 2, 3""",
)
def activity_side_overlap(spark, folder):
    """Overlap of the users behind the steps that start (or end) with the same event type."""
    io, evidence = _steps_io(spark, folder)
    cells = F.split("activity_id", ">")
    used = evidence.select(
        "activity_id", cells[0].alias("cluster_1"), F.col("case_id").alias("doc_1"),
        cells[1].alias("cluster_2"), F.col("case_id").alias("doc_2"),
    )
    # A step from a type to itself holds the type on both sides.
    return act.side_overlap(act.document_uses(used, io)).withColumn("overlap", F.round("overlap", 9))


@query(
    "case_features",
    f"""WITH {STEPS_IO}, t AS (SELECT case_id, hour(min(ts))::INT AS hour, count(*) AS total_documents, count(DISTINCT activity) AS unique_doc_types FROM log GROUP BY 1),
    f AS (SELECT case_id, max((a = 'click' AND b = 'purchase')::INT) AS seq_click_to_purchase FROM st GROUP BY 1),
    h AS (SELECT case_id, max((activity_id = 'view>click')::INT) AS has_step FROM evi GROUP BY 1)
    SELECT t.case_id, hour, total_documents, unique_doc_types, seq_click_to_purchase, has_step FROM t JOIN f USING (case_id) LEFT JOIN h USING (case_id)""",
)
def case_features(spark, folder):
    """Features of user cases: time, counts, follows-pairs and activities in one row."""
    log = user_log(spark, folder)
    _, evidence = _steps_io(spark, folder)
    parts = [
        decisions.time_features(log).select("case_id", "hour", "total_documents", "unique_doc_types"),
        decisions.follow_flags(log, [("click", "purchase")]),
        decisions.activity_flags(evidence, ["view>click"]).withColumnRenamed("has_at_view>click", "has_step"),
    ]
    return decisions.case_features(parts)


ORDER_STEPS = f"""{ORDER_FLOW}, {FLOW_STEPS}, evi AS (SELECT a || '>' || b AS activity_id, case_id FROM steps WHERE b IS NOT NULL)"""


def _order_steps(spark, folder):
    """Consecutive documents of orders as activities: activity_id, case_id, activity, next_activity."""
    steps = eventlog.follows(order_flow(spark, folder), order=FLOW_ORDER).where(F.col("next_activity").isNotNull())
    return steps.select(F.concat_ws(">", "activity", "next_activity").alias("activity_id"), "case_id", "activity", "next_activity")


NUMBERS = ("max_amount", "min_amount", "avg_amount", "amount_range", "max_price", "min_price", "avg_price", "total_value", "total_quantity", "max_quantity", "avg_quantity", "total_weight", "avg_weight")


@query(
    "case_vector",
    f"""WITH {ORDER_STEPS}, t AS (SELECT case_id, hour(min(ts))::INT AS hour, (isodow(min(ts)) - 1)::INT AS day_of_week, (isodow(min(ts)) >= 6)::INT AS is_weekend,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS process_duration, (hour(min(ts)) < 12)::INT AS morning_start,
      (hour(min(ts)) >= 18)::INT AS evening_start, count(*) AS total_documents, count(DISTINCT activity) AS unique_doc_types FROM flow GROUP BY 1),
    l AS (SELECT l_orderkey AS case_id, 'quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, 'price', l_extendedprice FROM lineitem
      UNION ALL SELECT l_orderkey, 'price', l_discount FROM lineitem UNION ALL SELECT l_orderkey, 'other', l_tax FROM lineitem
      UNION ALL SELECT l_orderkey, 'weight', l_quantity * 2 FROM lineitem),
    n AS (SELECT case_id, max(v) AS max_amount, min(v) AS min_amount, avg(v) AS avg_amount, max(v) - min(v) AS amount_range,
      max(v) FILTER (WHERE c = 'price') AS max_price, min(v) FILTER (WHERE c = 'price') AS min_price, avg(v) FILTER (WHERE c = 'price') AS avg_price,
      sum(v) FILTER (WHERE c = 'price') AS total_value, sum(v) FILTER (WHERE c = 'quantity') AS total_quantity,
      max(v) FILTER (WHERE c = 'quantity') AS max_quantity, avg(v) FILTER (WHERE c = 'quantity') AS avg_quantity,
      sum(v) FILTER (WHERE c = 'weight') AS total_weight, avg(v) FILTER (WHERE c = 'weight') AS avg_weight FROM l GROUP BY 1),
    f AS (SELECT case_id, max(coalesce((a = 'order' AND b = 'ship_A')::INT, 0)) AS seq_order_to_ship_A,
      max(coalesce((a = 'ship_N' AND b = 'ship_R')::INT, 0)) AS seq_ship_N_to_ship_R FROM steps GROUP BY 1),
    h AS (SELECT case_id, max((activity_id = 'order>ship_N')::INT) AS has_order_n, max((activity_id = 'ship_R>ship_R')::INT) AS has_r_r FROM evi GROUP BY 1)
    SELECT t.*, {', '.join(f'round({c}, 4) AS {c}' for c in NUMBERS)}, seq_order_to_ship_A, seq_ship_N_to_ship_R, has_order_n, has_r_r
    FROM t LEFT JOIN n USING (case_id) LEFT JOIN f USING (case_id) LEFT JOIN h USING (case_id)""",
)
def case_vector(spark, folder):
    """The whole feature vector of order cases: all time and number features, follows-pairs and activities."""
    from docflow.operators.leaves import categorized_numbers

    flow = order_flow(spark, folder)
    lines = german_lines(spark, folder).withColumn("Gewicht", F.col("Menge") * 2)
    leaf = row_leaves(lines, {"doc_id": "case_id"}, ["Menge", "Gesamtpreis", "Rabattbetrag", "Steuer", "Gewicht"])
    flags = decisions.activity_flags(_order_steps(spark, folder), ["order>ship_N", "ship_R>ship_R"])
    out = decisions.case_features(
        [
            decisions.time_features(flow),
            decisions.number_features(categorized_numbers(leaf)),
            decisions.follow_flags(flow, [("order", "ship_A"), ("ship_N", "ship_R")], order=FLOW_ORDER),
            flags.toDF("case_id", "has_order_n", "has_r_r"),
        ]
    )
    return out.withColumns({c: F.round(c, 4) for c in NUMBERS} | {"process_duration": F.round("process_duration", 6)})


@query(
    "contradicted_steps",
    f"""WITH {ORDER_STEPS}, sp AS (SELECT case_id, activity, min(ts) AS lo, max(ts) AS hi FROM flow GROUP BY 1, 2),
    acts AS (SELECT DISTINCT a, b FROM steps WHERE b IS NOT NULL)
    SELECT DISTINCT a || '>' || b AS activity_id FROM acts JOIN sp x ON x.activity = a JOIN sp y ON y.case_id = x.case_id AND y.activity = b WHERE x.lo > y.hi""",
)
def contradicted_steps(spark, folder):
    """Steps between the documents of an order whose end lies whole before their start in some other order."""
    kinds = cut_lineage(_order_steps(spark, folder).select("activity_id", "activity", "next_activity").distinct())
    sides = {"input": "activity", "output": "next_activity"}
    ins, outs = (kinds.select("activity_id", F.lit(d).alias("direction"), F.col(c).alias("cluster"), F.lit(0).alias("variant")) for d, c in sides.items())
    log = order_flow(spark, folder).withColumn("activity", F.concat("activity", F.lit("_0")))
    return act.temporal_contradictions(ins.unionByName(outs), log)


@query(
    "compatible_month_rules",
    """WITH ru AS (SELECT DISTINCT 'month ' || month(o_orderdate) AS activity_id, 'status ' || o_orderstatus AS lo, 'priority ' || o_orderpriority AS hi FROM orders),
    k AS (SELECT activity_id, lo, hi, unnest([lo, hi]) AS key FROM ru)
    SELECT DISTINCT x.activity_id AS id_1, y.activity_id AS id_2, x.key FROM k x JOIN k y ON x.key = y.key AND x.activity_id < y.activity_id
    WHERE (x.lo, x.hi) <> (y.lo, y.hi)""",
)
def compatible_month_rules(spark, folder):
    """The orders of a month as an activity, with the pairs of status and priority that occur in it as its rules."""
    part = lambda kind, c: F.concat_ws(" ", F.lit(kind), c.cast("string"))
    rules = table(spark, folder, "orders").select(
        part("month", F.month("o_orderdate")).alias("activity_id"), F.lit("SAME_VALUE").alias("rule_type"),
        part("status", F.col("o_orderstatus")).alias("key_lo"), part("priority", F.col("o_orderpriority")).alias("key_hi"),
    )
    return act.compatible_rules(cut_lineage(rules.distinct()))
