"""The registered query of every operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import (
    alignment,
    chat,
    html,
    language,
    lines,
    near_duplicates,
    neighbours,
    packing,
    postings,
    suffixes,
    token_counts,
    warc,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@query
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


TOOLS = [
    ("search", "query", "string", True, None),
    ("search", "limit", "integer", False, None),
    ("translate", "query", "string", True, None),
    ("translate", "to", "string", True, ["de", "en", "fr"]),
    ("measure", "query", "string", True, None),
    ("measure", "ratio", "number", False, None),
]


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as a tool log: every assistant turn makes a call with its whole text, and the user turn after it
    holds the result.  A call needs the one at half its turn.  What a hash of the row draws decides about the tool, also
    one without a schema, and about wrong, missing and unknown arguments."""
    draw = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(12))
    name = F.when(draw == 9, "recall").when(draw % 3 == 0, "search").when(draw % 3 == 1, "translate").otherwise("measure")
    head = F.coalesce("text", F.lit(""))
    value = (
        F.when(draw == 0, F.to_json(F.struct(head.alias("query"), F.length("text").alias("limit"))))
        .when(draw == 1, F.to_json(F.struct(F.lit("de").alias("to"), head.alias("query"))))
        .when(draw == 3, F.to_json(F.struct(head.alias("query"), F.lit("many").alias("limit"))))
        .when(draw == 4, F.to_json(F.struct(F.lit("xx").alias("to"), head.alias("query"))))
        .when(draw == 6, F.to_json(F.struct(F.length("text").alias("limit"))))
        .when(draw == 7, head)
        .when(draw == 8, F.to_json(F.struct((F.length("text") / 7).alias("ratio"), head.alias("query"))))
        .otherwise(F.to_json(F.struct(head.alias("query"), F.lit("en").alias("to"))))
    )
    is_call, is_result = F.col("role") == "assistant", (F.col("role") == "user") & (F.col("turn") > 1)
    call = lambda turn: F.concat(F.lit("c"), turn.cast("long").cast("string"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(is_result, "tool").otherwise(F.col("role")).alias("role"),
        "text",
        F.when(is_call, call(F.col("turn"))).when(is_result, call(F.col("turn") - 1)).alias("call_id"),
        F.when(is_call, name).alias("name"),
        F.when(is_call, value).alias("arguments"),
        F.when(is_call & (F.col("turn") > 1), F.array(call(F.floor(F.col("turn") / 2)))).alias("needs"),
    )


@query
def op6_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    schemas = spark.createDataFrame(TOOLS, "tool string, param string, type string, required boolean, allowed array<string>")
    return chat.format_chat(tool_messages(table(spark, folder, "conversations")), schemas)


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query
def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op9_repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.dedup(table(spark, folder, "documents"), keep_text=False)
    return found.withColumnRenamed("id", "doc_id")


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    model = language.fit(docs.where(~held_out))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLES["op1_line_dedup"] = r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
f AS (SELECT doc_id, list_filter(list_transform(range(1, len(l) + 1), lambda i: {'at': i - 1, 's': l[i]}), lambda x: regexp_matches(x.s, '\S')) AS l FROM d),
u AS (
  SELECT doc_id, i, list_transform(l[i:i + 2], lambda x: x.s) AS w, list_transform(l[i:i + 2], lambda x: x.at) AS c
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM f WHERE len(l) >= 3)
  UNION ALL
  SELECT doc_id, i, [l[i].s], [l[i].at] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM f) WHERE length(l[i].s) >= 120),
later AS (SELECT doc_id, c FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM u) WHERE k > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(c))) AS g FROM later GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
  CASE WHEN g IS NULL THEN array_to_string(l, chr(10))
    ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(g, i - 1)), chr(10)) END AS text
FROM d LEFT JOIN gone USING (doc_id)"""


@query
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    linked = near_duplicates.link(table(spark, folder, "documents"), near_duplicates.Method(words=2))
    kept = (F.col("id") == F.col("component_id")).alias("kept")
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept)


ORACLES["op2_near_duplicates"] = r"""WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
edge AS MATERIALIZED (SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, folder, "documents"), tokenizer_path(), keep_ids=False)
    packed = packing.assign(pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    index = postings.build_index(table(spark, folder, "documents"))
    found = postings.digest(postings.search(index, table(spark, folder, "benchmark"), n=10))
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op4_decontaminate"] = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, len(p) AS m, p FROM (
  SELECT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT m FROM win),
cand AS (SELECT r, i, m, w[i:i + m - 1] AS p FROM (
  SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT r, i, cand.m, item_id FROM cand JOIN (SELECT DISTINCT item_id, m, p FROM win) win ON cand.m = win.m AND cand.p = win.p),
cover AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN its USING (r)"""


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = alignment.align(table(spark, folder, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.select(F.col("id").cast("long").alias("doc_id"), *names)


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"), components=8)
    exact = F.col("deviation").cast("long").alias("deviation")
    return found.select(F.col("id").alias("vec_id"), "component", "n", exact, "whitened", "explained", "identity_error")


@query
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count(table(spark, folder, "documents"), tokenizer_path(), limit=1024)
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
