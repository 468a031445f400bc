"""Document typing: text features, k-means over a range of k, structural typing, names."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Params
from docflow.functions.names import clean_file_name, prepared_tokens, type_name
from docflow.operators.graph import components
from docflow.operators.skew import hot_keys, lookup_join, salted_join, small_join
from docflow.session import cut_lineage


def tokens(documents: DataFrame, text: str = "key_text", language: str = "german") -> DataFrame:
    """doc_id and its words, prepared for typing."""
    stop = StopWordsRemover.loadDefaultStopWords(language)
    return documents.select("doc_id", prepared_tokens(F.col(text), stop).alias("tokens"))


def tfidf(words: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """L2-normed TF-IDF vectors over the most frequent words: doc_id, features.

    The inverse frequency is ln((m+1)/(df+1)).
    """
    counts = CountVectorizer(inputCol="tokens", outputCol="_tf", vocabSize=params.max_features).fit(words).transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(counts).transform(counts)
    return Normalizer(inputCol="_tfidf", outputCol="features", p=2.0).transform(weighted).select("doc_id", "features")


def sweep_k(vectors: DataFrame, params: Params = DEFAULTS, seed: int = 42) -> DataFrame:
    """Cost and silhouette for every k from 2: k, cost, silhouette, is_best.

    The vectors are cut once and read by every fit; the loop is over k, never over rows.
    """
    vectors = cut_lineage(vectors)
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    rows = []
    for k in range(2, params.max_clusters + 1):
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
        labelled = model.transform(vectors)
        found = labelled.select("cluster").distinct().limit(2).count()
        silhouette = float(evaluator.evaluate(labelled)) if found > 1 else -1.0
        rows.append((k, float(model.summary.trainingCost), silhouette))
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return vectors.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in rows], "k int, cost double, silhouette double, is_best boolean"
    )


def label_documents(vectors: DataFrame, k: int, params: Params = DEFAULTS, seed: int = 42) -> DataFrame:
    """Final labels: best of several starts by cost; clusters numbered by their smallest document."""
    vectors = cut_lineage(vectors)
    best, best_cost = None, None
    for start in range(params.restarts):
        model = KMeans(k=k, seed=seed + start, featuresCol="features", predictionCol="_c").fit(vectors)
        cost = model.summary.trainingCost
        if best is None or cost < best_cost:
            best, best_cost = model, cost
    labelled = best.transform(vectors).select("doc_id", "_c")
    firsts = labelled.groupBy("_c").agg(F.min("doc_id").alias("_first"))
    # k rows: a window without partition is as small as k.
    numbered = firsts.withColumn("cluster", F.row_number().over(Window.orderBy("_first")) - 1)
    return labelled.join(F.broadcast(numbered), "_c").select("doc_id", "cluster")


def type_by_keys(signatures: DataFrame) -> DataFrame:
    """Structural typing: documents with the same key set are of one type, named by the type's smallest
    document.  `signatures`: doc_id, key_text.  Result: doc_id, cluster."""
    firsts = signatures.groupBy("key_text").agg(F.min("doc_id").alias("cluster"))
    return small_join(signatures, firsts, ["key_text"]).select("doc_id", "cluster")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("n_docs"))


def name_types(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, doc_type: the name of the cluster's first file without extension and digits."""
    named = documents.select("doc_id", type_name(F.col("path")).alias("_name")).join(labels, "doc_id")
    return named.groupBy("cluster").agg(F.min_by("_name", "doc_id").alias("doc_type"))


def group_by_names(documents: DataFrame) -> DataFrame:
    """Group files whose cleaned names contain each other: doc_id, name, name_group.

    Only distinct names are compared, by an inverted index of their stretches of up to three characters: a contained name
    looks itself up by the rarest of its own, and what it meets is checked.  The index is as large as the names are long;
    groups are closed transitively.
    """
    named = documents.select("doc_id", clean_file_name(F.col("path")).alias("name"))
    names = cut_lineage(named.select("name").distinct().where(F.length("name") > 0))

    def stretches(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("name") - size + 1)
        return F.when(F.length("name") >= size, F.transform(starts, lambda i: F.substring(F.col("name"), i, size)))

    # Names of three characters and more are found by three, shorter ones as a whole.
    short = F.flatten(F.filter(F.array(stretches(1), stretches(2)), lambda s: s.isNotNull()))
    index = names.select("name", F.explode(F.array_distinct(F.concat(short, F.coalesce(stretches(3), F.array())))).alias("gram"))
    common = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.coalesce(F.array_distinct(stretches(3)), F.array("name"))
    inner = names.select(F.col("name").alias("part"), F.explode(own).alias("gram"))
    rarest = lookup_join(inner, common, ["gram"]).groupBy("part").agg(F.min(F.struct("n", "gram")).alias("_r"))
    rarest = rarest.select("part", F.col("_r.gram").alias("gram"))
    met = salted_join(index, rarest, ["gram"], hot_keys(index, ["gram"]))
    edges = met.where((F.col("part") != F.col("name")) & F.col("name").contains(F.col("part"))).select(
        F.col("name").alias("src"), F.col("part").alias("dst")
    )
    groups = components(edges, names.select(F.col("name").alias("node")))
    grouped = groups.select(F.col("node").alias("name"), F.col("component").alias("name_group"))
    return small_join(named, grouped, ["name"], "left").select("doc_id", "name", F.coalesce("name_group", F.lit("")).alias("name_group"))
