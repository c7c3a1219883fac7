"""Samples, splits, clustering, classification and metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import kmeans, learning, sampling
from millrace.operators.batches import score_batches
from millrace.operators.quantiles import rank_auc
from millrace.plans import classify, clustering
from millrace.session import training_table
from millrace.testbed import fixtures as fx
from millrace.testbed.registry import query, table

_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
_HASH = "md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR))"
_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CENTRES = [[5.0, 10000.0, 0.02, 0.02], [25.0, 40000.0, 0.05, 0.04], [45.0, 70000.0, 0.08, 0.06]]


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").drop("l_shipdate")


@query("random_top_n", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY {_HASH}, l_orderkey, l_linenumber, l_partkey LIMIT 5000")
def random_top_n(spark: SparkSession, d: str) -> DataFrame:
    return sampling.keyed_rows(table(spark, d, "lineitem").select(*_KEY), 5_000, _KEY)


@query("head_n", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5")
def head_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(5)


@query("sample_fraction", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE substr({_HASH}, 1, 8) < '028f5c28'")
def sample_fraction(spark: SparkSession, d: str) -> DataFrame:
    return sampling.keyed_sample(table(spark, d, "lineitem").select(*_KEY), 0.01, _KEY)


@query("sample_head")
def sample_head(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_head(_lineitem(spark, d), 0.01, 5_000)


@query(
    "hash_split",
    f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN substr({_HASH}, 1, 8) < 'cccccccc' THEN 'train' ELSE 'test' END AS part FROM lineitem",
)
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.keyed_split(table(spark, d, "lineitem").select(*_KEY), 0.8, _KEY)


@query(
    "random_split",
    "SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, true AS near_fraction FROM lineitem GROUP BY ALL",
)
def random_split(spark: SparkSession, d: str) -> DataFrame:
    """Which side a row is on is random; together they hold every row as often as the table, and train about 80 % of them."""
    train, test = classify.random_parts(table(spark, d, "lineitem").select(*_KEY))
    both = train.withColumn("train", F.lit(1.0)).unionByName(test.withColumn("train", F.lit(0.0)))
    share = both.agg(F.abs(F.avg("train") - 0.8) < 6 * F.sqrt(0.16 / F.count(F.lit(1)))).scalar()
    return both.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("near_fraction", share)


@query(
    "split_at_index",
    "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) <= floor(0.8::DOUBLE * count(*) OVER ()) "
    "THEN 'train' ELSE 'test' END AS part FROM orders",
)
def split_at_index(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exact_split(table(spark, d, "orders").select("o_orderkey"), [], ["o_orderkey"], 0.8)


@query(
    "stratified_split",
    f"SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, CASE WHEN row_number() OVER (PARTITION BY l_returnflag ORDER BY {_HASH}, l_orderkey, l_linenumber, l_partkey) "
    "<= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY l_returnflag)) THEN 'train' ELSE 'test' END AS part FROM lineitem",
)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exact_split(table(spark, d, "lineitem").select("l_returnflag", *_KEY), ["l_returnflag"], _KEY, 0.8, digits=2)


@query(
    "zscore",
    "WITH m AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in _FEATURES)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) AS {c}" for c in _FEATURES)
    + " FROM lineitem, m",
)
def zscore(spark: SparkSession, d: str) -> DataFrame:
    scaled = learning.zscore(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_FEATURES), _FEATURES)
    return scaled.withColumns({c: F.round(c, 6) for c in _FEATURES})


def _distance(centre: list[float]) -> str:
    return " + ".join(f"({c} - {x}::DOUBLE) * ({c} - {x}::DOUBLE)" for c, x in zip(_FEATURES, centre))


_PLACES = ", ".join(f"{_distance(x)} AS {n}" for x, n in zip(_CENTRES, "abc"))
_DUCK_NEAREST = (
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS cluster "
    f"FROM (SELECT *, {_PLACES} FROM lineitem)"
)


@query("nearest_centroid", _DUCK_NEAREST)
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_KEY, learning.nearest_centroid(_FEATURES, _CENTRES).alias("cluster"))


@query("batch_scorer", _DUCK_NEAREST)
def batch_scorer(spark: SparkSession, d: str) -> DataFrame:
    narrow = table(spark, d, "lineitem").select(*_KEY, *_FEATURES)
    return score_batches(narrow, _FEATURES, _CENTRES).drop(*_FEATURES)


def _assignment(clustered: DataFrame) -> DataFrame:
    """Rows, clusters that have rows, and rows without a place in scaled space."""
    rows = clustered.select(F.col("prediction").alias("cluster"), vector_to_array("features").alias("x"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cluster").alias("n_clusters"),
        F.count_if(F.exists("x", lambda v: F.isnan(v))).alias("n_without_place"),
    )


@query("kmeans_clusters", "SELECT count(*) AS n_rows, 5::BIGINT AS n_clusters, 0::BIGINT AS n_without_place FROM lineitem")
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    clustered, _, _ = clustering.kmeans_clusters(table(spark, d, "lineitem").select(*_KEY, *_FEATURES), _FEATURES)
    return _assignment(clustered)


_SIDES = ", ".join(f"sum({c}) AS s_{c}" for c in _FEATURES)
_NORM = " + ".join(f"{c} * {c}" for c in _FEATURES)
_DOT = " + ".join(f"{c} * s_{c}" for c in _FEATURES)


@query(
    "silhouette_given_centres",
    f"""
    WITH p AS (SELECT {', '.join(_FEATURES)}, {_NORM} AS norm, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS cluster, row_number() OVER () AS id
      FROM (SELECT *, {_PLACES} FROM lineitem)),
    c AS (SELECT cluster AS k, count(*)::DOUBLE AS n, sum(norm) AS q, {_SIDES} FROM p GROUP BY 1),
    away AS (SELECT p.id, p.cluster, c.k, c.n,
      CASE WHEN p.cluster = c.k THEN (n * norm + q - 2 * ({_DOT})) / nullif(n - 1, 0) ELSE norm + q / n - 2 * ({_DOT}) / n END AS far FROM p, c),
    s AS (SELECT id, max(far) FILTER (k = cluster) AS a, min(far) FILTER (k <> cluster) AS b, any_value(n) FILTER (k = cluster) AS n FROM away GROUP BY id)
    SELECT count(*) AS n_rows, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s
    """,
)
def silhouette_given_centres(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*_FEATURES, learning.nearest_centroid(_FEATURES, _CENTRES).cast("double").alias("prediction"))
    score = learning.silhouette(learning.assemble(rows, _FEATURES))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.lit(score), 6).alias("silhouette"))


_SAMPLED = f"""
    WITH p AS (SELECT {', '.join(_FEATURES)}, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS cluster, row_number() OVER () AS id
      FROM (SELECT *, {_PLACES} FROM lineitem WHERE substr({_HASH}, 1, 16) < '051eb851eb851eb8')),
    far AS (SELECT x.id, x.cluster, y.cluster AS k, sum(sqrt({' + '.join(f'(x.{c} - y.{c}) * (x.{c} - y.{c})' for c in _FEATURES)})) AS total, count(*) AS n
      FROM p x, p y GROUP BY ALL),
    s AS (SELECT id, max(total / nullif(n - 1, 0)) FILTER (k = cluster) AS a, min(total / n) FILTER (k <> cluster) AS b, max(n) FILTER (k = cluster) AS n FROM far GROUP BY id)
    SELECT count(*) AS n_rows, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s
"""


@query("silhouette_sampled", _SAMPLED)
def silhouette_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Plain Euclidean silhouette of the rows in the first fiftieth of the key space."""
    rows = table(spark, d, "lineitem").select(*_KEY, *_FEATURES, learning.nearest_centroid(_FEATURES, _CENTRES).alias("prediction"))
    return clustering.sampled_silhouette(rows, 0.02, _KEY, _FEATURES).withColumn("silhouette", F.round("silhouette", 6))


@query("kmeans_search", "SELECT k::INT AS k, n AS n_rows, k::BIGINT AS n_clusters, 0::BIGINT AS n_misplaced, true AS agrees FROM (VALUES (3), (5)) v(k), (SELECT count(*) AS n FROM lineitem)")
def kmeans_search(spark: SparkSession, d: str) -> DataFrame:
    """For each k, the one that won among them: every row sits at the nearest of the fitted centres, and the silhouette is Spark's."""
    scaled = clustering.scaled_features(table(spark, d, "lineitem").select(*_FEATURES), _FEATURES).select("features")
    scaled = training_table(scaled, "scaled")
    blocks = kmeans.packed(scaled)
    _, _, scores = learning.search_k(scaled, (3, 5), blocks=blocks)
    out = []
    for k in (3, 5):
        _, model, own = learning.search_k(scaled, (k,), blocks=blocks)
        placed = model.transform(scaled)
        agrees = F.lit(abs(own[k] - learning.silhouette(placed)) < 1e-9 and own[k] == scores[k])
        x = [F.get("x", F.lit(i)) for i in range(len(_FEATURES))]
        squares = [sum(((v - float(c)) * (v - float(c)) for v, c in zip(x, centre, strict=True)), F.lit(0.0)) for centre in model.clusterCenters()]
        far = placed.select("prediction", vector_to_array("features").alias("x")).withColumn("far", F.array(*squares))
        misplaced = F.count_if(F.get("far", F.col("prediction")) > F.array_min("far") + 1e-9).alias("n_misplaced")
        counts = F.count(F.lit(1)).alias("n_rows"), F.countDistinct("prediction").alias("n_clusters"), misplaced, F.first(agrees).alias("agrees")
        out.append(far.agg(*counts).select(F.lit(k).alias("k"), "*"))
    return out[0].unionByName(out[1])


@query(
    "head_search",
    "SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS n_keys, true AS is_best, 2::BIGINT AS n_scores "
    "FROM lineitem WHERE l_quantity <> 13 OR l_linenumber <> 1",
)
def head_search(spark: SparkSession, d: str) -> DataFrame:
    """Clusters searched on the first rows; rows with a missing feature are left out."""
    holes = F.when((F.col("l_quantity") != 13) | (F.col("l_linenumber") != 1), F.col("l_discount")).alias("l_discount")
    rows = table(spark, d, "lineitem").select(*_KEY, *[holes if c == "l_discount" else c for c in _FEATURES])
    out, k, scores = clustering.search_on_head(rows, _FEATURES, ks=(3, 5), on_missing="skip")
    best = F.lit(scores[k] == max(scores.values()))
    n_keys = F.countDistinct(*_KEY).alias("n_keys")
    return out.agg(F.count(F.lit(1)).alias("n_rows"), n_keys, F.first(best).alias("is_best"), F.lit(len(scores)).cast("long").alias("n_scores"))


@query("kmeans_silhouette")
def kmeans_silhouette(spark: SparkSession, d: str) -> DataFrame:
    _, k, scores = clustering.kmeans_clusters(table(spark, d, "lineitem").select(*_FEATURES), _FEATURES)
    return spark.createDataFrame([(k, scores[k])], "k int, silhouette double")


@query("kmeans_sampled")
def kmeans_sampled(spark: SparkSession, d: str) -> DataFrame:
    clustered, _, _ = clustering.kmeans_sampled(table(spark, d, "lineitem").select(*_KEY, *_FEATURES), _FEATURES)
    return clustered.groupBy("prediction").agg(F.count(F.lit(1)).alias("n_rows"))


@query("train_on_head", "SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS n_keys, 5::BIGINT AS n_clusters FROM lineitem")
def train_on_head(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on the first rows, but every row gets one of the clusters."""
    out = clustering.train_on_head(table(spark, d, "lineitem").select(*_KEY, *_FEATURES), _FEATURES)
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(*_KEY).alias("n_keys"), F.countDistinct("cluster").alias("n_clusters")
    )


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """A label that features explain in part: cheap per piece."""
    cheap = (F.col("l_extendedprice") < 1500 * F.col("l_quantity")).cast("int")
    return table(spark, d, "lineitem").select(*_KEY, *_FEATURES, cheap.alias("label"))


# what SQL knows of a fitted model: the held-out rows, their labels, and that a prediction is a probability over one half
_HELD_OUT = f"SELECT CAST(l_extendedprice < 1500 * l_quantity AS INT) AS label FROM lineitem WHERE substr({_HASH}, 1, 8) >= 'cccccccc'"


def _test_rows(scored: DataFrame) -> DataFrame:
    p = vector_to_array("probability")[1]
    auc = learning.area_under_roc(scored, "label")
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("bigint").alias("n_positive"),
        F.count_if((p > 0.5).cast("double") != F.col("prediction")).alias("n_inconsistent"), F.lit(auc > 0.75).alias("separates"),
    )


_TEST_ROWS = f"SELECT count(*) AS n_rows, sum(label)::BIGINT AS n_positive, 0::BIGINT AS n_inconsistent, true AS separates FROM ({_HELD_OUT})"


@query("gbt_classifier", _TEST_ROWS)
def gbt_classifier(spark: SparkSession, d: str) -> DataFrame:
    return _test_rows(classify.gbt_predictions(_labelled(spark, d), "label", _FEATURES, _KEY))


@query("predictions_table", f"SELECT label, count(*) AS n_rows, 0::BIGINT AS n_inconsistent FROM ({_HELD_OUT}) GROUP BY label")
def predictions_table(spark: SparkSession, d: str) -> DataFrame:
    out = learning.prediction_table(classify.gbt_predictions(_labelled(spark, d), "label", _FEATURES, _KEY, step=0.3), "label")
    wrong = (F.col("probability") > 0.5).cast("int") != F.col("prediction")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("n_inconsistent"))


@query("gbt_many_rounds", _TEST_ROWS)
def gbt_many_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _test_rows(classify.gbt_predictions(_labelled(spark, d), "label", _FEATURES, _KEY, rounds=100))


@query(
    "gbt_rounds",
    f"SELECT i::INT AS round, n_train, n_test, true AS agrees, true AS separates FROM (SELECT unnest(range(1, 9)) AS i), "
    f"(SELECT count(*) FILTER (substr({_HASH}, 1, 8) < 'cccccccc') AS n_train, count(*) FILTER (substr({_HASH}, 1, 8) >= 'cccccccc') AS n_test FROM lineitem)",
)
def gbt_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Areas under ROC after each of 8 rounds. ``agrees``: the last one on held-out rows is the model's own by ranks."""
    rows = _labelled(spark, d)
    model, scores = classify.gbt_rounds(rows, "label", _FEATURES, _KEY, rounds=8, step=0.3)
    _, test = classify.keyed_parts(rows, _KEY)
    raw = model.transform(learning.assemble(test, _FEATURES)).select("label", vector_to_array("rawPrediction")[1].alias("score"))
    own = rank_auc(raw, "score", "label").agg(F.max("auc")).scalar()
    agrees = (F.col("round") < 8) | (F.abs(F.col("test_auc") - own) < 1e-9)
    return scores.select("round", "n_train", "n_test", agrees.alias("agrees"), (F.least("train_auc", "test_auc") > 0.7).alias("separates"))


@query(
    "auc_rank",
    f"""
    WITH r AS (SELECT label, (2 * rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS avg_rank FROM ({fx.DUCK_SCORES})),
    n AS (SELECT sum(label)::DOUBLE AS p, count(*)::DOUBLE - sum(label) AS q FROM r)
    SELECT round((sum(avg_rank) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)), 9) AS auc,
      any_value(p)::BIGINT AS n_positive, any_value(q)::BIGINT AS n_negative FROM r, n
    """,
)
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return rank_auc(fx.lineitem_scores(spark, d), "score", "label").withColumn("auc", F.round("auc", 9))


@query("accuracy_at_threshold", f"SELECT round(avg(CAST((CAST(score > 0.5 AS INT) = label) AS DOUBLE)), 9) AS accuracy, count(*) AS n_rows FROM ({fx.DUCK_SCORES})")
def accuracy_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    return learning.accuracy(fx.lineitem_scores(spark, d), "score", "label").withColumn("accuracy", F.round("accuracy", 9))


@query(
    "log_loss",
    f"SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss, count(*) AS n_rows FROM "
    f"(SELECT label, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM ({fx.DUCK_SCORES}))",
)
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    return learning.log_loss(fx.lineitem_scores(spark, d), "score", "label").withColumn("log_loss", F.round("log_loss", 6))
