from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import batches, boosting, distances, kmeans, learning, silhouette
from millrace.operators.quantiles import rank_auc
from millrace.plans import classify, clustering
from millrace.session import training_table


@pytest.fixture(scope="module")
def points(spark):
    """Three well separated clouds; the label is a function of x."""
    cloud = F.col("id") % 3
    return spark.range(900).select(
        "id",
        (cloud * 100 + F.rand(1)).alias("x"),
        (cloud * -50 + F.rand(2)).alias("y"),
        (cloud == 2).cast("int").alias("label"),
    ).cache()


def test_search_finds_the_clouds(points):
    out, k, scores = clustering.kmeans_clusters(points, ["x", "y"], ks=(2, 3, 4))
    assert k == 3 and all(-1 <= s <= 1 for s in scores.values())
    sizes = sorted(r["count"] for r in out.groupBy("prediction").count().collect())
    assert sizes == [300, 300, 300]


def test_sampled_and_head_training(points):
    out, _, scores = clustering.kmeans_sampled(points, ["x", "y"], n=200, ks=(3,))
    assert out.count() == 200 and scores[3] > 0.9
    everything = clustering.train_on_head(points, ["x", "y"], n=150, k=3)
    assert everything.count() == 900 and {r.cluster for r in everything.select("cluster").distinct().collect()} == {0, 1, 2}


def test_no_numeric_columns(spark):
    with pytest.raises(ValueError):
        clustering.scaled_features(spark.createDataFrame([("a",)], "s string"))


def test_scaler_agrees_with_columns(points):
    vectors = clustering.scaled_features(points, ["x"]).orderBy("id").limit(5).collect()
    plain = learning.zscore(points, ["x"]).orderBy("id").limit(5).collect()
    assert [v.features[0] for v in vectors] == pytest.approx([p.x for p in plain])
    population = learning.zscore(points, ["x"], population=True).orderBy("id").first().x
    assert population == pytest.approx(plain[0].x * (900 / 899) ** 0.5)


def test_classifier(points):
    scored = classify.gbt_predictions(points.select("id", "x", "y", "label"), "label", ["x", "y"], ["id"])
    assert learning.area_under_roc(scored, "label") > 0.99
    table = learning.prediction_table(scored, "label")
    assert table.columns == ["prediction", "probability", "label"]
    assert table.where("probability < 0 OR probability > 1 OR prediction <> CAST(probability > 0.5 AS INT)").count() == 0
    assert rank_auc(table, "probability", "label").first().auc > 0.99
    train, test = classify.random_parts(points)
    assert train.count() + test.count() == 900


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 1), (0.4, 0), (1.0, 0)], "p double, y int")
    assert learning.accuracy(df, "p", "y").first().accuracy == 0.5
    assert learning.log_loss(df, "p", "y").first().log_loss == pytest.approx(9.1926, abs=0.2)


def test_batch_state_is_built_per_task(spark):
    calls = []

    def score(state, batch: pd.DataFrame) -> pd.DataFrame:
        calls.append(1)
        return batch.assign(n=len(batch) + state)

    out = batches.map_with_state(spark.range(25).coalesce(1), lambda: 100, score, "id long, n long", batch_rows=10)
    assert sorted(r.n for r in out.collect()) == [105] * 5 + [110] * 20


def test_partial_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("b", 2.0), ("a", 3.0)], "k string, v double").repartition(3)
    total = batches.count_batches(df, "k", "v").groupBy("k").agg(F.sum("count").alias("n"))
    assert {r.k: r.n for r in total.collect()} == {"a": 2, "b": 1}


@pytest.fixture(scope="module")
def noisy(spark):
    return spark.range(3000).select(
        "id", F.rand(3).alias("x"), (F.floor(F.rand(4) * 8) / 8).alias("y"), F.rand(6).alias("z")
    ).withColumn("label", (F.col("x") + F.col("y") + F.rand(5) > 1.5).cast("int")).cache()


def test_margins_are_the_models_after_each_round(noisy):
    vectors = learning.assemble(noisy, ["x", "y", "z"])
    model = learning.fit_gbt(vectors, "label", rounds=6, depth=3)
    trees = boosting.export_trees(model)
    rows = model.transform(vectors).orderBy("id").collect()
    x = np.array([r.features.toArray() for r in rows])
    margins = boosting.round_margins(x, trees)
    assert np.allclose(margins[:, -1], [r.rawPrediction[1] for r in rows], atol=1e-12)
    sign = np.array([2 * r.label - 1 for r in rows])
    losses = [float(np.mean(2 * np.log1p(np.exp(-2 * sign * margins[:, r])))) for r in range(6)]
    assert np.allclose(losses, model.evaluateEachIteration(vectors), atol=1e-9)


def test_area_of_each_round_is_that_of_its_scores(spark, noisy):
    """By group, with rows without label, and a group of one class."""
    rows = noisy.withColumn("part", F.when(F.col("id") % 3 > 0, "a").when(F.col("label") == 1, "b"))
    rows = rows.withColumn("label", F.when(F.col("id") % 50 != 0, F.col("label")))
    vectors = learning.assemble(rows, ["x", "y", "z"])
    model = learning.fit_gbt(vectors.where("label is not null"), "label", rounds=5, depth=3)
    got = {(r.part, r.round): r for r in boosting.auc_by_round(model, vectors, "label", ["part"], [5, 1, 3]).collect()}
    assert set(got) == {(p, r) for p in ("a", "b", None) for r in (1, 3, 5)} and got["b", 3].auc is None
    trees = boosting.export_trees(model)
    known = vectors.where("label is not null and part = 'a'").orderBy("id").collect()
    margins = boosting.round_margins(np.array([r.features.toArray() for r in known]), trees)
    for r in (1, 3, 5):
        scored = spark.createDataFrame([(float(m), k.label) for m, k in zip(margins[:, r - 1], known, strict=True)], "score double, label int")
        assert got["a", r].auc == pytest.approx(rank_auc(scored, "score", "label").first().auc, abs=1e-12)
    whole = boosting.auc_by_round(model, vectors, "label").collect()
    assert len(whole) == 5 and {r.n_positive + r.n_negative for r in whole} == {2940}
    with pytest.raises(ValueError):
        boosting.auc_by_round(model, vectors, "label", at=[6])


def test_rounds_end_when_held_out_rows_no_longer_gain(noisy):
    model, scores = classify.gbt_rounds(noisy, "label", ["z"], ["id"], rounds=30, step=0.5, stop_early=True)
    n = len(model.treeWeights)
    assert n < 30
    got = {r.round: r for r in scores.collect()}
    assert set(got) == set(range(1, n + 1)) and all(r.n_train + r.n_test == 3000 and r.train_auc is not None for r in got.values())
    whole, _ = classify.gbt_rounds(noisy, "label", ["x", "y"], ["id"], rounds=4)
    assert len(whole.treeWeights) == 4


def brute_silhouette(x, cluster, square):
    far = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    far = far if square else np.sqrt(far)
    scores = []
    for i, own in enumerate(cluster):
        if (cluster == own).sum() == 1:
            scores.append(0.0)
            continue
        a = far[i, cluster == own].sum() / ((cluster == own).sum() - 1)
        b = min(far[i, cluster == c].mean() for c in set(cluster) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


@pytest.mark.parametrize("block", [7, 40, 2048])
def test_silhouettes_against_all_pairs(spark, block):
    """Clusters of very unlike sizes, one of a single row, repeated rows."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(2, 2, (15, 3)), [[9.0, 9, 9]], np.ones((8, 3))])
    cluster = np.array([0] * 60 + [3] * 15 + [4] + [7] * 8)
    rows = spark.createDataFrame([(*map(float, v), int(c)) for v, c in zip(x, cluster, strict=True)], "a double, b double, c double, prediction int")
    vectors = learning.assemble(rows, ["a", "b", "c"]).repartition(3)
    got = silhouette.euclidean_silhouette(vectors, block=block).first()
    assert got.n_rows == len(x) and got.silhouette == pytest.approx(brute_silhouette(x, cluster, False), abs=1e-12)
    both = vectors.withColumn("p2", (F.col("prediction") > 0).cast("int")).withColumn("one", F.lit(1))
    found = silhouette.squared_silhouettes(both, ["prediction", "p2", "one"])
    assert found["prediction"] == pytest.approx(brute_silhouette(x, cluster, True), abs=1e-12) and found["one"] is None
    assert found["p2"] == pytest.approx(brute_silhouette(x, (cluster > 0).astype(int), True), abs=1e-12)
    assert silhouette.euclidean_silhouette(both, "one", block=block).first().silhouette is None


def test_search_reads_blocks_once_for_all_k(spark, monkeypatch):
    """A k more costs no pass more. Centres are the means of the rows next to them, scores those of Spark's predictions, and a k alone ends alike."""
    monkeypatch.setattr(kmeans, "BLOCK_NUMBERS", 60)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 1.0, (n, 3)) for c, n in ((0, 700), (30, 200), (-40, 100))])
    rows = learning.assemble(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))), list("abc")).select("features")
    passes, one = [], kmeans._pass
    monkeypatch.setattr(kmeans, "_pass", lambda blocks, work: passes.append(blocks) or one(blocks, work))
    blocks = kmeans.packed(rows.repartition(5))
    assert blocks.agg(F.sum("n")).first()[0] == 1000 and blocks.agg(F.max("n")).first()[0] <= 20
    best, model, scores = learning.search_k(rows, (2, 3, 4), blocks=blocks)
    assert best == 3 and len(passes) <= 4 + 20 + 2 and all(p is blocks for p in passes)
    centres = np.array(model.clusterCenters())
    label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    np.testing.assert_allclose(centres, [x[label == j].mean(axis=0) for j in range(3)], atol=1e-4)
    placed = model.transform(rows)
    assert sorted(r["count"] for r in placed.groupBy("prediction").count().collect()) == [100, 200, 700]
    assert scores[3] == pytest.approx(learning.silhouette(placed), abs=1e-12)
    assert scores[3] == pytest.approx(silhouette.squared_silhouettes(placed, ["prediction"])["prediction"], abs=1e-12)
    for k in (2, 4):
        assert learning.search_k(rows, (k,), blocks=blocks)[2][k] == scores[k]


def test_search_of_few_places(spark):
    """Fewer places than k are a cluster each, one place has no score; empty parts, zeros as sparse vectors."""
    two = spark.createDataFrame([(0.0, 0.0, 0.0)] * 6 + [(0.0, 4.0, 0.0)] * 3, "a double, b double, c double").repartition(12)
    vectors = learning.assemble(two, ["a", "b", "c"])
    best, model, scores = learning.search_k(vectors, (3,))
    assert best == 3 and scores == {3: pytest.approx(1.0)} and sorted(tuple(c) for c in model.clusterCenters()) == [(0, 0, 0), (0, 4, 0)]
    assert learning.search_k(vectors.where("b = 0"), (2,))[2] == {2: None}


def narrow_rows(n):
    """One feature is far wider than the others, some rows are repeated, some lie far off."""
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(1, 51, n), rng.uniform(900, 105_000, n), rng.integers(0, 11, n) / 100], axis=1).astype(float)
    x[: n // 20] = x[n // 2]
    x[-3:, 1] *= 100
    return x, (x[:, 1] // 40_000).clip(max=2).astype(int)


def test_distances_to_distant_boxes_are_not_taken_one_by_one(monkeypatch):
    """Sums over all pairs as all distances give them, from a small part of the distances."""
    x, cluster = narrow_rows(30_000)
    member = (cluster[:, None] == np.arange(3)).astype(float)
    monkeypatch.setattr(distances, "LEAF", 512)
    taken = []
    for name in ("_near_sums", "far_sums"):
        monkeypatch.setattr(distances, name, lambda x, y, *rest, run=getattr(distances, name): (taken.append(len(x) * len(y)), run(x, y, *rest)))
    whole = distances.Rows(x, member)
    distances.meet(whole, whole)
    left, right = distances.Rows(x[:9_000], member[:9_000]), distances.Rows(x[9_000:], member[9_000:])
    assert sum(taken) < len(x) ** 2 / 8
    for a, b in ((left, left), (right, right), (left, right)):
        distances.meet(a, b)
    found, halves = whole.sums(), np.concatenate([left.sums(), right.sums()])
    some = np.arange(0, len(x), 101)
    want = np.array([np.sqrt(((x - x[i]) ** 2).sum(axis=1)) @ member for i in some])
    np.testing.assert_allclose(found[some], want, rtol=1e-10)
    np.testing.assert_allclose(halves[some], want, rtol=1e-10)


def test_silhouette_of_distant_cells(spark, monkeypatch):
    """Blocks of distant cells do not meet, but all pairs are in the silhouette; also where no cell is distant."""
    weighed, weigh = [], silhouette._cell_weights
    monkeypatch.setattr(silhouette, "_cell_weights", lambda *a: weighed.append(weigh(*a)) or weighed[-1])
    x, cluster = narrow_rows(12_000)
    for features, n_weighed in ((x, 1), (np.random.default_rng(6).normal(size=(3_000, 5)), 1)):
        of = cluster[: len(features)] if features is x else (features[:, 0] > 0).astype(int)
        pdf = pd.DataFrame(features, columns=[f"f{i}" for i in range(features.shape[1])]).assign(prediction=of.astype("int32"))
        got = silhouette.euclidean_silhouette(learning.assemble(spark.createDataFrame(pdf), list(pdf.columns[:-1]))).first()
        member = (of[:, None] == np.unique(of)).astype(float)
        sums = np.concatenate([np.sqrt(((features[at : at + 500, None, :] - features[None]) ** 2).sum(axis=2)) @ member for at in range(0, len(features), 500)])
        sizes, every = member.sum(axis=0), np.arange(len(features))
        mine = np.searchsorted(np.unique(of), of)
        own = sums[every, mine] / (sizes[mine] - 1)
        others = sums / sizes
        others[every, mine] = np.inf
        other = others.min(axis=1)
        assert got.n_rows == len(features) and got.silhouette == pytest.approx(((other - own) / np.maximum(own, other)).mean(), abs=1e-10)
        assert len(weighed) == n_weighed


def test_search_on_the_head(points):
    holes = points.withColumn("x", F.when(F.col("id") % 10 != 0, F.col("x")))
    out, k, scores = clustering.search_on_head(holes, ["x", "y"], n=200, ks=(2, 3, 5), on_missing="skip")
    assert k == 3 and set(scores) == {2, 3, 5} and scores[3] > 0.9
    assert out.columns == ["id", "x", "y", "label", "cluster"] and out.count() == 810
    with pytest.raises(ValueError):
        clustering.search_on_head(points, ["x"], on_missing="keep")
    moments = learning.moments(points.limit(50), ["x"], population=True)
    sample = learning.moments(points.limit(50), ["x"])
    assert moments["__scaled_0"][2] == pytest.approx(sample["__scaled_0"][2] * (49 / 50) ** 0.5)


def test_trees_are_fitted_on_merged_rows(spark, noisy):
    """As many rows as there are combinations of bins, whose weights are the rows; a threshold parts the rows as it parts these."""
    rows = noisy.select("id", "y", (F.floor(F.col("x") * 1000) / 1000).alias("x"), "z", "label")
    vectors = learning.assemble(rows, ["y", "x", "z"])
    for features, most in ((vectors, 2 * 8 * 32 * 32), (learning.assemble(rows, ["y", "x"]), 2 * 8 * 32)):
        merged = boosting.merged_rows(features.unionAll(features), ["label"], "n").collect()
        assert sum(r.n for r in merged) == 6000 and len(merged) <= min(most, 3000)
    values = boosting.bin_values(vectors)
    assert list(values[0]) == [i / 8 for i in range(8)] and len(values[1]) == 32
    places = boosting._places(np.array([r.features.toArray() for r in vectors.collect()]), [boosting.borders(v) for v in values])
    want = {tuple(values[f][p] for f, p in enumerate(row)) for row in places}
    assert {tuple(r.features.toArray()) for r in boosting.merged_rows(vectors, ["label"], "n").collect()} == want
    holes = learning.assemble(rows.withColumn("z", F.when(F.col("id") % 9 > 0, F.col("z"))), ["y", "z"], on_missing="keep")
    with pytest.raises(Exception, match="NaN"):
        learning.fit_gbt(holes, "label")
    wide = [np.arange(9.0)] * 30
    codes = boosting._codes(boosting._places(np.repeat(np.arange(20.0)[:, None], 30, axis=1), wide), wide)
    assert len(np.unique(codes)) == 10


def test_training_tables_have_bounded_parts(spark, points, monkeypatch):
    """More rows make more parts, when written and when read, not larger ones."""
    monkeypatch.setitem(training_table.__globals__, "SPREAD_ROWS", 30)
    table = training_table(points, "points")
    sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 90 and len(sizes) >= 15
