"""Models against brute force and invariants."""

import datetime as dt
import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import models as queries
from logvane.operators import dbscan, ensemble, gmm, iforest, vectors
from logvane.plans import training
from logvane.session import stage


def frame(spark, x, **more):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>").repartition(5)


def plain_dbscan(x, eps, min_samples):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= min_samples
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = min(label[j] for j in np.flatnonzero(near[i] & core))
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        around = np.flatnonzero(near[i] & core)
        if len(around):
            label[i] = min(label[j] for j in around)
    return label


@pytest.mark.parametrize("block", [12, 1000])
def test_dbscan_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    blobs = [rng.normal(c, 0.25, (40, 3)) for c in (0.0, 1.2, 3.0)]
    copies = np.repeat([[1.2, 1.2, 1.2], [9.0, 9.0, 9.0]], [60, 3], axis=0)
    x = np.vstack([*blobs, copies, rng.uniform(-2, 5, (25, 3))])
    found = dbscan.dbscan(frame(spark, x), 0.45, 6, block=block)
    got = {r["id"]: r["cluster"] for r in found.select("id", "cluster").collect()}
    assert [got[i] for i in range(len(x))] == plain_dbscan(x, 0.45, 6).tolist()


@pytest.mark.parametrize("block", [20, 200])
def test_dense_and_flat_cells(spark, block, monkeypatch):
    """Crowds within eps, two of them linked by one pair only, flat directions, and points on planes."""
    monkeypatch.setattr(dbscan, "FEW", 3)
    rng = np.random.default_rng(8)
    crowds = [rng.uniform(0, 0.1, (150, 4)) + np.array(c) for c in ([0, 0, 0, 0], [0.45, 0, 0, 0], [0.45, 0.47, 0, 0], [5, 5, 5, 5])]
    bridge = np.array([[0.101, 0.05, 0.05, 0.05], [0.449, 0.05, 0.05, 0.05]])
    grid = np.array([[x, y, 7.0, 0.0] for x in np.arange(0, 4, 0.25) for y in np.arange(0, 4, 0.25)])
    x = np.vstack([*crowds, bridge, grid, rng.uniform(-1, 6, (60, 4))])
    found = dbscan.dbscan(frame(spark, x), 0.35, 5, block=block)
    got = {r["id"]: r["cluster"] for r in found.select("id", "cluster").collect()}
    assert [got[i] for i in range(len(x))] == plain_dbscan(x, 0.35, 5).tolist()


def test_cells_grow_with_the_points_and_so_do_not_their_sizes(spark):
    rng = np.random.default_rng(9)
    sizes, visits = [], []
    for n in (500, 4000):
        x = rng.uniform(0, n ** (1 / 3), (n, 3))
        points = frame(spark, x).selectExpr("id AS pid", "features AS x", "1L AS weight")
        cells = dbscan._cells(points, 0.2, 100)
        assert cells.where("home").count() == n
        sizes.append(cells.groupBy("cell").agg(F.count_if("home").alias("n")).agg(F.max("n")).first()[0])
        visits.append(cells.count() / n)
    assert max(sizes) <= 150 and visits[1] < 2.5 * visits[0]


def wide_clusters():
    """Vectors that no plane cuts: three clusters, two of them linked by a chain, points around them, copies and noise."""
    rng = np.random.default_rng(11)
    centres = np.linalg.qr(rng.normal(size=(32, 3)))[0].T
    blobs = [c + rng.normal(0, 0.1, (n, 32)) for c, n in zip(centres, (220, 150, 90))]
    steps = np.linspace(0, 1, 40)[:, None]
    chain = (1 - steps) * centres[0] + steps * centres[1] + rng.normal(0, 0.06, (40, 32))
    around = rng.normal(0, 0.13, (60, 32)) + centres[rng.integers(0, 3, 60)]
    x = np.vstack([*blobs, chain, around, np.repeat(rng.normal(0, 0.3, (2, 32)), [7, 3], axis=0), rng.normal(0, 0.25, (30, 32))])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("first, size", [(40, 25), (100, 64), (8000, 2000)])
def test_a_cell_that_no_plane_cuts(spark, first, size, monkeypatch):
    monkeypatch.setattr(dbscan, "FIRST", first)
    monkeypatch.setattr(dbscan, "BLOCK", size)
    x = wide_clusters()
    truth = plain_dbscan(x, 0.68, 6)
    kinds = {c: int((truth == c).sum()) for c in set(truth.tolist())}
    assert len(kinds) >= 3 and 20 <= kinds[-1] <= 200
    found = dbscan.dbscan(frame(spark, x), 0.68, 6, block=20)
    got = {r["id"]: r["cluster"] for r in found.select("id", "cluster").collect()}
    assert [got[i] for i in range(len(x))] == truth.tolist()


def test_points_of_such_a_cell_are_not_copied(spark, monkeypatch):
    made, block_pairs = [], dbscan._block_pairs

    def counted(visits, block):
        pairs = block_pairs(visits, block)
        made.append((pairs.count(), visits.count()))
        return pairs

    monkeypatch.setattr(dbscan, "_block_pairs", counted)
    x = wide_clusters()
    points = frame(spark, x)
    assert dbscan.dbscan(points, 0.68, 6, block=20).count() == len(x)
    assert len(made) == 2 and all(pairs <= 4 * visits for pairs, visits in made)


def test_nothing_crosses_a_gap_wider_than_eps(spark):
    """Two directions of two values each: four cells without a visitor, and one row that the sample may miss."""
    rng = np.random.default_rng(12)
    x = np.hstack([rng.normal(0, 0.4, (600, 3)), 2.1 * rng.integers(0, 2, (600, 2))])
    points = frame(spark, x).selectExpr("id AS pid", "features AS x", "1L AS weight")
    cells = dbscan._cells(points, 2.0, 200)
    assert cells.count() == 600 and cells.select("cell").distinct().count() == 4
    x[17, 3] = 1.0
    found = dbscan.dbscan(frame(spark, x), 0.45, 6, block=60)
    got = {r["id"]: r["cluster"] for r in found.select("id", "cluster").collect()}
    assert [got[i] for i in range(len(x))] == plain_dbscan(x, 0.45, 6).tolist()


def test_no_points(spark):
    assert dbscan.dbscan(frame(spark, np.zeros((1, 2))).limit(0), 1.0, 2).count() == 0


def test_long_chain_is_one_cluster(spark):
    x = np.arange(60)[:, None] * 0.9
    found = dbscan.dbscan(frame(spark, x), 1.0, 2, block=8)
    assert dbscan.summary(found).first().asDict() == {"clusters": 1, "noise": 0}


def test_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (1500, 4)), rng.normal(9, 1, (30, 4))])
    rows = stage(frame(spark, x))
    nodes = iforest.grow_forest(rows, trees=50)
    forest = iforest.Forest.collect(nodes, 256)
    scored = iforest.with_forest_score(rows, forest)
    lowest = {r["id"] for r in scored.orderBy("if_raw").limit(30).collect()}
    assert len(lowest & set(range(1500, 1530))) >= 28
    sizes = iforest.sample_for_trees(rows, 50).groupBy("tree").count().collect()
    assert {r["count"] for r in sizes} == {256} and len(sizes) == 50
    again = iforest.Forest.collect(iforest.grow_forest(rows.repartition(3), trees=50), 256)
    assert np.array_equal(forest.threshold, again.threshold)


def test_mean_path():
    assert iforest.mean_path(1) == 0 and iforest.mean_path(2) == 1
    assert iforest.mean_path(256) == pytest.approx(10.244770920, abs=1e-6)


def test_mixture_likelihood(spark):
    mean, cov = np.array([1.0, -2.0]), np.array([[2.0, 0.6], [0.6, 1.0]])
    mixture = gmm.Mixture(np.array([1.0]), mean[None], cov[None])
    x = np.array([[0.0, 0.0], [1.0, -2.0], [5.0, 5.0]])
    found = gmm.with_log_likelihood(frame(spark, x), mixture).orderBy("id").collect()
    full = cov + gmm.RIDGE * np.eye(2)
    for row, point in zip(found, x, strict=True):
        d = point - mean
        expected = -0.5 * (d @ np.linalg.inv(full) @ d + math.log(np.linalg.det(full)) + 2 * math.log(2 * math.pi))
        assert row["log_likelihood"] == pytest.approx(expected)
    assert mixture.free_parameters == 2 + 3 + 0


def test_mixture_fit_finds_the_parts(spark):
    """Parts of known place, share and shape; a constant direction does no harm."""
    rng = np.random.default_rng(4)
    truth = [(900, [0, 0], [[1, 0.5], [0.5, 1]]), (450, [6, 0], [[0.5, 0], [0, 2]]), (150, [0, 9], [[0.2, 0], [0, 0.2]])]
    x = np.vstack([rng.multivariate_normal(m, c, n) for n, m, c in truth])
    x = np.hstack([x, np.full((len(x), 1), 3.0)])
    found = gmm.fit_mixture(stage(frame(spark, x)), 3, 4)
    order = np.argsort(-found.weights)
    assert found.weights[order] == pytest.approx([0.6, 0.3, 0.1], abs=0.03)
    for at, (_, mean, cov) in zip(order, truth):
        assert found.means[at] == pytest.approx([*mean, 3.0], abs=0.25)
        assert found.covariances[at][:2, :2] == pytest.approx(np.array(cov), abs=0.35)
    again = gmm.fit_mixture(stage(frame(spark, x).repartition(2)), 3, 4)
    assert again.means == pytest.approx(found.means)


def test_a_pass_sums_what_one_machine_would(spark):
    x = np.random.default_rng(5).normal(0, 1, (300, 3))
    mixtures = [gmm._start(x, 2, np.random.default_rng(i)) for i in range(3)]
    sums, plain = gmm._pass(frame(spark, x), "features", mixtures), gmm._Sums(3, 2, 3)
    plain.add(mixtures, x)
    for name in ("likelihood", "weight", "first", "second"):
        assert getattr(sums, name) == pytest.approx(getattr(plain, name))


def test_scaler_keeps_constant_columns(spark):
    rows = frame(spark, [[1.0, 5.0], [3.0, 5.0]])
    scaler = vectors.fit_scaler(rows)
    assert scaler.std == (1.0, 1.0) and scaler.mean == (2.0, 5.0)
    z = rows.select(vectors.scaled(F.col("features"), scaler).alias("z")).collect()
    assert sorted(r["z"] for r in z) == [[-1.0, 0.0], [1.0, 0.0]]


def test_weights_are_checked():
    with pytest.raises(ValueError):
        ensemble.check_weights((0.5, 0.5, 0.5))
    with pytest.raises(ValueError):
        ensemble.check_weights((0.5, 0.5))
    assert ensemble.check_weights((0.2, 0.3, 0.5)) == (0.2, 0.3, 0.5)


def test_train_save_load_score(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(8, 0.3, (6, 3))])
    rows = stage(frame(spark, x))
    models = ensemble.train(rows, trees=30, eps=1.0, min_samples=10, components=2, restarts=2, version="v10")
    ensemble.save(models, spark, str(tmp_path), dt.datetime(2024, 3, 1))
    older = ensemble.Models(**{**models.__dict__, "version": "v9"})
    ensemble.save(older, spark, str(tmp_path), dt.datetime(2024, 2, 1))
    oldest = ensemble.Models(**{**models.__dict__, "version": "001"})
    ensemble.save(oldest, spark, str(tmp_path), dt.datetime(2024, 1, 1))
    assert ensemble.load(spark, str(tmp_path), "001").version == "001"
    assert ensemble.versions(spark, str(tmp_path)).count() == 3
    loaded = ensemble.load(spark, str(tmp_path))
    assert loaded.version == "v10"
    a = {r["id"]: r["risk_score"] for r in ensemble.score(rows, models).collect()}
    b = {r["id"]: r["risk_score"] for r in ensemble.score(rows, loaded).collect()}
    assert a == pytest.approx(b)
    assert all(0.0 <= v <= 1.0 for v in a.values())
    usual = np.mean([a[i] for i in range(300)])
    assert min(a[i] for i in range(300, 306)) > usual


def test_train_and_evaluate(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(0, 1, (400, 3)), rng.normal(9, 0.5, (24, 3))])
    labels = [0] * 400 + [1] * 24
    rows = stage(frame(spark, x).withColumn("label", (F.col("id") >= 400).cast("int")))
    assert rows.filter("label = 1").count() == sum(labels)
    models, report = training.train_and_evaluate(
        rows, "v1", str(tmp_path), trees=20, eps=1.5, min_samples=10, components=2, restarts=1
    )
    r = report.first()
    assert abs(r["test"]["n_samples"] + r["validation"]["n_samples"] - 170) <= 2
    assert r["test"]["roc_auc"] > 0.95 and r["shared_features"] == 0
    assert r["improvement"]["accuracy_gain"] == pytest.approx(r["test"]["accuracy"] - r["baseline"]["accuracy"])
    assert ensemble.load(spark, str(tmp_path)).version == models.version == "v1"
    assert spark.read.json(str(tmp_path / "reports")).count() == 1


SF = "/root/testdata/sf0.001"


def test_queries_train_with_the_settings_of_the_job(spark, monkeypatch):
    asked = []

    def note(function):
        def run(*args, **options):
            bound = inspect.signature(function).bind(*args, **options)
            bound.apply_defaults()
            asked.append(bound.arguments)
            raise InterruptedError

        return run

    def settings(build):
        with pytest.raises(InterruptedError):
            build(spark, SF)
        return asked.pop()

    monkeypatch.setattr(queries, "_models", {})
    monkeypatch.setattr(ensemble, "train", note(ensemble.train))
    for build in (queries.retrain_job, queries.score_pipeline):
        got = settings(build)
        names = ("trees", "components", "restarts", "contamination", "eps", "min_samples")
        assert [got[n] for n in names] == [200, 5, 10, 0.05, 2.0, 100]
    monkeypatch.setattr(gmm, "fit_mixture", note(gmm.fit_mixture))
    for build in (queries.gmm_fit_score, queries.gmm_bic):
        assert settings(build)["restarts"] == 10
