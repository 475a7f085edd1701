"""Heap-ordered bounds against plain Lloyd rounds."""

import hashlib

import duckdb
import numpy as np
import pytest

from rateflow.llm import centroids

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>"


def lloyd(points, ids, k, rounds):
    """(assignment, squared distances, centroids) by measuring everything in every round."""
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"2:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), points[i].tolist()))[:k]
    c = points[order].copy()

    def assign():
        d = ((points[:, None, :] - c[None, :, :]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        own, _ = assign()
        for j in range(len(c)):
            if (own == j).any():
                c[j] = points[own == j].sum(0) // (own == j).sum()
    return *assign(), c


def check(spark, rows, k, rounds, dims):
    points = np.floor(256 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)).astype(np.int64)
    own, d, c = lloyd(points, [i for i, _ in rows], k, rounds)
    found, centers, measured = centroids.cluster(spark.createDataFrame(rows, VECTORS), k, rounds, dims)
    got = sorted(((r["vec_id"] is not None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in found.collect())
    assert got == sorted(((i is not None, i or 0), int(a), int(b)) for (i, _), a, b in zip(rows, own, d, strict=True))
    assert centers.tolist() == c.tolist()
    return measured


def test_random_clusters_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    grid = rng.integers(-3, 4, (300, 2)) / 4.0  # many ties and equal rows
    rows = [(i % 250, v) for i, v in enumerate(grid.tolist())] + [(None, [0.25, 0.5]), (None, [0.0, 0.0])]
    check(spark, rows, 12, 4, 2)
    check(spark, rows[:5], 12, 3, 2)  # fewer vectors than centroids
    check(spark, rows[:60], 1, 3, 2)
    check(spark, [(i, [1.5, -2.0]) for i in range(30)], 4, 2, 2)  # one place: empty clusters stay
    check(spark, rows, 7, 0, 2)


def test_separate_groups_are_hardly_measured_again(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 20, (8, 16))
    rows = [(i, (centers[i % 8] + rng.normal(0, 0.05, 16)).tolist()) for i in range(800)]
    measured = check(spark, rows, 5, 5, 16)
    assert measured[0] == 800 and sum(measured[3:]) < 400, measured


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(7)
    check(spark, [(i, v) for i, v in enumerate((rng.normal(0, 40_000, (200, 8))).tolist())], 9, 3, 8)
    with pytest.raises(Exception, match="a component beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e6] * 4)], VECTORS), 2, 1, 4)


def test_vectors_that_do_not_count(spark):
    good = [(i, [float(i), 1.0, -1.0]) for i in range(6)]
    bad = [(10, None), (11, []), (12, [1.0, 2.0]), (13, [1.0] * 4), (14, [1.0, None, 2.0]), (15, [float("nan"), 1.0, 1.0]), (16, [float("inf"), 1.0, 1.0]), (17, [float("-inf"), 1.0, 1.0])]
    rows = [(i, v, "x", 7) for i, v in good + bad]
    found, _, _ = centroids.cluster(spark.createDataFrame(rows, VECTORS + ", cluster STRING, distance INT"), 3, 2, 3)
    assert sorted(r["vec_id"] for r in found.collect()) == list(range(6))
    for none in ([], bad):
        found, c, measured = centroids.cluster(spark.createDataFrame(none, VECTORS), 3, 2, 3)
        assert found.collect() == [] and c.shape == (0, 3) and measured == []


def test_keys_never_miss_a_change():
    rng = np.random.default_rng(8)
    points, c = rng.integers(-50, 50, (400, 3)), rng.integers(-50, 50, (10, 3))
    drift = rng.random(10) * 1000
    own, key = centroids.nearest(points, c, drift)
    for _ in range(50):
        moved = c + rng.integers(-4, 5, c.shape)
        step = np.sqrt(((moved - c) ** 2).sum(1))
        now = drift + step + np.array([np.delete(step, j).max() for j in range(10)])
        after, _ = centroids.nearest(points, moved, now)
        assert (after == own)[key > now[own]].all()


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = [tuple(r) for r in centroids.op13_heap_kmeans(spark, SF).collect()]
    assert sorted(got) == sorted(con.execute(centroids.ORACLE).fetchall())
    assert len(got) == 500


def test_query_on_no_vectors(spark, tmp_path):
    spark.createDataFrame([], VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert centroids.op13_heap_kmeans(spark, str(tmp_path)).collect() == []
