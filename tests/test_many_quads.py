"""Rectangles of many polygons at once."""

import time

import numpy as np
import pytest

from inkspark.functions.quads import least_quad, least_rectangle, least_rectangles


def _polygons(n):
    r = np.random.default_rng(1)
    for i in range(n):
        size = int(r.integers(1, 15))
        yield r.integers(0, 6, (size, 2)).astype(float) if i % 2 else r.normal(size=(size, 2)) * 50


def test_many_equal_single_ones():
    polygons = [*_polygons(2000), np.array([[1.0, 2.0], [np.nan, 3.0], [4.0, 4.0]]), np.array([[1.0, 1.0]] * 3), np.array([[0.0, 0.0], [1.0, 1.0], [3.0, 3.0]])]
    owner = np.repeat(np.arange(len(polygons)), [len(p) for p in polygons])
    got = least_rectangles(np.concatenate(polygons), owner, len(polygons))
    for p, g in zip(polygons, got):
        np.testing.assert_allclose(g, least_rectangle(p), atol=1e-9)


def test_many_are_fast():
    polygons = list(_polygons(20000))
    points, owner = np.concatenate(polygons), np.repeat(np.arange(len(polygons)), [len(p) for p in polygons])
    began = time.process_time()
    least_rectangles(points, owner, len(polygons))
    assert time.process_time() - began < 1.5  # one by one: about 3


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(0, None), (1, []), (2, [[0, 0], [2, 0], [2, 1], [0, 1]]), (3, [[5, 5]])], "k int, p array<array<int>>").repartition(1)
    got = {r.k: r.q for r in rows.select("k", least_quad("p").alias("q")).collect()}
    assert got[0] is None and got[1] is None and got[3] == [[5, 5]] * 4
    assert [pytest.approx(x) for x in got[2]] == [[0, 0], [2, 0], [2, 1], [0, 1]]
