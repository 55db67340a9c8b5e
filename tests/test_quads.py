"""Least rectangles against a search over all directions."""

import numpy as np
from pyspark.sql import functions as F

from inkspark.functions import quads


def test_rectangles_of_least_area(spark):
    rng = np.random.default_rng(1)
    polygons = [rng.normal(size=(n, 2)) * [30, 4] @ np.array([[0.8, 0.6], [-0.6, 0.8]]) for n in (3, 4, 7, 30)] + [np.array([[0, 0], [4, 0], [4, 2], [0, 2], [2, 1], [2, 0]], float)]
    for p in polygons:
        quad = quads.least_rectangle(p)
        area = np.linalg.norm(quad[1] - quad[0]) * np.linalg.norm(quad[3] - quad[0])
        angles = np.linspace(0, np.pi / 2, 20_001)
        d = np.stack([np.cos(angles), np.sin(angles)])
        u, v = p @ d, p @ np.stack([-d[1], d[0]])
        brute = ((u.max(0) - u.min(0)) * (v.max(0) - v.min(0))).min()
        assert area <= brute + 1e-9 and area >= brute * 0.999
        for a, b in zip(quad, np.roll(quad, -1, axis=0)):  # all points on one side of each side
            assert (((b - a)[0] * (p[:, 1] - a[1]) - (b - a)[1] * (p[:, 0] - a[0])) >= -1e-9).all()


def test_columns_and_odd_polygons(spark):
    rows = [(1, [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]]), (2, [[5.0, 5.0]]), (3, [[0.0, 0.0], [3.0, 4.0]]), (4, []), (5, None), (6, [[0.0, 0.0], [1.0, 0.0], [1.0, 9.0], [0.0, 9.0]])]
    df = spark.createDataFrame(rows, "i int, p array<array<double>>").select("i", quads.least_quad("p").alias("q"))
    got = {r.i: r for r in df.select("i", "q", quads.quad_area("q").alias("a"), F.when(F.col("q").isNotNull(), quads.crop_size("q")).alias("c")).collect()}
    assert got[1].q == [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]] and got[1].a == 8.0 and tuple(got[1].c) == (4, 2, False)
    assert got[2].q == [[5.0, 5.0]] * 4 and got[2].a == 0.0 and abs(got[3].a) < 1e-9 and got[4].q is None and got[5].q is None
    assert tuple(got[6].c) == (1, 9, True)
