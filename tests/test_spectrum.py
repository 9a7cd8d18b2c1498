"""Ends of Laplacian spectra against NumPy."""

import itertools

import numpy as np

from plumbline.operators import graph


def test_components_of_many_shapes(spark):
    rng = np.random.default_rng(1)
    shapes = {"path": [(i, i + 1) for i in range(5)], "ring": [(i, (i + 1) % 6) for i in range(6)], "full": list(itertools.combinations(range(5), 2)), "pair": [(0, 1)], "random": [(i, j) for i, j in itertools.combinations(range(8), 2) if j == i + 1 or rng.random() < 0.3]}
    edges = [(f"{k}{i}", f"{k}{j}") for k, es in shapes.items() for i, j in es]
    extra = [(b, a) for a, b in edges[:4]] + [edges[0], ("path0", "path0"), ("lone", "lone")]  # either direction, twice, loops
    got = {x.component.rstrip("0123456789"): x for x in graph.spectrum(spark.createDataFrame(edges + extra, "src string, dst string").repartition(3), steps=10).collect()}
    assert set(got) == set(shapes)
    for k, es in shapes.items():
        n = max(map(max, es)) + 1
        a = np.zeros((n, n))
        for i, j in es:
            a[i, j] = a[j, i] = 1
        v = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)
        assert got[k].nodes == n and got[k].edges == len(es)
        assert np.allclose([got[k].connectivity, got[k].largest], [v[1], v[-1]], atol=1e-6)
    assert graph.spectrum(spark.createDataFrame([("a", "a")], "src string, dst string")).count() == 0
