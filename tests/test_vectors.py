"""The vector index against all distances."""

import numpy as np
import pytest

from lectern.operators import vectors


def brute(rows, queries, k):
    out = set()
    for q, label, v in queries:
        found = []
        for i, own, w in rows:
            if own == label and w is not None and v is not None:
                a, b = np.array(v, dtype=float), np.array(w, dtype=float)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                found.append((round(1 - (a @ b / size if size else 0.0), 6) + 0.0, i))
        out |= {(q, p + 1, i, d) for p, (d, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 8))
    out = [(i, int(i % 3), (centres[i % 12] + 0.3 * r.normal(size=8)).tolist()) for i in range(900)]
    out += [(1000 + i, 0, out[5][2]) for i in range(40)]  # copies
    out += [(2000 + i, 1, [0.0] * 8) for i in range(5)] + [(3000, 2, None)]
    return out


def frames(spark, rows, queries):
    shape = "label int, {} array<double>"
    return spark.createDataFrame(rows, "id long, " + shape.format("vector")).repartition(3), spark.createDataFrame(queries, "query_id long, " + shape.format("query_vector"))


def test_exact_neighbours(spark, rows):
    queries = [(i, own, v) for i, own, v in rows if i % 50 == 0 or i > 2003] + [(7000, 9, [1.0] * 8)]
    v, q = frames(spark, rows, queries)
    for k, cells in ((1, 30), (7, 30), (400, 5)):
        index = vectors.build(v, ["label"], cells)
        got = {(r.query_id, r.place, r.id, r.distance + 0.0) for r in vectors.exact_neighbours(index, q, k, probes=2).collect()}
        expected = brute(rows, queries, k)
        assert {x[:3] for x in got} == {x[:3] for x in expected} or all(abs(d - dict(((a, b), y) for a, b, _, y in expected)[a, b]) < 2e-6 for a, b, _, d in got)
        assert len(got) == len(expected)


def test_recall_of_probed_cells(spark, rows):
    queries = [(i, own, v) for i, own, v in rows if i % 10 == 0 and i < 900]
    v, q = frames(spark, rows, queries)
    index = vectors.build(v, ["label"], 30)
    got = {(r.query_id, r.id) for r in vectors.probable_neighbours(index, q, 5, probes=6).collect()}
    expected = {(a, c) for a, _, c, _ in brute(rows, queries, 5)}
    assert len(got & expected) >= 0.9 * len(expected)


def test_a_query_meets_few_vectors(spark, rows):
    """Cells and distances from centroids leave out most vectors of a label."""
    queries = [(i, own, v) for i, own, v in rows if i % 30 == 0 and i < 900]
    v, q = frames(spark, rows, queries)
    index = vectors.build(v, ["label"], 30)
    asked = vectors._asked(q, ["label"])
    met = vectors._scored(index, vectors._probed(index, asked, 2)).count()
    assert met < 0.4 * sum(sum(1 for _, own, _ in rows if own == label) for _, label, _ in queries)


def test_empty_index(spark):
    v, q = frames(spark, [], [(1, 0, [1.0, 2.0])])
    index = vectors.build(v, ["label"])
    assert vectors.exact_neighbours(index, q, 3).count() == 0
    assert vectors.probable_neighbours(index, q, 3).count() == 0
