"""Whitening and clustering of embeddings against plain arithmetic on whole numbers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import whitening
from ticketloom.llm.pivot_clusters import Assigner, clusters, spread_out, squared
from ticketloom.llm.queries import QUERIES, table, workers_import
from ticketloom.llm.spectrum import Spectrum, leading

FOLDER = "/root/testdata/sf0.001"
ODD = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]


def usable(vectors):
    kept = [(i, v) for i, v in vectors if v and all(e is not None and math.isfinite(e) for e in v)]
    lengths = [len(v) for _, v in kept]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    return [(i, v) for i, v in kept if len(v) == usual]


def whitened_by_hand(vectors, components=16):
    """(vec_id, component, n, deviation, whitened, explained) with exact covariances and a library's eigenpairs."""
    rows = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in usable(vectors)]
    fit = sorted({x for _, x in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    v = [[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array(v))
    values, vectors = values[::-1], vectors.T[::-1]
    found = {}
    for i, x in rows:
        away = [n * a - s for a, s in zip(x, sums)]
        for k in range(min(components, d)):
            if values[k] > d * np.finfo(float).eps * values[0]:
                w = float(np.array(away, float) / n @ vectors[k]) / math.sqrt(values[k])
                found.setdefault((i, k + 1), []).append((n, sum(a * a for a in away), w, values[k] / np.trace(v)))
    return found


def agrees(got, want):
    """Signs of the components are free, but one for all rows."""
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        n, deviation, w, explained = want[r["vec_id"], r["component"]].pop()
        sign = signs.setdefault(r["component"], 1 if w * r["whitened"] >= 0 else -1)
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["whitened"] == pytest.approx(sign * w, abs=1e-7)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_whitening_query_by_hand(spark):
    vectors = table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()
    got = QUERIES["op11_whitening"](spark, FOLDER).collect()
    agrees(got, whitened_by_hand([tuple(r) for r in vectors]))


@pytest.fixture(scope="module")
def odd(spark):
    """Vectors far from zero, odd ones, copies, repeated rows, a null id, and other columns."""
    workers_import(spark)
    rng = np.random.default_rng(5)
    vectors = [[1e6 + a, 3 * a + b, -7e4 + b] for a, b in rng.normal(size=(60, 2)).tolist()] + ODD
    rows = [(i, v, 1, "x") for i, v in enumerate(vectors)]
    rows += [(100, vectors[0], 1, "x"), (101, vectors[0], 1, "x"), rows[3], (None, vectors[5], 1, "x")]
    schema = "vec_id LONG, embedding ARRAY<DOUBLE>, cluster INT, n STRING"
    return spark.createDataFrame(rows, schema).repartition(4)


def test_whitening_edges(spark, odd):
    found = whitening.whitened(odd)
    assert found.columns[0] == "vec_id" and len(found.columns) == 7
    vectors = [(r["vec_id"], r["embedding"]) for r in odd.collect()]
    want = whitened_by_hand(vectors)
    # floor makes the third component more than rounding
    assert {k for _, k in want} == {1, 2, 3}
    agrees(found.collect(), want)
    assert whitening.whitened(odd.limit(0)).count() == 0
    assert whitening.whitened(odd.where("vec_id IN (0, 100)")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(9)], "vec_id LONG, embedding ARRAY<FLOAT>")
    assert {r["component"] for r in whitening.whitened(flat).collect()} == {1}


def test_products_beyond_floating_point_are_exact():
    rng = np.random.default_rng(0)
    y = rng.integers(-(2**40), 2**40, (20, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
    assert whitening.exact_products(y).tolist() == want


@pytest.mark.parametrize("values", [[3] * 5 + [2] * 5 + [1] * 10, [5, 5 - 1e-9] + [1] * 18, [4] + [0] * 19])
def test_spectrum_with_multiple_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(20, 20)))
    matrix = (q * np.array(values)) @ q.T
    matrix = ((matrix + matrix.T) / 2).astype(np.longdouble)
    found, vectors = leading(matrix, 16)
    assert len(found) == min(16, np.count_nonzero(values))
    assert np.allclose(found.astype(float), values[: len(found)], atol=1e-12)
    assert abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-15
    assert abs(matrix @ vectors.T - vectors.T * found).max() < 1e-14


def test_inertia_counts():
    a = np.random.default_rng(2).normal(size=(30, 30))
    matrix = (a + a.T).astype(np.longdouble)
    exact = np.linalg.eigvalsh(matrix.astype(float))
    for shift in np.linspace(-12, 12, 49):
        assert Spectrum(matrix).above(np.longdouble(shift)) == (exact > shift).sum()
    assert len(leading(np.zeros((3, 3), np.longdouble), 2)[0]) == 0


def clusters_by_hand(vectors, dimension=64, k=40, rounds=5):
    kept = [
        (i, [math.floor(256 * c) for c in v])
        for i, v in vectors
        if v and len(v) == dimension and all(e is not None and math.isfinite(e) for e in v)
    ]
    drawn = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    points = [x for _, x in drawn[:k]]

    def nearest():
        x, c = np.array([x for _, x in kept]), np.array(points)
        distance = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        return distance.argmin(axis=1), distance.min(axis=1)

    for _ in range(rounds):
        number, _ = nearest()
        for c in range(len(points)):
            own = [x for (_, x), a in zip(kept, number) if a == c]
            if own:
                points[c] = [sum(column) // len(own) for column in zip(*own)]
    number, distance = nearest()
    inertia = {c: int(distance[number == c].sum()) for c in set(number.tolist())}
    rows = [(i, int(c), int(d), inertia[int(c)], sum(inertia.values())) for (i, _), c, d in zip(kept, number, distance)]
    return rows, points


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_clusters_query_by_hand(spark):
    vectors = [tuple(r) for r in table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()]
    want, points = clusters_by_hand(vectors)
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    got = QUERIES["op13_pivot_clusters"](spark, FOLDER)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(got.collect()) == ordered([(*r, digests[r[1]]) for r in want])


@pytest.mark.parametrize("k", [1, 4, 40, 200])
def test_clusters_edges(spark, odd, k):
    odd = odd.withColumn("embedding", F.expr("transform(embedding, e -> e / 16)"))
    vectors = [(r["vec_id"], r["embedding"]) for r in odd.collect()]
    want, points = clusters_by_hand(vectors, 3, k)
    got = clusters(odd, dimension=3, centroids=k).collect()
    assert ordered([r[:5] for r in got]) == ordered(want)
    assert all(r["centroid"] == points[r["cluster"]] for r in got)


def test_no_clusters(spark, odd):
    assert clusters(odd.limit(0), dimension=3).count() == 0
    assert clusters(odd, dimension=5).count() == 0
    assert clusters(odd.where("vec_id IS NULL"), dimension=3).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    assert {(r["cluster"], r["distance"]) for r in clusters(same, dimension=2).collect()} == {(0, 0)}


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (40, 64))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 64))
    pivots = spread_out(centres, 6)
    to_pivots = np.sqrt(np.array([squared(x, p) for p in pivots], float)).T
    assigner = Assigner(centres, pivots)
    exact = np.array([squared(x, c) for c in centres]).T
    assert (assigner.bounds(to_pivots) <= exact).all()
    cluster, distance, computed = assigner.assign(x, to_pivots)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert computed < exact.size / 4
