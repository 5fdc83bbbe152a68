"""Clusters by ball trees against plain rounds over all vectors, and against SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np

from larkspur.llm import clustering, oracle, queries


def brute(rows, centroids=40, rounds=5, dimensions=64):
    own = []
    for k, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            own.append((k, [math.floor(256 * float(x)) for x in v]))
    name = lambda k: hashlib.sha256(f"2:{'null' if k is None else k}".encode()).hexdigest()
    centres = [v for _, v in sorted(own, key=lambda r: (name(r[0]), r[1]))[:centroids]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min(range(len(centres)), key=lambda i: (apart(v, centres[i]), i)) for _, v in own]
    for _ in range(rounds):
        of = assign()
        for c in set(of):
            members = [v for (_, v), x in zip(own, of, strict=True) if x == c]
            centres[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    of = assign()
    far = [apart(v, centres[c]) for (_, v), c in zip(own, of, strict=True)]
    inertia = {c: sum(d for d, x in zip(far, of, strict=True) if x == c) for c in of}
    digest = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return sorted(((k, c, d, inertia[c], sum(far), digest(c)) for (k, _), c, d in zip(own, of, far, strict=True)), key=str)


def hard_rows():
    rng = random.Random(5)
    rows = [(i, [round(rng.gauss(0, 0.3) + (i % 7), 3) for _ in range(64)]) for i in range(150)]
    rows += [(1000 + i, [0.5] * 64) for i in range(100)]  # copies
    rows += [(2000 + i, [0.5] * 63 + [0.5 + i % 2]) for i in range(20)]  # ties
    rows += [(7, [0.25] * 64), (7, [0.25] * 64), (None, [0.0] * 64), (None, [-1.0] * 64)]
    rows += [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [float("nan")] + [1.0] * 63), (8, [float("inf")] * 64), (9, [-0.001] * 64)]
    return rows


def test_against_brute_force(spark):
    rows = hard_rows()
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, key int, v string")
    as_floats = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    for parts in (1, 5):
        found = sorted((tuple(r) for r in clustering.digests(table.repartition(parts)).collect()), key=str)
        assert found == brute(as_floats)
    few = spark.createDataFrame(rows[:9], "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in clustering.digests(few).collect()), key=str) == brute(rows[:9])
    empty = clustering.digests(few.limit(0))
    assert empty.count() == 0 and empty.columns == clustering.digests(few).columns


def test_trees_are_exact_and_drop_centroids():
    rng = np.random.default_rng(1)
    for size in (3, 1000, 1 << 27):
        points = rng.integers(-size, size + 1, (3000, 8)).astype(np.float64)
        points[500:900] = points[500]
        near = rng.integers(0, 12, 3000)
        near[500:900] = near[500]
        if size == 1000:  # in groups
            points = np.rint(points / 100 + 5000 * near[:, None])
        centroids = points[rng.choice(3000, 40, replace=False)]
        centroids[7] = centroids[3]
        tree = clustering.Tree(points)
        whole = points.astype(np.int64)
        expected = np.array([((whole - c) ** 2).sum(axis=1) for c in centroids.astype(np.int64)]).argmin(axis=0)
        assert (clustering.assigned(tree, points, centroids) == expected).all()
        count, total = clustering.gathered(tree, points, centroids)
        assert (count == np.bincount(expected, minlength=40)).all()
        assert all((total[c] == whole[expected == c].sum(axis=0)).all() for c in range(40))
        (nodes, _), (places, _) = clustering.walk(tree, points, centroids)
        assert (tree.spans[nodes, 1] - tree.spans[nodes, 0]).sum() + len(places) == 3000
        assert (tree.spans[nodes, 1] - tree.spans[nodes, 0]).max() >= 400  # the copies
    assert len(places) < 3000


def test_small_blocks_and_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 64)
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(i % 5, 0.1, 64)]) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    trees = clustering.forest(clustering.kept(table), block=64)
    assert trees.count() >= 8
    found = sorted((tuple(r) for r in clustering.digests(table, centroids=6, rounds=9).collect()), key=str)
    assert found == brute(rows, 6, 9)


def test_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cursor = duck.execute(oracle.OP13)
    order = [d[0] for d in cursor.description]
    assert sorted(cursor.fetchall()) == sorted(tuple(r[c] for c in order) for r in queries.op13_centroid_clustering(spark, sf).collect())
