"""The inverted file against the exact search."""

import numpy as np

from larkspur.operators import ann, retrieval
from larkspur.plans.registry import QUERIES


def vectors(spark, n=1500, groups=30, copies=300):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(groups, 16))
    rows = [(i, (centres[i % groups] + rng.normal(scale=0.4, size=16)).tolist()) for i in range(n)]
    rows += [(n + i, [1.0] * 16) for i in range(copies)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0, 2.0]), (9003, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "id long, vector array<double>")


def test_all_lists_probed_is_exact(spark):
    table = vectors(spark)
    asked = table.where("id % 50 = 0")
    index = ann.indexed(table, 20)
    found = ann.probed(index, asked, 10, probes=20)
    exact = retrieval.nearest(table.where("size(vector) = 16"), asked, 10)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))
    assert ann.recall(found, exact) == 1.0


def test_every_vector_is_filed_once(spark):
    table = vectors(spark)
    rows = ann.indexed(table, 25, filed=1).blocks.collect()
    ids = [i for r in rows for i in r.ids]
    assert sorted(ids) == list(range(1800)) and all(len(r.ids) <= ann.BLOCK and len(r.units) == len(r.ids) * 16 * 8 for r in rows)
    copies = [r.list for r in rows if any(i >= 1500 for i in r.ids)]
    assert len(set(copies)) == 1
    twice = [(r.list, i) for r in ann.indexed(table, 25).blocks.collect() for i in r.ids]
    assert len(set(twice)) == len(twice) == 3600


def test_recall(spark, sf):
    table = vectors(spark)
    asked = table.where("id % 50 = 0")
    exact = retrieval.nearest(table.where("size(vector) = 16"), asked, 10)
    assert ann.recall(ann.probed(ann.indexed(table, 40), asked, 10, probes=10), exact) >= 0.9
    exact = QUERIES["vec_topk"](spark, sf)
    assert ann.recall(QUERIES["vec_index"](spark, sf), exact) >= 0.9


def test_bounded_sample_and_empty_tables(spark):
    table = vectors(spark)
    assert len(ann.fitted(table, 500, sample=60)) <= 60
    none = table.limit(0)
    index = ann.indexed(none, 5)
    assert ann.probed(index, table, 3).count() == 0
    assert ann.probed(ann.indexed(table, 5), none, 3).count() == 0
