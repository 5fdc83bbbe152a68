import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import dealt, recompression
from tests.llm.texts import SCHEMA, documents


def brute(rows, window=35):
    texts = [(k, (t or "").encode().split()) for k, t in rows]
    count = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for k, w in texts:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted(map(tuple, recompression.digests(docs, **options).collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    expected = brute([tuple(r) for r in docs.collect()])
    assert sum(r[2] for r in expected) > 1000
    assert found(docs, block_bytes=60_000) == expected
    assert found(docs) == expected


@pytest.mark.parametrize("window", [3, 35])
def test_hard_documents(spark, window):
    docs = spark.createDataFrame(documents(), SCHEMA)
    assert found(docs, window=window, block_bytes=1500) == brute([r[:2] for r in documents()], window)
    assert found(docs.where("false")) == []


def test_runs_and_few_words(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = " ".join(" ".join([rng.choice("ab")] * rng.randint(1, rng.choice([2, 9, 50]))) for _ in range(rng.randint(1, 30)))
        rows.append((i, text, "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    for window in (5, 35):
        assert found(docs, window=window, block_bytes=400) == brute([r[:2] for r in rows], window)


def test_texts(spark):
    texts = {r.doc_id: r.text for r in recompression.deduplicated(spark.createDataFrame([(1, "a b", "", "", 0), (2, None, "", "", 0)], SCHEMA)).collect()}
    assert texts == {1: "a b", 2: ""}


def test_buckets_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(dealt, "BUCKET_ENTRIES", 60)
    monkeypatch.setattr(dealt, "FAN", 3)
    rows = documents() * 2
    assert found(spark.createDataFrame(rows, SCHEMA), block_bytes=3000) == brute([r[:2] for r in rows])


def test_symbols_decide(spark, sf, monkeypatch):
    """Where Spark's rounds find no shared symbol little is removed: what a block has twice itself, and windows without high symbols."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    real, expected = dealt.shared_names, sum(r[2] for r in brute([tuple(r) for r in docs.collect()]))
    for lost in (1, 2):  # the low round's names, or the high round's
        calls = []

        def none(blocks, named, lost=lost, calls=calls):
            calls.append(1)
            names = real(blocks, named)
            return names.where("false") if len(calls) == lost else names

        monkeypatch.setattr(dealt, "shared_names", none)
        assert sum(r[2] for r in found(docs, block_bytes=1)) < expected / 3


def test_equal_windows_have_equal_symbols():
    """What a window belongs to depends on its own words only."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        words = rng.integers(0, rng.choice([2, 5, 1000]), 400).astype(np.uint64)
        inside = rng.integers(0, 3, 60).astype(np.uint64)
        words[40:100], words[250:310] = inside, inside
        symbols = recompression.Symbols(words, np.array([0, 180, 400]))
        at = symbols.windows(35)
        name, known = symbols.owners(at, 35, recompression.HIGH, None)
        own = dict(zip(at.tolist(), name.tolist(), strict=True))
        assert known.all() and all(own[40 + i] == own[250 + i] for i in range(26))
        assert len({own[i] for i in range(40, 66)}) > 5 or len(set(inside.tolist())) == 1


def test_many_equal_rows(spark):
    docs = spark.range(100_000).selectExpr("CAST(null AS LONG) AS doc_id", "repeat('w v u ', 15) AS text")
    rows = recompression.digests(docs, block_bytes=200_000).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, rows)) == [(45, 45, 100_000)]
