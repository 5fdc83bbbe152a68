"""Periodic runs against every period tried on every text."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from larkspur.llm import periodic, queries
from tests.llm.texts import SCHEMA, documents


def brute(words):
    """Every run, by trying all periods; smaller periods first, so a stretch that has one already is no run of a larger."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(24, 3 * q) and not any(all(words[j] == words[j + p] for j in range(start, start + length - p)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def digest(doc_id, text):
    words = split(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def made(rng, n, letters):
    """Random words with repetitions inside repetitions."""
    words = []
    while len(words) < n:
        unit = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 31, 33, 40]))]
        words += unit * rng.choice([1, 1, 2, 3, 4, 9]) + unit[: rng.randrange(len(unit) + 1)]
        if rng.random() < 0.2:
            words += words[-rng.randrange(1, 60) :] * rng.choice([1, 2, 3])
    return words[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_runs_of_made_texts(letters):
    rng = random.Random(letters)
    for n in (0, 1, 23, 24, 25, 47, 48, 72, 200, 200, 200, 300):
        words = made(rng, n, letters)
        assert periodic.runs_of(np.array(words, dtype=np.int32)) == brute(words), words


def test_every_period_at_every_place():
    for q in (1, 2, 7, 8, 9, 15, 16, 17, 30, 31, 32, 33, 64):
        for before in range(0, 40, 3):
            least = max(24, 3 * q)
            for length in (least - 1, least, least + 1):
                words = [1000 + i for i in range(before)] + [i % q for i in range(length)] + [5000, 5001]
                expected = [(before, length, q)] if length >= least else []
                assert periodic.runs_of(np.array(words)) == expected


def test_long_texts_stay_cheap():
    began = time.process_time()
    assert periodic.runs_of(np.zeros(300_000, dtype=np.int32)) == [(0, 300_000, 1)]
    words = np.tile(np.arange(50_000), 4)
    assert periodic.runs_of(words) == [(0, 200_000, 50_000)]
    assert len(periodic.runs_of(np.repeat(np.arange(8_000), 25))) == 8_000
    assert time.process_time() - began < 60


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = documents()
    rows += [(2000 + i, " ".join(f"w{x}" for x in made(rng, rng.randrange(0, 260), 4)), "en", "s", 0) for i in range(60)]
    rows += [(3000, "again and \t again\n" * 9_000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    expected = [digest(r[0], r[1]) for r in rows if r[0] != 3000]
    assert found == sorted([*expected, next(r for r in found if r[0] == 3000)], key=str)
    assert next(r[1:6] for r in found if r[0] == 3000) == (1, 0, 27_000, 3, 9_000_000)
    assert queries.op11_periodic_runs(spark, str(tmp_path)).where("n_runs > 0").count() > 35


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert found == {digest(r.doc_id, r.text) for r in rows}


def test_collapsed_keeps_columns(spark):
    rows = [("a " * 30 + "end", 1, "x"), ("a  b\tc", 2, "y"), (None, 3, None)]
    docs = spark.createDataFrame(rows, "text string, n_chars long, _lk_runs string")
    assert [tuple(r) for r in periodic.collapsed(docs).collect()] == [("a end", 5, "x"), ("a  b\tc", 2, "y"), (None, 3, None)]
    clash = spark.createDataFrame([(7, "b " * 24, 1)], "doc_id long, text string, start long")
    assert [tuple(r) for r in periodic.repeats(clash).collect()] == [(7, 0, 24, 1)]
    assert periodic.repeats(clash.limit(0)).count() == 0 and periodic.digests(clash.limit(0)).count() == 0
