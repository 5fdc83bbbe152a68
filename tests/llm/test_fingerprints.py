"""Fingerprints against a plain count of terms, and permuted tables against all pairs."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from larkspur.llm import fingerprints, queries
from tests.llm.texts import SCHEMA, documents

MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & MASK
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [xxh64_intdigest(w, 42) for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    pairs = [mix((a * 0x9E3779B97F4A7C15 + b) & MASK) for a, b in zip(words, words[1:], strict=False)]
    votes = [0] * 64
    for terms, weight in ((words, 1), (pairs, 2)):
        for h, n in Counter(terms).items():
            for b in range(64):
                votes[b] += weight * n.bit_length() * (1 if h >> b & 1 else -1)
    return sum(1 << b for b in range(64) if votes[b] > 0)


def xxhash64(text):
    return xxh64_intdigest(text.encode(), 42)


def test_fingerprints():
    texts = [r[1] for r in documents()] + ["Aa BB aa", "aa bb AA", "x " * 5000]
    assert fingerprints.fingerprints(texts).tolist() == [brute(t) for t in texts]
    assert fingerprints.fingerprints([]).tolist() == []


def digest_rows(rows):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash64(r[1]))))
    fps = [brute(t) for _, t in rows]
    near = lambda a, b: max(0.0, math.cos((a ^ b).bit_count() * (math.pi / 64)))
    others = {a: sum(1 for b in set(fps) if b != a and (a ^ b).bit_count() <= 3) for a in set(fps)}
    out = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 3
        new = t[: len(t) - cut] + after[:cut]
        f, e = fps[i], brute(new)
        out.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), f"{f:016x}", f"{e:016x}", round(near(f, e), 12), round(near(f, fps[(i + 1) % len(rows)]), 12), others[f]))
    return sorted(out, key=str)


def found(df):
    return sorted(((*r[:5], round(r[5], 12), round(r[6], 12), r[7]) for r in df.collect()), key=str)


def test_query(spark, tmp_path):
    rows = documents() + [(500 + i, f"one text that differs in its number {i // 2} and in nothing else " * (1 + i % 3), "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "key").withColumnRenamed("lang", "h")
    for parts in (1, 7):
        docs.repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert found(queries.op12_document_fingerprints(spark, str(tmp_path))) == digest_rows(rows)
    assert fingerprints.digests(docs.limit(0)).count() == 0
    lone = docs.where("doc_id = 8").limit(1)
    assert found(fingerprints.digests(lone)) == digest_rows([lone.first()])


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op12_document_fingerprints(spark, sf)) == digest_rows(rows)


@pytest.mark.parametrize(("radius", "blocks", "limit"), [(3, 5, 4096), (3, 6, 100), (0, 4, 64), (1, 3, 100)])
def test_tables_find_all(spark, radius, blocks, limit):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, MASK}
    for f in rng.sample(sorted(fps), 20):
        for _ in range(12):
            near = f
            for b in rng.sample(range(64), rng.randrange(1, radius + 3)):
                near ^= 1 << b
            fps.add(near)
    fps |= {rng.getrandbits(9) << 40 for _ in range(300)}  # a dense group
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    own = sorted(map(signed, fps))
    expected = {(a, b) for a in own for b in own if a != b and ((a ^ b) & MASK).bit_count() <= radius}
    table = spark.createDataFrame([(f,) for f in own], "fp long")
    pairs = [tuple(r) for r in fingerprints.within(table, radius, blocks, limit).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    counts = {r.fp: r.n_near for r in fingerprints.link_counts(table, radius, blocks, limit).collect()}
    assert counts == Counter(a for a, _ in expected)


def test_edited_texts_are_nearer_than_next_ones(spark, sf):
    rows = queries.op12_document_fingerprints(spark, sf).where("n_chars > 100").collect()
    near, after = np.array([r.near_edited for r in rows]), np.array([r.near_next for r in rows])
    assert near.mean() > 0.6 and after.mean() < 0.25 and (near >= after).mean() > 0.97


def test_bad_settings():
    with pytest.raises(ValueError):
        fingerprints.Tables(4, 4, 100)
