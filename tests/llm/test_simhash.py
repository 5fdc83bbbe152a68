import random
from collections import Counter

import pytest
import xxhash

from larkspur.llm import simhash
from tests.llm.texts import SCHEMA, documents


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(rows, radius=2):
    """Lists of the rows that reach each other."""
    fps = [brute_fingerprint(t) for _, t in rows]
    left, out = set(range(len(rows))), []
    while left:
        group, new = set(), {left.pop()}
        while new:
            group |= new
            left -= new
            new = {j for j in left if any((fps[i] ^ fps[j]).bit_count() <= radius for i in new)}
        out.append(sorted(group))
    return out


def brute(rows, radius=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                own[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, f"{f:016x}", least.get(root(i))) for i, ((k, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, simhash.digests(docs).collect()), key=str) == brute([tuple(r) for r in docs.collect()])
    hard = spark.createDataFrame(documents(), SCHEMA)
    assert sorted(map(tuple, simhash.digests(hard).collect()), key=str) == brute([r[:2] for r in documents()])
    assert simhash.digests(hard.where("false")).collect() == []


def test_long_chains(spark):
    fps, x = [], 0
    for b in range(0, 62, 2):  # each links to the next only
        x ^= 3 << b
        fps.append(x)
    fps += [1 << 62 | 1 << 60 | 5 << 50, -(1 << 63)]
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(rows)).collect()}
    assert set(roots) | {min(fps[:31])} == set(fps[:31])
    assert set(roots.values()) == {min(fps[:31])}
    for radius in (1, 3, 4):
        with pytest.raises(ValueError):
            simhash.links(rows, radius)
    assert simhash.links(spark.createDataFrame([(0,), (1,)], "fp long"), 0).collect() == []


def test_one_of_each(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = brute_components([r[:2] for r in rows])
    expected = [min((rows[i][0] for i in group if rows[i][0] is not None), default=None) for group in found]  # one row of each component
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(expected, key=str)


def test_one_of_each_keeps_every_component(spark):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    texts = [prose() for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(None, texts[0]), (None, texts[6]), (4, texts[6]), (8, texts[6])]  # unrelated, repeated, with an id
    rows += [(5, t) for t in texts[7:10]] + [(5, texts[7]), (6, texts[8])]  # tied smallest ids
    rows += [(2, texts[10]), (5, texts[10]), (3, texts[11]), (2, texts[11])]  # ids of other components' survivors
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = [(None, t) for t in texts[:6]] + [(4, texts[6])] + [(5, t) for t in texts[7:10]] + [(2, texts[10]), (2, texts[11])]
    assert len({brute_fingerprint(t) for t in texts}) == 12
    assert sorted(map(tuple, simhash.one_of_each(docs).collect()), key=str) == sorted(expected, key=str)
