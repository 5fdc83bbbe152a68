import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import dealt, suffix_array
from tests.llm.texts import SCHEMA, documents


def brute(rows, window=50):
    big = 1 << 63
    least = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            least[w] = min(least.get(w, big), big - 1 if k is None else k)
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < (big - 1 if k is None else k):
                gone[i : i + window] = True
        gone = gone[:-1]
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((k, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted(map(tuple, suffix_array.digests(docs, **options).collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    expected = brute([tuple(r) for r in docs.collect()])
    assert sum(r[2] for r in expected) > 10_000
    assert found(docs) == expected
    assert found(docs, block_bytes=50_000, hot=5) == expected


def test_buckets_in_two_levels(spark, monkeypatch):
    rows = edges() + documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(dealt, "BUCKET_ENTRIES", 100)
    monkeypatch.setattr(dealt, "FAN", 3)
    assert found(docs, block_bytes=1500, hot=3) == brute([r[:2] for r in rows])


def test_rows_grow_with_blocks(spark, monkeypatch):
    """However many blocks there are, each sends a bounded number of rows."""
    monkeypatch.setattr(dealt, "BUCKET_ENTRIES", 20)
    monkeypatch.setattr(dealt, "FAN", 8)
    sent = []
    for n in (20, 40, 80):
        docs = spark.createDataFrame([(i, " ".join(f"{i * k * 7919 % 99991:x}" for k in range(1, 120)), "", "", 0) for i in range(n)], SCHEMA)
        blocks = suffix_array._parsed(docs, "doc_id", "text", 50, 20, 1)
        named = lambda row: (np.unique(dealt.cut(suffix_array.Block.again(row, 50, 20).name, 6)),) * 2
        rows = sum(len(list(dealt.sent(dealt.NAME, 0, list(named(r.asDict())), blocks.first))) for r in blocks.table.collect())
        sent.append(rows)
        assert blocks.count == n and blocks.buckets > 8
    assert sent[2] <= 8 * 80 and sent[2] <= 4.2 * sent[0]


def test_many_equal_rows(spark):
    """100,000 rows with one id and one text, in many blocks."""
    docs = spark.range(100_000).selectExpr("CAST(id % 2 AS LONG) AS doc_id", "repeat('one text that many have, ', 4) AS text")
    rows = suffix_array.digests(docs, block_bytes=200_000).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 0, 50_000), (1, 100, 1, 50_000)]


@pytest.mark.parametrize("options", [{}, {"hot": 3, "block_bytes": 700}])
def test_repeat_groups(spark, options):
    """Every group has all occurrences of its bytes, and together they hold every string of 50 bytes that two texts have."""
    rows = [(i, r[1], *r[2:]) for i, r in enumerate(edges()[:50] + documents())]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = {k: (t or "").encode() for k, t, *_ in rows}
    groups = {}
    for r in suffix_array.repeat_groups(docs, **options).collect():
        groups.setdefault(r.repeat, []).append((r.key, r.start, texts[r.key][r.start : r.start + r.n_bytes]))
    held = set()
    for own in groups.values():
        (string,) = {s for _, _, s in own}
        everywhere = {(k, i) for k, t in texts.items() for i in range(len(t) - len(string) + 1) if t[i : i + len(string)] == string}
        assert len(string) >= 50 and len(own) > 1 and {(k, a) for k, a, _ in own} == everywhere
        held |= {(k, a + i) for k, a in everywhere for i in range(len(string) - 49)}
    count = Counter(t[i : i + 50] for t in texts.values() for i in range(len(t) - 49))
    several = Counter(w for t in texts.values() for w in {t[i : i + 50] for i in range(len(t) - 49)})
    windows = [(k, i, t[i : i + 50]) for k, t in texts.items() for i in range(len(t) - 49)]
    assert {(k, i) for k, i, w in windows if several[w] > 1} <= held <= {(k, i) for k, i, w in windows if count[w] > 1}


def edges():
    """Passages whose neighbourhoods differ, repeat in parts, and nest; with NUL bytes and runs."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh \0é") for _ in range(n))
    passages = [noise(n) for n in (45, 49, 50, 51, 60, 90, 120, 300)] + ["ab" * 40, "\0" * 70]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts.append(p if rng.random() < 0.5 else p[a:b])
            parts.append(noise(rng.choice([0, 1, 5, 40])))
        rows.append((i // 2 if i % 7 == 0 else i, "".join(parts), "en", "s", 0))
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 0, "block_bytes": 700}, {"hot": 3, "block_bytes": 700}, {"hot": 10_000, "block_bytes": 700}])
def test_edges(spark, monkeypatch, options):
    rows = edges() + documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs, **options) == brute([r[:2] for r in rows])
    assert found(docs.where("false")) == []


def test_segments(spark):
    table = spark.createDataFrame(edges(), SCHEMA).selectExpr("doc_id AS key", "text").toArrow()
    whole = suffix_array.Block(table).contexts()
    before, suffix_array.SEGMENT = suffix_array.SEGMENT, 100
    try:
        cut = suffix_array.Block(table).contexts()
    finally:
        suffix_array.SEGMENT = before
    windows = lambda b: sorted((a, s) for a, f, l in zip(b.places.tolist(), b.first.tolist(), b.last.tolist(), strict=True) for s in range(f, l + 1))  # noqa: E741, E731
    assert windows(whole) == windows(cut)


def test_intervals():
    tree = lambda x, least: sorted(zip(*(a.tolist() for a in suffix_array.lcp_intervals(np.array(x, dtype=int), least)), strict=True))
    assert tree([3, 5, 5, 2, 0, 4], 0) == [(0, 0, 6), (2, 0, 4), (3, 0, 3), (4, 5, 6), (5, 1, 3)]
    assert tree([3, 5, 5, 2, 0, 4], 3) == [(3, 0, 3), (4, 5, 6), (5, 1, 3)]
    assert tree([], 0) == []


def test_documents(spark):
    rows = edges() + documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "key", "source": "block"})
    out = suffix_array.deduplicated(docs)
    assert out.schema == docs.schema
    kept = sorted(out.collect(), key=str)
    assert len(kept) == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
    sizes = {k: n - g for k, n, g, *_ in brute([r[:2] for r in rows]) if k is not None and k >= 90}
    assert all(sizes[r.doc_id] <= len(r.text.encode()) <= sizes[r.doc_id] + 8 for r in kept if r.doc_id in sizes and r.text)
