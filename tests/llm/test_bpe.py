import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import bpe, codec
from tests.llm.texts import SCHEMA, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, path=PATH):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for key, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((key, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 5000, bpe.BLOCK_BYTES])
def test_as_the_library(spark, block):
    docs = spark.createDataFrame(documents(), SCHEMA)
    found = sorted(map(tuple, bpe.digests(docs, PATH, block_bytes=block).collect()), key=str)
    assert found == expected([(r[0], r[1]) for r in documents()])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str)
    assert found == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_tokens_decode_and_empty(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    t = Tokenizer.from_file(PATH)
    rows = bpe.decode(bpe.tokens(docs.where("doc_id < 9"), PATH), PATH).collect()
    texts = {r[0]: r[1] for r in documents()[:9]}
    for r in rows:
        assert r.ids == t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded == t.decode(r.ids, skip_special_tokens=False)
    assert bpe.digests(docs.where("false"), PATH).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_take_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    assert not bpe.splits_words(bpe.source_of(path)) and bpe.splits_words(bpe.source_of(PATH))
    docs = spark.createDataFrame(documents(), SCHEMA).where("doc_id != 18")
    found = sorted(map(tuple, bpe.digests(docs, path, block_bytes=5000).collect()), key=str)
    assert found == expected([(r.doc_id, r.text) for r in docs.collect()], path)
    rows = bpe.decode(bpe.tokens(docs, path).unionByName(spark.createDataFrame([(77, None)], "doc_id long, ids array<int>")), path).collect()
    assert sorted(str((r.doc_id, r.decoded)) for r in rows if r.doc_id != 77) == sorted(str((r.doc_id, r.text or "")) for r in docs.collect())
    assert [r.decoded for r in rows if r.doc_id == 77] == [None]


def test_clashing_names(spark):
    docs = spark.createDataFrame(documents()[:9], SCHEMA).withColumnsRenamed({"lang": "block", "source": "key", "n_chars": "word"})
    assert sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str) == expected([r[:2] for r in documents()[:9]])


def test_codec():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (2, 300, 70_000, 1 << 25, 1 << 32):
            v = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            control, data = codec.pack(v)
            assert len(control) == -(-n // 4)
            assert np.array_equal(codec.unpack(control, data, n), v)
    random.seed(0)
