import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import token_files
from tests.llm.texts import SCHEMA, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("size", [40, 1 << 24])
def test_hard_documents(spark, monkeypatch, size):
    monkeypatch.setattr(token_files, "SHARD_BYTES", size * 50)
    docs = spark.createDataFrame(documents(), SCHEMA)
    found = sorted(map(tuple, token_files.digests(docs, PATH).collect()), key=lambda r: r[1])
    assert found == expected([(r[0], r[1]) for r in documents()])
    assert token_files.digests(docs.where("false"), PATH).collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = sorted(map(tuple, token_files.digests(docs, PATH).collect()), key=lambda r: r[1])
    assert found == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_frames():
    ids = np.random.default_rng(2).zipf(1.3, 5000).clip(0, 49407).astype(np.uint32)
    f = token_files.framed(ids)
    assert np.array_equal(token_files.unframed(f["ranks"], f["control"], f["data"], len(ids)), ids)
    assert len(f["data"]) < 2 * len(ids)
