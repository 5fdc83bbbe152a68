"""Splitting texts into words inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Bytes of text that are split at once.
SLICE_BYTES = 4 << 20


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words, and all words one after the other; null texts have none.

    Arrow's ASCII white space is what the contracts call white space: 0x20 and 0x09 to 0x0D.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    ends, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    full = pc.not_equal(words, "")
    count = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    if count[-1] != len(words):
        words = words.filter(full)
    return count[ends - ends[0]], words


def coded_words(texts: pa.Array, prepare=None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets, a code for every word, and the distinct words that the codes stand for, in order of first occurrence.

    prepare changes texts before they are split. Texts are split a slice at a time, so copies of them stay small.
    """
    offsets, parts, total = [np.zeros(1, dtype=np.int64)], [pa.array([], pa.string())], 0
    for part in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE_BYTES):
        column = part.column("text")
        ends, words = split_words(prepare(column) if prepare else column)
        offsets.append(ends[1:] + total)
        parts.append(words.cast(pa.string()))
        total += len(words)
    coded = pa.chunked_array(parts).dictionary_encode()
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]) if coded.num_chunks else np.zeros(0, dtype=np.int32)
    return np.concatenate(offsets), codes, coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else parts[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int):
    """Slices of a batch whose texts have about limit bytes at most; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
