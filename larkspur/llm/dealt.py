"""Blocks of documents in a written table, and names that meet in buckets: what the two substring operators share.

Slices of the input's partitions become blocks of bounded size, one row each of a table in the shared folder, together
with what was found out about them. Their numbers stand in that table, so nothing depends on a second reading of the
input, and repeated rows, null ids and hot sources fill blocks like any other rows.

A block sends entries (a name, which is a 64-bit hash of a piece of text, and what belongs to it) to buckets, which are
ranges of the names; a bucket sees all entries of its names and replies to the blocks. A name that fills the corpus is
one entry for each block. A block sends at most FAN rows at a time, however large the corpus: where there are more
buckets, rows go to coarse buckets first, and groups of about FAN blocks are then split into the fine ones; replies
come back the same way. So rows grow in proportion to the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow_words import pieces
from larkspur.llm.shared import release, written

#: Bytes of text in a block, about, and entries of a bucket.
BLOCK_BYTES = 4 << 20
BUCKET_ENTRIES = 1_000_000
#: Rows that a block sends at most.
FAN = 1024
ODD = np.uint64(0x9E3779B97F4A7C15)
SENT = "bucket long, block long, entries binary"
SENT_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("entries", pa.binary())])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Blocks(NamedTuple):
    """A table of blocks (block, n, rows, aside), how many there are, the buckets for what they send, and the rows that a
    block sends at most."""

    table: DataFrame
    count: int
    buckets: int
    fan: int

    @property
    def first(self) -> int:
        """Buckets that blocks send to."""
        return min(self.buckets, self.fan)


def tabled(rows: DataFrame, limit: int, found: Callable[[pa.Table], tuple[int, bytes]], tag: str) -> Blocks:
    """Writes rows (with a column text) in blocks of about limit bytes. found: how many names a block will send, about, and what is kept aside."""
    sc = rows.sparkSession.sparkContext
    if rows.rdd.getNumPartitions() < sc.defaultParallelism:
        rows = rows.repartition(sc.defaultParallelism)

    def cut(batches):
        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces(batch, "text", limit):
                table = pa.Table.from_batches([part])
                names, aside = found(table)
                yield pa.RecordBatch.from_pydict({"block": [task << 32 | n], "n": [names], "rows": [frozen(table)], "aside": [aside]}, schema=schema)
                n += 1
                release()

    schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("rows", pa.binary()), ("aside", pa.binary())])
    return sized(written(rows.mapInArrow(cut, "block long, n long, rows binary, aside binary"), tag))


def sized(table: DataFrame) -> Blocks:
    """A written table of blocks, with buckets for the names that they will send."""
    count, names = table.agg(F.count("*"), F.sum("n")).first()
    return Blocks(table, count, max(1, -(-(names or 0) // BUCKET_ENTRIES)), FAN)


def frozen(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def thawed(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


class Kind(NamedTuple):
    """The arrays of entries: "n6" is a name of which the top 6 bytes are sent, others are numpy types; uint32 arrays are
    sent as differences. Of ragged entries the last array is bytes, and the one before it has their sizes."""

    types: tuple[str, ...]
    ragged: bool = False

    def pack(self, arrays: list[np.ndarray]) -> bytes:
        packer, parts = zstandard.ZstdCompressor(level=1), []
        for t, a in zip(self.types, arrays, strict=True):
            if t[0] == "n":
                a = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - int(t[1]) :]
            elif t == "u4":
                a = np.diff(a.astype(np.uint32), prepend=np.uint32(0))
            data = packer.compress(np.ascontiguousarray(a, dtype=None if t[0] == "n" else t).tobytes())
            parts += [len(data).to_bytes(4, "little"), data]
        return b"".join(parts)

    def unpack(self, packed: bytes) -> list[np.ndarray]:
        out, at, unpacker = [], 0, zstandard.ZstdDecompressor()
        for t in self.types:
            n = int.from_bytes(packed[at : at + 4], "little")
            data = unpacker.decompress(packed[at + 4 : at + 4 + n])
            at += 4 + n
            if t[0] == "n":
                width = int(t[1])
                wide = np.zeros((len(data) // width, 8), dtype=np.uint8)
                wide[:, 8 - width :] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
                out.append(wide.reshape(-1).view("<u8"))
            else:
                out.append(np.frombuffer(data, dtype=t))
            if t == "u4":
                out[-1] = np.cumsum(out[-1], dtype=np.uint32)
        return out

    def take(self, arrays: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
        if not self.ragged:
            return [a[at] for a in arrays]
        size = arrays[-2].astype(np.int64)
        start, own = (np.cumsum(size) - size)[at], size[at]
        where = np.repeat(start - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        return [*(a[at] for a in arrays[:-1]), arrays[-1][where]]

    def join(self, parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        empty = [np.zeros(0, dtype=np.uint64 if t[0] == "n" else t) for t in self.types]
        return [np.concatenate(x) for x in zip(empty, *parts, strict=True)]

    def with_blocks(self) -> Kind:
        return Kind(("i8", *self.types), self.ragged)


def cut(names: np.ndarray, width: int) -> np.ndarray:
    """Names with all but their top bytes set to 0."""
    return names & ~np.uint64((1 << 8 * (8 - width)) - 1)


def ranges(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts and ends among ascending names."""
    edges = np.arange(1, buckets, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // buckets)
    return np.concatenate(([0], np.searchsorted(names, edges), [len(names)]))


def sent(kind: Kind, block: int, arrays: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows of SENT for entries in ascending order of their names."""
    edges = ranges(arrays[0], buckets)
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, block, kind.pack(kind.take(arrays, np.arange(edges[b], edges[b + 1])))


def batch_of(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SENT_ARROW, strict=True)], schema=SENT_ARROW)


def table_of(rows) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows)], schema=SENT_ARROW)


def opened(kind: Kind, table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of each entry, and all entries, of rows of SENT."""
    parts = []
    for block, packed in zip(table["block"].to_pylist(), table["entries"].to_pylist(), strict=True):
        if block < 0:
            parts.append(kind.with_blocks().unpack(packed))
        else:
            arrays = kind.unpack(packed)
            parts.append([np.full(len(arrays[0]), block), *arrays])
    first, *arrays = kind.with_blocks().join(parts)
    return first, arrays


def at_buckets(rows: DataFrame, kind: Kind, blocks: Blocks, answer: Callable[[np.ndarray, list[np.ndarray]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """Replies, as rows of SENT, to the entries that were sent; answer sees all entries of a bucket."""
    fan, buckets, together = blocks.fan, blocks.buckets, kind.with_blocks()

    def reply(table: pa.Table) -> pa.Table:
        out = table_of(answer(*opened(kind, table)))
        release()
        return out

    def split(table: pa.Table) -> pa.Table:
        block, arrays = opened(kind, table)
        order = np.argsort(arrays[0], kind="stable")
        arrays = together.take([block, *arrays], order)
        edges = ranges(arrays[1], buckets)
        out = [(b, -1, together.pack(together.take(arrays, np.arange(edges[b], edges[b + 1])))) for b in np.flatnonzero(np.diff(edges)).tolist()]
        return table_of(out)

    if buckets > fan:
        groups = -(-blocks.count // fan)
        rows = rows.groupBy("bucket", F.pmod(F.xxhash64("block"), F.lit(groups))).applyInArrow(split, SENT)
    return rows.groupBy("bucket").applyInArrow(reply, SENT)


def replied(kind: Kind, bucket: int, blocks: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """Rows of SENT, one for each block that entries go to."""
    order = np.argsort(blocks, kind="stable")
    own = blocks[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)])) if len(own) else np.zeros(1, dtype=np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield bucket, int(own[a]), kind.pack(kind.take(arrays, order[a:b]))


def merged(replies: DataFrame, kind: Kind, blocks: Blocks) -> DataFrame:
    """Replies with about as many rows for a block as it may send."""

    def merge(table: pa.Table) -> pa.Table:
        block, arrays = opened(kind, table)
        return table_of(replied(kind, 0, block, arrays))

    if blocks.buckets <= blocks.fan:
        return replies
    groups = -(-blocks.count // blocks.fan)
    return replies.groupBy(F.pmod(F.col("bucket"), F.lit(blocks.fan)), F.pmod(F.xxhash64("block"), F.lit(groups))).applyInArrow(merge, SENT)


NAME = Kind(("n6", "u2"))
TOLD = Kind(("n6", "i4"))


def shared_names(blocks: Blocks, named: Callable[[dict], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """To every block, as rows of SENT of kind TOLD, those of its names that other blocks have too, with the sum of all
    counts. named: the ascending distinct names (their top 6 bytes) of a block's row and a count for each."""
    buckets = blocks.first

    def name(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names, counts = named(row)
                yield batch_of(sent(NAME, row["block"], [names, np.minimum(counts, 65535)], buckets))
                release()

    def meet(block, arrays):
        names, counts = arrays
        found, inverse, times = np.unique(names, return_inverse=True, return_counts=True)
        total = np.minimum(np.bincount(inverse, weights=counts, minlength=len(found)), (1 << 31) - 1).astype(np.int32)
        keep = np.flatnonzero(times[inverse] > 1)
        bucket = int(names[0] >> np.uint64(34)) if len(names) else 0
        yield from replied(TOLD, bucket, block[keep], [names[keep], total[inverse[keep]]])

    return merged(at_buckets(blocks.table.mapInArrow(name, SENT), NAME, blocks, meet), TOLD, blocks)


def told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The names that came back to a block, ascending, and their counts."""
    _, (names, counts) = opened(TOLD, table)
    order = np.argsort(names, kind="stable")
    return names[order], counts[order]


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of values are in the ascending array."""
    if not len(ascending):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:-1]) > 0
