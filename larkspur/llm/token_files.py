"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are encoded, dealt by ranges of their id into shards and written in ascending order. A shard is a sequence of
frames; a frame holds its documents' ids and lengths, a rank table (its ids by falling frequency, so that the most
frequent 256 ids take one byte), the control bytes and the data bytes. Ranks belong to the frame, so a frame decodes by
itself and the corpus is passed once. Frames are rows of a Parquet table: Spark's own committer puts them in any store,
and a lost executor's shard is written again. Reading back needs the table only.

Shards are dealt by ranges of the id, and of the text's beginning where ids are equal, with bounds from a sample of the ids; every row is written. Frames are bounded by
FRAME_BYTES of text, or one text that is longer.

Defined cases: null and empty texts have only the end id; null ids come first, ties are ordered by text and repeated
rows are kept; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import bpe, codec
from larkspur.llm.arrow_words import coded_words, pieces
from larkspur.llm.shared import new_path, release, text_bytes

FRAME_BYTES = 12 << 20
SHARD_BYTES = 24 << 20
#: Frames up to which their starts, 24 bytes each, are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST_FRAMES = 200_000
#: Distinct words that a worker remembers between batches.
REMEMBERED = 250_000

FRAME = "shard int, frame int, n_ids long, doc_ids array<long>, lengths array<int>, ranks binary, control binary, data binary"


class Remembered:
    """Ids of distinct words, the first REMEMBERED of which are kept from batch to batch."""

    loaded: dict[int, Remembered] = {}

    def __init__(self, encoder: bpe.WordEncoder):
        self.encoder, self.known = encoder, {}

    @classmethod
    def of(cls, encoder: bpe.WordEncoder) -> Remembered:
        if id(encoder) not in cls.loaded:
            cls.loaded[id(encoder)] = cls(encoder)
        return cls.loaded[id(encoder)]

    def encode(self, words: list[str]) -> list[list[int]]:
        out = [self.known.get(w) for w in words]
        new = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(new, self.encoder.encode([words[i] for i in new]), strict=True):
            out[i] = ids
            if len(self.known) < REMEMBERED:
                self.known[words[i]] = ids
        return out


def flat_ids(texts: pa.Array, encoder: bpe.WordEncoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by end_id, and how many each has."""
    offsets, places, words = coded_words(texts) if encoder.by_word else bpe.whole_texts(texts)
    ids = Remembered.of(encoder).encode(words.to_pylist())
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, starts = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), np.cumsum(sizes) - sizes
    n = sizes[places]
    before = np.concatenate(([0], np.cumsum(n)))
    total = before[offsets[1:]] - before[offsets[:-1]]
    words_at = before[:-1] + np.repeat(np.arange(len(total)), np.diff(offsets))  # each text before adds its end id
    out = np.full(int(before[-1]) + len(total), end_id, dtype=np.uint32)
    step = 400_000
    for a in range(0, len(places), step):
        m = n[a : a + step]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(words_at[a : a + step], m) + inner] = flat[np.repeat(starts[places[a : a + step]], m) + inner]
    return out, total + 1


def framed(ids: np.ndarray) -> dict[str, bytes]:
    """Ids as ranks, packed; the rank table goes along."""
    count = np.bincount(ids)
    seen = np.flatnonzero(count)
    by_rank = seen[np.argsort(-count[seen], kind="stable")].astype(np.uint32)
    rank = np.zeros(len(count), dtype=np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = codec.pack(rank[ids])
    return {"ranks": by_rank.tobytes(), "control": control, "data": data}


def unframed(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranks, dtype=np.uint32)[codec.unpack(control, data, n)]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encodes docs and writes their token files to path."""
    source = bpe.source_of(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def frames(batches):
        encoder, n, shard = bpe.WordEncoder.of(shared.value), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces(batch, "text", FRAME_BYTES):
                ids, lengths = flat_ids(part.column("text"), encoder, end_id)
                row = {"shard": shard, "frame": n, "n_ids": len(ids), "doc_ids": part.column("key").to_pylist(), "lengths": lengths} | framed(ids)
                yield pa.RecordBatch.from_pydict({c: [v] for c, v in row.items()}, schema=schema)
                n += 1
                release()

    schema = pa.schema([
        ("shard", pa.int32()), ("frame", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
        *((c, pa.binary()) for c in ("ranks", "control", "data")),
    ])
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    shards = max(1, -(-text_bytes(rows) // SHARD_BYTES))
    # Rows of one id are dealt by their texts' beginnings too, so that an id that many rows have isn't one shard.
    ordered = rows.repartitionByRange(shards, F.col("key").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    ordered.mapInArrow(frames, FRAME).write.parquet(path)


def read(frames: DataFrame) -> DataFrame:
    """Per document of the files, in any order: doc_id, start, n_tokens and ids_crc32."""
    small = frames.select("shard", "frame", "n_ids")
    by_shard = small.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    group = Window.partitionBy(F.expr("shard div 1000")).orderBy("shard")  # two levels: no window holds all shards
    groups = by_shard.groupBy(F.expr("shard div 1000").alias("g")).agg(F.sum("n").alias("gn"))
    before_group = groups.select("g", (F.sum("gn").over(Window.orderBy("g")) - F.col("gn")).alias("g0"))
    before = by_shard.select("shard", F.expr("shard div 1000").alias("g"), (F.sum("n").over(group) - F.col("n")).alias("s0")).join(before_group, "g")
    inside = Window.partitionBy("shard").orderBy("frame")
    starts = small.select("shard", "frame", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("f0")).join(before, "shard").select("shard", "frame", (F.col("g0") + F.col("s0") + F.col("f0")).alias("start"))
    if frames.select("shard").count() <= MAX_BROADCAST_FRAMES:
        starts = F.broadcast(starts)

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lengths = row.column("lengths").flatten().to_numpy().astype(np.int64)
                ids = unframed(*(row.column(c)[0].as_py() for c in ("ranks", "control", "data", "n_ids"))).astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                start = row.column("start")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids").flatten(), pa.array(start + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return frames.join(starts, ["shard", "frame"]).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digests(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the token files of docs and returns what is read from them."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, tokenizer, path, **options)
    return read(spark.read.schema(FRAME).parquet(path))
