"""Benchmark decontamination: a broadcast hash set of test n-grams against every window of the training texts.

The windows of the benchmark become a table of 64-bit window hashes with the words themselves for verification. It is
broadcast only in blocks of at most MAX_BLOCK_WORDS benchmark words; a benchmark beyond that is scanned in several
blocks, each pass adding its hits to the row, so the broadcast never grows with either table. Documents are scanned in
place: no shuffle, nothing grouped, so hot sources and common passages move nothing.

Defined cases: null or empty texts have no words and no hits; an item with fewer words than a window is one window of
its own length, an item without words is none; a null item_id is the string "null"; items are counted by their ids, and
repeated rows are scanned one by one; empty tables give no hits or no rows; other columns pass through `decontaminated`, working columns start
with `_lk_`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import release, written

WINDOW = 10
#: Words of the benchmark that one broadcast may hold; about 100 bytes each in a worker.
MAX_BLOCK_WORDS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
# The words: after A-Z are lower-cased, every ASCII character but digits and a-z separates words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Windows:
    """The windows of a block of benchmark items, by length and hash."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.code: dict[bytes, int] = {}
        self.items = [k for k, _ in items]
        found: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for n, (_, words) in enumerate(items):
            ids = np.array([self.code.setdefault(w, len(self.code) + 1) for w in words], dtype=np.int64)
            size = min(width, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners = found[size][ids[i : i + size].tobytes()]
                if not owners or owners[-1] != n:
                    owners.append(n)
        self.by_size = {}
        for size, grams in found.items():
            keys = np.frombuffer(b"".join(grams), dtype=np.int64).reshape(-1, size)
            self.by_size[size] = (np.unique(rolled(keys.T)), dict(grams))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        known = np.fromiter(map(self.code.get, words, [0] * len(words)), dtype=np.int64, count=len(words))
        hit, items = np.zeros(len(words) + 1, dtype=np.int32), set()
        gaps = np.concatenate(([0], np.cumsum(known == 0)))
        for size, (hashes, grams) in self.by_size.items():
            if size > len(words):
                continue
            at = np.flatnonzero(gaps[size:] == gaps[:-size])  # windows of benchmark words only
            if len(at):
                at = at[np.isin(rolled([known[at + j] for j in range(size)]), hashes)]
            for i in at.tolist():
                if (owners := grams.get(known[i : i + size].tobytes())) is not None:  # verified word by word
                    items.update(owners)
                    hit[i] += 1
                    hit[i + size] -= 1
        return np.cumsum(hit[:-1]) > 0, items


def rolled(columns) -> np.ndarray:
    """A polynomial hash of equally long windows, given column by column."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = (out + c.astype(np.uint64)) * BASE
            out ^= out >> np.uint64(29)
    return out


def _blocks(benchmark: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, in blocks of at most limit words each (one item at least), read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.col(text).alias("t")).toLocalIterator():
        words = normal_words(row.t)
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((row.k, words))
        size += len(words)
    yield block


def scanned(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "item_id", item_text: str = "text",
    width: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS, keep_text: bool = True,
) -> DataFrame:
    """docs with _lk_n (words), _lk_hits (a bit per word), _lk_n_hit and _lk_items (ids of items that occur, sorted)."""
    spark = docs.sparkSession
    out = docs.withColumns(
        {"_lk_n": F.lit(0).cast("long"), "_lk_hits": F.lit(b""), "_lk_n_hit": F.lit(0).cast("long"), "_lk_items": F.array().cast("array<string>")}
    )
    blocks = _blocks(benchmark, key, item_text, max_block_words)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        names = [c for c in out.columns if keep_text or following is not None or c != text]
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared, names=names):
            windows = Windows(shared.value, width)
            for batch in batches:
                rows: dict[str, list] = {"_lk_n": [], "_lk_hits": [], "_lk_n_hit": [], "_lk_items": []}
                for t, old, had in zip(*(batch.column(c).to_pylist() for c in (text, "_lk_hits", "_lk_items")), strict=True):
                    words = normal_words(t)
                    hit, items = windows.scan(words)
                    if old:
                        hit |= np.unpackbits(np.frombuffer(old, dtype=np.uint8), count=len(words)).astype(bool)
                    n = int(hit.sum())
                    rows["_lk_n"].append(len(words))
                    rows["_lk_hits"].append(np.packbits(hit).tobytes() if n else b"")
                    rows["_lk_n_hit"].append(n)
                    rows["_lk_items"].append(sorted({*had, *(windows.items[i] for i in items)}))
                types = {"_lk_n": pa.int64(), "_lk_hits": pa.binary(), "_lk_n_hit": pa.int64(), "_lk_items": pa.list_(pa.string())}
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], types[c]) if c in rows else batch.column(c) for c in names], names=names)
            release()

        out = out.mapInArrow(scan, out.select(*[F.col(f"`{c}`") for c in names]).schema)
        if following is not None:  # the pass is done: its windows leave the executors
            out = written(out, "decontaminate")
            shared.destroy()
        block = following
    return out


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: its words, its hit words, and the items whose windows occur in it."""
    found = scanned(docs.select("doc_id", "text"), benchmark, keep_text=False)
    return found.select(
        "doc_id", F.col("_lk_n").alias("n_words"), F.col("_lk_n_hit").alias("n_hit"), F.size("_lk_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_lk_items", ","), 256).alias("items_sha256"), (F.col("_lk_n_hit") > 0).alias("contaminated"),
    )


def without_hits(text: str | None, bits: bytes) -> str | None:
    """A text without its hit words and what stands between two of them."""
    if text is None or not bits:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    word = np.concatenate(([False], np.frombuffer(raw.translate(NORMAL), dtype=np.uint8) != 32, [False])).astype(np.int8)
    starts, ends = np.flatnonzero(np.diff(word) == 1), np.flatnonzero(np.diff(word) == -1)
    hit = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(starts)).astype(bool)
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    kept, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True):
        kept.append(raw[at : starts[a]])
        at = ends[b]
    return (b"".join(kept) + raw[at:]).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", mode: str = "documents", n_chars: str = "n_chars", **options) -> DataFrame:
    """docs without its contaminated documents (mode "documents") or without the hit spans of their texts ("spans")."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_lk_c{i}") for i, c in enumerate(names)])
    found = scanned(inner, benchmark, f"_lk_c{names.index(text)}", **options)
    if mode == "documents":
        return found.where("_lk_n_hit = 0").select(*[F.col(f"_lk_c{i}").alias(c) for i, c in enumerate(names)])
    column, out = f"_lk_c{names.index(text)}", [f"_lk_c{i}" for i in range(len(names))]

    def cut(batches):
        for batch in batches:
            new = pa.array([without_hits(*x) for x in zip(batch.column(column).to_pylist(), batch.column("_lk_hits").to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == column else batch.column(c) for c in out], names=out)

    spans = found.mapInArrow(cut, found.select(*out).schema).toDF(*names)
    return spans.withColumn(n_chars, F.length(text).cast("long")) if n_chars in names else spans
