"""BPE encoding and decoding through a table of distinct words.

Documents are split into words at ASCII white space, which no token crosses. Every block of documents (a slice of an
input partition) names its distinct words by places; the words of all blocks are dealt by word and sorted, each
distinct word is encoded once, and the ids go back to the blocks, where they are joined to the words by place. What is
shuffled is each block's distinct words and the documents as places, not the text or every occurrence. Decoding looks
the ids up in the table of pieces, which is bounded by the vocabulary and at hand in every worker; a shuffle of single
ids to join them with so small a table would only cost.

Splitting into words is known to be right for one way of normalising, splitting and decoding (SPLITS_WORDS). With a
tokenizer that works otherwise a whole text takes the place of a word: each distinct text is encoded once, by the
library, and decoded by it.

A word's rows are at most one per block, so no key is hot: a word that fills the corpus has as many rows as any word
that every block holds. A block is bounded by BLOCK_BYTES of text, or one text that is longer.

The input is read twice; it must give the same rows in the same partitions both times, as files do. A block whose two
readings differ finds no ids and ends the job with an error.

Defined cases: null and empty texts have no tokens; null, repeated or tied ids are passed on row by row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from larkspur.llm import codec
from larkspur.llm.arrow_words import coded_words, pieces
from larkspur.llm.shared import release

#: Bytes of text in a block.
BLOCK_BYTES = 32 << 20
#: Words whose strings are put together at once.
STEP = 250_000
#: Pieces that a worker remembers.
REMEMBERED = 200_000

# Words of these characters need no normalisation but lower case: they are stable under NFC, and every change between
# letters, digits and the rest is a split of the tokenizer (not so with ' and <).
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-;=-@\[-`{-~]*")
SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


# The settings of a tokenizer, all but vocabulary and merges, under which no token crosses white space.
SPLITS_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None, "decoder": None,
}


def splits_words(source: str) -> bool:
    """Is this a tokenizer whose texts may be split into words?"""
    settings = json.loads(source)
    return all(settings.get(k) == v for k, v in SPLITS_WORDS.items()) and all(t["special"] and t["content"].startswith("<|") for t in settings["added_tokens"])


class WordEncoder:
    """Encodes words (or whole texts, see splits_words) by a tokenizer of the tokenizers library."""

    loaded: dict[str, WordEncoder] = {}

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.by_word = splits_words(source)
        self.whole = Tokenizer.from_str(source)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        # The library's byte alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = [chr(b) if b in own else chr(next(rest)) for b in range(256)]
        self.known: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, source: str) -> WordEncoder:
        """One for each worker process."""
        key = hashlib.sha1(source.encode()).hexdigest()
        if key not in cls.loaded:
            cls.loaded[key] = cls(source)
        return cls.loaded[key]

    def piece(self, piece: str) -> list[int]:
        if (ids := self.known.get(piece)) is None:
            text = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            ids = [t.id for t in self.model.tokenize(text)]
            if len(self.known) < REMEMBERED:
                self.known[piece] = ids
        return ids

    def encode(self, words: Iterable[str]) -> list[list[int]]:
        """The ids of each word."""
        if not self.by_word:
            return [e.ids for e in self.whole.encode_batch_fast(list(words), add_special_tokens=False)]
        out: list[list[int]] = []
        hard, places = [], []
        for word in words:
            if PLAIN.fullmatch(word):
                found = SPLIT.findall(word.lower())
                out.append(self.piece(found[0]) if len(found) == 1 else [i for p in found for i in self.piece(p)])
            else:
                hard.append(word)
                places.append(len(out))
                out.append([])
        if hard:
            for place, e in zip(places, self.whole.encode_batch_fast(hard, add_special_tokens=False), strict=True):
                out[place] = e.ids
        return out

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """What runs of ids, sizes[i] of them in the i-th, stand for."""
        if self.by_word:
            return joined(self.pieces().take(pa.array(ids)), sizes)
        ends = np.cumsum(sizes)
        return pa.array(self.whole.decode_batch([ids[a:b].tolist() for a, b in zip(ends - sizes, ends, strict=True)], skip_special_tokens=False), pa.string())

    def pieces(self) -> pa.Array:
        """The piece of every id."""
        vocabulary = {i: p for p, i in self.whole.get_vocab(with_added_tokens=True).items()}
        return pa.array([vocabulary.get(i, "") for i in range(max(vocabulary, default=-1) + 1)], pa.string())


#: What keeps a text as it is: control strings, which are matched before lower case, and combining marks, which NFC joins before it.
AS_IT_IS = r"<\||[\x{0300}-\x{036F}]"
#: A letter followed by punctuation at a word's end; the tokenizer splits there too.
ENDED = r"([A-Za-z])([.,;:!?]+)(\s)"


def simplified(texts: pa.Array) -> pa.Array:
    """Texts with the same tokens and fewer distinct words: in lower case, the punctuation after words set apart."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    plain = pc.ascii_lower(pc.replace_substring_regex(texts, ENDED, r"\1 \2\3"))  # lower case last: it needs an array of its own
    return pc.if_else(pc.match_substring_regex(texts, AS_IT_IS), texts, plain)


def source_of(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def whole_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As coded_words, with every text as one word."""
    coded = pc.fill_null(texts, "").cast(pa.large_string()).dictionary_encode()
    return np.arange(len(texts) + 1), coded.indices.to_numpy(), coded.dictionary


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int, by_word: bool) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Key, rows, word offsets, places and distinct words of each block; the key tells other contents apart."""
    n, task = 0, TaskContext.get().partitionId()
    for batch in batches:
        for part in pieces(batch, "text", limit):
            offsets, places, words = coded_words(part.column("text"), simplified) if by_word else whole_texts(part.column("text"))
            sum32 = zlib.crc32(words.cast(pa.large_binary()).buffers()[2] or b"") if len(words) else 0
            yield sum32 << 31 | (task & 0xFFFFF) << 11 | n & 0x7FF, part, offsets, places, words
            n += 1
            release()


def gathered_ids(docs: DataFrame, source: str, limit: int) -> DataFrame:
    """block, places, sizes, ids: the ids of each block's distinct words, packed."""
    spark = docs.sparkSession
    shared, by_word = spark.sparkContext.broadcast(source), splits_words(source)

    def distinct(batches):
        for block, _, _, _, words in blocks_of(batches, limit, by_word):
            yield pa.RecordBatch.from_arrays(
                [words.cast(pa.string()), pa.array(np.full(len(words), block)), pa.array(np.arange(len(words), dtype=np.int32))], names=["word", "block", "place"]
            )

    def encoded(batches):
        encoder, last, last_ids = WordEncoder.of(shared.value), None, None
        for batch in batches:
            column = batch.column("word").dictionary_encode()  # sorted: equal words are neighbours, in one batch or two
            words = column.dictionary.to_pylist()
            again = bool(words) and words[0] == last
            ids = ([last_ids] if again else []) + encoder.encode(words[1:] if again else words)
            if words:
                last, last_ids = words[-1], ids[-1]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat, starts = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), np.cumsum(sizes) - sizes
            blocks, places, code = batch.column("block").to_numpy(), batch.column("place").to_numpy(), column.indices.to_numpy()
            order = np.argsort(blocks, kind="stable")
            cuts = np.flatnonzero(np.diff(blocks[order])) + 1
            rows: dict[str, list] = {"block": [], "places": [], "sizes": [], "ids": []}
            for own in np.split(order, cuts) if len(order) else []:
                size = sizes[code[own]]
                at = np.repeat(starts[code[own]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                for name, value in zip(rows, (int(blocks[own[0]]), places[own].tobytes(), size.astype(np.uint32).tobytes(), flat[at].astype(width).tobytes()), strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("places", "sizes", "ids"))]))
        encoder.known.clear()  # the worker lives on, its next task has other words
        release()

    width = np.uint16 if len(WordEncoder.of(source).pieces()) <= 1 << 16 else np.uint32
    table = docs.mapInArrow(distinct, "word string, block long, place int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(n, "word").sortWithinPartitions("word").mapInArrow(encoded, "block long, places binary, sizes binary, ids binary")


def coded_blocks(docs: DataFrame, limit: int, by_word: bool = True) -> DataFrame:
    """block, keys, offsets, n, control, data, order: each block's documents as places of their words, packed.

    0 stands for a word's first occurrence in the block, as places are given in that order; the words that come again
    are numbered from 1 by falling frequency, and order has their places.
    """

    def coded(batches):
        for block, part, offsets, places, words in blocks_of(batches, limit, by_word):
            count = np.bincount(places, minlength=len(words))
            again = np.flatnonzero(count > 1)
            order = again[np.argsort(-count[again], kind="stable")].astype(np.uint32)
            rank = np.zeros(len(words), dtype=np.uint32)
            rank[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
            numbers = rank[places]
            numbers[first_places(places)] = 0
            control, data = codec.pack(numbers) if len(places) else (b"", b"")
            yield pa.RecordBatch.from_pydict(
                {"block": [block], "keys": [part.column("key").to_pylist()], "offsets": [offsets.astype(np.int64).tobytes()], "n": [len(words)], "control": [control], "data": [data], "order": [order.tobytes()]},
                schema=pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("offsets", pa.binary()), ("n", pa.int32()), *((c, pa.binary()) for c in ("control", "data", "order"))]),
            )

    return docs.mapInArrow(coded, "block long, keys array<long>, offsets binary, n int, control binary, data binary, order binary")


def first_places(places: np.ndarray) -> np.ndarray:
    """Where each new place, which is the largest so far, stands."""
    if not len(places):
        return np.zeros(0, dtype=np.int64)
    most = np.maximum.accumulate(places)
    return np.flatnonzero(np.concatenate(([True], most[1:] > most[:-1])))


def uncoded(row: dict) -> np.ndarray:
    """The places that coded_blocks packed."""
    order = np.frombuffer(row["order"], dtype=np.uint32)
    numbers = codec.unpack(row["control"], row["data"], int(np.frombuffer(row["offsets"], dtype=np.int64)[-1]))
    places = np.concatenate((np.zeros(1, dtype=np.uint32), order))[numbers]
    places[numbers == 0] = np.arange(row["n"], dtype=np.uint32)
    return places


def joined(strings: pa.Array, sizes: np.ndarray, separator: str = " ") -> pa.Array:
    """Runs of strings, sizes[i] of them in the i-th, each joined to one."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), strings), pa.scalar(separator, strings.type))


class BlockIds:
    """A block's distinct words as ids, by place."""

    def __init__(self, table: pa.Table, n: int):
        of = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), dtype=t)
        places, sizes, flat = of("places", np.int32), of("sizes", np.uint32).astype(np.int64), b"".join(table["ids"].to_pylist())
        total = int(sizes.sum())
        flat = np.frombuffer(flat, dtype=np.uint16 if len(flat) == 2 * total else np.uint32)
        order = np.argsort(places)
        if len(places) != n or not np.array_equal(places[order], np.arange(n)):
            raise RuntimeError("the documents changed between two readings; write them to a table first")
        starts = (np.cumsum(sizes) - sizes)[order]
        self.sizes = sizes[order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = flat[np.repeat(starts - self.starts, self.sizes) + np.arange(total)]

    def of(self, places: np.ndarray) -> np.ndarray:
        """The ids of a run of words."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[places] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def encode(docs: DataFrame, tokenizer: str, finish, schema: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What finish(keys, offsets, places, BlockIds, WordEncoder) yields for every block, as Arrow batches of schema.

    Word j of document i is places[offsets[i] + j]; BlockIds gives ids by place.
    """
    source = source_of(tokenizer)
    narrow = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def end(blocks: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            offsets = np.frombuffer(row["offsets"], dtype=np.int64)
            out.append(finish(row["keys"], offsets, uncoded(row), BlockIds(words, row["n"]), WordEncoder.of(shared.value)))
        release()
        return pa.concat_tables(out) if out else empty

    fields = docs.sparkSession.createDataFrame([], schema)
    empty = fields.toArrow()
    return coded_blocks(narrow, block_bytes, splits_words(source)).groupBy("block").cogroup(gathered_ids(narrow, source, block_bytes).groupBy("block")).applyInArrow(end, fields.schema)


def _digest(keys, offsets, places, ids: BlockIds, encoder: WordEncoder) -> pa.Table:
    numbers = pa.array([str(i) for i in range(encoder.whole.get_vocab_size())], pa.string())
    # Ids to pieces, once for each distinct word of the block.
    as_numbers, as_pieces = joined(numbers.take(pa.array(ids.flat)), ids.sizes), encoder.decoded(ids.flat, ids.sizes)
    counts = np.concatenate(([0], np.cumsum(ids.sizes[places])))
    total = counts[offsets[1:]] - counts[offsets[:-1]]
    has_ids = ids.sizes > 0  # a word may have no tokens at all
    shas: tuple[list[str], list[str]] = ([], [])
    first = 0
    while first < len(keys):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, side="right")) - 1)
        own = places[offsets[first] : offsets[last]]
        full = has_ids[own]
        bounds = np.concatenate(([0], np.cumsum(full)))[offsets[first : last + 1] - offsets[first]]
        own = pa.array(own[full])
        for strings, found in zip((as_numbers, as_pieces), shas, strict=True):
            texts = joined(strings.take(own), np.diff(bounds))
            found.extend(hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in texts.cast(pa.large_binary()))
        first = last
    return pa.table({"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array(total, pa.int64()), "ids_sha256": pa.array(shas[0], pa.string()), "decoded_sha256": pa.array(shas[1], pa.string())})


def digests(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Per document: its number of tokens, and digests of its ids and of its decoded text."""
    return encode(docs, tokenizer, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", **options)


def tokens(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Per document: its ids."""

    def finish(keys, offsets, places, ids, _):
        lists = [ids.of(places[a:b]).astype(np.int32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.table({"doc_id": pa.array(keys, pa.int64()), "ids": pa.array(lists, pa.list_(pa.int32()))})

    return encode(docs, tokenizer, finish, "doc_id long, ids array<int>", **options)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """rows (key, ids) with decoded: what the ids stand for; null where there are none."""
    shared = rows.sparkSession.sparkContext.broadcast(source_of(tokenizer))

    def decoded(batches):
        encoder = WordEncoder.of(shared.value)
        for batch in batches:
            lists = batch.column(ids)
            texts = encoder.decoded(lists.flatten().to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(lists.is_null(), None, texts)], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(decoded, rows.withColumn("decoded", rows[ids].cast("string")).schema)
