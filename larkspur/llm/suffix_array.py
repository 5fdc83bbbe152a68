"""Suffix-array dedup: bytes of passages that a document of a smaller id has too are removed.

A string of WINDOW bytes belongs to one anchor: the place in it whose GRAM bytes have the least hash, the leftmost of
equals. Equal strings have their anchor at the same place, so only anchors have to be sorted as suffixes, a sparse
suffix array that still sees every repeat of WINDOW bytes. The bytes that an anchor's strings span are its context.

1. Blocks of documents are written as a table with their anchors' places.
2. The hashes of the blocks' anchors meet in buckets; a block learns which of its anchors occur elsewhere.
3. For each shared anchor, a block sends each different context once, with the smallest id that has it. A bucket sorts
   all its contexts as suffixes from the anchor on, with the array of common prefixes; a stack scan over that array
   gives the tree of common-prefix intervals, and the same scan over each interval's suffixes, ordered by what stands to
   their left, tests the diversity of their left extensions: every interval of both is a maximal repeat with all its
   occurrences, not just neighbours; contexts that are equal are one leaf of the tree with several occurrences. Every
   context gets the smallest id that has it and the widest repeat that it shares with a smaller id.
4. The blocks mark the bytes: a document above a context's smallest id loses all its strings there, the document with
   that id what it shares with still smaller ones. `repeat_groups` lists the repeats themselves, by all occurrences.

Copies of a context are one entry of a block, whatever the group's size. Of an anchor that has more than HOT entries
(the edge of a passage that very many documents have) every string of WINDOW bytes is sent as a context of its own,
dealt by its hash, so that no bucket grows with an anchor; the tree takes these as it takes the others.

Defined cases: null and empty texts have no bytes; documents of equal ids don't take from each other; a null id is
larger than any other; matches don't cross documents; extra columns are ignored by `digests` and `repeat_groups` and
pass through `deduplicated`, whatever their names, which cuts at characters: bytes of a character that is only partly
covered stay; repeated rows are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm import dealt
from larkspur.llm.dealt import Kind, among, covered, cut, mixed
from larkspur.llm.shared import release

WINDOW, GRAM = 50, 20
#: Entries up to which an anchor's contexts are sent whole.
HOT = 20_000
#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
NO_ID = np.int64((1 << 63) - 1)
#: A number for every byte, by a fixed rule.
TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * dealt.ODD)
#: Window starts that are worked on at once, and powers of an odd number and of its inverse.
SEGMENT = 1 << 19
POWERS = np.cumprod(np.full(SEGMENT + 256, dealt.ODD, dtype=np.uint64))
INVERSES = np.cumprod(np.full(SEGMENT + 256, pow(int(dealt.ODD), -1, 1 << 64), dtype=np.uint64)) * dealt.ODD
#: Bits of an anchor's hash that its order leaves out.
LOW = np.uint64((1 << 24) - 1)
#: A context: its anchor's name, its number in the block, the smallest id, bytes before the anchor, bytes; SINGLE marks
#: one string of a hot anchor, whose number is the block's contexts plus its start.
CONTEXT = Kind(("n4", "u4", "i8", "u1", "u1", "u1"), ragged=True)
SINGLE = 128
#: What a context is told: its number, the smallest id, bytes shared with smaller ids before the anchor and from it on.
ANSWER = Kind(("u4", "i8", "u1", "u1"))
#: A context's part in a repeat: its number, the repeat's name, bytes before the anchor and from it on.
MEMBER = Kind(("u4", "u8", "u1", "u1"))


class Hashes:
    """Hashes of pieces of a byte array, by sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(TABLE[data] * POWERS[: self.n], dtype=np.uint64)))

    def of(self, at: np.ndarray, size) -> np.ndarray:
        return mixed((self.sums[at + size] - self.sums[at]) * INVERSES[at])


class Block:
    """The bytes of a block's texts, one text after the other, with their anchors; worked on in segments."""

    def __init__(self, table: pa.Table, window: int = WINDOW, gram: int = GRAM, places: np.ndarray | None = None):
        self.table, self.window, self.gram = table, window, gram
        texts = table["text"].combine_chunks().fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]] if len(texts) else whole[:0]
        self.offsets = offsets - offsets[0]
        self.ids = table["key"].combine_chunks().fill_null(int(NO_ID)).to_numpy()
        starts = range(0, len(self.bytes) - window + 1, SEGMENT)
        #: Where anchors stand, ascending.
        self.places = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *map(self._anchors, starts)])) if places is None else places

    def _anchors(self, a: int) -> np.ndarray:
        """The anchors of the windows that start in a segment."""
        window, span = self.window, self.window - self.gram + 1
        hashes = Hashes(self.bytes[a : a + SEGMENT + window - 1])
        m = hashes.n - window + 1
        grams = hashes.of(np.arange(hashes.n - self.gram + 1), self.gram)
        # Least hash with its place in the low bits, over the grams that a window holds.
        least, width = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64), 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least & LOW).astype(np.int64)
        end = np.arange(m) + window
        for cut_at in self.offsets[np.searchsorted(self.offsets, a + 1) : np.searchsorted(self.offsets, a + m + window)] - a:
            end[max(0, cut_at - window + 1) : cut_at] = -1  # windows across a text's end
        return np.unique(anchor[end > 0]) + a

    def pieces(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of pieces of at most 160 bytes."""
        out = np.zeros(len(start), dtype=np.uint64)
        size = np.broadcast_to(np.asarray(size), start.shape)
        at = start // SEGMENT
        for s in np.unique(at).tolist():
            own = np.flatnonzero(at == s)
            a = s * SEGMENT
            out[own] = Hashes(self.bytes[a : a + SEGMENT + 160]).of(start[own] - a, size[own])
        return out

    def contexts(self) -> Block:
        """Finds, per anchor: doc, first and last (starts of its strings), name; and the different contexts, ascending by
        name: entry (an anchor that has it, of the smallest id); of: each anchor's context."""
        span, p = self.window - self.gram + 1, self.places
        grams = self.pieces(p, self.gram)
        self.doc = np.searchsorted(self.offsets, p, side="right") - 1
        first, last = np.maximum(self.offsets[self.doc], p - span + 1), np.minimum(p, self.offsets[self.doc + 1] - self.window)
        same, masked = self.doc[1:] == self.doc[:-1], grams & ~LOW
        left_wins = masked[:-1] <= masked[1:]
        first[1:] = np.where(same & left_wins, np.maximum(first[1:], p[:-1] + 1), first[1:])
        last[:-1] = np.where(same & ~left_wins, np.minimum(last[:-1], first[1:] - 1), last[:-1])
        self.first, self.last = first, last
        # Anchors have small hashes, being least ones: mixed again, their names spread over all buckets.
        self.name = mixed(grams + dealt.ODD)
        context = mixed(self.pieces(first, last - first + self.window) ^ mixed((p - first + 1).astype(np.uint64)))
        order = np.lexsort((self.ids[self.doc], context, self.name))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.name[order][1:] != self.name[order][:-1]) | (context[order][1:] != context[order][:-1])
        self.entry = order[new]
        self.of = np.zeros(len(order), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.least = self.ids[self.doc[self.entry]]
        return self

    def aside(self) -> bytes:
        return PLACES.pack([self.places])

    @classmethod
    def again(cls, row: dict, window: int, gram: int) -> Block:
        """The block of a row of the table of blocks, with its contexts."""
        return cls(dealt.thawed(row["rows"]), window, gram, PLACES.unpack(row["aside"])[0].astype(np.int64)).contexts()


PLACES = Kind(("u4",))


def lcp_intervals(lcp: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of common-prefix intervals, bottom up: lengths (least or more), first and last leaves.

    lcp[i] is what leaves i and i + 1 have in common; the intervals are maximal ranges with at least length in common,
    some neighbours having no more. A stack holds the open intervals; where nothing is open before and after a place,
    its interval opens and closes there.
    """
    deep = np.concatenate(([False], lcp >= least, [False])) if len(lcp) else np.zeros(2, dtype=bool)
    lonely = np.flatnonzero(deep[1:-1] & ~deep[:-2] & ~deep[2:])
    out = [(lcp[lonely].astype(np.int64), lonely, lonely + 1)]
    edge = np.flatnonzero(np.diff(deep.astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a < 2:
            continue
        stack: list[tuple[int, int]] = []
        found = []
        for i, x in enumerate([*lcp[a:b].tolist(), -1], a):
            left = i
            while stack and stack[-1][0] > x:
                length, left = stack.pop()
                found.append((length, left, i))
            if x >= least and (not stack or stack[-1][0] < x):
                stack.append((x, left))
        out.append(tuple(np.array(found, dtype=np.int64).T))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def common(rows: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Bytes that rows of padded matrices have in common from the start."""
    same = np.logical_and.accumulate(rows == other, axis=1).sum(axis=1)
    return np.minimum(same, np.minimum(sizes, other_sizes))


class Leaves:
    """The different contexts of a bucket, sorted as suffixes from the anchor on and then backwards from it."""

    def __init__(self, left: np.ndarray, size: np.ndarray, raw: np.ndarray, window: int, gram: int):
        middle = np.cumsum(size) - size + left
        right_n, width = size - left, window - gram
        keys = np.concatenate((_matrix(raw, middle, right_n, window), (right_n[:, None] + 1).astype(np.uint8), _matrix(raw, middle - 1, left, width, -1), (left[:, None] + 1).astype(np.uint8)), axis=1)
        flat = np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel()
        #: Entries in order, the first of each leaf among them, and each entry's leaf.
        self.order = np.argsort(flat, kind="stable")
        new = np.ones(len(flat), dtype=bool)
        new[1:] = flat[self.order][1:] != flat[self.order][:-1]
        self.firsts = np.flatnonzero(new)
        self.leaf = np.zeros(len(flat), dtype=np.int64)
        self.leaf[self.order] = np.cumsum(new) - 1
        own = keys[self.order[self.firsts]]
        self.right, self.left = own[:, :window], own[:, window + 1 : -1]
        self.right_n, self.left_n = own[:, window].astype(np.int64) - 1, own[:, -1].astype(np.int64) - 1
        self.window, self.gram = window, gram
        by_left = np.argsort(np.ascontiguousarray(own[:, window + 1 :]).view(f"S{width + 1}").ravel(), kind="stable")
        self.left_rank = np.zeros(len(own), dtype=np.int64)
        self.left_rank[by_left] = np.arange(len(own))

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lcp = common(self.right[:-1], self.right_n[:-1], self.right[1:], self.right_n[1:]) if len(self.right) > 1 else np.zeros(0, dtype=np.int64)
        return lcp_intervals(lcp, self.gram)

    def left_common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return common(self.left[a], self.left_n[a], self.left[b], self.left_n[b])

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Maximal repeats of two leaves or more: rows of leaves (as many in each row), and what each row has in common
        before the anchor and from it on."""
        r, lo, hi = self.intervals()
        two = np.flatnonzero(hi - lo == 1)
        x = self.left_common(lo[two], hi[two])
        fit = x + r[two] >= self.window
        yield np.stack((lo[two][fit], hi[two][fit]), axis=1), x[fit], r[two][fit]
        for i in np.flatnonzero(hi - lo > 1).tolist():
            members = np.arange(lo[i], hi[i] + 1)
            members = members[np.argsort(self.left_rank[members])]
            # Left extensions: where they differ a repeat is maximal; each interval is one repeat with all its occurrences.
            x, first, last = lcp_intervals(self.left_common(members[:-1], members[1:]), max(0, self.window - int(r[i])))
            for k in range(len(x)):
                yield members[None, first[k] : last[k] + 1], x[k : k + 1], r[i : i + 1]


def shared_spans(leaves: Leaves, ids: np.ndarray) -> np.ndarray:
    """Per leaf: how far before and from the anchor on it shares strings with leaves of smaller ids."""
    out = np.zeros((len(ids), 2), dtype=np.int64)
    for members, x, r in leaves.repeats():
        own = ids[members]
        row, column = np.nonzero(own > own.min(axis=1, keepdims=True)) if len(members) else (np.zeros(0, int),) * 2
        np.maximum.at(out, members[row, column], np.stack((x[row], r[row]), axis=1))
    return out


def _matrix(raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Padded rows of size bytes each of raw, from start on, forwards or backwards."""
    if not len(raw):
        return np.zeros((len(start), width), dtype=np.uint8)
    at = np.arange(width)
    return np.where(at < size[:, None], raw[np.clip(start[:, None] + step * at, 0, len(raw) - 1)], 0).astype(np.uint8)


def _parsed(docs: DataFrame, key: str, text: str, window: int, gram: int, block_bytes: int, carried: list[str] | None = None) -> dealt.Blocks:
    """The table of blocks: key, text and the carried columns (as c0, c1, ...), and the anchors' places."""
    more = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(carried or [])]
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("key"), docs[f"`{text}`"].cast("string").alias("text"), *more)

    def found(table: pa.Table) -> tuple[int, bytes]:
        block = Block(table, window, gram)
        return len(block.places), block.aside()

    return dealt.tabled(rows, block_bytes, found, "suffix-blocks")


def _shared_contexts(blocks: dealt.Blocks, window: int, gram: int, hot: int) -> DataFrame:
    """Rows of SENT with the contexts of shared anchors."""
    buckets = blocks.first

    def named(row: dict) -> tuple[np.ndarray, np.ndarray]:
        block = Block.again(row, window, gram)
        return np.unique(cut(block.name[block.entry], 6), return_counts=True)

    def gather(table: pa.Table, came: pa.Table) -> pa.Table:
        rows = []
        for row in table.to_pylist():
            block = Block.again(row, window, gram)
            rows += dealt.sent(CONTEXT, row["block"], _contexts(block, *dealt.told(came), hot), buckets)
        release()
        return dealt.table_of(rows)

    return blocks.table.groupBy("block").cogroup(dealt.shared_names(blocks, named).groupBy("block")).applyInArrow(gather, dealt.SENT)


def _contexts(block: Block, names: np.ndarray, counts: np.ndarray, hot: int) -> list[np.ndarray]:
    """Entries of CONTEXT for a block's contexts of anchors that other texts have too."""
    name = block.name[block.entry]
    own, start = np.unique(name, return_index=True)
    order = np.argsort(block.of, kind="stable")  # anchors by context, and so by name
    doc, begins = block.doc[order], np.searchsorted(block.of[order], start)
    local = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins) if len(own) else np.zeros(0, dtype=bool)
    times, short = np.diff(np.append(start, len(name))), cut(own, 6)
    at = np.minimum(np.searchsorted(names, short), max(0, len(names) - 1))
    total = np.where(among(short, names), counts[at] if len(names) else 0, times)
    shared, many = (np.repeat(x, times) for x in (local | among(short, names), total > hot))
    e = np.flatnonzero(shared & ~many)
    a = block.entry[e]
    first, size, left, id_, word, number = block.first[a], block.last[a] - block.first[a] + block.window, block.places[a] - block.first[a], block.least[e], name[e], e
    single = np.flatnonzero((shared & many)[block.of])
    if len(single):  # the strings of hot anchors, each once with the smallest id
        count = block.last[single] - block.first[single] + 1
        begin = np.repeat(block.first[single] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        owner = np.repeat(single, count)
        string = mixed(block.pieces(begin, block.window) ^ block.name[owner])
        order = np.lexsort((block.ids[block.doc[owner]], string))
        order = order[np.concatenate(([True], string[order][1:] != string[order][:-1]))]
        begin, owner = begin[order], owner[order]
        first, size = np.concatenate((first, begin)), np.concatenate((size, np.full(len(begin), block.window)))
        left = np.concatenate((left, (block.places[owner] - begin) | SINGLE))
        id_, word, number = np.concatenate((id_, block.ids[block.doc[owner]])), np.concatenate((word, string[order])), np.concatenate((number, len(name) + begin))
        order = np.argsort(word, kind="stable")
        first, size, left, id_, word, number = (x[order] for x in (first, size, left, id_, word, number))
    where = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return [word, number.astype(np.uint32), id_, left.astype(np.uint8), size.astype(np.uint8), block.bytes[where]]


def _answers(window: int, gram: int):
    """What a bucket tells: the smallest id of a context and its widest repeat with smaller ids, where that says more than the block knows."""

    def answer(block, arrays):
        _, number, id_, left, size, raw = arrays
        if not len(number):
            return
        leaves = Leaves((left & (SINGLE - 1)).astype(np.int64), size.astype(np.int64), raw, window, gram)
        least = np.minimum.reduceat(id_[leaves.order], leaves.firsts)
        spans = shared_spans(leaves, least)[leaves.leaf]
        least = least[leaves.leaf]
        tell = np.flatnonzero((least < id_) | (spans.sum(axis=1) >= window) | (left >= SINGLE))
        yield from dealt.replied(ANSWER, int(number[0]), block[tell], [number[tell], least[tell], spans[tell, 0].astype(np.uint8), spans[tell, 1].astype(np.uint8)])

    return answer


def _removed(block: Block, number: np.ndarray, least: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A flag per byte: is it removed?"""
    n = len(block.entry)
    own, before, after = block.least.copy(), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    whole = number < n
    own[number[whole]], before[number[whole]], after[number[whole]] = least[whole], left[whole], right[whole]
    gone = block.ids[block.doc] > own[block.of]
    x, r = before[block.of], after[block.of]
    start, end = np.where(gone, block.first, block.places - x), np.where(gone, block.last + block.window, block.places + r)
    keep = gone | (x + r >= block.window)
    starts, ends = [start[keep]], [end[keep]]
    if not whole.all():  # strings of hot anchors: all that equal one that the bucket knows
        begin, least = number[~whole].astype(np.int64) - n, least[~whole]
        owner = np.searchsorted(block.places, begin)
        while (wrong := (block.first[owner] > begin) | (block.last[owner] < begin)).any():
            owner = owner + wrong  # the anchor is the first at or after the start whose strings hold it
        string = mixed(block.pieces(begin, block.window) ^ block.name[owner])
        order = np.argsort(string)
        mine = np.flatnonzero(np.isin(block.name, block.name[owner]))
        count = block.last[mine] - block.first[mine] + 1
        at = np.repeat(block.first[mine] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        of = np.repeat(mine, count)
        strings = mixed(block.pieces(at, block.window) ^ block.name[of])
        place = order[np.minimum(np.searchsorted(string[order], strings), len(order) - 1)]
        hit = (string[place] == strings) & (block.ids[block.doc[of]] > least[place])
        starts.append(at[hit])
        ends.append(at[hit] + block.window)
    return covered(np.concatenate(starts), np.concatenate(ends), len(block.bytes))


def removals(docs: DataFrame, finish, schema, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot: int = HOT, carried: list[str] | None = None) -> DataFrame:
    """What finish(Block, removed) yields for every block, as an Arrow table of schema; removed: a flag per byte."""
    blocks = _parsed(docs, key, text, window, gram, block_bytes, carried)

    def end(table: pa.Table, came: pa.Table) -> pa.Table:
        out = [empty]
        for row in table.to_pylist():
            block = Block.again(row, window, gram)
            out.append(finish(block, _removed(block, *dealt.opened(ANSWER, came)[1])).cast(empty.schema))
        release()
        return pa.concat_tables(out)

    fields = docs.sparkSession.createDataFrame([], schema)
    empty = fields.toArrow()
    answers = dealt.merged(dealt.at_buckets(_shared_contexts(blocks, window, gram, hot), CONTEXT, blocks, _answers(window, gram)), ANSWER, blocks)
    return blocks.table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(end, fields.schema)


def repeat_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """repeat, n_bytes, key, start: the maximal repeats of window bytes or more with all their occurrences.

    Repeats are maximal within an anchor's context, so a longer one is told as the repeats of its anchors, which overlap.
    repeat is a hash of the repeat's bytes and of the anchor's place in them; a repeat occurs twice at least. All that
    two texts share is told, with the occurrences that one of them has more; what one text repeats alone may be left out.
    """
    blocks = _parsed(docs, key, text, window, gram, block_bytes)

    def answer(block, arrays):
        _, number, _, left, size, raw = arrays
        if not len(number):
            return
        leaves = Leaves((left & (SINGLE - 1)).astype(np.int64), size.astype(np.int64), raw, window, gram)
        times = np.diff(np.append(leaves.firsts, len(number)))
        groups = [(m, x[i], r[i]) for rows, x, r in leaves.repeats() for i, m in enumerate(rows)]
        groups += [(np.array([i]), leaves.left_n[i], leaves.right_n[i]) for i in range(len(times))]
        for members, x, r in groups:
            i = members[0]
            name = hashlib.blake2b(leaves.left[i, :x][::-1].tobytes() + b"\0" + leaves.right[i, :r].tobytes() + bytes((int(x),)), digest_size=8).digest()
            own = np.concatenate([leaves.order[leaves.firsts[m] : leaves.firsts[m] + times[m]] for m in members])
            n = len(own)
            yield from dealt.replied(MEMBER, int(number[0]), block[own], [number[own], np.full(n, np.frombuffer(name, dtype=np.uint64)[0]), np.full(n, x, dtype=np.uint8), np.full(n, r, dtype=np.uint8)])

    def end(table: pa.Table, came: pa.Table) -> pa.Table:
        out = []
        for row in table.to_pylist():
            block = Block.again(row, window, gram)
            number, name, x, r = dealt.opened(MEMBER, came)[1]
            anchors = np.argsort(block.of, kind="stable")
            edges = np.searchsorted(block.of[anchors], np.arange(len(block.entry) + 1))
            for k, i in enumerate(number.tolist()):
                own = anchors[edges[i] : edges[i + 1]] if i < len(block.entry) else _equal_strings(block, i - len(block.entry))
                at = block.places[own] - int(x[k])
                doc = block.doc[own]
                out.append(pa.table({
                    "repeat": pa.array(np.full(len(own), name[k]).view(np.int64)), "n_bytes": pa.array(np.full(len(own), int(x[k]) + int(r[k]), dtype=np.int64)),
                    "key": block.table["key"].combine_chunks().take(pa.array(doc)), "start": pa.array(at - block.offsets[doc]),
                }))
        return pa.concat_tables([empty, *out])

    fields = docs.sparkSession.createDataFrame([], "repeat long, n_bytes long, key long, start long")
    empty = fields.toArrow()
    members = dealt.at_buckets(_shared_contexts(blocks, window, gram, hot), CONTEXT, blocks, answer)
    found = blocks.table.groupBy("block").cogroup(members.groupBy("block")).applyInArrow(end, fields.schema).distinct()
    return found.join(found.groupBy("repeat").count().where("count > 1").select("repeat"), "repeat", "left_semi")


def _equal_strings(block: Block, begin: int) -> np.ndarray:
    """Anchors of the strings that equal the one at begin."""
    string = block.bytes[begin : begin + block.window].tobytes()
    owner = int(np.flatnonzero((block.first <= begin) & (block.last >= begin))[0])
    shift = int(block.places[owner]) - begin
    same = np.flatnonzero(block.name == block.name[owner])
    fit = (block.first[same] <= block.places[same] - shift) & (block.places[same] - shift <= block.last[same])
    return np.array([a for a in same[fit].tolist() if block.bytes[block.places[a] - shift :][: block.window].tobytes() == string], dtype=np.int64)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def digests(docs: DataFrame, **options) -> DataFrame:
    """Per document: its bytes, how many are removed in how many runs, and a digest of what is kept."""

    def finish(block, removed):
        rows = []
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
            own = removed[a:b]
            rows.append((b - a, int(own.sum()), len(_runs(own)[0]), hashlib.sha256(block.bytes[a:b][~own].tobytes()).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([block.table["key"].combine_chunks(), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removals(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **options)


def whole_characters(data: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """The flags of bytes whose whole UTF-8 character is removed."""
    if not len(data):
        return removed
    lead = (data & 0xC0) != 0x80
    return np.logical_and.reduceat(removed, np.flatnonzero(lead))[np.cumsum(lead) - 1]


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """docs without the repeated bytes of their texts, in whole characters; n_chars is counted anew, null texts stay."""
    names, schema = docs.columns, docs.schema
    others = [c for c in names if c not in (key, text, n_chars)]

    def finish(block, removed):
        removed = whole_characters(block.bytes, removed)
        texts: list[str | None] = []
        null = block.table["text"].combine_chunks().is_null().to_pylist()
        for a, b, no in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), null, strict=True):
            texts.append(None if no else block.bytes[a:b][~removed[a:b]].tobytes().decode())
        made = {key: block.table["key"], text: pa.array(texts, pa.string()), n_chars: pa.array([None if t is None else len(t) for t in texts], pa.int64())}
        made |= {c: block.table[f"c{i}"] for i, c in enumerate(others)}
        return pa.table([made[c] for c in names], names=names)

    return removals(docs, finish, schema, key, text, carried=others, **options)
