"""Substring dedup by recompression: words that repeat in windows of WINDOW words are removed, everywhere.

Recompression names runs of equal symbols and pairs of neighbours, round by round, starting from words. A pair is joined
by the symbols' own bits only, so equal substrings are parsed alike but for their edges; for each symbol it is known on
which range of words its existence depends. If a window occurs twice, all symbols whose range lies inside it occur
twice. A name is a hash of what it stands for; whether it is a global name, one that occurs again somewhere, is found
out by Spark in two rounds over blocks of documents:

1. The blocks' symbols of LOW rounds meet in buckets. A window with a symbol that nobody shares is unique; only stretches
   of words without such windows are worked on any further, as a table of their own.
2. The stretches' symbols of the HIGH rounds meet, built from shared ones only.
3. A window belongs to the highest symbol inside it, the leftmost of these, and goes on only if that is shared; equal
   windows belong to equal symbols at equal places. Windows meet under their symbol's name, joined with a hash of the
   words around it, and are verified by a second, independent hash of all their words: 96 bits tell two windows apart.

Every word in a window that another window of any text equals is removed. What meets is one entry for each different
name of a block, so a group of copies or a common phrase is one entry for each block. All names are dealt by hash, and
windows too, so no bucket grows with a symbol that many have.

Defined cases: null and empty texts have no words; white space is not kept, the kept words are joined by one space;
texts with fewer words than a window lose nothing; repeated rows and copies remove each other; null or tied ids pass
through; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from larkspur.llm import dealt
from larkspur.llm.arrow_words import coded_words
from larkspur.llm.bpe import joined
from larkspur.llm.dealt import Kind, among, covered, cut, mixed
from larkspur.llm.shared import release, written

WINDOW = 35
#: Bytes of text in a block, about.
BLOCK_BYTES = 6 << 20
#: Rounds after which symbols are compared, and the fewest words of a low symbol that is sent. A symbol of r rounds has
#: (4/3)^r words on average and depends on some eight times as many, so windows of 35 words hold symbols of 3 to 5 rounds;
#: a window without one, as in a text that repeats itself all along, belongs to its first word.
LOW, HIGH, LOW_WORDS = 3, (5, 4, 3), 3
#: Bytes of text for one low name, about.
NAME_EVERY = 20
#: A window: its name, its number in the block, and a second hash of its words.
WINDOWS = Kind(("n8", "u4", "i4"))
#: The numbers of windows that occur again.
AGAIN = Kind(("u4",))
#: Words of stretches, and the hashes that they stand for.
WORDS = Kind(("i4", "u8"))
STRETCHES = "block long, n long, rows binary, aside binary"


class Symbols:
    """Words of some texts, one text after the other, and what recompression makes of them."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        self.words, self.starts, self.ends = words, offsets[:-1], offsets[1:]
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.known: dict[tuple[int, ...], dict[int, tuple[np.ndarray, ...]]] = {}

    def parsed(self, rounds: tuple[int, ...]) -> dict[int, tuple[np.ndarray, ...]]:
        """After each of some rounds: the symbols' names, their first words and numbers of words, and the ranges that they depend on."""
        if rounds not in self.known:
            self.known[rounds] = self._parsed(rounds)
        return self.known[rounds]

    def _parsed(self, rounds: tuple[int, ...]) -> dict[int, tuple[np.ndarray, ...]]:
        names, start, end = self.words.copy(), np.arange(len(self.words), dtype=np.int32), np.arange(1, len(self.words) + 1, dtype=np.int32)
        low, high, doc = start.copy(), end.copy(), self.doc.astype(np.int32)
        outside_low, outside_high = (self.starts - 1).astype(np.int32), (self.ends + 1).astype(np.int32)
        out = {0: (names, start, end - start, low, high)}

        def beside(low, high, doc):
            """Ranges that depend on the left and right neighbours too; beyond a text's ends nothing is known."""
            new = np.flatnonzero(doc[1:] != doc[:-1]) + 1
            low, high, old_low, old_high = low.copy(), high.copy(), low, high
            np.minimum(old_low[1:], old_low[:-1], out=low[1:])
            np.maximum(old_high[:-1], old_high[1:], out=high[:-1])
            first, last = np.concatenate(([0], new)), np.concatenate((new, [len(doc)])) - 1
            low[first] = np.minimum(old_low[first], outside_low[doc[first]])
            high[last] = np.maximum(old_high[last], outside_high[doc[last]])
            return low, high

        for r in range(max(rounds)):
            if not len(names):
                out[r + 1] = out[0]
                continue
            # Runs: a maximal run of equal symbols becomes one symbol.
            first = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (doc[1:] != doc[:-1]))))
            low, high = beside(low, high, doc)
            last = np.concatenate((first[1:], [len(names)])) - 1
            length = last - first + 1
            run = names[first]
            run = np.where(length > 1, mixed(run * dealt.ODD + length.astype(np.uint64)), run)
            names, start, end, doc = run, start[first], end[last], doc[first]
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            # Pairs: a left symbol and a right symbol beside it become one symbol.
            left = (mixed(names + np.uint64(r)) & np.uint64(1)).astype(bool)
            pair = np.flatnonzero(left[:-1] & ~left[1:] & (doc[1:] == doc[:-1]))
            low2, high2 = beside(low, high, doc)  # a symbol that stays alone depends on its neighbours
            low2[pair], high2[pair] = np.minimum(low[pair], low[pair + 1]), np.maximum(high[pair], high[pair + 1])
            names, end = names.copy(), end.copy()
            names[pair] = mixed(names[pair] * dealt.ODD + mixed(names[pair + 1]))
            end[pair] = end[pair + 1]
            stay = np.ones(len(names), dtype=bool)
            stay[pair + 1] = False
            names, start, end, low, high, doc = names[stay], start[stay], end[stay], low2[stay], high2[stay], doc[stay]
            out[r + 1] = (names, start, end - start, low, high)
        return {r: out[r] for r in (*rounds, 0)}

    def hashes(self, size: int, salt: int = 0) -> np.ndarray:
        """A hash of the size words from each word on, where there are as many."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        total, width, power, taken = None, 1, mixed(self.words + np.uint64(salt)) if salt else self.words * np.uint64(3) + np.uint64(1), 0
        for bit in range(size.bit_length()):  # windows of 1, 2, 4, ... words are put together
            if size >> bit & 1:
                part = power[taken : taken + n]
                total = part.copy() if total is None else mixed(total * dealt.ODD + part)
                taken += width
            if size >> (bit + 1):
                power = mixed(power[:-width] * dealt.ODD + power[width:])
                width *= 2
        return total

    def windows(self, size: int) -> np.ndarray:
        """Where windows of size words start."""
        n = max(0, len(self.words) - size + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n else np.zeros(0, dtype=np.int64)

    def owners(self, at: np.ndarray, size: int, rounds: tuple[int, ...], shared: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The symbol that each window belongs to: its name joined with its place and level; and whether that is shared
        (shared has the names of the highest rounds; single words count as shared)."""
        name, known = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=bool)
        left = np.arange(len(at))
        parsed = self.parsed(rounds)
        for r in (*rounds, 0):
            names, start, _, low, high = parsed[r]
            k = np.searchsorted(low, at[left])  # ranges ascend: the leftmost that starts inside the window
            fit = k < len(names)
            k = np.minimum(k, max(0, len(names) - 1))
            if len(names):
                fit &= high[k] <= at[left] + size
            own, of = left[fit], k[fit]
            name[own] = mixed(names[of] ^ mixed((start[of] - at[own]).astype(np.uint64) * dealt.ODD + np.uint64(r + 1))) if len(own) else 0
            known[own] = among(cut(names[of], 6), shared) if r and shared is not None else True
            left = left[~fit]
        return name, known


class Block(Symbols):
    """The words of a block's texts."""

    def __init__(self, table: pa.Table, hashed: bool = True):
        from xxhash import xxh64_intdigest

        self.table = table
        offsets, self.codes, self.distinct = coded_words(table["text"].combine_chunks())
        words = np.zeros(len(self.codes), dtype=np.uint64)
        if hashed and len(self.codes):
            words = np.array([xxh64_intdigest(w) for w in self.distinct.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)[self.codes]
        super().__init__(words, offsets)

    def stretches(self, window: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of stretches of words that have a window each, all of whose low symbols are shared."""
        found, _, size, low, high = self.parsed((LOW,))[LOW]
        big = size >= LOW_WORDS
        found, low, high = cut(found[big], 6), low[big], high[big]
        own, inverse, times = np.unique(found, return_inverse=True, return_counts=True)
        alone = ~((times > 1) | among(own, names))[inverse] & (high - low <= window) if len(own) else np.zeros(0, dtype=bool)
        at, m = self.windows(window), len(self.words)
        # A window from high - window to low holds the symbol and all it depends on.
        unique = covered(np.maximum(high[alone] - window, 0), np.maximum(low[alone] + 1, 0), m + 1)
        at = at[~unique[at]]
        flags = covered(at, at + window, m)
        edge = np.concatenate(([True], self.doc[1:] != self.doc[:-1])) if m else np.zeros(0, dtype=bool)
        start = np.flatnonzero(flags & (edge | np.concatenate(([True], ~flags[:-1]))))
        end = np.flatnonzero(flags & np.concatenate((edge[1:] | ~flags[1:], [True]))) + 1
        return start, end


def _low(block: Block) -> np.ndarray:
    names, _, size, _, _ = block.parsed((LOW,))[LOW]
    return np.unique(cut(names[size >= LOW_WORDS], 6))


def _high(row: dict) -> tuple[Symbols, np.ndarray]:
    """The stretches of a row of their table, and where they start in their block."""
    table = dealt.thawed(row["rows"])
    codes, hashes = WORDS.unpack(row["aside"])
    return Symbols(hashes[codes], np.concatenate(([0], np.cumsum(table["size"].to_numpy())))), table["start"].to_numpy()


def _high_names(symbols: Symbols, window: int) -> np.ndarray:
    """The names of high symbols that some window holds."""
    found = [names[high - low <= window] for r, (names, _, _, low, high) in symbols.parsed(HIGH).items() if r]
    return np.unique(cut(np.concatenate(found), 6))


def _numbered(symbols: Symbols, window: int, shared: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """All windows by their names: places, names, second hashes, whether their symbols are shared, their order by name
    and second hash, and which of them are new in it: the new ones are numbered."""
    at = symbols.windows(window)
    owner, known = symbols.owners(at, window, HIGH, shared)
    names = mixed(owner * dealt.ODD + symbols.hashes(window)[at])
    seconds = (symbols.hashes(window, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = np.lexsort((seconds, names))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (names[order][1:] != names[order][:-1]) | (seconds[order][1:] != seconds[order][:-1])
    return at, names, seconds, known, order, new


def _stretched(blocks: dealt.Blocks, window: int) -> dealt.Blocks:
    """The table of stretches: per block where they start and their words' hashes."""

    def narrow(table: pa.Table, came: pa.Table) -> pa.Table:
        rows = []
        names, _ = dealt.told(came)
        for row in table.to_pylist():
            block = Block(dealt.thawed(row["rows"]))
            start, end = block.stretches(window, names)
            size = end - start
            inside = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            used, codes = np.unique(block.codes[inside], return_inverse=True)
            hashes = np.zeros(len(block.distinct), dtype=np.uint64)
            hashes[block.codes] = block.words
            found = pa.table({"start": pa.array(start, pa.int64()), "size": pa.array(size, pa.int64())})
            rows.append((row["block"], int(size.sum()), dealt.frozen(found), WORDS.pack([codes, hashes[used]])))
        release()
        return pa.Table.from_pylist([dict(zip(("block", "n", "rows", "aside"), r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("rows", pa.binary()), ("aside", pa.binary())])
    low = dealt.shared_names(blocks, lambda row: ((names := _low(Block(dealt.thawed(row["rows"])))), np.ones(len(names), dtype=np.int64)))
    table = written(blocks.table.groupBy("block").cogroup(low.groupBy("block")).applyInArrow(narrow, STRETCHES), "stretches")
    return dealt.sized(table)


def repeats(docs: DataFrame, finish, schema: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What finish(Block, removed) yields for every block, as an Arrow table of schema; removed: a flag per word."""
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("key"), docs[f"`{text}`"].cast("string").alias("text"))
    blocks = dealt.tabled(rows, block_bytes, lambda table: ((pc.sum(pc.binary_length(table["text"])).as_py() or 0) // NAME_EVERY, b""), "words")
    stretches = _stretched(blocks, window)
    high = dealt.shared_names(stretches, lambda row: ((names := _high_names(_high(row)[0], window)), np.ones(len(names), dtype=np.int64)))
    buckets = stretches.first

    def offer(table: pa.Table, came: pa.Table) -> pa.Table:
        out = []
        shared, _ = dealt.told(came)
        for row in table.to_pylist():
            symbols, _ = _high(row)
            at, names, seconds, known, order, new = _numbered(symbols, window, np.union1d(shared, _high_names_twice(symbols, window)))
            keep = np.flatnonzero(known[order[new]])  # equal windows have equal symbols
            first = order[new][keep]
            out += dealt.sent(WINDOWS, row["block"], [names[first], keep.astype(np.uint32), seconds[first]], buckets)
        release()
        return dealt.table_of(out)

    def meet(block, arrays):
        names, number, seconds = arrays
        order = np.lexsort((seconds, names))
        same = (names[order][1:] == names[order][:-1]) & (seconds[order][1:] == seconds[order][:-1])
        again = np.zeros(len(names), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        keep = np.flatnonzero(again)
        yield from dealt.replied(AGAIN, int(names[0] >> np.uint64(34)) if len(names) else 0, block[keep], [number[keep]])

    def end(table: pa.Table, came: pa.Table) -> pa.Table:
        out = [empty]
        kinds = came["kind"].to_pylist()
        for row in table.to_pylist():
            block = Block(dealt.thawed(row["rows"]), hashed=False)
            removed = np.zeros(len(block.codes), dtype=bool)
            for r in came.filter(pa.array([k == "stretches" for k in kinds], pa.bool_())).to_pylist():
                symbols, start = _high(r)
                at, _, _, _, order, new = _numbered(symbols, window)
                times = np.diff(np.append(np.flatnonzero(new), len(order)))
                own = times > 1
                parts = [AGAIN.unpack(x["rows"])[0] for x in came.filter(pa.array([k == "again" for k in kinds], pa.bool_())).to_pylist()]
                own[AGAIN.join([[p] for p in parts])[0]] = True
                hit = at[order[np.repeat(own, times)]]
                hit = hit + np.repeat(start - symbols.starts, symbols.ends - symbols.starts)[hit]
                removed |= covered(hit, hit + window, len(removed))
            out.append(finish(block, removed).cast(empty.schema))
        release()
        return pa.concat_tables(out)

    fields = docs.sparkSession.createDataFrame([], schema)
    empty = fields.toArrow()
    offered = stretches.table.groupBy("block").cogroup(high.groupBy("block")).applyInArrow(offer, dealt.SENT)
    again = dealt.merged(dealt.at_buckets(offered, WINDOWS, stretches, meet), AGAIN, stretches)
    came = stretches.table.selectExpr("block", "'stretches' AS kind", "rows", "aside").unionByName(again.selectExpr("block", "'again' AS kind", "entries AS rows", "null AS aside"))
    return blocks.table.groupBy("block").cogroup(came.groupBy("block")).applyInArrow(end, fields.schema)


def _high_names_twice(symbols: Symbols, window: int) -> np.ndarray:
    """High names that a block itself has twice, in one round: a symbol that stays alone keeps its name in later ones."""
    out = [np.zeros(0, dtype=np.uint64)]
    for r, (names, _, _, low, high) in symbols.parsed(HIGH).items():
        if r:
            own, times = np.unique(cut(names[high - low <= window], 6), return_counts=True)
            out.append(own[times > 1])
    return np.unique(np.concatenate(out))


def _kept(block: Block, removed: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Kept words of each text joined by spaces, and its numbers of words and of removed words."""
    n = block.ends - block.starts
    gone = np.concatenate(([0], np.cumsum(removed)))
    gone = gone[block.ends] - gone[block.starts]
    words = block.distinct.take(pa.array(block.codes[~removed])) if len(block.codes) else pa.array([], pa.large_string())
    return joined(words, n - gone), n, gone


def digests(docs: DataFrame, **options) -> DataFrame:
    """Per document: its words, how many are removed, and a digest of what is kept."""

    def finish(block, removed):
        kept, n, gone = _kept(block, removed)
        shas = [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in kept.cast(pa.large_binary())]
        return pa.table({"doc_id": block.table["key"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return repeats(docs, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", **options)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """Per document: its id, and its kept words joined by spaces."""

    def finish(block, removed):
        return pa.table({"doc_id": block.table["key"], "text": pc.cast(_kept(block, removed)[0], pa.string())})

    return repeats(docs, finish, "doc_id long, text string", **options)
