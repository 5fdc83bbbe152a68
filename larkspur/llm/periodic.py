"""Periodic runs of words: a text that says the same stretch again and again, found exactly and collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least MIN_LENGTH words
and MIN_TIMES periods long, that no neighbouring word extends. Each text is searched in scales. At a scale, aligned
blocks of a power of two of words are the keys of an Aho-Corasick automaton over integers (pyahocorasick with sequences as
keys; the integers name words or, at larger scales, stretches of words), and the automaton reads the text once. An occurrence of a block at a distance that fits the scale
(1 to 15 words for blocks of 8, B to 2B - 1 for blocks of B from 16 on) is a seed; seeds are extended word by word to
both sides, and stretches that are long enough and have no smaller period are runs. A run of period q always holds an
aligned block of q's scale q words before another occurrence, so none is missed: its length less q is 15 or more for
blocks of 8 and 2B or more for blocks of B.

Two shortcuts skip work, not runs: a block is a key only if each of its words comes again within the scale's distances,
and a seed inside a run whose period divides its distance extends to that very run. So a text of one word repeated costs
n log n. Texts are worked on one by one where they lie: no shuffle, nothing grouped.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; texts of fewer than MIN_LENGTH
words have no runs; rows are searched one by one, so repeated rows and ids give equal rows; an empty table gives an
empty result; a null id is never edited by `planted`; other columns pass through `collapsed`, working columns start with
`_lk_`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow_words import coded_words, pieces
from larkspur.llm.shared import release, words_of

MIN_LENGTH, MIN_TIMES = 24, 3
#: Words of the smallest blocks, which serve all periods below twice as many.
LEAST_BLOCK = 8
#: Bytes of text that are split and searched at once.
SLICE_BYTES = 2 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FAR = np.int64(1) << 62


def scales(n: int) -> Iterator[tuple[int, int, int]]:
    """Words of a block, and the least and the greatest distance that goes with it, for a text of n words."""
    block, least = LEAST_BLOCK, 1
    while least <= n // MIN_TIMES:
        yield block, least, 2 * block - 1
        block, least = 2 * block, 2 * block


def next_distances(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word, how far on in its own text the same word comes again; FAR where it doesn't."""
    own = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets)) * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(own, kind="stable")
    out = np.full(len(codes), FAR)
    same = own[order[1:]] == own[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names, from 1, of all stretches of twice width words, from the names of all stretches of width words."""
    pairs = names[:-width].astype(np.int64) * (int(names.max(initial=0)) + 1) + names[width:]
    return np.unique(pairs, return_inverse=True)[1] + 1


def seeds(names: np.ndarray, farthest: np.ndarray, block: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of aligned blocks and the distances at which they occur again, by one pass of an automaton over the text.

    names: of all stretches of a LEAST_BLOCK-th of a block, from 1. A key is the names of a block's parts, and the text
    is read as so many sequences of such parts as a part has words. So keys have LEAST_BLOCK symbols at every scale, and
    the automaton's chain of suffixes, which it walks at each match, is as short.
    farthest: for each aligned block the greatest of its words' next distances."""
    import ahocorasick

    possible = np.flatnonzero(farthest <= most)
    if not len(possible):
        return possible, possible
    step = block // LEAST_BLOCK
    ids: dict[tuple, int] = {}
    of_block = np.full(len(farthest), -1)
    keys = names[possible[:, None] * block + step * np.arange(LEAST_BLOCK)].tolist()
    for k, key in zip(possible.tolist(), keys, strict=True):
        of_block[k] = ids.setdefault(tuple(key), len(ids))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, i in ids.items():
        automaton.add_word(key, i)
    automaton.make_automaton()
    columns = -(-len(names) // step)
    read = np.zeros((step, columns + 1), dtype=np.int64)  # 0 stands between sequences
    padded = np.zeros(columns * step, dtype=np.int64)
    padded[: len(names)] = names
    read[:, :-1] = padded.reshape(columns, step).T
    found = np.fromiter((x for end, i in automaton.iter(tuple(read.reshape(-1).tolist())) for x in (end, i)), dtype=np.int64).reshape(-1, 2)
    row, column = np.divmod(found[:, 0] - LEAST_BLOCK + 1, columns + 1)
    start, key = column * step + row, found[:, 1]
    places, distances = [], []
    nearest = (start - least) // block
    for back in range(1 + (most - least) // block):
        k = nearest - back
        good = (k >= 0) & (start - k * block <= most)
        good[good] = of_block[k[good]] == key[good]
        places.append(k[good] * block)
        distances.append(start[good] - places[-1])
    return np.concatenate(places), np.concatenate(distances)


def extended(words: np.ndarray, a: int, b: int, d: int) -> tuple[int, int]:
    """The longest stretch around the places a to b, where words d apart are equal, in which they stay so."""
    n, size = len(words) - d, 64
    while b < n:
        differ = words[b : min(b + size, n)] != words[b + d : min(b + size, n) + d]
        k = int(differ.argmax())
        if differ[k]:
            b += k
            break
        b, size = min(b + size, n), 2 * size
    size = 64
    while a > 0:
        low = max(0, a - size)
        differ = (words[low:a] != words[low + d : a + d])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            a -= k
            break
        a, size = low, 2 * size
    return a, b + d


def has_smaller_period(words: np.ndarray, start: int, d: int) -> bool:
    """Does a stretch of at least three times d words have a period below d? If so, d over one of its primes is one."""
    rest, f = d, 2
    while rest > 1:
        if rest % f:
            f = f + 1 if f * f <= rest else rest
            continue
        e = d // f
        if np.array_equal(words[start : start + d], words[start + e : start + e + d]):
            return True
        while rest % f == 0:
            rest //= f
    return False


class Found:
    """The runs so far; those of a class have periods of equally many binary digits."""

    def __init__(self):
        self.classes: dict[int, list[tuple[int, int, int]]] = defaultdict(list)

    def add(self, start: int, end: int, period: int) -> None:
        self.classes[period.bit_length()].append((start, end, period))

    def explained(self, places: np.ndarray, distances: np.ndarray, block: int) -> np.ndarray:
        """Seeds that lie in a run whose period divides their distance: they would extend to that run."""
        out = np.zeros(len(places), dtype=bool)
        for runs in self.classes.values():
            start, end, period = np.array(sorted(runs)).T
            at = np.searchsorted(start, places, side="right") - 1
            for back in range(4):  # few runs of a class overlap; one that is missed costs time alone
                k = np.maximum(at - back, 0)
                out |= (at >= back) & (end[k] >= places + distances + block) & (distances % period[k] == 0)
        return out


def runs_of(words: np.ndarray, distances: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text of integer codes, by start, then period."""
    n = len(words)
    if n < MIN_LENGTH:
        return []
    farthest = next_distances(words, np.array([0, n])) if distances is None else distances
    found, size, names, width = Found(), 1, words.astype(np.int64) + 1, 1
    for block, least, most in scales(n):
        times = block // size
        farthest, size = farthest[: len(farthest) // times * times].reshape(-1, times).max(axis=1), block
        if farthest.min(initial=FAR) > most:
            continue
        while width < block // LEAST_BLOCK:
            names, width = doubled(names, width), 2 * width
        at, far = seeds(names, farthest, block, least, most)
        keep = far <= n // MIN_TIMES
        keep[keep] = ~found.explained(at[keep], far[keep], block)
        at, far = at[keep], far[keep]
        order = np.lexsort((at, far))
        at, far = at[order], far[order]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(far)) + 1, [len(far)])) if len(far) else np.zeros(1, dtype=np.int64)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d = int(far[i])
            while i < j:
                start, end = extended(words, int(at[i]), int(at[i]) + block, d)
                if end - start >= max(MIN_LENGTH, MIN_TIMES * d) and not has_smaller_period(words, start, d):
                    found.add(start, end, d)
                i += max(1, int(np.searchsorted(at[i:j], end - d - block, side="right")))
    return sorted((a, b - a, p) for runs in found.classes.values() for a, b, p in runs)


def searched(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The runs of each text, and each text with every run cut to its first period, words joined by one space."""
    offsets, codes, known = coded_words(texts)
    far = next_distances(codes, offsets)
    keep, rows = np.ones(len(codes), dtype=bool), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        rows.append([{"start": s, "length": n, "period": p} for s, n, p in runs_of(codes[a:b], far[a:b])])
        for r in rows[-1]:
            keep[a + r["start"] + r["period"] : a + r["start"] + r["length"]] = False
    ends = np.concatenate(([0], np.cumsum(keep)))[offsets]
    words = known.take(pa.array(codes[keep]))
    return pa.array(rows, ARROW_RUNS), pc.binary_join(pa.ListArray.from_arrays(ends.astype(np.int32), words), " ")


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _lk_runs (all runs by start, then period) and _lk_collapsed (words that no run repeats, joined by a space)."""
    names = docs.columns

    def search(batches):
        for batch in batches:
            for part in pieces(batch, text, SLICE_BYTES):
                found, collapsed_text = searched(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), found, collapsed_text], names=[*names, "_lk_runs", "_lk_collapsed"])
        release()

    schema = docs.select("*", F.lit(None).cast(RUNS).alias("_lk_runs"), F.lit(None).cast("string").alias("_lk_collapsed")).schema
    return docs.mapInArrow(search, schema)


def collapsed(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with each run of a text cut to its first period. Texts without runs stay as they are, white space included."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_lk_c{i}") for i, c in enumerate(names)])
    own = f"_lk_c{names.index(text)}"
    out = scanned(inner, own).withColumn(own, F.when(F.size("_lk_runs") > 0, F.col("_lk_collapsed")).otherwise(F.col(own)))
    new = {n_chars: F.when(F.size("_lk_runs") > 0, F.length(own).cast("long")).otherwise(F.col(f"_lk_c{names.index(n_chars)}"))} if n_chars in names else {}
    return out.select(*[new.get(c, F.col(f"_lk_c{i}")).alias(c) for i, c in enumerate(names)])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each run: key, start, length, period."""
    found = scanned(docs.select(F.col(key).alias("_lk_key"), F.col(text).alias("_lk_text")), "_lk_text")
    return found.select(F.col("_lk_key").alias(key), F.inline("_lk_runs"))


def planted(key: Column, text: Column) -> Column:
    """The text in which, for a tenth of all keys, the words from some place on repeat with some period.

    h = crc32(decimal key), g = h div 10; where h is divisible by 10 and there are n > 0 words, each word i >= a becomes
    word a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Other texts stay as they are."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / F.lit(10))
    # One-element arrays bind what a lambda uses again and again; it would be computed for every word otherwise.
    bound = F.transform(F.array(words_of(text)), lambda w: F.struct(w.alias("w"), (g % F.size(w)).cast("int").alias("a")))
    period = lambda s: (F.lit(1) + F.floor((F.size(s["w"]) - s["a"]) / (F.lit(3) + g % F.lit(8)))).cast("int")
    bound = F.transform(bound, lambda s: F.struct(s["w"].alias("w"), s["a"].alias("a"), period(s).alias("p")))
    word = lambda s: lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], s["a"] + (i - s["a"]) % s["p"]))
    edited = F.get(F.transform(bound, lambda s: F.array_join(F.transform(s["w"], word(s)), " ")), 0)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), edited).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """Per document, some of them edited: how many runs, the run of most repetitions, and digests of all runs and of the
    collapsed text."""
    found = scanned(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("_lk_text")), "_lk_text")
    # By start, then period: of equal exponents the first stays.
    best = F.aggregate(
        "_lk_runs", F.lit(None).cast(RUNS[6:-1]),
        lambda most, r: F.when(most.isNull() | (r["length"] * most["period"] > most["length"] * r["period"]), r).otherwise(most),
    )
    lines = F.transform("_lk_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_lk_best", best).select(
        "doc_id", F.size("_lk_runs").cast("long").alias("n_runs"), "_lk_best.start", "_lk_best.length", "_lk_best.period",
        F.floor(1000 * F.col("_lk_best.length") / F.col("_lk_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("_lk_collapsed", 256).alias("collapsed_sha256"),
    )
