"""Document fingerprints: SimHash of weighted terms, and permuted block tables that find all of them within a radius.

A text's terms are its words (A-Z lower-cased, between white space) and its pairs of adjacent words. A term's hash has 64
signed bits; each term votes on all of them with its weight, which is the number of binary digits of its count, twice
that for pairs, so that a line repeated a hundred times weighs seven and not a hundred. A bit is 1 if its votes are
above zero. Unrelated texts of one language share frequent words but few pairs. The likeness of two fingerprints is the
cosine that their differing bits stand for, cos(pi * bits / 64), and 0 beyond half of the bits.

`link_counts` and `within` search distinct fingerprints. The bits are cut into BLOCKS blocks; for a radius r, there is a
table for each choice of BLOCKS - r blocks, in which fingerprints meet that are equal there. Two fingerprints within the
radius differ in r blocks at most, so they meet in one table at least, and they are verified bit by bit. A pair counts in
the first of its tables alone. A bucket of more than LIMIT fingerprints isn't compared: its rows go on to tables of their
own, keyed by one of r + 1 parts of the bits that are left, until buckets are small, which they are at the latest when
few bits are left. Copies of a text are one fingerprint, so groups of copies cost nothing, and no pairs are sent for
counts.

`neighbours_edited` gives each document its successor in descending order of ids by one range shuffle: rows are sorted
within ranges (by id, then by a hash of the text, so ties are dealt out), a range's last row meets the first row of the
next range in a second step of two rows for each range.

Defined cases: a null text counts as empty, with fingerprint 0; null ids come last, equal ids are ordered by a hash of
the text, equal rows are interchangeable; a lone document follows itself; texts of fewer than three code points are not
edited; repeated rows are rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow_words import coded_words, pieces
from larkspur.llm.dealt import mixed
from larkspur.llm.shared import release, written

BITS, SEED = 64, 42
RADIUS, BLOCKS = 3, 5
#: Distinct fingerprints of a bucket that are compared with each other.
LIMIT = 4096
PAIR_WEIGHT = 2
ODD = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20
#: Terms whose bits are unpacked at once.
STEP = 1 << 15
#: Terms whose votes are added in 16 bits: a count has 63 binary digits at most, and 1,024 times 63 are fewer than 2**16.
GROUP = 1024


def _lanes() -> np.ndarray:
    """For each byte, its eight bits (highest first) as eight numbers of 16 bits, four to a word."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype("<u2").view("<u8")


LANES = _lanes()


def votes(owner: np.ndarray, term: np.ndarray, weight: int, count: int) -> np.ndarray:
    """Signed votes (count, BITS) of the distinct terms of each owner, by the binary digits of their counts.

    Votes for a bit are added in numbers of 16 bits, four at a time, over at most GROUP terms of one owner."""
    _, first, times = np.unique(mixed(term + (owner.astype(np.uint64) + np.uint64(1)) * ODD), return_index=True, return_counts=True)
    order = np.argsort(owner[first], kind="stable")
    first, heavy = first[order], np.frexp(times[order].astype(np.float64))[1].astype(np.uint64)
    out = np.zeros((count, BITS), dtype=np.int64)
    for at in range(0, len(first), STEP):
        part, w = first[at : at + STEP], heavy[at : at + STEP]
        own = owner[part]
        edge = np.flatnonzero(np.diff(own, prepend=-1))
        inside = np.arange(len(own)) - np.repeat(edge, np.diff(np.append(edge, len(own))))
        edge = np.flatnonzero(inside % GROUP == 0)
        ayes = LANES[term[part].astype(">u8").view(np.uint8)].reshape(-1, BITS // 4)
        ayes *= w[:, None]
        ayes = np.add.reduceat(ayes, edge, axis=0).view("<u2").astype(np.int64)
        np.add.at(out, own[edge], 2 * ayes - np.add.reduceat(w, edge).astype(np.int64)[:, None])
    return weight * out


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """The fingerprint of each text as an unsigned number."""
    from xxhash import xxh64_intdigest

    offsets, codes, known = coded_words(pa.array(texts, pa.string()), pc.ascii_lower)
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in known.to_pylist()), dtype=np.uint64, count=len(known))
    words = hashes[codes]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    total = votes(owner, words, 1, len(texts))
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    total += votes(owner[inside], mixed(words[inside] * ODD + words[inside + 1]), PAIR_WEIGHT, len(texts))
    return np.packbits(total > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def likeness(a: Column, b: Column) -> Column:
    """From 0 (half of the bits differ, or more) to 1 (none does)."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * (np.pi / BITS)))


def choices(mask: int, radius: int, blocks: int) -> list[int]:
    """Masks of the tables that follow a mask: first those of all choices of blocks, then one part of what is left."""
    if not mask:
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        own = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
        return [sum(c) for c in itertools.combinations(own, blocks - radius)]
    left = [b for b in range(BITS) if not mask >> b & 1]
    # Every so many bits: where some bits in a row are all that tells a dense group apart, each part has some of them.
    return [mask | sum(1 << b for b in left[i :: radius + 1]) for i in range(radius + 1)]


def salt(*masks: int) -> np.uint64:
    """A number for a path of masks."""
    out = np.zeros(1, dtype=np.uint64)
    for m in masks:
        out = mixed(out + np.uint64(m) + ODD)
    return out[0]


class Tables:
    """Rows of permuted tables, and the links in their buckets."""

    def __init__(self, radius: int, blocks: int, limit: int):
        if not 0 <= radius < blocks <= BITS:
            raise ValueError("the radius is 0 or more, and there are more blocks than that")
        # A bucket over this limit has more than radius + 1 bits left, which make radius + 1 parts.
        self.radius, self.blocks, self.limit = radius, blocks, max(limit, 2 ** (radius + 1))

    def rows(self, fps: np.ndarray, paths: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Key, fingerprint and path (the masks so far) of every row one level on."""
        keys, found, out = [], [], []
        by_path: dict[tuple, list[int]] = {}
        for i, p in enumerate(paths):
            by_path.setdefault(tuple(p), []).append(i)
        for path, at in by_path.items():
            own = fps[at]
            for mask in choices(path[-1] if path else 0, self.radius, self.blocks):
                keys.append(mixed((own & np.uint64(mask)) + salt(*path, mask)))
                found.append(own)
                out += [[*path, mask]] * len(own)
        return np.concatenate(keys or [EMPTY]), np.concatenate(found or [EMPTY]), out

    def first_meeting(self, apart: np.ndarray, path: list[int]) -> np.ndarray:
        """Is this the first table in which fingerprints meet that differ in these bits?"""
        good, before = np.ones(apart.shape, dtype=bool), 0
        for mask in path:
            for other in choices(before, self.radius, self.blocks):
                if other == mask:
                    break
                good &= (apart & np.uint64(other)) != 0
            before = mask
        return good

    def links(self, fps: np.ndarray, path: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in a bucket that link and meet here first, each in both directions."""
        for at in range(0, len(fps), 256):
            apart = fps[at : at + 256, None] ^ fps[None, :]
            a, b = np.nonzero((np.bitwise_count(apart) <= self.radius) & (apart != 0))
            good = self.first_meeting(apart[a, b], path)
            yield a[good] + at, b[good]


BIG, EMPTY = 1 << 64, np.zeros(0, dtype=np.uint64)
ROW = "key long, fp long, path array<long>"
MET = pa.schema([("fp", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("path", pa.list_(pa.int64()))])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def unsigned_path(p: list[int]) -> list[int]:
    return [x % BIG for x in p]


def signed_path(p: list[int]) -> list[int]:
    return [x - BIG if x >> 63 else x for x in p]


def met(rows: DataFrame, tables: Tables, pairs: bool) -> DataFrame:
    """Links in small buckets (fp, other, n: counts of links, or each link where pairs is set), and the rows of larger
    buckets with their path."""

    def bucket(fps: np.ndarray, path: list[int]):
        count = np.zeros(len(fps), dtype=np.int64)
        for a, b in tables.links(fps, path):
            if pairs:
                yield fps[a], fps[b], np.ones(len(a), dtype=np.int64)
            else:
                count += np.bincount(a, minlength=len(fps))
        full = np.flatnonzero(count)
        if len(full):
            yield fps[full], fps[full], count[full]

    def links_of(fps: np.ndarray, path: list[int]):
        for a, b, n in bucket(fps, path):
            yield pa.RecordBatch.from_arrays([signed(a), signed(b), pa.array(n), pa.nulls(len(a), MET.field("path").type)], schema=MET)

    def passed(fps: np.ndarray, path: list[int]):
        return pa.RecordBatch.from_arrays([signed(fps), signed(fps), pa.array(np.zeros(len(fps), dtype=np.int64)), pa.array([signed_path(path)] * len(fps), MET.field("path").type)], schema=MET)

    def scan(batches):
        key, path, held, over = None, None, [], False
        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else [0]
            for a, b in itertools.pairwise(np.asarray(edges).tolist()):
                if keys[a] != key:
                    if not over and sum(map(len, held)) > 1:
                        yield from links_of(np.concatenate(held), path)
                    key, path, held, over = keys[a], unsigned_path(batch.column("path")[a].as_py()), [], False
                held.append(fps[a:b])
                if over or sum(map(len, held)) > tables.limit:
                    yield passed(np.concatenate(held), path)
                    held, over = [], True
        if not over and sum(map(len, held)) > 1:
            yield from links_of(np.concatenate(held), path)

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "fp")
    return sorted_rows.mapInArrow(scan, "fp long, other long, n long, path array<long>")


def searched(distinct: DataFrame, radius: int, blocks: int, limit: int, pairs: bool) -> DataFrame:
    """Links of distinct fingerprints (a column fp of longs), level after level; a union of written tables."""
    tables = Tables(radius, blocks, limit)

    def deal(batches):
        for batch in batches:
            keys, fps, paths = tables.rows(batch.column("fp").to_numpy().view(np.uint64), [unsigned_path(p) for p in batch.column("path").to_pylist()])
            yield pa.RecordBatch.from_arrays([signed(keys), signed(fps), pa.array([signed_path(p) for p in paths], pa.list_(pa.int64()))], names=["key", "fp", "path"])

    rows, out = distinct.select("fp", F.array().cast("array<long>").alias("path")), None
    while rows is not None:
        found = written(met(rows.mapInArrow(deal, ROW), tables, pairs), "fingerprint-links")
        links = found.where("path IS NULL").select("fp", "other", "n")
        out = links if out is None else out.unionByName(links)
        rows = found.where("path IS NOT NULL").select("fp", "path")
        rows = rows if rows.head(1) else None
    return out


def link_counts(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, limit: int = LIMIT) -> DataFrame:
    """fp and n_near, how many other fingerprints lie within the radius, for those that have any."""
    return searched(distinct, radius, blocks, limit, False).groupBy("fp").agg(F.sum("n").alias("n_near"))


def within(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, limit: int = LIMIT) -> DataFrame:
    """fp, other: every pair of different fingerprints within the radius, in both directions. Its rows are as many as the
    links, which are at most 43,744 for a fingerprint at radius 3."""
    return searched(distinct, radius, blocks, limit, True).select("fp", "other")


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _lk_fp, the fingerprint of each text as a long."""
    names = docs.columns

    def made(batches):
        for batch in batches:
            for part in pieces(batch, text, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, signed(fingerprints(part.column(text).to_pylist()))], names=[*names, "_lk_fp"])
        release()

    return docs.mapInArrow(made, docs.select("*", F.lit(0).cast("long").alias("_lk_fp")).schema)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


TOLD = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha", pa.binary()), ("fp", pa.int64()), ("edited_fp", pa.int64()), ("next_fp", pa.int64())])
ENDS = pa.schema([("range", pa.int32()), ("head", pa.string()), ("tail", pa.string())])


def told(ids: list, texts: list[str], own: np.ndarray, following: list[str], next_fps: np.ndarray) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
         signed(own), signed(fingerprints(changed)), signed(next_fps)], schema=TOLD,
    )


def neighbours_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha, fp, edited_fp and next_fp of every row, as written tables."""
    schema = pa.schema([*TOLD, *ENDS])

    def with_ends(batch: pa.RecordBatch, head: str | None, tail: str | None) -> pa.RecordBatch:
        none = [None] * batch.num_rows
        ends = [[TaskContext.get().partitionId()] * batch.num_rows, [head, *none[1:]] if head is not None else none, [*none[1:], tail] if tail is not None else none]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, f.type) for x, f in zip(ends, ENDS, strict=True))], schema=schema)

    def follow(batches):
        ids, texts, own, first = [], [], np.zeros(0, dtype=np.uint64), True
        for batch in batches:
            for part in pieces(batch, "text", SLICE_BYTES):
                new = part.column("text").to_pylist()
                ids, texts, own = [*ids, *part.column("key").to_pylist()], [*texts, *new], np.concatenate((own, fingerprints(new)))
                if len(texts) > 1:
                    yield with_ends(told(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:]), texts[0] if first else None, None)
                    ids, texts, own, first = ids[-1:], texts[-1:], own[-1:], False
        if texts:  # the last row of the range: its successor is the first row of the next one
            yield with_ends(told(ids, texts, own, texts, own), texts[0] if first else None, texts[0])
        release()

    rows = docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("key").desc_nulls_last(), F.col("h")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    table = written(ranged.mapInArrow(follow, ddl(schema)), "fingerprints")

    ranges = sorted(r.range for r in table.where("tail IS NOT NULL").select("range").collect())  # one number for each range
    after = rows.sparkSession.createDataFrame(list(zip(ranges, [*ranges[1:], *ranges[:1]], strict=True)), "range int, next int")
    heads = table.where("head IS NOT NULL").select(F.col("range").alias("next"), F.col("head").alias("following"))
    last = table.where("tail IS NOT NULL").select("range", "tail", "doc_id", "fp").join(after, "range").join(heads, "next").select("doc_id", "fp", "tail", "following")

    def close(batches):
        for batch in batches:
            following = batch.column("following").to_pylist()
            yield told(batch.column("doc_id").to_pylist(), batch.column("tail").to_pylist(), batch.column("fp").to_numpy().view(np.uint64), following, fingerprints(following))

    closed = last.mapInArrow(close, ddl(TOLD))
    return table.where("tail IS NULL").select(*TOLD.names).unionByName(closed)


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def digests(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per document: digests of the edited text and both fingerprints, their likeness, that to the next document's
    fingerprint, and how many other fingerprints of the corpus lie within the radius."""
    rows = neighbours_edited(docs)
    counts = link_counts(rows.select("fp").distinct(), radius)
    hexed = lambda c: F.lower(F.lpad(F.hex(c), BITS // 4, "0"))
    return rows.join(counts, "fp", "left").select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
