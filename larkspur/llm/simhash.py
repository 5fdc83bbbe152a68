"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has 64 bits; documents link at RADIUS or fewer differing bits. Every distinct fingerprint
emits all variants within half the radius (1 + 64 for radius 2); two fingerprints within the radius share a variant.
Variants are shuffled, neighbours in a variant's order are linked, deduplicated and verified; all fingerprints of a
variant lie within the radius of each other, so a chain links them as well as all pairs would. Connected components
are found by rounds of large-star and small-star over those links, each round a written table.

Copies collapse into one fingerprint before anything is emitted, so a group of copies, however large, is one row; a
variant holds at most 65 fingerprints. Stars are found by grouped minima, combined on the map side, and joins.

Defined cases: a null or empty text has fingerprint zero, linked like any other; null ids never become a component's
id unless all ids of a component are null; repeated and tied rows are kept, each with its component; an empty table
gives an empty result; extra columns are ignored by `components`, and pass through `one_of_each`. Components that share
a smallest id, or have none, stay apart in `one_of_each`: each keeps a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import release, written

SHINGLE, BITS, SEED = 3, 64, 42
RADIUS = 2


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(words)) - 1
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[last:].tolist(), strict=False)], dtype=">u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", marks: tuple[Column, ...] = ()) -> DataFrame:
    """key, fp (the fingerprint as a signed long) and the marks (longs, as m0, m1, ...) of every row."""
    passed = ["key", *[f"m{i}" for i in range(len(marks))]]

    def made(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], pa.array(found)], names=[*passed, "fp"])
        release()

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"), *[m.alias(c) for m, c in zip(marks, passed[1:], strict=True)])
    return rows.mapInArrow(made, ", ".join(f"{c} long" for c in [*passed, "fp"]))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that connect all that differ in at most radius bits, which is 0 or 2:
    half of it is the variants' distance, and at an odd radius a chain of neighbours would miss links."""
    if radius not in (0, 2):
        raise ValueError("the radius is 0 or 2: half of it is the variants' distance")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(BITS)]) if radius else F.array("fp")
    variants = distinct.select("fp", F.explode(near).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select(before.alias("a"), F.col("fp").alias("b")).where(F.col("a").isNotNull())
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(pairs: DataFrame, tag: str = "components") -> DataFrame:
    """node, root: the smallest node that each linked node reaches; nodes without links are not listed.

    Rounds of large-star and small-star over pairs (a, b); their number grows with the logarithm of a component's size.
    """
    edges = written(pairs.select("a", "b").where("a != b").distinct(), tag)
    size = edges.count()
    before = None
    while size:
        # Large star: neighbours above a node move to the smallest node of its neighbourhood.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: what lies below a node, and the node, moves to the smallest of them. Here every v < u.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), "m").unionByName(lower).where("u != m").distinct()
        edges = written(small.select(F.col("m").alias("a"), F.col("u").alias("b")), tag)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")


def rooted(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct (one row for each fp) with root, the smallest fingerprint that is reachable; a written table."""
    roots = components(links(distinct.select("fp"), radius))
    of_fp = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))
    return written(of_fp, "roots")


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fp and component (the smallest key reachable) of every row."""
    rows = written(fingerprints(docs, key, text), "fingerprints")
    of_fp = rooted(rows.groupBy("fp").agg(F.min("key").alias("least")), radius)
    ids = of_fp.groupBy("root").agg(F.min("least").alias("component"))
    named = of_fp.join(ids, "root").select("fp", "component")
    return rows.join(named, "fp").select("key", "fp", "component")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint in hex and its component's smallest id."""
    return components_of(docs).select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: of the smallest key (null last), then of the smallest hash of key and text.

    A component is told by its root, not by its id, so those of equal or null ids don't merge. Rows are found again by
    128 bits of hashes of key and text; of rows that have both in common, any one stays.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_lk_c{i}") for i, c in enumerate(names)])
    own, body = f"_lk_c{names.index(key)}", f"_lk_c{names.index(text)}"
    id_ = F.col(own).cast("long")
    told = (F.coalesce(id_, F.lit(0)), id_.isNull(), F.col(body))
    marks = (F.xxhash64(*told), F.xxhash64(F.lit(1), *told))
    rows = written(fingerprints(inner, own, body, marks), "fingerprints")
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "m0", "m1")).alias("least")
    of_root = rooted(rows.groupBy("fp").agg(least), radius).groupBy("root").agg(F.min("least").alias("least"))
    kept = of_root.select(F.col("least.m0").alias("_lk_m0"), F.col("least.m1").alias("_lk_m1"))
    marked = inner.withColumns({"_lk_m0": marks[0], "_lk_m1": marks[1]})
    left = marked.join(kept, ["_lk_m0", "_lk_m1"], "left_semi").dropDuplicates(["_lk_m0", "_lk_m1"])
    return left.drop("_lk_m0", "_lk_m1").toDF(*names)
