"""Filling of budgets, and summaries by map and reduce."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from larkspur.operators.tables import held


def filled(sizes: Column, budget: int) -> Column:
    """Which of an array of sizes are taken, in order, while they fit; one that doesn't fit is skipped."""
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(s: Column, n: Column) -> Column:
        fits = s["used"] + n <= budget
        return F.struct((s["used"] + F.when(fits, n).otherwise(0)).cast("long").alias("used"), F.concat(s["taken"], F.array(fits)).alias("taken"))

    return F.aggregate(sizes, state, step, lambda s: s["taken"])


def _taken(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of blocks (key, _lk_b) that the block's budget _lk_left takes, in order; one batch is held at a time."""

    def fold(batches):
        now, left = (), 0
        for batch in batches:
            found = []
            own = zip(*[batch.column(c).to_pylist() for c in (key, "_lk_b", "_lk_left", "_lk_n")], strict=True)
            for i, (k, b, start, n) in enumerate(own):
                if not (now and b == now[1] and (k == now[0] or (k != k and now[0] != now[0]))):  # NaN is one key
                    now, left = (k, b), start
                if n <= left:
                    left -= n
                    found.append(i)
            yield batch.take(pa.array(found, pa.int32()))

    return rows.repartition(key, "_lk_b").sortWithinPartitions(key, "_lk_b", *order, "_lk_n").mapInArrow(fold, rows.schema)


def fill_budget(rows: DataFrame, key: str, order: list[str], size: str, budget: int, block: int = 100_000) -> DataFrame:
    """rows that a budget per key takes, greedily in order: each that still fits is taken, one that doesn't is skipped.

    Every row is looked at. Rows are dealt by range of key and order into blocks of about `block` rows. A key of one
    block is folded at once. Of a key with more, the budget is carried from block to block: one whose sum fits is taken
    whole, one whose least size doesn't fit is passed over, others are folded, a round for each in which one is met; in
    ascending order that is one block a key. Keys of several blocks are fewer than blocks, so the driver holds blocks.

    Defined cases: a null size is never taken and uses nothing; size 0 is always taken if the budget isn't negative;
    a negative size gives budget back; null keys are one key; rows tied in order are taken by size, then any.
    """
    others = [c for c in rows.columns if c != key]
    n = F.col("_lk_n")
    free = (n == 0) & F.lit(budget >= 0)
    sized = rows.withColumn("_lk_n", F.col(size).cast("long")).where(n.isNotNull())
    some = sized.where(~free)
    seen = some.agg(F.min("_lk_n").alias("least"), F.count("*").alias("all"), F.count_if(n <= budget).alias("fit")).first()
    plain = seen["least"] is None or seen["least"] >= 0
    if plain:
        some = some.where(n <= budget)
    count = max(1, -(-seen["fit" if plain else "all"] // block))
    dealt = held(some.repartitionByRange(count, key, *order, "_lk_n").withColumn("_lk_b", F.spark_partition_id()))

    sums = dealt.groupBy(key, "_lk_b").agg(F.sum("_lk_n").alias("total"), F.min("_lk_n").alias("least"))
    spans = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_lk_b", "total", "least"))).alias("blocks")).where(F.size("blocks") > 1).collect()
    schema = StructType([StructField("_lk_k", rows.schema[key].dataType), StructField("_lk_c", IntegerType()), StructField("_lk_i", IntegerType()), StructField("_lk_left", LongType())])

    def begun(at: list[tuple], how: str) -> DataFrame:
        """dealt with the budgets that blocks begin with, at: (key, block, place of the key, budget)."""
        starts = F.broadcast(rows.sparkSession.createDataFrame(at, schema))
        found = dealt.join(starts, F.col(f"`{key}`").eqNullSafe(F.col("_lk_k")) & (F.col("_lk_b") == F.col("_lk_c")), how)
        found = found.withColumn("_lk_left", F.coalesce("_lk_left", F.lit(budget).cast("long"))).drop("_lk_k", "_lk_c")
        return found.where(n <= F.col("_lk_left")) if plain else found

    left, place, starts = [budget] * len(spans), [0] * len(spans), []
    while True:
        stuck = []
        for i, span in enumerate(spans):
            for b in span["blocks"][place[i] :]:
                starts.append((span[key], b["_lk_b"], i, left[i]))
                place[i] += 1
                if b["least"] >= 0 and b["total"] <= left[i]:
                    left[i] -= b["total"]
                elif b["least"] <= left[i]:
                    stuck.append(starts[-1])
                    break
        if not stuck:
            break
        for r in _taken(begun(stuck, "inner"), key, order).groupBy("_lk_i").agg(F.sum("_lk_n").alias("used")).collect():
            left[r["_lk_i"]] -= r["used"]
    return _taken(begun(starts, "left"), key, order).select(key, *others).unionByName(sized.where(free).select(key, *others))


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with _i, their place in their key from 0. Rows are dealt into ranges of key and order and written; places are
    counted within a range and moved on by the sizes of the key's ranges before, so a key of any size is many tasks' work.
    Rows that tie are in one range, in any order."""
    ranged = held(rows.repartitionByRange(key, order).withColumn("_p", F.spark_partition_id()), "ranged")
    own = ranged.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_p").orderBy(order)) - 1)
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(key, "_p").agg(F.count("*").alias("_c")).select(F.col(key).alias("_k"), F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    both = own.join(sizes, own[key].eqNullSafe(sizes["_k"]) & (own["_p"] == sizes["_q"]))
    return both.select(*[own[c] for c in rows.columns], (F.col("_before") + F.col("_n")).alias("_i"))


def map_reduce(rows: DataFrame, key: str, order: str, text: str, reduce_texts, group: int = 8) -> DataFrame:
    """One text per key: neighbours in groups of `group` are reduced, level by level, until one is left.

    reduce_texts maps a Column of array<string> to a Column of string, a stand-in for a model. A level shuffles by key
    and group, so no key's texts meet at once; the levels are as many as the largest key needs.
    """
    level = numbered(rows.select(key, order, F.col(text).alias("_t")), key, order).select(key, "_i", "_t")
    most = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while most > 1:
        gathered = level.groupBy(key, F.floor(F.col("_i") / group).alias("_g")).agg(F.sort_array(F.collect_list(F.struct("_i", "_t"))).alias("_l"))
        level = gathered.select(key, F.col("_g").alias("_i"), reduce_texts(F.transform("_l", lambda x: x["_t"])).alias("_t"))
        most = -(-most // group)
    return level.select(key, F.col("_t").alias(text))
