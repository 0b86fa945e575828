"""Operator 7: sharding by sampled splitters.

Size-weighted key samples give quantile boundaries; records are range-partitioned
into many small ranges (at most MOST_RANGES, whose rows without texts grow beyond that),
overfull ranges are subdivided with samples of their own as long as a boundary is found in them,
and exact sums over the ranges place each record on one global line of bytes.
Cutting that line into equal parts gives shards of nearly equal bytes.

Contract (`bytes` law): shard sizes differ by the larger of one record and of
`group_share` of a shard. The key is (hash of text, id): equal texts lie side by
side. A group of equal texts on a cut stays whole while it is at most
`group_share` of a shard; a larger one is subdivided at the cut.

* null text: size 1, crc32 of no bytes; empty text likewise; very long texts are
  measured, never carried through a shuffle.
* ties: equal texts are ordered by id, a null id first; rows repeated with the same id and text
  stay separate rows, told apart by a row number.
* empty table: an empty result. Other columns of the input, whatever their
  names, are ignored.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_length

#: Bytes of text that one range should hold, and ranges at least and at most.
RANGE_BYTES = 64 << 20
LEAST_RANGES, MOST_RANGES = 512, 200_000
#: Samples drawn for each range, in expectation.
PER_RANGE = 24
#: Samples that one task sums up.
SAMPLED = 200_000


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the row's key alone."""
    return F.pmod(F.xxhash64(*cols, F.lit("sample")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _split(spark: SparkSession, scratch: Scratch, rows: DataFrame, total: float, pieces: int, name: str) -> list[tuple[int, int]]:
    """Quantile boundaries of the key from a size-weighted sample of expected size pieces * PER_RANGE.
    The sample is summed up in ranges on the executors; the boundaries alone, about `pieces`, come here."""
    take = F.col("weight") * F.lit(pieces * PER_RANGE / max(total, 1.0))
    seen = rows.filter(_unit("h", "k") < take).select("h", "k", F.greatest(F.lit(1.0), take).alias("n"))
    seen = seen.groupBy("h", "k").agg(F.sum("n").alias("n"))
    if pieces * PER_RANGE > SAMPLED:
        seen = seen.repartitionByRange(-(-pieces * PER_RANGE // SAMPLED), "h", "k").withColumn("part", F.spark_partition_id())
    else:
        seen = seen.withColumn("part", F.lit(0))
    seen = scratch.write(seen, name)
    gone, ahead = 0.0, []
    for r in seen.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        ahead.append((r.part, gone))
        gone += r.n
    line = Window.partitionBy("part").orderBy("h", "k").rowsBetween(Window.unboundedPreceding, 0)
    summed = seen.withColumn("upto", F.sum("n").over(line)).join(spark.createDataFrame(ahead, "part int, ahead double"), "part").withColumn("upto", F.col("upto") + F.col("ahead"))
    cuts = summed.filter(F.floor(F.col("upto") / PER_RANGE) > F.floor((F.col("upto") - F.col("n")) / PER_RANGE))
    return sorted((r.h, r.k) for r in cuts.select("h", "k").collect())


def _with_range(spark: SparkSession, rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Each row's range: how many cuts lie below its key. The cuts go as one array
    of at most MOST_RANGES pairs, searched by bisection inside the expression."""
    hs, ids = [c[0] for c in cuts], [c[1] for c in cuts]
    shared = spark.sparkContext.broadcast((hs, ids))

    @F.pandas_udf("long")
    def place(h: pd.Series, i: pd.Series) -> pd.Series:
        ch, ci = (np.asarray(x, dtype="int64") for x in shared.value)
        x, y = h.to_numpy(), i.to_numpy()
        lo, hi = np.searchsorted(ch, x, "left"), np.searchsorted(ch, x, "right")
        # among the cuts with the same hash, those with a smaller or equal id lie below
        for k in np.flatnonzero(hi > lo):
            lo[k] += np.searchsorted(ci[lo[k] : hi[k]], y[k], "right")
        return pd.Series(lo)

    return rows.withColumn("range", place("h", "k"))


def shard_by_bytes(spark: SparkSession, docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", group_share: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every record's shard and place in it."""
    scratch = Scratch(spark)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (byte_length(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)).alias("k"),  # a null id comes first
    )
    rows = scratch.write(rows, "rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # half of the weight is the record itself, so that ranges of short texts stay small too
    weighed = rows.withColumn("weight", F.col("size") + F.lit(total / n))
    pieces = min(MOST_RANGES, max(LEAST_RANGES, n_shards, total // RANGE_BYTES))
    cuts = _split(spark, scratch, weighed, 2.0 * total, pieces, "sample")
    for k in count():  # overfull ranges are subdivided with samples of their own, until none is left or it can't be
        ranged = _with_range(spark, weighed, cuts)
        full = ranged.groupBy("range").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).filter((F.col("w") > 6.0 * total / pieces) & (F.col("n") > 1000)).collect()
        if not full:
            break
        more = _split(spark, scratch, ranged.filter(F.col("range").isin([r.range for r in full])), sum(r.w for r in full), int(2 * sum(r.w for r in full) * pieces / total) + 1, f"sample{k}")
        if not set(more) - set(cuts):
            break
        cuts = sorted({*cuts, *more})
    # a task for each few ranges: rows get their place in the range, then the range its place on the line
    line = Window.partitionBy("range").orderBy("h", "k", "size", "text_crc32")
    placed = _with_range(spark, rows, cuts).select(
        "*",
        (F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("at"),
        (F.row_number().over(line) - 1).cast("long").alias("nth"),
    )
    placed = scratch.write(placed, "placed")
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range").collect()
    ahead, seen, starts = 0, 0, []
    for r in sums:  # at most as many as there are ranges
        starts.append((r.range, ahead, seen))
        ahead, seen = ahead + r.bytes, seen + r.n
    start = spark.createDataFrame(starts, "range long, bytes_before long, rows_before long")
    lined = placed.join(F.broadcast(start), "range").withColumn("pos", F.col("bytes_before") + F.col("at")).withColumn("row", F.col("rows_before") + F.col("nth"))
    part = lambda x: F.least(F.lit(n_shards - 1), F.floor(x * n_shards / F.lit(total))).cast("int")
    # groups of equal texts that lie on a cut: fewer than shards
    cut = (
        lined.groupBy("h").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("size")).alias("hi"))
        .filter((part(F.col("lo")) != part(F.col("hi") - 1)) & (F.col("hi") - F.col("lo") <= F.lit(group_share * total / n_shards)))
        .select("h", part((F.col("lo") + F.col("hi")) / 2).alias("whole")).collect()
    )
    own = part(F.col("pos") + F.col("size") / 2)
    for r in cut:
        own = F.when(F.col("h") == r.h, F.lit(r.whole)).otherwise(own)
    sharded = lined.withColumn("shard", own.cast("int"))
    firsts = {r.shard: r.first for r in sharded.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    first = F.create_map(*[F.lit(x) for k, v in firsts.items() for x in (int(k), int(v))])
    return sharded.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - first[F.col("shard")]).cast("long").alias("slot"))


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(spark, docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
