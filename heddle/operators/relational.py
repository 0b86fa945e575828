"""Joins with several forms: stars, entity matches, range joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a dimension is sent to every executor.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcasting if the optimizer's estimate of its size allows."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def star_join(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, Column]], how: str = "inner") -> DataFrame:
    """fact joined with each (dimension, condition) in turn; small dimensions are broadcast,
    large ones left to the optimizer."""
    for dimension, on in dimensions:
        fact = fact.join(small(dimension), on, how)
    return fact


def entity_match(a: DataFrame, b: DataFrame, on: str | Mapping[str, str], columns: Sequence[str], null_matches: bool = False) -> DataFrame:
    """Pairs of rows of a and b with equal attributes: a_<column> and b_<column>.

    on: an attribute, or attributes of a by those of b that they must equal. Skewed
    values are split by adaptive execution.
    """
    pairs = {on: on} if isinstance(on, str) else dict(on)
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in dict.fromkeys([*columns, *pairs])])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in dict.fromkeys([*columns, *pairs.values()])])
    same = [left[f"a_{x}"].eqNullSafe(right[f"b_{y}"]) if null_matches else left[f"a_{x}"] == right[f"b_{y}"] for x, y in pairs.items()]
    joined = left.join(right, same)
    return joined.select(*[f"a_{c}" for c in columns], *[f"b_{c}" for c in columns])


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the spans [start, end) that hold them: both sides are dealt into cells
    of the given width, so that the join has a key and no pair is made twice."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    last = F.greatest(cell(start), F.ceil(F.col(end) / F.lit(width)).cast("long") - 1)
    wide = spans.filter(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(start), last)))
    near = points.withColumn("_cell", cell(at)).join(wide, "_cell")
    return near.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """left with columns of the row of right that has the same key and the largest `at` up to its own,
    or nulls. Both sides lie in one line by key and time, so that no pairs are made."""
    rows = left.withColumn("_own", F.struct(*left.columns)).select(key, at, "_own", F.lit(None).cast(right.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("_of"))
    of = right.select(key, at, F.lit(None).cast(rows.schema["_own"].dataType).alias("_own"), F.struct(*columns).alias("_of"))
    # at equal times the right side comes first, so that it counts
    line = Window.partitionBy(key).orderBy(at, F.col("_own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.union(of).withColumn("_of", F.last("_of", True).over(line)).filter(F.col("_own").isNotNull())
    seen = F.col(f"_own.{key}").isNotNull()  # a null key matches nothing
    return found.select("_own.*", *[F.when(seen, F.col(f"_of.{c}")).alias(f"of_{c}") for c in columns])
