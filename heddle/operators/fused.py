"""Joins with sums and counts on top, without the many-to-many join between.

For tables L(k, g, v) and R(k, g, v), sums over all matching pairs factor by key:
the number of pairs is the sum over k of |L_k| * |R_k|, and so on. Each side is
aggregated by key (within tasks first), and only one row per key and group meets
the other side. A hot key costs one row, not the product of its rows. Rows with a
null key match nothing, as in SQL.

Grouped by columns of both sides the result may be far larger than either. met() then shuffles
none of it: where keys are few they become columns, a row holds all that a group has, and
two rows give a result's row at once. Where they are many, each side's groups are dealt into
parts, and a task has all rows of one part of either side: it pairs them and sums them up.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that may become columns, and pairs of rows from which they do.
MOST_KEYS, LEAST_PAIRS = 32, 1 << 20
#: Pairs of groups for each that the join has; groups sent to every executor; rows that a task gives, about.
SPARE, MOST_SENT, ROWS = 4, 1 << 18, 1 << 22
#: Pairs that a task sums up, about, where groups are dealt into parts; tasks; rows shuffled otherwise for each that this shuffles.
PAIRS, MOST_TASKS, SAVED = 1 << 21, 1 << 15, 2
_WHOLE = {"byte", "short", "integer", "long"}
#: Types, besides decimals, of which equal values have equal hashes (those of strings with a collation may not).
_HASHED = {"tinyint", "smallint", "int", "bigint", "float", "double", "string", "boolean", "date", "timestamp", "timestamp_ntz", "binary"}
_FINAL = {"Sum": F.sum, "Count": F.sum, "Min": F.min, "Max": F.max}


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def _side(df: DataFrame, keys: list[str], groups: Sequence[str], *aggs: Column) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys, *groups).agg(*aggs)


def join_count(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """join_count: pairs that the inner join has."""
    keys = _keys(on)
    a = _side(left, keys, (), F.count("*").alias("_a"))
    b = _side(right, keys, (), F.count("*").alias("_b"))
    return a.join(b, keys).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).cast("long").alias("join_count"))


def join_sum(left: DataFrame, right: DataFrame, on: str | Sequence[str], value: Column, left_groups: Sequence[str] = (), right_groups: Sequence[str] = (), name: str = "total") -> DataFrame:
    """Sum over the join of an expression of the left side, grouped by columns of either or both sides."""
    keys = _keys(on)
    a = _side(left, keys, left_groups, F.sum(value).alias("_s"))
    b = _side(right, keys, right_groups, F.count("*").alias("_n"))
    joined, total = a.join(b, keys), F.sum(F.col("_s") * F.col("_n")).alias(name)
    return joined.groupBy(*left_groups, *right_groups).agg(total) if left_groups or right_groups else joined.agg(total)


def join_sum_product(left: DataFrame, right: DataFrame, on: str | Sequence[str], left_value: Column, right_value: Column, name: str = "total") -> DataFrame:
    """Sum over the join of a product of one expression from each side."""
    keys = _keys(on)
    a = _side(left, keys, (), F.sum(left_value).alias("_x"))
    b = _side(right, keys, (), F.sum(right_value).alias("_y"))
    return a.join(b, keys).agg(F.sum(F.col("_x") * F.col("_y")).alias(name))


def join_sum_ratio(left: DataFrame, right: DataFrame, on: str | Sequence[str], top: Column, bottom: Column, factor: float = 1.0, name: str = "total") -> DataFrame:
    """Sum over the join of factor * top / bottom; pairs with a zero below give null and add nothing."""
    inverse = F.lit(1.0) / F.nullif(bottom.cast("double"), F.lit(0.0))
    return join_sum_product(left, right, on, F.lit(factor) * top, inverse, name)


def group_count(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """group_count: how many groups there are."""
    return df.select(*groups).distinct().agg(F.count("*").alias("group_count"))


class Part(NamedTuple):
    """An aggregate over the join: Sum, Count, Min or Max of an expression over one row of each side.
    Those of Sum and Count are products with a factor of each side."""

    kind: str
    of: Callable[[Callable[[str], Column]], Column]  #: the expression, from what gives a named column
    name: str
    kind_of_value: str | None = None  #: the result's type, if not Spark's

    def typed(self, total: Column) -> Column:
        return (total.cast(self.kind_of_value) if self.kind_of_value else total).alias(self.name)


def met(left: DataFrame, right: DataFrame, keys: Sequence[str], left_groups: Sequence[str], right_groups: Sequence[str], parts: Sequence[Part]) -> DataFrame:
    """Groups and aggregates over the join of two sides that hold one row a key and group."""
    total = [_FINAL[p.kind](p.of(F.col)) for p in parts]
    total = [p.typed(F.coalesce(t, F.lit(0)) if p.kind == "Count" else t) for p, t in zip(parts, total, strict=True)]
    plain = left.join(right, list(keys)).groupBy(*left_groups, *right_groups).agg(*total)
    if not left_groups or not right_groups:
        return plain
    found = _few_keys(left, right, list(keys), left_groups, right_groups)
    if found is not None:
        return _by_columns(left, right, list(keys), left_groups, right_groups, parts, plain, *found)
    dealt = _parts(left, right, list(keys), left_groups, right_groups)
    return plain if dealt is None else _by_parts(left, right, list(keys), left_groups, right_groups, total, *dealt).select(plain.columns)


def _few_keys(left: DataFrame, right: DataFrame, keys: list[str], left_groups: Sequence[str], right_groups: Sequence[str]):
    """The keys of both sides with a number each, and each side's groups, where the keys should become columns."""
    for x, y in zip(*([f.dataType.typeName() for f in s.select(keys).schema] for s in (left, right)), strict=True):
        if not {x, y} <= _WHOLE and (x != y or x not in ("string", "boolean", "date")):
            return None
    counts = []
    for s in (left, right):
        rows = s.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).limit(MOST_KEYS + 1).collect()
        if not rows or len(rows) > MOST_KEYS:
            return None
        counts.append({tuple(r[:-1]): r[-1] for r in rows})
    both = [k for k in counts[0] if k in counts[1]]
    pairs = sum(counts[0][k] * counts[1][k] for k in both)
    if pairs < LEAST_PAIRS:
        return None
    groups = [s.select(*g).distinct().count() for s, g in ((left, left_groups), (right, right_groups))]
    if groups[0] * groups[1] > SPARE * pairs:
        return None
    return both, groups


def _by_columns(left, right, keys, left_groups, right_groups, parts, plain, both, groups) -> DataFrame:
    numbered = left.sparkSession.createDataFrame([(*k, n, 1 << n) for n, k in enumerate(both)], left.select(keys).schema.add("_n", "integer").add("_bit", "long"))
    dealt = 0 if groups[0] >= groups[1] else 1
    deal = min(groups[dealt], max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups[0] * groups[1] // ROWS))
    wide = []
    for s, (df, own) in enumerate(((left, left_groups), (right, right_groups))):
        values = [c for c in df.columns if c not in keys and c not in own]
        rows = df.join(F.broadcast(numbered), keys)
        if s == dealt:
            rows = rows.repartition(deal, *own)
        each = [F.max(F.when(F.col("_n") == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in range(len(both))]
        wide.append(rows.groupBy(*own).agg(F.bit_or("_bit").alias(f"_has{s}"), *each))
    if groups[1 - dealt] <= MOST_SENT:
        wide[1 - dealt] = F.broadcast(wide[1 - dealt])
    shared = F.col("_has0").bitwiseAND(F.col("_has1"))
    out = []
    for p in parts:
        each = [p.of(lambda v, n=n: F.col(f"{v}_{n}")) for n in range(len(both))]
        if p.kind in ("Sum", "Count"):
            whole = functools.reduce(operator.add, [F.coalesce(e, F.lit(0)) for e in each])
            whole = F.when(F.coalesce(*each).isNotNull(), whole) if p.kind == "Sum" else whole
        else:
            each = [F.when(shared.bitwiseAND(F.lit(1 << n)) != 0, e) for n, e in enumerate(each)]
            whole = each[0] if len(each) == 1 else (F.least if p.kind == "Min" else F.greatest)(*each)
        out.append(whole.cast(plain.schema[p.name].dataType).alias(p.name))
    joined = wide[dealt].crossJoin(wide[1 - dealt]).filter(shared != 0)
    return joined.select(*left_groups, *right_groups, *out).select(plain.columns)


def _with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys]))


def _parts(left: DataFrame, right: DataFrame, keys: list[str], left_groups: Sequence[str], right_groups: Sequence[str]) -> tuple[int, int] | None:
    """Into how many parts each side's groups should be dealt, where that shuffles fewer rows than the join's result."""
    sides = ((left, left_groups), (right, right_groups))
    for s, own in sides:
        if any(t not in _HASHED and not t.startswith("decimal") for t in (s.schema[c].dataType.simpleString() for c in own)):
            return None
    for x, y in zip(*([s.schema[k].dataType for k in keys] for s in (left, right)), strict=True):
        if x != y and not {x.typeName(), y.typeName()} <= _WHOLE:
            return None
    each = [_with_keys(s, keys).groupBy(*keys).agg(F.count("*").cast("double").alias(n)) for s, n in ((left, "_n0"), (right, "_n1"))]
    sums = each[0].join(each[1], keys, "full").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("_n0") * F.col("_n1"), F.col("_n0"), F.col("_n1"))])
    pairs, *rows = sums.first()
    if pairs < LEAST_PAIRS:
        return None
    groups = [s.select(*g).distinct().count() for s, g in sides]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(MOST_TASKS, max(tasks, pairs / PAIRS))
    p = min(groups[0], max(1, math.ceil((blocks * rows[0] / rows[1]) ** 0.5)))
    q = min(groups[1], max(1, math.ceil(blocks / p)))
    shuffled = min(pairs, float(groups[0]) * groups[1] * tasks)
    return (p, q) if SAVED * (q * rows[0] + p * rows[1]) <= shuffled else None


def _by_parts(left, right, keys, left_groups, right_groups, total, p, q) -> DataFrame:
    """Part a of the left groups meets part b of the right ones in task a * q + b, to which a side's rows go once for each part of the other."""
    a, b = (F.pmod(F.xxhash64(*own), F.lit(n)).cast("int") for own, n in ((left_groups, p), (right_groups, q)))
    to = [F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda x: a * q + x), F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda x: x * q + b)]
    sent, types = [], [F.struct(*[c for c in s.columns if c not in keys]) for s in (left, right)]
    for s, df in enumerate((left, right)):
        by = [(F.col(k).cast("long") if df.schema[k].dataType.typeName() in _WHOLE else F.col(k)).alias(k) for k in keys]
        own = [types[n] if n == s else F.lit(None).cast((left, right)[n].select(types[n].alias("x")).schema["x"].dataType) for n in (0, 1)]
        sent.append(_with_keys(df, keys).select(F.explode(to[s]).alias("_to"), *by, *[o.alias(f"_s{n}") for n, o in enumerate(own)]))
    rows = sent[0].unionByName(sent[1]).repartitionById(p * q, "_to")
    rows = rows.groupBy("_to", *keys).agg(*[F.collect_list(f"_s{n}").alias(f"_s{n}") for n in (0, 1)])
    rows = rows.select("_to", F.explode("_s0").alias("_s0"), "_s1").select("_to", "_s0", F.explode("_s1").alias("_s1"))
    rows = rows.select("_to", *[F.col(f"_s{n}")[c].alias(c) for n, df in enumerate((left, right)) for c in df.columns if c not in keys])
    return rows.groupBy("_to", *left_groups, *right_groups).agg(*total)
