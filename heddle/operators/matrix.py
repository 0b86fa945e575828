"""Matrices as relations (i, j, v): products in three forms, and what goes with them.

sparse: join on the shared index and sum, without a shuffle of the product where that index
has few values (fused.met). dense and blocked: cells are gathered into
square NumPy blocks, matching blocks meet by a join, and their products are summed as blocks;
blocked uses smaller blocks, for products that outgrow a task. All give the same
rows: one for each pair of outer indexes that the join would give, zero sums included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators import fused
from heddle.plans import strategy as plans

DENSE_BLOCK, SMALL_BLOCK = 512, 128


def coo(df: DataFrame, i: str | Column, j: str | Column, v: str | Column = None) -> DataFrame:
    """i, j, v: one row a cell, equal cells added up; ones where no value is given."""
    value = F.lit(1) if v is None else (F.col(v) if isinstance(v, str) else v)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(i).alias("i"), col(j).alias("j"), value.alias("v")).dropna().groupBy("i", "j").agg(F.sum("v").alias("v"))


def vectors(df: DataFrame, row: str, vector: str) -> DataFrame:
    """i, j, v of a table with a vector in each row."""
    return df.select(F.col(row).alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("long"), F.col("v").cast("double"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.sum("v").alias("v"))


def column_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sum("v").alias("v"))


def non_zero(m: DataFrame) -> DataFrame:
    return m.filter(F.col("v") != 0).agg(F.count("*").alias("nnz"))


def extent(m: DataFrame) -> DataFrame:
    """Smallest and largest index of either kind and value."""
    return m.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "ijv" for f in (F.min, F.max)])


def dense_rows(m: DataFrame, columns: list) -> DataFrame:
    """i and a column for each of the given j: a one-hot or valued matrix of few columns."""
    return m.groupBy("i").pivot("j", columns).agg(F.sum("v")).fillna(0)


def _sparse(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("i", F.col("j").alias("_k"), F.col("v").alias("_x")), b.select(F.col("i").alias("_k"), "j", F.col("v").alias("_y"))
    return fused.met(x, y, ["_k"], ["i"], ["j"], [fused.Part("Sum", lambda at: at("_x") * at("_y"), "v")])


def _blocks(m: DataFrame, size: int, row: str, col: str) -> DataFrame:
    """Cells by block: _r and _c number it, two arrays hold the cells' places in it and their values."""
    r, c = (F.floor(F.col(x) / size).cast("long") for x in "ij")
    place = F.pmod(F.col("i"), F.lit(size)) * size + F.pmod(F.col("j"), F.lit(size))
    cells = F.collect_list(F.struct(place.cast("int").alias("p"), F.col("v").cast("double").alias("v")))
    return m.groupBy(r.alias(row), c.alias(col)).agg(cells.alias("cells")).select(row, col, F.col("cells.p").alias(f"p{row}{col}"), F.col("cells.v").alias(f"v{row}{col}"))


def _blocked(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Pairs of blocks meet on the inner index and go to the task of the block of the product that
    they add to, where one block is summed up at a time; each cell of the product is a row once.
    A block holds at most size * size cells, so the arrays are bounded."""

    def cells(r, c, product, pairs):
        i, j = np.nonzero(pairs > 0.5)  # cells that some pair of entries reaches
        return pa.RecordBatch.from_arrays([pa.array(r * size + i), pa.array(c * size + j), pa.array(product[i, j])], ["i", "j", "v"])

    def multiply(batches):
        at, product, pairs = None, None, None
        for batch in batches:
            rows, numbers = batch.num_rows, [batch.column(k).to_numpy() for k in range(2)]
            for n in range(rows):
                own = int(numbers[0][n]), int(numbers[1][n])
                if own != at:
                    if at is not None:
                        yield cells(*at, product, pairs)
                    at, product, pairs = own, np.zeros((size, size)), np.zeros((size, size))
                full, there = np.zeros((2, size * size)), np.zeros((2, size * size))
                for side in range(2):
                    place, value = (batch.column(2 + 2 * side + k)[n].values.to_numpy() for k in range(2))
                    full[side, place], there[side, place] = value, 1
                x, y, has, too = (m.reshape(size, size) for m in (*full, *there))
                product += x @ y
                pairs += has @ too
        if at is not None:
            yield cells(*at, product, pairs)

    met = _blocks(a, size, "r", "k").join(_blocks(b, size, "k", "c"), "k").select("r", "c", "prk", "vrk", "pkc", "vkc")
    return met.repartition("r", "c").sortWithinPartitions("r", "c").mapInArrow(multiply, "i long, j long, v double")


def matmul(a: DataFrame, b: DataFrame, strategy: str = "auto", block: int | None = None) -> DataFrame:
    """i, j, v of a * b, both given as i, j, v; equal cells are added up first.

    Dense and blocked forms need integer indexes; negative ones are fine.
    """
    a, b = (coo(m, "i", "j", "v") for m in (a, b))
    if strategy == "auto":
        keys = a.select("j").distinct().count()
        n = a.count() + b.count()
        outer = a.select("i").distinct().count() + b.select("j").distinct().count()
        strategy = plans.choose(keys, n / 2, True, keys * outer).strategy
    if strategy == "sparse":
        return _sparse(a, b)
    if strategy not in ("dense", "blocked"):
        raise ValueError(f"{strategy!r} is none of auto, sparse, dense and blocked")
    return _blocked(a, b, block or (DENSE_BLOCK if strategy == "dense" else SMALL_BLOCK))
