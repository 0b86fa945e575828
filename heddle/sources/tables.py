"""Readers, writers, generators and statistics of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = "|") -> DataFrame:
    """Delimited text without header; a delimiter at the line's end adds no column."""
    return spark.read.schema(schema).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def load(spark: SparkSession, path: str, schema: StructType, target: str, sep: str = "|") -> DataFrame:
    """Bulk load: text to Parquet columns, and the table read back."""
    read_delimited(spark, path, schema, sep).write.mode("overwrite").parquet(target)
    return spark.read.schema(schema).parquet(target)


def clustered(df: DataFrame, *columns: str, partitions: int | None = None) -> DataFrame:
    """Rows ranged and sorted by columns, so that their statistics prune row groups once written."""
    ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return ranged.sortWithinPartitions(*columns)


def append(*tables: DataFrame) -> DataFrame:
    """Blocks of one table under each other, by column name."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def dense_matrix(spark: SparkSession, dim: int, top: int = 256, seed: int = 0) -> DataFrame:
    """i, j, val for every cell of a dim x dim matrix; values 0 .. top-1, the same for a seed everywhere."""
    cells = spark.range(dim * dim)
    i, j = F.expr(f"id DIV {dim}").cast("int"), F.pmod("id", F.lit(dim)).cast("int")
    return cells.select(i.alias("i"), j.alias("j"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(top)).cast("int").alias("val"))


def column_stats(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """column_name, n, n_distinct, min_value, max_value (as text) of each column, in one scan."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    each = [x for c in columns for x in (F.count(c).alias(f"{c}.n"), count(c).alias(f"{c}.d"), F.min(c).cast("string").alias(f"{c}.lo"), F.max(c).cast("string").alias(f"{c}.hi"))]
    one = df.agg(*each)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}.{k}`").alias(a) for k, a in (("n", "n"), ("d", "n_distinct"), ("lo", "min_value"), ("hi", "max_value")))) for c in columns]))
    return one.select(rows.alias("r")).select("r.*")


def join_key_stats(a: DataFrame, b: DataFrame, key_a: str, key_b: str | None = None) -> DataFrame:
    """n_distinct over both sides' keys, and mean_rows of a side."""
    keys = a.select(F.col(key_a).alias("k")).unionAll(b.select(F.col(key_b or key_a).alias("k")))
    return keys.agg(F.count_distinct("k").alias("n_distinct"), F.expr("count(*) DIV 2").alias("mean_rows"))
