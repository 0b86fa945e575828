"""A catalogue of tables and one entry for queries over them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from heddle.functions.catalogue import normalise
from heddle.operators import fused, graph, matrix
from heddle.plans import rewrite
from heddle.sources import schema, tables


class Engine:
    """Tables by case-insensitive name; queries return lazy DataFrames."""

    def __init__(self, spark: SparkSession, factor: str = "auto"):
        """factor: when sums over joins are factored by key: auto, always or never (see plans/rewrite.py)."""
        self.spark, self.factor, self._tables = spark, factor, {}
        self._declared: dict = {}

    def create(self, name: str, df: DataFrame) -> DataFrame:
        self._tables[name.upper()] = df
        return df

    def create_parquet(self, folder: str, names: list[str] = tables.NAMES) -> None:
        for name in names:
            self.create(name, tables.read_parquet(self.spark, folder, name))

    def declare(self, schema_file: str) -> list[str]:
        """Take the table declarations of a schema file; load() gives them rows."""
        self._declared |= schema.read_schema(schema_file)
        return sorted(self._declared)

    def load(self, name: str, path: str, sep: str = "|", target: str | None = None) -> DataFrame:
        declared = self._declared[name.upper()]
        if target:
            return self.create(name, tables.load(self.spark, path, declared, target, sep))
        return self.create(name, tables.read_delimited(self.spark, path, declared, sep))

    def list(self) -> list[str]:
        return sorted({*self._tables, *self._declared})

    def delete(self, name: str) -> None:
        self._tables.pop(name.upper(), None)
        self._declared.pop(name.upper(), None)

    def table(self, name: str) -> DataFrame:
        return self._tables[name.upper()]

    def save(self, path: str) -> None:
        """Keep the declarations, as JSON."""
        Path(path).write_text(json.dumps({k: v.jsonValue() for k, v in self._declared.items()}))

    def restore(self, path: str) -> list[str]:
        from pyspark.sql.types import StructType

        self._declared |= {k: StructType.fromJson(v) for k, v in json.loads(Path(path).read_text()).items()}
        return sorted(self._declared)

    def sql(self, query: str) -> DataFrame:
        for name, df in self._tables.items():
            df.createOrReplaceTempView(name)
        return rewrite.factored(self.spark.sql(normalise(query)), self.factor)

    def sql_file(self, path: str) -> DataFrame:
        return self.sql(Path(path).read_text())

    def explain(self, query: str, mode: str = "formatted") -> str:
        plan = self.sql(query)._jdf.queryExecution()
        return plan.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def matmul(self, a: str, b: str, strategy: str = "auto", **kw) -> DataFrame:
        return matrix.matmul(self.table(a), self.table(b), strategy=strategy, **kw)

    def pagerank(self, edges: str, **kw) -> DataFrame:
        return graph.pagerank(self.table(edges), **kw)

    def join_count(self, a: str, b: str, key: str) -> DataFrame:
        return fused.join_count(self.table(a), self.table(b), key)
