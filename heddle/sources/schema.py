"""Table declarations: NAME|COL:TYPE[:LEN]|... , one table per line."""

from __future__ import annotations

from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType, StructField, StructType

#: Declared type -> Spark type. DATE is an integer yyyymmdd in delimited text.
TYPES: dict[str, DataType] = {"INTEGER": IntegerType(), "DECIMAL": DoubleType(), "TEXT": StringType(), "DATE": IntegerType()}


def parse_schema(text: str) -> dict[str, StructType]:
    """Tables by upper-case name. Raises ValueError for a type that isn't known."""
    tables: dict[str, StructType] = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        name, *columns = filter(None, (part.strip() for part in line.upper().split("|")))
        fields = []
        for column in columns:
            label, _, kind = column.partition(":")
            kind = kind.partition(":")[0]
            if kind not in TYPES:
                raise ValueError(f"{name}.{label}: type {kind or 'missing'} is none of {', '.join(TYPES)}")
            fields.append(StructField(label, TYPES[kind]))
        if len({f.name for f in fields}) != len(fields):
            raise ValueError(f"{name}: a column is declared twice")
        tables[name] = StructType(fields)
    return tables


def read_schema(path: str) -> dict[str, StructType]:
    with open(path, encoding="utf-8") as f:
        return parse_schema(f.read())
