"""Declared table schemas and their validation."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVED = "note_idx"
TYPES = {
    "string": T.StringType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int": T.IntegerType(),
    "int64": T.LongType(), "long": T.LongType(), "uint32": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
}


class SchemaError(ValueError):
    """All that is wrong with the tables of a request, together."""


class _Loader(yaml.SafeLoader):
    pass


#: Types may be written plainly or with a tag that names the frame library; either way they are looked up by name.
_Loader.add_multi_constructor("!", lambda loader, suffix, node: loader.construct_scalar(node))


def load_yaml(text_or_path: str | Path) -> dict[str, Any]:
    text = Path(text_or_path).read_text(encoding="utf-8") if isinstance(text_or_path, Path) or "\n" not in str(text_or_path) else str(text_or_path)
    return yaml.load(text, Loader=_Loader)  # a SafeLoader with one plain tag


def spark_type(name: str) -> T.DataType:
    try:
        return TYPES[name.strip().lower()]
    except KeyError:
        raise SchemaError(f"unknown type {name!r}; known are {', '.join(TYPES)}") from None


def struct(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(c, spark_type(t)) for c, t in columns.items()])


def problems(name: str, df: DataFrame, columns: dict[str, str], count_nulls: bool = True) -> list[str]:
    """What keeps df from being the table `name`: missing columns, types, a reserved column, nulls in id or date (one aggregation)."""
    out = [f"{name}: the column {RESERVED} is reserved"] if RESERVED in df.columns else []
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in columns if c not in types]
    if missing:
        out.append(f"{name}: missing columns {missing}")
    out += [f"{name}.{c}: {types[c].simpleString()} instead of {spark_type(t).simpleString()}" for c, t in columns.items() if c in types and types[c] != spark_type(t)]
    keys = [c for c in ("id", "date") if c in columns and c in types]
    if keys and count_nulls:
        row = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in keys)).first()
        out += [f"{name}.{c}: {row[c]} nulls" for c in keys if row[c]]
    return out


def cast(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Strict casts of the declared columns; a value that does not fit is an error when the plan runs."""
    return df.withColumns({c: F.col(c).cast(spark_type(t)) for c, t in columns.items() if c in df.columns})


def validated(tables: dict[str, DataFrame], declared: dict[str, dict[str, str]] | None, force: bool = False, count_nulls: bool = True) -> dict[str, DataFrame]:
    """The tables, cast if forced; a SchemaError with everything that is wrong. Extra columns are allowed; without declared schemas nothing is checked."""
    if not declared:
        return tables
    out, wrong = dict(tables), []
    for name, columns in declared.items():
        if name not in tables:
            wrong.append(f"{name}: missing")
            continue
        out[name] = cast(tables[name], columns) if force else tables[name]
        wrong += problems(name, out[name], columns, count_nulls)
    if wrong:
        raise SchemaError("; ".join(wrong))
    return out
