"""JSON columns as variants: parsed once, read by typed paths, and the schema that all rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str, name: str = "variant") -> DataFrame:
    """rows with a variant of a JSON text; null where it is null or no JSON."""
    return rows.withColumn(name, F.try_parse_json(column))


def field(variant: str, path: str, kind: str) -> Column:
    """The value at a path as a type; null where the path is missing or the value doesn't fit."""
    return F.try_variant_get(F.col(variant), path, kind)


def schema_by(rows: DataFrame, by: str, variant: str = "variant") -> DataFrame:
    """(by, n, n_invalid, schema): rows, rows without a variant, and the narrowest schema that all variants of a group fit."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(variant).isNull()).alias("n_invalid"), F.schema_of_variant_agg(variant).alias("schema"))
