"""Helpers that the operators of this package share on the Spark side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..durable import Workspace, Written, shared_folder

__all__ = ["Workspace", "Written", "carry_through", "crc32_mod", "numbered", "only", "place_of", "release_shuffles", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(col: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m; null stays null."""
    return F.crc32(col.cast("string")) % F.lit(m)


def place_of(names: list[str], name: str) -> int:
    """Where a column stands: the first of exactly that name, else the first but for case."""
    if name in names:
        return names.index(name)
    folded = [n.lower() for n in names]
    if name.lower() in folded:
        return folded.index(name.lower())
    raise ValueError(f"no column {name!r} among {names}")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by their places, so that no name can clash with another."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def only(df: DataFrame, **names: str) -> DataFrame:
    """The columns of df that names says (new name=old one); whatever else df holds, whatever its names, is not read."""
    return numbered(df).select(*[F.col(f"c{place_of(df.columns, old)}").alias(new) for new, old in names.items()])


def carry_through(df: DataFrame, text: str, result: str, run: Callable[[pa.RecordBatch, int], Iterator[tuple[int, int, list]]], drop_text: bool = False) -> DataFrame:
    """df with the columns of result (DDL), of which run gives the arrays for runs of rows, from a batch and its text's place.

    Columns of df named like one of result, in any case, are replaced; all others
    pass, whatever their names.
    """
    added = StructType.fromDDL(result)
    new = {f.name.lower() for f in added}
    at = place_of(df.columns, text)
    keep = [k for k, c in enumerate(df.columns) if c.lower() not in new and not (drop_text and k == at)]
    src = numbered(df).select(*[f"c{k}" for k in keep], *[] if at in keep else [f"c{at}"])
    place = keep.index(at) if at in keep else len(keep)
    schema = StructType([*src.schema.fields[: len(keep)], *added.fields])
    names = schema.names

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, arrays in run(b, place):
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[: len(keep)], *arrays], names=names)

    return src.mapInArrow(mapped, schema).toDF(*[df.columns[k] for k in keep], *added.names)


def release_shuffles(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage, which frees the shuffle files of finished rounds earlier than it else would."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
