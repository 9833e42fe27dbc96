"""What the query modules share: tables, inline fixtures for both engines, whole microseconds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SQL_TYPE = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Fixture:
    """Rows that both engines see: frame() for Spark, sql() for DuckDB.

    `more` is a SELECT over the driver's tables, written {table}, and the given rows,
    written {rows}, in words that both engines understand; its rows come beside the
    given ones, which are the corner cases. Without it the rows are parameters.
    """

    def __init__(self, ddl: str, rows: list[tuple], more: str = ""):
        self.ddl, self.rows, self.more = ddl, rows, more
        self.fields = [tuple(f.split()) for f in ddl.split(", ")]
        self.tables = sorted(set(re.findall(r"\{(\w+)\}", more)))

    def frame(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        rows = spark.createDataFrame(self.rows, self.ddl)
        if not self.more:
            return rows
        told = spark.sql(self.more, **{t: rows if t == "rows" else table(spark, sf_dir, t) for t in self.tables})
        return rows.unionByName(told.select(*[F.col(n).cast(t).alias(n) for n, t in self.fields]))

    def sql(self) -> str:
        def literal(v: object) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return "true" if v else "false"
            if isinstance(v, str):
                return " || ".join("'" + p.replace("'", "''") + "'" for p in v.split("\n")).replace("' || '", "' || chr(10) || '")
            return repr(v)

        rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        names = ", ".join(n for n, _ in self.fields)
        cast = ", ".join(f"CAST({n} AS {_SQL_TYPE[t]}) AS {n}" for n, t in self.fields)
        given = f"SELECT {cast} FROM (VALUES {rows}) AS fixture({names})"
        told = f" UNION ALL SELECT {cast} FROM ({self.more.format(**{t: f'({given})' if t == 'rows' else t for t in self.tables})})" if self.more else ""
        return f"({given}{told})"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    i = f"({ts} - timestamp_ntz'1970-01-01 00:00:00')"
    return F.expr(f"extract(DAY FROM {i}) * 86400000000L + extract(HOUR FROM {i}) * 3600000000L + extract(MINUTE FROM {i}) * 60000000L + cast(extract(SECOND FROM {i}) * 1000000 AS bigint)")


def re2(replacement: str) -> str:
    """A Java replacement string as RE2 wants it."""
    out = replacement
    for k in range(1, 10):
        out = out.replace(f"${k}", f"\\{k}")
    return out


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
