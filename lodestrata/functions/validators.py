"""Ingress checks as columns: each gives a reason, or null for a good row. Nothing is coerced or dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def strip(text: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def identity_problem(text: Column) -> Column:
    """Stripped, 1 to 1024 characters, no control, format or separator character."""
    s = strip(text)
    return F.when(text.isNull(), "missing").when(F.length(s) < 1, "empty").when(F.length(s) > schemas.MAX_IDENTITY, "too_long").when(s.rlike(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"), "control_character")


def text_problem(text: Column) -> Column:
    """Stripped, 1 to 8192 characters, no control character but tab and line ends."""
    s = strip(text)
    return F.when(text.isNull(), "missing").when(F.length(s) < 1, "empty").when(F.length(s) > schemas.MAX_TEXT, "too_long").when(s.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\u0080-\u009F]"), "control_character")


def query_problem(text: Column) -> Column:
    s = strip(text)
    return F.when(text.isNull(), "missing").when(F.length(s) < 1, "empty").when(F.length(s) > schemas.MAX_QUERY_LEN, "too_long")


def path_problem(path: Column) -> Column:
    """A relative path of ASCII letters, digits, dot, underscore, slash and hyphen, without a parent segment."""
    return F.when(path.isNull() | (path == ""), "empty").when(~path.rlike(r"^[A-Za-z0-9._/-]+\z"), "charset").when(path.startswith("/"), "absolute").when(F.array_contains(F.split(path, "/", -1), ".."), "traversal")


def top_k_problem(k: Column) -> Column:
    return F.when(k.isNull(), "missing").when((k < 1) | (k > schemas.MAX_TOP_K), "out_of_range")


def member_problem(value: Column, alphabet: tuple[str, ...]) -> Column:
    return F.when(value.isNull(), "missing").when(~value.isin(*alphabet), "not_a_member")


def unit_problem(x: Column) -> Column:
    return F.when(x.isNull(), "missing").when(F.isnan(x) | (x < 0) | (x > 1), "out_of_range")


def codegraph_dir(value: Column) -> Column:
    """The directory name to use: a plain name is taken, anything else falls back to the default."""
    s = strip(value)
    good = s.rlike(r"^[A-Za-z0-9._-]+\z") & ~s.isin(".", "..") & ~s.startswith("-")
    return F.when(F.coalesce(good, F.lit(False)), s).otherwise(".codegraph")


def first_problem(checks: dict[str, Column]) -> Column:
    """`column:reason` of the first failing check, in order."""
    return F.coalesce(*[F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), c)) for name, c in checks.items()])


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected ones with their reason."""
    told = rows.withColumn("reason", first_problem(checks))
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def check_closed(df: DataFrame, schema: T.StructType) -> None:
    """Raises unless df has the schema's fields, no more and no less, with their types."""
    have, want = {f.name: f.dataType.simpleString() for f in df.schema}, {f.name: f.dataType.simpleString() for f in schema}
    if have != want:
        raise ValueError(f"fields differ: {sorted(set(have.items()) ^ set(want.items()))}")


def null_problem(schema: T.StructType) -> Column:
    """The first required field that is null."""
    return F.coalesce(*[F.when(F.col(f.name).isNull(), f"{f.name}:missing") for f in schema if not f.nullable])


def parse_closed(raw: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """JSON objects of `column` parsed against a closed schema: `row` and `reason` (null if good).

    Unknown keys, missing required keys and values of another type are reasons;
    a value is never coerced.
    """
    keys = F.json_object_keys(F.col(column))
    names = F.array(*[F.lit(f.name) for f in schema])
    unknown = F.array_except(keys, names)
    required = F.array(*[F.lit(f.name) for f in schema if not f.nullable])
    as_text = F.from_json(F.col(column), T.MapType(T.StringType(), T.StringType()))
    row = F.from_json(F.col(column), T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    out = raw.withColumn("row", row).withColumn("__text", as_text)
    wrong = [F.when(F.col("__text")[f.name].isNotNull() & F.col("row")[f.name].isNull(), f"{f.name}:type") for f in schema]
    return out.withColumn(
        "reason",
        F.coalesce(
            F.when(keys.isNull(), "not_an_object"),
            F.when(F.size(unknown) > 0, F.concat(F.element_at(F.array_sort(unknown), 1), F.lit(":unknown"))),
            *wrong,
            *[F.when(F.col("row")[f.name].isNull(), f"{f.name}:missing") for f in schema if not f.nullable],
            F.when(F.size(F.array_except(required, keys)) > 0, "missing"),
        ),
    ).drop("__text")
