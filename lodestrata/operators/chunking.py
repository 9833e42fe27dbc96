"""Chunkers and anchors: sized pieces, heading sections, Python scopes, cited spans."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.hashing import content_hash

CHUNK_CHARS = 2000
LINE_WINDOW = 40


def sized_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", cap: int = CHUNK_CHARS) -> DataFrame:
    """(key, ordinal, chunk_id, chunk_text, content_hash): consecutive pieces of at most cap characters; empty texts have none."""
    n = F.ceil(F.length(text) / cap).cast("int")
    parts = docs.where(F.length(text) > 0).select(F.col(key), F.col(text), F.explode(F.sequence(F.lit(0), n - 1)).alias("ordinal"))
    piece = F.substr(F.col(text), F.col("ordinal") * cap + 1, F.lit(cap))
    return parts.select(key, F.col("ordinal").cast("long").alias("ordinal"), F.concat(F.col(key).cast("string"), F.lit("#"), F.col("ordinal").cast("string")).alias("chunk_id"), piece.alias("chunk_text"), content_hash(piece).alias("content_hash"))


def heading_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, heading_path, register, n_lines, body) by the levels 1 to 3 of Markdown headings.

    A heading opens a section and resets the deeper levels; lines in code fences
    are no headings. What stands before the second section is the plain summary,
    the rest is deep.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "said"))
    by = Window.partitionBy(key).orderBy("line")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fenced = F.sum(F.col("said").startswith("```").cast("int")).over(upto) % 2 == 1
    level = F.when(~F.col("fenced") & F.col("said").rlike(r"^#{1,3} +\S"), F.length(F.regexp_extract("said", r"^(#{1,3}) ", 1)))
    rows = lines.withColumn("fenced", fenced | F.col("said").startswith("```")).withColumn("level", level)
    title = F.regexp_extract("said", r"^#{1,3} +(.*)$", 1)
    for k in (1, 2, 3):
        here = F.when(F.col("level") == k, title).when(F.col("level") < k, F.lit(""))
        rows = rows.withColumn(f"h{k}", F.coalesce(F.last(here, ignorenulls=True).over(upto), F.lit("")))
    rows = rows.withColumn("section", F.sum(F.col("level").isNotNull().cast("long")).over(upto))
    path = F.concat_ws(" > ", *[F.when(F.col(f"h{k}") != "", F.col(f"h{k}")) for k in (1, 2, 3)])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n")
    return rows.withColumn("heading_path", path).groupBy(key, "section", "heading_path").agg(F.count("*").alias("n_lines"), body.alias("body")).withColumn("register", F.when(F.col("section") <= 1, "plain").otherwise("deep"))


def parsed(source: str) -> ast.Module | None:
    """The syntax tree of a Python file; None if it doesn't parse, or nests deeper than the parser's stack."""
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    except MemoryError as e:  # raised for the parser's own, fixed stack; without its message memory is short
        if "too complex to parse" not in str(e):
            raise
        return None


@udtf(returnType="name: string, kind: string, start_line: int, end_line: int")
class PythonScopes:
    """Functions and classes of a Python file with their lines; windows of lines if it doesn't parse."""

    def eval(self, source: str) -> Iterator[tuple]:
        if not source:
            return
        tree = parsed(source)
        if tree is None:
            n = source.count("\n") + 1
            for at in range(0, n, LINE_WINDOW):
                yield None, "lines", at + 1, min(n, at + LINE_WINDOW)
            return
        stack: list[tuple[str, ast.AST]] = [("", tree)]
        while stack:
            within, node = stack.pop()
            for child in reversed(list(ast.iter_child_nodes(node))):
                name = within
                if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    name = f"{within}.{child.name}" if within else child.name
                    yield name, "class" if isinstance(child, ast.ClassDef) else "function", child.lineno, child.end_lineno
                stack.append((name, child))


def python_scopes(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(path, name, kind, start_line, end_line) of each scope."""
    spark = files.sparkSession
    spark.udtf.register("python_scopes", PythonScopes)
    files.select(F.col(path).alias("path"), F.col(source).alias("source")).createOrReplaceTempView("files_for_scopes")
    return spark.sql("SELECT path, s.* FROM files_for_scopes, LATERAL python_scopes(source) s")


def parse_anchors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, target_path, line_start, line_end, valid) of each file:line or file:a-b that a text cites.

    valid is false, and the row stays, where the end lies before the start or a
    line is 0.
    """
    pattern = r"[A-Za-z0-9_./-]+\.[A-Za-z0-9]+:[0-9]{1,9}(?:-[0-9]{1,9})?"
    cited = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("pos", "said"))
    start = F.regexp_extract("said", r":([0-9]+)", 1).cast("int")
    last = F.regexp_extract("said", r":[0-9]+-([0-9]+)$", 1)
    end = F.when(last == "", start).otherwise(F.expr("try_cast(nullif(regexp_extract(said, ':[0-9]+-([0-9]+)$', 1), '') as int)"))
    out = cited.select(key, F.col("pos").cast("long").alias("pos"), F.regexp_extract("said", r"^(.*):", 1).alias("target_path"), start.alias("line_start"), end.alias("line_end"))
    return out.withColumn("valid", (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")))


def parse_span(span: Column) -> Column:
    """Struct (line_start, line_end) of `10`, `10-20` or `10:5-12:8`; null if it is none of these."""
    good = span.rlike(r"^[0-9]{1,9}(:[0-9]{1,9})?(-[0-9]{1,9}(:[0-9]{1,9})?)?\z")
    start = F.regexp_extract(span, r"^([0-9]+)", 1)
    end = F.regexp_extract(span, r"-([0-9]+)", 1)
    return F.when(good, F.struct(start.cast("int").alias("line_start"), F.when(end == "", start).otherwise(end).cast("int").alias("line_end")))


def with_context(context: Column, chunk: Column) -> Column:
    """A chunk under its context; without one, alone."""
    return F.concat_ws("\n\n", context, chunk)
