"""Finding and classifying source files, and reading external code graphs."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.graph import MIN_SCHEMA_VERSION

#: What counts as a document of a project.
DOC_PATTERN = r"(?i)(^|/)((readme|architecture|contributing|changelog)[^/]*|[^/]+\.(md|mdx|rst|adoc|ipynb)|openapi[^/]*\.(ya?ml|json)|swagger[^/]*\.(ya?ml|json))$|(^|/)(docs|adr|\.github)/"

#: Classification rules by priority: pattern on the path, then the tags.
RULES = [
    (10, r"(?i)(^|/)changelog[^/]*$", "human", "changelog", "owned"),
    (11, r"(?i)(^|/)readme[^/]*$", "human", "readme", "owned"),
    (12, r"(?i)(^|/)contributing[^/]*$", "human", "contributing", "owned"),
    (20, r"(?i)(^|/)adr/", "human", "adr", "owned"),
    (30, r"(?i)(openapi|swagger)[^/]*\.(ya?ml|json)$", "generated", "api_schema", "foreign"),
    (40, r"(?i)(^|/)(node_modules|vendor|third_party)/", "external", "vendored", "foreign"),
    (50, r"(?i)\.ipynb$", "human", "notebook", "supplemental"),
    (60, r"(?i)(^|/)docs/", "human", "guide", "owned"),
]


def discover(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, length, modified, content) of the documents under root, whatever store it is in; ignored patterns are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(F.col("path"), "length", F.col("modificationTime").alias("modified"), "content").where(F.col("path").rlike(DOC_PATTERN))
    return without_ignored(rows, ignore or [])


def without_ignored(files: DataFrame, ignore: list[str]) -> DataFrame:
    """Files whose path matches none of the ignore globs (*, ** and ? as usual; a trailing slash means the folder)."""
    for g in ignore:
        files = files.where(~F.col("path").rlike(glob_pattern(g)))
    return files


def glob_pattern(g: str) -> str:
    out, k = "", 0
    g = g + "**" if g.endswith("/") else g
    while k < len(g):
        if g.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
        elif g.startswith("**", k):
            out, k = out + ".*", k + 2
        elif g[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif g[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + (g[k] if g[k].isalnum() or g[k] in "/_-" else "\\" + g[k]), k + 1
    return f"(^|/){out}$"


def ignore_patterns(lines: DataFrame) -> DataFrame:
    """(dir, place, pattern, negated) of the rules in ignore files (dir, line_no, line); blank lines and comments are none.

    As usual: `!` takes a path in again, a trailing slash means folders only, a slash
    before the end ties a rule to its file's folder, * and ? stop at slashes and **
    does not. Brackets stand for themselves.
    """
    said = F.rtrim(F.regexp_replace("line", "\r$", ""))
    rows = lines.select("dir", F.col("line_no").alias("place"), said.alias("said")).where("said != '' and not startswith(said, '#')")
    rows = rows.select("dir", "place", F.startswith("said", F.lit("!")).alias("negated"), F.regexp_replace("said", "^!", "").alias("rule"))
    folder, tied = F.endswith("rule", F.lit("/")), F.regexp_replace("rule", "/$", "").contains("/")
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace("rule", "/$", ""), "^/", ""), r"([.+^$(){}|\[\]\\])", r"\\$1")
    for a, b in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        glob = F.replace(glob, F.lit(a), F.lit(b))
    return rows.select("dir", "place", F.concat(F.when(tied, "^").otherwise("^(?:.*/)?"), glob, F.when(folder, "/.*$").otherwise("(?:/.*)?$")).alias("pattern"), "negated")


def without_ignored_by(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path, ...) that no rule takes out: of all rules of a path's folders that match, the deepest folder's last one decides.

    A path meets the rules of its own folders by equality; dir is relative, the
    root's is empty. Paths are unique.
    """
    parts = F.split("path", "/", -1)
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = files.select("path", F.explode(folders).alias("dir")).join(rules, "dir")
    rest = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substring("path", F.length("dir") + 2, F.lit(1 << 30)))
    hit = met.where(F.regexp_like(rest, F.col("pattern")))
    out = hit.groupBy("path").agg(F.max_by("negated", F.struct(F.length("dir"), "place")).alias("back")).where("not back")
    return files.join(out, "path", "left_anti")


def classify(files: DataFrame, rules: DataFrame | None = None, path: str = "path") -> DataFrame:
    """files with producer, doc_type and ownership by the first rule that matches; none: human, other, owned.

    Rules are a small registry (priority, pattern, producer, doc_type, ownership)
    and are broadcast.
    """
    spark = files.sparkSession
    rules = rules if rules is not None else spark.createDataFrame(RULES, "priority int, pattern string, producer string, doc_type string, ownership string")
    hits = files.select(path).distinct().join(F.broadcast(rules), F.expr(f"{path} rlike pattern"))
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy(path).orderBy("priority"))).where("n = 1").select(path, "producer", "doc_type", "ownership")
    told = files.join(best, path, "left")
    default = {"producer": "human", "doc_type": "other", "ownership": "owned"}
    return told.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in default.items()})


def project_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?:[a-z]+:/+)?/*([^/]+)", 1)


class CodeGraphSource(DataSource):
    """Format `codegraph`: a table of a read-only SQLite code graph, split by row ids.

    Options: path of the file (readable on every executor), table (nodes, edges,
    files or unresolved_refs), partitions. A graph whose schema is too old is refused.
    """

    TABLES = {
        "nodes": "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported int",
        "edges": "id long, source string, target string, kind string",
        "files": "path string, content_hash string, language string, size long",
        "unresolved_refs": "id long, from_node_id string, reference_name string, reference_kind string, candidates string, file_path string, language string",
    }

    @classmethod
    def name(cls) -> str:
        return "codegraph"

    def schema(self) -> str:
        return self.TABLES[self.options.get("table", "nodes")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return CodeGraphReader(self.options, [f.name for f in schema])


class RowRange(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class CodeGraphReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.table, self.parts, self.columns = options["path"], options.get("table", "nodes"), int(options.get("partitions", "4")), columns

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[RowRange]:
        with self._open() as con:
            version = con.execute("SELECT max(version) FROM schema_versions").fetchone()[0]
            if version is None or version < MIN_SCHEMA_VERSION:
                raise ValueError(f"graph schema {version}; {MIN_SCHEMA_VERSION} is needed")
            lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if lo is None:
            return []
        step = -(-(hi - lo + 1) // self.parts)
        return [RowRange(k, min(k + step, hi + 1)) for k in range(lo, hi + 1, step)]

    def read(self, part: RowRange) -> Iterator[tuple]:
        with self._open() as con:
            yield from con.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (part.lo, part.hi))
