"""Hash-derived columns: content identity, deterministic stand-ins for models, minted ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import whole_rank


def content_hash(text: Column) -> Column:
    """Identity of a source unit."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def hash_embedding(text: Column, dim: int) -> Column:
    """A deterministic vector: component i is byte i mod 32 of the text's SHA-256 over 255."""
    if dim < 1:
        raise ValueError("dim must be at least 1")
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255.0)


def pair_score(query: Column, doc: Column) -> Column:
    """A deterministic relevance: the first eight hex digits of the pair's SHA-256 over their maximum."""
    return F.conv(F.substring(F.sha2(F.concat(query, F.lit("\0"), doc), 256), 1, 8), 16, 10).cast("double") / 4294967295.0


def minted_ids(kinds: DataFrame) -> DataFrame:
    """(kind, ord) rows get n = 0, 1, ... per kind in the order of ord, and the id that kind and n give; a kind may span many tasks."""
    ranked = whole_rank(kinds, [F.col("kind"), F.col("ord")], "place")
    first = ranked.groupBy("kind").agg(F.min("place").alias("first_place"))
    numbered = ranked.join(first, ranked["kind"].eqNullSafe(first["kind"])).drop(first["kind"])
    return numbered.withColumn("n", F.col("place") - F.col("first_place")).drop("place", "first_place").withColumn("minted_id", F.concat(F.lit("fakeid-"), F.substring(F.sha2(F.concat("kind", F.lit("\0"), F.col("n").cast("string")), 256), 1, 24)))


def source_root_hash(files: DataFrame, by: str, path: str, digest: str) -> DataFrame:
    """One hash per project over its sorted path:hash lines."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat(F.col(path), F.lit(":"), F.col(digest)))), "\n")
    return files.groupBy(by).agg(F.sha2(lines, 256).alias("source_root_hash"))
