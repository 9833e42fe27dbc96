"""A corpus pipeline: language ID, SimHash near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, language_id, packing, simhash, substring_dedup
from lodestrata.llm._spark import Workspace, only
from lodestrata.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language scores less are rejected, as are those without any letter.
MIN_LANGUAGE_SCORE = 0.3


def row_key(salt: int = 0) -> Column:
    """A row's own key, from id and text; a null is told from any value. Equal rows have equal keys."""
    return F.xxhash64(F.lit(salt), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def read(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever other columns docs has."""
    return only(docs, **{c: c for c in COLUMNS})


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in one of the labelled languages; the predicted one becomes lang.

    Rows without a text, with an empty one or one without a letter go. Rows with
    any other null, and repeated rows, are judged like others; equal rows get equal
    results. Without labelled rows none is left; an empty table gives an empty one.
    """
    docs = read(docs)
    found = language_id.identify_language(docs, language_id.fit_language_sample(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row with the smallest id stays, once.

    Rows without an id come after all others, in the order of their keys, as do
    rows of one id among themselves. Texts that are null or without a word are
    alike. Of equal rows (id and text) one stays. An empty table gives an empty one.
    """
    docs = read(docs).select(*COLUMNS, row_key().alias("row_key"), row_key(1).alias("second_key"))
    found = simhash.similar_components(docs, similarity=0.8, key="row_key", shingle=5).distinct()
    ids = docs.select(F.col("row_key").alias("doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "row_key").alias("place")).distinct()
    stay = found.join(ids, "doc_id").groupBy("component_id").agg(F.min("place").alias("place")).select("place.row_key")
    # texts move once, by an eight-byte key, and equal rows then stand side by side
    return docs.join(stay, "row_key", "left_semi").dropDuplicates(["row_key", "second_key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of passages that a document with a smaller id holds; texts without any stay as they are, emptied ones go.

    Rows without an id come after all others, in the order of their keys. Null and
    empty texts stay. Rows with equal ids don't remove from each other. An empty
    table gives an empty one.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(row_key(), 2))
    found = substring_dedup.remove_repeats(read(docs).select(*COLUMNS, place.alias("place")), key="place")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = found.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that hold a benchmark item, each row by its own key.

    A null id, an id that other rows have too and repeated rows make no difference;
    null and empty texts stay. An empty table on either side takes nothing out.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = read(docs).select(*COLUMNS, row_key().alias("row_key"))
    leaks = decontamination.find_contamination(docs, items, key="row_key").select(F.col("doc_id").alias("row_key")).distinct()
    return docs.join(leaks, "row_key", "left_anti").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; one row per piece. Null and empty texts are an end token, repeated rows documents of their own.

    An empty table gives none. As in all stages, further columns are not read, whatever their names.
    """
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", by_language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", benchmark_leaks), ("packing", sequences)]

#: No SQL can tokenise; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and reread; a table goes when the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Workspace() as w:
        for _, stage in STAGES[:-1]:
            now = w.kept(stage(spark, docs, sf_dir))
            w.drop(docs)
            docs = now
        return STAGES[-1][1](spark, w.hand_out(docs), sf_dir)
