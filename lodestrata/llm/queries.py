"""The queries of this package's operators over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, embedding_dedup, infill, kdtree, language_id, license_scan, packing, prefix_trie, quality, simhash, substring_dedup, token_counts
from ._spark import crc32_mod, table


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file on this machine (the same on executors)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_topk_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", F.expr("transform(embedding, x -> case when abs(256 * cast(x as double)) < 9e15 then 1.0d * floor(256 * cast(x as double)) else 256 * cast(x as double) end)"))
    return kdtree.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(turns))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"))
    known = table(spark, sf_dir, "labels").select("doc_id", "quality")
    learn = known.where(crc32_mod(F.col("doc_id"), 5) != 0)
    model = quality.fit_quality_of(docs.where("not held_out").select("doc_id", "text"), learn)
    return quality.score_quality(docs, model, threshold=0.3)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model"))


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    sample = language_id.fit_language_sample(docs.where("not held_out"))
    return language_id.identify_language(docs.drop("lang"), sample).drop("text")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")).drop("ids")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rebuilt = infill.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_topk_kdtree, op3_chat_format, op4_quality, op5_token_counts, op6_simhash_bktree, op7_language_id, op8_substring_dedup, op9_license_scan, op10_packing, op11_embedding_dedup, op12_infill, op13_prefix_trie)
}

_TURNS = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'"

ORACLES: dict[str, str] = {
    "op9_license_scan": license_scan.oracle(),
    "op11_embedding_dedup": embedding_dedup.oracle(),
    "op12_infill": infill.oracle(),
    "op13_prefix_trie": prefix_trie.oracle(),
    "op2_topk_kdtree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
