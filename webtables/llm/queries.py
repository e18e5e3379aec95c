"""The registered queries opN_<name> over whole tables; SQL twins are in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.llm import bpe
from webtables.llm.alignment import align
from webtables.llm.centroids import cluster, summary, whole_vectors
from webtables.llm.decontamination import find_leaks
from webtables.llm.exchange import importable
from webtables.llm.fingerprints import fingerprints, likeness
from webtables.llm.html_consensus import extract_text
from webtables.llm.line_dedup import without_repeated_lines
from webtables.llm.packing import pack
from webtables.llm.partenum import jaccard_components
from webtables.llm.suffix_dedup import dedup_bytes
from webtables.llm.super_kmers import dedup_windows
from webtables.llm.toxicity import fit, score
from webtables.llm.url_templates import judge_urls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/pages.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", ",").alias("fingerprint"),
        F.array_join("edited_sketch", ",").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("score")


def op7_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op8_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_windows(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The contract's rules.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(pages(spark, sf_dir), URL_RULES)


def op9_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(pages(spark, sf_dir)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fold."""
    return importable(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold() != 0)


def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs.select("doc_id", "text"), fit(docs, training_labels(spark, sf_dir)), name="score")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_geometric_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = importable(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return summary(*cluster(whole_vectors(table, 64, 256), k=40, rounds=5, seed="2", size=64))


def op13_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.withColumn("groups_sha256", digest).drop("groups")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_templates": op2_url_templates,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_scaled_fingerprints": op5_scaled_fingerprints,
    "op6_bm25_decontamination": op6_bm25_decontamination,
    "op7_partenum_join": op7_partenum_join,
    "op8_super_kmers": op8_super_kmers,
    "op9_html_consensus": op9_html_consensus,
    "op10_kneser_ney_toxicity": op10_kneser_ney_toxicity,
    "op11_speculative_bpe": op11_speculative_bpe,
    "op12_geometric_kmeans": op12_geometric_kmeans,
    "op13_merge_path_alignment": op13_merge_path_alignment,
}
