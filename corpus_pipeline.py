"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the docs of the next one. All but the last return the columns of documents.

toxicity            documents that score 0.5 or more go
line dedup          lines similar to an earlier line go, and documents that this leaves without any line
near duplicates     of each group linked by 5-word shingles the document with the smallest id stays
decontamination     documents that contain a benchmark item go
packing             pieces of at most 4096 tokens, with their sequences and offsets

Documents with null or empty text pass every filter and are one end token in the packing.
Documents without id cannot be labelled, matched by line or linked, and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.llm.decontamination import without_leaks
from webtables.llm.exchange import importable, stored
from webtables.llm.line_dedup import without_repeated_lines
from webtables.llm.packing import pack
from webtables.llm.partenum import jaccard_components
from webtables.llm.queries import tokenizer_path, training_labels
from webtables.llm.toxicity import fit, score

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Rows go to Python and back by a few megabytes, unless the session says otherwise; Spark's default is 64 MB for each task and side."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "4m")
    return spark


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, training_labels(small_batches(spark), sf_dir))
    return score(docs, model, name="_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = without_repeated_lines(docs).where("n_lines_removed = 0 OR text <> ''").drop("n_lines_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    groups = jaccard_components(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, small_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_lines),
    ("near duplicates", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("packing", pack_sequences),
]

#: SQL cannot express the first stage (a fitted model); tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
