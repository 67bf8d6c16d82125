"""From documents to token ids in five stages, each an operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe
from keyloom.llm.common import remove, shared_folder, table
from keyloom.llm.exact_dedup import keep_one
from keyloom.llm.mixing import mix_sources
from keyloom.llm.ngram_join import jaccard_components
from keyloom.llm.quality_rules import quality_rules
from keyloom.workers import reachable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail outright, or that the rules' votes make unlikely to be good, go."""
    return quality_rules(docs, keep=docs.columns, only_kept=True).select("keep.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays."""
    return keep_one(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 3/4 or more join, the one with the smallest doc_id stays.

    Rows that share a doc_id stay or go together; rows without one stay.
    """
    least = jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.filter("doc_id is not null").join(least, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, once, twice or not at all."""
    copies = mix_sources(docs, keep=docs.columns).filter("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("keep.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the text (binary, little-endian unsigned 32-bit), their number, and digests of the ids and of
    the text that they decode to."""
    return bpe.encode_decode(docs.select("doc_id", "text"), bpe.vocabulary(), keep_text=False).select(
        "doc_id",
        "ids",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", reachable(quality)),
    ("exact dedup", reachable(exact)),
    ("n-gram Jaccard join", reachable(near)),
    ("mixing sources", reachable(mixed)),
    ("BPE encoding and decoding", reachable(tokens)),
]

#: SQL has no BPE; tests/llm/test_pipeline.py compares the stages with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written beside the checkpoints and read again by the next. They go when
    the next stage's are written; only those that the result reads stay."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
