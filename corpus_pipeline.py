"""A corpus made ready for training: five stages over the documents table, each written as Parquet for the next one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fescue.llm._common import cut, shield
from fescue.llm.byte_bpe import byte_bpe
from fescue.llm.decontaminate import without_leaks
from fescue.llm.line_dedup import dedup_lines
from fescue.llm.near_copies import keep_one
from fescue.llm.quality_rules import quality_rules as rate


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame, list[str]], DataFrame]]:
    """docs with its other columns out of the operators' way, and a function that puts them back."""
    return shield(docs, "doc_id", "text")


def _as(docs: DataFrame, out: DataFrame) -> DataFrame:
    """out in the columns of docs; n_chars, where docs has it, counts the text as it is now."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep; trusted are those whose label says quality 1."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    plain, back = _apart(docs)
    return back(rate(plain, trusted).where("kept"), [])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; one that loses every line keeps an empty text."""
    plain, back = _apart(docs)
    return _as(docs, back(dedup_lines(plain), []))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id. Candidates are texts whose SimHash fingerprints differ in 4
    bits or fewer, and those that share a min-hash band; every link is verified (5-word shingles, Jaccard similarity 0.8 or more)."""
    return keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, how many there are, and whether the ids' bytes are those of the text."""
    plain, back = _apart(docs)
    out = byte_bpe(plain, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    out = out.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": same})
    return back(out, ["n_tokens", "ids", "round_trip"])


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("benchmark_decontamination", decontamination), ("byte_bpe", tokens)]

#: The likelihood ratio, the fingerprints, the alignment and the encoder cannot be put in SQL; tests hold the stages against
#: plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
