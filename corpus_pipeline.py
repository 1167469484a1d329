"""Raw documents to clean, deduplicated, decontaminated and tokenized ones.

Each stage works on the rows its predecessor kept, which are written as Parquet and read again in between. All stages but the
last return the columns of ``documents`` (further columns stay as they are, whatever their names). An empty table passes every
stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.bpe import encode_decode
from rowloom.llm.common import discard, stored, table
from rowloom.llm.decontaminate import drop_leaked
from rowloom.llm.quality_rules import keep_good
from rowloom.llm.queries import tokenizer_path
from rowloom.llm.simhash import keep_one
from rowloom.llm.substring_dedup import dedup_spans


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rules or that the isolation forest finds anomalous; null and empty texts fail. Repeated rows
    stay or go together; without labels the base rules alone judge."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id: a null doc_id only where the group has no
    other, of rows of one doc_id that of the smallest hash of the text, of repeated rows one. Null, empty and blank texts are a
    group (or belong to one)."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences covered by a repeated span are cut; n_chars follows the text (a null text has null), and no row goes. Rows of one
    doc_id are not held against each other; a null doc_id comes first."""
    cleaned = dedup_spans(docs)
    return cleaned.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a full window of a benchmark item, or windows of two items; null and empty texts stay. Repeated rows
    stay or go together; items without id or words count for nothing."""
    return drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each row; null and empty texts have no tokens."""
    return encode_decode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_codec", bpe_codec),
]

#: Isolation forests, XXH64 fingerprints and BPE merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written: list[DataFrame] = []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        discard(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
