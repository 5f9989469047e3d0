"""The training-data pipeline over the whole ``documents`` table.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame; it is written as Parquet and read again before the next
one. All but the last return the columns of ``documents``. Null and empty texts
are kept until the last stage, which encodes them as empty. SQL cannot express
the stages, so there is no ``ORACLE_SQL``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorset.llm import bpe, decontaminate, linedup, parity, quality
from anchorset.llm.queries import RANKS, table
from anchorset.sources.stages import StageStore

# Near copies share 8 of 10 of their five-word shingles; op6's own limits hold for its query only.
NEAR_WIDTH = 5
NEAR_SHARE = (8, 10)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that importance resampling does not draw."""
    return quality.drawn_documents(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks of lines that an earlier document has; ``n_chars`` follows
    the text. A document of which nothing but white space is left goes."""
    short = linedup.remove_repeated_lines(docs)
    left = (F.size("_lines.removed") == 0) | F.col("text").rlike(r"\S")
    return short.filter(left).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.
    Rows without an id all stay; exact repeats of a row with an id stay once."""
    classes = parity.jaccard_classes(docs, width=NEAR_WIDTH, share=NEAR_SHARE)
    first = classes.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every remaining text."""
    return bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = StageStore.for_session(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.border(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
