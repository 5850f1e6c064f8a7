"""A training corpus from raw documents: five corpus operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, quality, simhash, token_store
from tidemark.llm.common import table
from tidemark.llm.queries import tokenizer_path
from tidemark.storage import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay with all columns. Nulls, empties and repeats: as quality.keep_good() says."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, with all columns. Nulls, empties and repeats: as simhash.near_dedup() says."""
    return simhash.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a twentieth or more of benchmark passages go. Nulls, empties and repeats: as decontam.decontaminate() says."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the order of the rows in the files becomes that of the mix. Nulls, empties and repeats: as mixing.mix() says."""
    return mixing.in_mixed_order(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store, in the order of the files' rows: the mix of the stage before. Null and empty texts are one end id, an empty table is an empty store."""
    place = {"file_part": F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long"), "file_name": F.col("_metadata.file_name"), "file_row": F.col("_metadata.row_index")}
    try:
        rows = docs.select("doc_id", "text", *[c.alias(n) for n, c in place.items()])
    except AnalysisException:  # rows that are not in files have no order but that of their ids
        return token_store.token_output(docs, tokenizer_path())
    return token_store.token_output(rows, tokenizer_path(), order=list(place))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: A vote of latent neighbours, fingerprints and byte-pair tokens are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
