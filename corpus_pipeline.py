"""A corpus from raw documents to packed sequences: each stage works on all that its predecessor kept.

An empty table stays empty through all stages; other columns pass through, all but the last stage return those of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyline.llm.common import documents, staged
from keyline.llm.mixing import mixed
from keyline.llm.near_dedup import one_of_each
from keyline.llm.packing import pack
from keyline.llm.pii import pseudonyms
from keyline.llm.quality import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject; null and empty texts fail the base rules."""
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("_kl_kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at a similarity of 0.8 or more on five-word shingles, equal rows and null doc_ids included."""
    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms; n_chars follows the text, whose length stays."""
    return pseudonyms(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; null sources form one source."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences; a null text is one piece of the closing id alone."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]
#: The learned list, pseudonyms, ids and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
