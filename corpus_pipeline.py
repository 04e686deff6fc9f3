"""From raw documents to packed training sequences, in five stages.

Toxic documents go, then those of low quality; of each group of near copies one
stays; documents that hold benchmark passages go; the rest is packed. Each
stage is written as Parquet to the shared folder and read again by the next.

Rows are judged one by one. Null and empty texts are not toxic, are scored for
quality like an empty text, have no copies, hold no passage, and are packed as
one end id. Rows without an id stay up to packing. Of rows that share an id
the near-copy stage keeps one. Without labels nothing is toxic or bad; an empty
benchmark takes nothing; an empty table gives no rows. Extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netgrid.llm.decontamination import drop_leaks
from netgrid.llm.jaccard import one_of_each
from netgrid.llm.packing import pack_documents
from netgrid.llm.quality import keep_good
from netgrid.llm.toxicity import drop_toxic
from netgrid.plans.storage import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, _table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of at least 0.8."""
    return one_of_each(docs, k=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, "byte_bpe_50k.json", end_id=2, capacity=1024)


STAGES = [
    ("toxicity", toxicity),
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Models are learnt in two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last one."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
