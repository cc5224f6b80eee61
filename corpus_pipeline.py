"""A corpus pipeline of the operators in corpusloom.llm, over the documents table.

Toxic documents go; of each group of near duplicates one stays; passages that an earlier document has
are cut; sources are mixed to their target weights; what is left is packed into batches by length.
Every stage takes documents (doc_id, text, lang, source, n_chars, and any other columns) and returns the same columns, the
last one those and its own. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, release, settled, sift
from corpusloom.llm.minhash import near_duplicates
from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.packing import packed_rows
from corpusloom.llm.suffix_dedup import deduplicated_documents
from corpusloom.llm.toxicity import CUTOFF, score, train, training_labels


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the cutoff, as they are.

    A null text counts as empty, a null doc_id has no label; repeated rows share their fate. Texts of any length are read whole.
    """
    model = train(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model, out="__toxicity").where(F.col("__toxicity") < CUTOFF).drop("__toxicity")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, as it is: that of the smallest doc_id (null last).

    Rows are compared one by one, so rows that share a doc_id, or have none, are as any; of repeated rows one stays. Texts
    without words are nobody's copies and stay.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__member"), "component_id")
    named = numbered.select("__row", F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    named = named.join(groups, F.col("__row") == F.col("__member")).groupBy("component_id")
    kept = named.agg(F.min(F.struct("unnamed", "doc_id", "__row"))["__row"].alias("__row"))
    gone = materialize(numbered.select("__row").join(kept, "__row", "left_anti"), "gone")
    doubtful = sift(numbered, "__row", gone).join(gone, "__row", "left_anti")  # all others stay without a shuffle of their texts
    return sift(numbered, "__row", gone, absent=True).unionByName(doubtful).drop("__row")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the bytes of 100-byte strings that also start earlier; n_chars follows the text.

    Earlier is a smaller doc_id (null first), then a smaller text; of repeated rows the first keeps its text. A null text stays null, a text
    that loses all of its bytes is empty.
    """
    return deduplicated_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of the sources takes them, up to three times.

    Rows without words are not taken; a null source is a source; repeated rows and rows that share a doc_id are taken each on their own.
    """
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, with length (words), bucket, pad_to, batch, slot and copy (which of the rows of this doc_id and length, from 0).

    Rows without words have no bucket; a text longer than the token budget is a batch of its own. Columns that have these names are replaced.
    """
    return packed_rows(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash", near_duplicate_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier, components and suffixes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet in the shared folder and read again.

    Tables that a stage wrote on its way, and its input, are deleted once its own table is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = settled(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        release(before)  # only what this run has written
    return STAGES[-1][1](spark, docs, sf_dir)
