"""A corpus pipeline of five stages; each reads what the one before it wrote.

Toxic documents go, then exact copies, then near copies; what is left gets surrogates for personal data and is
packed to sequences. All stages but the last return the columns of documents, and each passes on every row its decisions keep.

Defined cases, of every stage: a null text is an empty one (and stays null in the table); a null id is an id, larger than all others;
repeated rows are copies of each other; columns other than doc_id and text pass unchanged, whatever their names, but ``n_chars``, which follows
the text where surrogates change it; an empty table gives an empty one; without labels no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, near_dedup, packing, pii, toxicity
from graphloom.lineage import clean, mark, new_path
from graphloom.llm.common import documents


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity score predicts to be toxic."""
    fields = _fields(docs, "doc_id")
    kept = toxicity.score(docs, documents(spark, sf_dir, "labels"), keep=fields).where("predicted = 0")
    return kept.select(*[F.col(c if c == "doc_id" else f"in_{c}").alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of equal texts."""
    fields = _fields(docs, "doc_id")
    kept = exact_dedup.dedup(docs, carry=fields).where("kept")
    return kept.select(*[F.col(c if c == "doc_id" else f"in_{c}").alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each class of near copies."""
    return near_dedup.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in the texts."""
    replaced = pii.replace(docs, spark.conf.get(pii.KEY_SETTING, pii.PUBLIC_KEY), count=None)
    return replaced.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else replaced


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


def _fields(docs: DataFrame, *without: str) -> list[str]:
    return [c for c in docs.columns if c not in without]


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]
ORACLE_SQL = None  # SQL can express neither the toxicity score nor the tokens


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again; what a stage has spooled goes once its result is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        before = mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        clean(spark, before)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
