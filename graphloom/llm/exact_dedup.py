r"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Documents arrive in memtables. A memtable is aggregated by digest (SHA-256 of the normalised text) to the smallest identifier and the
number of rows, and flushed as a run: files sorted by digest, and a filter, a bit table of about eight bits a digest. Runs of a level are
compacted once there are ``FANOUT`` of them: merged by digest to one run of the next level, with the smallest identifier and the
sum of the numbers. A lookup asks each run's filter first and reads the run for those digests only that it may hold, so a new
batch of documents costs its own size and not the index's.

A digest with more than one row is a hit. Documents without a hit pass unshuffled; the texts of the others
are grouped and joined by digest *and* text, which compares their bytes, so that equal digests of unequal texts can not merge
documents. A filter too small for the number of hits lets more documents through to the join, nothing else changes.

Hot groups: every aggregation combines on the map side, one row per group and task, and the join of
hits with their groups is one that adaptive execution splits.

Defined cases: null text counts as empty and all empty texts are one group; a null id is larger
than all others; of repeated rows (same id, same text) exactly one stays; an empty table gives an empty result; columns other than id and text
are ignored, those in ``carry`` pass as ``in_<name>``, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import new_path
from graphloom.llm.common import Filter, documents, filter_of, filters_of, maybe_in, spool

SPACE = r"[\x20\x09-\x0D]+"
MEMTABLES, FANOUT = 8, 8


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE, " ")


def _digest(norm: str) -> Column:
    return F.sha2(F.col(norm).cast("binary"), 256)


@dataclass
class Run:
    """Digests with the smallest identifier and the number of rows of each, sorted by digest, and what tells which digests it may hold."""

    level: int
    rows: DataFrame  # digest, keep_id, n
    filter: Filter


@dataclass
class Index:
    """The runs of an index, the newest last."""

    spark: SparkSession
    runs: list[Run] = field(default_factory=list)

    def _write(self, level: int, rows: DataFrame) -> Run:
        rows = spool(rows.sortWithinPartitions("digest"), f"dedup-run-{level}")
        made = filter_of(rows, "digest")
        return Run(level, rows, Filter(spool(made.table, f"dedup-filter-{level}"), made.blocks))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtables: int = MEMTABLES) -> None:
        """Flushes a batch of documents as runs of level 0 and compacts the levels that are full."""
        rows = docs.select((F.spark_partition_id() % memtables).alias("memtable"), F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
        table = rows.select("memtable", _digest("norm").alias("digest"), "id").groupBy("memtable", "digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        # one write for all memtables, each to its own folder
        path = new_path(self.spark, "dedup-flush")
        table.sortWithinPartitions("memtable", "digest").write.partitionBy("memtable").parquet(path)
        flushed = self.spark.read.schema(table.schema).parquet(path)
        shape = table.drop("memtable").schema
        for m, made in filters_of(flushed, "digest", "memtable").items():
            self.runs.append(Run(0, self.spark.read.schema(shape).parquet(f"{path}/memtable={m}"), made))
        level = 0
        while len(full := [r for r in self.runs if r.level == level]) >= FANOUT:
            merged = self._write(level + 1, compact(*[r.rows for r in full]))
            self.runs = [r for r in self.runs if r.level != level] + [merged]
            level += 1

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id, n) of those of the distinct ``digests`` that the index holds."""
        found = []
        for r in self.runs:
            asked = maybe_in(digests.select("digest"), r.filter, "digest").where("__maybe").select("digest")
            found.append(r.rows.join(asked, "digest", "left_semi"))
        return compact(*found)

    def hits(self) -> DataFrame:
        """(digest, keep_id, n) of the digests with more than one row. Digests that no other run's filter knows are not merged."""
        if len(self.runs) == 1:
            return self.runs[0].rows.where("n > 1")
        own, shared = [], []
        for i, r in enumerate(self.runs):
            rows = r.rows.withColumn("other", F.lit(False))
            for j, o in enumerate(self.runs):
                if i != j:
                    rows = maybe_in(rows, o.filter, "digest").withColumn("other", F.col("other") | F.col("__maybe")).drop("__maybe")
            rows = spool(rows, "dedup-probed")
            own.append(rows.where("NOT other AND n > 1").drop("other"))
            shared.append(rows.where("other").drop("other"))
        return compact(*shared).where("n > 1").unionByName(_all(own))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compact(*runs: DataFrame) -> DataFrame:
    """One run of several: (digest, keep_id, n)."""
    return _all([r.select("digest", "keep_id", "n") for r in runs]).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, index: Index | None = None, known: DataFrame | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, and the columns in ``carry`` (prefixed ``in_``).

    With an ``index`` of earlier documents, ``known`` being those (id and text columns as in ``docs``), documents are held against them too, and the index
    takes them in; of the earlier documents only those are read that a new one may equal.
    """
    spark = docs.sparkSession
    extra = [f"in_{c}" for c in carry or []]
    carried = [F.col(c).alias(f"in_{c}") for c in carry or []]
    batch = Index(spark)
    batch.add(docs, id_col, text_col)
    if not batch.runs:  # no documents
        batch.runs.append(batch._write(0, compact(spark.createDataFrame([], f"digest string, keep_id {docs.schema[id_col].dataType.simpleString()}, n long"))))
    hits = spool(batch.hits(), "dedup-hits").select("digest")
    earlier = None
    if index is not None and index.runs:
        if known is None:
            raise ValueError("hits in an index are compared with its documents' texts: pass them as known")
        met = spool(index.lookup(_all([r.rows.select("digest") for r in batch.runs]).distinct()), "dedup-met")
        hits = spool(hits.unionByName(met.select("digest")).distinct(), "dedup-hits")
        # of each digest's earlier documents the text of the one that stays
        texts = known.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("norm"))
        ids = met.select(F.col("keep_id").alias("doc_id"))
        texts = maybe_in(texts, filter_of(ids, "doc_id"), "doc_id").where("__maybe").drop("__maybe")
        same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        earlier = texts.join(met, same, "inner").withColumn("norm", normalised("norm")).where(_digest("norm") == F.col("digest")).groupBy("digest", "norm").agg(F.first("keep_id", ignorenulls=True).alias("doc_id"), F.max("n").alias("rows"))
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"), *carried).withColumn("digest", _digest("norm"))
    met = maybe_in(rows, filter_of(hits, "digest"), "digest")
    log = spool(met.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "digest", F.when(F.col("__maybe"), F.col("norm")).alias("norm"), *extra), "dedup-log")
    alone = log.where("norm IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"), *extra)
    maybe = log.where("norm IS NOT NULL")
    counted = maybe.select("digest", "norm", "doc_id", "rid", F.lit(1).cast("long").alias("rows"))
    if earlier is not None:
        counted = counted.unionByName(earlier.withColumn("rid", F.lit(-1).cast("long")))
    # written first: a join of two scans is one whose hot partitions adaptive execution can split
    groups = spool(counted.groupBy("digest", "norm").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"), F.sum("rows").alias("group_size")), "dedup-groups")
    met = maybe.join(groups, ["digest", "norm"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), F.col("digest").alias("text_sha256"), *extra)
    if index is not None:
        index.runs += batch.runs
    return alone.unionByName(met)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
