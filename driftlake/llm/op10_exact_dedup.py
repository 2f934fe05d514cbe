"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a table, one row a digest, bucketed and sorted by it, with a
partition for each batch. A named one is the warehouse's; one without a name,
as for a single call, has its files in the folder of spark.checkpoint.dir, so
that it asks for no shared warehouse. New data is reduced to one row a
digest (partial sums before the shuffle, so a text with any number of copies
is one row a task), anti-joined by sort-merge to the other batches' digests
without shuffling the index, and appended as its batch's partition. Adding a
batch again under its name replaces that partition, so a retry decides as the
first run did.

Defined cases: null text is empty text; an empty table gives no rows and an
empty batch; of rows with equal text and equal doc_id both are kept by
``decide`` and named by that doc_id; a text that another batch of the index
brought in is dropped, with that batch's keep_id; a null doc_id comes last.
Extra columns are ignored by ``decide`` and kept by ``dedup``.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import _delete, lookup, numbered, restored, scratch, scratch_dir, written

SPACE = "[\\x20\\x09-\\x0D]+"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the 32-byte SHA-256 of the normalised text."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"))


def shared_warehouse(spark: SparkSession) -> None:
    """Raise on a cluster whose warehouse is the default, a folder of one machine: executors could not share the index."""
    local = re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master)
    default = f"{os.getcwd()}/spark-warehouse"
    if not local and re.sub("^file:/*", "/", spark.conf.get("spark.sql.warehouse.dir", default)).rstrip("/") == default:
        raise ValueError("set spark.sql.warehouse.dir to a folder that the driver and all executors share")


class DigestIndex:
    """digest, keep_id, batch: the digests of all batches, each under the batch that brought it in."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        if name:
            shared_warehouse(spark)
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.path = None if name else f"{scratch_dir(spark)}/{self.name}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.path:
            _delete(self.spark, self.path)  # the catalog leaves files outside the warehouse

    def next_batch(self) -> int:
        return (self.rows().agg(F.max("batch")).first()[0] or 0) + 1 if self.exists() else 1

    def add(self, marked: DataFrame, batch: int | None = None) -> int:
        """Append the digests of a batch (doc_id, digest) that no other batch has; returns its number. ``batch`` names one that is added again."""
        batch = batch or self.next_batch()
        new = marked.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        if not self.exists():
            at = {"path": self.path} if self.path else {}
            new.withColumn("batch", F.lit(batch)).limit(0).write.partitionBy("batch").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name, **at)
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = {batch})")  # what an earlier run of this batch left
        if self.path:
            _delete(self.spark, f"{self.path}/batch={batch}")
        new = new.join(self.rows().where(F.col("batch") != batch).hint("merge"), "digest", "left_anti")
        new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest").write.mode("append").insertInto(self.name)
        return batch

    def decide(self, docs: DataFrame, text: str = "text", batches: int = 1, first: int | None = None) -> DataFrame:
        """Add docs and return doc_id, keep_id, group_size (equal texts in docs), kept, text_sha256 for each row.

        With ``batches``, rows go in by ascending doc_id in so many steps (cut
        at quantiles; rows of one doc_id together), each against what the steps
        before have left in the index. ``first``: the number of the first
        batch; to run a call again, pass the one it had.
        """
        with scratch(self.spark) as s:
            marked = written(digests(docs, text), "digests")
            cuts = sorted(set(marked.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
            first = first or self.next_batch()
            edges = [None, *cuts, None]
            for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                part = marked
                if lo is not None:
                    part = part.where((F.col("doc_id") > lo) | F.col("doc_id").isNull()) if hi is None else part.where(F.col("doc_id") > lo)
                if hi is not None:
                    part = part.where(F.col("doc_id") <= hi)
                self.add(part, first + i)
            sizes = marked.groupBy("digest").agg(F.count("*").alias("group_size"))
            known = written(sizes.join(self.rows(), "digest"), "known")
            out = lookup(marked, known, "digest", "group_size", F.coalesce("doc_id", F.lit(-1)))
            own = (F.col("batch") >= first) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
            return s.final(out.select("doc_id", "keep_id", "group_size", own.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")), "decided")


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: int | None = None) -> DataFrame:
    """The rows of docs whose text neither the index nor an earlier row has; all columns stay.

    Repeated rows (equal text and doc_id) leave one. Without an index, one is
    made for this call and dropped after it. ``batch``: as in ``DigestIndex.add``.
    """
    spark = docs.sparkSession
    held = index or DigestIndex(spark)
    with scratch(spark) as s:
        marked = written(digests(docs), "digests")
        batch = held.add(marked, batch)
        keep = s.final(held.rows().where(F.col("batch") == batch).select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep")), "kept")
    if index is None:
        held.drop()
    rows, own = numbered(docs)
    with_key = rows.withColumn("digest", F.unhex(F.sha2(normalised(own["text"]).cast("binary"), 256)))
    out = with_key.join(keep, (with_key["digest"] == keep["_digest"]) & with_key[own["doc_id"]].eqNullSafe(keep["_keep"]), "left_semi")
    return restored(out.dropDuplicates([own["doc_id"], "digest"]), own)


ORACLE = """
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
