"""Incremental scans: a file stream of corpus files to a progress log that holds each file's hits once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import term_hits

COMMITS = "commits"
ROWS = "rows"


def _files(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_epoch(batch: DataFrame, log: str, epoch: int) -> None:
    """Write a micro-batch as its epoch's partition, then its commit.

    A batch that is run again replaces its own partition, whatever its first
    run left there; until the commit is written, readers pass over it.
    """
    batch.write.mode("overwrite").parquet(f"{log}/{ROWS}/epoch={epoch}")
    commit(batch.sparkSession, log, epoch)


def commit(spark: SparkSession, log: str, epoch: int) -> None:
    files, path = _files(spark, f"{log}/{COMMITS}/{epoch}")
    out = files.create(path, True)
    out.writeBytes(f"{epoch}\n")
    out.close()


def committed(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """Rows of the committed epochs, with ``epoch``. The commits are listed and joined, not sent through the driver."""
    for part in (COMMITS, ROWS):
        files, path = _files(spark, f"{log}/{part}")
        files.mkdirs(path)
    done = spark.read.text(f"{log}/{COMMITS}").select(F.col("value").cast("long").alias("epoch")).distinct()
    rows = spark.read.schema(f"{schema}, epoch long").option("basePath", f"{log}/{ROWS}").parquet(f"{log}/{ROWS}")
    return rows.join(done, "epoch", "left_semi")


def scan_stream(spark: SparkSession, folder: str, schema: str, log: str, checkpoint: str, terms: list[str] | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """Term hits of files as they arrive, each micro-batch once in ``log`` (see ``committed``). Takes what is there and ends; started again, it goes on after the last committed batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    hits = term_hits(reader.parquet(folder), terms)
    return hits.writeStream.foreachBatch(lambda batch, epoch: put_epoch(batch, log, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unscanned(files: DataFrame, log: DataFrame, key: str = "tag") -> DataFrame:
    """Files whose key no committed epoch has: what a batch run has still to do."""
    return files.join(log.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
