"""Scratch tables in the shared folder, and joins that stay even under a hot key."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least 1/HOT_PARTS of the counted rows is hot, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 1024


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a local master's session gets a folder of its own.

    On a cluster executors don't share local folders, so the setting must be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="driftlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_open: list[list[str]] = []


class scratch:
    """Tables that written() makes inside go at the end, but for those of final(); they belong to the scratch around, if any.

    Only tables that no returned plan reads may go, so what is returned must come from final().
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def __enter__(self) -> scratch:
        _open.append([])
        return self

    def final(self, df: DataFrame, name: str = "result") -> DataFrame:
        out = written(df, name)
        self.kept.append(_open[-1].pop())
        return out

    def __exit__(self, *_: object) -> None:
        for path in _open.pop():
            _delete(self.spark, path)
        if _open:
            _open[-1].extend(self.kept)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by place, and the new name of each: columns added to it clash with none of df's."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that numbered() renamed, under their own names again."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str = "table", batch_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in lineage that survives lost executors.

    ``batch_rows`` bounds the rows of an Arrow batch while df runs, for rows that hold large values.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_ROWS)
    try:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, str(batch_rows))
        df.write.parquet(path)
        if _open:
            _open[-1].append(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, path)


def lookup(left: DataFrame, right: DataFrame, key: str, count: str, spread: Column, how: str = "left") -> DataFrame:
    """Join left to a table with one row per key, where some keys may hold a large part of left.

    right has one row a key and ``count``, the rows that left has of it. Keys
    with 1/HOT_PARTS of all rows or more (so HOT_PARTS at most: a proven bound)
    are broadcast; the others go through a shuffle in which rows of hot keys
    are dealt out by ``spread``, so no task gets more than its part.
    ``right`` should be a written table: it is read three times.
    """
    fields = [c for c in right.columns if c != key]
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.where(F.col(count) * HOT_PARTS >= F.lit(total)).select(F.col(key).alias("_k"), F.struct(*fields).alias("_hot"))
    cold = right.where(F.col(count) * HOT_PARTS < F.lit(total)).select(F.struct(F.lit(0).cast("long").alias("s"), F.col(key).alias("k")).alias("_j"), F.struct(*fields).alias("_cold"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_k"), "left")
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_j", F.struct(F.when(alone, F.xxhash64(spread).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long")).alias("s"), F.when(~alone, F.col(key)).alias("k")))
    out = out.join(cold, "_j", "left")
    got = F.coalesce("_hot", "_cold")
    out = out.select(*left.columns, *[got[c].alias(c) for c in fields], got.isNotNull().alias("_found"))
    return (out.where("_found") if how == "inner" else out).drop("_found")
