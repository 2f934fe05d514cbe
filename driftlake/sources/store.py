"""A persistent store of snapshots, the chain of diffs that is kept up to date over it, and a store of files at commits.

All are tables at a path that the driver and all executors share: a catalog
that forgets its tables with the session finds their partitions again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import version
from ..operators import snapshot
from ..session import kept
from . import git
from .readers import SNAPSHOT
from .readers import snapshot as parsed

HOP = ["base", "target", "base_digest", "target_digest"]


@contextmanager
def _replacing_partitions(spark: SparkSession) -> Iterator[None]:
    """While this is open an overwrite replaces just the partitions that it has rows of: a write that is run again leaves one copy."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def digests(raw: DataFrame) -> DataFrame:
    """release and a digest of its lines (release, value, seq): sums of hashes, so that lines are added up where they are.

    ``seq`` orders the lines of a release and is part of what they say: it must be the same in every run.
    """
    h = F.sha2(F.concat_ws("\u001f", F.col("seq").cast("string"), "value"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return raw.groupBy("release").agg(F.substring(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256), 1, 32).alias("digest"))


class _Table:
    def __init__(self, spark: SparkSession, path: str, fields: str, by: list[str], buckets: str = ""):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.name = f"driftlake_{hashlib.sha1(self.path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({fields}, {', '.join(f'{c} STRING' for c in by)}) USING parquet PARTITIONED BY ({', '.join(by)}) {buckets} LOCATION '{self.path}'")
        self._files(self.path)[0].mkdirs(self._files(self.path)[1])
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _files(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def partitions(self) -> set[tuple[str, ...]]:
        """The values of the partitions: as few as releases or hops."""
        unquoted = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {tuple(unquoted(p.partition("=")[2]) for p in r[0].split("/")) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()}

    def replace(self, rows: DataFrame) -> None:
        with _replacing_partitions(self.spark):
            rows.write.insertInto(self.name, overwrite=True)

    def drop(self, values: tuple[str, ...]) -> None:
        quoted = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        spec = ", ".join("{} = '{}'".format(c, v.replace("\\", "\\\\").replace("'", "\\'")) for c, v in zip(self.by, values, strict=True))
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({spec})")
        files, path = self._files("/".join([self.path, *[f"{c}={quoted(v)}" for c, v in zip(self.by, values, strict=True)]]))
        files.delete(path, True)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)


class SnapshotStore(_Table):
    """Constants by name, bucketed and sorted by it, one partition a (release, digest of its lines).

    A release whose lines are known is not parsed again; one whose lines have
    changed replaces its old partition once the new one is written. Since all
    partitions share the bucketing, comparing releases moves no rows
    (``snapshot.paired``).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200):
        super().__init__(spark, path, SNAPSHOT["const"], ["release", "digest"], f"CLUSTERED BY (n) SORTED BY (n) INTO {buckets} BUCKETS")
        self.buckets = buckets

    def add(self, raw: DataFrame) -> list[Row]:
        """Parse and write the releases of raw (release, value, seq) that are not stored yet; returns (release, digest) of those written."""
        have = self.partitions()
        new = [r for r in digests(raw.where("release is not null")).collect() if tuple(r) not in have]  # releases are few
        if new:
            chosen = F.broadcast(self.spark.createDataFrame(new, "release string, digest string"))
            rows = parsed(raw.join(chosen.select("release"), "release", "left_semi"), "const").join(chosen, "release")
            # One task a bucket, so each bucket of a release is one sorted file.
            self.replace(rows.select(*self.rows().columns).repartition(self.buckets, "n"))
            for old in have:
                if old[0] in {r["release"] for r in new}:
                    self.drop(old)
        return new

    def releases(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.partitions()), "release string, digest string")


class ChainStore(_Table):
    """Causes of adjacent releases of a store, one partition a hop, named by both releases and their digests.

    A hop is computed when its partition is missing, so a release put between
    two others costs two hops and takes one away, and one whose lines have
    changed costs the hops beside it. A hop's first row says that it was
    computed, even if it has no causes.
    """

    def __init__(self, store: SnapshotStore, path: str):
        super().__init__(store.spark, path, "cause STRING, name STRING, detail STRING, class STRING, sev STRING", HOP)
        self.store = store

    def wanted(self, releases: list[str] | None = None, endpoint: bool = False) -> DataFrame:
        """The hops of the stored releases (of ``releases`` only, if given), with ``kind``; ``endpoint`` adds the jump from first to last."""
        r = self.store.releases()
        r = r.where(F.col("release").isin(releases)) if releases is not None else r
        p = snapshot.pairs_of(r, version(F.col("release")), endpoint=endpoint)
        side = lambda c: r.select(F.col("release").alias(c), F.col("digest").alias(f"{c}_digest"))
        return p.join(side("base"), "base").join(side("target"), "target").select(*HOP, "kind")

    def update(self, releases: list[str] | None = None, endpoint: bool = False) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]]]:
        """Compute missing hops and drop those that are no more; returns both."""
        have, want = self.partitions(), {tuple(r)[:4] for r in self.wanted(releases, endpoint).collect()}
        new, old = sorted(want - have), sorted(have - want)
        if new:
            hops = self.spark.createDataFrame(new, ", ".join(f"{c} string" for c in HOP))
            names = sorted({x for h in new for x in h[:2]})
            causes = snapshot.chained(self.store.rows().where(F.col("release").isin(names)), hops)
            done = hops.select("base", "target", F.lit("meta").alias("cause"), F.concat_ws(" -> ", "base", "target").alias("name"), F.lit(None).cast("string").alias("detail"), F.lit("").alias("class"), F.lit("info").alias("sev"))
            rows = causes.unionByName(done).join(F.broadcast(hops), ["base", "target"])
            # A hop is dealt out by name over as many tasks as the store has buckets; small ones are merged again.
            self.replace(rows.select(*self.rows().columns).repartition(*HOP, F.pmod(F.xxhash64("name"), F.lit(self.store.buckets))))
        for h in old:
            self.drop(h)
        return new, old

    def causes(self) -> DataFrame:
        return self.rows().where("cause <> 'meta'").select(*snapshot.CAUSE_COLUMNS)


class BlobStore:
    """Files at commits, each read from git once.

    A commit's files never change, so what is stored stays right. Only files
    that are there are stored: one that is absent may be fetched later, and is
    looked for again. What one call adds is a partition named by its keys, so a
    call that is run again replaces its own rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = _Table(spark, path, "sha STRING, path STRING, text STRING", ["batch"])

    def read(self, objects: DataFrame, repo: str) -> DataFrame:
        """sha, path and text (null if absent) of objects (sha of the commit, path), one row each; rows with a null are left out."""
        key = ["sha", "path"]
        wanted = kept(objects.select(*key).where("sha is not null and path is not null").distinct(), "wanted")
        missing = kept(wanted.join(self.table.rows().select(*key), key, "left_anti"), "missing")
        h = F.sum(F.xxhash64(*key).cast("decimal(38,0)"))
        n, some = missing.agg(F.count("*"), F.sha1(F.concat_ws(",", F.count("*").cast("string"), h.cast("string")))).first()
        if n:
            self.table.replace(git.blobs(missing, repo).where("text is not null").withColumn("batch", F.lit(some)))
        # Callers that run at one time may have stored a file twice.
        return wanted.join(self.table.rows().select(*key, "text"), key, "left").dropDuplicates(key)
