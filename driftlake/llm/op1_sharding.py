"""Sharding by extendible hashing, in DataFrame operations only.

Each row hashes to 60 bits of md5 over its key columns. The directory starts
as one bucket; a bucket over ``limit`` bytes splits on the next bit, and only
such buckets split. Splitting is monotone (a child never outweighs its
parent), so a row's shard is the first prefix, from the left, whose rows fit.
That lets a level of the directory be computed from sums over prefixes rather
than by moving rows: the sums are taken for ``STEP`` bits at a time, and only
rows of buckets that are still too large go on to the next ``STEP`` bits.

Defined cases: a null key or text counts as empty; an empty table gives no
rows; a row larger than the limit ends alone in its shard, with ``fits``
false; rows of one 60-bit hash (repeated rows) can't be told apart: if they
outweigh the limit, they stay in one shard of all 60 bits with ``fits`` false.
Extra columns are ignored by ``shard`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import numbered, scratch, written

BITS = 60
STEP = 15
#: Bytes of text a shard may hold, by default.
LIMIT = 64 << 20
#: The same in the registered query: small, so that tables of half a megabyte split on several bits too.
QUERY_LIMIT = 64 << 10


def _hash(key):
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def hashed(docs: DataFrame, key=("doc_id", "text"), text="text") -> DataFrame:
    """doc_id, n_bytes (UTF-8 bytes of text) and h (60 bits)."""
    return docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), _hash(key).alias("h"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets as (depth, prefix, shard_bytes, shard_rows, fits); ``rows`` has h and n_bytes."""
    found, todo, base = None, rows.select("h", "n_bytes"), 0
    while True:
        top = min(base + STEP, BITS)
        # One sum per (depth, prefix), partial before the shuffle: 2**STEP prefixes a level at most for each open bucket.
        leaves = todo.groupBy(F.shiftright("h", BITS - top).alias("leaf")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"))
        depths = F.sequence(F.lit(base), F.lit(top))
        sums = (
            leaves.select("b", "c", "leaf", F.explode(depths).alias("depth"))
            .withColumn("prefix", F.expr(f"shiftright(leaf, {top} - depth)"))
            .groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("c").alias("shard_rows"))
        )
        sums = written(sums, "buckets")
        full = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
        above = sums.where(full).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.lit(True).alias("open"))
        live = sums.withColumn("up", F.shiftright("prefix", 1)).join(above, ["depth", "up"], "left").where((F.col("depth") == base) | F.col("open"))
        last = F.col("depth") == BITS
        done = live.where(~full | last).select("depth", "prefix", "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits"))
        if base:  # the bucket carried over from the last level is not a leaf again
            done = done.where(F.col("depth") > base)
        found = done if found is None else found.unionByName(done)
        left = written(sums.where((F.col("depth") == top) & full).select(F.col("prefix").alias("p")), "open")
        if top == BITS or left.isEmpty():
            return found
        todo = written(todo.withColumn("p", F.shiftright("h", BITS - top)).join(left, "p", "left_semi").select("h", "n_bytes"), "open-rows")
        base = top


def _placed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (with h) and their bucket: an equi-join on the prefix of each length that occurs; keep texts out of rows."""
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect()) or [0]  # BITS + 1 values at most
    ways = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in depths])
    return rows.select("*", F.explode(ways).alias("w")).select(*rows.columns, "w.depth", "w.prefix").join(buckets, ["depth", "prefix"])


def _name():
    return F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))


def shard(docs: DataFrame, limit: int = LIMIT, key=("doc_id", "text")) -> DataFrame:
    """doc_id, n_bytes, depth, prefix, shard (bits of the prefix), shard_bytes, shard_rows, fits."""
    with scratch(docs.sparkSession) as s:
        rows = written(hashed(docs, key), "hashed")
        out = _placed(rows, written(directory(rows, limit), "directory"))
        return s.final(out.select("doc_id", "n_bytes", "depth", "prefix", _name().alias("shard"), "shard_bytes", "shard_rows", "fits"), "shards")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Write docs as one folder per shard (named by depth and prefix) under ``path``; returns the directory.

    A shard that fits is written by one task, which its limit bounds; the rows
    of one that doesn't are dealt out to as many tasks as limits it holds.
    """
    rows, own = numbered(docs)
    with scratch(docs.sparkSession) as s:
        h = _hash([own["doc_id"], own["text"]])
        keys = written(rows.select(h.alias("h"), F.coalesce(F.octet_length(own["text"]), F.lit(0)).cast("long").alias("n_bytes")), "hashed")
        buckets = s.final(directory(keys, limit), "directory")
        parts = F.when(F.col("fits"), 1).otherwise(F.ceil(F.col("shard_bytes") / limit)).cast("int")
        place = written(_placed(keys.select("h").distinct(), buckets).select(F.col("h").alias("_h"), F.concat_ws("-", "depth", "prefix").alias("shard"), parts.alias("_parts")), "places")
        out = rows.withColumn("_h0", h).join(place, F.col("_h0") == F.col("_h"))
        # A hash of the row, which a stage that is run again gives alike; equal rows of a large shard are one part.
        out = out.withColumn("_part", F.pmod(F.xxhash64(F.to_json(F.struct(*own.values()), {"ignoreNullFields": "false"})), F.col("_parts"))).repartition("shard", "_part")
        out.select(*[F.col(n).alias(c) for c, n in own.items()], "shard").write.partitionBy("shard").parquet(path)
    return buckets


ORACLE = f"""
WITH r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, {BITS // 4}))::BIGINT AS h
  FROM documents),
s AS (
  SELECT d.depth::INT AS depth, h >> ({BITS} - d.depth)::INT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM r, generate_series(0, {BITS}) AS d(depth) GROUP BY ALL),
f AS (SELECT *, shard_bytes <= {QUERY_LIMIT} OR shard_rows = 1 OR depth = {BITS} AS leaf FROM s),
w AS (
  SELECT r.doc_id, r.n_bytes, r.h, f.*, row_number() OVER (PARTITION BY r.doc_id, r.h ORDER BY f.depth) AS k
  FROM r, f WHERE f.prefix = r.h >> ({BITS} - f.depth)::INT AND leaf)
SELECT doc_id, n_bytes, depth, prefix, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
       shard_bytes, shard_rows, shard_bytes <= {QUERY_LIMIT} AS fits
FROM w WHERE k = 1
"""
