"""From pairs to a dataset: dedup by signature, caps, leakage-safe splits, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ranks import placed

# The fallback order of split keys.
SPLIT_KEYS = ["toolchain", "window", "commit", "decl", "file", "signature"]


def signature(broken: Column, fixed: Column) -> Column:
    return X.short_hash(X.normalize(broken), X.normalize(fixed))


def shuffle_key(seed: int, *parts: str) -> Column:
    """A hash that stands for a random order: the same in every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]).cast("binary"))


def dedup(rows: DataFrame, keep: int = 1, signature: str = "signature", context: str = "context", order: str = "seq") -> DataFrame:
    """The first ``keep`` rows of each signature with different contexts, and duplicate_count of all.

    The counts are a partial aggregate joined back, and the first row of each
    context is taken by min_by, so a hot signature is not one task's window.
    """
    n = rows.groupBy(signature).agg(F.count("*").alias("duplicate_count"))
    others = [c for c in rows.columns if c not in (signature, context)]
    first = rows.groupBy(signature, context).agg(F.min_by(F.struct(*others), order).alias("_r")).select(signature, context, "_r.*")
    if keep == 1:
        rest = [c for c in rows.columns if c != signature]
        top = first.groupBy(signature).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(signature, "_r.*")
    else:
        top = first.withColumn("_n", F.row_number().over(Window.partitionBy(signature).orderBy(order))).where(F.col("_n") <= keep).drop("_n")
    return top.join(n, signature)


def capped(rows: DataFrame, by: str, cap: int, order: list[Column]) -> DataFrame:
    """At most ``cap`` rows of each value (0: all). Ranks are cut early by the planner's window group limit."""
    if not cap:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def rebalance(rows: DataFrame, per_label: int = 2000, per_signature: int = 8, seed: int = 0, key: str = "seq") -> DataFrame:
    r = capped(rows, "signature", per_signature, [shuffle_key(seed, key), F.col(key)])
    return capped(r, "label", per_label, [F.desc("confidence"), F.asc_nulls_first("decl"), shuffle_key(seed + 1, key), F.col(key)])


def choose_key(rows: DataFrame, by: str, fallback: bool = True) -> str:
    """The requested key, or the next in SPLIT_KEYS with three values at least."""
    order = [k for k in SPLIT_KEYS[SPLIT_KEYS.index(by) :] if k in rows.columns] if by in SPLIT_KEYS else [by]
    if not fallback:
        return by
    n = rows.agg(*[F.approx_count_distinct(k).alias(k) for k in order]).first()
    return next((k for k in order if n[k] >= 3), by)


def split(rows: DataFrame, by: str, order: list[Column] | None = None, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """rows with ``split``; a group is in one part only. Groups are placed in order: train while the rows before are under its share, then val, then test.

    Rows are summed to groups first, whose running sums are taken by ranges
    (``ranks.placed``). The default order is by hash.
    """
    g = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n")).first()[0] or 0
    by_hash = [F.md5(F.col(by).cast("string").cast("binary"))]
    p = placed(g, [*(order or by_hash), F.col(by)], weight="n")
    start = p.where(F.col("before") >= total * train).agg(F.min("before")).first()[0]
    part = F.when(F.col("before") < total * train, "train").when(F.col("before") - F.lit(start if start is not None else 0) < total * val, "val").otherwise("test")
    return rows.join(p.select(F.col(by).alias("_g"), part.alias("split")), F.col(by).eqNullSafe(F.col("_g"))).drop("_g")


def report(rows: DataFrame) -> DataFrame:
    """label, n, pct, most first; an empty table gives no rows."""
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2)).orderBy(F.desc("n"), "label")


def totals(rows: DataFrame) -> DataFrame:
    """total, labels, top_share, files, decls."""
    per = rows.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("labels"), F.max("n").alias("top"))
    every = rows.agg(F.count("*").alias("total"), F.countDistinct("file").alias("files"), F.countDistinct(F.nullif("decl", F.lit(""))).alias("decls"))
    return every.crossJoin(per).select("total", "labels", F.round(100 * F.col("top") / F.col("total"), 2).alias("top_share"), "files", "decls")  # one row each
