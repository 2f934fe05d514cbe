"""Observation weights: cascades, post-stratified shares, clustered bootstrap, sensitivity to the prior."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from .cascades import collapse as collapse
from .ranks import placed


def prior(spark: SparkSession, weights: dict[str, float], frequency: list[str] | None = None) -> DataFrame:
    """stratum, weight; the active weights must sum to 1 and stand on strata that bear frequencies."""
    active = {k: v for k, v in weights.items() if v > 0}
    if not math.isclose(sum(active.values()), 1.0, rel_tol=1e-6):
        raise ValueError(f"stratum weights must sum to 1, not {sum(active.values()):.6f}")
    if frequency is not None and (other := sorted(set(active) - set(frequency))):
        raise ValueError(f"strata without frequency evidence: {', '.join(other)}")
    return spark.createDataFrame(sorted(active.items()), "stratum string, weight double")


def repeats(pos: list[Column], seq: Column) -> Column:
    """Whether an equal message at the same place comes earlier in the cluster."""
    return F.row_number().over(Window.partitionBy(*pos).orderBy(seq)) > 1


def after_first_error(cluster: Column, order: list[Column], severity: Column, prone: Column, pos: Column) -> Column:
    """Whether a cascade-prone warning comes after the cluster's first error, by windows alone (errors inside other spans count too)."""
    w = Window.partitionBy(cluster).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (severity == "warning") & prone & (F.min(F.when(severity == "error", pos)).over(w) < pos)


def prone(template: Column) -> Column:
    return F.greatest(*[template.contains(p) for p in vocab.CASCADE_PRONE])


def shares(obs: DataFrame) -> DataFrame:
    """stratum, fingerprint, c (rows) and n (rows of the stratum)."""
    return obs.groupBy("stratum", "fingerprint").agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("stratum")))


def point(counts: DataFrame, priors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """fingerprint and weight: shares of strata weighed by the prior, of which strata without rows give up their part."""
    by = by or []
    live = counts.select(*by, "stratum").distinct().join(F.broadcast(priors), "stratum")
    live = live.withColumn("w", F.col("weight") / F.sum("weight").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))).drop("weight")
    return counts.join(F.broadcast(live) if not by else live, [*by, "stratum"]).groupBy(*by, "fingerprint").agg(F.sum(F.col("w") * F.col("c") / F.col("n")).alias("weight"))


def table(obs: DataFrame, priors: DataFrame, roots_only: bool = True) -> DataFrame:
    """Weight rows: weight, raw_count, root_count, clusters, first-seen metadata (template, severity, error_name) and share by stratum."""
    used = obs.join(F.broadcast(priors.select("stratum")), "stratum", "left_semi")
    use = used.where("is_root") if roots_only else used
    counts = shares(use)
    meta = used.groupBy("fingerprint").agg(F.count("*").alias("raw_count"), F.count_if("is_root").alias("root_count"), F.countDistinct("stratum", "cluster").alias("clusters"), *[F.min_by(c, "seq").alias(c) for c in ("template", "severity", "error_name") if c in obs.columns])
    per = counts.groupBy("fingerprint").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stratum", F.col("c") / F.col("n"))))).alias("per_stratum"))
    return point(counts, priors).join(meta, "fingerprint").join(per, "fingerprint").orderBy(F.desc("weight"), "fingerprint")


#: Sums of one (stratum, fingerprint) over all replicates that a task holds at once.
HELD = 4096


def _multiplied(draws: int) -> Callable:
    """Batches of (stratum, rs: the replicates that drew the cluster, fs and cs: its fingerprints and their rows) to sums by replicate."""
    held = HELD
    schema = pa.schema([("stratum", pa.string()), ("fingerprint", pa.string()), ("cs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}

        def told() -> pa.RecordBatch:
            keys = list(sums)
            at = pa.array(np.arange(len(keys) + 1) * draws, pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(list(sums.values()))))], schema=schema)
            sums.clear()
            return out

        for batch in batches:
            stratum, rs, fs, cs = (batch.column(c) for c in ("stratum", "rs", "fs", "cs"))
            for i in range(batch.num_rows):
                s, times = stratum[i].as_py(), np.bincount(rs[i].values.to_numpy(), minlength=draws)
                for f, c in zip(fs[i].as_py(), cs[i].as_py(), strict=True):
                    if (s, f) in sums:
                        sums[s, f] += c * times
                    else:
                        sums[s, f] = c * times
                    if len(sums) >= held:
                        yield told()
        if sums:
            yield told()

    return run


def bootstrap(obs: DataFrame, priors: DataFrame, draws: int = 400, seed: int = 0) -> DataFrame:
    """fingerprint, ci_low, ci_high: clusters are drawn with replacement within strata, ``draws`` times.

    The i-th draw of a replicate takes the cluster numbered md5(seed|replicate|stratum|i)
    modulo their number, so runs agree. Rows are summed to (stratum, cluster,
    fingerprint); each cluster's draws are one vector of ``draws`` counts, which
    its sums multiply, so no row stands for a replicate of a cell.
    """
    cells = obs.groupBy("stratum", "cluster", "fingerprint").agg(F.count("*").alias("c"))
    clusters = obs.select("stratum", "cluster").distinct()
    numbered = placed(clusters, [F.col("stratum"), F.col("cluster")])
    ends = numbered.groupBy(F.col("stratum").alias("_s")).agg(F.min("place").alias("at"), F.count("*").alias("k"))  # a row a stratum
    numbered = numbered.join(F.broadcast(ends), F.col("stratum").eqNullSafe(F.col("_s"))).select("stratum", "cluster", (F.col("place") - F.col("at")).alias("i"), "k")
    reps = obs.sparkSession.range(draws).withColumnRenamed("id", "r")
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), "stratum", F.col("i").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    # A cluster is drawn about ``draws`` times over all replicates, whatever the number of clusters.
    drawn = numbered.repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stratum", "i").crossJoin(F.broadcast(reps)).select(F.col("r").cast("int").alias("r"), "stratum", F.pmod(pick, F.col("k")).alias("i")).groupBy("stratum", "i").agg(F.collect_list("r").alias("rs"))
    drawn = drawn.join(numbered.select("stratum", "i", "cluster"), ["stratum", "i"]).select("stratum", "cluster", "rs")
    packed = cells.groupBy("stratum", "cluster").agg(F.collect_list(F.struct("fingerprint", "c")).alias("p"))
    sums = drawn.join(packed, ["stratum", "cluster"]).select("stratum", "rs", F.col("p.fingerprint").alias("fs"), F.col("p.c").alias("cs")).mapInArrow(_multiplied(draws), "stratum string, fingerprint string, cs array<long>")
    counts = sums.select("stratum", "fingerprint", F.posexplode("cs").alias("r", "c")).where("c > 0").groupBy("r", "stratum", "fingerprint").agg(F.sum("c").alias("c"))
    counts = counts.withColumn("n", F.sum("c").over(Window.partitionBy("r", "stratum")))
    est = point(counts, priors, ["r"])
    # A fingerprint that a replicate lacks has weight 0 there.
    lo, hi = int(0.025 * draws), int(0.975 * (draws - 1))
    full = F.array_sort(F.concat(F.array_repeat(F.lit(0.0), F.lit(draws) - F.size("w")), "w"))
    out = est.groupBy("fingerprint").agg(F.collect_list("weight").alias("w"))  # ``draws`` values at most
    return out.select("fingerprint", F.element_at(full, lo + 1).alias("ci_low"), F.element_at(full, hi + 1).alias("ci_high"))


def sensitivity(obs: DataFrame, priors: dict[str, DataFrame], top: int = 25) -> DataFrame:
    """fingerprint, ranks by prior (from 0, among the first ``top``) and their spread."""
    counts = shares(obs)
    out = None
    for name, p in priors.items():
        r = point(counts, p).orderBy(F.desc("weight"), "fingerprint").limit(top)
        r = r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "fingerprint")) - 1).select(F.lit(name).alias("prior"), "fingerprint", "rank")
        out = r if out is None else out.unionByName(r)
    return out.groupBy("fingerprint").agg(F.count("*").alias("n_priors"), F.min("rank").alias("best"), F.max("rank").alias("worst"), (F.max("rank") - F.min("rank")).alias("spread"))
