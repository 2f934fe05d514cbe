"""Registered queries over what is kept: stores, chains, logs and streams that the tables fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import snapshot
from ..session import kept, scratch_dir
from ..sources.store import ChainStore, SnapshotStore
from .queries import CAUSED, _snapshots

S = SparkSession
BUCKETS = 24


def _raw(spark: S, d: str) -> DataFrame:
    """Snapshot lines of every year: one JSON record a customer."""
    s = _snapshots(spark, d).withColumn("n", F.col("n").cast("string"))
    return s.select(F.col("release").cast("string").alias("release"), F.to_json(F.struct(F.lit("const").alias("t"), "n", "k", F.col("ar").cast("int").alias("ar"), "bi", "th", "prot")).alias("value"), F.lit(0).alias("seq"))


def _stored(spark: S, d: str) -> SnapshotStore:
    store = SnapshotStore(spark, scratch_dir(spark, "snapshots"), BUCKETS)
    raw = kept(_raw(spark, d), "raw")  # read by both fillings
    store.add(raw)
    if store.add(raw):
        raise AssertionError("known releases were written again")
    return store


@query(f"WITH {CAUSED} SELECT base::VARCHAR AS base, target::VARCHAR AS target, cause, count(*) AS count FROM causes GROUP BY ALL")
def snapshot_store_causes(spark: S, d: str) -> DataFrame:
    """Every hop, from a store that has been filled twice."""
    store = _stored(spark, d)
    hops = snapshot.version_pairs(store.releases())
    return snapshot.chained(store.rows(), hops).groupBy("base", "target", "cause").agg(F.count("*").alias("count"))


#: Orders in which releases (by place) come, in steps.
ARRIVALS = {
    "odd_last": lambda n: [list(range(0, n, 2)), list(range(1, n, 2))],
    "backwards": lambda n: [[n - 1 - k for k in range(i, min(i + 3, n))] for i in range(0, n, 3)],
    "ends_first": lambda n: [[0, n - 1], [n // 2], [i for i in range(1, n - 1) if i != n // 2]],
}


def _grown(spark: S, d: str) -> list[tuple[str, ChainStore, list[tuple[int, int, int]]]]:
    """For each order of arrival its chain, and (step, hops computed, hops dropped)."""
    store = _stored(spark, d)
    names = sorted(r[0] for r in store.partitions())
    out = []
    for how, steps in ARRIVALS.items():
        chain, there, done = ChainStore(store, scratch_dir(spark, "chain")), [], []
        for i, more in enumerate(steps(len(names))):
            there += [names[k] for k in more]
            new, old = chain.update(there)
            done.append((i, len(new), len(old)))
        out.append((how, chain, done))
    return out


_HOW = ", ".join(f"('{h}')" for h in ARRIVALS)


@query(f"WITH {CAUSED}, c AS (SELECT base::VARCHAR AS base, target::VARCHAR AS target, cause, count(*) AS count FROM causes GROUP BY ALL) SELECT how, c.* FROM c, (VALUES {_HOW}) h(how)")
def chain_of_arrivals(spark: S, d: str) -> DataFrame:
    """Releases arrive in three orders; the chain is that of a full build."""
    every = [c.causes().groupBy("base", "target", "cause").agg(F.count("*").alias("count")).withColumn("how", F.lit(how)) for how, c, _ in _grown(spark, d)]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("""WITH r AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)),
a AS (SELECT 'odd_last' AS how, i, i % 2 AS step FROM r UNION ALL SELECT 'backwards', i, (n - 1 - i) // 3 FROM r UNION ALL SELECT 'ends_first', i, CASE WHEN i IN (0, n - 1) THEN 0 WHEN i = n // 2 THEN 1 ELSE 2 END FROM r),
s AS (SELECT DISTINCT how, step FROM a), h AS (SELECT s.how, s.step, a.i, lead(a.i) OVER (PARTITION BY s.how, s.step ORDER BY a.i) AS j FROM s JOIN a ON a.how = s.how AND a.step <= s.step),
e AS (SELECT * FROM h WHERE j IS NOT NULL)
SELECT s.how, s.step, (SELECT count(*) FROM e WHERE e.how = s.how AND e.step = s.step AND NOT EXISTS (SELECT 1 FROM e p WHERE p.how = e.how AND p.step = e.step - 1 AND p.i = e.i AND p.j = e.j)) AS computed,
(SELECT count(*) FROM e p WHERE p.how = s.how AND p.step = s.step - 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.how = p.how AND e.step = p.step + 1 AND e.i = p.i AND e.j = p.j)) AS dropped FROM s""")
def chain_hops_computed(spark: S, d: str) -> DataFrame:
    """How many hops each arrival computes, and how many it drops."""
    rows = [(how, step, new, old) for how, _, done in _grown(spark, d) for step, new, old in done]
    return spark.createDataFrame(rows, "how string, step long, computed long, dropped long")
