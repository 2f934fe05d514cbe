"""Ordered funnel counting over a table of successor edges.

``ranged`` gives one row a (client, time), with the kinds that stand there as
bits, dealt out by ranges of (client, time): a client with a third of all rows
spreads over a third of the ranges. One backward pass over each sorted range
finds the next later row of every kind; what lies in later ranges of the same
client comes from a table of the ranges' first times, which has one row a range
at most. ``edges`` materialises, once for all funnels, the successor of each
row for each distinct pair of kinds, with one flag an excluded kind that stands
after the row and not after its successor.

``funnels`` composes edges step by step. Attempts that share a target are one
row a bin of BIN microseconds of their starts, so a target has limit / BIN + 1
rows at most however many attempts meet there; a bin holds its starts, so that
the time limit stays exact. What they took for the step is a histogram of
(microseconds, attempts). Percentiles are read from it in two levels: sums of
buckets of CELL microseconds, then the one bucket that holds the rank.

Defined cases: rows with a null in client, kind or time are left out; rows
equal in the three are one; an empty table gives no rows; times with or
without a zone are microseconds of UTC; rows of one time are no successors of
each other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import scratch, written

Funnel = tuple[Sequence[str], str]
#: Steps in order, and the kind that ends an attempt.
FUNNELS: dict[str, Funnel] = {
    "A": (("view", "click", "view", "purchase"), "error"),
    "B": (("signup", "view", "click", "purchase"), "error"),
    "C": (("click", "click", "purchase", "view"), "signup"),
}
LIMIT = 30 * 60 * 1_000_000
PERCENT = 90
BIN = 1 << 22
CELL = 1 << 16
_NEVER = np.iinfo(np.int64).max


def micros(time: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970; a time without a zone is taken as it stands, whatever the session's zone."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(time)
    minutes = (F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(time)) * 60 + F.minute(time)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), time) * 1_000_000).cast("long")


def rows_of(clicks: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """client_id, t, mask: bit i is set if a row of kinds[i] stands at t. Equal rows are put together before the shuffle."""
    at = micros(F.col("arrived_at"), clicks.schema["arrived_at"].dataType)
    bit = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, 1 << i)]), F.col("kind"))
    rows = clicks.where(F.col("kind").isin(*kinds) & F.col("client_id").isNotNull() & F.col("arrived_at").isNotNull())
    return rows.select("client_id", at.alias("t"), bit.alias("bit")).groupBy("client_id", "t").agg(F.bit_or("bit").alias("mask"))


def _scan(n_kinds: int):
    """From rows sorted by client and falling time: the next later time of each kind of the client in this range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, client, later = TaskContext.get().partitionId(), None, np.full(n_kinds, _NEVER)
        for batch in batches:
            who, t, mask = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            n, out = len(t), []
            if not n:
                continue
            starts = np.flatnonzero(np.concatenate([[client is None or who[0] != client], who[1:] != who[:-1]]))
            first = np.zeros(n, np.int64)  # of each row's client in this batch
            first[starts] = starts
            first = np.maximum.accumulate(first)
            carried = np.arange(n) < (starts[0] if len(starts) else n)  # rows of the client that the last batch ended in
            for k in range(n_kinds):
                has = mask >> k & 1 == 1
                at = np.maximum.accumulate(np.where(has, np.arange(n), -1))
                before = np.concatenate([[-1], at[:-1]])
                here = before >= first
                nxt = np.where(here, t[np.maximum(before, 0)], np.where(carried, later[k], _NEVER))
                out.append(pa.array(nxt, mask=nxt == _NEVER))
                later[k] = t[at[-1]] if at[-1] >= first[-1] else later[k] if carried[-1] else _NEVER
            client = who[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(n, part, np.int32)), *out], ["client_id", "t", "mask", "range", *[f"next{k}" for k in range(n_kinds)]])

    return run


def ranged(rows: DataFrame, n_kinds: int) -> DataFrame:
    """rows with ``range`` (of client_id and t) and ``next0``.. (the next later time of each kind, over all ranges)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"next{k}" for k in range(n_kinds)]
    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in names]])
    dealt = rows.repartitionByRange(parts, "client_id", "t").sortWithinPartitions(F.col("client_id"), F.col("t").desc())
    near = written(dealt.mapInArrow(_scan(n_kinds), schema), "ranged")
    # A client that goes on in a later range is the last of its range: one row a range at most, so broadcasting it has a bound.
    heads = near.groupBy("client_id", "range").agg(*[F.min(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("t"))).alias(f"head{k}") for k in range(n_kinds)])
    later = Window.partitionBy("client_id").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a range at most
    tails = heads.select("client_id", "range", F.count("*").over(later).alias("after"), *[F.min(f"head{k}").over(later).alias(f"tail{k}") for k in range(n_kinds)])
    tails = F.broadcast(written(tails.where("after > 0").drop("after"), "tails"))
    return near.join(tails, ["client_id", "range"], "left").select("client_id", "t", "mask", *[F.coalesce(c, f"tail{k}").alias(c) for k, c in enumerate(names)])


def pairs_of(funnels: Mapping[str, Funnel]) -> list[tuple[str, str]]:
    return sorted({p for steps, _ in funnels.values() for p in zip(steps, steps[1:])})


def kinds_of(funnels: Mapping[str, Funnel]) -> list[str]:
    return sorted({k for steps, out in funnels.values() for k in (*steps, out)})


def edges(successors: DataFrame, kinds: Sequence[str], pairs: Sequence[tuple[str, str]], excluded: Sequence[str]) -> DataFrame:
    """client_id, pair (its place in pairs), t, t2, hit: bit i is set if a row of excluded[i] stands after t and not after t2."""
    place = {k: i for i, k in enumerate(kinds)}
    one = []
    for i, (a, b) in enumerate(pairs):
        t2 = F.col(f"next{place[b]}")
        hit = sum((F.when(F.col(f"next{place[x]}") <= t2, 1 << j).otherwise(0) for j, x in enumerate(excluded)), F.lit(0))
        one.append(F.when((F.col("mask").bitwiseAND(1 << place[a]) != 0) & t2.isNotNull(), F.struct(F.lit(i).alias("pair"), t2.alias("t2"), hit.alias("hit"))))
    return successors.select("client_id", "t", F.explode(F.array_compact(F.array(*one))).alias("e")).select("client_id", "e.pair", "t", "e.t2", "e.hit")


def composed(edge: DataFrame, funnels: Mapping[str, Funnel], pairs: Sequence[tuple[str, str]], excluded: Sequence[str], limit: int) -> DataFrame:
    """funnel (its place), client_id, step (from 2), took, w: how many attempts took so many microseconds to a step that they reached."""
    place, bit = {p: i for i, p in enumerate(pairs)}, {x: 1 << i for i, x in enumerate(excluded)}
    steps = max(len(s) for s, _ in funnels.values())
    state, hist = None, []
    for step in range(2, steps + 1):
        use = [(f, place[s[step - 2], s[step - 1]], bit[x]) for f, (s, x) in enumerate(funnels.values()) if len(s) >= step]
        legs = F.array(*[F.when((F.col("pair") == p) & (F.col("hit").bitwiseAND(b) == 0), F.lit(f)) for f, p, b in use])
        leg = edge.where(F.col("pair").isin([p for _, p, _ in use]) & (F.col("t2") - F.col("t") <= limit))
        leg = leg.select(F.explode(F.array_compact(legs)).alias("funnel"), "client_id", "t", "t2")
        if state is None:
            now = leg.withColumn("starts", F.array("t"))
        else:
            on_time = F.filter("starts", lambda x: x >= F.col("t2") - limit)
            now = leg.join(state, ["funnel", "client_id", "t"]).select("funnel", "client_id", "t", "t2", on_time.alias("starts")).where(F.size("starts") > 0)
        if 2 < step < steps:
            now = written(now, f"step{step}")
        # Attempts with one target go on together, a row a bin of their starts.
        state = now.groupBy("funnel", "client_id", F.col("t2").alias("t"), F.expr(f"starts[0] div {BIN}").alias("bin")).agg(F.flatten(F.collect_list("starts")).alias("starts")).drop("bin")
        took = now.groupBy("funnel", "client_id", (F.col("t2") - F.col("t")).alias("took")).agg(F.sum(F.size("starts")).alias("w"))
        hist.append(took.select("funnel", "client_id", F.lit(step).alias("step"), "took", "w"))
    return reduce(DataFrame.unionAll, hist)


def percentiles(hist: DataFrame, percent: int = PERCENT) -> DataFrame:
    """funnel, client_id, step, n (attempts), p: the ceil(percent * n / 100)-th smallest of their times."""
    key = ["funnel", "client_id", "step"]
    cells = hist.groupBy(*key, F.expr(f"took div {CELL}").alias("cell")).agg(F.sum("w").alias("w"))
    whole, upto = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("cell")  # limit / CELL rows at most
    cells = cells.select("*", F.sum("w").over(whole).alias("n"), F.sum("w").over(upto).alias("cum")).withColumn("rank", F.expr(f"(n * {percent} + 99) div 100"))
    hot = cells.where("cum >= rank AND cum - w < rank").select(*key, "cell", "n", (F.col("rank") - F.col("cum") + F.col("w")).alias("left"))
    inside = hist.withColumn("cell", F.expr(f"took div {CELL}")).join(hot, [*key, "cell"])
    upto = Window.partitionBy(*key).orderBy("took")  # CELL rows at most
    return inside.withColumn("cum", F.sum("w").over(upto)).where("cum >= left AND cum - w < left").select(*key, "n", F.col("took").alias("p"))


def funnels(clicks: DataFrame, which: Mapping[str, Funnel] = FUNNELS, limit: int = LIMIT, percent: int = PERCENT) -> DataFrame:
    """funnel, client_id, n1.., deepest, t2.., same_depth for each funnel and client with attempts."""
    kinds, pairs, excluded = kinds_of(which), pairs_of(which), sorted({x for _, x in which.values()})
    steps = max(len(s) for s, _ in which.values())
    with scratch(clicks.sparkSession) as s:
        succ = ranged(rows_of(clicks, kinds), len(kinds))
        edge = written(edges(succ, kinds, pairs, excluded), "edges")
        begins = F.array(*[F.when(F.col("mask").bitwiseAND(1 << kinds.index(f[0][0])) != 0, F.lit(i)) for i, f in enumerate(which.values())])
        first = succ.select("client_id", F.explode(F.array_compact(begins)).alias("funnel")).groupBy("funnel", "client_id").agg(F.count("*").alias("n"))
        hist = written(composed(edge, which, pairs, excluded, limit), "hist")
        long = first.select("funnel", "client_id", F.lit(1).alias("step"), "n", F.lit(None).cast("long").alias("p")).unionByName(percentiles(hist, percent))
        n = [F.coalesce(F.max(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).cast("long").alias(f"n{k}") for k in range(1, steps + 1)]
        t = [F.max(F.when(F.col("step") == k, F.col("p"))).alias(f"t{k}") for k in range(2, steps + 1)]
        each = written(long.groupBy("funnel", "client_id").agg(*n, F.max("step").cast("int").alias("deepest"), *t), "clients")
        same = each.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # a row a funnel and step
        name = F.element_at(F.array(*map(F.lit, which)), F.col("funnel") + 1).alias("funnel")
        return s.final(each.join(F.broadcast(same), ["funnel", "deepest"]).select(name, "client_id", *[f"n{k}" for k in range(1, steps + 1)], "deepest", *[f"t{k}" for k in range(2, steps + 1)], "same_depth"), "funnels")


def _oracle() -> str:
    kinds = kinds_of(FUNNELS)
    nxt = ", ".join(f"min(t) FILTER (WHERE kind = '{k}') OVER w AS {k}" for k in kinds)
    parts = []
    for f, (s, x) in FUNNELS.items():
        q = f"SELECT client_id, t AS s1, {s[1]} AS s2, coalesce({x} <= {s[1]}, false) AS x2 FROM nx WHERE kind = '{s[0]}'"
        for i in (3, 4):
            q = f"SELECT a.*, n.{s[i - 1]} AS s{i}, coalesce(n.{x} <= n.{s[i - 1]}, false) AS x{i} FROM ({q}) a LEFT JOIN nx n ON n.client_id = a.client_id AND n.kind = '{s[i - 2]}' AND n.t = a.s{i - 1}"
        parts.append(f"SELECT '{f}' AS funnel, * FROM ({q})")
    ok = [f"s{i} IS NOT NULL AND NOT x{i} AND s{i} - s1 <= {LIMIT}" for i in (2, 3, 4)]
    got = f"SELECT funnel, client_id, s1, s2, s3, s4, {ok[0]} AS r2, {ok[0]} AND {ok[1]} AS r3, {ok[0]} AND {ok[1]} AND {ok[2]} AS r4 FROM p"
    n = ", ".join(f"count(*) FILTER (WHERE r{i}) AS n{i}" for i in (2, 3, 4))
    t = ", ".join(f"list_sort(list(s{i} - s{i - 1}) FILTER (WHERE r{i}))[(count(*) FILTER (WHERE r{i}) * {PERCENT} + 99) // 100] AS t{i}" for i in (2, 3, 4))
    return f"""WITH r AS (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
nx AS (SELECT client_id, kind, t, {nxt} FROM r WINDOW w AS (PARTITION BY client_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
p AS ({' UNION ALL '.join(parts)}), g AS ({got}),
c AS (SELECT funnel, client_id, count(*) AS n1, {n}, {t} FROM g GROUP BY funnel, client_id),
d AS (SELECT *, CAST(CASE WHEN n4 > 0 THEN 4 WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END AS INTEGER) AS deepest FROM c)
SELECT funnel, client_id, n1, n2, n3, n4, deepest, t2, t3, t4, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM d"""


ORACLE = _oracle()
