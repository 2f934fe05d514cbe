"""Cascades: which messages of a cluster only follow from its earlier errors.

A root error covers the places inside its span; what is covered is no root, so
it covers nothing itself. The roots are therefore a walk through a cluster's
places, each step to the next error that the walk so far doesn't cover. Places
are dealt out by ranges of (cluster, start) and walked there, so a cluster with
a third of all rows spreads over a third of the ranges. How far a walk's cover
reaches when it leaves a range is one number, handed on to the next range;
ranges inside one cluster are walked again when that number changes what they
hand on themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept

_NONE = int(np.iinfo(np.int64).min)
Entry = tuple[int, int]


def walk(start: np.ndarray, reach: np.ndarray, upto: int = _NONE) -> tuple[np.ndarray, int]:
    """Of places by rising start: up to where earlier root errors cover, at each place and after the last. reach: the furthest end of a place's errors, or _NONE; upto: the cover on entry."""
    at = np.flatnonzero(reach != _NONE)
    errors, ends = start[at], reach[at]
    roots, covers = [], [upto]
    i = int(np.searchsorted(errors, upto))
    while i < len(errors):
        upto = max(upto, int(ends[i]))
        roots.append(errors[i])
        covers.append(upto)
        i = max(i + 1, int(np.searchsorted(errors, upto)))
    return np.array(covers, np.int64)[np.searchsorted(np.array(roots, np.int64), start)], upto


def _walked(pdf: pd.DataFrame, entries: dict[int, Entry]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The places of a range, walked, and what the range hands on."""
    pdf = pdf.sort_values(["key", "start"], kind="stable")
    part, keys = int(pdf["part"].iloc[0]), pdf["key"].to_numpy()
    start, reach = pdf["start"].to_numpy(np.int64), pdf["reach"].to_numpy(np.int64)
    cover, first = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(pdf)]
    upto = _NONE
    for a, b in zip(cuts, cuts[1:]):
        upto, error = entries.get(part, (_NONE, _NONE)) if a == 0 else (_NONE, _NONE)
        cover[a:b], upto = walk(start[a:b], reach[a:b], upto)
        own = np.flatnonzero(reach[a:b] != _NONE)
        first[a:b] = error if error != _NONE else start[a + own[0]] if len(own) else _NONE
    marks = pdf[["key", "start"]].assign(covered=start < cover, late=(first != _NONE) & (first < start))
    return marks, pd.DataFrame({"part": [part], "head": [keys[0]], "tail": [keys[-1]], "upto": [upto], "first": [first[-1]]})


def marked(places: DataFrame) -> DataFrame:
    """key, start, covered (inside an earlier root error's span) and late (after the first error) of places (key string, start long, reach long or null), one row each."""
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.select("key", "start", F.coalesce("reach", F.lit(_NONE)).alias("reach")).repartitionByRange(parts, "key", "start")
    d = kept(dealt.withColumn("part", F.spark_partition_id()), "cascades")

    def handed(rows: DataFrame, entries: dict[int, Entry]) -> dict:
        ends = rows.groupBy("part").applyInPandas(lambda pdf: _walked(pdf, entries)[1], "part int, head string, tail string, upto long, first long")
        return {r["part"]: r for r in ends.collect()}  # a row a range

    state, entries = handed(d, {}), {}
    while True:
        order = sorted(state)
        new = {q: (state[p]["upto"], state[p]["first"]) for p, q in zip(order, order[1:]) if state[p]["tail"] == state[q]["head"]}
        again = [q for q in new if new[q] != entries.get(q) and state[q]["head"] == state[q]["tail"]]
        entries = new
        if not again:
            break
        state |= handed(d.where(F.col("part").isin(again)), entries)
    return d.groupBy("part").applyInPandas(lambda pdf: _walked(pdf, entries)[0], "key string, start long, covered boolean, late boolean")


def collapse(obs: DataFrame) -> DataFrame:
    """is_root for each (cluster, seq, fingerprint, severity, start, end, prone) row.

    Not a root: a repeat of (fingerprint, place) by seq; a start inside an
    earlier root error's span; a prone warning after the first root error.
    start and end are whole numbers, seq tells the rows of a place apart. A
    null cluster is a cluster like others; a row without a start is a root
    unless it is a repeat; an error without an end covers nothing.
    """
    cols = obs.select("cluster", "seq", "fingerprint", "severity", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "prone", F.to_json(F.struct("cluster")).alias("key"))
    firsts = cols.groupBy("key", "start", "fingerprint").agg(F.min(F.struct("seq", "severity", "end", "prone")).alias("f")).select("key", "start", "fingerprint", "f.*")
    places = firsts.where("start is not null").groupBy("key", "start").agg(F.max(F.when(F.col("severity") == "error", F.greatest("end", "start"))).alias("reach"))
    no = F.lit(False)
    follows = F.coalesce("covered", no) | F.coalesce(F.col("late") & (F.col("severity") == "warning") & F.col("prone"), no)
    roots = firsts.join(marked(places), ["key", "start"], "left").where(~follows).select(*[F.col(c).alias(f"_{c}") for c in ("key", "start", "fingerprint", "seq")])
    same = F.col("key") == F.col("_key")
    for c in ("start", "fingerprint", "seq"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return cols.join(roots, same, "left").select("cluster", "seq", F.col("_key").isNotNull().alias("is_root"))
