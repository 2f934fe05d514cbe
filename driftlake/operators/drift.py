"""Message drift between two tags: keyed full compare, then greedy pairing of what is left by similarity."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..session import kept
from .ranks import placed

# Fixed value: the least similarity of a fuzzy pair.
THRESHOLD = 0.55


def exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full compare of (path, idx, prose, severity, name): kind is retag, reseverity or retext, removed and added where one side lacks the key; equal rows give none."""
    names = ["prose", "severity", "name"]
    x = a.select("path", "idx", F.struct(*names).alias("a"))
    j = x.join(b.select("path", "idx", F.struct(*names).alias("b")), ["path", "idx"], "full_outer")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    kind = (
        F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(same("prose") & same("severity") & same("name"), F.lit(None))
        .when(same("prose") & ~same("name"), "retag").when(same("prose"), "reseverity").otherwise("retext")
    )
    return j.select("path", "idx", kind.alias("kind"), F.col("a.prose").alias("before"), F.col("b.prose").alias("after"), F.col("a.name").alias("before_name"), F.col("b.name").alias("after_name")).where("kind is not null")


#: Texts of one side that a task compares at once, and candidate pairs that one task chooses from.
BLOCK, CHOICES = 256, 1_000_000
_PAIR = "path string, l long, r long, similarity double, compared long"
_SLOTS = 64


def _classes(n: Column) -> Column:
    """Texts by length: each class is up to a quarter longer than the one before."""
    return F.floor(F.log(1.25, F.greatest(n, F.lit(1)).cast("double"))).cast("int")


def _reach(a: Column, b: Column) -> Column:
    """The best ratio that texts of two length classes can have."""
    far = F.pow(F.lit(1.25), F.greatest(F.abs(a - b) - 1, F.lit(0)).cast("double"))  # the longer is so many times longer, at least
    return 2 / (1 + far)


def _counts(texts: list[str]) -> np.ndarray:
    """How often each text has the characters of each slot."""
    out = np.zeros((len(texts), _SLOTS), np.int32)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i] = np.bincount(codes % _SLOTS, minlength=_SLOTS)
    return out


def similar(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (path, l, r, similarity) of texts of one path that reach ``threshold``; rows without l tell how many pairs were compared.

    a and b: path, idx, text. Texts are dealt out to blocks of BLOCK by length
    and a hash; blocks meet whose lengths allow the ratio, and pairs in them
    are compared whose characters, counted in slots, allow it: twice what they
    have in common over both lengths bounds the ratio from above.
    """

    def blocks(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        t = F.coalesce("text", F.lit(""))
        d = rows.select("path", F.col("idx").cast("long").alias("idx"), t.alias("text"), _classes(F.length(t)).alias("class"))
        n = d.groupBy("path", "class").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
        n = n.select(F.col("path").alias("_p"), F.col("class").alias("_c"), "n")
        d = d.join(n, F.col("path").eqNullSafe(F.col("_p")) & (F.col("class") == F.col("_c"))).withColumn("block", F.pmod(F.xxhash64("idx", "text"), F.col("n")))
        own = n.select(F.col("_p").alias(f"path_{side}"), F.col("_c").alias(f"class_{side}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias(f"block_{side}"))
        return d.drop("_p", "_c", "n"), own

    left, lb = blocks(a, "l")
    right, rb = blocks(b, "r")
    meet = lb.join(rb, F.col("path_l").eqNullSafe(F.col("path_r")) & (_reach(F.col("class_l"), F.col("class_r")) >= threshold)).drop("path_r").withColumnRenamed("path_l", "path")
    meet = meet.withColumn("meet", F.xxhash64("path", "class_l", "block_l", "class_r", "block_r"))

    def at(rows: DataFrame, side: str) -> DataFrame:
        m = meet.select(F.col("path").alias("_p"), F.col(f"class_{side}").alias("_c"), F.col(f"block_{side}").alias("_b"), "meet")
        return rows.join(m, F.col("path").eqNullSafe(F.col("_p")) & (F.col("class") == F.col("_c")) & (F.col("block") == F.col("_b"))).select("path", "meet", "idx", "text", F.lit(side).alias("side"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for path, part in pdf.groupby("path", dropna=False):  # blocks of two paths whose hashes agree
            x, y = (part[part["side"] == s] for s in "lr")
            ct, dt = x["text"].tolist(), y["text"].tolist()
            if not ct or not dt:
                continue
            ca, cb, na, nb = _counts(ct), _counts(dt), np.array(list(map(len, ct))), np.array(list(map(len, dt)))
            known: dict[tuple[str, str], float] = {}
            ys, name, compared = y["idx"].tolist(), None if pd.isna(path) else path, 0
            for i, (l, s) in enumerate(zip(x["idx"].tolist(), ct, strict=True)):
                total = na[i] + nb
                for j in np.flatnonzero(2 * np.minimum(ca[i], cb).sum(1) >= threshold * total).tolist():
                    key = s, dt[j]
                    if key not in known:
                        known[key] = 1.0 if s == dt[j] else similarity(*key)
                        compared += 1
                    if known[key] >= threshold:
                        rows.append((name, l, ys[j], known[key], None))
            rows.append((name, None, None, None, compared))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PAIR.split(", ")]).astype({"l": "Int64", "r": "Int64", "compared": "Int64"})

    return at(left, "l").unionByName(at(right, "r")).groupBy("meet").applyInPandas(one, _PAIR)


def _chosen(pdf: pd.DataFrame) -> pd.DataFrame:
    """In order of l, each takes the most similar r that is left, the first of equals."""
    pdf = pdf.sort_values(["l", "similarity", "r"], ascending=[True, False, True], kind="stable")
    done, taken, rows = None, set(), []
    for path, l, r, s in zip(pdf["path"], pdf["l"], pdf["r"], pdf["similarity"], strict=True):
        if l != done and r not in taken:
            done = l
            taken.add(r)
            rows.append((path, l, r, s))
    return pd.DataFrame(rows, columns=["path", "l", "r", "similarity"])


def greedy(pairs: DataFrame) -> DataFrame:
    """One r at most for each l of pairs (path, l, r, similarity): in order of l, each takes the most similar that is left.

    A path with more than CHOICES pairs is worked off in steps of about so
    many, in order of l; what a step has taken is not there for the next.
    """
    schema = "path string, l long, r long, similarity double"
    counts = pairs.groupBy("path", "l").agg(F.count("*").alias("n"))
    most = counts.groupBy("path").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= CHOICES:
        return pairs.groupBy("path").applyInPandas(_chosen, schema)
    sums = placed(counts, [F.col("path"), F.col("l")], weight="n")
    first = sums.groupBy(F.col("path").alias("_p")).agg(F.min("before").alias("first"))
    steps = sums.join(first, F.col("path").eqNullSafe(F.col("_p"))).select("_p", F.col("l").alias("_l"), F.floor((F.col("before") - F.col("first")) / CHOICES).alias("step"))
    pairs = kept(pairs.join(steps, F.col("path").eqNullSafe(F.col("_p")) & (F.col("l") == F.col("_l"))).drop("_p", "_l"), "pairs")
    done: list[DataFrame] = []
    for step in range((pairs.agg(F.max("step")).first()[0] or 0) + 1):
        now = pairs.where(F.col("step") == step)
        for d in done:
            gone = d.select(F.col("path").alias("_p"), F.col("r").alias("_r"))
            now = now.join(gone, F.col("path").eqNullSafe(F.col("_p")) & (F.col("r") == F.col("_r")), "left_anti")
        done.append(kept(now.drop("step").groupBy("path").applyInPandas(_chosen, schema), "chosen"))
    return reduce(DataFrame.unionAll, done)


def paired(events: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Removed and added events of one path joined greedily, in the order of the removed: each takes the most similar that is left."""
    removed, added = (events.where(F.col("kind") == k) for k in ("removed", "added"))
    pairs = similar(removed.select("path", "idx", F.col("before").alias("text")), added.select("path", "idx", F.col("after").alias("text")), threshold)
    pairs = kept(pairs.where("l is not null").drop("compared"), "similar")
    m = kept(greedy(pairs), "matches").withColumnRenamed("path", "_p")
    x = removed.join(m, F.col("path").eqNullSafe(F.col("_p")) & (F.col("idx") == F.col("l")), "left").select("path", "before", "before_name", "r", "similarity")
    y = added.join(m.select("_p", F.col("r").alias("_r"), F.lit(True).alias("got")), F.col("path").eqNullSafe(F.col("_p")) & (F.col("idx") == F.col("_r")), "left").select(F.col("path").alias("_q"), "idx", "after", "after_name", "got")
    out = x.join(y.where("got"), F.col("path").eqNullSafe(F.col("_q")) & (F.col("r") == F.col("idx")), "left")
    out = out.select("path", F.when(F.col("r").isNull(), "removed").otherwise("retext").alias("kind"), "before", "after", "before_name", "after_name", "similarity")
    none = F.lit(None).cast("string")
    rest = y.where("got is null").select(F.col("_q").alias("path"), F.lit("added").alias("kind"), none.alias("before"), "after", none.alias("before_name"), "after_name", F.lit(None).cast("double").alias("similarity"))
    return out.unionByName(rest)


def drift(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    events = exact(a, b)
    keyed = events.where("kind not in ('removed', 'added')").withColumn("similarity", F.lit(None).cast("double")).drop("idx")
    return keyed.unionByName(paired(events, threshold))
