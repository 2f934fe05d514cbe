"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source size`` times. The whole
part is taken outright; the fractions are rounded by pivotal sampling: two
documents with fractions p and q and sizes a and b move mass (p up by x/a and
q down by x/b, or the reverse, with the odds that keep each expectation)
until one is 0 or 1. The mass, sum of size times fraction, never changes.
Pairs are formed inside leaves of about LEAF items; each leaf hands one
undecided item to the next level of a reduction tree, whose nodes join FAN of
them, until one is left for the source. Since mass moves in words, that one is
a long document: it goes to its nearer end, and its residual words are handed
to decided documents of the source that are no longer than what is left,
longest first (``settled``), so the source misses its target by less than its
shortest documents.

Rows that nothing tells apart are one item: c such rows want c times as many
copies, of which all but a fraction are taken outright, and the copies are
dealt out to them evenly. So no group of equal rows meets in one task. Items
of over PIECE rows are cut into several.

Odds and leaves come from hashes of (seed, doc_id, tag, size), so reruns agree
whatever the partitioning.

Defined cases: null text has size 0; a null source is a source of its own,
after all others; documents of size 0 and sources of size 0 take 0; an empty
table gives no rows; null and repeated ids are rows like others, each rounded
for itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import numbered, restored, scratch, written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
LEAF = 4096
FAN = 64
#: Equal rows that one item stands for at most.
PIECE = 1 << 16
_NEAR = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n, target: one row a source. rows: source and size.

    The excess over caps is reshared by weight until no source is above its
    cap: with rate = (total - caps of the full) / weights of the rest, a source
    is full when its cap is at most rate * weight. The loop reads the table of
    sources only, and ends since a full source stays full.
    """
    per = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row a source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    per = written(per.withColumn("i", F.row_number().over(order) - 1).withColumn("w", w).drop("i"), "sources")
    total = share * float(per.agg(F.sum("source_size")).first()[0] or 0)
    rate, full = 0.0, -1
    limit = F.col("source_size") * F.lit(cap)
    while True:
        is_full = limit <= F.lit(rate) * F.col("w")
        r = per.agg(F.count_if(is_full), F.sum(F.when(is_full, limit)), F.sum(F.when(~is_full, F.col("w")))).first()
        if r[0] == full or not r[2]:
            break
        full = r[0]
        rate = (total - float(r[1] or 0)) / float(r[2])
    return per.select("source", "source_size", "n", F.least(limit, F.lit(rate) * F.col("w")).cast("double").alias("target"))


def _odds(seed: int, level: int, key: list[int], size: list[int]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}/{level}/{k}/{s}".encode(), digest_size=8).digest(), "big") / 2.0**64 for k, s in zip(key, size, strict=True)])


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions p in (0, 1) pair by pair; returns them and the place of the one still undecided (-1: none)."""
    p = p.copy()
    i = -1
    for j in range(len(p)):
        if not _NEAR < p[j] < 1 - _NEAR:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        a, b = size[i], size[j]
        up = min(a * (1 - p[i]), b * p[j])
        down = min(a * p[i], b * (1 - p[j]))
        x = up if u[j] * (up + down) < down else -down  # each expectation stays as it was
        p[i] += x / a
        p[j] -= x / b
        open_i, open_j = _NEAR < p[i] < 1 - _NEAR, _NEAR < p[j] < 1 - _NEAR
        for k, is_open in ((i, open_i), (j, open_j)):
            if not is_open:
                p[k] = round(p[k])
        i = i if open_i else j if open_j else -1
    return p, i


def _level(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Long documents pair first; the key, of a hash, breaks ties.
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        size, p = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float)
        p, i = pivot(size, p, _odds(seed, level, pdf["key"].tolist(), pdf["size"].tolist()))
        pdf["rest"] = 0.0
        if last and i >= 0:
            end = float(round(p[i]))  # nothing is left to pair it with
            pdf.loc[i, "rest"] = size[i] * (p[i] - end)
            p[i], i = end, -1
        pdf["p"] = p
        pdf["open"] = np.arange(len(p)) == i
        return pdf[["key", "source", "size", "p", "frac", "node", "rest", "open"]]

    return run


def _flips(pdf: pd.DataFrame) -> pd.DataFrame:
    """How many items of each size a source's residual words move: the longest that fit first, then one of the shortest if that comes nearer."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
    left, n, out = abs(float(pdf["rest"].iloc[0])), pdf["n"].tolist(), [0] * len(pdf)
    for i, size in enumerate(pdf["size"].tolist()):
        out[i] = min(n[i], int(left // size))
        left -= out[i] * size
    if out[-1] < n[-1] and 2 * left > pdf["size"].iloc[-1]:
        out[-1] += 1
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "flips": out, "up": pdf["rest"] > 0})


def settled(done: DataFrame) -> DataFrame:
    """key, source, size and p of decided items (key, source, size, p, frac, rest), with each source's residual words handed to items no longer than them."""
    rest = done.groupBy("source").agg(F.sum("rest").alias("left")).where("abs(left) >= 0.5")
    # Words are added by items at 0 and taken back from items at 1, if they had a fraction: then neither end breaks their bounds.
    move = F.when(F.col("left") > 0, F.col("p") == 0).otherwise(F.col("p") == 1) & F.col("frac") & (F.col("size") <= F.abs("left"))
    fit = _by_source(done, written(rest, "rest")).where(move).select("key", "source", "size", F.col("left").alias("rest"))
    # Sizes up to the residual only: a source has as many rows as its longest document has words at most.
    sizes = fit.groupBy("source", "size", "rest").agg(F.count("*").alias("n"))
    fields = [T.StructField("size", T.LongType()), T.StructField("flips", T.LongType()), T.StructField("up", T.BooleanType())]
    flips = written(sizes.groupBy("source").applyInPandas(_flips, T.StructType([done.schema["source"], *fields])).where("flips > 0"), "flips")
    most = flips.agg(F.max("flips")).first()[0]
    if not most:
        return done.select("key", "source", "size", "p")
    # The items with the least keys of each size that moves; with the bound on the rank a task keeps only what may be taken.
    ranked = fit.withColumn("i", F.row_number().over(Window.partitionBy("source", "size").orderBy("key"))).where(F.col("i") <= most)
    m = flips.select(F.col("source").alias("_s"), F.col("size").alias("_n"), "flips", "up")
    moved = ranked.join(m, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))).where("i <= flips")
    moved = written(moved.select(F.col("key").alias("_k"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.when(F.col("up"), 1.0).otherwise(0.0).alias("to")), "moved")
    on = (F.col("key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))
    return done.join(moved, on, "left").select("key", "source", "size", F.coalesce("to", "p").alias("p"))


#: Copies of the table of sources that a hot source's rows are dealt out to.
SALTS = 64


def _by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (with key and source) joined to one row a source, evenly under a hot source."""
    names = [c for c in sources.columns if c != "source"]
    small = sources.select(F.col("source").alias("_s"), *names).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    return salted.join(small, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_t"))).drop("_salt", "_s", "_t")


def rounded(rows: DataFrame, want: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, tag, source, size, source_size, target, c (equal rows) and copies (of all c) for each item of (doc_id, tag, source, size)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    want = written(want.withColumn("rate", rate).withColumn("leaves", F.ceil(F.col("n") / LEAF)), "targets")
    items = rows.groupBy("doc_id", "tag", "source", "size").agg(F.count("*").alias("rows"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PIECE))).alias("piece")
    items = items.select("*", piece).withColumn("c", F.least(F.lit(PIECE), F.col("rows") - F.col("piece") * PIECE)).drop("rows")
    items = items.withColumn("key", F.xxhash64("doc_id", "tag", "source", "size", "piece"))
    j = _by_source(items, want.select("source", "source_size", "target", "rate", "leaves"))
    whole = F.floor(F.col("rate") * F.col("c") + F.lit(_NEAR))
    some = F.col("size") > 0
    j = j.withColumn("base", F.when(some, whole).otherwise(0).cast("long")).withColumn("p", F.when(some, F.greatest(F.col("rate") * F.col("c") - whole, F.lit(0.0))).otherwise(0.0))
    items = written(j.withColumn("node", F.pmod(F.xxhash64("key"), F.col("leaves")).cast("long")).drop("piece", "rate", "leaves"), "items")
    names = ["key", "source", "size", "p", "frac", "node"]
    cur = items.withColumn("frac", F.col("p") > _NEAR).select(*names)
    most = int(want.agg(F.max("leaves")).first()[0] or 1)
    schema, done, level = T.StructType([*cur.schema.fields, T.StructField("rest", T.DoubleType()), T.StructField("open", T.BooleanType())]), None, 0
    while True:
        last = most <= 1
        out = written(cur.groupBy("source", "node").applyInPandas(_level(seed, level, last), schema), "rounded")
        part = out.where(~F.col("open")).drop("node", "open")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        cur = out.where("open").withColumn("node", F.floor(F.col("node") / FAN).cast("long")).select(*names)
        most, level = -(-most // FAN), level + 1
    final = settled(done).withColumnRenamed("p", "up")
    # Two items may share a key by chance, but hardly source and size as well.
    on = (items["key"] == final["key"]) & items["source"].eqNullSafe(final["source"]) & (items["size"] == final["size"])
    return items.join(final, on).drop(final["source"], final["size"]).select("doc_id", "tag", "source", "size", "source_size", "target", "c", (F.col("base") + F.col("up")).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each document."""
    with scratch(docs.sparkSession) as s:
        rows = written(sizes(docs).withColumn("tag", F.lit(0).cast("long")), "sizes")
        plan = s.final(rounded(rows, targets(rows), seed), "mix")
    # The copies of c equal rows, evenly: the first (copies mod c) rows have one more.
    out = plan.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    copies = (F.floor(F.col("copies") / F.col("c")) + (F.col("i") <= F.col("copies") % F.col("c")).cast("long")).cast("int")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix, each as often as it is taken; all columns of docs stay.

    A document without words is in no mix and goes. Equal rows (all columns)
    stand in the mix as often as they are taken together.
    """
    rows, own = numbered(docs)
    text = own["text"]
    # A copy of a row can't be told from it, so what names rows is a hash of all their columns.
    tag = F.xxhash64(F.to_json(F.struct(*own.values()), {"ignoreNullFields": "false"}))  # a hash of the columns themselves would pass over nulls
    with scratch(docs.sparkSession) as s:
        size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
        key = rows.select(F.col(own["doc_id"]).alias("doc_id"), F.col(own["source"]).alias("source"), size.alias("size"), tag.alias("tag"))
        key = written(key, "sizes")
        plan = rounded(key, targets(key), seed).groupBy("doc_id", "tag", "source", "size").agg(F.sum("copies").alias("_copies"), F.sum("c").alias("_same")).where("_copies > 0")
        plan = s.final(plan.withColumnsRenamed({"doc_id": "_id", "tag": "_tag", "source": "_source", "size": "_size"}), "mix")
    tagged = rows.withColumn("_row", tag).withColumn("_words", size)
    on = tagged[own["doc_id"]].eqNullSafe(plan["_id"]) & (tagged["_row"] == plan["_tag"]) & tagged[own["source"]].eqNullSafe(plan["_source"]) & (tagged["_words"] == plan["_size"])
    one = tagged.join(plan.where("_same = 1"), on)
    many = tagged.join(plan.where("_same > 1"), on).dropDuplicates([own["doc_id"], "_row", own["source"], "_words"])
    out = one.unionByName(many).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return restored(out, own)
