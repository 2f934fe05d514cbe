"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document's distinct word shingles are hashed to a set; equal sets
   become one class (its smallest doc_id), so copies never make pairs.
2. A class's signature has BANDS * ROWS minima. Classes that share a band are
   candidates. In each bucket the smallest class is tested against the others
   (a star, not all pairs).
3. A test compares signatures batch by batch. After n places with m matches
   the similarity has the posterior Beta(m + 1, n - m + 1); a candidate goes
   as soon as P(similarity >= threshold) < MISS. Survivors are verified on the
   full sets.
4. Links give components. A bucket that still holds several components may
   hide a link between members that no star tested. Members outside its
   largest component are first tested against the NEAREST most similar ones of
   other components, which joins families that the star left in pieces. Then,
   in buckets that still hold several components, the signatures of all
   members of different components are compared in blocks; only members with a
   partner that outlasts all batches go on, with their sets, to a second pass
   over the blocks that verifies. After that no two candidates are left that
   are neither tested nor joined.

At similarity 0.8 a pair shares no band with probability (1 - 0.8**ROWS)**BANDS,
about 1e-7, and less above.

Defined cases: null and empty texts have empty sets and link with nothing; a
text shorter than a shingle has its whole word sequence as its one shingle; an
empty table gives no rows; rows that share a doc_id are one document with all
the links of its texts; rows without doc_id are documents of their own, and a
component's id is null only if it has no other rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lookup, scratch, written
from ._text import U, Words, gram_starts, grams, mix, slices

BANDS, ROWS = 40, 5
PLACES = BANDS * ROWS
BATCH = 40
#: A candidate is dropped when the posterior probability that it links is below this.
MISS = 1e-5
#: Members of one bucket that are compared in one task (twice so many when blocks are paired).
BLOCK = 512
NEAREST = 2
#: Rows of an Arrow batch of full sets.
SET_ROWS = 500
#: Stands for a null doc_id.
LAST = (1 << 63) - 1

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, PLACES, dtype=np.uint64) * U(2) + U(1)
_X = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document, and n+1 offsets."""
    w = Words(column, lower=True)
    h, doc = w.hashes(), w.doc()
    ok = np.flatnonzero(gram_starts(w.ptr, k, len(h)))
    g, d = grams(h, k)[ok] ^ U(0x5851F42D4C957F2D), doc[ok]
    short = np.flatnonzero((w.n > 0) & (w.n < k))
    if len(short):
        whole = [grams(h[w.ptr[i] : w.ptr[i + 1]], int(w.n[i]))[0] ^ (U(0xA0761D6478BD642F) + U(int(w.n[i]))) for i in short]
        g, d = np.concatenate([g, np.array(whole, dtype=U)]), np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return g, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(w.n)))]).astype(np.int64)


def signatures(g: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """uint16 minima, one row a document (of any value for empty sets)."""
    out = np.zeros((len(ptr) - 1, PLACES), np.uint16)
    some = np.flatnonzero(np.diff(ptr))
    if len(some):
        starts = ptr[:-1][some]
        with np.errstate(over="ignore"):
            for j in range(PLACES):
                # The least of n hashes is about 2**64 / n: its high bits are zeros in long texts, so it is mixed again before it is cut.
                out[some, j] = (mix(np.minimum.reduceat((g ^ _X[j]) * _A[j], starts)) >> U(48)).astype(np.uint16)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64 keys, one row a signature and one column a band."""
    with np.errstate(over="ignore"):
        s = sig.reshape(len(sig), BANDS, ROWS).astype(U)
        k = np.zeros((len(sig), BANDS), U) + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            k = mix(k * U(0xD1342543DE82EF95) + s[:, :, r] + U(1))
    return k.view(np.int64)


def least_matches(percent: int, miss: float = MISS) -> dict[int, int]:
    """For each batch end n: the fewest matches with P(similarity >= percent/100) >= miss.

    P(Beta(m + 1, n - m + 1) >= t) is the chance of at most m successes in n + 1 trials of odds t.
    """
    t, out = percent / 100, {}
    for n in range(BATCH, PLACES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out[n] = m
    return out


def survive(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Places of the pairs (rows of a and b) that no batch rules out."""
    live, got = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, m in least.items():
        got = got + (a[live, n - BATCH : n] == b[live, n - BATCH : n]).sum(1)
        on = got >= m
        live, got = live[on], got[on]
    return live


def _sig(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), PLACES)


def _key(items: bytes) -> bytes:
    return hashlib.blake2b(items, digest_size=16).digest()


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes, null for the empty set), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                g, ptr = shingle_sets(part.column(1), k)
                sig = signatures(g, ptr)
                keys = [_key(g[a:b].tobytes()) if b > a else None for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ptr)), pa.array(keys, pa.binary()), pa.array([s.tobytes() if x else None for s, x in zip(sig, keys, strict=True)], pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = band_keys(_sig(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], ["node", "band"])

    return classes.select("node", "sig").mapInArrow(run, "node long, band long")


def _tested(pairs: DataFrame, sigs: DataFrame, least: dict[int, int]) -> DataFrame:
    """Pairs (a, b) that outlast the signature batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                on = pa.array(survive(_sig(part.column(2)), _sig(part.column(3)), least))
                yield pa.RecordBatch.from_arrays([part.column(0).take(on), part.column(1).take(on)], ["a", "b"])

    # The small side of a star is one hot class: pairs and sigs are written tables, so each join's inputs come
    # from its own exchanges and adaptive execution splits skewed partitions.
    one = pairs.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    two = one.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    return two.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return both * 100 >= percent * (len(x) + len(y) - both)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for i in range(batch.num_rows):
                if similar(*(np.frombuffer(batch.column(c)[i].as_buffer(), U) for c in (2, 3)), percent):
                    on.append(i)
            take = pa.array(on, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
    return two.select("a", "b", "ia", "ib").mapInArrow(run, "a long, b long")


def _own_sets(picked: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and items, from rows (rep, text) and (rep, set_key, node): the text whose set has the class's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                g, ptr = shingle_sets(part.column(1), k)
                items = [g[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                keys = [_key(i) if i else None for i in items]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(items, pa.binary())], ["rep", "set_key", "items"])

    found = picked.select("rep", "text").mapInArrow(run, "rep long, set_key binary, items binary")
    # Rows of one doc_id and set have equal items; the join needs no other shuffle than the aggregate's.
    return found.groupBy("rep", "set_key").agg(F.first("items").alias("items")).join(nodes, ["rep", "set_key"]).select("node", "items")


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) for each node of links (a, b).

    Each round takes the least label among neighbours, then follows labels one step; it ends when nothing moves.
    """
    both = written(links.union(links.select("b", "a")).distinct().toDF("node", "other"), "links")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "labels")
    while True:
        far = both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        near = labels.join(far, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        near = written(near, "near")
        jump = near.groupBy("comp").agg(F.count("*").alias("n")).join(near.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp")
        new = written(lookup(near, written(jump, "jump"), "comp", "n", F.col("node")).select("node", "was", F.least("comp", "up").alias("comp")), "labels")
        if new.where("comp <> was").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _crossed(rows: DataFrame, least: dict[int, int], percent: int, how: str) -> DataFrame:
    """Pairs (a, b) of different components in one bucket; rows: band, n (of the bucket), node, comp, sig, and items for ``verified``.

    ``nearest``: the NEAREST most similar ones for each member outside the
    largest component, not yet verified. ``flagged``: (node, band) for each
    member with a partner of another component that outlasts all batches.
    ``verified``: all such partners are compared on full sets and the links
    come out; once joined, components are one. The last two take a pair in the
    bucket of the first band that it shares, not in every one.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    extra = ["items"] if how == "verified" else []
    rows = rows.select("band", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "node", "comp", "sig", *extra)
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def pairs(t: pa.Table) -> pa.RecordBatch:
        band, i, j, own, node, comp = (t.column(c).to_numpy() for c in range(6))
        sig = _sig(t.column(6))
        items = t.column(7).to_pylist() if extra else None
        edge = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        out: list[np.ndarray] = []
        for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(band)]]), strict=True):
            if how == "nearest":
                _, of, size = np.unique(comp[a:b], return_inverse=True, return_counts=True)
                for x in a + np.flatnonzero(of != size.argmax()):
                    y = a + np.flatnonzero(comp[a:b] != comp[x])
                    y = y[survive(np.broadcast_to(sig[x], (len(y), PLACES)), sig[y], least)]
                    if len(y) > NEAREST:
                        y = y[np.argsort(-(sig[y] == sig[x]).sum(1), kind="stable")[:NEAREST]]
                    out.append(np.stack([np.full(len(y), node[x]), node[y]], 1))
                continue
            c = comp[a:b].copy()
            flag = np.zeros(b - a, bool)
            before = ROWS * int(np.flatnonzero(band_keys(sig[a : a + 1])[0] == band[a])[0])  # places of the bands before this bucket's
            for x in range(a, b - 1):
                y = x + 1 + np.flatnonzero((c[x + 1 - a :] != c[x - a]) & ((i[x] == j[x]) | (own[x + 1 : b] != own[x])))
                if len(y):
                    y = y[survive(np.broadcast_to(sig[x], (len(y), PLACES)), sig[y], least)]
                if len(y) and before:
                    y = y[~(sig[y, :before] == sig[x, :before]).reshape(len(y), -1, ROWS).all(2).any(1)]
                if how == "flagged":
                    flag[y - a] = True
                    flag[x - a] |= len(y) > 0
                    continue
                mine = np.frombuffer(items[x], U) if len(y) else None
                for z in y.tolist():
                    if c[z - a] != c[x - a] and similar(mine, np.frombuffer(items[z], U), percent):
                        out.append(np.array([[node[x], node[z]]]))
                        c[c == c[z - a]] = c[x - a]
            if how == "flagged":
                out.append(np.stack([node[a:b][flag], band[a:b][flag]], 1))
        got = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        if how != "flagged":
            got = np.sort(got, 1)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            n = t.num_rows
            if not n:
                continue
            last = tuple(t.column(c)[n - 1].as_py() for c in range(3))  # its rows may go on in the next batch
            cut = n
            while cut and tuple(t.column(c)[cut - 1].as_py() for c in range(3)) == last:
                cut -= 1
            if cut:
                yield pairs(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield pairs(held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def classes_of(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row.

    n_links counts the links met while components were joined: those inside a
    component that other links had already joined are not looked for.
    """
    with scratch(docs.sparkSession) as s:
        return s.final(_classes_of(docs.select("doc_id", "text"), least_matches(percent), k, percent), "near-duplicates")


def _classes_of(docs: DataFrame, least: dict[int, int], k: int, percent: int) -> DataFrame:
    ids = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    sketches = written(sketch(ids, k), "sketches")
    classes = sketches.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    # A class is a node, named by its smallest doc_id; where another class has the same one (repeated and null ids), by a hash.
    classes = written(classes, "classes")
    taken = classes.groupBy("rep").agg(F.min("set_key").alias("first"), F.count("*").alias("same")).where((F.col("same") > 1) | (F.col("rep") == LAST)).select("rep", F.when(F.col("rep") < LAST, F.col("first")).alias("first"), "same")
    named = lookup(classes, written(taken, "taken"), "rep", "same", F.xxhash64("set_key"))
    nodes = written(named.select("set_key", "rep", "n", F.when(F.col("same").isNull() | F.col("set_key").eqNullSafe(F.col("first")), F.col("rep")).otherwise(F.xxhash64("set_key", "rep")).alias("node")), "nodes")
    # Texts of one doc_id are one document: its classes are joined from the start.
    texts = sketches.where((F.col("doc_id") < LAST) & F.col("set_key").isNotNull()).groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi")
    shared = sketches.select("doc_id", "set_key").join(texts.select("doc_id", "lo"), "doc_id").where("set_key > lo").distinct()
    at = lambda c: nodes.select(F.col("set_key").alias(c), F.col("node").alias(c + "_node"))
    same_id = written(shared.select(F.col("lo").alias("a"), F.col("set_key").alias("b")).distinct().join(at("a"), "a").join(at("b"), "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")), "same-id")
    # One row a class: the key holds doc_id too, so a class of many copies is spread over the tasks.
    sigs = sketches.select("set_key", F.col("doc_id").alias("rep"), "sig").join(nodes.select("set_key", "rep", "node"), ["set_key", "rep"])
    sigs = written(sigs.groupBy("node").agg(F.first("sig").alias("sig")), "signatures")
    buckets = written(_bands(sigs).groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1"), "buckets")
    # Plain joins on the band: both sides come from an exchange of the join, so adaptive execution splits a hot band.
    hits = written(_bands(sigs).join(buckets, "band").select("band", "n", "leader", "node"), "hits")
    # Full sets of the classes in any bucket with company: the only shuffle of texts.
    inside = nodes.join(hits.select("node").distinct(), "node").select("node", "set_key", "rep")
    picked = ids.withColumnRenamed("doc_id", "rep").join(inside.select("rep").distinct(), "rep", "left_semi")
    sets = written(_own_sets(picked, inside, k), "sets")
    stars = written(hits.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    tested = written(_tested(stars, sigs, least), "tested")
    links = written(_linked(tested, sets, percent), "links", SET_ROWS)
    every = links.unionByName(same_id)
    labels = components(every)
    for how in ("nearest", "verified"):
        # Buckets with several components left.
        bucket = written(hits.join(labels, "node", "left").select("band", "n", "node", F.coalesce("comp", "node").alias("comp")), "named")
        several = bucket.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
        cross = written(bucket.join(written(several, "several"), "band").select("band", "n", "node", "comp"), "cross")
        signed = cross.join(sigs, "node")
        if how == "nearest":
            pairs = written(_crossed(signed, least, percent, how).join(stars, ["a", "b"], "left_anti"), "crossed")
            more = written(_linked(pairs, sets, percent), "more-links", SET_ROWS)
        else:
            flagged = written(_crossed(signed, least, percent, "flagged").toDF("node", "band"), "flagged")
            size = written(flagged.groupBy("band").agg(F.count("*").alias("n")), "flagged-buckets")
            left = written(cross.drop("n").join(flagged, ["node", "band"], "left_semi").join(size, "band"), "left")
            more = written(_crossed(left.join(sigs, "node").join(sets, "node"), least, percent, how), "more-links", SET_ROWS)
        if not more.isEmpty():
            every = every.unionByName(more)
            labels = components(every)
    degree = every.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    comps = written(nodes.join(labels, "node", "left").select("node", "set_key", "rep", "n", F.coalesce("comp", "node").alias("comp")), "comps")
    # The smallest doc_id of each component: nodes may be named by hashes.
    lowest = written(comps.groupBy("comp").agg(F.min("rep").alias("component"), F.count("*").alias("size")), "lowest")
    found = lookup(comps, lowest, "comp", "size", F.col("node")).join(degree, "node", "left")
    found = written(found.select("set_key", "n", "component", F.coalesce("n_links", F.lit(0)).alias("n_links")), "found")
    out = lookup(sketches.select("doc_id", "n_shingles", "set_key"), found, "set_key", "n", F.col("doc_id"))
    back = lambda c: F.nullif(c, F.lit(LAST))
    return out.select(back(F.col("doc_id")).alias("doc_id"), "n_shingles", back(F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links for each row."""
    return classes_of(docs, k, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_links")


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id.

    Rows that share a doc_id are one document: they stay or go together. Rows
    without doc_id can't be named: all stay as long as one is the first of its component.
    """
    with scratch(docs.sparkSession) as s:
        keep = s.final(near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias("_keep")).distinct(), "kept")
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]), "left_semi")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS far FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.far = e.x),
m AS (SELECT doc_id, min(far) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
