"""Substring dedup with prefix-partitioned suffix trees.

A window is WINDOW consecutive words. Each word covered by a window that also
starts in a document with a smaller doc_id goes. Every answer is read from
suffix trees; what precedes them only decides which suffixes meet where.

1. Documents of one word sequence are a class: one row with its smallest and
   largest doc_id stands for them.
2. Suffixes are split into groups by a part of their prefix: the seed, the
   least-hashed gram of SEEDS[0] words among the first WINDOW words. Equal
   windows have equal seeds, and neighbouring suffixes share one, so a run of
   them travels once, as one body of text, not WINDOW times. Only seeds of two
   documents can hold a repeat; texts are needed for their runs alone. Equal
   bodies are one leaf, again with its smallest and largest document.
3. A group of more than GROUP_WORDS words of different bodies doesn't fit the
   memory of a task: its prefix is lengthened. Its runs are split anew by the
   least-hashed gram of SEEDS[1] words, and so on; SEEDS ends with the whole
   window, whose groups are one leaf each. Small groups keep short prefixes.
4. Each group's suffix tree is built from the sorted suffixes of its bodies
   (names of doubled prefixes, Karp, Miller and Rosenberg 1972) and the lengths
   of neighbours' common prefixes, which no limit cuts: internal nodes are the
   intervals of that array (Abouelhoda, Kurtz and Ohlebusch 2004), found with a
   stack. Nodes of depth WINDOW or more whose suffixes are preceded by different
   words are the maximal repeats. A suffix is covered as far as the deepest of
   them goes that has a smaller document below it.
5. Answers go back from leaves to the runs that are equal to them, to classes,
   and to all documents of a class.

Defined cases: null and empty texts have no words (n_removed 0, digest of the
empty string); a null doc_id counts as larger than any other, and rows without
doc_id don't remove one another's words; rows with equal doc_id never remove
one another's words, and are judged by their own texts; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lookup, scratch, written
from ._text import Words, grams, slices

WINDOW = 50
#: Words of the part of the prefix that groups suffixes, from level to level; the last level is WINDOW.
SEEDS = (12, 24, 36)
#: Words of different bodies that one tree may hold (about 15 MB in the task); beyond it the prefix is lengthened.
GROUP_WORDS = 1 << 16
#: Small groups share a task's pass up to so many words.
BATCH_WORDS = 1 << 19
LAST = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").digest()


def seeds_of(h: np.ndarray, window: int, seed: int) -> np.ndarray:
    """For each window of one document, the place of its seed (the leftmost least gram)."""
    g = grams(h, seed)
    span = window - seed + 1
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    val, at, size = g, np.arange(len(g)), 1
    while size < span:
        step = min(size, span - size)
        left, right = slice(0, len(val) - step), slice(step, None)
        less = val[right] < val[left]
        val, at = np.where(less, val[right], val[left]), np.where(less, at[right], at[left])
        size += step
    return at[:n]


def _scan(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Rows of documents (seed null: n words, sha) and rows of seeds (n: the place), by (d, tag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column(2))
                h = w.hashes()
                sha = [hashlib.sha256(w.joined(i)).digest() for i in range(len(w.n))]
                rows, places, keys = [], [], []
                for i in range(len(w.n)):
                    x = h[w.ptr[i] : w.ptr[i + 1]]
                    at = np.unique(seeds_of(x, window, seed))
                    if len(at):
                        rows.append(np.full(len(at), i))
                        places.append(at)
                        keys.append(grams(x, seed)[at])
                r = np.concatenate(rows) if rows else np.zeros(0, int)
                m = len(w.n)
                pick = pa.array(np.concatenate([np.arange(m), r]))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pick), part.column(1).take(pick),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))]),
                    pa.array(np.concatenate([w.n, *places]).astype(np.int32)), pa.concat_arrays([pa.array(sha, pa.binary()), pa.nulls(len(r), pa.binary())]),
                ], ["d", "tag", "seed", "n", "sha"])

    return docs.mapInArrow(run, "d long, tag long, seed long, n int, sha binary")


RUN = "seed long, up binary, d long, nxt long, start int, n int, digest binary, body binary"
_RUN_TYPES = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
_RUN_NAMES = ["seed", "up", "d", "nxt", "start", "n", "digest", "body"]


def _runs(hits: DataFrame, window: int, seed: int) -> DataFrame:
    """RUN rows from (up, d, nxt, text, places): the runs of suffixes with a shared seed, as one body each; n of its words.

    places: those of the seeds wanted, null for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(3))
                h = w.hashes()
                out: list[list] = [[] for _ in _RUN_TYPES]
                for i in range(len(w.n)):
                    a = int(w.ptr[i])
                    x = h[a : w.ptr[i + 1]]
                    at = seeds_of(x, window, seed)
                    if not len(at):
                        continue
                    edge = np.flatnonzero(at[1:] != at[:-1]) + 1
                    key = grams(x, seed).view(np.int64)
                    up, d, nxt = (part.column(c)[i].as_py() for c in range(3))
                    p = part.column(4)[i]
                    s, e = np.concatenate([[0], edge]), np.concatenate([edge, [len(at)]])
                    if p.is_valid:
                        on = np.isin(at[s], p.values.to_numpy())
                        s, e = s[on], e[on]
                    if not len(s):
                        continue
                    text = b" " + w.joined(i) + b" "
                    size = w.we[a : a + len(x)] - w.ws[a : a + len(x)] + 1
                    to = np.concatenate([[0], np.cumsum(size)])  # the space before each word
                    for q, m, u, v in zip(s.tolist(), (e - s + window - 1).tolist(), to[s].tolist(), to[e + window - 1].tolist(), strict=True):
                        body = text[u + 1 : v]
                        for c, y in zip(out, (int(key[at[q]]), up, d, nxt, q, m, hashlib.blake2b(body, digest_size=16).digest(), body), strict=True):
                            c.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _RUN_TYPES, strict=True)], _RUN_NAMES)

    return hits.select("up", "d", "nxt", "text", "places").mapInArrow(run, RUN)


def suffix_order(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes of ``names`` in order, and the length of each one's common prefix with the next. The last item must be like no other.

    Names of doubled prefixes give the order; their halves, from the longest down, give the lengths.
    """
    n = len(names)
    cur, size, steps = names.astype(np.int64), 1, []
    while True:
        steps.append((size, cur))
        if n == 0 or cur.max() == n - 1:  # every prefix of this size is like no other
            break
        nxt = np.zeros(n, np.int64)
        nxt[: n - size] = cur[size:] + 1
        _, cur = np.unique(cur * np.int64(nxt.max() + 1) + nxt, return_inverse=True)
        size *= 2
    order = np.argsort(cur, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, n - 1), np.int64)
    for size, rank in reversed(steps):
        inside = (b < n) & (a < n)
        same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        common[same] += size
        a[same] += size
        b[same] += size
    return order, common


def deep_nodes(common: np.ndarray, least: int) -> np.ndarray:
    """(lo, hi, depth) of each internal node of depth ``least`` or more in the suffix tree, shallow before deep: below it are the suffixes lo to hi - 1 of the order, and their common prefix has ``depth`` words."""
    out: list[tuple[int, int, int]] = []
    held: list[tuple[int, int]] = []  # depth and first suffix of the open intervals, deeper and deeper
    last = -2
    at = np.flatnonzero(common >= least)
    for i, depth in zip(at.tolist(), common[at].tolist(), strict=True):
        if i != last + 1:
            out += [(lo, last + 2, d) for d, lo in held]
            held = []
        lo = i
        while held and held[-1][0] > depth:
            d, lo = held.pop()
            out.append((lo, i + 1, d))
        if not held or held[-1][0] < depth:
            held.append((depth, lo))
        last = i
    out += [(lo, last + 2, d) for d, lo in held]
    nodes = np.array(out, np.int64).reshape(-1, 3)
    return nodes[np.argsort(nodes[:, 2], kind="stable")]


def maximal(nodes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The nodes that are maximal repeats: what stands before their suffixes (``before``, in order) is not the same everywhere."""
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    return nodes[change[nodes[:, 1] - 1] > change[nodes[:, 0]]]


class Tree:
    """The generalised suffix tree of some bodies, each closed by a name of its own, and the maximal repeats in it of ``least`` words or more."""

    def __init__(self, bodies: pa.Array, least: int):
        w = Words(bodies)
        _, names = np.unique(w.hashes(), return_inverse=True)
        self.words, m = w, len(w.n)
        text = np.zeros(len(names) + m, np.int64)
        text[np.arange(len(names)) + np.repeat(np.arange(m), w.n)] = names
        text[w.ptr[1:] + np.arange(m)] = len(names) + np.arange(m)
        _, text = np.unique(text, return_inverse=True)
        leaf = np.repeat(np.arange(m), w.n + 1)
        off = np.arange(len(text)) - np.repeat(w.ptr[:-1] + np.arange(m), w.n + 1)
        order, common = suffix_order(text)
        before = np.where(off == 0, -1 - leaf, np.concatenate([[0], text[:-1]]))  # what is before a body is unknown, so like nothing else
        self.leaf, self.off = leaf[order], off[order]  # of the suffixes in order
        self.repeats = maximal(deep_nodes(common, least), before[order])


def repeats(bodies: pa.Array, d: np.ndarray, nxt: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, start, end, rest) of the parts of bodies that a smaller document has too: smaller than the leaf's first one (rest 0) or than its next one (rest 1).

    Each suffix below a maximal repeat whose smallest document is smaller than
    its own is covered as far as the repeat is deep; the deepest such repeat
    counts. A body that several documents have is a repeat too, the tree's leaf.
    A repeat that isn't maximal goes on to the left in all its places, so a
    longer one covers it there.
    """
    none = np.zeros(0, int)
    if not len(bodies) or not len(Words(bodies).ws):
        return none, none, none, none
    t = Tree(bodies, window)
    depth = np.zeros((2, len(t.leaf)), np.int64)
    own = np.stack([d[t.leaf], nxt[t.leaf]])
    for lo, hi, deep in t.repeats.tolist():  # from the shallow to the deep
        part = own[:, lo:hi]
        np.putmask(depth[:, lo:hi], own[0, lo:hi].min() < part, deep)
    # The node of a whole body has all its documents below it, and nothing is deeper.
    size = t.words.n[t.leaf]
    np.putmask(depth[1], (t.off == 0) & (size >= window) & (own[0] < own[1]), size)
    rest, at = np.nonzero(depth)
    leaf, off, end = t.leaf[at], t.off[at], t.off[at] + depth[rest, at]
    sort = np.lexsort((off, rest, leaf))
    return leaf[sort], off[sort], end[sort], rest[sort]


_SPANS = "digest binary, a array<int>, b array<int>, rest_a array<int>, rest_b array<int>"


def _trees(leaves: DataFrame, window: int) -> DataFrame:
    """digest and word spans that go, for the leaf's first document (a, b) and for the others (rest_a, rest_b); groups meet whole in one task each."""

    def spans(t: pa.Table) -> pa.RecordBatch:
        d, nxt = t.column(2).to_numpy(), t.column(3).to_numpy()
        leaf, off, end, rest = repeats(t.column(4).combine_chunks(), d, nxt, window)
        # Spans of one leaf that touch become one: ends are made to rise, leaf after leaf.
        far = int(end.max(initial=0)) + 1
        part = np.cumsum(np.concatenate([[0], (leaf[1:] != leaf[:-1]) | (rest[1:] != rest[:-1])])) if len(leaf) else leaf
        reach = np.maximum.accumulate(end + part * far) - part * far
        new = np.ones(len(leaf), bool)
        new[1:] = (part[1:] != part[:-1]) | (off[1:] > reach[:-1])
        s = np.flatnonzero(new)
        e = np.concatenate([s[1:], [len(leaf)]])[: len(s)] - 1
        a, b, which, kind = off[s], reach[e], leaf[s], rest[s]
        some = np.unique(which)
        cols = []
        for k in (0, 1):
            on = kind == k
            n = np.bincount(np.searchsorted(some, which[on]), minlength=len(some))
            ptr = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            cols += [pa.ListArray.from_arrays(ptr, pa.array(v[on].astype(np.int32))) for v in (a, b)]
        return pa.RecordBatch.from_arrays([t.column(1).combine_chunks().take(pa.array(some)), *cols], ["digest", "a", "b", "rest_a", "rest_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "body"):
                held.append(part)
                size += part.nbytes // 8
                if size < BATCH_WORDS:
                    continue
                t = pa.Table.from_batches(held)
                seed = t.column(0).to_numpy()
                cut = int(np.searchsorted(seed, seed[-1]))  # the last group may go on
                if cut:
                    yield spans(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(b.nbytes for b in held) // 8
        if held:
            yield spans(pa.Table.from_batches(held))

    return leaves.select("seed", "digest", "d", "nxt", "body").repartition("seed").sortWithinPartitions("seed").mapInArrow(run, _SPANS)


def _kept(rows: DataFrame) -> DataFrame:
    """up and the digest of the words that no span covers, from (up, text, spans of (a, b))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1))
                sha = []
                for i in range(len(w.n)):
                    mark = np.zeros(int(w.n[i]) + 1, np.int64)
                    np.add.at(mark, part.column(2)[i].values.field(0).to_numpy(), 1)
                    np.add.at(mark, part.column(2)[i].values.field(1).to_numpy(), -1)
                    sha.append(hashlib.sha256(w.joined(i, np.cumsum(mark[:-1]) == 0)).digest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sha, pa.binary())], ["up", "kept"])

    return rows.select("up", "text", "spans").mapInArrow(run, "up binary, kept binary")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _answers(runs: DataFrame, found: DataFrame) -> DataFrame:
    """up, and the spans that go of its first document (a, b) and of the others (rest_a, rest_b), from runs and their leaves' answers.

    found: digest, lo and count besides the spans. A run whose document isn't
    the leaf's first one goes as the leaf's others do.
    """
    members = lookup(runs.select("digest", "up", "d", "nxt", "start"), found, "digest", "count", F.struct("up", "start"), "inner")
    first = F.col("d") == F.col("lo")
    at = lambda c: F.transform(c, lambda x: x + F.col("start"))
    own = F.arrays_zip(at(F.when(first, F.col("a")).otherwise(F.col("rest_a"))).alias("a"), at(F.when(first, F.col("b")).otherwise(F.col("rest_b"))).alias("b"))
    rest = F.when(F.col("nxt") > F.col("d"), F.arrays_zip(at(F.col("rest_a")).alias("a"), at(F.col("rest_b")).alias("b"))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    per = members.select("up", own.alias("own"), rest.alias("rest")).groupBy("up").agg(F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("rest")).alias("rest"))
    return per.select(F.col("up").alias("digest"), F.col("own.a").alias("a"), F.col("own.b").alias("b"), F.col("rest.a").alias("rest_a"), F.col("rest.b").alias("rest_b"))


def _resolved(runs: DataFrame, window: int, seeds: tuple[int, ...], group: int, level: int) -> DataFrame:
    """digest (of ``up``) and spans that go, for runs of one level: through trees where groups fit, through longer prefixes where they don't."""
    # One row a leaf: where its body is, its smallest and largest document, its size.
    leaf = runs.groupBy("digest").agg(F.min(F.struct("d", "up", "start")).alias("at"), F.max(F.greatest("d", "nxt")).alias("nxt"), F.count("*").alias("count"), F.first("seed").alias("seed"), F.first("n").alias("n"))
    leaf = written(leaf.select("digest", "at", F.col("at.d").alias("lo"), "nxt", "count", "seed", "n"), f"leaves-{level}")
    groups = leaf.groupBy("seed").agg(F.min("lo").alias("least"), F.max("nxt").alias("most"), F.sum("n").alias("words"), F.count("*").alias("leaves")).where("least < most").drop("least", "most")
    leaf = written(lookup(leaf, written(groups, f"groups-{level}"), "seed", "leaves", F.col("digest"), "inner").drop("leaves"), f"shared-{level}")
    small = leaf.where(F.col("words") <= group) if seeds else leaf
    body = runs.select(F.struct("d", "up", "start").alias("at"), "digest", "body")
    # A body is in one place of a leaf, so its rows are spread by the leaf's digest.
    bodies = lambda x: body.join(x.select("digest", "at", "lo", F.col("nxt").alias("nxt"), "seed"), ["digest", "at"]).dropDuplicates(["digest"])
    found = _trees(bodies(small).withColumnRenamed("lo", "d"), window)
    if seeds and not (large := leaf.where(F.col("words") > group)).isEmpty():
        split = bodies(large).select(F.col("digest").alias("up"), F.col("lo").alias("d"), "nxt", F.col("body").cast("string").alias("text"), F.lit(None).cast("array<int>").alias("places"))
        longer = written(_runs(split, window, seeds[0]), f"runs-{level + 1}")
        found = found.unionByName(_resolved(longer, window, seeds[1:], group, level + 1))
    found = written(found, f"found-{level}")
    told = written(found.join(leaf.select("digest", "lo", "count"), "digest"), f"told-{level}")
    return _answers(runs, told)


def covers(docs: DataFrame, window: int = WINDOW, seeds: tuple[int, ...] = SEEDS, group: int = GROUP_WORDS) -> tuple[DataFrame, DataFrame]:
    """heads: d, tag, n, sha of each row; and classes: sha, d and tag of the first row, n, count, spans that go of the first document and of the others."""
    texts = _texts(docs)
    scan = written(_scan(texts, window, seeds[0]), "scan")
    heads = scan.where("seed is null").select("d", "tag", "n", "sha")
    same = heads.groupBy("sha").agg(F.min(F.struct("d", "tag")).alias("at"), F.max("d").alias("nxt"), F.count("*").alias("count"), F.first("n").alias("n"))
    same = written(same.select("sha", "at.d", "at.tag", "nxt", "count", "n"), "classes")
    at = scan.where("seed is not null").select("seed", "d", "tag", F.col("n").alias("at"))
    shared = written(at.groupBy("seed").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("count")).where("lo < hi").select("seed", "count"), "shared")
    hits = lookup(at, shared, "seed", "count", F.struct("d", "tag", "at"), "inner")
    per = hits.groupBy("d", "tag").agg(F.collect_set("at").alias("places"))
    per = written(per.join(same.select("d", "tag", "nxt", F.col("sha").alias("up")), ["d", "tag"]), "hits")
    # Repeated rows have one text: one of them is enough.
    picked = texts.join(per, ["d", "tag"]).dropDuplicates(["d", "tag"])
    runs = written(_runs(picked, window, seeds[0]), "runs-0")
    spans = _resolved(runs, window, (*seeds[1:], window), group, 0).withColumnRenamed("digest", "sha")
    return scan.where("seed is null").select("d", "n", "sha"), same.join(spans, "sha", "left")


def _length(a: str, b: str):
    """Words that the spans of two arrays cover."""
    spans = F.array_sort(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    add = lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["total"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("total"))
    return F.coalesce(F.aggregate(spans, zero, add, lambda acc: acc["total"]), F.lit(0)).cast("long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seeds: tuple[int, ...] = SEEDS, group: int = GROUP_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document."""
    with scratch(docs.sparkSession) as s:
        heads, classes = covers(docs, window, seeds, group)
        cut = classes.withColumn("first_n", _length("a", "b")).withColumn("rest_n", _length("rest_a", "rest_b"))
        cut = written(cut, "cut")
        # A text is needed again where a part of it stays; of copies all windows go, so nothing of them or everything stays.
        part = cut.where((F.col("first_n") > 0) & (F.col("first_n") < F.col("n"))).select("d", "tag", F.col("sha").alias("up"), F.arrays_zip("a", "b").alias("spans"))
        texts = _texts(docs).join(part, ["d", "tag"]).dropDuplicates(["d", "tag"])
        kept = _kept(texts)
        done = cut.join(kept.withColumnRenamed("up", "sha"), "sha", "left").select("sha", F.col("d").alias("first"), "count", "first_n", "rest_n", "kept")
        out = lookup(heads, written(done, "done"), "sha", "count", F.col("d"))
        gone = F.when(F.col("d") == F.col("first"), F.col("first_n")).otherwise(F.col("rest_n"))
        left = F.when(gone == 0, F.col("sha")).when(gone == F.col("n"), F.lit(bytearray(_EMPTY))).otherwise(F.col("kept"))
        return s.final(out.select(F.nullif("d", F.lit(LAST)).alias("doc_id"), F.col("n").cast("long").alias("n_words"), gone.alias("n_removed"), F.lower(F.hex(left)).alias("kept_sha256")), "repeats")

ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS k FROM w, LATERAL (SELECT unnest(range(1, len(words) - {WINDOW - 2})) AS i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM s) WHERE lo < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM r),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(words, ' ') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
LEFT JOIN (SELECT v.doc_id, string_agg(v.word, ' ' ORDER BY v.p) AS kept
           FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) v
           ANTI JOIN c ON v.doc_id = c.doc_id AND v.p = c.p GROUP BY v.doc_id) k ON w.doc_id = k.doc_id
"""
