"""Quality rules: statistics of whole texts, and a decision list learnt by sequential covering.

``statistics`` counts over every whole text (vectorised per Arrow batch).
``learn`` grows conjunctions of thresholds for the rejected class on two
thirds of the labelled rows, prunes each on the other third, removes what it
covers and goes on while rules stay precise. ``verdict`` turns the list into
ordered Spark conditional expressions.

Defined cases: null and empty texts have no words, lines or symbols and fail
the base rule; labels that are null, or that name no document, are left out;
a doc_id labelled both ways counts as rejected for neither (left out); without
labels of both kinds the list is empty and keeps everything. Extra columns are
ignored. Equal doc_ids give one row each; learning takes one of them, the one
with the least features, and at most MAX_LABELLED in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import numbered, restored
from ._text import Words, gram_starts, grams, per_doc, range_hashes, slices

#: Labelled rows used for learning, the least in the order of md5(doc_id).
MAX_LABELLED = 20_000
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_digits", "n_marks", "n_lines", "n_distinct", "n_long"]
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!?;:=_~^@\\/{}[]()\"'"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def repeated(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items (hash, doc), doc ascending: is it found twice or more in its doc; has an earlier place of its doc the same."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = np.zeros(len(h), bool)
    if len(h):
        a, d = h[order], doc[order]
        same[1:] = (a[1:] == a[:-1]) & (d[1:] == d[:-1])
    later = np.zeros(len(h), bool)
    later[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    both = np.zeros(len(h), bool)
    both[order] = twice
    return both, later


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    w = Words(column)
    data, offs, doc = w.data, w.offs, w.doc()
    h = w.hashes()
    chars = ((data & 0xC0) != 0x80) & w.inside
    out = {"n_words": w.n, "word_chars": per_doc(chars, offs), "n_symbols": per_doc(SYMBOLS[data], offs)}
    # Lines: ends at \n or at the end of the text; only those with a word count.
    brk = np.flatnonzero(data == 10)
    some = np.flatnonzero(np.diff(offs) > 0)
    ls = np.concatenate([offs[:-1][some], brk + 1])
    order = np.argsort(ls, kind="stable")
    ls = ls[order]
    ldoc = np.concatenate([some, np.searchsorted(offs, brk, side="right") - 1])[order]
    nxt = np.searchsorted(brk, ls)
    le = np.minimum(np.where(nxt < len(brk), np.append(brk, 0)[nxt], len(data)), offs[ldoc + 1]) if len(ls) else ls
    le = np.maximum(le, ls)
    words = np.searchsorted(w.ws, le) - np.searchsorted(w.ws, ls) > 0 if len(ls) else np.zeros(0, bool)
    ls, le, ldoc = ls[words], le[words], ldoc[words]
    _, later = repeated(range_hashes(data, ls, le), ldoc)
    out["n_dup_lines"] = np.bincount(ldoc[later], minlength=len(w.n))
    out["n_lines"] = np.bincount(ldoc, minlength=len(w.n))
    # Windows of five words found twice or more; every word that one covers counts once.
    ok = np.flatnonzero(gram_starts(w.ptr, WINDOW, len(h)))
    twice, _ = repeated(grams(h, WINDOW)[ok], doc[ok])
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, ok[twice], 1)
    np.add.at(cover, ok[twice] + WINDOW, -1)
    out["n_repeat_words"] = per_doc(np.cumsum(cover[:-1]) > 0, w.ptr)
    _, again = repeated(h, doc)
    out["n_distinct"] = w.n - per_doc(again, w.ptr)
    out["n_long"] = per_doc((w.we - w.ws) > 20, w.ptr)
    # Capitals past a word's first byte, also two-byte Latin ones.
    first = np.zeros(len(data) + 1, bool)
    first[w.ws] = True
    latin = np.zeros(len(data), bool)
    if len(data) > 1:
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        latin[1:] &= ~first[:-2]
    out["n_upper"] = per_doc((_UPPER[data] & ~first[:-1]) | latin, offs)
    out["n_digits"] = per_doc(_DIGIT[data], offs)
    out["n_marks"] = per_doc(_MARKS[data], offs)
    return {k: v.astype(np.int64) for k, v in out.items()}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of BASE and MORE for every whole text; one pass, no shuffle."""
    names = BASE + MORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                c = count_texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c[n]) for n in names]], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


# Ratios that rules may test, as (numerator, denominator), or a plain count.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"), "marks_per_word": ("n_marks", "n_words"), "upper_per_char": ("n_upper", "word_chars"), "digits_per_char": ("n_digits", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"), "dup_lines_per_line": ("n_dup_lines", "n_lines"), "repeat_per_word": ("n_repeat_words", "n_words"), "distinct_per_word": ("n_distinct", "n_words"),
    "long_per_word": ("n_long", "n_words"), "words_per_line": ("n_words", "n_lines"), "n_words": ("n_words", None),
}


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") if b is None else F.col(a) / F.greatest(F.col(b), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


Test = tuple[str, bool, float]  # feature, at least (else at most), threshold


def _holds(x: dict[str, np.ndarray], rule: list[Test]) -> np.ndarray:
    return reduce(np.logical_and, [(x[f] >= t) if up else (x[f] <= t) for f, up, t in rule], np.ones(len(next(iter(x.values()))), bool))


def _best(x: dict[str, np.ndarray], y: np.ndarray, base: float) -> tuple[float, Test] | None:
    """The test with the most gain in the sense of information about rejected rows (y true)."""
    best = None
    for f, v in x.items():
        order = np.argsort(v, kind="stable")
        s, cum = v[order], np.cumsum(y[order])
        cut = np.flatnonzero(s[1:] > s[:-1])
        if not len(cut):
            continue
        mid = (s[cut] + s[cut + 1]) / 2
        for up, p, n in ((False, cum[cut], cut + 1), (True, cum[-1] - cum[cut], len(s) - cut - 1)):
            gain = p * (np.log2((p + 0.5) / (n + 1)) - base)
            k = int(np.argmax(gain))
            if p[k] and (best is None or gain[k] > best[0] + 1e-12):
                best = (float(gain[k]), (f, up, float(mid[k])))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, least: float = 0.95, max_tests: int = 4, min_cover: int = 5) -> list[list[Test]]:
    """Rules that reject, in order. ``least``: the precision on the pruning third below which learning ends."""
    rules: list[list[Test]] = []
    n = len(bad)
    third = np.arange(n) % 3 == 2
    live = np.ones(n, bool)
    while (live & bad & ~third).sum() >= min_cover and (live & ~bad).any():
        on = live & ~third
        rule: list[Test] = []
        while len(rule) < max_tests:
            y = bad[on]
            if y.all():
                break
            got = _best({f: v[on] for f, v in x.items()}, y, float(np.log2((y.sum() + 0.5) / (len(y) + 1))))
            if got is None or got[0] <= 0:
                break
            rule.append(got[1])
            on &= _holds(x, rule[-1:])
        if not rule:
            break

        def worth(r: list[Test], at: np.ndarray = third) -> float:
            hit = _holds(x, r) & live & at
            p = (hit & bad).sum()
            return (2 * p - hit.sum()) / max(1, hit.sum())

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = _holds(x, rule) & live
        good = (hit & bad & third).sum(), (hit & third).sum()
        if (hit & bad).sum() < min_cover or good[0] < least * good[1] or (hit & bad).sum() < least * hit.sum():
            break
        rules.append(rule)
        live &= ~hit
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """kept, as ordered conditions: the first rule that holds rejects."""
    out = None
    for rule in rules:
        cond = reduce(lambda a, b: a & b, [(feature(f) >= t) if up else (feature(f) <= t) for f, up, t in rule])
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled(labels: DataFrame, column: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` rows (doc_id, label), the least by md5 of doc_id; labels that disagree are left out."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("_m")).where("label = _m")
    return one.select("doc_id", "label").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[list[Test]]:
    """Learn from labelled documents; their number, and so what reaches the driver, is bounded by ``most``."""
    chosen = labelled(labels, most=most)
    # ``chosen`` has at most ``most`` rows: small enough to broadcast by its bound.
    rows = statistics(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    rows = rows.where(~base_failed()).join(F.broadcast(chosen), "doc_id").select("label", "doc_id", *[feature(f).alias(f) for f in FEATURES])
    # Of rows with one doc_id the one with the least features: no more than ``most`` reach the driver.
    one = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "label", "x.*")
    pdf = one.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most).toPandas()
    if not len(pdf):
        return []
    return learn({f: pdf[f].to_numpy(float) for f in FEATURES}, (pdf["label"] == 0).to_numpy())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for each document."""
    rules = fit(docs, labels)
    s = statistics(docs).withColumn("base_failed", base_failed())
    return s.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns: one pass over docs that carries them through the counting."""
    rules = fit(docs, labels)
    names = BASE + MORE
    at = docs.columns.index("text")
    rows, own = numbered(docs)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, own["text"]):
                c = count_texts(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c[n]) for n in names]], [*part.schema.names, *names])

    return restored(rows.mapInArrow(run, schema).where(~base_failed() & verdict(rules)), own)
