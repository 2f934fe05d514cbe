"""Personal data: base patterns, and a skip-chain conditional random field over what they leave open.

The base patterns give sure spans. Words with a digit or an at-sign that no
base span covers are the open nodes of a conditional random field (a word
with neither can't hold any of the kinds, so its label is O whatever its
neighbours say: leaving it out is exact). Neighbouring nodes share a
transition potential; nodes whose normalised form, or last seven digits, or
mailbox are the same share a skip potential, however far apart. Loopy
sum-product passing, with base spans clamped to their kind, gives beliefs; a
node is added as a span if a kind that its form allows has BELIEF or more.

Node, transition and skip weights are learnt together, by gradient ascent on
the likelihood with the same message passing, from at most MAX_DOCS documents
(the least by md5 of doc_id among those with a digit or at-sign; rows without
doc_id are left out, of rows with one doc_id the text least by md5 is taken)
of MAX_NODES nodes each. Base spans are the labels; open nodes that share a key
with one are left out, since the patterns don't tell what they are. So that the field learns
what the patterns can't say, each document also gets degraded mentions
(DEGRADED): the value of one of its own base spans without its plus sign, dots
or domain, labelled with its kind; and the same of values that stand nowhere
else in it, labelled O.

Defined cases: null text is empty text, without spans; an empty table gives
no rows; spans are code points, end exclusive; equal doc_ids give one row
each; extra columns are ignored. Texts are read whole. Only ASCII digits
count as digits.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

KINDS = ("email", "ip", "card", "phone")
#: Documents, and nodes of each, that the field is fitted on; scoring has no such bounds.
MAX_DOCS, MAX_NODES = 2000, 64
BELIEF = 0.95
#: Degraded mentions of a document's own values, and of values that stand nowhere else, added to each document in fitting.
DEGRADED = 3
# The base patterns. An e-mail address is matched from its at-sign and an ip from the start of its digits, which gives the same spans in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_PARTS = re.compile(r"[.-]")
_NODE = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>"
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octet(p: str) -> bool:
    """Whether p, of digits, is at most 255 (however many leading zeros it has)."""
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def emails(t: str) -> list[Span]:
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        a = at
        while a > end and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            end = m.end()
            out.append((a, end))
        at = t.find("@", max(at + 1, end))
    return out


def base(t: str) -> dict[str, list[Span]]:
    """Spans of each kind: leftmost, not overlapping within the kind, failing ones dropped."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in t:
        out["email"] = emails(t)
    if _DIGITS.search(t):
        out["ip"] = [m.span() for m in _IP.finditer(t) if all(map(octet, m.group().split(".")))] if "." in t else []
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 16:
                d = "".join(_DIGITS.findall(m.group()))
                if 16 <= len(d) <= 19 and luhn(d):
                    out["card"].append(m.span())
        if "+" in t:
            out["phone"] = [m.span() for m in _PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


@dataclass
class Node:
    start: int
    end: int
    place: int  # the word's place in the text
    text: str
    label: int  # 1 + kind of an overlapping base span, or 0
    span: Span | None = None  # that span


def nodes(t: str, spans: dict[str, list[Span]]) -> list[Node]:
    """Words with a digit or at-sign, without punctuation at the ends; number-like neighbours make one node."""
    found = sorted((a, b, k) for k, name in enumerate(KINDS, 1) for a, b in spans[name])
    reach = list(itertools.accumulate((f[1] for f in found), max))  # spans before ``at`` end before the word
    out: list[Node] = []
    at, start, end, numeric = 0, 0, 0, False  # of the open run: where it starts and ends, and whether it holds no letter or at-sign

    def close() -> None:
        if out:
            out[-1].start, out[-1].end, out[-1].text = start, end, t[start:end]

    for place, m in enumerate(_NODE.finditer(t)):
        w = m.group()
        if "@" not in w and not _DIGITS.search(w):
            continue
        left = len(w) - len(w.lstrip(_EDGE))
        a, b = m.start() + left, m.start() + len(w.rstrip(_EDGE))
        if a < b:
            while at < len(found) and reach[at] <= a:
                at += 1
            k, label, span = at, 0, None
            while k < len(found) and found[k][0] < b and not label:
                if a < found[k][1]:
                    span, label = found[k][:2], found[k][2]
                k += 1
            plain = not any(c.isalpha() or c == "@" for c in w)
            near = out and out[-1].place == place - 1 and out[-1].span == span
            if near and (label or numeric and plain):
                end, numeric, out[-1].place = b, numeric and plain, place
            else:
                close()
                start, end, numeric = a, b, plain
                out.append(Node(a, b, place, "", label, span))
    close()
    return out


def allowed(s: str) -> np.ndarray:
    """Which labels the form of a node allows."""
    d = "".join(_DIGITS.findall(s))
    alpha = any(c.isalpha() for c in s)
    four = [p for p in _PARTS.split(s)]
    ip = len(four) == 4 and all(_DIGITS.fullmatch(p) and octet(p) for p in four)
    return np.array([True, "@" in s[1:-1], ip, not alpha and 16 <= len(d) <= 19 and luhn(d), not alpha and 8 <= len(d) <= 15 and not (ip and "." in s)])


def form(s: str) -> np.ndarray:
    n = max(1, len(s))
    d = sum(map(len, _DIGITS.findall(s)))
    a = sum(c.isalpha() for c in s)
    return np.array([1.0, "@" in s, d / n, a / n, min(n, 40) / 20, min(d, 20) / 10, 16 <= d <= 19, 8 <= d <= 15, s.startswith("+"), s.count(".") == 3, min(s.count("."), 9) / 3, min(s.count("-"), 9) / 3, "(" in s, "=" in s or '"' in s, s.isupper(), d == n, *allowed(s)[1:]], float)


def keys(s: str) -> list[str]:
    """Nodes that share one of these are alike."""
    flat = "".join(c for c in s.lower() if c.isalnum())
    d = "".join(_DIGITS.findall(s))
    out = ["=" + flat]
    if len(d) >= 7 and not any(c.isalpha() for c in s):
        out.append("#" + d[-7:])
    if "@" in s:
        out.append("@" + s.split("@")[0].lower())
    return out


def edges(places: list[int], names: list[list[str]]) -> list[tuple[int, int, int]]:
    """(a, b, kind) of neighbours (kind 0) and of nodes with a key in common (kind 1; each with the last one before it)."""
    out = [(i - 1, i, 0) for i in range(1, len(places)) if places[i] - places[i - 1] <= 1]
    last: dict[str, int] = {}
    for i, ks in enumerate(names):
        out += sorted({(last[k], i, 1) for k in ks if k in last and last[k] != i})
        last.update(dict.fromkeys(ks, i))
    return out


def _norm(m: np.ndarray) -> np.ndarray:
    return m - np.logaddexp.reduce(m, axis=-1, keepdims=True) if m.ndim == 1 else m - np.logaddexp.reduce(m, axis=-1)[..., None]


class Messages:
    """Loopy sum-product on one graph (or on many, side by side); messages are kept from call to call."""

    def __init__(self, n: int, graph: list[tuple[int, int, int]]):
        g = np.array(graph, int).reshape(-1, 3)
        self.n, (self.a, self.b, self.kind) = n, g.T
        self.fore, self.aft = np.zeros((len(g), 5)), np.zeros((len(g), 5))  # log messages a->b and b->a

    def total(self, unary: np.ndarray) -> np.ndarray:
        s = unary.copy()
        np.add.at(s, self.b, self.fore)
        np.add.at(s, self.a, self.aft)
        return s

    def run(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs of nodes and of edges."""
        a, b = self.a, self.b
        psi = np.where(self.kind[:, None, None] == 0, chain, skip)
        for _ in range(rounds if len(a) else 0):
            s = self.total(unary)
            new_f = _norm(np.logaddexp.reduce((s[a] - self.aft)[:, :, None] + psi, axis=1))
            new_a = _norm(np.logaddexp.reduce((s[b] - self.fore)[:, None, :] + psi, axis=2))
            moved = max(np.abs(new_f - self.fore).max(), np.abs(new_a - self.aft).max())
            self.fore, self.aft = 0.5 * self.fore + 0.5 * new_f, 0.5 * self.aft + 0.5 * new_a
            if moved < 1e-4:
                break
        s = self.total(unary)
        pair = (s[a] - self.aft)[:, :, None] + (s[b] - self.fore)[:, None, :] + psi
        pair = np.exp(_norm(pair.reshape(-1, 25))).reshape(-1, 5, 5) if len(a) else np.zeros((0, 5, 5))
        return np.exp(_norm(s)), pair


def unaries(x: np.ndarray, weight: np.ndarray, may: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Node potentials: -30 for labels that the form rules out; ``sure`` (label or 0) clamps."""
    u = np.where(may, x @ weight, -30.0)
    on = np.flatnonzero(sure)
    u[on] = -30.0
    u[on, sure[on]] = 0.0
    return u


@dataclass
class Field:
    weight: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray

    def beliefs(self, ns: list[Node], rounds: int = 40) -> np.ndarray:
        x, may = np.array([form(n.text) for n in ns]), np.array([allowed(n.text) for n in ns])
        graph = edges([n.place for n in ns], [keys(n.text) for n in ns])
        return Messages(len(ns), graph).run(unaries(x, self.weight, may, np.array([n.label for n in ns])), self.chain, self.skip, rounds)[0]

    def added(self, t: str, spans: dict[str, list[Span]]) -> dict[str, list[Span]]:
        ns = nodes(t, spans)
        out: dict[str, list[Span]] = {k: [] for k in KINDS}
        if all(x.label or not allowed(x.text)[1:].any() for x in ns):
            return out
        p = self.beliefs(ns)
        for x, q in zip(ns, p, strict=True):
            k = int(q.argmax())
            if not x.label and k and q[k] >= BELIEF:
                out[KINDS[k - 1]].append((x.start, x.end))
        return out


Sample = tuple[str, int, bool, int]  # text, label, is it clamped, place


def degraded(s: str, kind: int, rng: random.Random) -> str:
    """A mention of the value of a base span that no base pattern of its kind matches."""
    d = _DIGITS.findall(s)
    flat = "".join(d)
    if kind == 1:
        at, _, host = s.partition("@")
        return f"{at}@{host.split('.')[0]}"
    if kind == 2:
        return "-".join(d)
    if kind == 3:
        return ".".join(flat[i : i + 4] for i in range(0, len(flat), 4))
    flat = flat[-10:] if len(flat) > 10 and rng.random() < 0.5 else flat
    return rng.choice([flat, flat[:-7] + "-" + flat[-7:-4] + "-" + flat[-4:], flat[:-4] + "." + flat[-4:]])


def stranger(s: str, rng: random.Random) -> str:
    """A value of the same form that stands nowhere else."""
    return "".join(rng.choice("0123456789") if c in "0123456789" else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in s)


def samples(t: str) -> list[Sample]:
    """The nodes of a text, MAX_NODES at most (the least by a hash), with degraded mentions after them."""
    ns = nodes(t, base(t))
    if len(ns) > MAX_NODES:
        ns = sorted(sorted(ns, key=lambda n: hashlib.md5(f"{n.text}/{n.place}".encode("utf-8", "surrogatepass")).digest())[:MAX_NODES], key=lambda n: n.place)
    known = {k for n in ns if n.label for k in keys(n.text)}
    ns = [n for n in ns if n.label or known.isdisjoint(keys(n.text))]  # what an open node like a sure one is, the patterns don't tell
    out: list[Sample] = [(n.text, n.label, n.label > 0, n.place) for n in ns]
    rng = random.Random(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest())
    own = [n for n in ns if n.label and n.span]
    place = (ns[-1].place if ns else 0) + 2
    for n in rng.sample(own, min(DEGRADED, len(own))):
        value = t[slice(*n.span)]
        other = degraded(stranger(value, rng), n.label, rng)
        more = [(degraded(value, n.label, rng), n.label), (other, 0), *[(other, 0)] * (rng.random() < 0.5)]
        rng.shuffle(more)
        for s, y in more:
            out.append((s, y if allowed(s)[y] else 0, False, place))
            place += rng.choice([1, 2, 2])
    return out


def learn(docs: list[list[Sample]], steps: int = 250, rate: float = 0.2, decay: float = 1e-5) -> Field:
    """Node, transition and skip weights together: Adam on the penalised likelihood of the open nodes' labels given the clamped ones."""
    n_f = len(form("0"))
    p = {"weight": np.zeros((n_f, 5)), "chain": np.zeros((5, 5)), "skip": np.zeros((5, 5))}
    flat = [n for doc in docs for n in doc]
    if flat:
        graph, at = [], 0
        for doc in docs:
            graph += [(a + at, b + at, k) for a, b, k in edges([n[3] for n in doc], [keys(n[0]) for n in doc])]
            at += len(doc)
        x, may, y = np.array([form(n[0]) for n in flat]), np.array([allowed(n[0]) for n in flat]), np.array([n[1] for n in flat])
        sure, hot, m = np.where([n[2] for n in flat], y, 0), np.eye(5)[y], Messages(len(flat), graph)
        seen, kinds = np.zeros((len(m.a), 5, 5)), [m.kind == 0, m.kind == 1]
        seen[np.arange(len(m.a)), y[m.a], y[m.b]] = 1.0
        is_open = max(1, int((sure == 0).sum()))
        g1, g2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            q, pair = m.run(unaries(x, p["weight"], may, sure), p["chain"], p["skip"], 6)
            off = np.where((sure == 0)[:, None], hot - q, 0.0)
            e = seen - pair
            both = e[kinds[1]].sum(0)
            grad = {"weight": x.T @ off, "chain": e[kinds[0]].sum(0), "skip": (both + both.T) / 2}
            for k in p:
                g = grad[k] / is_open - decay * p[k]
                g1[k] = 0.9 * g1[k] + 0.1 * g
                g2[k] = 0.99 * g2[k] + 0.01 * g * g
                p[k] = p[k] + rate * (g1[k] / (1 - 0.9**step)) / (np.sqrt(g2[k] / (1 - 0.99**step)) + 1e-8)
    return Field(p["weight"], p["chain"], p["skip"])


def fit(docs: DataFrame, most: int = MAX_DOCS) -> Field:
    """Learn from at most ``most`` documents; without any, the field adds nothing."""
    some = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    ids = F.broadcast(some.select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest(), pickle.dumps(samples(t))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["doc_id", "h", "nodes"])

    rows = some.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, h binary, nodes binary")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("h", "nodes")).alias("r")).select("doc_id", "r.nodes").toPandas().sort_values("doc_id")
    return learn([pickle.loads(r) for r in one["nodes"]])


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added), n_added for each document."""
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n: list[list[int]] = [[] for _ in KINDS]
                sha, all_spans, extra = [], [], []
                for t in part.column(1).to_pylist():
                    b = base(t or "")
                    more = model.added(t, b) if t and (_DIGITS.search(t) or "@" in t) else {k: [] for k in KINDS}
                    for i, k in enumerate(KINDS):
                        n[i].append(len(b[k]))
                    sha.append(hashlib.sha256(listed(b).encode()).hexdigest())
                    all_spans.append(listed({k: b[k] + more[k] for k in KINDS}))
                    extra.append(sum(map(len, more.values())))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(sha), pa.array(all_spans), pa.array(extra, pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
