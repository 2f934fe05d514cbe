"""SentencePiece encoding and decoding as weighted finite-state transduction.

``compile_model`` reads a model file and builds the parts: the normaliser (a
transducer whose arcs are the model's character map, followed by the rules for
white space and the dummy prefix), the piece lexicon as arcs from the right,
and byte fallback arcs for characters without a piece. An input is composed
with them lazily: a state is (position, last piece), an arc consumes a piece,
and the weight is in the tropical semiring (min, +). For a byte-pair model the
weight of an arc is 0 if the two pieces may stand side by side (merging their
joined characters by the model's order gives just these two) and infinity if
not. Every prefix of the input has one path of finite weight, so the shortest
path keeps one survivor a position and is the model's own segmentation. For a
unigram model the weight is minus the piece's log probability.

Where no piece joins a character to a following space mark or a line break to
another character (tested while compiling), these begin a new machine: paths
of such units are kept in a bounded table per worker. Otherwise a text is one
unit. User-defined pieces are cut out of the text first, longest first, and
never merge.

Defined cases: null text is empty text, which has no pieces; an empty table
gives no rows; rows are coded one by one, whole, so repeats give equal rows;
an id that names no piece decodes as the unknown piece does; where the
normaliser changes a text, decoding gives the normalised one and
``round_trip`` is false; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import raw, slices

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Units whose paths a worker keeps, the half of them that were met last.
KEPT = 400_000
_UNITS = re.compile("▁*[^▁\n]+|▁+|\n+")
_CROSSES = re.compile("[^▁]▁|\n[^\n]|[^\n]\n")
#: What the unknown piece, and an id that names no piece, decode to.
UNKNOWN = " \u2047 ".encode()
INF = float("inf")


class Normaliser:
    """The character map of a model as a transducer: from each place the longest arc whose label the text goes on with; other characters map to themselves.

    ``table``: four bytes with the size of a double-array trie over UTF-8, the
    trie, and the replacements, each ended by a zero byte.
    """

    def __init__(self, table: bytes = b"", squeeze: bool = False, dummy: bool = True):
        self.squeeze, self.dummy, self.identity = squeeze, dummy, not table and not squeeze
        n = int.from_bytes(table[:4], "little") if table else 0
        self.trie = np.frombuffer(table[4 : 4 + n], "<u4").tolist()
        self.texts = table[4 + n :]

    def step(self, b: bytes, i: int) -> tuple[bytes, int]:
        """What the arc from place i writes, and where it leads."""
        trie, at, best = self.trie, 0, None
        if trie:
            at = (trie[0] >> 10) << ((trie[0] & 512) >> 6)
            for j in range(i, len(b)):
                at ^= b[j]
                unit = trie[at]
                if unit & 0x800000FF != b[j]:
                    break
                at ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    best = j + 1, trie[at] & 0x7FFFFFFF
        if best:
            return self.texts[best[1] : self.texts.index(0, best[1])], best[0]
        n = 1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
        return b[i : i + n], i + n

    def __call__(self, text: str) -> str:
        """The normalised text with its spaces marked, from the dummy prefix on; empty if nothing is left."""
        if self.identity:
            s = text
        else:
            b, i, out = text.encode("utf-8", "surrogatepass"), 0, []
            while i < len(b):
                got, i = self.step(b, i)
                out.append(got)
            s = b"".join(out).decode("utf-8", "replace")
            if self.squeeze:
                s = re.sub(" +", " ", s).strip(" ")
        return (MARK if self.dummy else "") + s.replace(" ", MARK) if s else ""


class Machine:
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool, normaliser: Normaliser | bool = True):
        """kinds as in the model file: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""
        self.normaliser = normaliser if isinstance(normaliser, Normaliser) else Normaliser(dummy=normaliser)
        self.pieces, self.bpe, self.dummy = pieces, bpe, self.normaliser.dummy
        own = sorted((p for i, p in enumerate(pieces) if kinds[i] == 4), key=len, reverse=True)
        self.own = re.compile("(" + "|".join(map(re.escape, own)) + ")") if own else None
        self.own_ids = {p: np.array([i], "<i4").tobytes() for i, p in enumerate(pieces) if kinds[i] == 4}
        self.crosses = any(_CROSSES.search(p) for i, p in enumerate(pieces) if kinds[i] == 1)
        self.id = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
        self.score = {p: scores[i] for p, i in self.id.items()}
        self.byte = [-1] * 256
        for i, k in enumerate(kinds):
            if k == 6:
                self.byte[int(pieces[i][3:5], 16)] = i
        self.unk = kinds.index(2) if 2 in kinds else 0
        self.fallback = all(i >= 0 for i in self.byte)
        self.unk_weight = 0.0 if bpe else 10.0 - min(self.score.values(), default=0.0)  # fixed value: the library's penalty
        self.longest = max(map(len, self.id), default=1)
        self.ends = {}  # last character -> lengths of the pieces that end in it
        for p in self.id:
            self.ends.setdefault(p[-1], set()).add(len(p))
        self.ends = {c: sorted(v, reverse=True) for c, v in self.ends.items()}
        self.beside: dict[str | None, dict[str, float]] = {}
        self.arcs = 0
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kinds[i] == 6 else UNKNOWN if kinds[i] == 2 else b"" if kinds[i] == 3 else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]

    def merged(self, chars: str) -> list[str]:
        """Merge neighbours by score, leftmost first among equals, until no pair is a piece."""
        s = list(chars)
        score = self.score
        while len(s) > 1:
            best, at = -INF, -1
            for i in range(len(s) - 1):
                x = score.get(s[i] + s[i + 1])
                if x is not None and x > best:
                    best, at = x, i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def weight(self, last: str | None, piece: str) -> float:
        """Of the arc for ``piece`` after ``last`` (None: a start or a byte arc); kept in the table of arcs."""
        if not self.bpe:
            x = -self.score[piece]
        elif last is None:
            x = 0.0 if self.merged(piece) == [piece] else INF
        else:
            x = 0.0 if self.weight(None, piece) == 0.0 and self.merged(last + piece) == [last, piece] else INF
        if self.arcs > 1_000_000:
            self.beside.clear()
            self.arcs = 0
        self.arcs += 1
        self.beside.setdefault(last, {})[piece] = x
        return x

    def shortest(self, s: str) -> list[int]:
        """Piece ids on the path of least weight through the machine composed with s."""
        n, bpe = len(s), self.bpe
        dist = [0.0] + [INF] * n
        back: list[str | None] = [None] * (n + 1)
        ids, ends, beside = self.id, self.ends, self.beside
        for j in range(1, n + 1):
            c = s[j - 1]
            best, arc = INF, None
            for k in ends.get(c, ()):
                i = j - k
                if i < 0 or dist[i] >= best:
                    continue
                p = s[i:j]
                if p in ids:
                    last = back[i] if bpe else None  # a unigram arc has one weight after any piece
                    row = beside.get(last)
                    x = None if row is None else row.get(p)
                    x = dist[i] + (self.weight(last, p) if x is None else x)
                    if x < best:
                        best, arc = x, p
                        if bpe:  # no other piece can end the one finite path to j
                            break
            if arc is None and c not in ids:  # no piece has this character: its bytes
                best = dist[j - 1] + self.unk_weight
            dist[j], back[j] = best, arc
        out: list[int] = []
        j = n
        while j > 0:
            p = back[j]
            if p is None:
                if self.fallback:
                    out += [self.byte[b] for b in reversed(s[j - 1].encode("utf-8", "surrogatepass"))]
                elif not (j < n and back[j + 1] is None):  # neighbours without a piece are one unknown piece
                    out.append(self.unk)
                j -= 1
            else:
                out.append(ids[p])
                j -= len(p)
        return out[::-1]

    def joined(self, s: str) -> bytes | None:
        """The path of s from two kept paths that meet at a finite arc: then the whole is the one finite path."""
        heads, tails, beside = self.heads, self.tails, self.beside
        for i in range(len(s) - 1, 1, -1):
            tail = tails.get(s[i:])
            if tail is not None and (head := heads.get(s[:i])) is not None:
                last, first = self.pieces[int.from_bytes(head[-4:], "little")], self.pieces[int.from_bytes(tail[:4], "little")]
                row = beside.get(last)
                x = None if row is None else row.get(first)
                if (self.weight(last, first) if x is None else x) == 0.0:
                    return head + tail
        return None

    def unit(self, s: str) -> bytes:
        ids = self.older.get(s)
        if ids is None:
            if not self.bpe or len(s) > 40:
                return np.array(self.shortest(s), dtype="<i4").tobytes()
            ids = self.joined(s)
        if ids is None:
            path = self.shortest(s)
            ids = np.array(path, dtype="<i4").tobytes()
            if all(i >= 0 and self.pieces[i] in self.id for i in path):  # byte arcs have no piece to meet at
                if len(self.heads) > KEPT // 2:
                    self.heads.clear()
                    self.tails.clear()
                self.heads[s] = ids
                for k in (1, 2, 3):  # parts of the path are the paths of their own texts
                    if len(path) > k:
                        n = sum(len(self.pieces[i]) for i in path[-k:])
                        self.heads[s[:-n]], self.tails[s[-n:]] = ids[: -4 * k], ids[-4 * k :]
        if len(self.table) >= KEPT // 2:  # units of the last round move up again when they are met
            self.older, self.table = self.table, {}
        self.table[s] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        s = self.normaliser(text)
        if self.own is None:
            return self.coded(s)
        return b"".join([self.own_ids[x] if k % 2 else self.coded(x) for k, x in enumerate(self.own.split(s))])

    def coded(self, s: str) -> bytes:
        if not s:
            return b""
        unit = self.unit
        return b"".join([self.table.get(u) or unit(u) for u in ([s] if self.crosses else _UNITS.findall(s))])

    def decode(self, ids) -> str:
        b = self.bytes_of
        s = b"".join([b[i] if 0 <= i < len(b) else UNKNOWN for i in ids]).decode("utf-8", "replace")
        return s[1:] if self.dummy and s.startswith(" ") else s

    def decoded(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of ids, and n+1 offsets, for documents at ids[ptr[i]:ptr[i+1]]; the dummy space is still there."""
        if not hasattr(self, "_flat"):
            self._flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
            self._len = np.array([len(b) for b in self.bytes_of], np.int64)
            self._at = np.cumsum(self._len) - self._len
        n = self._len[ids]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        place = np.arange(total) + np.repeat(self._at[ids] - (end - n), n)
        return self._flat[place], np.concatenate([[0], end])[ptr]


_machines: dict[str, Machine] = {}


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            c = b[at]
            at += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while at < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, b[at : at + n]
        at += n


def compile_model(data: bytes) -> Machine:
    """The machine of a model file's bytes."""
    pieces, scores, kinds, bpe, normaliser = [], [], [], False, Normaliser(squeeze=True)
    for no, v in _fields(data):
        if no == 1:
            f = dict(_fields(v))
            pieces.append(f[1].decode())
            scores.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(f.get(3, 1))
        elif no == 2:
            bpe = dict(_fields(v)).get(3, 1) == 2
        elif no == 3:
            f = dict(_fields(v))
            normaliser = Normaliser(f.get(2, b""), bool(f.get(4, 1)), bool(f.get(3, 1)))
    return Machine(pieces, scores, kinds, bpe, normaliser)


def machine(path: str = MODEL) -> Machine:
    """The compiled model, once a worker; the file comes with the installation, so every executor has it."""
    if path not in _machines:
        with open(path, "rb") as f:
            _machines[path] = compile_model(f.read())
    return _machines[path]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip (decoding gives the text again) for each document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                codes = [m.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                n = np.array([len(c) // 4 for c in codes], np.int64)
                ids = np.frombuffer(b"".join(codes), "<i4")
                ptr = np.concatenate([[0], np.cumsum(n)])
                data, offs = raw(part.column(1))
                back, at = m.decoded(ids, ptr)
                lead = (np.diff(offs) > 0).astype(np.int64) * m.dummy
                same = [back[a + x : b].tobytes() == data[c:d].tobytes() for a, b, x, c, d in zip(at[:-1], at[1:], lead, offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(ids)), pa.array(same)], ["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.decode(i or []) for i in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
