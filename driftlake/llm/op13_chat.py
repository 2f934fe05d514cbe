"""Chat formatting by compiled templates.

A template is text with ``{{ expression }}`` and ``{% statement %}`` marks (a
dash inside a mark trims the white space beside it). ``parse`` makes a tree of
it, ``fold`` evaluates what is constant (expressions, branches, neighbouring
texts), and ``Template`` turns the tree into nested Python closures that write
a conversation's text and note what stands between ``{% generation %}`` and
``{% endgeneration %}``: the loss mask, as spans of code points.

Statements: if/elif/else/endif, for x in list/endfor (with loop.index, loop.first,
loop.last), set x = e, generation/endgeneration. Expressions are Python's own
grammar with a list of permitted nodes: literals, names, keys of dicts (with a
dot or brackets), comparisons, and/or/not, +, a if c else b, and filters after
``|``. Nothing else can be reached: no calls, attributes of objects, globals or
dunder names; a render writes at most ``limit`` parts and PER_ITEM more for each
item of the lists that it is given, so that a long conversation is no fault but
loops inside loops are; + makes nothing over MOST long.

``format_chats`` renders each conversation where its turns have been gathered:
a conversation is one text, so one value, and must fit into a task like any
text. ``read_back`` is its inverse for the template CHAT.

Defined cases: null texts and roles are empty; a conversation's rows go by
turn, null turns last, ties by role and text; repeated rows are turns like
others; rows without conv_id are one conversation; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the format.
BEGIN, END, STOP = "[INST]", "[/INST]", "</s>"
CONTROL = (BEGIN, END, "<s>", STOP)
#: Turns of other roles name their role; the reply's text alone is learnt.
CHAT = """
{%- for m in messages -%}
{%- if m.role == 'assistant' -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}{{ stop }}
{%- else -%}
{{ begin + ' ' }}{{ m.role | line }}{{ '\\n' }}{{ m.text | escape }}{{ ' ' + end }}
{%- endif -%}
{%- endfor -%}
"""
_GUARDED = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\(.)", re.S)
_LINE = re.compile(r"(?:[^\\\n]|\\.)*", re.S)  # up to the first newline without a backslash
Span = tuple[int, int]
#: Characters or items that + may put together.
MOST = 1 << 28
#: Parts that a template may write for each item of a list.
PER_ITEM = 64
#: Characters of formatted texts that go on together.
PIECE = 1 << 25


def escape(s: str) -> str:
    """A backslash before each backslash and inside each control string, so that none is left."""
    return _GUARDED.sub(lambda m: m[0][0] + "\\" + m[0][1:] if len(m[0]) > 1 else "\\\\", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


FILTERS: dict[str, Callable[..., Any]] = {
    "escape": lambda s: escape(str(s)), "line": lambda s: escape(str(s)).replace("\n", "\\\n"), "trim": lambda s: str(s).strip(), "upper": lambda s: str(s).upper(), "lower": lambda s: str(s).lower(), "length": len,
    "default": lambda s, other="": other if s is None else s, "join": lambda s, by="": by.join(map(str, s)), "string": str,
}


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- syntax tree


@dataclass
class Text:
    text: str


@dataclass
class Put:
    value: ast.expr


@dataclass
class Set:
    name: str
    value: ast.expr


@dataclass
class If:
    branches: list[tuple[ast.expr | None, list[Any]]]  # None: else


@dataclass
class For:
    name: str
    items: ast.expr
    body: list[Any] = field(default_factory=list)


@dataclass
class Generation:
    body: list[Any] = field(default_factory=list)


_MARK = re.compile(r"\{(\{|%)(-?)(.*?)(-?)(?:\}\}|%\})", re.S)
_PERMITTED = (
    ast.Constant, ast.Name, ast.Attribute, ast.Subscript, ast.Compare, ast.BoolOp, ast.UnaryOp, ast.BinOp, ast.IfExp, ast.List, ast.Load, ast.And, ast.Or, ast.Not, ast.USub, ast.Add, ast.BitOr,
    ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn, ast.Is, ast.IsNot,
)


def expression(source: str) -> ast.expr:
    """The tree of an expression, refused if it holds anything but permitted nodes."""
    try:
        e = ast.parse(source.strip(), mode="eval").body
    except (SyntaxError, RecursionError, MemoryError) as x:
        raise TemplateError(f"bad expression {source!r}") from x
    _checked(e)
    return e


def _checked(e: ast.AST) -> None:
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.BitOr):  # value | filter, or value | filter(arguments)
        call = e.right
        name = call.func if isinstance(call, ast.Call) else call
        if not isinstance(name, ast.Name) or name.id not in FILTERS or isinstance(call, ast.Call) and call.keywords:
            raise TemplateError("after | comes the name of a filter")
        for x in [e.left, *(call.args if isinstance(call, ast.Call) else [])]:
            _checked(x)
        return
    if not isinstance(e, _PERMITTED) or isinstance(e, ast.Attribute) and e.attr.startswith("_"):
        raise TemplateError(f"{type(e).__name__} is not permitted")
    for x in ast.iter_child_nodes(e):
        _checked(x)


def parse(source: str) -> list[Any]:
    root: list[Any] = []
    open_: list[tuple[str, list[Any], Any]] = [("", root, None)]
    at, trim = 0, False
    for m in _MARK.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        text = text.rstrip() if m[2] else text
        if text:
            open_[-1][1].append(Text(text))
        at, trim = m.end(), bool(m[4])
        if m[1] == "{":
            open_[-1][1].append(Put(expression(m[3])))
        else:
            _statement(m[3].strip(), open_)
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} is not closed")
    rest = source[at:].lstrip() if trim else source[at:]
    return root + [Text(rest)] if rest else root


def _statement(said: str, open_: list[tuple[str, list[Any], Any]]) -> None:
    word, _, rest = said.partition(" ")
    kind, body, node = open_[-1]
    if word == "if":
        new = If([(expression(rest), [])])
        body.append(new)
        open_.append(("if", new.branches[0][1], new))
    elif word in ("elif", "else") and kind == "if" and node.branches[-1][0] is not None:
        node.branches.append((expression(rest) if word == "elif" else None, []))
        open_[-1] = ("if", node.branches[-1][1], node)
    elif word == "for" and (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)):
        new = For(m[1], expression(m[2]))
        body.append(new)
        open_.append(("for", new.body, new))
    elif word == "set" and (m := re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)(.+)", rest, re.S)):
        body.append(Set(m[1], expression(m[2])))
    elif word == "generation":
        if any(k == "generation" for k, _, _ in open_):
            raise TemplateError("generation inside generation")
        new = Generation()
        body.append(new)
        open_.append(("generation", new.body, new))
    elif word == f"end{kind}" and kind:
        open_.pop()
    else:
        raise TemplateError(f"unexpected {said!r}")


# ---------------------------------------------------------------- folding


_NAMES = {"true": True, "false": False, "none": None}


def _constant(e: ast.expr, known: dict[str, Any]) -> bool:
    """Whether e depends on nothing but literals and known names."""
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.BitOr):
        return all(_constant(x, known) for x in [e.left, *(e.right.args if isinstance(e.right, ast.Call) else [])])
    if isinstance(e, ast.Name):
        return e.id in known
    return all(_constant(x, known) for x in ast.iter_child_nodes(e) if isinstance(x, ast.expr))


class _Fold(ast.NodeTransformer):
    """Puts values where an expression has constant parts; a part that fails is left to fail when it is rendered."""

    def __init__(self, known: dict[str, Any]):
        self.known = known

    def visit(self, node: ast.AST) -> ast.AST:
        if not isinstance(node, ast.expr):
            return node
        if _constant(node, self.known):
            try:
                v = closure(node)(dict(self.known))
            except (TypeError, ValueError):
                return node
            return ast.Constant(v) if v is None or isinstance(v, (str, int, float)) else node
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):  # the filter's name is no value
            right = ast.Call(node.right.func, [self.visit(a) for a in node.right.args], []) if isinstance(node.right, ast.Call) else node.right
            return ast.BinOp(self.visit(node.left), node.op, right)
        return self.generic_visit(node)


def fold(tree: list[Any], known: dict[str, Any], bound: frozenset[str] | None = None) -> list[Any]:
    """The tree with constants evaluated: one text where there were texts and constant values, and only branches that can be taken."""
    bound = bound if bound is not None else frozenset(_bound(tree))
    fixed = {k: v for k, v in (_NAMES | known).items() if k not in bound}  # a name that the template binds is no constant
    out: list[Any] = []

    def add(node: Any) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not isinstance(node, Text) or node.text:
            out.append(node)

    for node in tree:
        if isinstance(node, Put):
            value = _Fold(fixed).visit(node.value)
            add(Text(_shown(value.value)) if isinstance(value, ast.Constant) else Put(value))
        elif isinstance(node, If):
            left: list[tuple[ast.expr | None, list[Any]]] = []
            for test, body in node.branches:
                test = test if test is None else _Fold(fixed).visit(test)
                if isinstance(test, ast.Constant):
                    if not test.value:
                        continue
                    test = None
                left.append((test, fold(body, known, bound)))
                if test is None:
                    break
            if left and left[0][0] is None:
                for x in left[0][1]:
                    add(x)
            elif left:
                add(If(left))
        elif isinstance(node, For):
            add(For(node.name, _Fold(fixed).visit(node.items), fold(node.body, known, bound)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body, known, bound)))
        else:
            add(node)
    return out


def _bound(tree: list[Any]) -> Iterator[str]:
    for node in tree:
        if isinstance(node, (For, Set)):
            yield node.name
            yield "loop"
        for body in [b for _, b in node.branches] if isinstance(node, If) else [node.body] if isinstance(node, (For, Generation)) else []:
            yield from _bound(body)


# ---------------------------------------------------------------- closures


def _shown(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


_COMPARE: dict[type, Callable[[Any, Any], bool]] = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: lambda a, b: a is b, ast.IsNot: lambda a, b: a is not b,
}
Env = dict[str, Any]


def _get(box: Any, key: Any) -> Any:
    if isinstance(box, dict):
        return box.get(key)
    if isinstance(box, (list, str)) and isinstance(key, int):
        return box[key] if -len(box) <= key < len(box) else None
    return None


def closure(e: ast.expr) -> Callable[[Env], Any]:
    """A function of the names' values that gives the value of e."""
    if isinstance(e, ast.Constant):
        return lambda env, v=e.value: v
    if isinstance(e, ast.Name):
        return lambda env, k=e.id: env.get(k)
    if isinstance(e, (ast.Attribute, ast.Subscript)):
        box = closure(e.value)
        key = closure(ast.Constant(e.attr) if isinstance(e, ast.Attribute) else e.slice)
        return lambda env: _get(box(env), key(env))
    if isinstance(e, ast.List):
        parts = [closure(x) for x in e.elts]
        return lambda env: [p(env) for p in parts]
    if isinstance(e, ast.UnaryOp):
        v = closure(e.operand)
        return (lambda env: not v(env)) if isinstance(e.op, ast.Not) else lambda env: -v(env)
    if isinstance(e, ast.BoolOp):
        parts, until = [closure(x) for x in e.values], isinstance(e.op, ast.Or)

        def both(env: Env) -> Any:
            for p in parts:
                v = p(env)
                if bool(v) is until:
                    break
            return v

        return both
    if isinstance(e, ast.IfExp):
        test, a, b = closure(e.test), closure(e.body), closure(e.orelse)
        return lambda env: a(env) if test(env) else b(env)
    if isinstance(e, ast.Compare):
        parts, ops = [closure(x) for x in (e.left, *e.comparators)], [_COMPARE[type(o)] for o in e.ops]

        def compared(env: Env) -> bool:
            v = [p(env) for p in parts]
            return all(f(a, b) for f, a, b in zip(ops, v, v[1:]))

        return compared
    assert isinstance(e, ast.BinOp)
    left = closure(e.left)
    if isinstance(e.op, ast.Add):
        right = closure(e.right)

        def plus(env: Env) -> Any:
            v = left(env) + right(env)
            if isinstance(v, (str, list)) and len(v) > MOST:
                raise TemplateError("a value is longer than the sandbox permits")
            return v

        return plus
    call = e.right
    f = FILTERS[(call.func if isinstance(call, ast.Call) else call).id]
    args = [closure(x) for x in call.args] if isinstance(call, ast.Call) else []
    return lambda env: f(left(env), *[a(env) for a in args])


class Writer:
    def __init__(self, limit: int):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[Span] = []
        self.limit = limit

    def put(self, s: str) -> None:
        self.limit -= 1
        if self.limit < 0:
            raise TemplateError("the template writes more parts than its limit")
        self.parts.append(s)
        self.length += len(s)


Step = Callable[[Env, Writer], None]


def _steps(tree: list[Any]) -> Step:
    steps = [_step(x) for x in tree]
    if len(steps) == 1:
        return steps[0]

    def run(env: Env, out: Writer) -> None:
        for s in steps:
            s(env, out)

    return run


def _step(node: Any) -> Step:
    if isinstance(node, Text):
        return lambda env, out, t=node.text: out.put(t)
    if isinstance(node, Put):
        v = closure(node.value)
        return lambda env, out: out.put(_shown(v(env)))
    if isinstance(node, Set):
        v = closure(node.value)
        return lambda env, out, k=node.name: env.__setitem__(k, v(env))
    if isinstance(node, If):
        tests = [(closure(t) if t is not None else lambda env: True, _steps(b)) for t, b in node.branches]

        def choose(env: Env, out: Writer) -> None:
            for t, body in tests:
                if t(env):
                    body(env, out)
                    return

        return choose
    body = _steps(node.body)
    if isinstance(node, Generation):

        def learnt(env: Env, out: Writer) -> None:
            a = out.length
            body(env, out)
            out.spans.append((a, out.length))

        return learnt
    items = closure(node.items)

    def loop(env: Env, out: Writer) -> None:
        every = items(env)
        if not isinstance(every, list):
            raise TemplateError("for goes over lists only")
        n = len(every)
        for i, x in enumerate(every):
            out.put("")  # a turn of a loop counts against the limit even if it writes nothing
            body(env | {node.name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n}}, out)

    return loop


class Template:
    """A template compiled once; ``constants`` are names whose values are known when it is compiled."""

    def __init__(self, source: str, limit: int = 10_000_000, **constants: Any):
        self.source, self.limit, self.constants = source, limit, constants
        self.tree = fold(parse(source), constants)
        self._run = _steps(self.tree)

    def __reduce__(self):  # closures are made again where they run
        return _again, (self.source, self.limit, self.constants)

    def render(self, **names: Any) -> tuple[str, list[Span]]:
        """The text, and the spans of code points under the loss mask."""
        out = Writer(self.limit + PER_ITEM * sum(len(v) for v in names.values() if isinstance(v, list)))
        self._run(_NAMES | self.constants | names, out)
        return "".join(out.parts), out.spans


def _again(source: str, limit: int, constants: dict[str, Any]) -> Template:
    return Template(source, limit, **constants)


def chat() -> Template:
    return Template(CHAT, begin=BEGIN, end=END, stop=STOP)


# ---------------------------------------------------------------- conversations


def gathered(rows: DataFrame) -> DataFrame:
    """conv_id, roles, texts of each conversation, in order of turns."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    g = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return g.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))


def format_chats(rows: DataFrame, template: Template | None = None, piece: int = PIECE) -> DataFrame:
    """conv_id, text, spans (start, end of each learnt part) of each conversation of rows (conv_id, turn, role, text)."""
    t = template or chat()
    kind = rows.schema["conv_id"].dataType.simpleString()

    mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, at, held = [], [], 0, 0
            for i, (roles, said) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text, learnt = t.render(messages=[{"role": r, "text": x} for r, x in zip(roles, said, strict=True)])
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in learnt])
                held += len(text)
                if held >= piece or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(texts, pa.string()), pa.array(spans, mask)], ["conv_id", "text", "spans"])
                    texts, spans, at, held = [], [], i + 1, 0

    return gathered(rows).mapInArrow(run, f"conv_id {kind}, text string, spans array<struct<start: long, end: long>>")


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that CHAT formatted."""
    out, at = [], 0
    while at < len(text):
        if text.startswith(BEGIN, at):
            m = _LINE.match(text, at + len(BEGIN) + 1)
            b = text.index(" " + END, m.end() + 1)
            role, said, at = m[0], text[m.end() + 1 : b], b + 1 + len(END)
        else:
            b = text.index(STOP, at)
            role, said, at = "assistant", text[at:b], b + len(STOP)
        out.append((unescape(role), unescape(said)))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from formatted texts and spans."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts are made of control strings.
TRAP = [(-7, 0, "user", f"{STOP}{BEGIN} ok {END}"), (-7, 1, "assistant", f"{STOP}{BEGIN} ok {END}")]


def with_trap(rows: DataFrame) -> DataFrame:
    own = rows.select("conv_id", "turn", "role", "text")
    return own.unionByName(rows.sparkSession.createDataFrame(TRAP, "conv_id long, turn long, role string, text string"))


def _oracle() -> str:
    plus = "len({c}) - len(replace({c}, '\\', '')) + " + " + ".join(f"(len({{c}}) - len(replace({{c}}, '{x}', ''))) // {len(x)}" for x in CONTROL)
    added = lambda c: f"len({c}) + " + plus.format(c=c)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{STOP}{BEGIN} ok {END}'), (-7, 1, 'assistant', '{STOP}{BEGIN} ok {END}'))),
t AS (SELECT *, CASE WHEN role = 'assistant' THEN {added('text')} + {len(STOP)} ELSE {added('text')} + {added('role')} + len(role) - len(replace(role, chr(10), '')) + {len(BEGIN) + 1 + 1 + 1 + len(END)} END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""


ORACLE = _oracle()
