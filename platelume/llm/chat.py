"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded (neighbouring literals, filters and operators of literals, branches
whose condition is a literal), and Python closures are generated from the tree. The language is sandboxed: a template sees
only the names it is given, fields and items of mappings and sequences, the filters of FILTERS, the tests of TESTS and the operators
of _Parser; it has no calls, no attributes of objects and no imports.
  {{ expr }}   {% set x = expr %}   {% for m in messages %}..{% endfor %}   {% if a %}..{% elif b %}..{% else %}..{% endif %}
  {% generation %}..{% endgeneration %}   marks what a loss covers      {# comment #}
  A - inside a tag's brackets ({{- -}} {%- -%}) takes away the white space on its side. In a loop, loop.first, loop.last, loop.index and
  loop.index0 are known. What is set in a loop ends with its turn.
A rendered template is a stream of (text, under the loss mask?), so that a conversation of any length passes
through a task a turn at a time: rows are sorted by conversation and turn and never gathered. messages is a stream too: it can be looped over
once, whole or from an item on (messages[1:]), and items can be looked at ahead of the loop (messages[0].role), as far as they are named.

Defined cases: null text and null role are empty; a conversation's rows go by turn (null turns first), then role, then
text; repeated rows are turns of their own; rows with a null conv_id are one conversation; conv_id and turn may be of any type that sorts; empty texts and
empty tables work; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

Piece = tuple[str, bool]

# ---- escaping ------------------------------------------------------------------------------


def escape(text: str) -> str:
    """Control strings begin with < and end with >; a text's own and its backslashes are written so that neither is left."""
    return text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "g": ">"}.get(m[1], m[1]), text, flags=re.S)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "lower": lambda x: _text(x).lower(),
    "upper": lambda x: _text(x).upper(),
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else 0,
    "default": lambda x, other="": other if x is None else x,
    "join": lambda x, between="": _text(between).join(map(_text, x or ())),
}
TESTS: dict[str, Callable[[object], bool]] = {
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "mapping": lambda x: isinstance(x, dict),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "true": lambda x: x is True,
    "false": lambda x: x is False,
}

#: Each turn is <turn role>text</turn> and a line end; an assistant's text and nothing else is under the loss mask.
TEMPLATE = (
    "{% for m in messages %}{{ '<turn ' }}{{ m.role | escape }}{{ '>' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '</turn>' + '\\n' }}{% endfor %}"
)

# ---- parsing -------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-|+~.()\[\]:,=<>%]))", re.S)
_END = {kind: re.compile(rf"\s*(-?){end}") for kind, end in (("{{", r"\}\}"), ("{%", r"%\}"))}
Token = tuple[str, str]


class TemplateError(ValueError):
    pass


def lex(source: str) -> Iterator[tuple[str, str | list[Token]]]:
    """("text", s), ("{{", tokens) and ("{%", tokens) in order; a tag ends outside its strings."""
    at, strip = 0, False
    while at < len(source):
        m = re.compile(r"\{[{%#]").search(source, at)
        text, end = source[at : m.start() if m else len(source)], m.end() if m else len(source)
        text = text.lstrip() if strip else text
        if m and source[end : end + 1] == "-" and m[0] != "{#":
            text, end = text.rstrip(), end + 1
        if text:
            yield "text", text
        at, strip = end, False
        if not m:
            return
        if m[0] == "{#":
            at = source.find("#}", at) + 2
            if at < 2:
                raise TemplateError("a comment is not ended")
            continue
        tokens: list[Token] = []
        while not (over := _END[m[0]].match(source, at)):
            t = _TOKEN.match(source, at)
            if not t:
                raise TemplateError(f"not understood: {source[at : at + 40].strip()!r}" if source[at:].strip() else f"{m[0]} is not ended")
            tokens.append((t.lastgroup, t[t.lastgroup]))
            at = t.end()
        at, strip = over.end(), bool(over[1])
        yield m[0], tokens


class _Parser:
    """Expressions: or, and, not, comparisons, in, is, + - ~, | filter, .field, [item], [from:to], names, numbers, strings, parentheses."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return value if kind in ("op", "name") else None

    def take(self, value: str | None = None) -> Token:
        if self.at >= len(self.tokens) or value and (self.tokens[self.at][1] != value or self.tokens[self.at][0] == "str"):
            raise TemplateError(f"{value or 'a value'} is missing")
        self.at += 1
        return self.tokens[self.at - 1]

    def may(self, *values: str) -> str | None:
        """The next token, taken, if it is one of these."""
        if (found := self.peek()) in values:
            self.at += 1
            return found
        return None

    def name(self) -> str:
        kind, value = self.take()
        if kind != "name":
            raise TemplateError(f"not a name: {value!r}")
        return value

    def end(self) -> None:
        if self.at != len(self.tokens):
            raise TemplateError(f"too much: {self.tokens[self.at][1]!r}")

    def whole(self) -> tuple:
        tree = self.either()
        self.end()
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.may("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.may("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        if self.may("not"):
            return ("not", self.negated())
        tree = self.sum()
        while True:
            if op := self.may("==", "!=", "<", "<=", ">", ">=", "in"):
                tree = (op, tree, self.sum())
            elif self.may("not"):
                self.take("in")
                tree = ("not", ("in", tree, self.sum()))
            elif self.may("is"):
                no, test = self.may("not"), self.name()
                if test == "defined":
                    found = ("defined", tree)
                elif test in TESTS:
                    found = ("test", test, tree)
                else:
                    raise TemplateError(f"no test {test!r}; there are defined, {', '.join(sorted(TESTS))}")
                tree = ("not", found) if no else found
            else:
                return tree

    def sum(self) -> tuple:
        tree = self.filtered()
        while op := self.may("+", "-", "~", "%"):
            tree = (op, tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.item()
        while self.may("|"):
            name, more = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}; there are {', '.join(sorted(FILTERS))}")
            if name in ("default", "join") and self.may("("):
                more.append(self.either())
                self.take(")")
            tree = ("filter", name, tree, *more)
        return tree

    def item(self) -> tuple:
        tree = self.atom()
        while op := self.may(".", "["):
            if op == ".":
                tree = ("item", tree, ("lit", self.name()))
                continue
            first = None if self.peek() == ":" else self.either()
            if self.may(":"):
                last = None if self.peek() == "]" else self.either()
                tree = ("slice", tree, first or ("lit", None), last or ("lit", None))
            else:
                tree = ("item", tree, first)
            self.take("]")
        return tree

    def atom(self) -> tuple:
        kind, value = self.take()
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("lit", int(value))
        if value == "-":
            return ("-", ("lit", 0), self.item())
        if value == "(":
            tree = self.either()
            self.take(")")
            return tree
        if kind != "name" or value in ("and", "or", "not", "in", "is"):
            raise TemplateError(f"not a value: {value!r}")
        return ("lit", {"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else ("name", value)


def parse(source: str) -> list[tuple]:
    """The template's syntax tree: ("text", s), ("out", expr), ("set", name, expr), ("for", name, expr, body), ("if", [(expr, body)]), ("generation", body)."""
    root: list[tuple] = []
    stack: list[tuple[str, list]] = [("", root)]

    def close(kind: str) -> None:
        if stack[-1][0] != kind:
            raise TemplateError(f"end{kind} does not fit {stack[-1][0] or 'the start'}")
        stack.pop()

    def open_(kind: str, node: Callable[[list], tuple]) -> None:
        body: list = []
        stack[-1][1].append(node(body))
        stack.append((kind, body))

    for kind, value in lex(source):
        if kind == "text":
            stack[-1][1].append(("text", value))
            continue
        p = _Parser(value)
        if kind == "{{":
            stack[-1][1].append(("out", p.whole()))
            continue
        word = p.name() if value else ""
        if word == "for":
            name = p.name()
            p.take("in")
            values = p.whole()
            open_("for", lambda body: ("for", name, values, body))  # noqa: B023
        elif word == "set":
            name = p.name()
            p.take("=")
            stack[-1][1].append(("set", name, p.whole()))
        elif word == "if":
            test = p.whole()
            open_("if", lambda body: ("if", [(test, body)]))  # noqa: B023
        elif word in ("elif", "else"):
            close("if")
            test = p.whole() if word == "elif" else ("lit", True)
            body: list = []
            stack[-1][1][-1][1].append((test, body))
            stack.append(("if", body))
        elif word == "generation":
            open_("generation", lambda body: ("generation", body))
        elif word in ("endfor", "endif", "endgeneration"):
            close(word[3:])
        else:
            raise TemplateError(f"no tag {word!r}")
        if word not in ("for", "set", "if", "elif"):
            p.end()
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return root


# ---- folding -------------------------------------------------------------------------------


def fold_expr(e: tuple) -> tuple:
    """e with each part worked out that depends on no name."""
    if e[0] in ("lit", "name"):
        return e
    parts = [fold_expr(x) if isinstance(x, tuple) else x for x in e[1:]]
    folded = (e[0], *parts)
    if all(x[0] == "lit" for x in parts if isinstance(x, tuple)):
        return ("lit", expression(folded)({}))
    return folded


def fold(nodes: list[tuple]) -> list[tuple]:
    """Literals become text, neighbouring texts one, and decided branches their body."""
    flat: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and flat and flat[-1][0] == "text":
            flat[-1] = ("text", flat[-1][1] + node[1])
        elif node != ("text", ""):
            flat.append(node)

    for node in nodes:
        if node[0] == "out":
            e = fold_expr(node[1])
            add(("text", _text(e[1])) if e[0] == "lit" else ("out", e))
        elif node[0] == "set":
            add(("set", node[1], fold_expr(node[2])))
        elif node[0] == "for":
            add(("for", node[1], fold_expr(node[2]), fold(node[3])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        elif node[0] == "if":
            left = []
            for e, body in node[1]:
                e = fold_expr(e)
                if e[0] == "lit" and not e[1]:
                    continue
                left.append((e, fold(body)))
                if e[0] == "lit":
                    break
            if left and left[0][0][0] == "lit":
                for x in left[0][1]:
                    add(x)
            elif left:
                add(("if", left))
        else:
            add(node)
    return flat


# ---- generation of closures ----------------------------------------------------------------


class Stream:
    """Messages that come one after the other: looped over once, and looked at ahead of that by their place."""

    def __init__(self, items: Iterable):
        self.items, self.ahead, self.begun = iter(items), [], False

    def __iter__(self) -> Iterator:
        if self.begun:
            raise TemplateError("messages are a stream: one loop over them, or a part of them, is all there can be")
        self.begun = True
        while self.ahead:
            yield self.ahead.pop(0)
        yield from self.items

    def at(self, i: int):
        if self.begun or i < 0:
            raise TemplateError("messages are a stream: an item is known by its place from the start, before the loop over them")
        self.ahead += islice(self.items, max(0, i + 1 - len(self.ahead)))
        return self.ahead[i] if i < len(self.ahead) else None


def _text(x) -> str:
    return "" if x is None else str(x)


def _item(x, key):
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, Stream) and isinstance(key, int):
        return x.at(key)
    if isinstance(x, (list, tuple, str)) and isinstance(key, int) and -len(x) <= key < len(x):
        return x[key]
    return None


def _slice(x, first, last):
    if isinstance(x, Stream):
        if (first or 0) < 0 or (last or 0) < 0:
            raise TemplateError("messages are a stream: a part of them is counted from the start")
        return islice(x, first, last)
    return x[first:last] if isinstance(x, (list, tuple, str)) else None


def _plus(a, b):
    return a + b if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)) else _text(a) + _text(b)


def _number(x) -> float:
    return x if isinstance(x, (int, float)) else 0


def _less(a, b) -> bool:
    return a < b if type(a) is type(b) and isinstance(a, (int, float, str)) else _number(a) < _number(b)


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _less,
    ">": lambda a, b: _less(b, a),
    "<=": lambda a, b: not _less(b, a),
    ">=": lambda a, b: not _less(a, b),
    "in": lambda a, b: a in b if isinstance(b, (list, tuple, dict)) else isinstance(b, str) and _text(a) in b,
    "+": _plus,
    "-": lambda a, b: _number(a) - _number(b),
    "%": lambda a, b: _number(a) % _number(b) if _number(b) else 0,
    "~": lambda a, b: _text(a) + _text(b),
    "item": _item,
}


def expression(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "lit":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "defined":
        if e[1][0] == "name":
            return lambda env, n=e[1][1]: n in env
        inner = expression(e[1])
        return lambda env: inner(env) is not None
    if kind == "filter":
        inner, f, more = expression(e[2]), FILTERS[e[1]], [expression(x) for x in e[3:]]
        return lambda env: f(inner(env), *[m(env) for m in more])
    if kind == "test":
        inner, test = expression(e[2]), TESTS[e[1]]
        return lambda env: test(inner(env))
    if kind == "not":
        inner = expression(e[1])
        return lambda env: not inner(env)
    if kind == "slice":
        x, first, last = map(expression, e[1:])
        return lambda env: _slice(x(env), first(env), last(env))
    a, b = expression(e[1]), expression(e[2])
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "and":
        return lambda env: a(env) and b(env)
    return lambda env, f=_BINARY[kind]: f(a(env), b(env))


def statements(nodes: list[tuple], masked: bool = False) -> Callable[[dict], Iterator[Piece]]:
    made = [_statement(n, masked) for n in nodes]

    def run(env: dict) -> Iterator[Piece]:
        for m in made:
            yield from m(env)

    return made[0] if len(made) == 1 else run


def _statement(node: tuple, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = ((node[1], masked),)
        return lambda env: iter(piece)
    if kind == "out":
        value = expression(node[1])
        return lambda env: iter(((_text(value(env)), masked),))
    if kind == "set":
        name, value = node[1], expression(node[2])

        def put(env: dict) -> Iterator[Piece]:
            env[name] = value(env)
            return iter(())

        return put
    if kind == "generation":
        return statements(node[1], True)
    if kind == "if":
        branches = [(expression(e), statements(body, masked)) for e, body in node[1]]

        def choose(env: dict) -> Iterator[Piece]:
            for test, body in branches:
                if test(env):
                    yield from body(env)
                    return

        return choose
    name, values, body = node[1], expression(node[2]), statements(node[3], masked)

    def loop(env: dict) -> Iterator[Piece]:
        rest = iter(values(env) or ())
        over = object()
        value, n = next(rest, over), 0
        while value is not over:
            after = next(rest, over)
            yield from body({**env, name: value, "loop": {"first": n == 0, "last": after is over, "index": n + 1, "index0": n}})
            value, n = after, n + 1

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """source -> a function from names to the stream of pieces. Messages may be any iterable, read once and lazily."""
    run = statements(fold(parse(source)))
    return lambda names: run({k: v if isinstance(v, (str, int, float, dict, list, tuple, bool, type(None))) else Stream(v) for k, v in names.items()})


# ---- over tables ---------------------------------------------------------------------------


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows, each with the type of its first column."""
    for batch in batches:
        for a in range(0, len(batch), 1000):
            part = batch.slice(a, 1000)
            yield from zip(*(part.column(i).to_pylist() for i in range(4)), repeat(part.schema.field(0).type, len(part)), strict=True)


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """rows (conv_id, turn, role, text) -> (conv_id, seq, piece, masked): the formatted conversation in pieces, a piece a row.

    Joined in order of seq, a conversation's pieces are its formatted text.
    """
    compile_template(template)  # a faulty template fails here
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        turns = _turns(batches)
        ahead = next(turns, None)
        out: list[tuple] = []
        while ahead is not None:
            conv, kind = ahead[0], ahead[-1]

            def messages() -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and _same(ahead[0], conv):
                    _, turn, role, text, _ = ahead
                    yield {"turn": turn, "role": role or "", "text": text or ""}
                    ahead = next(turns, None)

            own = messages()
            for seq, (piece, masked) in enumerate(render({"messages": own})):
                out.append((conv, seq, piece, masked))
                if len(out) >= 2048 or len(piece) > 1 << 16:
                    yield _pieces(out, kind)
                    out = []
            for _ in own:  # what the template left unread
                pass
        if out:
            yield _pieces(out, kind)

    own = rows.select("conv_id", "turn", "role", "text")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    schema = T.StructType([own.schema["conv_id"], T.StructField("seq", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("masked", T.BooleanType())])
    return own.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _same(a, b) -> bool:
    return a == b or a != a and b != b


def _pieces(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["conv_id", "seq", "piece", "masked"])


_OPEN, _CLOSE = "<turn ", "</turn>\n"


class _Reader:
    """Reads TEMPLATE's output back, piece by piece: turns, and what the loss covers."""

    def __init__(self, conv):
        self.conv, self.rest, self.n, self.chars, self.loss_chars = conv, [], 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, piece: str, masked: bool) -> None:
        self.chars += len(piece)
        if masked:
            text = unescape(piece)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.rest.append(piece)
        # control strings stand alone or at a piece's ends, as texts hold no <
        if "</turn>" in piece:
            whole = "".join(self.rest)
            *turns, last = whole.split(_CLOSE)
            for t in turns:
                role, _, text = t.removeprefix(_OPEN).partition(">")
                self.n += 1
                self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            self.rest = [last] if last else []

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame, sort: bool = True) -> DataFrame:
    """format_conversations' rows -> (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    sort=False: pieces come straight from format_conversations, in the order that it made; another order is an error, not a wrong result.
    """
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out, last, kind = None, [], -1, pa.null()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, *kinds], strict=True)], names=["conv_id", *names])

        for conv, seq, piece, masked, kind in _turns(batches):
            if seq == 0:
                if reader:
                    out.append(reader.row())
                reader = _Reader(conv)
            elif not reader or seq != last + 1 or not _same(conv, reader.conv):
                raise ValueError(f"conversation {conv!r}: piece {seq} is out of order; read_back with sort=True puts pieces in order")
            last = seq
            reader.take(piece, masked)
            if len(out) >= 2048:
                yield batch()
                out = []
        if reader:
            out.append(reader.row())
        if out:
            yield batch()

    own = pieces.select("conv_id", "seq", "piece", "masked")
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "seq") if sort else own
    schema = T.StructType([own.schema["conv_id"], *[T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in zip(names, kinds, strict=True)]])
    return own.mapInArrow(run, schema)
