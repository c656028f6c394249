"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constant parts
are folded, and each node becomes a Python closure. The language knows only the
names it is given, string literals, integers, comparisons, ``and or not``, ``~``
to join strings and a fixed set of filters; there are no attributes of Python
objects, no calls and no assignment.

    {{ expression }}   {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% generation %}..{% endgeneration %}

A template renders one turn (``role``, ``text``, ``index``, ``first``); a
conversation's output is its turns' outputs in a row. So turns render where they
are read, whatever the length of a conversation, and only the reader takes them
in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CHAT = (
    "{{ '" + START + "' ~ (role | name) ~ '\\n' }}"
    "{% if role == 'assistant' %}{% generation %}{{ text | escape }}{% endgeneration %}{% else %}{{ text | escape }}{% endif %}"
    "{{ '" + END + "' ~ '\\n' }}"
)


def escape(text: str) -> str:
    """Put a backslash between ``<`` and ``|``, one more where some stand there already; no control string survives."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def name(role: str) -> str:
    """A role on one line: escaped like texts, line feeds and backslashes spelled out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unname(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "name": name, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template isn't of this language."""


# The syntax tree: expressions have ``value`` where they are constant.
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition or None, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass
class Out:
    """What a rendering appends to; ``spans`` are the generated parts, as offsets in code points."""

    parts: list = field(default_factory=list)
    size: int = 0
    spans: list = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<word>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>~|()]))")
_OPS: dict[str, Callable] = {
    "~": lambda *x: "".join(map(str, x)),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "not": lambda a: not a,
    "and": lambda *x: all(x),
    "or": lambda *x: any(x),
}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def fold(node):
    """An expression whose parts are constant becomes a constant."""
    if isinstance(node, Filter) and isinstance(node.of, Const):
        return Const(FILTERS[node.name](str(node.of.value)))
    if isinstance(node, Op):
        if all(isinstance(a, Const) for a in node.args):
            return Const(_OPS[node.op](*(a.value for a in node.args)))
        if node.op == "~":
            joined: list = []
            for a in node.args:
                if joined and isinstance(a, Const) and isinstance(joined[-1], Const):
                    joined[-1] = Const(str(joined[-1].value) + str(a.value))
                else:
                    joined.append(a)
            return Op("~", tuple(joined))
    return node


#: A string literal of a tag.
_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


class Parser:
    """Recursive descent over the pieces of a template."""

    def __init__(self, source: str, names: frozenset[str]):
        self.names = names
        # A tag ends at its closing sign outside of string literals; one that never ends runs to the template's end.
        self.pieces = [p for p in re.split(rf"(\{{\{{(?:{_QUOTED}|(?!\}}\}}).)*\}}\}}|\{{%(?:{_QUOTED}|(?!%\}}).)*%\}})", source, flags=re.S) if p]
        self.at = 0

    def parse(self) -> tuple:
        body, ended = self.body(())
        if ended is not None:
            raise TemplateError(f"unexpected {ended}")
        return body

    def body(self, until: tuple[str, ...]) -> tuple[tuple, str | None]:
        nodes: list = []
        while self.at < len(self.pieces):
            piece = self.pieces[self.at]
            self.at += 1
            if piece.startswith("{{"):
                nodes.append(Output(self.expression(piece[2:-2])))
            elif piece.startswith("{%"):
                said = piece[2:-2].strip()
                word = said.split(None, 1)[0] if said else ""
                if word in until:
                    return self.merged(nodes), said
                if word == "if":
                    nodes.append(self.branches(said[2:]))
                elif said == "generation":
                    inner, ended = self.body(("endgeneration",))
                    if ended is None:
                        raise TemplateError("generation without end")
                    nodes.append(Generation(inner))
                else:
                    raise TemplateError(f"unknown statement {said!r}")
            else:
                nodes.append(Output(Const(piece)))
        if until:
            raise TemplateError(f"{until[-1]} is missing")
        return self.merged(nodes), None

    def branches(self, condition: str):
        found, test = [], self.expression(condition)
        while True:
            inner, ended = self.body(("elif", "else", "endif"))
            found.append((test, inner))
            if ended == "endif":
                break
            if test is None:
                raise TemplateError("a branch after else")
            test = self.expression(ended[4:]) if ended.startswith("elif") else None
        # Branches that can't be reached go; one that always holds ends the list.
        kept = []
        for test, inner in found:
            if isinstance(test, Const) and not test.value:
                continue
            kept.append((None if isinstance(test, Const) else test, inner))
            if kept[-1][0] is None:
                break
        return If(tuple(kept))

    @staticmethod
    def merged(nodes: list) -> tuple:
        """Neighbouring constant outputs become one."""
        out: list = []
        for n in nodes:
            if isinstance(n, Output) and isinstance(n.of, Const) and out and isinstance(out[-1], Output) and isinstance(out[-1].of, Const):
                out[-1] = Output(Const(str(out[-1].of.value) + str(n.of.value)))
            else:
                out.append(n)
        return tuple(out)

    def expression(self, source: str):
        tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens = tokens
        node = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return node

    def next_is(self, *signs: str) -> str | None:
        if self.tokens and self.tokens[0][0] in ("sign", "word") and self.tokens[0][1] in signs:
            return self.tokens.pop(0)[1]
        return None

    def chain(self, sign: str, part: Callable):
        args = [part()]
        while self.next_is(sign):
            args.append(part())
        return args[0] if len(args) == 1 else fold(Op(sign, tuple(args)))

    def either(self):
        return self.chain("or", lambda: self.chain("and", self.negation))

    def negation(self):
        return fold(Op("not", (self.negation(),))) if self.next_is("not") else self.comparison()

    def comparison(self):
        left = self.chain("~", self.filtered)
        sign = self.next_is("==", "!=", "<=", ">=", "<", ">")
        return fold(Op(sign, (left, self.chain("~", self.filtered)))) if sign else left

    def filtered(self):
        node = self.atom()
        while self.next_is("|"):
            if not self.tokens or self.tokens[0][1] not in FILTERS:
                raise TemplateError("unknown filter")
            node = fold(Filter(node, self.tokens.pop(0)[1]))
        return node

    def atom(self):
        if not self.tokens:
            raise TemplateError("an expression ends early")
        kind, value = self.tokens.pop(0)
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if value == "(":
            node = self.either()
            if not self.next_is(")"):
                raise TemplateError("a bracket isn't closed")
            return node
        if kind == "word" and value in ("true", "false"):
            return Const(value == "true")
        if kind == "word" and value in self.names:
            return Name(value)
        raise TemplateError(f"unknown name {value!r}")


def evaluator(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env[n]
    if isinstance(node, Filter):
        return lambda env, f=FILTERS[node.name], of=evaluator(node.of): f(str(of(env)))
    return lambda env, f=_OPS[node.op], args=tuple(map(evaluator, node.args)): f(*(a(env) for a in args))


def renderer(nodes: tuple) -> Callable[[dict, Out], None]:
    """The closure of a body."""
    steps = [_step(n) for n in nodes]

    def run(env: dict, out: Out) -> None:
        for s in steps:
            s(env, out)

    return run


def _step(node) -> Callable[[dict, Out], None]:
    if isinstance(node, Output):
        value = evaluator(node.of)
        return lambda env, out: out.put(str(value(env)))
    if isinstance(node, If):
        branches = [(evaluator(t) if t is not None else None, renderer(b)) for t, b in node.branches]

        def choose(env: dict, out: Out) -> None:
            for test, body in branches:
                if test is None or test(env):
                    body(env, out)
                    return

        return choose
    body = renderer(node.body)

    def marked(env: dict, out: Out) -> None:
        first = out.size
        body(env, out)
        out.spans.append((first, out.size))

    return marked


NAMES = frozenset({"role", "text", "index", "first"})


def compiled(source: str) -> Callable[[dict], tuple[str, list]]:
    """A function from a turn's names to its output and generated spans."""
    run = renderer(Parser(source, NAMES).parse())

    def render(env: dict) -> tuple[str, list]:
        out = Out()
        run(env, out)
        return "".join(out.parts), out.spans

    return render


def format_turns(conversations: DataFrame, template: str = CHAT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, output, spans`` for every row; a conversation's output is its rows' outputs by turn.

    ``spans`` are the generated parts as offsets in ``output``. Null role and
    text count as empty, null turns come first; rows of one turn are ordered by
    role and text, so ties have one order. ``index`` is the turn's number.
    Null ids are one conversation. Other columns don't matter.
    """
    compiled(template)  # Mistakes show on the driver.
    rows = conversations.select(
        conversations[conv_col].alias("conv_id"),
        conversations[turn_col].alias("turn"),
        F.coalesce(conversations[role_col], F.lit("")).alias("role"),
        F.coalesce(conversations[text_col], F.lit("")).alias("text"),
    )

    def run(batches):
        render = compiled(template)
        for batch in batches:
            made = [
                render({"role": r.as_py(), "text": t.as_py(), "index": n.as_py() or 0, "first": not n.as_py()})
                for n, r, t in zip(batch.column(1), batch.column(2), batch.column(3), strict=True)
            ]
            spans = pa.array([[{"first": a, "last": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), spans], names=["conv_id", "turn", "output", "spans"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, output string, spans array<struct<first:int,last:int>>")


class Reading:
    """What has been read of one conversation's output; it holds no text beyond a turn's."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def read(self, output: str, spans: list[dict]) -> None:
        self.chars += len(output)
        for m in re.finditer(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", output, re.S):
            self.turns += 1
            self.hash.update(f"{unname(m[1])}\n{unescape(m[2])}\n".encode())
        for s in spans:
            text = unescape(output[s["first"] : s["last"]])
            self.loss_chars += len(text)
            self.loss_hash.update(text.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted turns again, conversation by conversation.

    Returns ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``. Turns are sorted by Spark and stream past: memory doesn't
    grow with a conversation. A digest over a whole conversation must see it in
    order, so a conversation is read by one task; all else was done before.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    # Outputs of a turn's ties differ where the turns do.
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "output")

    def run(batches) -> Iterator[pa.RecordBatch]:
        now: Reading | None = None
        for batch in batches:
            conv_type, done = batch.schema.field(0).type, []
            for conv, output, spans in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                c = conv.as_py()
                if now is None or now.conv != c:
                    if now is not None:
                        done.append(now.row())
                    now = Reading(c)
                now.read(output.as_py(), spans.as_py())
            if done:
                yield batch_of(done, conv_type)
        if now is not None:
            yield batch_of([now.row()], conv_type)

    def batch_of(rows: list[tuple], conv_type) -> pa.RecordBatch:
        kinds = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
