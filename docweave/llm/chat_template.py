"""Chat formatting by a compiler for a sandboxed template language.

A template is lexed and parsed into a syntax tree, constants are folded, and the
tree becomes nested Python closures.  The language has text, ``{{ expression }}``,
``{% for name in expression %}``, ``{% if %} {% elif %} {% else %}``, and
``{% generation %} ... {% endgeneration %}``, which marks the output that a model
is trained on.  Expressions have strings, integers, true, false, none, names,
fields of rows (``m.role``, ``loop.first``), ``== != and or not + ~`` and the
filters of ``FILTERS``.  Names and fields are looked up in dicts only: a template
reaches no Python attribute, call or module.

``escape`` puts a backslash before each backslash and each control string, so
that a text never imitates a turn's marks and ``read_back`` can restore it.

A conversation is the rows of one id, by turn, then role, then text; it is one
output text, so its rows meet in one task.  Null texts and roles are empty, null
turns come last, and each row with a null id is a conversation of its own, so that
such rows do not gather in one task.  Repeated rows stay repeated.  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<turn>", "</role>", "</turn>")
TEMPLATE = (
    "{% for m in messages %}<turn>{{ m.role | escape }}</role>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
_TO_ESCAPE = re.compile("|".join(re.escape(c) for c in ("\\", *CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MARKS = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROLS)), re.DOTALL)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class TemplateError(ValueError):
    pass


@dataclass
class Output:
    """What has been rendered, and the spans under the generation marks."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


# The tree: ("text", s) ("print", e) ("for", name, e, body) ("if", [(e, body)], else) ("generation", body)
# Expressions: ("const", v) ("name", n) ("field", e, n) ("filter", e, n) ("not", e) (op, a, b)
_STRING = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_TAG = re.compile(rf"\{{\{{((?:{_STRING}|(?!\}}\}}).)*)\}}\}}|\{{%((?:{_STRING}|(?!%\}}).)*)%\}}", re.DOTALL)
_WORD = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.|+~()]))""", re.DOTALL)
_CONSTANTS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent; each method is one level of precedence."""

    def __init__(self, source: str):
        self.words: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _WORD.match(source, at)
            if not m:
                raise TemplateError(f"unexpected: {source[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.words[self.at] if self.at < len(self.words) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        if self.peek()[1] in wanted and self.peek()[0] in ("op", "name"):
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def name(self) -> str:
        kind, word = self.peek()
        if kind != "name" or word.startswith("_"):
            raise TemplateError(f"a name is needed, not {word!r}")
        self.at += 1
        return word

    def whole(self) -> tuple:
        out = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected: {self.peek()[1]!r}")
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        out = self.summed()
        while op := self.take("==", "!="):
            out = (op, out, self.summed())
        return out

    def summed(self) -> tuple:
        out = self.filtered()
        while op := self.take("+", "~"):
            out = (op, out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.primary()
        while op := self.take(".", "|"):
            name = self.name()
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            out = ("field" if op == "." else "filter", out, name)
        return out

    def primary(self) -> tuple:
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return out
        kind, word = self.peek()
        if kind == "str":
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1], flags=re.DOTALL))
        if kind == "int":
            self.at += 1
            return ("const", int(word))
        name = self.name()
        return ("const", _CONSTANTS[name]) if name in _CONSTANTS else ("name", name)


def parse(source: str) -> list[tuple]:
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        pieces += [("text", source[at : m.start()]), ("print", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    pieces = [p for p in [*pieces, ("text", source[at:])] if p[0] != "text" or p[1]]
    place = 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal place
        out: list[tuple] = []
        while place < len(pieces):
            kind, value = pieces[place]
            place += 1
            if kind == "text":
                out.append(("text", value))
            elif kind == "print":
                out.append(("print", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    if rest and word != "elif":
                        raise TemplateError(f"nothing may follow {word}: {value}")
                    return out, value
                if word == "for":
                    name, _, of = rest.strip().partition(" in ")
                    out.append(("for", _Expression(name).name(), _Expression(of).whole(), body("endfor")[0]))
                elif word == "generation":
                    out.append(("generation", body("endgeneration")[0]))
                elif word == "if":
                    cases, last = [], None
                    end = value
                    while True:
                        test = _Expression(end.partition(" ")[2]).whole()
                        inner, end = body("elif", "else", "endif")
                        cases.append((test, inner))
                        if end == "else":
                            last, end = body("endif")
                        if end == "endif":
                            break
                    out.append(("if", cases, last or []))
                else:
                    raise TemplateError(f"unknown tag: {value}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return body()[0]


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: _text(a) + _text(b),
}


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def fold_expression(e: tuple) -> tuple:
    if e[0] in ("const", "name"):
        return e
    if e[0] in ("field", "filter"):
        inner = fold_expression(e[1])
        return ("const", FILTERS[e[2]](inner[1])) if e[0] == "filter" and inner[0] == "const" else (e[0], inner, e[2])
    if e[0] == "not":
        inner = fold_expression(e[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    a, b = fold_expression(e[1]), fold_expression(e[2])
    return ("const", _BINARY[e[0]](a[1], b[1])) if a[0] == b[0] == "const" else (e[0], a, b)


def fold(body: list[tuple]) -> list[tuple]:
    """Constant prints become text, decided branches their body, neighbouring texts one."""
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        made = [node]
        if kind == "print":
            e = fold_expression(node[1])
            made = [("text", _text(e[1]))] if e[0] == "const" else [("print", e)]
        elif kind == "for":
            made = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif kind == "generation":
            made = [("generation", fold(node[1]))]
        elif kind == "if":
            cases, last = [], fold(node[2])
            for test, inner in node[1]:
                test = fold_expression(test)
                if test[0] != "const":
                    cases.append((test, fold(inner)))
                elif test[1]:
                    last = fold(inner)
                    break
            made = [("if", cases, last)] if cases else last
        for m in made:
            if m[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + m[1])
            elif m != ("text", ""):
                out.append(m)
    return out


def _value(e: tuple) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        return lambda env: e[1]
    if kind == "name":
        return lambda env: env.get(e[1])
    if kind == "field":
        of = _value(e[1])
        return lambda env: row.get(e[2]) if isinstance(row := of(env), dict) else None
    if kind == "filter":
        of, call = _value(e[1]), FILTERS[e[2]]
        return (lambda env: call(of(env))) if e[2] == "length" else (lambda env: call(_text(of(env))))
    if kind == "not":
        of = _value(e[1])
        return lambda env: not of(env)
    a, b = _value(e[1]), _value(e[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    call = _BINARY[kind]
    return lambda env: call(a(env), b(env))


Render = Callable[[dict, Output], None]


def _closure(node: tuple) -> Render:
    kind = node[0]
    if kind == "text":
        return lambda env, out: out.write(node[1])
    if kind == "print":
        value = _value(node[1])
        return lambda env, out: out.write(_text(value(env)))
    if kind == "generation":
        inner = _sequence(node[1])

        def generation(env: dict, out: Output) -> None:
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))

        return generation
    if kind == "for":
        name, over, inner = node[1], _value(node[2]), _sequence(node[3])

        def loop(env: dict, out: Output) -> None:
            rows = over(env) or []
            for i, row in enumerate(rows):
                inner(env | {name: row, "loop": {"index0": i, "first": i == 0, "last": i == len(rows) - 1}}, out)

        return loop
    cases, last = [(_value(test), _sequence(body)) for test, body in node[1]], _sequence(node[2])

    def choose(env: dict, out: Output) -> None:
        for test, body in cases:
            if test(env):
                return body(env, out)
        return last(env, out)

    return choose


def _sequence(body: list[tuple]) -> Render:
    steps = [_closure(node) for node in body]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


@lru_cache(32)
def compiled(source: str) -> Render:
    return _sequence(fold(parse(source)))


def render(source: str, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    out = Output()
    compiled(source)({"messages": messages}, out)
    return "".join(out.parts), out.spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that TEMPLATE made."""
    turns, role, start = [], "", 0
    for m in _MARKS.finditer(formatted):
        if m[0] == "</role>":
            role = unescape(formatted[start : m.start()])
        elif m[0] == "</turn>":
            turns.append((role, unescape(formatted[start : m.start()])))
        if m[0][0] != "\\":
            start = m.end()
    return turns


def conversations(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    turn = F.struct(
        F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = df.select(F.col(id_col), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("_own"), turn.alias("_turn"))
    return rows.groupBy(id_col, "_own").agg(F.sort_array(F.collect_list("_turn")).alias("_turns")).drop("_own")


def format_chats(df: DataFrame, id_col: str = "conv_id", template: str = TEMPLATE) -> DataFrame:
    """(id, formatted, loss_spans): one row for each conversation; spans in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(template, turns) for turns in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in done]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in done], pa.string()), pa.array(spans, kind)], names=[id_col, "formatted", "loss_spans"])

    turns = conversations(df, id_col)
    kind = turns.schema[id_col].dataType.simpleString()
    return turns.mapInArrow(run, f"{id_col} {kind}, formatted string, loss_spans array<struct<start: bigint, `end`: bigint>>")


def read_chats(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """df of format_chats with turns (role, text) and loss_text, both read from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts, spans = batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in read_back(f)] for f in texts]
            loss = ["".join(unescape(f[s["start"] : s["end"]]) for s in own) for f, own in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns, kind), pa.array(loss, pa.string())], names=[*batch.schema.names, "turns", "loss_text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "formatted", "loss_spans").mapInArrow(
        run, f"{id_col} {kind}, formatted string, loss_spans array<struct<start: bigint, `end`: bigint>>, turns array<struct<role: string, text: string>>, loss_text string"
    )
