"""Chat templates: a small sandboxed template language, compiled to Python closures.

The language has text, ``{{ expression }}``, ``{% for x in y %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set x = expression %}``, ``{% generation %}`` around what a model should learn to write, and
``{# comments #}``. A source is cut into tokens, parsed into a tree, constants are folded, and every node
becomes a closure. Expressions see only the variables given and plain values in them: names look up
mappings and lists, never attributes of Python objects; there are no calls, only the filters below.

A template whose only top-level loop is over ``messages`` also renders turn by turn (``Streaming``), so a
conversation is never needed as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

_CUT = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>().\[\]|]))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The source is not a valid template, or uses what the sandbox does not have."""


def escape(text: str) -> str:
    """Text without the control opener ``<|``; ``unescape`` takes it back exactly."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_line(text: str) -> str:
    """Like ``escape``, and on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "escape": lambda x: escape(str(x)),
    "escape_line": lambda x: escape_line(str(x)),
}


@dataclass
class Output:
    """What a template has written: text, and the spans of it inside generation blocks."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    mask: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


# --- parsing: nodes are tuples (kind, ...) ---------------------------------------------------------------


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        number, string, name, symbol = m.groups()
        if number:
            out.append(("const", int(number)))
        elif string:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.DOTALL)))
        elif name:
            out.append(("name", name))
        else:
            out.append(("op", symbol))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing: or < and < not < comparison < + ~ - < filters, fields."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def parse(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted: tuple[str, Any]) -> Any:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str, value: Any = None) -> Any:
        k, v = self.peek()
        if k != kind or value is not None and v != value:
            raise TemplateError(f"expected {value or kind}")
        self.at += 1
        return v

    def either(self) -> tuple:
        node = self.both()
        while self.take(("name", "or")):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take(("name", "and")):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take(("name", "not")) else self.compared()

    def compared(self) -> tuple:
        node = self.summed()
        while op := self.take(*(("op", o) for o in ("==", "!=", "<", ">", "<=", ">=")), ("name", "in")):
            node = (op, node, self.summed())
        return node

    def summed(self) -> tuple:
        node = self.filtered()
        while op := self.take(("op", "+"), ("op", "~"), ("op", "-")):
            node = (op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.single()
        while True:
            if self.take(("op", ".")):
                node = ("item", node, ("const", self.need("name")))
            elif self.take(("op", "[")):
                node = ("item", node, self.either())
                self.need("op", "]")
            elif self.take(("op", "|")):
                name = self.need("name")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                node = ("filter", name, node)
            else:
                return node

    def single(self) -> tuple:
        kind, value = self.peek()
        if kind == "const":
            self.at += 1
            return ("const", value)
        if kind == "name":
            self.at += 1
            return ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        if self.take(("op", "(")):
            node = self.either()
            self.need("op", ")")
            return node
        raise TemplateError("expected a value")


class _Blocks:
    """Statements and text, recursively, up to one of the closing words."""

    def __init__(self, source: str):
        self.parts, self.at = [p for p in _CUT.split(source) if p], 0

    def parse(self, *closing: str) -> tuple[list[tuple], str]:
        out: list[tuple] = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                out.append(("print", _Expression(part[2:-2]).parse()))
            elif not part.startswith("{%"):
                out.append(("text", part))
            else:
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in closing:
                    return out, f"{word} {rest}".strip()
                out.append(self.statement(word, rest))
        if closing:
            raise TemplateError(f"missing {closing[-1]}")
        return out, ""

    def statement(self, word: str, rest: str) -> tuple:
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError("for needs: name in list")
            body, _ = self.parse("endfor")
            return ("for", m[1], _Expression(m[2]).parse(), body)
        if word == "if":
            cases, test = [], _Expression(rest).parse()
            while True:
                body, end = self.parse("elif", "else", "endif")
                cases.append((test, body))
                if end.startswith("elif"):
                    test = _Expression(end[4:]).parse()
                elif end == "else":
                    test = ("const", True)
                else:
                    return ("if", cases)
        if word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError("set needs: name = value")
            return ("set", name.strip(), _Expression(value).parse())
        if word == "generation":
            body, _ = self.parse("endgeneration")
            return ("generation", body)
        raise TemplateError(f"no statement {word}")


# --- folding ---------------------------------------------------------------------------------------------


def _fold_expression(node: tuple) -> tuple:
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = _fold_expression(node[2])
        return ("const", FILTERS[node[1]](inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    parts = tuple(_fold_expression(n) for n in node[1:])
    if all(p[0] == "const" for p in parts):
        return ("const", _closure((kind, *parts))({}))
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return (kind, *parts)


def fold(nodes: list[tuple]) -> list[tuple]:
    """The tree with constant expressions computed, dead branches gone and neighbouring texts joined."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "print":
            value = _fold_expression(node[1])
            node = ("text", _shown(value[1])) if value[0] == "const" else ("print", value)
        elif kind == "for":
            node = ("for", node[1], _fold_expression(node[2]), fold(node[3]))
        elif kind == "generation":
            node = ("generation", fold(node[1]))
        elif kind == "set":
            node = ("set", node[1], _fold_expression(node[2]))
        elif kind == "if":
            cases = []
            for test, body in ((_fold_expression(t), fold(b)) for t, b in node[1]):
                if test[0] == "const" and not test[1]:
                    continue
                cases.append((test, body))
                if test[0] == "const":
                    break
            if not cases:
                continue
            if cases[0][0][0] == "const":
                for inner in cases[0][1]:
                    _append(out, inner)
                continue
            node = ("if", cases)
        _append(out, node)
    return out


def _append(nodes: list[tuple], node: tuple) -> None:
    if node[0] == "text" and nodes and nodes[-1][0] == "text":
        nodes[-1] = ("text", nodes[-1][1] + node[1])
    elif node != ("text", ""):
        nodes.append(node)


# --- closures --------------------------------------------------------------------------------------------

Value = Callable[[dict], Any]
Step = Callable[[dict, Output], None]


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, list | tuple | str) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b,
    "-": lambda a, b: a - b, "~": lambda a, b: _shown(a) + _shown(b), "item": _item,
}


def _closure(node: tuple) -> Value:
    kind = node[0]
    if kind == "const":
        return lambda scope, value=node[1]: value
    if kind == "name":
        return lambda scope, name=node[1]: scope.get(name)
    if kind == "filter":
        return lambda scope, f=FILTERS[node[1]], inner=_closure(node[2]): f(inner(scope))
    if kind == "not":
        return lambda scope, inner=_closure(node[1]): not inner(scope)
    left, right = _closure(node[1]), _closure(node[2])
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    return lambda scope, f=_BINARY[kind]: f(left(scope), right(scope))


def _steps(nodes: list[tuple]) -> Step:
    steps = [_step(n) for n in nodes]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: tuple) -> Step:
    kind = node[0]
    if kind == "text":
        return lambda scope, out, text=node[1]: out.write(text)
    if kind == "print":
        return lambda scope, out, value=_closure(node[1]): out.write(_shown(value(scope)))
    if kind == "set":
        def assign(scope: dict, out: Output, name=node[1], value=_closure(node[2])) -> None:
            scope[name] = value(scope)

        return assign
    if kind == "generation":
        def generate(scope: dict, out: Output, body=_steps(node[1])) -> None:
            start = out.length
            body(scope, out)
            out.mask.append((start, out.length))

        return generate
    if kind == "if":
        cases = [(_closure(test), _steps(body)) for test, body in node[1]]

        def choose(scope: dict, out: Output) -> None:
            for test, body in cases:
                if test(scope):
                    return body(scope, out)
            return None

        return choose

    def loop(scope: dict, out: Output, name=node[1], values=_closure(node[2]), body=_steps(node[3])) -> None:
        items = list(values(scope) or [])
        for i, item in enumerate(items):
            body(_turn(scope, name, item, i, i + 1 == len(items)), out)

    return loop


def _turn(scope: dict, name: str, item: Any, index: int, last: bool) -> dict:
    return {**scope, name: item, "loop": {"index": index + 1, "index0": index, "first": index == 0, "last": last}}


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.tree = fold(_Blocks(source).parse()[0])
        self._run = _steps(self.tree)

    def render(self, **variables: Any) -> Output:
        """Text and generation spans for the given variables (plain values only)."""
        out = Output()
        self._run(dict(variables), out)
        return out


class Streaming:
    """The same template, one message at a time; needs exactly one top-level loop, over ``messages``."""

    def __init__(self, source: str):
        tree = fold(_Blocks(source).parse()[0])
        loops = [i for i, n in enumerate(tree) if n[0] == "for"]
        if len(loops) != 1 or tree[loops[0]][2] != ("name", "messages"):
            raise TemplateError("a streaming template has one loop, over messages")
        at = loops[0]
        _, self.name, _, body = tree[at]
        self.before, self.body, self.after = _steps(tree[:at]), _steps(body), _steps(tree[at + 1 :])

    def render(self, messages: Iterator[dict]) -> Iterator[Output]:
        """One output per message; what stands before and after the loop goes to the first and the last."""
        scope: dict = {}
        index, held = 0, next(messages, None)
        while held is not None:
            following = next(messages, None)
            out = Output()
            if index == 0:
                self.before(scope, out)
            self.body(_turn(scope, self.name, held, index, following is None), out)
            if following is None:
                self.after(scope, out)
            yield out
            index, held = index + 1, following
