"""A small sandboxed template language for conversations, compiled to Python closures.

    {% for message in messages %}<turn>{{ message.role | escape }}<body>
    {%- if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}
    {%- else %}{{ message.text | escape }}{% endif %}</turn>{% endfor %}

Statements: ``for`` (one, over ``messages``, not nested), ``if``/``elif``/``else``, ``generation``
(its output is what a model is to learn), ``{# comments #}``; a ``-`` inside a tag's border
strips white space on that side.  Expressions: strings, integers, ``true``, ``false``, the loop
variable's fields, ``~``, ``==``, ``!=``, ``in``, ``and``, ``or``, ``not``, ``a if c else b``, filters.

Nothing else can be named: no attribute, no call, no arithmetic, no loop within the loop.
So a template ends, its output is linear in its input, and a turn's output depends on that
turn alone; what stands before and after the loop is constant.  That is what lets turns of
one conversation be rendered in different tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate
from typing import Any


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Call:
    """A filter or an operator, by its name, on expressions."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class If:
    condition: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class For:
    body: tuple


class Escape:
    """Reversible escapes of control strings in texts.

    ``\\`` is doubled, and every control string gets a ``\\`` after its first character, so none
    is left in an escaped text.  No control string may overlap another or itself; then none
    can arise either where an escaped text meets the template's own.
    """

    def __init__(self, controls: Sequence[str]):
        for a in controls:
            if len(a) < 2 or "\\" in a:
                raise TemplateError(f"control string {a!r} is too short or holds the escape sign")
            for b in controls:
                if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise TemplateError(f"control strings {a!r} and {b!r} overlap")
        self.controls = tuple(controls)
        self._find = re.compile("|".join(map(re.escape, controls))) if controls else None

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        return self._find.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if self._find else text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


_TAG = re.compile(r"\{%(-?)(.*?)(-?)%\}|\{\{(-?)(.*?)(-?)\}\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|().]))", re.DOTALL)
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false"}
_NEWLINES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    found, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise TemplateError(f"cannot read {source[at:]!r}")
        text, number, name, sign = m.groups()
        if text is not None:
            found.append(("const", re.sub(r"\\(.)", lambda e: _NEWLINES.get(e[1], e[1]), text[1:-1], flags=re.DOTALL)))
        elif number is not None:
            found.append(("const", int(number)))
        else:
            found.append(("sign" if sign or name in _WORDS else "name", sign or name))
        at = m.end()
    return [*found, ("end", None)]


class _Parser:
    """Recursive descent over the tags of a template."""

    def __init__(self, source: str, fields: Sequence[str], filters: Mapping[str, Callable], most: int = 100_000):
        if len(source) > most:
            raise TemplateError("the template is too long")
        self.fields, self.filters = fields, filters
        self.variable: str | None = None
        self.parts, at, strip = [], 0, False
        for m in _TAG.finditer(source):
            text = source[at : m.start()].lstrip() if strip else source[at : m.start()]
            left, right = (m[1] or m[4]), (m[3] or m[6])
            self.parts.append(("text", text.rstrip() if left else text))
            if m[2] is not None:
                self.parts.append(("tag", m[2].strip()))
            elif m[5] is not None:
                self.parts.append(("output", m[5]))
            at, strip = m.end(), bool(right)
        self.parts.append(("text", source[at:].lstrip() if strip else source[at:]))
        self.next = 0

    def template(self) -> tuple:
        body, end = self.body(())
        assert end == ""
        return body

    def body(self, ends: tuple[str, ...], depth: int = 0) -> tuple[tuple, str]:
        """Statements up to a tag that begins with one of ``ends``, and that tag."""
        if depth > 50:
            raise TemplateError("the template is nested too deeply")
        out: list = []
        while self.next < len(self.parts):
            kind, value = self.parts[self.next]
            self.next += 1
            if kind == "text":
                if "{%" in value or "{{" in value:
                    raise TemplateError(f"a tag is not closed: {value!r}")
                out.append(Output(Const(value)))
            elif kind == "output":
                out.append(Output(self.expression(value)))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(out), value
                if word == "if":
                    out.append(self.condition(rest, depth))
                elif word == "generation":
                    body, _ = self.body(("endgeneration",), depth + 1)
                    out.append(Generation(body))
                elif word == "for":
                    out.append(self.loop(rest, depth))
                else:
                    raise TemplateError(f"unknown or misplaced tag {value!r}")
        if ends:
            raise TemplateError(f"expected {' or '.join(ends)}")
        return tuple(out), ""

    def condition(self, source: str, depth: int) -> If:
        test = self.expression(source)
        then, end = self.body(("elif", "else", "endif"), depth + 1)
        other: tuple = ()
        if end.startswith("elif"):
            other = (self.condition(end[4:], depth + 1),)
        elif end == "else":
            other, _ = self.body(("endif",), depth + 1)
        return If(test, then, other)

    def loop(self, source: str, depth: int) -> For:
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", source)
        if m is None or m[1] in _WORDS or self.variable is not None or depth:
            raise TemplateError("a template has one loop, over messages and outside of any other tag")
        self.variable = m[1]
        body, _ = self.body(("endfor",), depth + 1)
        self.variable = ""  # gone, and no second loop
        return For(body)

    def expression(self, source: str) -> Any:
        self.tokens, self.at = _tokens(source), 0
        value = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"cannot read {source!r}")
        return value

    def taken(self, *signs: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind == "sign" and value in signs:
            self.at += 1
            return value
        return None

    def either(self) -> Any:
        value = self.any_of()
        if self.taken("if"):
            test = self.any_of()
            other = self.either() if self.taken("else") else Const("")
            return Call("choose", (test, value, other))
        return value

    def any_of(self) -> Any:
        value = self.all_of()
        while self.taken("or"):
            value = Call("or", (value, self.all_of()))
        return value

    def all_of(self) -> Any:
        value = self.negated()
        while self.taken("and"):
            value = Call("and", (value, self.negated()))
        return value

    def negated(self) -> Any:
        return Call("not", (self.negated(),)) if self.taken("not") else self.compared()

    def compared(self) -> Any:
        value = self.joined()
        sign = self.taken("==", "!=", "in")
        return Call(sign, (value, self.joined())) if sign else value

    def joined(self) -> Any:
        value = self.filtered()
        while self.taken("~"):
            value = Call("~", (value, self.filtered()))
        return value

    def filtered(self) -> Any:
        value = self.primary()
        while self.taken("|"):
            kind, name = self.tokens[self.at]
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            value = Call(name, (value,))
        return value

    def primary(self) -> Any:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return Const(value)
        if (kind, value) in (("sign", "true"), ("sign", "false")):
            return Const(value == "true")
        if (kind, value) == ("sign", "("):
            inner = self.either()
            if not self.taken(")"):
                raise TemplateError("a bracket is not closed")
            return inner
        if kind == "name" and self.variable and value == self.variable and self.taken("."):
            kind, name = self.tokens[self.at]
            if kind == "name" and name in self.fields:
                self.at += 1
                return Field(name)
            raise TemplateError(f"messages have no field {name!r}")
        raise TemplateError(f"{value!r} cannot be used here")


def _as_text(value: Any) -> str:
    return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


OPERATORS: dict[str, Callable] = {
    "~": lambda a, b: _as_text(a) + _as_text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: _as_text(a) in _as_text(b),
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "choose": lambda c, a, b: a if c else b,
}


def _fold(node: Any, functions: Mapping[str, Callable]) -> Any:
    """An expression with its constant parts worked out."""
    if not isinstance(node, Call):
        return node
    args = tuple(_fold(a, functions) for a in node.args)
    if node.name in ("and", "or", "choose") and isinstance(args[0], Const):
        if node.name == "choose":
            return args[1] if args[0].value else args[2]
        return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
    if all(isinstance(a, Const) for a in args):
        return Const(functions[node.name](*[a.value for a in args]))
    return Call(node.name, args)


def _folded(body: tuple, functions: Mapping[str, Callable]) -> tuple:
    """Statements with constant branches chosen and neighbouring constant outputs joined."""
    out: list = []

    def add(node: Any) -> None:
        if isinstance(node, Output) and isinstance(node.value, Const):
            text = _as_text(node.value.value)
            if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                out[-1] = Output(Const(out[-1].value.value + text))
            elif text:
                out.append(Output(Const(text)))
        else:
            out.append(node)

    for node in body:
        if isinstance(node, Output):
            add(Output(_fold(node.value, functions)))
        elif isinstance(node, If):
            test = _fold(node.condition, functions)
            then, other = _folded(node.then, functions), _folded(node.other, functions)
            if isinstance(test, Const):
                for chosen in then if test.value else other:
                    add(chosen)
            elif then or other:
                add(If(test, then, other))
        else:
            add(type(node)(_folded(node.body, functions)))
    return tuple(out)


Turn = Mapping[str, str]


def _value_closure(node: Any, functions: Mapping[str, Callable]) -> Callable[[Turn], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda turn: value
    if isinstance(node, Field):
        name = node.name
        return lambda turn: turn[name]
    args = [_value_closure(a, functions) for a in node.args]
    if node.name == "and":
        return lambda turn: args[0](turn) and args[1](turn)
    if node.name == "or":
        return lambda turn: args[0](turn) or args[1](turn)
    if node.name == "choose":
        return lambda turn: args[1](turn) if args[0](turn) else args[2](turn)
    function = functions[node.name]
    if len(args) == 1:
        return lambda turn: function(args[0](turn))
    return lambda turn: function(args[0](turn), args[1](turn))


def _closure(body: tuple, functions: Mapping[str, Callable], learnt: bool = False) -> Callable:
    """A function of a turn, its output's parts, and the places among them where learning begins or ends."""
    steps = []
    for node in body:
        if isinstance(node, Output):
            steps.append(_output(_value_closure(node.value, functions)))
        elif isinstance(node, If):
            steps.append(
                _branch(
                    _value_closure(node.condition, functions),
                    _closure(node.then, functions, learnt),
                    _closure(node.other, functions, learnt),
                )
            )
        elif learnt:
            raise TemplateError("generation stands within generation")
        else:
            steps.append(_marked(_closure(node.body, functions, True)))

    def run(turn: Turn, out: list[str], marks: list[int]) -> None:
        for step in steps:
            step(turn, out, marks)

    return steps[0] if len(steps) == 1 else run


def _output(value: Callable) -> Callable:
    return lambda turn, out, marks: out.append(_as_text(value(turn)))


def _branch(test: Callable, then: Callable, other: Callable) -> Callable:
    return lambda turn, out, marks: (then if test(turn) else other)(turn, out, marks)


def _marked(inner: Callable) -> Callable:
    def run(turn: Turn, out: list[str], marks: list[int]) -> None:
        marks.append(len(out))
        inner(turn, out, marks)
        marks.append(len(out))

    return run


class Template:
    """A compiled template: ``head`` and ``tail`` are constant, ``turn`` renders one message."""

    def __init__(self, source: str, fields: Sequence[str] = ("role", "text"), controls: Sequence[str] = ()):
        self.escapes = Escape(controls)
        filters = {"escape": self.escapes.escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}
        functions = OPERATORS | {name: (lambda f: lambda x: f(_as_text(x)))(f) for name, f in filters.items()}
        tree = _folded(_Parser(source, fields, filters).template(), functions)
        loops = [i for i, node in enumerate(tree) if isinstance(node, For)]
        if len(loops) != 1:
            raise TemplateError("a template needs a loop over messages")
        self.tree = tree
        self.head, self.tail = self._constant(tree[: loops[0]]), self._constant(tree[loops[0] + 1 :])
        self._run = _closure(tree[loops[0]].body, functions)

    @staticmethod
    def _constant(body: tuple) -> str:
        if not all(isinstance(n, Output) and isinstance(n.value, Const) for n in body):
            raise TemplateError("what stands outside of the loop is constant")
        return "".join(n.value.value for n in body)

    def turn(self, message: Turn) -> tuple[str, list[tuple[int, int]]]:
        """A turn's text, and the spans of code points in it that a model is to learn."""
        out: list[str] = []
        marks: list[int] = []
        self._run(message, out, marks)
        if not marks:
            return "".join(out), []
        at = [0, *accumulate(map(len, out))]
        return "".join(out), [(at[a], at[b]) for a, b in zip(marks[::2], marks[1::2], strict=True)]
