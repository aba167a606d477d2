"""A small sandboxed template language for conversations.

``{{ expression }}`` writes, ``{% if %} {% elif %} {% else %} {% endif %}`` chooses, ``{% generation %} {% endgeneration %}`` marks what a model is to
generate, and ``{% for turn in turns %} {% endfor %}`` stands once, at the top, around what is written for each turn. Expressions are literals, names, fields of
the turn, ``+ == != and or not``, brackets, and the filters ``escape``, ``trim``, ``lower``, ``upper``. Nothing else can be named: there are no calls, and a field is
a key of the turn, never an attribute of a Python object.

A template is parsed to a tree, constant parts of the tree are folded, and closures are made of what is left: ``head`` and ``tail`` are texts, ``write``
renders one turn with its generated spans. ``escape`` puts a backslash before each place where a backslash or a control string begins; from the
same tree comes the pattern that reads a rendered turn back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

_PIECE = re.compile(r"\{\{(?P<out>.*?)\}\}|\{%(?P<tag>.*?)%\}|\{#.*?#\}", re.S)
_LEXEME = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>==|!=|[().|,+]))", re.S)
_LITERALS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """A template that the language does not allow."""


# ---- the tree
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    """A key of the turn; the empty text where the turn lacks it or holds null."""

    name: str


@dataclass(frozen=True)
class Binary:
    sign: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Filter:
    name: str
    of: object
    extra: tuple[str, ...]


@dataclass(frozen=True)
class Out:
    of: object


@dataclass(frozen=True)
class Choice:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class Loop:
    body: tuple


def text_of(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


class _Expression:
    """Parses one expression by descent; ``turn`` is the name of the loop's variable, if it is inside one."""

    def __init__(self, source: str, turn: str | None) -> None:
        self.turn, self.tokens, at = turn, [], 0
        while source[at:].strip():
            m = _LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:].strip()!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        kind, own = self.tokens[self.at]
        if kind in {"sign", "name"} and own in wanted:
            self.at += 1
            return own
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected, not {self.tokens[self.at][1]!r}")

    def whole(self) -> object:
        found = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"not understood: {self.tokens[self.at][1]!r}")
        return found

    def either(self) -> object:
        left = self.both()
        while self.take("or"):
            left = Binary("or", left, self.both())
        return left

    def both(self) -> object:
        left = self.denied()
        while self.take("and"):
            left = Binary("and", left, self.denied())
        return left

    def denied(self) -> object:
        return Not(self.denied()) if self.take("not") else self.compared()

    def compared(self) -> object:
        left = self.joined()
        while sign := self.take("==", "!="):
            left = Binary(sign, left, self.joined())
        return left

    def joined(self) -> object:
        left = self.filtered()
        while self.take("+"):
            left = Binary("+", left, self.filtered())
        return left

    def filtered(self) -> object:
        found = self.single()
        while self.take("|"):
            kind, name = self.tokens[self.at]
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no such filter: {name!r}")
            self.at += 1
            extra = []
            if self.take("("):
                while not self.take(")"):
                    value = self.single()
                    if not isinstance(value, Const) or not value.value or not isinstance(value.value, str):
                        raise TemplateError("filters take texts that are written out")
                    extra.append(value.value)
                    self.take(",")
            found = Filter(name, found, tuple(extra))
        return found

    def single(self) -> object:
        if self.take("("):
            found = self.either()
            self.need(")")
            return found
        kind, own = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), own[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(own))
        if kind == "name" and own in _LITERALS:
            return Const(_LITERALS[own])
        if kind == "name" and own == self.turn:
            self.need(".")
            kind, own = self.tokens[self.at]
            self.at += 1
            if kind == "name":
                return Field(own)
        raise TemplateError(f"not allowed: {own!r}")


class _Blocks:
    """Parses a template by descent into its blocks."""

    def __init__(self, source: str) -> None:
        self.parts, self.turn, self.marked, at = [], None, False, 0
        for m in _PIECE.finditer(source):
            self.parts += [("text", source[at : m.start()]), ("out", m["out"]) if m["out"] is not None else ("tag", (m["tag"] or "").strip())]
            at = m.end()
        self.parts += [("text", source[at:]), ("tag", "")]
        self.parts = [x for x in self.parts[:-1] if x[1] or x[0] == "out"] + self.parts[-1:]
        self.at = 0

    def body(self, *ends: str) -> tuple[tuple, str, str]:
        """The nodes up to one of these tags, that tag, and what follows its name."""
        out: list = []
        while True:
            kind, own = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out.append(Out(Const(own)))
            elif kind == "out":
                out.append(Out(_Expression(own, self.turn).whole()))
            else:
                word, _, rest = own.partition(" ")
                if word in ends:
                    return tuple(out), word, rest
                out.append(self.block(word, rest, top=ends == ("",)))

    def block(self, word: str, rest: str, top: bool) -> object:
        if word == "for" and top:
            found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+turns", rest.strip(), re.ASCII)
            if not found:
                raise TemplateError("a loop goes over turns")
            self.turn = found[1]
            own = Loop(self.body("endfor")[0])
            self.turn = None
            return own
        if word in {"if", "elif"}:
            test = _Expression(rest, self.turn).whole()
            yes, end, rest = self.body("elif", "else", "endif")
            no = (self.block("elif", rest, False),) if end == "elif" else self.body("endif")[0] if end == "else" else ()
            return Choice(test, yes, no)
        if word == "generation" and not self.marked:
            self.marked = True
            own = Generation(self.body("endgeneration")[0])
            self.marked = False
            return own
        raise TemplateError(f"not allowed here: {word!r}" if word else "a block is not closed")


# ---- escaping
def _starts(controls: tuple[str, ...]) -> str:
    return "|".join(re.escape(c) for c in ("\\", *controls))


def escape(text: str, controls: tuple[str, ...]) -> str:
    """A backslash before each place where a backslash or a control string begins."""
    return re.sub(f"(?={_starts(controls)})", r"\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str, tuple[str, ...]], str]] = {"escape": escape, "trim": lambda t, _: t.strip(), "lower": lambda t, _: t.lower(), "upper": lambda t, _: t.upper()}


# ---- folding
def _fold(node: object, controls: tuple[str, ...]) -> object:
    """The same expression with constant parts computed."""
    if isinstance(node, Not):
        of = _fold(node.of, controls)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Filter):
        of, extra = _fold(node.of, controls), controls + node.extra if node.name == "escape" else node.extra
        return Const(FILTERS[node.name](text_of(of.value), extra)) if isinstance(of, Const) else Filter(node.name, of, extra)
    if isinstance(node, Binary):
        left, right = _fold(node.left, controls), _fold(node.right, controls)
        if isinstance(left, Const) and node.sign in {"and", "or"}:
            return right if bool(left.value) == (node.sign == "and") else left
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(_OPERATIONS[node.sign](left.value, right.value))
        return Binary(node.sign, left, right)
    return node


_OPERATIONS = {"+": lambda a, b: text_of(a) + text_of(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def _fold_body(body: tuple, controls: tuple[str, ...]) -> tuple:
    """Constant outputs that follow each other become one, and choices with constant tests the branch they take."""
    out: list = []

    def put(node: object) -> None:
        if isinstance(node, Out) and isinstance(node.of, Const):
            text = text_of(node.of.value)
            if out and isinstance(out[-1], Out) and isinstance(out[-1].of, Const):
                text = out.pop().of.value + text
            if text:
                out.append(Out(Const(text)))
        else:
            out.append(node)

    for node in body:
        match node:
            case Out(of):
                put(Out(_fold(of, controls)))
            case Choice(test, yes, no):
                test, yes, no = _fold(test, controls), _fold_body(yes, controls), _fold_body(no, controls)
                if isinstance(test, Const):
                    for x in yes if test.value else no:
                        put(x)
                else:
                    put(Choice(test, yes, no))
            case Generation(inner):
                put(Generation(_fold_body(inner, controls)))
            case Loop(inner):
                put(Loop(_fold_body(inner, controls)))
    return tuple(out)


# ---- closures
class Writer:
    """What has been rendered, and the generated spans in code points."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


Render = Callable[[Mapping[str, object], Writer], None]


def _value(node: object) -> Callable[[Mapping[str, object]], object]:
    match node:
        case Const(value):
            return lambda turn: value
        case Field(name):
            return lambda turn: "" if (own := turn.get(name)) is None else own
        case Not(of):
            inner = _value(of)
            return lambda turn: not inner(turn)
        case Filter(name, of, extra):
            inner = _value(of)
            if name == "escape":
                place = re.compile(f"(?={_starts(extra)})")
                return lambda turn: place.sub(r"\\", text_of(inner(turn)))
            apply = FILTERS[name]
            return lambda turn: apply(text_of(inner(turn)), extra)
        case Binary("and", left, right):
            first, second = _value(left), _value(right)
            return lambda turn: first(turn) and second(turn)
        case Binary("or", left, right):
            first, second = _value(left), _value(right)
            return lambda turn: first(turn) or second(turn)
        case Binary(sign, left, right):
            first, second, operation = _value(left), _value(right), _OPERATIONS[sign]
            return lambda turn: operation(first(turn), second(turn))
    raise TemplateError(f"not allowed: {node!r}")


def _closure(body: tuple) -> Render:
    steps: list[Render] = []
    for node in body:
        match node:
            case Out(Const(text)):
                steps.append(lambda turn, out, text=text: out.put(text))
            case Out(of):
                steps.append(lambda turn, out, value=_value(of): out.put(text_of(value(turn))))
            case Choice(test, yes, no):
                steps.append(lambda turn, out, test=_value(test), yes=_closure(yes), no=_closure(no): (yes if test(turn) else no)(turn, out))
            case Generation(inner):

                def generated(turn: Mapping[str, object], out: Writer, inner: Render = _closure(inner)) -> None:
                    start = out.length
                    inner(turn, out)
                    out.spans.append((start, out.length))

                steps.append(generated)
            case _:
                raise TemplateError("a loop stands at the top only")

    def render(turn: Mapping[str, object], out: Writer) -> None:
        for step in steps:
            step(turn, out)

    return render


# ---- reading back
def _pattern(body: tuple, follows: str) -> str:
    """A pattern of all that ``body`` can render; ``follows``: the constant text behind it."""
    out = ""
    for k, node in enumerate(body):
        behind = next((n.of.value for n in body[k + 1 : k + 2] if isinstance(n, Out) and isinstance(n.of, Const)), "" if k + 1 < len(body) else follows)
        match node:
            case Out(Const(text)):
                out += re.escape(text)
            case Out(Filter("escape", Field(name), controls)):
                ends = [c for c in controls if behind.startswith(c)]
                if not ends or any(c[:i] == c[-i:] for c in ends for i in range(1, len(c))):
                    raise TemplateError(f"what follows {name!r} does not show where it ends: {behind!r}")
                first = "".join(sorted({re.escape(c[0]) for c in controls}))
                out += rf"(?P<{name}>(?:[^\\{first}]++|\\.|(?!{'|'.join(map(re.escape, controls))})[{first}])*+)"
            case Generation(inner):
                out += _pattern(inner, behind)
            case Choice(_, yes, no):
                both = {_pattern(yes, behind), _pattern(no, behind)}
                if len(both) > 1:
                    raise TemplateError("the branches of a choice can't be told apart")
                out += both.pop()
            case _:
                raise TemplateError("a turn that is to be read back writes escaped fields and constant text only")
    return out


class Template:
    """A compiled template: ``head``, ``write`` for each turn, ``tail``. It pickles as its source."""

    def __init__(self, source: str, controls: tuple[str, ...]) -> None:
        if not all(controls):
            raise TemplateError("control strings are not empty")
        self.source, self.controls = source, tuple(controls)
        self.tree = _fold_body(_Blocks(source).body("")[0], self.controls)
        loops = [k for k, node in enumerate(self.tree) if isinstance(node, Loop)]
        outside = [node for node in self.tree if not isinstance(node, Loop)]
        if len(loops) != 1 or not all(isinstance(n, Out) and isinstance(n.of, Const) for n in outside):
            raise TemplateError("a template has one loop over turns, and constant text around it")
        self.head = "".join(n.of.value for n in self.tree[: loops[0]])
        self.tail = "".join(n.of.value for n in self.tree[loops[0] + 1 :])
        self.body = self.tree[loops[0]].body
        self._write = _closure(self.body)

    def __reduce__(self) -> tuple:
        return Template, (self.source, self.controls)

    def write(self, turn: Mapping[str, object]) -> tuple[str, list[tuple[int, int]]]:
        """What stands for one turn, and its generated spans."""
        out = Writer()
        self._write(turn, out)
        return "".join(out.parts), out.spans

    def render(self, turns: list[Mapping[str, object]]) -> tuple[str, list[tuple[int, int]]]:
        """A whole conversation of a size that fits one string."""
        parts, spans, at = [self.head], [], len(self.head)
        for turn in turns:
            text, own = self.write(turn)
            parts.append(text)
            spans += [(a + at, b + at) for a, b in own]
            at += len(text)
        return "".join(parts) + self.tail, spans

    def reader(self) -> re.Pattern:
        """Matches one rendered turn; its groups are the fields, still escaped."""
        return re.compile(_pattern(self.body, ""), re.S)
