"""Secrets by lexing assignments.

Source and configuration syntax is lexed into pairs of a name and a value. A value is an expression: its literals and the names in it, through
brackets, calls and conditions, up to the end of the statement; pairs in its brackets (named arguments) are pairs of their own. Types between a name and
its value are passed over, subscripts name what they stand for, XML elements and attributes are pairs, and a ``name`` followed by a ``value`` is one.
Each pair is a definition that refers to the latest definitions of the names in it before. Sensitivity flows back along these references, newest
first, so constants propagate through any number of steps in time linear in the pairs; a literal is scored by the most sensitive name that
it reaches and by its own look. Literals that score ``THRESHOLD`` or more are
added to the spans of fixed shape: keyword assignments, access keys, hex runs. Private key blocks are added too.

Cases: null and empty texts have no spans; repeated rows have equal spans; spans that tie in start come by kind and end; texts without any sensitive word are not
lexed, since no literal can score there; columns beside doc_id and text are not read, whatever their names; an empty table gives an empty result; places count code points.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ripplet.llm.common import small_batches, texts

#: The kinds of the contract in its order, then the added ones.
KINDS = ("assign", "access", "hex", "literal", "pem")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # with its four letters 18 or more; a shorter run has no longer one inside
HEX = re.compile(r"[0-9a-f]{16,}")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,40}PRIVATE KEY-----")
THRESHOLD = 0.6
#: Sensitivity of a name that contains such a word.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "credential": 0.9, "signingkey": 0.9, "encryptionkey": 0.9}
#: Of a name that has such a word as one of its own.
SENSITIVE_WORD = {"pass": 0.9}
_STEMS = ("pass", "pwd", "secret", "token", "key", "credential")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*|%.*%|\{\{.*|(?:your|my|example|sample|dummy|change|todo|none|null|true|false|test|placeholder|redacted)[\w .-]*)$")
#: What a call or a subscript asks for by name is no value.
_ASKED = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|https?://[^@\s]*|[a-z]+(?:[._-][a-z]+)*")
_DECLARES = frozenset("var let const val final static".split())
_LABELS, _VALUES = frozenset("name key id".split()), frozenset("value default content".split())
#: What gives the name behind it its value without a sign, and calls that set one: by their own name, or by what they are told first.
_VERBS = frozenset("set setenv setx export define putenv".split())
_SETTER = re.compile(r"(?:.*[.\-])?(?:set|with)_?([A-Z_]\w*|[a-z]+(?:_[a-z]+)+)", re.ASCII)
_PUTS = re.compile(r"(?i)(?:.*[.\-])?(?:set|put|add|setproperty|setenv|putenv|setitem|setattribute|setheader|addheader|define)", re.ASCII)
#: What stands before a name whose colon begins a body.
_BODIES = frozenset("class def if for while else elif try except with case switch lambda".split())
#: The password of a URL.
URL = re.compile(r"""://[^\s:/@"'<>]*+:([^\s:/@"'<>]++)@""")
#: Each alternative gives up after what it has read once: an escaped quote outside a literal is a token, so a kind of quote without an end is looked for once on a line.
LEX = re.compile(
    r"""<(?P<element>[A-Za-z_][\w.-]*+)[^<>]*+>(?P<body>[^<>]++)</(?P=element)>"""
    r"""|\#[ \t]*+define[ \t]++(?P<macro>[A-Za-z_]\w*+)(?=[ \t])"""
    r"""|(?P<name>[A-Za-z_$][\w$]*(?:[.\-][\w$]+)*)"""
    r"""|(?P<block>\"\"\"(?:[^\\"]|\\.|"(?!""))*+\"\"\"|'''(?:[^\\']|\\.|'(?!''))*+''')"""
    r"""|(?P<quoted>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`)"""
    r"""|\\(?P<mark>["'])(?P<escaped>[^"'\\\n]++)\\(?P=mark)"""
    r"""|(?P<number>[0-9][\w.+/=-]*)"""
    r"""|(?P<gives>:=|=>|<-|(?<![=!<>])=(?!=)|:(?!:))"""
    r"""|(?P<joins>\+|\.\.)"""
    r"""|(?P<opens>[(\[])"""
    r"""|(?P<shuts>[)\]])"""
    r"""|(?P<blank>\n[ \t]*+(?=\n))"""
    r"""|(?P<ends>[;,\n{}])"""
    r"""|(?P<other>\\.|[^\s])""",
    re.ASCII | re.S,
)


def sensitivity(name: str) -> float:
    plain = re.sub(r"[^a-z0-9]", "", name.lower())
    whole = max((v for k, v in SENSITIVE.items() if k in plain), default=0.0)
    return whole or max((SENSITIVE_WORD.get(w.lower(), 0.0) for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)), default=0.0)


def strength(literal: str) -> float:
    """How much a literal looks like a secret rather than a word or a placeholder."""
    n = len(literal)
    if n < 6 or _PLACEHOLDER.match(literal) or literal.isspace():
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 * min(n, 20) / 10 + 0.15 * min(entropy, 4) / 2 + 0.15 * kinds) * (0.4 if re.search(r"\s", literal) and kinds < 3 else 1.0)


Token = tuple[str, int, int]


class Pair:
    """A name with what its value holds: literals and other names, as (content, start, end); ``depth``: of brackets where it stands."""

    __slots__ = ("also", "body", "depth", "joined", "literals", "name", "names", "next_line", "others", "typed")

    def __init__(self, name: str, also: str | None, depth: int, typed: bool) -> None:
        self.name, self.also, self.depth, self.typed, self.joined = name, also, depth, typed, True
        self.body = False  # whether it is a colon before a body of statements
        self.next_line = False  # whether the value may stand in the line after the name
        self.others: list[str] = []  # names that the values after the next commas belong to
        self.literals: list[Token] = []
        self.names: list[tuple[str, int, int, bool]] = []  # whether it stands where a bare value does


def pairs(text: str) -> Iterator[Pair]:
    """The assignments of a text, each when it ends; every token belongs to the innermost one that is open."""
    open_: list[Pair] = []
    depth = 0
    brackets: list[bool] = []  # of what is open: whether it asks by name
    key: str | None = None  # what a gives would assign to
    before: list[str] = []  # names in a row up to here
    newest: Token | None = None  # the last literal or name that was put into a value
    waits: str | None = None  # the first name of a declaration
    row: list[str] | None = []  # names with commas between them, from the beginning of a statement on; none elsewhere
    told: dict[int, str | None] = {}  # by depth of brackets: what a call that sets something was told first

    def close(least: int) -> Iterator[Pair]:
        while open_ and open_[-1].depth >= least:
            yield open_.pop()

    for m in LEX.finditer(text):
        kind, own = m.lastgroup, m[0]
        if kind == "body":
            pair = Pair(m["element"], None, depth, False)
            start, end = m.span("body")
            body = m["body"].strip()
            if body:
                at = text.index(body, start, end)
                pair.literals.append((body, at, at + len(body)))
                yield pair
            key, before = None, []
            continue
        now = open_[-1] if open_ else None
        asks = bool(brackets and brackets[-1])
        if now and now.next_line and kind not in {"quoted", "block", "escaped", "number", "ends", "blank"}:
            open_.pop()  # the line after it begins something else
            yield now
            now = open_[-1] if open_ else None
        if kind == "macro":
            yield from close(0)
            open_.append(Pair(m["macro"], None, 0, False))
            key, before, waits, newest, row, depth, brackets = None, [], None, None, None, 0, []
            continue
        if kind == "name":
            if len(before) == 2 and before[0].lower() in _VERBS and not now and re.search("[0-9]", own):
                pair = Pair(before[1], None, depth, False)
                pair.literals.append((own, m.start(), m.end()))
                yield pair
            if row is not None:
                row = [*row, own] if not before else [own] if len(before) == 1 and before[0] in _DECLARES else None
            before.append(own)
            waits = before[1] if len(before) == 3 and before[0] in _DECLARES else None
            if now:
                newest = (own, m.start(), m.end())
                now.names.append((*newest, now.joined and now.depth == depth))
                now.joined = False
            key = own
            continue
        if kind in {"quoted", "block", "number", "escaped"}:
            edge = {"block": 3, "escaped": 2, "number": 0}.get(kind, 1)
            literal = (own[edge : len(own) - edge], m.start() + edge, m.end() - edge)
            if now and now.next_line:
                now.next_line = False
            if len(before) == 2 and before[0].lower() in _VERBS and not now:
                pair = Pair(before[1], None, depth, False)
                pair.literals.append(literal)
                yield pair
            if told.get(depth, "") is None:
                told[depth] = literal[0]
            if now and (kind != "number" or now.joined) and not (asks and _ASKED.fullmatch(literal[0])):
                newest = literal
                now.literals.append(literal)
                now.joined = False
            row = None
            key = literal[0] if kind in {"quoted", "escaped"} and re.fullmatch(r"[\w.$-]+", literal[0]) else None
            before, waits = [], None
            continue
        if kind == "gives" and key is not None and not (now and now.joined and now.depth == depth):
            if now and now.depth == depth and now.typed and own in {"=", ":="} and not now.literals:
                now.names, now.typed, now.joined = [], False, True  # what stood there was a type
            else:
                if now and newest and newest[0] == key:  # it was the next name, not a value
                    if now.literals and now.literals[-1] == newest:
                        now.literals.pop()
                    elif now.names and now.names[-1][:3] == newest:
                        now.names.pop()
                yield from close(depth)
                open_.append(Pair(key, waits, depth, own == ":"))
                if row and len(row) > 1 and row[-1] == key and own != ":":
                    open_[-1].name, *open_[-1].others = row
                open_[-1].body = own == ":" and bool(_BODIES & set(before[:-1]))
            key, before, waits, newest, row = None, [], None, None, None
            continue
        before, waits = [], None
        if kind == "joins":
            if now:
                now.joined = True
            continue
        if kind == "opens":
            brackets.append(own == "[" and key is not None or own == "(" and bool(key) and bool(re.search(r"(?i)(?:^|[._])(?:get\w*|env\w*|lookup|fetch|read\w*|load\w*)$", key)))
            depth += 1
            told.pop(depth, None)
            if now and own == "(" and key is None:
                now.joined = True
            if own == "(" and key is not None:
                if setter := _SETTER.fullmatch(key):
                    open_.append(Pair(setter[1], None, depth, False))
                if _PUTS.fullmatch(key):
                    told[depth] = None
            key, row = None, None
            continue
        if kind == "shuts":
            named = key if own == "]" else None  # a subscript names what is assigned
            if depth:
                yield from close(depth)
                depth -= 1
                brackets.pop()
            key = named
            continue
        known, key = key, None
        if kind == "blank" or own in ";{}":
            yield from close(0)
            depth, brackets, row, told = 0, [], [], {}
        elif own == "," and now and now.depth == depth and now.others:
            name, *others = now.others
            yield from close(depth)
            open_.append(Pair(name, None, depth, False))
            open_[-1].others = others
        elif own == "," and told.get(depth):
            yield from close(depth)
            open_.append(Pair(told.pop(depth), None, depth, False))
        elif own == "\n" and now and not now.next_line and now.joined and not now.literals and not now.names and not now.body:
            now.next_line = True
        elif kind == "ends":
            yield from close(depth)
            if own == "\n":
                row = []
            elif not (row and row[-1] == known):
                row = None
        else:
            row = None
    yield from close(0)


def literal_spans(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name, and of passwords in URLs."""
    found: list[tuple[float, list[Token], list[int]]] = []  # sensitivity, literals, and earlier definitions, of each definition
    latest: dict[str, int] = {}
    label: str | None = None
    for pair in pairs(text):
        own = max(sensitivity(pair.name), sensitivity(pair.also) if pair.also else 0.0)
        low = pair.name.lower()
        if low in _VALUES and label:
            own = max(own, sensitivity(label))
        literals = list(pair.literals)
        used = []
        for name, start, end, bare in pair.names:
            if name in latest:
                used.append(latest[name])
            elif bare and own > 0 and re.search("[0-9]", name):
                literals.append((name, start, end))  # a bare word, as configuration files have them
        said = [x[0] for x in pair.literals] or [x[0] for x in pair.names]
        label = said[0] if low in _LABELS and len(said) == 1 else None
        for name in {pair.name, pair.also} - {None}:
            latest[name] = len(found)
        found.append((own, literals, used))
    reach = [own for own, _, _ in found]
    scored: dict[Token, float] = {(m[1], m.start(1), m.end(1)): strength(m[1]) for m in URL.finditer(text)} if "://" in text else {}
    for k in range(len(found) - 1, -1, -1):
        if reach[k] > 0:
            for other in found[k][2]:
                reach[other] = max(reach[other], reach[k])
            for x in found[k][1]:
                scored[x] = max(scored.get(x, 0.0), reach[k] * strength(x[0]))
    return sorted((a, b, s) for (_, a, b), s in scored.items() if s >= THRESHOLD)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed shapes."""
    low = text.lower()
    out = []
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def spans(text: str) -> list[tuple[int, int, int]]:
    """All spans by start and kind; literals that a fixed shape holds already are not added."""
    found = base_spans(text)
    low = text.lower()
    extra = []
    if "-----BEGIN " in text:
        extra += [(m.start(), 4, m.end()) for m in PEM.finditer(text)]
    if any(k in low for k in _STEMS) and any(c in text for c in "=:<(\"'") or "://" in text and "@" in text:
        reach, furthest, most = sorted((a, b) for a, _, b in found), [], 0
        for a, b in reach:
            most = max(most, b)
            furthest.append((a, most))
        for a, b, _ in literal_spans(text):
            k = bisect.bisect_right(furthest, (a, math.inf)) - 1
            if k < 0 or furthest[k][1] < b:
                extra.append((a, 3, b))
    return sorted(found + extra)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed shapes, digest of their spans, and all spans as text; no shuffle."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, shown = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                found = spans(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in found))
                hashes.append(hashlib.sha256(written([x for x in found if x[1] < 3]).encode()).hexdigest())
                shown.append(written(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(shown, pa.string())], names)

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
