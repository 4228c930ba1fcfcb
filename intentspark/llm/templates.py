"""A small template language for chat formats, compiled to Python closures.

Text with ``{{ expression }}``, ``{% statement %}`` and ``{# comment #}``; a
``-`` inside a bracket trims the white space beside it. Statements: if / elif /
else, for, set, and generation (its output is what a model is to learn).
Expressions: strings, numbers, true, false, none, lists, names, ``a.b`` and
``a[b]``, ``x | filter(...)``, ``is [not] defined`` / ``none``, ``in``,
comparison, and / or / not, ``+ - * // % ~`` and ``a if c else b``.

It is closed: names are the given values and loop variables only, ``a.b`` reads
a key of a mapping or an item of a list (never an attribute of a Python
object), the filters are those given, nothing can be called, and there are
limits on a template's size and depth, on the rounds of its loops, on numbers
(64 bits) and on the texts it puts together.

Compiling goes source -> tokens -> syntax tree -> folded tree -> closures.
Folding evaluates what depends on constants only, drops branches never taken
and joins neighbouring texts.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable
from typing import Any, NamedTuple

MAX_SOURCE = 100_000
MAX_DEPTH = 64
#: Rounds of all loops in one rendering, and characters of a text put together by an operator.
MAX_ROUNDS = 10_000_000
MAX_TEXT = 1 << 28


class TemplateError(ValueError):
    """A template that can't be read, or that fails on its values."""


class Node(NamedTuple):
    """A node of the tree: its kind, and parts that are nodes, tuples of nodes or plain values."""

    kind: str
    parts: tuple = ()


# --- tokens

_TAG = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(r"""\s*(?:
    (?P<end>-?\}\}|-?%\})
  | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
  | (?P<number>\d+(?:\.\d+)?)
  | (?P<name>[A-Za-z_]\w*)
  | (?P<op>==|!=|<=|>=|//|[-+*%~<>|.,()\[\]=])
)""", re.X | re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _unquoted(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def scan(source: str) -> list[tuple[str, Any]]:
    """("text", str), ("print", tokens) and ("tag", tokens) in order; a token is (kind, value)."""
    if len(source) > MAX_SOURCE:
        raise TemplateError(f"a template is at most {MAX_SOURCE} characters long")
    out: list[tuple[str, Any]] = []
    at, trim = 0, False
    while True:
        found = _TAG.search(source, at)
        text = source[at:found.start()] if found else source[at:]
        text = text.lstrip() if trim else text
        if found and found[0].endswith("-"):
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if not found:
            return out
        at, trim = found.end(), False
        if found[0] == "{#":
            end = source.find("#}", at)
            if end < 0:
                raise TemplateError("a comment is not closed")
            at = end + 2
            continue
        tokens, closing = [], "}}" if found[0].startswith("{{") else "%}"
        while True:
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r} at {at}")
            at, kind = m.end(), m.lastgroup
            if kind == "end":
                if not m["end"].endswith(closing):
                    raise TemplateError(f"{closing} expected at {m.start('end')}")
                trim = m["end"].startswith("-")
                break
            tokens.append((kind, _unquoted(m[kind]) if kind == "string" else m[kind]))
        out.append(("print" if closing == "}}" else "tag", tokens))


# --- syntax tree

_KEYWORDS = {"and", "or", "not", "in", "is", "if", "else"}
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
#: Operators by precedence, loosest first, above "not".
_LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%"))


class _Expression:
    """A recursive-descent reader of one tag's tokens."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    def peek(self, *values: str) -> bool:
        if self.at >= len(self.tokens):
            return False
        kind, value = self.tokens[self.at]
        return kind in ("op", "name") and value in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            if (name := self.tokens[self.at - 1][1]) not in _KEYWORDS:
                return name
        raise TemplateError("a name expected")

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def ternary(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("an expression is nested too deeply")
        value = self.either()
        if self.take("if"):
            test = self.either()
            value = Node("choose", (test, value, self.ternary() if self.take("else") else Node("const", ("",))))
        self.depth -= 1
        return value

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = Node("or", (left, self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = Node("and", (left, self.negated()))
        return left

    def negated(self) -> Node:
        turns = 0
        while self.take("not"):
            turns += 1
        value = self.binary(0)
        return Node("not", (Node("not", (value,)),) if turns % 2 == 0 else (value,)) if turns else value

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while True:
            if level == 0 and self.peek("is"):
                left = self.test(left)
                continue
            if level == 0 and self.peek("not") and self.tokens[self.at + 1:self.at + 2] == [("name", "in")]:
                self.at += 2
                op = "not in"
            else:
                op = next((o for o in _LEVELS[level] if self.take(o)), None)
            if op is None:
                return left
            left = Node("binary", (op, left, self.binary(level + 1)))

    def test(self, value: Node) -> Node:
        self.need("is")
        negative = self.take("not")
        name = self.name()
        if name not in ("defined", "none"):
            raise TemplateError(f"unknown test {name!r}")
        found = Node(name, (value,))
        return Node("not", (found,)) if negative else found

    def unary(self) -> Node:
        turns = 0
        while self.take("-"):
            turns += 1
        value = self.postfix()
        return Node("minus", (value,)) if turns % 2 else value

    def postfix(self) -> Node:
        value = self.primary()
        while True:
            if self.take("."):
                value = Node("item", (value, Node("const", (self.name(),))))
            elif self.take("["):
                value = Node("item", (value, self.ternary()))
                self.need("]")
            elif self.take("|"):
                name, extra = self.name(), []
                if self.take("("):
                    extra = self.listed(")")
                value = Node("filter", (name, value, tuple(extra)))
            else:
                return value

    def listed(self, closing: str) -> list[Node]:
        found: list[Node] = []
        while not self.take(closing):
            if found:
                self.need(",")
            found.append(self.ternary())
        return found

    def primary(self) -> Node:
        if self.take("("):
            value = self.ternary()
            self.need(")")
            return value
        if self.take("["):
            return Node("list", (tuple(self.listed("]")),))
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        if kind == "name" and value in _CONSTANTS:
            self.at += 1
            return Node("const", (_CONSTANTS[value],))
        if kind == "name":
            return Node("name", (self.name(),))
        if kind not in ("string", "number"):
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        return Node("const", (value if kind == "string" else float(value) if "." in value else int(value),))


def _whole(tokens) -> Node:
    reader = _Expression(tokens)
    value = reader.ternary()
    reader.done()
    return value


class _Blocks:
    """The reader of statements."""

    def __init__(self, pieces: list[tuple[str, Any]]):
        self.pieces, self.at, self.depth = pieces, 0, 0

    def until(self, *ends: str) -> tuple[tuple[Node, ...], str, list]:
        """Nodes up to a tag of ``ends``, that tag's word and its other tokens."""
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("blocks are nested too deeply")
        nodes: list[Node] = []
        while self.at < len(self.pieces):
            kind, value = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Node("text", (value,)))
            elif kind == "print":
                nodes.append(Node("print", (_whole(value),)))
            else:
                word = value[0][1] if value else ""
                if word in ends:
                    self.depth -= 1
                    return tuple(nodes), word, value[1:]
                nodes.append(self.statement(word, value[1:]))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        self.depth -= 1
        return tuple(nodes), "", []

    def statement(self, word: str, rest: list) -> Node:
        if word == "if":
            return self.branch(rest)
        if word == "for":
            reader = _Expression(rest)
            name = reader.name()
            reader.need("in")
            values = reader.ternary()
            reader.done()
            return Node("for", (name, values, self.until("endfor")[0]))
        if word == "set":
            reader = _Expression(rest)
            name = reader.name()
            reader.need("=")
            value = reader.ternary()
            reader.done()
            return Node("set", (name, value))
        if word == "generation" and not rest:
            return Node("generation", (self.until("endgeneration")[0],))
        raise TemplateError(f"unknown statement {word!r}")

    def branch(self, rest: list) -> Node:
        test = _whole(rest)
        body, word, more = self.until("elif", "else", "endif")
        if word == "elif":
            return Node("if", (test, body, (self.branch(more),)))
        return Node("if", (test, body, self.until("endif")[0] if word == "else" else ()))


def parse(source: str) -> tuple[Node, ...]:
    return _Blocks(scan(source)).until()[0]


# --- folding

def names(node: Any) -> set[str]:
    """All names that a node reads."""
    if isinstance(node, Node):
        if node.kind == "name":
            return {node.parts[0]}
        return set().union(*map(names, node.parts)) if node.parts else set()
    return set().union(*map(names, node)) if isinstance(node, tuple) and node else set()


def _set_names(nodes: tuple) -> set[str]:
    """Names that statements give values to."""
    found = set()
    for n in nodes:
        if n.kind in ("set", "for"):
            found.add(n.parts[0])
        for part in n.parts:
            if isinstance(part, tuple) and part and isinstance(part[0], Node):
                found |= _set_names(part)
    return found


def fold_value(node: Node, constants: dict, filters: dict) -> Node:
    """The expression with all that depends on constants evaluated."""
    if node.kind == "name" and node.parts[0] in constants:
        return Node("const", (constants[node.parts[0]],))
    if node.kind in ("const", "name"):
        return node
    parts = tuple(fold_value(p, constants, filters) if isinstance(p, Node)
                  else tuple(fold_value(q, constants, filters) for q in p) if isinstance(p, tuple) else p
                  for p in node.parts)
    node = Node(node.kind, parts)
    first = parts[0] if parts else None
    if node.kind in ("and", "or", "choose") and first.kind == "const":  # the other side may not be constant
        taken = bool(first.parts[0])
        if node.kind == "choose":
            return parts[1] if taken else parts[2]
        return parts[1] if taken == (node.kind == "and") else first
    flat = [q for p in parts for q in (p if isinstance(p, tuple) and not isinstance(p, Node) else (p,)) if isinstance(q, Node)]
    if all(q.kind == "const" for q in flat):
        return Node("const", (_value(node, filters)({}),))
    return node


def fold(nodes: tuple[Node, ...], constants: dict, filters: dict) -> tuple[Node, ...]:
    """The statements with constant parts evaluated, dead branches dropped and texts joined."""
    out: list[Node] = []

    def add(node: Node) -> None:
        if node.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Node("text", (out[-1].parts[0] + node.parts[0],))
        elif node.kind != "text" or node.parts[0]:
            out.append(node)

    for node in nodes:
        if node.kind == "print":
            value = fold_value(node.parts[0], constants, filters)
            add(Node("text", (_shown(value.parts[0]),)) if value.kind == "const" else Node("print", (value,)))
        elif node.kind == "if":
            test = fold_value(node.parts[0], constants, filters)
            sides = [fold(n, constants, filters) for n in node.parts[1:]]
            if test.kind == "const":
                for n in sides[0 if test.parts[0] else 1]:
                    add(n)
            elif any(sides):
                add(Node("if", (test, *sides)))
        elif node.kind == "for":
            name, values, body = node.parts
            values = fold_value(values, constants, filters)
            inner = {k: v for k, v in constants.items() if k not in (name, "loop")}
            add(Node("for", (name, values, fold(body, inner, filters))))
        elif node.kind == "set":
            add(Node("set", (node.parts[0], fold_value(node.parts[1], constants, filters))))
        elif node.kind == "generation":
            add(Node("generation", (fold(node.parts[0], constants, filters),)))
        else:
            add(node)
    return tuple(out)


# --- closures

class _Missing:
    """What an unknown name gives: defined nowhere, prints as nothing, is false."""

    def __bool__(self) -> bool:
        return False

    def __eq__(self, other) -> bool:
        return isinstance(other, _Missing)

    __hash__ = None


MISSING = _Missing()


def _shown(value: Any) -> str:
    if value is None or value is MISSING:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, (bool, int, float)):
        return str(value)
    raise TemplateError("a list or mapping can't be printed")


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key, MISSING)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else MISSING
    return MISSING


def _numbers(op: Callable) -> Callable:
    def apply(a, b):
        if not all(isinstance(x, (int, float)) for x in (a, b)):
            raise TemplateError("a number expected")
        try:
            got = op(a, b)
        except ZeroDivisionError:
            raise TemplateError("division by zero") from None
        if abs(got) >= 1 << 63:
            raise TemplateError("a number beyond 64 bits")
        return got
    return apply


def _joined(a: str, b: str) -> str:
    if len(a) + len(b) > MAX_TEXT:
        raise TemplateError(f"a text of over {MAX_TEXT} characters")
    return a + b


def _plus(a, b):
    if isinstance(a, str) and isinstance(b, str):
        return _joined(a, b)
    return _numbers(operator.add)(a, b)


def _compared(op: Callable) -> Callable:
    def apply(a, b):
        try:
            return op(a, b)
        except TypeError:
            raise TemplateError("values of different kinds can't be ordered") from None
    return apply


def _within(a, b):
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    return isinstance(b, (list, tuple, dict)) and a in b


_BINARY: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": _compared(operator.lt), "<=": _compared(operator.le),
    ">": _compared(operator.gt), ">=": _compared(operator.ge), "in": _within, "not in": lambda a, b: not _within(a, b),
    "~": lambda a, b: _joined(_shown(a), _shown(b)), "+": _plus, "-": _numbers(operator.sub), "*": _numbers(operator.mul),
    "//": _numbers(operator.floordiv), "%": _numbers(operator.mod),
}

Value = Callable[[dict], Any]


def _value(node: Node, filters: dict) -> Value:
    """A closure from the names' values to the expression's value."""
    kind, parts = node
    if kind == "const":
        value = parts[0]
        return lambda env: value
    if kind == "name":
        name = parts[0]
        return lambda env: env.get(name, MISSING)
    if kind == "list":
        items = [_value(p, filters) for p in parts[0]]
        return lambda env: [f(env) for f in items]
    if kind == "filter":
        if parts[0] not in filters:
            raise TemplateError(f"unknown filter {parts[0]!r}")
        apply, subject, extra = filters[parts[0]], _value(parts[1], filters), [_value(p, filters) for p in parts[2]]
        return lambda env: apply(subject(env), *[f(env) for f in extra])
    if kind == "binary":
        op, a, b = _BINARY[parts[0]], _value(parts[1], filters), _value(parts[2], filters)
        return lambda env: op(a(env), b(env))
    inner = [_value(p, filters) for p in parts]
    a, b, c = (inner + [None, None])[:3]
    return {
        "item": lambda env: _item(a(env), b(env)),
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
        "not": lambda env: not a(env),
        "minus": lambda env: _numbers(operator.sub)(0, a(env)),
        "defined": lambda env: a(env) is not MISSING,
        "none": lambda env: a(env) is None,
        "choose": lambda env: b(env) if a(env) else c(env),
    }[kind]


class Output:
    """Rendered text, and the (start, end) spans that a model is to learn."""

    def __init__(self):
        self.pieces: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []
        self.inside = 0
        self.rounds = 0

    def add(self, text: str) -> None:
        if text:
            self.pieces.append(text)
            self.size += len(text)

    def text(self) -> str:
        return "".join(self.pieces)


Statement = Callable[[dict, Output], None]


def _statement(node: Node, filters: dict) -> Statement:
    kind, parts = node
    if kind == "text":
        text = parts[0]
        return lambda env, out: out.add(text)
    if kind == "print":
        value = _value(parts[0], filters)
        return lambda env, out: out.add(_shown(value(env)))
    if kind == "set":
        name, value = parts[0], _value(parts[1], filters)
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "if":
        test, yes, no = _value(parts[0], filters), _block(parts[1], filters), _block(parts[2], filters)
        return lambda env, out: yes(env, out) if test(env) else no(env, out)
    if kind == "for":
        name, values, body = parts[0], _value(parts[1], filters), _block(parts[2], filters)

        def loop(env: dict, out: Output) -> None:
            items = values(env)
            if not isinstance(items, (list, tuple)):
                raise TemplateError("a loop runs over a list")
            out.rounds += len(items)
            if out.rounds > MAX_ROUNDS:
                raise TemplateError(f"over {MAX_ROUNDS} rounds of loops")
            for i, item in enumerate(items):
                body(env | {name: item, "loop": position(i, len(items))}, out)  # what the body sets stays inside
        return loop
    body = _block(parts[0], filters)

    def generation(env: dict, out: Output) -> None:
        start = out.size
        out.inside += 1
        body(env, out)
        out.inside -= 1
        if not out.inside and out.size > start:
            out.spans.append((start, out.size))
    return generation


def _block(nodes: Iterable[Node], filters: dict) -> Statement:
    steps = [_statement(n, filters) for n in nodes]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)
    return run


def position(i: int, n: int) -> dict:
    """The values of ``loop`` in the i-th of n rounds."""
    return {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n}


FILTERS: dict[str, Callable] = {
    "trim": lambda x: _shown(x).strip(),
    "upper": lambda x: _shown(x).upper(),
    "lower": lambda x: _shown(x).lower(),
    "default": lambda x, other="": other if x is MISSING else x,
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else 0,
}


class Template:
    """A compiled template. ``constants`` are folded in, ``filters`` add to the
    built-in ones. ``render(messages)`` gives the text and the spans of a
    whole conversation."""

    def __init__(self, source: str, constants: dict | None = None, filters: dict | None = None):
        self.filters = FILTERS | (filters or {})
        raw = parse(source)
        constants = {k: v for k, v in (constants or {}).items() if k not in _set_names(raw)}
        self.tree = fold(raw, constants, self.filters)
        self._run = _block(self.tree, self.filters)
        self._turns()

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        self._run({"messages": messages}, out)
        return out.text(), out.spans

    def _turns(self) -> None:
        """Split the template at its one loop over ``messages``, if each turn can
        be rendered without the others: then ``by_turn`` holds."""
        loops = [i for i, n in enumerate(self.tree) if n.kind == "for" and n.parts[1] == Node("name", ("messages",))]
        self.by_turn = len(loops) == 1
        if not self.by_turn:
            return
        i = loops[0]
        before, (self._name, _, body), after = self.tree[:i], self.tree[i].parts, self.tree[i + 1:]
        self.by_turn = not {"messages"} & (names(before) | names(body) | names(after))
        silent = all(n.kind == "set" for n in before) and not after
        #: Whether a turn's output depends on its place in the conversation.
        self.uses_place = not silent or "loop" in names(body)
        self._before, self._body, self._after = (_block(n, self.filters) for n in (before, body, after))

    def render_turn(self, message: dict, index: int = 0, count: int = 1) -> tuple[str, list[tuple[int, int]]]:
        """What one turn adds to the conversation's text: the first with what
        stands before the loop, the last with what stands after it."""
        if not self.by_turn:
            raise TemplateError("a turn's output depends on other turns")
        out, env = Output(), {}
        self._before(env, out if index == 0 else Output())
        self._body(env | {self._name: message, "loop": position(index, count)}, out)
        if index == count - 1:
            self._after(env, out)
        return out.text(), out.spans
