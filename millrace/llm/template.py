"""A small, sandboxed template language for conversations, compiled to Python closures.

    {{ expression }}                       output
    {% for x in e %} ... {% else %} ... {% endfor %}     lists; also {% for a, b in e %}; loop.index, index0, first, last, length
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set x = expression %}
    {% generation %} ... {% endgeneration %}       what the model is to learn
    {# a comment #}

A minus inside a tag's ends ({%- -%}, {{- -}}, {#- -#}) takes the white space beside it away. Expressions have literals,
lists, names, keys and slices (m.role, m['role'], x[-1], x[1:]), not/and/or, comparisons, in, not in, tests (is defined, is
none, is string, is number, is boolean, is mapping, is iterable, each with not), a if b else c, + - * // %, ~, filters (x | trim, x | join(', '))
and the functions given (raise_exception(text)). They reach nothing else: no attributes of Python objects, no calls
but filters and functions given. Whatever is wrong with a template, when read or when rendered, is a TemplateError. A template becomes
a tree of tuples, constants are folded (neighbouring texts joined, branches with a known condition chosen), and each node
becomes a closure; rendering evaluates no text as code.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

_INSIDE = r"""((?:"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|(?!-?(?:END)).)*+)"""
TAG = re.compile(rf"\{{\{{(-?){_INSIDE.replace('END', r'\}\}')}(-?)\}}\}}|\{{%(-?){_INSIDE.replace('END', r'%\}')}(-?)%\}}|\{{\#(-?)(?:(?!-?\#\}}).)*+(-?)\#\}}", re.S)
TOKEN = re.compile(r"""\s*(?:(\d+(?:\.\d+)?)|("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[<>+~|.,:*%\[\]()-]))""", re.S)
#: Brackets, tags and operators may be nested so deep.
DEPTH = 60
CONSTANTS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template can't be read, or asks for what it may not reach."""


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _key(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError(f"no key {key!r} here")


def _slice(value: Any, ends: tuple) -> Any:
    if isinstance(value, (list, str)) and all(e is None or isinstance(e, int) for e in ends) and ends[2] != 0:
        return value[slice(*ends)]
    raise TemplateError("slices are of lists and texts, by whole numbers")


def _add(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list):
        return a + b
    return _number(lambda x, y: x + y)(a, b)


def _number(f: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    def of(a: Any, b: Any) -> Any:
        if not all(isinstance(x, (int, float)) for x in (a, b)):
            raise TemplateError("two numbers are wanted here")
        return f(a, b)

    return of


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "+": _add, "-": _number(lambda a, b: a - b), "*": _number(lambda a, b: a * b), "//": _number(lambda a, b: a // b),
    "%": _number(lambda a, b: a % b), "~": lambda a, b: _text(a) + _text(b), "key": _key, "slice": _slice,
}
#: Tests besides defined.
TESTS: dict[str, Callable[[Any], bool]] = {
    "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool),
    "mapping": lambda v: isinstance(v, dict), "iterable": lambda v: isinstance(v, (list, str, dict)),
}


class _Parser:
    """Expressions to tuples: ("lit", v), ("name", n), ("list", [e...]), ("bin", op, a, b), ("and"|"or", a, b), ("not", a), ("cond", test, a, b), ("is", test, a), ("filter", n, a, [e...]), ("call", n, [e...])."""

    def __init__(self, source: str):
        self.tokens, at, self.depth = [], 0, 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            number, string, name, sign = m.groups()
            self.tokens.append(("lit", float(number) if "." in number else int(number)) if number else ("lit", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)) if string else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted: str) -> str | None:
        kind, value = self.peek()
        if kind in ("sign", "name") and value in wanted:
            self.at += 1
            return value
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign} is missing")

    def whole(self) -> tuple:
        out = self.expression()
        if self.peek()[0] != "end":
            raise TemplateError(f"{self.peek()[1]!r} is left over")
        return out

    def expression(self) -> tuple:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deep")
        out = self.either()
        if self.take("if"):
            test = self.either()
            out = ("cond", test, out, self.expression() if self.take("else") else ("lit", None))
        self.depth -= 1
        return out

    def chain(self, part: Callable[[], tuple], make: Callable[[str, tuple, tuple], tuple], *ops: str) -> tuple:
        out, n = part(), 0
        while op := self.take(*ops):
            n += 1
            if n > DEPTH:
                raise TemplateError("nested too deep")
            out = make(op, out, part())
        return out

    def either(self) -> tuple:
        return self.chain(self.both, lambda op, a, b: (op, a, b), "or")

    def both(self) -> tuple:
        return self.chain(self.negated, lambda op, a, b: (op, a, b), "and")

    def negated(self) -> tuple:
        n = 0
        while self.take("not"):
            n += 1
        out = self.compared()
        return out if n == 0 else ("not", out) if n % 2 else ("not", ("not", out))

    def compared(self) -> tuple:
        out = self.sum()
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                out = ("bin", op, out, self.sum())
            elif self.peek() == ("name", "not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                out = ("bin", "not in", out, self.sum())
            elif self.take("is"):
                negative, (kind, test) = self.take("not"), self.peek()
                self.at += 1
                if kind != "name" or test not in TESTS and test not in ("defined", "undefined"):
                    raise TemplateError(f"no test {test!r}")
                out = ("is", "defined" if test == "undefined" else test, out)
                out = ("not", out) if bool(negative) != (test == "undefined") else out
            else:
                return out

    def sum(self) -> tuple:
        return self.chain(self.product, lambda op, a, b: ("bin", op, a, b), "+", "-", "~")

    def product(self) -> tuple:
        return self.chain(self.signed, lambda op, a, b: ("bin", op, a, b), "*", "//", "%")

    def signed(self) -> tuple:
        return ("bin", "-", ("lit", 0), self.filtered()) if self.take("-") else self.filtered()

    def arguments(self, end: str) -> list[tuple]:
        out: list[tuple] = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.expression())
        return out

    def filtered(self) -> tuple:
        out, n = self.keyed(), 0
        while self.take("|"):
            kind, name = self.peek()
            n += 1
            if kind != "name" or n > DEPTH:
                raise TemplateError("a filter's name is missing" if kind != "name" else "nested too deep")
            self.at += 1
            out = ("filter", name, out, self.arguments(")") if self.take("(") else [])
        return out

    def keyed(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "lit":
            out: tuple = ("lit", value)
        elif kind == "name" and self.take("("):
            out = ("call", value, self.arguments(")"))
        elif kind == "name":
            lower = value.lower() if value in ("True", "False", "None") else value
            out = ("lit", CONSTANTS[lower]) if lower in CONSTANTS else ("name", value)
        elif value == "(":
            out = self.expression()
            self.need(")")
        elif value == "[":
            out = ("list", self.arguments("]"))
        else:
            raise TemplateError("an expression is missing")
        n = 0
        while op := self.take(".", "["):
            n += 1
            if n > DEPTH:
                raise TemplateError("nested too deep")
            if op == "[":
                out = self.bracket(out)
            else:
                kind, name = self.peek()
                if kind != "name":
                    raise TemplateError("a key is missing")
                self.at += 1
                out = ("bin", "key", out, ("lit", name))
        return out

    def bracket(self, value: tuple) -> tuple:
        """A key or a slice, up to its closing bracket."""
        parts, none = [], ("lit", None)
        while True:
            parts.append(none if self.peek()[1] in (":", "]") and self.peek()[0] == "sign" else self.expression())
            if self.take("]"):
                break
            self.need(":")
        if len(parts) == 1:
            if parts[0] is none:
                raise TemplateError("a key is missing")
            return ("bin", "key", value, parts[0])
        if len(parts) > 3:
            raise TemplateError("a slice has three parts at most")
        return ("bin", "slice", value, ("list", [*parts, *[none] * (3 - len(parts))]))


def parse(source: str) -> tuple:
    """("block", [...]) of ("text", s), ("out", e), ("for", [name...], e, block, block), ("if", [(e, block)...]), ("set", name, e), ("gen", block)."""
    parts, at, strip, depth = [], 0, False, 0
    for m in TAG.finditer(source):
        before = source[at : m.start()]
        before = before.lstrip() if strip else before
        parts.append(("text", before.rstrip() if m[1] or m[4] or m[7] else before))
        strip = bool(m[3] or m[6] or m[8])
        if m[2] is not None or m[5] is not None:
            parts.append(("out", m[2]) if m[2] is not None else ("tag", m[5].strip()))
        at = m.end()
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    parts.reverse()

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal depth
        depth += 1
        if depth > DEPTH:
            raise TemplateError("nested too deep")
        try:
            return inside(ends)
        finally:
            depth -= 1

    def inside(ends: tuple[str, ...]) -> tuple[tuple, str]:
        body: list[tuple] = []
        while parts:
            kind, value = parts.pop()
            if kind == "text":
                if value:
                    body.append(("text", value))
                continue
            if kind == "out":
                body.append(("out", _Parser(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return ("block", body), value
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {value!r}")
                items = _Parser(m[2]).whole()
                inner, end = block(("else", "endfor"))
                body.append(("for", re.split(r"\s*,\s*", m[1]), items, inner, block(("endfor",))[0] if end == "else" else ("block", [])))
            elif word == "if":
                arms, test = [], _Parser(rest).whole()
                while True:
                    inner, end = block(("elif", "else", "endif"))
                    arms.append((test, inner))
                    if end.startswith("elif"):
                        test = _Parser(end[4:]).whole()
                    elif end == "else" and test != ("lit", True):
                        test = ("lit", True)
                    elif end == "endif":
                        break
                    else:
                        raise TemplateError(f"{end!r} is out of place")
                body.append(("if", arms))
            elif word == "set":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {value!r}")
                body.append(("set", m[1], _Parser(m[2]).whole()))
            elif word == "generation":
                body.append(("gen", block(("endgeneration",))[0]))
            else:
                raise TemplateError(f"no tag {word!r} here")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", body), ""

    return block(())[0]


def literals(node: tuple) -> list[str]:
    """Texts that the folded tree may write as they stand."""
    kind, *rest = node
    if kind == "text":
        return [rest[0]]
    inner = {"block": lambda: rest[0], "if": lambda: [b for _, b in rest[0]], "for": lambda: rest[2:], "gen": lambda: rest}.get(kind, list)()
    return [s for n in inner for s in literals(n)]


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """The same tree with all known values worked out."""
    kind, *rest = node
    known = lambda *es: all(e[0] == "lit" for e in es)
    if kind == "bin":
        a, b = fold(rest[1], filters), fold(rest[2], filters)
        return ("lit", BINARY[rest[0]](a[1], b[1])) if known(a, b) else ("bin", rest[0], a, b)
    if kind in ("and", "or"):
        a, b = (fold(e, filters) for e in rest)
        return (b if bool(a[1]) == (kind == "and") else a) if known(a) else (kind, a, b)
    if kind == "not":
        a = fold(rest[0], filters)
        return ("lit", not a[1]) if known(a) else ("not", a)
    if kind == "filter":
        if rest[0] not in filters:
            raise TemplateError(f"no filter {rest[0]!r}")
        a, more = fold(rest[1], filters), [fold(e, filters) for e in rest[2]]
        return ("lit", filters[rest[0]](a[1], *[e[1] for e in more])) if known(a, *more) else ("filter", rest[0], a, more)
    if kind == "list":
        es = [fold(e, filters) for e in rest[0]]
        return ("lit", [e[1] for e in es]) if known(*es) else ("list", es)
    if kind == "cond":
        test, a, b = (fold(e, filters) for e in rest)
        return (a if test[1] else b) if known(test) else ("cond", test, a, b)
    if kind == "is":
        a = fold(rest[1], filters)
        return ("lit", rest[0] == "defined" or TESTS[rest[0]](a[1])) if known(a) else ("is", rest[0], a)
    if kind == "call":
        return ("call", rest[0], [fold(e, filters) for e in rest[1]])
    if kind == "out":
        a = fold(rest[0], filters)
        return ("text", _text(a[1])) if known(a) else ("out", a)
    if kind == "block":
        body: list[tuple] = []
        for n in (fold(n, filters) for n in rest[0]):
            for n in n[1] if n[0] == "block" else [n]:
                if n[0] == "text" and body and body[-1][0] == "text":
                    body[-1] = ("text", body[-1][1] + n[1])
                elif n != ("text", ""):
                    body.append(n)
        return ("block", body)
    if kind == "if":
        arms = []
        for test, inner in rest[0]:
            test = fold(test, filters)
            if not known(test) or test[1]:
                arms.append((test, fold(inner, filters)))
            if known(test) and test[1]:
                break
        return arms[0][1] if arms and known(arms[0][0]) else ("if", arms) if arms else ("block", [])
    if kind == "for":
        return ("for", rest[0], *(fold(n, filters) for n in rest[1:]))
    if kind == "set":
        return ("set", rest[0], fold(rest[1], filters))
    if kind == "gen":
        return ("gen", fold(rest[0], filters))
    return node


class _Out:
    """Text written so far, and the spans under generation marks."""

    def __init__(self):
        self.parts, self.n, self.spans = [], 0, []

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.n += len(s)


def _defined(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], bool]:
    """Whether a name, or a key of a mapping that is defined, is there."""
    if node[0] == "name":
        return lambda names: node[1] in names
    if node[0] == "bin" and node[1] == "key":
        whole, inner, key = _defined(node[2], filters), _expression(node[2], filters), _expression(node[3], filters)

        def there(names):
            if not whole(names):
                return False
            value, k = inner(names), key(names)
            return k in value if isinstance(value, dict) else _key(value, k) is not None if isinstance(value, (list, str)) else False

        return there
    return lambda names: True


def _expression(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind, *rest = node
    if kind == "list":
        es = [_expression(e, filters) for e in rest[0]]
        return lambda names: [e(names) for e in es]
    if kind == "cond":
        test, a, b = (_expression(e, filters) for e in rest)
        return lambda names: a(names) if test(names) else b(names)
    if kind == "is":
        if rest[0] == "defined":
            return _defined(rest[1], filters)
        test, a = TESTS[rest[0]], _expression(rest[1], filters)
        return lambda names: test(a(names))
    if kind == "call":
        name, es = rest[0], [_expression(e, filters) for e in rest[1]]
        if name not in FUNCTIONS:
            raise TemplateError(f"no function {name!r}")
        return lambda names: FUNCTIONS[name](*[e(names) for e in es])
    if kind == "lit":
        value = rest[0]
        return lambda names: value
    if kind == "name":
        name = rest[0]
        return lambda names: names.get(name)
    if kind == "bin":
        op, a, b = BINARY[rest[0]], _expression(rest[1], filters), _expression(rest[2], filters)
        return lambda names: op(a(names), b(names))
    if kind == "filter":
        f, a, more = filters[rest[0]], _expression(rest[1], filters), [_expression(e, filters) for e in rest[2]]
        return lambda names: f(a(names), *[e(names) for e in more])
    if kind == "not":
        a = _expression(rest[0], filters)
        return lambda names: not a(names)
    a, b = _expression(rest[0], filters), _expression(rest[1], filters)
    return (lambda names: a(names) and b(names)) if kind == "and" else (lambda names: a(names) or b(names))


def _statement(node: tuple, filters: dict[str, Callable]) -> Callable[[dict, _Out], None]:
    kind, *rest = node
    if kind == "text":
        s = rest[0]
        return lambda names, out: out.write(s)
    if kind == "out":
        e = _expression(rest[0], filters)
        return lambda names, out: out.write(_text(e(names)))
    if kind == "set":
        name, e = rest[0], _expression(rest[1], filters)
        return lambda names, out: names.__setitem__(name, e(names))
    if kind == "gen":
        inner = _statement(rest[0], filters)

        def generation(names, out):
            start = out.n
            inner(names, out)
            out.spans.append((start, out.n))

        return generation
    if kind == "if":
        arms = [(_expression(t, filters), _statement(b, filters)) for t, b in rest[0]]

        def choose(names, out):
            for test, body in arms:
                if test(names):
                    return body(names, out)

        return choose
    if kind == "for":
        targets, e, body, other = rest[0], _expression(rest[1], filters), _statement(rest[2], filters), _statement(rest[3], filters)

        def loop(names, out):
            items = e(names)
            if not isinstance(items, list):
                raise TemplateError("for takes a list")
            if not items:
                other(names, out)
            for i, item in enumerate(items):
                if len(targets) > 1 and not (isinstance(item, list) and len(item) == len(targets)):
                    raise TemplateError(f"for takes lists of {len(targets)} here")
                told = dict(zip(targets, item if len(targets) > 1 else [item], strict=True))
                at = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items), "revindex": len(items) - i}
                body({**names, **told, "loop": at}, out)

        return loop
    steps = [_statement(n, filters) for n in rest[0]]

    def block(names, out):
        for step in steps:
            step(names, out)

    return block


def _refuse(text: Any = "") -> None:
    raise TemplateError(_text(text))


FUNCTIONS: dict[str, Callable] = {"raise_exception": _refuse, "range": lambda *ends: list(range(*ends))}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": len, "join": lambda v, by="": by.join(map(_text, v)),
    "default": lambda v, other="": other if v is None else v, "items": lambda v: [[k, x] for k, x in v.items()], "first": lambda v: _key(v, 0), "last": lambda v: _key(v, -1),
}


def tree(source: str, filters: dict[str, Callable] | None = None) -> tuple:
    """The folded tree of a template."""
    try:
        return fold(parse(source), FILTERS | (filters or {}))
    except (TypeError, AttributeError, KeyError, ValueError, ZeroDivisionError, OverflowError) as e:
        raise e if isinstance(e, TemplateError) else TemplateError(str(e)) from e


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """render(**names) -> (text, spans of code points under generation marks)."""
    run = _statement(tree(source, filters), FILTERS | (filters or {}))

    def render(**names: Any) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        try:
            run(names, out)
        except (TypeError, AttributeError, KeyError, ValueError, ZeroDivisionError, OverflowError) as e:
            raise e if isinstance(e, TemplateError) else TemplateError(str(e)) from e
        return "".join(out.parts), out.spans

    return render
