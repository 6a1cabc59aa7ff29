"""Chat formatting by compiled templates.

A template is parsed into a syntax tree, constants in it are folded, and the tree becomes nested Python
closures; no code is generated as text and none of the host's objects is reachable from a template: values are
strings, numbers, booleans, None, lists and dicts, names and keys must not begin with an underscore, and there
are no calls but the filters listed here. Rendering is a generator of (text, in generation) pieces, so that a
conversation streams through turn by turn.

    {{ expr | filter }}  {% for x in expr %} {% endfor %}  {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% set name = expr %}  {% generation %} {% endgeneration %}  {# comment #}

Expressions: literals, names, a.b, a['b'], a[0], filters, not, and, or, ==, !=, <, <=, >, >=, in, +, ~ (join as
text), parentheses. In a loop, loop.index, loop.index0, loop.first and loop.last are known. A tag that ends in
`-%}` or begins with `{%-` takes the white space on that side away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
CHATML = (
    "{% for m in messages %}" + START + "{{ m.role | escape_role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + STOP + "\n{% endfor %}"
)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """No control string is left: each `<`, any backslashes, `|` gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """As escape, on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


FILTERS: dict[str, Callable] = {"escape": escape, "escape_role": escape_role, "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len}

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.\[\]()=,]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


class _Expression:
    """Recursive descent over one tag's tokens. Nodes are tuples: (kind, parts...)."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        while at < len(source.rstrip()):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        if self.peek()[0] in ("op", "name") and self.peek()[1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected in {self.source!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"a name expected in {self.source!r}")
        self.at += 1
        return value

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r} in {self.source!r}")

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.added()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            node = (op, node, self.added())
        return node

    def added(self):
        node = self.filtered()
        while op := self.take("+", "~"):
            node = (op, node, self.filtered())
        return node

    def filtered(self):
        node = self.value()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def value(self):
        kind, value = self.peek()
        if self.take("("):
            node = self.either()
            self.need(")")
        elif kind == "number":
            self.at += 1
            node = ("const", float(value) if "." in value else int(value))
        elif kind == "string":
            self.at += 1
            node = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        else:
            name = self.name()
            node = ("const", {"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else ("name", name)
        while op := self.take(".", "["):
            if op == ".":
                node = ("item", node, ("const", self.name()))
            else:
                node = ("item", node, self.either())
                self.need("]")
        return node


def parse(template: str) -> tuple:
    """The syntax tree: ("block", children) of text, out, for, if, set and generation nodes."""
    parts = _TAG.split(template)
    for i in range(1, len(parts), 2):
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    stack: list[tuple] = [("root", [])]

    def into(node) -> None:
        stack[-1][-1].append(node)

    for i, part in enumerate(parts):
        if i % 2 == 0:
            if part:
                into(("text", part))
            continue
        inner = part[2:-2].strip("-").strip() if part[:2] != "{#" else ""
        if part.startswith("{{"):
            e = _Expression(inner)
            into(("out", e.either()))
            e.end()
        elif part.startswith("{%"):
            e = _Expression(inner)
            word = e.name()
            if word == "for":
                name = e.name()
                e.need("in")
                stack.append(("for", name, e.either(), []))
            elif word == "if":
                stack.append(("if", [(e.either(), body := [])], body))
            elif word in ("elif", "else"):
                if stack[-1][0] != "if":
                    raise TemplateError(f"{word} without if")
                _, branches, _ = stack.pop()
                branches.append((e.either() if word == "elif" else ("const", True), body := []))
                stack.append(("if", branches, body))
            elif word == "set":
                name = e.name()
                e.need("=")
                into(("set", name, e.either()))
            elif word == "generation":
                stack.append(("generation", []))
            elif word in ("endfor", "endif", "endgeneration"):
                if stack[-1][0] != word[3:]:
                    raise TemplateError(f"{word} without {word[3:]}")
                into(stack.pop())
            else:
                raise TemplateError(f"unknown tag {word!r}")
            e.end()
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return ("block", stack[0][1])


_BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b)}


def fold(node):
    """The tree with constant parts computed, dead branches dropped and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "not":
        inner = fold(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind in ("and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind in _BINARY or kind == "item":
        a, b = fold(node[1]), fold(node[2])
        if kind in _BINARY and a[0] == b[0] == "const":
            return ("const", _BINARY[kind](a[1], b[1]))
        return (kind, a, b)
    if kind == "out":
        inner = fold(node[1])
        return ("text", _text(inner[1])) if inner[0] == "const" else ("out", inner)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(("block", node[3])))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "generation":
        return ("generation", fold(("block", node[1])))
    if kind == "if":
        branches = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            branches.append((test, fold(("block", body))))
            if test[0] == "const":
                break
        return branches[0][1] if branches and branches[0][0][0] == "const" else ("if", branches)
    out: list = []
    for child in node[1]:
        child = fold(child)
        for x in child[1] if child[0] == "block" else [child]:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return ("block", out)


def _value(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, x=node[1]: x
    if kind == "name":
        return lambda env, x=node[1]: env.get(x)
    if kind == "filter":
        f, inner = FILTERS[node[1]], _value(node[2])
        return lambda env: f(inner(env))
    if kind == "not":
        inner = _value(node[1])
        return lambda env: not inner(env)
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "item":

        def item(env):
            whole, key = a(env), b(env)
            if isinstance(whole, dict):
                return whole.get(key)
            if isinstance(whole, (list, str)) and isinstance(key, int):
                return whole[key] if -len(whole) <= key < len(whole) else None
            return None

        return item
    f = _BINARY[kind]
    return lambda env: f(a(env), b(env))


def _writer(node) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    kind = node[0]
    if kind == "text":

        def write(env, on, x=node[1]):
            yield x, on
    elif kind == "out":
        value = _value(node[1])

        def write(env, on):
            yield _text(value(env)), on
    elif kind == "set":
        value = _value(node[2])

        def write(env, on, name=node[1]):
            env[name] = value(env)
            yield from ()
    elif kind == "generation":
        body = _writer(node[1])

        def write(env, on):
            yield from body(env, True)
    elif kind == "if":
        branches = [(_value(test), _writer(body)) for test, body in node[1]]

        def write(env, on):
            for test, body in branches:
                if test(env):
                    yield from body(env, on)
                    return
    elif kind == "for":
        items, body = _value(node[2]), _writer(node[3])

        def write(env, on, name=node[1]):
            each = iter(items(env) or ())
            now, i = next(each, each), 0
            while now is not each:
                after = next(each, each)
                yield from body(env | {name: now, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is each}}, on)
                now, i = after, i + 1
    else:
        bodies = [_writer(x) for x in node[1]]

        def write(env, on):
            for body in bodies:
                yield from body(env, on)

    return write


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (dicts, taken one by one) and further names to pieces of (text, in generation)."""
    write = _writer(fold(parse(template)))
    return lambda messages, **names: write({**names, "messages": messages}, False)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(STOP) + "\n", re.S)


def turns_in(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from text that CHATML made; raises where it isn't such."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        found.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at character {at}")
    return found


PART = "conv_id long, part long, formatted string, loss array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))


def _formatted(template: str, part_chars: int):
    def rows(batches):
        render = compile_template(template)
        source = _rows(batches)
        row = next(source, None)
        out: list = []
        while row is not None:
            conv, turns = row[0], [0]
            ended: list = [None]

            def messages(first=row):
                now = first
                while now is not None and now[0] == conv:
                    turns[0] += 1
                    yield {"role": now[1] or "", "text": now[2] or ""}
                    now = next(source, None)
                ended[0] = now

            pieces, size, loss, part, seen = [], 0, [], 0, 0
            for text, on in render(messages()):
                # a part ends between turns, and holds at least one
                if turns[0] > seen and size >= part_chars:
                    out.append((conv, part, "".join(pieces), loss))
                    pieces, size, loss, part = [], 0, [], part + 1
                    yield _batch(out)
                    out = []
                seen = turns[0]
                if on and text:
                    if loss and loss[-1]["end"] == size:
                        loss[-1]["end"] += len(text)
                    else:
                        loss.append({"start": size, "end": size + len(text)})
                pieces.append(text)
                size += len(text)
            out.append((conv, part, "".join(pieces), loss))
            if len(out) >= 500:
                yield _batch(out)
                out = []
            row = ended[0]
        if out:
            yield _batch(out)

    return rows


def _batch(out: list) -> pa.RecordBatch:
    columns = list(zip(*out))
    return pa.record_batch([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), _SPANS))], names=["conv_id", "part", "formatted", "loss"])


def format_conversations(conversations: DataFrame, template: str = CHATML, part_chars: int = 1 << 20) -> DataFrame:
    """conv_id, part, formatted, loss: each conversation's text and, in characters of the part, its loss mask.

    A conversation is one part unless its text exceeds part_chars; then a part ends before the turn that would
    come next, and parts follow one another in their partition. Turns are taken by turn, then by role and text;
    repeated rows are repeated turns. Null texts and roles are empty. Rows without conv_id form a conversation.
    Empty table: no rows. Other columns are not read. Any turn but the longest is bounded memory: rows stream.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_formatted(template, part_chars), PART)


def _digested(batches):
    found: list = []
    conv = turns = loss = None
    n = [0, 0, 0]

    def done():
        found.append((conv, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2]))

    def flush():
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for own, part, text, spans in _rows(batches):
        if part == 0:
            if turns is not None:
                done()
            if len(found) >= 1000:
                yield flush()
                found.clear()
            conv, turns, loss, n = own, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        for role, body in turns_in(text):
            turns.update(f"{role}\n{body}\n".encode())
            n[0] += 1
        for x in spans:
            body = unescape(text[x["start"] : x["end"]])
            loss.update(body.encode())
            n[1] += len(body)
        n[2] += len(text)
    if turns is not None:
        done()
    if found:
        yield flush()


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of what its formatted text and its loss mask say. parts: as format_conversations returns them."""
    return parts.mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
