"""Chat formatting by compiled templates.

A template is parsed into a syntax tree, constants are folded, and the tree
becomes Python closures that yield pieces of output. The language is sandboxed by
what it lacks: no attribute of a Python object, no call and no import can be
written, only the variables below, literals, ``==``, ``!=``, ``and``, ``or``,
``not``, ``+`` and the filters in ``FILTERS``.

    {{ expression | filter }}      {# remark #}
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for message in messages %} ... {% endfor %}
    {% generation %} ... {% endgeneration %}       text that a model is trained on

Variables: ``message.role``, ``message.text``, ``loop.first``, ``loop.index``.

Rendering is a stream: messages come one after the other and pieces go out as they
are made, so a conversation of any length needs the memory of one turn. In Spark,
rows are dealt by conversation, sorted by turn, and every turn becomes one output
row with its part of the formatted text and the spans under the loss mask.

``escape`` puts an escape mark into every control string inside a text, so no
text can forge a turn; ``unescape`` undoes it exactly.

Defined cases: null text and role count as empty; null conversation ids are one
conversation and null turns come first; rows of the same turn go by role, then
text; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|role|>", "<|text|>")
MARK = "\\"
_controls = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    """Double every mark, and put ``\\.`` after the first character of every control string."""
    doubled = text.replace(MARK, MARK * 2)
    return _controls.sub(lambda m: m[0][0] + MARK + "." + m[0][1:], doubled)


_escaped = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "" if m[1] == "." else m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "trim": lambda t: t.strip(" \t\n\x0b\x0c\r"),
    "lower": str.lower,
    "upper": str.upper,
}

TEMPLATE = (
    "{% for message in messages %}{# one turn #}"
    "<s>{% if message.role == 'user' %}[INST] {% else %}{% endif %}"
    "<|role|>{{ message.role | escape }}<|text|>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{% if message.role == 'user' %} [/INST]{% endif %}</s>{% endfor %}"
)

_parts = re.compile(r"({{.*?}}|{%.*?%}|{#.*?#})", re.S)
_tokens = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_][A-Za-z_.]*)|(==|!=|[|+()]))")
NAMES = ("message.role", "message.text", "loop.first", "loop.index")


class TemplateError(ValueError):
    """The template is not in the language."""


# -- expressions: tuples (kind, ...) ---------------------------------------------------


class _Expression:
    def __init__(self, source: str):
        self.rest, self.source = [], source
        at = 0
        source = source.rstrip()
        while at < len(source):
            found = _tokens.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.rest.append(("text", found[1]) if found[1] else ("name", found[2]) if found[2] else ("op", found[3]))
            at = found.end()

    def take(self, *wanted: str) -> str | None:
        if self.rest and self.rest[0][0] != "text" and self.rest[0][1] in wanted:
            return self.rest.pop(0)[1]
        return None

    def parse(self) -> tuple:
        tree = self.either()
        if self.rest:
            raise TemplateError(f"unexpected {self.rest[0][1]!r} in {self.source!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.summed()
        sign = self.take("==", "!=")
        return (sign, tree, self.summed()) if sign else tree

    def summed(self) -> tuple:
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.single()
        while self.take("|"):
            name = self.rest.pop(0)[1] if self.rest else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def single(self) -> tuple:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(f"missing ) in {self.source!r}")
            return tree
        if not self.rest:
            raise TemplateError(f"missing value in {self.source!r}")
        kind, value = self.rest.pop(0)
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], value[1:-1]))
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name" and value in NAMES:
            return ("name", value)
        raise TemplateError(f"unknown {value!r}")


def _show(value) -> str:
    return value if isinstance(value, str) else str(value)


_binary = {
    "or": lambda a, b: a or b,
    "and": lambda a, b: a and b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: _show(a) + _show(b),
}


def _fold(tree: tuple) -> tuple:
    """Replace what is constant by its value."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        inner = _fold(tree[2])
        return ("const", FILTERS[tree[1]](_show(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    parts = [_fold(t) for t in tree[1:]]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(p[0] == "const" for p in parts):
        values = [p[1] for p in parts]
        return ("const", not values[0] if kind == "not" else _binary[kind](*values))
    return (kind, *parts)


def _closure(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env[n]
    if kind == "filter":
        apply, inner = FILTERS[tree[1]], _closure(tree[2])
        return lambda env: apply(_show(inner(env)))
    parts = [_closure(t) for t in tree[1:]]
    if kind == "not":
        return lambda env: not parts[0](env)
    if kind == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if kind == "or":
        return lambda env: parts[0](env) or parts[1](env)
    return lambda env, f=_binary[kind]: f(parts[0](env), parts[1](env))


# -- statements ------------------------------------------------------------------------


def parse(template: str) -> list[tuple]:
    """Syntax tree: a list of ("emit", e), ("if", [(e, body)...]), ("for", body), ("generation", body)."""
    pieces = [p for p in _parts.split(template) if p]

    def block(ends: tuple[str, ...], looping: bool) -> tuple[list[tuple], str]:
        out: list[tuple] = []
        while pieces:
            piece = pieces.pop(0)
            if piece.startswith("{#"):
                continue
            if piece.startswith("{{"):
                out.append(("emit", _Expression(piece[2:-2]).parse()))
                continue
            if not piece.startswith("{%"):
                out.append(("emit", ("const", piece)))
                continue
            words = piece[2:-2].strip()
            head = words.split(None, 1)[0] if words else ""
            if head in ends:
                return out, words
            if head == "if":
                arms, test = [], _Expression(words[2:]).parse()
                while True:
                    body, end = block(("elif", "else", "endif"), looping)
                    arms.append((test, body))
                    if end == "endif":
                        break
                    test = ("const", True) if end == "else" else _Expression(end[4:]).parse()
                out.append(("if", arms))
            elif words == "for message in messages":
                if looping:
                    raise TemplateError("loops do not nest")
                out.append(("for", block(("endfor",), True)[0]))
            elif words == "generation":
                out.append(("generation", block(("endgeneration",), looping)[0]))
            else:
                raise TemplateError(f"unknown statement {words!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return block((), False)[0]


def fold(tree: list[tuple]) -> list[tuple]:
    """Fold expressions, drop branches that cannot run, and join neighbouring constants."""
    out: list[tuple] = []

    def emit(node: tuple) -> None:
        if node[0] == "emit" and node[1][0] == "const":
            text = _show(node[1][1])
            if not text:
                return
            if out and out[-1][0] == "emit" and out[-1][1][0] == "const":
                node = ("emit", ("const", out.pop()[1][1] + text))
            else:
                node = ("emit", ("const", text))
        out.append(node)

    for node in tree:
        if node[0] == "emit":
            emit(("emit", _fold(node[1])))
        elif node[0] == "if":
            arms = []
            for test, body in node[1]:
                test = _fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold(body)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    emit(inner)
            elif arms:
                out.append(("if", arms))
        else:
            out.append((node[0], fold(node[1])))
    return out


Piece = tuple[str, bool]  # text, under the loss mask


def compiled(template: str) -> Callable[[Iterator[tuple[str, str]]], Iterator[Piece | None]]:
    """A renderer: from (role, text) pairs to pieces; ``None`` ends what belongs to a turn."""

    def body(nodes: list[tuple], loss: bool) -> Callable[[dict, Iterator], Iterator]:
        steps = [step(n, loss) for n in nodes]

        def run(env, messages):
            for one in steps:
                yield from one(env, messages)

        return run

    def step(node: tuple, loss: bool):
        kind = node[0]
        if kind == "emit":
            value = _closure(node[1])

            def run(env, messages):
                yield _show(value(env)), loss

        elif kind == "if":
            arms = [(_closure(t), body(b, loss)) for t, b in node[1]]

            def run(env, messages):
                for test, inner in arms:
                    if test(env):
                        yield from inner(env, messages)
                        return

        elif kind == "for":
            inner = body(node[1], loss)

            def run(env, messages):
                for i, (role, text) in enumerate(messages):
                    yield from inner({"message.role": role, "message.text": text, "loop.first": i == 0, "loop.index": i + 1}, messages)
                    yield None

        else:
            run = body(node[1], True)
        return run

    top = body(fold(parse(template)), False)
    empty = {"message.role": "", "message.text": "", "loop.first": True, "loop.index": 0}
    return lambda messages: top(empty, iter(messages))


def rendered(template: str, messages) -> tuple[str, list[tuple[int, int]]]:
    """Whole text and loss spans (start, end in code points) of one conversation."""
    text, spans, at = [], [], 0
    for piece in compiled(template)(messages):
        if piece:
            if piece[1]:
                spans.append((at, at + len(piece[0])))
            text.append(piece[0])
            at += len(piece[0])
    return "".join(text), spans


# -- Spark -----------------------------------------------------------------------------

FORMATTED = "conv_id long, part long, text string, spans array<int>"


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Consecutive rows of the same first field, as a stream of streams."""
    held = next(rows, None)
    while held is not None:
        key = held[0]

        def own():
            nonlocal held
            while held is not None and held[0] == key:
                row = held
                held = next(rows, None)
                yield row

        stream = own()
        yield key, stream
        for _ in stream:  # a reader that stopped early
            pass


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    """Few rows a batch, so long turns do not pile up."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row a turn, in order: conv_id, part, its formatted text and its loss spans as flat (start, end) pairs.

    What the template writes before the first turn goes with it, and what it
    writes after the last turn is a part of its own.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.int32()))])

    def run(batches):
        render = compiled(template)

        def parts():
            for key, rows in _conversations(_rows(batches)):
                text, spans, at, part = [], [], 0, 0
                for piece in render((role or "", body or "") for _, _, role, body in rows):
                    if piece is None:
                        yield key, part, "".join(text), spans
                        text, spans, at, part = [], [], 0, part + 1
                        continue
                    if piece[1]:
                        spans += [at, at + len(piece[0])]
                    text.append(piece[0])
                    at += len(piece[0])
                if text:
                    yield key, part, "".join(text), spans

        yield from _batched(parts(), schema)

    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, FORMATTED)


_turn = re.compile(r"<s>(?:\[INST\] )?<\|role\|>(.*?)<\|text\|>(.*?)(?: \[/INST\])?</s>", re.S)


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a text that the default template wrote."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(text)]


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from formatted parts in order: turns and loss text found in them, as digests."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def run(batches):
        def rows():
            for key, own in _conversations(_rows(batches)):
                turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, _, text, spans in own:
                    size += len(text)
                    for role, said in turns_of(text):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for start, end in zip(spans[::2], spans[1::2], strict=True):
                        plain = unescape(text[start:end])
                        loss.update(plain.encode())
                        chars += len(plain)
                yield key, n, turns.hexdigest(), chars, loss.hexdigest(), size

        yield from _batched(rows(), schema)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
