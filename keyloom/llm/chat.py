"""Chat formatting by a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and Python closures are made of
it. They yield text segments lazily, each marked as generated or not, so a conversation of any
length is rendered turn by turn. The language: text, ``{{ expr }}``, ``{% for x in y %}``,
``{% if %} {% elif %} {% else %} {% endif %}``, ``{% generation %} {% endgeneration %}``;
expressions have strings, numbers, names, ``x.field``, ``loop.first/last/index0``, comparisons,
``and or not``, ``~`` and filters. Names reach only what is passed in and fields are dictionary
keys, so no attribute, call or import can be reached.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Strings that mark turns, which may not stand in a text as they are.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


@dataclass(frozen=True)
class Marks:
    """What stands before the first turn, before and after a turn's role, and after its text. All hold control strings."""

    start: str = "<s>"
    head: str = "[INST] "
    middle: str = " [/INST] "
    end: str = "</s>\n"

    def template(self) -> str:
        """A template of these marks. Only an assistant's text is generated."""
        return (
            f"{self.start}{{% for m in messages %}}{self.head}{{{{ m.role | escape }}}}{self.middle}"
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
            f"{self.end}{{% endfor %}}{{% if add_generation_prompt %}}{self.head}{{{{ 'assis' ~ 'tant' }}}}{self.middle}{{% endif %}}"
        )


#: The marks and the template of the registered query.
MARKS = Marks()
TEMPLATE = MARKS.template()
Segment = tuple[str, bool]


def escape(text: str) -> str:
    """Double every escape character, then break every control string after its first one."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len,
}


class TemplateError(ValueError):
    """The template can't be parsed, or it asks for something outside the sandbox."""


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|.()]))")


def _tokens(code: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while code[at:].strip():
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"unexpected {code[at:].strip()[:20]!r}")
        text, number, name, sign = m.groups()
        out.append(("const", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), text[1:-1])) if text else ("const", int(number)) if number else ("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent from tokens to nodes ('const', v), ('name', n), ('field', x, n), ..."""

    def __init__(self, code: str) -> None:
        self.left = _tokens(code)

    def parse(self) -> tuple:
        node = self.either()
        if self.left:
            raise TemplateError(f"unexpected {self.left[0][1]!r}")
        return node

    def take(self, *wanted: str) -> str | None:
        if self.left and self.left[0][0] != "const" and self.left[0][1] in wanted:
            return str(self.left.pop(0)[1])
        return None

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.inverse()
        while self.take("and"):
            node = ("and", node, self.inverse())
        return node

    def inverse(self) -> tuple:
        return ("not", self.inverse()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while sign := self.take("==", "!="):
            node = (sign, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.take("~"):
            node = ("~", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while sign := self.take(".", "|"):
            if not self.left or self.left[0][0] != "name":
                raise TemplateError(f"a name has to follow {sign}")
            name = str(self.left.pop(0)[1])
            if sign == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            if name.startswith("_"):
                raise TemplateError(f"{name} is outside the sandbox")
            node = ("field" if sign == "." else "filter", node, name)
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
            return node
        if not self.left or self.left[0][0] == "sign":
            raise TemplateError("an expression ends too early")
        kind, value = self.left.pop(0)
        if kind == "name" and str(value).startswith("_"):
            raise TemplateError(f"{value} is outside the sandbox")
        return ("const", {"true": True, "false": False, "none": None}[value]) if kind == "name" and value in ("true", "false", "none") else (kind, value)


def parse(template: str) -> list[tuple]:
    """The syntax tree: nodes text, out, for, if and generation."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(("out", _Expression(part[2:-2]).parse()))
            elif part.startswith("{%"):
                tag = part[2:-2].strip()
                word, _, rest = tag.partition(" ")
                if word in ends:
                    return nodes, tag
                if word == "for" and (m := re.fullmatch(r"([A-Za-z]\w*) in (.+)", rest.strip(), re.S)):
                    body, _ = block(("endfor",))
                    nodes.append(("for", m[1], _Expression(m[2]).parse(), body))
                elif word == "if":
                    arms, test = [], _Expression(rest).parse()
                    while True:
                        body, end = block(("elif", "else", "endif"))
                        arms.append((test, body))
                        if end == "endif":
                            break
                        test = ("const", True) if end == "else" else _Expression(end[4:]).parse()
                    nodes.append(("if", arms))
                elif word == "generation" and not rest:
                    nodes.append(("generation", block(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unknown tag {tag!r}")
            elif part:
                nodes.append(("text", part))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    return block(())[0]


def _string(value: object) -> str:
    return "" if value is None else str(value)


_PAIRS: dict[str, Callable[[object, object], object]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: _string(a) + _string(b),
}


def fold_expression(node: tuple) -> tuple:
    """The expression with everything computed that hangs on constants alone."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "field":
        return ("field", fold_expression(node[1]), node[2])
    parts = [fold_expression(x) for x in node[1:] if isinstance(x, tuple)]
    if kind == "filter":
        return ("const", FILTERS[node[2]](_string(parts[0][1]))) if parts[0][0] == "const" else ("filter", parts[0], node[2])
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(p[0] == "const" for p in parts):
        if kind == "not":
            return ("const", not parts[0][1])
        if kind in _PAIRS:
            return ("const", _PAIRS[kind](parts[0][1], parts[1][1]))
    return (kind, *parts)


def fold(nodes: list[tuple]) -> list[tuple]:
    """The tree with constants folded, dead arms cut and neighbouring texts joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "out":
            e = fold_expression(node[1])
            add(("text", _string(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        elif node[0] == "if":
            arms = []
            for test, body in ((fold_expression(t), fold(b)) for t, b in node[1]):
                if test[0] != "const" or test[1]:
                    arms.append((test, body))
                if test[0] == "const" and test[1]:
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        else:
            add(node)
    return out


def _closure(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if kind == "field":
        of, name = _closure(node[1]), node[2]

        def field(scope: dict) -> object:
            value = of(scope)
            return value.get(name) if isinstance(value, dict) else None

        return field
    if kind == "filter":
        of, f = _closure(node[1]), FILTERS[node[2]]
        return lambda scope: f(_string(of(scope)))
    parts = [_closure(x) for x in node[1:]]
    if kind == "not":
        return lambda scope: not parts[0](scope)
    if kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    pair = _PAIRS[kind]
    return lambda scope: pair(parts[0](scope), parts[1](scope))


def _ahead(items: Iterable) -> Iterator[tuple[object, bool]]:
    """Each item with whether it is the last."""
    source = iter(items)
    for held in source:
        for item in source:
            yield held, False
            held = item
        yield held, True


def _renderer(nodes: list[tuple]) -> Callable[[dict, bool], Iterator[Segment]]:
    steps: list[Callable[[dict, bool], Iterator[Segment]]] = []
    for node in nodes:
        if node[0] == "text":
            steps.append(lambda scope, made, t=node[1]: iter(((t, made),)))
        elif node[0] == "out":
            steps.append(lambda scope, made, f=_closure(node[1]): iter(((_string(f(scope)), made),)))
        elif node[0] == "generation":
            steps.append(lambda scope, made, r=_renderer(node[1]): r(scope, True))
        elif node[0] == "if":
            arms = [(_closure(t), _renderer(b)) for t, b in node[1]]

            def choose(scope: dict, made: bool, arms=arms) -> Iterator[Segment]:
                return next((r(scope, made) for t, r in arms if t(scope)), iter(()))

            steps.append(choose)
        else:

            def loop(scope: dict, made: bool, name=node[1], items=_closure(node[2]), body=_renderer(node[3])) -> Iterator[Segment]:
                for k, (item, last) in enumerate(_ahead(items(scope) or ())):
                    yield from body({**scope, name: item, "loop": {"first": k == 0, "last": last, "index0": k}}, made)

            steps.append(loop)

    def run(scope: dict, made: bool) -> Iterator[Segment]:
        for step in steps:
            yield from step(scope, made)

    return run


def compile_template(template: str) -> Callable[..., Iterator[Segment]]:
    """A function of names that yields (text, generated) segments lazily."""
    render = _renderer(fold(parse(template)))
    return lambda **names: render(names, False)


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
    for batch in batches:
        columns = [batch.column(i) for i in range(3)]
        for i in range(batch.num_rows):
            yield columns[0][i].as_py(), {"role": columns[1][i].as_py() or "", "text": columns[2][i].as_py() or ""}


def _grouped(rows: Iterable[tuple[object, dict]]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Neighbouring rows of one conversation, streamed."""
    from itertools import groupby

    for key, own in groupby(rows, key=lambda r: r[0]):
        yield key, (turn for _, turn in own)


#: Characters of segments in one batch.
BATCH_CHARS = 1 << 20


def formatter(template: str, prompt: bool, id_type: pa.DataType):
    """For mapInArrow over sorted (id, role, text): segments (id, first, text, generated)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows: list[tuple] = []
        chars = 0

        def batch() -> pa.RecordBatch:
            kinds = (id_type, pa.bool_(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "first", "text", "generated"])

        for key, messages in _grouped(_turns(batches)):
            first = True
            for text, made in render(messages=messages, add_generation_prompt=prompt):
                rows.append((key, first, text, made))
                first = False
                chars += len(text) + 64
                if chars > BATCH_CHARS:
                    yield batch()
                    rows, chars = [], 0
        if rows:
            yield batch()

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE, add_generation_prompt: bool = False, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted text of each conversation as consecutive segments (id, first, text, generated).

    ``first`` marks a conversation's first segment; the concatenation of its segments is its
    formatted text, those with ``generated`` are what a model is trained on. Segments of a
    conversation lie together and in order in a partition, so no conversation is ever held
    whole. Turns are ordered by turn, ties by role and text, nulls first; null roles and texts
    count as empty; rows with a null id form one conversation; repeated rows are turns of their
    own; an empty table gives no segments; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = turns.schema[id_col].dataType
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    return rows.mapInArrow(formatter(template, add_generation_prompt, to_arrow_type(kind)), f"id {kind.simpleString()}, first boolean, text string, generated boolean")


class _Reader:
    """Reads one conversation's segments back and keeps digests only."""

    def __init__(self, marks: Marks) -> None:
        self.marks = marks
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.open, self.started, self.made = "", False, ""

    def add(self, text: str, generated: bool) -> None:
        self.chars += len(text)
        if generated:
            self.made += text
        else:
            self._mask()
        self.open += text
        start, end = self.marks.start, self.marks.end
        if not self.started and len(self.open) >= len(start):
            if not self.open.startswith(start):
                raise ValueError("a conversation doesn't begin with its mark")
            self.open, self.started = self.open[len(start):], True
        while self.started and (at := self.open.find(end)) >= 0:
            turn, self.open = self.open[:at], self.open[at + len(end):]
            role, mark, body = turn.removeprefix(self.marks.head).partition(self.marks.middle)
            if not mark:
                raise ValueError("a turn has no mark")
            self.turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1

    def _mask(self) -> None:
        if self.made:
            text = unescape(self.made)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
            self.made = ""

    def result(self) -> tuple:
        self._mask()
        if self.open:
            raise ValueError("a conversation ends inside a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def reader(id_type: pa.DataType, marks: Marks = MARKS):
    """For mapInArrow over segments: one row of digests for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        key, now, out = None, None, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            ids, firsts, texts, made = (b.column(i).to_pylist() for i in range(4))
            for i in range(b.num_rows):
                if firsts[i]:
                    if now is not None:
                        out.append((key, *now.result()))
                    key, now = ids[i], _Reader(marks)
                now.add(texts[i], made[i])
            if len(out) > 10_000:
                yield batch()
                out = []
        if now is not None:
            out.append((key, *now.result()))
        if out:
            yield batch()

    return run


def read_back(segments: DataFrame, id_col: str = "conv_id", marks: Marks = MARKS) -> DataFrame:
    """Digests of each conversation, parsed from what ``format_conversations`` made by a template of ``marks``.

    Has to follow it directly, as the order of segments counts. Null ids, empty texts, ties and repeated
    turns are as they were formatted; no segments give no rows; a text without its marks raises.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = segments.schema["id"].dataType
    out = segments.mapInArrow(reader(to_arrow_type(kind), marks), f"id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", id_col)


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns whose texts are control strings themselves."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
