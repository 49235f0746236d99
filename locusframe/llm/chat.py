"""Chat formatting by a template compiler."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turns stand between <turn> and </turn>; what assistants say is under the loss mask.
TEMPLATE = (
    '{% for turn in turns %}{{ "<turn>" }}{{ turn.role | line }}{{ "\\n" }}'
    '{% if turn.role == "assistant" %}{% generation %}{{ turn.text | escape }}{% endgeneration %}'
    '{% else %}{{ turn.text | escape }}{% endif %}{{ "</" + "turn>\\n" }}{% endfor %}')
TURN = re.compile(r"<turn>([^<\\\n]*(?:\\.[^<\\\n]*)*)\n([^<\\]*(?:\\.[^<\\]*)*)</turn>\n", re.S)


def escape(text: str) -> str:
    """Control strings begin with <, which never stands unescaped in an escaped text."""
    return text.replace("\\", "\\\\").replace("<", "\\<")


def line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


class TemplateError(ValueError):
    pass


LEX = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.|+()\[\]]))""")
ESCAPES = {"n": "\n", "t": "\t"}


class Expression:
    """A recursive-descent parser; its trees are tuples whose head names the kind."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = LEX.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("unexpected end of an expression")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, word: str) -> None:
        if self.take()[1] != word:
            raise TemplateError(f"expected {word}")

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def chain(self, word: str, below: Callable[[], tuple]) -> tuple:
        tree = below()
        while self.peek() == word:
            self.take()
            tree = (word, tree, below())
        return tree

    def either(self) -> tuple:
        return self.chain("or", lambda: self.chain("and", self.negated))

    def negated(self) -> tuple:
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        tree = self.sum()
        if self.peek() in ("==", "!="):
            return (self.take()[1], tree, self.sum())
        return tree

    def sum(self) -> tuple:
        return self.chain("+", self.postfix)

    def postfix(self) -> tuple:
        tree = self.primary()
        while (word := self.peek()) in (".", "[", "|"):
            self.take()
            if word == "[":
                tree = ("item", tree, self.either())
                self.expect("]")
                continue
            kind, name = self.take()
            if kind != "name" or word == "|" and name not in FILTERS:
                raise TemplateError(f"no filter or attribute {name!r}")
            tree = ("item", tree, ("const", name)) if word == "." else ("filter", tree, name)
        return tree

    def primary(self) -> tuple:
        kind, word = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(word))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[word]) if word in ("true", "false", "none") else ("name", word)
        if word == "(":
            tree = self.either()
            self.expect(")")
            return tree
        raise TemplateError(f"unexpected {word!r}")


def parse(template: str) -> tuple:
    """The syntax tree: ("block", items) of text, print, if, for and generation nodes."""
    pieces = re.split(r"(\{%.*?%\}|\{\{.*?\}\})", template, flags=re.S)
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal at
        items: list[tuple] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                items.append(("print", Expression(piece[2:-2]).whole()))
            elif not piece.startswith("{%"):
                items.append(("print", ("const", piece)))
            else:
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return ("block", items), word
                if word == "generation":
                    items.append(("generation", block(("endgeneration",))[0]))
                elif word == "if":
                    yes, end = block(("else", "endif"))
                    items.append(("if", Expression(rest).whole(), yes, block(("endif",))[0] if end == "else" else ("block", [])))
                elif word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                    items.append(("for", m[1], Expression(m[2]).whole(), block(("endfor",))[0]))
                else:
                    raise TemplateError(f"unknown tag {piece!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return ("block", items), ""

    return block(())[0]


def fold(tree: tuple) -> tuple:
    """Constant folding: known expressions, tests with a known outcome, neighbouring constants."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "block":
        items: list[tuple] = []
        for x in map(fold, tree[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "print" and y[1][0] == "const":
                    if items and items[-1][0] == "print" and items[-1][1][0] == "const":
                        y = ("print", ("const", shown(items.pop()[1][1]) + shown(y[1][1])))
                    elif shown(y[1][1]) == "":
                        continue
                items.append(y)
        return ("block", items)
    if kind == "if":
        test = fold(tree[1])
        if test[0] == "const":
            return fold(tree[2] if test[1] else tree[3])
        return ("if", test, fold(tree[2]), fold(tree[3]))
    if kind == "for":
        return ("for", tree[1], fold(tree[2]), fold(tree[3]))
    if kind in ("print", "generation"):
        return (kind, fold(tree[1]))
    folded = (kind, *[fold(x) if isinstance(x, tuple) else x for x in tree[1:]])
    if kind == "item" or not all(x[0] == "const" for x in folded[1:] if isinstance(x, tuple)):
        return folded
    return ("const", value(folded)({}))


def shown(x: Any) -> str:
    return "" if x is None else str(x)


def value(tree: tuple) -> Callable[[dict], Any]:
    """A closure from the variables to an expression's value. Only listed filters and plain data are in reach."""
    kind = tree[0]
    if kind == "const":
        return lambda env, x=tree[1]: x
    if kind == "name":
        return lambda env, x=tree[1]: env.get(x)
    a = value(tree[1])
    if kind == "filter":
        return lambda env, f=FILTERS[tree[2]]: f(shown(a(env)))
    if kind == "not":
        return lambda env: not a(env)
    b = value(tree[2])
    if kind == "item":

        def item(env: dict) -> Any:
            box, key = a(env), b(env)
            if isinstance(box, dict):
                return box.get(key)
            return box[key] if isinstance(box, (list, tuple)) and isinstance(key, int) and key < len(box) else None

        return item
    return {
        "or": lambda env: a(env) or b(env), "and": lambda env: a(env) and b(env), "==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env),
        "+": lambda env: shown(a(env)) + shown(b(env)) if isinstance(a(env), str) or isinstance(b(env), str) else a(env) + b(env),
    }[kind]


def emit(tree: tuple) -> Callable[[dict, Output], None]:
    """A closure that writes a node."""
    kind = tree[0]
    if kind == "print":
        if tree[1][0] == "const":
            return lambda env, out, x=shown(tree[1][1]): out.write(x)
        show = value(tree[1])
        return lambda env, out: out.write(shown(show(env)))
    if kind == "block":
        steps = [emit(x) for x in tree[1]]

        def run(env: dict, out: Output) -> None:
            for step in steps:
                step(env, out)

        return run
    if kind == "if":
        test, yes, no = value(tree[1]), emit(tree[2]), emit(tree[3])
        return lambda env, out: (yes if test(env) else no)(env, out)
    if kind == "generation":
        inner = emit(tree[1])

        def marked(env: dict, out: Output) -> None:
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))

        return marked
    name, items, inner = tree[1], value(tree[2]), emit(tree[3])

    def loop(env: dict, out: Output) -> None:
        rows = items(env) or []
        for i, x in enumerate(rows):
            inner({**env, name: x, "loop": {"index": i + 1, "first": i == 0, "last": i == len(rows) - 1}}, out)

    return loop


@lru_cache(maxsize=16)
def compiled(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """Turns (dicts of role and text) to the formatted text and the spans of its generation marks."""
    write = emit(fold(parse(template)))

    def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        write({"turns": turns}, out)
        return "".join(out.parts), out.spans

    return render


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """Turns (role, text) of what TEMPLATE wrote, and the text under its marks, unescaped."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns, "".join(unescape(formatted[a:b]) for a, b in spans)


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Rows (conv_id, formatted, loss_spans array<struct<start, stop>>), one per conv_id of turns(conv_id, turn, role, text).

    Turns come in order of turn, null last; ties by role, then text. Null role or text counts as
    empty; rows without conv_id are one conversation. Repeated rows are turns of their own. An
    empty table gives no rows; other columns are not read. Spans count code points of `formatted`.
    A conversation is one value and so is put together in one task; nothing else is.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("none"), "turn", blank("role"), blank("text"))))
    chats = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.transform(rows, lambda x: F.struct(x["role"], x["text"])).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                done = [render([{"role": t["role"], "text": t["text"]} for t in x]) for x in b.column("turns").to_pylist()]
                spans = pa.array([[{"start": s, "stop": e} for s, e in x] for _, x in done], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([x for x, _ in done], pa.string()), spans], names=["conv_id", "formatted", "loss_spans"])

    return chats.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, formatted string, loss_spans array<struct<start:bigint,stop:bigint>>")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            out: list[tuple] = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                said, loss = read_back(text, [(s["start"], s["stop"]) for s in spans])
                out.append((len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), len(text)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                             names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return format_chats(turns.unionByName(extra)).mapInArrow(
        digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(text, '\', '\\'), '<', '\<') as et, replace(replace(replace(role, '\', '\\'), '<', '\<'), chr(10), '\n') as er from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(length(er) + length(et) + 15) as bigint) as formatted_chars
from e group by conv_id
"""
