"""Chat formatting by a template compiler.

A template in a small sandboxed language is parsed to a syntax tree, its constants are folded, and Python closures
are generated from it; they render a conversation and record which characters are under the loss mask. The language
has no calls, no attributes of objects and no loop but the one over turns, so a template can reach nothing but the
values given to it:

    {{ expr }}                      output
    {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% set name = expr %}           within the loop for that turn alone
    {% for turn in turns %} {% endfor %}   once, not inside another tag; any name for the turn, "messages" for turns
    {% generation %} {% endgeneration %}   what is inside is under the loss mask
    {# remark #}, and {%- -%} {{- -}}, which take white space away on their side
    expr: 'text', numbers, true, false, names, ==, !=, and, or, not, +, ( ), expr | filter
    names: turn.role, turn.text (or turn['role'], turn.content), loop.first, loop.last, names set before, values given
    filters: trim, upper, lower, escape; a name whose set was not reached is empty

What stands before and after the loop depends on constants and given values alone, so it is rendered when the template
is compiled; it goes with the first and the last turn. Turns are thus rendered apart, and a conversation is never held
whole: rows stream in order and only digests are carried on. A template without a loop is what a loop would hold, and
has role, text, first and last as names.

Control strings inside texts are escaped reversibly: the escape sign (by default "\\x1a", SUB) is put after the first
character of each control string, and doubled where the text itself has it at such a place (see `Escaper`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read

TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[()|+=.\[\]]))")
PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
FILTERS: dict[str, Callable[[str], str]] = {"trim": lambda s: s.strip(), "upper": lambda s: s.upper(), "lower": lambda s: s.lower()}
NAMES = {"role", "text", "first", "last"}
FIELDS = {"role": "role", "text": "text", "content": "text"}
LOOP = {"first": "first", "last": "last"}


class TemplateError(ValueError):
    pass


# -- syntax tree: tuples ("const", v), ("name", n), ("op", sign, a, b), ("not", a), ("filter", name, a),
#    ("out", e), ("if", [(cond, body)], other), ("set", name, e), ("mask", body), ("turns", body)


def parts_of(source: str) -> list[str]:
    """Texts and tags, remarks taken away and white space beside tags where their signs say so."""
    out, strip = [], False
    for part in PART.split(source):
        tag = part[:2] in ("{{", "{%", "{#") and len(part) >= 4
        if not tag:
            out.append(part.lstrip() if strip else part)
            strip = False
            continue
        start, end = (2, -2)
        if part[2] == "-" and len(part) > 4:
            out[-1:] = [out[-1].rstrip()] if out else []
            start = 3
        strip = part[-3] == "-" and len(part) - 2 > start
        if strip:
            end = -3
        if part[1] != "#":
            out.append(part[:2] + part[start:end] + part[-2:])
        else:
            out.append("")
    return [p for p in out if p]


class Parser:
    def __init__(self, source: str, values: dict | None = None):
        self.parts = parts_of(source)
        self.at = 0
        self.values = dict(values or {})
        self.loop = self.turn = None  # whether the loop has been met, and the turn's name while inside it
        self.inside = 0  # tags that are open
        self.known = set() if any(re.match(r"\{%\s*for\b", p) for p in self.parts) else set(NAMES)
        if taken := set(self.values) & (NAMES | {"loop", "true", "false"}):
            raise TemplateError(f"names that cannot be given: {sorted(taken)}")

    def body(self, *ends: str) -> tuple[list[tuple], str]:
        """Nodes up to one of these tags, and that tag's content."""
        out: list[tuple] = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{"):
                out.append(("out", self.expression(part[2:-2])))
            elif part.startswith("{%"):
                tag = part[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return out, tag
                out.append(self.statement(word, tag[len(word) :]))
            else:
                out.append(("out", ("const", part)))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return out, ""

    def statement(self, word: str, rest: str) -> tuple:
        self.inside += 1
        try:
            return self.turns(rest) if word == "for" else self.plain(word, rest)
        finally:
            self.inside -= 1

    def turns(self, rest: str) -> tuple:
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(?:turns|messages)\s*", rest)
        if not m or self.loop or self.inside > 1 or m[1] in self.known | set(self.values) | {"loop"}:
            raise TemplateError(f"bad loop: {rest}")
        self.loop, self.turn, before = True, m[1], set(self.known)
        out = ("turns", self.body("endfor")[0])
        self.turn, self.known = None, before
        return out

    def plain(self, word: str, rest: str) -> tuple:
        if word == "if":
            arms, cond = [], self.expression(rest)
            while True:
                inner, tag = self.body("elif", "else", "endif")
                arms.append((cond, inner))
                if tag.startswith("elif"):
                    cond = self.expression(tag[4:])
                    continue
                other = self.body("endif")[0] if tag == "else" else []
                return ("if", arms, other)
        if word == "set":
            name, sign, value = rest.partition("=")
            if not sign or not name.strip().isidentifier() or name.strip() in NAMES | {"loop", "true", "false", self.turn} | set(self.values):
                raise TemplateError(f"bad set: {rest}")
            node = ("set", name.strip(), self.expression(value))
            self.known.add(name.strip())
            return node
        if word == "generation":
            return ("mask", self.body("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    def expression(self, source: str) -> tuple:
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        out = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return out

    def take(self, *values: str) -> str | None:
        if self.tokens and self.tokens[0][0] != "str" and self.tokens[0][1] in values:
            return self.tokens.pop(0)[1]
        return None

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("op", "or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("op", "and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.added()
        while sign := self.take("==", "!="):
            left = ("op", sign, left, self.added())
        return left

    def added(self) -> tuple:
        left = self.filtered()
        while self.take("+"):
            left = ("op", "+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        out = self.atom()
        while self.take("|"):
            kind, name = self.tokens.pop(0) if self.tokens else ("", "")
            if kind != "name" or name not in FILTERS and name != "escape":
                raise TemplateError(f"unknown filter {name!r}")
            out = ("filter", name, out)
        return out

    def atom(self) -> tuple:
        if not self.tokens:
            raise TemplateError("expression ends early")
        kind, value = self.tokens.pop(0)
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), value[1:-1]))
        if kind == "num":
            return ("const", int(value))
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name" and self.turn and value in (self.turn, "loop"):
            return ("name", self.field(FIELDS if value == self.turn else LOOP))
        if kind == "name" and value in self.values:
            return ("const", self.values[value])
        if kind == "name" and value in self.known:
            return ("name", value)
        if value == "(":
            out = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return out
        raise TemplateError(f"unexpected {value!r}")


    def field(self, fields: dict[str, str]) -> str:
        """The field named by what follows: .name or ['name']."""
        sign, (kind, name) = self.take(".", "["), self.tokens.pop(0) if self.tokens else ("", "")
        if kind == "str" and sign == "[":
            name = name[1:-1]
        if not sign or kind != ("name" if sign == "." else "str") or name not in fields or sign == "[" and not self.take("]"):
            raise TemplateError(f"unknown field {name!r}")
        return fields[name]


def text_of(value) -> str:
    return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: text_of(a) + text_of(b)}


def folded(node: tuple, filters: dict) -> tuple:
    """The same expression with constant parts computed."""
    kind = node[0]
    if kind == "op":
        a, b = folded(node[2], filters), folded(node[3], filters)
        if node[1] in ("and", "or"):
            if a[0] == "const":
                return b if bool(a[1]) == (node[1] == "and") else a
        elif a[0] == b[0] == "const":
            return ("const", OPS[node[1]](a[1], b[1]))
        return ("op", node[1], a, b)
    if kind == "not":
        a = folded(node[1], filters)
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = folded(node[2], filters)
        return ("const", filters[node[1]](text_of(a[1]))) if a[0] == "const" else ("filter", node[1], a)
    return node


def folded_body(nodes: list[tuple], filters: dict) -> list[tuple]:
    """Statements with constant conditions decided and neighbouring constant outputs joined."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "out":
            node = ("out", folded(node[1], filters))
            if node[1][0] == "const":
                node = ("out", ("const", text_of(node[1][1])))
                if out and out[-1][0] == "out" and out[-1][1][0] == "const":
                    node = ("out", ("const", out.pop()[1][1] + node[1][1]))
            out.append(node)
        elif node[0] == "if":
            arms, other = [], folded_body(node[2], filters)
            for cond, body in node[1]:
                cond, body = folded(cond, filters), folded_body(body, filters)
                if cond[0] != "const":
                    arms.append((cond, body))
                elif cond[1]:
                    other = body
                    break
            out.extend([("if", arms, other)] if arms else other)
        elif node[0] == "set":
            out.append(("set", node[1], folded(node[2], filters)))
        else:
            out.append((node[0], folded_body(node[1], filters)))
    return out


def value_closure(node: tuple, filters: dict) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n, "")
    if kind == "not":
        return lambda env, a=value_closure(node[1], filters): not a(env)
    if kind == "filter":
        return lambda env, f=filters[node[1]], a=value_closure(node[2], filters): f(text_of(a(env)))
    a, b = value_closure(node[2], filters), value_closure(node[3], filters)
    if node[1] == "and":
        return lambda env: a(env) and b(env)
    if node[1] == "or":
        return lambda env: a(env) or b(env)
    return lambda env, op=OPS[node[1]]: op(a(env), b(env))


def body_closure(nodes: list[tuple], filters: dict) -> Callable[[dict, list, bool], None]:
    """A closure that appends (text, masked) pieces."""
    steps = []
    for node in nodes:
        if node[0] == "out":
            steps.append(lambda env, out, mask, v=value_closure(node[1], filters): out.append((text_of(v(env)), mask)))
        elif node[0] == "set":
            steps.append(lambda env, out, mask, n=node[1], v=value_closure(node[2], filters): env.__setitem__(n, v(env)))
        elif node[0] == "mask":
            steps.append(lambda env, out, mask, b=body_closure(node[1], filters): b(env, out, True))
        else:
            arms = [(value_closure(c, filters), body_closure(b, filters)) for c, b in node[1]]
            other = body_closure(node[2], filters)

            def branch(env, out, mask, arms=arms, other=other):
                for cond, body in arms:
                    if cond(env):
                        return body(env, out, mask)
                return other(env, out, mask)

            steps.append(branch)

    def run(env, out, mask):
        for step in steps:
            step(env, out, mask)

    return run


class Escaper:
    """Reversible: after it, no control string occurs in a text.

    Every run of escape signs that follows a control string's first character gets one more sign where the control
    string's rest follows. Undoing takes that one sign away. A first character followed by n signs and the rest thus
    becomes one with n + 1 signs, for n = 0, 1, 2 ..., so nothing is ambiguous.
    """

    def __init__(self, controls: list[str], sign: str = "\x1a"):
        if any(len(c) < 2 or sign in c for c in controls):
            raise TemplateError("control strings need two characters and must not hold the escape sign")
        # the rest is looked ahead for, so that overlapping control strings are all broken
        each = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(sign)}*{re.escape(c[1:])})" for c in sorted(controls))
        back = "|".join(f"(?<={re.escape(c[0])}){re.escape(sign)}(?={re.escape(sign)}*{re.escape(c[1:])})" for c in sorted(controls))
        self.sign, self.add, self.remove = sign, re.compile(each or "(?!)"), re.compile(back or "(?!)")

    def escape(self, text: str) -> str:
        return self.add.sub(self.sign, text)

    def restore(self, text: str) -> str:
        return self.remove.sub("", text)


def compile_template(source: str, controls: list[str], values: dict | None = None) -> Callable[[dict], list[tuple[str, bool]]]:
    """A closure that renders one turn (role, text, first, last) to (text, under the loss mask) pieces.

    values: texts, numbers and booleans by name, which are constants of the template. The pieces of a conversation's
    turns, one after the other, are the conversation.
    """
    parser = Parser(source, values)
    filters = FILTERS | {"escape": Escaper(controls).escape}
    nodes = folded_body(parser.body()[0], filters)
    at = next((i for i, n in enumerate(nodes) if n[0] == "turns"), None)
    before, each, after = ([], nodes, []) if at is None else (nodes[:at], nodes[at][1], nodes[at + 1 :])
    run, env = body_closure(each, filters), {}
    head: list[tuple[str, bool]] = []
    tail: list[tuple[str, bool]] = []
    body_closure(before, filters)(env, head, False)
    seen = dict(env)
    body_closure(after, filters)(env, tail, False)

    def render(turn: dict) -> list[tuple[str, bool]]:
        out = list(head) if turn["first"] else []
        run(seen | turn, out, False)
        return [p for p in (out + tail if turn["last"] else out) if p[0]]

    return render


#: The template of the query and its control strings. A turn begins with its role between marks and ends with a mark;
#: the loss covers each assistant text.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
TEMPLATE = (
    "<s>{% for turn in turns %}"
    "{% set mark = '[ROLE]' + turn.role | escape + '[/ROLE]' %}{{ mark }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ turn.text | escape }}[/INST]{% endif %}</s>"
    "{% endfor %}"
)
TURN = re.compile(r"(?:<s>)?\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.S)


def read_back(output: str, escaper: Escaper) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted output."""
    out, at = [], 0
    while at < len(output):
        if not (m := TURN.match(output, at)):
            raise ValueError("output cannot be read back")
        body = m[2]
        if body.startswith("[INST]"):
            body = body[len("[INST]") : -len("[/INST]")]
        out.append((escaper.restore(m[1]), escaper.restore(body)))
        at = m.end()
    return out


def format_turns(conversations: DataFrame, template: str = TEMPLATE, controls: list[str] = CONTROLS, values: dict | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, formatted text and the spans of it under the loss mask.

    A conversation's output is its rows' formatted texts, by turn, end to end. Turns are rendered where they lie; only
    the conversation's first and last turn numbers are joined to them, so a conversation of any length, even one with
    a third of all rows, is spread over all tasks. Null texts and roles are empty; turns are ordered by turn (nulls
    first), then role, then text, so ties have a fixed order; copies of a repeated first or last row are all marked so; a null conv_id is a conversation of its own;
    an empty table gives an empty table; other columns are not read.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct("turn", "role", "text")
    ends = rows.groupBy(F.col("conv_id").alias("of")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    marked = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "turn", "role", "text", key.eqNullSafe(F.col("lo")).alias("first"), key.eqNullSafe(F.col("hi")).alias("last"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        render = compile_template(template, controls, values)
        for batch in batches:
            texts, masks = [], []
            for turn in batch.to_pylist():
                pieces = render(turn)
                at, spans = 0, []
                for text, masked in pieces:
                    if masked:
                        spans.append({"start": at, "end": at + len(text)})
                    at += len(text)
                texts.append("".join(p for p, _ in pieces))
                masks.append(spans)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), batch.column("text"), pa.array(texts, pa.string()), pa.array(masks, span)], ["conv_id", "turn", "role", "text", "formatted", "loss"])

    return marked.mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, formatted string, loss array<struct<start:long,end:long>>")


def digests(formatted: DataFrame, controls: list[str] = CONTROLS) -> DataFrame:
    """One row per conversation, read back from the formatted turns.

    Rows are dealt by conversation, sorted and streamed: a digest is carried from row to row, so that no task holds
    more than one batch, however long a conversation is.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    # parts have a few rows to carry at most; the shuffle holds the formatted text once
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss")

    arrow = to_arrow_type(formatted.schema["conv_id"].dataType)

    def run(batches):
        escaper = Escaper(controls)
        state = None  # conversation, turns, digest of turns, loss characters, digest of them, characters

        def row(s):
            return {"conv_id": s[0], "n_turns": s[1], "turns_sha256": s[2].hexdigest(), "loss_chars": s[3], "loss_sha256": s[4].hexdigest(), "formatted_chars": s[5]}

        schema = pa.schema([("conv_id", arrow), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            done = []
            for conv, output, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(output, escaper):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = escaper.restore(output[span["start"] : span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(output)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(state)], schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return digests(format_turns(rows.unionByName(more)))


OP10_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc as (
  select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '<(\x1A*s>)', '<' || chr(26) || '\1', 'g'), '<(\x1A*/s>)', '<' || chr(26) || '\1', 'g'),
    '\[(\x1A*INST\])', '[' || chr(26) || '\1', 'g'), '\[(\x1A*/INST\])', '[' || chr(26) || '\1', 'g'),
    '\[(\x1A*ROLE\])', '[' || chr(26) || '\1', 'g'), '\[(\x1A*/ROLE\])', '[' || chr(26) || '\1', 'g') e
  from rows)
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(3 + sum(length(e) + length(role) + length('[ROLE][/ROLE]</s>') + case when role = 'assistant' then 0 else length('[INST][/INST]') end) as bigint) formatted_chars
from esc group by conv_id
"""
