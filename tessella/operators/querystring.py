"""A query-string language for filters, compiled to one Column.

    or    := and (("||" | "OR") and)*
    and   := unary (("&&" | "AND")? unary)*            juxtaposition is AND
    unary := ("NOT" | "!" | "-" | "+")? (field ":" value | value | "(" or ")")
    value := term | "phrase" | * | >n | >=n | <n | <=n | [a TO b] | {a TO b} | "(" or ")"

Backslash escapes one character; * and ? in a term are wildcards. Field names are matched without case. A list-valued
field matches if any of its elements does. A value that is no number never matches a numeric field, rather than
failing. A term without a field is looked for as a whole word, without case, in the text columns given.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"""\s*(?:
      (?P<op>\|\||&&|\(|\)|!(?=\S)|[-+](?=[^\s\d]))
    | (?P<range>[\[{][^\]}]*\bTO\b[^\]}]*[\]}])
    | (?P<phrase>"(?:\\.|[^"\\])*")
    | (?P<compare>[<>]=?\s*(?:\\.|[^\s()])+)
    | (?P<term>(?:\\.|[^\s()":<>|&]|\|(?!\|)|&(?!&))+)
    | (?P<colon>:)
    )""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not, all, term, phrase, compare, range
    field: str | None = None
    value: str = ""
    parts: tuple[Node, ...] = ()


def lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = TOKEN.match(query, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read the query at {query[at : at + 20]!r}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


class Parser:
    def __init__(self, query: str):
        self.tokens, self.at = lex(query), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def parse(self) -> Node:
        if not self.tokens:
            return Node("all")
        node = self.either(None)
        if self.peek()[0] != "end":
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self, field: str | None) -> Node:
        parts = [self.both(field)]
        while self.peek() in (("op", "||"), ("term", "OR")):
            self.take()
            parts.append(self.both(field))
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    def both(self, field: str | None) -> Node:
        parts = [self.unary(field)]
        while self.peek()[0] != "end" and self.peek() not in (("op", ")"), ("op", "||"), ("term", "OR")):
            if self.peek() in (("op", "&&"), ("term", "AND")):
                self.take()
            parts.append(self.unary(field))
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def unary(self, field: str | None) -> Node:
        kind, text = self.peek()
        if (kind, text) in (("op", "!"), ("op", "-"), ("term", "NOT")):
            self.take()
            return Node("not", parts=(self.unary(field),))
        if (kind, text) == ("op", "+"):
            self.take()
            return self.unary(field)
        if (kind, text) == ("op", "("):
            self.take()
            node = self.either(field)
            if self.take() != ("op", ")"):
                raise ValueError("a parenthesis is not closed")
            return node
        if kind == "term" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] == "colon":
            self.take()
            self.take()
            return self.unary(unescape(text))
        if kind in ("term", "phrase", "compare", "range"):
            self.take()
            if kind == "term" and text == "*":
                return Node("all", field)
            return Node(kind, field, text)
        raise ValueError(f"unexpected {text or 'end of the query'!r}")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _leaves(schema: T.StructType, at: str = "") -> dict[str, tuple[str, T.DataType]]:
    """Lower-case dotted name of every leaf: its column reference and type."""
    out = {}
    for f in schema.fields:
        name, ref = f"{at}.{f.name}" if at else f.name, f"`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out |= {k: (f"{ref}.{r}", t) for k, (r, t) in _leaves(f.dataType, name).items()}
        else:
            out[name.lower()] = (ref, f.dataType)
    return out


def _element(kind: T.DataType) -> tuple[int, T.DataType]:
    depth = 0
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    return depth, kind


def wild_pattern(term: str) -> str | None:
    """A regular expression for a term with wildcards, or None."""
    if not re.search(r"(?<!\\)[*?]", term):
        return None
    parts = re.findall(r"\\.|[*?]|[^\\*?]+", term)
    return "^" + "".join(".*" if p == "*" else "." if p == "?" else re.escape(unescape(p)) for p in parts) + "$"


def _test(node: Node, value: Column, kind: T.DataType) -> Column:
    numeric = isinstance(kind, T.NumericType)
    number = value.cast("double") if numeric else value.try_cast("double")
    if node.kind == "compare":
        op, text = re.match(r"([<>]=?)\s*(.+)", node.value, re.DOTALL).groups()
        try:
            limit = F.lit(float(unescape(text)))
        except ValueError:
            if numeric:
                return F.lit(False)
            number, limit = value.cast("string"), F.lit(unescape(text))
        return {">": number > limit, ">=": number >= limit, "<": number < limit, "<=": number <= limit}[op]
    if node.kind == "range":
        low, high = re.match(r"[\[{]\s*(.*?)\s+TO\s+(.*?)\s*[\]}]$", node.value, re.DOTALL).groups()
        tests = []
        for text, ops in ((low, ">=" if node.value[0] == "[" else ">"), (high, "<=" if node.value[-1] == "]" else "<")):
            if text != "*":
                tests.append(_test(Node("compare", value=f"{ops}{text}"), value, kind))
        return F.lit(True) if not tests else tests[0] if len(tests) == 1 else tests[0] & tests[1]
    text = unescape(node.value[1:-1]) if node.kind == "phrase" else node.value
    if numeric:
        try:
            return value.cast("double") == F.lit(float(unescape(text)))
        except ValueError:
            return F.lit(False)
    wild = wild_pattern(text) if node.kind == "term" else None
    if wild:
        return F.lower(value.cast("string")).rlike(wild.lower())
    return F.lower(value.cast("string")) == unescape(text).lower() if node.kind == "term" else _words(value, text)


def _words(value: Column, text: str) -> Column:
    """Whether the words of text occur in a row in value, without case."""
    words = [re.escape(w) for w in re.findall(r"\w+", text.lower())]
    return F.lower(value.cast("string")).rlike(r"(?U)(?<!\w)" + r"\W+".join(words) + r"(?!\w)") if words else F.lit(False)


class Compiler:
    def __init__(self, schema: T.StructType, text_columns: list[str] | None):
        self.leaves = _leaves(schema)
        self.text = text_columns if text_columns is not None else [k for k, (_, t) in self.leaves.items() if isinstance(_element(t)[1], T.StringType)]

    def column(self, node: Node) -> Column:
        if node.kind in ("and", "or"):
            parts = [self.column(p) for p in node.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if node.kind == "and" else out | p
            return out
        if node.kind == "not":
            return ~F.coalesce(self.column(node.parts[0]), F.lit(False))
        if node.kind == "all":
            return F.lit(True) if node.field is None else self.over(node.field, lambda v, k: v.isNotNull())
        if node.field is not None:
            return self.over(node.field, lambda v, k: _test(node, v, k))
        if node.kind in ("compare", "range"):
            raise ValueError("a comparison needs a field")
        text = unescape(node.value[1:-1]) if node.kind == "phrase" else node.value
        wild = wild_pattern(text) if node.kind == "term" else None
        find = (lambda v, k: F.lower(v).rlike(r"(?U)(?<!\w)" + wild[1:-1].lower().replace(".*", r"\w*") + r"(?!\w)")) if wild else (lambda v, k: _words(v, unescape(text)))
        tests = [self.over(c, find) for c in self.text]
        if not tests:
            return F.lit(False)
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    def over(self, name: str, test) -> Column:
        if name.lower() not in self.leaves:
            raise ValueError(f"no field {name!r}")
        ref, kind = self.leaves[name.lower()]
        depth, element = _element(kind)
        value = F.col(ref)
        if not depth:  # null means no match; only a negation has to tell, so the bare test can go down to the scan
            return test(value, element)
        for _ in range(depth - 1):
            value = F.flatten(value)
        return F.exists(value, lambda v: test(v, element))


def compile_query(query: str, schema: T.StructType, text_columns: list[str] | None = None) -> Column:
    """The filter as one Column of built-in expressions, so scalar comparisons are pushed down to the scan."""
    return Compiler(schema, text_columns).column(Parser(query).parse())


def search(df: DataFrame, query: str, text_columns: list[str] | None = None) -> DataFrame:
    return df.where(compile_query(query, df.schema, text_columns))


def search_page(df: DataFrame, query: str, order_by: list[str], offset: int = 0, size: int = 10) -> DataFrame:
    """One page of the matches in a stable order. Relevance is not scored: ties are all alike and order_by decides."""
    return search(df, query).orderBy(*order_by).offset(offset).limit(size)


def search_after(df: DataFrame, key: str, last, size: int = 10_000) -> DataFrame:
    """The page of rows after the key of the last row seen; only those rows are sorted."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)


def plan_slices(n_docs: int, max_query_size: int = 10_000, max_slices: int = 1024) -> int:
    """How many slices a scan of n_docs is cut into."""
    if n_docs < 1:
        raise ValueError("no documents match the query")
    return min(-(-n_docs // max_query_size), max_slices)
