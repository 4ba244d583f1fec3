"""MATCH patterns: parser, and a compiler to joins.

    MATCH (a:Person {city: 'X'})-[r:KNOWS]->(b)<-[:KNOWS]-(c), (c)--(d) WHERE a.age >= 30 AND NOT b.name CONTAINS 'x' OR d.id = 'D'

Labels are the vertex column ``label`` and edge types the edge column ``type`` (or ``edge_type``); properties are columns, or
keys of a map column ``properties``. The compiler starts from the pattern edge with most constants and goes on along shared variables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import QueryParseError
from graphloom.graph import Graph

_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|!=|<>|=|<|>)|(?P<sign>[(){}\[\]:,.*-]))""")


@dataclass
class NodePattern:
    name: str
    labels: list[str] = field(default_factory=list)
    properties: dict = field(default_factory=dict)


@dataclass
class EdgePattern:
    name: str
    source: str
    target: str
    directed: bool = True
    types: list[str] = field(default_factory=list)
    properties: dict = field(default_factory=dict)


@dataclass
class Query:
    nodes: dict[str, NodePattern]
    edges: list[EdgePattern]
    where: tuple | None = None
    returns: list[tuple[str, str | None]] | None = None
    limit: int | None = None


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.rstrip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryParseError(f"unexpected {text[at : at + 10]!r} at {at}")
            kind = m.lastgroup
            value = m[kind]
            self.tokens.append((kind, re.sub(r"\\(.)", r"\1", value[1:-1]) if kind == "string" else value))
            at = m.end()
        self.i, self.hidden = 0, 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else ("end", "")

    def take(self, *values: str):
        kind, value = self.peek()
        if kind in ("sign", "op") and value in values:
            self.i += 1
            return value
        return None

    def word(self, *words: str) -> bool:
        kind, value = self.peek()
        if kind == "name" and value.upper() in words:
            self.i += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise QueryParseError(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise QueryParseError(f"expected a name, found {value!r}")
        self.i += 1
        return value

    def fresh(self) -> str:
        self.hidden += 1
        return f"_{self.hidden}"

    def literal(self):
        kind, value = self.peek()
        self.i += 1
        if kind == "string":
            return value
        if kind == "number":
            return float(value) if "." in value else int(value)
        if kind == "name" and value.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[value.lower()]
        raise QueryParseError(f"expected a value, found {value!r}")

    def body(self) -> tuple[str, list[str], dict]:
        name = self.name() if self.peek()[0] == "name" else self.fresh()
        labels = []
        while self.take(":"):
            labels.append(self.name())
        properties = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.expect(":")
                properties[key] = self.literal()
                self.take(",")
        return name, labels, properties

    def node(self, nodes: dict) -> str:
        self.expect("(")
        name, labels, properties = self.body()
        self.expect(")")
        got = nodes.setdefault(name, NodePattern(name))
        got.labels += labels
        got.properties |= properties
        return name

    def query(self) -> Query:
        if not self.word("MATCH"):
            raise QueryParseError("a pattern starts with MATCH")
        nodes: dict[str, NodePattern] = {}
        edges: list[EdgePattern] = []
        while True:
            left = self.node(nodes)
            while self.peek()[1] in ("-", "<"):
                into = bool(self.take("<"))
                self.expect("-")
                name, types, properties = self.fresh(), [], {}
                if self.take("["):
                    name, types, properties = self.body()
                    self.expect("]")
                    self.expect("-")
                else:
                    self.take("-")
                out = bool(self.take(">"))
                if into and out:
                    raise QueryParseError("an edge points one way or none")
                right = self.node(nodes)
                edges.append(EdgePattern(name, right if into else left, left if into else right, into or out, types, properties))
                left = right
            if not self.take(","):
                break
        q = Query(nodes, edges)
        if self.word("WHERE"):
            q.where = self.either()
        if self.word("RETURN"):
            q.returns = [self.column()]
            while self.take(","):
                q.returns.append(self.column())
        if self.word("LIMIT"):
            q.limit = int(self.literal())
        if self.peek()[0] != "end":
            raise QueryParseError(f"unexpected {self.peek()[1]!r}")
        return q

    def column(self) -> tuple[str, str | None]:
        name = self.name()
        return (name, self.name()) if self.take(".") else (name, None)

    def either(self):
        left = self.both()
        while self.word("OR"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.word("AND"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        if self.word("NOT"):
            return ("not", self.negated())
        if self.take("("):
            inner = self.either()
            self.expect(")")
            return inner
        left = self.column()
        if self.word("CONTAINS"):
            return ("contains", left, self.literal())
        if self.word("STARTS"):
            if not self.word("WITH"):
                raise QueryParseError("expected WITH")
            return ("starts", left, self.literal())
        op = self.take("=", "!=", "<>", "<", ">", "<=", ">=")
        if not op:
            raise QueryParseError(f"expected a comparison, found {self.peek()[1]!r}")
        right = self.column() if self.peek()[0] == "name" and self.peek(1)[1] == "." else ("literal", self.literal())
        return ("compare", op, left, right)


def parse(text: str) -> Query:
    return _Parser(text).query()


def _property(df_columns: list[str], prefix: str, key: str) -> Column:
    if f"{prefix}.{key}" in df_columns:
        return F.col(f"`{prefix}.{key}`")
    if f"{prefix}.properties" in df_columns:
        return F.try_element_at(F.col(f"`{prefix}.properties`"), F.lit(key))
    raise QueryParseError(f"{prefix} has no property {key}")


def _condition(tree: tuple, columns: list[str]) -> Column:
    kind = tree[0]
    if kind in ("and", "or"):
        a, b = _condition(tree[1], columns), _condition(tree[2], columns)
        return a & b if kind == "and" else a | b
    if kind == "not":
        return ~_condition(tree[1], columns)
    of = lambda c: _property(columns, c[0], c[1] or "id")
    if kind == "contains":
        return F.contains(of(tree[1]).cast("string"), F.lit(str(tree[2])))
    if kind == "starts":
        return F.startswith(of(tree[1]).cast("string"), F.lit(str(tree[2])))
    _, op, left, right = tree
    a = of(left)
    if right[0] == "literal":
        b = F.lit(right[1])
        if isinstance(right[1], (int, float)) and not isinstance(right[1], bool):
            a = a.try_cast("double")
    else:
        b = of(right)
    return {"=": a == b, "!=": a != b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def match(graph: Graph, pattern: str | Query) -> DataFrame:
    """Rows of bindings. Without RETURN: a column for each named vertex (its id); with it the asked columns, named ``a`` or ``a.key``.

    One pattern edge matches one edge row, so parallel edges give several rows; different variables may bind the same vertex.
    """
    q = parse(pattern) if isinstance(pattern, str) else pattern
    v, e = graph.vertices, graph.edges
    kind = next((c for c in ("type", "edge_type", "label") if c in e.columns), None)

    def node(name: str) -> DataFrame:
        p = q.nodes[name]
        df = v.select(*[F.col(c).alias(f"{name}.{c}") for c in v.columns])
        for label in p.labels:
            df = df.where(_property(df.columns, name, "label") == label)
        for k, x in p.properties.items():
            df = df.where(_property(df.columns, name, k) == F.lit(x))
        return df

    def edge(p: EdgePattern) -> DataFrame:
        df = e.select(*[F.col(c).alias(f"{p.name}.{c}") for c in e.columns])
        for t in p.types:
            if kind is None:
                raise QueryParseError("the edges have no type column")
            df = df.where(F.col(f"`{p.name}.{kind}`") == t)
        for k, x in p.properties.items():
            df = df.where(_property(df.columns, p.name, k) == F.lit(x))
        ends = lambda a, b: df.withColumns({f"{p.source}.id": F.col(f"`{p.name}.{a}`"), **({f"{p.target}.id": F.col(f"`{p.name}.{b}`")} if p.target != p.source else {})})
        out = ends("source", "target")
        if p.source == p.target:
            return out.where(F.col(f"`{p.name}.source`") == F.col(f"`{p.name}.target`"))
        if not p.directed:
            out = out.unionByName(ends("target", "source").where(F.col(f"`{p.name}.source`") != F.col(f"`{p.name}.target`")))
        return out

    selective = lambda n: len(q.nodes[n].labels) + 2 * len(q.nodes[n].properties)
    used = _used(q)
    left, out, bound = list(q.edges), None, set()

    def attach(df: DataFrame | None, name: str) -> DataFrame:
        n = q.nodes[name]
        if df is not None and not n.labels and not n.properties and not used.get(name):
            return df  # nothing is asked of the vertex but its id
        return node(name) if df is None else df.join(node(name), [f"{name}.id"])

    while left:
        connected = [x for x in left if {x.source, x.target} & bound] or left
        p = max(connected, key=lambda x: (selective(x.source) + selective(x.target) + len(x.properties), -left.index(x)))
        left.remove(p)
        rel = edge(p)
        shared = [f"{n}.id" for n in dict.fromkeys((p.source, p.target)) if n in bound]
        if out is None:
            out = rel
        elif shared:
            out = out.join(rel, shared)
        else:
            raise QueryParseError("the parts of a pattern must share a vertex")
        for n in dict.fromkeys((p.source, p.target)):
            if n not in bound:
                out = attach(out, n)
                bound.add(n)
    alone = [n for n in q.nodes if n not in bound]
    if alone and (out is not None or len(alone) > 1):
        raise QueryParseError("the parts of a pattern must share a vertex")
    if alone:
        out = attach(None, alone[0])
    if q.where is not None:
        out = out.where(_condition(q.where, out.columns))
    if q.returns is not None:
        picked = []
        for name, key in q.returns:
            if key is None and name not in q.nodes:
                picked.append(F.struct(*[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in out.columns if c.startswith(name + ".")]).alias(name))
            else:
                picked.append(_property(out.columns, name, key or "id").alias(name if key is None else f"{name}.{key}"))
        out = out.select(*picked)
    else:
        out = out.select(*[F.col(f"`{n}.id`").alias(n) for n in q.nodes if not n.startswith("_")])
    return out if q.limit is None else out.limit(q.limit)


def _used(q: Query) -> dict[str, bool]:
    """Vertices of which a property besides the id is asked."""
    found: dict[str, bool] = {}

    def note(c) -> None:
        if c and c[0] in q.nodes and (c[1] or "id") != "id":
            found[c[0]] = True

    def walk(t) -> None:
        if t[0] in ("and", "or"):
            walk(t[1]), walk(t[2])
        elif t[0] == "not":
            walk(t[1])
        elif t[0] == "compare":
            note(t[2])
            if t[3][0] != "literal":
                note(t[3])
        else:
            note(t[1])

    if q.where is not None:
        walk(q.where)
    for c in q.returns or []:
        note(c)
    return found
