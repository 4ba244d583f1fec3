"""Triples and a fluent query over them.

A triple is a row (subject, predicate, object, object_type[, datatype, lang]); object_type is uri, literal or blank. Patterns
join on their shared variables; FILTER, ORDER BY, OFFSET and LIMIT follow, and the chosen variables are projected.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import QueryParseError
from graphloom.graph import Graph

SCHEMA = "subject string, predicate string, object string, object_type string, datatype string, lang string"
#: The usual prefixes.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}


@dataclass(frozen=True)
class Term:
    kind: str  # var, uri, literal
    value: str
    datatype: str | None = None
    lang: str | None = None


def var(name: str) -> Term:
    return Term("var", name)


def uri(value: str) -> Term:
    return Term("uri", value)


def literal(value) -> Term:
    return Term("literal", str(value))


def typed_literal(value, datatype: str) -> Term:
    return Term("literal", str(value), datatype)


def lang_literal(value: str, lang: str) -> Term:
    return Term("literal", value, lang=lang)


def _term(x) -> Term:
    return x if isinstance(x, Term) else var(x[1:]) if isinstance(x, str) and x.startswith("?") else uri(x) if isinstance(x, str) else literal(x)


class TripleStore:
    def __init__(self, triples: DataFrame, prefixes: dict[str, str] | None = None):
        missing = [c for c in ("datatype", "lang") if c not in triples.columns]
        kind = {} if "object_type" in triples.columns else {"object_type": F.lit("uri")}
        self.triples = triples.withColumns({c: F.lit(None).cast("string") for c in missing} | kind).select("subject", "predicate", "object", "object_type", "datatype", "lang")
        self.prefixes = dict(prefixes or {})

    @classmethod
    def empty(cls, spark: SparkSession) -> TripleStore:
        return cls(spark.createDataFrame([], SCHEMA))

    @classmethod
    def from_graph(cls, graph: Graph) -> TripleStore:
        """Each vertex is a graph:Node, each edge connects, and its weight is a triple of its own."""
        node = lambda c: F.concat(F.lit("node:"), c)
        e = graph.edges
        rows = [
            graph.node_ids().select(node("id").alias("subject"), F.lit("rdf:type").alias("predicate"), F.lit("graph:Node").alias("object"), F.lit("uri").alias("object_type"), F.lit(None).cast("string").alias("datatype")),
            e.select(node("source").alias("subject"), F.lit("graph:connectedTo").alias("predicate"), node("target").alias("object"), F.lit("uri").alias("object_type"), F.lit(None).cast("string").alias("datatype")),
            e.select(F.concat(F.lit("edge:"), "source", F.lit("_"), "target").alias("subject"), F.lit("graph:weight").alias("predicate"), F.col("weight").cast("string").alias("object"), F.lit("literal").alias("object_type"), F.lit("xsd:double").alias("datatype")),
        ]
        return cls(rows[0].unionByName(rows[1]).unionByName(rows[2]))

    def add(self, *rows: tuple) -> TripleStore:
        """Adds (subject, predicate, object) rows; the object is a term, a URI string or a value."""
        data = []
        for s, p, o in rows:
            o = _term(o)
            data.append((self.expand(s), self.expand(p), self.expand(o.value) if o.kind == "uri" else o.value, o.kind, o.datatype, o.lang))
        return TripleStore(self.triples.unionByName(self.triples.sparkSession.createDataFrame(data, SCHEMA)), self.prefixes)

    def bind(self, prefix: str, namespace: str) -> TripleStore:
        return TripleStore(self.triples, self.prefixes | {prefix: namespace})

    def expand(self, name: str) -> str:
        prefix, colon, rest = name.partition(":")
        return self.prefixes[prefix] + rest if colon and prefix in self.prefixes else name

    # ontology

    def add_class(self, name: str, label: str | None = None) -> TripleStore:
        return self.add((name, "rdf:type", "owl:Class"), *([(name, "rdfs:label", literal(label))] if label else []))

    def add_property(self, name: str, kind: str = "object", domain: str | None = None, range_: str | None = None) -> TripleStore:
        types = {"object": "owl:ObjectProperty", "datatype": "owl:DatatypeProperty", "annotation": "owl:AnnotationProperty"}
        if kind not in types:
            raise QueryParseError(f"a property is one of {', '.join(types)}")
        rows = [(name, "rdf:type", types[kind])] + ([(name, "rdfs:domain", domain)] if domain else []) + ([(name, "rdfs:range", range_)] if range_ else [])
        return self.add(*rows)

    def add_subclass(self, child: str, parent: str) -> TripleStore:
        return self.add((child, "rdfs:subClassOf", parent))

    def subclass_closure(self) -> DataFrame:
        """(child, parent) of all subclass chains, each class with itself."""
        from graphloom.operators.paths import multi_bfs

        e = self.triples.where(F.col("predicate") == self.expand("rdfs:subClassOf")).select(F.col("subject").alias("source"), F.col("object").alias("target"))
        g = Graph.from_edges(e)
        return multi_bfs(g, g.node_ids()).select(F.col("source").alias("child"), F.col("id").alias("parent"))

    def instances(self, klass: str) -> DataFrame:
        """(subject) of the class and of its subclasses."""
        below = self.subclass_closure().where(F.col("parent") == self.expand(klass)).select(F.col("child").alias("object"))
        below = below.unionByName(self.triples.sparkSession.createDataFrame([(self.expand(klass),)], "object string")).distinct()
        return self.triples.where(F.col("predicate") == self.expand("rdf:type")).join(below, "object", "left_semi").select("subject").distinct()

    def contains(self, s: str, p: str, o: str) -> bool:
        return not self.triples.where((F.col("subject") == self.expand(s)) & (F.col("predicate") == self.expand(p)) & (F.col("object") == self.expand(o))).limit(1).isEmpty()

    def statistics(self) -> DataFrame:
        """(triples, subjects, predicates, objects)."""
        return self.triples.agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("predicates"), F.count_distinct("object").alias("objects"))

    def export(self) -> DataFrame:
        return self.triples.select("subject", "predicate", "object", "object_type")

    def select(self, *variables: str) -> Select:
        return Select(self, tuple(v.lstrip("?") for v in variables))


@dataclass(frozen=True)
class Select:
    """An immutable query; every method gives a new one and ``run`` its plan."""

    store: TripleStore
    variables: tuple[str, ...]
    patterns: tuple = ()
    filters: tuple = ()
    order: tuple = ()
    skip: int = 0
    most: int | None = None
    unique: bool = False
    options: dict = field(default_factory=dict)

    def where(self, s, p, o) -> Select:
        return replace(self, patterns=(*self.patterns, (_term(s), _term(p), _term(o))))

    def filter(self, variable: str, op: str, value) -> Select:
        """op: =, !=, <, >, <=, >=, regex, contains, lang, datatype."""
        return replace(self, filters=(*self.filters, (variable.lstrip("?"), op, value)))

    def order_by(self, variable: str, descending: bool = False) -> Select:
        return replace(self, order=(*self.order, (variable.lstrip("?"), descending)))

    def limit(self, n: int) -> Select:
        return replace(self, most=n)

    def offset(self, n: int) -> Select:
        return replace(self, skip=n)

    def distinct(self) -> Select:
        return replace(self, unique=True)

    def _pattern(self, s: Term, p: Term, o: Term) -> DataFrame:
        df, out = self.store.triples, {}
        for column, t in (("subject", s), ("predicate", p), ("object", o)):
            if t.kind == "var":
                if t.value in out:
                    df = df.where(F.col(column) == out[t.value][0])
                elif column == "object":
                    out[t.value] = [F.col(column), F.col("datatype"), F.col("lang")]
                else:
                    out[t.value] = [F.col(column), F.lit(None).cast("string"), F.lit(None).cast("string")]
            else:
                df = df.where(F.col(column) == (self.store.expand(t.value) if t.kind == "uri" else t.value))
                if column == "object" and t.kind == "literal":
                    df = df.where(F.col("object_type") == "literal")
                    df = df if t.datatype is None else df.where(F.col("datatype") == t.datatype)
                    df = df if t.lang is None else df.where(F.col("lang") == t.lang)
        return df.select(*[x.alias(n if i == 0 else f"{n}@{i}") for n, xs in out.items() for i, x in enumerate(xs)], F.lit(1).alias("@"))

    def _test(self, variable: str, op: str, value) -> Column:
        c = F.col(variable)
        number = c.try_cast("double")
        numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
        if op in ("<", ">", "<=", ">="):
            a, b = (number, F.lit(float(value))) if numeric else (c, F.lit(str(value)))
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        tests = {
            "=": lambda: number == float(value) if numeric else c == self.store.expand(str(value)),
            "!=": lambda: number != float(value) if numeric else c != self.store.expand(str(value)),
            "regex": lambda: c.rlike(str(value)),
            "contains": lambda: F.contains(c, F.lit(str(value))),
            "datatype": lambda: F.col(f"`{variable}@1`") == self.store.expand(str(value)),
            "lang": lambda: F.col(f"`{variable}@2`") == value,
        }
        if op not in tests:
            raise QueryParseError(f"unknown filter {op}")
        return tests[op]()

    def run(self) -> DataFrame:
        if not self.patterns:
            raise QueryParseError("a query needs a pattern")
        # constants first, then along shared variables
        left = sorted(self.patterns, key=lambda p: sum(t.kind == "var" for t in p))
        out = None
        names: set[str] = set()
        while left:
            p = next((x for x in left if names & {t.value for t in x if t.kind == "var"}), left[0])
            left.remove(p)
            df = self._pattern(*p)
            mine = {t.value for t in p if t.kind == "var"}
            shared = sorted(names & mine)
            if out is None:
                out = df
            elif shared:
                out = out.join(df.drop("@", *[f"{n}@{i}" for n in shared for i in (1, 2)]), shared)
            elif not mine:
                out = out.join(df.limit(1), "@", "left_semi")
            else:
                raise QueryParseError("the patterns must share variables")
            names |= mine
        unknown = [v for v in (*self.variables, *[f[0] for f in self.filters], *[o[0] for o in self.order]) if v not in names]
        if unknown:
            raise QueryParseError(f"no pattern binds {', '.join(unknown)}")
        for f in self.filters:
            out = out.where(self._test(*f))
        keep = list(self.variables) or sorted(names)
        if self.unique:
            out = out.select(*dict.fromkeys([*keep, *[o[0] for o in self.order]])).distinct()
        keys = []
        for v, down in self.order:
            for key in (F.col(v).try_cast("double"), F.col(v)):
                keys.append(key.desc_nulls_last() if down else key.asc_nulls_first())
        out = out.orderBy(*keys) if keys else out
        out = out.offset(self.skip) if self.skip else out
        out = out if self.most is None else out.limit(self.most)
        return out.select(*keep)
