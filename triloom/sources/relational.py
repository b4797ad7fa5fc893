"""Ordinary tables seen as triples: a row is a subject, a column a predicate; nothing is written out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import terms as T
from ..plans.algebra import Pattern
from ..plans.relation import TERM, Enc, Relation, nothing, union
from .base import Source, bind

_DATATYPES = {S.ByteType: T.INTEGER, S.ShortType: T.INTEGER, S.IntegerType: T.INTEGER, S.LongType: T.INTEGER, S.FloatType: T.DOUBLE, S.DoubleType: T.DOUBLE, S.BooleanType: T.BOOLEAN, S.TimestampType: T.DATETIME, S.TimestampNTZType: T.DATETIME, S.StringType: ""}


@dataclass
class Mapping:
    """How a table becomes triples. frame: the table, or a function that opens it when it is first needed. key: its columns, none for a hash
    of the whole row. unique: no two rows have the same key, which is taken on trust; only then are several patterns on a subject one scan.
    links: column to the table whose row it names; languages: text column to the column of its language."""

    name: str
    frame: DataFrame | Callable[[], DataFrame]
    key: list[str]
    links: dict[str, str] = field(default_factory=dict)
    languages: dict[str, str] = field(default_factory=dict)
    rows: int | None = None
    unique: bool = False

    @property
    def df(self) -> DataFrame:
        if not isinstance(self.frame, DataFrame):
            self.frame = self.frame()
        return self.frame

    def subject(self) -> Column:
        if not self.key:
            return F.sha1(F.to_json(F.struct(*[F.col(c) for c in self.df.columns])))
        return F.col(self.key[0]) if len(self.key) == 1 else F.concat_ws("/", *self.key)


class RelationalSource(Source):
    """Subjects are base + table/key, predicates base + table#column, classes base + Table; a null value is no triple."""

    def __init__(self, spark: SparkSession, mappings: list[Mapping], base: str = "urn:t:"):
        self.spark, self.base = spark, base
        self.tables = {m.name: m for m in mappings}
        self.classes = {self.class_iri(m): m for m in mappings}
        self._rows: dict[str, int] = {}

    def _maps(self, m: Mapping, c: str) -> bool:
        return type(m.df.schema[c].dataType) in _DATATYPES and c not in m.languages.values()

    def _column(self, predicate: str) -> tuple[Mapping, str] | None:
        """Table and column of a predicate; opens no other table."""
        table, _, c = predicate.removeprefix(self.base).partition("#")
        m = self.tables.get(table)
        return (m, c) if predicate.startswith(self.base) and m and c in m.df.columns and self._maps(m, c) else None

    def class_iri(self, m: Mapping) -> str:
        return f"{self.base}{m.name[:1].upper()}{m.name[1:]}"

    def subject_enc(self, m: Mapping) -> Enc:
        return Enc("iri", f"{self.base}{m.name}/")

    def object(self, m: Mapping, c: str) -> tuple[Enc, Column]:
        if c in m.links:
            return self.subject_enc(self.tables[m.links[c]]), F.col(c)
        if c in m.languages:
            return Enc("text"), F.struct(F.col(c).alias("lex"), F.col(m.languages[c]).alias("lang"))
        return Enc("literal", datatype=_DATATYPES[type(m.df.schema[c].dataType)]), F.col(c)

    def _same(self, enc: Enc, c: Column, kind: S.DataType | None, t: str) -> Column | None:
        """Condition for a column to be that term, on native values so that it is pushed down; None if it never is."""
        if enc.kind == "iri":
            if T.py_is_literal(t) or not t.startswith(enc.prefix):
                return None
            key = t[len(enc.prefix) :]
            if isinstance(kind, S.IntegralType):
                return c == int(key) if key.lstrip("-").isdigit() and str(int(key)) == key else None
            return c.cast("string") == key
        if not T.py_is_literal(t):
            return None
        lex, lang, dt = T.py_literal(t)
        if enc.kind == "text":
            return (c["lex"] == lex) & (F.lower(c["lang"]) == lang) if lang else None
        if lang or (dt or "") not in (enc.datatype, T.STRING if not enc.datatype else enc.datatype):
            return None
        if isinstance(kind, S.IntegralType):
            return c == int(lex) if lex.lstrip("-").isdigit() and str(int(lex)) == lex else None
        if isinstance(kind, S.StringType):
            return c == lex
        return enc.term(c) == t

    def _counted(self, m: Mapping) -> int:
        if m.name not in self._rows:
            self._rows[m.name] = m.rows if m.rows is not None else m.df.count()  # from file footers
        return self._rows[m.name]

    def _guessed(self, m: Mapping) -> int:
        """Rows by the size of the files, for which no job runs; at least one, as only a job would know."""
        if m.rows is not None:
            return m.rows
        size = m.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return max(1, int(str(size)) // (8 * len(m.df.columns)))

    def count(self, p: Pattern) -> float:
        return self._matches(p, self._counted)

    def estimate(self, p: Pattern) -> float:
        return self._matches(p, self._guessed)

    def _matches(self, p: Pattern, rows: Callable[[Mapping], int]) -> float:
        if T.py_is_literal(p.s) or T.py_is_literal(p.p):
            return 0
        if T.py_is_open(p.p):
            n = float(sum(rows(m) * (1 + len(m.df.columns)) for m in self.tables.values()))
        elif p.p == T.RDF_TYPE:
            n = float(sum(rows(m) for iri, m in self.classes.items() if T.py_is_open(p.o) or iri == p.o))
            return n if T.py_is_open(p.s) else min(n, 1.0)
        elif found := self._column(p.p):
            m, c = found
            n = float(rows(m))
            if not T.py_is_open(p.o):
                n /= max(1, rows(self.tables[m.links[c]])) if c in m.links else 20  # an object's share, without looking at the data
        else:
            return 0
        return n if T.py_is_open(p.s) else min(n, 50.0)

    def values(self, p: Pattern, v: str, exact: bool = False) -> float | None:
        """Subjects are as many as rows, and so are the rows that a link can name."""
        if T.py_is_open(p.p) or p.p == T.RDF_TYPE or (found := self._column(p.p)) is None:
            return None
        m, c = found
        named = m if v == p.s else self.tables[m.links[c]] if v == p.o and c in m.links else None
        return None if named is None else float(self._counted(named) if exact else self._guessed(named))

    def star(self, patterns: list[Pattern]) -> Relation | None:
        """One scan for several patterns on one subject of one table whose key is unique, where joining the patterns is reading the row."""
        found = [self._column(p.p) for p in patterns if p.p != T.RDF_TYPE]
        tables = {x[0].name if x else None for x in found} | {self.classes[p.o].name if p.o in self.classes else None for p in patterns if p.p == T.RDF_TYPE}
        if len(tables) != 1 or None in tables:
            return None
        m = self.tables[tables.pop()]
        if not m.unique:
            return None
        return self._read(m, patterns[0].s, [(p.o, self._column(p.p)[1]) for p in patterns if p.p != T.RDF_TYPE])

    def _read(self, m: Mapping, s: str, wanted: list[tuple[str, str]]) -> Relation:
        names = list(dict.fromkeys([t for t in (s, *[o for o, _ in wanted]) if T.py_is_open(t)]))
        out: dict[str, tuple[Enc, Column]] = {}
        df = m.df
        subject = self.subject_enc(m), m.subject()
        if T.py_is_open(s):
            out[s] = subject
        else:
            kind = m.df.schema[m.key[0]].dataType if len(m.key) == 1 else None
            same = self._same(*subject, kind, s)
            if same is None:
                return nothing(self.spark, names)
            df = df.where(same)
        for o, c in wanted:
            enc, value = self.object(m, c)
            if not T.py_is_open(o):
                same = self._same(enc, value, m.df.schema[c].dataType, o)
                if same is None:
                    return nothing(self.spark, names)
                df = df.where(same)
                continue
            df = df.where(F.col(c).isNotNull())
            if enc.kind == "text":
                df = df.where(F.col(m.languages[c]).isNotNull())
            if o not in out:
                out[o] = enc, value
            elif out[o][0] == enc:
                df = df.where(out[o][1] == value)
            elif "iri" in (enc.kind, out[o][0].kind):
                return nothing(self.spark, names)
            else:
                df = df.where(out[o][0].term(out[o][1]) == enc.term(value))
        return Relation(df.select(*[value.alias(v) for v, (_, value) in out.items()]), {v: enc for v, (enc, _) in out.items()})

    def scan(self, p: Pattern) -> Relation:
        if T.py_is_open(p.p):
            return self._any_predicate(p)
        if p.p == T.RDF_TYPE:
            return self._types(p)
        if (found := self._column(p.p)) is None:
            return nothing(self.spark, p.variables())
        m, c = found
        return self._read(m, p.s, [(p.o, c)])

    def _types(self, p: Pattern) -> Relation:
        parts = []
        for iri, m in self.classes.items():
            if not T.py_is_open(p.o) and iri != p.o:
                continue
            r = self._read(m, p.s, [])
            if r.empty or p.o == p.s:
                continue
            if T.py_is_open(p.o):
                r = Relation(r.df.withColumn(p.o, F.lit(iri)), r.encs | {p.o: TERM})
            parts.append(r)
        return union(parts) if parts else nothing(self.spark, p.variables())

    def _any_predicate(self, p: Pattern) -> Relation:
        """Rows turned into triples, of the tables that the subject or class leaves."""
        parts = []
        for m in self.tables.values():
            if not T.py_is_open(p.s) and not p.s.startswith(self.subject_enc(m).prefix):
                continue
            r = self._read(m, p.s, [])
            if r.empty:
                continue
            df = m.df
            if not T.py_is_open(p.s):
                kind = m.df.schema[m.key[0]].dataType if len(m.key) == 1 else None
                df = df.where(self._same(self.subject_enc(m), m.subject(), kind, p.s))
            parts.append(df.select(self.subject_enc(m).term(m.subject()).alias("s"), self._cells(m)).where("o is not null"))
        if not parts:
            return nothing(self.spark, p.variables())
        df = parts[0]
        for other in parts[1:]:
            df = df.unionAll(other)
        return bind(df, p)

    def _cells(self, m: Mapping) -> Column:
        """A row's predicates and objects, one row each."""
        cells = [F.struct(F.lit(T.RDF_TYPE).alias("p"), F.lit(self.class_iri(m)).alias("o"))]
        for c in m.df.columns:
            if self._maps(m, c):
                enc, value = self.object(m, c)
                cells.append(F.struct(F.lit(self.predicate(m.name, c)).alias("p"), enc.term(value).alias("o")))
        return F.inline(F.array(*cells))

    def about(self, p: Pattern, subject: Enc) -> Relation:
        """A variable predicate needs only the table that the subject's keys are of, and joins on those keys."""
        own = [m for m in self.tables.values() if self.subject_enc(m) == subject]
        if not T.py_is_open(p.p) or not own or len({p.s, p.p, p.o}) < 3:
            return self.match(p)
        m = own[0]
        df = m.df.select(m.subject().alias("s"), self._cells(m)).where("o is not null")
        if not T.py_is_open(p.o):
            df = df.where(F.col("o") == p.o)
        parts = {p.s: "s", p.p: "p"} | ({p.o: "o"} if T.py_is_open(p.o) else {})
        return Relation(df.select(*[F.col(x).alias(v) for v, x in parts.items()]), {v: subject if v == p.s else TERM for v in parts})

    def predicate(self, table: str, col: str) -> str:
        return f"{self.base}{table}#{col}"


def star_schema(spark: SparkSession, folder: str) -> RelationalSource:
    """The mapping of the driver's tables. lineitem has no key of its own: its rows are named by a hash of the whole row."""
    read = lambda t: lambda: spark.read.parquet(f"{folder}/{t}.parquet")
    return RelationalSource(
        spark,
        [
            Mapping("region", read("region"), ["r_regionkey"], unique=True),
            Mapping("nation", read("nation"), ["n_nationkey"], {"n_regionkey": "region"}, unique=True),
            Mapping("customer", read("customer"), ["c_custkey"], {"c_nationkey": "nation"}, unique=True),
            Mapping("supplier", read("supplier"), ["s_suppkey"], {"s_nationkey": "nation"}, unique=True),
            Mapping("part", read("part"), ["p_partkey"], unique=True),
            Mapping("orders", read("orders"), ["o_orderkey"], {"o_custkey": "customer"}, unique=True),
            Mapping("lineitem", read("lineitem"), [], {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, unique=True),
            Mapping("events", read("events"), ["event_id"], unique=True),
            Mapping("documents", read("documents"), ["doc_id"], languages={"text": "lang"}, unique=True),
            Mapping("labels", read("labels"), ["doc_id"], {"doc_id": "documents"}, unique=True),
            Mapping("pages", read("pages"), ["page_id"], unique=True),
            Mapping("benchmark", read("benchmark"), ["item_id"], unique=True),
            Mapping("conversations", read("conversations"), ["conv_id", "turn"], unique=True),
        ],
    )

