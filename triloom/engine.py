"""The entry point: Engine(spark, source).sparql(text)."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions import terms as T
from .operators.compiler import QueryCompiler
from .plans.algebra import InvalidQueryError, Query, UnsupportedQueryError
from .plans.parser import PREFIXES, parse
from .plans.relation import TERM, Relation, column
from .shipping import ship
from .sources.base import Source

log = logging.getLogger("triloom.engine")

__all__ = ["Engine", "InvalidQueryError", "Result", "UnsupportedQueryError"]


@dataclass
class Result:
    """form: SELECT, CONSTRUCT, DESCRIBE or ASK. variables: of SELECT, with their ?."""

    form: str
    variables: list[str]
    relation: Relation | None
    frame: DataFrame | None = None

    def terms(self) -> DataFrame:
        """Solutions as terms, columns named with ?; triples s, p, o; or one boolean."""
        if self.relation is None:
            return self.frame
        r = self.relation
        return r.df.select(*[T.deskolemise(r.term(v)).alias(v) if r.encs[v] == TERM else r.term(v).alias(v) for v in self.variables])

    def typed(self) -> DataFrame:
        """Solutions with literals as native values, columns named without ?."""
        if self.relation is None:
            return self.frame
        r = self.relation
        return r.df.select(*[r.encs[v].native(column(v)).alias(v[1:]) for v in self.variables])

    def boolean(self) -> bool:
        return bool(self.frame.first()["result"])

    def rows(self) -> Iterator[dict[str, str | None]]:
        """Solutions one by one, as partitions are done; unbound variables are None."""
        for row in self.terms().toLocalIterator():
            yield row.asDict()


class Engine:
    """Read-only graph-pattern queries over one source.

    compat: "standard" follows SPARQL 1.1; "quirks" keeps the documented deviations of the query dialect this engine takes over
    (see README).
    """

    def __init__(self, spark: SparkSession, source: Source, prefixes: dict[str, str] | None = None, compat: str = "standard"):
        if compat not in ("standard", "quirks"):
            raise ValueError(f"unknown compat {compat!r}")
        ship(spark)
        self.spark, self.source, self.quirks = spark, source, compat == "quirks"
        self.prefixes = PREFIXES | (prefixes or {})

    def sparql(self, query: str | Query, seed: DataFrame | None = None) -> Result:
        """Raises InvalidQueryError or UnsupportedQueryError before anything runs.

        seed: solutions to start from, columns named after variables (with ?), values terms, null for unbound.
        """
        q = parse(query, self.prefixes) if isinstance(query, str) else query
        c = QueryCompiler(self.spark, self.source, self.quirks)
        start = None
        if seed is not None:
            start = Relation(seed.select(*[column(v) for v in seed.columns]), dict.fromkeys(seed.columns, TERM), frozenset(f.name for f in seed.schema if f.nullable))
        rows = c.where(q, start)
        if q.form == "SELECT":
            if q.variables == ["*"] and seed is not None:
                q.variables = list(dict.fromkeys([*[v for v in seed.columns if v.startswith("?")], *q.named()]))
            names = q.named() if q.variables == ["*"] else list(dict.fromkeys(q.variables))
            return Result("SELECT", names, c.select(q, rows))
        if q.form == "ASK":
            return Result("ASK", [], None, c.ask(rows))
        if q.form == "CONSTRUCT":
            return Result("CONSTRUCT", [], None, c.construct(q, rows))
        if q.form == "DESCRIBE":
            return Result("DESCRIBE", [], None, c.describe(q, rows))
        raise UnsupportedQueryError(f"Unsupported query form: {q.form}")

    def explain(self, query: str) -> str:
        """The order in which the patterns are joined, and the physical plan."""
        from .plans.algebra import Bgp, Group
        from .plans.planner import plan

        q = parse(query, self.prefixes)
        lines = []

        def walk(g: Group) -> None:
            patterns = [p for x in g.parts if isinstance(x, Bgp) for p in x.patterns]
            for u in plan(patterns, self.source) or ():
                lines.append(f"{max(0, u.count):.0f}: " + " . ".join(map(str, u.patterns)))
            for x in g.parts:
                for inner in [x] if isinstance(x, Group) else getattr(x, "branches", ()):
                    walk(inner)

        walk(q.where)
        r = self.sparql(q)
        df = r.relation.df if r.relation is not None else r.frame
        return "\n".join([*lines, df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))])

    def cancel(self, group: str) -> None:
        """Stop the jobs of a group set with sparkContext.setJobGroup()."""
        self.spark.sparkContext.cancelJobGroup(group)

    def cancel_all(self) -> None:
        """Stop all jobs of the session's context, whatever started them."""
        self.spark.sparkContext.cancelAllJobs()
