"""Algebra to DataFrames."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.expressions import Compiler
from ..plans.algebra import Bgp, Filter, Group, Pattern, Query, Union, UnsupportedQueryError
from ..plans.planner import LOOK, Size, Unit, plan
from ..plans.relation import TERM, Relation, Tiles, column, join, left_join, nothing, union, unit
from ..sources.base import Source

log = logging.getLogger("triloom.plan")

TRIPLE = "s string, p string, o string"


class QueryCompiler:
    """One query over one source. quirks: see Compiler; also ORDER BY by text and first key only, and LIMIT that counts triples."""

    def __init__(self, spark: SparkSession, source: Source, quirks: bool = False):
        self.spark, self.source, self.quirks = spark, source, quirks
        self.expressions = Compiler(quirks)

    def check(self, node) -> None:
        if isinstance(node, Filter):
            self.expressions.check(node.expression)
        elif isinstance(node, Group):
            for x in node.parts:
                self.check(x)
        elif isinstance(node, Union):
            for x in node.branches:
                self.check(x)

    # Patterns

    def bgp(self, patterns: list[Pattern], start: Relation | None = None) -> Relation:
        names = list(dict.fromkeys(v for p in patterns for v in p.variables()))
        if start is not None:
            names = list(dict.fromkeys([*start.encs, *names]))
        if not patterns:
            return start or unit(self.spark)
        units = plan(patterns, self.source, set(start.encs) if start else set())
        if units is None:
            log.info("no match for some pattern of %s", "; ".join(map(str, patterns)))
            return nothing(self.spark, names)
        out = start
        for i, u in enumerate(units):
            log.info("step %d, about %.0f rows: %s", i, u.count, "; ".join(map(str, u.patterns)))
            found = self.source.star(u.patterns) if len(u.patterns) > 1 else self.match(u.patterns[0], out)
            out = found if out is None else join(out, found, self.tiles(units[:i], u) if start is None else None)
            if out.empty:
                return nothing(self.spark, names)
        return out.select([v for v in names if v in out.encs])

    def tiles(self, before: list[Unit], new: Unit) -> Tiles | None:
        """How the join of what came before with a unit is cut; rows are counted only where estimates say that they may make many pairs."""
        if not set().union(*(u.variables for u in before)) & new.variables:
            return None

        def sizes(exact: bool) -> tuple[Size, Size, set[str]]:
            held, known = Size.of(before[0], self.source, exact), before[0].variables
            for u in before[1:]:
                held, known = held.joined(Size.of(u, self.source, exact), known & u.variables), known | u.variables
            return held, Size.of(new, self.source, exact), known & new.variables

        held, size, shared = sizes(False)
        if held.keys(size, shared) is None or held.joined(size, shared).rows < LOOK:
            return None
        held, size, shared = sizes(True)
        cut = held.tiles(size, shared, self.spark.sparkContext.defaultParallelism)
        if cut is not None:
            log.info("about %.0f pairs in %d tasks; each key in %d parts", held.joined(size, shared).rows, cut.tasks, cut.parts)
        return cut

    def match(self, p: Pattern, known: Relation | None) -> Relation:
        """A pattern's solutions; what is known of its subject may narrow where to look."""
        if known is not None and T.py_is_open(p.s) and p.s in known.encs and p.s not in known.maybe:
            return self.source.about(p, known.encs[p.s])
        return self.source.match(p)

    def group(self, node: Group, start: Relation | None = None) -> Relation:
        """Parts joined in order; adjacent patterns are planned together, filters hold for the whole group."""
        out, patterns, filters = start, [], []
        started = start is not None

        def flush() -> None:
            nonlocal out, patterns, started
            if patterns:
                found = self.bgp(patterns)
                out = join(out, found) if started else found
                started, patterns = True, []

        def settled() -> Relation:
            return out if started else unit(self.spark)

        for part in node.parts:
            if isinstance(part, Bgp):
                patterns += part.patterns
            elif isinstance(part, Filter):
                self.expressions.check(part.expression)
                if self.quirks:
                    flush()
                    out, started = self.filter(settled(), part.expression), True
                else:
                    filters.append(part.expression)
            elif isinstance(part, Group) and part.optional:
                flush()
                inner, conditions = part, []
                if not self.quirks:
                    conditions = [x.expression for x in part.parts if isinstance(x, Filter)]
                    inner = Group([x for x in part.parts if not isinstance(x, Filter)])
                    for e in conditions:
                        self.expressions.check(e)
                keep = None
                if conditions:
                    keep = lambda scope, cs=conditions: reduce(lambda a, b: a & b, [self.expressions.keep(e, scope) for e in cs])
                out, started = left_join(settled(), self.group(inner), keep), True
            elif isinstance(part, Group):
                flush()
                found = self.group(part)
                out, started = (join(out, found) if started else found), True
            elif isinstance(part, Union):
                flush()
                found = union([self.group(b) for b in part.branches])
                out, started = (join(out, found) if started else found), True
            else:
                raise UnsupportedQueryError(f"Unsupported group element: {type(part).__name__}")
        flush()
        out = settled()
        for e in filters:
            out = self.filter(out, e)
        return out

    def filter(self, rows: Relation, e: object) -> Relation:
        return rows if rows.empty else rows.where(self.expressions.keep(e, rows))

    # Modifiers

    def sort_keys(self, e: object, scope: Relation) -> list[Column]:
        """Columns whose ascending order is the order of terms: unbound, blank nodes, IRIs, literals; numbers by value."""
        v = self.expressions.value(e, scope)
        bad = F.lit(False)
        if v.undefined is not None:
            bad = bad | v.undefined
        if v.error is not None:
            bad = bad | F.coalesce(v.error, F.lit(False))
        if self.quirks:
            return [F.when(bad, "").otherwise(v.term())]
        if v.kind in ("num", "bool", "str"):
            return [F.when(~bad, v.col)] if v.undefined is not None or v.error is not None else [v.col]
        t = v.term()
        if v.iri:
            return [F.when(bad, F.lit(None)).otherwise(t)]
        rank = F.when(bad, 0).when(T.is_blank(t) | t.rlike(T.GENID), 1).when(~T.is_literal(t), 2).otherwise(3)
        number = F.when(T.is_numeric(t), T.number(T.lexical(t)))
        return [rank, number, F.when(~bad, t)]

    def order(self, q: Query) -> list[tuple[object, bool]]:
        for e, _ in q.order:
            self.expressions.check(e)
        return q.order[:1] if self.quirks else q.order

    def select(self, q: Query, rows: Relation) -> Relation:
        names = q.named() if q.variables == ["*"] else list(dict.fromkeys(q.variables))
        keys, directions = [], []
        for e, ascending in self.order(q):
            for key in self.sort_keys(e, rows):
                keys.append(key)
                directions.append(ascending)
        sort = [f"__sort{i}" for i in range(len(keys))]
        shown = [column(v) if v in rows.encs else F.lit(None).cast("string").alias(v) for v in names]
        df = rows.df.select(*shown, *[k.alias(s) for k, s in zip(keys, sort, strict=True)])
        by = [F.col(s).asc_nulls_first() if up else F.col(s).desc_nulls_last() for s, up in zip(sort, directions, strict=True)]
        if q.distinct:
            if sort:  # a row's place is that of its first occurrence
                first = F.struct(*sort)
                pick = F.min(first) if all(directions) else F.max(first) if not any(directions) else F.min_by(first, F.struct(*[k for k, up in zip(sort, directions, strict=True) if up]))
                df = df.groupBy(*[column(v) for v in names]).agg(pick.alias("__first")).select(*[column(v) for v in names], "__first.*")
            else:
                df = df.distinct()
        if by:
            df = df.orderBy(*by)
        df = self.slice(df, q).select(*[column(v) for v in names])
        encs = {v: rows.encs.get(v, TERM) for v in names}
        return Relation(df, encs, rows.maybe | frozenset(v for v in names if v not in rows.encs))

    @staticmethod
    def slice(df: DataFrame, q: Query) -> DataFrame:
        if q.offset:
            df = df.offset(q.offset)
        return df if q.limit is None else df.limit(q.limit)

    def solutions(self, q: Query, rows: Relation) -> Relation:
        """All variables, ordered; sliced unless slicing counts triples."""
        keys = []
        for e, up in self.order(q):
            keys += [k.asc_nulls_first() if up else k.desc_nulls_last() for k in self.sort_keys(e, rows)]
        df = rows.df.orderBy(*keys) if keys else rows.df
        return Relation(df if self.quirks else self.slice(df, q), rows.encs, rows.maybe, rows.empty)

    # Query forms

    def construct(self, q: Query, rows: Relation) -> DataFrame:
        rows = self.solutions(q, rows)
        constant = [p for p in q.template if not any(T.py_is_variable(t) or (t.startswith("_:") and not self.quirks) for t in p)]  # blank nodes are new ones in every solution
        per_row = [p for p in q.template if p not in constant]
        fresh = F.concat(F.lit("_:b"), F.monotonically_increasing_id().cast("string"), F.lit("_"))
        blanks = {t: i for i, t in enumerate(dict.fromkeys(t for p in per_row for t in p if t.startswith("_:")))}

        def cell(t: str) -> Column:
            if t.startswith("_:"):
                return F.concat(F.col("__solution"), F.lit(str(blanks[t])))
            if T.py_is_variable(t):
                return T.deskolemise(rows.term(t)) if t in rows.encs else F.lit(None).cast("string")
            return F.lit(t)

        parts = []
        if per_row:
            numbered = rows.df.withColumn("__solution", fresh)
            made = numbered.select(F.inline(F.array(*[F.struct(*[cell(t).alias(x) for x, t in zip("spo", p, strict=True)]) for p in per_row])))
            parts.append(made.where("s is not null and p is not null and o is not null").where(~T.is_literal(F.col("s")) & ~T.is_literal(F.col("p")) & ~T.is_blank(F.col("p"))))
        if constant:
            once = self.spark.createDataFrame([tuple(p) for p in constant], TRIPLE)
            if not self.quirks:  # only if there is a solution
                once = once.crossJoin(F.broadcast(rows.df.limit(1).select(F.lit(1).alias("__any")))).drop("__any")
            parts.append(once)
        out = parts[0] if parts else self.spark.createDataFrame([], TRIPLE)
        for other in parts[1:]:
            out = out.unionAll(other)
        return self.slice(out, q) if self.quirks else out

    def describe(self, q: Query, rows: Relation) -> DataFrame:
        """All triples with a described resource as subject, each once."""
        rows = self.solutions(q, rows)
        names = q.named() if q.variables == ["*"] else [v for v in q.variables if T.py_is_variable(v)]
        parts = []
        for v in names:
            if v in rows.encs:
                own = Relation(rows.df.where(column(v).isNotNull()).select(column(v)).distinct(), {v: rows.encs[v]})
                found = join(own, self.match(Pattern(v, "?__predicate", "?__object"), own))
                parts.append(found.df.select(found.term(v).alias("s"), found.term("?__predicate").alias("p"), found.term("?__object").alias("o")))
        for iri in q.variables:
            if not T.py_is_variable(iri) and iri != "*":
                found = self.source.match(Pattern(iri, "?__predicate", "?__object"))
                parts.append(found.df.select(F.lit(iri).alias("s"), found.term("?__predicate").alias("p"), found.term("?__object").alias("o")))
        if not parts:
            return self.spark.createDataFrame([], TRIPLE)
        out = parts[0]
        for other in parts[1:]:
            out = out.unionAll(other)
        out = out.select(*[T.deskolemise(F.col(x)).alias(x) for x in "spo"]).distinct()
        return self.slice(out, q) if self.quirks else out

    def ask(self, rows: Relation) -> DataFrame:
        return rows.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))

    def where(self, q: Query, seed: Relation | None = None) -> Relation:
        self.check(q.where)
        if not q.where.parts and seed is None:
            return unit(self.spark)
        rows = self.group(q.where)
        return rows if seed is None else join(seed, rows)

