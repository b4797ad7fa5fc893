"""What every source of triples offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.algebra import Pattern
from ..plans.relation import TERM, Enc, Relation, column, nothing


def impossible(p: Pattern) -> bool:
    """Patterns that no triple can match: a literal as subject or predicate."""
    return T.py_is_literal(p.s) or T.py_is_literal(p.p)


def bind(df: DataFrame, p: Pattern) -> Relation:
    """Solutions of a pattern over rows (s, p, o): constants filter, variables name columns, repeated ones must agree."""
    names: dict[str, str] = {}
    for part, t in zip("spo", p, strict=True):
        if not T.py_is_open(t):
            df = df.where(F.col(part) == t)
        elif t in names:
            df = df.where(F.col(part) == F.col(names[t]))
        else:
            names[t] = part
    return Relation(df.select(*[F.col(part).alias(v) for v, part in names.items()]), dict.fromkeys(names, TERM))


class Source:
    """A set of triples that answers patterns."""

    spark: SparkSession

    def scan(self, p: Pattern) -> Relation:
        raise NotImplementedError

    def star(self, patterns: list[Pattern]) -> Relation | None:
        """Patterns with one subject variable as one scan, or None if the source can't."""
        return None

    def count(self, p: Pattern) -> float:
        """Estimated number of matches; 0 only if there are none."""
        raise NotImplementedError

    def estimate(self, p: Pattern) -> float:
        """Like count(), for ordering joins; cheaper where a source can."""
        return self.count(p)

    def values(self, p: Pattern, v: str, exact: bool = False) -> float | None:
        """At most so many terms stand for the variable v in p's matches, or None if that isn't known. exact: by count(), not estimate()."""
        return None

    def match(self, p: Pattern) -> Relation:
        """scan(), or no rows at once for patterns that can't match."""
        if impossible(p):
            return nothing(self.spark, p.variables())
        return self.scan(p)

    def about(self, p: Pattern, subject: Enc) -> Relation:
        """Like match(), where p's subject is a variable known to be so encoded; other subjects may be left out."""
        return self.match(p)

    def triples(self) -> DataFrame:
        """All triples as text."""
        r = self.scan(Pattern("?s", "?p", "?o")).as_terms(["?s", "?p", "?o"])
        return r.df.select(*[column(f"?{x}").alias(x) for x in "spo"])
