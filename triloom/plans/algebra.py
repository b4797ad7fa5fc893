"""Queries as data: patterns, groups and the four query forms."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.terms import py_abbreviate, py_is_open


class InvalidQueryError(Exception):
    """The text is not a query."""


class UnsupportedQueryError(Exception):
    """A query that this engine doesn't evaluate."""


@dataclass(frozen=True)
class Pattern:
    s: str
    p: str
    o: str

    def __iter__(self):
        return iter((self.s, self.p, self.o))

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t for t in self if py_is_open(t)))

    def __str__(self) -> str:
        return " ".join(map(py_abbreviate, self))

    def matches(self, s: str, p: str, o: str) -> bool:
        """Whether a triple fits: constants are equal, repeated variables agree."""
        seen: dict[str, str] = {}
        return all(seen.setdefault(t, v) == v if py_is_open(t) else t == v for t, v in zip(self, (s, p, o), strict=True))

    def bound_by(self, general: Pattern) -> bool:
        """Whether this pattern is an instance of a more general one."""
        return all(py_is_open(g) or g == t for t, g in zip(self, general, strict=True))


@dataclass(frozen=True)
class Op:
    """An operator or function applied to expressions; terms are plain strings."""

    name: str
    args: tuple


@dataclass
class Bgp:
    patterns: list[Pattern]


@dataclass
class Filter:
    expression: object


@dataclass
class Group:
    parts: list
    optional: bool = False


@dataclass
class Union:
    branches: list[Group]


@dataclass
class Query:
    form: str  # SELECT, CONSTRUCT, DESCRIBE, ASK
    where: Group
    variables: list[str] = field(default_factory=list)  # of SELECT and DESCRIBE; ["*"] for all
    template: list[Pattern] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[object, bool]] = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0

    def named(self) -> list[str]:
        """Variables of the WHERE clause in order of first use, blank nodes left out."""
        return [v for v in in_scope(self.where) if v.startswith("?")]


def in_scope(node) -> list[str]:
    if isinstance(node, Bgp):
        found = [v for p in node.patterns for v in p.variables()]
    elif isinstance(node, Group):
        found = [v for x in node.parts for v in in_scope(x)]
    elif isinstance(node, Union):
        found = [v for x in node.branches for v in in_scope(x)]
    else:
        found = []
    return list(dict.fromkeys(found))
