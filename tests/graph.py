"""A tiny graph, and a brute-force evaluator of the algebra over it."""

from __future__ import annotations

import itertools

from triloom.functions.terms import py_is_open
from triloom.plans.algebra import Bgp, Filter, Group, Op, Union

T = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
INT = "http://www.w3.org/2001/XMLSchema#integer"
E = "http://e/"


def e(name: str) -> str:
    return E + name


TRIPLES = [
    (e("york"), e("name"), '"York"@en'),
    (e("york"), e("name"), '"York"@de'),
    (e("york"), T, e("City")),
    (e("york"), e("people"), f'"200000"^^{INT}'),
    (e("ontario"), e("name"), '"York"@en'),
    (e("ontario"), T, e("City")),
    (e("ontario"), e("people"), f'"900"^^{INT}'),
    (e("ghent"), e("name"), '"Ghent"@en'),
    (e("ghent"), T, e("City")),
    (e("ann"), T, e("Artist")),
    (e("ann"), e("born"), e("york")),
    (e("ann"), e("age"), f'"41"^^{INT}'),
    (e("bob"), T, e("Artist")),
    (e("bob"), e("born"), e("ontario")),
    (e("bob"), e("knows"), e("ann")),
    (e("cat"), T, e("Artist")),
    (e("cat"), e("born"), e("york")),
    (e("cat"), e("knows"), e("cat")),
    (e("cat"), e("died"), e("ghent")),
    (e("dan"), e("born"), e("ghent")),
    (e("dan"), e("knows"), "_:someone"),
    ("_:someone", e("age"), f'"7"^^{INT}'),
]


def _number(t):
    return float(t.split('"')[1]) if t.endswith(INT) else None


def _holds(x, row):
    """Three-valued: True, False or None (error), for the few operators the differential test uses."""
    if x.name == "bound":
        return x.args[0] in row
    if x.name == "!":
        v = _holds(x.args[0], row)
        return None if v is None else not v
    if x.name in ("&&", "||"):
        a, b = (_holds(y, row) for y in x.args)
        stop = x.name == "||"
        return stop if stop in (a, b) else None if None in (a, b) else not stop
    a, b = (row.get(y) if y.startswith("?") else y for y in x.args)
    if a is None or b is None:
        return None
    na, nb = _number(a), _number(b)
    if x.name in ("=", "!="):
        same = na == nb if na is not None and nb is not None else a == b
        return same if x.name == "=" else not same
    if na is None or nb is None:
        return None if not (a.startswith('"') and b.startswith('"')) else False
    return na > nb if x.name == ">" else na < nb


def _join(a, b):
    return {**a, **b} if all(a[k] == b[k] for k in a.keys() & b.keys()) else None


def solve(node, triples) -> list[dict]:
    """Solutions by definition: bottom-up, bags, filters over the group."""
    if isinstance(node, Bgp):
        rows = [{}]
        for p in node.patterns:
            out = []
            for row, t in itertools.product(rows, triples):
                new = {}
                for q, v in zip(p, t, strict=True):
                    if py_is_open(q):
                        if new.setdefault(q, v) != v:
                            break
                    elif q != v:
                        break
                else:
                    if (joined := _join(row, new)) is not None:
                        out.append(joined)
            rows = out
        return rows
    if isinstance(node, Union):
        return [row for b in node.branches for row in solve(b, triples)]
    rows, filters = [{}], []
    for part in node.parts:
        if isinstance(part, Filter):
            filters.append(part.expression)
        elif isinstance(part, Group) and part.optional:
            inner = Group([x for x in part.parts if not isinstance(x, Filter)])
            own = [x.expression for x in part.parts if isinstance(x, Filter)]
            found, out = solve(inner, triples), []
            for row in rows:
                hits = [j for f in found if (j := _join(row, f)) is not None and all(_holds(x, j) for x in own)]
                out += hits or [row]
            rows = out
        else:
            found = solve(part, triples)
            rows = [j for row in rows for f in found if (j := _join(row, f)) is not None]
    return [row for row in rows if all(_holds(x, row) for x in filters)]


__all__ = ["Op", "TRIPLES", "e", "solve"]
