"""Results as text, chunk by chunk: rows are pulled from the cluster a partition at a time."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

from ..engine import Result
from ..functions import terms as T

Writer = Callable[[Result], Iterator[str]]
WIDTH = 50


def _json(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def write_json(r: Result) -> Iterator[str]:
    """An array of objects, keys with ?, null for unbound."""
    yield "["
    empty = True
    for item in [r.boolean()] if r.form == "ASK" else r.rows():
        yield ("\n" if empty else ",\n") + _json(item)
        empty = False
    yield "]\n" if empty else "\n]\n"


def _cell(t: str) -> dict[str, str]:
    if T.py_is_literal(t):
        lex, lang, dt = T.py_literal(t)
        return {"value": lex, "type": "literal"} | ({"xml:lang": lang} if lang else {"datatype": dt} if dt else {})
    return {"value": t, "type": "bnode" if t.startswith("_:") else "uri"}


def write_sparql_json(r: Result) -> Iterator[str]:
    names = [v[1:] for v in r.variables]
    yield '{"head": ' + _json({"vars": names} if names else {}) + ",\n"
    if r.form == "ASK":
        yield '"boolean":' + _json(r.boolean()) + "}\n"
        return
    yield '"results": { "bindings": ['
    empty = True
    for row in r.rows():
        yield ("\n" if empty else ",\n") + _json({v[1:]: _cell(t) for v, t in row.items() if t is not None})
        empty = False
    yield "] }}\n" if empty else "\n]}}\n"


def write_sparql_xml(r: Result) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n'
    if r.variables:
        yield "  <head>\n" + "".join(f"    <variable name={quoteattr(v[1:])}/>\n" for v in r.variables) + "  </head>\n"
    if r.form == "ASK":
        yield f"  <boolean>{_json(r.boolean())}</boolean>\n</sparql>\n"
        return
    yield "  <results>\n"
    for row in r.rows():
        lines = ["    <result>"]
        for v, t in row.items():
            if t is None:
                continue
            cell = _cell(t)
            extra = f" xml:lang={quoteattr(cell['xml:lang'])}" if "xml:lang" in cell else f" datatype={quoteattr(cell['datatype'])}" if "datatype" in cell else ""
            lines += [f"      <binding name={quoteattr(v[1:])}>", f"        <{cell['type']}{extra}>{escape(cell['value'])}</{cell['type']}>", "      </binding>"]
        yield "\n".join([*lines, "    </result>"]) + "\n"
    yield "  </results>\n</sparql>\n"


def write_simple(r: Result) -> Iterator[str]:
    """A block of "name: value" lines per row."""
    if r.form == "ASK":
        yield _json(r.boolean()) + "\n"
        return
    longest = max((len(v) - 1 for v in r.variables), default=0)
    for i, row in enumerate(r.rows()):
        yield ("\n" if i else "") + "".join(f"{v[1:].rjust(longest)}: {'null' if t is None else t}\n" for v, t in row.items())


def write_table(r: Result) -> Iterator[str]:
    """Columns of fixed width, longer values cut."""
    if r.form == "ASK":
        yield _json(r.boolean()) + "\n"
        return
    pad = lambda x: x.ljust(WIDTH) if len(x) <= WIDTH else x[: WIDTH - 1] + "…"
    head = " ".join(pad(v[1:]) for v in r.variables)
    yield f"{head}\n{'-' * len(head)}\n"
    for row in r.rows():
        yield " ".join(pad("null" if t is None else t) for t in row.values()) + "\n"


def write_stats(r: Result) -> Iterator[str]:
    """Number and delay of each result, for measuring."""
    began = time.perf_counter()
    delay = lambda: f"{(time.perf_counter() - began) * 1000:.3f}"
    yield "Result,Delay (ms)\n"
    for i, _ in enumerate([r.boolean()] if r.form == "ASK" else r.rows()):
        yield f"{i + 1},{delay()}\n"
    yield f"TOTAL,{delay()}\n"


def _turtle_term(t: str, prefixes: dict[str, str]) -> str:
    if T.py_is_literal(t):
        lex, lang, dt = T.py_literal(t)
        text = _json(lex)
        return text + (f"@{lang}" if lang else f"^^{_turtle_term(dt, prefixes)}" if dt else "")
    if t.startswith("_:"):
        return t
    for name, iri in prefixes.items():
        local = t[len(iri) :]
        if t.startswith(iri) and local.isidentifier() and local.isascii():
            return f"{name}:{local}"
    return f"<{t}>"


def write_turtle(r: Result, prefixes: dict[str, str] | None = None) -> Iterator[str]:
    """Triples of CONSTRUCT and DESCRIBE; subjects and predicates that follow themselves are not repeated."""
    prefixes = prefixes or {}
    for name, iri in prefixes.items():
        yield f"@prefix {name}: <{iri}>.\n"
    subject = predicate = None
    for row in r.frame.toLocalIterator():
        s, p, o = (_turtle_term(t, prefixes) for t in row)
        if s == subject:
            yield f", {o}" if p == predicate else f";\n    {p} {o}"
        else:
            yield ("" if subject is None else ".\n") + f"{s} {p} {o}"
        subject, predicate = s, p
    if subject is not None:
        yield ".\n"


#: Media types of solutions and booleans.
WRITERS: dict[str, Writer] = {
    "application/json": write_json,
    "application/sparql-results+json": write_sparql_json,
    "application/sparql-results+xml": write_sparql_xml,
    "simple": write_simple,
    "table": write_table,
    "debug": write_stats,
}


def register(media_type: str, writer: Writer) -> None:
    WRITERS[media_type] = writer


def write(r: Result, media_type: str = "application/json", prefixes: dict[str, str] | None = None) -> Iterator[str]:
    """Triples as Turtle whatever the type; else by the type, ValueError if it has no writer."""
    if r.form in ("CONSTRUCT", "DESCRIBE"):
        return write_turtle(r, prefixes)
    if media_type not in WRITERS:
        raise ValueError(f"No writer is registered for {media_type}")
    return WRITERS[media_type](r)


def save_ntriples(r: Result, path: str) -> None:
    """Triples of CONSTRUCT and DESCRIBE written by the cluster, a line each."""
    from pyspark.sql import functions as F

    def cell(c):
        lex = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(T.lexical(c), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")
        tail = F.regexp_extract(c, r'(?s)^".*"(@[A-Za-z0-9-]+)$', 1)
        dt = T.datatype(c)
        literal = F.concat(F.lit('"'), lex, F.lit('"'), tail, F.when(dt != "", F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise(""))
        return F.when(T.is_literal(c), literal).when(T.is_blank(c), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    r.frame.select(F.concat(*[x for k in "spo" for x in (cell(F.col(k)), F.lit(" "))], F.lit(".")).alias("value")).write.text(path)
