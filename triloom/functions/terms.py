"""RDF terms as text: Column functions and their plain Python counterparts.

A term is one string: ``"lex"``, ``"lex"@lang`` or ``"lex"^^datatype`` for a literal, ``_:id`` for a blank node, else an IRI.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
INTEGER, DOUBLE, DECIMAL, BOOLEAN, STRING = (XSD + x for x in ("integer", "double", "decimal", "boolean", "string"))
DATETIME = XSD + "dateTime"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
NUMERIC = (INTEGER, DOUBLE, DECIMAL, *(XSD + x for x in ("float", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger")))
GENID = r"^https?://[^/]+/\.well-known/genid/"
SKOLEM = "http://local/.well-known/genid/"

_NUMBER = r"^\s*([-+]?(?:Infinity|[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?|\.[0-9]+(?:[eE][-+]?[0-9]+)?))"
NUMBER_LIKE = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*$"


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def lexical(t: Column) -> Column:
    """Text of a literal; of other terms the empty string."""
    return F.regexp_extract(t, r'(?s)^"(.*)"', 1)


def language(t: Column) -> Column:
    """Language of a literal in lower case, or the empty string."""
    return F.lower(F.regexp_extract(t, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1))


def datatype(t: Column) -> Column:
    """Datatype of a typed literal, or the empty string."""
    return F.regexp_extract(t, r'(?s)^".*"\^\^([^"]+)$', 1)


def number(lex: Column) -> Column:
    """The number a text starts with, NaN if none."""
    return F.coalesce(F.regexp_extract(lex, _NUMBER, 1).try_cast("double"), F.lit(float("nan")))


def is_numeric(t: Column) -> Column:
    return datatype(t).isin(*NUMERIC)


def truth(t: Column) -> Column:
    """Everything is true but "false"^^xsd:boolean and literals whose text is 0."""
    return ~((t == f'"false"^^{BOOLEAN}') | (is_literal(t) & (lexical(t) == "0")))


def literal(lex: Column, datatype_iri: str | None = None) -> Column:
    return F.concat(F.lit('"'), lex, F.lit('"' if datatype_iri in (None, "", STRING) else f'"^^{datatype_iri}'))


def skolemise(t: Column) -> Column:
    """Blank nodes as IRIs, so that they take part in matching like any other term."""
    return F.when(is_blank(t), F.concat(F.lit(SKOLEM), F.substring(t, 3, 1 << 30))).otherwise(t)


def deskolemise(t: Column) -> Column:
    """Such IRIs as blank nodes again, characters other than letters, digits and _ replaced by _."""
    return F.when(t.rlike(GENID), F.concat(F.lit("_:"), F.regexp_replace(F.regexp_replace(t, GENID, ""), r"[^A-Za-z0-9_]", "_"))).otherwise(t)


# Plain Python


def py_is_variable(t: str) -> bool:
    return t.startswith("?")


def py_is_open(t: str) -> bool:
    """Variables, and blank nodes of a query, which are variables that aren't projected."""
    return t.startswith(("?", "_:"))


def py_is_literal(t: str) -> bool:
    return t.startswith('"')


_LITERAL = re.compile(r'^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^([^"]+))?$', re.S)


def py_literal(t: str) -> tuple[str, str | None, str | None]:
    """(text, language, datatype) of a literal."""
    m = _LITERAL.match(t)
    if not m:
        raise ValueError(f"not a literal: {t}")
    return m[1], m[2], m[3]


def py_deskolemise(t: str) -> str:
    rest = re.sub(GENID, "", t)
    return t if rest == t else "_:" + re.sub(r"[^A-Za-z0-9_]", "_", rest)


_KEPT = "".join(chr(c) for c in b"#$&+,/:;=?@")


def py_same_url(a: str, b: str) -> bool:
    """Equality of two URLs after percent-decoding, reserved characters staying encoded."""
    return _decoded(a) == _decoded(b)


def _decoded(url: str) -> str:
    def one(m: re.Match) -> str:
        data = bytes.fromhex(m[0].replace("%", ""))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return m[0]
        return "".join(f"%{ord(c):02X}" if c in _KEPT else c for c in text)

    return re.sub(r"(?:%[0-9A-Fa-f]{2})+", one, url)


def py_abbreviate(t: str) -> str:
    """A short form for plans and logs: the last part of an IRI, the text of a literal."""
    if py_is_open(t):
        return t
    if py_is_literal(t):
        return f'"{py_literal(t)[0][:40]}"'
    return re.split(r"[#/]", t.rstrip("/#"))[-1] or t
