import pytest

from triloom.functions.terms import DECIMAL, DOUBLE, INTEGER, RDF, RDF_TYPE
from triloom.plans.algebra import Bgp, Filter, Group, InvalidQueryError, Op, Pattern, Union, UnsupportedQueryError
from triloom.plans.parser import parse, parse_turtle


def patterns(text):
    return parse(text).where.parts[0].patterns


def test_lists_types_and_prefixes():
    found = patterns("PREFIX x: <http://x/> SELECT * { ?s a x:T ; rdfs:label 'a', \"b\"@EN ; . }")
    assert found == [Pattern("?s", RDF_TYPE, "http://x/T"), Pattern("?s", "http://www.w3.org/2000/01/rdf-schema#label", '"a"'), Pattern("?s", "http://www.w3.org/2000/01/rdf-schema#label", '"b"@en')]


def test_blank_nodes_are_variables_that_are_not_projected():
    q = parse("SELECT * WHERE { ?p <u:b> [ <u:n> _:l ; <u:m> [] ] }")
    assert q.named() == ["?p"]
    assert len(q.where.parts[0].patterns) == 3


def test_collections():
    assert [p.p for p in patterns("SELECT * { ?s <u:p> (1 2) }")] == [RDF + "first", RDF + "rest", RDF + "first", RDF + "rest", "u:p"]


def test_dollar_and_digit_variables_and_missing_spaces():
    assert patterns("SELECT $1 WHERE { $1<u:p>?2.?2 <u:q> 5 }") == [Pattern("?1", "u:p", "?2"), Pattern("?2", "u:q", f'"5"^^{INTEGER}')]


def test_numbers_and_long_strings():
    assert [p.o for p in patterns("SELECT * { ?s ?p 1, -2, 1.5, 1e3, true, '''a\n\"b''', \"\\u0041\\n\" }")] == [
        f'"1"^^{INTEGER}', f'"-2"^^{INTEGER}', f'"1.5"^^{DECIMAL}', f'"1e3"^^{DOUBLE}', '"true"^^http://www.w3.org/2001/XMLSchema#boolean', '"a\n"b"', '"A\n"',
    ]


def test_groups_unions_filters_and_stray_dots():
    q = parse("SELECT * { { ?a ?b ?c } UNION { ?a ?b ?d } . OPTIONAL { ?x ?y ?z } . FILTER LANGMATCHES(LANG(?c), 'EN') FILTER (xsd:double(?c) > 1 || !bound(?d) && ?c = 2) }")
    kinds = [type(x) for x in q.where.parts]
    assert kinds == [Union, Group, Filter, Filter] and q.where.parts[1].optional
    assert q.where.parts[2].expression == Op("langmatches", (Op("lang", ("?c",)), '"EN"'))
    top = q.where.parts[3].expression
    assert top.name == "||" and top.args[1].name == "&&"


def test_precedence():
    x = parse("SELECT * { ?a ?b ?c FILTER(1 + 2 * ?c < 4 - 1) }").where.parts[1].expression
    assert x.name == "<" and x.args[0].name == "+" and x.args[0].args[1].name == "*" and x.args[1].name == "-"


def test_modifiers_in_either_order():
    q = parse("SELECT DISTINCT ?a { ?a ?b ?c } ORDER BY ?b DESC(?c) OFFSET 10 LIMIT 5")
    assert (q.distinct, q.offset, q.limit) == (True, 10, 5) and q.order == [("?b", True), ("?c", False)]


def test_forms():
    assert parse("ASK { <u:x> ?p ?o }").form == "ASK"
    assert parse("DESCRIBE <u:x> ?y WHERE { ?y ?p ?o }").variables == ["u:x", "?y"]
    assert parse("DESCRIBE <u:x>").where.parts == []
    q = parse("CONSTRUCT WHERE { ?a <u:p> ?b }")
    assert q.template == q.where.parts[0].patterns == [Pattern("?a", "u:p", "?b")]
    assert isinstance(q.where.parts[0], Bgp)


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT * {", "SELECT * { ?a ?b }", "SELECT ?a { ?a nope:b ?c }", "SELECT * { ?a ?b ?c } LIMIT x", "SELECT * { ?a ?b ?c } }", "SELECT * { ?a ?b ?c FILTER }"])
def test_invalid(text):
    with pytest.raises(InvalidQueryError, match="Parse error"):
        parse(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT (1 AS ?x) { ?a ?b ?c }", "SELECT * { ?a ?b ?c } GROUP BY ?a", "SELECT REDUCED * { ?a ?b ?c }", "SELECT * FROM <u:g> { ?a ?b ?c }", "SELECT * { ?a ?b ?c } VALUES ?a { 1 }",
        "SELECT * { BIND(1 AS ?x) }", "SELECT * { ?a ?b ?c MINUS { ?a ?b 1 } }", "SELECT * { GRAPH ?g { ?a ?b ?c } }", "SELECT * { { SELECT * { ?a ?b ?c } } }", "SELECT * { ?a <u:p>/<u:q> ?c }",
        "SELECT * { ?a ?b ?c FILTER EXISTS { ?a ?b 1 } }", "SELECT * { ?a ?b ?c FILTER(?a IN (1, 2)) }", "SELECT * { ?a ?b ?c FILTER(-?c > 1) }", "INSERT DATA { <u:a> <u:b> <u:c> }",
    ],
)
def test_unsupported(text):
    with pytest.raises(UnsupportedQueryError):
        parse(text)


def test_turtle_and_trig():
    quads = parse_turtle('@prefix x: <http://x/>.\n@base <http://b/>.\n<a> a x:T, x:U ; x:n "1"^^x:int .\nPREFIX y: <http://y/>\n<http://g/#m> { <> y:p [ y:q 1.0 ] }\n{ _:a x:b <c> }', "http://d/")
    assert quads[0] == ("http://b/a", RDF_TYPE, "http://x/T", None)
    assert [q[3] for q in quads] == [None, None, None, "http://g/#m", "http://g/#m", None]
    assert quads[-1][2] == "http://b/c"
    with pytest.raises(InvalidQueryError):
        parse_turtle("<a> <b>")
