import itertools
import random
from collections import Counter

import pytest
from graph import TRIPLES, e, solve
from pyspark.sql import functions as F

from triloom.engine import Engine, UnsupportedQueryError
from triloom.functions.expressions import evaluate
from triloom.functions.terms import BOOLEAN, DOUBLE, INTEGER, py_abbreviate, py_deskolemise, py_same_url
from triloom.plans.algebra import Op, Pattern
from triloom.plans.parser import parse
from triloom.plans.planner import components, plan
from triloom.plans.relation import TERM, Relation, Tiles, join, left_join
from triloom.sources.federated import FederatedSource
from triloom.sources.triples import TripleSource, from_rows, read_triples, write_triples

P = "PREFIX e: <http://e/> "


@pytest.fixture(scope="module")
def source(spark):
    s = from_rows(spark, TRIPLES)
    s.df = s.df.cache()
    return s


@pytest.fixture(scope="module")
def engine(spark, source):
    return Engine(spark, source)


def rows(engine, text, seed=None):
    return [{k: v for k, v in r.items() if v is not None} for r in engine.sparql(P + text, seed).rows()]


def same(a, b):
    key = lambda r: tuple(sorted(r.items()))
    assert Counter(map(key, a)) == Counter(map(key, b))


def test_join_of_three(engine):
    same(rows(engine, 'SELECT ?p ?c { ?p a e:Artist . ?p e:born ?c . ?c e:name "York"@en }'), [{"?p": e("ann"), "?c": e("york")}, {"?p": e("cat"), "?c": e("york")}, {"?p": e("bob"), "?c": e("ontario")}])


def test_repeated_variable(engine):
    same(rows(engine, "SELECT * { ?x e:knows ?x }"), [{"?x": e("cat")}])


def test_blank_data_nodes_match_and_come_out_as_blanks(engine):
    same(rows(engine, "SELECT * { e:dan e:knows ?x . ?x e:age ?a }"), [{"?x": "_:someone", "?a": f'"7"^^{INTEGER}'}])


def test_seed(engine, spark):
    seed = spark.createDataFrame([(e("york"), "x"), (None, "y")], "`?c` string, `?a` string")
    found = rows(engine, "SELECT * { ?p e:born ?c }", seed)
    same(found, [{"?p": e("ann"), "?c": e("york"), "?a": "x"}, {"?p": e("cat"), "?c": e("york"), "?a": "x"}, *[{"?p": e(p), "?c": e(c), "?a": "y"} for p, c in (("ann", "york"), ("bob", "ontario"), ("cat", "york"), ("dan", "ghent"))]])


def test_empty_where_and_cartesian(engine):
    assert rows(engine, "SELECT * { }") == [{}]
    assert len(rows(engine, "SELECT * { ?a a e:Artist . ?b a e:City }")) == 9


def test_ask_construct_describe(engine):
    assert engine.sparql(P + "ASK { e:ann ?p ?o }").boolean() is True
    assert engine.sparql(P + "ASK { e:eve ?p ?o }").boolean() is False
    made = [tuple(r) for r in engine.sparql(P + "CONSTRUCT { ?p e:in ?c . ?p e:of ?d . [] e:k ?c . e:x e:y 1 . ?n e:bad ?p } { ?p a e:Artist ; e:born ?c OPTIONAL { ?p e:died ?d } OPTIONAL { ?c e:name ?n } }").terms().collect()]
    assert (e("cat"), e("of"), e("ghent")) in made and made.count((e("x"), e("y"), f'"1"^^{INTEGER}')) == 1
    assert not any(s.startswith('"') for s, _, _ in made)
    blanks = [s for s, p, _ in made if p == e("k")]
    assert len(blanks) == len(set(blanks)) and all(b.startswith("_:") for b in blanks)
    assert engine.sparql(P + "CONSTRUCT { e:x e:y 1 } { e:eve ?p ?o }").terms().count() == 0
    described = {tuple(r) for r in engine.sparql(P + "DESCRIBE ?p ?c { ?p e:born ?c ; e:died ?d }").terms().collect()}
    assert described == {t for t in TRIPLES if t[0] in (e("cat"), e("york"))}


def test_order_distinct_slice(engine):
    assert [r["?c"] for r in rows(engine, "SELECT DISTINCT ?c { ?p e:born ?c } ORDER BY DESC(?c)")] == [e("york"), e("ontario"), e("ghent")]
    people = rows(engine, "SELECT ?c ?n { ?c a e:City OPTIONAL { ?c e:people ?n } } ORDER BY ?n")
    assert [r["?c"] for r in people] == [e("ghent"), e("ontario"), e("york")]  # unbound first, then by value
    assert [r["?c"] for r in rows(engine, "SELECT ?c { ?c a e:City } ORDER BY ?c OFFSET 1 LIMIT 1")] == [e("ontario")]
    mixed = [r["?o"] for r in rows(engine, "SELECT DISTINCT ?o { { e:dan ?p ?o } UNION { e:cat ?p ?o } UNION { ?c e:people ?o } } ORDER BY ?o")]
    assert mixed[0] == "_:someone" and mixed[-2:] == [f'"900"^^{INTEGER}', f'"200000"^^{INTEGER}']
    quirky = Engine(engine.spark, engine.source, compat="quirks")
    assert [r["?n"][1:3] for r in rows(quirky, "SELECT ?n { ?c e:people ?n } ORDER BY ?n")] == ["20", "90"]  # as text


def test_quirks(engine):
    quirky = Engine(engine.spark, engine.source, compat="quirks")
    text = "SELECT ?c { ?c a e:City OPTIONAL { ?c e:people ?n } FILTER(?n > 1000) }"
    assert {r["?c"] for r in rows(engine, text)} == {e("york")}
    assert {r["?c"] for r in rows(quirky, text)} == {e("york"), e("ghent")}
    assert len(rows(quirky, 'SELECT ?c { ?c e:people ?n FILTER(?n = 900.0) }')) == 0 and len(rows(engine, 'SELECT ?c { ?c e:people ?n FILTER(?n = 900.0) }')) == 1
    assert quirky.sparql(P + "CONSTRUCT { ?c e:a 1 . ?c e:b 2 } { ?c a e:City } LIMIT 3").terms().count() == 3
    assert engine.sparql(P + "CONSTRUCT { ?c e:a 1 . ?c e:b 2 } { ?c a e:City } LIMIT 3").terms().count() == 6


def test_unsupported_before_anything_runs(engine):
    for text in ("SELECT * { ?a ?b ?c FILTER nope(?a) }", "SELECT * { ?a ?b ?c FILTER regex(?a, 'x', 'i') }", "SELECT * { ?a ?b ?c FILTER bound(1) }"):
        with pytest.raises(UnsupportedQueryError):
            engine.sparql(text)


GROUPS = [
    "{ ?p e:born ?c OPTIONAL { ?p e:died ?d } }",
    "{ ?p e:born ?c OPTIONAL { ?p e:died ?d OPTIONAL { ?d e:name ?n } } }",
    "{ ?p e:born ?c OPTIONAL { ?p e:knows ?q } OPTIONAL { ?q e:age ?a } }",
    "{ ?p e:born ?c OPTIONAL { ?p e:died ?d } { ?x e:born ?d } }",
    "{ ?p e:born ?c OPTIONAL { ?c e:people ?n FILTER(?n > 1000) } }",
    "{ ?p a e:Artist OPTIONAL { ?p e:age ?a } FILTER(?a > 40 || ?p = e:bob) }",
    "{ ?p a e:Artist OPTIONAL { ?p e:age ?a } FILTER(!bound(?a)) }",
    "{ ?p a e:Artist OPTIONAL { ?p e:age ?a } FILTER(!(?a > 40 && ?p != e:bob)) }",
    "{ { ?x e:born ?c } UNION { ?x e:died ?c . ?x e:knows ?k } }",
    "{ { ?x e:born ?c } UNION { ?x e:died ?d } ?x a e:Artist OPTIONAL { ?x e:knows ?c } }",
    "{ ?p e:born ?c { { ?c e:people ?n } UNION { ?p e:age ?n } } FILTER(?n < 1000) }",
    "{ ?p e:knows ?q { ?q e:born ?c OPTIONAL { ?q e:died ?d } } }",
    "{ OPTIONAL { ?x e:nope ?y } ?x e:born ?c }",
    "{ OPTIONAL { ?x e:died ?y } OPTIONAL { ?x e:born ?z } }",
    "{ ?x ?p ?y . ?y ?q ?z FILTER(?p = ?q) }",
]


@pytest.mark.parametrize("group", GROUPS)
def test_against_brute_force(engine, group):
    q = parse(P + "SELECT * " + group)
    data = [tuple("http://local/.well-known/genid/someone" if t == "_:someone" else t for t in row) for row in TRIPLES]
    want = [{k: py_deskolemise(v) for k, v in r.items() if k.startswith("?")} for r in solve(q.where, data)]
    same(rows(engine, "SELECT * " + group), want)


def test_random_groups_against_brute_force(engine):
    rng = random.Random(7)
    names = ["born", "died", "knows", "age", "people", "name"]
    for _ in range(12):
        pattern = lambda: f"?{rng.choice('xyz')} e:{rng.choice(names)} ?{rng.choice('yzw')} ."
        group = "{ " + pattern() + rng.choice(["", pattern()]) + rng.choice(["", f"OPTIONAL {{ {pattern()} {rng.choice(['', 'FILTER(?w > 10)'])} }}"]) + rng.choice(["", f"{{ {pattern()} }} UNION {{ {pattern()} }}"]) + " }"
        q = parse(P + "SELECT * " + group)
        data = [tuple("http://local/.well-known/genid/someone" if t == "_:someone" else t for t in row) for row in TRIPLES]
        same(rows(engine, "SELECT * " + group), [{k: py_deskolemise(v) for k, v in r.items()} for r in solve(q.where, data)])


TRUE, FALSE = f'"true"^^{BOOLEAN}', f'"false"^^{BOOLEAN}'
INT3, INT4 = f'"3"^^{INTEGER}', f'"4"^^{INTEGER}'
EXPRESSIONS = [
    (("+", INT3, INT4), f'"7"^^{INTEGER}'), (("-", INT3, INT4), f'"-1"^^{INTEGER}'), (("*", INT3, INT4), f'"12"^^{INTEGER}'), (("=", INT3, INT3), TRUE), (("=", '"a"', '"a"'), TRUE), (("=", '"a"@en', '"a"'), FALSE),
    (("!=", INT3, INT4), TRUE), (("<", INT3, INT4), TRUE), (("<", INT4, INT4), FALSE), (("<=", INT4, INT4), TRUE), ((">", INT4, INT3), TRUE), ((">=", INT3, INT4), FALSE), (("!", TRUE), FALSE), (("!", '"0"'), TRUE),
    (("!", '"abc"'), FALSE), (("&&", TRUE, FALSE), FALSE), (("||", TRUE, FALSE), TRUE), (("&&", '"x"', "http://i"), TRUE), (("lang", '"a"@en-GB'), '"en-gb"'), (("lang", '"a"'), '""'), (("langmatches", '"EN"', '"en"'), TRUE),
    (("langmatches", '"de-at"', '"DE"'), TRUE), (("langmatches", '"den"', '"de"'), FALSE), (("langmatches", '"en"', '"*"'), TRUE), (("contains", '"abcd"@en', '"bc"'), TRUE), (("contains", '"abcd"', '"x"'), FALSE),
    (("regex", '"abc"', '"a.c"'), TRUE), (("regex", '"abc"', '"^b"'), FALSE), (("regex", "http://abc/", '"abc"'), TRUE), (("str", '"a"@en'), '"a"@en'), (("str", "http://i"), '"http://i"'), ((INTEGER, '"123.67"'), f'"123"^^{INTEGER}'),
    ((DOUBLE, '"123"'), f'"123.0"^^{DOUBLE}'), (("bound", "?a"), TRUE), (("bound", "?b"), FALSE), (("+", "?b", INT3), None), (("=", "?a", INT3), TRUE),
]


@pytest.mark.parametrize("expression,want", EXPRESSIONS)
def test_expressions(spark, expression, want):
    assert evaluate(spark, Op(expression[0], expression[1:]), {"?a": INT3}) == want


def test_expression_edges(spark):
    assert evaluate(spark, None) is None and evaluate(spark, "?a", {"?a": "x"}) == "x" and evaluate(spark, "http://i") == "http://i"
    assert evaluate(spark, Op("/", (f'"1"^^{INTEGER}', f'"0"^^{INTEGER}'))).startswith('"Infinity"')
    assert evaluate(spark, Op("<", (INT3, '"NaN"'))) == FALSE
    for bad in (Op("<", (INT3, "http://i")), Op("lang", ("http://i",)), Op("&&", (TRUE, Op("lang", ("http://i",))))):
        with pytest.raises(ValueError):
            evaluate(spark, bad)
    assert evaluate(spark, Op("||", (TRUE, Op("lang", ("http://i",))))) == TRUE
    assert evaluate(spark, Op("langmatches", ('""', '"*"'))) == FALSE and evaluate(spark, Op("langmatches", ('""', '"*"')), quirks=True) == TRUE
    assert evaluate(spark, Op(INTEGER, ('"-1.5"',))) == f'"-1"^^{INTEGER}' and evaluate(spark, Op(INTEGER, ('"-1.5"',)), quirks=True) == f'"-2"^^{INTEGER}'
    assert evaluate(spark, Op("=", (INT3, f'"3.0"^^{DOUBLE}'))) == TRUE and evaluate(spark, Op("=", (INT3, f'"3.0"^^{DOUBLE}')), quirks=True) == FALSE
    assert evaluate(spark, Op("<", ('"9"', '"10"'))) == TRUE and evaluate(spark, Op("<", ('"b"', '"a"'))) == FALSE
    with pytest.raises(UnsupportedQueryError, match="Unsupported operator"):
        evaluate(spark, Op("nope", ()))
    with pytest.raises(UnsupportedQueryError, match="number of arguments"):
        evaluate(spark, Op("+", (INT3,)))


def test_components_and_plan(source):
    a, b, c, d = Pattern("?a", e("born"), "?b"), Pattern("?b", e("name"), '"York"@en'), Pattern("?c", e("age"), "?d"), Pattern("?a", e("knows"), "?e")
    assert components([]) == [] and components([a]) == [[a]]
    assert [set(x) for x in components([a, c, b, d])] == [{c}, {a, b, d}]
    assert len(components([a, Pattern("?z", "?y", "?x"), Pattern("?b", e("in"), "?z")])) == 1
    order = [u.patterns[0] for u in plan([a, b, c, d], source)]
    assert set(order) == {a, b, c, d} and order[0] == c  # the smaller component first, the cross product last
    for x, y in itertools.pairwise(order[1:]):
        assert {*x.variables()} & {*y.variables()} or order.index(y) > 2
    assert plan([a, Pattern("?a", e("nothing"), "?q")], source) is None
    assert plan([Pattern('"x"', "?p", "?o")], source) is None


def test_patterns():
    p = Pattern("?x", "u:p", "?x")
    assert p.matches("a", "u:p", "a") and not p.matches("a", "u:p", "b") and not p.matches("a", "u:q", "a")
    assert Pattern("a", "u:p", "?o").bound_by(Pattern("?s", "u:p", "?o")) and not Pattern("?s", "?p", "?o").bound_by(Pattern("?s", "u:p", "?o"))


def test_terms():
    assert py_deskolemise("http://x.org/.well-known/genid/a-b/c") == "_:a_b_c" and py_deskolemise("http://x.org/a") == "http://x.org/a"
    assert py_same_url("http://x/%C3%A9%2F", "http://x/é%2F") and not py_same_url("http://x/%2F", "http://x//")
    assert py_abbreviate("http://x/y#z") == "z" and py_abbreviate('"long text"@en') == '"long text"'


def test_written_triples_are_pruned(spark, source, tmp_path):
    path = str(tmp_path / "t")
    write_triples(source.df, path, buckets=8)
    stored = read_triples(spark, path, buckets=8)
    q = P + 'SELECT ?p { ?p e:born ?c . ?c e:name "York"@en }'
    same(list(Engine(spark, stored).sparql(q).rows()), list(Engine(spark, source).sparql(q).rows()))
    text = stored.scan(Pattern("?s", e("born"), "?o")).df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p_bucket" in text


def test_stats(source):
    assert source.count(Pattern("?s", e("born"), "?o")) == 4
    assert source.count(Pattern("?s", e("nothing"), "?o")) == 0 and source.count(Pattern("?s", '"x"', "?o")) == 0
    assert 0 < source.count(Pattern("?s", e("born"), e("york"))) < 4


class Broken(TripleSource):
    def __init__(self, spark):
        self.spark = spark

    def count(self, p):
        raise OSError("down")


def test_federation(spark, source):
    assert FederatedSource(spark, []).match(Pattern("?s", "?p", "?o")).df.count() == 0
    both = FederatedSource(spark, [source, from_rows(spark, [(e("eve"), e("born"), e("york"))])])
    assert both.count(Pattern("?s", e("born"), "?o")) == 5
    found = rows(Engine(spark, both), 'SELECT ?p { ?p e:born ?c . ?c e:name "York"@en }')
    assert {r["?p"] for r in found} == {e("ann"), e("bob"), e("cat"), e("eve")}
    both.count(Pattern("?s", e("died"), "?o"))
    assert Pattern("?s", e("died"), "?o") in both.empty[1] and Pattern("?s", e("died"), "?o") not in both.empty[0]
    lame = FederatedSource(spark, [Broken(spark), source])
    assert len(rows(Engine(spark, lame), "SELECT * { ?p e:born ?c }")) == 4
    with pytest.raises(OSError):
        FederatedSource(spark, [Broken(spark), source], error_threshold=0).count(Pattern("?s", e("born"), "?o"))


def test_no_literal_star_join_reads_a_table_once(spark):
    from triloom.sources.relational import Mapping, RelationalSource

    df = spark.createDataFrame([(1, "a", 5, None), (2, "b", None, 1)], "id long, n string, v long, up long")
    engine = Engine(spark, RelationalSource(spark, [Mapping("t", df, ["id"], {"up": "t"}, unique=True)]), {"t": "urn:t:t#"})
    assert list(engine.sparql("SELECT * { ?x t:n ?n ; t:v ?v }").rows()) == [{"?x": "urn:t:t/1", "?n": '"a"', "?v": f'"5"^^{INTEGER}'}]
    assert "Join" not in engine.sparql("SELECT * { ?x t:n ?n ; t:v ?v }").relation.df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["?m"] for r in engine.sparql("SELECT ?m { ?x t:up ?y . ?y t:n ?m }").rows()] == ['"a"']
    assert engine.sparql("SELECT * { ?s ?p ?o }").terms().where(F.col("`?o`").startswith('"')).count() == 5


def test_rows_that_share_a_key_are_one_subject(spark):
    from triloom.sources.relational import Mapping, RelationalSource

    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6)], "id long, n string, v long")
    engine = Engine(spark, RelationalSource(spark, [Mapping("t", df, ["id"])]), {"t": "urn:t:t#"})
    assert len(list(engine.sparql("SELECT * { ?x t:n ?n ; t:v ?v }").rows())) == 4
    assert len(list(engine.sparql("SELECT * { { ?x t:n ?n } { ?x t:v ?v } }").rows())) == 4


def _relation(spark, names, maybe, found, tmp_path, name):
    spark.createDataFrame(found, ", ".join(f"`{v}` string" for v in names)).write.parquet(str(tmp_path / name))
    return Relation(spark.read.parquet(str(tmp_path / name)), dict.fromkeys(names, TERM), frozenset(maybe))


def _compatible(a, b):
    return all(a.get(v) is None or b.get(v) is None or a[v] == b[v] for v in a.keys() & b.keys())


@pytest.mark.parametrize("with_key", [True, False])
def test_joins_on_variables_that_may_be_unbound(spark, tmp_path, with_key):
    """Three shared variables, each of which either side can leave unbound; with one more that is always bound, or without."""
    rng = random.Random(4)
    value = lambda: rng.choice([None, "1", "2"])
    key = ["?k"] if with_key else []
    left_names, right_names = [*key, "?x", "?y", "?z", "?a"], [*key, "?x", "?y", "?z", "?b"]
    make = lambda n: [(*[rng.choice("pqr") for _ in key], value(), value(), value(), str(i)) for i in range(n)]
    lefts, rights = make(40), make(25)
    left = _relation(spark, left_names, ["?x", "?y", "?z"], lefts, tmp_path, "left")
    right = _relation(spark, right_names, ["?x", "?y", "?z"], rights, tmp_path, "right")
    names = list(dict.fromkeys([*left_names, *right_names]))
    merged = lambda a, b: tuple(b.get(v) if a.get(v) is None else a[v] for v in names)
    pairs, kept = [], []
    for a in (dict(zip(left_names, r, strict=True)) for r in lefts):
        own = [merged(a, b) for b in (dict(zip(right_names, r, strict=True)) for r in rights) if _compatible(a, b)]
        pairs += own
        kept += own or [merged(a, {})]
    found = join(left, right)
    assert Counter(tuple(r[v] for v in names) for r in found.df.collect()) == Counter(pairs)
    outer = left_join(left, right)
    assert Counter(tuple(r[v] for v in names) for r in outer.df.collect()) == Counter(kept)
    if with_key:
        for made in (found, outer):
            text = made.df.select("*")._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in text and "Cartesian" not in text and text.count("FileScan") == 2


def test_optional_whose_right_side_leaves_the_variable_unbound_has_no_nested_loop(spark, engine):
    found = engine.sparql(P + "SELECT * { ?p e:born ?c OPTIONAL { ?p e:name ?n OPTIONAL { ?p e:lives ?c } } }")
    text = found.relation.df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_construct_keeps_blank_nodes_together(engine):
    made = engine.sparql(P + "CONSTRUCT { _:x e:of ?p . _:x a e:Thing . e:all a e:Set } { ?p e:born ?c }").terms().collect()
    things = {r["s"] for r in made if r["o"] == e("Thing")}
    assert len(things) == 4 and things == {r["s"] for r in made if r["p"] == e("of")}
    assert sum(r["s"] == e("all") for r in made) == 1


def test_counts_are_stored_with_the_triples(spark, source, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    write_triples(source.df, path, buckets=4)
    stored = read_triples(spark, path, buckets=4)
    stored.df = None  # not looked at
    assert stored.count(Pattern("?s", e("born"), "?o")) == 4 and stored.count(Pattern("?s", e("nothing"), "?o")) == 0
    assert read_triples(spark, path, buckets=4).df.count() == source.df.count()


def test_explain(engine):
    text = engine.explain(P + 'SELECT ?p { ?p e:born ?c . ?c e:name "York"@en }')
    assert "born" in text and "Physical Plan" in text


def test_few_keys_that_make_many_pairs_are_cut_into_tiles(spark):
    """A key's pairs are the work of many tasks, whatever bytes they read; before, they were that of one."""
    from triloom.sources.relational import Mapping, RelationalSource

    hub = spark.createDataFrame([(0,), (1,)], "id int")
    small = spark.createDataFrame([(i, None if i == 7 else int(i == 5)) for i in range(40)], "id int, hub int")
    large = spark.createDataFrame([(i, None if i == 9 else int(i % 50 == 0)) for i in range(900)], "id int, hub int")
    tables = [Mapping("hub", hub, ["id"], rows=2, unique=True), Mapping("small", small, ["id"], {"hub": "hub"}, rows=3200, unique=True), Mapping("large", large, ["id"], {"hub": "hub"}, rows=40_000, unique=True)]
    found = Engine(spark, RelationalSource(spark, tables), {t: f"urn:t:{t}#" for t in ("small", "large")}).sparql("SELECT ?a ?b { ?a small:hub ?h . ?b large:hub ?h }").typed()
    want = Counter((f"urn:t:small/{a['id']}", f"urn:t:large/{b['id']}") for a in small.collect() for b in large.collect() if a["hub"] is not None and a["hub"] == b["hub"])
    assert Counter(map(tuple, found.collect())) == want
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 8 and max(shares) < sum(want.values()) / 4


@pytest.mark.parametrize("copy_left", [True, False])
def test_tiles_keep_every_pair(spark, copy_left):
    left = Relation(spark.createDataFrame([(k, "x") for k in "aab"], "`?k` string, `?l` string"), {"?k": TERM, "?l": TERM})
    right = Relation(spark.createDataFrame([(k, str(i % 3)) for i in range(20) for k in "abc"], "`?k` string, `?r` string"), {"?k": TERM, "?r": TERM})
    got = join(left, right, Tiles(7, 5, copy_left))
    assert list(got.encs) == got.df.columns == ["?k", "?l", "?r"]
    assert Counter(map(tuple, got.df.collect())) == Counter(map(tuple, join(left, right).df.collect()))


def test_only_joins_that_may_make_many_pairs_count_rows(spark, monkeypatch):
    from triloom.sources.relational import star_schema

    source = star_schema(spark, "/root/testdata/sf0.01")
    monkeypatch.setattr(source, "_counted", lambda m: pytest.fail("rows were counted"))
    found = Engine(spark, source, {t: f"urn:t:{t}#" for t in ("supplier", "customer")}).sparql("SELECT ?s ?c { ?s supplier:s_nationkey ?n . ?c customer:c_nationkey ?n }")
    assert found.typed().count() == 5949


def test_a_known_subject_narrows_a_variable_predicate(spark):
    from triloom.sources.relational import Mapping, RelationalSource

    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, n string")
    b = spark.createDataFrame([(1, 2)], "id long, a long")
    engine = Engine(spark, RelationalSource(spark, [Mapping("a", a, ["id"]), Mapping("b", b, ["id"], {"a": "a"})]), {"a": "urn:t:a#", "b": "urn:t:b#"})
    found = list(engine.sparql("SELECT * { ?y b:a ?x . ?x ?p ?o }").rows())
    assert {(r["?p"], r["?o"]) for r in found} == {("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "urn:t:A"), ("urn:t:a#id", f'"2"^^{INTEGER}'), ("urn:t:a#n", '"y"')}
    assert list(engine.sparql('SELECT ?p { ?y b:a ?x . ?x ?p "y" }').rows()) == [{"?p": "urn:t:a#n"}]
    assert list(engine.sparql("SELECT * { ?y b:a ?x . ?x ?x ?o }").rows()) == []
