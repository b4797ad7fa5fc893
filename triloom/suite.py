"""The queries that the driver runs over its tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Result
from .functions.terms import RDF_TYPE
from .plans.algebra import Pattern
from .results.writers import WRITERS, save_ntriples, write_turtle
from .sources.federated import FederatedSource
from .sources.files import read_ntriples, read_turtle, snapshot
from .sources.fragments import HYDRA, FragmentSource
from .sources.relational import Mapping, RelationalSource, star_schema
from .sources.scratch import new_path
from .sources.triples import TripleSource
from .streaming.monotone import stream_query, windowed_sort

TABLES = "region nation customer supplier part orders lineitem events documents labels pages benchmark conversations".split()
PREFIXES = {t: f"urn:t:{t}#" for t in TABLES} | {"c": "urn:t:"}

#: name: (query, SQL). Results are typed: literals as native values, IRIs as text.
SPARQL: dict[str, tuple[str, str]] = {
    "minimum_slice": (
        'SELECT ?name ?seg WHERE { ?n nation:n_name "NATION_3" . ?c customer:c_nationkey ?n . ?c customer:c_name ?name . ?c customer:c_mktsegment ?seg }',
        "SELECT c_name AS name, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'",
    ),
    "scan_pattern": ("SELECT ?c ?seg WHERE { ?c customer:c_mktsegment ?seg }", "SELECT 'urn:t:customer/' || c_custkey AS c, c_mktsegment AS seg FROM customer"),
    "scan_constant": ('SELECT ?c WHERE { ?c customer:c_mktsegment "BUILDING" }', "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "scan_subject": ("SELECT ?name WHERE { <urn:t:customer/7> customer:c_name ?name }", "SELECT c_name AS name FROM customer WHERE c_custkey = 7"),
    "scan_types": ("SELECT ?x WHERE { ?x a c:Supplier }", "SELECT 'urn:t:supplier/' || s_suppkey AS x FROM supplier"),
    "bgp_star": (
        "SELECT ?o ?total ?prio ?status WHERE { ?o orders:o_totalprice ?total ; orders:o_orderpriority ?prio ; orders:o_orderstatus ?status }",
        "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS total, o_orderpriority AS prio, o_orderstatus AS status FROM orders",
    ),
    "bgp_chain": (
        """SELECT ?q ?price ?cname ?nname ?rname WHERE { ?l lineitem:l_orderkey ?o ; lineitem:l_quantity ?q . ?o orders:o_custkey ?c ; orders:o_totalprice ?price .
           ?c customer:c_nationkey ?n ; customer:c_name ?cname . ?n nation:n_regionkey ?r ; nation:n_name ?nname . ?r region:r_name ?rname }""",
        """SELECT l_quantity AS q, o_totalprice AS price, c_name AS cname, n_name AS nname, r_name AS rname FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "bgp_two_stars": (
        "SELECT ?sn ?cn WHERE { ?s supplier:s_nationkey ?n ; supplier:s_name ?sn . ?c customer:c_nationkey ?n ; customer:c_name ?cn }",
        "SELECT s_name AS sn, c_name AS cn FROM supplier JOIN customer ON s_nationkey = c_nationkey",
    ),
    "bgp_cartesian": ("SELECT ?a ?b WHERE { ?x region:r_name ?a . ?y nation:n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "pattern_repeated_var": ("SELECT ?x WHERE { ?x labels:quality ?v . ?x labels:toxic ?v }", "SELECT 'urn:t:labels/' || doc_id AS x FROM labels WHERE quality = toxic"),
    "repeated_impossible": ("SELECT ?x WHERE { ?x labels:doc_id ?x }", "SELECT CAST(doc_id AS VARCHAR) AS x FROM labels WHERE false"),
    "literal_subject_empty": ('SELECT ?p ?o WHERE { "x" ?p ?o }', "SELECT r_name AS p, r_name AS o FROM region WHERE false"),
    "contradiction": ("SELECT ?a WHERE { ?x region:r_name ?a . ?x <urn:none> ?b }", "SELECT r_name AS a FROM region WHERE false"),
    "other_template_empty": ("SELECT ?a WHERE { ?x region:r_name ?a . ?x nation:n_name ?b }", "SELECT r_name AS a FROM region WHERE false"),
    "optional_one": (
        "SELECT ?d ?q WHERE { ?d documents:source ?s OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?q } }",
        "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "optional_multi": (
        "SELECT ?o ?qty ?pn WHERE { ?o orders:o_orderstatus ?st OPTIONAL { ?l lineitem:l_orderkey ?o ; lineitem:l_quantity ?qty ; lineitem:l_partkey ?p . ?p part:p_name ?pn } }",
        "SELECT 'urn:t:orders/' || o_orderkey AS o, l_quantity AS qty, p_name AS pn FROM orders LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey",
    ),
    "optional_nested": (
        "SELECT ?d ?q ?t WHERE { ?d documents:source ?s OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?q OPTIONAL { ?l labels:toxic ?t FILTER(?t > 0) } } }",
        "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q, CASE WHEN toxic > 0 THEN toxic END AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "optional_filter": (
        "SELECT ?d ?q WHERE { ?d documents:source ?s OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?q FILTER(?q = 1) } }",
        "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality = 1",
    ),
    "optional_then_filter": (
        "SELECT ?d ?q WHERE { ?d documents:source ?s OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?q } FILTER(?q = 1) }",
        "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1",
    ),
    "join_maybe_unbound": (
        "SELECT ?n ?c WHERE { ?n nation:n_name ?name OPTIONAL { ?c customer:c_nationkey ?n ; customer:c_acctbal ?b FILTER(?b > 9500) } { ?c customer:c_mktsegment \"BUILDING\" } }",
        """WITH l AS (SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500)
           SELECT 'urn:t:nation/' || n_nationkey AS n, 'urn:t:customer/' || r.c_custkey AS c FROM l JOIN customer r ON (l.c_custkey IS NULL OR l.c_custkey = r.c_custkey) WHERE r.c_mktsegment = 'BUILDING'""",
    ),
    "join_both_maybe_unbound": (
        """SELECT ?n ?r ?c WHERE { { ?n nation:n_name ?name OPTIONAL { ?n nation:n_regionkey ?r FILTER(?name != "NATION_3") } }
           { ?n nation:n_nationkey ?k OPTIONAL { ?n nation:n_regionkey ?r FILTER(?k > 5) } OPTIONAL { ?c customer:c_nationkey ?n ; customer:c_acctbal ?b FILTER(?b > 9500) } } }""",
        """WITH a AS (SELECT n_nationkey AS k, CASE WHEN n_name <> 'NATION_3' THEN n_regionkey END AS r FROM nation), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey > 5 THEN n_regionkey END AS r FROM nation)
           SELECT 'urn:t:nation/' || a.k AS n, 'urn:t:region/' || coalesce(a.r, b.r) AS r, 'urn:t:customer/' || c_custkey AS c FROM a JOIN b ON a.k = b.k AND (a.r IS NULL OR b.r IS NULL OR a.r = b.r)
           LEFT JOIN customer ON c_nationkey = a.k AND c_acctbal > 9500""",
    ),
    "optional_maybe_unbound": (
        """SELECT ?n ?r ?x WHERE { ?n nation:n_nationkey ?k OPTIONAL { ?n nation:n_regionkey ?r FILTER(?k > 5) }
           OPTIONAL { ?n nation:n_name ?x OPTIONAL { ?n nation:n_regionkey ?r FILTER(?x != "NATION_9" && ?x != "NATION_4") } } }""",
        """SELECT 'urn:t:nation/' || n_nationkey AS n, CASE WHEN n_nationkey > 5 OR n_name NOT IN ('NATION_9', 'NATION_4') THEN 'urn:t:region/' || n_regionkey END AS r, n_name AS x FROM nation""",
    ),
    "optional_right_unbound": (
        "SELECT ?n ?x ?z WHERE { ?n nation:n_regionkey ?x OPTIONAL { { ?x region:r_name ?z FILTER(?z = \"ASIA\") } UNION { ?w supplier:s_name ?z FILTER(?z = \"none\") } } }",
        "SELECT 'urn:t:nation/' || n_nationkey AS n, 'urn:t:region/' || n_regionkey AS x, r_name AS z FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name = 'ASIA'",
    ),
    "union_two": (
        "SELECT ?x ?n WHERE { { ?x supplier:s_name ?n } UNION { ?x customer:c_name ?n } }",
        "SELECT 'urn:t:supplier/' || s_suppkey AS x, s_name AS n FROM supplier UNION ALL SELECT 'urn:t:customer/' || c_custkey, c_name FROM customer",
    ),
    "union_three": (
        "SELECT ?n WHERE { { ?x region:r_name ?n } UNION { ?x nation:n_name ?n } UNION { ?x part:p_brand ?n } }",
        "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_brand FROM part",
    ),
    "union_disjoint_vars": (
        "SELECT ?a ?b WHERE { { ?x region:r_name ?a } UNION { ?y nation:n_name ?b } }",
        "SELECT r_name AS a, NULL AS b FROM region UNION ALL SELECT NULL, n_name FROM nation",
    ),
    "union_joined": (
        "SELECT ?x ?rn WHERE { ?n nation:n_regionkey ?r . ?r region:r_name ?rn { ?x supplier:s_nationkey ?n } UNION { ?x customer:c_nationkey ?n } }",
        """SELECT x, r_name AS rn FROM (SELECT 'urn:t:supplier/' || s_suppkey AS x, s_nationkey AS k FROM supplier UNION ALL SELECT 'urn:t:customer/' || c_custkey, c_nationkey FROM customer)
           JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "nested_group": (
        "SELECT ?cn ?nn WHERE { ?c customer:c_name ?cn { ?c customer:c_nationkey ?n { ?n nation:n_name ?nn FILTER contains(?nn, \"1\") } } }",
        "SELECT c_name AS cn, n_name AS nn FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(n_name, '1')",
    ),
    "blank_pattern": (
        "SELECT ?cn WHERE { ?c customer:c_name ?cn ; customer:c_nationkey [ nation:n_name ?nn ; nation:n_regionkey _:r ] . _:r region:r_name \"ASIA\" }",
        "SELECT c_name AS cn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    ),
    "filter_add": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?s ; part:p_retailprice ?v FILTER(?s + ?v > 1020) }", "SELECT p_partkey AS k FROM part WHERE p_size + p_retailprice > 1020"),
    "filter_sub": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?s FILTER(?s - 10 > 20) }", "SELECT p_partkey AS k FROM part WHERE p_size - 10 > 20"),
    "filter_mul": ("SELECT ?q ?e WHERE { ?l lineitem:l_quantity ?q ; lineitem:l_extendedprice ?e ; lineitem:l_discount ?d FILTER(?e * ?d > 3000) }", "SELECT l_quantity AS q, l_extendedprice AS e FROM lineitem WHERE l_extendedprice * l_discount > 3000"),
    "filter_div": ("SELECT ?q ?e WHERE { ?l lineitem:l_quantity ?q ; lineitem:l_extendedprice ?e FILTER(?e / ?q < 950.0) }", "SELECT l_quantity AS q, l_extendedprice AS e FROM lineitem WHERE l_extendedprice / l_quantity < 950.0"),
    "filter_div_zero": ("SELECT ?d WHERE { ?l labels:doc_id ?d ; labels:quality ?q ; labels:toxic ?t FILTER(?q / ?t > 0) }", "SELECT 'urn:t:documents/' || doc_id AS d FROM labels WHERE quality > 0"),
    "filter_eq": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?s FILTER(?s = 15.0) }", "SELECT p_partkey AS k FROM part WHERE p_size = 15"),
    "filter_ne": ('SELECT ?n WHERE { ?x region:r_name ?n FILTER(?n != "ASIA") }', "SELECT r_name AS n FROM region WHERE r_name <> 'ASIA'"),
    "filter_iri": ("SELECT ?nn WHERE { ?n nation:n_regionkey ?r ; nation:n_name ?nn FILTER(?r = <urn:t:region/2>) }", "SELECT n_name AS nn FROM nation WHERE n_regionkey = 2"),
    "filter_lt": ("SELECT ?c ?b WHERE { ?c customer:c_acctbal ?b FILTER(?b < 0) }", "SELECT 'urn:t:customer/' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal < 0"),
    "filter_le": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?s FILTER(?s <= 3) }", "SELECT p_partkey AS k FROM part WHERE p_size <= 3"),
    "filter_gt": ("SELECT ?k ?v WHERE { ?p part:p_partkey ?k ; part:p_retailprice ?v FILTER(?v > 980) }", "SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_retailprice > 980"),
    "filter_ge": ("SELECT ?e ?v WHERE { ?e events:value ?v FILTER(?v >= 90) }", "SELECT 'urn:t:events/' || event_id AS e, value AS v FROM events WHERE value >= 90"),
    "filter_not": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?s FILTER(!(?s > 5)) }", "SELECT p_partkey AS k FROM part WHERE NOT p_size > 5"),
    "filter_and": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?s ; part:p_retailprice ?v FILTER(?s > 5 && ?v < 1200) }", "SELECT p_partkey AS k FROM part WHERE p_size > 5 AND p_retailprice < 1200"),
    "filter_or": ('SELECT ?c WHERE { ?c customer:c_mktsegment ?s ; customer:c_acctbal ?b FILTER(?s = "BUILDING" || ?b < 100) }', "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 100"),
    "filter_or_unbound": (
        "SELECT ?d WHERE { ?d documents:source ?s OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?q } FILTER(?q = 0 || ?s = \"src1\") }",
        "SELECT 'urn:t:documents/' || d.doc_id AS d FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0 OR source = 'src1'",
    ),
    "filter_lang": ('SELECT ?d WHERE { ?d documents:text ?t FILTER(lang(?t) = "de") }', "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE lower(lang) = 'de'"),
    "filter_langmatches": ('SELECT ?d WHERE { ?d documents:text ?t FILTER langMatches(lang(?t), "FR") }', "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE lower(lang) = 'fr' OR lower(lang) LIKE 'fr-%'"),
    "filter_contains": ('SELECT ?d WHERE { ?d documents:text ?t FILTER contains(?t, "ing the") }', "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE contains(text, 'ing the')"),
    "filter_regex": ('SELECT ?p ?n WHERE { ?p part:p_name ?n FILTER regex(?n, "[aeiou].* [bw][a-z]*t$") }', "SELECT 'urn:t:part/' || p_partkey AS p, p_name AS n FROM part WHERE regexp_matches(p_name, '[aeiou].* [bw][a-z]*t$')"),
    "filter_regex_iri": ('SELECT ?c WHERE { ?c customer:c_name ?n FILTER regex(?c, "customer/1[0-9]$") }', "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_custkey BETWEEN 10 AND 19"),
    "filter_str": ('SELECT ?nn WHERE { ?n nation:n_regionkey ?r ; nation:n_name ?nn FILTER(str(?r) = "urn:t:region/1") }', "SELECT n_name AS nn FROM nation WHERE n_regionkey = 1"),
    "cast_integer": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_retailprice ?v FILTER(xsd:integer(?v) = 905) }", "SELECT p_partkey AS k FROM part WHERE trunc(p_retailprice) = 905"),
    "cast_double": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?s FILTER(xsd:double(?s) > 45) }", "SELECT p_partkey AS k FROM part WHERE p_size > 45"),
    "filter_bound": (
        "SELECT ?d WHERE { ?d documents:source ?s OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?q } FILTER(!bound(?q)) }",
        "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "order_by": ("SELECT ?k ?b WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?b } ORDER BY ?b ?k LIMIT 20", "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY b, k LIMIT 20"),
    "order_by_desc": ("SELECT ?k ?v WHERE { ?p part:p_partkey ?k ; part:p_retailprice ?v } ORDER BY DESC(?v) ?k LIMIT 15", "SELECT p_partkey AS k, p_retailprice AS v FROM part ORDER BY v DESC, k LIMIT 15"),
    "order_by_multi": (
        "SELECT ?seg ?b ?k WHERE { ?c customer:c_custkey ?k ; customer:c_mktsegment ?seg ; customer:c_acctbal ?b } ORDER BY ?seg DESC(?b) ?k OFFSET 5 LIMIT 25",
        "SELECT c_mktsegment AS seg, c_acctbal AS b, c_custkey AS k FROM customer ORDER BY seg, b DESC, k LIMIT 25 OFFSET 5",
    ),
    "order_by_expression": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?s ; part:p_retailprice ?v } ORDER BY DESC(?v / ?s) ?k LIMIT 10", "SELECT p_partkey AS k FROM part ORDER BY p_retailprice / p_size DESC, k LIMIT 10"),
    "order_by_unbound": (
        "SELECT ?k ?q WHERE { ?d documents:doc_id ?k OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?q } } ORDER BY ?q ?k LIMIT 30",
        "SELECT d.doc_id AS k, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY q NULLS FIRST, k LIMIT 30",
    ),
    "distinct": ("SELECT DISTINCT ?seg ?n WHERE { ?c customer:c_mktsegment ?seg ; customer:c_nationkey ?n }", "SELECT DISTINCT c_mktsegment AS seg, 'urn:t:nation/' || c_nationkey AS n FROM customer"),
    "distinct_ordered": ("SELECT DISTINCT ?brand WHERE { ?p part:p_brand ?brand ; part:p_size ?s } ORDER BY ?s ?brand LIMIT 5", "SELECT p_brand AS brand FROM part GROUP BY p_brand ORDER BY min(p_size), brand LIMIT 5"),
    "offset_limit": ("SELECT ?k WHERE { ?o orders:o_orderkey ?k } ORDER BY ?k OFFSET 10 LIMIT 100", "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 100 OFFSET 10"),
    "never_bound": ("SELECT ?n ?nope WHERE { ?x region:r_name ?n }", "SELECT r_name AS n, CAST(NULL AS VARCHAR) AS nope FROM region"),
    "select_all": ("SELECT * WHERE { ?x nation:n_name ?name ; nation:n_regionkey _:r }", "SELECT 'urn:t:nation/' || n_nationkey AS x, n_name AS name FROM nation"),
    "ask_true": ("ASK { ?x region:r_name \"ASIA\" }", "SELECT count(*) > 0 AS result FROM region WHERE r_name = 'ASIA'"),
    "ask_false": ("ASK { ?x region:r_name \"ATLANTIS\" }", "SELECT count(*) > 0 AS result FROM region WHERE r_name = 'ATLANTIS'"),
    "construct": (
        "CONSTRUCT { ?c <urn:x:in> ?r . ?r <urn:x:has> ?c } WHERE { ?c customer:c_nationkey ?n . ?n nation:n_regionkey ?r }",
        """WITH x AS (SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:region/' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
           SELECT c AS s, 'urn:x:in' AS p, r AS o FROM x UNION ALL SELECT r, 'urn:x:has', c FROM x""",
    ),
    "construct_optional": (
        "CONSTRUCT { ?d <urn:x:from> ?s . ?d <urn:x:label> ?l } WHERE { ?d documents:source ?s OPTIONAL { ?l labels:doc_id ?d } }",
        """SELECT 'urn:t:documents/' || doc_id AS s, 'urn:x:from' AS p, '"' || source || '"' AS o FROM documents
           UNION ALL SELECT 'urn:t:documents/' || doc_id, 'urn:x:label', 'urn:t:labels/' || doc_id FROM labels""",
    ),
    "construct_constant": (
        "CONSTRUCT { <urn:x:a> <urn:x:b> 5 . ?r <urn:x:name> ?n } WHERE { ?r region:r_name ?n }",
        """SELECT 'urn:x:a' AS s, 'urn:x:b' AS p, '"5"^^http://www.w3.org/2001/XMLSchema#integer' AS o UNION ALL SELECT 'urn:t:region/' || r_regionkey, 'urn:x:name', '"' || r_name || '"' FROM region""",
    ),
    "describe": (
        'DESCRIBE ?n WHERE { ?n nation:n_regionkey ?r . ?r region:r_name "EUROPE" }',
        """WITH x AS (SELECT n.* FROM nation n JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
           SELECT 'urn:t:nation/' || n_nationkey AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'urn:t:Nation' AS o FROM x
           UNION ALL SELECT 'urn:t:nation/' || n_nationkey, 'urn:t:nation#n_nationkey', '"' || n_nationkey || '"^^http://www.w3.org/2001/XMLSchema#integer' FROM x
           UNION ALL SELECT 'urn:t:nation/' || n_nationkey, 'urn:t:nation#n_name', '"' || n_name || '"' FROM x
           UNION ALL SELECT 'urn:t:nation/' || n_nationkey, 'urn:t:nation#n_regionkey', 'urn:t:region/' || n_regionkey FROM x""",
    ),
    "describe_iri": (
        "DESCRIBE <urn:t:region/1>",
        """SELECT 'urn:t:region/1' AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'urn:t:Region' AS o UNION ALL SELECT 'urn:t:region/1', 'urn:t:region#r_regionkey', '"1"^^http://www.w3.org/2001/XMLSchema#integer'
           UNION ALL SELECT 'urn:t:region/1', 'urn:t:region#r_name', '"' || r_name || '"' FROM region WHERE r_regionkey = 1""",
    ),
    "scan_spo": (
        "SELECT ?p ?o WHERE { <urn:t:supplier/3> ?p ?o }",
        """SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'urn:t:Supplier' AS o UNION ALL SELECT 'urn:t:supplier#s_suppkey', '"3"^^http://www.w3.org/2001/XMLSchema#integer'
           UNION ALL SELECT 'urn:t:supplier#s_name', '"' || s_name || '"' FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT 'urn:t:supplier#s_nationkey', 'urn:t:nation/' || s_nationkey FROM supplier WHERE s_suppkey = 3
           UNION ALL SELECT 'urn:t:supplier#s_acctbal', '"' || s_acctbal || '"^^http://www.w3.org/2001/XMLSchema#double' FROM supplier WHERE s_suppkey = 3""",
    ),
}


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(spark, star_schema(spark, sf_dir), PREFIXES, **options)


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).sparql(text).typed()


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = spark.createDataFrame([("urn:t:nation/1", '"one"'), ("urn:t:nation/2", '"two"'), ("urn:t:nation/99", '"none"')], "`?n` string not null, `?tag` string not null")
    return engine(spark, sf_dir).sparql("SELECT ?tag ?cn WHERE { ?c customer:c_nationkey ?n ; customer:c_name ?cn }", seed).terms().select(F.regexp_extract("`?tag`", '"(.*)"', 1).alias("tag"), F.regexp_extract("`?cn`", '"(.*)"', 1).alias("cn"))


def _halves(spark: SparkSession, sf_dir: str) -> FederatedSource:
    """Two sources: people and places; both know suppliers."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    supplier, nation = Mapping("supplier", read("supplier"), ["s_suppkey"], {"s_nationkey": "nation"}), Mapping("nation", read("nation"), ["n_nationkey"])
    return FederatedSource(spark, [RelationalSource(spark, [supplier, nation]), RelationalSource(spark, [supplier, nation, Mapping("customer", read("customer"), ["c_custkey"], {"c_nationkey": "nation"})])])


def _federated_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _halves(spark, sf_dir), PREFIXES).sparql("SELECT ?s ?n WHERE { ?s supplier:s_name ?n }").typed()


def _federated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _halves(spark, sf_dir), PREFIXES).sparql("SELECT ?cn ?nn WHERE { ?c customer:c_nationkey ?n ; customer:c_name ?cn . ?n nation:n_name ?nn }").typed()


def _pattern_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = star_schema(spark, sf_dir)
    names = [("orders", "o_orderstatus"), ("customer", "c_name"), ("labels", "toxic")]
    return spark.createDataFrame([(f"{t}.{c}", int(source.count(Pattern("?s", source.predicate(t, c), "?o")))) for t, c in names], "pattern string, n long")


def _as_triples(spark: SparkSession, sf_dir: str) -> TripleSource:
    """region, nation and supplier written out as triples."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    source = RelationalSource(
        spark, [Mapping("region", read("region"), ["r_regionkey"]), Mapping("nation", read("nation"), ["n_nationkey"], {"n_regionkey": "region"}), Mapping("supplier", read("supplier"), ["s_suppkey"], {"s_nationkey": "nation"})]
    )
    return TripleSource(source.triples())


def _triples_bgp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _as_triples(spark, sf_dir), PREFIXES).sparql("SELECT ?sn ?rn WHERE { ?s supplier:s_name ?sn ; supplier:s_nationkey ?n . ?n nation:n_regionkey ?r . ?r region:r_name ?rn }").typed().select(
        *[F.regexp_extract(c, '"(.*)"', 1).alias(c) for c in ("sn", "rn")]
    )


def _triples_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _as_triples(spark, sf_dir), PREFIXES).sparql("SELECT ?s ?p ?o WHERE { ?s ?p ?o }").typed().groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def _construct_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = engine(spark, sf_dir).sparql("CONSTRUCT { _:x <urn:x:of> ?n . _:x <urn:x:name> ?name } WHERE { ?n nation:n_name ?name }").terms()
    return made.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("p") == "urn:x:of", F.col("o"))).alias("o")).select("n", "o")


def _construct_blank_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template triple without variables but with a blank node belongs to each solution's own node."""
    made = engine(spark, sf_dir).sparql("CONSTRUCT { _:x <urn:x:of> ?n . _:x a <urn:x:Thing> . <urn:x:all> a <urn:x:Set> } WHERE { ?n nation:n_name ?name }").terms()
    of = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    made = made.groupBy("s").agg(F.count(F.lit(1)).alias("n"), of("urn:x:of").alias("o"), of(RDF_TYPE).alias("type"))
    return made.select("n", "o", "type")


def _repeated_in_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations point to nations, some to themselves."""
    to = F.expr("concat('urn:t:nation/', n_nationkey)").alias("s"), F.lit("urn:x:to").alias("p"), F.expr("concat('urn:t:nation/', n_nationkey * 11 % 25)").alias("o")
    source = TripleSource(spark.read.parquet(f"{sf_dir}/nation.parquet").select(*to))
    return Engine(spark, source).sparql("SELECT ?x WHERE { ?x <urn:x:to> ?x }").typed()


def _filter_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text can't be added to: an error, which only a true alternative outweighs."""
    return engine(spark, sf_dir).sparql("SELECT ?k WHERE { ?n nation:n_nationkey ?k ; nation:n_name ?name FILTER(?name + 1 > 0 || ?k < 3) }").typed()


def _federated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts summed over sources; one that has nothing of a pattern isn't asked for its instances."""
    source, rows = _halves(spark, sf_dir), []
    for name, p in (("suppliers", Pattern("?s", PREFIXES["supplier"] + "s_name", "?n")), ("customers", Pattern("?c", PREFIXES["customer"] + "c_name", "?n")), ("orders", Pattern("?o", PREFIXES["orders"] + "o_custkey", "?c"))):
        rows.append((name, int(source.count(p)), sum(p in x for x in source.empty.values())))
    return spark.createDataFrame(rows, "pattern string, n long, without int")


def _federated_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two sources fails: the other still answers."""

    class Broken(RelationalSource):
        def count(self, p):
            raise OSError("no answer")

        scan = estimate = count

    source = FederatedSource(spark, [Broken(spark, []), star_schema(spark, sf_dir)])
    return Engine(spark, source, PREFIXES).sparql("SELECT ?n ?name WHERE { ?n nation:n_name ?name }").typed()


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_sort(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"), "n_name", 4, "n_nationkey")


def _written(media_type: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = "".join(WRITERS[media_type](engine(spark, sf_dir).sparql("SELECT ?n ?x WHERE { ?r region:r_name ?n } ORDER BY ?n")))
        return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "line int, text string")

    return run


def _debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the results; their delays differ from run to run."""
    return _written("debug")(spark, sf_dir).select("line", F.substring_index("text", ",", 1).alias("text"))


def _lines(parts: str) -> str:
    """SQL for the lines of a text from (place, line) rows over r: regions i of n by name."""
    return f"WITH r AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i, count(*) OVER () AS n FROM region), x AS ({parts}) SELECT CAST(row_number() OVER (ORDER BY place, part) - 1 AS INT) AS line, line AS text FROM x"


def _fixed(at: int, lines: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {at} AS place, {k} AS part, '{x}' AS line" for k, x in enumerate(lines))


_END = 1_000_000  # after all regions
WRITTEN_SQL = {
    "json": _lines(_fixed(0, ["["]) + " UNION ALL SELECT i, 0, '{\"?n\":\"\\\"' || r_name || '\\\"\",\"?x\":null}' || CASE WHEN i < n THEN ',' ELSE '' END FROM r UNION ALL " + _fixed(_END, ["]"])),
    "sparql_json": _lines(
        _fixed(0, ['{"head": {"vars":["n","x"]},', '"results": { "bindings": ['])
        + " UNION ALL SELECT i, 0, '{\"n\":{\"value\":\"' || r_name || '\",\"type\":\"literal\"}}' || CASE WHEN i < n THEN ',' ELSE '' END FROM r UNION ALL "
        + _fixed(_END, ["]}}"])
    ),
    "sparql_xml": _lines(
        _fixed(0, ['<?xml version="1.0" encoding="UTF-8"?>', '<sparql xmlns="http://www.w3.org/2005/sparql-results#">', "  <head>", '    <variable name="n"/>', '    <variable name="x"/>', "  </head>", "  <results>"])
        + """ UNION ALL SELECT i, unnest([0, 1, 2, 3, 4]), unnest(['    <result>', '      <binding name="n">', '        <literal>' || r_name || '</literal>', '      </binding>', '    </result>']) FROM r UNION ALL """
        + _fixed(_END, ["  </results>", "</sparql>"])
    ),
    "simple": _lines("SELECT i AS place, unnest([0, 1, 2]) AS part, unnest(['n: \"' || r_name || '\"', 'x: null', CASE WHEN i < n THEN '' END]) AS line FROM r").replace("FROM x", "FROM x WHERE line IS NOT NULL"),
    "table": _lines(_fixed(0, ["n" + " " * 50 + "x" + " " * 49, "-" * 101]) + " UNION ALL SELECT i, 0, rpad('\"' || r_name || '\"', 50, ' ') || ' ' || rpad('null', 50, ' ') FROM r"),
    "debug": _lines(_fixed(0, ["Result"]) + " UNION ALL SELECT i, 0, CAST(i AS VARCHAR) FROM r UNION ALL " + _fixed(_END, ["TOTAL"])),
}
#: The window of four as a state: what is held, and what went out at each step.
WINDOWED_SQL = """
WITH RECURSIVE t AS (SELECT n_nationkey AS k, n_name AS s, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s VARCHAR, i BIGINT, k INTEGER)[]) AS held, CAST(NULL AS STRUCT(s VARCHAR, i BIGINT, k INTEGER)) AS gone
      UNION ALL
      SELECT i + 1, CASE WHEN len(h) >= 4 OR came IS NULL THEN h[2:] ELSE h END, CASE WHEN len(h) >= 4 OR came IS NULL THEN h[1] END
      FROM (SELECT w.i, t.i AS came, list_sort(CASE WHEN t.i IS NULL THEN held ELSE list_append(held, {'s': t.s, 'i': t.i, 'k': t.k}) END) AS h FROM w LEFT JOIN t ON t.i = w.i + 1) AS x
      WHERE len(h) > 0)
SELECT gone.k AS n_nationkey, gone.s AS n_name, row_number() OVER (ORDER BY i) - 1 AS place FROM w WHERE gone IS NOT NULL
"""


def _quirks_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, compat="quirks").sparql("SELECT ?d ?q WHERE { ?d documents:source ?s OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?q } FILTER(?q > 0) }").typed()


_SUPPLIERS = "SELECT ?sn ?rn WHERE { ?s supplier:s_name ?sn ; supplier:s_nationkey ?n . ?n nation:n_regionkey ?r . ?r region:r_name ?rn }"


def _plain(df: DataFrame) -> DataFrame:
    """Texts of the literals in columns of terms."""
    return df.select(*[F.regexp_extract(F.col(f"`{c}`"), '"(.*)"', 1).alias(c.lstrip("?")) for c in df.columns])


def _ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ntriples")
    save_ntriples(Result("CONSTRUCT", [], None, _as_triples(spark, sf_dir).df), path)
    return _plain(Engine(spark, TripleSource(read_ntriples(spark, path)), PREFIXES).sparql(_SUPPLIERS).terms())


def _trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as TriG, with a count in a named graph that is not data."""
    data = Engine(spark, star_schema(spark, sf_dir), PREFIXES).sparql("CONSTRUCT { ?r region:r_name ?n } WHERE { ?r region:r_name ?n }")
    text = "".join(write_turtle(data)) + "<urn:meta> { <urn:page> <http://rdfs.org/ns/void#triples> 5 }\n"
    path = new_path(spark, "trig")
    spark.createDataFrame([(text,)], "value string").write.text(path)
    return _plain(Engine(spark, TripleSource(read_turtle(spark, path)), PREFIXES).sparql("SELECT ?o WHERE { ?s ?p ?o }").terms())


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders hold from their date on."""
    dated = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"valid_from": F.col("o_orderdate"), "valid_to": F.lit(None).cast("timestamp")})
    source = RelationalSource(spark, [Mapping("orders", snapshot(dated, "1996-01-01 00:00:00"), ["o_orderkey"])])
    return Engine(spark, source, PREFIXES).sparql("SELECT ?o ?st WHERE { ?o orders:o_orderstatus ?st }").typed()


_PAGE = """@prefix h: <{h}>. @prefix r: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>.
<urn:dataset> h:search [ h:template "http://pages/{{?s,p,o}}"; h:mapping [ h:variable "s"; h:property r:subject ], [ h:variable "p"; h:property r:predicate ], [ h:variable "o"; h:property r:object ] ] .
<{url}> h:totalItems {n} {following}.
{data}"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as pages of ten triples, answered by a stand-in for a server."""
    from urllib.parse import parse_qsl, urlsplit

    names = RelationalSource(spark, [Mapping("region", spark.read.parquet(f"{sf_dir}/region.parquet"), ["r_regionkey"]), Mapping("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"), ["n_nationkey"], {"n_regionkey": "region"})])
    triples = [tuple(t) for t in names.triples().where("p like '%name' or p like '%n_regionkey'").orderBy("s", "p").collect()]

    def fetch(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
        args = dict(parse_qsl(urlsplit(url).query))
        page = int(args.pop("page", 1))
        found = [t for t in triples if all(args.get(k, v) == v for k, v in zip("spo", t, strict=True))]
        term = lambda t: t if t.startswith('"') else f"<{t}>"
        data = "\n".join(" ".join(map(term, t)) + " ." for t in found[10 * page - 10 : 10 * page])
        following = f"; h:next <{url.split('&page')[0]}{'&' if '?' in url else '?'}page={page + 1}>" if len(found) > 10 * page else ""
        return 200, {"content-type": "text/turtle"}, _PAGE.format(h=HYDRA, url=url, n=len(found), following=following, data=data).encode()

    source = FragmentSource(spark, "http://pages/", fetch)
    return _plain(Engine(spark, source, PREFIXES).sparql("SELECT ?nn ?rn WHERE { ?n nation:n_name ?nn ; nation:n_regionkey ?r . ?r region:r_name ?rn }").terms())


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join over a stream of triples, run until it has caught up."""
    path, name = new_path(spark, "stream"), "streamed_" + new_path(spark, "x").rpartition("triloom-")[2][:8]
    _as_triples(spark, sf_dir).df.write.parquet(path)
    prefixes = "".join(f"PREFIX {t}: <{PREFIXES[t]}> " for t in ("supplier", "nation", "region"))
    found = _plain(stream_query(spark.readStream.schema("s string, p string, o string").parquet(path), prefixes + _SUPPLIERS))
    q = found.writeStream.format("memory").queryName(name).option("checkpointLocation", path + "-state").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


CODE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "seed_bindings": (_seeded, "SELECT CASE c_nationkey WHEN 1 THEN 'one' ELSE 'two' END AS tag, c_name AS cn FROM customer WHERE c_nationkey IN (1, 2)"),
    "federated_union": (_federated_union, "SELECT 'urn:t:supplier/' || s_suppkey AS s, s_name AS n FROM supplier UNION ALL SELECT 'urn:t:supplier/' || s_suppkey, s_name FROM supplier"),
    "federated_join": (_federated_join, "SELECT c_name AS cn, n_name AS nn FROM customer JOIN (SELECT * FROM nation UNION ALL SELECT * FROM nation) ON c_nationkey = n_nationkey"),
    "pattern_count": (_pattern_count, "SELECT 'orders.o_orderstatus' AS pattern, count(*) AS n FROM orders UNION ALL SELECT 'customer.c_name', count(*) FROM customer UNION ALL SELECT 'labels.toxic', count(*) FROM labels"),
    "triples_bgp": (_triples_bgp, "SELECT s_name AS sn, r_name AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "triples_count": (
        _triples_count,
        """WITH a AS (SELECT count(*) AS n FROM region), b AS (SELECT count(*) AS n FROM nation), c AS (SELECT count(*) AS n FROM supplier)
           SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, a.n + b.n + c.n AS n FROM a, b, c
           UNION ALL SELECT 'urn:t:region#' || x, n FROM a, (VALUES ('r_regionkey'), ('r_name')) v(x) UNION ALL SELECT 'urn:t:nation#' || x, n FROM b, (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) v(x)
           UNION ALL SELECT 'urn:t:supplier#' || x, n FROM c, (VALUES ('s_suppkey'), ('s_name'), ('s_nationkey'), ('s_acctbal')) v(x)""",
    ),
    "construct_blank": (_construct_blank, "SELECT CAST(2 AS BIGINT) AS n, 'urn:t:nation/' || n_nationkey AS o FROM nation"),
    "quirks_keep_undefined": (_quirks_keep, "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality > 0 OR quality IS NULL"),
    "ntriples_reader": (_ntriples, "SELECT s_name AS sn, r_name AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "trig_reader": (_trig, "SELECT r_name AS o FROM region"),
    "snapshot": (_snapshot, "SELECT 'urn:t:orders/' || o_orderkey AS o, o_orderstatus AS st FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01 00:00:00'"),
    "fragments": (_fragments, "SELECT n_name AS nn, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "stream_bgp": (_streamed, "SELECT s_name AS sn, r_name AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "construct_blank_mixed": (
        _construct_blank_mixed,
        "SELECT CAST(2 AS BIGINT) AS n, 'urn:t:nation/' || n_nationkey AS o, 'urn:x:Thing' AS type FROM nation UNION ALL SELECT 1, NULL, 'urn:x:Set'",
    ),
    "repeated_in_pattern": (_repeated_in_pattern, "SELECT 'urn:t:nation/' || n_nationkey AS x FROM nation WHERE n_nationkey * 11 % 25 = n_nationkey"),
    "filter_error": (_filter_error, "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3"),
    "federated_count": (
        _federated_count,
        "SELECT 'suppliers' AS pattern, 2 * count(*) AS n, 0 AS without FROM supplier UNION ALL SELECT 'customers', count(*), 1 FROM customer UNION ALL SELECT 'orders', 0, 2",
    ),
    "federated_failing": (_federated_failing, "SELECT 'urn:t:nation/' || n_nationkey AS n, n_name AS name FROM nation"),
    "windowed_sort": (_windowed, WINDOWED_SQL),
    "json": (_written("application/json"), WRITTEN_SQL["json"]),
    "sparql_json": (_written("application/sparql-results+json"), WRITTEN_SQL["sparql_json"]),
    "sparql_xml": (_written("application/sparql-results+xml"), WRITTEN_SQL["sparql_xml"]),
    "simple": (_written("simple"), WRITTEN_SQL["simple"]),
    "table": (_written("table"), WRITTEN_SQL["table"]),
    "debug": (_debug, WRITTEN_SQL["debug"]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(q) for k, (q, _) in SPARQL.items()} | {k: f for k, (f, _) in CODE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in SPARQL.items()} | {k: s for k, (_, s) in CODE.items() if s}
