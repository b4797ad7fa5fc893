import http.client
import io
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer
from xml.etree import ElementTree

import pytest
from graph import TRIPLES, e

from triloom import cli
from triloom.engine import Engine, UnsupportedQueryError
from triloom.functions.terms import INTEGER
from triloom.plans.algebra import Pattern
from triloom.results.writers import WRITERS, register, save_ntriples, write
from triloom.server import make_server, negotiate
from triloom.sources import files
from triloom.sources.federated import FederatedSource
from triloom.sources.files import UnknownFormatError, read, read_ntriples, read_turtle, snapshot
from triloom.sources.fragments import HYDRA, Controls, FragmentSource, MissingControl, extract_controls, extract_count, merged, parse_page
from triloom.sources.triples import TripleSource, from_rows
from triloom.streaming.monotone import look_ahead, stream_query, windowed_sort

P = "PREFIX e: <http://e/> "


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, from_rows(spark, TRIPLES))


def text(engine, query, kind, prefixes=None):
    return "".join(write(engine.sparql(P + query), kind, prefixes))


CITY = "SELECT ?c ?n ?x { ?c a e:City ; e:name ?n OPTIONAL { ?c e:people ?x } } ORDER BY ?c ?n"


def test_json(engine):
    found = json.loads(text(engine, CITY, "application/json"))
    assert found[0] == {"?c": e("ghent"), "?n": '"Ghent"@en', "?x": None} and len(found) == 4
    assert text(engine, "SELECT ?a { ?a e:nope ?b }", "application/json") == "[]\n"
    assert text(engine, "ASK { ?a ?b ?c }", "application/json") == "[\ntrue\n]\n"


def test_sparql_json(engine):
    found = json.loads(text(engine, CITY, "application/sparql-results+json"))
    assert found["head"] == {"vars": ["c", "n", "x"]}
    assert found["results"]["bindings"][0] == {"c": {"value": e("ghent"), "type": "uri"}, "n": {"value": "Ghent", "type": "literal", "xml:lang": "en"}}
    assert found["results"]["bindings"][1]["x"] == {"value": "900", "type": "literal", "datatype": INTEGER}
    assert json.loads(text(engine, "ASK { e:nope ?b ?c }", "application/sparql-results+json")) == {"head": {}, "boolean": False}
    assert json.loads(text(engine, "SELECT ?a { ?a e:nope ?b }", "application/sparql-results+json"))["results"]["bindings"] == []
    star = json.loads(text(engine, "SELECT * { e:dan e:knows ?x }", "application/sparql-results+json"))
    assert star["head"]["vars"] == ["x"] and star["results"]["bindings"][0]["x"]["type"] == "bnode"


def test_sparql_xml(engine):
    ns = "{http://www.w3.org/2005/sparql-results#}"
    root = ElementTree.fromstring(text(engine, CITY, "application/sparql-results+xml"))
    assert [v.get("name") for v in root.find(ns + "head")] == ["c", "n", "x"]
    assert len(root.find(ns + "results")) == 4 and root.find(f"{ns}results/{ns}result/{ns}binding/{ns}uri").text == e("ghent")
    assert ElementTree.fromstring(text(engine, "ASK { ?a ?b ?c }", "application/sparql-results+xml")).find(ns + "boolean").text == "true"


def test_simple_table_debug(engine):
    assert text(engine, "SELECT ?c ?name { ?c e:name ?name FILTER(?c = e:ghent) }", "simple") == f'   c: {e("ghent")}\nname: "Ghent"@en\n'
    lines = text(engine, CITY, "table").splitlines()
    assert lines[0].split() == ["c", "n", "x"] and set(lines[1]) == {"-"} and len(lines) == 6 and all(len(x) == 152 for x in lines)
    assert text(engine, "ASK { ?a ?b ?c }", "table") == text(engine, "ASK { ?a ?b ?c }", "simple") == "true\n"
    debug = text(engine, CITY, "debug").splitlines()
    assert debug[0] == "Result,Delay (ms)" and len(debug) == 6 and debug[-1].startswith("TOTAL,")


def test_turtle_and_registry(engine, spark, tmp_path):
    made = text(engine, "CONSTRUCT { ?c a e:Place ; e:n ?n } { ?c e:name ?n }", "whatever", {"e": "http://e/"})
    path = tmp_path / "x.ttl"
    path.write_text(made)
    assert read_turtle(spark, str(path)).count() == 8 and "e:ghent " in made
    register("x/y", lambda r: iter(["z"]))
    assert text(engine, CITY, "x/y") == "z"
    del WRITERS["x/y"]
    with pytest.raises(ValueError, match="No writer"):
        text(engine, CITY, "x/y")
    out = str(tmp_path / "nt")
    save_ntriples(engine.sparql(P + "CONSTRUCT { ?c e:n ?n } { ?c e:name ?n }"), out)
    assert {tuple(r)[:3] for r in read_ntriples(spark, out).collect()} == {(s, e("n"), o) for s, p, o in TRIPLES if p == e("name")}


def test_ntriples_and_nquads(spark, tmp_path):
    path = tmp_path / "a.nq"
    path.write_text('# note\n\n<http://a> <http://p> "x\\n\\"y\\u0041"@EN .\n_:b <http://p> "1"^^<http://dt> . # end\n<http://a> <http://p> <http://b> <http://g> .\n')
    found = [tuple(r) for r in read(spark, str(path)).collect()]
    assert found == [("http://a", "http://p", '"x\n"yA"@en', None), ("http://local/.well-known/genid/b", "http://p", '"1"^^http://dt', None), ("http://a", "http://p", "http://b", "http://g")]
    path.write_text("nonsense\n")
    with pytest.raises(Exception, match="not a triple"):
        read(spark, str(path)).collect()
    with pytest.raises(UnknownFormatError):
        read(spark, "x.xyz")


def test_large_turtle_files_are_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "a.ttl").write_text("<http://a> <http://b> <http://c> .\n" * 5)
    assert read_turtle(spark, str(tmp_path / "a.ttl")).count() == 5
    monkeypatch.setattr(files, "WHOLE_FILE_BYTES", 50)
    with pytest.raises(ValueError, match="too large"):
        read_turtle(spark, str(tmp_path / "a.ttl"))


def test_cancel_all(spark):
    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    engine = Engine(spark, TripleSource(spark.range(1).selectExpr("'http://a' AS s", "'http://b' AS p", "'http://c' AS o").mapInPandas(slow, "s string, p string, o string")))
    threading.Timer(2, engine.cancel_all).start()
    began = time.monotonic()
    with pytest.raises(Exception, match="cancel"):
        engine.sparql("SELECT ?s { ?s <http://b> ?o }").terms().collect()
    assert time.monotonic() - began < 40


def test_snapshot(spark):
    df = spark.createDataFrame([("a", "2020-01-01", "2021-01-01"), ("b", "2020-06-01", None)], "s string, f string, t string").selectExpr("s", "cast(f as timestamp) valid_from", "cast(t as timestamp) valid_to")
    names = lambda at: [r["s"] for r in snapshot(df, at).orderBy("s").collect()]
    assert names("2020-03-01") == ["a"] and names("2020-07-01") == ["a", "b"] and names("2022-01-01") == ["b"]


PAGE = """@prefix h: <{h}>. @prefix v: <http://rdfs.org/ns/void#>. @prefix r: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>.
<http://d/#dataset> h:search [ h:template "http://d/{{?s,p,o}}"; h:mapping [ h:variable "s"; h:property r:subject ], [ h:variable "p"; h:property r:predicate ], [ h:variable "o"; h:property r:object ] ] .
<{url}> v:triples {n} ; h:totalItems 99 {next} .
{data}"""
SIZE = 3


class Web:
    """Pages of the tiny graph, three triples each."""

    def __init__(self, triples, broken=()):
        self.triples, self.broken, self.asked = triples, broken, []

    def __call__(self, url, headers):
        self.asked.append((url, headers))
        if url in self.broken:
            raise OSError("gone")
        args = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))
        page = int(args.pop("page", 1))
        found = [t for t in self.triples if all(args.get(k, v) == v for k, v in zip("spo", t, strict=True))]
        term = lambda t: f"<{t}>" if not t.startswith(('"', "_:")) else t if not t.endswith(INTEGER) else t.replace("^^" + INTEGER, f"^^<{INTEGER}>")
        data = "\n".join(f"{term(s)} {term(p)} {term(o)} ." for s, p, o in found[(page - 1) * SIZE : page * SIZE])
        following = f'; h:next <{url.split("&page")[0]}{"&" if "?" in url else "?"}page={page + 1}>' if len(found) > page * SIZE else ""
        return 200, {"content-type": "text/turtle;charset=utf-8"}, PAGE.format(h=HYDRA, url=url, n=len(found), next=following, data=data).encode()


def test_fragments(spark):
    named = [t for t in TRIPLES if "_:" not in t[0] + t[2]]
    web = Web(named)
    source = FragmentSource(spark, "http://d/", web)
    assert source.count(Pattern("?s", e("born"), "?o")) == 4
    assert source.scan(Pattern("?s", e("born"), "?o")).df.count() == 4
    found = list(Engine(spark, source).sparql(P + 'SELECT ?p { ?p e:born ?c . ?c e:name "York"@en }').rows())
    assert {r["?p"] for r in found} == {e("ann"), e("bob"), e("cat")}
    before = len(web.asked)
    source.count(Pattern("?s", e("born"), "?o"))
    assert len(web.asked) == before  # kept
    assert source.count(Pattern('"x"', "?p", "?o")) == 0 and len(web.asked) == before


def test_fragment_failures(spark):
    start = FragmentSource(spark, "http://d/", Web(TRIPLES, broken={"http://d/"}))
    for _ in range(2):
        with pytest.raises(OSError):
            start.count(Pattern("?s", "?p", "?o"))
    url = "http://d/?p=" + urllib.parse.quote(e("born"), safe="")
    with pytest.raises(OSError):
        FragmentSource(spark, "http://d/", Web(TRIPLES, broken={url})).count(Pattern("?s", e("born"), "?o"))
    quiet = FragmentSource(spark, "http://d/", Web(TRIPLES, broken={url}), on_error="warn_empty")
    assert list(Engine(spark, quiet).sparql(P + "SELECT * { ?s e:born ?o }").rows()) == []


def test_late_failures(spark):
    """A page that fails while the query runs: an error, or for a federation that may lose sources the end of that source's pages."""
    later = "http://d/?p=" + urllib.parse.quote(e("born"), safe="") + "&page=2"
    query = P + "SELECT * { ?s e:born ?o }"
    with pytest.raises(OSError):
        list(Engine(spark, FragmentSource(spark, "http://d/", Web(TRIPLES, broken={later}))).sparql(query).rows())
    quiet = FragmentSource(spark, "http://d/", Web(TRIPLES, broken={later}), on_error="warn_empty")
    assert len(list(Engine(spark, quiet).sparql(query).rows())) == SIZE
    both = FederatedSource(spark, [FragmentSource(spark, "http://d/", Web(TRIPLES, broken={later})), from_rows(spark, [(e("eve"), e("born"), e("york"))])])
    assert len(list(Engine(spark, both).sparql(query).rows())) == SIZE + 1


def test_late_failures_in_tasks(spark):
    """The same where tasks fetch the pages."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            base = f"http://127.0.0.1:{self.server.server_address[1]}"
            second = "page=2" in self.path
            body = PAGE.format(h=HYDRA, url=base + self.path, n=9, next=f"; h:next <{base}/?page=2>", data="<http://a> <http://b> <http://c> .").replace("http://d/{", base + "/{").encode()
            self.send_response(500 if second else 200)
            self.send_header("Content-Type", "text/turtle")
            self.end_headers()
            self.wfile.write(b"" if second else body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    start = f"http://127.0.0.1:{server.server_address[1]}/"
    with pytest.raises(Exception, match="500"):
        FragmentSource(spark, start).scan(Pattern("?s", "?p", "?o")).df.collect()
    both = FederatedSource(spark, [FragmentSource(spark, start), from_rows(spark, [("http://x", "http://y", "http://z")])])
    assert both.scan(Pattern("?s", "?p", "?o")).df.count() == 2
    server.shutdown()


def test_templates():
    names = {"s": "s", "p": "p", "o": "o"}
    found = lambda template: Controls(template=template, names=names).url(Pattern("http://a b", "?p", '"o"'))
    assert found("http://d/{s}{#o}") == "http://d/http%3A%2F%2Fa%20b#%22o%22" and found("http://d/{+s,p}") == "http://d/http://a%20b"
    assert found("http://d{/s,o}{;p,o}{.o}") == "http://d/http%3A%2F%2Fa%20b/%22o%22;o=%22o%22.%22o%22"
    assert found("http://d/?x=1{&s,p,o}") == "http://d/?x=1&s=http%3A%2F%2Fa%20b&o=%22o%22" and found("http://d/{?p}") == "http://d/"


def test_page_metadata():
    page = parse_page("http://d/x", PAGE.format(h=HYDRA, url="http://d/x", n=44, next="; h:nextPage <http://d/x2>", data="<http://a> <http://b> <http://c> ."))
    assert page.total == 44 and len(page.controls.names) == 3 and page.controls.link("next") == "http://d/x2"
    assert ("http://a", "http://b", "http://c") in page.data
    assert page.controls.url(Pattern("?s", "http://b c", '"o"@en')) == "http://d/?p=http%3A%2F%2Fb%20c&o=%22o%22%40en"
    with pytest.raises(MissingControl):
        page.controls.link("last")
    with pytest.raises(MissingControl):
        extract_controls("http://d/x", []).url(Pattern("?s", "?p", "?o"))
    assert extract_count("http://other", page.metadata) == {} and extract_count("http://d/x", [("http://d/x", "u:n", '"7 of 9"')], ("u:n",)) == {"total": 7}
    quads = parse_page("http://d/x", "<http://a> <http://b> <http://d/x> . <http://d/x#m> { <http://d/x> <http://rdfs.org/ns/void#triples> 5 }", "application/trig")
    assert quads.total == 5 and len(quads.data) == 1
    with pytest.raises(UnknownFormatError):
        parse_page("http://d/x", "", "text/html")
    boom = lambda page, triples: 1 / 0
    assert merged([boom, lambda p, t: {"a": 1}, lambda p, t: {"a": 2, "b": 3}], "http://d/x", []) == {"a": 1, "b": 3}


def test_time_gate(spark):
    asked = []

    def fetch(url, headers):
        asked.append((url, headers.get("Accept-Datetime")))
        if url == "http://d/":
            return 200, {"content-type": "text/turtle", "link": '<http://gate/>; rel="timegate", <http://d/>; rel="original"'}, b""
        return 200, {"content-type": "text/turtle", "memento-datetime": "x"}, PAGE.format(h=HYDRA, url=url, n=0, next="", data="").encode()

    assert FragmentSource(spark, "http://d/", fetch, at="Mon, 01 Jan 2024 00:00:00 GMT").controls().template
    assert [x[0] for x in asked] == ["http://d/", "http://gate/"] and all(x[1] for x in asked)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.nt").write_text("<http://e/a> <http://e/p> <http://e/b> .\n")
    (tmp_path / "b.nt").write_text("<http://e/b> <http://e/p> <http://e/c> .\n")
    (tmp_path / "q.sparql").write_text("SELECT ?x ?z { ?x <http://e/p> ?y . ?y <http://e/p> ?z }")
    out = io.StringIO()
    assert cli.main([str(tmp_path / "a.nt"), str(tmp_path / "b.nt"), str(tmp_path / "q.sparql")], spark, out) == 0
    assert json.loads(out.getvalue()) == [{"?x": e("a"), "?z": e("c")}]
    out = io.StringIO()
    assert cli.main([str(tmp_path / "a.nt"), "-q", "CONSTRUCT WHERE { ?a ?b ?c }"], spark, out) == 0 and out.getvalue() == "<http://e/a> <http://e/p> <http://e/b>.\n"
    out = io.StringIO()
    assert cli.main(["--listformats"], spark, out) == 0 and out.getvalue().split() == list(WRITERS)
    assert cli.main([str(tmp_path / "a.nt"), "-q", "SELECT"], spark, out) == 1 and "Parse error" in capsys.readouterr().err
    assert cli.main([], spark, out) == 1


def test_server(engine):
    server = make_server(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(url, data=None, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + url, data, headers)) as r:
                return r.status, r.headers["Content-Type"], r.read().decode()
        except urllib.error.HTTPError as x:
            return x.code, x.headers["Content-Type"], x.read().decode()

    query = P + "SELECT ?c { ?c a e:City } ORDER BY ?c LIMIT 1"
    form = urllib.parse.urlencode({"query": query})
    assert json.loads(get("/sparql?" + form)[2]) == [{"?c": e("ghent")}]
    assert json.loads(get("/sparql", form.encode())[2]) == [{"?c": e("ghent")}]
    status, kind, body = get("/sparql", query.encode(), **{"Content-Type": "application/sparql-query", "Accept": "application/sparql-results+json;q=0.9, text/html"})
    assert (status, kind) == (200, "application/sparql-results+json") and json.loads(body)["head"]["vars"] == ["c"]
    assert get("/sparql?" + urllib.parse.urlencode({"query": P + "CONSTRUCT { ?c a e:X } { ?c a e:City }"}))[1] == "text/turtle"
    assert get("/other")[0] == 404 and get("/sparql?query=SELECT")[0] == 400
    assert get("/sparql", b"x", **{"Content-Type": "text/plain"})[0] == 400
    request = urllib.request.Request(base + "/sparql", method="DELETE")
    with pytest.raises(urllib.error.HTTPError) as x:
        urllib.request.urlopen(request)
    assert x.value.code == 405
    server.shutdown()
    assert negotiate("text/html, */*;q=0.1", ["a/b", "c/d"]) == "a/b" and negotiate("c/*", ["a/b", "c/d"]) == "c/d" and negotiate(None, ["a/b"]) == "a/b"


def test_server_stops_slow_queries(spark):
    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    df = spark.range(1).selectExpr("'http://a' AS s", "'http://b' AS p", "'http://c' AS o").mapInPandas(slow, "s string, p string, o string")
    server = make_server(Engine(spark, TripleSource(df, estimates={})), 0, timeout=1.0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    began = time.monotonic()
    with pytest.raises(http.client.IncompleteRead):
        urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/sparql?" + urllib.parse.urlencode({"query": "SELECT ?s { ?s <http://b> ?o }"})).read()
    assert time.monotonic() - began < 40
    server.shutdown()


def test_server_marks_results_that_are_cut_off(spark):
    class Cut(Engine):
        def sparql(self, text, seed=None):
            result = super().sparql(text, seed)

            def rows():
                yield {"?s": "http://a"}
                raise RuntimeError("stopped")

            result.rows = rows
            return result

    server = make_server(Cut(spark, from_rows(spark, [("http://a", "http://b", "http://c")])), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with pytest.raises(http.client.IncompleteRead):
        urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/sparql?" + urllib.parse.urlencode({"query": "SELECT ?s { ?s <http://b> ?o }"})).read()
    server.shutdown()


def test_look_ahead(spark):
    assert list(look_ahead(iter([8, 6, 4, 3, 1, 2, 7, 5]), 4)) == [3, 1, 2, 4, 5, 6, 7, 8]
    assert list(look_ahead(iter([8, 6, 4, 3, 1, 2, 7, 5]), 100, key=lambda x: -x)) == [8, 7, 6, 5, 4, 3, 2, 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([8, 6, 4, 3, 1, 2, 7, 5])], "i long, v long")
    assert [r["v"] for r in windowed_sort(df, "v", 4, "i").orderBy("place").collect()] == [3, 1, 2, 4, 5, 6, 7, 8]


def test_stream(spark, tmp_path):
    path = str(tmp_path / "s")
    from_rows(spark, TRIPLES).df.write.parquet(path)
    stream = spark.readStream.schema("s string, p string, o string").parquet(path)
    found = stream_query(stream, P + 'SELECT ?p ?c { ?p e:born ?c . ?c e:name "York"@en }').selectExpr("`?p` as p", "`?c` as c")
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["p"] for r in spark.table("found").collect()} == {e("ann"), e("bob"), e("cat")}
    for bad in ("SELECT * { ?a ?b ?c OPTIONAL { ?a ?b ?d } }", "SELECT DISTINCT * { ?a ?b ?c }", "ASK { ?a ?b ?c }"):
        with pytest.raises(UnsupportedQueryError):
            stream_query(stream, bad)
