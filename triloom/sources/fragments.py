"""Paged web documents of triples: data, counts and links told apart, and a scan that follows the pages."""

from __future__ import annotations

import gzip
import logging
import re
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import terms as T
from ..plans.algebra import Pattern
from ..plans.parser import parse_turtle
from ..plans.relation import Relation, nothing
from ..shipping import ship
from .base import Source, bind, impossible
from .files import UnknownFormatError

log = logging.getLogger("triloom.sources")

HYDRA = "http://www.w3.org/ns/hydra/core#"
VOID_TRIPLES = "http://rdfs.org/ns/void#triples"
COUNT_PREDICATES = (VOID_TRIPLES, HYDRA + "totalItems")
#: Link names and the predicates that state them, newer names first.
LINKS = {x: (HYDRA + x, HYDRA + x + "Page") for x in ("first", "next", "previous", "last")}
#: Content types that are read, and whether metadata is in named graphs.
TYPES = {"text/turtle": False, "text/n3": False, "application/n-triples": False, "application/trig": True, "application/n-quads": True}
ACCEPT = ", ".join(f"{kind};q={weight}" for kind, weight in (("application/n-quads", 1), ("application/trig", 0.9), ("application/n-triples", 0.5), ("text/turtle", 0.4), ("text/n3", 0.1)))

Triple = tuple[str, str, str]
#: (url, headers) to (status, headers with lower-case names, body).
Fetch = Callable[[str, dict[str, str]], tuple[int, dict[str, str], bytes]]


def fetch_http(url: str, headers: dict[str, str], timeout: float = 5.0) -> tuple[int, dict[str, str], bytes]:
    """GET with redirects and compressed bodies; an error status raises."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept-Encoding": "gzip,deflate", **headers}), timeout=timeout) as r:
        found, body = {k.lower(): v for k, v in r.headers.items()}, r.read()
        if found.get("content-encoding") == "gzip":
            body = gzip.decompress(body)
        elif found.get("content-encoding") == "deflate":
            body = zlib.decompress(body)
        return r.status, found, body


def extract_count(page: str, triples: list[Triple], predicates: tuple[str, ...] = COUNT_PREDICATES) -> dict:
    """The first count stated of the page itself: its first digits."""
    for s, p, o in triples:
        if p in predicates and T.py_same_url(s, page) and (m := re.search(r"\d+", o)):
            return {"total": int(m[0])}
    return {}


#: What URI templates put before and between the values of each kind of expression, whether names go with them, and whether reserved characters stay.
EXPANSIONS = {
    "": ("", ",", False, False),
    "+": ("", ",", False, True),
    "#": ("#", ",", False, True),
    ".": (".", ".", False, False),
    "/": ("/", "/", False, False),
    ";": (";", ";", True, False),
    "?": ("?", "&", True, False),
    "&": ("&", "&", True, False),
}
RESERVED = ":/?#[]@!$&'()*+,;="


class MissingControl(KeyError):
    """A link or form that the page doesn't have."""


@dataclass
class Controls:
    links: dict[str, str] = field(default_factory=dict)
    template: str | None = None
    names: dict[str, str] = field(default_factory=dict)  # s, p, o to the template's variable

    def link(self, name: str) -> str:
        if name not in self.links:
            raise MissingControl(name)
        return self.links[name]

    def url(self, p: Pattern) -> str:
        """The page of a pattern: the search form filled in, open positions left out."""
        if self.template is None:
            raise MissingControl("search form")
        values = {self.names[x]: t for x, t in zip("spo", p, strict=True) if not T.py_is_open(t)}

        def expand(m: re.Match) -> str:
            first, between, named, plain = EXPANSIONS[m[1]]
            own = [(n, quote(values[n], safe=RESERVED if plain else "")) for n in (x.strip("*") for x in m[2].split(",")) if n in values]
            parts = [(n if m[1] == ";" and not v else f"{n}={v}") if named else v for n, v in own]
            return (first if parts else "") + between.join(parts)

        return re.sub(r"\{([+#./;?&]?)([^}]*)\}", expand, self.template)


def extract_controls(page: str, triples: list[Triple]) -> Controls:
    found = Controls()
    by_subject: dict[str, dict[str, list[str]]] = {}
    for s, p, o in triples:
        by_subject.setdefault(s, {}).setdefault(p, []).append(o)
    own = {p: o for s, x in by_subject.items() if T.py_same_url(s, page) for p, o in x.items()}
    for name, predicates in LINKS.items():
        for p in predicates:
            if p in own and name not in found.links:
                found.links[name] = own[p][0]
    properties = {T.RDF + "subject": "s", T.RDF + "predicate": "p", T.RDF + "object": "o"}
    for x in by_subject.values():
        for form in x.get(HYDRA + "search", ()):
            stated = by_subject.get(form, {})
            names = {}
            for m in stated.get(HYDRA + "mapping", ()):
                at = by_subject.get(m, {})
                for prop, var in zip(at.get(HYDRA + "property", ()), at.get(HYDRA + "variable", ()), strict=False):
                    if prop in properties:
                        names[properties[prop]] = T.py_literal(var)[0]
            if found.template is None and len(names) == 3 and stated.get(HYDRA + "template"):
                found.template, found.names = T.py_literal(stated[HYDRA + "template"][0])[0], names
    return found


def merged(extractors: list[Callable[[str, list[Triple]], dict]], page: str, triples: list[Triple]) -> dict:
    """What several extractors find; of one name the first counts, and an extractor that fails finds nothing."""
    out: dict = {}
    for extract in extractors:
        try:
            for k, v in extract(page, triples).items():
                out.setdefault(k, v)
        except Exception as e:  # noqa: BLE001
            log.info("extractor failed on %s: %s", page, e)
    return out


@dataclass
class Page:
    url: str
    data: list[Triple]
    metadata: list[Triple]

    @property
    def total(self) -> int | None:
        return extract_count(self.url, self.metadata).get("total")

    @property
    def controls(self) -> Controls:
        return extract_controls(self.url, self.metadata)


def parse_page(url: str, text: str, content_type: str = "text/turtle") -> Page:
    """With named graphs the default graph is the data; else triples about the page itself and with Hydra predicates are metadata."""
    kind = content_type.split(";")[0].strip().lower()
    if kind not in TYPES:
        raise UnknownFormatError(f"No parser for {content_type}")
    quads = parse_turtle(text, url)
    if TYPES[kind]:
        is_data = lambda q: q[3] is None
    else:
        is_data = lambda q: not (T.py_same_url(q[0], url) or q[1].startswith(HYDRA))
    return Page(url, [q[:3] for q in quads if is_data(q)], [q[:3] for q in quads if not is_data(q)])


def fetch_page(url: str, fetch: Fetch = fetch_http, at: str | None = None) -> Page:
    """at: an HTTP date; an undated answer is then fetched again through the time gate it names."""
    headers = {"Accept": ACCEPT} | ({"Accept-Datetime": at} if at else {})
    _, found, body = fetch(url, headers)
    if at and "memento-datetime" not in found and (m := re.search(r'<([^>]+)>\s*;[^,]*rel="?[^",]*\btimegate\b', found.get("link", ""))):
        _, found, body = fetch(m[1], headers)
    return parse_page(url, body.decode(), found.get("content-type", "text/turtle"))


def pages(url: str, fetch: Fetch = fetch_http, at: str | None = None, late_errors: str = "raise") -> Iterator[Page]:
    """A page and those after it. late_errors: "raise", or "stop" for a warning and an end where a page can't be read."""
    while url:
        try:
            page = fetch_page(url, fetch, at)
        except Exception as e:
            if late_errors != "stop":
                raise
            log.warning("no pages from %s on: %s", url, e)
            return
        yield page
        url = page.controls.links.get("next")


class _Reader(DataSourceReader):
    def __init__(self, url: str, at: str | None, late_errors: str):
        self.url, self.at, self.late_errors = url, at, late_errors

    def partitions(self):
        return [InputPartition(self.url)]

    def read(self, partition):
        for page in pages(partition.value, at=self.at, late_errors=self.late_errors):
            yield from page.data


class FragmentDataSource(DataSource):
    """spark.read.format("fragments").load(url): the triples of a page and those after it, fetched by a task page by page."""

    @classmethod
    def name(cls) -> str:
        return "fragments"

    def schema(self) -> str:
        return "s string, p string, o string"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("at"), self.options.get("late_errors", "raise"))


class FragmentSource(Source):
    """A web source whose start page has a search form. Patterns are fetched when first asked for; counts come from their first page.

    on_error: "raise", or "warn_empty" for a warning and no rows. late_errors says the same of pages that are read while the query runs, where
    "stop" keeps what came before; a federation that may lose sources sets it. A start page that fails keeps failing. The last cache pages of patterns are
    kept. With a fetch function of its own (tests, local files) pages are read by the driver, else by tasks.
    """

    def __init__(self, spark: SparkSession, start: str, fetch: Fetch | None = None, on_error: str = "raise", at: str | None = None, cache: int = 100):
        self.spark, self.start, self.fetch, self.on_error, self.at = spark, start, fetch, on_error, at
        self.cache, self._pages, self._controls, self._failure = cache, {}, None, None
        self.late_errors = "stop" if on_error == "warn_empty" else "raise"
        ship(spark)
        spark.dataSource.register(FragmentDataSource)

    def controls(self) -> Controls:
        if self._failure:
            raise self._failure
        if self._controls is None:
            try:
                self._controls = fetch_page(self.start, self.fetch or fetch_http, self.at).controls
            except Exception as e:
                self._failure = e
                raise
        return self._controls

    def first_page(self, p: Pattern) -> Page:
        url = self.controls().url(p)
        if url not in self._pages:
            while len(self._pages) >= self.cache:
                self._pages.pop(next(iter(self._pages)))
            self._pages[url] = fetch_page(url, self.fetch or fetch_http, self.at)
        else:
            self._pages[url] = self._pages.pop(url)  # used last
        return self._pages[url]

    def count(self, p: Pattern) -> float:
        if impossible(p):
            return 0
        try:
            page = self.first_page(p)
        except Exception:
            if self.on_error == "warn_empty":
                log.warning("could not read %s", p)
                return 0
            raise
        return float(len(page.data) if page.total is None else page.total)

    def scan(self, p: Pattern) -> Relation:
        if self.on_error == "warn_empty" and self.count(p) == 0:
            return nothing(self.spark, p.variables())
        url = self.controls().url(p)
        if self.fetch is None:
            df = self.spark.read.format("fragments").options(late_errors=self.late_errors, **({"at": self.at} if self.at else {})).load(url)
        else:
            rows = [t for page in pages(url, self.fetch, self.at, self.late_errors) for t in page.data]
            df = self.spark.createDataFrame(rows, "s string, p string, o string")
        return bind(df.select(*[T.skolemise(F.col(x)).alias(x) for x in "spo"]), p)
