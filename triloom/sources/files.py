"""Readers: N-Triples and N-Quads line by line in the JVM, Turtle and TriG file by file in Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..shipping import ship

_IRI, _BLANK = r"<[^<>\"{}|^`\\\x00-\x20]*>", r"_:[^\s<>\"]+"
_LITERAL = r'"(?:[^"\\\n\r]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?'
_LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"
_QUAD = "s string, p string, o string, g string"


class UnknownFormatError(ValueError):
    """No reader for a format or content type."""


def _unescaped(c: Column) -> Column:
    """String escapes resolved; only \\u needs more than replacing, and goes through the JSON parser."""
    quoted = F.concat(F.lit('["'), F.regexp_replace(c, r"\\'", "'"), F.lit('"]'))
    return F.when(~c.contains("\\"), c).otherwise(F.get(F.from_json(quoted, "array<string>"), 0))


def _term(raw: Column) -> Column:
    """A term as a line writes it, as terms are written here; blank nodes skolemised."""
    lex = _unescaped(F.regexp_extract(raw, r'(?s)^"(.*)"', 1))
    tag = F.lower(F.regexp_extract(raw, r'(?s)^".*"(@[A-Za-z0-9-]+)$', 1))
    dt = F.regexp_extract(raw, r'(?s)^".*"(\^\^)<([^<>]*)>$', 2)
    plain = F.concat(F.lit('"'), lex, F.lit('"'))
    literal = F.when(tag != "", F.concat(plain, tag)).when((dt != "") & (dt != T.STRING), F.concat(plain, F.lit("^^"), dt)).otherwise(plain)
    iri = F.regexp_replace(raw, r"^<|>$", "")
    return F.when(raw.startswith('"'), literal).when(raw.startswith("<"), iri).otherwise(T.skolemise(raw))


def read_ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows s, p, o, g of N-Triples or N-Quads files; comments and blank lines are skipped, any other line fails the job."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = lines.select("value", *[F.regexp_extract("value", _LINE, i + 1).alias(x) for i, x in enumerate("spog")])
    sound = F.when(F.col("p") == "", F.raise_error(F.concat(F.lit("not a triple: "), F.substring("value", 1, 200)))).otherwise(F.col("s"))
    parts = parts.withColumn("s", sound)
    return parts.select(*[_term(F.col(x)).alias(x) for x in "spo"], F.when(F.col("g") != "", _term(F.col("g"))).alias("g"))


#: The largest Turtle or TriG file: it is parsed in the memory of one task.
WHOLE_FILE_BYTES = 512 << 20


def read_turtle(spark: SparkSession, path: str | list[str], base: str = "") -> DataFrame:
    """Rows s, p, o, g of Turtle, N3 (its Turtle part) or TriG files. A file is parsed by one task, so one of more than WHOLE_FILE_BYTES is refused; N-Triples
    have no such limit. Blank nodes are distinct between files."""
    ship(spark)
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > WHOLE_FILE_BYTES).select("path").first()
    if large:
        raise ValueError(f"{large[0]} is too large to be parsed as a whole; give it as N-Triples or N-Quads, which are read line by line")
    files = spark.read.text(path, wholetext=True).select("value", F.md5(F.coalesce(F.input_file_name(), F.lit(""))).alias("file"), F.input_file_name().alias("name"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..plans.parser import parse_turtle

        for batch in batches:
            for text, file, name in zip(batch["value"], batch["file"], batch["name"], strict=True):
                rows = parse_turtle(text, base or name, "auto")
                own = lambda t, f=file: f"_:{f[:12]}_{t[2:]}" if t and t.startswith("_:") else t
                yield pd.DataFrame([tuple(map(own, r)) for r in rows], columns=list("spog"), dtype=object)

    return files.mapInPandas(parse, _QUAD).select(*[T.skolemise(F.col(x)).alias(x) for x in "spog"])


#: Formats and content types, and what reads them.
READERS = {
    **dict.fromkeys(("ntriples", "nt", "application/n-triples", "nquads", "nq", "application/n-quads"), read_ntriples),
    **dict.fromkeys(("turtle", "ttl", "n3", "trig", "text/turtle", "text/n3", "application/trig"), read_turtle),
}


def read(spark: SparkSession, path: str | list[str], format: str | None = None) -> DataFrame:
    """By format or content type, else by the file's extension; parquet must have s, p, o."""
    first = path if isinstance(path, str) else path[0]
    name = (format or first.rstrip("/").rpartition(".")[2]).split(";")[0].strip().lower()
    if name == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if name not in READERS:
        raise UnknownFormatError(f"No reader for {name!r}")
    return READERS[name](spark, path)


def snapshot(df: DataFrame, at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The triples that held at a time: versioned rows with an open or closed interval; the condition is pushed to the scan."""
    when = F.lit(at).cast("timestamp")
    return df.where((F.col(start) <= when) & (F.col(end).isNull() | (F.col(end) > when))).drop(start, end)
