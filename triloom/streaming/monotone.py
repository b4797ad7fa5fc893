"""Queries over a stream of triples, and results as they come."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.algebra import Bgp, Filter, Group, Union, UnsupportedQueryError
from ..plans.parser import parse
from ..shipping import ship
from ..sources.triples import TripleSource


def check_monotone(node) -> None:
    """Only what never takes a solution back: patterns, filters, unions and groups."""
    if isinstance(node, Group):
        if node.optional:
            raise UnsupportedQueryError("OPTIONAL is not supported over a stream.")
        for x in node.parts:
            check_monotone(x)
    elif isinstance(node, Union):
        for x in node.branches:
            check_monotone(x)
    elif not isinstance(node, (Bgp, Filter)):
        raise UnsupportedQueryError(f"{type(node).__name__} is not supported over a stream.")


def stream_query(triples: DataFrame, text: str, **options) -> DataFrame:
    """A SELECT over a streaming table (s, p, o) as a streaming table of terms; joins between its patterns are stream joins, which keep all rows
    unless the stream has a watermark. Order, slices, DISTINCT and OPTIONAL are refused."""
    from ..engine import Engine

    q = parse(text)
    if q.form != "SELECT" or q.order or q.distinct or q.offset or q.limit is not None:
        raise UnsupportedQueryError("Only plain SELECT is supported over a stream.")
    check_monotone(q.where)
    return Engine(triples.sparkSession, _StreamSource(triples), **options).sparql(text).terms()


class _StreamSource(TripleSource):
    """A stream has no counts: patterns keep the order in which they are written."""

    def count(self, p) -> float:
        return 1.0


def look_ahead(items: Iterator, window: int, key: Callable = lambda x: x) -> Iterator:
    """Items in an order that is right as far as holding ``window`` of them allows: the smallest of those held goes out."""
    held: list = []
    for i, x in enumerate(items):
        heapq.heappush(held, (key(x), i, x))
        if len(held) >= window:
            yield heapq.heappop(held)[2]
    while held:
        yield heapq.heappop(held)[2]


def windowed_sort(df: DataFrame, column: str, window: int, position: str) -> DataFrame:
    """Rows of df, which are in the order of position, sorted within a look-ahead of ``window`` rows; new column ``place``.

    The order of one sequence can't be split: all rows go through one task, as a stream, holding only the window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        at = df_columns.index(column)
        out: list = []
        place = 0
        for row in look_ahead(rows, window, key=lambda r: r[at]):
            out.append((*row, place))
            place += 1
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=[*df_columns, "place"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[*df_columns, "place"])

    ship(df.sparkSession)
    df_columns = list(df.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(1).sortWithinPartitions(position).mapInPandas(run, f"{fields}, place long")
