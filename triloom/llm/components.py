"""Connected components of a graph in tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialise, released

#: Edges that a task holds at once while it contracts its own share of them.
HELD_EDGES = 1_000_000


@released
def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: each node with the smallest one that the same share of edges ties it to."""
    root: dict = {}

    def find(x: object) -> object:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        found = [(x, top) for x in root if (top := find(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], schema.field(i).type) for i in (0, 1)], ["a", "b"])

    schema, n = None, 0
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        n += batch.num_rows
        if n >= HELD_EDGES:
            yield stars(schema)
            n = 0
    if n:
        yield stars(schema)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``comp`` (the smallest node reachable) for all nodes of edges (``a``, ``b``) but those that only meet themselves.

    First every task contracts its own share of the edges into stars, in bounded memory, so that at most one edge a node and share is
    left. Then every round renames each node to the smallest of itself and its neighbours, contracts the edges and drops loops,
    until none is left; a node's new names are followed along. Nodes with very many edges are joined by join_groups(). Each round starts
    from written tables, so lineage doesn't grow.
    """
    kind = edges.schema["a"].dataType.simpleString()
    stars = edges.select("a", "b").where("a <> b").distinct().mapInArrow(_contracted, f"a {kind}, b {kind}")
    both = stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    both = materialise(both.distinct(), "edges")
    names = None
    while not both.isEmpty():
        step = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"), F.count(F.lit(1)).alias("degree"))
        step = materialise(step, "renamed")
        if names is None:
            names = step.select(F.col("a").alias("node"), F.col("to").alias("comp"))
        else:
            sizes = names.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
            named = materialise(sizes.join(step.select(F.col("a").alias("comp"), "to"), "comp"), "named")
            names = materialise(join_groups(names, named, ["comp"], "size").select("node", F.coalesce("to", "comp").alias("comp")), "names")
        left = join_groups(both, step, ["a"], "degree", "inner").select("b", F.col("to").alias("a2"))
        right = join_groups(left, step.select(F.col("a").alias("b"), "to", "degree"), ["b"], "degree", "inner")
        both = materialise(right.select(F.col("a2").alias("a"), F.col("to").alias("b")).where("a <> b").distinct(), "edges")
    if names is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return names
