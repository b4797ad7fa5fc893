"""Joins that survive hot keys, and tables in buckets."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triloom.llm import common
from triloom.llm.common import Bucketed, ascii_lower, join_groups, materialise, spread_join


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([0, 0, 0, 1, 2, 3, None, 100 + i])) for i in range(3000)]
    return data, materialise(spark.createDataFrame(data, "id long, k long"), "rows")


def test_joins_with_hot_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 16)
    data, table = rows
    groups = table.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("text", F.concat(F.lit("t"), F.col("k")))
    times = Counter(k for _, k in data if k is not None)
    for how in ("left", "inner"):
        found = [tuple(r) for r in join_groups(table, groups, ["k"], "n", how).select("id", "k", "n", "text").collect()]
        want = [(i, k, times[k] if k is not None else None, f"t{k}" if k is not None else None) for i, k in data if how == "left" or k is not None]
        assert sorted(map(str, found)) == sorted(map(str, want))
    several = groups.select("k", "text").unionByName(groups.select("k", F.concat("text", F.lit("'")).alias("text")))
    found = [tuple(r) for r in spread_join(table, several, ["k"]).select("id", "k", "text").collect()]
    assert Counter(found) == Counter((i, k, f"t{k}{x}") for i, k in data if k is not None for x in ("", "'"))
    assert spread_join(table.limit(0), several, ["k"]).count() == 0


def test_bucketed_tables_stay_where_they_are(spark, rows):
    data, table = rows
    held = Bucketed(table, "k", "held")
    small = spark.createDataFrame([(0, "zero"), (1, "one")], "k long, name string")
    joined = held.frame.join(small.hint("merge"), "k")
    assert joined.count() == sum(k in (0, 1) for _, k in data) and held.files.count() == len(data)
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of the small side
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("triloom_") and not t.isTemporary]


def test_ascii_lower(spark):
    texts = ["ABC xyz", "ÀÉ ABC", "İI", "", "ǅA", "ẞZ"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t"))).collect()]
    assert found == ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in texts]
