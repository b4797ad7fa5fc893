"""Triples as a table (s, p, o), and a writer that lays such tables out for pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.algebra import Pattern
from ..plans.relation import Relation
from .base import Source, bind, impossible

#: Predicates whose counts are kept, the most frequent ones; others count as the least frequent of these.
STATS_PREDICATES = 10_000
#: Where write_triples() stores counts; names with an underscore are no data to Spark.
COUNTS = "_counts"


class TripleSource(Source):
    """Blank nodes of the data are skolemised on the way in, so they match like IRIs and come out as blank nodes again.

    bucketed: the table has the column p_bucket that write_triples() adds; a constant predicate then prunes partitions. counted: the
    counts that it stores, without which the triples are counted when an order of joins first needs it.
    """

    def __init__(self, df: DataFrame, bucketed: int = 0, estimates: dict[Pattern, float] | None = None, counted: DataFrame | None = None):
        self.spark, self.raw, self.bucketed, self.counted = df.sparkSession, df, bucketed, counted
        if "g" in df.columns:
            df = df.where("g is null")  # named graphs hold metadata
        self.df, self.given, self._stats = df, estimates or {}, None

    def scan(self, p: Pattern) -> Relation:
        df = self.df
        if self.bucketed and not T.py_is_open(p.p):
            df = df.where(F.col("p_bucket") == F.pmod(F.hash(F.lit(p.p)), F.lit(self.bucketed)))
        return bind(df.select("s", "p", "o"), p)

    @property
    def stats(self) -> dict[str, tuple[int, int, int]]:
        """predicate: (triples, subjects, objects), the latter two estimated; gathered once."""
        if self._stats is None:
            rows = _counts(self.df) if self.counted is None else self.counted
            self._stats = {r["p"]: (r["n"], max(1, r["s"]), max(1, r["o"])) for r in rows.orderBy(F.desc("n")).limit(STATS_PREDICATES).collect()}
        return self._stats

    def count(self, p: Pattern) -> float:
        if impossible(p):
            return 0
        if p in self.given:
            return self.given[p]
        if T.py_is_open(p.p):
            known = self.stats.values()
        elif p.p in self.stats:
            known = [self.stats[p.p]]
        elif len(self.stats) < STATS_PREDICATES:
            return 0
        else:
            known = [min(self.stats.values())]
        total = 0.0
        for n, s, o in known:
            total += n / (1 if T.py_is_open(p.s) else s) / (1 if T.py_is_open(p.o) else o)
        return total


def _counts(df: DataFrame) -> DataFrame:
    return df.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s").alias("s"), F.approx_count_distinct("o").alias("o"))


def from_rows(spark: SparkSession, rows: list[tuple[str, str, str]], **options) -> TripleSource:
    df = spark.createDataFrame([tuple(r[:3]) for r in rows], "s string, p string, o string")
    return TripleSource(df.select(*[T.skolemise(F.col(x)).alias(x) for x in "spo"]), **options)


def write_triples(df: DataFrame, path: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Write (s, p, o) partitioned by a hash of p, sorted by p and s: constant predicates prune partitions, constant subjects row groups.

    A predicate may hold a third of all triples, so a partition is written by many tasks: rows are dealt by bucket and a hash of s. Counts by
    predicate go into a folder of their own, which readers of the triples pass over.
    """
    keyed = df.select("s", "p", "o", F.pmod(F.hash("p"), F.lit(buckets)).alias("p_bucket"))
    dealt = keyed.repartition("p_bucket", F.pmod(F.hash("s"), F.lit(16)))
    dealt.sortWithinPartitions("p_bucket", "p", "s").write.mode(mode).partitionBy("p_bucket").parquet(path)
    _counts(df.sparkSession.read.parquet(path)).write.mode("overwrite").parquet(f"{path}/{COUNTS}")


def read_triples(spark: SparkSession, path: str, buckets: int = 64) -> TripleSource:
    return TripleSource(spark.read.parquet(path), bucketed=buckets, counted=spark.read.parquet(f"{path}/{COUNTS}"))
