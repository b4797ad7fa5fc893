"""What the training-data operators share: scratch tables, joins that survive hot keys, text normalisation."""

from __future__ import annotations

import ctypes
import functools
import gc
import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.scratch import new_path

#: A key is hot when it holds more than one part in hot_parts() of all rows: at least one in so many, and a quarter of a partition's share.
HOT_KEYS = 4096
#: The most buckets that a table may have unless the session is set otherwise.
MOST_BUCKETS = 100_000
#: The six ASCII white-space characters [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def materialise(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back: later stages start from files that outlive any executor."""
    path = path or new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Bucketed:
    """A table whose rows lie in buckets by a column: joins of ``frame`` on it move the other side only. ``files`` are the same rows for other readers.

    Buckets need an entry in the catalog while the frame is made; then it is dropped, and the files stay as scratch.
    """

    def __init__(self, df: DataFrame, column: str, tag: str):
        spark, path, name = df.sparkSession, new_path(df.sparkSession, tag), f"triloom_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(min(partitions(spark), MOST_BUCKETS), column).option("path", path).saveAsTable(name)
        self.frame, self.files = spark.table(name), spark.read.schema(df.schema).parquet(path)
        spark.sql(f"DROP TABLE {name}")


def released(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives memory back at the end: Python workers live on, and the next stage runs beside them."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def small(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about that many bytes, of one row at least."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_parts(spark: SparkSession) -> int:
    """Hot keys number fewer than this, whatever the input: what is broadcast for them has a proven bound, and it follows the number of partitions."""
    return max(HOT_KEYS, 4 * partitions(spark))


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], weight: str, how: str = "left") -> DataFrame:
    """rows joined to groups, which has one row per key and in ``weight`` how many of the rows hold it.

    A key may hold a third of all rows. Hot keys (fewer than hot_parts() of them) are broadcast, so their rows stay where they are; the
    others are shuffled. rows is read more than once and should be a table, groups one or a plain aggregate of one. Rows with a null key find no partner.
    """
    is_hot = F.col(weight) * hot_parts(rows.sparkSession) > F.lit(rows.count())
    hot = F.broadcast(groups.where(is_hot))
    cold_rows = rows.join(F.broadcast(groups.where(is_hot).select(*key)), key, "left_anti")
    return rows.join(hot, key, "inner").unionByName(cold_rows.join(groups.where(~is_hot), key, how))


def spread_join(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """rows joined to table, whose rows are large or several a key, so that hot ones can't be broadcast.

    A key may hold a third of rows. Rows of a hot key are dealt into as many parts as it holds hot_parts() shares, and its rows of table are
    copied to each part. rows is read more than once and should be a table; names that begin with two underscores are taken.
    """
    parts, total = hot_parts(rows.sparkSession), rows.count()
    times = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__times")).where(F.col("__times") * parts > total)
    hot = F.broadcast(times.select(*key, F.ceil(F.col("__times") * parts / F.lit(max(1, total))).cast("int").alias("__parts")))
    dealt = rows.join(hot, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    copied = table.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [*key, "__part"]).drop("__part")


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else.

    lower() does just that unless it changes some non-ASCII character, which is looked for first; then translate() is used.
    """
    others = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return (
        F.when(~text.rlike(r"[^\x00-\x7F]"), F.lower(text))
        .when(F.lower(others) == others, F.lower(text))
        .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
