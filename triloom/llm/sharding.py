"""Sharding by a two-pass external shuffle: scatter by seeded hash into memory-sized buckets, Fisher-Yates within each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import materialise, new_path, released

#: Bytes of text that one bucket holds about: a bucket is shuffled in the memory of one task.
BUCKET_BYTES = 16 << 20
#: Buckets whose counts are summed together first: one task sums these groups, and only them.
SUMMED_BUCKETS = 4096


def _positions(start: int, n: int, rows: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of n positions from start on, when rows positions are cut into shards whose sizes differ by one at most."""
    base, more = divmod(rows, shards)
    at = np.arange(start, start + n)
    wide = more * (base + 1)
    shard = np.where(at < wide, at // (base + 1), more + (at - wide) // max(1, base))
    return shard, at - np.where(shard <= more, shard * (base + 1), wide + (shard - more) * base)


def shuffle_into_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 29, bucket_bytes: int = BUCKET_BYTES, path: str | None = None
) -> DataFrame:
    """Write all rows, in a seeded random order, as shards under path (a folder per shard) and return the table read back.

    Columns: ``row`` (struct of the input columns, whole), ``slot`` (gapless from 0 within a shard), ``shard``. Law ``rows``:
    shard sizes differ by one at most. The same rows, seed and bucket size give the same shards.

    First pass: rows scatter into buckets by a seeded hash of id and text, so no source and no group of copies under different
    ids gathers in one; rows equal in both share a bucket. Second pass: each bucket, sorted by that hash, is Fisher-Yates
    shuffled with its own seed and takes the positions after those of the buckets before it. Those are prefix sums over the table of
    counts; a bucket is a partition, and its first position reaches it as a row of the same shuffle. Null ids and texts hash like any value; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    spread = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    hashes = materialise(docs.select(spread.alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("b")), "hashes")
    rows, size = hashes.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    buckets = max(shards, -(-size // bucket_bytes))
    bucket = lambda h: F.pmod(h, F.lit(buckets))
    counts = materialise(hashes.groupBy(bucket(F.col("h")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "bucket-counts")
    counts = counts.withColumn("group", F.expr(f"bucket div {SUMMED_BUCKETS}"))
    before = F.sum("n").over(Window.orderBy("group")) - F.col("n")
    groups = counts.groupBy("group").agg(F.sum("n").alias("n")).select("group", before.alias("before"))
    within = F.sum("n").over(Window.partitionBy("group").orderBy("bucket")) - F.col("n")
    starts = counts.withColumn("within", within).join(groups, "group").select("bucket", (F.col("before") + F.col("within")).alias("start"))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), spread.alias("h"))
    kind = whole.schema["row"].dataType.simpleString()
    tagged = whole.select(bucket(F.col("h")).alias("bucket"), F.lit(1).alias("tag"), "h", "row")
    marks = starts.select("bucket", F.lit(0).alias("tag"), F.col("start").alias("h"), F.lit(None).cast(kind).alias("row"))

    def shuffled(parts: list[pa.RecordBatch], b: int, start: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        order = np.arange(table.num_rows)
        np.random.default_rng([seed, b]).shuffle(order)  # Fisher-Yates
        shard, slot = _positions(start, len(order), rows, shards)
        held = table.column("row").combine_chunks().take(pa.array(order))
        return pa.RecordBatch.from_arrays([held, pa.array(slot), pa.array(shard.astype(np.int32))], ["row", "slot", "shard"])

    @released
    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, b, start = [], None, 0
        for batch in batches:
            of = batch.column("bucket").to_numpy()
            tags, hs = batch.column("tag").to_numpy(), batch.column("h")
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if of[i] != b:
                    if held:
                        yield shuffled(held, b, start)
                    held, b = [], int(of[i])
                if tags[i] == 0:
                    start, i = hs[i].as_py(), i + 1
                if i < j:
                    held.append(batch.slice(i, j - i).select(["row"]))
        if held:
            yield shuffled(held, b, start)

    dealt = tagged.unionByName(marks).repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "tag", "h")
    out = dealt.mapInArrow(second_pass, f"row {kind}, slot long, shard int")
    path = path or new_path(spark, "shards")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
