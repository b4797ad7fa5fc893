"""Exact dedup by a Golomb-coded fingerprint exchange."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import golomb
from .common import Bucketed, join_groups, materialise, partitions, released, small

#: Rows whose fingerprints one block holds: 8 bytes each.
BLOCK_ROWS = 100_000

_ROWS = "block long, place int, id long, sha string, norm binary, fps binary"
_FIELDS = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("sha", pa.string()), ("norm", pa.binary()), ("fps", pa.binary())])


def _normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


@released
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in blocks, numbered within them; after a block's rows a row with its fingerprints by place."""
    first, number, held = TaskContext.get().partitionId() << 24, 0, []

    def end() -> pa.RecordBatch:
        row = [first + number], [None], [None], [None], [None], [np.array(held, np.uint64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _FIELDS, strict=True)], schema=_FIELDS)

    for batch in small(batches):
        texts = [_normalised(x) for x in batch.column("body").to_pylist()]
        places = range(len(held), len(held) + len(texts))
        held += [xxhash.xxh3_64_intdigest(x) >> (64 - golomb.KEY_BITS) for x in texts]
        own = [first + number] * len(texts), places, batch.column("id"), [hashlib.sha256(x).hexdigest() for x in texts], texts, [None] * len(texts)
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(own, _FIELDS, strict=True)], schema=_FIELDS)
        if len(held) >= BLOCK_ROWS:
            yield end()
            number, held = number + 1, []
    if held:
        yield end()


@released
def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit per place of each block that has suspects."""
    for batch in batches:
        for row in batch.to_pylist():
            again = golomb.joined_bits([(x["owner"], x["bits"]) for x in row["parts"]])
            if again.any():
                bits = np.packbits(again[np.unique(np.frombuffer(row["fps"], np.uint64), return_inverse=True)[1]]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([bits], pa.binary())], ["block", "bits"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``sha``.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Of equal texts the largest id
    stays (a null id is smaller than any other; rows that repeat id and text share their verdict). Input columns other than
    the two named ones are not read, so their names do not matter; an empty table gives an empty one. Ids are integers.

    Tasks write normalised texts in blocks, in a table that is bucketed by block, and per block its 48-bit fingerprints. Blocks send those,
    sorted and Golomb-coded, to the owners of fingerprint ranges and get bitmaps back of what occurs more than once in the
    corpus. The bitmaps move to the buckets and the texts stay where they are: only the texts so marked are shuffled, where
    grouping by the bytes verifies equality. That grouping combines within tasks, then within some of them, then over all, so a text
    that a third of all rows share gathers nowhere; the verdicts go back to the rows by join_groups().
    """
    spark = docs.sparkSession
    ship(spark)
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    table = Bucketed(pairs.mapInArrow(_fingerprints, _ROWS), "block", "texts")
    written = table.files
    rows, blocks = written.where("fps is null").select("id", "sha"), written.where("fps is not null").select("block", "fps")
    bits = golomb.owner_bits(rows.count())

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, fps in zip(batch.column("block").to_pylist(), batch.column("fps").to_pylist(), strict=True):
                keys, counts = np.unique(np.frombuffer(fps, np.uint64), return_counts=True)
                yield golomb.messages(block, keys, counts, bits)

    sent = blocks.mapInArrow(send, golomb.MESSAGE.replace("string", "long"))
    parts = golomb.bitmaps(sent).groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("parts"))
    marks = materialise(blocks.join(parts, "block").mapInArrow(_marks, "block long, bits binary"), "bitmaps")
    marked = F.expr("getbit(cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as long), 7 - place % 8) = 1")
    texts = table.frame.where("fps is null").select("block", "place", "id", "norm")
    suspects = texts.join(marks.hint("shuffle_hash"), "block").where(marked)
    part = F.pmod(F.xxhash64("block"), F.lit(int(np.ceil(np.sqrt(partitions(spark)))))).alias("part")
    groups = suspects.groupBy("norm", part).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.groupBy("norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).where("group_size > 1")
    groups = materialise(groups.select(F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"), "groups")
    return join_groups(rows, groups, ["sha"], "group_size").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "sha",
    )
