"""Mixing sources to target weights: fixed-length blocks, multinomial counts per shard, pseudorandom index permutations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import materialise, partitions, released

#: Words in a block, blocks in an output shard, how often a word may be taken, weights of the sources in order.
BLOCK_WORDS = 64
SHARD_BLOCKS = 4096
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: list[int], total: int, cap: int = MAX_EPOCHS) -> list[float]:
    """Shares of total by weight; none above cap times its size, the excess going to the others by weight."""
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > cap * sizes[i]]
        for i in free:
            out[i] = weights[i] * unit
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        if not over:
            break
        free = [i for i in free if i not in set(over)]
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each x under a permutation of range(n) picked by key: a four-round Feistel network, walked until below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    n, key = n.astype(np.uint64), key.astype(np.uint64)

    def once(v: np.ndarray, half: np.ndarray, mask: np.ndarray, key: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for r in range(4):
            f = (right + key + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(29)) & mask)
        return (left << half) | right

    out = once(x.astype(np.uint64), half, mask, key)
    while (again := np.flatnonzero(out >= n)).size:
        out[again] = once(out[again], half[again], mask[again], key[again])
    return out.astype(np.int64)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw at any size, by inversion: the weights come from the ratios of neighbours, as far as 12 deviations from the mean and 64 more."""
    total = max(1, good + bad)
    mean = n * good / total
    reach = int(12 * (mean * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5) + 64
    low, high = max(0, n - bad, int(mean) - reach), min(good, n, int(mean) + reach)
    k = np.arange(low, high, dtype=np.int64)
    ratios = np.log((good - k).astype(np.float64)) + np.log((n - k).astype(np.float64)) - np.log(k + 1.0) - np.log((bad - n + 1 + k).astype(np.float64))
    weights = np.concatenate([[0.0], np.cumsum(ratios)])
    sums = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def _draw(rng: np.random.Generator, quotas: np.ndarray, n: int) -> np.ndarray:
    """How many of n slots each source gets: multinomial draws given that the quotas are used up in the end."""
    out, left, all_left = np.zeros(len(quotas), np.int64), int(n), int(quotas.sum())
    for i, quota in enumerate(quotas.tolist()):
        out[i] = _hypergeometric(rng, quota, all_left - quota, left)
        left, all_left = left - int(out[i]), all_left - quota
    return out


def shard_counts(quotas: np.ndarray, shard: int, shards: int, shard_blocks: int, seed: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, slots) of every source in one shard, found without the other shards: seeded draws halve the shards down to it.

    known: draws on the way to the shard before, kept for a task whose shards follow one another; no more than one path of them.
    """
    known, path = {} if known is None else known, {}
    lo, hi, start, held = 0, shards, np.zeros(len(quotas), np.int64), quotas.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        drawn = known.get((lo, hi))
        if drawn is None:
            drawn = _draw(np.random.default_rng([seed, lo, hi]), held, (mid - lo) * shard_blocks)
        path[lo, hi] = drawn
        if shard < mid:
            hi, held = mid, drawn
        else:
            lo, start, held = mid, start + drawn, held - drawn
    known.clear()
    known.update(path)
    return start, held


@dataclass
class Mix:
    """rows: a row per input row with its place in its source; sources: one dict per source; slots: the plan of the shards."""

    rows: DataFrame
    sources: list[dict]
    slots: DataFrame
    block_words: int

    def segments(self) -> DataFrame:
        """What each slot takes from each row: (src, part, rn, shard, slot, epoch, word_from, word_to), word numbers within the row."""
        length = self.block_words
        pieces = (
            self.rows.where("size > 0")
            .withColumn("block", F.explode(F.sequence(F.expr(f"start div {length}"), F.expr(f"(start + size - 1) div {length}"))))
            .select("src", "part", "rn", "start", "size", "block")
        )
        first = F.greatest(F.col("start"), F.col("block") * length)
        last = F.least(F.col("start") + F.col("size"), F.col("block") * length + F.col("take"))
        return (
            pieces.join(self.slots, ["src", "block"])
            .select("src", "part", "rn", "shard", "slot", "epoch", (first - F.col("start")).alias("word_from"), (last - F.col("start")).alias("word_to"))
            .where("word_to > word_from")
        )

    def taken(self) -> DataFrame:
        """rows with ``taken``: the words that the mix takes from each."""
        sums = self.segments().groupBy("src", "part", "rn").agg(F.sum(F.expr("word_to - word_from")).alias("taken"))
        return self.rows.join(sums, ["src", "part", "rn"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def _keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("k2")]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
) -> Mix:
    """Plan a mix of all documents in which each source comes near its target.

    A source's words (runs of anything but ASCII white space), its documents in an order fixed by hashed ids, are packed into
    blocks of block_words; a last, shorter block holds the rest. Targets share the total by weight up to max_epochs times a
    source's size (see targets()). A source's slots run through its blocks once per epoch, in an order that a pseudorandom
    permutation per source and epoch gives, the shorter block last; the last slot is cut at the target. How many slots each
    output shard has of each source is drawn multinomially, given those totals. No word is taken more than max_epochs times.

    Null texts have no words; a null source is a source of its own, after all others; sources without words have target 0; rows
    that repeat an id are separate rows; ids are integers or null. Other columns are not read. The same input and seed give the same mix.
    The driver holds one small record per source and nothing per document.

    A source may hold a third of all rows: places come from prefix sums over range partitions, and blocks meet slots by
    (source, block index), so no task holds a source.
    """
    spark = docs.sparkSession
    ship(spark)
    order = ["src", "o", "id", "size", "k1"]
    rows = docs.select(
        F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string"))).alias("src"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("o"),
        F.col(id_col).alias("id"),
        F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        *_keys(id_col, text_col),
    )
    rows = materialise(rows, "sizes").repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    rows = materialise(rows, "ranges")
    within = Window.partitionBy("src", "part").orderBy(*order[1:])
    upto = Window.partitionBy("src").orderBy("part")
    sums = rows.groupBy("src", "part").agg(F.sum("size").alias("part_size"))
    sums = sums.select("src", "part", (F.sum("part_size").over(upto) - F.col("part_size")).alias("before"))
    rows = (
        rows.withColumn("rn", F.row_number().over(within))
        .withColumn("run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(sums, ["src", "part"])
        .select("src", "part", "rn", "id", "k1", "k2", "size", (F.col("before") + F.col("run") - F.col("size")).alias("start"))
    )
    rows = materialise(rows, "places")

    found = sorted(((x["src"] == "n", x["src"].encode(), x["src"], int(x["s"])) for x in rows.groupBy("src").agg(F.sum("size").alias("s")).collect()))
    sizes = [x[3] for x in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes), max_epochs)
    sources = [{"src": x[2], "size": x[3], "target": t} for x, t in zip(found, goal, strict=True)]
    words = np.array([min(max_epochs * s, floor(t + 0.5)) for s, t in zip(sizes, goal, strict=True)], np.int64)
    size = np.array(sizes, np.int64)
    full, blocks = size // block_words, -(-size // block_words)
    epochs = words // np.maximum(1, size)
    rest = words - epochs * size
    quotas = epochs * blocks + -(-rest // block_words)
    shards = int(-(-quotas.sum() // shard_blocks))
    names = np.array([x["src"] for x in sources], object)

    @released
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            for shard in batch["id"].tolist():
                start, held = shard_counts(quotas, shard, shards, shard_blocks, seed, known)
                s = np.repeat(np.arange(len(held)), held)
                i = np.arange(len(s)) - np.repeat(np.cumsum(held) - held, held) + start[s]
                epoch, at = i // blocks[s], i % blocks[s]
                block, whole = at.copy(), at < full[s]
                block[whole] = permuted(at[whole], full[s][whole], (np.uint64(seed) << np.uint64(40)) + (s[whole] * max_epochs + epoch[whole]).astype(np.uint64))
                take = np.where(whole, block_words, size[s] - full[s] * block_words)
                cut = i == quotas[s] - 1
                ends = np.where(rest[s] > 0, rest[s] - at * block_words, take)
                take = np.where(cut, np.minimum(take, ends), take)
                slot = np.random.default_rng([seed, 1, shard]).permutation(len(s))
                yield pd.DataFrame({"src": names[s], "block": block, "take": take, "epoch": epoch, "shard": shard, "slot": slot})

    slots = spark.range(0, shards, 1, max(1, min(shards, partitions(spark)))).mapInPandas(draw, "src string, block long, take long, epoch long, shard long, slot long")
    return Mix(rows, sources, materialise(slots, "slots"), block_words)


def _cut(text: str | None, ranges: list[dict]) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(data)]
    merged: list[list[int]] = []
    for a, b in sorted((x["word_from"], x["word_to"]) for x in ranges):
        if merged and merged[-1][1] == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    if merged == [[0, len(spans)]]:
        return text or ""
    return b"\n".join(data[spans[a][0] : spans[b - 1][1]] for a, b in merged).decode("utf-8", "surrogatepass")


def mixed_documents(docs: DataFrame, plan: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as documents: a row per input row and epoch in which the mix takes any of its words: ``row`` and ``body``.

    ``body`` is the whole text where all its words are taken, else the taken stretches, joined by \\n. The texts are shuffled once.
    """
    ship(docs.sparkSession)
    same = Window.partitionBy("k1", "k2").orderBy("src", "part", "rn")
    ranked = plan.rows.select("src", "part", "rn", "k1", "k2", F.row_number().over(same).alias("r"))
    ranges = plan.segments().groupBy("src", "part", "rn", "epoch").agg(F.collect_list(F.struct("word_from", "word_to")).alias("ranges"))
    wanted = ranges.join(ranked, ["src", "part", "rn"]).select("k1", "k2", "r", "ranges")
    held, key = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(id_col, text_col)), ["k1", "k2"]
    if not ranked.where("r > 1").isEmpty():  # equal rows are told apart by their rank, which costs another shuffle of the texts
        held, key = held.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))), ["k1", "k2", "r"]
    both = held.hint("merge").join(wanted, key)

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            bodies = [_cut(t, r) for t, r in zip(rows.field(text_col).to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows, pa.array(bodies, pa.string())], ["row", "body"])

    chosen = both.select("row", "ranges")
    return chosen.mapInArrow(cut, f"row {chosen.schema['row'].dataType.simpleString()}, body string")
