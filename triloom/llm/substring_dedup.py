"""Substring dedup: runs of consecutive sentences that occur again, anywhere in the corpus, are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import golomb
from .common import join_groups, materialise, released, small

#: Sentences of a run at least, and bytes of its sentences together: short formulas that recur by chance are no passages.
MIN_SENTENCES, MIN_BYTES = 2, 160
#: A stretch without a sentence end is cut after every so many words, so that it is several sentences too.
STRETCH_WORDS = 12
#: Bytes of text that one block holds about.
BLOCK_BYTES = 8_000_000
_END = re.compile(rb"[.!?][\x20\x09-\x0D]+|\n+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[\x20\x09-\x0D]*")
_STRETCH = re.compile(rb"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}" % STRETCH_WORDS)
_MASK = (1 << 64) - 1
#: Odd multipliers of the two rolling hashes.
_ROLL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _cut(data: bytes) -> Iterator[tuple[bytes, list[bytes]]]:
    """(piece, its words) of a text: cut after each sentence end (. ! ? before white space, line breaks, the full-width ends) with the white
    space that follows it, and long stretches after every STRETCH_WORDS words."""
    at = 0
    for end in [*(m.end() for m in _END.finditer(data)), len(data)]:
        piece, at = data[at:end], end
        words = piece.split()
        if len(words) > STRETCH_WORDS:
            done = 0
            for m in _STRETCH.finditer(piece):
                yield piece[done : m.end()], words[:STRETCH_WORDS]
                words, done = words[STRETCH_WORDS:], m.end()
            piece = piece[done:]
        if piece:
            yield piece, words


def pieces(text: str | None) -> list[bytes]:
    return [piece for piece, _ in _cut((text or "").encode("utf-8", "surrogatepass"))]


def _sentences(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Two hashes and the bytes of every sentence: words in lower case (A-Z), joined by one space; pieces without words are none."""
    first, second, sizes = [], [], []
    for _, words in _cut((text or "").encode("utf-8", "surrogatepass").lower()):
        if words:
            own = b" ".join(words)
            h = xxhash.xxh3_128_intdigest(own)
            first.append(h & _MASK)
            second.append(h >> 64)
            sizes.append(len(own))
    return first, second, sizes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, counts: np.ndarray, min_sentences: int, min_bytes: int) -> tuple[np.ndarray, ...]:
    """(h1, h2, start, length): for every sentence the shortest sufficient run that starts with it and the shortest that ends with it.

    counts: sentences of each text, one text after another; runs lie within a text. Hashes are rolling ones over prefix sums, so a run of
    any length costs the same.
    """
    n = len(first)
    ends = np.cumsum(counts)
    last, start = np.repeat(ends, counts) - 1, np.repeat(ends - counts, counts)
    total, at = np.concatenate([[0], np.cumsum(sizes)]), np.arange(n)
    to = np.maximum(np.searchsorted(total, total[:-1] + min_bytes) - 1, at + min_sentences - 1)
    since = np.minimum(np.searchsorted(total, total[1:] - min_bytes, side="right") - 1, at - min_sentences + 1)
    lo, hi = np.concatenate([at[to <= last], since[since >= start]]), np.concatenate([to[to <= last], at[since >= start]])
    lo, hi = np.divmod(np.unique(lo * (n + 1) + hi), n + 1)
    out = []
    for values, r in zip((first, second), _ROLL, strict=True):
        powers = np.cumprod(np.full(n + 1, r, np.uint64))
        back = np.cumprod(np.full(n + 1, pow(r, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(values) * powers[:-1], dtype=np.uint64)])
        out.append(_mixed((sums[hi + 1] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64)))
    return *out, lo, hi - lo + 1


_BLOCK = "owner long, block string, keys binary, counts binary, ids array<long>, texts array<long>, h1 binary, h2 binary, row binary, pos binary, n binary"
_FIELDS = pa.schema(
    [("owner", pa.int64()), ("block", pa.string()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64()))]
    + [(x, pa.binary()) for x in ("h1", "h2", "row", "pos", "n")]
)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(ids, text keys, texts) of blocks of about BLOCK_BYTES."""
    ids, keys, texts, n = [], [], [], 0
    for batch in batches:
        for i, k, text in zip(*(batch.column(c).to_pylist() for c in ("id", "k", "text")), strict=True):
            ids.append(i)
            keys.append(k)
            texts.append(text)
            n += len(text or "") + 64
            if n >= BLOCK_BYTES:
                yield ids, keys, texts
                ids, keys, texts, n = [], [], [], 0
    if ids:
        yield ids, keys, texts


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``row`` (struct of the input columns), ``body`` (text left), ``n_sentences``, ``n_removed``.

    Sentences end at . ! or ? before ASCII white space, at the full-width ends and at line breaks; a stretch without an end is cut
    after every STRETCH_WORDS words. Runs of at least min_sentences consecutive sentences with at least min_bytes bytes together are
    compared over the whole corpus, A-Z lower-cased and white space collapsed, by 128-bit hashes. Of the occurrences of a run the
    first, by id (null first), then text hash, then position, stays; sentences that any other occurrence covers go, with the
    white space after them.

    What goes is what all runs of every length would remove: a longer run that occurs again consists of the shortest sufficient runs that start
    or end with one of its sentences, those occur again with it, and only they are hashed, two a sentence. min_bytes=1 compares
    every run of min_sentences. A passage stays where it holds no sufficient run of whole sentences.

    A null text is empty and stays so; texts without sentences stay as they are. Rows equal in id and text count once and get the
    same result. Input columns travel inside ``row``; ids are integers; an empty table gives an empty one.

    Blocks send 48-bit run keys, Golomb-coded, to owners and learn which occur again; only those runs are grouped by their
    full hash, with map-side combining, and meet their first occurrence by join_groups(), so a passage in a third of the
    documents stays spread. The removals meet the texts in one shuffle.
    """
    ship(docs.sparkSession)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("k"),
    )
    bits = golomb.owner_bits(docs.count() * 64)

    @released
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, bodies in _held(small(batches)):
            seen, found = set(), []
            for i, text in enumerate(bodies):
                found.append(tuple(np.array(x, kind) for x, kind in zip(_sentences(text) if (ids[i], texts[i]) not in seen else ([], [], []), (np.uint64, np.uint64, np.int64), strict=True)))
                seen.add((ids[i], texts[i]))
            counts = np.array([len(x[0]) for x in found], np.int64)
            doc, starts = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
            h1, h2, at, n = _runs(*(np.concatenate(x) for x in zip(*found, strict=True)), counts, min_sentences, min_bytes)
            block = xxhash.xxh3_128_hexdigest(np.array([i or 0 for i in ids] + texts, np.int64).tobytes() + h1.tobytes())
            keys, times = np.unique(h1 >> np.uint64(64 - golomb.KEY_BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None], pa.int64()), pa.array([block]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.int64())),
                    pa.array([h1.tobytes()]), pa.array([h2.tobytes()]), pa.array([doc[at].astype("<i4").tobytes()]), pa.array([(at - starts[doc[at]]).astype("<i4").tobytes()]), pa.array([n.astype("<i4").tobytes()]),
                ],
                schema=_FIELDS,
            )
            if len(keys):
                sent = golomb.messages(block, keys, times, bits)
                yield pa.RecordBatch.from_arrays([*sent.columns, *[pa.nulls(sent.num_rows, f.type) for f in list(_FIELDS)[4:]]], schema=_FIELDS)

    @released
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h1, h2 = np.frombuffer(row["h1"], np.uint64), np.frombuffer(row["h2"], np.uint64)
                again = golomb.joined_levels([(x["owner"], x["levels"]) for x in row["parts"]]) > 1
                at = np.flatnonzero(again[np.unique(h1 >> np.uint64(64 - golomb.KEY_BITS), return_inverse=True)[1]])
                doc = np.frombuffer(row["row"], "<i4")[at].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array([row["ids"][i] for i in doc], pa.int64()), pa.array([row["texts"][i] for i in doc], pa.int64()),
                        pa.array(np.frombuffer(row["pos"], "<i4")[at]), pa.array(np.frombuffer(row["n"], "<i4")[at]),
                    ],
                    ["h1", "h2", "id", "k", "pos", "n"],
                )

    made = materialise(keyed.select("id", "text", "k").mapInArrow(blocks, _BLOCK), "run-blocks")
    parts = golomb.replies(made.where("owner is not null").select("owner", "block", "keys", "counts"))
    parts = parts.groupBy("block").agg(F.collect_list(F.struct("owner", "levels")).alias("parts"))
    bodies = made.where("owner is null").select("block", "ids", "texts", "h1", "h2", "row", "pos", "n")
    again = bodies.hint("merge").join(parts, "block").mapInArrow(marked, "h1 long, h2 long, id long, k long, pos int, n int")
    again = materialise(again, "runs-again")
    place = F.struct("id", "k", "pos")
    groups = again.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    others = join_groups(again, materialise(groups, "run-groups"), ["h1", "h2"], "times", "inner").where(~place.eqNullSafe(F.col("first")))
    drops = others.groupBy("id", "k").agg(F.collect_set(F.struct("pos", "n")).alias("drops")).alias("d")

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, totals, removed = [], [], []
            for text, drop in zip(batch.column("row").field(text_col).to_pylist(), batch.column("drops").to_pylist(), strict=True):
                gone = {p for x in drop or () for p in range(x["pos"], x["pos"] + x["n"])}
                kept, number = [], 0
                for piece, words in _cut((text or "").encode("utf-8", "surrogatepass")):
                    if gone and not (words and number in gone):
                        kept.append(piece)
                    number += bool(words)
                bodies.append(b"".join(kept).decode("utf-8", "surrogatepass") if gone else text)
                totals.append(number)
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(bodies, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], ["row", "body", "n_sentences", "n_removed"])

    kind = keyed.schema["row"].dataType.simpleString()
    both = keyed.select("row", "id", "k").hint("merge").alias("t").join(drops, F.col("t.id").eqNullSafe(F.col("d.id")) & (F.col("t.k") == F.col("d.k")), "left")
    return both.select("t.row", "d.drops").mapInArrow(cut, f"row {kind}, body string, n_sentences long, n_removed long")
