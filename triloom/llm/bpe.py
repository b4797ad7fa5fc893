"""Byte-level BPE by corpus-level merge replay, and back."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Bucketed, partitions, released, small

#: Characters of text in a block, distinct words whose merges one index replays together.
BLOCK_CHARS = 12_000_000
REPLAY_WORDS = 200_000
#: Where a pattern allows it, texts are cut into chunks at every space before a non-space, and each distinct chunk is looked at once.
_CUT, _HARD = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")


class Merges:
    """Rank table: tokens are byte strings, ids their ranks."""

    def __init__(self, ranks_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.separator = max(self.tokens) + 1
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make together, -1 for none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def one(self, word: bytes) -> list[int]:
        """A single word, the lowest-ranked and then leftmost pair first."""
        if word in self.ranks:
            return [self.ranks[word]]
        symbol = [int(self.first[b]) for b in word]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def enter(at: int) -> None:
            if at >= 0 and after[at] < len(word):
                a, b = symbol[at], symbol[after[at]]
                if (rank := self.ranks.get(self.tokens[a] + self.tokens[b])) is not None:
                    heapq.heappush(heap, (rank, at, a, b))

        for i in range(len(word) - 1):
            enter(i)
        while heap:
            rank, at, a, b = heapq.heappop(heap)
            right = after[at]
            if symbol[at] != a or right >= len(word) or symbol[right] != b:
                continue  # one of the two is part of another merge by now
            symbol[at], symbol[right], after[at] = rank, -1, after[right]
            if after[at] < len(word):
                before[after[at]] = at
            enter(before[at])
            enter(at)
        return [x for x in symbol if x >= 0]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in order).

        All words lie in one linked array of symbols. An index holds for every rank the positions whose pair makes it; ranks are
        taken in ascending order, each merged at all its positions at once, after which only the pairs at the neighbours of the
        merged positions are entered anew. A word in which a merge makes a pair of lower rank than its own is encoded singly.
        """
        known = [self.ranks.get(w, -1) for w in words]
        todo = [i for i, r in enumerate(known) if r < 0 and words[i]]
        counts = np.array([r >= 0 for r in known], np.int64)
        found: dict[int, np.ndarray] = {}
        if todo:
            raw = np.frombuffer(b"\n" + b"\n".join(words[i] for i in todo) + b"\n", np.uint8)
            sizes = np.array([len(words[i]) for i in todo], np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes + 1)])
            symbol = self.first[raw]
            symbol[edges] = self.separator
            word_of = np.zeros(len(raw), np.int64)
            word_of[1:] = np.repeat(np.arange(len(todo)), sizes + 1)
            after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
            index: dict[int, list[np.ndarray]] = {}
            heap: list[int] = []
            odd: set[int] = set()

            def enter(left: np.ndarray, current: int) -> None:
                rank = self.rank_of(symbol[left], symbol[after[left]])
                left, rank = left[rank >= 0], rank[rank >= 0]
                if not len(left):
                    return
                if current >= 0 and (low := rank < current).any():
                    odd.update(word_of[left[low]].tolist())
                order = np.argsort(rank, kind="stable")
                rank, left = rank[order], left[order]
                cuts = np.flatnonzero(np.diff(rank)) + 1
                for r, where in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(left, cuts), strict=True):
                    if r in index:
                        index[r].append(where)
                    else:
                        index[r] = [where]
                        heapq.heappush(heap, r)

            enter(np.arange(len(raw) - 1), -1)
            while heap:
                r = heapq.heappop(heap)
                held = index.pop(r)
                at = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
                at = at[symbol[at] >= 0]
                at = at[self.rank_of(symbol[at], symbol[after[at]]) == r]
                if not len(at):
                    continue
                touching = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if touching.any():  # of overlapping positions every second, from the left
                    start = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - start) % 2 == 0]
                gone = after[at]
                symbol[at], symbol[gone] = r, -1
                after[at] = after[gone]
                before[after[at]] = at
                enter(np.unique(np.concatenate([before[at], at])), r)
            alive = (symbol >= 0) & (symbol != self.separator)
            ids, n = symbol[alive], np.bincount(word_of[alive], minlength=len(todo))
            if odd:
                cut = np.split(ids, np.cumsum(n)[:-1])
                for i in odd:
                    cut[i] = np.array(self.one(words[todo[i]]), np.int64)
                ids, n = np.concatenate(cut), np.array([len(x) for x in cut])
            counts[todo] = n
            found = {"ids": ids}
        total = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(total[-1], np.uint32)
        direct = np.array([r >= 0 for r in known], bool)
        out[total[:-1][direct]] = np.array([r for r in known if r >= 0], np.uint32)
        if todo:
            out[np.repeat(~direct, counts)] = found["ids"]
        return counts.astype(np.uint32), out


@lru_cache(4)
def merges(ranks_file: bytes) -> Merges:
    return Merges(ranks_file)


def ragged(ends: np.ndarray, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of the rows taken from a ragged array whose row i ends at ends[i + 1]."""
    n = ends[rows + 1] - ends[rows]
    if not len(rows):
        return n, data[:0]
    return n, data[np.arange(n.sum()) + np.repeat(ends[rows] - (np.cumsum(n) - n), n)]


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


#: Values from here on take two more bytes; the largest that three bytes hold.
_DIRECT, _LARGEST = 224, 224 + (32 << 16) - 1


def _packed(x: np.ndarray) -> bytes:
    """Compressed unsigned integers, most of them small: a byte each, two more for large ones, each kind of byte by itself."""
    if len(x) and int(x.max()) > _LARGEST:
        return b"\1" + zstandard.ZstdCompressor(level=3).compress(x.astype("<u4").tobytes())
    large = x >= _DIRECT
    rest = x[large].astype(np.int64) - _DIRECT
    first = x.astype(np.uint8)
    first[large] = _DIRECT + (rest >> 16)
    kinds = first, (rest >> 8 & 255).astype(np.uint8), (rest & 255).astype(np.uint8)
    return b"\0" + len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(b"".join(k.tobytes() for k in kinds))


def _unpacked(x: bytes) -> np.ndarray:
    if x[0]:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), "<u4").astype(np.int64)
    n = int.from_bytes(x[1:9], "little")
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[9:]), np.uint8).astype(np.int64)
    out, more = data[:n], data[n:].reshape(2, -1)
    large = out >= _DIRECT
    out[large] = _DIRECT + ((out[large] - _DIRECT) << 16) + (more[0] << 8) + more[1]
    return out


_BLOCKS = "block long, owner int, ids array<long>, docs binary, chunks binary, chunk_words binary, chunk_sizes binary, word_owners binary, words binary, word_sizes binary"
_FIELDS = pa.schema(
    [("block", pa.int64()), ("owner", pa.int32()), ("ids", pa.list_(pa.int64()))] + [(x, pa.binary()) for x in ("docs", "chunks", "chunk_words", "chunk_sizes", "word_owners", "words", "word_sizes")]
)


class _Block:
    """Documents as numbers of chunks; texts are not kept."""

    def __init__(self, at_spaces: bool):
        self.at_spaces = at_spaces
        self.number: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.sequence: list[np.ndarray] = []
        self.name, self.chars = xxhash.xxh3_64(), 0

    def add(self, i: int | None, text: str) -> None:
        self.ids.append(i)
        self.name.update(f"{i} {len(text)} ".encode() + text.encode("utf-8", "surrogatepass"))
        self.chars += len(text)
        if not text:
            self.sizes.append(0)
            return
        pieces = [text] if not self.at_spaces else _CUT.split(text) if _HARD.search(text) else text.split(" ")
        pieces[0] = "\n" + pieces[0]  # marks a chunk that starts a text: no space comes before it
        number = self.number
        for p in pieces:
            if p not in number:
                number[p] = len(number)
        self.sizes.append(len(pieces))
        self.sequence.append(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)))


def _messages(held: _Block, pattern: str, owners: int) -> pa.RecordBatch:
    """Chunks as numbers of words (0: the next new word, else its number + 1), owners of words: row 0; then a message per owner."""
    sizes, block = held.sizes, held.name.intdigest() >> 1
    chunks = np.concatenate(held.sequence or [np.zeros(0, np.int32)])
    often = np.argsort(-np.bincount(chunks, minlength=len(held.number)), kind="stable")  # frequent chunks get small numbers
    rank = np.empty(len(often), np.int32)
    rank[often] = np.arange(len(often))
    names = list(held.number)
    held.number, held.sequence = {}, []
    find = regex.compile(pattern).findall
    word_number: dict[str, int] = {}
    refs, chunk_sizes = [], []
    for i in often.tolist():
        chunk = names[i]
        got = find(chunk[1:] if chunk[:1] == "\n" else " " + chunk)
        chunk_sizes.append(len(got))
        for w in got:
            refs.append(word_number.setdefault(w, len(word_number)))
    refs = np.array(refs, np.int64)
    is_new = refs > np.concatenate([[-1], np.maximum.accumulate(refs)[:-1]]) if len(refs) else refs
    words = [w.encode("utf-8", "surrogatepass") for w in word_number]
    owner = np.array([xxhash.xxh32_intdigest(w) % owners for w in words], np.int64)
    order = np.argsort(owner, kind="stable")
    own = (np.array(sizes, np.int64), rank[chunks], np.where(is_new, 0, refs + 1), np.array(chunk_sizes, np.int64), owner)
    out = [(block, -1, held.ids, *map(_packed, own), None, None)]
    sorted_owner = owner[order]
    starts = np.flatnonzero(np.diff(sorted_owner, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        own = [words[i] for i in order[a:b].tolist()]
        out.append((block, int(sorted_owner[a]), *[None] * 6, zstandard.ZstdCompressor(level=9).compress(b"".join(own)), _packed(np.array([len(w) for w in own], np.int64))))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_FIELDS)], schema=_FIELDS)


def encode(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", at_spaces: bool = False) -> DataFrame:
    """A row per input row: ``id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers), ``decoded`` (bytes of those ids).

    Each match of pattern in a text is a word, encoded by the ranks as byte-pair merges; a word that is a token is that token.
    Special tokens do not exist. Null and empty texts have no tokens; rows may repeat; ids are integers or null; other columns are
    not read; an empty table gives an empty one. at_spaces says that under this pattern a space before a non-space always starts a word,
    whatever surrounds it, so that texts may be cut there first, which saves much; without it any pattern is right.

    Tasks turn their documents into numbers of words and send each distinct word once, to its hash's owner. An owner replays
    the merges over the distinct words of the corpus that it holds (Merges.replay) and answers with ids, so no word of the
    corpus is merged twice, and what moves are distinct words and their ids; blocks stay in their buckets. Owners are the shuffle partitions; blocks and replay
    groups have fixed sizes; a very frequent word is one entry per block. A text longer than a block is a block of its own.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(ranks_file)
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    owners = partitions(spark)

    @released
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Block(at_spaces)
        for batch in small(batches):
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.add(i, text)
                if held.chars >= BLOCK_CHARS:
                    yield _messages(held, pattern, owners)
                    held = _Block(at_spaces)
        if held.ids:
            yield _messages(held, pattern, owners)

    made = Bucketed(pairs.mapInArrow(blocks, _BLOCKS), "block", "bpe-blocks")

    @released
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = merges(ranks.value), [], 0
        known: dict[bytes, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            cut = []
            for block, owner, words, word_sizes in held:
                ends, words = _ends(_unpacked(word_sizes)).tolist(), zstandard.ZstdDecompressor().decompress(words)
                cut.append((block, owner, [words[a:b] for a, b in zip(ends, ends[1:], strict=False)]))
            new = list(dict.fromkeys(w for _, _, ws in cut for w in ws if w not in known))
            if len(known) + len(new) > 4 * REPLAY_WORDS:
                known.clear()
                new = list(dict.fromkeys(w for _, _, ws in cut for w in ws))
            counts, ids = table.replay(new)
            known.update(zip(new, np.split(ids, np.cumsum(counts)[:-1]), strict=True) if new else ())
            for block, owner, ws in cut:
                got = [known[w] for w in ws]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([owner], pa.int32()), pa.array([_packed(np.array([len(x) for x in got], np.uint32))]), pa.array([_packed(np.concatenate(got))])],
                    ["block", "owner", "sizes", "ids"],
                )

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("block", "owner", "words", "word_sizes")], strict=True):
                held.append(row)
                n += 2 * len(row[2])  # compressed
                if n >= 8 * REPLAY_WORDS:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    asked = made.files.where("owner >= 0").select("block", "owner", "words", "word_sizes").repartitionById(owners, "owner")
    answers = asked.sortWithinPartitions("owner").mapInArrow(answer, "block long, owner int, sizes binary, ids binary")
    parts = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "sizes", F.col("ids").alias("word_ids"))).alias("parts"))

    @released
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = merges(ranks.value).tokens
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = [x for _, x in sorted({x["owner"]: x for x in row["parts"] or ()}.items())]  # equal blocks have equal answers
                empty = [np.zeros(0, np.int64)]
                word_ends = _ends(np.concatenate([_unpacked(x["sizes"]) for x in own] or empty))
                word_ids = np.concatenate([_unpacked(x["word_ids"]) for x in own] or empty)
                chunk_sizes = _unpacked(row["chunk_sizes"])
                refs, word_owners = _unpacked(row["chunk_words"]), _unpacked(row["word_owners"])
                refs = np.where(refs == 0, np.cumsum(refs == 0) - 1, refs - 1)
                place = np.empty(len(word_owners), np.int64)
                place[np.argsort(word_owners, kind="stable")] = np.arange(len(word_owners))
                per_word, chunk_ids = ragged(word_ends, word_ids, place[refs])
                chunk_ends = _ends(per_word)[_ends(chunk_sizes)]
                chunks, doc_ends = _unpacked(row["chunks"]), _ends(_unpacked(row["docs"])).tolist()
                done = 0
                while done < len(row["ids"]):  # about 300,000 chunks at a time
                    upto = done + 1
                    while upto < len(row["ids"]) and doc_ends[upto + 1] - doc_ends[done] <= 300_000:
                        upto += 1
                    per_chunk, ids = ragged(chunk_ends, chunk_ids, chunks[doc_ends[done] : doc_ends[upto]])
                    at = _ends(per_chunk)[np.array(doc_ends[done : upto + 1]) - doc_ends[done]].tolist()
                    cut = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["ids"][done:upto], pa.int64()),
                            pa.array([len(x) for x in cut], pa.int64()),
                            pa.array([x.astype("<u4").tobytes() for x in cut], pa.binary()),
                            pa.array([b"".join(map(names.__getitem__, x.tolist())) for x in cut], pa.binary()),
                        ],
                        ["id", "n_tokens", "ids", "decoded"],
                    )
                    done = upto

    bodies = made.frame.where("owner < 0").select("block", "ids", "docs", "chunks", "chunk_words", "chunk_sizes", "word_owners")
    return bodies.join(parts.hint("merge"), "block", "left").mapInArrow(tokens, "id long, n_tokens long, ids binary, decoded binary")


def decode(ids: bytes, ranks_file: bytes) -> bytes:
    names = merges(ranks_file).tokens
    return b"".join(names[i] for i in np.frombuffer(ids, "<u4").tolist())


def ranks_from(path: str) -> bytes:
    return Path(path).read_bytes()
