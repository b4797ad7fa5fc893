"""N-gram Jaccard join: prefixes over token combinations find candidates, exact overlaps decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import golomb
from .common import Bucketed, join_groups, materialise, partitions, released, spread_join
from .components import components

N_GRAM = 5
#: Similarity as a fraction of 100.
THRESHOLD = 75
#: Bytes of text and rows that a block holds at most, about; texts in a group that is verified together.
BLOCK_BYTES, BLOCK_ROWS, VERIFY_TEXTS = 8_000_000, 20_000, 2_000
#: Tokens in up to 2**5 - 1 documents are indexed singly, in up to 2**9 - 1 as pairs, beyond as triples; sets below 16 tokens only singly.
PAIR_LEVEL, TRIPLE_LEVEL, SMALL = 6, 10, 16
#: Nodes and tokens of a tile, and of a group of visitors to it.
TILE_NODES, TILE_TOKENS = 100, 500_000
#: A row per document; after a block's rows one with the places, sets and signatures of its distinct sets that are indexed.
_ROWS = "block string, id long, node binary, n long, k long, places array<int>, firsts array<binary>, ns array<long>, counts array<int>, sigs binary"
_FIELDS = pa.schema(
    [("block", pa.string()), ("id", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("k", pa.int64()), ("places", pa.list_(pa.int32())), ("firsts", pa.list_(pa.binary()))]
    + [("ns", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("sigs", pa.binary())]
)
_GOLD, _ODD, _MASK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: _Words, n: int = N_GRAM) -> np.ndarray:
    """Hashes of the distinct n-word shingles of a lower-cased text, ascending; fewer words are one shingle."""
    own = text.split()  # bytes.split() cuts at [\x20\x09-\x0D]
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        out = _mixed(out * np.uint64(_GOLD) + h[i : len(h) - m + 1 + i])
    return np.unique(out)


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def signatures(tokens: np.ndarray, levels: np.ndarray, threshold: int = THRESHOLD) -> set[int]:
    """What a set is indexed under: two sets that reach the threshold share a signature.

    Tokens go from rare to frequent (level, then hash: one order for all sets). At most ``slack`` of a set's tokens are missing
    from a partner. A rare token of the prefix spends one of them if it is not shared. Frequent tokens fall into classes by the
    number k that a combination of them takes and by hash; a class with m tokens in the prefix holds k shared ones unless m - k + 1
    are missing. The prefix is extended until more than slack would have to be missing everywhere; then some class shares a
    combination, and it lies in both prefixes, as shared tokens come first in the shorter one. Tokens of one document only
    lengthen the prefix: nothing can meet them. The number of classes goes with the set's size (a power of two), so that a
    class has few tokens; sets that may pair with the next larger power are indexed for both.
    """
    n = len(tokens)
    slack = n - -(-threshold * n // 100)
    if int((levels == 1).sum()) > slack:
        return set()
    order = np.lexsort((tokens, levels))
    ordered = list(zip(tokens[order].tolist(), levels[order].tolist(), strict=True))
    own = 1 << (n.bit_length() - 1)
    out: set[int] = set()
    for band in (own, 2 * own) if 100 * n >= threshold * 2 * own else (own,):
        classes, kinds = {}, max(1, band // 8)
        need = slack + 1
        for token, level in ordered:
            if level == 1:
                need -= 1
            elif level < PAIR_LEVEL or band < SMALL:
                out.add(token)
                need -= 1
            else:
                k = 2 if level < TRIPLE_LEVEL else 3
                held = classes.setdefault((k, (token * _GOLD >> 40 & 0xFFFFFF) % kinds), [])
                seed = (token * _GOLD + band * 4 + k) & _MASK
                for others in combinations(held, k - 1):
                    h = seed
                    for x in others:
                        h = (h ^ (h >> 31) ^ x) * _ODD & _MASK
                    out.add(h)
                held.append(token)
                need -= len(held) >= k
            if need <= 0:
                break
    return out


def _digest(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[int | None], list[bytes]]]:
    """(name, ids, lower-cased texts) of the blocks of a task. The same rows give the same blocks: a block is cut by size and named after its rows."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(_lower(text))
            n += len(texts[-1])
            if n >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                yield xxhash.xxh3_128_hexdigest(repr(ids).encode() + b"".join(texts)), ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield xxhash.xxh3_128_hexdigest(repr(ids).encode() + b"".join(texts)), ids, texts


def _sharing(held: Bucketed, every: Bucketed, opened: Callable[[pa.RecordBatch], Iterator[tuple[dict, list[bytes]]]]) -> DataFrame:
    """The sets (``node``, ``n``, ``weight``, ``text``, ``sigs``) that share a signature with another, weight their signatures' number, sigs the shared ones.

    Each set speaks from one block of those that hold it. Blocks send their sets' signatures, sorted and Golomb-coded, to the owners of ranges and get
    bitmaps back of what occurs more than once; only those move, to the buckets that hold texts and signatures. Some signatures may be marked that one
    set alone holds (keys that collide), none is missed.
    """
    lists = every.files.where("sigs is not null")
    homes = lists.select("block", F.explode("firsts").alias("node")).groupBy("node").agg(F.min("block").alias("block"))
    homes = Bucketed(homes.groupBy("block").agg(F.collect_list("node").alias("nodes")), "block", "set-blocks").frame
    total = (lists.agg(F.sum(F.octet_length("sigs"))).first()[0] or 0) // 8
    bits, owners = golomb.key_bits(total), golomb.owner_bits(total)
    shift = np.uint64(64 - bits)
    own = ("places", "firsts", "ns", "counts", "sigs")
    single = every.frame.where("sigs is not null").groupBy("block").agg(F.first(F.struct(*own)).alias("own"))  # equal blocks have equal names
    single = single.select("block", *[f"own.{x}" for x in own]).join(homes.hint("merge"), "block")

    def speaking(row: dict) -> list[tuple[int, np.ndarray]]:
        """The block's sets that speak from it, by their number among those of the block, with their signatures."""
        nodes, sigs = set(row["nodes"]), np.split(np.frombuffer(row["sigs"], np.uint64), np.cumsum(row["counts"])[:-1])
        return [(i, x) for i, (node, x) in enumerate(zip(row["firsts"], sigs, strict=True)) if node in nodes]

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, counts = np.unique(np.concatenate([x for _, x in speaking(row)]) >> shift, return_counts=True)
                yield golomb.messages(row["block"], keys, counts, owners, bits)

    sent = single.select("block", "firsts", "counts", "sigs", "nodes").mapInArrow(send, golomb.MESSAGE)
    marks = golomb.bitmaps(sent).groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("parts"))
    marks = materialise(marks, "bitmaps")

    @released
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in opened(batch):
                sets = speaking(row)
                again = golomb.joined_bits([(x["owner"], x["bits"]) for x in row["parts"]])
                again = again[np.unique(np.concatenate([x for _, x in sets]) >> shift, return_inverse=True)[1].ravel()]
                out = []
                for (i, sigs), marked in zip(sets, np.split(again, np.cumsum([len(x) for _, x in sets])[:-1]), strict=True):
                    if marked.any():
                        out.append((row["firsts"][i], row["ns"][i], len(sigs), texts[row["places"][i]], sigs[marked].view(np.int64)))
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], ["node", "n", "weight", "text", "sigs"])

    known = single.join(marks.hint("merge"), "block")
    found = held.frame.select("block", "lengths", "texts").join(known.hint("merge"), "block").mapInArrow(select, "node binary, n long, weight int, text binary, sigs array<long>")
    return found.dropDuplicates(["node"])


def _verify(pairs: DataFrame, texts: Bucketed, groups: int, n_gram: int, threshold: int) -> DataFrame:
    """Of pairs (``a``, ``b``), which may repeat, those whose sets reach the threshold.

    Texts of a are dealt into groups; a text b goes once to each group that holds a partner of it, with the list of them, so the
    text of a node with very many partners is sent at most once per group, from several tasks (spread_join()). A task keeps the sets of one group.
    """
    group_of = lambda node: F.pmod(F.xxhash64(node), F.lit(groups)).alias("group")
    asked = pairs.groupBy(group_of("a"), "b").agg(F.collect_set("a").alias("partners"))
    asked = materialise(asked, "partners")  # at most a group's nodes in a list
    wanted = asked.select(F.explode("partners").alias("node")).distinct()
    left = texts.frame.select("node", "text").join(wanted.hint("merge"), "node", "left_semi").select(group_of("node"), F.lit(0).alias("tag"), "node", "text", F.lit(None).cast("array<binary>").alias("partners"))
    pivots = texts.frame.select("node", "text").join(asked.select(F.col("b").alias("node")).distinct().hint("merge"), "node", "left_semi")
    right = spread_join(asked, pivots.withColumnRenamed("node", "b"), ["b"]).select("group", F.lit(1).alias("tag"), F.col("b").alias("node"), "text", "partners")

    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, at = _Words(), {}, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["group"] != at:
                    held, at = {}, row["group"]
                own = shingles(row["text"], words, n_gram)
                if row["tag"] == 0:
                    held[row["node"]] = own
                    continue
                for partner in row["partners"]:
                    other = held[partner]
                    small, large = (own, other) if len(own) < len(other) else (other, own)
                    where = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    common = int((large[where] == small).sum())
                    if 100 * common >= threshold * (len(own) + len(other) - common):
                        found.append((partner, row["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    return left.unionByName(right).repartition(groups, "group").sortWithinPartitions("group", "tag").mapInArrow(compare, "a binary, b binary")


def _meetings(ties: DataFrame, threshold: int) -> DataFrame:
    """Which nodes of open buckets are compared where: (``tile``, ``slot``, ``role``, ``node``, ``comp``), role 0 at home in a tile, 1 visiting it.

    ties: (``sig``, ``size``, ``node``, ``n``, ``comp``, ``rank``, ``hi``): the members of each open bucket, ``size`` of them, with their components, ordered
    by ``rank``, and the last component of the bucket in that order. Every node is at home in one tile, of bounded nodes and tokens, cut
    from the nodes whose largest bucket is the same. Of two members of a bucket that are in different components, the one in
    the earlier component visits the other's tile, whatever else they share; the last component's members, such as a large group
    that is joined already, go nowhere. Visitors to a tile are dealt into groups (slots) of bounded nodes and tokens, and the tile's own nodes go to each.
    """
    order = F.struct("rank", "comp")
    homes = ties.groupBy("node").agg(F.max(F.struct("size", "sig")).alias("largest"), F.first("comp").alias("comp"), F.first("rank").alias("rank"), F.first("n").alias("n"))
    homes = materialise(homes.select("node", "comp", "rank", "n", F.col("largest.sig").alias("anchor")), "anchors")
    chunks = lambda n: F.greatest(F.ceil(n / TILE_NODES), F.ceil(F.sum("n") / TILE_TOKENS)).cast("int")
    sizes = homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("nodes"), chunks(F.count(F.lit(1))).alias("chunks"))
    homes = join_groups(homes, sizes, ["anchor"], "nodes", "inner")
    tile = F.xxhash64("anchor", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("tile")
    homes = materialise(homes.select("anchor", "node", "comp", "rank", "n", tile), "homes")
    tiles = homes.groupBy("anchor", "tile").agg(F.max(order).alias("top"), F.min("n").alias("lo"), F.max("n").alias("most"))

    placed = ties.join(homes.select("node", "anchor"), "node").select("sig", "size", "node", "n", "rank", "comp", "hi", "anchor")
    placed = materialise(placed, "placed")
    held = placed.groupBy("sig", "anchor").agg(F.max(order).alias("top"))
    same = [F.bit_xor(F.xxhash64(F.lit(i), "anchor", "top")).alias(f"s{i}") for i in (0, 1)]
    kinds = materialise(held.groupBy("sig").agg(*same), "kinds")
    held = held.join(kinds, "sig").select("s0", "s1", "anchor", "top").distinct()
    going = placed.where(order < F.col("hi")).select("sig", "node", "n", "rank", "comp")
    sizes = placed.select("sig", "size").distinct().join(kinds, "sig")
    going = materialise(join_groups(going, sizes, ["sig"], "size", "inner").select("s0", "s1", "node", "n", "rank", "comp").distinct(), "going")
    going = spread_join(going, held, ["s0", "s1"]).where(order < F.col("top")).select("anchor", "node", "n", "rank", "comp").distinct()
    fits = (order < F.col("top")) & F.expr(f"100 * n >= {threshold} * lo and 100 * most >= {threshold} * n")
    visits = spread_join(materialise(going, "going-to"), tiles, ["anchor"]).where(fits).select("tile", "node", "comp", "n")
    visits = materialise(visits, "visits")
    asked = visits.groupBy("tile").agg(F.count(F.lit(1)).alias("visitors"), chunks(F.count(F.lit(1))).alias("slots"))
    guests = join_groups(visits, asked, ["tile"], "visitors", "inner").select("tile", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int").alias("slot"), F.lit(1).alias("role"), "node", "comp")
    slot = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")
    return guests.unionByName(homes.join(asked, "tile").select("tile", slot, F.lit(0).alias("role"), "node", "comp"))


def _verify_open(ties: DataFrame, texts: Bucketed, n_gram: int, threshold: int) -> DataFrame:
    """Links (``a``, ``b``) that join different components of open buckets, as many as it takes: see _meetings(). No pairs travel."""
    meet = materialise(_meetings(ties, threshold), "meetings")
    total = meet.count()
    own = texts.frame.select("node", "text").join(meet.select("node").distinct().hint("merge"), "node", "left_semi")
    meet = spread_join(meet, own, ["node"])

    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, at = _Words(), [], None

        def links() -> pa.RecordBatch:
            rows = [(role, node, comp, shingles(text, words, n_gram)) for role, node, comp, text in held]
            found = _linked([x[1:] for x in rows if not x[0]], [x[1:] for x in rows if x[0]], threshold)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                key = row["tile"], row["slot"]
                if key != at:
                    if held:
                        yield links()
                    held, at = [], key
                held.append((row["role"], row["node"], row["comp"], row["text"]))
        if held:
            yield links()

    count = max(partitions(ties.sparkSession), total // VERIFY_TEXTS)
    return meet.repartition(count, "tile", "slot").sortWithinPartitions("tile", "slot").mapInArrow(compare, "a binary, b binary")


def _linked(home: list[tuple[bytes, bytes, np.ndarray]], visitors: list[tuple[bytes, bytes, np.ndarray]], threshold: int) -> list[tuple[bytes, bytes]]:
    """Links between visitors and nodes at home (node, component, tokens) that join components. Overlaps are counted through postings of tokens."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    if not home or not visitors:
        return []
    sizes = np.array([len(x[2]) for x in home])
    owner = np.repeat(np.arange(len(home)), sizes)
    tokens, number, df = np.unique(np.concatenate([x[2] for x in home]), return_inverse=True, return_counts=True)
    postings, ends = owner[np.argsort(number.ravel(), kind="stable")], np.concatenate([[0], np.cumsum(df)])
    found = []
    for node, comp, own in visitors:
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        at = at[tokens[at] == own]
        if not len(at):
            continue
        common = np.bincount(np.concatenate([postings[ends[t] : ends[t + 1]] for t in at.tolist()]), minlength=len(home))
        for k in np.flatnonzero(100 * common >= threshold * (len(own) + sizes - common)).tolist():
            x, y = find(comp), find(home[k][1])
            if x != y:
                root[x] = y
                found.append((node, home[k][0]))
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_gram: int = N_GRAM, threshold: int = THRESHOLD, keyed: bool = False) -> DataFrame:
    """A row per input row: ``id``, ``n_shingles``, ``component_id``; if keyed also ``text_key``, xxhash64() of the lower-cased text, and
    ``component``, which names the component whatever its ids (null without words).

    A document's set: the distinct n_gram-word shingles of its text, A-Z lower-cased, words cut at ASCII white space; a shorter
    text is one shingle; one without words (null, empty) has none and is linked with nothing. Documents link when 100 times
    the intersection is at least threshold times the union. component_id is the smallest id reachable by links, its own included.
    Sets are compared by 64-bit hashes of their shingles, and equal sets by 128-bit digests of those.

    Rows with equal sets are one node, whatever their ids (null ids or repeated ones too: a row without any non-null id in its
    component gets null). Other columns are not read; an empty table gives an empty one. Ids are integers.

    Token frequencies, over all documents, come from the Golomb-coded exchange between blocks of texts, which are written once. Sets are
    indexed under signatures(); a second exchange tells which of these occur more than once, and only sets that hold such ones leave their
    blocks (_sharing()). First each bucket of equal signatures compares its members with one pivot, the set with most
    signatures, which in a group of near copies is the least altered one; verified links make components. Buckets whose
    members are all in one component are done. In the others, every two members of different components are compared, each
    node with the tiles that hold such partners of it (_meetings()), so no link that joins two components is lost. Copies near to
    a pivot, however many, cost one comparison each, and what is left meets them tile by tile. Hot signatures, pivots, nodes, components
    and tiles are met by join_groups() and spread_join().
    """
    ship(docs.sparkSession)
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    @released
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([data])], ["block", "ids", "lengths", "texts"])

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[bytes]]]:
        """(row, texts) of each block of a batch."""
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            data, ends = zstandard.ZstdDecompressor().decompress(row["texts"]), np.cumsum(row["lengths"]).tolist()
            yield row, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    held = Bucketed(pairs.mapInArrow(packed, "block string, ids array<long>, lengths array<long>, texts binary"), "block", "text-blocks")
    blocks = held.files
    total = blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
    bits, owners = golomb.key_bits(total * 512), golomb.owner_bits(total * 512)
    shift = np.uint64(64 - bits)

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for row, texts in opened(batch):
                sets = {own.tobytes(): own for own in (shingles(text, words, n_gram) for text in texts) if len(own)}
                if sets:
                    keys, counts = np.unique(np.concatenate(list(sets.values())) >> shift, return_counts=True)
                    yield golomb.messages(row["block"], keys, counts, owners, bits)

    parts = golomb.replies(blocks.select("block", "lengths", "texts").mapInArrow(send, golomb.MESSAGE)).groupBy("block").agg(F.collect_list(F.struct("owner", "levels")).alias("parts"))
    parts = Bucketed(parts, "block", "levels").frame

    @released
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for row, texts in opened(batch):
                tokens = [shingles(text, words, n_gram) for text in texts]
                nodes = [_digest(own) for own in tokens]
                keys, number = np.unique(np.concatenate(tokens) >> shift, return_inverse=True)
                levels = golomb.joined_levels([(x["owner"], x["levels"]) for x in row["parts"] or ()])
                ends = np.cumsum([len(own) for own in tokens])
                out, seen, own_sigs = [], set(), []
                number = np.split(levels[number.ravel()], ends[:-1])
                for place, (i, node, text, own, level) in enumerate(zip(row["ids"], nodes, texts, tokens, number, strict=True)):
                    if node and node not in seen:
                        seen.add(node)
                        if found := signatures(own, level, threshold):
                            own_sigs.append((place, node, len(own), np.array(sorted(found), np.uint64)))
                    key = xxhash.xxh64_intdigest(text, seed=42) if keyed else None
                    out.append((row["block"], i, node, len(own), None if key is None else key - (key >> 63 << 64), None, None, None, None, None))
                if own_sigs:
                    places, firsts, ns, sigs = zip(*own_sigs, strict=True)
                    out.append((row["block"], None, None, None, None, places, firsts, ns, [len(x) for x in sigs], np.concatenate(sigs).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], f.type) for j, f in enumerate(_FIELDS)], schema=_FIELDS)

    every = Bucketed(held.frame.join(parts.hint("merge"), "block", "left").mapInArrow(index, _ROWS), "block", "signatures")
    rows = every.files.where("sigs is null").select("id", "n", "node", *(["k"] if keyed else []))
    texts = Bucketed(_sharing(held, every, opened), "node", "texts")
    groups = max(partitions(docs.sparkSession), texts.files.count() // VERIFY_TEXTS)
    members = texts.files.select("node", "weight", F.col("n").cast("int").alias("n"), F.explode("sigs").alias("sig"))
    same = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"s{i}") for i in (0, 1)]
    heads = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), *same).where("size > 1")
    heads = heads.groupBy("size", "s0", "s1").agg(F.min("sig").alias("sig")).select("sig", "size")  # buckets with the same members are one
    members = materialise(join_groups(members, materialise(heads, "shared"), ["sig"], "size", "inner"), "members")
    pivots = members.groupBy("sig").agg(F.max(F.struct("weight", "node", "n")).alias("pivot"), F.first("size").alias("size"))
    members = materialise(join_groups(members.drop("size"), pivots, ["sig"], "size", "inner"), "buckets")
    near = members.where(f"node <> pivot.node and 100 * n >= {threshold} * pivot.n and 100 * pivot.n >= {threshold} * n")
    chosen = near.select(F.col("node").alias("a"), F.col("pivot.node").alias("b"))
    edges = materialise(_verify(chosen, texts, groups, n_gram, threshold), "links")
    names = components(edges)

    ranks = names.groupBy("comp").agg(F.count(F.lit(1)).alias("rank"))
    ranked = join_groups(names, ranks, ["comp"], "rank", "inner")
    named = members.select("sig", "node", "n", "size").join(ranked, "node", "left")
    named = materialise(named.select("sig", "node", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("rank", F.lit(1)).alias("rank")), "named")
    order = F.struct("rank", "comp")
    open_ = named.groupBy("sig").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("sig", "hi", "size")
    ties = materialise(join_groups(named, materialise(open_, "open"), ["sig"], "size", "inner"), "ties")
    if not ties.isEmpty():
        late = materialise(_verify_open(ties, texts, n_gram, threshold), "late-links")
        if not late.isEmpty():
            names = components(edges.unionByName(late))

    classes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.join(names, "node", "left"), "classes")
    merged = classes.where("comp is not null").groupBy("comp").agg(F.min("least_id").alias("comp_id"), F.count(F.lit(1)).alias("nodes"))
    joined = join_groups(classes.where("comp is not null"), merged, ["comp"], "nodes", "inner")
    alone = classes.where("comp is null").select("node", "least_id", "copies", *([F.col("node").alias("comp")] if keyed else []))
    classes = materialise(joined.select("node", F.col("comp_id").alias("least_id"), "copies", *(["comp"] if keyed else [])).unionByName(alone), "component-ids")
    more = [F.col("k").alias("text_key"), F.col("comp").alias("component")] if keyed else []
    return join_groups(rows, classes, ["node"], "copies").select("id", F.col("n").alias("n_shingles"), F.coalesce("least_id", "id").alias("component_id"), *more)
