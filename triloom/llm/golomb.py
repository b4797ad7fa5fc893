"""Golomb-coded key exchange: blocks send sorted, compressed keys to owners of key ranges, owners reply per key."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys are the upper KEY_BITS bits of a 64-bit hash; a collision only makes a key look more frequent than it is.
KEY_BITS = 48


def encode(values: np.ndarray) -> bytes:
    """Ascending uint64 values as Golomb codes (Rice's power-of-two divisors) of their differences."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=values[:1] * 0)
    k = max(0, int(np.log2(max(1.0, float(gaps.max()) if n == 1 else float(gaps.mean())))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = b""
    if k:
        rest = np.packbits(np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - k :]).tobytes()
    return np.array([n, k, len(unary)], "<u4").tobytes() + np.packbits(unary).tobytes() + rest


def decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, k, bits = np.frombuffer(blob, "<u4", 3).tolist()
    packed = (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, packed, 12), count=bits)
    ends = np.flatnonzero(unary)
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        low = np.zeros((n, 64), np.uint8)
        low[:, 64 - k :] = np.unpackbits(np.frombuffer(blob, np.uint8, offset=12 + packed), count=n * k).reshape(n, k)
        gaps = (gaps << np.uint64(k)) | np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Bit length of each count: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


def messages(block: str | int, keys: np.ndarray, counts: np.ndarray, owner_bits: int, key_bits: int = KEY_BITS) -> pa.RecordBatch:
    """One message per owner that the block has keys for. keys: ascending, distinct."""
    owners = (keys >> np.uint64(key_bits - owner_bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(owners, prepend=-1))
    ends = [*starts[1:].tolist(), len(keys)]
    out = [(int(owners[a]), block, encode(keys[a:b]), zlib.compress(counts[a:b].astype("<u4").tobytes(), 1)) for a, b in zip(starts.tolist(), ends, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string() if isinstance(block, str) else pa.int64(), pa.binary(), pa.binary()))],
        ["owner", "block", "keys", "counts"],
    )


MESSAGE = "owner long, block string, keys binary, counts binary"


def _reply(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = [decode(x) for x in pdf["keys"]]
    counts = np.concatenate([np.frombuffer(zlib.decompress(x), "<u4") for x in pdf["counts"]]).astype(np.float64)
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = levels(np.bincount(where.ravel(), weights=counts)[where.ravel()])
    cuts = np.cumsum([len(x) for x in keys])[:-1]
    return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "levels": [zlib.compress(x.tobytes(), 1) for x in np.split(total, cuts)]})


def replies(sent: DataFrame) -> DataFrame:
    """For each message its owner's reply: the level of every key's total count, in the message's order.

    An owner holds one range of a uniform hash, each block sends a key once, and the number of owners grows with the input:
    no owner is hot, however often a key occurs.
    """
    return sent.groupBy("owner").applyInPandas(_reply, "block string, owner long, levels binary")


def _bitmap(pdf: pd.DataFrame) -> pd.DataFrame:
    again = [np.frombuffer(zlib.decompress(x), np.uint8) > 1 for x in _reply(pdf)["levels"]]
    return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "bits": [len(x).to_bytes(4, "little") + np.packbits(x).tobytes() for x in again]})


def bitmaps(sent: DataFrame) -> DataFrame:
    """As replies(), but a bit per key: whether it occurs more than once. ``block`` keeps its type."""
    return sent.groupBy("owner").applyInPandas(_bitmap, f"block {sent.schema['block'].dataType.simpleString()}, owner long, bits binary")


def joined_bits(parts: list[tuple[int, bytes]]) -> np.ndarray:
    """A block's bitmaps, in key order, as booleans."""
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=int.from_bytes(x[:4], "little")) for _, x in sorted(parts)] or [np.zeros(0, np.uint8)]).astype(bool)


def joined_levels(parts: list[tuple[int, bytes]]) -> np.ndarray:
    """A block's replies, in key order; equal blocks have equal names and equal replies, of which one counts."""
    return np.frombuffer(b"".join(zlib.decompress(x) for _, x in sorted(dict(parts).items())), np.uint8)


def key_bits(n_keys: int, spare: int = 8) -> int:
    """Bits of a key for so many keys, when one in 2**spare may seem to occur once more than it does."""
    return min(60, max(32, n_keys.bit_length() + spare))


def owner_bits(n_keys: int, per_owner: int = 1 << 21) -> int:
    return min(24, max(3, int(np.ceil(np.log2(max(1, n_keys) / per_owner))))) if n_keys else 3


def tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches of a task in tables of about that many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)
