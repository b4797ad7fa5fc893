"""Chroma audio fingerprints: integral-image filters over pitch-class frames, bit errors at every offset by correlation."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import join_groups, materialise, released

RATE = 4_000
#: Samples per frame and from one frame to the next.
FRAME, HOP = 512, 128
#: Frequencies that count.
LOW_HZ, HIGH_HZ = 60.0, 1_800.0
#: Frames over which pitch classes are smoothed.
SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
#: A filter's value, the log ratio of two mean energies, falls into one of four steps at -STEP, 0 and STEP.
STEP, FLOOR = 0.6, 0.02
#: The largest share of differing bits of a match, and the fewest items that overlap in one.
MAX_BIT_ERROR = 0.2
MIN_OVERLAP = 16
#: Items that a block of recordings holds, padding included; values that are correlated at once; transforms beyond this length are in double precision.
BLOCK_ITEMS, AT_ONCE, LONG = 1 << 16, 1 << 22, 1 << 13


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of sixteen filters, by rule."""
    return [(i % 5, (5 * i) % 12, 4 + 2 * (i % 4), 4 * (1 + i // 4)) for i in range(16)]


FILTERS = _filters()
WIDEST = max(f[3] for f in FILTERS)


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Energy of the twelve pitch classes (A first) in every frame, smoothed and of unit length; a silent frame is zero."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float64), FRAME)[::HOP][:n]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    own = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    pitch = np.rint(12 * np.log2(hz[own] / 440.0)).astype(int) % 12
    out = power[:, own] @ np.eye(12)[pitch]
    padded = np.pad(out, ((2, 2), (0, 0)), mode="edge")
    out = sum(w * padded[i : i + n] for i, w in enumerate(SMOOTH))
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0.0)


def _area(image: np.ndarray, t: np.ndarray, frames: tuple[int, int], pitches: tuple[int, int]) -> np.ndarray:
    """Sum over frames t+a..t+b-1 and pitch classes c..d-1, from the integral image."""
    (a, b), (c, d) = frames, pitches
    return image[t + b, d] - image[t + a, d] - image[t + b, c] + image[t + a, c]


def pack(frames: np.ndarray) -> np.ndarray:
    """A 32-bit item per frame from which the widest filter fits: two bits (Gray code) per filter."""
    n = len(frames) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([frames, frames], axis=1), axis=0), axis=1)  # pitch classes wrap around
    t, out = np.arange(n), np.zeros(n, np.uint32)
    for i, (kind, p, height, width) in enumerate(FILTERS):
        q, r, mid, third, half = p + height, p + height // 2, width // 2, width // 4, height // 4
        whole, size = _area(image, t, (0, width), (p, q)), width * height
        if kind == 0:  # these pitch classes against the others
            a, n_a, rest, n_rest = whole, size, _area(image, t, (0, width), (0, 12)) - whole, 12 * width - size
        elif kind == 1:  # lower against upper
            a, n_a = _area(image, t, (0, width), (p, r)), width * (r - p)
        elif kind == 2:  # before against after
            a, n_a = _area(image, t, (0, mid), (p, q)), mid * height
        elif kind == 3:  # one diagonal against the other
            a, n_a = _area(image, t, (0, mid), (p, r)) + _area(image, t, (mid, width), (r, q)), mid * height
        else:  # middle against rim
            a, n_a = _area(image, t, (third, width - third), (p + half, q - half)), (width - 2 * third) * (height - 2 * half)
        if kind:
            rest, n_rest = whole - a, size - n_a
        value = np.log(np.maximum(a, 0) / n_a + FLOOR) - np.log(np.maximum(rest, 0) / n_rest + FLOOR)
        step = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        out |= (step ^ (step >> 1)).astype(np.uint32) << np.uint32(2 * i)
    return out.view(np.int32)


def read_wav(data: bytes | None) -> np.ndarray:
    """Samples of a 16-bit PCM file, channels averaged; nothing for null."""
    if not data:
        return np.zeros(0)
    with wave.open(io.BytesIO(data)) as f:
        x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
    return x.mean(axis=1) / 32768.0


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def melody(vector: list[float] | None, note_s: float = 0.08, semitone: float = 0.05) -> bytes | None:
    """A vector as a recording: a note per value, higher for larger values."""
    if vector is None:
        return None
    v = np.nan_to_num(np.array([np.nan if x is None else x for x in vector], np.float64), nan=0.0, posinf=1.0, neginf=-1.0)
    hz = 440.0 * 2 ** (np.clip(np.rint(v / semitone), -24, 24) / 12)
    phase = np.cumsum(np.repeat(hz, int(RATE * note_s))) * (2 * np.pi / RATE)
    return write_wav(0.5 * np.sin(phase))


def fingerprints(rows: DataFrame, id_col: str, media_col: str, decode: Callable[[object], np.ndarray] = read_wav) -> DataFrame:
    """``id``, ``items`` (packed integers, one per frame), ``digest`` (SHA-256 of the items) of every recording.

    decode turns a value of the media column into samples; nulls and recordings shorter than the widest filter have no items.
    Other columns are not read; rows may repeat.
    """

    ship(rows.sparkSession)

    @released
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            items = [pack(chroma(decode(x))) for x in batch["media"]]
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "items": [x.tolist() for x in items], "digest": [hashlib.sha256(x.tobytes()).hexdigest() for x in items]})

    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return held.mapInPandas(of, "id long, items array<int>, digest string")


_BLOCK = "ids binary, sizes binary, items binary"


@released
def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Recordings of about one length, packed; a recording longer than a block is one by itself."""
    for batch in batches:
        sizes = batch["items"].map(len).to_numpy()
        order, at = np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * sizes[order[end]] <= BLOCK_ITEMS:
                end += 1
            own, at = order[at:end], end
            ids, items = batch["class_id"].to_numpy(np.int64)[own], np.concatenate(batch["items"].to_numpy()[own])
            yield pd.DataFrame({"ids": [ids.tobytes()], "sizes": [sizes[own].astype(np.int64).tobytes()], "items": [items.astype(np.int32).tobytes()]})


def _smooth(n: int) -> int:
    """The smallest 2**a * 3**b * 5**c of n at least: such transforms are fast."""
    odd = [3**b * 5**c for b in range(40) for c in range(28) if 3**b * 5**c < 2 * n]
    return min(x << max(0, (-(-n // x) - 1).bit_length()) for x in odd)


def _spectra(sizes: np.ndarray, items: np.ndarray, n: int, weight: float) -> np.ndarray:
    """Transforms of length n of each recording's bits as 1 and -1, and of weight where it has items: (frequency, recording, 33)."""
    at = np.arange(sizes.max()) < sizes[:, None]
    signals = np.zeros((*at.shape, 33), np.float32 if n <= LONG else np.float64)
    bits = np.unpackbits(items.astype("<i4").view(np.uint8).reshape(-1, 4), axis=1)
    signals[at, :32] = bits * 2.0 - 1.0
    signals[at, 32] = weight
    return np.fft.rfft(signals, n, axis=1).transpose(1, 0, 2)


def _alike(q_sizes: np.ndarray, q_items: np.ndarray, c_sizes: np.ndarray, c_items: np.ndarray, max_bit_error: float, min_overlap: int) -> tuple[np.ndarray, ...]:
    """(query, recording, offset, bits that differ, overlap) of the pairs that match: every pair at every offset, the best offset of each.

    The products of the bits as 1 and -1 sum to 32 * overlap - 2 * differing; a last signal takes off what a match must reach,
    so that one correlation is to be compared with 0. Sums are whole and even, so rounding makes them exact.
    """
    low, high = int(min_overlap - c_sizes.max()), int(q_sizes.max() - min_overlap)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if low > high or not len(q_sizes) or not len(c_sizes):
        return none
    n = _smooth(int(q_sizes.max() + c_sizes.max()) - 1)
    least = 32 * (1 - 2 * max_bit_error)
    q, c = _spectra(q_sizes, q_items, n, 1.0), np.conj(_spectra(c_sizes, c_items, n, -least)).transpose(0, 2, 1)
    allowed, out = np.zeros(n, bool), []
    allowed[np.arange(low, high + 1) % n] = True
    step = max(1, AT_ONCE // (q.shape[0] * len(c_sizes)))
    for at in range(0, len(q_sizes), step):
        sums = np.matmul(np.ascontiguousarray(q[:, at : at + step]), c)
        sums = np.fft.irfft(sums.reshape(len(sums), -1).T, n, axis=1)
        pair, o = np.nonzero((sums >= -0.5) & allowed)
        o, value = np.where(o > high, o - n, o), sums[pair, o]
        a, b = at + pair // len(c_sizes), pair % len(c_sizes)
        overlap = np.minimum(c_sizes[b], q_sizes[a] - o) - np.maximum(0, -o)
        differ = np.rint((32 * overlap - value - least * overlap) / 2).astype(np.int64)
        fits = (overlap >= min_overlap) & (differ / (32.0 * np.maximum(overlap, 1)) <= max_bit_error)
        a, b, o, differ, overlap = (x[fits] for x in (a, b, o, differ, overlap))
        order = np.lexsort((o, 2 * differ - 32 * overlap, b, a))
        a, b, o, differ, overlap = (x[order] for x in (a, b, o, differ, overlap))
        first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        out.append(tuple(x[first] for x in (a, b, o, differ, overlap)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def align(prints: DataFrame, every: int = 100, max_bit_error: float = MAX_BIT_ERROR, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """A row per recording: id, class_id, class_size, n_items, digest, matches.

    Recordings with equal items are a class, named after its smallest id; equal recordings match by that. Classes with a member
    whose id every divides are queries. A query matches another class when there is an offset at which at least min_overlap items
    overlap and at most max_bit_error of the bits of the overlap differ; of such offsets that counts at which equal bits exceed
    differing ones by most (of equal ones the smallest). ``matches`` stands in the row of the class's smallest id and lists the queries that the class matches: (query
    class, offset: position in the query less position here, bit_error), best first; it's null in other rows.

    Recordings without items match nothing. Every query meets every class at every offset, in blocks of recordings, so nothing
    that matches is missed; the work grows with queries times classes. A third of all recordings being equal is one class. Null
    ids are members but name no class. A recording of n items takes some 1000 n bytes of a task's memory.
    """
    classes = prints.groupBy("digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.any_value("items").alias("items"), F.coalesce(F.bool_or(F.col("id") % every == 0), F.lit(False)).alias("query"))
    classes = materialise(classes, "classes")
    usable = classes.where("class_id is not null and size(items) > 0")
    held = materialise(usable.select("class_id", "items").mapInPandas(_blocks, _BLOCK), "item-blocks")
    asked = materialise(usable.where("query").select("class_id", "items").mapInPandas(_blocks, _BLOCK), "query-blocks")
    both = held.crossJoin(asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]))

    @released
    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples():
                ids, sizes, q_ids, q_sizes = (np.frombuffer(y, np.int64) for y in (x.ids, x.sizes, x.q_ids, x.q_sizes))
                a, b, offset, differ, overlap = _alike(q_sizes, np.frombuffer(x.q_items, np.int32), sizes, np.frombuffer(x.items, np.int32), max_bit_error, min_overlap)
                found = pd.DataFrame({"query_id": q_ids[a], "class_id": ids[b], "offset": offset, "bit_error": differ / (32.0 * overlap)})
                yield found[found["query_id"] != found["class_id"]]

    pairs = both.mapInPandas(matched, "query_id long, class_id long, offset int, bit_error double")
    found = pairs.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("bit_error", "query_id", "offset"))).alias("matches"))
    named = classes.select("digest", "class_id", "class_size", F.size("items").alias("n_items")).join(found, "class_id", "left")
    named = materialise(named, "class-matches")
    return join_groups(prints.select("id", "digest"), named, ["digest"], "class_size", "inner").select(
        "id", "class_id", "class_size", "n_items", "digest", F.when(F.col("id") == F.col("class_id"), F.coalesce("matches", F.array().cast("array<struct<bit_error:double,query_id:bigint,offset:int>>"))).alias("matches")
    )
