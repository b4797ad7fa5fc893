"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans of mixed-language text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import released, small

#: Labelled rows per language that the classifier is fitted on, about: the bound of the training sample.
SAMPLE_ROWS = 2_000
#: Feature buckets; nats that a change of language costs; most nats by which one word can speak against a language.
BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
WORD_LIMIT = 10.0
#: A language is a candidate for a script that at least this share of its words is written in.
SCRIPT_SHARE = 0.005
#: Words that a task keeps scores of, and words that go through Viterbi at a time.
KNOWN_WORDS, STEP_WORDS = 250_000, 500_000

#: First code points of script ranges and the script (a number per script, 0 for others) from there on.
SCRIPT_STARTS = (
    0x0, 0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80, 0xD00, 0xD80, 0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100,
    0x1200, 0x13A0, 0x1780, 0x1800, 0x18B0, 0x1E00, 0x1F00, 0x2000, 0x2C60, 0x2C80, 0x2E80, 0x3040, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00,
)
SCRIPTS = (
    0, 1, 0, 2, 3, 4, 5, 6, 0, 7, 13, 14, 15, 16, 17, 18, 19, 20, 21, 8, 22, 23, 24, 9, 10,
    25, 0, 26, 27, 0, 1, 2, 0, 1, 0, 11, 12, 0, 10, 0, 11, 0, 10, 0, 11, 0,
)
N_SCRIPTS = 28

_WORDS = re.compile(r"[^\W\d_]+")


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: CRC-32 of its id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word number) of every pair, triple and whole word, as two aligned arrays; script and length of each word."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = points == 32
    starts = np.flatnonzero(space)[:-1]
    word = np.cumsum(space)[:-1] - 1  # of each position but the last space
    a, b, c = points[:-1], points[1:], np.append(points[2:], np.uint64(32))
    pairs = _mixed(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F))
    triples = _mixed(a * np.uint64(0x165667B19E3779F9) + b * np.uint64(0x27D4EB2F165667C5) + c * np.uint64(0x85EBCA77C2B2AE63))
    inner = b != 32  # a triple over a word's end says nothing
    inner |= space[:-1]
    place = np.arange(len(a), dtype=np.uint64) - starts.astype(np.uint64)[word]
    whole = _mixed(np.add.reduceat((a + np.uint64(1)) * (place + np.uint64(7)) * (a * np.uint64(0x9E3779B97F4A7C15) + place), starts))
    numbers = np.arange(len(words))
    script = np.array(SCRIPTS)[np.searchsorted(SCRIPT_STARTS, points[starts + 1], side="right") - 1]
    return np.concatenate([pairs, triples[inner], whole]), np.concatenate([word, word[inner], numbers]), script, np.bincount(word)[: len(words)] - 1


@dataclass
class Model:
    """languages in code-point order; weights: log probability of each bucket per language; scripts: languages that use each script."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray
    fallback: int

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores per language, length) of each word; -inf for all languages where none uses its script."""
        bucket, word, script, length = _features(words)
        order = np.argsort(word, kind="stable")
        total = np.add.reduceat(self.weights[bucket[order]], np.searchsorted(word[order], np.arange(len(words))))
        total = np.where(self.scripts[script], total, -np.inf)
        best = total.max(axis=1, keepdims=True)
        some = np.isfinite(best)
        return np.where(some, np.maximum(total - np.where(some, best, 0), -WORD_LIMIT), -np.inf).astype(np.float32), length


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about sample_rows labelled rows per language, picked by a hash of their id; held-out rows, null ids, null labels and null texts are not learned from.

    Counts of hashed pairs and triples of letters and of words are summed per language in Spark; the driver gets at most
    BUCKETS + N_SCRIPTS numbers per language.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("out"))
    rows = rows.where("not out and id is not null and lang is not null and text is not null")
    sizes = {x["lang"]: x["count"] for x in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes, key=lambda x: x.encode())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool), 0)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample_rows / sizes[k])))])
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(_WORDS.findall(text.lower()))
            for lang, counter in seen.items():
                if counter:
                    bucket, word, script, _ = _features(list(counter))
                    n = np.fromiter(counter.values(), np.int64, len(counter))
                    both = np.concatenate([bucket, script + BUCKETS])
                    totals = np.bincount(both, np.concatenate([n[word], n]))
                    at = np.flatnonzero(totals)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(totals[at].astype(np.int64))], ["lang", "bucket", "n"])

    counts: pd.DataFrame = picked.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
    table[counts["bucket"].to_numpy(np.int64), counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    grams, scripts = table[:BUCKETS] + 0.5, table[BUCKETS:]
    shares = scripts / np.maximum(1, scripts.sum(axis=0))
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), shares >= SCRIPT_SHARE, int(np.argmax([sizes[x] for x in languages])))


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of every word: scores of all texts' words one after another, sizes in descending order; a change costs penalty.

    All texts take a step at once, so the work in Python is one step per word of the longest text.
    """
    starts = np.cumsum(sizes) - sizes
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    back = np.empty(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()  # texts longer than t
    for t in range(longest):
        n = active[t]
        held, at = value[:n], starts[:n] + t
        first = held.argmax(axis=1)
        floor = held[np.arange(n), first] - np.float32(penalty)
        stay = held >= floor[:, None]
        back[at] = np.where(stay, own, first[:, None])
        value[:n] = np.where(stay, held, floor[:, None]) + scores[at]
    labels = np.empty(len(scores), np.int64)
    current = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = current[:n]
        current[:n] = back[at, current[:n]]
    return labels


class _Known(dict):
    """Numbers of words; new ones wait to be scored."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


SPANS = "array<struct<lang:string,first_word:int,words:int>>"


def detect(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (struct of the carried columns), ``lang_pred``, ``score``, ``spans`` for every whole text.

    Words are runs of letters, lower-cased. A word's candidates are the languages that use its script; its scores are naive Bayes
    over hashed letter pairs, triples and the word. Viterbi with SWITCH_PENALTY labels every word; ``spans`` are the runs of
    one label, counted in words that have candidates. ``lang_pred`` is the label of most letters (of equal ones the first by
    code point) and ``score`` its share of all letters. A null text and one without letters are ``und`` with score 0; where no learned
    language uses any of a text's scripts, the most common learned language is given with score 0; without training rows
    all texts are ``und``. Only the text is looked at. Rows may repeat; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    spans_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))

    @released
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        table, lengths = np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.int64)
        for batch in small(batches):
            if len(known) > KNOWN_WORDS:
                known = _Known()
                table, lengths = table[:0], lengths[:0]
            numbers, letters = [], []
            for text in batch.column("text").to_pylist():
                words = _WORDS.findall(text.lower()) if text else []
                numbers.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                letters.append(bool(words) and any(map(str.isalpha, text)))
            if known.new and model.languages:
                scores, length = model.scores(known.new)
                length = np.where([any(map(str.isalpha, w)) for w in known.new], length, 0)
                scores[length == 0] = -np.inf
                table, lengths = np.concatenate([table, scores]), np.concatenate([lengths, length])
            known.new = []
            n = batch.num_rows
            pred, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            if model.languages:
                usable = np.isfinite(table).any(axis=1)
                all_letters = [int(lengths[x].sum()) for x in numbers]
                numbers = [x[usable[x]] for x in numbers]
                table_safe = np.where(np.isfinite(table), table, np.float32(-4 * WORD_LIMIT))
                order = sorted(range(n), key=lambda i: -len(numbers[i]))
                done = 0
                while done < n and len(numbers[order[done]]):
                    upto, total = done, 0
                    while upto < n and (upto == done or total + len(numbers[order[upto]]) <= STEP_WORDS):
                        total += len(numbers[order[upto]])
                        upto += 1
                    part = [i for i in order[done:upto] if len(numbers[i])]
                    flat = np.concatenate([numbers[i] for i in part])
                    sizes = np.array([len(numbers[i]) for i in part])
                    labels = viterbi(table_safe[flat], sizes)
                    ends = np.cumsum(sizes)
                    for i, a, b in zip(part, (ends - sizes).tolist(), ends.tolist(), strict=True):
                        own = labels[a:b]
                        weight = np.bincount(own, lengths[flat[a:b]], len(model.languages))
                        best = int(weight.argmax())
                        pred[i], score[i] = model.languages[best], float(weight[best] / max(1, all_letters[i]))
                        runs = np.flatnonzero(np.diff(own, prepend=-1))
                        spans[i] = [{"lang": model.languages[own[x]], "first_word": x, "words": y - x} for x, y in zip(runs.tolist(), [*runs[1:].tolist(), b - a], strict=True)]
                    done = upto
                for i in range(n):
                    if pred[i] == "und" and letters[i]:
                        pred[i] = model.languages[model.fallback]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, spans_type)], ["row", "lang_pred", "score", "spans"]
            )

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).alias("text"))
    return held.mapInArrow(label, f"row {held.schema['row'].dataType.simpleString()}, lang_pred string, score double, spans {SPANS}")
