"""Corpus pipeline: language ID, line dedup, near-duplicate join, mixing, byte-level BPE. Documents in, token digests out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.llm import bpe, language_id
from triloom.llm.common import ascii_lower, materialise, read
from triloom.llm.line_dedup import line_dedup
from triloom.llm.mixing import mix, mixed_documents
from triloom.llm.ngram_jaccard import jaccard_components

#: A document is rejected when less than this share of its letters is in any one language.
MIN_LANGUAGE_SHARE = 0.5

#: The classifier, the components and the mix are beyond SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def _with_text(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents from ``row``, text from ``body`` and n_chars to match."""
    new = {"text": F.col("body"), "n_chars": F.char_length("body").cast("long")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those of no main language; a missing lang is filled in. Without any labelled document nothing but letters counts. Null texts go; ids, repeated or null, don't matter but for training."""
    model = language_id.fit(docs)
    found = language_id.detect(docs, model, docs.columns)
    own = F.col("row.text").rlike(r"\p{L}")
    if model.languages:
        own = own & (F.col("score") >= MIN_LANGUAGE_SHARE)
    lang = F.coalesce("row.lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred")))
    return found.where(own).select(*[(lang if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines, and documents of which nothing but white space is left by that. A null text is an empty line and stays, as an empty text."""
    found = line_dedup(docs)
    return _with_text(found.where((F.col("n_dropped") == 0) | F.col("body").rlike(r"\S")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: the one with the smallest id (null last), then of the smallest hash of its text. Rows that share an id are rows of their own.

    Rows equal in id and text are one row from the start, which combines within tasks, so that however many they are they gather nowhere.
    """
    found = jaccard_components(docs, keyed=True)
    alone = F.col("component").isNull()  # no words: linked with nothing
    first = found.groupBy("component", F.when(alone, F.col("id")), F.when(alone, F.col("text_key"))).agg(F.min(F.struct(F.col("id").isNull(), "id", "text_key")).alias("first"))
    key = lambda i, k: (F.coalesce(i, F.lit(0)).alias("i"), i.isNull().alias("nameless"), k.alias("k"))
    first = materialise(first.select(*key(F.col("first.id"), F.col("first.text_key"))), "first-rows")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(*key(F.col("doc_id").cast("long"), F.xxhash64(ascii_lower(text))), F.xxhash64(text).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    single = keyed.groupBy("i", "nameless", "k").agg(F.min_by("row", "h").alias("row"))
    kept = single.join(first.hint("merge"), ["i", "nameless", "k"], "left_semi")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: one for each epoch that takes words of a document, with the text taken. Documents without words (null texts too) are in no mix; a null source is one."""
    return _with_text(mixed_documents(docs, mix(docs)), docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests, a row per document of the mix. A null text has no tokens; ids may be null or repeat; no other column is read."""
    import public_tokenizers

    ranks = bpe.ranks_from(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.encode(docs, ranks, public_tokenizers.PATTERN, at_spaces=True)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
