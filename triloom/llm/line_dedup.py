"""Line dedup: lines that many documents hold are kept in one of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, join_groups, materialise

MIN_CHARS = 40
MIN_DOCS = 5


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"),
        text.alias("body"),
        F.xxhash64(F.col(id_col), text).alias("k1"),
        F.xxhash64(F.lit(1), F.col(id_col), text).alias("k2"),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop repeated lines; returns ``row`` (struct of the input columns), ``body`` (kept text), ``n_lines``, ``n_dropped``.

    A text is split at \\n. A line's key is the line without ASCII white space at its ends, with A-Z lower-cased. Lines whose
    key has at least min_chars code points and occurs in at least min_docs documents stay only in the document with the
    largest id that holds them (every occurrence there); all other lines stay, in order, joined by \\n.

    A null or empty text is one empty line. Documents are counted by id: rows that share an id count once, whatever their texts, and
    null ids are one document together; rows equal in id and text get the same result; rows that share the largest id all keep the line. A null id is smaller than any other. Input columns are carried inside
    ``row``, so their names cannot clash; an empty table gives an empty one.

    Plan: one pass writes (document key, position, 128-bit line hash) for the long lines; documents are counted per hash with
    map-side partial aggregation; hashes over the threshold meet their lines by join_groups(), which keeps a line that a third
    of the documents hold off a single task; dropped positions per document meet the text in one shuffle of the texts.
    """
    keyed = _keyed(docs, id_col, text_col)
    key = F.trim(F.col("line"), F.lit(ASCII_SPACE))
    lines = (
        keyed.select("k1", "k2", "id", F.posexplode(F.split(ascii_lower(F.col("body")), "\n", -1)).alias("pos", "line"))
        .select("k1", "k2", "id", "pos", key.alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("k1", "k2", "id", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    )
    lines = materialise(lines, "lines")
    groups = (
        lines.groupBy("h1", "h2")
        .agg((F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("n_docs"), F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_docs") >= min_docs)
    )
    groups = materialise(groups, "line-groups")
    drops = (
        join_groups(lines, groups, ["h1", "h2"], "n_rows", "inner")
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("drops"))
    )
    body = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))  # not carried beside row: it would be shuffled twice
    kept = F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), F.col("drops"))
    return (
        keyed.select("row", "k1", "k2")
        .join(drops, ["k1", "k2"], "left")
        .select("row", body.alias("body"), "drops", F.split(body, "\n", -1).alias("all_lines"))
        .select(
            "row",
            F.when(F.col("drops").isNull(), F.col("body"))
            .otherwise(F.array_join(F.transform(kept, lambda i: F.get("all_lines", i)), "\n"))
            .alias("body"),
            F.size("all_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
