"""One query per operator, over its whole table, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, language_id, warc
from .common import materialise, read
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_jaccard import jaccard_components
from .sharding import shuffle_into_shards
from .substring_dedup import substring_dedup
from .warc import archive

SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.detect(docs, language_id.fit(docs), ["doc_id"])
    return found.select("row.doc_id", language_id.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the digest of every record's bytes, so that each is rebuilt in full."""
    found = archive(read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))


_SHA1_BITS = "CAST('0x' || substr(h, {}, 5) AS BIGINT)"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({} // {}) % 32 AS BIGINT) + 1, 1)"
BASE32_SQL = " || ".join(_LETTER.format(_SHA1_BITS.format(5 * i + 1), 32**j) for i in range(8) for j in (3, 2, 1, 0))
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h, regexp_replace(url, '[\\r\\n]+', ' ', 'g') AS u FROM pages),
g AS (SELECT b, max(page_id) AS first_id, max_by(u, page_id) AS first_u FROM p GROUP BY b),
r AS (SELECT page_id, p.b, u, first_id, first_u, page_id <> first_id AS again, {BASE32_SQL} AS d, chr(13) || chr(10) AS e FROM p JOIN g ON p.b = g.b)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to,
       sha256('WARC/1.1' || e || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e
              || 'WARC-Date: {warc.DATE}' || e || coalesce('WARC-Target-URI: ' || u || e, '') || 'WARC-Payload-Digest: sha1:' || d || e
              || CASE WHEN again THEN 'WARC-Profile: {warc.PROFILE}' || e || 'WARC-Refers-To: <urn:page:' || first_id || '>' || e
                                      || coalesce('WARC-Refers-To-Target-URI: ' || first_u || e, '') ELSE '' END
              || 'Content-Type: application/http; msgtype=response' || e || 'Content-Length: ' || ({len(warc.HTTP_HEAD)} + CASE WHEN again THEN 0 ELSE strlen(b) END) || e || e
              || 'HTTP/1.1 200 OK' || e || 'Content-Type: text/html; charset=utf-8' || e || e || CASE WHEN again THEN '' ELSE b END || e || e) AS record_sha256
FROM r
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^ \\t\\n\\x0b\\f\\r]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = d.doc_id
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("row.text", F.lit(""))
    return shuffle_into_shards(read(spark, sf_dir, "documents")).select(
        "row.doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _melody(vector) -> object:
    return audio.read_wav(audio.melody(vector))


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings: each vector of embeddings is rendered as a WAV file, a note per value."""
    prints = materialise(audio.fingerprints(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _melody), "prints")
    return audio.align(prints).withColumnRenamed("id", "vec_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER_SQL.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("body", "UTF-8"), 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, {LOWER_SQL.format(f"trim(ls[i], {SPACE_SQL})")} AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
g AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, g.k IS NOT NULL AND l.doc_id <> g.keeper AS gone FROM l LEFT JOIN g ON l.k = g.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.ranks_from(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, at_spaces=True)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(read(spark, sf_dir, "documents"))
    of = spark.createDataFrame([(x["src"], x["size"], x["target"]) for x in plan.sources], "src string, source_size long, target double")
    return plan.taken().join(of, "src").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_sentences", "n_removed", F.coalesce("body", F.lit("")).alias("text"))


_SPACE_RE, _WORD_RE = "[ \\t\\n\\x0b\\f\\r]", "[^ \\t\\n\\x0b\\f\\r\\x1e]"
_ENDS_SQL = f"regexp_replace(coalesce(text, ''), '([.!?]{_SPACE_RE}+|\\n+|[\u3002\uff01\uff1f]{_SPACE_RE}*)', '\\1' || chr(30), 'g')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, string_split(regexp_replace({_ENDS_SQL}, '((?:{_WORD_RE}+{_SPACE_RE}+){{12}})', '\\1' || chr(30), 'g'), chr(30)) AS ps FROM documents),
p AS (SELECT doc_id, i, ps[i] AS piece, trim(regexp_replace({LOWER_SQL.format("ps[i]")}, '{_SPACE_RE}+', ' ', 'g')) AS s
      FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM d)),
s AS (SELECT doc_id, i, s, row_number() OVER w - 1 AS pos, CAST(sum(strlen(s)) OVER w AS BIGINT) AS upto, CAST(sum(strlen(s)) OVER w AS BIGINT) - strlen(s) AS since
      FROM p WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
l AS (SELECT doc_id, list(s ORDER BY pos) AS ss FROM s GROUP BY doc_id),
r AS (SELECT a.doc_id, a.pos AS lo, greatest(b.pos, a.pos + 1) AS hi FROM s a ASOF JOIN s b ON a.doc_id = b.doc_id AND a.since + 160 <= b.upto
      UNION SELECT a.doc_id, least(b.pos, a.pos - 1), a.pos FROM s a ASOF JOIN s b ON a.doc_id = b.doc_id AND a.upto - 160 >= b.since),
k AS (SELECT r.doc_id, lo, hi, array_to_string(list_slice(ss, lo + 1, hi + 1), chr(30)) AS k FROM r JOIN l ON r.doc_id = l.doc_id WHERE lo >= 0 AND hi < len(ss)),
o AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY k ORDER BY doc_id, lo) AS occ FROM k),
x AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM o WHERE occ > 1),
m AS (SELECT p.doc_id, p.i, p.piece, s.pos IS NOT NULL AS is_s, x.pos IS NOT NULL AS gone
      FROM p LEFT JOIN s ON p.doc_id = s.doc_id AND p.i = s.i LEFT JOIN x ON s.doc_id = x.doc_id AND s.pos = x.pos)
SELECT doc_id, CAST(sum(CAST(is_s AS INT)) AS BIGINT) AS n_sentences, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed,
       coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM m GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_warc": op2_warc,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_sharding": op4_sharding,
        "op5_audio": op5_audio,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_bpe": op8_bpe,
        "op9_mixing": op9_mixing,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": OP2_SQL,
        "op3_ngram_jaccard": OP3_SQL,
        "op6_exact_dedup": OP6_SQL,
        "op7_line_dedup": OP7_SQL,
        "op10_substring_dedup": OP10_SQL,
    }
