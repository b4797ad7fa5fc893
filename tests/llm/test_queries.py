"""Every opN_ query over the whole of the smallest tables, column by column: against its SQL or against brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from test_others import best_offsets

from triloom.llm import audio, bpe, queries
from triloom.llm.mixing import targets

tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(db):
    return db.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()


def found(spark, name):
    return queries.queries()[name](spark, DATA).toPandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, db, name):
    got, want = found(spark, name), db.execute(queries.oracle_sql()[name]).df()
    order = sorted(want.columns)
    key = lambda d: sorted(map(tuple, d[order].astype(object).where(d[order].notna(), None).astype(str).to_numpy().tolist()))
    clean = lambda d: d.assign(refers_to=d["refers_to"].astype("Int64")) if "refers_to" in d else d
    assert sorted(got.columns) == order and key(clean(got)) == key(clean(want)) and len(want)


def test_language_id(spark, documents):
    got = found(spark, "op1_language_id").set_index("doc_id")
    assert list(got.columns[:3]) == ["held_out", "lang_pred", "score"] and sorted(got.index) == sorted(i for i, *_ in documents)
    learned = {lang for i, t, lang, _ in documents if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    right = []
    for i, text, lang, _ in documents:
        r = got.loc[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (text is None or not any(map(str.isalpha, text))) and r["lang_pred"] in learned | {"und"}
        if r["held_out"] and lang is not None:
            right.append(r["lang_pred"] == lang)
    assert len(right) > 20 and np.mean(right) > 0.95


def test_sharding(spark, documents):
    got = found(spark, "op4_sharding").set_index("doc_id")
    assert list(got.columns) == ["size", "text_crc32", "law", "shard", "slot", "grown_shard"] and sorted(got.index) == sorted(i for i, *_ in documents)
    for i, text, *_ in documents:
        data = (text or "").encode()
        assert got.loc[i, "size"] == len(data) + 8 and got.loc[i, "text_crc32"] == zlib.crc32(data)
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    counts = got.groupby("shard").size()
    assert list(counts.index) == list(range(24)) and counts.max() - counts.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_audio(spark, db):
    got = found(spark, "op5_audio").set_index("vec_id")
    items = {i: audio.pack(audio.chroma(audio.read_wav(audio.melody(v)))) for i, v in db.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    assert sorted(got.index) == sorted(items)
    classes = {}
    for i, own in items.items():
        classes.setdefault(own.tobytes(), []).append(i)
    for i, own in items.items():
        r = got.loc[i]
        assert (r["class_id"], r["class_size"], r["n_items"]) == (min(classes[own.tobytes()]), len(classes[own.tobytes()]), len(own)) and r["digest"] == hashlib.sha256(own.tobytes()).hexdigest()
    firsts = {min(c): items[min(c)] for c in classes.values()}
    asked = {min(c) for c in classes.values() if any(i % 100 == 0 for i in c)}
    want = {k: v for k, v in best_offsets(firsts, 1, asked).items()}
    pairs = {(m["query_id"], i): (m["offset"], m["bit_error"]) for i, r in got.iterrows() if r["matches"] is not None for m in r["matches"]}
    assert pairs == want


def test_bpe(spark, documents):
    got = found(spark, "op8_bpe").set_index("doc_id")
    table = bpe.merges(bpe.ranks_from(tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=table.ranks, special_tokens={})
    assert list(got.columns) == ["n_tokens", "ids_sha256", "decoded_sha256"] and sorted(got.index) == sorted(i for i, *_ in documents)
    for i, text, *_ in documents:
        ids = library.encode_ordinary(text or "")
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_mixing(spark, documents):
    got = found(spark, "op9_mixing").set_index("doc_id")
    assert list(got.columns) == ["size", "source_size", "target", "taken"] and sorted(got.index) == sorted(i for i, *_ in documents)
    sizes = {i: len((t or "").encode().split()) for i, t, *_ in documents}
    names = sorted({s for *_, s in documents}, key=lambda s: (s is None, (s or "").encode()))
    total = {n: sum(sizes[i] for i, *_, s in documents if s == n) for n in names}
    goal = dict(zip(names, targets([total[n] for n in names], [1 + k % 3 for k in range(len(names))], sum(total.values())), strict=True))
    taken = dict.fromkeys(names, 0)
    for i, *_, s in documents:
        r = got.loc[i]
        assert (r["size"], r["source_size"]) == (sizes[i], total[s]) and abs(r["target"] - goal[s]) < 1e-6 and 0 <= r["taken"] <= 3 * sizes[i]
        taken[s] += r["taken"]
    assert all(abs(taken[n] - goal[n]) <= 1 for n in names)
