"""The pipeline, stage by stage, against brute force over each stage's own input."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from test_dedup import jaccard_reference, line_reference, near_copies
from test_others import prose

import __spark_entry__
import corpus_pipeline
from triloom.llm import bpe, queries

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    langs = ["en", "de", "fr"]
    line = "This line stands in very many of the documents here."
    rows = [(i, "\n".join([prose(rng, langs[i % 3], rng.randint(5, 120)), *([line] if i % 4 == 0 else [])]), langs[i % 3], f"src{i % 5}") for i in range(150)]
    rows += [(1000 + i, t, "en", "src1") for i, (_, t) in enumerate(near_copies(rng, 20, 60, 3, 0))]
    rows += [(2000, None, None, None), (2001, "123 456", "en", "src0"), (2002, "", "en", "src0"), (2003, prose(rng, "de", 30), None, None), (2004, line, "en", "src2")]
    folder = str(tmp_path_factory.mktemp("sf"))
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
        if name != "bpe":
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in seen[-1])
    given, spoken, lines, single, mixed, tokens = seen
    assert {r["doc_id"] for r in given} - {r["doc_id"] for r in spoken} == {2000, 2001, 2002}
    assert all(r["lang"] for r in spoken)
    want = {(i, t) for i, t, *_ in line_reference([(r["doc_id"], r["text"]) for r in spoken]) if t.strip() or not any(i == s["doc_id"] and s["text"].strip() for s in spoken)}
    assert {(r["doc_id"], r["text"]) for r in lines} == want
    reference = jaccard_reference([(r["doc_id"], r["text"]) for r in lines])
    assert {r["doc_id"] for r in single} == {i for i, _, c in reference if i == c} and len(single) == len({r["doc_id"] for r in single}) < len(lines)
    by_id = {r["doc_id"]: r for r in single}
    assert all(set(r["text"].split()) <= set(by_id[r["doc_id"]]["text"].split()) and r["source"] == by_id[r["doc_id"]]["source"] for r in mixed)
    count = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    assert abs(count(mixed) - count(single)) <= 6
    table = bpe.merges(bpe.ranks_from(tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=table.ranks, special_tokens={})
    want = []
    for r in mixed:
        ids = library.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert sorted(map(tuple, tokens)) == sorted(want)


def test_near_copies_row_by_row(frame):
    rng = random.Random(12)
    texts = [prose(rng, "en", 60) for _ in range(12)]
    rows = [(0, texts[0]), (5, texts[1]), (5, texts[1].upper()), (None, texts[0]), (None, texts[2]), (None, texts[2]), (None, texts[2] + " end"), (None, texts[3])]
    rows += [(10 + i, t) for i in range(8) for t in (texts[0] + f" more{i}", texts[4 + i])]  # each id: a near copy of 0 and a text of its own
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(None, frame(rows), "").collect()]
    assert sorted(i for i, _ in kept if i is not None) == [0, 5, *range(10, 18)]
    assert {(0, texts[0]), *((10 + i, texts[4 + i]) for i in range(8))} <= {*kept}
    nameless = sorted(t for i, t in kept if i is None)
    assert len(nameless) == 2 and texts[3] in nameless and any(t.startswith(texts[2]) for t in nameless)


def test_every_stage_takes_odd_rows(spark, tmp_path):
    """Null and repeated ids, null columns, equal rows, a very long text, columns whose names the stages use themselves."""
    rng = random.Random(13)
    text = [prose(rng, "en", 40) for _ in range(8)]
    rows = [(1, text[0], "en", "a"), (1, text[0], "en", "a"), (1, text[1], None, None), (None, text[2], "en", "b"), (None, None, None, None), (2, "", None, "b"), (3, text[3] + "\n" + text[4], "en", "a")]
    rows += [(4, prose(rng, "en", 30_000), "en", "b"), (5, "word", "en", "a"), (6, " \n ", "en", "a"), (7, None, "en", "c")] + [(10 + i, text[5], "en", "a") for i in range(6)]
    extra = "`__n` long, id string, row string, body string, k long, h long, component string, `first` int"
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "x", None, "y", 2, 3, "z", 4) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, df, "")
        assert n == 4 or found.columns == df.columns
        kept[name] = found.collect()
    size = lambda name: len(kept[name])
    assert size("language_id") == len(rows) - 4 and size("line_dedup") == len(rows) - 5 and size("bpe") == len(rows)
    assert sorted(str(r["doc_id"]) for r in kept["ngram_jaccard"]) == sorted(["1", "1", "10", "2", "3", "4", "5", "6", "7", "None", "None"])
    assert all(r["id"] == "x" and r["__n"] == 1 for r in kept["ngram_jaccard"] + kept["mixing"])


def test_run_gives_the_same(spark, corpus):
    a, b = (sorted(map(str, corpus_pipeline.run(spark, corpus).collect())) for _ in range(2))
    assert a == b and a


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and set(queries.queries()) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
