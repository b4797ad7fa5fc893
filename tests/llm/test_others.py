"""Language ID, archive, sharding, audio, byte-pair encoding and mixing against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken

from triloom.llm import audio, bpe, language_id, mixing
from triloom.llm.common import materialise
from triloom.llm.mixing import mix, mixed_documents, permuted, shard_counts, targets
from triloom.llm.sharding import _positions, shuffle_into_shards
from triloom.llm.warc import archive, base32, read_archive, write_archive

tokenizers = pytest.importorskip("public_tokenizers")

SYLLABLES = {"en": "the ing and tion er of", "de": "ung sch der ein keit ver", "fr": "eau oui les ment tré ais", "ru": "при ово на ить ска"}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(words))


def test_language_id(frame):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 80)), lang, "s") for i in range(400)]
    mixed = prose(rng, "en", 30) + " " + prose(rng, "ru", 60) + " " + prose(rng, "de", 20)
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !? ²½", "de"), (1003, mixed, None), (1004, "漢字かな", None), (None, prose(rng, "fr", 40), "fr"), (0, *rows[0][1:])]
    docs = frame(rows)
    model = language_id.fit(docs)
    assert model.languages == sorted(SYLLABLES)
    found = {r["row"]["doc_id"]: r for r in language_id.detect(docs, model, docs.columns).collect()}
    own = {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r["doc_id"] for r in docs.where(language_id.held_out("doc_id")).collect()} == own and len(own) > 50
    right = [found[i]["lang_pred"] == lang for i, _, lang, *_ in rows[:400] if i in own]
    assert np.mean(right) > 0.95
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert found[1004]["score"] == 0 and found[1004]["lang_pred"] in SYLLABLES
    assert found[1003]["lang_pred"] == "ru" and [s["lang"] for s in found[1003]["spans"]] == ["en", "ru", "de"]
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_id_without_labels(frame):
    docs = frame([(1, "abc", None), (2, None, "en")])
    model = language_id.fit(docs)
    assert [r["lang_pred"] for r in language_id.detect(docs, model, ["doc_id"]).collect()] == ["und", "und"]
    assert language_id.detect(frame([]), model, ["doc_id"]).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    sizes = np.array([6, 5, 2, 1])
    scores = rng.normal(0, 5, (sizes.sum(), 3)).astype(np.float32)
    labels = language_id.viterbi(scores, sizes, 4.0)
    at = 0
    for n in sizes.tolist():
        own = scores[at : at + n]
        value = lambda path, own=own: sum(own[i, x] for i, x in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        best = max(value(tuple(np.unravel_index(k, (3,) * n))) for k in range(3**n))
        assert abs(value(labels[at : at + n].tolist()) - best) < 1e-3
        at += n


PAGES = "page_id long, url string, html string, id long, digest string"


def test_archive(spark):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", rng.choice(["<p>a</p>", "<p>é</p>", "", None, f"<p>{i}</p>"]), None, "clash") for i in range(150)] + [(900, None, "a\r\nb", 1, ""), (901, "u\r\nX: y", "a\r\nb", 1, ""), (902, "u", "long " * 5000, 1, ""), (903, "same", "same", 1, ""), (903, "same", "same", 1, "")]
    found = archive(spark.createDataFrame(rows, PAGES)).collect()
    best = {}
    for i, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", -1), i)
    want = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if best[h or ""] == i else "revisit", None if best[h or ""] == i else best[h or ""]))
    assert sorted(map(str, [(r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found])) == sorted(map(str, want))
    texts = {i: (h or "").encode() for i, _, h, *_ in rows}
    for r in found:
        record = bytes(r["record"])
        head, _, rest = record.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == length + 4 and rest.endswith(b"\r\n\r\n") and head.count(b"\r\nX: y") == 0
        if r["record_type"] == "response":
            assert rest[:-4].partition(b"\r\n\r\n")[2] == texts[r["id"]]


def test_archive_stores_once_verifies_and_keeps_small_payloads(spark, tmp_path):
    rows = [(i, "u", "same text", None, "") for i in range(20)] + [(50, "u", "other", None, "")]
    path = str(tmp_path / "a")
    write_archive(spark.createDataFrame(rows, PAGES), path)
    assert spark.read.parquet(path + "/payloads").count() == 2
    found = archive(spark.createDataFrame(rows, PAGES), min_bytes=100)
    assert {r["record_type"] for r in found.collect()} == {"response"} and found.count() == 21
    kept = spark.read.parquet(path + "/payloads")
    broken = spark.createDataFrame([(r["digest"], b"x") for r in kept.collect()], kept.schema)
    broken.write.mode("overwrite").parquet(path + "/payloads")
    with pytest.raises(Exception, match="does not match"):
        read_archive(spark, path).collect()
    assert archive(spark.createDataFrame([], PAGES)).count() == 0


def test_base32(spark):
    from pyspark.sql import functions as F

    data = [(bytes([i, 7 * i % 256]),) for i in range(256)]
    for b, s in spark.createDataFrame(data, "b binary").select("b", base32(F.sha1("b"))).collect():
        assert s == base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_sharding(frame):
    rows = [(i, f"text {i}" if i % 3 else "same", "en", "s", i, -i, "clash") for i in range(1000)] + [(None, None), (5, "text 5"), (2000, "x" * 100_000)]
    first, again = (sorted(map(str, shuffle_into_shards(frame(rows), bucket_bytes=4000).collect())) for _ in range(2))
    assert first == again
    found = shuffle_into_shards(frame(rows), bucket_bytes=4000).collect()
    assert sorted(str(r["row"][:2]) for r in found) == sorted(str(r[:2]) for r in map(lambda x: (x[0], x[1]), rows))
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    ids = [r["row"]["doc_id"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"])) if r["row"]["doc_id"] is not None]
    assert abs(np.corrcoef(ids[:-1], ids[1:])[0, 1]) < 0.15
    assert shuffle_into_shards(frame([])).count() == 0
    few = shuffle_into_shards(frame([(1, "a"), (2, "b")])).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0)]


def test_positions():
    for rows in (0, 1, 23, 24, 25, 1000):
        shard, slot = _positions(0, rows, rows, 24)
        counts = np.bincount(shard, minlength=24)
        assert counts.max() - counts.min() <= 1 and all(sorted(slot[shard == s]) == list(range(counts[s])) for s in range(24))


def test_chroma_hears_pitch_classes():
    t = np.arange(audio.RATE) / audio.RATE
    for semitone in (0, 3, 7, 14):
        frames = audio.chroma(np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t))
        assert (frames.argmax(axis=1) == semitone % 12).all()
    assert audio.chroma(np.zeros(4000)).max() == 0 and len(audio.chroma(np.zeros(3))) == 0


def test_wav_round_trip():
    x = np.sin(np.arange(1000) / 10) * 0.5
    assert np.abs(audio.read_wav(audio.write_wav(x)) - x).max() < 1e-3 and len(audio.read_wav(None)) == 0


def test_audio_alignment(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(0, 0.125, 64) for i in range(0, 1000, 10)}
    vectors[901] = np.concatenate([rng.normal(0, 0.125, 10), vectors[100][:54]])  # the same, ten notes later
    vectors[902] = vectors[200] + rng.normal(0, 0.006, 64)
    vectors[903] = vectors[300]
    rows = [(i, v.tolist(), "clash") for i, v in vectors.items()] + [(950, None, ""), (951, [], ""), (None, vectors[300].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    prints = audio.fingerprints(df, "vec_id", "embedding", lambda v: audio.read_wav(audio.melody(v)))
    prints = materialise(prints, "prints")
    found = {r["id"]: r for r in audio.align(prints).collect()}
    step = 10 * int(audio.RATE * 0.08) / audio.HOP
    assert [(m["query_id"], abs(m["offset"] + step) <= 1) for m in found[901]["matches"]] == [(100, True)]
    assert [(m["query_id"], m["offset"]) for m in found[902]["matches"]] == [(200, 0)]
    assert found[903]["class_id"] == 300 == found[None]["class_id"] and found[903]["matches"] is None and found[300]["class_size"] == 3
    assert found[950]["n_items"] == 0 and found[950]["matches"] == []
    # recall against brute force at every offset
    items = {r["id"]: np.array(r["items"], np.int32) for r in prints.collect() if r["id"] is not None and r["items"]}
    truth = set()
    for q in (i for i in items if i % 100 == 0):
        for c, own in items.items():
            if found[c]["class_id"] in (q, found[q]["class_id"]) or found[c]["class_id"] != c:
                continue
            for offset in range(-len(own) + audio.MIN_OVERLAP, len(items[q]) - audio.MIN_OVERLAP + 1):
                a, b = own[max(0, -offset) :], items[q][max(0, offset) :]
                n = min(len(a), len(b))
                if np.bitwise_count((a[:n] ^ b[:n]).view(np.uint32)).sum() <= audio.MAX_BIT_ERROR * 32 * n and n >= audio.MIN_OVERLAP:
                    truth.add((q, c))
    got = {(m["query_id"], i) for i, r in found.items() for m in r["matches"] or ()}
    assert truth and len(truth & got) >= 0.9 * len(truth)
    assert audio.align(prints.limit(0)).count() == 0


def best_offsets(items, every, asked=None):
    """(query, recording): (offset, bit error), by trying every pair at every offset; no two recordings are equal."""
    out = {}
    for q in (i for i in items if (i % every == 0 if asked is None else i in asked)):
        for c in items.keys() - {q}:
            found = []
            for offset in range(audio.MIN_OVERLAP - len(items[c]), len(items[q]) - audio.MIN_OVERLAP + 1):
                a, b = items[c][max(0, -offset) :], items[q][max(0, offset) :]
                n = min(len(a), len(b))
                differ = int(np.bitwise_count((a[:n] ^ b[:n]).view(np.uint32)).sum())
                if n >= audio.MIN_OVERLAP and differ <= audio.MAX_BIT_ERROR * 32 * n:
                    found.append((2 * differ - 32 * n, offset, differ / (32 * n)))
            if found:
                out[q, c] = min(found)[1:]
    return out


def aligned(spark, vectors, every):
    """The same by align(), and the items."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    prints = materialise(audio.fingerprints(df, "vec_id", "embedding", lambda v: audio.read_wav(audio.melody(v))), "prints")
    got = {(m["query_id"], r["id"]): (m["offset"], m["bit_error"]) for r in audio.align(prints, every).collect() for m in r["matches"] or ()}
    return got, {r["id"]: np.array(r["items"], np.int32) for r in prints.collect()}


def test_audio_copies_with_bit_errors_up_to_the_limit(spark):
    rng = np.random.default_rng(11)
    vectors = {10 * i: rng.normal(0, 0.125, 64) for i in range(30)}
    vectors |= {i + k: vectors[i] + rng.normal(0, noise, 64) for i in list(vectors) for k, noise in ((1, 0.02), (2, 0.03))}
    got, items = aligned(spark, vectors, 10)
    error = {i: np.bitwise_count((items[i] ^ items[i - i % 10]).view(np.uint32)).mean() / 32 for i in items if i % 10}
    planted = {i for i, e in error.items() if e <= audio.MAX_BIT_ERROR}
    assert len(planted) > 40 and sum(error[i] > 0.15 for i in planted) >= 5
    assert {(i - i % 10, i) for i in planted} <= got.keys()


def test_audio_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(12)
    vectors = {i: rng.normal(0, 0.125, rng.integers(16, 65)) for i in range(0, 200)}
    vectors |= {1000 + i: vectors[i][:-8] + rng.normal(0, 0.02, len(vectors[i]) - 8) for i in range(0, 200, 10)}
    vectors |= {2000 + i: np.concatenate([rng.normal(0, 0.125, 30), vectors[i][:14] + rng.normal(0, 0.01, 14)]) for i in range(5, 200, 10)}
    got, items = aligned(spark, vectors, 5)
    lengths = {i: len(x) for i, x in items.items()}
    want = best_offsets(items, 5)
    short = sum(min(lengths[c], lengths[q] - o) - max(0, -o) < 30 for (q, c), (o, _) in want.items())
    assert len(want) > 80 and short > 20 and len({*lengths.values()}) > 30
    assert got == want


@pytest.fixture(scope="module")
def ranks():
    return bpe.ranks_from(tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_matches_the_library(frame, ranks):
    table = bpe.merges(ranks)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=table.ranks, special_tokens={})
    rng = random.Random(5)
    parts = ["a", "b'", "'s", " ", "  ", "\n", " \n", "\t", "é", "1", "²", "!!", "\x1c", "\x85", "\xa0", "Ω", "日本", "'ll ", "don't", "　", "<|endoftext|>", "ing the", "\U0001f600"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(800)] + [(i, prose(rng, "en", 60)) for i in range(800, 900)]
    rows += [(900, None), (901, ""), (902, " "), (903, "x" * 3000), (904, "ab" * 3000), (None, "a null id"), (905, rows[0][1]), (905, rows[0][1])]
    found = bpe.encode(frame(rows), ranks, tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    key = lambda r: (str(r[0]), r[1], r[2])
    got = [(r["id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in found]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe.decode(want[850][2], ranks) == want[850][3]
    assert bpe.encode(frame([]), ranks, tokenizers.PATTERN).count() == 0


def test_replay_matches_single_words(ranks):
    rng = random.Random(6)
    table = bpe.merges(ranks)
    words = list({bytes(rng.choices(b"aabbcdetheing !\xc3\xa9", k=rng.randint(1, 60))) for _ in range(3000)}) + [b""]
    counts, ids = table.replay(words)
    at = 0
    for w, n in zip(words, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == (table.one(w) if w else [])
        at += n
    assert table.replay([])[0].tolist() == []


def test_packing():
    rng = np.random.default_rng(7)
    for top in (2, 224, 300, 70_000, 3_000_000):
        x = rng.integers(0, top, 1000)
        assert (bpe._unpacked(bpe._packed(x)) == x).all()
    assert len(bpe._unpacked(bpe._packed(np.zeros(0, np.int64)))) == 0


def test_targets():
    assert targets([10, 10, 10], [1, 2, 3], 30) == [5.0, 10.0, 15.0]
    found = targets([100, 1, 100], [1, 2, 3], 201)
    assert found[1] == 3.0 and abs(sum(found) - 201) < 1e-9 and abs(found[2] - 3 * found[0]) < 1e-9
    assert targets([], [], 0) == [] and targets([0, 0], [1, 2], 0) == [0.0, 0.0]


def test_permutation_and_draws():
    for n in (1, 2, 3, 10, 257):
        for key in (0, 5):
            x = np.arange(n)
            assert sorted(permuted(x, np.full(n, n), np.full(n, key)).tolist()) == x.tolist()
    quotas = np.array([1000, 0, 37, 5000])
    shards = -(-quotas.sum() // 64)
    starts, counts = zip(*(shard_counts(quotas, s, shards, 64, 3) for s in range(shards)), strict=True)
    assert (sum(counts) == quotas).all() and all(c.sum() == 64 for c in counts[:-1])
    assert all((starts[i + 1] == starts[i] + counts[i]).all() for i in range(shards - 1))


def test_draws_of_many_slots_follow_the_law():
    rare = np.array([1, 2, 2 * 900_000_000])  # a few slots among very many: most draws of a hundredth get none
    found = np.array([mixing._draw(np.random.default_rng([1, i]), rare, int(rare.sum()) // 100) for i in range(5000)])
    assert (found.sum(axis=1) == rare.sum() // 100).all() and 25 <= found[:, 0].sum() <= 80 and 65 <= found[:, 1].sum() <= 140
    rng = np.random.default_rng(2)
    for good, bad, n in ((30, 50, 20), (5, 900, 300), (400, 7, 390), (0, 9, 4), (9, 0, 4)):
        own = np.bincount([mixing._hypergeometric(rng, good, bad, n) for _ in range(20_000)], minlength=n + 1)
        of_numpy = np.bincount(rng.hypergeometric(good, bad, n, 20_000), minlength=n + 1)
        assert np.abs(np.cumsum(own - of_numpy)).max() < 500  # Kolmogorov and Smirnov's distance: 0.025
    big = 3 * 900_000_000
    found = np.array([mixing._hypergeometric(rng, big, big, big) for _ in range(400)], np.float64)
    assert abs(found.mean() - big / 2) < 5 * (big / 8 / 400) ** 0.5 and 0.8 < found.var() / (big / 8) < 1.25


def test_mixing(frame):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rng.randint(0, 300))), "en", rng.choice(["a", "b", "b", "b", "ü", None, "tiny"] if i % 40 else ["tiny"]), i) for i in range(300)]
    rows += [(1000, None, "en", "empty"), (1001, "  lead\tand  trail \n", "en", "a"), (None, "no id here", "en", "a"), (1002, "twice the same", "en", "a"), (1002, "twice the same", "en", "a")]
    docs = frame(rows)
    plan = mix(docs)
    size = lambda t: len((t or "").encode().split())
    found = plan.taken().collect()
    assert sorted((str(r["id"]), r["size"]) for r in found) == sorted((str(r[0]), size(r[1])) for r in rows)
    names = [s["src"] for s in plan.sources]
    assert names == ["sa", "sb", "sempty", "stiny", "sü", "n"]
    taken = {}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        taken[r["src"]] = taken.get(r["src"], 0) + r["taken"]
    for s in plan.sources:
        assert abs(taken[s["src"]] - s["target"]) <= 1, s
    again = mix(docs)
    assert sorted(map(str, again.taken().select("id", "size", "taken").collect())) == sorted(map(str, plan.taken().select("id", "size", "taken").collect()))
    slots = plan.slots.groupBy("shard").count().collect()
    assert all(r["count"] == 4096 for r in slots if r["shard"] < len(slots) - 1)
    texts = mixed_documents(docs, plan).collect()
    words = {}
    for r in texts:
        i = str(r["row"]["doc_id"])
        words.setdefault(i, []).extend(r["body"].encode().split())
    for r in found:
        if r["id"] not in (1002,):
            assert len(words.get(str(r["id"]), [])) == r["taken"]
    own = {str(r[0]): set((r[1] or "").encode().split()) for r in rows}
    assert all(set(w) <= own[i] for i, w in words.items())
    assert sum(len(w) for w in words.values()) == sum(taken.values())


def test_mixing_nothing(frame):
    assert mix(frame([])).taken().count() == 0
    assert [r["taken"] for r in mix(frame([(1, None, None, None), (2, " ", None, "a")])).taken().collect()] == [0, 0]
