"""Line, exact, substring and near-duplicate removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from triloom.llm import golomb, ngram_jaccard
from triloom.llm.common import Bucketed, materialise
from triloom.llm.components import components
from triloom.llm.exact_dedup import exact_dedup
from triloom.llm.line_dedup import line_dedup
from triloom.llm.ngram_jaccard import _linked, _Words, jaccard_components, shingles, signatures
from triloom.llm.substring_dedup import MIN_BYTES, MIN_SENTENCES, pieces, substring_dedup

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


EDGES = [(1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "É" * 50), (6, "é" * 50), (7, "İK" + "x" * 60), (8, "x" * 20000), (None, "a null id"), (9, "same row"), (9, "same row")]


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000):
        for top in (n + 1, 1 << 20, 1 << 48):
            v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            assert (golomb.decode(golomb.encode(v)) == v).all()
    assert golomb.levels(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def line_reference(rows, min_chars=40, min_docs=5):
    key = lambda x: lower(x.strip(SPACE))
    held = {}
    for i, t in set(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    keeper = {k: max((-1 if i is None else i) for i in v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == (-1 if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(frame):
    rng = random.Random(3)
    common = ["This Line Is Common And Long Enough To Be Counted É", "another one that is common and long enough to count!", "short"]
    rows = [(i, "\n".join(rng.choice([rng.choice(common), lower(rng.choice(common)), f"  {rng.choice(common)}\t", f"only here {i} " * 4]) for _ in range(rng.randint(1, 6)))) for i in range(10, 60)]
    rows += EDGES + [(100 + i, "É" * 50) for i in range(5)]
    rows += [(i, f"a line in five rows of three documents, too few to go\nrow {k}") for k, i in enumerate((200, 200, 201, 202, 202))]
    rows += [(i, f"a line in five documents, one of them without an id\nrow {k}") for k, i in enumerate((None, None, 210, 211, 212, 213))]
    rows += [(220, "\n".join(f"line {k} of one very long document, of many lines" for k in range(5000)))]
    found = [(r["row"]["doc_id"], r["body"], r["n_lines"], r["n_dropped"]) for r in line_dedup(frame(rows)).collect()]
    key = lambda r: str(r)
    assert sorted(found, key=key) == sorted(line_reference(rows), key=key)


def test_line_dedup_empty(frame):
    assert line_dedup(frame([])).count() == 0


def test_exact_dedup(frame):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Aa", "aA", "É", "é", "", None, f"own {i}"])) for i in range(200)] + EDGES
    found = exact_dedup(frame(rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t or ""), []).append(i)
    want = []
    for i, t in rows:
        own = groups[lower(t or "")]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(lower(t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert exact_dedup(frame([])).count() == 0


def substring_reference(rows, min_sentences=MIN_SENTENCES, min_bytes=MIN_BYTES):
    """Every run of every length, not only the shortest sufficient ones."""
    norm = lambda p: b" ".join(p.lower().split())
    texts = {}
    for i, t in rows:
        texts.setdefault((i, t), [norm(p) for p in pieces(t) if p.strip()])
    runs = {}
    for (i, t), s in texts.items():
        for at in range(len(s)):
            for n in range(min_sentences, len(s) - at + 1):
                if sum(map(len, s[at : at + n])) >= min_bytes:
                    runs.setdefault((n, *s[at : at + n]), []).append((i, t, at))
    gone = {}
    for (n, *_), places in runs.items():
        first = min(places, key=lambda x: (-1 if x[0] is None else x[0], x[2]))
        for i, t, at in places:
            if (i, t, at) != first:
                gone.setdefault((i, t), set()).update(range(at, at + n))
    out = []
    for i, t in rows:
        number, kept = 0, b""
        for p in pieces(t):
            is_s = bool(p.strip())
            if not (is_s and number in gone.get((i, t), ())):
                kept += p
            number += is_s
        out.append((i, kept.decode() if (i, t) in gone else t, number, len(gone.get((i, t), ()))))
    return out


def test_substring_dedup(frame):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice(".!?")
    passage = " ".join(sentence(12) for _ in range(5))
    long = sentence(45)
    rows = []
    for i in range(10, 60):
        own = [sentence(rng.randint(1, 14)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            own.insert(rng.randint(0, len(own)), passage.upper() if i % 2 else passage)
        if i % 7 == 0:
            own.append(long)
        rows.append((i, rng.choice([" ", "\n", " \n"]).join(own)))
    rows += EDGES + [(200, rows[0][1]), (201, f"{passage} {passage}")]
    menu = "".join(rng.choice("Fish Rice Soup Tea".split()) + f" {k}!\n" for k in range(60))  # very short sentences
    cjk = "".join("".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(20)) + rng.choice("\u3002\uff01\uff1f") for _ in range(8))
    unbroken = " ".join(word() for _ in range(60))  # no sentence end
    rows += [(300 + i, f"{word()}. {x} {word()}") for i, x in enumerate((menu, cjk, unbroken, menu, cjk, unbroken))]
    rows += [(400, " ".join(sentence(9) for _ in range(400)))]
    for least in ((MIN_SENTENCES, MIN_BYTES), (3, 1)):
        found = [(r["row"]["doc_id"], r["body"], r["n_sentences"], r["n_removed"]) for r in substring_dedup(frame(rows), min_sentences=least[0], min_bytes=least[1]).collect()]
        short = [r for r in rows if r[0] != 400]  # nothing of it occurs twice, and all its runs are many
        assert sorted(map(str, (r for r in found if r[0] != 400))) == sorted(map(str, substring_reference(short, *least)))
        assert [r[3] for r in found if r[0] == 400] == [0]
        for i in (303, 304, 305):
            assert next(r for r in found if r[0] == i)[3] >= 3
    left = " ".join(r[1] or "" for r in found).lower()
    assert left.count(passage.split(".")[0].lower()) == 1
    assert substring_dedup(frame([])).count() == 0


def jaccard_reference(rows, threshold=75):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids, default=None)))
    return out


def near_copies(rng, n, length, edits, start):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(length)] = f"v{rng.randint(0, 10**6)}"
        out.append((start + i, " ".join(own)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(frame, seed):
    rng = random.Random(seed)
    rows = near_copies(rng, 120, 60, 6, 1000) + near_copies(rng, 60, 25, 2, 2000) + near_copies(rng, 40, 300, 14, 3000)
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(4000 + i, passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(2, 30)))) for i in range(60)]
    rows += [(5000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))) for i in range(40)]
    rows += [(6000 + i, f"Alone {i} " * 8) for i in range(10)] + [(7000, rows[0][1].upper())] + EDGES
    rng.shuffle(rows)
    found = [tuple(r) for r in jaccard_components(frame(rows)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, jaccard_reference(rows)))


def test_jaccard_empty(frame):
    assert jaccard_components(frame([])).count() == 0
    assert sorted(tuple(r) for r in jaccard_components(frame([(1, None), (2, " ")])).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(9)
    for size in (1, 2, 3, 5, 8, 15, 16, 17, 30, 33, 63, 70, 130, 500):
        for _ in range(30):
            a = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
            b = a[rng.random(len(a)) > 0.12]
            b = np.unique(np.concatenate([b, rng.integers(1, 1 << 63, int(rng.integers(0, size // 8 + 1)), dtype=np.uint64)]))
            levels = {t: int(rng.choice([2, 4, 7, 9, 11])) for t in np.union1d(a, b).tolist()}
            one = {t: (levels[t] if t in set(a.tolist()) & set(b.tolist()) else 1) for t in levels}
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= 75 * (len(a) + len(b) - common):
                for given in (levels, one):
                    x, y = (signatures(s, np.array([given[t] for t in s.tolist()])) for s in (a, b))
                    assert x & y, (size, len(a), len(b), common)


def test_linked_gives_a_spanning_set():
    rng = random.Random(2)
    rows = near_copies(rng, 50, 40, 3, 0)
    words = _Words()
    nodes = [(str(i).encode(), str(i).encode(), shingles(t.encode(), words)) for i, t in rows]
    assert len(_linked(nodes, nodes, 75)) <= 49
    found = _linked(nodes[::2], nodes[1::2], 75)
    assert found and all(int(a) % 2 == 1 and int(b) % 2 == 0 for a, b in found)
    assert _linked([], nodes, 75) == _linked(nodes, [], 75) == []


def test_jaccard_large_group_with_shared_passages(frame, monkeypatch):
    """5,000 near copies of a text, many of them too far from the pivot, and unlike texts that share a passage with them: nothing gathers in one task."""
    seen = []

    def spied(ties, threshold):
        seen.append(materialise(real(ties, threshold), "spied"))
        return seen[-1]

    real = ngram_jaccard._meetings
    monkeypatch.setattr(ngram_jaccard, "_meetings", spied)
    rng = random.Random(8)
    rows = near_copies(rng, 5000, 80, 5, 1000)
    passage = " ".join(rows[0][1].split()[:40])
    rows += [(i, passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(30))) for i in range(300)]
    found = {r["id"]: r["component_id"] for r in jaccard_components(frame(rows)).collect()}
    words, near = _Words(), {}
    sets = {i: set(shingles(t.encode(), words).tolist()) for i, t in rows}
    names = {i: found[i] for i, _ in rows}
    assert all(names[i] == i for i in range(300))  # a passage of half a text is no link
    for i, own in sets.items():
        if i >= 1000:
            near.setdefault(names[i], []).append(i)
    largest = max(near.values(), key=len)
    others = [i for i in sets if i >= 1000 and i not in set(largest)]
    assert 2000 < len(largest) < 4000  # copies with up to two changes or so
    for i in others[::10]:  # outside the large component: no link with any of it
        assert all(100 * len(sets[i] & sets[j]) < 75 * len(sets[i] | sets[j]) for j in largest)
    meet = seen[0].groupBy("tile", "slot").count().toPandas()["count"]
    assert len(meet) >= 20 and meet.max() <= 0.05 * meet.sum()


def test_jaccard_texts_leave_their_blocks_for_partners_only(frame, monkeypatch):
    """Copies of a set in many blocks are one set: its text and signatures stay where they are unless another set shares a signature, and move once then."""
    made = {}

    class Spied(Bucketed):
        def __init__(self, df, column, tag):
            super().__init__(df, column, tag)
            made[tag] = self

    monkeypatch.setattr(ngram_jaccard, "Bucketed", Spied)
    rng = random.Random(10)
    copied = [" ".join(f"c{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(30)]
    first = [" ".join(f"p{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(10)]
    pairs = first + [t.rsplit(" ", 1)[0] + " end" for t in first]
    rows = list(enumerate(copied * 10 + pairs * 10))
    rng.shuffle(rows)
    found = [tuple(r) for r in jaccard_components(frame(rows)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, jaccard_reference(rows)))
    assert sorted(r["text"].decode() for r in made["texts"].files.collect()) == sorted(pairs)
    assert "text" not in made["signatures"].files.columns
    both = set(jaccard_components(frame(rows * 2)).collect())  # rows that repeat, and blocks that may
    assert {tuple(r) for r in both} == set(found)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    found = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert found == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
