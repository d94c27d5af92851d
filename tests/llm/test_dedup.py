import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from vireo.llm import exact, passages, simhash
from vireo.llm.components import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(UPPER)


def union(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", norm(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def plain_components(ids, fps, d):
    fps = np.array(fps, np.uint64)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= d]
    root = union(len(fps), pairs)
    least = defaultdict(list)
    for i, r in zip(ids, root):
        least[r].append(i)
    return [min((x for x in least[r] if x is not None), default=None) for r in root]


@pytest.mark.parametrize("in_one", [50, 1_000_000])
def test_components_match_union_find(spark, monkeypatch, in_one):
    monkeypatch.setattr("vireo.llm.components.IN_ONE", in_one)
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(700, x) for x in range(701, 760)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(800, pairs)
    assert got == {x: r for x, r in enumerate(want) if x != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(0, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            if copy:
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy).upper() if rng.random() < 0.5 else " ".join(copy))
    return texts


def test_fingerprints_and_groups_match_brute_force(frame):
    texts = near_texts()
    ids = list(range(100, 100 + len(texts)))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(texts, ids)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(ids, fps, 4)
    assert [got[i]["fp"] % (1 << 64) for i in ids] == fps
    assert [got[i]["component_id"] for i in ids] == want
    assert len(set(want)) < len(ids)


@pytest.mark.parametrize("limit", [3, 50_000])
def test_links_of_close_fingerprints_are_complete_either_way(spark, limit):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set()
    for c in centre.tolist():
        for _ in range(40):
            x = c
            for b in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = simhash.link_fingerprints(rows, 4, cell_limit=limit).collect()
    at = {x: i for i, x in enumerate(fps)}
    pairs = [(at[r["a"] % (1 << 64)], at[r["b"] % (1 << 64)]) for r in links]
    arr = np.array(fps, np.uint64)
    assert all(np.bitwise_count(arr[a] ^ arr[b]) <= 4 for a, b in pairs)
    every = [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(arr[i] ^ arr[j]) <= 4]
    assert union(len(fps), pairs) == union(len(fps), every)


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    zero = [r for r in rows if r["fp"] == 0]
    assert {r["doc_id"] for r in zero} == {1, 2, 3, None} and {r["component_id"] for r in zero} == {1}
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["component_id"] == by[5]["component_id"] == 4 and by[6]["component_id"] == by[7]["component_id"] == 6
    assert sum(r["doc_id"] == 8 for r in rows) == 2
    assert simhash.near_duplicates(none).count() == 0


def test_rice_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (7, 1 << 48), (1000, 1 << 47), (1000, 3000), (3, 4)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64)) + np.uint64(1000)
        k, unary, rest = exact.rice_encode(v, 1000)
        assert (exact.rice_decode(len(v), k, unary, rest, 1000) == v).all()
    dense = np.arange(5, 5000, dtype=np.uint64)
    assert sum(map(len, exact.rice_encode(dense, 5)[1:])) < 1500        # about two bits each


def test_exact_groups_match_brute_force(frame):
    rng = random.Random(2)
    texts = [rng.choice(["hot text"] * 3 + [f"T{rng.randrange(60)} É", f"t{rng.randrange(60)} É", f"t{rng.randrange(60)} é", "", None]) for _ in range(400)]
    got = {r["doc_id"]: r for r in exact.exact_duplicates(frame(texts, parts=7)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    assert len(got) == 400
    for t, g in groups.items():
        for i in g:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(g), len(g), i == max(g))
            assert bytes(got[i]["sha"]) == hashlib.sha256(t.encode()).digest()


def test_exact_odd_rows(odd, none):
    rows = exact.exact_duplicates(odd).collect()
    assert len(rows) == 11
    empty = [r for r in rows if r["doc_id"] in (1, 2, None) and r["group_size"] == 4 or r["group_size"] == 3]
    assert {r["keep_id"] for r in empty} == {2} and sum(r["kept"] for r in empty) == 1
    assert sum(r["kept"] for r in rows if r["doc_id"] == 8) == 1                  # repeated rows: one stays
    assert {r["doc_id"] for r in rows if r["group_size"] == 2 and r["kept"]} == {5, 7, 8}
    assert exact.exact_duplicates(none).count() == 0


def plain_repeats(texts, least=50):
    """(doc, word) covered by a window of `least` words that occurs elsewhere."""
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        w = (t or "").split()
        for p in range(len(w) - least + 1):
            seen[" ".join(w[p:p + least])].append((i, p))
    return {(i, p + k) for places in seen.values() if len(places) > 1 for i, p in places for k in range(least)}


def test_passages_match_brute_force(frame):
    rng = random.Random(4)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    shared = [words(n) for n in (49, 50, 51, 70, 120, 300)]
    texts = []
    for i in range(60):
        w = words(rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            w += rng.choice(shared) + words(rng.randrange(0, 30))
        texts.append(" ".join(w))
    texts += texts[:3] + [" ".join(shared[3])] * 5
    got = passages.repeated_passages(frame(texts, parts=6)).collect()
    covered = {(r["doc_id"], k) for r in got for k in range(r["first_word"], r["end_word"])}
    assert covered == plain_repeats(texts)
    assert all(r["n_words"] >= 50 for r in got)


def test_passages_behind_a_frequent_line(frame):
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    texts, lines = [], [words(n) for n in (20, 30, 34, 40)]
    for i in range(40):                                 # pairs that share words before the line, and nothing after it
        own = words(51 - len(lines[i % 4]))
        texts += [" ".join(words(40) + own + lines[i % 4] + words(40)) for _ in range(2)]
    texts += [" ".join(words(40) + lines[i % 4] + words(40)) for i in range(400)]
    rng.shuffle(texts)
    got = passages.repeated_passages(frame(texts, parts=6)).collect()
    assert {(r["doc_id"], k) for r in got for k in range(r["first_word"], r["end_word"])} == plain_repeats(texts)
    assert all(r["across"] for r in got)


def near_copies(rng, n=300):
    """Copies of a few texts with edits, which share most of their words with many others."""
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    bases, texts = [words(k) for k in (49, 50, 90, 300, 700)], []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(w))
            w[at:at + rng.randrange(3)] = words(rng.randrange(3))
        texts.append(" ".join(w * rng.choice((1, 1, 1, 2))))
    return texts


def test_passages_of_near_copies_write_little(spark, frame):
    texts = near_copies(random.Random(8))
    docs = frame(texts, parts=6)
    passages.repeated_passages(docs.limit(3)).collect()             # sets the folder
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    written = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    before = written()
    got = passages.repeated_passages(docs).collect()
    assert {(r["doc_id"], k) for r in got for k in range(r["first_word"], r["end_word"])} == plain_repeats(texts)
    assert written() - before < sum(map(len, texts)) / 10


def test_passages_of_hot_keys_are_the_same(frame, monkeypatch):
    texts = near_copies(random.Random(9))
    texts += texts[:20]
    docs = frame(texts, [*range(310), None, None, *range(8)], parts=6)
    found = sorted(map(repr, passages.repeated_passages(docs).collect()))
    for hot in (0, 60):                                 # all keys, some keys
        monkeypatch.setattr(passages, "HOT", hot)
        assert sorted(map(repr, passages.repeated_passages(docs).collect())) == found
    assert len(found) > 200


def test_recurring_windows_match_brute_force():
    rng = np.random.default_rng(3)
    n, width = 60, passages.AROUND
    key = rng.integers(0, 4, n)
    words = rng.integers(0, 1 << 32, (4, 5, width)).astype(np.uint32)[key, rng.integers(0, 5, n)]
    words[:, passages.BEFORE:passages.BEFORE + passages.PREFIX] = key[:, None]
    like = rng.integers(0, width, n)                    # words of another row of the key from some place on
    words = np.where(np.arange(width) < like[:, None], words, words[[rng.choice(np.flatnonzero(key == k)) for k in key]])
    row, pos, behind = rng.integers(0, 9, n), rng.integers(0, 60, n), rng.integers(16, 51, n)
    seen = defaultdict(list)
    for i in range(n):
        for r in range(passages.PREFIX, behind[i] + 1):
            if passages.LEAST - r <= pos[i]:
                seen[r, key[i], words[i, r - 16:r + 34].tobytes()].append(i)
    wanted = [[51, 0, False] for _ in range(n)]
    for (r, _, _), held in seen.items():
        for i in held if len(held) > 1 else ():
            w = wanted[i]
            w[:] = min(w[0], r), max(w[1], r), w[2] or len({row[j] for j in held}) > 1
    got = passages._recurring(key, row, pos, behind, words)
    assert [list(map(int, x)) for x in zip(*got)] == [list(map(int, w)) for w in wanted]
    assert 5 < sum(w[1] > 0 for w in wanted) < n


def test_passages_odd_rows(odd, none):
    got = passages.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["first_word"], r["end_word"], r["across"]) for r in got} == {(6, 0, 40_000, True), (7, 0, 40_000, True)}
    assert passages.repeated_passages(none).count() == 0
