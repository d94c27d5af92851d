import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vireo.llm import registry, setjoin

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain(rows, percent=90, k=3):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return Counter((doc_id, len(sets[i]), least.get(root(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def corpus(seed, n=160, most=70):
    """Texts of all sizes with copies that are edited more or less, chains of edits among them."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.65:
            words = rng.choice(out[-40:]).split(" ")
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
                i = rng.randrange(len(words) + 1)
                words[i:i + rng.choice([0, 1])] = [f"n{rng.randrange(10**6)}"] * rng.choice([0, 1])
        else:
            words = [f"w{rng.randrange(400)}" for _ in range(int(rng.choice([3, 12, 30, most]) * (0.3 + rng.random())))]
        out.append(" ".join(words))
    return out



@pytest.mark.parametrize("seed,percent,k", [(1, 90, 3), (2, 90, 3), (3, 80, 3), (4, 60, 2)])
def test_groups_match_brute_force(frame, seed, percent, k):
    texts = corpus(seed)
    want = plain(list(enumerate(texts)), percent, k)
    assert len({c for _, _, c in want}) < len(texts) - 20
    assert got(setjoin.similar_groups(frame(texts), k, percent)) == want


def test_sizes_at_the_limit(frame):
    """Sets of every size to 60 with as many tokens replaced, added or gone as just are or just are not allowed."""
    texts = []
    for n in range(1, 60):
        words = [f"s{n}x{i}" for i in range(n)]
        texts.append(" ".join(words))
        for cut in range(1, 1 + n // 8):
            texts += [" ".join(words[cut:]), " ".join(words[:-cut] + [f"s{n}y{cut}z{i}" for i in range(cut)]), " ".join(words + [f"s{n}e{cut}f{i}" for i in range(cut)])]
    rows = list(enumerate(texts))
    assert got(setjoin.similar_groups(frame(texts, parts=5), 1)) == plain(rows, 90, 1)


def test_every_similar_pair_shares_a_mark():
    """The index alone: each pair of similar sets has a key in common, in bands with and without neighbourhoods."""
    rng = random.Random(9)
    for sets in (10, 10 ** 9):                # many sets make neighbourhoods worth their rows
        begin = setjoin.starts(700)
        bands = [(lo, *setjoin.allocate(lo, hi, sets, 90)) for lo, hi in zip(begin, [*begin[1:], begin[-1] + 1])]
        texts, pairs = [], []
        for n in [*range(9, 60), 90, 141, 142, 200, 333, 600]:
            words = [f"a{rng.random()}" for _ in range(n)]
            for extra in range(0, n // 9 + 1, max(1, n // 30)):
                gone = rng.randrange(max(1, (n - 9 * extra) // 10 + 1))
                other = words[gone:] + [f"b{rng.random()}" for _ in range(extra)]
                a, b = set(words), set(other)
                if a != b and 100 * len(a & b) >= 90 * len(a | b):
                    pairs.append((len(texts), len(texts) + 1))
                    texts += [" ".join(words), " ".join(other)]
        marks = {}              # equal sets have marks once
        for out in setjoin._index(bands, 1, 90, 0)([pa.record_batch([pa.array(texts)], names=["text"])]):
            for n, (sid, m) in enumerate(zip(out.column("sid").to_pylist(), out.column("marks").to_pylist())):
                marks.setdefault(sid, set()).update(m)
                texts[n] = sid
        assert len(pairs) > 100 and all(marks[texts[i]] & marks[texts[j]] for i, j in pairs)


def test_tokens_of_a_slice():
    rows = pa.array([f"w{i} x{i % 3} y z w{i}" for i in range(40)] + [None, "", "one", "one two"])
    whole, parts = setjoin._tokens(rows, 3), [setjoin._tokens(rows.slice(a, 7), 3) for a in range(0, 44, 7)]
    assert np.array_equal(whole[1], np.concatenate([p[1] for p in parts]))
    assert np.array_equal(whole[0], np.concatenate([p[0] + 7 * i for i, p in enumerate(parts)]))


def test_large_group_of_near_copies_in_windows(frame, monkeypatch):
    """Two families under common keys: they stay apart, and no member is lost."""
    monkeypatch.setattr(setjoin, "FIRST_WINDOW", 2)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for family in range(3):
        own = base[:50] + [f"f{family}x{i}" for i in range(10)]
        for _ in range(25):
            words = list(own)
            words[rng.randrange(60)] = f"n{rng.random()}"
            texts.append(" ".join(words))
    assert got(setjoin.similar_groups(frame(texts))) == plain(list(enumerate(texts)))


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(setjoin.similar_groups(odd)) == plain(rows)
    assert got(setjoin.similar_groups(none)) == Counter()


def test_query_matches_brute_force(spark, sf_small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert got(registry.queries()["op12_set_join"](spark, sf_small)) == plain(rows)
