import random
import re
import zlib
from collections import Counter

from vireo.llm import registry, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, one_in=97):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, one_in=97):
    words = plain_counts(rows, one_in)
    out, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(others), words[best] if form[w] else None)
    result = set()
    for w, (n, k, fn) in out.items():
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, n, k, fn))
    return result


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def texts(seed, n=240):
    rng = random.Random(seed)
    base = ["letter", "latter", "ladder", "better", "bitter", "aabbcc", "aabbc", "aaaaa", "aaaaaa", "straße", "Ärger", "ärger", "×÷×÷×", "étude", "ABCDEF"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(12)):
            w = rng.choice(base)
            if rng.random() < 0.4:
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abeé") + w[i:], w[:i] + rng.choice("abeé") + w[i + 1:]])
            words.append(w)
        out.append(rng.choice([" ", "-", "1", "\n"]).join(words))
    return out


def test_variants_match_brute_force(frame):
    rows = list(enumerate(texts(5)))
    want = plain(rows)
    assert len(want) > 40 and any(w[1] for w in want)
    assert got(spelling.variants(frame([t for _, t in rows]), one_in=97)) == want


def test_variants_without_slips_and_other_limits(frame):
    rows = list(enumerate(texts(8, 60)))
    assert got(spelling.variants(frame([t for _, t in rows]))) == plain(rows, None)


def test_variants_of_odd_rows(odd, none, frame):
    assert got(spelling.variants(odd, one_in=97)) == plain([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert got(spelling.variants(none, one_in=97)) == set()
    assert got(spelling.variants(frame([None, "", "1 2 3"]), one_in=97)) == set()


def test_chain_of_forms_ends_at_its_root(frame):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbb"]
    text = " ".join(" ".join([w] * (3 * 2 ** i)) for i, w in enumerate(chain))
    out = {r["word"]: r for r in spelling.variants(frame([text])).collect()}
    assert {r["root"] for r in out.values()} == {"bbbbbb"}
    assert [out[w]["form"] for w in chain] == [*chain[1:], None]


def test_query_covers_the_table(spark, sf_small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    out = registry.queries()["op13_spelling"](spark, sf_small)
    assert got(out) == plain(rows)
