import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vireo.llm import alignment, registry

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_align():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    name = {i: t for t, i in a.get_vocab().items()}

    def tokens(text):
        """(ids, ends) of both sides, or None."""
        if not text:
            return None
        whole, out = (" " + text).encode(), []
        for ids, value in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in name[i])),
                           (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            parts = [value(i) for i in ids]
            if b"".join(parts) != whole:
                return None
            out.append((ids, list(itertools.accumulate(map(len, parts)))))
        return out

    def links(both):
        (x, ex), (y, ey) = both
        bx, by = [0, *ex], [0, *ey]
        return [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if bx[i] < ey[j] and by[j] < ex[i]]

    def run(rows):
        both = [tokens(t) for _, t in rows]
        linked = [links(x) if x else [] for x in both]
        count = Counter(p for one in linked for p in set(one))
        best = {}
        for (x, _), n in count.items():
            best[x] = max(n, best.get(x, 0))
        out = []
        for (doc_id, _), x, one in zip(rows, both, linked):
            if not x:
                out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
                continue
            (ia, ea), (ib, eb) = x
            ends = sorted(set(ea) & set(eb))
            side = lambda ids, e: [[str(i) for i, z in zip(ids, e) if lo < z <= hi] for lo, hi in zip([0, *ends], ends)]
            said = ";".join(f"{','.join(p)}|{','.join(q)}" for p, q in zip(side(ia, ea), side(ib, eb)))
            out.append((doc_id, len(ia), len(ib), len(ends), len(one), sum(count[p] == best[p[0]] for p in one), sum(count[p] for p in one),
                        hashlib.sha256(said.encode()).hexdigest()))
        return Counter(out)

    return run


def got(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha"]
    return Counter((*r[:7], r[7].hex() if r[7] else "") for r in df.select(cols).collect())


ODD = ["plain words, and more words", "a  b", " lead", "trail ", "a \n b\nc\td", "don't we'll I'm", "x y　z", "<s> </s> <|endoftext|> <unk>", "▁ under", "a▁b",
       "nul\x00byte \x1c \x85", "été ﬁn ½ ²³ 你好 世界 🙂👍🏽", "\n", " ", "  ", "1234567890 3.14", "a" * 3000, "᠎ ᠎a", "tab \tx", "wörd​​x ‑", "한국어 텍스트", "c\r\nd e"]


def test_alignment_matches_plain_code(frame, plain_align):
    rng = random.Random(2)
    alphabet = ["a", "bc", " ", " ", "  ", "\n", "é", "你", "'s", "<s>", "1", ".", " ", "▁", "ing", "THE"]
    texts = [*ODD, *ODD[:5], *("".join(rng.choice(alphabet[:-3] + ["the", "word"]) for _ in range(rng.randrange(30))) for _ in range(150))]
    assert got(alignment.align(frame(texts, parts=5), A, B)) == plain_align(list(enumerate(texts)))


def test_ranges_of_numbers_give_the_same(frame, plain_align, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 64)
    monkeypatch.setattr(alignment, "BUCKET", 100)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    texts = [f"Some sentence number {i % 7} about thing{i} and {'x' * (i % 5)}!" for i in range(60)]
    assert got(alignment.align(frame(texts, parts=5), A, B, most_slots=128)) == plain_align(list(enumerate(texts)))


def test_odd_rows(odd, none, plain_align):
    rows = [(r["doc_id"], r["text"][:4000] if r["text"] else r["text"]) for r in odd.collect()]
    short = odd.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert got(alignment.align(short, A, B)) == plain_align(rows)
    out = {r["doc_id"]: r for r in alignment.align(odd, A, B, with_groups=True).collect() if r["doc_id"]}
    assert out[6][1:] == out[7][1:] and out[6]["n_a"] > 40_000 and out[6]["groups"].count(";") == out[6]["n_groups"] - 1
    assert got(alignment.align(none, A, B)) == Counter()


def test_perfect_hash_numbers_every_key(spark):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 31, 30_000))
    rows = spark.createDataFrame([(int(k),) for k in keys], "pair long").repartition(4)
    for bucket in (1 << 20, 2000):
        alignment.BUCKET, old = bucket, alignment.BUCKET
        numbers = alignment.perfect_hash(rows)
        alignment.BUCKET = old
        assert len(numbers) == len(keys) and sorted(numbers(keys).tolist()) == list(range(len(keys)))
        other = np.setdiff1d(np.arange(5000), keys)
        assert (numbers(other) < len(keys)).all()


def test_query(spark, sf_small):
    out = registry.queries()["op11_alignment"](spark, sf_small)
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert all(r["n_best"] <= r["n_links"] <= r["count_sum"] and r["n_groups"] <= min(r["n_a"], r["n_b"]) for r in rows)
