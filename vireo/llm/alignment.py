"""Token alignment between two tokenizers, with corpus-wide counts of aligned id pairs.

Both tokenizers read space + text. Where tokens of both end at the same byte the
text is cut into groups; two tokens are linked when their byte ranges overlap.

The first pass aligns every document and adds up, within each task, how many
documents hold each id pair linked; the tasks' sparse counts are stored. A minimal
perfect hash function is built over the distinct pairs, in buckets that are
separate rows: levels of bit maps, a key at a level's bit if no other of the
level falls there, its number the rank of that bit. Each task then lays its
counts out as dense vectors indexed by that number, with the keys beside them
for verification, and the vectors are summed as a tree. The second pass aligns
the documents again and looks every link up, its key verified.

Neither tokenizer joins across a single space between two other characters, so
texts are cut there and every distinct piece of a batch is aligned once; a
tokenizer for which that is not known is given whole texts.

A lookup needs the vectors in memory. They are broadcast in ranges of at most
``most_slots`` numbers; a corpus with more pairs takes one second pass per range, with
the same result.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, pick, small

SLICE = 1 << 16         # numbers of one slice of a vector
FAN_IN = 32             # vectors that one task of the tree adds up
BUCKET = 200_000        # distinct pairs per bucket of the hash function, about
SPACE_BITS = 2          # bits of a level per key that it is left with
CACHE = 300_000         # pieces whose alignment a worker keeps
MOST_SLOTS = 1 << 23    # numbers looked up in one second pass: 16 bytes each

# fixed values: byte-level vocabularies write a byte as this character; the other bytes follow from U+0100 on
SHOWN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


class Pairing:
    """Aligns texts with two tokenizers: ``a``, a byte-level BPE file, and ``b``, a sentencepiece model."""

    def __init__(self, a, b, with_groups=True):
        import json
        import os
        import re

        import numpy as np
        import pyarrow as pa
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # a task has one core
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True            # their strings in a text are plain text
        hidden = [x for x in range(256) if x not in set(SHOWN)]
        byte = {chr(x): x for x in SHOWN} | {chr(256 + i): x for i, x in enumerate(hidden)}
        self.a_bytes = {i: bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
                        for token, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.wide = len(self.b_bytes)                  # key of a pair: a * wide + b
        self.with_groups = with_groups                 # the groups as text are wanted
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, x in self.a_bytes.items():
            self.a_size[i] = len(x)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.numbers = pa.array([str(i) for i in range(max(len(self.a_size), self.wide))])
        spec = json.loads(self.a.to_str())
        split = spec["pre_tokenizer"] or {}
        # no token of either crosses from a character that is no space to a space
        self.cuts = (spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", False)
                     and not split.get("add_prefix_space") and not any(re.search("[^▁]▁", p) for p in pieces))
        self.cut = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎]) (?=[^\s\x1c-\x1f\x85᠎])").split
        self.clear()

    def clear(self):
        import numpy as np

        self.index, self.said = {}, []
        self.facts, self.keys, self.start = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, pieces):
        """Align the pieces that are new, many in one string: their cuts are token ends of both tokenizers."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.index]
        whole = [p for p in new if not self.cuts or not p or p[0].isspace() or p[-1].isspace()]
        if whole:
            apart = set(whole)
            new = [p for p in new if p not in apart]
        groups = [new[i:i + 256] for i in range(0, len(new), 256)]
        for i in range(0, len(groups), 64):
            self.align(groups[i:i + 64])
        for i in range(0, len(whole), 1024):
            self.align([[p] for p in whole[i:i + 1024]])

    def align(self, groups):
        """Append the alignment of the groups' pieces; a group whose bytes the tokens do not give back is taken piece by piece."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = [" ".join(g) for g in groups]
        side_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        side_b = self.b.encode(texts, num_threads=1)
        good, bad = [], []
        for n, t in enumerate(texts):
            raw = b" " + t.encode()
            same = b"".join(map(self.a_bytes.__getitem__, side_a[n])) == raw and b"".join(map(self.b_bytes.__getitem__, side_b[n])) == raw
            (good if same else bad).append(n)
        if good:
            words = [p for n in good for p in groups[n]]
            a = np.fromiter(itertools.chain.from_iterable(side_a[n] for n in good), np.int64)
            b = np.fromiter(itertools.chain.from_iterable(side_b[n] for n in good), np.int64)
            end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            end_p = np.cumsum([1 + len(p.encode()) for p in words])
            ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
            ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]       # a link for every end: of the tokens that reach or pass it
            i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
            both = (end_a[i] == ends) & (end_b[j] == ends)
            common = ends[both]
            if (common[np.searchsorted(common, end_p)] != end_p).any():
                raise ValueError("a token crosses from a character that is no space to a space")
            per_piece = lambda e: np.bincount(np.searchsorted(end_p, e), minlength=len(words))
            facts = np.stack([per_piece(end_a), per_piece(end_b), per_piece(common), per_piece(ends), np.ones(len(words), np.int64)], 1)
            said = [None] * len(words)
            if self.with_groups:
                def lists(ids, where, n):
                    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], where]).astype(np.int32)), n.take(pa.array(ids)))

                sides = [pc.binary_join(lists(x, e[both] + 1, self.numbers), ",") for x, e in ((a, i), (b, j))]
                each = pc.binary_join_element_wise(*sides, "|")
                said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(facts[:, 2])]).astype(np.int32)), each), ";").to_pylist()
            self.add(words, facts, a[i] * self.wide + b[j], said)
        words = [p for n in bad for p in groups[n]]
        if words and len(words) > len(bad):
            self.align([[p] for p in words])
        elif words:
            n = [[len(side_a[i]), len(side_b[i]), 0, 0, 0] for i in bad]
            self.add(words, np.array(n, np.int64), np.zeros(0, np.int64), [""] * len(words))

    def add(self, words, facts, keys, said):
        import numpy as np

        self.index.update(zip(words, range(len(self.said), len(self.said) + len(words))))
        self.said.extend(said)
        self.facts = np.concatenate([self.facts, facts])
        self.keys = np.concatenate([self.keys, keys])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(facts[:, 3])])

    def pieces(self, column):
        """Texts -> (row, piece number) of all pieces in order, and the numbers' pieces."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), "")
        some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        # a space beside white space, or at an end, stays inside its piece
        odd = pc.match_substring_regex(texts, r"^ | $| [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
                                              r"|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] ")
        odd = odd.to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(some & ~odd) if self.cuts else np.zeros(0, np.int64)
        rest = np.flatnonzero(some & odd) if self.cuts else np.flatnonzero(some)
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        row = plain[pc.list_parent_indices(lists).to_numpy()]
        coded = lists.flatten().dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = coded.indices.to_numpy().astype(np.int64)
        more, own = {}, []
        for i in rest.tolist():
            text = texts[i].as_py()
            parts = self.cut(text) if self.cuts else [text]
            own.append(np.array([more.setdefault(p, len(known) + len(more)) for p in parts], np.int64))
        if own:
            row = np.concatenate([row, np.repeat(rest, [len(x) for x in own])])
            code = np.concatenate([code, *own])
            order = np.argsort(row, kind="stable")
            row, code = row[order], code[order]
        return row, code, known + list(more)

    def batch(self, column):
        """(row, piece number, facts per number (n_a, n_b, groups, links, ok), groups as text per number, links: start and keys)."""
        import numpy as np

        if len(self.index) > CACHE:
            self.clear()
        row, code, known = self.pieces(column)
        self.learn(known)
        at = np.fromiter(map(self.index.__getitem__, known), np.int64, len(known))
        facts = self.facts[at]
        start = np.concatenate([[0], np.cumsum(facts[:, 3])])
        bad = np.zeros(len(column), bool)
        bad[row[facts[code, 4] == 0]] = True            # bytes of the text that tokens do not give back: no tokens
        ok = ~bad[row]
        return row[ok], code[ok], facts, [self.said[i] for i in at.tolist()], start, self.keys[_spread(at, self.start)[0]]


def _pairing(a, b, with_groups):
    return kept(("pairing", a, b, with_groups), lambda: Pairing(a, b, with_groups))


def _spread(code, start):
    """Places of the links of each code in turn, and how many each has."""
    import numpy as np

    n = start[code + 1] - start[code]
    ends = np.cumsum(n)
    return np.repeat(start[code] - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0), n


def _count(a, b, at):
    """Arrow mapper: (.., text) -> (part, pair, n): in how many documents of the task a pair is linked."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, pairing = TaskContext.get().partitionId(), _pairing(a, b, False)
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rb in small(batches):
            row, code, _, _, start, linked = pairing.batch(rb.column(at))
            own, link = np.unique(linked, return_inverse=True)
            once = np.unique(row * len(start) + code)                  # a piece counts once for its document
            row, code = once // len(start), once % len(start)
            place, many = _spread(code, start)
            held = np.unique(np.repeat(row, many) * max(1, len(own)) + link[place])
            more = np.bincount(held % max(1, len(own)), minlength=len(own))
            every, to = np.unique(np.concatenate([keys, own]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            total[to[:len(keys)]] += n
            total[to[len(keys):]] += more
            keys, n = every[total > 0], total[total > 0]
        yield pa.record_batch([pa.array(np.full(len(keys), part)), pa.array(keys), pa.array(n)], names=["part", "pair", "n"])

    return run


def _hash(keys, seed):
    import numpy as np

    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(keys, buckets):
    import numpy as np

    return (_hash(keys, 1 << 20) % np.uint64(buckets)).astype(np.int64)


def _levels(keys):
    """Bit maps of the levels that give every key of a bucket a bit of its own."""
    import numpy as np

    out = []
    while len(keys):
        size = max(64, -(-len(keys) * SPACE_BITS // 64) * 64)
        at = (_hash(keys, len(out)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        out.append(np.packbits(alone, bitorder="little"))
        keys = keys[~alone[at]]
    return out


def _build(batches):
    """Arrow mapper over distinct (bucket, pair), sorted -> (bucket, level, bits)."""
    import numpy as np
    import pyarrow as pa

    def made(bucket, keys):
        bits = [x.tobytes() for x in _levels(np.concatenate(keys))]
        n = len(bits)
        return pa.record_batch([pa.array([bucket] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(bits, pa.binary())], names=["bucket", "level", "bits"])

    now, held = None, []
    for rb in batches:
        bucket, keys = (c.to_numpy(zero_copy_only=False) for c in rb.columns)
        for b in np.unique(bucket).tolist():
            if held and b != now:
                yield made(now, held)
                held = []
            now = b
            held.append(keys[bucket == b])
    if held:
        yield made(now, held)


class PerfectHash:
    """Numbers 0 .. n - 1 of the keys that it was built on; -1 or a wrong number, to be verified, for others."""

    def __init__(self, buckets, rows):
        import numpy as np

        self.buckets = buckets
        depth = max([r["level"] for r in rows], default=-1) + 1
        self.size, self.start = np.zeros((buckets, depth), np.int64), np.zeros((buckets, depth), np.int64)
        at, maps = 0, []
        for r in sorted(rows, key=lambda r: (r["bucket"], r["level"])):
            bits = np.frombuffer(bytes(r["bits"]), np.uint8)
            self.start[r["bucket"], r["level"]], self.size[r["bucket"], r["level"]] = at, 8 * len(bits)
            at += 8 * len(bits)
            maps.append(bits)
        self.words = np.concatenate([np.zeros(0, np.uint8), *maps]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def __len__(self):
        return int(self.before[-1])

    def __call__(self, keys):
        import numpy as np

        out, left = np.full(len(keys), -1), np.arange(len(keys))
        bucket = _bucket(keys, self.buckets)
        for level in range(self.size.shape[1]):
            left = left[self.size[bucket[left], level] > 0]
            if not len(left):
                break
            b = bucket[left]
            at = self.start[b, level] + (_hash(keys[left], level) % self.size[b, level].astype(np.uint64)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[word] + below)[hit]
            left = left[~hit]
        return out


def perfect_hash(counts: DataFrame) -> PerfectHash:
    """Over the distinct pairs of ``counts`` (pair): about 4 bits a pair, built in tasks of about ``BUCKET`` pairs."""
    pairs = cut(counts.select("pair").distinct())
    buckets = max(1, -(-pairs.count() // BUCKET))

    def dealt(batches):
        import pyarrow as pa

        for rb in batches:
            yield pa.record_batch([pa.array(_bucket(rb.column(0).to_numpy(zero_copy_only=False), buckets)), rb.column(0)], names=["bucket", "pair"])

    rows = pairs.mapInArrow(dealt, "bucket long, pair long").repartition("bucket").sortWithinPartitions("bucket")
    return PerfectHash(buckets, rows.mapInArrow(_build, "bucket long, level int, bits binary").collect())


def _add(vectors):
    """Sum of the counts and union of the keys of (counts, keys) slices."""
    import numpy as np

    n, keys = np.zeros(SLICE, np.int64), np.full(SLICE, -1, np.int64)
    for a, b in vectors:
        n += np.frombuffer(a, np.int64)
        keys = np.maximum(keys, np.frombuffer(b, np.int64))
    return n.tobytes(), keys.tobytes()


def _dense(numbers):
    """Arrow mapper over (part, pair, n), sorted by part -> (part, slice, counts, keys): a task's dense vector, in the slices that it needs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hash_of = numbers.value
        for part, rows in itertools.groupby(((p, rb) for rb in batches for p in np.unique(rb.column(0).to_numpy()).tolist()), key=lambda x: x[0]):
            slices = {}
            for _, rb in rows:
                own = rb.column(0).to_numpy() == part
                pair, n = rb.column(1).to_numpy()[own], rb.column(2).to_numpy()[own]
                slot = hash_of(pair)
                for s in np.unique(slot // SLICE).tolist():
                    here = slot // SLICE == s
                    counts, keys = slices.setdefault(s, (np.zeros(SLICE, np.int64), np.full(SLICE, -1, np.int64)))
                    counts[slot[here] % SLICE] += n[here]
                    keys[slot[here] % SLICE] = pair[here]
            for s, (counts, keys) in slices.items():
                yield pa.record_batch([pa.array([part]), pa.array([s]), pa.array([counts.tobytes()], pa.binary()), pa.array([keys.tobytes()], pa.binary())],
                                      names=["part", "slice", "counts", "keys"])

    return run


def _fold(batches):
    """Arrow mapper over (part, slice, counts, keys), sorted by slice and part -> one row for each (slice, part)."""
    import pyarrow as pa

    rows = (r for rb in batches for r in zip(*[c.to_pylist() for c in rb.columns]))
    for (part, s), group in itertools.groupby(rows, key=lambda r: r[:2]):
        counts, keys = _add((a, b) for _, _, a, b in group)
        yield pa.record_batch([pa.array([part], pa.int64()), pa.array([s], pa.int64()), pa.array([counts], pa.binary()), pa.array([keys], pa.binary())],
                              names=["part", "slice", "counts", "keys"])


def pair_vectors(counts: DataFrame, numbers: PerfectHash) -> DataFrame:
    """(slice, counts, keys): the dense vectors of all tasks of ``counts`` (part, pair, n), summed as a tree."""
    shared = counts.sparkSession.sparkContext.broadcast(numbers)       # about 4 bits a pair
    form = "part long, slice long, counts binary, keys binary"
    parts = (counts.agg(F.max("part")).first()[0] or 0) + 1
    vectors = cut(counts.mapInArrow(_dense(shared), form))
    while True:
        parts = -(-parts // FAN_IN)
        up = vectors.withColumn("part", F.floor(F.col("part") / FAN_IN)).repartition("part", "slice").sortWithinPartitions("part", "slice")
        vectors = cut(up.mapInArrow(_fold, form))
        if parts == 1:
            return vectors.select("slice", "counts", "keys")


class Counts:
    """Counts of the pairs numbered from ``first`` on, and the greatest count of each id of the first tokenizer."""

    def __init__(self, numbers, first, rows, best):
        import numpy as np

        self.numbers, self.first, self.best = numbers, first, best
        size = max([r["slice"] for r in rows], default=-1) + 1 - first // SLICE
        self.n, self.keys = np.zeros(max(0, size) * SLICE, np.int64), np.full(max(0, size) * SLICE, -1, np.int64)
        for r in rows:
            at = r["slice"] * SLICE - first
            self.n[at:at + SLICE], self.keys[at:at + SLICE] = np.frombuffer(r["counts"], np.int64), np.frombuffer(r["keys"], np.int64)

    def look_up(self, keys):
        """Counts of the keys, 0 for those that are numbered outside this range."""
        import numpy as np

        at = self.numbers(keys) - self.first
        here = (at >= 0) & (at < len(self.n))
        at = np.where(here, at, 0)
        if not len(self.n):
            return np.zeros(len(keys), np.int64)
        other = self.keys[at[here]] != keys[here]
        if other.any():
            raise ValueError(f"pairs of the second pass were not there in the first: {keys[here][other][:10].tolist()}")
        return np.where(here, self.n[at], 0)


def _score(a, b, at, shared, first, with_groups):
    """Arrow mapper: (keys.., text, n_best, count_sum) -> the same with n_best and count_sum added up; the other columns if ``first``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pairing, counts = _pairing(a, b, True), shared.value
        for rb in small(batches):
            row, code, facts, said, start, linked = pairing.batch(rb.column(at))
            # per piece, then per document; pieces of documents without tokens alone are not counted
            used = np.zeros(len(facts), bool)
            used[code] = True
            of = np.repeat(np.arange(len(facts)), facts[:, 3])
            of, linked = of[used[of]], linked[used[of]]
            n = counts.look_up(linked)
            top = (n > 0) & (n == counts.best[linked // pairing.wide])
            so_far = np.concatenate([[0], np.cumsum(n)])
            edge = np.searchsorted(of, np.arange(len(facts) + 1))
            per_sum = so_far[edge[1:]] - so_far[edge[:-1]]
            per_top = np.bincount(of[top], minlength=len(facts))

            ends = np.searchsorted(row, np.arange(rb.num_rows + 1))

            def total(values):
                so_far = np.concatenate([[0], np.cumsum(values[code])])
                return so_far[ends[1:]] - so_far[ends[:-1]]

            sums = [total(per_top) + rb.column(at + 1).to_numpy(), total(per_sum) + rb.column(at + 2).to_numpy()]
            cols, names = [*rb.columns[:at + 1]], rb.schema.names[:at + 3]
            cols += [pa.array(x) for x in sums]
            if first:
                codes, cuts = code.tolist(), ends.tolist()
                groups = [";".join(map(said.__getitem__, codes[x:y])) for x, y in zip(cuts, cuts[1:])]
                cols += [pa.array(total(facts[:, i])) for i in range(4)]
                cols.append(pa.array([hashlib.sha256(g.encode()).digest() if g else None for g in groups], pa.binary()))
                names = [*names, "n_a", "n_b", "n_groups", "n_links", "groups_sha"]
                if with_groups:
                    cols.append(pa.array(groups, pa.string()))
                    names.append("groups")
            else:
                cols += rb.columns[at + 3:]
                names = rb.schema.names
            yield pa.record_batch(cols, names=names)

    return run


def pair_counts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(part, pair, n): the first pass; ``pair`` is the first tokenizer's id x the second's vocabulary + the second's id."""
    return cut(pick(docs, "text").mapInArrow(_count(a, b, 0), "part long, pair long, n long"))


def align(docs: DataFrame, a: str, b: str, keys=("doc_id",), with_groups: bool = False, most_slots: int = MOST_SLOTS) -> DataFrame:
    """One row per row of ``docs``: ``keys``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha (SHA-256, null without
    tokens) and, ``with_groups``, the groups as text (``a1,a2|b1;a3|b2,b3``).

    ``a``: file of a byte-level BPE tokenizer, ``b``: of a sentencepiece model. A link's count is the number of rows that
    hold its id pair linked; n_best counts the links whose count is the greatest of their first id's. Null and empty texts, and
    those whose bytes the tokens of one of them do not give back, have no tokens and count nothing. Repeated rows count
    and come back as often as they occur; whole texts are read, however long; an empty table gives an empty result.
    """
    import numpy as np

    spark = docs.sparkSession
    counts = pair_counts(docs, a, b)
    numbers = perfect_hash(counts)
    vectors = pair_vectors(counts, numbers)
    own = Pairing(a, b)
    wide, best = own.wide, np.zeros(own.a.get_vocab_size(), np.int64)          # bounded by the first vocabulary

    def tops(batches):
        import pyarrow as pa

        for rb in batches:
            for n, k in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                n, k = np.frombuffer(n, np.int64), np.frombuffer(k, np.int64)
                ids, at = np.unique(k[k >= 0] // wide, return_inverse=True)
                top = np.zeros(len(ids), np.int64)
                np.maximum.at(top, at, n[k >= 0])
                yield pa.record_batch([pa.array(ids), pa.array(top)], names=["a", "top"])

    for r in vectors.select("counts", "keys").mapInArrow(tops, "a long, top long").groupBy("a").agg(F.max("top").alias("top")).collect():
        best[r["a"]] = r["top"]
    rows = pick(docs, *keys, "text")
    kinds = dict(rows.dtypes)
    form = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "text"]) + ", n_best long, count_sum long"
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    form += ", n_a long, n_b long, n_groups long, n_links long, groups_sha binary" + (", groups string" if with_groups else "")
    step = -(-most_slots // SLICE) * SLICE
    for at in range(0, max(1, len(numbers)), step):
        held = vectors.where((F.col("slice") >= at // SLICE) & (F.col("slice") < (at + step) // SLICE)).collect()      # at most most_slots numbers
        shared = spark.sparkContext.broadcast(Counts(numbers, at, held, best))
        rows = rows.mapInArrow(_score(a, b, len(keys), shared, at == 0, with_groups), form)
        if at + step < len(numbers):
            rows = cut(rows)             # a range's vectors are gone before the next one's come
    out = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha", *(["groups"] if with_groups else [])]
    return rows.select(*keys, *out)
