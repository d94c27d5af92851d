"""Bounded-space online packing of token sequences.

Each partition keeps ``open_windows`` windows open. A document's ids fill whole
windows first; the rest is placed best-fit, in the fullest open window that
still holds it. When none does, the fullest window is topped up with the head
of the rest and emitted, and the tail goes on as a new item. At the end of a
partition the open windows are merged in order of fill, so at most one stays
short; those leftovers, one per partition, are merged in rounds of groups of
bounded size until one is left, which is cut at powers of two.
"""

from __future__ import annotations

import itertools
import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, pick, small

END = 1
GROUP = 256             # leftovers merged by one task in a round
CACHE = 500_000         # distinct pieces whose ids a worker keeps, about

# fixed values: how a tokenizer whose pieces are known to be independent takes words apart
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class _Index(dict):
    """Number of a piece of text; a new piece gets the next one."""

    def __missing__(self, piece):
        self[piece] = n = len(self)
        return n


class _Words:
    """Ids of texts through a cache of their pieces.

    A tokenizer that drops white space, composes, takes lower case and matches
    ``WORDS`` gives a text the ids of its pieces, in order, where pieces end at
    spaces, tabs and line ends, and between a letter and an ASCII mark or digit other
    than the apostrophe. Arrow finds the distinct pieces of a batch; Python sees only
    those. Texts that may hold the name of a special token, and all texts of other
    tokenizers, are encoded whole.
    """

    def __init__(self, path):
        import json
        import os
        import re

        import numpy as np
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # a task has one core; threads cost memory each
        self.np = np
        self.encoder = Tokenizer.from_file(path)
        spec = json.loads(self.encoder.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.cuts = (bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": WORDS}
                     and split.get("behavior") == "Removed" and split.get("invert") is True)
        vocab = self.encoder.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)           # ids that end a word
        if self.cuts:
            self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # lower-case letters need no normalising, and a string of them is taken apart at its spaces
        self.word = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
        if self.cuts:
            spec["normalizer"] = None
            split |= {"pattern": {"String": " "}, "invert": False}
            self.joined = Tokenizer.from_str(json.dumps(spec))
        self.kind = np.full(256, 3, np.uint8)                           # 0 space, 1 letter, 2 mark or digit, 3 other
        self.kind[33:127] = 2
        self.kind[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
        self.kind[ord("'")] = 3
        self.kind[[ord(c) for c in " \t\n"]] = 0
        self.breaks = np.zeros(16, bool)                                # 4 * kind + kind of the next byte
        self.breaks[[1, 2, 3, 4, 8, 12, 6, 9]] = True
        self.lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
        self.clear()

    def clear(self):
        self.index = _Index({b"": 0})              # no piece is empty: it stands for the closing id
        self.flat, self.start, self.size = array("I", [END]), array("q", [0]), array("q", [1])
        self.seen = self.np.zeros(CACHE, self.np.int32)          # how often a piece was looked up

    def shrink(self):
        """Forget all but the more frequent half of the pieces."""
        kept = self.np.argsort(-self.seen[:len(self.index)], kind="stable")[:CACHE // 2].tolist()
        pieces, flat, start, size = list(self.index), self.flat, self.start, self.size
        self.clear()
        for k in kept:
            if k:
                self.index[pieces[k]] = len(self.size)
                self.start.append(len(self.flat))
                self.size.append(size[k])
                self.flat.extend(flat[start[k]:start[k] + size[k]])

    def learn(self):
        """Give the new pieces their ids: words many in one string, where each ends with an id that closes a word."""
        np = self.np
        new = list(itertools.islice(self.index, len(self.size), None))
        start, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        words = [k for k, p in enumerate(new) if self.word(p)]
        joined = set(words)
        apart = [k for k in range(len(new)) if k not in joined]
        groups = [words[i:i + 64] for i in range(0, len(words), 64)]
        for i in range(0, len(groups), 64):
            texts = [b" ".join([new[k] for k in g]).decode() for g in groups[i:i + 64]]
            for g, e in zip(groups[i:i + 64], self.joined.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) != len(g) or ends[-1] != len(ids):
                    apart.extend(g)
                    continue
                size[g] = np.diff(ends, prepend=0)
                start[g] = len(self.flat) + ends - size[g]
                self.flat.frombytes(ids.tobytes())
        for i in range(0, len(apart), 4096):
            some = apart[i:i + 4096]
            for k, e in zip(some, self.encoder.encode_batch_fast([new[k].decode() for k in some], add_special_tokens=False)):
                start[k], size[k] = len(self.flat), len(e.ids)
                self.flat.extend(e.ids)
        self.start.frombytes(start.tobytes())
        self.size.frombytes(size.tobytes())

    def whole(self, text):
        return self.np.array([*self.encoder.encode(text, add_special_tokens=False).ids, END], self.np.uint32)

    def numbers(self, texts):
        """Numbers of the pieces of all texts in order, 0 after each text."""
        import pyarrow as pa

        np = self.np
        _, where, data = texts.buffers()
        ends = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
        ends = ends[1:] - ends[0]
        if not len(raw):
            return np.zeros(len(texts), np.int64)
        lower, kind = self.lower[raw], self.kind[raw]
        lead = np.flatnonzero(raw >= 0xC3)
        before = lead[(raw[lead] > 0xC3) & (lead > 0)] - 1
        lower[before] = raw[before]                                     # a combining mark may follow this letter
        lead = lead[raw[lead] == 0xC3]
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1                                 # letters U+00C0 to U+00FF
        breaks = self.breaks[(kind[:-1] << 2) | kind[1:]]
        breaks[ends[(ends > 0) & (ends < len(raw))] - 1] = True
        cuts = np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(raw)]])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(lower)])
        coded = pieces.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.index.__getitem__, known), np.int64, len(known))
        return np.insert(at[coded.indices.to_numpy()], np.searchsorted(cuts[:-1], ends), 0)

    def ids(self, column):
        """One uint32 array per text of an Arrow column, with the closing id."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        if not self.cuts:
            return [self.whole(t) for t in texts.to_pylist()]
        if len(self.index) > CACHE * 3 // 4:
            self.shrink()
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(~special), np.flatnonzero(special)
        at = self.numbers(texts.take(pa.array(plain)) if len(rest) else texts)
        if len(self.index) > len(self.size):
            self.learn()
        flat, start, size = (np.frombuffer(x, k) for x, k in ((self.flat, np.uint32), (self.start, np.int64), (self.size, np.int64)))
        often = np.bincount(at, minlength=len(self.size))
        if len(often) > len(self.seen):
            self.seen = np.append(self.seen, np.zeros(len(often), np.int32))
        self.seen[:len(often)] += often.astype(np.int32)
        n = size[at]
        ends = np.cumsum(n)
        out = flat[np.repeat(start[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        parts = [None] * len(texts)
        for i, part in zip(plain.tolist(), np.split(out, ends[np.flatnonzero(at == 0)])):
            parts[i] = part
        for i in rest.tolist():
            parts[i] = self.whole(texts[i].as_py())
        return parts


def _slices(batches, rows=4096, most=1 << 23):
    """The batches in slices of at most ``rows`` rows and about ``most`` bytes of text; a longer text is alone."""
    import numpy as np
    import pyarrow.compute as pc

    for rb in small(batches, rows):
        ends = np.cumsum(pc.fill_null(pc.binary_length(rb.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < rb.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield rb.slice(at, to - at)
            at = to


class _Windows:
    """Open windows of one partition. A piece is (keys, start, ids, doc_tokens)."""

    def __init__(self, capacity, most):
        self.capacity, self.most = capacity, most
        self.open, self.fill = [], []      # pieces per window, and how full it is

    def add(self, keys, ids, total, start=0):
        """Yield windows that become full."""
        n = self.capacity
        while len(ids) - start >= n:
            yield [(keys, start, ids[start:start + n], total)]
            start += n
        rest = len(ids) - start
        while rest:
            best, most = -1, -1
            for i, x in enumerate(self.fill):
                if most < x <= n - rest:
                    best, most = i, x
            if best < 0 and len(self.open) < self.most:
                self.open.append([])
                self.fill.append(0)
                best = len(self.open) - 1
            take = rest
            if best < 0:
                best = self.fill.index(max(self.fill))
                take = n - self.fill[best]
            self.open[best].append((keys, start, ids[start:start + take], total))
            self.fill[best] += take
            start, rest = start + take, rest - take
            if self.fill[best] == n:
                self.fill.pop(best)
                yield self.open.pop(best)

    def finish(self):
        """Merge what is open, fullest first: yield full windows; the last may be short."""
        order = sorted(range(len(self.open)), key=lambda i: (-self.fill[i], i))
        yield from _merge([p for i in order for p in self.open[i]], self.capacity)


def _merge(pieces, capacity):
    """Join pieces and cut them every ``capacity`` ids."""
    window, fill = [], 0
    for keys, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, capacity - fill)
            window.append((keys, start + at, ids[at:at + take], total))
            at, fill = at + take, fill + take
            if fill == capacity:
                yield window
                window, fill = [], 0
    if window:
        yield window


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "turn", "short", "ids"]
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "turn int, short boolean, ids binary")


def _rows(windows, first, with_ids, capacity, last=False):
    """Arrow batch of pieces. A short window keeps its ids, to be merged later."""
    import numpy as np
    import pyarrow as pa

    rows = []
    for k, window in enumerate(windows, first):
        offset = 0
        short = not last and sum(len(p[2]) for p in window) < capacity
        for turn, (key, start, ids, total) in enumerate(window):
            raw = np.ascontiguousarray(ids, "<u4").tobytes()
            rows.append((key, start, len(ids), zlib.crc32(raw), total, k, offset, turn, short, raw if short or with_ids else None))
            offset += len(ids)
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.bool_(), pa.binary()]
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=NAMES)


def _pack(path, capacity, most, with_ids):
    """(doc_id, text) of one partition -> pieces."""

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        words, windows, full = kept(("words", path), lambda: _Words(path)), _Windows(capacity, most), []
        for rb in _slices(batches):
            for key, ids in zip(rb.column(0).to_pylist(), words.ids(rb.column(1))):
                full.extend(windows.add(key, ids, len(ids)))
            if len(full) >= 64:
                yield _rows(full, first, with_ids, capacity)
                first, full = first + len(full), []
        full.extend(windows.finish())
        if full:
            yield _rows(full, first, with_ids, capacity)

    return run


def _binary(window):
    """Cut a short window into windows whose lengths are powers of two: they need no padding."""
    left = sum(len(p[2]) for p in window)
    while left:
        size = 1 << (left.bit_length() - 1)
        first, *more = _merge(window, size)
        yield first
        window, left = [p for w in more for p in w], left - size


def _merge_groups(turn, capacity, with_ids, last):
    """Pieces of leftovers (grp, doc_id, start, doc_tokens, ids), in order -> pieces of merged windows."""

    def merged(group, pieces):
        windows = list(_merge(pieces, capacity))
        if last and sum(len(p[2]) for p in windows[-1]) < capacity:
            windows.extend(_binary(windows.pop()))
        return _rows(windows, (1 << 62) + (turn << 56) + (group << 24), with_ids, capacity, last)

    def run(batches):
        import numpy as np

        group, pieces = None, []
        for rb in batches:
            for g, key, start, total, ids in zip(*[c.to_pylist() for c in rb.columns]):
                if g != group:
                    if pieces:
                        yield merged(group, pieces)
                    group, pieces = g, []
                pieces.append((key, start, np.frombuffer(ids, "<u4"), total))
        if pieces:
            yield merged(group, pieces)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, open_windows: int = 64, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as
    little-endian unsigned 32-bit numbers, with ``with_ids``).

    ``tokenizer`` is the path of any ``tokenizers`` file. Every document ends with id 1, so an empty or null text is one id. Repeated
    rows are packed as often as they occur; a null doc_id stays null. All
    sequences hold ``capacity`` ids but for the last few, whose lengths are
    powers of two. An empty table gives an empty result.
    """
    rows = pick(docs, "doc_id", "text")
    done = cut(rows.mapInArrow(_pack(tokenizer, capacity, open_windows, with_ids), PIECES))
    out, short, turn = done.where("not short"), done.where("short"), 0
    while True:
        # in round r a group holds the leftovers of GROUP ** r neighbouring partitions
        number = F.shiftright("sequence_id", 33) if turn == 0 else F.shiftright("sequence_id", 24).bitwiseAND((1 << 32) - 1)
        top = short.agg(F.max(number)).first()[0]
        if top is None:
            break
        last = top < GROUP
        group = F.floor(number / GROUP).alias("grp")
        left = short.select(group, "doc_id", "start", "doc_tokens", "ids", "sequence_id", "turn")
        left = left.repartition("grp").sortWithinPartitions("grp", "sequence_id", "turn")
        merge = _merge_groups(turn, capacity, with_ids, last)
        merged = cut(left.drop("sequence_id", "turn").mapInArrow(merge, PIECES))
        out = out.union(merged.where("not short"))
        if last:
            break
        short, turn = merged.where("short"), turn + 1
    return out.select(*NAMES[:7], *(["ids"] if with_ids else []))
