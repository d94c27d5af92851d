"""Document fingerprints by consistent weighted sampling.

Terms are pairs of neighbouring words (white-space separated, with a mark at
either end of the text), weighted by their count and told apart by 64-bit
hashes. For each of ``SAMPLES`` samples a term has r, c ~ Gamma(2, 1) and
b ~ U(0, 1). A term of weight w has t = floor(ln w / r + b), and
ln a = ln c - r (t + 1 - b); the term of least a is the sample. Two texts agree
in a sample with a probability that is the generalised Jaccard similarity of
their weights. The signature byte is a hash of the winning (term, t), and the
likeness is the share of equal bytes, less what chance adds.

The draws of a term come from its hash alone, whatever other terms there are.
At weight 1, a follows Exp(1) and is independent of y = exp(-r b), which is
uniform, and z = c / a follows 1 + Exp(1) / a. So a is drawn first, as
-ln(1 - u), with u from tabulation hashing: three parts of the hash choose rows
of random 32-bit numbers, which are added. A term of weight 1 needs no more than
u, as the least a has the least u. For a greater weight s = -ln y and the
Exp(1) of z are drawn likewise from tables of their own, and r = s + ln z,
c = a z, b = s / r have the stated distributions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small

SAMPLES = 128
SEED = 20_16
PART = 12            # bits of a term's hash that choose a row of one table

_DRAWN: dict = {}


def _draws():
    """Three tables of random 32-bit numbers for each draw, a row of SAMPLES for each part (the same in every worker; 19 MB)."""
    import numpy as np

    if not _DRAWN:
        rng = np.random.Generator(np.random.Philox(SEED))
        for draw in ("a", "s", "z"):
            _DRAWN[draw] = [rng.integers(0, 1 << 32, (1 << PART, SAMPLES), dtype=np.uint32) for _ in range(3)]
    return _DRAWN


def _terms(text):
    """64-bit hashes of the pairs of neighbouring words."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").split()
    h64 = xxhash.xxh3_64_intdigest
    h = np.empty(len(words) + 2, np.uint64)
    h[0], h[-1] = 1, 2
    h[1:-1] = [h64(w) for w in words]
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pair ^= pair >> np.uint64(29)
    pair *= np.uint64(0xBF58476D1CE4E5B9)
    return pair ^ (pair >> np.uint64(32))


def _numbers(term, draw):
    """The numbers u of a draw, (terms, SAMPLES)."""
    import numpy as np

    made = None
    for i, rows in enumerate(_draws()[draw]):
        part = rows[((term >> np.uint64(i * PART)) & np.uint64((1 << PART) - 1)).astype(np.int64)]
        made = part if made is None else np.add(made, part, out=made)
    return made


def _exponential(u):
    """a ~ Exp(1) for 32-bit numbers u, rising with u."""
    import numpy as np

    return -np.log1p((u + 0.5) * -(2.0 ** -32))


def _weighted(term, weight):
    """a and an integer for (term, t), each (terms, SAMPLES), of terms of the given weights; at t = 0 the integer is u."""
    import numpy as np

    u = _numbers(term, "a")
    a, s = _exponential(u), _exponential(_numbers(term, "s"))
    lnz = np.log1p(_exponential(_numbers(term, "z")) / a)
    r = s + lnz
    t = np.floor((np.log(weight)[:, None] + s) / r)
    t[weight == 1] = 0
    a = np.where(t > 0, a * np.exp(lnz + s - r * (t + 1)), a)
    return a, u + t.astype(np.uint32) * np.uint32(0x9E3779B1)


def signature(text):
    """SAMPLES bytes; the text is split in words as it stands."""
    import numpy as np

    term, weight = np.unique(_terms(text), return_counts=True)
    one, heavy, weight = term[weight == 1], term[weight > 1], weight[weight > 1].astype(np.float64)
    found = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(one), 256):
        np.minimum(found, _numbers(one[i:i + 256], "a").min(axis=0), out=found)
    least = _exponential(found) if len(one) else np.full(SAMPLES, np.inf)
    every = np.arange(SAMPLES)
    for i in range(0, len(heavy), 256):
        a, kind = _weighted(heavy[i:i + 256], weight[i:i + 256])
        at = a.argmin(axis=0)
        less = a[at, every] < least
        least, found = np.where(less, a[at, every], least), np.where(less, kind[at, every], found)
    found = (found ^ (found >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    found = (found ^ (found >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (found >> np.uint32(24)).astype(np.uint8)


def likeness(a, b):
    """Estimated generalised Jaccard similarity of two signatures, 0 to 1."""
    same = float((a == b).mean())
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def fingerprints(docs: DataFrame, keys=("doc_id",)) -> DataFrame:
    """``keys`` + fingerprint (binary) of every whole text; null counts as empty, equal texts have equal fingerprints."""
    rows = pick(docs, *keys, "text")
    kinds = dict(rows.dtypes)

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            at = rb.num_columns - 1
            made = [signature(t or "").tobytes() for t in rb.column(at).to_pylist()]
            yield pa.record_batch([*rb.columns[:at], pa.array(made, pa.binary())], names=[*rb.schema.names[:at], "fingerprint"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", fingerprint binary")


def edited(text, following):
    """The last half of the code points replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def _ranges(batches):
    """Ordered (null, value) rows of a partition -> its first row without and its first with an id."""
    import pyarrow as pa
    import pyarrow.compute as pc

    left = {True, False}
    for rb in batches:
        for kind in list(left):
            at = pc.index(rb.column(0), pa.scalar(kind)).as_py()
            if at >= 0:
                left.discard(kind)
                yield rb.slice(at, 1)
        if not left:
            break


def _assign(known, null):
    """(doc_id, value, text) -> (grp, copy, doc_id, value, packed text), with the copies of first rows.

    ``known`` and ``null``: sorted first values of the ranges with and without an id; ranges
    without come first.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        first = {True: np.array(null, np.int64), False: np.array(known, np.int64)}
        total = len(known) + len(null)
        for rb in small(batches):
            value = rb.column(1).to_numpy(zero_copy_only=False)
            empty = rb.column(0).is_null().to_numpy(zero_copy_only=False)
            grp = np.where(empty, np.searchsorted(first[True], value, "right") - 1,
                           len(null) + np.searchsorted(first[False], value, "right") - 1)
            lead = np.where(empty, np.isin(value, first[True]), np.isin(value, first[False]))
            take = np.concatenate([np.arange(len(value)), np.flatnonzero(lead)])
            grp = np.concatenate([grp, (grp[lead] - 1) % total])
            copy = np.arange(len(take)) >= len(value)
            packed = [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in rb.column(2).to_pylist()]
            yield pa.record_batch([pa.array(grp), pa.array(copy), rb.column(0).take(pa.array(take)), pa.array(value[take]),
                                   pa.array([packed[i] for i in take.tolist()], pa.binary())],
                                  names=["grp", "copy", "doc_id", "value", "packed"])

    return run


RESULT = ("doc_id long, n_chars long, edited_sha binary, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double")


def _compare(batches):
    """Rows (grp, copy, doc_id, packed text) in order -> each own row compared with the row after it."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    group, held, out = None, None, []

    def done(doc_id, text, sig, after, nsig):
        new = edited(text, after)
        esig = sig if new == text else nsig if new == after else signature(new)
        return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest(),
                sig.tobytes(), esig.tobytes(), likeness(sig, esig), likeness(sig, nsig))

    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        cols = zip(*rows) if rows else [[]] * len(kinds)
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                               names=["doc_id", "n_chars", "edited_sha", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for rb in batches:
        for grp, copy, doc_id, packed in zip(*[c.to_pylist() for c in rb.columns]):
            if grp != group:
                group, held = grp, None
            if copy and held is None:           # a further copy of a repeated first id
                continue
            text = unpack(packed).decode("utf-8", "surrogatepass")
            sig = signature(text)
            if held is not None:
                out.append(done(*held, text, sig))
            held = None if copy else (doc_id, text, sig)
            if len(out) >= 512:
                yield batch(out)
                out = []
    yield batch(out)


def compare_neighbours(docs: DataFrame, rows_per_range: int = 4096) -> DataFrame:
    """Each document against its edited self and against the next one in ascending doc_id.

    Columns doc_id, n_chars, edited_sha, fingerprint, edited_fingerprint
    (binary), near_edited, near_next. The ids are cut into ranges of about
    ``rows_per_range`` rows; the first row of each range is copied behind the
    range before it (and the very first behind the last), so that ranges can
    be worked on apart; texts move once, compressed. Rows that share an id
    follow each other by the hash of their text, rows without an id come first
    in that order. Null texts count as empty. A single row is its own next; an
    empty table gives an empty result.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("value"), "text")
    keys = rows.select(F.col("doc_id").isNull().alias("null"), "value")
    parts = max(1, -(-pick(docs, "doc_id").count() // rows_per_range))
    keys = keys.repartitionByRange(parts, F.desc("null"), "value").sortWithinPartitions(F.desc("null"), "value")
    first = keys.mapInArrow(_ranges, keys.schema).collect()       # two rows at most for each range
    known, null = (sorted({r["value"] for r in first if r["null"] == x}) for x in (False, True))
    out = rows.mapInArrow(_assign(known, null), "grp long, copy boolean, doc_id long, value long, packed binary")
    out = out.repartition(parts, "grp").sortWithinPartitions("grp", "copy", "value", F.xxhash64("packed"))
    return out.select("grp", "copy", "doc_id", "packed").mapInArrow(_compare, RESULT)
