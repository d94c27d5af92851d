"""SimHash near-duplicate groups through a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; the bit counts
of the segments are a point of the grid {0,1,2}^32, and the Manhattan distance
of two points never exceeds the Hamming distance of the fingerprints. The
points are range-joined on the grid: fingerprints within ``max_bits`` = d bits
have, in one of ``B = d // 2 // 1`` halves of the segments, grid points within
``d // 2``, hence a common grid cell within ``ceil(d / 4)`` of both. Each
distinct fingerprint is shipped to those cells (about 50 rows), candidates
meet in a cell and are verified on all 64 bits.

A cell with more than ``cell_limit`` fingerprints is not compared at all: its
members go to an exact linear path, where two fingerprints are linked when
they share a 64-bit word within ``d / 2`` flipped bits of both. A word
has at most 2,081 such fingerprints, so no group there can grow.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, small
from .components import components

SEED = 42
SEGMENTS = 32


def _votes(hashes):
    """Fingerprint of shingle hashes: each bit that is set in over half of them."""
    import numpy as np

    n = len(hashes)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i:i + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((2 * total > n), bitorder="little").view(np.int64)[0]


def _fingerprint(text, k):
    import numpy as np
    import xxhash

    h64 = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return 0
    norm = b" ".join(words)
    if n <= k:
        return _votes(np.array([h64(norm, SEED)], np.uint64))
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    return _votes(np.array([h64(norm[a:b], SEED) for a, b in zip(start, end[k - 1:].tolist())], np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 4, keys=("doc_id",)) -> DataFrame:
    """``keys`` + ``fp`` (the 64 bits as a signed long) of every whole text; a null text counts as empty."""
    rows = pick(docs, *keys, "text")

    def run(batches):
        import pyarrow as pa

        for rb in small(batches):
            at = rb.num_columns - 1
            fp = [int(_fingerprint(t, shingle)) if t else 0 for t in rb.column(at).to_pylist()]
            yield pa.record_batch([*rb.columns[:at], pa.array(fp, pa.int64())], names=[*rb.schema.names[:at], "fp"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", fp long")


def _cells(max_bits):
    """Arrow mapper: distinct fp -> (cell, fp) for all grid cells within the shared radius."""
    radius = max_bits // 2                # of one half, by the pigeonhole principle
    ship = (radius + 1) // 2              # a common cell of two points at most `radius` apart

    def run(batches):
        import numpy as np
        import pyarrow as pa

        half = SEGMENTS // 2
        power = 3 ** np.arange(half, dtype=np.int64)
        for rb in batches:
            fp = rb.column(0).to_numpy(zero_copy_only=False)
            u = fp.view(np.uint64)
            one = u - ((u >> np.uint64(1)) & np.uint64(0x5555555555555555))       # bit counts of the 2-bit segments
            point = np.stack([((one >> np.uint64(2 * i)) & np.uint64(3)).astype(np.int64) for i in range(SEGMENTS)], 1)
            for side in (0, 1):
                own = point[:, side * half:(side + 1) * half]
                frontier = [(own, np.arange(len(fp)), np.zeros(len(fp), np.int64))]
                cells, rows = [own @ power], [np.arange(len(fp))]
                for _ in range(ship):     # one more step per round; steps go on in segment order, so no cell repeats
                    new = []
                    for p, who, least in frontier:
                        for i in range(half):
                            for step in (-1, 1):
                                ok = (least <= i) & (p[:, i] + step >= 0) & (p[:, i] + step <= 2)
                                if ok.any():
                                    q = p[ok].copy()
                                    q[:, i] += step
                                    cells.append(q @ power)
                                    rows.append(who[ok])
                                    if ship > 1:
                                        new.append((q, who[ok], np.full(len(q), i, np.int64)))
                    frontier = new
                cell = np.concatenate(cells) * 2 + side
                yield pa.record_batch([pa.array(cell), pa.array(fp[np.concatenate(rows)])], names=["cell", "fp"])

    return run


def _tree(f, max_bits):
    """Spanning forest of the links in one cell: search from a member through those not yet reached."""
    import numpy as np

    out_a, out_b = [], []
    left, todo = f, []
    while left.size:
        if not todo:
            todo, left = [left[0]], left[1:]
            continue
        x = todo.pop()
        near = np.bitwise_count(left ^ x) <= max_bits
        if near.any():
            hit = left[near]
            out_a.append(np.full(len(hit), x))
            out_b.append(hit)
            todo.extend(hit)
            left = left[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _links(max_bits, cell_limit, small=48):
    """Arrow mapper over rows sorted by cell -> (hot, a, b): verified links, or members of an oversized cell."""

    def verified(c, f):
        import numpy as np

        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(first, len(c)))
        per_row = np.repeat(size, size)
        few = (per_row > 1) & (per_row <= small)
        sc, sf = c[few], f[few]
        a, b = [], []
        for d in range(1, small):
            if d >= len(sc):
                break
            near = (sc[d:] == sc[:-d]) & (np.bitwise_count(sf[d:] ^ sf[:-d]) <= max_bits)
            a.append(sf[:-d][near])
            b.append(sf[d:][near])
        for s, n in zip(first[size > small].tolist(), size[size > small].tolist()):
            x, y = _tree(f[s:s + n], max_bits)
            a.append(x)
            b.append(y)
        none = np.zeros(0, np.uint64)
        return np.unique(np.stack([np.concatenate(a or [none]), np.concatenate(b or [none])], 1), axis=0)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def made(hot, a, b):
            return pa.record_batch([pa.array(np.full(len(a), hot)), pa.array(np.ascontiguousarray(a).view(np.int64)),
                                    pa.array(np.ascontiguousarray(b).view(np.int64))], names=["hot", "a", "b"])

        held_c, held_f, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for rb in itertools.chain(batches, [None]):
            if rb is not None:
                c = np.concatenate([held_c, rb.column(0).to_numpy(zero_copy_only=False)])
                f = np.concatenate([held_f, rb.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            else:
                c, f = held_c, held_f
            if hot is not None and len(c):
                n = int(np.searchsorted(c, hot, "right"))
                if n:
                    yield made(True, f[:n], f[:n])
                c, f = c[n:], f[n:]
                if len(c):
                    hot = None
            at = 0 if not len(c) else len(c) if rb is None else int(np.searchsorted(c, c[-1], "left"))
            if at:
                e = verified(c[:at], f[:at])
                if len(e):
                    yield made(False, e[:, 0], e[:, 1])
            held_c, held_f = c[at:], f[at:]
            if len(held_c) > cell_limit:
                hot = held_c[0]
                yield made(True, held_f, held_f)
                held_c, held_f = held_c[:0], held_f[:0]

    return run


def _midpoints(max_bits):
    """Arrow mapper: fp -> (word, fp) for all 64-bit words within half of ``max_bits`` flipped bits."""
    half = (max_bits + 1) // 2
    masks = [sum(1 << i for i in bits) for n in range(half + 1) for bits in itertools.combinations(range(64), n)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        flips = np.array(masks, np.uint64)
        for rb in batches:
            fp = rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 512):
                part = fp[i:i + 512]
                word = (part[:, None] ^ flips[None, :]).ravel()
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))],
                                      names=["word", "fp"])

    return run


def link_fingerprints(fps: DataFrame, max_bits: int = 4, cell_limit: int = 50_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within ``max_bits`` bits.

    Inside one cell only a spanning forest of the links is emitted, so a large
    group yields a number of rows in proportion to its size. All links are
    exact; pairs within ``max_bits`` end up connected, others do not.
    """
    cells = fps.select("fp").distinct().mapInArrow(_cells(max_bits), "cell long, fp long")
    near = cells.repartition("cell").sortWithinPartitions("cell")
    found = cut(near.mapInArrow(_links(max_bits, cell_limit), "hot boolean, a long, b long").distinct())
    words = found.where("hot").select(F.col("a").alias("fp")).distinct().mapInArrow(_midpoints(max_bits), "word long, fp long")
    least = words.groupBy("word").agg(F.min("fp").alias("b"))
    if max_bits % 2:                      # halves of an odd distance overlap: check the pair itself
        least = words.select("word", F.col("fp").alias("b"))
    far = words.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    far = far.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return found.where("not hot").select("a", "b").union(far)


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, cell_limit: int = 50_000, keys=("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keys``, ``fp`` long, ``root`` (the smallest fingerprint of its component),
    ``component_id`` (smallest doc_id reachable).

    Null and word-less texts have fingerprint zero and are linked like any
    other. Repeated rows come back repeated; rows with a null id count in a
    group but never name it (the id is null where a group has no other). An
    empty table gives an empty result. Very long texts are hashed in chunks.
    """
    own = cut(fingerprints(docs, shingle, keys))
    groups = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(link_fingerprints(own, max_bits, cell_limit))
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = cut(rooted.join(least, "root").select("fp", "root", "component_id"))    # apart: a hot fingerprint's rows can be split
    return own.join(names, "fp").select(*keys, "fp", "root", "component_id")


def representatives(found: DataFrame) -> DataFrame:
    """(doc_id, key) of the one document that stays of each group of ``found``: the smallest id, ids before nulls."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    return found.groupBy("root").agg(first).select("first.doc_id", "first.key")
