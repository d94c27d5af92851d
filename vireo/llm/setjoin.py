"""Exact Jaccard join of word n-gram sets through a partition of the universe.

A token (the hash of an n-gram) falls into one of m segments by a second hash,
so that a set is cut into m subsets. Sets that are similar enough differ in at
most H tokens, which cannot spoil all segments: by the pigeonhole principle
they agree on one, or differ there by a single token. m and the kind of index
depend on the size band:

* the first d segments are worth two: the subset and its one-deletion
  neighbourhood (the subset without each of its tokens) are indexed, so a
  segment that differs by one token is still met;
* the others are worth one: only the subset is indexed. A set uses those that
  are not empty, in order, until they and 2 d exceed the tokens that it may
  differ in; spare segments stand in for empty ones, which all sets would share.

d is allocated per band at the least cost: index rows against the pairs of
unrelated sets that are expected to meet, from the number of sets in the band.
Bands are half as wide again as they start; a set close above the start
of its band is indexed in the band below too.

Sets that meet under a key are linked as stars first: all with the least of
them. Candidates are verified exactly on all tokens, verified links contracted, and
only keys whose sets are still in several components are compared further,
in windows that grow fourfold, until every pair of sets under the key either is in one
component, or differs too much by its size or by the parities of 256 classes of tokens, or was verified. So a large group of near copies costs rows in proportion
to its size, and no link is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import ordered_prefix
from .common import cut, pick, small
from .components import components

WIDTH = 1.5             # end of a band over its start
SAME = 0.1              # for the cost: chance that a token of a set is one of an unrelated set too
FIRST_WINDOW = 64
SKETCH = ["z0", "z1", "z2", "z3"]       # 256 parities: they differ in no more places than the sets do
CELLS = 1 << 22         # segments that a task holds at once
SEED = 0x5851F42D


def starts(most: int) -> list[int]:
    """First sizes of the bands up to a set of ``most`` tokens."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * WIDTH)))
    return out


def may_differ(size: int, percent: int) -> int:
    """Most tokens that a set of ``size`` and a similar set that is no smaller differ in."""
    return size * (100 - percent) // percent


def allocate(lo: int, hi: int, sets: int, percent: int) -> tuple[int, int]:
    """(m, d) of the band of sizes lo .. hi - 1 that holds ``sets`` sets: segments, and those with neighbourhoods."""
    need = may_differ(hi - 1, percent) + 1
    if need == 1:
        return 0, 0                                 # only equal sets are similar, and those are one class
    best = None
    for d in range((need + 1) // 2 + 1):
        single = max(0, need - 2 * d)
        m = d + single + (single + 3) // 4          # a quarter to spare
        k = (lo + hi) / 2 / m
        rows = sets * (d * (k + 1) + single)
        meet = sets * sets / 2 * (single * SAME ** max(k, 1) + d * (2 * k + 1) * SAME ** max(k - 1, 0))
        if best is None or rows + meet < best[0]:
            best = rows + meet, m, d
    return best[1:]


def plan(docs: DataFrame, shingle: int, percent: int) -> list[tuple[int, int, int]]:
    """(start, m, d) of every band. The bands' sets are counted over all texts, by their words; only the cost rests on it."""
    words = F.greatest(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) - (shingle - 1), F.lit(1))
    step = F.floor(F.log("size") / F.log(F.lit(WIDTH))).alias("step")
    sizes = pick(docs, "text").select(words.alias("size")).groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
    rows = sizes.collect()                           # one row per power of WIDTH
    begin = starts(max([1, *(r["most"] for r in rows)]))
    counts = [0] * len(begin)
    for r in rows:
        counts[max(i for i, b in enumerate(begin) if b <= max(1, r["most"]))] += r["n"]
    return [(lo, *allocate(lo, hi, n, percent)) for lo, hi, n in zip(begin, [*begin[1:], begin[-1] + 1], counts)]


def _mix(x):
    """A mixed copy of 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tokens(column, shingle):
    """Texts -> (row, token): the distinct token hashes of each row, sorted by row and hash."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    if column.offset:          # Arrow's split kernels misread a slice
        column = column.take(pa.array(np.arange(len(column))))
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    row = pc.list_parent_indices(words).to_numpy()
    flat = words.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(some).as_py():
        row, flat = row[some.to_numpy(zero_copy_only=False)], flat.filter(some)
    coded = flat.dictionary_encode()
    ends, data = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[:len(coded.dictionary) + 1].tolist(), coded.dictionary.buffers()[2]
    data = memoryview(data) if data is not None else b""
    known = np.array([xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])], np.uint64)
    h = known[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=len(column))
    full = count >= shingle
    n = len(h) - shingle + 1
    one = np.uint64(0x9E3779B97F4A7C15)

    def chain(parts):
        x = np.zeros(len(parts[0]), np.uint64)
        for p in parts:
            x = _mix(x * one + p + np.uint64(1))
        return x

    if n > 0:
        at = np.flatnonzero((row[:n] == row[shingle - 1:]))
        rows, tokens = row[at], chain([h[at + i] for i in range(shingle)])
    else:
        rows, tokens = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # fewer words than a shingle: the whole sequence is one token, told apart by its number of words
    first = np.cumsum(count) - count
    for k in range(1, shingle):
        short = np.flatnonzero(~full & (count == k))
        if len(short):
            rows = np.concatenate([rows, short])
            tokens = np.concatenate([tokens, chain([h[first[short] + i] for i in range(k)] + [np.full(len(short), k, np.uint64)])])
    order = np.lexsort((tokens, rows))
    rows, tokens = rows[order], tokens[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])
    return rows[new].astype(np.int64), tokens[new]


def _signatures(who, tokens, size, band, m, d, limit, seed):
    """Keys of sets in one band: (set, key), the sets by their place in ``size``.

    who, tokens: the tokens of the sets; limit: segments worth one that a set needs.
    """
    import numpy as np

    n = len(size)
    part = (_mix(tokens ^ np.uint64(seed)) % np.uint64(m)).astype(np.int64)
    value = _mix(tokens + np.uint64(0x632BE59BD9B4E019))
    cell = who * m + part
    total = np.zeros(n * m, np.uint64)
    held = np.bincount(cell, minlength=n * m).reshape(n, m)
    np.add.at(total, cell, value)
    salt = _mix(np.uint64(band << 32) + np.arange(m, dtype=np.uint64) + np.uint64(seed))
    sets, keys = [], []
    if d:
        two = total.reshape(n, m)[:, :d]
        sets.append(np.repeat(np.arange(n), d))
        keys.append(_mix(two ^ salt[None, :d]).ravel())
        inner = part < d
        sets.append(who[inner])
        keys.append(_mix((total[cell[inner]] - value[inner]) ^ salt[part[inner]]))
    if m > d:
        one, some = total.reshape(n, m)[:, d:], held[:, d:] > 0
        turn = np.cumsum(some, axis=1)
        out = some & (turn <= limit[:, None])
        out |= ~some & (turn[:, -1:] < limit[:, None])          # too few that are not empty: all are used
        s, i = np.nonzero(out)
        sets.append(s)
        keys.append(_mix(one[s, i] ^ salt[d + i]))
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(sets), np.concatenate(keys)


def _index(bands, shingle, percent, at):
    """Arrow mapper: (keys.., text) -> (keys.., n, sid, check, marks, sketch): size, hash and second hash of the set,
    its keys in the index, those for the first of equal sets in a task, and its sketch."""
    begin = [b[0] for b in bands]

    def all_keys(rows, tokens, size, fresh):
        import numpy as np

        band = np.searchsorted(begin, size, "right") - 1
        sets, keys = [], []
        for b in np.unique(band[fresh]).tolist():
            for home in range(b, -1, -1):
                own, differ = fresh & (band == b), size * (100 - percent) // percent
                if home < b:          # close above the start of its band: similar to sets of a band below
                    last = begin[home + 1] - 1
                    own &= size * percent <= 100 * last
                    differ = (last + size) * (100 - percent) // (100 + percent)
                where, (_, m, d) = np.flatnonzero(own), bands[home]
                if not len(where):
                    break
                step = max(1, CELLS // max(1, m))
                for i in range(0, len(where) if m else 0, step):
                    some = where[i:i + step]
                    place = np.full(len(size), -1)
                    place[some] = np.arange(len(some))
                    mine = place[rows] >= 0
                    limit = np.maximum(0, differ[some] + 1 - 2 * d)
                    s, k = _signatures(place[rows[mine]], tokens[mine], size[some], home, m, d, limit, SEED + home)
                    sets.append(some[s])
                    keys.append(k)
        return np.concatenate(sets or [np.zeros(0, np.int64)]), np.concatenate(keys or [np.zeros(0, np.uint64)])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen = np.zeros(0, np.uint64)
        for rb in small(batches):
            rows, tokens = _tokens(rb.column(at), shingle)
            n = rb.num_rows
            size = np.bincount(rows, minlength=n)
            sid, check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            np.add.at(sid, rows, _mix(tokens))
            np.add.at(check, rows, _mix(tokens ^ np.uint64(0xD6E8FEB86659FD93)))
            sid = _mix(sid + size.astype(np.uint64))
            sketch, some = np.zeros((4, n), np.uint64), np.flatnonzero(size)
            if len(some):
                begin_at, place = np.searchsorted(rows, some), tokens >> np.uint64(56)
                bit = np.uint64(1) << (place & np.uint64(63))
                for w in range(4):
                    sketch[w, some] = np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == w, bit, np.uint64(0)), begin_at)
            first = np.zeros(n, bool)
            first[np.unique(sid, return_index=True)[1]] = True
            fresh = first & (size > 0) & ~np.isin(sid, seen)
            seen = np.concatenate([seen, sid[fresh]])
            s, k = all_keys(rows, tokens, size, fresh)
            order = np.argsort(s, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(k[order].view(np.int64)))
            yield pa.record_batch([*rb.columns[:at], pa.array(size.astype(np.int64)), pa.array(sid.view(np.int64)), pa.array(check.view(np.int64)),
                                   lists, *(pa.array(z.view(np.int64)) for z in sketch)],
                                  names=[*rb.schema.names[:at], "n", "sid", "check", "marks", *SKETCH])

    return run


def _sets(shingle):
    """Arrow mapper: (sid, text) -> (sid, tokens)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rb in small(batches):
            rows, tokens = _tokens(rb.column(1), shingle)
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=rb.num_rows))]).astype(np.int32)
            yield pa.record_batch([rb.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64)))], names=["sid", "tokens"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate ``pairs`` (a, b) those whose whole sets are similar enough, as (a, b, shared, total)."""
    met = pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a")
    met = met.join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b")
    met = met.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
    return met.select("a", "b", "shared", (F.col("sum") - F.col("shared")).alias("total")).where(F.col("shared") * 100 >= F.col("total") * percent)


def _whole(docs: DataFrame, reps: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(sid, tokens) of the sets in ``wanted`` (sid), from the text of one document each."""
    need = wanted.distinct().join(reps, "sid").select("sid", "doc_id", "key")
    texts = docs.alias("t").join(need.alias("k"), F.col("t.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("t.key") == F.col("k.key")))
    sets = texts.select("sid", "text").mapInArrow(_sets(shingle), "sid long, tokens array<long>")
    return cut(sets.groupBy("sid").agg(F.any_value("tokens").alias("tokens")))      # rows that repeat as a whole: one of them


def _windows(begin, end, percent):
    """Arrow mapper over (mark, block, own, sid, n, root, sketch), sorted by mark, block and place -> (a, b): sets of one block,
    of different roots and of like sizes and sketches, ``begin`` to ``end - 1`` places apart, the later one at home in the block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for rb in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in rb.columns]
            old = 0 if held is None else len(held[0])
            every = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            mark, block, own, sid, n, root, *sketch = every
            a, b = [], []
            for gap in range(begin, min(end, len(mark))):
                x, y = slice(0, len(mark) - gap), slice(gap, len(mark))
                ok = own[y] & (mark[x] == mark[y]) & (block[x] == block[y]) & (root[x] != root[y])
                ok &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
                ok[:max(0, old - gap)] = False                  # both were there before
                i = np.flatnonzero(ok)
                if not len(i):
                    continue
                apart = sum(np.bitwise_count((z[i] ^ z[i + gap]).view(np.uint64)).astype(np.int64) for z in sketch)
                i = i[apart <= (n[i] + n[i + gap]) * (100 - percent) // (100 + percent)]
                a.append(sid[i])
                b.append(sid[i + gap])
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            held = [c[-end:] for c in every]

    return run


def _in_blocks(left: DataFrame, end: int) -> DataFrame:
    """The sets of each mark by place, in blocks of bounded size: each with the last ``end - 1`` of the block before."""
    size = 4 * end
    placed = ordered_prefix(left, ["mark"], ["sid"], pos_col="place")
    block, rest = F.floor((F.col("place") - 1) / size), F.pmod(F.col("place") - 1, F.lit(size))
    home = F.struct(block.alias("block"), F.lit(True).alias("own"))
    later = F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    both = F.when(rest > size - end, F.array(home, later)).otherwise(F.array(home))
    rows = placed.select("mark", "sid", "n", "root", "place", *SKETCH, F.explode(both).alias("b"))
    rows = rows.select("mark", "b.block", "b.own", "sid", "n", "root", *SKETCH, "place")
    return rows.repartition("mark", "block").sortWithinPartitions("mark", "block", "place").drop("place")


def links(docs: DataFrame, own: DataFrame, reps: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """(a, b, shared, total): verified links between different sets that connect all similar ones (see the module)."""
    marks = own.where("size(marks) > 0").select("sid", F.explode("marks").alias("mark"))
    often = marks.groupBy("mark").agg(F.min("sid").alias("least"), F.max("sid").alias("most")).where("least <> most").select("mark", "least")
    # a mark that only one set has needs no more
    shared = cut(marks.join(often, "mark").select("mark", "sid", "least").distinct())
    sets = _whole(docs, reps, shared.select("sid"), shingle)
    size = reps.select("sid", F.col("size").alias("n"))
    star = shared.where("sid <> least").select("sid", "least").distinct().join(size, "sid")
    star = star.join(size.select(F.col("sid").alias("least"), F.col("n").alias("least_n")), "least")
    like = F.least("n", "least_n") * 100 >= F.greatest("n", "least_n") * percent
    done = cut(star.where(like).select(F.col("least").alias("a"), F.col("sid").alias("b")))
    found, begin, end = cut(_similar(done, sets, percent)), 1, FIRST_WINDOW
    while True:
        roots = components(found.select("a", "b"))
        roots = size.join(roots, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("root"))
        named = shared.select("mark", "sid").join(roots, "sid")
        apart = named.groupBy("mark").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("held"))
        left = named.join(apart.where((F.col("x") != F.col("y")) & (F.col("held") > begin)).select("mark"), "mark")
        left = cut(left.join(reps.select("sid", F.col("size").alias("n"), *SKETCH), "sid"))
        if not left.limit(1).count():
            return found
        pairs = _in_blocks(left, end).mapInArrow(_windows(begin, end, percent), "a long, b long").distinct()
        pairs = cut(pairs.join(done, ["a", "b"], "left_anti"))
        done = done.union(pairs)
        found = cut(found.union(_similar(pairs, sets, percent)))
        shared, begin, end = left.select("mark", "sid"), end, 4 * end


def similar_groups(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, sid (hash of the set: equal sets are one class), component_id.

    Two documents are linked when 100 x intersection >= ``percent`` x union of their sets of ``shingle`` words;
    component_id is the smallest doc_id reachable. Null, empty and word-less texts have no token and are
    linked with nothing; fewer words than ``shingle`` are one token. Repeated rows come back
    repeated; rows with a null id count in a group but never name it. An empty table gives an empty
    result. Tokens are 64-bit hashes; whole texts are read, however long.
    """
    docs = pick(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    rows = docs.select("doc_id", "key", "text")
    bands = plan(docs, shingle, percent)
    own = cut(rows.mapInArrow(_index(bands, shingle, percent, 2), "doc_id long, key long, n long, sid long, check long, marks array<long>, "
                                                                          + ", ".join(f"{z} long" for z in SKETCH)))
    some = own.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    same = F.when(F.min("check") != F.max("check"), F.raise_error(F.lit("two sets share a 64-bit hash"))).otherwise(F.first("n"))
    reps = some.groupBy("sid").agg(first, F.min("doc_id").alias("least"), same.alias("size"), *(F.first(z).alias(z) for z in SKETCH))
    reps = cut(reps.select("sid", "first.doc_id", "first.key", "least", "size", *SKETCH))
    roots = components(links(docs, own, reps, shingle, percent).select("a", "b"))
    rooted = reps.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = cut(rooted.join(least, "root").select("sid", "component_id"))      # apart: a hot set's rows can be split
    out = some.join(names, "sid").select("doc_id", F.col("n").alias("n_shingles"), "sid", "component_id")
    return out.union(own.where("n = 0").select("doc_id", "n", "sid", F.col("doc_id").alias("component_id")))
