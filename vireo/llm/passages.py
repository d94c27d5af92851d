"""Repeated passages by a sparse suffix array over words.

Of every text those suffixes are kept that start at a minimiser: the word
position whose 8-gram hash is least in some window of ``WINDOW`` positions. A
passage of ``LEAST`` words that occurs twice holds, within its first
``WINDOW`` words, the same minimisers in both places, followed by at least
``PREFIX`` equal words. So suffixes are keyed by their first ``PREFIX`` words;
a filter of a fixed greatest size, made from the keys that occur more than
once, spares the others the rest of the way.

The remaining suffixes meet by their key, with the words around them. Windows
of ``LEAST`` words that hold the same key at the same place lie in one task,
which hashes them once for all suffixes with equal words around them and marks
each suffix from its first to its last window that occurs again.

Keys of more than ``HOT`` suffixes would be too much for a task. Their suffixes
are sorted by their words, neighbours are compared, and each match is extended to
the right and, from the words before the suffix, to the left. Matches of
``LEAST`` words or more are marked in both places. Two suffixes that share a
passage by the words before them need not be neighbours. So rows also give a hash of each window of
``LEAST`` words around the suffix; windows that occur again are marked. No row
of a key shares more words from the suffix on than one of the two neighbours
does, so longer windows are spared, as are those of rows that follow two
documents in a run of neighbours that share the window. Windows that a row
shares with a neighbour of another document are counted, but marked already.
That sort is a range sort on key and words, so the suffixes of one passage that
very many documents share are spread over tasks; the two rows on either side
of a border are compared in a last small step.
Marks are merged per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pick, pow2_at_least

LEAST = 50              # words of a passage
GRAM = 8                # words hashed to choose minimisers
PREFIX = 16             # words that key a suffix
WINDOW = LEAST - PREFIX + 1
CONTEXT = LEAST         # words carried on either side of a suffix start
FILTER_BITS = 1 << 27   # greatest size of the filter: 16 MB
HOT = 1 << 16           # most suffixes of a key that meet in one task
CHUNK = 1 << 15         # suffixes that a task compares at once, whole keys; about as many make a part of the shuffle
BEFORE = LEAST - PREFIX # words before a suffix that a passage around its key can take
AROUND = BEFORE + LEAST


def _suffixes(text):
    """(word hashes, kept positions, their keys) of a text; none if it is shorter than a passage."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if n < LEAST:
        return None
    h64 = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(h64, words), np.uint64, n)

    def rolled(m):
        g = np.zeros(n - m + 1, np.uint64)
        for i in range(m):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[i:n - m + 1 + i]
        g ^= g >> np.uint64(31)
        g = g * np.uint64(0xBF58476D1CE4E5B9)
        return g ^ (g >> np.uint64(27))

    gram = rolled(GRAM)
    picks = []
    for at in range(0, len(gram) - WINDOW + 1, 1 << 16):       # long texts: in parts
        part = np.lib.stride_tricks.sliding_window_view(gram[at:at + (1 << 16) + WINDOW - 1], WINDOW)
        picks.append(part.argmin(axis=1) + np.arange(at, at + len(part)))
    pos = np.unique(np.concatenate(picks))
    pos = pos[pos + PREFIX <= n]
    return h, pos, rolled(PREFIX)[pos].view(np.int64)


def _keys(batches):
    import numpy as np
    import pyarrow as pa

    for rb in batches:
        found, size = [], 0
        for text in rb.column(0):
            s = _suffixes(text.as_py() or "")
            if s:
                found.append(s[2])
                size += len(s[2])
            if size > 1 << 16:
                yield pa.record_batch([pa.array(np.concatenate(found))], names=["key"])
                found, size = [], 0
        if found:
            yield pa.record_batch([pa.array(np.concatenate(found))], names=["key"])


SUFFIX = "key long, right binary, left binary, doc_id long, row long, pos long"


def _passing(bits, mask, hot, key, of_hot):
    """Which keys pass the filter and are, or are not, among the (sorted) ``hot`` ones."""
    import numpy as np

    bit = key & mask
    return ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool) & (np.isin(key, hot) == of_hot)


MET = "key long, doc_id long, row long, pos long, behind long, words binary"


def _around(on, mask, hot):
    """Second scan: suffixes whose key passes the filter and is not hot, with the words around them (``behind`` of them
    from the suffix on; places outside the text are 0)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(on.value, np.uint8)
        frequent = np.array(hot.value, np.int64)
        reach = np.arange(AROUND)

        def batch(found, size):
            key, pos, behind, words = (np.concatenate(c) for c in list(zip(*found))[2:])
            times = np.repeat(np.arange(len(found)), [len(f[2]) for f in found])
            ids = [pa.array([f[c] for f in found], pa.int64()).take(pa.array(times)) for c in (0, 1)]
            ends = np.arange(size + 1, dtype=np.int32) * (4 * AROUND)
            held = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(words))])
            return pa.record_batch([pa.array(key), *ids, pa.array(pos), pa.array(behind), held], names=["key", "doc_id", "row", "pos", "behind", "words"])

        found, size = [], 0
        for rb in batches:
            for at in range(rb.num_rows):               # one text at a time: a batch of them may be large
                doc_id, row, text = (rb.column(c)[at].as_py() for c in range(3))
                s = _suffixes(text) if text else None
                if not s:
                    continue
                h, pos, key = s
                hit = np.flatnonzero(_passing(bits, mask, frequent, key, False))
                padded = np.concatenate([np.zeros(BEFORE, np.uint32), h.astype(np.uint32), np.zeros(LEAST, np.uint32)])
                for some in np.split(hit, range(4096, len(hit), 4096)):
                    if not len(some):
                        continue
                    p = pos[some]
                    found.append((doc_id, row, key[some], p, np.minimum(len(h) - p, LEAST), padded[p[:, None] + reach]))
                    size += len(some)
                    if size >= 4096:
                        yield batch(found, size)
                        found, size = [], 0
        if found:
            yield batch(found, size)

    return run


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _groups(values):
    """(order, start of each group of equal values in it, group of each value)."""
    import numpy as np

    order = np.argsort(values)
    new = np.r_[True, values[order][1:] != values[order][:-1]]
    group = np.empty(len(values), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def _recurring(key, row, pos, behind, words):
    """Of suffixes, all those of their keys: (first, last, across) of the windows of ``LEAST`` words around each that occur
    again, by their numbers of words from the suffix on; first is over last where none does."""
    import numpy as np

    ahead = np.arange(PREFIX, LEAST + 1)                            # words from the suffix on
    base = np.uint64(0x9E3779B97F4A7C15) ** np.arange(AROUND, dtype=np.uint64)
    back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)) ** np.arange(len(ahead), dtype=np.uint64)
    sums = np.zeros((len(key), AROUND + 1), np.uint64)
    np.cumsum(_mixed(words.astype(np.uint64) + np.uint64(1 << 40)) * base, axis=1, out=sums[:, 1:])
    before = np.minimum(pos, BEFORE)
    # suffixes with equal words around them share their windows
    order, start, of = _groups(_mixed(sums[:, -1] + (before * 64 + behind).astype(np.uint64)))
    low, high = np.minimum.reduceat(row[order], start), np.maximum.reduceat(row[order], start)
    more = np.bincount(of) > 1
    one = order[start]
    valid = (ahead <= behind[one][:, None]) & (LEAST - ahead <= before[one][:, None])
    again, apart = valid & more[:, None], valid & (more & (low != high))[:, None]
    _, of_key, n_around = np.unique(key[one], return_inverse=True, return_counts=True)
    some = np.flatnonzero(n_around[of_key] > 1)                     # of keys with unlike words around them
    if len(some):
        has = valid[some]
        window = _mixed((sums[one[some], LEAST:LEAST + len(ahead)] - sums[one[some], :len(ahead)]) * back + ahead.astype(np.uint64))[has]
        who = np.repeat(some, has.sum(axis=1))
        if len(window):
            order, start, group = _groups(window)
            least, most = np.minimum.reduceat(low[who[order]], start), np.maximum.reduceat(high[who[order]], start)
            shared = (np.bincount(group) > 1)[group]
            a, b = again[some], apart[some]
            a[has] |= shared
            b[has] |= shared & (least != most)[group]
            again[some], apart[some] = a, b
    any_ = again.any(axis=1)
    first = np.where(any_, PREFIX + again.argmax(axis=1), LEAST + 1)
    last = np.where(any_, LEAST - again[:, ::-1].argmax(axis=1), 0)
    return first[of], last[of], apart.any(axis=1)[of]


MARKS = "doc_id long, row long, first long, last long, across boolean, key long"


def _meet(batches):
    """Suffixes in the order of their keys -> marks (doc, first, last, across, key)."""
    import numpy as np
    import pyarrow as pa

    def marks(table):
        key, row, pos, behind = (table.column(c).to_numpy() for c in ("key", "row", "pos", "behind"))
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint32).reshape(-1, AROUND)
        first, last, across = _recurring(key, row, pos, behind, words)
        hit = np.flatnonzero(first <= last)
        doc_id = table.column("doc_id").combine_chunks().take(pa.array(hit))
        return pa.table([doc_id, *map(pa.array, (row[hit], (pos + first - LEAST)[hit], (pos + last)[hit], across[hit], key[hit]))],
                        names=["doc_id", "row", "first", "last", "across", "key"]).to_batches()

    wait, n = [], 0
    for rb in batches:
        if not rb.num_rows:
            continue
        wait.append(rb)
        n += rb.num_rows
        if n >= CHUNK and wait[0].column(0)[0] != rb.column(0)[-1]:
            table = pa.Table.from_batches(wait)
            whole = int(np.searchsorted(table.column("key").to_numpy(), rb.column(0)[-1].as_py()))
            yield from marks(table.slice(0, whole))
            wait, n = table.slice(whole).to_batches(), n - whole
    if n:
        yield from marks(pa.Table.from_batches(wait))


def _contexts(on, mask, hot):
    """Suffixes whose key passes the filter and is hot, with the words on either side."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(on.value, np.uint8)
        frequent = np.array(hot.value, np.int64)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def batch(rows):
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["key", "right", "left", "doc_id", "row", "pos"])

        rows = []
        for rb in batches:
            for at in range(rb.num_rows):               # one text at a time: a batch of them may be large
                doc_id, row, text = (rb.column(c)[at].as_py() for c in range(3))
                s = _suffixes(text) if text else None
                if not s:
                    continue
                h, pos, key = s
                hit = _passing(bits, mask, frequent, key, True)
                short = h.astype(">u4")                         # order of the bytes is order of the words
                for p, k in zip(pos[hit].tolist(), key[hit].tolist()):
                    rows.append((k, short[p:p + CONTEXT].tobytes(), short[max(0, p - CONTEXT):p][::-1].tobytes(), doc_id, row, p))
                    if len(rows) == 4096:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def _common(a, b):
    """Words that two contexts share from their start."""
    import numpy as np

    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    x, y = np.frombuffer(a, ">u4", n // 4), np.frombuffer(b, ">u4", n // 4)
    return int((x != y).argmax())


MARK = ("edge boolean, part long, doc_id long, row long, first long, last long, across boolean, key long, right binary, left binary, "
        "pos long, windows array<long>, known long")


def _windows(row, done):
    """Hashes of the passages of ``LEAST`` words with PREFIX, PREFIX + 1, .. words from the suffix on; null where ``done`` or too short."""
    import xxhash

    words, at = b"".join(row[2][i:i + 4] for i in range(len(row[2]) - 4, -1, -4)) + row[1], len(row[2]) - 4 * LEAST
    out = []
    for r, d in zip(range(PREFIX, LEAST + 1), done):
        w = words[at + 4 * r:at + 4 * (r + LEAST)] if not d and at + 4 * r >= 0 else b""
        out.append(xxhash.xxh3_64_intdigest(w) >> 1 if len(w) == 4 * LEAST else None)
    return out


def _neighbours(edges):
    """Sorted suffixes -> marks (doc, first, last, across), and, with ``edges``, the first and last row of each part
    and the windows (null ``edge``) of keys of more than two rows."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if edges else 0
        kinds = [pa.bool_(), *[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        names = ["edge", "part", "doc_id", "row", "first", "last", "across", "key", "right", "left", "pos", "windows", "known"]
        out, prev, other, n = [], None, None, 0    # the row before, and the last one of another document
        two = [False] * (LEAST - PREFIX + 1)       # windows that two documents of the run of neighbours have given
        wait, in_key, first_key = [], 0, True      # rows of a key that may still have two rows only

        def compare(a, b):
            if a[0] != b[0]:
                return 0, 0
            right, left = _common(a[1], b[1]), _common(a[2], b[2])
            if left + right >= LEAST:
                across = a[3:5] != b[3:5]
                for x in (a, b):
                    out.append((False, part, x[3], x[4], x[5] - left, x[5] + right, across, x[0], None, None, x[5], None, None))
            return right, left

        def border(x):
            return (True, part, x[3], x[4], None, None, None, x[0], x[1], x[2], x[5], None, None)

        def give(keep=0):
            for x, done, reach, known in wait[:len(wait) - keep]:
                found = _windows(x, [d or PREFIX + i > reach for i, d in enumerate(done)])
                if any(h is not None for h in found):
                    out.append((None, part, x[3], x[4], None, None, None, x[0], None, None, x[5], found, known))
            del wait[:len(wait) - keep]

        def batch(rows):
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for rb in batches:
            for row in zip(*[c.to_pylist() for c in rb.columns]):
                right = left = 0
                if prev is None:
                    if edges:
                        out.append(border(row))
                else:
                    right, left = compare(prev, row)
                    if prev[3:5] != row[3:5]:
                        other = prev
                    elif other is not None and other[3:5] != row[3:5]:
                        compare(other, row)
                if edges:
                    if prev is not None and prev[0] != row[0]:
                        if first_key or in_key > 2:
                            give()
                        wait.clear()
                        in_key, first_key = 0, False
                    apart, done, known = prev is not None and prev[3:5] != row[3:5], [], 0
                    for i in range(len(two)):
                        shared = LEAST - left <= PREFIX + i <= right
                        known |= (shared and apart) << i
                        done.append(shared and apart and two[i])
                        two[i] = shared and (apart or two[i])
                    if wait:
                        wait[-1][2] = max(wait[-1][2], right)
                        wait[-1][3] |= known
                    # how many words the row shares with a neighbour; the one before a part's first row is not known
                    wait.append([row, done, right if prev is not None else LEAST, known])
                    in_key += 1
                    if in_key > 2:
                        give(keep=1)               # the next row may share more words with this one
                prev, n = row, n + 1
            if len(out) >= 4096:
                yield batch(out)
                out.clear()
        if wait:                                   # the last key may go on in the next part
            wait[-1][2] = LEAST
            give()
        if edges and n > 1:                        # a single row is its part's first already
            out.append(border(prev))
        if out:
            yield batch(out)

    return run


def _hot_marks(passing):
    """Marks of the suffixes of frequent keys, spread over tasks by their words."""
    order = ["key", "right", "left", "doc_id", "row", "pos"]      # the last three split rows of equal words too
    parts = int(passing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = passing.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = cut(ranged.mapInArrow(_neighbours(True), MARK))
    # border rows: two for each part, however many rows there are
    border = marked.where("edge").repartition(1).sortWithinPartitions(*order, "part")
    joined = border.select("key", "right", "left", "doc_id", "row", "pos").mapInArrow(_neighbours(False), MARK)
    marks = marked.where("not edge").union(joined).select("doc_id", "row", "first", "last", "across", "key")
    held = marked.where("edge IS NULL").select(
        "doc_id", "row", "pos", "key", "known", F.posexplode("windows").alias("n", "window")).where("window IS NOT NULL")
    one_of = F.xxhash64("doc_id", "row")
    again = held.groupBy("n", "window").agg(F.count("*").alias("n_held"), F.min(one_of).alias("a"), F.max(one_of).alias("b"))
    again = again.where("n_held > 1").select("n", "window", (F.col("a") != F.col("b")).alias("across"))
    last = F.col("pos") + F.col("n") + PREFIX
    return marks.union(held.where("shiftright(known, n) & 1 = 0").join(again, ["n", "window"]).select("doc_id", "row", (last - LEAST).alias("first"), last.alias("last"), "across", "key"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Maximal runs of words covered by passages of ``LEAST`` words or more that occur elsewhere.

    One row per run: doc_id, row (hash of id and text, tells apart rows with
    one id), first_word, end_word (exclusive; words are runs of characters
    other than space and \\x09-\\x0D, counted from 0), n_words, passage_id (equal for runs that
    share their suffixes), across (some match lies in another row). Null,
    empty and short texts have no row; a row that repeats is a copy, so its
    whole text is one run. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    counted = rows.select("text").mapInArrow(_keys, "key long").groupBy("key").count()
    size = min(FILTER_BITS, pow2_at_least(max(1 << 16, 64 * pick(docs, "doc_id").count())))
    bit = F.col("key").bitwiseAND(size - 1)
    # a key is listed if it has more than HOT suffixes, so the lists have few
    words = counted.where("count > 1").groupBy(F.shiftright(bit, 15).alias("seg")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND(32767)).alias("bits"), F.sum("count").alias("n"),
        F.collect_list(F.when(F.col("count") > HOT, F.col("key"))).alias("hot"))
    on, often, n_met = bytearray(size // 8), [], 0
    for r in words.collect():                      # at most 4,096 rows of 4 KB
        on[r["seg"] * 4096:(r["seg"] + 1) * 4096] = r["bits"]
        often += r["hot"]
        n_met += r["n"]
    on, hot = (spark.sparkContext.broadcast(x) for x in (bytes(on), often))
    parts = max(1, -(-n_met // CHUNK))
    met = rows.mapInArrow(_around(on, size - 1, hot), MET).repartition(parts, "key").sortWithinPartitions("key")
    marks = met.mapInArrow(_meet, MARKS)
    if often:
        marks = marks.union(_hot_marks(cut(rows.mapInArrow(_contexts(on, size - 1, hot), SUFFIX))))
    # a mark is at most two contexts long, so a document has about as many as it has suffixes
    one = marks.groupBy("doc_id", "row", "first", "last").agg(F.max("across").alias("across"), F.min("key").alias("key"))
    w = Window.partitionBy("doc_id", "row").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = one.withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(w))
    out = runs.groupBy("doc_id", "row", "run").agg(
        F.min("first").alias("first_word"), F.max("last").alias("end_word"), F.min("key").alias("passage_id"), F.max("across").alias("across"))
    return out.select("doc_id", "row", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "passage_id", "across")
