"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each source partition hashes its normalised texts, sorts the distinct
   48-bit fingerprints, cuts them by hash range and sends every owner one
   Golomb-Rice coded message (a repeat inside the partition is one flag bit, so
   a text that fills the table still costs each partition one code word).
2. An owner decodes the messages of its range, counts each fingerprint and
   answers every message with a bitmap: bit i set if fingerprint i is shared.
3. The answered fingerprints set the bits of a filter of a fixed greatest size
   (8 MB), which a second scan uses to pass on suspects only.
4. Suspects are shuffled with their texts and grouped by the bytes of the
   normalised text: one partial row per task and text, so a hot text is no hot
   group. Only groups verified that way count as duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, pow2_at_least, small

BITS = 48               # of an exchanged fingerprint; a false match is a suspect that step 4 clears
PER_OWNER = 1 << 21     # fingerprints in one owner's range, about
FILTER_BITS = 1 << 26   # greatest size of the suspects' filter: 8 MB


def normalise(text):
    """Bytes of the text with A-Z lower-cased; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def rice_encode(values, base):
    """Sorted distinct uint64 ``values`` >= base -> (parameter, unary bits, rest bits)."""
    import numpy as np

    gaps = np.diff(values, prepend=np.uint64(base))
    k = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.69))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def rice_decode(n, k, unary, rest, base):
    import numpy as np

    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotient = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotient << np.uint64(k)) | low, dtype=np.uint64) + np.uint64(base)


def _hash_rows(batches):
    """(keys.., text) -> (keys.., part, rid, fp, sha)."""
    import hashlib

    import pyarrow as pa
    import xxhash
    from pyspark import TaskContext

    part, done = TaskContext.get().partitionId(), 0
    for rb in small(batches):
        at = rb.num_columns - 1
        texts = [normalise(t) for t in rb.column(at).to_pylist()]
        n = len(texts)
        yield pa.record_batch([
            *rb.columns[:at], pa.array([part] * n, pa.int64()), pa.array(range(done, done + n), pa.int64()),
            pa.array([xxhash.xxh64_intdigest(t) >> (64 - BITS) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
            names=[*rb.schema.names[:at], "part", "rid", "fp", "sha"])
        done += n


def _send(owners, hold=1 << 21):
    """(part, fp) of one source partition -> messages, one per owner and ``hold`` rows."""
    shift = BITS - (owners.bit_length() - 1)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def messages(fps, part, turn):
            value, count = np.unique(np.concatenate(fps).view(np.uint64), return_counts=True)
            owner = (value >> np.uint64(shift)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            rows = []
            for v, c, o in zip(np.split(value, cuts), np.split(count, cuts), owner[np.append(0, cuts)].tolist()):
                k, unary, rest = rice_encode(v, o << shift)
                rows.append((part, turn, o, len(v), k, unary, rest, np.packbits(c > 1).tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)],
                                   names=["part", "turn", "owner", "n", "k", "unary", "rest", "multi"])

        held, size, turn, part = [], 0, 0, None
        for rb in batches:
            if not rb.num_rows:
                continue
            part = rb.column(0)[0].as_py()
            held.append(rb.column(1).to_numpy(zero_copy_only=False))
            size += rb.num_rows
            if size >= hold:
                yield messages(held, part, turn)
                held, size, turn = [], 0, turn + 1
        if held:
            yield messages(held, part, turn)

    return run


MESSAGE = "part long, turn long, owner long, n int, k int, unary binary, rest binary, multi binary"


def _answer(shift):
    """All messages of an owner -> one bitmap per message."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        parts = [rice_decode(m.n, m.k, m.unary, m.rest, m.owner << shift) for m in pdf.itertuples()]
        multi = [np.unpackbits(np.frombuffer(m.multi, np.uint8), count=m.n).astype(bool) for m in pdf.itertuples()]
        every = np.concatenate(parts)
        _, at, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = count > 1
        np.logical_or.at(shared, at[np.concatenate(multi)], True)
        bits = np.split(shared[at], np.cumsum([len(p) for p in parts])[:-1])
        return pd.DataFrame({"part": pdf["part"], "turn": pdf["turn"], "owner": pdf["owner"],
                             "bitmap": [np.packbits(b).tobytes() for b in bits]})

    return run


def _suspects(shift):
    """(message, bitmap) -> fingerprints whose bit is set."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            for m in rb.to_pylist():
                fp = rice_decode(m["n"], m["k"], m["unary"], m["rest"], m["owner"] << shift)
                on = np.unpackbits(np.frombuffer(m["bitmap"], np.uint8), count=m["n"]).astype(bool)
                yield pa.record_batch([pa.array(fp[on].view(np.int64))], names=["fp"])

    return run


def suspect_fingerprints(hashed: DataFrame, n: int) -> DataFrame:
    """Fingerprints that occur more than once among ``n`` ``hashed`` rows (part, fp), by the exchange."""
    spark = hashed.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = pow2_at_least(max(least, n // PER_OWNER))
    shift = BITS - (owners.bit_length() - 1)
    sent = hashed.select("part", "fp").mapInArrow(_send(owners), MESSAGE)
    answers = sent.groupBy("owner").applyInPandas(_answer(shift), "part long, turn long, owner long, bitmap binary")
    return sent.join(answers, ["part", "turn", "owner"]).drop("multi", "part", "turn").mapInArrow(_suspects(shift), "fp long")


def _passing(filter_bits, mask):
    """Second scan: texts whose fingerprint is in the filter -> (fp, norm bytes, sha)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        on = np.frombuffer(filter_bits.value, np.uint8)
        for rb in small(batches):
            texts = [normalise(t) for t in rb.column(0).to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(t) >> (64 - BITS) for t in texts], np.int64)
            bit = fp & mask
            hit = np.flatnonzero((on[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            yield pa.record_batch([pa.array(fp[hit]), pa.array([texts[i] for i in hit.tolist()], pa.binary())], names=["fp", "norm"])

    return run


def exact_duplicates(docs: DataFrame, keys=("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keys``, keep_id, group_size, kept, sha (binary).

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of each group the row with the largest doc_id stays; of repeated
    rows with that same id exactly one is ``kept``. Null ids sort lowest. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = pick(docs, *keys, "text")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", part long, rid long, fp long, sha binary"
    hashed = cut(rows.mapInArrow(_hash_rows, schema))
    n = hashed.count()
    size = min(FILTER_BITS, pow2_at_least(max(1 << 16, 8 * n)))
    bit = F.col("fp").bitwiseAND(size - 1)
    words = suspect_fingerprints(hashed, n).groupBy(F.shiftright(bit, 15).alias("seg")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND(32767)).alias("bits"))
    on = bytearray(size // 8)
    for r in words.collect():                      # at most 2,048 rows of 4 KB
        on[r["seg"] * 4096:(r["seg"] + 1) * 4096] = r["bits"]
    shared = spark.sparkContext.broadcast(bytes(on))
    texts = pick(docs, "text").mapInArrow(_passing(shared, size - 1), "fp long, norm binary")
    groups = texts.groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "n")
    last = hashed.groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "part", "rid")).alias("last"))
    groups = cut(groups.join(last, ["fp", "sha"]))       # apart, so that a hot group's rows can be split in the join
    own = F.struct("doc_id", "part", "rid")
    return hashed.join(groups, ["fp", "sha"], "left").select(
        *keys,
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | own.eqNullSafe(F.col("last"))).alias("kept"),
        "sha")
