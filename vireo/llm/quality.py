"""Quality classifier by compression with two trained dictionaries.

One zstandard dictionary is trained on chunks of texts labelled good, one on
chunks labelled bad. A text is compressed in chunks with either; the
difference of the two sizes over their sum is the evidence, and a logistic
calibration turns it, together with the overall compression ratio (highly
repetitive text compresses alike with both), into a score. The dictionaries
learn from one half of a bounded labelled sample, the calibration from the
other, so it sees texts as the scored ones are: unknown to the dictionaries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, labelled_sample, pick, sampled_texts, small

CHUNK = 512             # bytes compressed at once
DICT_BYTES = 32_768
LEVEL = 3
PER_CLASS = 3_000       # labelled rows of each class in the sample
CHUNKS = 20_000         # chunks of each class that a dictionary is trained on


@dataclass
class Model:
    good: bytes
    bad: bytes
    raw: bool            # the dictionaries are plain content, for want of chunks to train on
    mean: object
    scale: object
    weights: object
    prior: float         # the score where one class has no labelled row


class _Sizes:
    def __init__(self, good, bad, raw):
        import zstandard as z

        kind = z.DICT_TYPE_RAWCONTENT if raw else z.DICT_TYPE_FULLDICT
        self.pair = []
        for data in (good, bad):
            d = z.ZstdCompressionDict(data, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            self.pair.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, text):
        import math

        data = (text or "").encode("utf-8", "surrogatepass")
        good, bad = (c.compress for c in self.pair)
        a = b = 0
        for i in range(0, max(1, len(data)), CHUNK):
            part = data[i:i + CHUNK]
            a += len(good(part))
            b += len(bad(part))
        return (b - a) / (a + b), math.log((a + b) / (2 * len(data) + 16))


def _expand(f):
    import numpy as np

    d, r = f[:, 0], f[:, 1]
    return np.c_[d, r, d * d, r * r, d * r]


def _chunks(batches):
    """(label, text) -> (label, order, chunk) over whole texts."""
    import pyarrow as pa
    import xxhash

    for rb in small(batches):
        for label, text in zip(*[c.to_pylist() for c in rb.columns]):
            data = text.encode("utf-8", "surrogatepass")
            parts = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]
            if parts:
                yield pa.record_batch([pa.array([label] * len(parts), pa.int32()),
                                       pa.array([xxhash.xxh64_intdigest(p) >> 1 for p in parts], pa.int64()),
                                       pa.array(parts, pa.binary())], names=["label", "at", "part"])


def _measure(good, bad, raw):
    """(label, weight, text) -> (label, weight, d, r)"""

    def run(batches):
        import pyarrow as pa

        sizes = _Sizes(good, bad, raw)
        for rb in small(batches):
            f = [sizes.features(t) for t in rb.column(2).to_pylist()]
            both = [pa.array(list(c), pa.float64()) for c in zip(*f)] if f else [pa.array([], pa.float64())] * 2
            yield pa.record_batch([rb.column(0), rb.column(1), *both], names=["label", "weight", "d", "r"])

    return run


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", where=None, per_class: int = PER_CLASS) -> Model:
    """Dictionaries and calibration from at most ``per_class`` labelled rows of each class.

    ``where`` restricts the rows of ``labels`` that may be learned from. The calibration
    weights the sampled rows to the class ratio of all permitted labels.
    """
    import numpy as np
    import zstandard as z

    sample = labelled_sample(labels, column, per_class, where)
    texts = sampled_texts(docs, sample).select("label", "half", "weight", "text")
    parts = texts.where("half = 0").select("label", "text").mapInArrow(_chunks, "label int, at long, part binary")
    both = [[bytes(r["part"]) for r in parts.where(F.col("label") == c).orderBy("at", "part").limit(CHUNKS).collect()] for c in (1, 0)]
    n = [len(x) for x in both]
    if not all(n):
        count = {r["label"]: r["in_class"] for r in sample.select("label", "in_class").distinct().collect()}
        return Model(b"", b"", True, None, None, None, (count.get(1, 0) + 1) / (sum(count.values()) + 2))
    raw = False
    try:
        dicts = [z.train_dictionary(DICT_BYTES, x, level=LEVEL).as_bytes() for x in both]
    except z.ZstdError:                            # too few chunks to train on
        raw, dicts = True, [b"".join(x)[-DICT_BYTES:] for x in both]
    measured = texts.where("half = 1").select("label", "weight", "text").mapInArrow(
        _measure(*dicts, raw), "label int, weight double, d double, r double")
    rows = np.array([tuple(r) for r in measured.collect()], float).reshape(-1, 4)      # at most per_class rows
    if len(set(rows[:, 0])) < 2:
        return Model(*dicts, raw, np.zeros(1), np.ones(1), np.array([20.0, 0.0]), 0.5)
    mean, scale, w = fit_logistic(_expand(rows[:, 2:]), rows[:, 0], rows[:, 1])
    return Model(*dicts, raw, mean, scale, w, 0.5)


class _Scorer:
    def __init__(self, model):
        self.model = model
        self.sizes = None if model.weights is None else _Sizes(model.good, model.bad, model.raw)

    def __call__(self, texts):
        import numpy as np

        m = self.model
        if self.sizes is None or not texts:
            return np.full(len(texts), m.prior)
        f = np.array([self.sizes.features(t) for t in texts])
        x = _expand(f) if len(m.weights) > 2 else f[:, :1]
        return 1 / (1 + np.exp(-np.clip(((x - m.mean) / m.scale) @ m.weights[:-1] + m.weights[-1], -30, 30)))


def score(docs: DataFrame, model: Model, keys=("doc_id",)) -> DataFrame:
    """``keys`` + score (0 to 1, higher: the good class likelier) of every whole text.

    A null text counts as empty and is scored like any other; repeated rows
    come back repeated; an empty table gives an empty result. Where one class
    had no labelled rows, every score is the smoothed share of good labels.
    """
    rows = pick(docs, *keys, "text")
    kinds = dict(rows.dtypes)

    def run(batches):
        import pyarrow as pa

        scorer = _Scorer(model)
        for rb in small(batches):
            at = rb.num_columns - 1
            yield pa.record_batch([*rb.columns[:at], pa.array(scorer(rb.column(at).to_pylist()))], names=[*rb.schema.names[:at], "score"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns; nothing is shuffled."""
    cols = docs.columns
    pos = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    at = cols.index("text")

    def run(batches):
        import pyarrow as pa

        scorer = _Scorer(model)
        for rb in small(batches):
            if rb.num_rows:
                yield rb.filter(pa.array(scorer(rb.column(at).to_pylist()) >= least))

    return pos.mapInArrow(run, pos.schema).toDF(*cols)
