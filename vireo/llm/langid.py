"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: counts of the byte that follows
each context of up to ``ORDER`` bytes. A byte costs -log2 of its probability,
which is n / (N + q) in the longest context that has seen it (N bytes, q
different ones) after an escape of q / (N + q) from each longer one; below the
empty context all 256 bytes are alike. The statistics are frozen after
training, so a text's code length is a sum of table entries and does not
depend on what was scored before. The language of least code length wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import char_groups, least_hashes, pick, small

ORDER = 3
PER_LANG = 2_000        # texts of each language in the training sample
NODES = 16_384          # contexts kept in the joint tree, the most frequent ones


@dataclass
class Model:
    langs: list
    symbol: object       # byte -> symbol; 0: a byte that no language has shown
    node: object         # context of ORDER symbols -> deepest tree node on its path
    cost: object         # (node, symbol) -> bits in each language


def _grams(batches):
    """(lang number, text) -> (lang, gram, n): ORDER + 1 bytes as one number, counted per task."""
    import numpy as np
    import pyarrow as pa

    for rb in batches:
        lang = rb.column(0).to_pylist()
        for group in char_groups(rb.column(1).to_pylist(), 1 << 22):
            keys = []
            for i, text in group:
                b = np.frombuffer(b"\n" * ORDER + text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
                code = np.zeros(len(b) - ORDER, np.int64)
                for k in range(ORDER + 1):
                    code = code << 8 | b[k:len(b) - ORDER + k]
                keys.append(code | lang[i] << 8 * (ORDER + 1))
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.record_batch([pa.array(key >> 8 * (ORDER + 1)), pa.array(key & (1 << 8 * (ORDER + 1)) - 1), pa.array(n.astype(np.int64))],
                                  names=["lang", "gram", "n"])


def _tables(langs, lang, gram, count, most=NODES):
    """Cost tables from the counts of (lang, gram)."""
    import numpy as np

    parts = np.stack([gram >> 8 * (ORDER - k) & 255 for k in range(ORDER + 1)], 1)
    seen = np.zeros(256, bool)
    seen[parts.ravel()] = True
    seen[10] = True                                # what stands before a text
    symbol = np.where(seen, np.cumsum(seen), 0).astype(np.int64)
    width, n_langs = int(seen.sum()) + 1, len(langs)
    parts = symbol[parts]
    # tree nodes by depth; a context is a number in base `width`, its last byte the lowest digit
    cost = np.full((1, width, n_langs), 8.0, np.float32)      # below the empty context: one of 256 bytes
    node_of = np.zeros(1, np.int64)                           # context number -> node, for the depth in hand
    rows = [cost]
    base = 0
    for depth in range(ORDER + 1):
        context = np.zeros(len(parts), np.int64)
        for k in range(ORDER - depth, ORDER):
            context = context * width + parts[:, k]
        total = np.bincount(context, weights=count, minlength=width ** depth)
        kept = np.flatnonzero(total)
        if depth == ORDER and len(kept) > most:
            kept = np.sort(kept[np.argsort(-total[kept], kind="stable")[:most]])
        place = np.full(width ** depth, -1, np.int64)
        place[kept] = np.arange(len(kept))
        table = np.zeros((len(kept), width, n_langs), np.float32)
        on = place[context] >= 0
        np.add.at(table, (place[context[on]], parts[on, ORDER], lang[on]), count[on].astype(np.float32))
        n, q = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        up = node_of[kept % width ** max(depth - 1, 0)] if depth else np.zeros(1, np.int64)
        above = np.concatenate(rows)[up]
        with np.errstate(divide="ignore", invalid="ignore"):
            known = -np.log2(table / (n + q))
            escape = np.where(n > 0, -np.log2(q / (n + q)), 0.0)
        rows.append(np.where(table > 0, known, escape + above).astype(np.float32))
        base += len(rows[-2])
        if depth:
            node_of = np.where(place >= 0, base + place, node_of[np.arange(width ** depth) % width ** (depth - 1)])
        else:
            node_of = np.array([base])
    return Model(langs, symbol, node_of.astype(np.int32), np.concatenate(rows).reshape(-1, n_langs))


def fit(docs: DataFrame, where=None, per_lang: int = PER_LANG) -> Model | None:
    """Context trees from at most ``per_lang`` whole texts of each language, those whose ids have the least hash.

    ``where`` restricts the rows of ``docs`` that may be learned from. None
    where there is no text with a language.
    """
    import numpy as np

    known = pick(docs, "doc_id", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    if where is not None:
        known = known.where(where)
    rows = least_hashes(known, "lang", per_lang).collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    sample = docs.sparkSession.createDataFrame(sorted({(r["doc_id"], number[r["lang"]]) for r in rows}), "doc_id long, number long")
    texts = pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("number", "text")
    grams = texts.mapInArrow(_grams, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(grams):
        return None
    return _tables(langs, grams["lang"].to_numpy(), grams["gram"].to_numpy(), grams["n"].to_numpy())


def _bits(model, texts):
    """(texts, languages) code lengths of whole texts."""
    import numpy as np

    width = int(model.symbol.max()) + 1
    out = np.zeros((len(texts), len(model.langs)))
    for group in char_groups(texts, 1 << 19):
        data = [t.encode("utf-8", "surrogatepass") for _, t in group]
        edge = b"\n" * ORDER
        joined = edge + edge.join(data)
        size = np.array([len(d) for d in data])
        start = ORDER + np.cumsum(size + ORDER) - size - ORDER
        codes = model.symbol[np.frombuffer(joined, np.uint8)]
        for at in range(0, len(codes) - ORDER, 1 << 20):      # a very long text: in parts
            end = min(at + (1 << 20), len(codes) - ORDER)
            context = np.zeros(end - at, np.int64)
            for k in range(ORDER):
                context = context * width + codes[at + k:end + k]
            entry = model.node[context].astype(np.int64) * width + codes[at + ORDER:end + ORDER]
            total = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(model.cost[entry], axis=0, dtype=np.float64)])
            a = np.clip(start - ORDER - at, 0, end - at)
            b = np.clip(start + size - ORDER - at, 0, end - at)
            out[[i for i, _ in group]] += total[b] - total[a]
    return out


def predict(docs: DataFrame, model: Model | None, keys=("doc_id",)) -> DataFrame:
    """``keys`` + lang_pred, score, bits per language of every whole text.

    The score is the posterior of the winner under equal priors. ``und`` (score
    0) where the text is null or holds no letter, or nothing was learned; ties
    go to the language first in the alphabet. Repeated rows come back repeated;
    an empty table gives an empty result.
    """
    rows = pick(docs, *keys, "text")
    kinds = dict(rows.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)      # bounded: NODES x 257 symbols x languages

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = shared.value
        for rb in small(batches):
            at = rb.num_columns - 1
            texts = rb.column(at).to_pylist()
            ok = [i for i, t in enumerate(texts) if t and model is not None and any(map(str.isalpha, t))]
            lang, score, bits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if ok:
                length = _bits(model, [texts[i] for i in ok])
                best = length.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(length.min(axis=1, keepdims=True) - length, -1000)).sum(axis=1)
                for k, i in enumerate(ok):
                    lang[i], score[i], bits[i] = model.langs[best[k]], float(share[k]), length[k].tolist()
            yield pa.record_batch([*rb.columns[:at], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                   pa.array(bits, pa.list_(pa.float64()))], names=[*rb.schema.names[:at], "lang_pred", "score", "bits"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", lang_pred string, score double, bits array<double>")
