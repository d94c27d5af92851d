"""Personal data: four base patterns and a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) are taken as they are. What they
lose when a greedy match swallows a neighbour and fails, or when a value is
written in another way, the random field adds: zones of text around digits
and ``@`` are cut into tokens, every stretch of up to ``MOST_TOKENS`` tokens is a
candidate segment of each kind with a score from features of the whole span
(shape, digits, Luhn sum, separators, neighbours), and a dynamic program over
the bounded segments chooses boundaries and kinds jointly. It is trained by
maximum likelihood on the base spans of a bounded sample, plus rewritten forms
of them. Base spans always stay; added ones never overlap them.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 20
MOST_CHARS = 80
SAMPLE = 20_000         # documents that the random field learns from
PATTERNS = 500          # different zones that it is fitted to, the most frequent ones
EPOCHS = 12

# fixed patterns of the base spans
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# fixed values: other numbers as they are commonly written, which are no personal data
NUMBERS = ("3.14", "3.14.15", "10.2.1", "1.2.3.4.5", "2024-01-15", "15.01.2024", "12:30", "12:30:05", "1987", "12,345", "12,345.67",
           "99.5%", "1/2", "2024/25", "100-200", "5 000 000", "123456789012345", "1234567890", "v2.0.1", "A4", "3x4", "@home", "x@y")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SEED = re.compile(r"[0-9@]+|[(\[]at[)\]]")
TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\s+|[\s\S]")
AT = re.compile(r"@|[(\[]at[)\]]")
NOT_DIGIT = re.compile("[^0-9]+")
DIGITS = re.compile("[0-9]+")
FIRST_DOT = re.compile(r"(?<=[0-9])\.(?=[0-9])")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _mails(text):
    """Leftmost matches of MAIL, found from their @: a match holds one, and starts in the run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = MAIL.match(text, start) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _is_quad(parts):
    """Four parts of the digits 0-9, each 255 at most; any number of leading zeros."""
    short = [p.lstrip("0") for p in parts]
    return len(parts) == 4 and all(DIGITS.fullmatch(p) and len(s) <= 3 and int(s or 0) <= 255 for p, s in zip(parts, short))


def _quads(text):
    """Leftmost matches of IP, found from their dots: a long run of digits without one is passed over."""
    end, dot = 0, FIRST_DOT.search(text)
    while dot:
        start = dot.start()
        while start > end and text[start - 1] in "0123456789":
            start -= 1
        m = IP.match(text, start)
        end = m.end() if m else dot.start() + 1
        if m:
            yield m
        dot = FIRST_DOT.search(text, end)


def base_spans(text):
    """(kind, start, end) in the order of KINDS and start; and whether a match was too long for its kind."""
    out, long = [("email", a, b) for a, b in _mails(text)] if "@" in text else [], False
    if re.search("[0-9]", text):
        for m in _quads(text):
            if _is_quad(m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            d = NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
            long |= len(d) > 19
        if "+" in text:
            for m in PHONE.finditer(text):
                n = len(NOT_DIGIT.sub("", m[0]))
                if 9 <= n <= 15:
                    out.append(("phone", *m.span()))
                long |= n > 15
    return out, long


def zones(text):
    """(start, end) of stretches of neighbouring chunks that hold a digit or an @."""
    out = []
    for m in SEED.finditer(text):
        a, b = m.span()
        if out and b <= out[-1][1]:
            continue
        if m[0][0] in "([":                    # a spelt-out @: the chunks beside it belong to it
            a, b = a - 1 if a and text[a - 1] == " " else a, b + 1 if text[b:b + 1] == " " else b
        floor = out[-1][1] if out else 0
        while a > floor and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a - out[-1][1] <= 3 and not text[out[-1][1]:a].strip():
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _side(c):
    return "" if not c else "s" if c.isspace() else "d" if c.isdigit() else "a" if c.isalpha() else c


def _shape(s):
    return "".join(f"d{len(t)}" if t[0] in "0123456789" else "a" if t[0].isalpha() else " " if t.isspace() else t for t in TOKEN.findall(s))


def features(s, before, after):
    """Names of the whole-span features of candidate ``s``."""
    digits = NOT_DIGIT.sub("", s)
    n = len(digits)
    shape = _shape(s)
    seps = "".join(sorted({c for c in s if not c.isalnum()}))
    quad = s.split(".")
    is_quad = max(map(len, quad)) <= 3 and _is_quad(quad)
    at = len(AT.findall(s))
    right = AT.split(s, maxsplit=1)[1] if at == 1 else ""
    letters = any(c.isalpha() for c in s)
    good = 13 <= n <= 19 and luhn(digits)
    return ("bias", f"n{min(n, 20)}", f"seps{seps}", f"first{_side(s[0])}", f"last{_side(s[-1])}",
            f"before{_side(before)}", f"after{_side(after)}", f"letters{letters}", f"at{min(at, 2)}{'.' in right or 'dot' in right}",
            *(("quad",) if is_quad else ()), f"luhn{good}{letters}", *((f"shape{shape}",) if len(shape) <= 40 else ()))


def _key(s, before, after):
    digits = NOT_DIGIT.sub("", s)
    quad = s.split(".")
    return (_shape(s), _side(before), _side(after), 13 <= len(digits) <= 19 and luhn(digits),
            max(map(len, quad)) <= 3 and _is_quad(quad))


def candidates(text, start, end):
    """Token borders of text[start:end], and (i, j) of segments that may be an entity."""
    cuts = [start] + [m.end() for m in TOKEN.finditer(text, start, end)]
    n = len(cuts) - 1
    head = [text[cuts[i]].isalnum() or text[cuts[i]] in "+([" for i in range(n)]
    tail = [text[cuts[i + 1] - 1].isalnum() or text[cuts[i + 1] - 1] in ")]" for i in range(n)]
    some = [0]
    for i in range(n):
        some.append(some[-1] + (text[cuts[i]] in "0123456789@" or text[cuts[i]] in "(["))
    pairs = []
    for j in range(1, n + 1):
        if tail[j - 1]:
            for i in range(max(0, j - MOST_TOKENS), j):
                if head[i] and some[j] > some[i] and cuts[j] - cuts[i] <= MOST_CHARS:
                    pairs.append((i, j))
    return cuts, pairs


class Field:
    """Weights (kind, feature) and inference."""

    def __init__(self, weights):
        self.weights, self.cache = weights, {}

    def scores(self, text, a, b):
        before, after = text[a - 1:a], text[b:b + 1]
        s = text[a:b]
        key = _key(s, before, after)
        got = self.cache.get(key)
        if got is None:
            f = features(s, before, after)
            got = tuple(sum(self.weights.get((k, x), 0.0) for x in f) for k in KINDS)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[key] = got
        return got

    def decode(self, text, start, end):
        """Best segmentation of text[start:end]: (kind, start, end) of its entities."""
        cuts, pairs = candidates(text, start, end)
        ends = {}
        for i, j in pairs:
            ends.setdefault(j, []).append(i)
        best, back = [0.0], [None]
        for j in range(1, len(cuts)):
            top, how = best[j - 1], None
            for i in ends.get(j, ()):
                for k, s in zip(KINDS, self.scores(text, cuts[i], cuts[j])):
                    if best[i] + s > top:
                        top, how = best[i] + s, (i, k)
            best.append(top)
            back.append(how)
        out, j = [], len(cuts) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((k, cuts[i], cuts[j]))
                j = i
        return out[::-1]

    def spans(self, text):
        """Base spans and those that the field adds, in the order of KINDS and start."""
        base, _ = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        added = []
        for start, end in zones(text):
            at = start
            for a, b in [x for x in taken if x[1] > start and x[0] < end] + [(end, end)]:
                if a > at:
                    added += self.decode(text, at, min(a, end))
                at = max(at, b)
        return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def _fit(patterns):
    """Maximum likelihood by gradient ascent; ``patterns``: (zone with a character either side, gold spans, count)."""
    weights = {}
    data = []
    for text, gold, count in patterns:
        cuts, pairs = candidates(text, 1, len(text) - 1)
        place = {c: i for i, c in enumerate(cuts)}
        want = {(place.get(a), place.get(b), k) for k, a, b in gold}
        if any(i is None or j is None or (i, j) not in set(pairs) for i, j, _ in want):
            continue
        feats = {(i, j): features(text[cuts[i]:cuts[j]], text[cuts[i] - 1:cuts[i]], text[cuts[j]:cuts[j] + 1]) for i, j in pairs}
        data.append((len(cuts) - 1, feats, want, min(count, 20) ** 0.5))
    for epoch in range(EPOCHS):
        rate = 0.3 / (1 + epoch / 8)
        for n, feats, want, weight in data:
            score = {(i, j, k): sum(weights.get((k, x), 0.0) for x in f) for (i, j), f in feats.items() for k in KINDS}
            into, outof = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for (i, j, k), s in score.items():
                into[j].append((i, s))
                outof[i].append((j, s))
            ahead, rest = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _logsum([ahead[j - 1]] + [ahead[i] + s for i, s in into[j]])
            for i in range(n - 1, -1, -1):
                rest[i] = _logsum([rest[i + 1]] + [rest[j] + s for j, s in outof[i]])
            for (i, j, k), s in score.items():
                gap = ((i, j, k) in want) - math.exp(ahead[i] + s + rest[j] - ahead[n])
                if abs(gap) > 1e-3:
                    for x in feats[i, j]:
                        weights[k, x] = weights.get((k, x), 0.0) * (1 - 1e-4) + rate * weight * gap / 2
    return weights


def _logsum(x):
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def _rewritten(text, gold):
    """Other ways to write a zone's only span: the same value, a form that the base patterns do not know."""
    kind, a, b = gold[0]
    s, head, tail = text[a:b], text[:a], text[b:]
    forms = []
    if kind == "email":
        forms = [s.replace("@", x) for x in ("(at)", "[at]", " (at) ", " [at] ")]
    elif kind == "phone" and "(" in s:
        digits = NOT_DIGIT.sub("", s)[-10:]
        forms = [s[s.index("("):], f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"]
    elif kind == "card" and s.isdigit() and len(s) == 16:
        forms = [".".join(s[i:i + 4] for i in range(0, 16, 4))]
    return [(head + f + tail, [(kind, a, a + len(f))]) for f in forms]


def _zone_rows(batches):
    """(text) -> (pattern, zone, gold): zones whose base matches are trustworthy."""
    import pyarrow as pa

    for rb in batches:
        rows = []
        for text in rb.column(0).to_pylist():
            if not text or not SEED.search(text):
                continue
            base, long = base_spans(text)
            if long:                          # a swallowed neighbour: no truth to learn from
                continue
            for a, b in zones(text):
                inside = [(k, x, y) for k, x, y in base if x < b and y > a]
                if b - a > 100 or any(x < a or y > b for _, x, y in inside):
                    continue
                if any(p[2] > q[1] for p, q in zip(sorted(inside, key=lambda s: s[1]), sorted(inside, key=lambda s: s[1])[1:])):
                    continue
                zone = (text[a - 1:a] or "\n") + text[a:b] + (text[b:b + 1] or "\n")
                gold = [(k, x - a + 1, y - a + 1) for k, x, y in inside]
                forms = [(zone, gold)]
                if len(gold) == 1:
                    forms += _rewritten(zone, gold)
                for z, g in forms:
                    said = ",".join(f"{k}:{x}:{y}" for k, x, y in g)
                    rows.append((_shape(z) + said, z, said))
        if rows:
            yield pa.record_batch([pa.array(list(c), pa.string()) for c in zip(*rows)], names=["pattern", "zone", "gold"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Field fitted to the zones of at most ``sample`` whole texts, those whose ids have the least hash."""
    ids = pick(docs, "doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")      # at most `sample` ids
    found = texts.mapInArrow(_zone_rows, "pattern string, zone string, gold string").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("zone", "gold")).alias("z"))
    rows = found.orderBy(F.desc("n"), "pattern").limit(PATTERNS).collect()
    data = []
    for r in rows:
        gold = [s.split(":") for s in r["z"]["gold"].split(",")] if r["z"]["gold"] else []
        data.append((r["z"]["zone"], [(k, int(a), int(b)) for k, a, b in gold], r["n"]))
    data += [(f"{a}{x}{b}", [], 9) for x in NUMBERS for a, b in (("\n", " "), (" ", "\n"), (" ", " "), (" ", ","))]
    return Field(_fit(data))


def find(docs: DataFrame, field: Field, keys=("doc_id",)) -> DataFrame:
    """``keys``, base and spans (arrays of kind, start, end in code points, end exclusive) of every whole text.

    Ordered by kind as in KINDS, then start. A null text counts as empty and
    has no span; repeated rows come back repeated; an empty table gives an
    empty result; without training zones only base spans are found.
    """
    rows = pick(docs, *keys, "text")
    kinds = dict(rows.dtypes)
    weights = field.weights

    def run(batches):
        import pyarrow as pa

        own = Field(weights)
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for rb in small(batches):
            at = rb.num_columns - 1
            base, every = [], []
            for text in rb.column(at).to_pylist():
                b, e = own.spans(text) if text and SEED.search(text) else ([], [])
                base.append([dict(zip(("kind", "start", "end"), s)) for s in b])
                every.append([dict(zip(("kind", "start", "end"), s)) for s in e])
            yield pa.record_batch([*rb.columns[:at], pa.array(base, pa.list_(span)), pa.array(every, pa.list_(span))],
                                  names=[*rb.schema.names[:at], "base", "spans"])

    kind = "array<struct<kind string, start long, `end` long>>"
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", base {kind}, spans {kind}")
