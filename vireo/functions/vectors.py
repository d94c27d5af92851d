"""Array/vector expressions built from Spark higher-order functions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """1 - u.v / (|u| |v|); NULL when either vector has zero norm."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den == 0, F.lit(None)).otherwise(F.lit(1.0) - dot(a, b) / den)


def rounded(x, digits: int) -> Column:
    """``round(x, digits)`` of a double, without a decimal number per value: that is left to values near a tie, large
    ones, infinite ones and NaN."""
    x, by = _c(x), 10.0 ** digits
    below = F.floor(x * by)
    safe = (F.abs(x * by) < 1e9) & (F.abs(x * by - below - 0.5) > 1e-6)
    return F.when(safe, F.floor(x * by + 0.5) / by).otherwise(F.round(x, digits))


def concat_vectors(a, b) -> Column:
    return F.concat(_c(a), _c(b))


def array_sum(a) -> Column:
    return F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x)


def rescale(a, center: float = 127.5, scale: float = 255.0) -> Column:
    """Pixel rescale (x - center) / scale for every element."""
    return F.transform(as_double(a), lambda x: (x - F.lit(center)) / F.lit(scale))


def one_hot(label, n: int) -> Column:
    """Dense float one-hot vector of length ``n``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: (i == _c(label)).cast("float"))


def argmax(a) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(_c(a), F.array_max(_c(a))) - 1


def softmax(logits) -> Column:
    """exp(x - max) / sum(exp(x - max)), element-wise over an array."""
    a = as_double(logits)
    m = F.array_max(a)
    ex = F.transform(a, lambda x: F.exp(x - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / tot)


def logspace(start: float, stop: float, num: int, base: float = 10.0) -> Column:
    """Array of ``num`` values base**(start + i*(stop-start)/(num-1))."""
    step = (stop - start) / (num - 1) if num > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)),
                       lambda i: F.pow(F.lit(base), F.lit(start) + i * F.lit(step)))
