"""String expressions: URL building, key extraction, ROI text, ASCII folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_encode_plus(s) -> Column:
    """Form encoding as ``urllib.urlencode`` (space -> '+'); '*' is escaped too,
    which Java's encoder leaves alone."""
    return F.replace(F.url_encode(_c(s)), F.lit("*"), F.lit("%2A"))


def query_string(pairs: list[tuple[str, Column | str]]) -> Column:
    """``k1=v1&k2=v2`` with form-encoded values, keys in the given order."""
    parts = []
    for k, v in pairs:
        parts.append(F.concat(F.lit(url_encode_plus_literal(k) + "="), url_encode_plus(v)))
    return F.concat_ws("&", *parts)


def url_encode_plus_literal(s: str) -> str:
    from urllib.parse import quote_plus
    return quote_plus(s, safe="")


def endpoint(url, hosts: list[str], ports: list[int]) -> Column:
    """Deterministic endpoint choice from the URL's md5: digits 1-6 modulo the
    hosts, 7-12 modulo the ports (the reference drew one at random per request)."""
    h = F.md5(_c(url))
    pick = lambda first, n: (F.conv(F.substring(h, first, 6), 16, 10).cast("int") % n + 1).cast("int")
    host = F.element_at(F.array(*[F.lit(x) for x in hosts]), pick(1, len(hosts)))
    port = F.element_at(F.array(*[F.lit(p) for p in ports]), pick(7, len(ports)))
    return F.struct(host.alias("host"), port.alias("port"))


def request_url(prefix_format: str, host, port, url, params: list[tuple[str, Column | str]]) -> Column:
    """``format_string(prefix_format, host, port, url, query_string(params))``."""
    return F.format_string(prefix_format, _c(host), _c(port), _c(url), query_string(params))


def url_suffix_key(url, marker: str) -> Column:
    """Text after the first ``marker`` in the URL (NULL when absent)."""
    import re
    parts = F.split(_c(url), re.escape(marker), 2)
    return F.when(F.size(parts) == 2, F.element_at(parts, 2))


def roi_text(roi) -> Column:
    """First four coordinates truncated toward zero, space-joined."""
    return F.concat_ws(" ", F.transform(F.slice(_c(roi), 1, 4), lambda x: x.cast("int").cast("string")))


def ascii_only(text) -> Column:
    """Drop every non-ASCII character (``encode('ascii', 'ignore')``)."""
    return F.regexp_replace(_c(text), r"[^\x00-\x7F]", "")
