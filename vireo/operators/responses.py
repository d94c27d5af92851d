"""Feature-service responses: parse, validate, project, explode regions, enrich.

A response is one JSON object per image. Validation is a single ``CASE`` chain
over the parsed struct, so every rejected row keeps a *reason* (the reference
printed it and dropped the row); projection and ROI explosion are plain
expressions. Enrichment joins a table of fetched content on the URL, or calls
a user function once per Arrow batch (``mapInPandas``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import roi_text, url_suffix_key

# Fixed values that must equal the reference: vector lengths of the binary
# signature (832*9/64 + 1024/64 with integer division) and the colour feature
# (18*3*3 + 4).
SIGNATURE_DIM = 133
COLOR_DIM = 166

_VECS = T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.DoubleType())))

RESPONSE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("result_roi", T.BooleanType()),
    T.StructField("result_sentence", T.BooleanType()),
    T.StructField("result_signature", T.BooleanType()),
    T.StructField("result_color", T.BooleanType()),
    T.StructField("roi", _VECS),
    T.StructField("sentence", T.ArrayType(T.StringType())),
    T.StructField("signature", _VECS),
    T.StructField("color_feature", _VECS),
    T.StructField("feature", _VECS),
    T.StructField("lctgr_nm", T.StringType()),
    T.StructField("mctgr_nm", T.StringType()),
    T.StructField("sctgr_nm", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])

# Reason codes, in the order the rules are checked (fixed rule order of the
# reference's sanity check; the two dimension rules run after the first eleven).
REASONS = ("roi_flag", "sentence_flag", "roi_empty", "sentence_empty", "signature_flag",
           "color_flag", "signature_empty", "color_empty", "lctgr_empty", "mctgr_empty",
           "sctgr_empty", "signature_dim", "color_dim")


def parse_responses(df: DataFrame, payload: str = "payload", out: str = "resp") -> DataFrame:
    """JSON text -> struct column ``out``; malformed text sets ``out._corrupt``."""
    parsed = F.from_json(F.col(payload), RESPONSE_SCHEMA,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn(out, parsed)


def _not_true(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _empty_map(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _first_len(m: Column) -> Column:
    first_cat = F.try_element_at(F.map_values(m), F.lit(1))
    return F.size(F.try_element_at(first_cat, F.lit(1)))


def rejection_reason(r: Column, signature_dim: int = SIGNATURE_DIM, color_dim: int = COLOR_DIM,
                     rules: str = "full") -> Column:
    """The reason a parsed response is rejected, NULL when it passes.

    ``rules="full"``: the 13 rules; ``rules="detector"``: roi flag and roi
    presence only. Unparseable JSON -> ``bad_json``. A missing or null flag
    rejects (deliberate: the reference let null pass and failed on a missing key).
    """
    bad = r.isNull() | r["_corrupt"].isNotNull()
    if rules == "detector":
        return (F.when(bad, F.lit("bad_json"))
                .when(_not_true(r["result_roi"]), F.lit("roi_flag"))
                .when(_empty_map(r["roi"]), F.lit("roi_empty")))
    if rules != "full":
        raise ValueError(f"unknown rules {rules!r}")
    sig_len = _first_len(r["signature"])
    col_len = _first_len(r["color_feature"])
    return (F.when(bad, F.lit("bad_json"))
            .when(_not_true(r["result_roi"]), F.lit("roi_flag"))
            .when(_not_true(r["result_sentence"]), F.lit("sentence_flag"))
            .when(_empty_map(r["roi"]), F.lit("roi_empty"))
            .when(r["sentence"].isNull(), F.lit("sentence_empty"))
            .when(_not_true(r["result_signature"]), F.lit("signature_flag"))
            .when(_not_true(r["result_color"]), F.lit("color_flag"))
            .when(_empty_map(r["signature"]), F.lit("signature_empty"))
            .when(_empty_map(r["color_feature"]), F.lit("color_empty"))
            .when(_blank(r["lctgr_nm"]), F.lit("lctgr_empty"))
            .when(_blank(r["mctgr_nm"]), F.lit("mctgr_empty"))
            .when(_blank(r["sctgr_nm"]), F.lit("sctgr_empty"))
            .when(F.coalesce(sig_len, F.lit(-1)) != signature_dim, F.lit("signature_dim"))
            .when(F.coalesce(col_len, F.lit(-1)) != color_dim, F.lit("color_dim")))


def validate(df: DataFrame, payload: str = "payload", signature_dim: int = SIGNATURE_DIM,
             color_dim: int = COLOR_DIM, rules: str = "full") -> DataFrame:
    """Adds ``resp`` (parsed), ``reason`` and ``ok``; keeps every row."""
    p = parse_responses(df, payload)
    return p.withColumn("reason", rejection_reason(F.col("resp"), signature_dim, color_dim, rules)) \
        .withColumn("ok", F.col("reason").isNull())


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("ok"))


def validation_summary(validated: DataFrame) -> DataFrame:
    """Rows per outcome ('ok' or the reason) in one aggregate."""
    return validated.groupBy(F.coalesce(F.col("reason"), F.lit("ok")).alias("outcome")) \
        .agg(F.count(F.lit(1)).alias("n"))


def project_full(validated: DataFrame) -> DataFrame:
    """url, roi, signature, feature_color (renamed colour feature), sentence."""
    r = F.col("resp")
    return accepted(validated).select(r["url"].alias("url"), r["roi"].alias("roi"),
                                      r["signature"].alias("signature"),
                                      r["color_feature"].alias("feature_color"),
                                      r["sentence"].alias("sentence"))


def project_roi(validated: DataFrame) -> DataFrame:
    r = F.col("resp")
    return accepted(validated).select(r["url"].alias("url"), r["roi"].alias("roi"))


def _first_vec(m: Column) -> Column:
    return F.try_element_at(F.try_element_at(F.map_values(m), F.lit(1)), F.lit(1))


def project_first(validated: DataFrame) -> DataFrame:
    """First category's first vector of roi / feature / colour feature and the
    first sentence (document order); rows where one is absent are dropped."""
    r = F.col("resp")
    out = accepted(validated).select(
        r["url"].alias("url"), _first_vec(r["roi"]).alias("roi"),
        _first_vec(r["feature"]).alias("feature"), _first_vec(r["color_feature"]).alias("color_feature"),
        F.try_element_at(r["sentence"], F.lit(1)).alias("sentence"))
    return out.dropna(subset=["roi", "feature", "color_feature", "sentence"])


def first_feature_vector(projected_first: DataFrame) -> DataFrame:
    """(url, feature ++ color_feature): the nearest-neighbour input vector."""
    return projected_first.select("url", F.concat("feature", "color_feature").alias("vec"))


def explode_rois(projected: DataFrame, url: str = "url", roi: str = "roi",
                 *, marker: str) -> DataFrame:
    """One row per region: (key, pos, is_first, roi_text). The first region
    updates the catalogue row, the others become inserted copies (the caller's
    table write decides: append / MERGE)."""
    return projected.select(url_suffix_key(F.col(url), marker).alias("key"),
                            F.posexplode(F.flatten(F.map_values(F.col(roi)))).alias("pos", "r")) \
        .select("key", "pos", (F.col("pos") == 0).alias("is_first"), roi_text(F.col("r")).alias("roi_text"))


def upsert_rois(catalogue: DataFrame, rois: DataFrame, key: str, roi: str = "roi") -> DataFrame:
    """The whole new catalogue after a merge with region rows (``key``, pos, is_first, roi_text), with an ``action``:

    ``updated``: the row of the key takes the text of its first region; ``inserted``: a copy of that row for
    every other region; ``unchanged``: no region has the key. Regions without a catalogue row add nothing.
    Two regions with the same key and position raise, as an ambiguous merge source does. A NULL key matches nothing.
    One join: the positions of a key are counted with map-side partial sums, the catalogue is shuffled once.
    """
    src = rois.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("_key"), "pos").agg(
        F.count(F.lit(1)).alias("_n"), F.first("is_first").alias("_first"), F.first("roi_text").alias("_text"))
    twice = F.raise_error(F.concat(F.lit("two regions with the same key and position: "), F.col("_key"))).cast("boolean")
    src = src.withColumn("_first", F.when(F.col("_n") > 1, twice).otherwise(F.col("_first"))).select("_key", "_first", "_text")
    met = catalogue.join(src, F.col(key) == F.col("_key"), "left")
    action = F.when(F.col("_first").isNull(), "unchanged").when(F.col("_first"), "updated").otherwise("inserted")
    text = F.when(F.col("_first").isNull(), F.col(roi)).otherwise(F.col("_text"))
    return met.select(*[text.alias(roi) if c == roi else F.col(c) for c in catalogue.columns], action.alias("action"))


def observe_outcomes(validated: DataFrame, name: str = "outcomes") -> tuple[DataFrame, Observation]:
    """``validated`` with counters that fill while a sink consumes it: ``seen``, ``ok`` and one per reason.

    Read ``observation.get`` after the action; the data is not scanned for the counts.
    """
    seen = Observation(name)
    why = F.coalesce(F.col("reason"), F.lit("ok"))
    counts = [F.count(F.when(why == r, 1)).alias(r) for r in ("ok", "bad_json", *REASONS)]
    return validated.observe(seen, F.count(F.lit(1)).alias("seen"), *counts), seen


def enrich_by_url(catalogue: DataFrame, content: DataFrame, url: str = "url",
                  payload: str = "payload") -> DataFrame:
    """Attach fetched content by URL (left join) with a status column:
    ``ok`` / ``missing`` (no content) / ``bad_payload`` (empty content)."""
    j = catalogue.join(content, url, "left")
    status = F.when(F.col(payload).isNull(), F.lit("missing")) \
        .when(F.length(F.trim(F.col(payload))) == 0, F.lit("bad_payload")).otherwise(F.lit("ok"))
    return j.withColumn("status", status)


def enrich_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema,
                   setup: Callable[[], object] | None = None) -> DataFrame:
    """Plug-in enrichment: ``fn(batch, client)`` on every Arrow batch of every
    partition; ``setup()`` builds one client per partition (e.g. an HTTP session).
    Rows ``fn`` does not return are dropped (the reference's failed requests);
    :func:`enrich_batches_with_status` keeps them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = setup() if setup else None
        for b in batches:
            yield fn(b, client)
    return df.mapInPandas(run, schema)


def enrich_batches_with_status(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], key: str, adds: str,
                               setup: Callable[[], object] | None = None) -> DataFrame:
    """Plug-in enrichment that loses no row: all columns of ``df``, the columns ``adds`` (a DDL string) and ``status``.

    ``fn(batch, client)`` returns ``key`` and the added columns for the rows it could serve. ``ok``: one answer;
    ``missing``: none (added columns NULL); ``ambiguous``: several, of which the first counts. ``key`` must be unique in a
    batch. Errors of ``fn`` are raised.
    """
    cols, added = df.columns, [f.name for f in T._parse_datatype_string(adds).fields]
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {adds}, status string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = setup() if setup else None
        for b in batches:
            answers = fn(b, client)
            often = answers[key].value_counts()
            one = answers.drop_duplicates(key)[[key, *added]]
            out = b.merge(one, on=key, how="left", suffixes=("", "_y"))
            n = out[key].map(often).fillna(0)
            yield out.assign(status=n.map(lambda x: "missing" if x == 0 else "ok" if x == 1 else "ambiguous"))[[*cols, *added, "status"]]

    return df.mapInPandas(run, form)
