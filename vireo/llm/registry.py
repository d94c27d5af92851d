"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment, exact, langid, mixing, packing, passages, pii, quality, setjoin, simhash, spelling, toxicity, weighted
from .common import crc_mod, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def hex64(c):
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op1_simhash(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


def op2_quality(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), crc_mod(3) == 1
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", where=~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_langid(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), crc_mod(4) == 2
    out = langid.predict(docs, langid.fit(docs, where=~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, 2048, with_ids=False)


def op6_weighted(spark, sf_dir):
    out = weighted.compare_neighbours(table(spark, sf_dir, "documents"))
    hex_of = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), hex_of("fingerprint"),
                      hex_of("edited_fingerprint"), "near_edited", "near_next")


def op7_toxicity(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), crc_mod(5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", where=~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_exact_dedup(spark, sf_dir):
    out = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = pii.find(docs, pii.fit(docs))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(number, pii.KINDS), F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"))


# share of the tokens wanted of each kind of document, by its labels: as first stated, whatever the documents hold
TARGETS = {"good_clean": 0.85, "good_toxic": 0.03, "bad_clean": 0.10, "bad_toxic": 0.02}


def domains(labels):
    """labels -> (doc_id, domain)"""
    name = F.concat(F.when(F.col("quality") == 1, "good_").otherwise("bad_"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    return labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", name.alias("domain"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)


def op11_alignment(spark, sf_dir):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = alignment.align(table(spark, sf_dir, "documents"), a, b)
    said = F.coalesce(F.lower(F.hex("groups_sha")), F.lit("")).alias("groups_sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", said)


def op12_set_join(spark, sf_dir):
    return setjoin.similar_groups(table(spark, sf_dir, "documents"), shingle=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"), one_in=97)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM d""",
    "op12_set_join": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS t
            FROM d),
        e AS (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM s),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT s.doc_id, len(s.t) AS n_shingles, component_id FROM s JOIN least ON s.doc_id = least.x""",
}

QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_quality, op3_passages, op4_langid, op5_packing, op6_weighted, op7_toxicity, op8_exact_dedup, op9_pii,
    op10_mixing, op11_alignment, op12_set_join, op13_spelling)}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
