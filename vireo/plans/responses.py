"""Feature-response plans. Responses are built from ``embeddings`` (left-joined
to ``labels`` on doc_id = vec_id) as JSON text, then parsed and validated.

Per image: category ``c<label>``; two regions from the first eight coordinates
(x1000); signature = the embedding, colour feature = the embedding reversed;
two sentences. ``pmod(vec_id, 17)`` selects one deliberate defect per residue
(one per rule, plus malformed JSON, a missing key and an empty sentence list),
and toxic-labelled images report a failed colour extraction. Expected vector
lengths are the embedding size (64) here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import endpoint, request_url, url_suffix_key
from ..functions.vectors import array_sum
from ..operators import neighbors as NB
from ..operators import responses as RP
from ..session import shared_path
from ..sources import load_table
from ..sources.jsonl import write_jsonl

DIM = 64
MARKER = "store/"
HOSTS, PORTS = ("h1", "h2"), (8081, 7081)
NEAREST = 3


def _empty_vecs():
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<array<double>>>"))


def payloads(spark, sf_dir):
    e = load_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    lab = load_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    x = e.join(lab, e.vec_id == lab.doc_id, "left")
    m = F.pmod(F.col("vec_id"), F.lit(17))
    v = F.col("embedding").cast("array<double>")
    scaled = F.transform(v, lambda t: t * 1000.0)
    cat = F.concat(F.lit("c"), F.col("label").cast("string"))
    url = F.concat(F.lit("img.example.com/" + MARKER), F.col("vec_id").cast("string"), F.lit(".jpg"))

    def vecs(vec):
        return F.create_map(cat, F.array(vec))

    roi = F.when(m == 2, _empty_vecs()).otherwise(
        F.create_map(cat, F.array(F.slice(scaled, 1, 4), F.slice(scaled, 5, 4))))
    sentence = F.when(m == 3, F.lit(None).cast("array<string>")) \
        .when(m == 15, F.array().cast("array<string>")) \
        .otherwise(F.array(F.concat(F.lit("item "), F.col("vec_id").cast("string")),
                           F.concat(F.lit("label "), F.col("label").cast("string"))))
    signature = F.when(m == 6, _empty_vecs()).when(m == 11, vecs(F.slice(v, 1, DIM - 1))).otherwise(vecs(v))
    color = F.when(m == 7, _empty_vecs()).when(m == 12, vecs(F.slice(F.reverse(v), 1, DIM - 1))) \
        .otherwise(vecs(F.reverse(v)))
    fields = [
        ("url", url),
        ("result_roi", m != 0),
        ("result_sentence", m != 1),
        ("result_signature", m != 4),
        ("result_color", (m != 5) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)),
        ("roi", roi),
        ("sentence", sentence),
        ("signature", signature),
        ("color_feature", color),
        ("feature", vecs(v)),
        ("lctgr_nm", F.when(m == 8, F.lit("")).otherwise(F.concat(F.lit("L"), F.col("label").cast("string")))),
        ("mctgr_nm", F.when(m == 9, F.lit(""))
         .otherwise(F.concat(F.lit("M"), F.pmod(F.col("label"), F.lit(3)).cast("string")))),
        ("sctgr_nm", F.when(m == 10, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("S"), F.pmod(F.col("vec_id"), F.lit(5)).cast("string")))),
    ]
    full = F.to_json(F.struct(*[c.alias(n) for n, c in fields]))
    no_roi = F.to_json(F.struct(*[c.alias(n) for n, c in fields if n != "roi"]))
    truncated = full.substr(F.lit(1), F.length(full) - 7)
    payload = F.when(m == 13, truncated).when(m == 14, no_roi).otherwise(full)
    return x.select("vec_id", payload.alias("payload"))


def validated(spark, sf_dir, rules="full"):
    return RP.validate(payloads(spark, sf_dir), signature_dim=DIM, color_dim=DIM, rules=rules)


def q_response_validate(spark, sf_dir):
    return validated(spark, sf_dir).select("vec_id", "reason", "ok")


def q_response_validate_roi(spark, sf_dir):
    return validated(spark, sf_dir, rules="detector").select("vec_id", "reason", "ok")


def q_response_validation_summary(spark, sf_dir):
    return RP.validation_summary(validated(spark, sf_dir))


def _vsum(c):
    return F.round(array_sum(F.flatten(F.flatten(F.map_values(c)))), 6)


def q_response_project_full(spark, sf_dir):
    p = RP.project_full(validated(spark, sf_dir))
    return p.select("url",
                    F.size(F.flatten(F.map_values("roi"))).alias("roi_n"), _vsum(F.col("roi")).alias("roi_sum"),
                    _vsum(F.col("signature")).alias("signature_sum"),
                    _vsum(F.col("feature_color")).alias("feature_color_sum"),
                    F.size("sentence").alias("sentence_n"))


def q_response_project_roi(spark, sf_dir):
    p = RP.project_roi(validated(spark, sf_dir, rules="detector"))
    return p.select("url", F.size(F.flatten(F.map_values("roi"))).alias("roi_n"),
                    _vsum(F.col("roi")).alias("roi_sum"))


def q_response_project_first(spark, sf_dir):
    p = RP.project_first(validated(spark, sf_dir))
    from ..functions.text import roi_text
    return p.select("url", roi_text(F.col("roi")).alias("roi_text"),
                    F.round(array_sum("feature"), 6).alias("feature_sum"),
                    F.round(array_sum("color_feature"), 6).alias("color_sum"), "sentence")


def q_roi_explode(spark, sf_dir):
    return RP.explode_rois(RP.project_roi(validated(spark, sf_dir, rules="detector")), marker=MARKER)


def q_catalogue_upsert(spark, sf_dir):
    """The catalogue (a row per image, every fourth with a text of its own) after the merge with the regions."""
    e = load_table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    cat = e.select(F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")).alias("key"), F.col("vec_id").alias("prd_no"),
                   F.concat(F.lit("L"), F.col("label").cast("string")).alias("lctgr_nm"), F.when(F.col("vec_id") % 4 == 0, F.lit("0 0 1 1")).alias("roi"))
    rois = RP.explode_rois(RP.project_roi(validated(spark, sf_dir, rules="detector")), marker=MARKER)
    return RP.upsert_rois(cat, rois, "key")


def q_response_counters(spark, sf_dir):
    """Counters of accepted and rejected responses, filled while the accepted ones are written as JSON lines."""
    seen, counters = RP.observe_outcomes(validated(spark, sf_dir))
    write_jsonl(RP.project_full(seen), shared_path(spark, "features-full"))
    return spark.createDataFrame(sorted((k, n) for k, n in counters.get.items() if n), "outcome string, n long")


def q_jsonl_variant(spark, sf_dir):
    """Customers written as JSON-lines files whose fields change type and place, read back dynamically.

    The balance is a number, a text or missing, the segment a text or an object, by ``c_custkey`` modulo 3.
    """
    c = load_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    m = F.col("c_custkey") % 3
    as_is = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal", F.col("c_mktsegment").alias("segment")))
    as_text = F.to_json(F.struct("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"), F.struct(F.col("c_mktsegment").alias("name")).alias("segment")))
    without = F.to_json(F.struct("c_custkey", "c_name"))
    path = shared_path(spark, "customers-jsonl")
    c.select(F.when(m == 0, as_is).when(m == 1, as_text).otherwise(without).alias("value")).write.text(path)
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    said = F.schema_of_variant(F.variant_get("v", "$.c_acctbal", "variant"))
    kind = F.when(said == "STRING", said).when(said.isNotNull(), "number")      # the decimals of a number vary
    return v.select(get("$.c_custkey", "long").alias("c_custkey"), get("$.c_name", "string").alias("c_name"),
                    get("$.c_acctbal", "double").alias("c_acctbal"), kind.alias("kind"),
                    F.coalesce(get("$.segment.name", "string"), get("$.segment", "string")).alias("segment"))


def q_enrich_with_status(spark, sf_dir):
    """Every page with its title and a status: pages without a title, or with two, are kept and told apart."""
    pg = load_table(spark, sf_dir, "pages", ["page_id", "html"])

    def fetch(batch, client):
        found = batch.assign(title=batch["html"].str.findall(r"(?s)<title>(.+?)</title>")).explode("title")
        return found[found["title"].notna()][["page_id", "title"]]
    return RP.enrich_batches_with_status(pg, fetch, "page_id", "title string").select("page_id", "title", "status")


def q_url_suffix_key(spark, sf_dir):
    pg = load_table(spark, sf_dir, "pages", ["page_id", "url"])
    return pg.select("page_id", url_suffix_key(F.col("url"), ".example.").alias("key"))


def q_request_url(spark, sf_dir):
    p = load_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_brand", "p_name"])
    img = F.concat(F.lit("img.example.com/p/"), F.col("p_partkey").cast("string"))
    at = endpoint(img, HOSTS, PORTS)
    # fixed formats of the service's two requests: with categories, and of the detector
    full = request_url("http://%s:%d/request_handler?url=http://%s&%s&is_browser=0", at["host"], at["port"], img,
                       [("lctgr_nm", F.col("p_type")), ("mctgr_nm", F.col("p_brand")), ("sctgr_nm", F.col("p_name"))])
    detector = F.format_string("http://%s:%d/request_handler?url=http://%s&is_browser=0", at["host"], at["port"], img)
    return p.select("p_partkey", full.alias("request"), detector.alias("detector_request"))


def q_feature_neighbors(spark, sf_dir):
    """The whole chain: payload, validation, first projection, one vector, nearest neighbours."""
    vec = RP.first_feature_vector(RP.project_first(validated(spark, sf_dir)))
    top = NB.cosine_top_k(vec, "url", "vec", NEAREST, dim=2 * DIM)
    return top.select("query", "rank", "ref", F.round("distance", 6).alias("distance"))


def _content(spark, sf_dir):
    """Content of the https pages only: the others are deliberate missing keys of the join."""
    pg = load_table(spark, sf_dir, "pages", ["url", "html"])
    return pg.filter(F.col("url").startswith("https")) \
        .select("url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("payload"))


def q_enrich_by_url(spark, sf_dir):
    cat = load_table(spark, sf_dir, "pages", ["page_id", "url"])
    out = RP.enrich_by_url(cat, _content(spark, sf_dir))
    return out.select("page_id", "status", F.length("payload").alias("payload_len"))


def q_enrich_map_batches(spark, sf_dir):
    pg = load_table(spark, sf_dir, "pages", ["page_id", "url", "html"])

    def fetch(batch, client):
        titles = batch["html"].str.extract(r"(?s)<title>(.*?)</title>", expand=False)
        out = batch[["page_id", "url"]].assign(title=titles)
        return out[out["title"].notna() & (out["title"].str.len() > 0)]
    return RP.enrich_batches(pg, fetch, "page_id long, url string, title string")


CUSTOMER_SCHEMA = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


def q_jsonl_roundtrip(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    lines = c.select(F.to_json(F.struct(*c.columns)).alias("value"))
    back = lines.select(F.from_json("value", CUSTOMER_SCHEMA).alias("r")).select("r.*")
    return back


def q_last_record(spark, sf_dir):
    from ..operators.relational import last_record
    o = load_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    lines = o.select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_custkey", "o_totalprice")).alias("value"))
    last = last_record(lines, "o_orderkey")
    return last.select(F.from_json("value", "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE")
                       .alias("r")).select("r.*")


_P = f"""
WITH x AS (
  SELECT e.vec_id, e.label, CAST(e.embedding AS DOUBLE[]) AS v, coalesce(l.toxic, 0) AS toxic,
         e.vec_id % 17 AS m,
         'img.example.com/{MARKER}' || CAST(e.vec_id AS VARCHAR) || '.jpg' AS url
  FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id),
y AS (
  SELECT *, list_transform(v, lambda t: t * 1000.0) AS s,
         CASE WHEN m = 13 THEN 'bad_json'
              WHEN m = 0 THEN 'roi_flag'
              WHEN m = 1 THEN 'sentence_flag'
              WHEN m IN (2, 14) THEN 'roi_empty'
              WHEN m = 3 THEN 'sentence_empty'
              WHEN m = 4 THEN 'signature_flag'
              WHEN m = 5 OR toxic = 1 THEN 'color_flag'
              WHEN m = 6 THEN 'signature_empty'
              WHEN m = 7 THEN 'color_empty'
              WHEN m = 8 THEN 'lctgr_empty'
              WHEN m = 9 THEN 'mctgr_empty'
              WHEN m = 10 THEN 'sctgr_empty'
              WHEN m = 11 THEN 'signature_dim'
              WHEN m = 12 THEN 'color_dim' END AS reason,
         CASE WHEN m = 13 THEN 'bad_json'
              WHEN m = 0 THEN 'roi_flag'
              WHEN m IN (2, 14) THEN 'roi_empty' END AS roi_reason
  FROM x)
"""


def _tr(expr: str) -> str:
    return f"CAST(CAST(trunc({expr}) AS INTEGER) AS VARCHAR)"


ORACLE = {
    "response_validate": _P + "SELECT vec_id, reason, reason IS NULL AS ok FROM y",
    "response_validate_roi": _P + "SELECT vec_id, roi_reason AS reason, roi_reason IS NULL AS ok FROM y",
    "response_validation_summary": _P + "SELECT coalesce(reason, 'ok') AS outcome, count(*) AS n FROM y GROUP BY 1",
    "response_project_full": _P + """
SELECT url, CAST(2 AS INTEGER) AS roi_n, round(list_sum(s[1:8]), 6) AS roi_sum,
       round(list_sum(v), 6) AS signature_sum, round(list_sum(list_reverse(v)), 6) AS feature_color_sum,
       CAST(CASE WHEN m = 15 THEN 0 ELSE 2 END AS INTEGER) AS sentence_n
FROM y WHERE reason IS NULL""",
    "response_project_roi": _P + """
SELECT url, CAST(2 AS INTEGER) AS roi_n, round(list_sum(s[1:8]), 6) AS roi_sum FROM y WHERE roi_reason IS NULL""",
    "response_project_first": _P + f"""
SELECT url, concat_ws(' ', {_tr('s[1]')}, {_tr('s[2]')}, {_tr('s[3]')}, {_tr('s[4]')}) AS roi_text,
       round(list_sum(v), 6) AS feature_sum, round(list_sum(list_reverse(v)), 6) AS color_sum,
       'item ' || CAST(vec_id AS VARCHAR) AS sentence
FROM y WHERE reason IS NULL AND m <> 15""",
    "roi_explode": _P + f"""
SELECT CAST(vec_id AS VARCHAR) || '.jpg' AS key, 0 AS pos, true AS is_first,
       concat_ws(' ', {_tr('s[1]')}, {_tr('s[2]')}, {_tr('s[3]')}, {_tr('s[4]')}) AS roi_text
FROM y WHERE roi_reason IS NULL
UNION ALL
SELECT CAST(vec_id AS VARCHAR) || '.jpg' AS key, 1 AS pos, false AS is_first,
       concat_ws(' ', {_tr('s[5]')}, {_tr('s[6]')}, {_tr('s[7]')}, {_tr('s[8]')}) AS roi_text
FROM y WHERE roi_reason IS NULL""",
    "catalogue_upsert": _P + f"""
, r AS (
  SELECT vec_id, 0 AS pos, concat_ws(' ', {_tr('s[1]')}, {_tr('s[2]')}, {_tr('s[3]')}, {_tr('s[4]')}) AS txt FROM y WHERE roi_reason IS NULL
  UNION ALL
  SELECT vec_id, 1 AS pos, concat_ws(' ', {_tr('s[5]')}, {_tr('s[6]')}, {_tr('s[7]')}, {_tr('s[8]')}) AS txt FROM y WHERE roi_reason IS NULL)
SELECT CAST(e.vec_id AS VARCHAR) || '.jpg' AS key, e.vec_id AS prd_no, 'L' || CAST(e.label AS VARCHAR) AS lctgr_nm,
       CASE WHEN r.pos IS NULL THEN CASE WHEN e.vec_id % 4 = 0 THEN '0 0 1 1' END ELSE r.txt END AS roi,
       CASE WHEN r.pos IS NULL THEN 'unchanged' WHEN r.pos = 0 THEN 'updated' ELSE 'inserted' END AS action
FROM embeddings e LEFT JOIN r ON e.vec_id = r.vec_id""",
    "response_counters": _P + """
SELECT coalesce(reason, 'ok') AS outcome, count(*) AS n FROM y GROUP BY 1 UNION ALL SELECT 'seen' AS outcome, count(*) AS n FROM y""",
    "jsonl_variant": """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 < 2 THEN c_acctbal END AS c_acctbal,
       CASE c_custkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'STRING' END AS kind,
       CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS segment FROM customer""",
    "enrich_with_status": """
WITH t AS (SELECT page_id, regexp_extract_all(html, '(?s)<title>(.+?)</title>', 1) AS t FROM pages)
SELECT page_id, t[1] AS title, CASE len(t) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM t""",
    "url_suffix_key": """
SELECT page_id, CASE WHEN strpos(url, '.example.') > 0 THEN substr(url, strpos(url, '.example.') + 9) END AS key
FROM pages""",
    "request_url": f"""
WITH p AS (SELECT *, 'img.example.com/p/' || CAST(p_partkey AS VARCHAR) AS img FROM part),
h AS (SELECT *, md5(img) AS d FROM p),
e AS (SELECT *, list_extract({list(HOSTS)}, CAST(('0x' || substr(d, 1, 6)) AS BIGINT) % {len(HOSTS)} + 1) AS host,
             list_extract({list(PORTS)}, CAST(('0x' || substr(d, 7, 6)) AS BIGINT) % {len(PORTS)} + 1) AS port FROM h),
u AS (SELECT *, 'http://' || host || ':' || CAST(port AS VARCHAR) || '/request_handler?url=http://' || img AS head FROM e)
SELECT p_partkey, head || '&lctgr_nm=' || replace(url_encode(p_type), '%20', '+')
       || '&mctgr_nm=' || replace(url_encode(p_brand), '%20', '+')
       || '&sctgr_nm=' || replace(url_encode(p_name), '%20', '+') || '&is_browser=0' AS request,
       head || '&is_browser=0' AS detector_request
FROM u""",
    "feature_neighbors": _P + f"""
, f AS (SELECT url, list_concat(v, list_reverse(v)) AS w FROM y WHERE reason IS NULL AND m <> 15),
s AS (SELECT a.url AS query, b.url AS ref,
             1 - list_dot_product(a.w, b.w) / (sqrt(list_dot_product(a.w, a.w)) * sqrt(list_dot_product(b.w, b.w))) AS distance
      FROM f a JOIN f b ON a.url <> b.url),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, ref) AS rank FROM s)
SELECT query, CAST(rank AS INTEGER) AS rank, ref, round(distance, 6) AS distance FROM r WHERE rank <= {{NEAREST}}""".replace("{NEAREST}", str(NEAREST)),
    "enrich_by_url": """
WITH c AS (SELECT url, regexp_extract(html, '<title>(.*?)</title>', 1) AS payload FROM pages WHERE starts_with(url, 'https'))
SELECT p.page_id,
       CASE WHEN c.payload IS NULL THEN 'missing' WHEN length(trim(c.payload)) = 0 THEN 'bad_payload' ELSE 'ok' END AS status,
       CAST(length(c.payload) AS INTEGER) AS payload_len
FROM pages p LEFT JOIN c USING (url)""",
    "enrich_map_batches": """
SELECT page_id, url, title
FROM (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)
WHERE title <> ''""",
    "jsonl_roundtrip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "last_record": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1",
}

QUERIES = {
    "response_validate": q_response_validate,
    "response_validate_roi": q_response_validate_roi,
    "response_validation_summary": q_response_validation_summary,
    "response_project_full": q_response_project_full,
    "response_project_roi": q_response_project_roi,
    "response_project_first": q_response_project_first,
    "roi_explode": q_roi_explode,
    "catalogue_upsert": q_catalogue_upsert,
    "response_counters": q_response_counters,
    "jsonl_variant": q_jsonl_variant,
    "enrich_with_status": q_enrich_with_status,
    "url_suffix_key": q_url_suffix_key,
    "feature_neighbors": q_feature_neighbors,
    "request_url": q_request_url,
    "enrich_by_url": q_enrich_by_url,
    "enrich_map_batches": q_enrich_map_batches,
    "jsonl_roundtrip": q_jsonl_roundtrip,
    "last_record": q_last_record,
}
