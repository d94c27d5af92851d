"""Model-scoring, sweep and dictionary plans.

* classifier data: ``embeddings`` (vec_id, 64-d vector, label 0..9). Rows in
  ``vec_id`` order: the first 100 are validation (the reference kept the first
  rows of its training set for validation), the next 100 test, the rest train.
* model: class centroids of the training rows (a weight matrix), logits scaled
  by 10, softmax, top-5 classes.
* dictionaries (text derived from ``nation``): label map entries
  ``target_class: n_nationkey`` / ``target_class_string: "n<8-digit key>"``,
  one file per region, every sixth entry without its string; uid -> name lines
  only for regions 0..3: deliberate missing keys, so that the lookup's empty
  default and its unmatched rows are seen.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import one_hot, rescale
from ..operators import inference as INF
from ..operators import sweep as SW
from ..operators.relational import fixed_batches, positional_splits
from ..sources import load_table
from ..sources import lookups as LK

N_VALID = 100
TEMPERATURE = 10.0
TOP_K = 5
BATCH = 3


def classifier_rows(spark, sf_dir):
    e = load_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return positional_splits(e, ["vec_id"], [N_VALID, N_VALID], ["validation", "test"], "train")


def model(spark, sf_dir):
    rows = classifier_rows(spark, sf_dir)
    w = INF.fit_centroids(rows.filter(F.col("split") == "train"), "embedding", "label")
    return INF.collect_model(w)


def _uid(col):
    return F.concat(F.lit("n"), F.lpad(col.cast("string"), 8, "0"))


def label_map_texts(spark, sf_dir):
    n = load_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    # nations 3, 9, 15, .. have no string: their entry must not shift those that follow
    said = F.when(F.pmod("n_nationkey", F.lit(6)) == 3, F.lit("")).otherwise(
        F.concat(F.lit('  target_class_string: "'), _uid(F.col("n_nationkey")), F.lit('"\n')))
    block = F.concat(F.lit("entry {\n  target_class: "), F.col("n_nationkey").cast("string"), F.lit("\n"), said, F.lit("}\n"))
    g = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", block.alias("b"))))
                                     .alias("bs"))
    return g.select(F.array_join(F.transform("bs", lambda x: x["b"]), "").alias("value"))


def uid_name_lines(spark, sf_dir):
    n = load_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return n.filter(F.col("n_regionkey") < 4) \
        .select(F.concat(_uid(F.col("n_nationkey")), F.lit("\t"), F.col("n_name")).alias("value"))


def names(spark, sf_dir):
    resolved, _ = LK.compose_lookup(LK.parse_label_map(label_map_texts(spark, sf_dir)),
                                    LK.parse_uid_names(uid_name_lines(spark, sf_dir)))
    return resolved.select(F.col("node").alias("label"), "name")


def q_url_index_parse(spark, sf_dir):
    pg = load_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    extra = F.when(F.col("html").contains('lang="fr"'), F.lit(" fr")).otherwise(F.lit(""))
    gap = F.expr("repeat(' ', 1 + cast(pmod(page_id, 3) as int))")
    lines = pg.select(F.concat(F.col("page_id").cast("string"), gap, F.col("url"), extra).alias("value"))
    return LK.parse_url_index(lines)


def q_label_map_parse(spark, sf_dir):
    return LK.parse_label_map(label_map_texts(spark, sf_dir))


def q_uid_names_parse(spark, sf_dir):
    return LK.parse_uid_names(uid_name_lines(spark, sf_dir))


def q_label_lookup_compose(spark, sf_dir):
    resolved, _ = LK.compose_lookup(LK.parse_label_map(label_map_texts(spark, sf_dir)),
                                    LK.parse_uid_names(uid_name_lines(spark, sf_dir)))
    return resolved


def q_label_lookup_unmatched(spark, sf_dir):
    _, unmatched = LK.compose_lookup(LK.parse_label_map(label_map_texts(spark, sf_dir)),
                                     LK.parse_uid_names(uid_name_lines(spark, sf_dir)))
    return unmatched


def q_label_lookup_default(spark, sf_dir):
    from ..operators.relational import lookup
    e = load_table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    return lookup(e, names(spark, sf_dir), "label", ["name"], default="").select("vec_id", "label", "name")


def q_one_hot(spark, sf_dir):
    e = load_table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    txt = F.array_join(F.transform(one_hot(F.col("label"), 10), lambda x: x.cast("int").cast("string")), ",")
    return e.select("vec_id", txt.alias("one_hot"))


def q_rescale_array(spark, sf_dir):
    e = load_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    px = F.transform(F.col("embedding").cast("array<double>"),
                     lambda x: F.floor((x + F.lit(1.0)) * F.lit(127.5)).cast("int"))
    r = rescale(px)
    return e.select("vec_id", F.size(r).alias("n"),
                    F.round(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"),
                    F.round(F.array_min(r), 6).alias("vmin"), F.round(F.array_max(r), 6).alias("vmax"))


def q_synthetic_two_class(spark, sf_dir):
    """Reference fake data: image i is constant label - 0.5 with label = i % 2."""
    e = load_table(spark, sf_dir, "embeddings", ["vec_id"])
    label = F.pmod(F.col("vec_id"), F.lit(2)).cast("int")
    img = F.array_repeat((label - F.lit(0.5)).cast("float"), 28 * 28)
    hot = F.array_join(F.transform(one_hot(label, 2), lambda x: x.cast("int").cast("string")), ",")
    return e.select("vec_id", label.alias("label"), img.alias("img"), hot.alias("one_hot")) \
        .select("vec_id", "label", F.element_at("img", 1).cast("double").alias("pixel"),
                F.size("img").alias("n_pixels"), "one_hot")


def q_error_rate(spark, sf_dir):
    classes, w = model(spark, sf_dir)
    rows = classifier_rows(spark, sf_dir).filter(F.col("split") == "validation")
    pred = rows.select("label", INF.predict_class("embedding", classes, w).alias("pred"))
    return INF.error_rate(pred, "pred", "label").select(F.round("error_rate", 6).alias("error_rate"))


def _scored(spark, sf_dir, method):
    classes, w = model(spark, sf_dir)
    e = load_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    out = INF.score_top_k(e, "vec_id", "embedding", classes, w, k=TOP_K, temperature=TEMPERATURE,
                          names=names(spark, sf_dir), default_name="", method=method)
    return out.select("vec_id", F.col("rank").cast("int").alias("rank"), "label", "name",
                      F.round("score", 6).alias("score"))


def q_batch_inference_top_k(spark, sf_dir):
    return _scored(spark, sf_dir, "expr")


def q_batch_inference_map(spark, sf_dir):
    return _scored(spark, sf_dir, "batches")


def q_sweep_mlp(spark, sf_dir):
    """The whole grid of 50 configurations: its axes, and whether each fit gave figures that make sense."""
    rows = classifier_rows(spark, sf_dir)
    out = SW.sweep(rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "validation"),
                   rows.filter(F.col("split") == "test"), "embedding", "label", n_classes=10)
    error = lambda c: F.col(c).between(0.0, 100.0)
    return out.select("grid_pos", F.round("base_learning_rate", 6).alias("base_learning_rate"), "decay_rate", "fc1_size",
                      (F.col("minibatch_loss") < SW.SENTINEL).alias("trained"),
                      (error("validation_error") & error("test_error")).alias("errors_in_range"))


def q_positional_split(spark, sf_dir):
    return classifier_rows(spark, sf_dir).select("vec_id", "split")


def q_batch_rows(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders", ["o_orderkey"])
    b = fixed_batches(o, ["o_orderkey"], BATCH)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"),
                                  F.max("o_orderkey").alias("last_key"))


_C = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY vec_id) AS rn
           FROM embeddings),
tr AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM e WHERE rn > {2 * N_VALID}),
cen AS (SELECT label, i, avg(x) AS w FROM tr GROUP BY label, i),
cm AS (SELECT label AS cls, list(w ORDER BY i) AS w FROM cen GROUP BY label),
sc AS (SELECT e.vec_id, e.label, e.rn, cm.cls, {TEMPERATURE} * list_dot_product(e.v, cm.w) AS lg FROM e CROSS JOIN cm)
"""

_NAMES = """
nm AS (SELECT n_nationkey AS label, n_name AS name FROM nation WHERE n_regionkey < 4 AND n_nationkey % 6 <> 3)
"""

ORACLE = {
    "url_index_parse": """
SELECT CAST(page_id AS VARCHAR) AS img_id, url AS img_url FROM pages WHERE NOT contains(html, 'lang="fr"')""",
    "label_map_parse": """
SELECT n_nationkey AS node, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS uid FROM nation WHERE n_nationkey % 6 <> 3""",
    "uid_names_parse": """
SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS uid, n_name AS name FROM nation WHERE n_regionkey < 4""",
    "label_lookup_compose": """
SELECT n_nationkey AS node, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS uid, n_name AS name
FROM nation WHERE n_regionkey < 4 AND n_nationkey % 6 <> 3""",
    "label_lookup_unmatched": """
SELECT n_nationkey AS node, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS uid FROM nation
WHERE n_regionkey >= 4 AND n_nationkey % 6 <> 3""",
    "label_lookup_default": "WITH " + _NAMES + """
SELECT e.vec_id, e.label, coalesce(nm.name, '') AS name FROM embeddings e LEFT JOIN nm ON e.label = nm.label""",
    "one_hot": """
SELECT vec_id, array_to_string(list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN '1' ELSE '0' END), ',')
       AS one_hot FROM embeddings""",
    "rescale_array": """
WITH p AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor((x + 1.0) * 127.5) AS INTEGER)) AS px
           FROM embeddings),
r AS (SELECT vec_id, list_transform(px, lambda q: (q - 127.5) / 255.0) AS r FROM p)
SELECT vec_id, CAST(len(r) AS INTEGER) AS n, round(list_sum(r), 6) + 0.0 AS vsum, round(list_min(r), 6) + 0.0 AS vmin,
       round(list_max(r), 6) + 0.0 AS vmax FROM r""",
    "synthetic_two_class": """
SELECT vec_id, CAST(vec_id % 2 AS INTEGER) AS label, CAST(vec_id % 2 AS DOUBLE) - 0.5 AS pixel,
       CAST(784 AS INTEGER) AS n_pixels, CASE WHEN vec_id % 2 = 0 THEN '1,0' ELSE '0,1' END AS one_hot
FROM embeddings""",
    "error_rate": _C + f"""
, pred AS (SELECT vec_id, any_value(label) AS label, arg_max(cls, lg) AS p FROM sc WHERE rn <= {N_VALID} GROUP BY vec_id)
SELECT round(100.0 - 100.0 * avg(CASE WHEN p = label THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM pred""",
    "batch_inference_top_k": _C + ", " + _NAMES + f"""
, pr AS (SELECT vec_id, cls, exp(lg - max(lg) OVER (PARTITION BY vec_id)) AS ex FROM sc),
pp AS (SELECT vec_id, cls, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM pr),
rk AS (SELECT vec_id, cls, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls) AS rank FROM pp)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, cls AS label, coalesce(nm.name, '') AS name, round(p, 6) AS score
FROM rk LEFT JOIN nm ON rk.cls = nm.label WHERE rank <= {TOP_K}""",
    "positional_split": f"""
SELECT vec_id, CASE WHEN rn <= {N_VALID} THEN 'validation' WHEN rn <= {2 * N_VALID} THEN 'test' ELSE 'train' END AS split
FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings)""",
    "batch_rows": f"""
SELECT CAST((rn - 1) // {BATCH} AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1""",
}

ORACLE["sweep_mlp"] = f"""
SELECT CAST(r.i * {len(SW.FC1_SIZES)} + s.i AS INTEGER) AS grid_pos, round(pow(10, -3 + r.i * 2 / 9.0), 6) AS base_learning_rate,
       CAST({SW.DECAY_RATES[0]} AS DOUBLE) AS decay_rate, CAST(s.v AS INTEGER) AS fc1_size, true AS trained, true AS errors_in_range
FROM (SELECT unnest(range(0, 10)) AS i) r,
     (VALUES {", ".join(f"({i}, {v})" for i, v in enumerate(SW.FC1_SIZES))}) s(i, v)"""
ORACLE["batch_inference_map"] = ORACLE["batch_inference_top_k"]

QUERIES = {
    "url_index_parse": q_url_index_parse,
    "label_map_parse": q_label_map_parse,
    "uid_names_parse": q_uid_names_parse,
    "label_lookup_compose": q_label_lookup_compose,
    "label_lookup_unmatched": q_label_lookup_unmatched,
    "label_lookup_default": q_label_lookup_default,
    "one_hot": q_one_hot,
    "rescale_array": q_rescale_array,
    "synthetic_two_class": q_synthetic_two_class,
    "error_rate": q_error_rate,
    "batch_inference_top_k": q_batch_inference_top_k,
    "batch_inference_map": q_batch_inference_map,
    "sweep_mlp": q_sweep_mlp,
    "positional_split": q_positional_split,
    "batch_rows": q_batch_rows,
}
