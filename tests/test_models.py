"""Scoring paths agree; dictionary readers; sweep grid; vector functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.functions import vectors as V
from vireo.functions.text import query_string, roi_text, url_suffix_key
from vireo.operators import inference as INF
from vireo.operators import sweep as SW
from vireo.operators.relational import fixed_batches, positional_split
from vireo.sources import lookups as LK


def test_scoring_paths_agree(spark, sf_small):
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    classes, w = INF.collect_model(INF.fit_centroids(e, "embedding", "label"))
    assert w.shape == (len(classes), 64)
    a = INF.score_top_k(e, "vec_id", "embedding", classes, w, k=5, temperature=10.0, method="expr")
    b = INF.score_top_k(e, "vec_id", "embedding", classes, w, k=5, temperature=10.0, method="batches")
    ra = sorted((r.vec_id, r.rank, r.label, round(r.score, 9)) for r in a.collect())
    rb = sorted((r.vec_id, r.rank, r.label, round(r.score, 9)) for r in b.collect())
    assert ra == rb
    top1 = {r.vec_id: r.label for r in b.filter("rank = 1").collect()}
    pred = e.withColumn("pred", INF.predict_class("embedding", classes, w)).collect()
    assert all(top1[r.vec_id] == r.pred for r in pred)


def test_label_lookup_chain(spark):
    label_map = spark.createDataFrame([(
        'entry {\n  target_class: 449\n  target_class_string: "n01440764"\n}\n'
        'entry {\n  target_class: 450\n  target_class_string: "n01443537"\n}\n',)], "value string")
    nodes = LK.parse_label_map(label_map)
    assert sorted(map(tuple, nodes.collect())) == [(449, "n01440764"), (450, "n01443537")]
    names = LK.parse_uid_names(spark.createDataFrame([("n01440764\ttench, Tinca tinca",)], "value string"))
    resolved, unmatched = LK.compose_lookup(nodes, names)
    assert [tuple(r) for r in resolved.collect()] == [(449, "n01440764", "tench, Tinca tinca")]
    assert [tuple(r) for r in unmatched.collect()] == [(450, "n01443537")]
    idx = LK.parse_url_index(spark.createDataFrame([("1  http://a/x.jpg",), ("2 b c",), ("3",)], "value string"))
    assert [tuple(r) for r in idx.collect()] == [("1", "http://a/x.jpg")]


def test_param_grid(spark):
    g = SW.param_grid(spark)
    assert g.count() == 50
    rates = sorted({r.base_learning_rate for r in g.collect()})
    assert rates[0] == pytest.approx(1e-3) and rates[-1] == pytest.approx(1e-1)
    lg = spark.range(1).select(V.logspace(-3, -1, 10).alias("a")).first()["a"]
    assert lg == pytest.approx(list(np.logspace(-3, -1, 10)))


def test_vector_functions(spark):
    r = spark.createDataFrame([([1.0, 3.0, 3.0], 2)], "a array<double>, label int").select(
        V.argmax("a").alias("am"), V.one_hot("label", 4).alias("oh"), V.softmax("a").alias("sm"),
        V.rescale(F.array(F.lit(0), F.lit(255))).alias("rs"), V.cosine_distance("a", "a").alias("d")).first()
    assert r.am == 1
    assert r.oh == [0.0, 0.0, 1.0, 0.0]
    assert sum(r.sm) == pytest.approx(1.0)
    assert r.rs == pytest.approx([-0.5, 0.5])
    assert r.d == pytest.approx(0.0)


def test_text_functions(spark):
    r = spark.createDataFrame([("img/store/7.jpg", [10.9, -2.5, 3.0, 4.0, 5.0], "a b*#")],
                              "u string, roi array<double>, v string").select(
        url_suffix_key("u", "store/").alias("k"), roi_text("roi").alias("t"),
        query_string([("x y", F.col("v"))]).alias("q")).first()
    assert (r.k, r.t, r.q) == ("7.jpg", "10 -2 3 4", "x+y=a+b%2A%23")


def test_batches_and_positional_split(spark):
    df = spark.range(0, 10).select(F.col("id").alias("k"))
    b = {r.k: r.batch for r in fixed_batches(df, ["k"], 3).collect()}
    assert b == {i: i // 3 for i in range(10)}
    s = {r.k: r.split for r in positional_split(df, ["k"], 4).collect()}
    assert [s[i] for i in range(10)] == ["validation"] * 4 + ["train"] * 6


def test_request_url_and_endpoint(spark):
    # fixed value: the format of the service's request
    from vireo.functions.text import endpoint, request_url
    df = spark.createDataFrame([("img.example.com/a b.jpg", "BAGS & SHOES", "x")], "u string, l string, m string")
    ep = endpoint(F.col("u"), ["h1", "h2"], [8081, 7081])
    r = df.select(ep.alias("e"),
                  request_url("http://%s:%d/request_handler?url=http://%s&%s&is_browser=0",
                              ep["host"], ep["port"], F.col("u"),
                              [("lctgr_nm", F.col("l")), ("mctgr_nm", F.col("m"))]).alias("q")).first()
    assert r.e.host in ("h1", "h2") and r.e.port in (8081, 7081)
    assert r.q == (f"http://{r.e.host}:{r.e.port}/request_handler?url=http://img.example.com/a b.jpg"
                   "&lctgr_nm=BAGS+%26+SHOES&mctgr_nm=x&is_browser=0")
    again = df.select(ep.alias("e")).first()
    assert again.e == r.e  # deterministic per URL


def test_sweep_best_config_first_wins(spark):
    res = spark.createDataFrame([(0, 0.001, 0.95, 64, 1.0, 30.0, 31.0), (1, 0.002, 0.95, 64, 1.0, 20.0, 21.0),
                                 (2, 0.003, 0.95, 64, 1.0, 20.0, 19.0)], SW.RESULT_SCHEMA)
    assert SW.best_config(res).first().grid_pos == 1


def test_positional_splits_by_threshold(spark):
    from vireo.operators import relational as RL
    df = spark.range(0, 500).select(((F.col("id") * 7919) % 500).alias("k"))
    a = {r.k: r.split for r in RL.positional_splits(df, ["k"], [10, 20], ["a", "b"], "c").collect()}
    assert all(a[k] == ("a" if k < 10 else "b" if k < 30 else "c") for k in range(500))


def test_label_without_a_string_does_not_shift_the_others(spark):
    text = ('  target_class: 5\n}\nentry {\n  target_class: 6\n  other: 1\n  target_class_string: "x"\n}\n'
            'entry {\n  target_class: 7\n  target_class_string: "y"\n')
    got = LK.parse_label_map(spark.createDataFrame([(text,)], "value string")).collect()
    assert sorted(tuple(r) for r in got) == [(6, "x"), (7, "y")]


def test_label_map_of_many_lines(spark, tmp_path):
    """A file of a million lines in many splits, long gaps between a class and its string, classes without one."""
    want = []
    with open(tmp_path / "map.pbtxt", "w") as f:
        for n in range(160_000):
            f.write(f"entry {{\n  target_class: {n}\n")
            if n == 40_000:
                f.writelines(f"  other: {i}\n" for i in range(200_000))
            if n % 7:
                f.write(f'  target_class_string: "u{n}"\n  target_class_string: "second"\n')
                want.append((n, f"u{n}"))
            f.write("  other: 1\n}\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400k")
    try:
        got = LK.read_label_map(spark, str(tmp_path / "map.pbtxt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(map(tuple, got)) == want


def test_label_map_with_a_far_string(spark):
    text = "  target_class: 1\n" + "x\n" * 20_000 + '  target_class_string: "a"\n  target_class: 2\n'
    got = LK.parse_label_map(spark.createDataFrame([(text,), ('  target_class_string: "b"',)], "value string")).collect()
    assert [tuple(r) for r in got] == [(1, "a")]


def separable(spark):
    rows = [(i, [float(i % 3 == c) * 4 - 1 + 0.01 * (i % 7) for c in range(3)], i % 3) for i in range(120)]
    return spark.createDataFrame(rows, "k long, v array<double>, label int")


def test_sweep_learns_and_uses_its_axes(spark):
    df = separable(spark)
    out = SW.sweep(df, df, df, "v", "label", 3, rates=(0.05, 0.1), decays=(0.95, 0.1), sizes=(8,), max_iter=30).orderBy("grid_pos").collect()
    assert len(out) == 4 and all(r.minibatch_loss < SW.SENTINEL and r.test_error < 100.0 for r in out)
    assert min(r.test_error for r in out) < 5.0
    assert out[0].minibatch_loss != out[1].minibatch_loss          # the decay matters


def test_sweep_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    net = SW._start(rng, 3, 4, 3)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 3, 7)
    found = SW._gradient(net, x, y)[1:]
    for w, g in zip(net, found):
        for at in np.ndindex(w.shape):
            kept, both = w[at], []
            for step in (1e-6, -1e-6):
                w[at] = kept + step
                both.append(SW._gradient(net, x, y)[0])
            w[at] = kept
            assert abs((both[0] - both[1]) / 2e-6 - g[at]) < 1e-5


def test_sweep_in_blocks_is_plain_descent(spark, monkeypatch):
    """Many blocks and partitions give the weights of one matrix; a fit that diverges keeps the sentinel."""
    monkeypatch.setattr(SW, "BLOCK", 5)
    df = separable(spark)
    rows = df.collect()
    x, y = np.array([r.v for r in rows], float), np.array([r.label for r in rows])
    out = SW.sweep(df, df, df.limit(0), "v", "label", 3, rates=(0.05, float("inf")), sizes=(6,), max_iter=3).orderBy("grid_pos").collect()
    net = SW._start(np.random.default_rng([7, 6]), x.shape[1], 6, 3)
    for epoch in range(2):
        for _ in range(3):
            loss, *grads = SW._gradient(net, x, y)
            net = [w - SW.STEP * 0.05 * 0.95 ** epoch / len(y) * g for w, g in zip(net, grads)]
    assert abs(out[0].minibatch_loss - loss / len(y)) < 1e-9
    assert abs(out[0].validation_error - 100 * SW._wrong(net, x, y)[0] / len(y)) < 1e-9 and out[0].test_error == SW.SENTINEL
    assert (out[1].minibatch_loss, out[1].validation_error, out[1].test_error) == (SW.SENTINEL,) * 3


def test_sweep_raises_what_is_no_divergence(spark):
    df = separable(spark)
    with pytest.raises(Exception):
        SW.sweep(df, df, df, "v", "label", 2, rates=(0.1,), sizes=(4,), max_iter=2).collect()


def test_rejected_rows_of_the_scorer(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "k long, v array<double>")
    for method in ("expr", "batches"):
        out = INF.score_top_k(df, "k", "v", [0, 1], np.eye(2), k=1, method=method).collect()
        assert [(r.k, r.label) for r in out] == [(1, 0)]
    assert {tuple(r) for r in INF.rejected_rows(df, "k", "v", np.eye(2)).collect()} == {(2, "no vector"), (3, "wrong length")}


def test_recommended_conf():
    from vireo.session import recommended_conf
    c = recommended_conf(100 * 2**40, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20)
    assert int(recommended_conf(1 << 20, 8)["spark.sql.shuffle.partitions"]) == 16
