"""JSON-lines sink/source round trip and the streaming validation job."""

import json
import os
import tempfile

from vireo.operators import responses as RP
from vireo.sources.jsonl import read_jsonl, write_jsonl
from vireo.streaming import reason_counts, validate_stream


def test_jsonl_round_trip(spark):
    d = tempfile.mkdtemp(prefix="vireo-jsonl-")
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "id long, s string, x double")
    write_jsonl(df, os.path.join(d, "out"))
    back = read_jsonl(spark, os.path.join(d, "out"), "id long, s string, x double")
    assert sorted(map(tuple, back.collect())) == [(1, "a", 1.5), (2, None, 2.5)]
    text = "".join(open(os.path.join(d, "out", f)).read() for f in os.listdir(os.path.join(d, "out"))
                   if f.endswith(".json"))
    assert '{"id":1,"s":"a","x":1.5}' in text


def test_streaming_validation(spark):
    d = tempfile.mkdtemp(prefix="vireo-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    good = {"url": "u1", "result_roi": True, "result_sentence": True, "result_signature": True,
            "result_color": True, "roi": {"c": [[1.0, 2.0, 3.0, 4.0]]}, "sentence": ["s"],
            "signature": {"c": [[0.0] * RP.SIGNATURE_DIM]}, "color_feature": {"c": [[0.0] * RP.COLOR_DIM]},
            "feature": {"c": [[1.0]]}, "lctgr_nm": "L", "mctgr_nm": "M", "sctgr_nm": "S"}
    bad = dict(good, url="u2", result_roi=False)
    with open(os.path.join(src, "part-0.json"), "w") as f:
        f.write(json.dumps(good) + "\n" + json.dumps(bad) + "\n{broken\n")
    q = validate_stream(spark, src, os.path.join(d, "out"), os.path.join(d, "ckpt"), available_now=True)
    q.awaitTermination(120)
    out = spark.read.json(os.path.join(d, "out")).select("url").collect()
    assert [r.url for r in out] == ["u1"]
    counts = reason_counts(spark, src)
    cq = counts.writeStream.format("memory").queryName("vireo_reasons").outputMode("complete") \
        .option("checkpointLocation", os.path.join(d, "ckpt2")).trigger(availableNow=True).start()
    cq.awaitTermination(120)
    got = {r.outcome: r["count"] for r in spark.sql("select * from vireo_reasons").collect()}
    assert got == {"ok": 1, "roi_flag": 1, "bad_json": 1}


def test_scan_formats_and_pushdown(spark, sf_small):
    import io
    import contextlib

    from pyspark.sql import functions as F

    from vireo.sources import scan

    df = scan(spark, "parquet", f"{sf_small}/customer.parquet", columns=["c_custkey", "c_mktsegment"],
              predicate=F.col("c_mktsegment") == "BUILDING")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    plan = buf.getvalue()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan
    d = tempfile.mkdtemp(prefix="vireo-scan-")
    src = spark.read.parquet(f"{sf_small}/customer.parquet")
    src.write.csv(os.path.join(d, "csv"), header=True)
    src.write.json(os.path.join(d, "json"))
    n = src.filter("c_mktsegment = 'BUILDING'").count()
    c = scan(spark, "csv", os.path.join(d, "csv"), columns=["c_custkey"], predicate="c_mktsegment = 'BUILDING'",
             header="true", schema=src.schema)
    j = scan(spark, "json", os.path.join(d, "json"), predicate="c_mktsegment = 'BUILDING'", schema=src.schema,
             limit=5, order_by=["c_custkey"])
    assert c.count() == n
    assert [r.c_custkey for r in j.collect()] == [r.c_custkey for r in src.filter("c_mktsegment = 'BUILDING'")
                                                  .orderBy("c_custkey").limit(5).collect()]


def test_jdbc_scan_requires_bounds(spark):
    import pytest

    from vireo.sources import jdbc_scan
    with pytest.raises(ValueError, match="lower_bound"):
        jdbc_scan(spark, "jdbc:none://x", table="t", partition_column="id", num_partitions=8)
