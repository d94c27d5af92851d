"""Merge of regions into the catalogue, counters, quarantine, enrichment that loses no row."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vireo.operators import responses as RP
from vireo.sources import ratings as RS


def rois(spark, rows):
    return spark.createDataFrame(rows, "key string, pos int, is_first boolean, roi_text string")


def test_upsert_updates_copies_and_keeps(spark):
    cat = spark.createDataFrame([("a", 1, None), ("b", 2, "old"), ("c", 3, "keep"), (None, 4, "x"), ("b", 5, None)], "key string, prd int, roi string")
    src = rois(spark, [("a", 0, True, "1 1"), ("b", 0, True, "2 2"), ("b", 1, False, "3 3"), ("z", 0, True, "9 9"), (None, 0, True, "n")])
    got = sorted((r["prd"], r["action"], r["roi"]) for r in RP.upsert_rois(cat, src, "key").collect())
    assert got == [(1, "updated", "1 1"), (2, "inserted", "3 3"), (2, "updated", "2 2"), (3, "unchanged", "keep"), (4, "unchanged", "x"),
                   (5, "inserted", "3 3"), (5, "updated", "2 2")]


def test_upsert_of_a_doubled_region_raises(spark):
    cat = spark.createDataFrame([("a", None)], "key string, roi string")
    with pytest.raises(Exception, match="same key and position"):
        RP.upsert_rois(cat, rois(spark, [("a", 0, True, "1"), ("a", 0, True, "2")]), "key").collect()


def test_counters_come_with_the_write(spark):
    df = spark.createDataFrame([("{}",), ("{bad",), ('{"result_roi": true}',)], "payload string")
    seen, counters = RP.observe_outcomes(RP.validate(df))
    seen.write.format("noop").mode("overwrite").save()
    got = {k: n for k, n in counters.get.items() if n}
    assert got == {"seen": 3, "roi_flag": 1, "bad_json": 1, "sentence_flag": 1}


def test_quarantine_keeps_every_line(spark):
    lines = ["1,2,3.5,100", "1,2,3.5", "x,2,3,4", "1,y,3,4", "1,2,z,4", "1,2,3,w", "", "1,2,3,4,5", None]
    good, bad = RS.quarantine(spark.createDataFrame([(x,) for x in lines], "value string"), RS.rating_reason(F.col("value")))
    assert [r["value"] for r in good.collect()] == ["1,2,3.5,100"]
    got = sorted((r["reason"], r["value"] or "") for r in bad.collect())
    assert got == sorted([("fields", "1,2,3.5"), ("user", "x,2,3,4"), ("item", "1,y,3,4"), ("rating", "1,2,z,4"), ("timestamp", "1,2,3,w"),
                          ("fields", ""), ("fields", "1,2,3,4,5"), ("fields", "")])
    titles = spark.createDataFrame([('1,"a, b"',), ("x,b",), ("3,",), (None,)], "value string")
    good, bad = RS.quarantine(titles, RS.title_reason(F.col("value")))
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["item", "item", "title"]


def test_enrichment_with_status_loses_no_row(spark):
    df = spark.createDataFrame([(i, f"u{i}") for i in range(6)], "id long, url string").coalesce(1)

    def fetch(batch, client):
        return pd.DataFrame({"id": [0, 2, 2, 5], "size": [10, 20, 21, 50]})

    got = [(r["id"], r["size"], r["status"]) for r in RP.enrich_batches_with_status(df, fetch, "id", "size long").orderBy("id").collect()]
    assert got == [(0, 10, "ok"), (1, None, "missing"), (2, 20, "ambiguous"), (3, None, "missing"), (4, None, "missing"), (5, 50, "ok")]
