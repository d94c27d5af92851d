"""One crafted response per validation rule, plus valid / malformed / missing key
/ empty sentence list; projections and region explosion."""

import json

import pytest

from vireo.operators import responses as RP


def good(**over):
    sig = [[0.5] * RP.SIGNATURE_DIM]
    col = [[0.25] * RP.COLOR_DIM]
    d = {"url": "img/store/42.jpg", "result_roi": True, "result_sentence": True,
         "result_signature": True, "result_color": True,
         "roi": {"c1": [[10.7, 20.2, -30.9, 40.0, 99.0], [1.0, 2.0, 3.0, 4.0]]},
         "sentence": ["a shoe", "second"], "signature": {"c1": sig}, "color_feature": {"c1": col},
         "feature": {"c1": [[1.0, 2.0]]}, "lctgr_nm": "L", "mctgr_nm": "M", "sctgr_nm": "S"}
    d.update(over)
    return d


CASES = [
    ("valid", good(), None),
    ("r1", good(result_roi=False), "roi_flag"),
    ("r2", good(result_sentence=False), "sentence_flag"),
    ("r3", good(roi={}), "roi_empty"),
    ("r4", good(sentence=None), "sentence_empty"),
    ("r5", good(result_signature=False), "signature_flag"),
    ("r6", good(result_color=False), "color_flag"),
    ("r7", good(signature={}), "signature_empty"),
    ("r8", good(color_feature=None), "color_empty"),
    ("r9", good(lctgr_nm=""), "lctgr_empty"),
    ("r10", good(mctgr_nm=None), "mctgr_empty"),
    ("r11", good(sctgr_nm=""), "sctgr_empty"),
    ("r12", good(signature={"c1": [[0.5] * 132]}), "signature_dim"),
    ("r13", good(color_feature={"c1": [[0.5] * 167]}), "color_dim"),
    ("empty_sentence_list", good(sentence=[]), None),
    ("first_rule_wins", good(result_roi=False, lctgr_nm=""), "roi_flag"),
]


@pytest.fixture(scope="module")
def validated(spark):
    rows = [(name, json.dumps(d), exp) for name, d, exp in CASES]
    missing = good()
    del missing["result_color"]
    rows.append(("missing_key", json.dumps(missing), "color_flag"))
    rows.append(("malformed", '{"url": "x", "roi": ', "bad_json"))
    df = spark.createDataFrame(rows, "name string, payload string, expected string")
    return RP.validate(df)


def test_reasons(validated):
    for r in validated.collect():
        assert r["reason"] == r["expected"], r["name"]
        assert r["ok"] == (r["expected"] is None)


def test_detector_rules(spark):
    rows = [("a", json.dumps(good(result_sentence=False))), ("b", json.dumps(good(result_roi=False))),
            ("c", json.dumps(good(roi=None)))]
    out = {r["name"]: r["reason"] for r in
           RP.validate(spark.createDataFrame(rows, "name string, payload string"), rules="detector").collect()}
    assert out == {"a": None, "b": "roi_flag", "c": "roi_empty"}


def test_summary_counts(validated):
    s = {r["outcome"]: r["n"] for r in RP.validation_summary(validated).collect()}
    assert s["ok"] == 2
    assert sum(s.values()) == len(CASES) + 2


def test_projections_and_regions(validated):
    full = RP.project_full(validated).collect()
    assert sorted(full[0].asDict()) == ["feature_color", "roi", "sentence", "signature", "url"]
    first = RP.project_first(validated).collect()
    assert len(first) == 1  # the empty sentence list has no first sentence
    assert first[0]["sentence"] == "a shoe"
    regions = RP.explode_rois(RP.project_roi(validated), marker="store/").orderBy("pos").collect()
    assert len(regions) == 4  # two accepted responses, two regions each
    assert {(r["key"], r["pos"], r["is_first"], r["roi_text"]) for r in regions} == {
        ("42.jpg", 0, True, "10 20 -30 40"), ("42.jpg", 1, False, "1 2 3 4")}


def test_enrich_by_url(spark):
    cat = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, url string")
    content = spark.createDataFrame([("a", "<p>x</p>"), ("b", "  ")], "url string, payload string")
    out = {r["id"]: r["status"] for r in RP.enrich_by_url(cat, content).collect()}
    assert out == {1: "ok", 2: "bad_payload", 3: "missing"}
