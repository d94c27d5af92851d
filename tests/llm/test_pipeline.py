import corpus_pipeline
from vireo.llm import mixing
from vireo.llm.common import keyed, table
from vireo.llm.registry import TARGETS, domains

SF = "/root/testdata/sf0.01"


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count(), name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (docs.count() > 0)


def test_exact_stage_leaves_one_row_of_each_text(spark, odd):
    rows = corpus_pipeline.exact_stage(spark, odd, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 2, 3, 5, 7, 8]
    assert {r["Text"] for r in rows} == {"other"}


def test_near_stage_leaves_one_row_of_each_group(spark, odd):
    rows = corpus_pipeline.near_stage(spark, odd, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 4, 6, 8]


def test_pipeline_follows_its_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    good = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1]
    bad = [i for i, r in labels.items() if r["quality"] == 0]
    assert sum(i in good for i in clean) > 0.98 * len(clean) and sum(i in good for i in bad) < 0.1 * len(bad)
    mixed = mixing.mix(keyed(docs), domains(table(spark, SF, "labels")), TARGETS, keys=("doc_id", "key"))
    kept = {r["doc_id"] for r in mixing.thinned(mixed).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect()} == kept
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "doc_tokens").collect()
    have = {}
    for r in rows:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["length"]
    assert set(have) <= good and all(have[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_mixing_stage_meets_the_targets(spark, frame):
    # words that only one domain has; good_toxic holds far too many tokens, bad_clean too few
    held = {"good_clean": 5000, "good_toxic": 4000, "bad_clean": 800, "bad_toxic": 200}
    names = [k for k, n in held.items() for _ in range(n)]
    docs = frame([f"{k}a {k}b {k}c {i} {i + 1}" for i, k in enumerate(names)])
    labelled = spark.createDataFrame(list(enumerate(names)), "doc_id long, domain string")
    kept = mixing.thinned(mixing.mix(keyed(docs), labelled, TARGETS, keys=("doc_id", "key"))).collect()
    share = {k: sum(names[r["doc_id"]] == k for r in kept) / len(kept) for k in held}
    assert all(abs(share[k] - want) < 0.02 for k, want in TARGETS.items()), share
    assert len(kept) > 0.9 * min(n / TARGETS[k] for k, n in held.items())        # no more dropped than the targets ask for
