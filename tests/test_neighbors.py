"""Top-k cosine neighbours against brute force; ties, copies, defective vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.operators import neighbors as NB
from vireo.operators.relational import sample_one


def vec_df(spark, rows):
    return spark.createDataFrame(rows, "k long, v array<float>")


def brute(rows, k):
    """(query, rank, ref) of every row, ordered by (distance, ref)."""
    out = []
    for q, u in rows:
        u = np.array(u, np.float32).astype(float)
        cand = []
        for r, v in rows:
            v = np.array(v, np.float32).astype(float)
            n = np.linalg.norm(u) * np.linalg.norm(v)
            if r != q and n:
                cand.append((round(1 - float(u @ v) / n, 9), r))
        out.append((q, sorted(cand)))
    best = {}
    for q, cand in out:
        best.setdefault(q, []).extend(cand)
    return sorted((q, i + 1, r) for q, c in best.items() for i, (_, r) in enumerate(sorted(c)[:k]))


def triples(df):
    return sorted((r["query"], r["rank"], r["ref"]) for r in df.collect())


def test_handmade_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, [2.0, 0.0])]
    got = {(r["query"], r["ref"]): r["distance"] for r in NB.cosine_top_k(vec_df(spark, rows), "k", "v", 9).collect()}
    assert got[1, 2] == pytest.approx(0.0) and got[1, 3] == pytest.approx(2.0) and got[1, 4] == pytest.approx(1.0)
    assert not [p for p in got if 5 in p] and len(got) == 5 * 4


@pytest.mark.parametrize("block_size", [50, 2048])
def test_blocks_equal_brute_force(spark, sf_small, block_size):
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet").select("vec_id", "embedding").where("vec_id < 200")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    assert triples(NB.cosine_top_k(e, "vec_id", "embedding", 7, block_size=block_size)) == brute(rows, 7)


def test_ties_by_ref_and_copies(spark):
    rows = [(1, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.0, 1.0])]
    out = NB.cosine_top_k(vec_df(spark, rows), "k", "v", 2).filter(F.col("query") == 1).orderBy("rank").collect()
    assert [r["ref"] for r in out] == [3, 5]
    rows = [(7, [1.0, 0.0])] * 3 + [(8, [0.6, 0.8])] * 2 + [(9, [0.0, 1.0]), (10, [-1.0, 0.2])]
    assert triples(NB.cosine_top_k(vec_df(spark, rows), "k", "v", 4)) == brute(rows, 4)


def test_defective_vectors_are_listed_not_fatal(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [0.0, 1.0])]
    df = vec_df(spark, rows)
    out = NB.cosine_top_k(df, "k", "v", 3)
    assert {r["query"] for r in out.collect()} == {1, 2, 6}
    assert {tuple(r) for r in NB.rejected(df, "k", "v", 2).collect()} == {(3, "no vector"), (4, "wrong length"), (5, "null element")}


def test_list_of_one_query(spark):
    df = vec_df(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])
    one = sample_one(df, ["k"], seed=7)
    q = one.first()["k"]
    got = {r["ref"]: r["distance"] for r in NB.neighbor_list(df, "k", "v", one).collect()}
    assert set(got) == {1, 2, 3} - {q} and all(d is not None for d in got.values())
