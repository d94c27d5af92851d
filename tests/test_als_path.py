import random

import numpy as np
import pytest

from vireo.operators import als_path as AP


def data(spark, n=400, users=12, items=15):
    rng = random.Random(7)
    # one user holds a third of the rows; some pairs repeat
    rows = [(0 if rng.random() < 0.33 else rng.randrange(users), 10**12 + rng.randrange(items), rng.uniform(1, 5)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "user long, item long, rating double").repartition(3)


def plain(rows, start, lam, rank, iterations):
    """Alternating least squares row by row, with the factors after each iteration."""
    y, x, out = dict(start), {}, []

    def solve(side, other, own, its):
        made = {}
        for i in {r[own] for r in rows}:
            mine = [r for r in rows if r[own] == i]
            a = sum(np.outer(other[r[its]], other[r[its]]) for r in mine) + lam * len(mine) * np.eye(rank)
            made[i] = np.linalg.solve(a, sum(r[2] * other[r[its]] for r in mine))
        return made

    for _ in range(iterations):
        x = solve(x, y, 0, 1)
        y = solve(y, x, 1, 0)
        out.append((x, y))
    return out


def test_path_matches_plain_least_squares(spark):
    rows, train = data(spark)
    held, valid = data(spark, 60, 14, 17)                   # some ids are unknown
    valid = valid.unionByName(spark.createDataFrame([(1, None, 2.0), (None, 3, 1.0)], valid.schema))
    points, users, items = AP.validation_path(train, valid, (2, 3), (0.1, 0.5), 3)
    got = {(p["lam"], p["rank"], p["iters"]): p for p in AP.with_descent(points).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda e: e[1]["grid_pos"])] == \
        [(lam, k, t) for lam in (0.1, 0.5) for k in (2, 3) for t in (1, 2, 3)]
    ids = train.selectExpr("item AS id").distinct()
    found = {(r["iters"], r["rank"], r["lam"], r["id"]): r["v"] for r in items.collect()}
    for lam in (0.1, 0.5):
        for k in (2, 3):
            start = {r["id"]: np.array(r["v"]) for r in AP.starting_factors(ids, [k], [lam], 42).collect()}
            for t, (x, y) in enumerate(plain(rows, start, lam, k, 3), 1):
                p = got[lam, k, t]
                errors = [x[u] @ y[i] - r for u, i, r in rows]
                scored = [x[u] @ y[i] - r for u, i, r in held if u in x and i in y]
                size = sum(x[u] @ x[u] + y[i] @ y[i] for u, i, _ in rows)
                assert p["train_rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))))
                assert p["val_rmse"] == pytest.approx(np.sqrt(np.sum(np.square(scored)) / len(held)))
                assert p["n_scored"] == len(scored) and p["descends"]
                assert p["objective"] == pytest.approx(np.sum(np.square(errors)) + lam * size)
                assert all(np.allclose(found[t, k, lam, i], v) for i, v in y.items())
    best = min(got.values(), key=lambda p: (p["val_rmse"], p["grid_pos"]))
    assert [p["grid_pos"] for p in got.values() if p["is_best"]] == [best["grid_pos"]]
    assert users.count() == 3 * 2 * 2 * len({r[0] for r in rows})


@pytest.mark.parametrize("users,items", [(40, 6), (6, 40)])
def test_factors_travel_once_per_id_and_block(spark, monkeypatch, users, items):
    """Of either side: what leaves a block or comes to it is one row per id, not one per rating and grid point."""
    monkeypatch.setattr(AP, "BLOCK", 50)                    # hot ids lie in several blocks
    rows, train = data(spark, 500, users, items)
    blocks = AP._Blocks(train, train.limit(0), AP.Layout((2,), (0.1, 0.5)))
    many = blocks.train.select("block").distinct().count()
    assert many >= 8 and blocks.home == ("user" if users > items else "item")
    start = AP.starting_factors(train.selectExpr("item AS id").distinct(), [2], [0.1], 42)
    v = {r["id"]: np.array(r["v"]) for r in start.collect()}
    first = start.selectExpr("CAST(null AS INT) AS block", "id", "concat(v, v) AS v")
    made = blocks.half_step("user", first)
    got = {r["id"]: r["v"] for r in made.collect()}
    assert made.count() == len(got) == len({r[0] for r in rows})
    x, _ = plain(rows, v, 0.1, 2, 1)[0]
    assert all(np.allclose(got[u][:2], w) for u, w in x.items())
    assert blocks.brought(made, "user").count() == blocks.route["user"].count() <= len(rows)


def test_path_of_empty_tables_and_bad_arguments(spark):
    _, train = data(spark, 30)
    none = train.limit(0)
    assert AP.validation_path(none, train, (2,), (0.1,), 1)[0].count() == 0
    p = AP.validation_path(train, none, (2,), (0.1,), 1)[0].first()
    assert p["n_scored"] == 0 and p["val_rmse"] is None
    for ranks, lambdas, n in (((), (0.1,), 1), ((2,), (0.0,), 1), ((2,), (0.1,), 0), ((2, 2), (0.1,), 1)):
        with pytest.raises(ValueError):
            AP.validation_path(train, train, ranks, lambdas, n)
