from __future__ import annotations

import numpy as np
import pytest

from lexiloom.operators import models
from lexiloom.operators.ranking import ranked


def test_forest_importance_is_that_of_the_model_itself(spark):
    """Every row scored by the model with every feature dealt; in the plan no row is multiplied by the features."""
    rng = np.random.default_rng(8)
    names = [f"f{i}" for i in range(6)]
    x = rng.integers(0, 5, (300, 6)) / 4
    rows = [(i, int(v[0] + v[1] * v[2] > rng.random()), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, f"id long, label int, {', '.join(f'{n} double' for n in names)}").cache()
    model = models.forest(names, numTrees=15, maxDepth=6).fit(models.weighted(df))
    made = models.permutation_importance(model, df, names, "id", repeats=3)
    got = {r["feature"]: (r["mean_drop"], r["std_drop"]) for r in made.collect()}
    order = {r["id"]: (r["rank"] - 1) for r in ranked(df, [], "id", 42, size="n").select("id", "rank").collect()}
    at = {rank: i for i, rank in order.items()}
    shifted = spark.range(3).selectExpr("cast(id as int) r").selectExpr("r", "pmod(xxhash64(42, r), 299L) s").collect()
    shifts = [1 + r["s"] for r in sorted(shifted, key=lambda r: r["r"])]

    def f1(values):
        data = spark.createDataFrame([(i, rows[i][1], *map(float, v)) for i, v in enumerate(values)], df.schema)
        p = [(r["y_true"], r["y_pred"]) for r in models.predictions(model, data, "id").collect()]
        tp, wrong = p.count((1, 1)), p.count((0, 1)) + p.count((1, 0))
        return 2 * tp / (2 * tp + wrong)

    base = f1(x)
    for j, name in enumerate(names):
        drops = []
        for s in shifts:
            dealt = x.copy()
            dealt[:, j] = [x[at[(order[i] + s) % 300], j] for i in range(300)]
            drops.append(base - f1(dealt))
        assert got[name] == (pytest.approx(np.mean(drops), abs=1e-12), pytest.approx(np.std(drops), abs=1e-12))
    assert "explode([0,1,2,3,4,5])" not in made._jdf.queryExecution().optimizedPlan().toString()
