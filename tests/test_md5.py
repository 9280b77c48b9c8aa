from __future__ import annotations

import hashlib

import numpy as np
import pytest

from lexiloom.functions import md5
from lexiloom.operators import metrics


def test_digests_of_numbered_texts():
    for head, n in (("42:0:", 20_011), ("42:1999:", 1), ("", 123), ("a" * 43, 10_002), ("é:", 1001)):
        want = [hashlib.md5(f"{head}{i}".encode()).hexdigest() for i in range(n)]
        got = [None] * n
        for first, four in md5.numbered(head, n):
            for j, own in enumerate(zip(*four)):
                got[first + j] = "".join(f"{int(x):08x}" for x in own)
        assert got == want
    with pytest.raises(ValueError):
        list(md5.numbered("a" * 60, 2))


def test_bootstrap_draws_many_tasks_and_groups_of_any_size(spark):
    """Groups share the digests of a replicate; replicates are spread over many tasks, however few rows they are."""
    cells = spark.createDataFrame([("a", 3, 2, 1, 7), ("b", 40_000, 7, 9, 13), ("c", 0, 0, 0, 1), ("d", 0, 0, 0, 0)], "model string, tn long, fp long, fn long, tp long")
    made = metrics.bootstrap_f1(cells, ["model"], n_boot=12)
    got = {r["model"]: r for r in made.collect()}
    assert set(got) == {"a", "b", "c"} and got["c"]["ci_low"] == got["c"]["ci_high"] == 1
    for model, tn, fp, fn, tp in (("a", 3, 2, 1, 7), ("b", 40_000, 7, 9, 13)):
        n, f1 = tn + fp + fn + tp, []
        for b in range(12):
            at = [int(hashlib.md5(f"42:{b}:{i // 4}".encode()).hexdigest()[8 * (i % 4) : 8 * (i % 4) + 8], 16) % n for i in range(n)]
            x, y, z = (sum(lo <= v < hi for v in at) for lo, hi in ((tn, tn + fp), (tn + fp, tn + fp + fn), (tn + fp + fn, n)))
            f1.append(2 * z / (2 * z + x + y) if 2 * z + x + y else 0.0)
        assert got[model]["f1_mean"] == pytest.approx(np.mean(f1)) and got[model]["ci_low"] == pytest.approx(np.quantile(f1, 0.025))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
