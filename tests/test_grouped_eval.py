from __future__ import annotations

import re
from unittest import mock

from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.functions import style
from lexiloom.plans import model_queries as Q


def test_trees_are_fitted_in_no_more_partitions_than_cores(spark, monkeypatch):
    seen = {}
    for kind in ("forest", "boosted", "logistic"):
        learner = lambda *a, kind=kind, **k: mock.Mock(fit=lambda rows: seen.__setitem__(kind, (rows.rdd.getNumPartitions(), rows.count())))
        monkeypatch.setattr(Q.models, kind, learner)
    rows = spark.range(0, 90_000, 1, 40).selectExpr("id as email_id", "cast(id % 2 as int) as label")
    for kind in Q.MODELS:
        Q._fit(kind, rows, ["a"])
    cores = spark.sparkContext.defaultParallelism
    assert seen == {"logistic": (4, 90_000), "forest": (cores, 90_000), "boosted": (min(4, cores), 90_000)}


def test_grouped_matrix_is_not_split_by_rows_first(spark, tmp_path, monkeypatch):
    texts = [(i, f"please verify account number {'abcdefgh'[i % 8] * 9} now, {chr(97 + i % 26) * 30}", i % 2, "s") for i in range(200)]
    spark.createDataFrame(texts, "email_id long, text string, label int, source string").write.parquet(f"{tmp_path}/emails.parquet")
    expected = {tuple(r[n] for n in ("email_id", *Q.NAMES)) for r in Q._matrix(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(Q.ranking, "stratified_split", mock.Mock(side_effect=AssertionError("a split that nothing uses")))
    made = Q._grouped(spark, str(tmp_path))
    assert {tuple(r[n] for n in ("email_id", *Q.NAMES)) for r in made.collect()} == expected
    assert made.groupBy("cluster").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_fits_run_side_by_side(spark):
    import threading

    meet = threading.Barrier(3, timeout=30)  # passes only if all three are inside at the same time
    assert Q._at_once(spark, *[lambda i=i: (meet.wait(), i)[1] for i in range(3)]) == [0, 1, 2]


def test_quick_patterns_count_as_the_plain_ones(spark):
    odd = ["", "a@b.co_m@c.de x.y@z.com@q.org", "a@b a@@b.co .@.aa %@-.zz@y.xx", "a@b.com.c@d.ee", "١٢³ 4 ⑳ x² 😀1", "cake tree be the eee 'e e' one-e queue's", "tht. e. me! she? néE cafe'e'"]
    got = {r["i"]: r for r in style.counted(spark.createDataFrame(list(enumerate(odd)), "i int, text string")).collect()}
    for i, t in enumerate(odd):
        low = t.lower()
        words = re.findall(r"[a-z']+", low)
        groups = [len(re.findall("[aeiouy]+", w)) for w in words]
        silent = [w.endswith("e") and n > 1 for w, n in zip(words, groups)]
        assert got[i]["__c_email"] == len(re.findall(lexicons.EMAIL, t))
        assert got[i]["__c_digit"] == sum(c.isdigit() for c in t)
        assert got[i]["__c_syllables"] == sum(max(n - s, 1) for n, s in zip(groups, silent))
