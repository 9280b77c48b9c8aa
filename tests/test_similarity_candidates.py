from __future__ import annotations

import numpy as np

from lexiloom.operators import similarity


def test_texts_of_middling_likeness_are_no_candidates(spark):
    """Half of each text is shared by all, so that pairs are at about 0.3; only the planted ones reach 0.5, and all of these stay."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda n: "".join(rng.choice(letters, n))
    shared = word(250)
    texts = [shared + word(270) for _ in range(150)]
    texts += [t[:-60] + word(60) for t in texts[:40]]
    reps = spark.createDataFrame(list(enumerate(texts)), "rep long, key string")
    near = {(r["a"], r["b"]) for r in similarity._band_candidates(reps, 0.5).collect()}
    assert {(i, 150 + i) for i in range(40)} <= near and len(near) < 0.2 * 190 * 189 / 2
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(reps, 0.5).select("a", "b").collect()} == {(i, 150 + i) for i in range(40)}


def test_grouped_split_makes_its_input_once(spark):
    found = spark.range(60).selectExpr("id", "abs(hash(sha1(cast(id div 3 as string)))) as cluster")
    made = similarity.grouped_split(spark.range(60).selectExpr("id", "cast(id % 2 as int) as label"), "id", "label", found)
    assert "sha1" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == 60 and similarity.leakage(made).count() == 0
