import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import audit, checks, dedupe, metrics, ranking, similarity
from lexiloom.operators.graph import components


def plain_pieces(text):
    k = "".join(c for c in (text or "").lower() if c.isascii() and c.isalnum())
    return {k[i : i + 5] for i in range(len(k) - 4)} or ({k} if k else set())


def test_keep_first(spark, rows_of):
    df = spark.createDataFrame([(3, "A b", 0), (1, "a  B", 0), (2, "a b", 1), (4, None, 0), (5, "  ", 0), (1, "a  B", 0)], "id int, text string, label int")
    assert rows_of(dedupe.loader_dedupe(df, "id").select("id")) == [(1,)]
    assert rows_of(dedupe.class_dedupe(df, "id").select("id", "label")) == [(1, 0), (2, 1), (5, 0)]
    assert dedupe.loader_dedupe(df.limit(0), "id").count() == 0
    assert dedupe.duplicate_count(df, F.col("text")).first() == (6, 5, 1)


def test_ranks_are_exact_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 10 else None, "x") for i in range(3000)], "id int, g int, rank string")
    got = ranking.ranked(df, ["g"], "id", size="n").collect()
    assert len(got) == 3000
    for g in (0, 1, 2, None):
        own = sorted(r["rank"] for r in got if r["g"] == g)
        assert own == list(range(1, len(own) + 1)) and {r["n"] for r in got if r["g"] == g} == {len(own)}


def test_stratified_split_sizes(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(982)], "id int, label int")
    got = {(r["label"], r["split"]): r["n"] for r in ranking.stratified_split(df, "label", "id").groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(c, s): n for c in (0, 1) for s, n in (("train", 343), ("val", 74), ("test", 74))}
    small = df.where("id < 172")
    assert [r[0] for r in ranking.stratified_split(small, "label", "id").groupBy("split").count().orderBy("split").select("count").collect()] == [26, 120, 26]
    folds = ranking.folds(df, "label", "id").groupBy("label", "fold").count().collect()
    assert len(folds) == 10 and max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1


def test_downsample_sample_and_empty(spark):
    df = spark.createDataFrame([(i, int(i < 40)) for i in range(200)], "id int, label int")
    assert [r["count"] for r in ranking.downsampled(df, "label", "id").groupBy("label").count().collect()] == [40, 40]
    assert audit.sample(df, ["label"], "id", 25).groupBy("label").count().collect()[0]["count"] == 25
    assert ranking.stratified_split(df.limit(0), "label", "id").count() == 0 and ranking.downsampled(df.limit(0), "label", "id").count() == 0


def test_components(spark, rows_of):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(60)] + [(400, 400), (None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = rows_of(components(spark.createDataFrame(edges, "src long, dst long")))
    assert got == sorted(((x, find(x)) for x in parent), key=repr)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def mutated(rng, text):
    chars = list(text)
    for _ in range(rng.randrange(1, 25)):
        chars[rng.randrange(len(chars))] = rng.choice("abcdefgh ")
    return "".join(chars)


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(20, 160))) for _ in range(25)]
    texts = base + [mutated(rng, t) for t in base] + [base[0].upper(), "", "!!", None, "abc", "A b-c", base[1][:60]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, key string")
    members, reps = similarity.representatives(df, "id")
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.similar_pairs(reps).collect()}
    first = {}
    for i, t in enumerate(texts):
        k = "".join(c for c in (t or "").lower() if c.isascii() and c.isalnum())
        if k:
            first.setdefault(k, i)
    wanted = {}
    for a, b in itertools.combinations(sorted(first.values()), 2):
        x, y = plain_pieces(texts[a]), plain_pieces(texts[b])
        if len(x & y) / len(x | y) >= 0.5:
            wanted[a, b] = len(x & y) / len(x | y)
    assert got == pytest.approx(wanted) and len(wanted) > 5
    found = {r["id"]: r["cluster"] for r in similarity.clusters(df, "id").collect()}
    assert found[50] == found[0] == 0 and found[51] == 51 and found[52] == 52 and 53 not in found and found[55] == 54
    stats = similarity.cluster_stats(spark.createDataFrame(list(found.items()), "id long, cluster long")).first()
    assert stats["n_members"] == len(found) and stats["n_clusters"] == len(set(found.values()))


def test_grouped_split_never_parts(spark):
    found = spark.createDataFrame([(i, i // 3 * 3 if i < 60 else i) for i in range(400)], "id long, cluster long")
    df = spark.createDataFrame([(i, i % 2) for i in range(400)], "email long, label int").withColumnRenamed("email", "id")
    got = similarity.grouped_split(df, "id", "label", found)
    assert similarity.leakage(got).count() == 0 and got.count() == 400
    for (cls, split), n in {(r["class"], r["split"]): r["count"] for r in got.groupBy("class", "split").count().collect()}.items():
        total = got.where(F.col("class") == cls).count()
        assert split == "train" or round(total * 0.15) <= n <= round(total * 0.15) + 2


def test_confusion_and_scores(spark):
    df = spark.createDataFrame([("m", t, p, 0.5) for t, p in zip([0, 0, 1, 1, None], [0, 1, 1, 1, 1])], "model string, y_true int, y_pred int, score double")
    r = metrics.scores(metrics.confusion(df, ["model"])).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"], r["recall"]) == (1, 1, 0, 2, 1.0) and r["precision"] == pytest.approx(2 / 3)
    cells = spark.createDataFrame([("a", 72, 2, 0, 74), ("b", 0, 0, 0, 0), ("c", 5, 0, 0, 7)], "model string, tn long, fp long, fn long, tp long")
    got = {r["model"]: r for r in metrics.scores(cells).collect()}
    assert got["a"]["f1"] == pytest.approx(0.986667, abs=1e-6) and got["b"]["f1"] == 0
    ci = {r["model"]: r for r in metrics.bootstrap_f1(cells, ["model"], n_boot=200).collect()}
    assert (ci["c"]["ci_low"], ci["c"]["ci_high"]) == (1, 1) and ci["a"]["ci_low"] < ci["a"]["f1_mean"] < ci["a"]["ci_high"] and "b" not in ci


def test_auc_with_ties_against_pairs(spark):
    rng = random.Random(2)
    rows = [("m", rng.randrange(2), rng.choice([0.1, 0.25, 0.5, 0.75, rng.random(), None])) for _ in range(300)]
    pos, neg = ([s for _, t, s in rows if t == v and s is not None] for v in (1, 0))
    wanted = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert metrics.roc_auc(spark.createDataFrame(rows, "model string, y_true int, score double"), ["model"]).first()["auc"] == pytest.approx(wanted)
    assert metrics.roc_auc(spark.createDataFrame([("m", 1, 0.5)], "model string, y_true int, score double"), ["model"]).first()["auc"] is None


def test_histogram_spearman_weights(spark, rows_of):
    df = spark.createDataFrame([(v,) for v in (-20.0, -21.0, 120.0, 120.1, 0.0)], "v double")
    assert rows_of(metrics.histogram(df, "v")) == [(0, 1), (38, 1), (5, 1)]
    x = spark.createDataFrame([(c, i) for i, c in enumerate("abcdef", 1)], "f string, rank int")
    y = spark.createDataFrame([(c, i) for i, c in enumerate("fedcba", 1)], "f string, rank int")
    assert tuple(metrics.spearman(x, y, "f").first()) == (6, -1.0, 0.0) and metrics.spearman(x, x.limit(0), "f").first()["rho"] is None
    w = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "label int")
    assert rows_of(metrics.class_weights(w, "label")) == [(0, 3, pytest.approx(4 / 6)), (1, 1, 2.0)]


def test_audit_goldens(spark):
    rows = [(f"k{i}", "s", i < 25, (i >= 5) if i < 25 else i < 30) for i in range(50)]
    judged = spark.createDataFrame(rows + rows[:3] + [("n", "s", True, None)], "key string, source string, screen_retained boolean, judged_in_scope boolean")
    population = spark.createDataFrame([("s", 652, 167)], "source string, retained long, excluded long")
    r = audit.score(judged, population).first()
    assert (r["precision"], r["fn_rate"]) == (0.8, 0.2) and r["recall"] == pytest.approx(0.940, abs=5e-4) and round(r["est_in_scope"]) == 522 and round(r["est_missed"]) == 33


def test_checks(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    found = checks.report([checks.none_of(df, "none", "a"), checks.none_of(df.limit(0), "empty", "a"), checks.check(df, "sum", "b", F.sum("x"), F.col("value") == 3)])
    assert {r["check"]: r["pass"] for r in found.collect()} == {"none": False, "empty": True, "sum": True}
    assert {r["grp"]: (r["passed"], r["failed"]) for r in checks.summary(found).collect()} == {"a": (1, 1), "b": (1, 0), None: (2, 1)}
    assert math.isclose(1, 1)


def test_p_values_of_rank_correlations(spark):
    """Against the known two-sided tails of Student's t."""
    known = [(2.0, 1, 0.295167), (2.0, 2, 0.183503), (2.0, 3, 0.139326), (2.0, 4, 0.116117), (2.0, 5, 0.101939), (0.0, 7, 1.0), (1.5, 18, 0.150950), (2.0930240544, 19, 0.05)]
    df = spark.createDataFrame([(t, nu) for t, nu, _ in known], "t double, nu int")
    got = {(r["t"], r["nu"]): r["p"] for r in df.select("t", "nu", metrics.student_p(F.col("t"), F.col("nu")).alias("p")).collect()}
    assert all(got[t, nu] == pytest.approx(p, abs=1e-6) for t, nu, p in known)
    ranks = lambda xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs, 1)], "f string, rank int")
    one = lambda x, y: tuple(metrics.spearman(ranks(x), ranks(y), "f").first())
    assert one("abc", "abc") == (3, 1.0, 0.0) and one("ab", "ba")[0] == 2 and one("ab", "ba")[2] is None and one("ab", "cd")[0] == 0


def test_scores_of_linear_models_and_weights(spark):
    df = spark.createDataFrame([(0.0, 0), (2.0, 1), (-2.0, 0), (None, None)], "m double, label int")
    got = [tuple(r) for r in df.select(F.round(metrics.sigmoid(F.col("m")), 6), metrics.thresholded(metrics.sigmoid(F.col("m")))).collect()]
    assert got == [(0.5, 1), (0.880797, 1), (0.119203, 0), (None, None)]
    assert tuple(metrics.scale_pos_weight(df, "label").first()) == (2, 1, 2.0) and tuple(metrics.scale_pos_weight(df.limit(0), "label").first()) == (0, 0, 0.0)


def test_disagreement_keys_turn_judgements(spark):
    sampled = spark.createDataFrame([("a", True), ("b", False), ("c", True), (None, True)], "key string, screen_retained boolean")
    keys = spark.createDataFrame([("b", 1), ("c", 1), ("c", 2), (None, 1), ("z", 1)], "key string, screen_retained int")
    assert {r["key"]: r["judged_in_scope"] for r in audit.disagreements(sampled, keys).collect()} == {"a": True, "b": True, "c": False, None: True}
    assert audit.disagreements(sampled.limit(0), keys).count() == 0


def test_differing_tables_and_digests(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 1.0), ("z", 3.0, 1.0), ("v", 4.0, 4.0)], "k string, p double, q double")
    b = spark.createDataFrame([("x", 1.00001, None), ("y", 2.1, 1.0), ("v", 4.0, None), ("w", 0.0, 0.0)], "k string, p double, q double")
    assert {r["k"] for r in checks.differing(a, b, ["k"], ["p", "q"], 1e-3).collect()} == {"y", "z", "v", "w"} and checks.differing(a, a, ["k"], ["p", "q"], 0).count() == 0
    stored = spark.createDataFrame([("f1", "aa"), ("f2", "bb"), ("gone", "cc")], "name string, sha256 string")
    found = spark.createDataFrame([("file:/d/f1", 1, "aa"), ("file:/d/f2", 1, "xx")], "path string, size long, sha256 string")
    assert [r["name"] for r in checks.wrong_digests(stored, found).collect()] == ["f2"]


def test_both_ways_of_the_similarity_join(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40, 200))) for _ in range(150)]
    texts = base + [t[: len(t) * k // 10] + "".join(rng.choice("qrstuv") for _ in range(len(t) * (10 - k) // 10)) for t in base for k in (7, 8, 9)] + ["", "ab", "abcd", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    _, reps = similarity.representatives(df, "id")
    pieces = lambda k: {k[i : i + 5] for i in range(len(k) - 4)} or {k}
    keyed = [(r["rep"], pieces(r["key"])) for r in reps.collect()]
    wanted = {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(keyed, 2) if len(x & y) >= 0.5 * len(x | y)}
    for exact in (True, False):
        got = [(r["a"], r["b"]) for r in similarity.similar_pairs(reps, exact=exact).collect()]
        assert len(got) == len(set(got)) and set(got) <= wanted and len(got) >= (len(wanted) if exact else 0.99 * len(wanted)) and len(wanted) > 300
    assert similarity.similar_pairs(reps.limit(0)).count() == 0


def test_a_hub_of_most_edges(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(7, None), (9000, 9000)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(3000)) and all(got[i] == 5000 for i in range(5000, 5041)) and got[9000] == 9000


def test_fast_bootstrap_agrees_with_row_draws(spark):
    cells = spark.createDataFrame([("a", 70, 5, 9, 66), ("b", 0, 0, 0, 3), ("c", 0, 0, 0, 0), ("d", 5, 0, 0, 0)], "m string, tn long, fp long, fn long, tp long")
    fast = {r["m"]: r for r in metrics.fast_bootstrap_f1(cells, ["m"]).collect()}
    slow = {r["m"]: r for r in metrics.bootstrap_f1(cells, ["m"]).collect()}
    assert set(fast) == set(slow) == {"a", "b", "d"} and fast["b"]["ci_low"] == 1.0 and fast["d"]["ci_high"] == 0.0
    assert all(fast["a"][c] == pytest.approx(slow["a"][c], abs=0.01) for c in ("f1_mean", "ci_low", "ci_high"))
    assert metrics.fast_bootstrap_f1(cells.limit(0), ["m"]).count() == 0
