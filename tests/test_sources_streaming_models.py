import hashlib
import mailbox
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import style
from lexiloom.operators import models, ranking
from lexiloom.sources import readers, writers
from lexiloom.streaming import pipeline


def test_csv_round_trip(spark, tmp_path, rows_of):
    df = spark.createDataFrame([('He said "hi",\nthen left', 1, "a"), ("plain", 0, "b"), ("PLAIN ", 0, "b")], "text string, label int, source string")
    writers.write_corpus_csv(df, str(tmp_path / "c"))
    assert sorted(r[1] for r in rows_of(readers.read_csv(spark, str(tmp_path / "c")))) == [0, 1]
    (tmp_path / "bad.csv").write_text("text,other\nx,1\n")
    with pytest.raises(ValueError, match="label"):
        readers.read_csv(spark, str(tmp_path / "bad.csv"))


def test_csv_keeps_the_first_row_and_fails_on_labels(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label,n\n"Same text",1,first\n"same  TEXT ",0,second\n" ",1,blank\nother,-3,x\n')
    got = {r["text"]: (r["label"], r["n"]) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"Same text": (1, "first"), "other": (-3, "x")}
    (tmp_path / "b.csv").write_text("text,label\nx,one\n")
    with pytest.raises(Exception, match="no integer label"):
        readers.read_csv(spark, str(tmp_path / "b.csv")).collect()
    assert readers.read_table(spark, str(tmp_path / "a.csv")).columns == ["text", "label", "n"]


def test_results_document(spark):
    df = spark.createDataFrame([("m", 0.5, 0.25, 0.3, 0.9, 0.8, 0.1, 0.7, 1, 2, 3, 4)], "model string, precision double, recall double, f1 double, accuracy double, auc double, ci_low double, ci_high double, tn int, fp int, fn int, tp int")
    (one,) = writers.results_document(df, {"m": {"depth": 3}})
    assert one["confusion_matrix"] == [[1, 2], [3, 4]] and one["f1_ci_low"] == 0.1 and one["best_params"] == {"depth": 3} and one["model"] == "m"


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lexiloom import runtime

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *a: None)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.shared_dir(fake("spark://host:7077"))
    assert runtime.shared_dir(fake("local[4]")).startswith("file:")


def test_folders_headers_digests(spark, tmp_path):
    for folder, name, body in (("h", "1.txt", "one"), ("h", "2.txt", "ONE "), ("m", "1.txt", "Header: x\nbody"), ("m", "2.eml", "two")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(body)
    both = readers.read_two_folders(spark, str(tmp_path / "h"), str(tmp_path / "m")).collect()
    assert len(both) == 3 and sum(r["label"] for r in both) == 2
    assert [r["text"] for r in readers.read_headed_texts(spark, str(tmp_path / "m")).collect()] == ["body"]
    assert {r["sha256"] for r in readers.file_digests(spark, str(tmp_path / "h")).collect()} == {hashlib.sha256(x).hexdigest() for x in (b"one", b"ONE ")}


def test_mbox_and_bodies(spark, tmp_path):
    box = mailbox.mbox(str(tmp_path / "box-1"))
    for subject, plain, html in (("a", "Grüße", "<p>x</p>"), ("b", None, "<b>A</b><br>B &amp; C<script>no()</script>"), ("DON'T DELETE: FOLDER INTERNAL DATA", "x", None)):
        m = EmailMessage()
        m["Subject"] = subject
        if plain:
            m.set_content(plain, charset="iso-8859-1")
        if html:
            m.add_alternative(html, subtype="html") if plain else m.set_content(html, subtype="html")
        box.add(m)
    box.flush()
    parts = readers.read_mbox(spark, str(tmp_path / "box-1"))
    got = {r["msg_no"]: r["body"].strip() for r in readers.message_bodies(parts.unionByName(parts)).collect()}
    assert got == {0: "Grüße", 1: "A \nB & C"}


def test_message_bodies_of_dirty_parts(spark):
    rows = [("s", 1, 0, None, "text/plain", "no-such", b"caf\xc3\xa9"), ("s", 1, 1, None, "text/plain", None, b"\xff"), ("s", 2, 0, "x", "text/html", "utf-8", None), ("s", 3, 0, "x", "image/png", None, b"x")]
    df = spark.createDataFrame(rows, readers.MESSAGE_PARTS)
    assert {r["msg_no"]: r["body"] for r in readers.message_bodies(df).collect()} == {1: "café\n�", 2: "", 3: ""}
    assert readers.message_bodies(df.limit(0)).count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.12345, 1), ("b", None, 2)], "name string, value double, n int")
    assert writers.markdown(df).splitlines() == ["| name | value | n |", "|---|---|---|", "| a | 0.123 | 1 |", "| b |  | 2 |"]
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "one.json").write_text('{"a": {"b": [1, 2]},\n "c": 3}')
    assert tuple(readers.read_json(spark, str(tmp_path / "one.json")).select("a.b", "c").first()) == ([1, 2], 3)
    writers.write_table_csv(df, str(tmp_path / "t"))
    assert "0.123450" in "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    writers.write_snippets(spark.createDataFrame([("k", "a\nb")], "key string, text string"), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()[0] == "k\ta b"
    with pytest.raises(ValueError):
        writers.alignment(spark, [("x", "Done")])
    assert writers.status_histogram(writers.alignment(spark, [("x", "Completed"), ("y", "Completed")])).first()["n"] == 2
    assert readers.synthetic(spark, 5).groupBy("label").count().collect()[0]["count"] == 5


def test_streams(spark, tmp_path):
    rows = [(1, "a", 0, "please click the account link now " * 8, "2024-01-01 10:00:00"), (2, "a", 1, "short", "2024-01-01 11:00:00"), (3, "a", 1, None, None)]
    df = spark.createDataFrame(rows, "id long, source string, label int, text string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made, mode in (("feats", pipeline.stream_features(stream, ["word_count"]), "append"), ("funnel", pipeline.stream_funnel(stream, "at"), "complete"), ("unique", pipeline.stream_unique(stream, "id", "at"), "append")):
        query = made.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert {r["id"]: r["word_count"] for r in spark.table("feats").collect()} == {1: 48, 2: 1, 3: 0}
    r = spark.table("funnel").first()
    assert (r["messages"], r["excluded_length"]) == (2, 1) and spark.table("unique").count() == 3


def test_models_on_synthetic_texts(spark):
    df = models.weighted(ranking.stratified_split(readers.synthetic(spark, 60), "label", "id"))
    names = style.SCALARS
    made = style.features(df, names=names).cache()
    train, test = made.where("split = 'train'"), made.where("split = 'test'")
    model = models.logistic(names, train.count()).fit(train)
    assert models.evaluated(models.predictions(model, test, "id")).first()["f1"] > 0.8
    drops = models.permutation_importance(model, test, names, "id", repeats=2).collect()
    assert len(drops) == len(names) and max(r["mean_drop"] for r in drops) <= 1
    tree, best = models.grid_search(models.forest(names, numTrees=5), ranking.folds(train, "label", "id", 3), {"maxDepth": [2, 3]})
    assert best["maxDepth"] in (2, 3) and models.impurity_importance(tree, names, 5).count() == 5 and models.impurity_importance(model, names).count() == 0


def test_permutation_queries_repeat_ten_times(monkeypatch):
    from unittest import mock

    from lexiloom.plans import model_queries

    seen = []
    monkeypatch.setattr(model_queries, "F", mock.MagicMock())
    for name in ("_matrix", "_fit"):
        monkeypatch.setattr(model_queries, name, mock.MagicMock())
    for name in ("metrics", "models"):
        monkeypatch.setattr(model_queries, name, mock.MagicMock())
    model_queries.models.permutation_importance = lambda *a, repeats=10, **k: seen.append(repeats) or mock.MagicMock()
    monkeypatch.setattr(model_queries, "Window", mock.MagicMock())
    model_queries.permutation_importance(None, "")
    model_queries.importance_agreement(None, "")
    assert seen == [10, 10]


def test_descent_against_plain_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(2, 3, 200), rng.normal(0, 1, 200), np.full(200, 7.0)])
    y = (x[:, 0] + rng.normal(0, 2, 200) > 2).astype(float)
    df = spark.createDataFrame([(i, *map(float, row), int(t)) for i, (row, t) in enumerate(zip(x, y))] + [(900, 1.0, None, 1.0, 1), (901, 1.0, 1.0, 1.0, None)], "id long, a double, b double, `c.d` double, label int")
    made = models.descent(df, ["a", "b", "c.d"], epochs=30)
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd == 0, 1, sd)
    w, b = np.random.default_rng(42).normal(0, 0.01, 3), 0.0
    for _ in range(30):
        off = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.1 * (z.T @ off / 200 + 1e-3 * w), b - 0.1 * off.mean()
    assert made.weights == pytest.approx(w.tolist()) and made.intercept == pytest.approx(b)
    scored = made.scored(df.where("id < 200"), "id").collect()
    assert [r["score"] for r in sorted(scored, key=lambda r: r["id"])] == pytest.approx((1 / (1 + np.exp(-(z @ w + b)))).tolist())
    with pytest.raises(ValueError, match="no rows"):
        models.descent(df.limit(0), ["a"])


def test_feature_checks_describe_each_text_once(spark, tmp_path):
    """Means and matrix come from one table of features and equal those of the queries; ids may repeat."""
    from lexiloom.functions import style
    from lexiloom.plans import model_queries
    from lexiloom.plans import queries as core

    texts = ["Please pay 5 EUR to a@b.com now.", "please  pay 5 EUR to a@b.com now.", "We met in ٣ rooms, m² and so on!", "", " ", None, "Is it the one?", "Nobody knows why it rains."]
    rows = [(i % 30, f"{t} {i % 9}" if t and t.strip() else t, i % 3, f"s{i % 2}") for i, t in enumerate(texts * 6)]
    spark.createDataFrame(rows, "email_id long, text string, label int, source string").write.parquet(f"{tmp_path}/emails.parquet")
    found, matrix = model_queries._described(spark, str(tmp_path))
    want = model_queries._matrix(spark, str(tmp_path))
    as_set = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert as_set(matrix) == as_set(want) and want.count() > 5
    means = core._class_means(found.select("label", *[F.round(c, 6).alias(c) for c in style.FOCUS]))
    assert sorted(map(repr, means.collect())) == sorted(map(repr, core.queries()["class_means"](spark, str(tmp_path)).collect()))
