"""Record copies, cross-split pairs and near-duplicates against brute force, with hostile rows."""

import itertools
import random
import re

import pyarrow as pa
import pytest

from lexiloom.llm import kernels, near, records

WORDS = "the invoice account river garden window seven orange paper silver morning letter branch office market bridge simple travel kitchen winter number region ticket engine planet forest candle pocket system mirror".split()


def key(t):
    return re.sub("[^a-z0-9]", "", (t or "").lower())


def plain_pieces(t):
    k = key(t)
    return {k[i : i + 5] for i in range(len(k) - 4)} or ({k} if k else set())


def similarity(x, y):
    a, b = plain_pieces(x), plain_pieces(y)
    return len(a & b) / len(a | b) if a and b else 0.0


def tree(t):
    body, fields = [], []
    for line in (t or "").split("\n"):
        (fields if re.match(r"[A-Za-z][A-Za-z ]{0,29}[:=]\s*[^/\s]", line.strip()) else body).append(key(line))
    return "".join(body), tuple(sorted(fields))


def hostile():
    return [None, "", " \n ", "!?", "é", "ab", "A-b", "K", "k", "x" * 200_000, "Subject: a\nFrom: b\nbody", "FROM = b\r\n  body\r\nSubject:a", "Link: /x\nbody", "link/x body", "a:\nb", "İx", "a : b\nc", "\n\nA\nb: c"]


def corpus(seed, n):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(15, 60))) for _ in range(n)]
    out = list(base)
    for t in base:
        words = t.split()
        for _ in range(rng.choice([0, 1, 3, 8, 14])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out + [t.upper().replace(" ", "\n") for t in base[:10]] + hostile()


@pytest.fixture(scope="module")
def emails(spark):
    texts = corpus(1, 60)
    rng = random.Random(4)
    splits = [rng.choice(["train", " Train", "TEST", "val", "validation ", None]) for _ in texts]
    rows = [(i, t, s, "clash", i) for i, (t, s) in enumerate(zip(texts, splits))]
    return rows, spark.createDataFrame(rows, "email_id long, text string, split string, `class` string, `id` long")


def test_records_against_trees(spark, emails):
    rows, df = emails
    groups = {}
    for i, t, *_ in rows:
        if key(t):
            groups.setdefault(tree(t), []).append(i)
    wanted = sorted((i, min(g)) for g in groups.values() for i in g if i != min(g))
    got = sorted((r["id"], r["first_id"]) for r in records.copies(df).collect())
    assert got == wanted and len(got) > 10
    assert sorted(r["n_copies"] for r in records.records(df).collect()) == sorted(map(len, groups.values()))


def test_kernel_tree_agrees_with_plain_tree():
    for t in corpus(9, 5):
        (body,), (fields,) = kernels.trees(pa.array([t or ""]))
        assert (len(body), sorted(map(len, fields))) == (len(tree(t)[0]), sorted(map(len, tree(t)[1]))) or "K" in (t or "") or "İ" in (t or "")


def test_digests_tell_complementary_thue_morse_texts_apart(spark):
    """Strings that collide under every polynomial hash modulo a power of two."""
    word = "ab"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, word.upper()), (3, other), (4, other + "!"), (5, f"Subject: {word}\nx"), (6, f"Subject: {other}\nx")], "email_id long, text string")
    assert sorted((r[0], r[1]) for r in records.copies(df).collect()) == [(2, 1), (4, 3)]
    assert sorted((r[0], r[1]) for r in records.records(df).collect()) == [(1, 2), (3, 2), (5, 1), (6, 1)]


def test_records_with_null_ids_and_ids_used_twice(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "A b"), (7, "c"), (7, "C"), (7, "d"), (7, "D"), (9, "d")], "email_id long, text string")
    assert sorted((r[0] or 0, r[1]) for r in records.records(df).collect()) == [(0, 2), (7, 2), (7, 3)]
    assert [(r[0], r[1]) for r in records.copies(df).collect()] == [(9, 7)]


def test_block_shape_keeps_chance_meetings_in_proportion():
    met = [n * n / 2.0**bits * blocks for n in (10**4, 10**6, 10**8, 10**10) for bits, blocks in [near.block_shape(n)]]
    assert all(b <= a * 100**1.2 for a, b in zip(met, met[1:]))


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "A  B"), (3, None)], "email_id long, text string")
    assert sorted(set((r[0], r[1]) for r in records.copies(df).collect())) == [(2, 1)]
    assert records.records(df).first()["n_copies"] == 3
    none = df.limit(0)
    assert records.copies(none).count() == records.records(none).count() == 0
    assert near.near_duplicate_pairs(none).count() == 0
    assert near.cross_split_pairs(none.selectExpr("email_id", "text", "'train' as split")).count() == 0


def test_cross_split_pairs(spark, emails):
    rows, df = emails
    name = lambda s: {"validation": "val"}.get((s or "").strip().lower(), (s or "").strip().lower())
    wanted = {(a[0], b[0]) for a in rows for b in rows if name(a[2]) == "train" and name(b[2]) in ("val", "test") and similarity(a[1], b[1]) >= 0.8}
    got = [(r["train_id"], r["eval_id"]) for r in near.cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= wanted and len(set(got)) >= 0.95 * len(wanted) and len(wanted) > 8


def test_near_duplicates(spark, emails):
    rows, df = emails
    wanted = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if similarity(a[1], b[1]) >= 0.5 and tree(a[1]) != tree(b[1])}
    got = [(r["id_a"], r["id_b"]) for r in near.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= wanted and len(set(got)) >= 0.95 * len(wanted) and len(wanted) > 20


def test_a_third_of_all_rows_the_same(spark):
    texts = corpus(3, 40)[:80]
    rows = [(i, t, "train" if i % 2 else "test") for i, t in enumerate(texts + ["one and the same text for a third of all rows"] * 40)]
    df = spark.createDataFrame(rows, "email_id long, text string, split string")
    assert near.near_duplicate_pairs(df.where("email_id >= 80")).count() == 0  # copies are no pairs
    assert records.copies(df).where("first_id = 80").count() == 39
    got = near.cross_split_pairs(df).where("train_id >= 80 and eval_id >= 80")
    assert got.count() == 20 * 20


def test_jaccard_and_keys():
    texts = pa.array([t or "" for t in corpus(5, 8)[:-18] + ["K", "İx", "ab", ""]])
    digits, offs = kernels.keys(texts)
    assert [int(n) for n in offs[1:] - offs[:-1]] == [len(key(t)) for t in texts.to_pylist()]
    left, right = texts.to_pylist(), list(reversed(texts.to_pylist()))
    assert kernels.jaccard(pa.array(left), pa.array(right)).tolist() == pytest.approx([similarity(a, b) for a, b in zip(left, right)])


def test_groups_are_chains_of_pairs_and_copies(spark, emails):
    rows, df = emails
    group = {i: i for i, *_ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    pairs = [(r["id_a"], r["id_b"]) for r in near.near_duplicate_pairs(df).collect()] + [(r["id"], r["first_id"]) for r in records.copies(df).collect()]
    first = {}
    for i, t, *_ in rows:
        if key(t):
            pairs.append((i, first.setdefault(key(t), i)))
    for a, b in pairs:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    got = near.near_duplicate_groups(df).collect()
    assert {r["id"]: r["group"] for r in got} == {i: find(i) for i in group} and len(got) == len(rows)
    assert sum(r["n_links"] for r in got) > 0 and near.near_duplicate_groups(df.limit(0)).count() == 0


def test_overlap_counts(spark, emails):
    _, df = emails
    per = near.overlap_counts(df, source_col="class").collect()
    assert sum(r["n_pairs"] for r in per) == near.cross_split_pairs(df).count() and {r["split"] for r in per} <= {"val", "test"}


def test_edits_of_a_template_that_a_third_of_all_rows_share(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template = some(900)
    texts = [template + some(50) for _ in range(300)] + [some(950) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "email_id long, text string")
    assert similarity(texts[0], texts[1]) > 0.85
    got = {(r["id_a"], r["id_b"]) for r in near.near_duplicate_pairs(df).collect()}
    assert got == set(itertools.combinations(range(300), 2))


def test_repeated_passages_turn_no_fingerprint(spark):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(404))
        rows += [(2 * i, text, "test"), (2 * i + 1, text + text[300:] * 5, "train")]
    assert similarity(rows[0][1], rows[1][1]) > 0.97
    got = {(r["train_id"], r["eval_id"]) for r in near.cross_split_pairs(spark.createDataFrame(rows, "email_id long, text string, split string")).collect()}
    assert got == {(2 * i + 1, 2 * i) for i in range(60)}
