"""Grouped splits, personal items, encodings, leakage, mixing and residue on small fixtures with hostile rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import encoding, grouping, leakage, mixing, personal, residue

HOSTILE = [None, "", " ", "\n\n", "x" * 100_000, "é" * 50, "\x00\x07", "{{", "[[", "@", "(at)"]


# -- grouped splits --


def test_case_references(spark):
    texts = {
        "We opened case no. AB-123456.": ["AB123456"], "dossier ab 123456 et Vorgang: CD654321": ["AB123456", "CD654321"], "Ticket #AB123456, ref. AB-123456": ["AB123456"],
        "form AB-123456": [], "suitcase AB-123456": [], "case AB-1234567": [], "case ABC-123456": [], "reference\u00a0XY-000001": ["XY000001"], "expedi\u0435nte XY-000001": ["XY000001"], "": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "i int, t string")
    got = {r["i"]: r["r"] for r in df.select("i", grouping.case_references(F.col("t")).alias("r")).collect()}
    assert got == dict(enumerate(texts.values())) | {99: []}


def test_author(spark):
    rows = ['"A B" <a.b@x.example>', "A.B@X.example ", "no address", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string").orderBy("i").select(grouping.author(F.col("s"))).collect()]
    assert got == ["a.b@x.example", "a.b@x.example", None, None, None]


def test_grouped_split_ties_and_shares(spark):
    rng = random.Random(1)
    rows = [(i, f"case AB-{rng.randrange(400):06d}" if rng.random() < 0.05 else rng.choice(HOSTILE[:4]), rng.choice([None, f"s{rng.randrange(300)}"]), rng.choice([None, f"<u{rng.randrange(600)}@x.example>"]), rng.choice([0, 1, None])) for i in range(3000)]
    rows += [(5000 + i, None, "hot", f"<h{i}@x.example>", i % 2) for i in range(1500)]
    df = spark.createDataFrame(rows, "email_id long, text string, source string, sender string, label int")
    got = {r["id"]: r for r in grouping.grouped_split(df).collect()}
    assert len(got) == 4500 and {r["split"] for r in got.values()} <= set(grouping.SPLITS)
    of = {}
    for i, text, source, sender, _ in rows:
        for name in (source and "s" + source, sender, *re.findall("AB-[0-9]{6}", text or "")):
            if name:
                assert of.setdefault(name, got[i]["split"]) == got[i]["split"]
    assert {got[5000 + i]["split"] for i in range(1500)} == {got[5000]["split"]}
    empty = grouping.grouped_split(df.limit(0))
    assert empty.count() == 0 and grouping.tied_sources(df.limit(0)).count() == 0


# -- personal items --

ITEMS = [
    ("Hi Frida,\n\nAsk for Ivo Skeistesk at our desk or call +44 20 7946 0224.", [("NAME", "Frida"), ("NAME", "Ivo Skeistesk"), ("PHONE", "+44 20 7946 0224")]),
    ("Write to a.b+c@mail-x.example or to x_y (at) host-a (dot) test.", [("EMAIL", "a.b+c@mail-x.example"), ("EMAIL", "x_y (at) host-a (dot) test")]),
    ("Call (215) 555-0143 or 01 99 00 86 18, order 106-4484684-44428, 192.0.2.18, 2022-11-22.", [("PHONE", "(215) 555-0143"), ("PHONE", "01 99 00 86 18")]),
    ("We hold the number 928-11-7260 for Renée van Kineth.", [("ID", "928-11-7260"), ("NAME", "Renée van Kineth")]),
    ("Tax number: ZZ79 9365 4808 3519\nAccount holder: Torravik, Rob", [("ID", "ZZ79 9365 4808 3519"), ("NAME", "Torravik, Rob")]),
    ("Home address: Flat 15, 138 Old Tannery Lane, Elmsgate", [("ADDRESS", "Flat 15, 138 Old Tannery Lane")]),
    ("Die Sendung für Oskar Greirrix liegt bei Mühlweg 30.", [("NAME", "Oskar Greirrix"), ("ADDRESS", "Mühlweg 30")]),
    ("Votre conseillère Sabine Bistimont habite 162, rue Belle-Échelle.", [("NAME", "Sabine Bistimont"), ("ADDRESS", "162, rue Belle-Échelle")]),
    ("The Marta Street depot closes in April. Everquay Bank will call.", []),
    ("Ask for Anna Ke\u00adllin\u200ber at our desk", [("NAME", "Anna Ke\u00adllin\u200ber")]),
    ("Dear Dr Paeltusen,\n\nregards", [("NAME", "Paeltusen")]),
]


@pytest.mark.parametrize("text, wanted", ITEMS)
def test_items(text, wanted):
    assert [(k, text[a:b]) for a, b, k in personal.Finder().find(text)] == wanted


def test_items_operator_and_surrogates(spark):
    texts = [t for t, _ in ITEMS] + HOSTILE
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "email_id long, text string, kind string")
    got = personal.items(df).collect()
    assert sorted((r["kind"], r["value"]) for r in got) == sorted(x for _, w in ITEMS for x in set(w))
    made = {r["email_id"]: r["text"] for r in personal.pseudonymised(df, "key").collect()}
    assert len(made) == len(texts) and made[len(ITEMS)] is None and made[8] == texts[8]
    for i, (text, wanted) in enumerate(ITEMS):
        for kind, value in wanted:
            assert value not in made[i] and f"[{kind} " in made[i]
    again = {r["email_id"]: r["text"] for r in personal.pseudonymised(df, "other").collect()}
    assert again[0] != made[0] and personal.items(df.limit(0)).count() == personal.pseudonymised(df.limit(0), "k").count() == 0


def _surrogates():
    return personal.Surrogates(b"k", personal.FEMALE, personal.MALE)


def test_surrogates_keep_type_and_coreference():
    f, s = personal.Finder(), _surrogates()
    text = "Hi Frida,\n\nAsk for Frida Qasto or call +44 20 7946 0224, again +442079460224. Ask for Felix Qasto."
    made = personal.replaced(text, f.find(text), s)
    first, full, other = re.findall(r"\[NAME ([^\]]+)\]", made)
    assert full.startswith(first) and first in personal.FEMALE and other.split()[0] in personal.MALE and other.split()[1] == full.split()[1]
    a, b = re.findall(r"\[PHONE ([^\]]+)\]", made)
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4}", a) and a.replace(" ", "") == b
    one = lambda kind, value: s.one(kind, value, personal._KEPT)
    assert one("PHONE", "+353 1 555 0143").startswith("+353 ") and one("PHONE", "+1 215 555 0143").startswith("+1 ")
    assert one("ADDRESS", "Mühlweg 30").split()[0].endswith("weg") and one("ADDRESS", "138 Old Tannery Lane").endswith(" Lane")
    assert one("NAME", "ivo van Kineth") == one("NAME", "Ivo van KINETH").replace(one("NAME", "Ivo"), one("NAME", "ivo")).replace(one("NAME", "KINETH"), one("NAME", "Kineth"))
    for word in ("Иванов", "Παπαδόπουλος", "田中", "כהן", "محمد", "Müller", "Nguyễn"):
        made = one("NAME", word)
        script = next(k for k in personal.surrogates._SCRIPTS.values() if k.match(word))
        assert made != word and script.match(made) and made[:1].isupper() == word[:1].isupper()


@pytest.mark.parametrize("kind, shape", [("NAME", "{w} {v}"), ("NAME", "{w}"), ("EMAIL", "{w}.{v}@{v}{n}.example"), ("PHONE", "+44 20 {n:04d} {m:04d}"), ("ID", "AB{n:04d}{m:03d}C"), ("ADDRESS", "{n} {w} Lane")])
def test_no_two_of_many_values_share_a_surrogate(kind, shape):
    rng, s = random.Random(5), _surrogates()
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))).capitalize()
    values = {shape.format(w=word(), v=word(), n=rng.randrange(1, 10_000), m=rng.randrange(1000)) for _ in range(20_000)} | ({*personal.FEMALE, *personal.MALE} if shape == "{w}" else set())
    canonical = {v.lower() for v in values}
    made = {v: s.one(kind, v, personal._KEPT).lower() for v in canonical}
    assert len(set(made.values())) == len(canonical) and all(k != v for k, v in made.items())


# -- encodings --


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp1251", "cp437"])
def test_round_trip_of_damage(page):
    text = "Céline écrivit à Jürgen: “Über 20 € für die Größe” – año, niño, señor."
    wrong = text.encode("utf-8").decode(page, "replace")
    if "\ufffd" in wrong:
        assert encoding.repair(wrong)[1]
        return
    assert encoding.repair(wrong) == (text, True)
    half = text[:20] + text[20:].encode("utf-8").decode(page)
    assert encoding.repair(half) == (text, True)


def test_double_damage_and_single_byte_pages():
    text = "Céline répondit: le résumé coûte 20 €"
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(twice) == (text, True)
    for page in ("mac_roman", "cp1251"):
        assert encoding.repair(text.encode("cp1252").decode(page)) == (text, True)


@pytest.mark.parametrize("text", ["AVISO DE ALTERAÇÃO, SÃO 3 PÁGINAS", "IRMÃ ÂNGELA, CORAÇÃO e PÃO", "Проверка завершена.", "сеrtіficate of the vоte", "✅ ⚠️ 🔒", "Grüße für Øystein, “naïve” … £5 – €6", "Ångström à la carte", "", None, "plain"])
def test_genuine_text_stays(text):
    assert encoding.repair(text) == (text, False)


def test_restored_operator(spark):
    df = spark.createDataFrame([(1, "CafÃ© noir", 7), (2, "Café noir", 8), (3, "bad \ufffd", 9), *[(10 + i, t, 0) for i, t in enumerate(HOSTILE)]], "email_id long, text string, id int")
    got = {r["email_id"]: (r["restored"], r["id"]) for r in encoding.restored(df).collect()}
    assert got == {1: ("Café noir", 7), 3: ("bad \ufffd", 9)} and encoding.restored(df.limit(0)).count() == 0


# -- leakage --


def test_leaks_against_windows(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 13, 40]))) for _ in range(30)] + ["", None]
    docs = []
    for _ in range(80):
        words = [rng.choice(vocabulary) for _ in range(60)]
        source = (rng.choice(items[:30])).split()
        n = rng.choice([0, 8, 11, 12, 13, 40])
        at = rng.randrange(max(1, len(source) - n))
        words[rng.randrange(60) : 0] = source[at : at + n]
        docs.append(rng.choice([" ", ", ", "\n"]).join(words).upper())
    docs += [*HOSTILE, items[3].replace("w", "W\u200b")]
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower().replace("\u200b", ""))
    windows = lambda t: {tuple(words(t)[i : i + 12]) for i in range(len(words(t)) - 11)}
    wanted = {(d, i) for d, x in enumerate(docs) for i, y in enumerate(items) if windows(x) & windows(y)}
    rows = spark.createDataFrame([(d, t, 1) for d, t in enumerate(docs)] + [(0, docs[0], 1)], "doc_id long, text string, item_id int")
    held = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = [tuple(r) for r in leakage.leaks(rows, held).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 20
    assert leakage.leaks(rows.limit(0), held).count() == leakage.leaks(rows, held.limit(0)).count() == 0


# -- mixing --


def test_mix_shares_caps_and_epochs(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(5, 60))), s) for i, s in enumerate(["Big"] * 300 + [" small_one "] * 20 + ["tiny"] * 5 + ["none"] * 10 + [None] * 3)]
    docs += [(900 + i, t, "Big") for i, t in enumerate(HOSTILE[:4])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("big", 0.5, None), ("small-one", 0.4, 3), ("tiny", 0.1, 1), ("absent", 0.0, None)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(df, targets)
    rows = selection.collect()
    made = {r["source"]: r for r in report.collect()}
    per = {s: [r for r in rows if r["source"] == s] for s in made}
    assert set(made) == {"big", "small-one", "tiny", "absent"} and not per["absent"]
    assert max(r["copies"] for r in per["small-one"]) <= 3 and max(r["copies"] for r in per["tiny"]) <= 1
    for s, r in made.items():
        assert r["tokens"] == sum(x["copies"] * x["tokens"] for x in per[s]) and abs(r["tokens"] - r["budget"]) <= 40  # half a document
        copies = [x["copies"] for x in per[s] if x["tokens"]]
        assert not copies or max(copies) - (min(copies) if len(copies) == r["documents"] else 0) <= 1
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.02 for r in made.values()) and sum(r["actual_share"] for r in made.values()) == pytest.approx(1)
    assert made["tiny"]["tokens"] == made["tiny"]["budget"] == sum(x["tokens"] for x in per["tiny"])  # its cap decides the total
    _, more = mixing.mix(df, targets, total=20_000)
    asked = {r["source"]: r for r in more.collect()}
    assert asked["tiny"]["tokens"] == made["tiny"]["tokens"] and asked["big"]["tokens"] == pytest.approx(10_000, abs=40)
    assert mixing.mix(df.limit(0), targets)[0].count() == mixing.mix(df, targets.limit(0))[0].count() == 0


def test_better_documents_come_more_often(spark):
    docs = [(i, "word " * 20 if i % 2 else "#### 12 " * 20, "s") for i in range(4000)]
    selection, _ = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([("s", 0.1, None)], "source string, target_share double, max_repeats int"))
    chosen = [r["id"] % 2 for r in selection.collect()]
    assert sum(chosen) > 0.68 * len(chosen) > 50  # qualities of 1 and about 0.33 make about three of four


# -- residue --

BAD = [
    "Summary\n\nYou need to enable JavaScript to run this app.", "404 Not Found\nThe requested URL /x was not found on this server.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.",
    "Home | Archive | Help\n\njava.lang.NullPointerException\n\tat app.View.page(View.java:24)", "Dear {{first_name}},\n\nyour order is ready and waits for you.", "Report\n\nTBD TBD TBD\nto be written\nTBD", "Dear [Your Company], thanks.",
    "Veuillez activer JavaScript pour afficher ce message.", "Texte à venir. Texte à venir. Titre ici.", "© 2023 X\n\nToo many requests. You have been rate limited, retry after 82 seconds.",
]
GOOD = [
    "A banner asking you to enable JavaScript is a common trick, so the desk blocks it.\n\nThe meeting went well and everyone agreed to the plan for the coming spring season.", "The words lorem ipsum in a mail are a sign that a kit was copied without care. We saw two such mails in May.",
    "Our style guide explains that {{name}} style fields are filled by the sender.", "In the sample script the variable ${HOME} points to the folder with 22 keys.", "The rule p { margin: 0 } and the list [a, b] belong to the older layout.",
    "The subject carried the tag [EXTERNAL] and the body had [REDACTED] where the number stood [1].", "Readers asked why a page sometimes says 404 not found, and the answer is that the sender removed it.", "Write to bruno[at]help.example at once.", "Costs rose 5 % from 40% to 60%, i.e. <20 or >30.",
]


def _found(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    return {r["id"]: (r["label"], r["trusted"]) for r in residue.residue(df).collect()}


def test_residue_rules(spark):
    texts = ["x" * 100_000, *BAD[1:], *GOOD, *(t for t in HOSTILE if t is None or t[:1] != "x"), BAD[0]]
    got = _found(spark, texts)
    assert set(got) == set(range(len(BAD))) and all(trusted for _, trusted in got.values()), [texts[i] for i in set(got) ^ set(range(len(BAD)))]
    empty = spark.createDataFrame([], "doc_id long, text string, label string")
    assert residue.residue(empty).count() == 0


def test_residue_spreads_to_near_duplicates(spark):
    """A notice under a title, filler between good paragraphs and other wordings count once the corpus knows them as residue."""
    notice = "You need to enable JavaScript to run this app"
    long = "The server met an unexpected condition while it was building the list of folders for your account and has stopped its work, ref {}. Please go back and try again {}."
    texts = [
        notice + ".", "Report on roses\n\n" + notice + ".", "Report on roses\n\nYou need to enable JavaScript to run our app.",
        "Roses\n\nTBD TBD TBD to be written later by us", "The garden has roses.\n\nTBD TBD TBD to be written later by us\n\nThe pond has frogs.",
        "Internal server error. " + long.format("a1", "later"), "Folders of the clerks\n\n" + long.format("b7", "later"), "Folders of the clerks\n\n" + long.format("c2", "tomorrow"),
        "The garden has roses.\n\n" + notice + ".\n\nThe pond has frogs.", "> " + notice + ".", "The garden has roses and tulips and a pond.",
    ]
    got = _found(spark, texts)
    assert got == {0: ("script", True), 1: ("script", False), 3: ("filler", True), 4: ("filler", False), 5: ("error", True), 6: ("error", False), 7: ("error", False)}
    alone = _found(spark, texts[1:3] + texts[4:5] + texts[6:])
    assert alone == {}  # nothing trusted to start from


def test_residue_chains_and_copies_of_one_notice(spark):
    said = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
    chain = ["Access denied. " + " ".join(said) + " try again"]
    for step in range(1, 6):
        said = [*said[:-2], f"end{'abcdef'[step]}x", f"end{'abcdef'[step]}y"][2:] + ["closing", "words"]
        chain.append("A title\n\n" + " ".join(said))
    got = _found(spark, ["Not found"] * 300 + chain)
    assert all(got[i] == ("error", True) for i in range(300)) and got[300][0] == "error" and got[301] == ("error", False)


def test_residue_at_the_threshold_of_similarity(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        said = ["".join(rng.choice("bcdfgklmnprstu") for _ in range(6)) for _ in range(120)]
        rows.append((2 * i, "Placeholder " + " ".join(said)))
        for at in (rng.randrange(10, 50), rng.randrange(60, 110)):
            said[at] = "edited"
        rows.append((2 * i + 1, "The garden has roses.\n\nPlaceholder " + " ".join(said)))  # 107 of 127 five-word shingles shared
    got = {r["id"]: r["trusted"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] for i in range(400)) and sum(got.get(2 * i + 1) is False for i in range(400)) >= 396


LONG_BAD = [
    "java.lang.IllegalStateException: no session\n" + "\n".join(f"\tat org.app.view.Page.step{i}(Page.java:{i})" for i in range(20)) + "\n\tat java.base/java.lang.Thread.run(Thread.java:829)\n\t... 12 more",
    "Traceback (most recent call last):\n" + "\n".join(f'  File "/srv/app/page.py", line {i}, in step\n    step({i})' for i in range(10)) + "\nValueError: no session",
    "You need to enable JavaScript to read this message. The settings of your browser decide whether scripts may run. Open them, look for the page on privacy and choose the first of the entries. Then reload this page. If that is of no use, contact the administrator of your network.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. " * 6,
    "Notes on the harvest of the year before last, gathered by the clerks of the second floor for the friends of the garden and sent to all who had asked for them during the long and rainy weeks of the autumn: " + "ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat " * 40,
    "Coming soon. " * 60,
]
LONG_GOOD = [
    "The page not found by our readers was the one on roses. We planted them in the spring of the year before last, and they have done well since. The beds by the wall get the sun until noon. Those by the gate are in the shade of the old oak. Nobody has watered them since Sunday.",
    "Coming soon to the hall is a play by the pupils of the village. It tells of a miller and of a miller's daughter, who leave the valley for the coast, and of what they find there. Seats are free, doors open at seven, and there is tea and cake for all who help to carry the chairs back afterwards. The last bus leaves at eleven, from the gate, and the first one on the next morning is at six. Please bring a cushion, since the benches are hard.",
]


@pytest.mark.parametrize("text", LONG_BAD)
def test_long_residue(text):
    assert residue._kind(text) in ("error", "script", "filler") or residue._latin(text)


@pytest.mark.parametrize("text", LONG_GOOD)
def test_long_good_text(text):
    assert residue._kind(text) is None and not residue._latin(text)


def test_residue_with_repeated_passages(spark):
    rng = random.Random(22)
    rows = []
    for i in range(40):
        said = ["".join(rng.choice("bcdfgklmnprstu") for _ in range(6)) for _ in range(100)]
        rows += [(2 * i, "Placeholder " + " ".join(said)), (2 * i + 1, "The garden has roses.\n\nPlaceholder " + " ".join(said + said[75:] * 5))]
    got = {r["id"]: r["trusted"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got.get(2 * i + 1) is False for i in range(40))


# genuine texts in some forty languages, mathematics, units, boxes, ligatures and signs
CLEAN = [
    # English, German, French, Spanish, Portuguese, Italian, Catalan, Dutch, Danish, Norwegian, Swedish, Finnish, Icelandic
    "The naïve café owner’s résumé cost £5 – “no more than that” – and 20 °C is fine.", "Größe, Übung und Maß: „Füße dürfen öfter müde sein“, sagte Jürgen am 3. März.", "Où est passée l’élève ? À Noël, l’œuvre « Çà et là » a coûté 5 €, c’est sûr.",
    "¿Qué pasó mañana? El niño comió piñas; ¡qué útil! La cigüeña llegó a las 5 ª.", "Não há coração que não sinta a ação; os pães e as mães são três. Às vezes põe-se o avô à mão.", "Perché non c’è più città? È così: già, più, ciò, lunedì e virtù.", "El col·legi de Sant Cugat és molt gran; l’avinguda paral·lela, l’illa i les cançons són així.",
    "De coördinatie van het café is geëindigd; ’s avonds één reünie.", "Søren køber æbler på øen; æ ø å ÆØÅ. Blåbærgrød på Ærø.", "Håkon går på ski i Tromsø; vær så god, ærlig talt.", "Åsa åt räksmörgås på Öland. ”Blå himmel”, sa hon, »Å, vad fint«. BLÅ» och SMÅ”.", "Äiti söi hyvää pöytää yöllä; Åbo ja Ääni.", "Jón Þórðarson og Guðrún fóru á Þingvöll; það er góð hugmynd, ætíð.",
    # Polish, Czech, Slovak, Slovene, Croatian, Hungarian, Romanian, Turkish, Estonian, Latvian, Lithuanian, Albanian, Maltese, Welsh, Irish
    "Zażółć gęślą jaźń; Łódź, Świętokrzyskie, ŻÓŁĆ i GĘŚLĄ. Mąż Ósmy śpi.", "Příliš žluťoučký kůň úpěl ďábelské ódy. ÚŽASNÝ KŘÍŽ, DĚŠŤ a VÝŠKA. Úžas!", "Vypäť najťažšiu úlohu; ľahký kôň, ĽUBKA a dážď. Šťastie.", "Čmrlj žvrgoli šestnajst ščetk; ČŠŽ.", "Đorđe i Žarko šeću; ćevapi, čaša, džep. ĐAK.", "Árvíztűrő tükörfúrógép; ŐZ ÉS ŰR, Éva öt őze.", "Ștefan și Țuțu au mâncat în București; ţară, şarpe, ĂÂÎȘȚ.", "Iğdır’da güneş ışığı; ŞİŞLİ, Çağdaş Öğüt, İstanbul.", "Õhtul sõi Jüri öösel šokolaadi; ÕUN ja ÄÄR.",
    "Ģertrūde ēd ķiršus, ņem ūdeni; ŠĶĪVIS, Žūpu Ēvalds.", "Įžymus žąsinas ėda; ŪKIS, ČIA, šįmet. Ąžuolas.", "Është çështje e shpejtë; Çelësi ë.", "Ġorġ u Ħal Għaxaq; ŻEBBUĠ.", "Tŷ a dŵr, ŵy; Llŷn a’r tŷ gwyn.", "Tá Seán Ó Súilleabháin ar an ngaoth; ÉIRE Á BÁ.",
    # Russian, Ukrainian, Belarusian, Bulgarian, Serbian, Macedonian, Greek, Armenian, Hebrew, Arabic, Hindi, Chinese, Japanese, Korean, Vietnamese, Thai
    "Привет, как дела? Съешь ещё этих мягких французских булок. «Ёлка» №5, ОБЪЯВЛЕНИЕ.", "Він сказав, що Дія працює; її їжак, Рік і Зірка. Київ, Єва, Ґанок. ВІН І ДІЯ. Сідай! Від Івана.", "Ён кажа: сёньня дождж, Ўсё добра; Дзіва, ВІЦЕБСК.", "Той каза: щъркел, Ѝ; Здравей, ДЪЖД.", "Ђорђе, Љубав и Њива; Ћирилица, Џеп. ЉУБАВ.", "Ѓорѓи, Ќе одам, Ѕвезда и Јас.", "Ο Γιώργος είπε: «Ωραία μέρα», ΆΝΟΙΞΗ, ΰ.", "Բարեւ Ձեզ", "שלום לכולם", "مرحبا بالعالم، كيف الحال؟", "नमस्ते दुनिया", "你好,世界。《书》", "こんにちは、「世界」。", "안녕하세요 세계", "Tiếng Việt rất đẹp; Nguyễn Văn Ân, Đường Điện Biên Phủ, ĐẸP.", "สวัสดีชาวโลก",
    # mathematics, units, typography, boxes, ligatures, emoji, brands
    "x ≤ 5 and y ≥ 3, so √2 ≈ 1.41", "5 Ω, 10 kΩ and 3 MΩ at 20 µF; 5 µm ± 2 %", "∑ of π and ∂f/∂x → ∞, ∫ f dx ≠ 0", "α-helix and β-sheet, γ rays, Δt = 5 s, θ ∈ ℝ", "as shown ‡ and † below; § 5 ¶ 2", "¬p ∧ q ∨ r ⇒ s", "┌──┬──┐\n│ a│ b│\n├──┼──┤\n└──┴──┘", "├── src\n│   └── main\n└─┤Name├─┐", "╔══╗\n║ x║\n╚══╝ █▄▀ ░▒▓", "oﬃce ﬁle and ﬂoor, eﬀect", "m² and m³, x² + y³ = z², 10⁻⁹, H₂O, CO₂, ½ ¼", "a±b, 5×3÷2, 3′ 5″, 50‰", "■ first\n● second\n✓ done ★ ☎ → ↑", "Thanks 😀👍🏽 ❤️ see you…", "Acme™ and Foo® © 2020, № 5, № 7", "f(x) = ax² + bx³y", "LE CAFÉ… “CAFÉ” «CAFÉ» CAFÉ®", "e.g. señor Ñandú, NIÑO”, AÑO», Ã and Â as letters: PÃO, MÂE»", "Pâté à l’ancienne: 1,5 kg à 12 €/kg – n° 5", "Der Weg Wien—Österreich, Paris–Évry, «étude» und “état”; “École”.", "Spannung 2πrh, ρgh und 3x²y; E=mc², kΩ·m.",
]


@pytest.mark.parametrize("text", CLEAN)
def test_genuine_text_stays_as_it_is(text):
    assert encoding.repair(text) == (text, False)


@pytest.mark.parametrize("page", ["mac_roman", "cp1251", "cp437", "cp850"])
def test_single_bytes_of_half_a_text(page):
    text = "Céline a reçu la réponse.\nDie Gebühr für größere Päckchen wurde gelöscht."
    lines = text.split("\n")
    for wrong in (text.encode("cp1252").decode(page), lines[0] + "\n" + lines[1].encode("cp1252").decode(page)):
        assert encoding.repair(wrong) == (text, True)


@pytest.mark.parametrize("text", CLEAN[1:6])
def test_damaged_samples_come_back(text):
    """What was planted is compared with what comes back, for texts decoded wrongly as a whole."""
    for page in ("cp1252", "latin-1", "cp437"):
        table = {b: c for c, b in encoding._BYTE[page].items()}
        wrong = "".join(chr(b) if b < 128 else table[b] for b in text.encode("utf-8"))
        assert encoding.repair(wrong) == (text, True)


def test_given_names_of_single_senders_and_long_lists(spark):
    name = lambda i: "Qu" + "".join("abdeiklmno"[int(d)] for d in f"{i:04d}") + "x"
    df = spark.createDataFrame([(i, f"{name(i)} Bistimont <a{i}@b.example>", f"We met {name(i)} Bistimont at noon.") for i in range(6000)], "email_id long, sender string, text string")
    given = personal.given_names(df)
    assert len(given) == 6000
    got = {r["email_id"]: r["value"] for r in personal.items(df.where("email_id % 100 = 0"), given=given).collect()}
    assert got == {i: f"{name(i)} Bistimont" for i in range(0, 6000, 100)}


@pytest.mark.parametrize("text", ["a ≥ b", "■ first\n■ second", "– ■ item, café", "și țara, Elçin Məmmədov", "x − y = ∞", "meeting with 田中 at noon", "שלום to all", "مرحبا to all"])
def test_signs_and_scripts_come_back(text):
    for page in ("cp1252", "latin-1"):
        table = {b: c for c, b in encoding._BYTE[page].items()}
        wrong = "".join(chr(b) if b < 128 else table[b] for b in text.encode("utf-8"))
        assert encoding.repair(wrong) == (text, True)


@pytest.mark.parametrize("text", ["“LE CAFÉ” opens", "hon gick på…” och sa", "CAFÈ™ is a brand"])
def test_letters_before_signs_stay(text):
    assert encoding.repair(text) == (text, False)


# -- names learned from context --

UNKNOWN = ["Thandiwe", "Priyanka", "Takeshi", "Siobhan", "Olumide", "Hiroshi", "Aisha", "Ngozi", "Xiaoming", "Barack"]


def _letters(rng, n, given):
    """Texts around names; given names of the list `given`."""
    family = lambda: "".join(rng.choice(["bre", "ska", "tol", "vik", "mun", "gra", "zei", "lo"]) for _ in range(3)).capitalize()
    frames = ["Please ask for {} at our desk.", "The report by {} was sent on Monday.", "We spoke to {} about the bill.", "Kind regards,\n{}", "Hello {},\n\nyour parcel is here.", "Yesterday {} called us."]
    orgs = ["the Marlowe Stores closed", "at Everquay Bank they told us", "the desk of Corviden Travel wrote"]
    out = []
    for _ in range(n):
        name = f"{rng.choice(given)} {family()}"
        out.append((f"We wrote in May to say that {rng.choice(orgs)} and the bank, the stores and the travel desk agreed. " + rng.choice(frames).format(name), name))
    return out


def test_names_outside_the_lists_are_learned():
    rng = random.Random(4)
    known, hidden = _letters(rng, 900, personal.FEMALE + personal.MALE), _letters(rng, 200, UNKNOWN)
    sample = [t for t, _ in known + hidden[:60]]
    model = personal.names.fit(sample, personal.Finder().find, personal.names.vocabulary())
    plain, finder = personal.Finder(), personal.Finder(model=model)
    found = lambda f, rows: sum(name in {t[a:b] for a, b, k in f.find(t) if k == "NAME"} for t, name in rows)
    assert found(plain, hidden[60:]) < 20 and found(finder, hidden[60:]) >= 0.9 * 140
    assert found(finder, known) >= found(plain, known)
    wrong = [t[a:b] for t, name in known + hidden for a, b, k in finder.find(t) if k == "NAME" and t[a:b] != name]
    assert len(wrong) <= 0.01 * 1100, wrong[:10]


def test_a_model_of_nothing_finds_nothing(spark):
    for texts in ([], ["no names here"], ["Ask for Thandiwe Nkosi today."]):
        model = personal.names.fit(texts, personal.Finder().find, set())
        assert model.names("Ask for Thandiwe Nkosi today.", []) == [] and model.given == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HOSTILE)], "email_id long, text string")
    assert personal.name_model(df).given == [] and personal.name_model(df.limit(0)).given == []


def test_all_texts_teach_names(spark):
    """The model of a corpus is what all its texts make together, however few of many tell; each text is searched once."""
    rng = random.Random(6)
    told = _letters(rng, 300, personal.FEMALE + personal.MALE) + _letters(rng, 40, UNKNOWN)
    texts = [t for t, _ in told] + ["We wrote in May.", None, "", "ASK FOR THANDIWE BRESKATOL\n\nDear Siobhan,\n", "Ask\u00a0for  Takeshi Skatolvik today.  "] + ["the bills of this month are due"] * 13_000
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "email_id long, text string").repartition(7).cache()
    want = personal.names.fit([t for t in texts if t], personal.Finder().find, personal.names.vocabulary())
    found = personal.found(df)
    model = personal.name_model(found)
    assert want.given and model.given == want.given and model.least == want.least and (model.weights == want.weights).all()
    assert sorted(personal.items(found, model=model).collect()) == sorted(personal.items(df, model=want).collect())
    assert sorted(personal.pseudonymised(found, "k", model=model).collect()) == sorted(personal.pseudonymised(df, "k", model=want).collect())


def test_residue_pairs_share_a_partition_at_every_size(spark):
    """Partition keys follow from a paragraph alone, and two paragraphs at the threshold always share one."""
    rng = np.random.default_rng(4)
    for n in (1, 4, 5, 9, 10, 40, 333):
        for _ in range(200):
            shared = int(np.ceil(0.8 * n))  # the smaller set is part of the larger one: the worst case
            x = rng.choice(1 << 32, n, replace=False).astype(np.uint32)
            y = np.sort(rng.choice(x, shared, replace=False))
            x = np.sort(x)
            size = np.array([len(x), len(y)])
            a, b = residue._prefixes(np.concatenate([x, y]), size, size, np.arange(2), 0.8).to_pylist()
            assert set(a) & set(b) and len(a) == n - shared + 1
    assert not hasattr(residue, "_tables")  # no shape that follows from the number of rows
