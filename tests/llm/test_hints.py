"""Hints, shadows and remembered words of problem 3: less is searched, and nothing else is found."""

import random

import pyarrow as pa
import pytest

from lexiloom import lexicons
from lexiloom.llm import hints, names, personal

ITEMS = [
    "Anna Skatolvik", "ANNA", "Herr K. Östvik", "(Ms Smith", "Dr\nSmith", "Señora Ruiz", "SEÑORA RUIZ", "A.B. Smith", "J. van der Berg", "Berg, A. und", "\n\nHi Otto,\n", "\nliebe Anna\n", "Sehr geehrte Frau Otto,\n", "Chère Anna,\n", "Buenos días Otto,\n",
    "Name: Otto Berg", "NOM = Otto", "kontoinhaberin : Berg, Otto", "user at mail dot example", "u [at] mail.example", "u@mail.example", "12 Canning Street", "7b Old Mill St.", "٣ Old Road", "3/12 High Rd, Flat 2", "12, rue de la Paix", "12bis Impaſſe Verte", "5 allée Verte",
    "Musterstraße 5", "Lindenweg 3", "CALLE Mayor 7", "Avda. de la Luz n.º 5", "c/ Sol 4", "+49 30 123456", "0049 30 1234 567", "(030) 123-4567", "(0301) 1234567", "301-555-0146", "01 23 45 67 89", "030 1234 5678", "01234 567890", "01234567890", "123-45-6789", "123 45 6789", "DE12 1234 1234 1234 1234",
    "P<DE1234567", "X12345678", "12345678-Z", "QQ 12 34 56 C", "QQ123456C", "1 85 05 78 006 084 36", "185057800608436", "number 123456789", "nummer: 123456789", "not ID: 123456789",
]
BITS = [" ", "  ", "\n", "\r\n", "\t", " ", "　", "\x0b", "\x1c", "\x85", " ", "­", "​", "\x7f", "\x00", "_", "'", "’", "-", "(", ")", ".", ",", "“", "–", "İ", "ı", "ſ", "K", "ß", "ẞ", "é", "Ü", "А", "Μ", "x", "Z", "8"]


def _odd(n: int) -> list[str]:
    """Items among words, with characters put in, changed or dropped, and cases changed."""
    rng, out = random.Random(11), [*ITEMS]
    for _ in range(n):
        t = " ".join(x for _ in range(rng.randrange(1, 4)) for x in ("we wrote of", rng.choice(ITEMS), rng.choice(("", "and the Bank", "in May"))))
        for _ in range(rng.choice((0, 1, 2, 6))):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(BITS) + t[i + rng.randrange(2) :]
        out.append(rng.choice((t, t, t, t, t.upper(), t.lower())))
    return out


def _shadow(text: str) -> tuple[str, list[int]]:
    """Character by character: invisible ones go, blanks are one, and none stands at the end or the beginning of a line."""
    at, kept = [], []
    for i, c in enumerate(text):
        if c in lexicons.INVISIBLE or c in personal._BLANKS and kept and kept[-1] in " \n":
            continue
        if c == "\n" and kept and kept[-1] == " ":
            kept.pop(), at.pop()
        at.append(i)
        kept.append(" " if c in personal._BLANKS else c)
    return "".join(kept), at


def test_hints_lose_no_item():
    finder, texts = personal.Finder(), _odd(4000)
    shadows = list(finder.shadows(pa.array(texts)))
    assert shadows == [finder.shadow(t) for t in texts]
    folded = [t for t, _ in shadows]
    own = [finder._find(t, None) for t in folded]
    for t, may, want in zip(folded, hints.may(pa.array(folded)), own):
        assert finder._find(t, None, may) == want, (t, may)
    assert {kind for items in own for _, _, kind in items} == {"EMAIL", "ID", "PHONE", "ADDRESS", "NAME"} and sum(map(bool, own)) > 2000


def test_shadows():
    finder = personal.Finder()
    for text in _odd(2000):
        t, at = finder.shadow(text)
        want, places = _shadow(text)
        if at is None:
            assert len(t) == len(text)
        else:
            assert (t, at) == (want.translate(personal._FOLD), places)


def test_a_text_without_hints_is_not_searched(monkeypatch):
    """Numbers, words in capitals and labels alone cost no search for addresses, figures, titles and holders."""

    def never(*_):
        raise AssertionError("searched")

    class Never:
        finditer = match = search = never

    for search in ("_ENGLISH", "_FRENCH", "_GERMAN", "_SPANISH", "_FIGURES", "_INITIALS", "_TITLE", "_SALUTE", "_HOLDER", "_NUMBER"):
        monkeypatch.setattr(personal, search, Never)
    batch = pa.record_batch({"id": [1, 2], "text": ["On 2024-05-28 we found 42 crates of the user names, ms 3 and 1,278.57 euros at Castellane Stores.\n\nThe drop-in desk", None]})
    assert [own for _, own in personal._Rest(None, None).of(batch)] == [[], []]


@pytest.mark.parametrize("known", [set(), {"anna", "old", "mill"}])
def test_pieces_are_what_the_patterns_say(known):
    pieces, words = names._Pieces(known), {p for t in _odd(3000) for p in t.split()}
    for p in words | {"INV-64975", "£1912", "“current”", "www.a-b.example/f/h7d!", "ab.cd", "McDonald's", "e2qq37.", "X", "x", "ĸ", "The", "AND"}:
        said = pieces[p] or (0, (), (), ())
        small = tuple(w for w in names._SMALL.findall(p) if w not in known)
        large = tuple(w for w in names._WORD.findall(p) if w[0].isupper() and w.lower() not in known)
        assert said == (len(names._CASED.findall(p)), small, large, names._TOLD.get(p.lower(), ())), p


def test_more_ordinary_words_change_what_is_remembered():
    model, run = names.NameModel({"old"}), "Old Anna B. Skatolvik"
    assert model._within("To " + run, 3, 3 + len(run)) == [(7, 24)] and model.spans(run) == [(0, 21)] and not model.common("Skatolvik")
    model.more({"skatolvik", "anna"})
    assert model._within(run, 0, len(run)) == [] and model.spans(run) == [] and model.common("Skatolvik")


def test_items_of_sliced_rows():
    batch = pa.record_batch({"starts": [[1], [], [2, 5], None], "ends": [[2], [], [3, 6], None], "kinds": [["ID"], [], ["NAME", "ID"], None]})
    assert list(names.spans(batch)) == [[(1, 2, "ID")], [], [(2, 3, "NAME"), (5, 6, "ID")], []]
    assert list(names.spans(batch.slice(1, 2))) == [[], [(2, 3, "NAME"), (5, 6, "ID")]]
