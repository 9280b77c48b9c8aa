"""Problem 3: personal items inside free text, found with their kind and replaced by typed surrogates.

Items are sought in a shadow of the text without invisible characters, with look-alike letters folded and all blanks
alike, so that obfuscation hides nothing; values are cut from the original at the same places. Names are found by given
names (built-in, from display names of senders, and learned), by initials, titles, salutations and field labels, and by a
model of their context that is fitted on all texts of the corpus (names.py).

Surrogates are keyed permutations (surrogates.py): an item gets the same replacement wherever it stands (coreference), and
two different items of a kind never share one. Given names are replaced by names of the same gender, words by words of the
same script and case, digits by digits; separators, country codes and street types stay.

Defined results: null and empty texts hold no items and stay as they are. A value that occurs twice in a text is one row
of items() and replaced at both places. Overlaps go to the item that begins first, then to the longer one. Repeated rows
give equal rows. Extra columns are ignored. Whole texts are searched, of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.llm import encoding, hints, names, surrogates
from lexiloom.llm.hints import ANY, May
from lexiloom.llm.names import NameModel, Words, learned
from lexiloom.llm.surrogates import Surrogates
from lexiloom.runtime import cut, spread

# Given names in use across Europe, by gender.
FEMALE = (
    "Adela Alice Amira Ana Anaïs Anna April Beatriz Bianca Carmen Céline Celeste Chloé Clara Claire Daphne Dawn Edith Elena Emma Esther Fatima Fiona Frida Grace Greta Hanna Helga Ingrid Irene Isabel Jasmine Julia "
    "Katja Keiko Laura Leila Livia Lucía Łucja Maria Mária Marie Marta Mirela Nadia Nina Noor Olga Paloma Petra Priya Renée Rosa Sabine Sara Selma Sofia Stella Talia Ursula Vera Viola Wanda Wilma Xenia Yara Zoë Zora"
).split()
# Fixed values, likewise.
MALE = (
    "Aaron Ahmed Alexander Amaro Andrés Anton Björn Boris Bruno Carlos Cyril Daniel Dario David Dmitri Emil Felix François Gideon Gustav Hans Hector Hugo Íñigo Ismael Ivo Javier Jean John Jonas José Jürgen Karl Kasper Lorenz "
    "Louis Luis Lukas Magnus Mark Michael Miguel Noël Olaf Oskar Otto Øystein Pablo Paul Pavel Pedro Peter Pierre Quentin Ralf Ravi Rob Robert Ruben Søren Stefan Theo Thomas Timo Tomas Ulrich Umar Viktor Walter Will Yannis Yusuf Zoltan"
).split()
# Given names that are ordinary words in lower case or as capitals.
_WORDLIKE = set("will mark rob april dawn grace viola rosa stella may june august sofia paul ana jean rose art bill".split())
_PARTICLE = r"(?:(?:van|von|de|del|der|den|di|da|la|le|ter|ten|bin|al|dos|du|zu|zur)\s)"
_INK = r"[^\s\x00-\x26\x28-\x2c./:;<=>?@\[-\x60{-~“”„«»–—…]"
_SUR = rf"(?=[^\p{{Ll}}\d'-]){_INK}{{2,}}"
_ANY = rf"(?=[^\d'-]){_INK}{{2,}}"
# Words that end or replace what looks like a family name.
_STOP = set(
    "street st road rd avenue ave lane ln close terrace drive way court place square crescent building depot house hall tower centre center branch office desk team group counter section registry archive helpdesk "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday the this that these those we you our your it he she they and or but for from with in on at to of by as if no not is was are be will would can please since before after until when while although because due owing despite unless following given starting once now under somewhat thanks according just as part without "
    "someone dear hi hello kind best regards yours sincerely cheers via der die das und oder les des una los las el la para pour für zu est ist both figures account customer client member".split()
)
_AFTER = regex.compile(rf"(?:\s\p{{L}}\.)?(?:\s\p{{L}}\.)?\s{_PARTICLE}{{0,2}}({_SUR})")
_AFTER_ANY = regex.compile(rf"(?:\s\p{{L}}\.)?\s{_PARTICLE}{{0,2}}({_ANY})")
_BEFORE = regex.compile(rf"(?:(?<=\s|^){_PARTICLE}{{1,2}})?({_SUR}), $")
_BEFORE_ANY = regex.compile(rf"(?:(?<=\s|^){_PARTICLE}{{1,2}})?({_ANY}), $")
_INITIALS = regex.compile(rf"(?<![\w.'’-])(?<!\d\s)(\p{{Lu}}\.(?:\s?\p{{Lu}}\.)?\s{_PARTICLE}{{0,2}}({_SUR}))")
_REVERSED = regex.compile(rf"(?<![\w.'’-])((?:{_PARTICLE}{{1,2}})?({_SUR}), \p{{Lu}}\.)(?=\s+[^\W\d_]|\s*$|[,;)])")
_TITLE = regex.compile(rf"(?<![\w])(?i:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Herrn|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Don|Doña)\.?\s((?:\p{{Lu}}\.\s)?{_PARTICLE}{{0,2}}({_SUR}))")
_SALUTE = regex.compile(
    rf"(?im)(?:^|\n)\s*(?:good (?:morning|afternoon|evening|day)|hi|hello|hey|dear|attention|guten (?:tag|morgen|abend)|hallo|liebe[rs]?|sehr geehrte[rs]?(?: (?:herr|frau))?|moin|bonjour|bonsoir|salut|ch{_INK}{{1,6}}re?|hola|buenos d{_INK}{{1,4}}as|estimad[oa]|querid[oa])(?:\s(?:mr|mrs|ms|dr|prof)\.?)?\s((?:\p{{L}}\.\s)?{_PARTICLE}{{0,2}}{_ANY}(?:\s\p{{L}}\.)?(?:\s{_PARTICLE}{{0,2}}{_ANY})?)\s?[,:!]?[^\S\n]*(?=\n|$)"
)
_HOLDER = regex.compile(rf"(?i)(?<!\p{{L}})(?:account holder|kontoinhaber\w*|titulaire|titular|name|nom|nombre)\s?[:=]\s?((?:{_INK}+\.?,?[^\S\n]){{0,4}}{_INK}+\.?)")

_AT = re.compile(r"@|\s?[\[({]\s?(?:at|AT|At)\s?[\])}]\s?|\s(?:at|AT)\s(?=[\w-]+(?:\s(?:dot|DOT)\s[\w-]+)+)")
_OUTSIDE = frozenset(" \t\r\n\x0b\x0c\u00a0\u2009\u202f\u2028\u2029\u3000<>()[]{},;:\"“”|/")  # what no local part holds
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
_HOST = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}")
_PHONE = re.compile(
    r"(?<![\w+<#/.\-])(?<!\d\s)(?:"
    r"\+\d{1,3}(?:[\s.\-]?\(0\))?(?:[\s.\-]?\d{1,4}){2,5}"
    r"|\+\d{9,14}"
    r"|00\s?\d{2}(?:[\s.\-]?\d{2,4}){2,4}"
    r"|\(\d{3}\)\s?\d{3}[\s.\-]\d{4}|\(0\d{2,4}\)\s?\d{3,4}[\s.\-]?\d{3,4}"
    r"|[2-9]\d{2}([.\-])\d{3}\1\d{4}"
    r"|0[1-9](?:[\s.]\d{2}){4}"
    r"|0\d{2,3}\s\d{3,4}\s\d{3,4}|0\d{4}\s\d{6}|0\d{10}"
    r")(?![\w])(?![\-.]\d)(?!\s\d)"
)
_ID = re.compile(
    r"(?<![\w<\-/.])(?<!\d\s)(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3}\s\d{2}\s\d{4}"
    r"|[A-Za-z]{2}\d{2}(?:\s\d{4}){3,6}|[A-Za-z]<[A-Za-z]{2}\d{7}|[A-Za-z]\d{8}|\d{8}-?[A-Za-z]"
    r"|[A-Za-z]{2}\s\d{2}\s\d{2}\s\d{2}\s[A-Za-z]|[A-Za-z]{2}\d{6}[A-Za-z]|\d\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}\s\d{2}|[12789]\d{14}"
    r")(?![\w])(?!-\d)"
)
#: What a bare number of nine digits follows if it identifies a person.
_NUMBERED = re.compile(r"(?i)(?:number|confirm|nummer|documento|\bnot\S{1,4})\s?[:=]?\s?\Z")
_STREET = r"(?:Street|Road|Avenue|Lane|Close|Terrace|Drive|Way|Court|Place|Square|Crescent|Boulevard|Gardens|Grove|Row|Hill|Mews|Park|STREET|ROAD|AVENUE|LANE|CLOSE|TERRACE|DRIVE|WAY|COURT|PLACE|street|road|avenue|lane|close|terrace|drive|way|court|place|(?i:St|Rd|Ave|Ln|Dr|Blvd|Cres|Sq)\b\.?)"
_UNIT = r"(?i:Flat|Unit|Apt|Apartment|Suite|Room|Floor)\.?\s\d{1,4}[A-Za-z]?"
_NUMBER = re.compile(r"\d(?:(?<![\w/.,\-]\d)\d{0,3}[a-zA-Z]?(?!\w)(?![.,]\d)|(?<=/\d)\d{0,3}[a-zA-Z]?(?![\w/]))")  # begins with what is rare
_UNIT_BEFORE = re.compile(rf"(?<![\w]){_UNIT}(?:,\s|/|\s)\Z")
_UNIT_NUMBER = re.compile(r"(?i)\b(?:flat|unit|apt|apartment|suite|room|floor)\.?\s\Z")
_ENGLISH = re.compile(rf"(?:\s{_INK}+){{1,3}}?\s{_STREET}(?![\w-])(?:,\s{_UNIT}(?!\w))?")
_FRENCH = regex.compile(rf"(?:\s?(?:bis|ter))?,?\s(?i:rue|avenue|boulevard|place|chemin|impasse|all{_INK}{{1,4}}e|quai|cours|route)\s(?:(?i:de la|de l['’]|du|des|de|d['’])\s?)?{_INK}+(?:\s(?=\p{{Lu}}){_INK}+)?")
_GERMAN = re.compile(rf"(?<![\w-])(?!\d){_INK}{{2,}}?(?i:stra(?:ß|ss|{_INK}{{1,4}})e|str\.|weg|gasse|platz|allee|damm|ufer|ring)\s\Z")
_GERMAN_ENDS = ("e", "str.", "weg", "gasse", "platz", "damm", "ufer", "ring")
_SPANISH = re.compile(rf"(?<![\w-])(?i:calle|avenida|avda\.|plaza|paseo|camino|ronda|c/)\s(?:(?i:de la|de los|de las|del|de)\s)?(?:{_INK}+\s){{1,3}}?(?:n\.º\s)?\Z")


def _variants(name: str) -> set[str]:
    """A name with the damage of wrong encodings."""
    out = {name, "".join(c if c < "\x80" else "�" for c in name)}
    raw = name.encode("utf-8")
    if len(raw) > len(name):
        for page in encoding.PAGES:
            table = {b: c for c, b in encoding._BYTE[page].items()}
            wrong = "".join(chr(b) if b < 128 else table.get(b, "�") for b in raw)
            out |= {wrong, "".join("�" if b > 127 else chr(b) for b in raw)}
            twice = wrong.encode("utf-8")
            if page in ("cp1252", "latin-1"):
                out.add("".join(chr(b) if b < 128 else table.get(b, "�") for b in twice))
        for page in encoding.SINGLE:
            out.add(name.encode("cp1252", "replace").decode(page, "replace"))
    return out


def _words_back(t: str, at: int, n: int) -> int:
    """Where the n-th word before a place begins."""
    for _ in range(n):
        while at and t[at - 1].isspace():
            at -= 1
        while at and not t[at - 1].isspace():
            at -= 1
    return at


class Finder:
    """Finds personal items; `given` adds given names to the built-in ones, `model` finds names by their context."""

    def __init__(self, given: list[str] | None = None, model: NameModel | None = None):
        self.model = model
        names = {*FEMALE, *MALE, *(given or []), *(model.given if model else [])}
        self.given = {v for n in names for v in _variants(n)}
        self.low = {v.lower(): v for v in self.given}
        self.exact, self.loose = (ahocorasick.Automaton() for _ in range(2))
        for v in self.given:
            self.exact.add_word(v, len(v))
            self.loose.add_word(v.lower(), len(v.lower()))
        self.exact.make_automaton()
        self.loose.make_automaton()

    def shadow(self, text: str) -> tuple[str, list[int] | None]:
        """The text to search, and the place of each of its characters in the original if any was dropped."""
        at = None
        if _UNEVEN.search(text):
            at, kept, last = [], [], 0
            for m in _GAP.finditer(text):
                at += range(last, m.start())
                kept.append(text[last : m.start()])
                last, own = m.end(), []
                for i, c in enumerate(m.group(), m.start()):
                    if c in lexicons.INVISIBLE:
                        continue
                    if c in _BLANKS:
                        if own and own[-1] in " \n":
                            continue
                        c = " "
                    elif own and own[-1] == " ":
                        own.pop()
                        at.pop()
                    at.append(i)
                    own.append(c)
                kept += own
            at += range(last, len(text))
            text = "".join(kept) + text[last:]
            text = _BLANK.sub(" ", text)
        return _FOLDED.sub(lambda m: m.group().translate(_FOLD), text), at

    def shadows(self, texts: pa.Array) -> Iterator[tuple[str | None, list[int] | None]]:
        """The shadow of each text; one that is even and holds nothing to fold is its own."""
        for text, other in zip(texts.to_pylist(), hints.told(texts, _OTHER)):
            yield self.shadow(text) if other else (text, None)

    def _emails(self, t: str, spelled: bool = True) -> Iterator[tuple[int, int, str]]:
        low = t.lower() if spelled else ""
        for m in _AT.finditer(t) if any(x in low for x in _SPELLED) else _SIGN.finditer(t):
            a, host = m.start(), _HOST.match(t, m.end())
            while host and a and t[a - 1] not in _OUTSIDE:
                a -= 1
            if host and a < m.start():
                yield a, host.end(), "EMAIL"

    def _addresses(self, t: str, may: May = ANY) -> Iterator[tuple[int, int, str]]:
        for m in _NUMBER.finditer(t):
            a, b = m.span()
            far = _ENGLISH.match(t, b) if may.english else None
            if far:
                unit = _UNIT_BEFORE.search(t, max(0, a - 20), a)
                if unit or not _UNIT_NUMBER.search(t, max(0, a - 12), a) and t[a - 1 : a] != "/":
                    yield unit.start() if unit else a, far.end(), "ADDRESS"
                continue
            far = _FRENCH.match(t, b) if may.french else None
            if far:
                yield a, far.end(), "ADDRESS"
                continue
            if a and t[a - 1].isspace():
                near = _GERMAN.search(t, _words_back(t, a, 2), a) if may.german and t[max(0, a - 8) : a - 1].lower().endswith(_GERMAN_ENDS) else None
                near = near or (_SPANISH.search(t, _words_back(t, a, 8), a) if may.spanish else None)
                if near:
                    yield near.start(), b, "ADDRESS"

    def _names(self, t: str, may: May = ANY) -> Iterator[tuple[int, int]]:
        caseless = not _LOWER.search(t) or not _UPPER.search(t)
        after, before = (_AFTER_ANY, _BEFORE_ANY) if caseless else (_AFTER, _BEFORE)
        spans: dict[int, int] = {}
        for last, size in (self.loose.iter(t.lower()) if caseless else self.exact.iter(t)):
            a, b = last + 1 - size, last + 1
            if not _INKED.match(t[a - 1 : a]) and (t[b : b + 1] in "-'’" or not _INKED.match(t[b : b + 1])):
                spans[a] = max(b, spans.get(a, 0))
        for a, b in spans.items():
            if caseless and t[a:b].lower() in _WORDLIKE:
                continue  # only salutations and fixed phrases tell these from ordinary words
            f = after.match(t, b)
            p = before.search(t, _words_back(t, a, 4), a) if t[a - 2 : a] == ", " else None
            turned = p and p.end() == a and p.group(1).lower() not in _STOP and not _FIGURE.match(t, b)
            if turned and f and "\n" in t[b : f.start(1)]:  # `family, given` at the end of a line
                f = None
            if f and f.group(1).rstrip("'’").lower() not in _STOP and _LETTERED.search(f.group(1)):
                yield a, f.start(1) + len(f.group(1).rstrip("'’-"))
                continue
            if turned:
                yield p.start(), b
                continue
            if _ALONE_AFTER.match(t, b) and _ALONE_BEFORE.search(t, max(0, a - 3), a):
                yield a, b
        initials = _REVERSED.finditer(t) if _TURNED.search(t) else ()
        low = t.lower() if may.titled else ""
        titled = _TITLE.finditer(t) if any(x in low for x in _TITLED) else ()
        for m in (*(_INITIALS.finditer(t) if may.initials else ()), *initials, *titled):
            if m.group(2).rstrip("'’").lower() not in _STOP:
                yield m.start(1), m.end(1) if not m.group(1).endswith(("'", "’", "-")) else m.end(1) - 1
        for m in filter(None, (_SALUTE.match(t, at) for at in self._hails(t))) if may.hail else ():
            if self._named(m.group(1), caseless):
                yield m.start(1), m.end(1)
        low = t.lower() if may.holder else ""
        for m in _HOLDER.finditer(t) if any(x in low for x in _HOLDERS) else ():
            if self._named(m.group(1), caseless):
                end = m.end(1)
                if m.group(1).endswith(".") and not _INITIAL_LAST.search(m.group(1)):
                    end -= 1
                yield m.start(1), end

    def _hails(self, t: str) -> Iterator[int]:
        """Where a line begins as salutations do."""
        at = 0
        while at >= 0:
            h = _HAIL.match(t, at)
            if h:
                yield at
            at = t.find("\n", h.end() if h else at + 1)

    def _named(self, said: str, caseless: bool) -> bool:
        parts = [x.strip(",.") for x in said.split()]
        known = any(x in self.given or caseless and x.lower() in self.low for x in parts)
        short = len(parts) <= 3 and any(len(x) == 1 for x in parts) and not any(x.lower() in _STOP for x in parts)
        return (known or short) and not (len(parts) == 1 and len(parts[0]) < 2) and not parts[-1].lower() in ("account", "customer", "client", "member", "owner", "colleague")

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all items in order, without overlaps."""
        if not text:
            return []
        return self._find(*self.shadow(text))

    def _find(self, t: str, at: list[int] | None, may: May = ANY) -> list[tuple[int, int, str]]:
        found = list(self._emails(t, may.spelled))
        if _DIGITS.search(t):
            for run in _FIGURES.finditer(t) if may.figures else ():
                if run.end() - run.start() >= 6 and len(_DIGITS.findall(run.group())) >= 6:
                    a, b = max(0, run.start() - 6), run.end() + 4
                    found += [(m.start(), m.end(), "ID") for m in _ID.finditer(t, a, b)]
                    if run.end() - run.start() == 9 and _NUMBERED.search(t, max(0, run.start() - 30), run.start()) and not t[run.end() : run.end() + 1].isalnum():
                        found.append((run.start(), run.end(), "ID"))
                    found += [(m.start(), m.end(), "PHONE") for m in _PHONE.finditer(t, a, b) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
            if may.english or may.french or may.german or may.spanish:
                found += self._addresses(t, may)
        found += [(a, b, "NAME") for a, b in self._names(t, may)]
        rank = {"EMAIL": 0, "ID": 1, "PHONE": 2, "ADDRESS": 3, "NAME": 4}
        out, last = [], -1
        for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1], rank[x[2]])):
            if a >= last and b > a:
                out.append((a, b, kind))
                last = b
        if self.model:
            added = self.model.names(t, [(a, b) for a, b, _ in out])
            out = sorted(out + [(a, b, "NAME") for a, b in added]) if added else out
        return out if at is None else [(at[a], at[b - 1] + 1, kind) for a, b, kind in out]


_BLANKS = " \t\r\x0b\x0c\u00a0\u2009\u202f"
_UNEVEN = re.compile(f"[{lexicons.INVISIBLE}{_BLANKS}\n](?:(?<=[{lexicons.INVISIBLE}])|(?<=[{_BLANKS}])[{_BLANKS}\n]|(?<=\n)[{_BLANKS}])")
_GAP = re.compile(f"[{lexicons.INVISIBLE}{_BLANKS}\n]{{2,}}|[{lexicons.INVISIBLE}]")
_BLANK = re.compile(f"[{_BLANKS[1:]}]")
_FOLD = str.maketrans(lexicons.LOOKALIKE_FROM + "   \t\r", lexicons.LOOKALIKE_TO + "     ")
_FOLDED = re.compile("[\\u00a0\\u2009\\u202f\t\r" + lexicons.LOOKALIKE_FROM + "]")
#: What _UNEVEN and _FOLDED find, for whole arrays.
_OTHER = f"[{lexicons.INVISIBLE}\u00a0\u2009\u202f\t\r{lexicons.LOOKALIKE_FROM}]|[{_BLANKS}][{_BLANKS}\n]|\n[{_BLANKS}]"
_LETTERED = re.compile(r"[A-Za-z].*[A-Za-z]|[^\W\d_]{3}")
_INKED = re.compile(_INK)
_TURNED = re.compile(r", [^\W\d_a-z]\.")
_HAIL = re.compile(r"(?:^|\n)\s?(?:[Gg][OoUu]|[Hh][IiEeAaOo]|[DdAa][EeTt]|[Ll][Ii]|[Ss][EeAa]|[Mm][Oo]|[Bb][OoUu]|[Cc][Hh]|[Ee][Ss]|[Qq][Uu])")
# What a text holds, in small letters, that has addresses with the sign spelled out, titles, and labels of names.
_SIGN = re.compile("@")
_SPELLED = ("(at", "[at", "{at", "( at", "[ at", "{ at", " dot ")
_TITLED = ("mr", " ms ", " ms.", "\nms", "miss", "dr ", "dr.", "prof", "herr", "frau", "monsieur", "madame", "mme", "mlle", "señor", "sr ", "sr.", "sra", "don ", "doña")
_HOLDERS = ("holder", "inhaber", "titula", "name", "nom")
_LOWER, _UPPER = re.compile("[a-z]{2}"), re.compile("[A-Z]")
_INITIAL_LAST = regex.compile(r"(?:^|\s)\p{L}\.$")
_DIGITS = re.compile(r"\d")
_FIGURES = re.compile(r"\d[\d\s.()\-]*\d")
_FIGURE = re.compile(r"\s\d")
_ALONE_AFTER = regex.compile(r"(?:,[^\S\n]*(?:\n|$|please see)|[^\S\n]*(?:\n|$))")
_ALONE_BEFORE = re.compile(r"(?:^|\n)\s?$|\A$")


#: Words of addresses that stay.
_KEPT = regex.compile(rf"(?i){_STREET}|flat|unit|apt|apartment|suite|room|floor|rue|avenue|boulevard|place|chemin|impasse|quai|calle|avenida|plaza|paseo|camino|ronda|de|la|du|des|del|los|las|st|rd|ave|bis|ter|c|[a-z]")


def replaced(text: str, found: list[tuple[int, int, str]], made: Surrogates) -> str:
    """The text with every item replaced by [KIND surrogate]."""
    parts, last = [], 0
    for a, b, kind in found:
        parts += [text[last:a], f"[{kind} {made.one(kind, text[a:b], _KEPT)}]"]
        last = b
    return "".join(parts) + text[last:]


# -- operators -------------------------------------------------------------------------------------------------------


def given_names(senders: DataFrame, sender_col: str = "sender") -> list[str]:
    """All distinct first words of display names, those of a single row included."""
    first = F.initcap(F.regexp_extract(F.col(sender_col), r'^\s*"?([^\s"<@,]+)\s[^<]*<', 1))
    rows = senders.select(first.alias("name")).where(F.length("name") >= 2).distinct()
    return sorted(r["name"] for r in rows.collect())  # grows with the distinct given names, not with the rows


FOUND = "id long, text string, starts array<int>, ends array<int>, kinds array<string>, open boolean, a int, b int, language string, word string, small long, large long, inside boolean"
_PIECE = re.compile(r"\S+")
_WORDS = 200_000  # words that a task counts before it passes them on


def found(df: DataFrame, given: list[str] | None = None, id_col: str = "email_id", text_col: str = "text", ordinary: set[str] | None = None) -> DataFrame:
    """Every text with the items that need no model and whether a model may add some; runs of uncommon words (with a
    language, NameModel.runs) and counts of words (with a word) as rows of their own.

    items, pseudonymised and name_model take this table in place of the texts, so that these are searched once.
    """
    plain = NameModel(names.vocabulary() if ordinary is None else ordinary)
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kinds", pa.list_(pa.string())), ("open", pa.bool_()), ("a", pa.int32()), ("b", pa.int32()), ("language", pa.string()), ("word", pa.string()), ("small", pa.int64()), ("large", pa.int64()), ("inside", pa.bool_())])

    def filled(made: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)

    def told(rows: list[tuple], columns: tuple[str, ...]) -> pa.RecordBatch:
        return filled(dict(zip(columns, zip(*rows))) if rows else {}, len(rows))

    def parted(own: list[list[tuple]]) -> dict[str, list]:
        return {c: [[x[i] for x in row] for row in own] for i, c in enumerate(("starts", "ends", "kinds"))}

    def may_add(t: str, items: list[tuple[int, int, str]], met: list[tuple[int, int]]) -> bool:
        """Whether a run holds two words in capitals outside the items."""
        outside = lambda at: not any(x <= at < y for x, y, _ in items)
        return any(sum(w.group()[0].isupper() and outside(w.start()) for w in _PIECE.finditer(t, a, b)) > 1 for a, b in met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, words = Finder(given), Words(plain)
        for batch in batches:
            own, may, runs = [], [], []
            texts = batch.column("text").to_pylist()
            shadows = list(finder.shadows(batch.column("text")))
            for text, (t, at), hint in zip(texts, shadows, hints.may(pa.array([t for t, _ in shadows], pa.string()))):
                if not text:
                    own.append([])
                    may.append(False)
                    continue
                words.add(text)
                own.append(finder._find(t, at, hint))
                met = plain.spans(text)
                runs += plain.runs(text, own[-1], met, words.language() if met else "")
                other = met if t == text else plain.spans(t)
                for said in {text[a:b] for a, b in met} | {t[a:b] for a, b in other}:
                    words.meet(said)
                may.append(bool(other) and (at is not None or may_add(t, own[-1], other)))
            yield filled({"id": batch.column("id"), "text": batch.column("text"), "open": may} | parted(own), len(texts))
            if runs:
                near, a, b, items, language = zip(*runs)
                yield filled({"text": near, "a": a, "b": b, "language": language} | parted(list(items)), len(runs))
            if len(words.small) + len(words.large) > _WORDS:
                yield told(list(words.taken()), ("word", "small", "large", "inside"))
        yield told(list(words.taken()), ("word", "small", "large", "inside"))

    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return cut(rows.mapInArrow(run, FOUND), "found")


def name_model(df: DataFrame, given: list[str] | None = None, id_col: str = "email_id", text_col: str = "text") -> NameModel:
    """What the corpus itself tells about names, learned from all its texts; df holds texts or is what found() made of them."""
    return learned(df if "starts" in df.columns else found(df, given, id_col, text_col), names.vocabulary())


class _Rest:
    """Items of texts, or what the model adds to those of found()."""

    def __init__(self, given: list[str] | None, model: NameModel | None):
        self.finder = Finder(given, model)
        self.new = new = self.finder.given - Finder(given).given
        self.exact, self.loose = (ahocorasick.Automaton() for _ in range(2))
        for v in new:
            self.exact.add_word(v, len(v))
            self.loose.add_word(v.lower(), len(v.lower()))
        self.exact.make_automaton()
        self.loose.make_automaton()

    def _changed(self, t: str) -> bool:
        """Whether a word may begin with a given name that the model adds."""
        caseless = not _LOWER.search(t) or not _UPPER.search(t)
        return any(last < size or not _INKED.match(t[last - size : last + 1 - size]) for last, size in (self.loose.iter(t.lower()) if caseless else self.exact.iter(t)))

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[tuple[int, int, str]]]]:
        """(text, items) of each row."""
        texts = batch.column("text").to_pylist()
        shadows = list(self.finder.shadows(batch.column("text")))
        folded = pa.array([t for t, _ in shadows], pa.string())
        if "starts" not in batch.schema.names:
            yield from ((text, self.finder._find(t, at, hint) if text else []) for text, (t, at), hint in zip(texts, shadows, hints.may(folded)))
            return
        may_add = batch.column("open").to_pylist()
        again = [i for i, ((t, at), begun) in enumerate(zip(shadows, hints.may_begin(folded, self.new))) if t and (begun and self._changed(t) or may_add[i] and at is not None)]
        hint = dict(zip(again, hints.may(folded.take(pa.array(again, pa.int32())))))
        for i, (text, own, (t, at)) in enumerate(zip(texts, names.spans(batch), shadows)):
            if i in hint:
                own = self.finder._find(t, at, hint[i])
            elif may_add[i] and text and self.finder.model:
                own = sorted(own + [(a, b, "NAME") for a, b in self.finder.model.names(t, [(a, b) for a, b, _ in own])])
            yield text, own


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    if "starts" in df.columns:
        return df.where("word is null and language is null").select("id", "text", "starts", "ends", "kinds", "open")
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))


def items(df: DataFrame, id_col: str = "email_id", text_col: str = "text", given: list[str] | None = None, model: NameModel | None = None) -> DataFrame:
    """(id, kind, value): one row per distinct item of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = _Rest(given, model)
        for batch in batches:
            ids, kinds, values = [], [], []
            for i, (text, own) in zip(batch.column("id").to_pylist(), rest.of(batch)):
                for kind, value in dict.fromkeys((kind, text[a:b]) for a, b, kind in own):
                    ids.append(i)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["id", "kind", "value"])

    made = _rows(df, id_col, text_col).where("text is not null").mapInArrow(run, "id long, kind string, value string")
    return made.select(F.col("id").alias(id_col), "kind", "value")


def pseudonymised(df: DataFrame, key: str, id_col: str = "email_id", text_col: str = "text", given: list[str] | None = None, model: NameModel | None = None) -> DataFrame:
    """(id, text, items): every text with its items replaced, and how many places were replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, made = _Rest(given, model), Surrogates(key.encode(), FEMALE, MALE)
        for batch in batches:
            texts, counts = [], []
            for text, own in rest.of(batch):
                texts.append(replaced(text, own, made) if own else text)
                counts.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["id", "text", "n_items"])

    return _rows(df, id_col, text_col).mapInArrow(run, "id long, text string, n_items int").select(F.col("id").alias(id_col), "text", "n_items")
