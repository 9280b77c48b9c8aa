"""Which of the searches for personal items a text needs at all, told for whole Arrow arrays at once.

Each pattern is what its search in personal.py cannot do without, so that a text that it does not match loses nothing. RE2
reads a text once and never backtracks, which takes a twentieth of the time of the search. All characters beyond ASCII pass
for letters, digits and blanks alike: no table of Unicode decides, and texts with many of them are searched in vain at worst.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc

# digits, blanks, what names are made of (_INK), what they begin with, letters
_D, _S, _I, _U, _W = r"[0-9[:^ascii:]]", r"[\t-\r\x1c-\x20[:^ascii:]]", r"[0-9A-Za-z'\x7f[:^ascii:]-]", r"[A-Z\x7f[:^ascii:]]", r"[0-9A-Za-z_[:^ascii:]]"
_P = rf"(?:(?:van|von|de|del|der|den|di|da|la|le|ter|ten|bin|al|dos|du|zu|zur){_S})"
_STREET = (
    r"(?:Street|Road|Avenue|Lane|Close|Terrace|Drive|Way|Court|Place|Square|Crescent|Boulevard|Gardens|Grove|Row|Hill|Mews|Park|STREET|ROAD|AVENUE|LANE|CLOSE|TERRACE|DRIVE|WAY|COURT|PLACE"
    r"|street|road|avenue|lane|close|terrace|drive|way|court|place|(?i:St|Rd|Ave|Ln|Dr|Blvd|Cres|Sq))"
)
_NAMES_LENGTH = 10_000  # characters of names that one pattern holds


def _any(words: str) -> str:
    """Words in small or large letters, with the letters beyond ASCII that Python takes for i."""
    return f"(?i:{re.sub('i', '[iİı]', words)})"


class May(NamedTuple):
    """Whether a text may hold what each search finds."""

    spelled: bool
    figures: bool
    english: bool
    french: bool
    german: bool
    spanish: bool
    initials: bool
    titled: bool
    holder: bool
    hail: bool


ANY = May(*[True] * len(May._fields))
PATTERNS = May(
    spelled=rf"(?i)[\[({{]{_S}?at|{_S}dot{_S}",
    figures="|".join(
        (
            rf"(?:^|[^0-9A-Za-z_+<#/.-])(?:\+{_D}|00{_S}?{_D}{{2}}(?:{_S}|[.-])?{_D}{{2}}|\({_D}{{3}}\){_S}?{_D}{{3}}(?:{_S}|[.-])|\(0{_D}{{2,4}}\){_S}?{_D}{{3}}|[2-9]{_D}{{2}}[.-]{_D}{{3}}[.-]{_D}{{4}}"
            rf"|0[1-9](?:(?:{_S}|\.){_D}{{2}}){{4}}|0{_D}{{2,3}}{_S}{_D}{{3,4}}{_S}{_D}{{3}}|0{_D}{{4}}{_S}{_D}{{6}}|0{_D}{{10}})",
            rf"(?:^|[^0-9A-Za-z_<\-/.])(?:{_D}{{3}}-{_D}{{2}}-{_D}{{4}}|{_D}{{3}}{_S}{_D}{{2}}{_S}{_D}{{4}}|[A-Za-z]{{2}}{_D}{{2}}(?:{_S}{_D}{{4}}){{3}}|[A-Za-z]<[A-Za-z]{{2}}{_D}{{7}}|[A-Za-z]{_D}{{8}}|{_D}{{8}}-?[A-Za-z]"
            rf"|[A-Za-z]{{2}}(?:{_S}{_D}{{2}}){{3}}{_S}[A-Za-z]|[A-Za-z]{{2}}{_D}{{6}}[A-Za-z]|{_D}(?:{_S}{_D}{{2}}){{3}}(?:{_S}{_D}{{3}}){{2}}{_S}{_D}{{2}}|[12789]{_D}{{14}})",
            rf"(?:{_any('number|confirm|nummer|documento')}|(?i:not)[^\t-\r\x1c-\x20]{{1,4}}){_S}?[:=]?{_S}?{_D}",
        )
    ),
    english=rf"{_D}[a-zA-Z]?(?:{_S}{_I}+){{1,3}}{_S}{_STREET}(?:[^0-9A-Za-z_-]|$)",
    french=rf"{_D}[a-zA-Z]?(?:{_S}?(?:bis|ter))?,?{_S}(?:{_any('rue|avenue|boulevard|place|chemin|impasse|quai|cours|route')}|(?i:all){_I}{{1,4}}(?i:e)){_S}",
    german=rf"(?:(?i:stra)(?:(?i:ss)|{_I}{{1,4}})(?i:e)|{_any('str[.]|weg|gasse|platz|allee|damm|ufer|ring')}){_S}{_D}",
    spanish=rf"{_any('calle|avenida|avda[.]|plaza|paseo|camino|ronda|c/')}{_S}(?:[^\t-\r\x1c-\x20]+{_S}){{1,6}}{_D}",
    initials=rf"(?:^|[^0-9A-Za-z_.'-]){_U}\.(?:{_S}?{_U}\.)?{_S}{_P}{{0,2}}{_U}",
    titled=rf"(?:^|[^0-9A-Za-z_]){_any('mr|mrs|ms|miss|dr|prof|herr|herrn|frau|monsieur|madame|mme|mlle|señora?|sra?|don|doña')}\.?{_S}(?:{_U}\.{_S})?{_P}{{0,2}}{_U}",
    holder=rf"(?:^|[^A-Za-z])(?:{_any('account holder|titulaire|titular|name|nom|nombre')}|{_any('kontoinhaber')}{_W}*){_S}?[:=]{_S}?{_I}",
    hail=rf"(?:^|\n){_S}*(?:{_any('good (?:morning|afternoon|evening|day)|hi|hello|hey|dear|attention|guten (?:tag|morgen|abend)|hallo|liebe[rs]?|sehr geehrte[rs]?(?: (?:herr|frau))?|moin|bonjour|bonsoir|salut|hola|estimad[oa]|querid[oa]')}"
    rf"|(?i:ch){_I}{{1,6}}(?i:re?)|(?i:buenos d){_I}{{1,4}}(?i:as)){_S}",
)
_CASED = (r"[a-z]{2}", r"[A-Z]")


def told(texts: pa.Array, pattern: str) -> list[bool]:
    """Whether each text holds a match; null texts hold none."""
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False).tolist()


def may(texts: pa.Array) -> Iterator[May]:
    """What each (shadow of a) text may hold."""
    return map(May._make, zip(*(told(texts, p) for p in PATTERNS)))


def may_begin(texts: pa.Array, names: Iterable[str]) -> list[bool]:
    """Whether a word of each text may begin with one of the names, or the text is in one case; many names tell nothing."""
    names = sorted(names)
    if not names:
        return [False] * len(texts)
    if sum(map(len, names)) > _NAMES_LENGTH:
        return [True] * len(texts)
    begun = told(texts, rf"(?:^|[^0-9A-Za-z'-])(?:{'|'.join(map(re.escape, names))})")
    return [x or not (lower and upper) for x, lower, upper in zip(begun, *(told(texts, p) for p in _CASED))]
