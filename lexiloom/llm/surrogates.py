"""Keyed surrogates for personal items: permutations of all values of a format, so that distinctness needs no table.

Every replacement is a one-to-one map under the key: given names are permuted inside their gender's list, digits and
letters of numbers inside all numbers of the same shape, words inside all words of their script whose surrogate has the
same length. So two values of a kind never share a surrogate, whatever the corpus holds, and a value has the same surrogate
wherever it stands, in any case and with any separators. No value stands for itself: permutations are conjugates of a
rotation, which has no fixed point. Separators, country codes, street types, particles and domain endings stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import regex

_CONSONANTS = {"Latin": "bdfghklmnprstvwz", "Cyrillic": "бвгджзклмнпрстфх", "Greek": "βγδζθκλμνξπρστφχ"}
_VOWELS = {"Latin": "aeiou", "Cyrillic": "аеиоу", "Greek": "αειου"}
#: How every made word ends, so that none is one of the given names.
_TAILS = {"Latin": "nd", "Cyrillic": "нд", "Greek": "νδ"}
_SCRIPTS = {name: regex.compile(rf"\p{{{name}}}") for name in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Armenian", "Georgian", "Devanagari", "Thai", "Hangul", "Hiragana", "Katakana", "Han")}
_PART = re.compile(r"(?i)(?:van|von|de|del|der|den|di|da|la|le|ter|ten|bin|al|dos|du|zu|zur)\Z")
_RUN = regex.compile(r"[\p{L}\p{M}]+")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+|[0-9]+")
#: German streets keep the end that says what they are.
_STREET_END = regex.compile(r"(?i)(?:stra(?:ß|ss)e|str|weg|gasse|platz|allee|damm|ufer|ring)$")
# First digits of country codes of one and of two digits; all others have three.
_ONE = ("1", "7")
_TWO = tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


class Permutation:
    """Keyed one-to-one maps of the numbers below n, for any n: Feistel rounds with cycle walking."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _forth(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        half = max(1, (n - 1).bit_length() + 1 >> 1)
        mask, size = (1 << half) - 1, half + 7 >> 3
        while True:
            a, b = x >> half, x & mask
            for i in reversed(range(6)) if back else range(6):
                side = a if back else b
                f = int.from_bytes(hashlib.blake2b(side.to_bytes(size, "big"), digest_size=max(size, 1) if size <= 64 else 64, key=self.key, salt=bytes([i]), person=tweak).digest(), "big") & mask
                a, b = (b ^ f, a) if back else (b, a ^ f)
            x = a << half | b
            if x < n:
                return x

    def of(self, x: int, n: int, tweak: str) -> int:
        """The image of x, never x itself but for n = 1."""
        person = hashlib.blake2b(tweak.encode(), digest_size=16).digest()
        return self._forth((self._forth(x, n, person) + 1) % n, n, person, back=True)


@lru_cache(None)
def _alphabet(script: str) -> str:
    """All small letters of a script, for Latin those of the first two blocks after the plain ones."""
    if script in ("plain", "Latin"):
        plain = "abcdefghijklmnopqrstuvwxyz"
        return plain if script == "plain" else plain + "".join(c for c in map(chr, range(0xDF, 0x250)) if c.isalpha() and c == c.lower())
    known = _SCRIPTS[script]
    return "".join(c for c in map(chr, range(0x370, 0xD7A4)) if known.match(c) and c == c.lower() and unicodedata.category(c)[0] == "L")


class Surrogates:
    def __init__(self, key: bytes, female: list[str], male: list[str]):
        self.permutation = Permutation(key)
        self.pools = [list(female), list(male)]
        self.place = {name.lower(): (pool, i) for pool in (1, 0) for i, name in enumerate(self.pools[pool])}
        self.word = lru_cache(1 << 16)(self._word)

    def _cased(self, made: str, like: str) -> str:
        return made.upper() if like.isupper() and len(like) > 1 else made.lower() if like.islower() else made[:1].upper() + made[1:]

    def _word(self, low: str) -> str:
        """The surrogate of a word in small letters."""
        if len(low) == 1 and low.isascii():
            return chr(97 + self.permutation.of(ord(low) - 97, 26, "letter"))
        script = next((s for s, known in _SCRIPTS.items() if all(known.match(c) for c in low)), None)
        kind = "plain" if low.isascii() else script
        letters = _alphabet(kind) if kind else ""
        if kind and all(c in letters for c in low):
            digits, base = [letters.index(c) for c in low], len(letters)
        else:  # several scripts, marks of their own or rare letters: all code points
            digits, base, script = [ord(c) for c in low], 0x110000, None
        if script and script not in _VOWELS:  # letter for letter
            x = 0
            for d in digits:
                x = x * base + d
            x, out = self.permutation.of(x, base ** len(low), f"{kind}:{len(low)}"), []
            for _ in low:
                x, d = divmod(x, base)
                out.append(letters[d])
            return "".join(reversed(out))
        x = 0
        for d in digits:  # the number of the word among all, shorter ones first
            x = x * base + d + 1
        set_ = script or "Latin"
        consonants, vowels = _CONSONANTS[set_], _VOWELS[set_]
        unit = len(consonants) * len(vowels)
        low_end, size = 0, unit
        while x >= low_end + size:  # words whose surrogates have the same number of syllables
            low_end, size = low_end + size, size * unit
        y, made = self.permutation.of(x - low_end, size, f"{kind}:{size}"), []
        while size > 1:
            y, own = divmod(y, unit)
            made.append(consonants[own // len(vowels)] + vowels[own % len(vowels)])
            size //= unit
        out = "".join(made)
        # words with marks are told from plain ones by a mark, others by another one
        mark = "" if kind in ("plain", "Cyrillic", "Greek") else "́" if kind == "Latin" and script else "̀"
        return unicodedata.normalize("NFC", out + mark) + _TAILS[set_]

    def _name_word(self, said: str) -> str:
        at = self.place.get(said.lower())
        if at is None:
            return self._cased(self.word(said.lower()), said)
        pool = self.pools[at[0]]
        return self._cased(pool[self.permutation.of(at[1], len(pool), f"given:{at[0]}")], said)

    def _digits(self, said: str, tweak: str) -> str:
        """Digits for digits: all numbers of the same length, without a leading zero if there is none."""
        low = 0 if said[0] == "0" or len(said) == 1 else 10 ** (len(said) - 1)
        size = 10 ** (len(said) - 1) if said[0] == "0" else 10 ** len(said) - low
        return str(low + self.permutation.of(int(said) - low, size, f"{tweak}:{len(said)}:{low}")).zfill(len(said)) if size > 1 else said

    def _token(self, m) -> str:
        said = m.group()
        return self._digits(said, "figure") if said[0].isdigit() and said.isascii() else self._cased(self.word(said.lower()), said)

    def _number(self, kind: str, value: str) -> str:
        """Letters for letters and digits for digits, after the country code of a phone number."""
        at, tweak = 0, kind
        if kind == "PHONE" and (m := re.match(r"\+|00\s?", value)):
            ahead = re.sub(r"\D", "", value[m.end() : m.end() + 5])
            n = 1 if ahead.startswith(_ONE) else 2 if ahead.startswith(_TWO) else 3
            at = m.end()
            while n and at < len(value):
                n -= value[at].isdigit()
                at += 1
            tweak = f"{kind}:{re.sub(r'\D', '', value[m.end() : at])}"
            own = re.match(r"[\s.\-]?\(0\)", value[at:])  # the trunk prefix in brackets stays
            at += own.end() if own else 0
        places = [i for i in range(at, len(value)) if value[i].isalnum() and value[i].isascii()]
        if not places:
            return value
        bases = [10 if value[i].isdigit() else 26 for i in places]
        x, n = 0, 1
        for i, b in zip(places, bases):
            x, n = x * b + (int(value[i]) if b == 10 else ord(value[i].lower()) - 97), n * b
        x = self.permutation.of(x, n, f"{tweak}:{''.join('d' if b == 10 else 'l' for b in bases)}")
        out = list(value)
        for i, b in zip(reversed(places), reversed(bases)):
            x, d = divmod(x, b)
            out[i] = str(d) if b == 10 else chr((65 if value[i].isupper() else 97) + d)
        return "".join(out)

    def _street(self, said: str, kept: regex.Pattern) -> str:
        if kept.fullmatch(said):
            return said
        end = _STREET_END.search(said)
        if end and end.start() > 1:
            return self._cased(self.word(said[: end.start()].lower()), said[: end.start()]) + end.group()
        return self._cased(self.word(said.lower()), said)

    def one(self, kind: str, value: str, kept: regex.Pattern) -> str:
        """The surrogate of a value; `kept` matches words of addresses that stay."""
        if kind == "NAME":
            alone = len(_RUN.findall(value)) == 1  # a particle by itself is a name
            return _RUN.sub(lambda m: m.group() if not alone and _PART.match(m.group()) else self._name_word(m.group()), value)
        if kind == "EMAIL":
            parts = regex.split(r"(@|\s?[\[({]\s?(?i:at)\s?[\])}]\s?|\s(?i:at)\s)", value, maxsplit=1)
            if len(parts) == 3:
                labels = regex.split(r"(\.|\s?[\[({]\s?(?i:dot|punkt|point|punto)\s?[\])}]\s?|\s(?i:dot)\s)", parts[2])
                host = [x if i % 2 or i == len(labels) - 1 and i else _TOKEN.sub(self._token, x) for i, x in enumerate(labels)]
                return _TOKEN.sub(self._token, parts[0]) + parts[1] + "".join(host)
        if kind == "ADDRESS":
            return _TOKEN.sub(lambda m: self._digits(m.group(), "house") if m.group()[0].isdigit() else self._street(m.group(), kept), value)
        return self._number(kind, value)
