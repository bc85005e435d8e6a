"""Personal data: detected entities receive keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the entity's own format: each character is drawn from the alphabet of
the one it stands for (digits, hexadecimal digits, vowels or consonants of a script and case, letters of its
part of Unicode elsewhere, numbers of an address with as many digits). The permutation is a Feistel network P,
used as P^-1(P(x) + 1): a shift in permuted order. So within a format distinct entities have distinct surrogates,
equal ones have equal ones in every document and task, none is its own surrogate, and no table of entities has
to be kept or shuffled. Where a surrogate could meet another kind of value (a listed name, for one) the permutation
is applied again until it doesn't, which keeps it a permutation: that is the collision check. Forms that differ
in case alone, and numbers and account numbers that differ in their spaces and signs alone, are one entity.

Types: email, phone (a known country code stays), ip (both versions), card (13 to 19 digits; a valid check digit
stays valid, an invalid one invalid), iban (check digits as for cards), ssn, secret (assigned tokens and
passwords, keys with a known prefix, long hexadecimal strings) and name (after a title, or a listed first name
with a surname, in Latin, Greek or Cyrillic; and, in the same document, every further mention of such a name's
words). Listed first names are exchanged within their gender and length, others keep vowels, consonants and
their last letter, which often carries the gender. Detection is by patterns and a short list of names: names
without a title whose first name isn't listed, addresses of houses and numbers without a cue aren't found.
Lengths never change, and no pattern has an upper length where the type has none.

Defined results: a null text stays null and has no entities; the empty one is empty. A text of any length is
searched as a whole. Where patterns overlap the one that begins first counts, and of these the one that is listed
first. Repeated rows get equal results; ids aren't looked at. Other columns stay as they are, but one that is named
like entities_col is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, turn


#: The setting that holds the key for queries; a session without it gets a random one, kept while it lasts.
KEY_SETTING = "spark.larkspark.pii.key"
ROUNDS = 8
#: Characters that one permutation exchanges together; longer entities go in parts.
PART = 64
CACHE_ENTRIES = 100_000

#: Titles by gender, and first names by gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Signora", "Госпожа", "Κυρία"),
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Κύριος"),
    "?": ("Dr", "Prof", "Doktor", "Docteur", "Doctor", "Доктор"),
}
NAMES = {
    "f": ("Ada", "Ana", "Eva", "Ida", "Lea", "Mia", "Zoe", "Amy", "Anna", "Emma", "Jane", "Lisa", "Lucy", "Mary", "Nora", "Rosa", "Sara", "Alice", "Chloe", "Clara", "Elena", "Emily", "Julia", "Karen", "Laura", "Linda", "Marie", "Sofia", "Amelie", "Camila", "Hannah", "Isabel", "Monika", "Sabine", "Sophie", "Teresa"),
    "m": ("Ben", "Jan", "Leo", "Max", "Tim", "Tom", "Sam", "Ivo", "Adam", "Carl", "Erik", "Hans", "Jack", "John", "José", "Juan", "Luis", "Paul", "Bruno", "David", "Diego", "Felix", "Henri", "James", "Jonas", "Lucas", "Peter", "Simon", "Andrés", "Daniel", "Dieter", "Michel", "Robert", "Stefan", "Thomas", "Victor"),
}
#: The characters that a letter is exchanged for: vowels, then consonants, of each script and case.
ALPHABETS = (
    "0123456789",
    "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ",
    "àáâäãåèéêëìíîïòóôöõùúûü", "çñ", "ÀÁÂÄÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜ", "ÇÑ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
_OF = {c: a for a in ALPHABETS for c in a}
_HEX = "0123456789abcdef"
_SIGNS = "_+-"
#: Telephone country codes of one and of two digits; all others have three.
_CODES = re.compile("[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
#: Prefixes that mark keys, and words that are assigned one.
KEY_PREFIXES = r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|AIza)"
_ASSIGNED = r"(?i:\b(?:api|access|secret|private|auth)?[_ -]?(?:key|token|secret|password|passwd|passphrase|pwd))[\"']?\s?[:=]\s?"
_CALLED = r"(?i:\b(?:tel|telefon|telephone|téléphone|teléfono|phone|mobile|cell|handy|fax|call)\b[.:]?\s?(?:no\.?|me|us|at|is)?\s?[:#]?\s?)"

_GAP = r"[\s|!#*$%&]{0,6}[-.\s]?[\s|!#*$%&]{0,6}"
_TITLE = "|".join(sorted((re.escape(t) for x in TITLES.values() for t in x), key=len, reverse=True))
_LISTED = "|".join(sorted({n for x in NAMES.values() for n in x}, key=lambda n: (-len(n), n)))
_CAPITAL = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][a-zß-öø-ÿα-ωά-ώа-я'’-]+"
_NUMBER = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUP = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\w.+-])[\w+-][\w.+-]*@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])",
    "assigned": rf"{_ASSIGNED}(?:\"(?P<quoted>[^\"\s]{{4,}})\"|'(?P<single>[^'\s]{{4,}})'|(?P<bare>(?=[^\s\"',;]*\d)[^\s\"',;]{{6,}}))",
    "secret": rf"(?<![0-9A-Za-z]){KEY_PREFIXES}[0-9A-Za-z_-]{{16,}}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{{32,}}|(?=[A-F]*\d)(?=\d*[A-F])[0-9A-F]{{32,}})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?:{_NUMBER}\.){{3}}{_NUMBER}(?![\d]|\.\d)",
    "ipv6": rf"(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{2,6}}(?::{_GROUP}){{1,5}}|{_GROUP}:(?::{_GROUP}){{2,6}})(?![\w:])",
    "phone": rf"(?<![\w+])\+(?:\d{{7,15}}|\d{{1,3}}{_GAP}\(?\d{{2,4}}\)?{_GAP}\d{{3,4}}{_GAP}\d{{3,5}}|\d{{1,3}}(?:[ .-]?\(0\))?(?:[ .-]?\d{{1,2}}){{5}}|\d{{1,3}}[ .-]\(?\d{{2,5}}\)?[ .-]\d{{4,8}})(?!\d)|(?<![\w(])\(\d{{3}}\)\s?\d{{3}}[-.]\d{{4}}(?!\d)|(?<![\w.-])\d{{3}}([-.])\d{{3}}\4\d{{4}}(?![\w-]|\.\d)",
    "called": rf"{_CALLED}(?P<number>\(?\d(?:[ ()./-]{{0,2}}\d){{6,14}})(?!\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w]|-\d|\.\d)",
    "name": rf"(?<=\b)(?:{_TITLE})\b\.?\s(?:{_CAPITAL}\s){{0,2}}{_CAPITAL}|\b(?:{_LISTED})(?:\s{_CAPITAL}){{1,2}}",
}
PATTERNS["phone"] = PATTERNS["phone"].replace("([-.])", "(?P<sign>[-.])").replace(r"\4", "(?P=sign)")
#: What of a match is the entity, and its type, where it isn't the whole match or the pattern's name.
_VALUES = {"assigned": ("quoted", "single", "bare"), "called": ("number",)}
_KINDS = {"assigned": "secret", "called": "phone", "ipv6": "ip"}
_ALL = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
_NUMERIC = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items() if k != "name"))
_MAY = re.compile(r"[0-9@]|(?i:key|token|secret|passw|passphrase|pwd)")
_TITLED = re.compile(rf"\b(?:{_TITLE})\b\.?\s|\b(?:{_LISTED})\s")


@lru_cache(maxsize=4096)
def _letters(c: str) -> str | None:
    """The letters of a character's class in its part of Unicode, where no alphabet is listed."""
    kind = unicodedata.category(c)
    if kind not in ("Ll", "Lu", "Lo", "Lm", "Nd"):
        return None
    start = ord(c) & ~127
    return "".join(x for x in map(chr, range(start, start + 128)) if unicodedata.category(x) == kind and x not in _OF and (kind == "Lo" or len(x.upper()) == len(x.lower()) == 1)) or None


def alphabet(c: str) -> str | None:
    """What a character may be exchanged for, itself among them; None for signs."""
    found = _OF.get(c) or _letters(c)
    return found if found and c in found and len(found) > 1 else None


class Permutation:
    """A keyed permutation of numbers given by digits of mixed radices, without fixed points."""

    def __init__(self, key: bytes, tweak: str):
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode()

    def _f(self, turn: int, value: int, sizes: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|%s|%s" % (turn, value, sizes, self.tweak), key=self.key, digest_size=64).digest(), "big")

    def _network(self, a: int, b: int, m: int, n: int, back: bool) -> tuple[int, int]:
        sizes = b"%d,%d" % (m, n)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if turn % 2 == 0:
                f = self._f(turn, b, sizes)
                a = (a - f if back else a + f) % m
            else:
                f = self._f(turn, a, sizes)
                b = (b - f if back else b + f) % n
        return a, b

    def apply(self, digits: list[int], radices: list[int]) -> list[int]:
        """Long ones go in parts of PART; a part's permutation depends on the ones before it, so the whole is one, too."""
        out, part = [], self
        for at in range(0, len(digits), PART):
            out += part._apply(digits[at : at + PART], radices[at : at + PART])
            if at + PART < len(digits):
                before = hashlib.blake2b(part.tweak + repr(digits[at : at + PART]).encode(), digest_size=16).hexdigest()
                part = Permutation(self.key, before)
        return out

    def _apply(self, digits: list[int], radices: list[int]) -> list[int]:
        half = (len(radices) + 1) // 2
        m, n = prod(radices[:half]), prod(radices[half:])
        if m * n < 2:
            return digits
        a = b = 0
        for d, r in zip(digits[:half], radices[:half], strict=True):
            a = a * r + d
        for d, r in zip(digits[half:], radices[half:], strict=True):
            b = b * r + d
        a, b = self._network(a, b, m, n, False)
        at = (a * n + b + 1) % (m * n)
        a, b = self._network(at // n, at % n, m, n, True)
        out = []
        for value, part in ((b, radices[half:]), (a, radices[:half])):
            for r in reversed(part):
                out.append(value % r)
                value //= r
        return out[::-1]


def luhn(digits: list[int]) -> int:
    """The check digit for these digits."""
    doubled = [d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
    return -sum(doubled) % 10


class Surrogates:
    """Detection and replacement with one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.permutations: dict[str, Permutation] = {}
        self.cache: dict[tuple[str, str], str] = {}
        self.listed = {n.casefold() for x in NAMES.values() for n in x}

    def __reduce__(self):
        return Surrogates, (self.key,)

    def _permute(self, tweak: str, text: str, alphabet_of) -> str:
        """Exchanges each character that has an alphabet; the others are the format, and the permutation depends on it."""
        alphabets = [alphabet_of(c) for c in text]
        shape = "".join("\x00" if a else c for c, a in zip(text, alphabets, strict=True))
        tweak = f"{tweak}|{shape}|{','.join(a[0] for a in alphabets if a)}"
        if len(tweak) > 300:
            tweak = hashlib.blake2b(tweak.encode()).hexdigest()
        if tweak not in self.permutations:
            if len(self.permutations) > CACHE_ENTRIES:
                self.permutations.clear()
            self.permutations[tweak] = Permutation(self.key, tweak)
        own = [(c, a) for c, a in zip(text, alphabets, strict=True) if a]
        new = iter(self.permutations[tweak].apply([a.index(c) for c, a in own], [len(a) for _, a in own]))
        return "".join(a[next(new)] if a else c for c, a in zip(text, alphabets, strict=True))

    def of(self, kind: str, text: str) -> str:
        got = self.cache.get((kind, text))
        if got is None:
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            got = getattr(self, f"_{kind}")(text)
            if got == text:  # nothing of this format could be exchanged: signs are
                signs = any(c in _SIGNS for c in text)
                got = self._permute(f"signs {kind}", text, (lambda c: _SIGNS if c in _SIGNS else None) if signs else alphabet)
            self.cache[kind, text] = got
        return got

    def _cased(self, text: str, replace) -> str:
        """Case forms are one entity: the lower-case form is replaced, and the surrogate takes the form's case."""
        new = replace(text.lower())
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(text, new, strict=True))

    def _email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        host, dot, top = domain.rpartition(".")
        labels = host.split(".")
        known = labels[-1].lower() == "example"  # a reserved domain stays; what stands before it is exchanged
        front = ".".join(labels[:-1]) if known else host
        new = self._cased(local, lambda x: self._permute("local", x, alphabet))
        if front:
            new_front = self._cased(front, lambda x: self._permute("domain", x, alphabet))
            host = f"{new_front}.{labels[-1]}" if known else new_front
        return f"{new}@{host}{dot}{top}"

    def _digits(self, tweak: str, text: str, fixed: int = 0) -> str:
        """Digits but the first fixed ones; what stands between them is kept but doesn't make another entity."""
        digits = [c for c in text if c.isdecimal()]
        new = digits[:fixed] + list(self._permute(f"{tweak}{''.join(digits[:fixed])}", "".join(digits[fixed:]), alphabet))
        it = iter(new)
        return "".join(next(it) if c.isdecimal() else c for c in text)

    def _phone(self, text: str) -> str:
        """A country code stays, whether something stands between it and the number or not."""
        digits = "".join(c for c in text if c.isdecimal())
        code = _CODES.match(digits)
        return self._digits("phone", text, (code.end() if code else 3) if text.startswith("+") else 0)

    def _ssn(self, text: str) -> str:
        return self._digits("ssn", text)

    def _iban(self, text: str) -> str:
        """Country and the check digits' distance from valid ones are kept; spaces don't make another entity."""
        plain = text.replace(" ", "")
        country, check, own = plain[:2], int(plain[2:4]), plain[4:]
        new = self._permute(f"iban {country}", own, alphabet)
        if 2 <= check <= 98:  # the range of valid ones; others are kept as they are
            check = (check - iban_check(country, own) + iban_check(country, new)) % 97
            check += 97 * (check < 2)
        it = iter(f"{country}{check:02d}{new}")
        return "".join(c if c == " " else next(it) for c in text)

    def _card(self, text: str) -> str:
        """The first digit and the check digit's distance from a valid one are kept."""
        digits = [int(c) for c in text if c.isdecimal()]
        off = (digits[-1] - luhn(digits[:-1])) % 10
        new = [int(c) for c in self._digits("card", "".join(map(str, digits[:-1])), 1)]
        it = iter([*new, (luhn(new) + off) % 10])
        return "".join(str(next(it)) if c.isdecimal() else c for c in text)

    def _ipv6(self, text: str) -> str:
        return self._cased(text, lambda x: self._permute("ipv6", x, lambda c: _HEX if c in _HEX else None))

    def _ip(self, text: str) -> str:
        """Each number keeps how many digits it has."""
        lows = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        parts = [(int(x), *lows[len(x)]) for x in text.split(".")]
        tweak = f"ip|{[n for _, _, n in parts]}"
        if tweak not in self.permutations:
            self.permutations[tweak] = Permutation(self.key, tweak)
        new = self.permutations[tweak].apply([x - low for x, low, _ in parts], [n for _, _, n in parts])
        return ".".join(str(x + low) for x, (_, low, _) in zip(new, parts, strict=True))

    def _secret(self, text: str) -> str:
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and not text.isdecimal():
            new = self._permute("secret", text.lower(), lambda c: _HEX)
            return new.upper() if text == text.upper() else new
        marked = re.match(KEY_PREFIXES, text)
        front = marked.end() if marked else 0
        return text[:front] + self._permute(f"secret {text[:front]}", text[front:], alphabet)

    def _word(self, word: str) -> str:
        """One name. A listed first name is exchanged for another of its gender and length."""
        for g, names in NAMES.items():
            if word in names:
                pool = [n for n in names if len(n) == len(word)]
                return pool[self._shift(f"first|{g}|{len(word)}", pool.index(word), len(pool))]
        new = self._permute("name", word[:-1], alphabet) + word[-1]
        while new.casefold() in self.listed and new != word:
            new = self._permute("name", new[:-1], alphabet) + new[-1]
        return new if new != word else self._permute("whole name", word, alphabet)

    def _shift(self, tweak: str, at: int, size: int) -> int:
        if tweak not in self.permutations:
            self.permutations[tweak] = Permutation(self.key, tweak)
        return self.permutations[tweak].apply([at], [size])[0]

    def _name(self, text: str) -> str:
        """A title stays; what a word is exchanged for doesn't depend on it, so mentions with and without one agree."""
        titled = re.match(rf"(?:{_TITLE})\b\.?\s", text)
        front = titled[0] if titled else ""
        return front + _NAME_WORD.sub(lambda m: self._word(m[0]), text[len(front) :])

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int, str]]]:
        """(text with surrogates, entities as (type, start, end, surrogate)). Lengths don't change, so the spans hold in both texts."""
        if not text:
            return text, []
        titled = _TITLED.search(text) is not None
        if not titled and not _MAY.search(text):
            return text, []
        found, words = [], set()
        for m in (_ALL if titled else _NUMERIC).finditer(text):
            kind = m.lastgroup
            part = next((v for v in _VALUES.get(kind, ()) if m[v] is not None), kind)
            found.append((_KINDS.get(kind, kind), m.start(part), m.end(part), self.of("secret" if kind == "assigned" else "phone" if kind == "called" else kind, m[part])))
            if kind == "name":
                words.update(w for w in _NAME_WORD.findall(re.sub(rf"^(?:{_TITLE})\b\.?\s", "", m[0])) if len(w) > 2)
        if words:
            found = self._mentions(text, found, words)
        out, at = [], 0
        for _, start, end, new in found:
            out += [text[at:start], new]
            at = end
        out.append(text[at:])
        return "".join(out), found

    def _mentions(self, text: str, found: list, words: set[str]) -> list:
        """found, and the other places of the document where a word of a name that was found stands."""
        taken = iter(sorted((start, end) for _, start, end, _ in found))
        start, end = next(taken, (len(text), len(text)))
        more = []
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(words, key=lambda w: (-len(w), w))))})(?!\w)", text):
            while end <= m.start():
                start, end = next(taken, (len(text), len(text) + 1))
            if m.end() <= start:
                more.append(("name", m.start(), m.end(), self.of("word", m[0])))
        return sorted([*found, *more], key=lambda e: e[1])


_NAME_WORD = re.compile(r"[^\s'’-]+")


def iban_check(country: str, own: str) -> int:
    """The valid check digits."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{own}{country}00")) % 97


def session_key(spark: SparkSession) -> bytes:
    """The key in KEY_SETTING; without one a random key for this session, so surrogates can't be undone by who has the code."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        spark.conf.set(KEY_SETTING, key := secrets.token_hex(32))
    return key.encode()


_ENTITY = "array<struct<type: string, start: int, end: int, surrogate: string>>"


def surrogate_column(key: bytes, text_col: str = "text") -> Column:
    """struct(text, entities) of a whole text."""

    spans = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    @F.arrow_udf(f"text string, entities {_ENTITY}")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Surrogates(key)
        turn("pii")
        for texts in batches:
            for at in range(0, len(texts), ROWS_AT_ONCE):
                got = [own.replace(t) for t in texts.slice(at, ROWS_AT_ONCE).to_pylist()]
                entities = pa.array([[dict(zip(("type", "start", "end", "surrogate"), e, strict=True)) for e in x] for _, x in got], spans)
                yield pa.StructArray.from_arrays([pa.array([t for t, _ in got], pa.string()), entities], ["text", "entities"])

    return run(F.col(text_col).cast("string"))


def replace_pii(docs: DataFrame, key: bytes, text_col: str = "text", entities_col: str | None = "entities") -> DataFrame:
    """docs with surrogates in its texts and, unless entities_col is None, a column of the entities found. No shuffle."""
    made = "__surrogates"
    while made in docs.columns:
        made += "_"
    out = docs.withColumn(made, surrogate_column(key, text_col))
    columns = [F.col(f"{made}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != entities_col]
    if entities_col:
        columns.append(F.col(f"{made}.entities").alias(entities_col))
    return out.select(*columns)
