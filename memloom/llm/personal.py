"""Personal information inside free text (problem 4).

Patterns find e-mail addresses, postal addresses, identity numbers, phone numbers and
names; every find becomes a typed placeholder. Numbers keep their format: their
digits are permuted by a keyed Feistel network over the same number of digits (a
leading birth date over the days of a century; a check digit is worked out anew, off by what the
old one was off), so equal values stay equal across documents and whoever has the key can undo it.
Other values carry a keyed tag. Numbers are found by their shape and their surroundings; one
with a wrong check digit counts, too, since people mistype what they mean.

Defined results
* null, empty and blank texts stay as they are and hold nothing; everything outside a find stays as it was;
* of overlapping finds e-mail comes before address, identity number, phone and name; a name inside an e-mail address is none;
* one row per record and kind in the report, also for rows delivered twice; null record ids are kept;
* very long texts are searched whole; extra columns pass through ``mask``; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "address", "id_number", "phone", "name")
ROUNDS = 8

#: Given names, lower case.
GIVEN = frozenset(
    """
    aisha alice amara amelia ana andreas anna anouk ansel anton astrid barbara bianca bjorn bruno camille carlos carmen catherine celia charlotte
    chloe clara daniel dario david deepak devin diego dmitri edward elena elif elizabeth emeka emily emma erik fatima farah felix fiona freya
    gabriel george giulia greta hannah hans hassan helen helga henrik henry hiroshi hugo ibrahim idris ingrid ioana isabel isabella ivan jack
    james jan jennifer jessica joao johan john jonas jorge jose joseph juan judith julia karen karin katarina kenji kofi kwame lars laura leila
    lena liam linda lisa louis lucas lucia luis magnus marco margaret maria marie marta martin mary mateo matthew mei michael miguel mohammed
    monica nadia naomi natalia nicolas nikolai nina noah nora oleg olga oliver olivia omar oskar pablo paloma patricia paul pavel pedro peter
    philip pierre priya rafael rahul raj ravi rebecca richard robert rosa samuel sandra sanjay sara sarah selim sergei simon sofia sophie
    stefan stellan stephen susan sven svetlana tariq thomas tomas ursula vera victor viktor walter william xavier yasmin yuki yusuf zainab zoe
    """.split()
)
_TITLE = r"(?:mr|mrs|ms|miss|mx|dr|prof|professor|sir|madam)"
_SURNAME_END = (
    r"(?:by|dale|escu|ette|gaard|grove|haven|inger|mere|more|ovan|stead|sund|vik|vorn|wick|ama|croft|ley|ridge|son|sen|berg|mann|stein|ova|ov|enko|sky|ski|ska|ton|ford|field|wood|worth|"
    r"man|ham|well|land|ström|strom|lund|quist|ez|elli|ini|idis|yan|oğlu|oglu)"
)
_NOT_SURNAMES = frozenset(
    """monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    the and for with like from via through will has have had was were is are can could would should do does did i we you he she they it my our your his her their""".split()
)
#: Capitalised words that begin a sentence or end the name of a place, firm or thing, never a person's.
_NO_PERSON = frozenset(
    """a an this that these those every each some any no all both in at on by before after between during since until under over about only even then there here when while where what who
    why how if but or so because although everyone everybody someone somebody nobody nothing everything anyone new old north south east west upper lower great saint
    street road lane avenue trail park pier mill bridge festival fair club band team school college university academy institute hospital clinic museum library church company corporation group bank
    council committee department office service services support centre center city town county state kingdom republic coast island islands mountain river lake valley bay desk times post news radio press
    inc ltd corp llc gmbh""".split()
)
_NUMBER_WORDS = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_AT, _DOT = r"(?:\s?@\s?|\s?[(\[{<]\s?at\s?[)\]}>]\s?)", r"(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?)"
_LABEL = r"[\w\-]+"
_STREET = (
    r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|court|ct|crescent|cres|boulevard|blvd|way|place|pl|square|sq|grove|hill|walk|mews|row|parade|quay|terrace|gardens|park)"
)
_NOT_STREETS = frozenset("covers of in the and for to per more about like with at on by from through via credits points minutes visits parts copies of is are was were".split())

_EMAIL = re.compile(rf"(?<![\w.+\-])[\w.+\-]*\w\+?{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[a-z]{{2,24}}\b|(?<![\w.+\-])[\w.+\-]*\w\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})*\s+dot\s+[a-z]{{2,24}}\b", re.I)
_UNIT = r"(?:(?:flat|apt|apartment|unit|suite)\.?\s\d+[a-z]?,?\s+)?"
#: A unit, and a town that starts with a capital, with or without a code.
_TOWN = r"(?:,?\s(?-i:(?=[A-Z]))[^\W\d_]{3,}(?:\s\d{4,6}\b)?(?=[\s.,;)\"'!?]|$))?"
_TAIL = r"(?:,?\s+(?:flat|apt|apartment|unit|suite)\.?\s\d+[a-z]?\b)?" + _TOWN.replace(",?", ",", 1)
_NUMBERED = re.compile(rf"{_UNIT}\b(?P<no>\d{{1,5}}[a-z]?),?[ ](?P<words>(?:[^\W\d_]+\.?[ ]){{1,3}}){_STREET}\b(?P<end>\.?){_TAIL}", re.I)
_STRASSE = re.compile(r"\b[^\W\d_]{3,}(?:weg|strasse|straße|gasse|allee|platz|gatan|vägen|straat|laan)\.?\s\d{1,4}[a-z]?\b(?:,\s\d{4,5}\s[^\W\d_]+)?", re.I)
_RUE = re.compile(r"\b(?:\d{1,4},?\s)?(?:rue|calle|rua|avenida|impasse|chemin)\s(?:(?:de|du|des|del|da|do|dos|la|le|les|los)\s|d'|l')*[^\W\d_]+(?:\s\d{1,4}[a-z]?\b)?" + _TOWN.replace(",?", ",", 1), re.I)
_BEFORE_NO_ADDRESS = re.compile(r"\b(?:chapter|section|page|part|step|figure|table|volume|episode|lesson|line|row|version|build|level|item|ticket)\s$", re.I)
_ID = [
    re.compile(p, re.I)
    for p in (
        r"(?<![\w\-.])\d{3}([- ])\d{2}\1\d{4}(?![\w\-])(?!\.\d)",
        r"(?<!\w)[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-d](?!\w)",
        r"(?<!\w)dl[- ]?\d{4}-\d{4}-\d{2}(?![\w\-])",
        r"(?<![\w\-.])\d{6}[-+]\d{4}(?![\w\-])",
        r"(?<![\w\-.])\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}(?![\w\-])",
        r"(?<![\w\-.])(?<!\d )\d{3} \d{3} \d{3} \d(?![\w\-])(?! \d)",
    )
]
_ID_CUE = r"(?:social\s+security|ssn|social\s+insurance|national\s+insurance|national\s+id|national\s+register|insurance\s+(?:no|number)|identity|personal\s+(?:id|identity)|tax\s*(?:payer)?\s*(?:id|no|number)|passport|driving\s+licen[cs]e|driver'?s?\s+licen[cs]e|licen[cs]e\s+(?:no|number))"
_ID_VALUE = r"(?P<v>[a-z]{0,2}[- ]?\d[\d\- .]{4,14}\d[a-z]?)"
_ID_AFTER = re.compile(rf"\b{_ID_CUE}\b(?:\s+(?:number|no|nr|num|id|card))?\W{{1,4}}(?:(?:is|was|of|reads)\W{{1,3}})?{_ID_VALUE}(?!\w)", re.I)
_ID_BEFORE = re.compile(rf"(?<![\w\-.]){_ID_VALUE}\s+(?:as|is|for)\s+(?:the|my|his|her|their|your|our)\s+{_ID_CUE}", re.I)
_EXT = r"(?:,?\s?(?:ext\.?|x)\s?\d{1,5})?"
_PHONE = [
    re.compile(p, re.I)
    for p in (
rf"(?<![\w+])\+1[\s.\-]?(?:\(\d{{3}}\)|\d{{3}})[\s.\-]?\d{{3}}[\s.\-]?\d{{4}}(?!\w){_EXT}",
        r"(?<![\w+])\+44\s?(?:\(0\)\s?)?(?:\d{2}\s?\d{4}\s?\d{4}|\d{3}\s?\d{3}\s?\d{4}|\d{4}\s?\d{3}\s?\d{3}|\d{4}\s?\d{6}|\d{10})(?!\w)",
        rf"(?<![\w+])\+(?!1[\s.\-(]|44)[2-9]\d{{0,2}}[\s.\-]?(?:\(\d{{1,4}}\)[\s.\-]?)?\d(?:[\s.\-]?\d){{5,12}}(?!\w){_EXT}",
        rf"(?<![\w\-.])(?:1[\s.\-])?\(\d{{3}}\)\s?\d{{3}}[\s.\-]?\d{{4}}(?![\w\-]){_EXT}",
        rf"(?<![\w\-.])(?:1[.\-])?[2-9]\d{{2}}([.\-])\d{{3}}\1\d{{4}}(?![\w\-]){_EXT}",
        rf"(?<![\w\-.])[2-9]\d{{2}}[2-9]\d{{6}}(?![\w\-]){_EXT}",
        rf"(?<![\w\-.])(?<!\d )555[\s.\-]\d{{4}}(?![\w\-]){_EXT}",
        r"(?<![\w\-.])0\d{4}\s?\d{6}(?![\w\-])|(?<![\w\-.])0\d{2,3}\s\d{3,4}\s\d{4}(?![\w\-])",
        rf"(?<!\w)(?:{_NUMBER_WORDS}[\s,\-]+){{6,14}}{_NUMBER_WORDS}(?!\w)",
    )
]
_PHONE_CUE = re.compile(rf"\b(?:call|phone|ring|rings|text|tel|telephone|mobile|cell|fax|dial|whatsapp|reach)\b[^\d\n]{{0,24}}(?P<v>(?:1[\s.\-])?[2-9]\d{{2}}[\s.\-]\d{{3}}[\s.\-]\d{{4}}|[2-9]\d{{2}}[\s.\-]\d{{4}})(?![\w\-]){_EXT}", re.I)
_WORD = r"[^\W\d_]{2,}(?:['’\-][^\W\d_]{2,})?"
_FULL = re.compile(rf"(?<!\w)(?P<g>[^\W\d_]{{2,}})(?P<i>(?:\s[^\W\d_]\.)+)?\s+(?P<s>{_WORD})(?!\w)")
_REVERSED = re.compile(rf"(?<!\w)(?=(?P<all>(?P<s>{_WORD}),\s+(?P<g>[^\W\d_]{{2,}}))(?!\w))")
_INITIALS = re.compile(rf"(?<![\w.])(?:[^\W\d_]\.\s?){{1,3}}(?P<s>{_WORD})(?!\w)")
_TITLED = re.compile(rf"(?<!\w)(?P<t>{_TITLE})\.?\s+(?:[^\W\d_]\.\s?)?(?:(?P<g>[^\W\d_]{{2,}})\s+)?(?P<s>{_WORD})(?!\w)", re.I)
_CUED = re.compile(r"(?i:\b(?:my name is|i am called|spoke with|contact is|ask for|signed by|best wishes,|kind regards,|sincerely,))\s+(?P<g>[A-Z][a-z]+)(?:\s[A-Z]\.)*\s+(?P<s>[A-Z][a-z]+(?:-[A-Z][a-z]+)?)")
#: A pair of capitalised words before a word of speaking or kinship, for given names that no list holds.
_CAPITALS = r"[A-Z][^\W\d_A-Z]+(?:-[A-Z][^\W\d_A-Z]+)?"
_SPEAK = frozenset("said says told tells asked met wrote writes replied answered agreed insisted explained admitted emailed phoned texted thanked apologised apologized lives lived works worked thinks thought married".split())
_KIN = frozenset("wife husband son daughter mother father brother sister boss colleague email phone address birthday".split())
_SPEAKS = re.compile(rf"\s(?:{'|'.join(sorted(_SPEAK))})\b|['’]s\s(?:{'|'.join(sorted(_KIN))})\b")
_PAIR_BEFORE = re.compile(rf"(?<![\w.\-'’])(?P<g>{_CAPITALS})\s(?P<s>{_CAPITALS})$")
_SURNAME = re.compile(rf"(?:[^\W\d_]{{2,}}{_SURNAME_END})(?:['’\-][^\W\d_]{{2,}})?$", re.I)

#: Cheap signs, without which the dearer patterns can't match.
_DIGIT, _LONG, _LETTERS = re.compile(r"\d"), re.compile(r"\d(?:[\s.\-()]{0,3}\d){5,}"), re.compile(r"[a-z]{3,}")
_BRACKET_AT = re.compile(r"[(\[{<]\s?at\s?[)\]}>]")
_STREET_WORD = re.compile(rf"\d[a-z]?,? (?:[^\W\d_]+\.? ){{1,3}}{_STREET}\b")
_STRASSE_SIGNS = ("weg", "stra", "gasse", "allee", "platz", "gatan", "vägen", "laan")
_RUE_SIGNS = ("rue ", "calle ", "rua ", "avenida ", "impasse ", "chemin ")
_NUMBER_LIST = _NUMBER_WORDS[3:-1].split("|")


def _surname(given: str, s: str) -> bool:
    """Whether ``s`` can be the surname after ``given``: a capitalised word, or the shape of one where case tells nothing."""
    low = s.lower()
    if low in _NOT_SURNAMES or low in GIVEN:
        return False
    titled = given[0].isupper() and given[1:].islower()
    return (titled and s[0].isupper()) or bool(_SURNAME.match(s))


def _names(text: str, low: str) -> Iterator[tuple[int, int]]:
    for m in _TITLED.finditer(text):
        s, g = m["s"], m["g"]
        if g and (not s[0].isupper() or s.lower() in _NOT_SURNAMES) and g[0].isupper():
            yield m.start(), m.end("g")
        elif g and g[0].isupper() and _SURNAME.match(g) and not _SURNAME.match(s):
            yield m.start(), m.end("g")
        elif s[0].isupper() or _SURNAME.match(s):
            yield m.start(), m.end()
        elif g and _SURNAME.match(g):
            yield m.start(), m.end("g")
    words = set(_LETTERS.findall(low))
    some = not GIVEN.isdisjoint(words)
    for m in _REVERSED.finditer(text) if some else ():
        if m["g"].lower() in GIVEN and _SURNAME.match(m["s"]):
            yield m.span("all")
    at = 0 if some else len(text)
    while m := _FULL.search(text, at):
        if m["g"].lower() in GIVEN and _surname(m["g"], m["s"]):
            yield m.span()
            at = m.end()
        else:
            at = m.end("g")
    for m in _INITIALS.finditer(text) if "." in text else ():
        if m["s"][0].isupper() and _SURNAME.match(m["s"]) or m["s"].islower() and m[0][0].islower() and re.fullmatch(r"(?:[^\W\d_]\.\s?){1,3}" + _WORD, m[0]) and _SURNAME.match(m["s"]):
            yield m.span()
    for m in _CUED.finditer(text):
        if m["s"].lower() not in _NOT_SURNAMES:
            yield m.span()
    for v in _SPEAKS.finditer(text) if not (_SPEAK.isdisjoint(words) and _KIN.isdisjoint(words)) else ():
        if (m := _PAIR_BEFORE.search(text, max(0, v.start() - 60), v.start())) and not {m["g"].lower(), m["s"].lower()} & (_NOT_SURNAMES | _NO_PERSON):
            yield m.span()


def _addresses(text: str, low: str) -> Iterator[tuple[int, int]]:
    for m in _NUMBERED.finditer(text) if _STREET_WORD.search(low) else ():
        names = m["words"].split()
        if any(w.lower().strip(".") in _NOT_STREETS for w in names) or _BEFORE_NO_ADDRESS.search(text, max(0, m.start("no") - 12), m.start("no")):
            continue
        kind = text[m.end("words") : m.end()]
        if len({w[0].isupper() for w in (*names, kind)}) == 1 and not (names[0][0].islower() and re.match(r"(?:park|terrace|place|hill|walk|row|gardens|way)\b", kind)):
            yield m.span()
    for p, signs in ((_STRASSE, _STRASSE_SIGNS), (_RUE, _RUE_SIGNS)):
        for m in p.finditer(text) if any(x in low for x in signs) else ():
            if re.search(r"\d", m[0]):
                yield m.span()


def _ids(text: str) -> Iterator[tuple[int, int]]:
    for p in _ID:
        for m in p.finditer(text):
            yield m.span()
    for p in (_ID_AFTER, _ID_BEFORE):
        for m in p.finditer(text):
            if sum(c.isdigit() for c in m["v"]) >= 6:
                yield m.span("v")


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for p in _PHONE[:-1]:
        for m in p.finditer(text):
            yield m.span()
    for m in _PHONE_CUE.finditer(text):
        yield m.span("v")


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every find, in order and without overlap."""
    if not text:
        return []
    low = text.lower()
    got: list[tuple[int, int, str]] = []

    def take(spans: Iterator[tuple[int, int]], kind: str) -> None:
        for a, b in spans:
            if all(b <= x or a >= y for x, y, _ in got):
                got.append((a, b, kind))

    if "@" in text or " dot " in low or _BRACKET_AT.search(low):
        take((m.span() for m in _EMAIL.finditer(text)), "email")
    if _DIGIT.search(text):
        take(_addresses(text, low), "address")
        if _LONG.search(text):
            take(_ids(text), "id_number")
            take(_phones(text), "phone")
    if sum(map(low.count, _NUMBER_LIST)) > 6:
        take((m.span() for m in _PHONE[-1].finditer(text)), "phone")
    take(_names(text, low), "name")
    return sorted(got)


def _luhn(digits: str) -> int:
    """The digit that closes ``digits`` by the rule of doubled digits, from the right."""
    doubled = [int(c) * (2 - k % 2) for k, c in enumerate(reversed(digits))]
    return -sum(d // 10 + d % 10 for d in doubled) % 10


class _Checked(NamedTuple):
    """A form of number whose last digits follow from the others."""

    shape: re.Pattern
    width: int
    dated: bool
    check: Callable[[str], int]


_CHECKED = (
    _Checked(re.compile(r"\d{6}[-+]\d{4}"), 1, True, _luhn),
    _Checked(re.compile(r"\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}"), 2, True, lambda d: 97 - int(d) % 97),
    _Checked(re.compile(r"\d{3} \d{3} \d{3} \d"), 1, False, lambda d: -sum(int(c) * w for c, w in zip(d, range(10, 1, -1), strict=True)) % 11 % 10),
)


class Pseudonyms:
    """Keyed, format-preserving stand-ins."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, r: int, size: int, value: int, modulus: int) -> int:
        h = hashlib.blake2b(b"%d|%d|%d" % (r, size, value), key=self.key, digest_size=16)
        return int.from_bytes(h.digest(), "big") % modulus

    def digits(self, text: str, back: bool = False) -> str:
        """A permutation of the digit strings of this length."""
        n = len(text)
        if n < 2:
            return text
        cut = n // 2
        a, b, size_a, size_b = int(text[:cut]), int(text[cut:]), 10**cut, 10 ** (n - cut)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2 == 0:
                a = (a + sign * self._round(r, n, b, size_a)) % size_a
            else:
                b = (b + sign * self._round(r, n, a, size_b)) % size_b
        return f"{a:0{cut}d}{b:0{n - cut}d}"

    def day(self, yymmdd: str, back: bool = False) -> str:
        """A permutation of the valid dates of a century; what is no date is permuted as digits, off the dates."""
        first, days = date(2000, 1, 1), 36_525

        def number(s: str) -> int | None:
            try:
                return (date(2000 + int(s[:2]), int(s[2:4]), int(s[4:])) - first).days
            except ValueError:
                return None

        if (n := number(yymmdd)) is None:
            out = self.digits(yymmdd, back)
            while number(out) is not None:
                out = self.digits(out, back)
            return out
        while True:  # walk the cycle back into the days
            n = int(self.digits(f"{n:05d}", back))
            if n < days:
                return (first + timedelta(days=n)).strftime("%y%m%d")

    def number(self, text: str, back: bool = False) -> str:
        """``text`` with its digits permuted in place; a birth date in front stays one, check digits stay as right or wrong as they were."""
        digits = "".join(c for c in text if c.isdigit())
        form = next((f for f in _CHECKED if f.shape.fullmatch(text)), None)
        if form is None:
            new = self.digits(digits, back)
        else:
            body, check = digits[: -form.width], digits[-form.width :]
            size, off = 10**form.width, int(check) - form.check(body)
            body = (self.day(body[:6], back) + self.digits(body[6:], back)) if form.dated else self.digits(body, back)
            new = f"{body}{(form.check(body) + off) % size:0{form.width}d}"
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in text)

    def tag(self, text: str) -> str:
        same = " ".join(text.lower().split())
        return hashlib.blake2b(same.encode(), key=self.key, digest_size=5).hexdigest()

    def replace(self, text: str, kind: str) -> str:
        if kind in ("phone", "id_number") and any(c.isdigit() for c in text):
            return f"[{kind.upper()} {self.number(text)}]"
        return f"[{kind.upper()} {self.tag(text)}]"


def mask(text: str | None, pseudonyms: Pseudonyms) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find(text):
        out += [text[at:a], pseudonyms.replace(text[a:b], kind)]
        at = b
    return "".join([*out, text[at:]])


def report(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, kind): one row per record and kind found in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k) for i, t in enumerate(b.column(len(keys)).to_pylist()) for k in sorted({k for _, _, k in find(t)})]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in range(len(keys))), pa.array([k for _, k in rows], pa.string())], [*keys, "kind"])

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInArrow(run, f"{types}, kind string").distinct()


def masked(df: DataFrame, text: str, secret: bytes, out: str | None = None) -> DataFrame:
    """``df`` with ``text`` masked, in the column ``out`` or in place."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Pseudonyms(secret)
        for s in batches:
            yield s.map(lambda t: mask(t, own), na_action="ignore")

    return df.withColumn(out or text, run(F.col(text)))
