"""Personal information in free text, by a semi-Markov conditional random field.

A segmentation of a text is a set of non-overlapping entity segments with types; everything
else is outside.  Candidate segments - whole spans of bounded length, each with a type - come
from wide patterns; a segment's score is the dot product of learned weights with features of
the whole span (check digits, separators, length, name and street morphology) and of what
stands left and right of it.  The best segmentation is found by dynamic programming over
the candidates' end points, which picks boundaries and types jointly: a name inside an
address loses to the address, eleven digits after a plus sign to the phone number.  Training
(pii_train) maximises the conditional likelihood by forward-backward over the same lattice.

Rows are independent: one Arrow pass, no shuffle.  Texts are taken whole, of any length; a
segment is bounded, a text is not.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.llm.messages import decode
from docketspark.llm.pii_weights import WEIGHTS
from docketspark.session import spread

# ---------------------------------------------------------------- fixed values

#: Given names common in Poland.  Lists are features of the field; no name needs to be in one.
GIVEN_NAMES = """
Adam Agata Agnieszka Aleksander Aleksandra Alicja Andrzej Anna Antoni Artur Barbara Bartosz Beata Bogdan Bogusław
Bożena Danuta Daniel Dariusz Dorota Edward Elżbieta Ewa Filip Franciszek Grażyna Grzegorz Halina Hanna Helena Henryk
Irena Iwona Jacek Jadwiga Jakub Jan Janina Janusz Jarosław Jerzy Joanna Jolanta Józef Julia Justyna Kamil Karol
Katarzyna Kazimierz Krystyna Krzysztof Leszek Łukasz Maciej Magdalena Małgorzata Marcin Marek Maria Mariusz Marta
Marzena Mateusz Michał Mieczysław Mirosław Monika Natalia Patryk Paulina Paweł Piotr Rafał Renata Robert Roman
Ryszard Sebastian Sławomir Stanisław Stefan Szymon Tadeusz Teresa Tomasz Urszula Waldemar Wanda Wiesław Wiesława
Wiktor Witold Władysław Wojciech Zbigniew Zdzisław Zofia Zuzanna Zygmunt
""".split()

#: Titles and roles before a person's name.
TITLES = r"""(?:mec|adw|apl|prok|prof|dr|mgr|inż|kom|r\.\s?pr|not|hab)\.|(?:mecenas|adwokat|radc|sędzi|sędzin|prokurator|notariusz|komornik|referendarz|asesor|profesor|doktor|magister|inżynier|świad|pan|pani|panem|panu|pana|panią|państwo)\w{0,4}|(?:radc\w+\s+prawn\w+)|herrn?|frau|fräulein|dr|prof|richter(?:in)?|zeug(?:e|en|in)|rechtsanw[aä]lt(?:in)?|ra|mr|mrs|ms|miss|sir|judge|justice|witness|doctor"""

#: Words that open a field of this kind, or a number that is none.
CUES = {
    "phone": r"tel|kom\.|komór|telefon|phone|fon\b|fax|faks|dzwoni|kontakt|numer podany|nr do|mobil|call|office on|erreichbar|ruf",
    "card": r"dow[oó]d|dow\.|osobist|identity|id card|ausweis|tożsamo",
    "pass": r"paszport|passport|reisepass",
    "number": r"pesel|nip\b|podatk|tax|steuer|ewidencyjn|national|legitymuj|numerem",
    "other": r"rachun|konto|iban|zamówieni|faktur|fv|umow[ay] nr|krs|regon|księg|art\.|poz\.|dz\. ?u|nr akt|sygn|order|account|invoice|kwot|warto|sum[aęy]|eur|wysoko|sporu",
    "addr": r"adres|doręcze|zam\.|zamieszk|kierowa|siedzib|położon|\bprzy\b|notices|zustellung|address|wohnhaft|lokal",
    "name": r"nazwisko|obecni|podpisali|poważaniem|regards|grüßen|osoba|całości|obecnie|wniosek|wezwano|spad\w+|imieniu|pełnomocni\w+ dla|named|signed",
}

#: Words that open a street name, and what no name is made of.
STREET_WORDS = r"(?:[uU][lL]|[aA][lL]|[pP][lL]|[oO][sS]|[sS]kw|[rR]on)\.|[uU]lic[aąęyi]|ULICA|[aA]lej[aąęi]|[pP]lacu?|[oO]siedl[ue]|[sS]kwer\w?"
NOT_NAMES = frozenset(
    """sąd sądu sądem trybunał izba izby prezes prezesa rada urząd spółka spółki bank ulica aleja plac kodeks ustawa skarb
    państwa powód pozwany pozwana powódka wnioskodawca uczestnik kupujący najemca biegły komornik syndyk oraz okręgowy
    rejonowy apelacyjny najwyższy wydział punkt der die das the court lane road street avenue gmbh ltd and
    sprawozdawca przewodniczący mecenas dyrektor kierownik minister""".split()
)
COUNTRY_NOT_SERIES = frozenset("NIP PLN EUR USD GBP CHF KRS ISO DIN ART UST PKT POZ FV NR VAT TEL KOM FAX".split())

#: Given names common in Germany, Britain and Ukraine.
FOREIGN_NAMES = """
Hans Klaus Jürgen Petra Sabine Wolfgang Ingrid Lukas Ursula Heike Uwe Karin Mia Anja John Mary Peter David Emma William Susan James Linda
George Thomas Helen Oleksandr Olena Iryna Mykola Serhii Oksana Taras Олександр Ірина Микола Олена Іван Наталія Сергій Марія Оксана Андрій Тарас
""".split()

_U, _L = "A-ZĄĆĘŁŃÓŚŹŻÄÖÜ", "a-ząćęłńóśźżäöüß"


def _ranges(kinds: tuple[str, ...]) -> str:
    """The characters of these Unicode categories, as ranges of a character class; the basic plane only."""
    out, start = [], None
    for c in range(0x41, 0x10001):
        inside = c < 0x10000 and unicodedata.category(chr(c)) in kinds
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


_CAPITALS = _ranges(("Lu", "Lt"))  # of any script that has them
_B = r"[ \t\xa0\r\n]"  # a blank inside an entity


def _name_forms() -> frozenset[str]:
    """Case forms of the given names, by rule, lower-case."""
    out = set()
    for n in GIVEN_NAMES:
        n = n.lower()
        out.add(n)
        if n.endswith("a"):
            stem = n[:-1]
            out |= {stem + e for e in ("y", "i", "ie", "ę", "ą", "o", "ii", "ji")}
            if stem.endswith(("r", "t", "d", "ł")):
                out |= {stem[:-1] + {"r": "rze", "t": "cie", "d": "dzie", "ł": "le"}[stem[-1]]}
            if stem.endswith("k"):
                out.add(stem[:-1] + "ce")
        else:
            stem = {"ek": n[:-2] + "k", "eł": n[:-2] + "ł", "ei": n}.get(n[-2:], n)
            out |= {stem + e for e in ("a", "owi", "em", "iem", "ie", "u")}
            if n.endswith("y"):
                out |= {n[:-1] + e for e in ("ego", "emu", "ym")}
            if n.endswith("i"):
                out |= {n + e for e in ("ego", "emu", "m")}
    plain = str.maketrans("ąćęłńóśźż", "acelnoszz")
    return frozenset(out | {n.translate(plain) for n in out} | {n.lower() for n in FOREIGN_NAMES})


_GIVEN = _name_forms()
_SURNAME = re.compile(r"(?:[^\W\d_]{2,}(?:sk|ck|zk)(?:i|a|iego|iej|iemu|im|ą|ich)|[^\W\d_]{2,}(?:owicz|ewicz|czyk|czak|iak|ński)(?:a|owi|em|iem)?)$", re.I)
_TITLE_WORD = re.compile(TITLES, re.I)
#: How titles start; a quick look before the pattern.
_TITLE_STARTS = tuple("mec adw apl prok prof dr mgr inż kom r. pr not hab radc sędz refer asesor profesor doktor magister świad pan pań herr frau fräu richt zeug recht ra mr ms miss sir judge justice witness doctor".split())
_TITLE_LEFT = re.compile(rf"(?:^|[^\w])(?:{TITLES}){_B}{{1,3}}$", re.I)
_CUE = {k: re.compile(v, re.I) for k, v in CUES.items()}

# ---------------------------------------------------------------- candidates


@dataclass
class Segment:
    """A typed span with the features of the whole span; ``value`` is the found value."""

    start: int
    end: int
    kind: str
    value: str
    features: list[str] = field(default_factory=list)
    score: float = 0.0


_AT = r"(?:@|[ \xa0]?[\[({][ \xa0]?(?:at|AT|At|małpa)[ \xa0]?[\])}][ \xa0]?)"
_DOT = r"(?:\.|[ \xa0]?[\[({][ \xa0]?(?:dot|DOT|Dot|kropka)[ \xa0]?[\])}][ \xa0]?)"
_EMAIL = re.compile(rf"(?<![\w.+%-])([A-Za-z0-9](?:[\w.+%-]*[A-Za-z0-9_+-])?)({_AT})([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*)(?![\w@])")
_DIGITS = re.compile(r"\d")
_SEP = r"[ \xa0.\-\n\t]"
_PHONE = re.compile(
    rf"(?<![\w/@])((?:\(?(?:\+|00){_SEP}?48\)?|\(?48\))?){_SEP}{{0,2}}(\(?\d\d\)?{_SEP}?\d{{3}}{_SEP}?\d\d{_SEP}?\d\d|\d{{3}}{_SEP}?\d{{3}}{_SEP}?\d{{3}})(?![\w/@]|[.,-]\d)"
)
_PESEL = re.compile(r"(?<![\w+/.,-])(\d{11}|\d{6}[ \xa0-]\d{5}|\d\d[ \xa0-]\d\d[ \xa0-]\d\d[ \xa0-]\d{5})(?![\w/]|[.,-]\d)")
_NIP = re.compile(r"(?<![\w+/.,-])(?:PL[ \xa0-]?)?(\d{10}|\d{3}([ \xa0-])\d{3}\2\d\d\2\d\d|\d{3}([ \xa0-])\d\d\3\d\d\3\d{3})(?![\w/]|[.,-]\d)")
_LONG = re.compile(r"\d(?:[ \xa0.()\n\t-]{0,2}\d){8,}")
_SIX = re.compile(r"(?<!\d)\d{3}(?:[ \xa0]?\d{3}|\d{4})(?![\d])")
_SERIES = re.compile(r"(?<![\w+/-])([A-Za-z]{2,3})[ \xa0-]?$")

_NUMBER = r"\d{1,4}[A-Za-z]?(?![\w.,-]?\d)(?!\w)"
_WORD = rf"[{_U}][\w'’-]*\.?"
_FLAT = rf"(?:{_B}?/{_B}?\d{{1,4}}\w?|{_B}+(?:m|lok|mieszk|app?)\.?{_B}*\d{{1,4}}\w?)?"
_TOWN = rf"(?:,?{_B}+\d\d-\d{{3}}(?:{_B}+[{_U}][\w-]+(?:{_B}+[{_U}][{_L}]+)?)?)?"
_ADDRESS = re.compile(rf"(?<![\w])({STREET_WORDS}){_B}{{0,3}}((?:\d{{1,2}}{_B})?{_WORD}(?:{_B}+(?:{_WORD}|[a-z]{{1,3}}(?={_B}+[{_U}]))){{0,3}}){_B}+({_NUMBER}){_FLAT}{_TOWN}")
_BARE = re.compile(rf"(?<![\w.-])({_WORD}(?:{_B}+{_WORD}){{0,3}}){_B}+({_NUMBER})({_FLAT})(,{_B}+(?:\d\d-\d{{3}}|\d{{5}}){_B}+[{_U}][\w-]+(?:{_B}+[{_U}][{_L}]+)?)?")
_BARE_HINT = re.compile(r"\d[A-Za-z]?(?:,?\s+(?:m|lok|mieszk|app?)\.?\s*\d|,\s+\d\d-\d{3}\s|,\s+\d{5}\s+[A-Z])")
_BARE_CUE = re.compile(r"[kK]ierowa[^\s:]*:?|[aA]dres[^:\n]{0,24}:|[zZ]am\.|[zZ]amieszka\w+|Zustellung an|(?:straße|strasse|weg|gasse|platz|allee)\s+\d")
#: Literals of the patterns: where none occurs, the pattern need not run.
_HAS_CUE = ("ierowa", "dres", "am.", "amieszka", "Zustellung", "straße", "strasse", "weg ", "gasse", "platz", "allee")
_HAS_STREET = ("ul.", "Ul.", "UL.", "uL.", "al.", "Al.", "AL.", "pl.", "Pl.", "PL.", "os.", "Os.", "OS.", "skw.", "ron.", "Skw.", "Ron.", "ulic", "Ulic", "ULICA", "alej", "Alej", "plac", "Plac", "siedl", "kwer")
_HAS_ENGLISH = ("Street", "Road", "Lane", "Avenue", "Square", "Drive", "Close", "Court", "Terrace", "Way", "St.", "Rd.")
_GERMAN = re.compile(r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring)$")
_ENGLISH = re.compile(rf"(?<![\w.,/-])(\d{{1,4}}[A-Za-z]?){_B}+((?:[{_U}][\w'’-]*{_B}+){{1,3}}(?:Street|Road|Lane|Avenue|Square|Drive|Close|Court|Terrace|Way|St\.|Rd\.))(?!\w)")
#: Where a capitalised run can start a name: two capitals in a row, or one after a title's end.
_ONE = rf"[{_CAPITALS}](?:\.|[\w'’ʼ]+(?:-[{_CAPITALS}][\w'’ʼ]+)?)"
_NAMES = re.compile(rf"(?<![\w@.+_-]){_ONE}(?:{_B}+{_ONE})*(?![\w@])")
_PARTS = re.compile(_ONE)
_ROMAN = re.compile("[IVXLCDM]+")
_SPACES = re.compile(rf"{_B}+")


def pesel_ok(d: str) -> bool:
    return len(d) == 11 and sum(int(a) * b for a, b in zip(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1))) % 10 == 0


def nip_ok(d: str) -> bool:
    return len(d) == 10 and sum(int(a) * b for a, b in zip(d, (6, 5, 7, 2, 3, 4, 5, 6, 7))) % 11 == int(d[9])


def card_ok(s: str) -> bool:
    v = [ord(c) - 55 if c.isalpha() else int(c) for c in s]
    return sum(a * b for a, b in zip(v, (7, 3, 1, 9, 7, 3, 1, 7, 3))) % 10 == 0


def _left_cues(text: str, start: int, width: int = 34) -> list[str]:
    """Cues left of a span, no further than the sentence before; the nearest is marked."""
    left = text[max(0, start - width) : start]
    out, near = [], ("", -1)
    for k, rx in _CUE.items():
        at = -1
        for m in rx.finditer(left):
            at = m.start()
        if at >= 0:
            out.append(f"cue:{k}")
            if at > near[1]:
                near = (k, at)
    if near[0]:
        out.append(f"near:{near[0]}")
    return out


def candidates(text: str, weights: dict[str, float] | None = None) -> list[Segment]:
    """Every segment the field may choose from; bounded in length, overlapping each other freely.

    With ``weights``, names that could not be chosen under them are left out.
    """
    out: list[Segment] = []
    lower_at = "@" in text or "at]" in text or "at)" in text or "AT]" in text or "AT)" in text or "małpa" in text
    if lower_at:
        for m in _EMAIL.finditer(text):
            local, at, domain = m.groups()
            plain = re.sub(rf"{_DOT}", ".", domain)
            labels = plain.split(".")
            f = ["bias", "tld" if labels[-1].isalpha() and len(labels[-1]) > 1 else "no_tld", "dotted" if len(labels) > 1 else "flat_domain"]
            if at != "@":
                f.append("spelled")
            out.append(Segment(m.start(), m.end(), "email", f"{local}@{plain}".lower(), f))
    if _DIGITS.search(text):
        _numbers(text, out)
        _addresses(text, out)
    _names(text, out, weights)
    return out


def _numbers(text: str, out: list[Segment]) -> None:
    for run in _LONG.finditer(text):
        a, z = max(0, run.start() - 6), run.end() + 12
        for m in _PHONE.finditer(text, a, z):
            prefix, number = m.groups()
            national = re.sub(r"\D", "", number)
            start = m.start() if prefix else m.start(2)
            right = text[m.end() : m.end() + 8]
            f = ["bias", *(["prefix"] if prefix else []), *_left_cues(text, start)]
            f.append("solid" if number.isdigit() else "dotted" if "." in number else "dashed" if "-" in number else "spaced")
            if re.match(r"(?:,\d\d)?\s?(?:zł|PLN|euro|EUR|USD|€)", right):
                f.append("money_right")
            if re.match(r"[ \xa0]\d{3,4}\b", right) or re.search(r"\d[ \xa0.]$", text[max(0, start - 2) : start]):
                f.append("more_digits")
            if national[0] == "0":
                f.append("zero")
            out.append(Segment(start, m.end(), "phone", national, f))
        for kind, rx, ok in (("pesel", _PESEL, pesel_ok), ("nip", _NIP, nip_ok)):
            for m in rx.finditer(text, a, z):
                d = re.sub(r"\D", "", m.group(1))
                if not ok(d):  # only with a right check digit
                    continue
                f = [kind, *_left_cues(text, m.start())]
                if re.match(r"[ \xa0]\d{3,}", text[m.end() : m.end() + 6]) or re.search(r"\d[ \xa0]$", text[max(0, m.start() - 2) : m.start()]):
                    f.append("more_digits")
                out.append(Segment(m.start(), m.end(), "identity", d, f))
    for m in _SIX.finditer(text):
        before = text[max(0, m.start() - 5) : m.start()]
        if not (before[-1:].isalpha() or before[-2:-1].isalpha() and before[-1:] in " \xa0-") or not (series := _SERIES.search(before)):
            continue
        letters, digits = series.group(1), m.group().replace(" ", "").replace("\xa0", "")
        if len(letters) + len(digits) != 9 or (len(letters) == 2) != (len(digits) == 7) or re.match(r"[\w/]|[.,-]\d", text[m.end() : m.end() + 2]):
            continue
        kind, value = "card" if len(letters) == 3 else "pass", letters.upper() + digits
        start = m.start() - len(series.group())
        f = [kind, *_left_cues(text, start), "upper" if letters.isupper() else "lower" if letters.islower() else "mixed"]
        if letters.upper() in COUNTRY_NOT_SERIES:
            f.append("no_series")
        if kind == "card" and card_ok(value):
            f.append("card_ok")
        if re.match(r"\s?(?:zł|PLN|euro|EUR)|[ \xa0]\d", text[m.end() : m.end() + 6]):
            f.append("money_right")
        out.append(Segment(start, m.end(), "identity", value, f))


def _tidy(s: str) -> str:
    return _SPACES.sub(" ", s)


def _has(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


def _addresses(text: str, out: list[Segment]) -> None:
    for m in _ADDRESS.finditer(text) if _has(text, _HAS_STREET) else ():
        f = ["bias", "street_word", *_left_cues(text, m.start())]
        if re.search(r"\d\d-\d{3}", text[m.end(3) : m.end()]) or re.search(r"\d\d-\d{3}", text[max(0, m.start() - 30) : m.start()]):
            f.append("postal")
        out.append(Segment(m.start(), m.end(), "address", f"{_tidy(m.group(2))} {m.group(3)}", f))
    # without a street word: the name stands within 70 characters of a flat or postal code, or after a cue
    windows = [(max(0, h.start() - 70), h.end()) for h in _BARE_HINT.finditer(text)]
    if _has(text, _HAS_CUE):
        windows += [(max(0, h.start() - 30), h.end() + 90) for h in _BARE_CUE.finditer(text)]
    seen = set()
    for lo, hi in windows:
        for m in _BARE.finditer(text, lo, hi + 120):
            if m.start(2) > hi:
                break
            if m.start(2) not in seen:
                seen.add(m.start(2))
                _bare(text, m, out)
    for m in _ENGLISH.finditer(text) if _has(text, _HAS_ENGLISH) else ():
        f = ["bias", "english", *_left_cues(text, m.start())]
        out.append(Segment(m.start(), m.end(), "address", f"{_tidy(m.group(2))} {m.group(1)}", f))


def _bare(text: str, m: re.Match, out: list[Segment]) -> None:
    words, number, flat, town = m.groups()
    parts = words.split()
    german = bool(_GERMAN.search(parts[-1].lower())) or parts[0] in ("Am", "An", "Auf", "Im", "Zum", "Zur")
    if not (re.search("[a-z]", flat) or town or german) and "near:addr" not in _left_cues(text, m.start()):
        return
    for k in range(len(parts)):  # the street name may start at any of the words
        if parts[k].endswith(".") or not any(len(w) > 2 and w[1:].islower() for w in parts[k:]):
            continue  # an abbreviation opens no street name, and a case signature is none
        start = m.start() if not k else m.start() + len(re.match(rf"(?:\S+{_B}+){{{k}}}", words).group())
        name = _tidy(text[start : m.end(1)])
        f = ["bias", "bare", *_left_cues(text, start), *(["postal"] if town else []), *(["flat"] if flat.strip() else []), *(["german"] if german else [])]
        if k and german:
            f.append("cut_words")
        if parts[k].lower() in NOT_NAMES:
            f.append("not_name")
        if k:
            f.append("later_start")
        if any(len(w) < 3 or w.isupper() for w in parts[k:]):
            f.append("caps_word")
        out.append(Segment(start, m.end(), "address", f"{name} {number}", f))


@lru_cache(1 << 16)
def _mark(word: str) -> str:
    """What a capitalised word looks like: on a list, of a form, or none of these ('other')."""
    bare = word.rstrip(".")
    low = bare.lower()
    if word.endswith("."):
        return "initial"
    if low in NOT_NAMES:
        return "stop"
    if low in _GIVEN:
        return "given"
    if _TITLE_WORD.fullmatch(word):
        return "title"
    if _ROMAN.fullmatch(bare):
        return "roman"
    capitals = sum(c.isupper() for c in bare)
    if len(bare) < 3 or len(bare) < 5 and capitals > 1:
        return "abbr"
    if any(c.isdigit() or c == "_" for c in bare) or 1 + bare.count("-") < capitals < len(bare) - bare.count("-") and "'" not in bare and "’" not in bare and not bare.startswith("Mc"):
        return "odd"
    if _SURNAME.search(bare.split("-")[-1]):
        return "surname"
    return "caps" if bare.isupper() else "other"


@lru_cache(1 << 16)
def _word_features(word: str) -> tuple[str, ...]:
    """Features of a word that no list and no form tells about."""
    if _mark(word) not in ("other", "caps"):
        return ()
    low = word.lower()
    script = "latin" if low[0] < "\u0250" else "cyrillic" if "\u0400" <= low[0] < "\u0530" else "script"
    return (f"w:{low}", f"end3:{low[-3:]}", f"end2:{low[-2:]}", f"script:{script}")


def _titled(text: str, start: int) -> bool:
    """Whether a title stands right before; the last word's first letters decide most cases."""
    left = text[max(0, start - 24) : start]
    word = left.split()[-1:] if left[-1:].isspace() else []
    return bool(word) and word[0].lower().startswith(_TITLE_STARTS) and bool(_TITLE_LEFT.search(left))


_LEFT_WORD = re.compile(rf"([^\W\d_]+){_B}+$")
_RIGHT_WORD = re.compile(rf"{_B}+([^\W\d_]+)")
_OPENS = re.compile(r"(?:^|[.!?\n]\s{0,2})$")  # a sentence starts here
_LEFT_SIGN = re.compile(r"(\S)\s*$")
_RIGHT_SIGN = re.compile(r"\s*(\S)")


def _around(text: str, start: int, end: int) -> list[str]:
    """Features of what stands beside a span: the words, their ends, and the signs."""
    left, right = text[max(0, start - 24) : start], text[end : end + 24]
    f = []
    if m := _LEFT_WORD.search(left):
        w = m.group(1)
        f += [f"l:{w.lower()}", f"lend:{w[-2:].lower()}", "lword"] if w[0].islower() else ["lcap"]
    else:
        sign = _LEFT_SIGN.search(left)
        f.append(f"lsign:{sign.group(1) if sign else 'none'}")
    if "\n" in left[-2:]:
        f.append("line_left")
    if m := _RIGHT_WORD.match(right):
        w = m.group(1)
        f += [f"r:{w.lower()}", f"rend:{w[-2:].lower()}", f"rlast:{w[-1].lower()}", "rword"] if w[0].islower() else ["rcap"]
    else:
        sign = _RIGHT_SIGN.match(right)
        f.append(f"rsign:{sign.group(1) if sign else 'none'}")
    if right[:1] == "\n":
        f.append("line_right")
    return f


@lru_cache(1 << 16)
def _inner(shape: tuple[str, ...], words: tuple[str, ...]) -> tuple[str, ...]:
    return ("bias", f"shape:{'+'.join(shape)}", *(f"has:{m}" for m in sorted(set(shape))), *(x for w in words for x in _word_features(w)))


def _names(text: str, out: list[Segment], weights: dict[str, float] | None = None) -> None:
    """Every run of one to three capitalised words, of any script, is a candidate; one word alone only after a title.

    With ``weights``, spans that cannot score above zero whatever stands around them are left out, which
    changes no result.
    """
    most = _most_around(weights) if weights is not None else 0.0
    for run in _NAMES.finditer(text):
        s = run.group()
        if len(s) < 3:
            continue
        title = None
        if " " not in s and len(_SPACES.split(s)) == 1 and "." not in s:
            title = _titled(text, run.start())
            if not title:
                continue
        parts = [(p.start() + run.start(), p.end() + run.start(), p.group()) for p in _PARTS.finditer(s)]
        marks = [_mark(w) for _, _, w in parts]
        n = len(parts)
        opens = bool(_OPENS.search(text, max(0, run.start() - 3), run.start()))
        for i in range(n):
            if i == 0 and title is None:
                title = _titled(text, run.start())
            before = title if i == 0 else marks[i - 1] == "title"
            for j in range(i, min(n, i + 3)):
                shape = marks[i : j + 1]
                if "title" in shape or j == i and not before:  # a surname alone counts after a title only
                    continue
                f = _inner(tuple(shape), tuple(w for _, _, w in parts[i : j + 1]))
                if weights is not None and most + _sum_of("name", f, weights) <= 0:
                    continue
                start, end = parts[i][0], parts[j][1]
                f = [*f]
                if before:
                    f.append("title")
                    if j == i:
                        f.append("title_single")
                if i and not before:
                    f.append(f"cut_left:{marks[i - 1]}")
                if j > i and opens:
                    f.append("opens" if i == 0 else "after_opening" if i == 1 else "later")
                if j < n - 1:
                    f.append(f"cut_right:{marks[j + 1]}")
                    if "\n" in text[end : parts[j + 1][0]]:
                        f.append("cut_at_line")
                f += [f"line:{j - i + 1}:{marks[k]}" for k in range(i + 1, j + 1) if "\n" in text[parts[k - 1][1] : parts[k][0]]]
                if "cue:name" in _left_cues(text, start, 40):
                    f.append("cue:name")
                if re.search(rf"(?:{STREET_WORDS}){_B}*$", text[max(0, start - 10) : start]):
                    f.append("street_left")
                if re.match(rf"{_B}+\d", text[end : end + 4]):
                    f.append("number_right")
                if any(w.isupper() and len(w) > 2 for _, _, w in parts[i : j + 1]):
                    f.append("caps")
                f += _around(text, start, end)
                out.append(Segment(start, end, "name", _tidy(text[start:end]), f))


#: Features of a name's surroundings that can stand together, by what they start with.
_AROUND = ("cut_at_line", "line:", "title", "title_single", "cut_left:", "cut_right:", "cue:name", "street_left", "number_right", "caps", "opens", "after_opening", "later", "l:", "lend:", "lword", "lcap", "lsign:", "line_left", "r:", "rend:", "rlast:", "rword", "rcap", "rsign:", "line_right")
_bounds: dict[int, tuple[dict, float]] = {}


def _most_around(weights: dict[str, float]) -> float:
    """The most that a name's surroundings can add: of each group of features the greatest weight."""
    if id(weights) not in _bounds or _bounds[id(weights)][0] is not weights:
        best = dict.fromkeys(_AROUND, 0.0)
        for k, v in weights.items():
            kind, _, f = k.partition("|")
            for g in _AROUND:
                if kind == "name" and (f.startswith(g) if g.endswith(":") and g != "cue:name" else f == g):
                    best[g] = max(best[g], v)
        _bounds[id(weights)] = (weights, sum(best.values()))
    return _bounds[id(weights)][1]


# ---------------------------------------------------------------- decoding


def _sum_of(kind: str, features: Iterable[str], weights: dict[str, float]) -> float:
    return sum(weights.get(f"{kind}|{f}", 0.0) for f in features)


def score(segment: Segment, weights: dict[str, float]) -> float:
    return _sum_of(segment.kind, segment.features, weights)


def best_segments(segments: list[Segment]) -> list[Segment]:
    """The non-overlapping set of greatest total score; outside text scores 0, so only gains are kept.

    Viterbi over end points: best[e] is the best total of segments that end by e.  Ties go to fewer
    segments, then to the earlier start.
    """
    use = sorted((s for s in segments if s.score > 0), key=lambda s: (s.end, s.start))
    if len(use) < 2:
        return use
    ends = [s.end for s in use]
    best: list[float] = [0.0]
    step: list[tuple[int, bool]] = []
    for k, s in enumerate(use):
        before = bisect_right(ends, s.start, 0, k)
        take = best[before] + s.score
        if take > best[k]:
            best.append(take)
            step.append((before, True))
        else:
            best.append(best[k])
            step.append((k, False))
    chosen, k = [], len(use)
    while k:
        to, took = step[k - 1]
        if took:
            chosen.append(use[k - 1])
        k = to
    return chosen[::-1]


def find(text: str, weights: dict[str, float] = WEIGHTS) -> list[Segment]:
    """Findings of one text, left to right."""
    found = candidates(text, weights)
    for s in found:
        s.score = score(s, weights)
    return best_segments(found)


def _covered(text: str, found: list[Segment]) -> str:
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def mask(text: str) -> str:
    """The text with a typed placeholder in place of each finding; everything else unchanged.

    What a placeholder lets come to light is masked too, so a masked text has no findings.
    """
    while found := find(text):
        text = _covered(text, found)
    return text


# ---------------------------------------------------------------- messages

#: The fields of message events that hold ids, names of files and other fixed words.
_NO_TEXT = re.compile(r"^(?:type|status|author_role|.*_?id|.*filename|name|kind|.*_at)$")


def message_strings(value) -> list[str]:
    """Free-text strings of decoded content; the text of adjoining content events is one string."""
    out: list[str] = []
    stack: list[tuple] = [("", value)]
    while stack:
        key, v = stack.pop()
        if isinstance(v, str):
            if not _NO_TEXT.match(key):
                out.append(v)
        elif isinstance(v, dict):
            stack.extend(reversed(v.items()))
        elif isinstance(v, list):
            merged: list = []
            for x in v:
                if isinstance(x, dict) and x.get("type") == "content" and isinstance(x.get("text"), str) and merged and isinstance(merged[-1], dict) and merged[-1].get("type") == "content" and isinstance(merged[-1].get("text"), str):
                    merged[-1] = {**merged[-1], "text": merged[-1]["text"] + x["text"]}
                else:
                    merged.append(x)
            stack.extend((key, x) for x in reversed(merged))
    return out


def find_in_content(content: str, is_message: bool) -> list[Segment]:
    if not is_message:
        return find(content)
    kind, v = decode(content)
    if kind == "json":
        return [s for t in message_strings(v) for s in find(t)]
    return find(content)


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s"\[\]{},:]+', re.S)

#: (start, end, decoded value) of a string literal.
Literal = tuple[int, int, str]


def _literal_runs(raw: str) -> list[list[Literal]]:
    """Free-text string literals of JSON text; those that message_strings() reads as one string stand together."""
    runs: list[list[Literal]] = []
    stack: list[dict] = []  # open lists and objects

    def alone(x: Literal | None, key: str) -> None:
        if x is not None and not _NO_TEXT.match(key):
            runs.append([x])

    def value(x: Literal | None) -> str:
        """Note a value, None if it is no string, in what is open; the key it stands under."""
        if not stack:
            return ""
        top = stack[-1]
        if top["list"]:
            if x is not None or not top["object"]:
                top["run"] = None
            alone(x, top["key"])
            return top["key"]
        name = top["name"]
        if name in ("type", "text"):  # known at the end of the object; of repeated keys the last holds
            alone(top.get(name), name)
            top[name] = x
        else:
            alone(x, name)
        return name

    for m in _TOKEN.finditer(raw):
        t = m.group()
        if t in "{[":
            if stack:
                stack[-1]["object"] = t == "{"
            key = value(None)
            stack.append({"list": t == "[", "key": key, "name": None, "run": None, "object": False})
        elif t in "}]":
            top = stack.pop()
            if top["list"]:
                continue
            kind, text = top.get("type"), top.get("text")
            up = stack[-1] if stack and stack[-1]["list"] else None
            if up and kind and text and kind[2] == "content":
                if up["run"] is None:
                    runs.append([])
                    up["run"] = runs[-1]
                up["run"].append(text)
            else:
                if up:
                    up["run"] = None
                alone(text, "text")
        elif t == ",":
            if stack:
                stack[-1]["name"] = None
        elif t != ":":
            literal = (m.start(), m.end(), json.loads(t)) if t[0] == '"' else None
            if stack and not stack[-1]["list"] and stack[-1]["name"] is None:
                stack[-1]["name"] = literal[2]
            else:
                if stack:
                    stack[-1]["object"] = False
                value(literal)
    return runs


def _mask_run(run: list[Literal]) -> list[str]:
    """Masked texts of the literals of one string; a finding over several gets its placeholder in the first."""
    found = find("".join(x[2] for x in run))
    out, at = [], 0
    for _, _, text in run:
        end, done, parts = at + len(text), at, []
        for s in found:
            if s.start < end and s.end > at:
                parts += [text[done - at : max(s.start, done) - at], f"[{s.kind.upper()}]" if s.start >= at else ""]
                done = min(s.end, end)
        out.append("".join([*parts, text[done - at :]]))
        at = end
    return out


def mask_content(content: str, is_message: bool) -> str:
    """Masked text of a message: plain text as a whole, JSON by the strings of message_strings() with its layout kept."""
    kind, v = decode(content) if is_message else ("plain", None)
    if kind != "json":
        return mask(content)
    while any(map(find, message_strings(v))):  # most messages have none, and need no second look at their layout
        masked = _mask_json(content)
        if masked == content:
            break
        content, v = masked, decode(masked)[1]
    return content


def _mask_json(raw: str) -> str:
    """Mask the string literals of JSON text in place; a literal that changes is written again.

    The findings are those of the strings that message_strings() gives, so one that adjoining content
    events share is masked in each of them.
    """
    outer = raw.strip(" \t\r\n\ufeff")
    if outer[:1] == '"':
        inner = _mask_json(json.loads(outer))
        head = raw.index('"')
        return raw[:head] + json.dumps(inner, ensure_ascii=outer.isascii()) + raw[head + len(outer) :]
    new = {(x[0], x[1]): text for run in _literal_runs(raw) for x, text in zip(run, _mask_run(run)) if text != x[2]}
    out, at = [], 0
    for start, end in sorted(new):
        out += [raw[at:start], json.dumps(new[start, end], ensure_ascii=raw[start:end].isascii())]
        at = end
    return "".join([*out, raw[at:]])


# ---------------------------------------------------------------- Spark plans


def find_pii(df: DataFrame, src: str, id_col: str, text_col: str, is_message: bool = False) -> DataFrame:
    """(src, row_id, kind, found_value): the distinct findings of each row.

    Null and blank texts have none.  Rows that repeat an id and text give the same findings; the
    result is distinct.
    """
    rows = spread(df.select(clean_id(id_col).alias("row_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL"))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, kinds, values = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, value in dict.fromkeys((s.kind, s.value) for s in find_in_content(t, is_message)):
                    ids.append(i)
                    kinds.append(kind)
                    values.append(value.encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (ids, kinds, values)], ["row_id", "kind", "found_value"])

    found = rows.mapInArrow(run, "row_id string, kind string, found_value string").distinct()
    return found.select(F.lit(src).alias("src"), "row_id", "kind", "found_value")


def mask_pii(df: DataFrame, id_col: str, text_col: str, out_col: str, is_message: bool = False) -> DataFrame:
    """(id, out_col): the text of each row with its findings replaced; null stays null."""
    rows = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            masked = [t if t is None else mask_content(t, is_message) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(masked, pa.string())], ["_id", out_col])

    return rows.mapInArrow(run, f"_id {kind}, `{out_col}` string").withColumnRenamed("_id", id_col)


def count_leaks(masked: DataFrame, text_col: str, is_message: bool = False) -> DataFrame:
    """(rows, leaks): texts of a masked column that are not null, and the findings still in them; 0 is expected."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            left = sum(len(find_in_content(t, is_message)) for t in b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([left], pa.int64())], ["rows", "leaks"])

    per = masked.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "rows bigint, leaks bigint")
    return per.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks"))
