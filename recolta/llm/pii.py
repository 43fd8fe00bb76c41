"""Personal information in free text (problem 6).

Regular expressions propose spans. Checksums (Luhn, mod 97, the letter of mod 23) confirm or weaken
a proposal, and context words before and after it raise or lower its score; what reaches the
threshold is reported and replaced by a typed placeholder such as [PHONE]. Of overlapping spans the
one of higher score, then the longer one, stays.

Texts are read in their consistent visual form, so that full-width digits or hidden characters
don't shield a number; positions and replacements refer to the text as stored.

Types: email, phone, id_number (passport, identity card, tax, social security, driving licence),
address (street with house number), name (given and family name). Card and bank account numbers are
replaced too, under the types card and iban.

Defined cases: null texts, null captions and null lists have no findings and stay null; empty texts
stay empty; equal captions are each reported; long texts are searched to their end; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recolta.llm.bpe import VOCABULARIES
from recolta.llm.visual_form import tables

#: Score from which a span is reported.
LEAST_SCORE = 0.5
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 42, 24

# Common given names of the seven languages.
GIVEN_NAMES = """
Aaron Adam Adrian Alan Albert Alejandro Alessandro Alex Alexander Alexandra Alfonso Alice Amelia Ana Andrea Andreas Andrew André Angela Anke Anna Anne Annika Anton Antonio António Arthur Barbara Bas Beatriz Benjamin Bernd Birgit Björn Brian Bruno
Camille Carla Carlos Carmen Caroline Charles Charlotte Chiara Chloé Chris Christian Christine Claire Clara Claudia Daan Daniel Daniela David Diana Diego Dieter Dirk Eduardo Elena Elisabeth Elizabeth Ella Emil Emily Emma Eric Erik Eva
Federico Felix Fernando Florian Francesca Francesco Francisco Frank François Françoise Freya Gabriel George Giorgio Giovanni Giulia Greta Günther Hannah Hans Heike Heinz Helen Helena Hélène Henrik Henry Hugo Inés Ines Ingrid Isabel Ivan
Jack James Jan Jane Javier Jean Jeroen João Johan Johannes John Jonas José Juan Julia Julien Jürgen Karen Karin Karl Kevin Klaus Laura Lena Leon Linda Lisa Lorenzo Louise Luca Lucas Lucía Luis Luís Lukas Manuel Marco Maria María Marie Mario Mark Markus Marta Martin Mary Mateo Matteo Max Michael Miguel Mónica Monika
Nadia Nicolas Nina Nora Núria Oliver Olivia Oscar Pablo Paolo Patricia Paul Paula Pedro Peter Petra Philippe Pierre Rachel Raúl Ricardo Richard Robert Rosa Rui Ruth Sabine Sander Sandra Sara Sarah Sean Silvia Simon Sofia Sophie Søren Stefan Susanne Sven Thomas Tiago Tim Tina Tom Ulrich Ursula Victor Walter Wanda William Willem Wolfgang Yvonne Zoë
"""
# What a document that identifies a person is called, and what other numbers are called.
_ID_WORDS = (
    r"passports?|passeports?|pasaportes?|passaport[eio]|paspoort(?:nummer)?|reisepass|personalausweis[^\W_]*|ausweis(?:nummer|nr)?|ssn|social security|sécurité sociale|seguridad social|segurança social|sozialversicherungs[^\W_]*|"
    r"ni number|nino|national insurance|national id|identity (?:card|number|document)|id card|id number|carte (?:nationale )?d.identité|carta d.identità|documento de identidad|identiteitskaart|dni|nie|nif|nir|cpf|bsn|burgerservicenummer|"
    r"steuer-?id[^\W_]*|steuernummer|tax (?:id|number|no|identification)[^\W_]*|taxpayer|tin|itin|numéro fiscal|identificación fiscal|codice fiscale|driver.?s? licen[cs]e|driving licen[cs]e|führerschein[^\W_]*|permis de conduire|permiso de conducir|patente di guida|carta de condução|rijbewijs[^\W_]*"
)
_OTHER_NUMBERS = r"isbn|issn|ean|sku|order|orders|invoice|rechnung|facture|factura|fattura|fatura|factuur|tracking|parcel|colis|sendung[^\W_]*|build|version|v|port|ticket|request|incident|ref|reference|rows|status|error|serial|batch|model|commit|bestellung|bestelnummer|commande|pedido|ordine|encomenda|room|page"
_PHONE_WORDS = r"call|phone|tel|telephone|telefon[^\W_]*|téléphone|teléfono|telefono|telefone|telefoon[^\W_]*|mobile|mobil|móvil|cell|handy|portable|text me|sms|whatsapp|ring|fax|(?:new|phone|mobile|cell|neue|nuevo|nouveau|novo|nuovo|nieuwe?|mobil[^\W_]*) (?:number|nummer|numéro|número|numero)|(?:número|numero|numéro) (?:nuevo|nouveau|novo|nuovo)|anrufen|erreich[^\W_]*|appel[^\W_]*|llam[^\W_]*|chiam[^\W_]*|ligue|ligar|bel|reach me|dial"
_NAME_WORDS = r"form says|name|badge|card of|addressed to|label|signed|contact|kontakt|contacto|met|ask|fragt|pregunta|booked under|talk by|thanks to|belongs to|reading|dear|mr|mrs|ms|dr|herr|frau|madame|monsieur|señora?|sr|sra|deliver[^\W_]*|for|by"


def _near(words: str) -> re.Pattern:
    return re.compile(rf"(?<![^\W_])(?:{words})(?![^\W_])", re.IGNORECASE)


IS_ID, IS_OTHER, IS_PHONE, IS_NAME = map(_near, (_ID_WORDS, _OTHER_NUMBERS, _PHONE_WORDS, _NAME_WORDS))

#: Every pattern takes time in proportion to the text: repetitions have one way to match or are possessive, and a run of characters
#: is entered at its start only. A local part has at most eight spelled-out dots.
_SPELLED = r"\s?[(\[{]\s?(?:dot|punkt|punto|point)\s?[)\]}]\s?"
_DOT = rf"(?:\.|{_SPELLED})"
_LABEL = r"(?>[^\W_]+(?:[_-]+[^\W_]+)*)"
EMAIL = re.compile(
    rf"(?<![\w@.+%-])[\w+%-][\w.+%-]*+(?:{_SPELLED}(?=\w)[\w.+%-]++){{0,8}}(?:\s?@\s?|\s?[(\[{{]\s?(?:at|arroba|ät|chez)\s?[)\]}}]\s?){_LABEL}(?:{_DOT}{_LABEL})+"
    rf"|(?<![\w@.+%-])[\w+%-][\w.+%-]*+\s(?:at|AT)\s[\w-]++(?:\s(?:dot|DOT)\s[\w-]++)+",
)
NUMBER = re.compile(r"(?<![\w.,/+-])(?:\+|\(\+?)?\d+(?:[ \t.\-/()]{1,4}\d+)*(?![\w]|[.,]\d|-\d)")
NANP = re.compile(r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}")
SSN = re.compile(r"(?<![\w.-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")
NI = re.compile(r"(?<!\w)[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D](?!\w)", re.IGNORECASE)
SPANISH = re.compile(r"(?<!\w)(?:[XYZ][ -]?\d{7}|\d{8})[ -]?[A-Z](?!\w)", re.IGNORECASE)
ITALIAN = re.compile(r"(?<!\w)[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z](?!\w)", re.IGNORECASE)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
AFTER_ID = re.compile(
    rf"(?<![^\W_])(?:{_ID_WORDS})(?![^\W_])[\s-]*+(?:(?:number|nummer|numéro|número|numero|card|núm|num|no|nr|n)(?![^\W_])\s*+)?[.°º:#]{{0,2}}+\s*+(?:(?:is|ist|est|es|è|é|lautet)\s++:?\s*+)?((?:[A-Z]{{1,4}}[ -]?)?\d(?:[A-Z\d]|[ ./-]{{1,2}}(?=[A-Z]?\d)|[ -](?=[A-Z](?![^\W_]))){{3,24}})(?![^\W_])",
    re.IGNORECASE,
)
_UP, _ANY = "[A-ZÀ-ÖØ-Þ]", r"[\w'’.-]"
_UNIT = r"(?!(?:minutes?|min|hours?|days?|seconds?|people|miles?|km|files?|times?|years?|weeks?|months?)\b)"
ADDRESSES = [
    re.compile(rf"(?<![\w/.-])\d{{1,5}}[A-Za-z]?,? (?:{_UNIT}{_UP}{_ANY}* ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Close|Way|Place|Pl|Boulevard|Blvd|Square|Sq|Terrace|Crescent|Row|Mews|Parkway|Pkwy|Highway|Hwy|Alley|Walk|Grove|Gardens|STREET|ST|AVENUE|AVE|ROAD|RD|LANE|DRIVE|COURT|CT)\b\.?(?:,? (?:Apt|Flat|Unit|Suite|Apartment)\.? ?\w{{1,4}}\b)?"),
    re.compile(rf"(?<![\w/.-])\d{{1,5}}[a-z]?,? (?:{_UNIT}[\w'’-]+ ){{1,2}}(?:street|avenue|ave|road|rd|lane|court|boulevard|blvd)\b\.?(?=\s*(?:,|$|\n))", re.IGNORECASE),
    re.compile(r"(?<!\w)(?:[A-ZÄÖÜ][\wäöüß]+e[rs]? |Am |An der |Im |Zum |Zur )(?:Straße|Strasse|Str\.|Weg|Platz|Allee|Gasse|Ring|Ufer|Damm)[ ,]{1,2}\d{1,4}(?: ?[a-z])?\b"),
    re.compile(r"(?<!\w)[a-zäöü]{3,}(?:straße|strasse|str\.) \d{1,4} ?[a-z]?\b"),
    re.compile(rf"(?<![\w/.-])\d{{1,4}}(?: ?(?:bis|ter|quater|[A-D]))?,? (?i:rue|avenue|av\.|boulevard|bd|chemin|place|impasse|allée|allee|route|quai|cours|square|passage|sentier)(?: (?i:de la|de l['’]|du|des|de|d['’]|la|le|les))? ?{_UP}{_ANY}*(?:[ -]{_UP}[\w'’-]+)*"),
    re.compile(rf"(?<![^\W_])(?:(?i:calle|avenida|avda\.?|plaza|paseo|camino|carretera|ronda|travesía|rua|travessa|largo|praça|estrada|alameda|via|viale|piazza|corso|vicolo|strada|vía)|C/|Av\.|AV\.|R\.|V\.le|P\.za|Ctra\.) ?(?:(?i:de|del|della|delle|dei|di|da|do|das|dos|la|las|los|el|lo|dal|dell['’]) ?){{0,3}}{_UP}[\w'’-]+(?: (?:(?:de|del|di|da|do|dos|y|e|la) )?{_UP}[\w'’-]+){{0,3}},? (?:(?:n|nº|n\.º|n\.|n°|núm|num|número|nr|no)\.? ?)?\d{{1,4}}(?: ?(?:bis|[A-Za-z]))?\b"),
]


def _ending(ends: str, number: str) -> re.Pattern:
    """A whole run of word characters with one of the ends, and a house number. The run is read once."""
    behind = "|".join(f"(?<={e})" for e in ends.split())
    return re.compile(rf"(?<![\w'’-])[\w'’-]++(?:{behind}){number}")


_COMPOUND = [
    _ending("straße strasse str STRASSE STR gasse allee platz weg ufer damm chaussee", r"(?:(?<=str)\.|(?<=STR)\.)?[ ,]{1,2}\d{1,4}(?: ?[a-zA-Z])?\b"),
    _ending("straat laan plein gracht kade dijk steeg singel STRAAT LAAN WEG", r"[ ,]{1,2}\d{1,4}(?:[ -]?[a-zA-Z])?\b"),
]
_CAPITAL = re.compile(r"(?<!\w)[A-ZÄÖÜ]")
# Words and word ends that make an address worth looking for.
_STREET_WORDS = frozenset(
    "st street ave avenue rd road ln lane dr drive ct court close way pl place blvd boulevard sq square terrace crescent row mews pkwy parkway hwy highway alley walk grove gardens "
    "strasse straße str weg platz allee gasse ring ufer damm am an im zum zur rue av bd chemin impasse allée route quai cours passage sentier c calle avda avenida plaza paseo camino carretera ctra ronda travesía "
    "rua r travessa largo praça estrada alameda via viale v piazza p corso vicolo strada vía".split()
)
_STREET_ENDS = ("straße", "strasse", "str", "gasse", "allee", "platz", "weg", "ufer", "damm", "chaussee", "straat", "laan", "plein", "gracht", "kade", "dijk", "steeg", "singel")
_WORD = re.compile(r"[^\W\d_]+")


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


@lru_cache(maxsize=1)
def _given() -> tuple[frozenset[str], re.Pattern, re.Pattern, re.Pattern]:
    names = GIVEN_NAMES.split()
    plain = ["".join(c for c in unicodedata.normalize("NFD", n) if not unicodedata.combining(c)) for n in names]
    every = sorted({*names, *plain}, key=lambda n: (-len(n), n))
    given = rf"(?:{'|'.join(every)})"
    family = rf"(?:(?:van der|van den|van de|van|von der|von|zu|de la|de los|del|della|di|da|dos|das|do|de|du|le|la|ter|ten|af|O['’]|Mc|Mac)[ ]?)?{_UP}(?=[\w'’]*[a-zà-ÿ])[\w'’]++(?:-{_UP}[\w'’]++)*+"
    middle = rf"(?:(?:{_UP}\.|{given}) ){{0,2}}"
    title = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Sr|Sra|Mme|M)\.? ){0,2}"
    straight = re.compile(rf"(?<![\w@#/.-])(?=[^\W\d_])({title})({given}(?:-{given})?) {middle}({family})(?![\w@])")
    reverse = re.compile(rf"(?<![\w@#/.-])(?=[^\W\d_])({family}), ({given}(?:-{given})?)(?: {_UP}\.)?(?![\w@])")
    small = re.compile(rf"(?<![\w@#/.-])(?=[^\W\d_])({given}) (?:[a-z]\.? )?([^\W\d_]{{3,}}+(?:-[^\W\d_]++)?+)(?![\w@])", re.IGNORECASE)
    return frozenset({*every, *(n.lower() for n in every), *(n.upper() for n in every)}), straight, reverse, small


# Capitalised words that follow a given name without being a family name, and small words.
_NO_FAMILY = frozenset("Mini Desk Cloud Notes Pro Street Avenue Road Lane Drive Court Square Park Station School Club Day And The Is Was Has Said Says In On At Of For With Digest Und Et Y E En Von Hat Ist War A I It He She They We You".split())
_SMALL = frozenset("and the is was has had said says in on at of for with from to by und hat ist war et est dans con para por por que y e en van het een che per non not but or so as if it he she they we you who are were will would can could when then than also just only".split())


@lru_cache(maxsize=1)
def _common_words() -> frozenset[str]:
    """Words that are single pieces of the public vocabularies: no family names as a rule."""
    words: set[str] = set()
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        with open(os.path.join(VOCABULARIES, name), "rb") as f:
            pieces = (base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in f)
            words.update(p[1:].lower() for p in pieces if len(p) > 3 and p[0] == " " and p[1:].isalpha())
    return frozenset(words)


def luhn(digits: str) -> bool:
    """Luhn checksum of a string of digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Mod-97 checksum of an international bank account number."""
    s = text.replace(" ", "").upper()
    return len(s) > 14 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def french_valid(digits: str) -> bool:
    """Mod-97 key of a French social security number of 13 + 2 digits."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def spanish_valid(text: str) -> bool:
    """Mod-23 letter of a Spanish DNI or NIE."""
    s = re.sub(r"[ -]", "", text).upper()
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == s[-1]


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - BEFORE) : start], text[end : end + AFTER]


def _last(pattern: re.Pattern, before: str) -> int:
    """Where the last context word before a span ends; -1 if there is none."""
    return max((m.end() for m in pattern.finditer(before)), default=-1)


def _emails(text: str) -> Iterator[Finding]:
    for m in EMAIL.finditer(text):
        tail = re.split(r"[.\s)\]}]+", m[0].strip())[-1]
        score = 0.9 if len(tail) >= 2 and not tail.isdigit() else 0.2
        yield Finding("email", m.start(), m.end(), score)


def _id_numbers(text: str) -> Iterator[Finding]:
    for m in AFTER_ID.finditer(text):
        digits = sum(c.isdigit() for c in m[1])
        if digits >= 4:
            yield Finding("id_number", m.start(1), m.end(1), 0.95 if not french_valid(re.sub(r"\D", "", m[1])) else 1.0)
    for pattern, base in ((SSN, 0.6), (NI, 0.6), (SPANISH, 0.45), (ITALIAN, 0.7)):
        for m in pattern.finditer(text):
            before, after = _context(text, m.start(), m.end())
            known, other = _last(IS_ID, before), _last(IS_OTHER, before)
            score = base + 0.3 * (known > other or bool(IS_ID.search(after))) - 0.4 * (other > known)
            if pattern is SPANISH:
                score += 0.2 * spanish_valid(m[0])
            yield Finding("id_number", m.start(), m.end(), score)
    for m in IBAN.finditer(text):
        if iban_valid(m[0]):
            yield Finding("iban", m.start(), m.end(), 0.95)


def _numbers(text: str) -> Iterator[Finding]:
    for m in NUMBER.finditer(text):
        raw = m[0]
        digits = re.sub(r"\D", "", raw)
        n = len(digits)
        if n < 7 or raw.count("(") != raw.count(")"):
            continue
        before, after = _context(text, m.start(), m.end())
        phone, other, known = _last(IS_PHONE, before), _last(IS_OTHER, before), _last(IS_ID, before)
        if 13 <= n <= 19 and luhn(digits) and not raw.startswith("+") and re.fullmatch(r"\d{13,19}|(?:\d{4}[ -]){3,4}\d{1,4}|\d{4}[ -]\d{6}[ -]\d{5}", raw) and other <= phone:
            yield Finding("card", m.start(), m.end(), 0.6)
            continue
        grouped = len(re.findall(r"\d+", raw)) > 1
        if n > 15:
            continue
        if raw.lstrip("(").startswith("+") or digits.startswith("00") and n >= 10:
            score = 0.8 if n >= 8 else 0.3
        elif NANP.fullmatch(raw):
            score = 0.75
        elif digits[0] == "0" and 9 <= n <= 12 and not re.search(r"^\d{1,2}[./-]\d{1,2}[./-]\d{4}", raw):
            score = 0.6 if grouped else 0.5
        elif n == 9 and re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{3}|\d{3}[ .-]\d{2}[ .-]\d{2}[ .-]\d{2}", raw):
            score = 0.55
        else:
            score = 0.25 if 7 <= n <= 12 else 0.1
        score += 0.3 * (phone > max(other, known)) - 0.5 * (other > max(phone, known)) - 0.5 * (known > max(phone, other))
        score -= 0.3 * bool(re.match(r"\s?(?:rows|ms|bytes|euro|dollars|times|€|\$|%)", after))
        yield Finding("phone", m.start(), m.end(), score)


def _addresses(text: str) -> Iterator[Finding]:
    for pattern in ADDRESSES:
        for m in pattern.finditer(text):
            yield Finding("address", m.start(), m.end(), 0.8)
    for pattern in _COMPOUND:
        for m in pattern.finditer(text):
            if first := _CAPITAL.search(text, m.start(), m.end()):
                yield Finding("address", first.start(), m.end(), 0.8)


def _names(text: str) -> Iterator[Finding]:
    _, straight, reverse, small = _given()
    common = _common_words()
    for m in straight.finditer(text):
        family = m[3]
        if family in _NO_FAMILY or len(family) < 3:
            continue
        yield Finding("name", m.start(2), m.end(), 0.8)
    for m in reverse.finditer(text):
        before, after = _context(text, m.start(), m.end())
        known = bool(_BEFORE_FAMILY.search(before))
        rare = m[1].lower() not in common
        score = 0.3 + 0.3 * known + 0.25 * (rare and not _PLACE.search(before)) - 0.4 * (m[1] in _NO_FAMILY)
        yield Finding("name", m.start(), m.end(), score)
    for m in small.finditer(text):
        if (m[1][0].isupper() and not m[1].isupper()) or m[2].lower() in _SMALL:
            continue
        before, _ = _context(text, m.start(), m.end())
        rare = m[2].lower() not in common
        yield Finding("name", m.start(), m.end(), 0.3 + 0.25 * rare + 0.25 * bool(_DIRECT.search(before)))


_BEFORE_FAMILY = re.compile(r"(?:[:/&(]|(?:merci à|gracias a|grazie a|obrigad[oa] a)|(?<![^\W_])(?:by|under|of|contact|to|with|ask|met|and|reading|for|says|bei|an|von|und|por|con|par|avec|chez|di|da|door|van|met))\s*$", re.IGNORECASE)
_PLACE = re.compile(r"(?<![^\W_])(?:in|at|near|from|nach|aus|en|à|em|a|te|naar)\s*$", re.IGNORECASE)
_DIRECT = re.compile(rf"(?:{_NAME_WORDS}|[:/])[ .:]*$", re.IGNORECASE)


@lru_cache(maxsize=50_000)
def _char_form(ch: str) -> str:
    """What one character stands for; tables() holds it for the arrays."""
    t = tables()
    cp = ord(ch)
    n = int(t["length"][cp])
    made = chr(t["single"][cp]) if n == 1 else "".join(map(chr, t["long"][t["start"][cp] : t["start"][cp] + n]))
    return unicodedata.normalize("NFC", made) if n else ""


def visible(text: str) -> tuple[str, list[int] | None]:
    """(consistent form, for each of its characters the position in the text); None if nothing changes."""
    if text.isascii():
        return text, None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not tables()["changes"][points[points > 127]].any():
        return text, None
    out: list[str] = []
    at: list[int] = []
    for i, ch in enumerate(text):
        for c in ch if ch < "\x7f" else _char_form(ch):
            if out and unicodedata.combining(c) and len(both := unicodedata.normalize("NFC", out[-1] + c)) == 1:
                out[-1] = both
            else:
                out.append(c), at.append(i)
    made = "".join(out)
    return made, None if made == text else at


def find(text: str | None) -> list[Finding]:
    """The findings in a text, in order, without overlaps. Positions refer to the text as given."""
    if not text:
        return []
    seen, at = visible(text)
    found: list[Finding] = []
    words = _WORD.findall(seen)
    if "@" in seen or re.search(r"[(\[{ ](?:at|AT|arroba|ät|chez)[)\]} ]", seen):
        found += _emails(seen)
    if re.search(r"\d", seen):
        if len(re.findall(r"\d", seen)) >= 5:
            found += _id_numbers(seen)
            found += _numbers(seen)
        lower = [w.lower() for w in words]
        if not _STREET_WORDS.isdisjoint(lower) or any(w.endswith(_STREET_ENDS) for w in lower):
            found += _addresses(seen)
    if not _given()[0].isdisjoint(words):
        found += _names(seen)
    found = sorted((f for f in found if f.score >= LEAST_SCORE), key=lambda f: (-f.score, f.start - f.end, f.start))
    kept: list[Finding] = []  # in order of their places
    for f in found:
        i = bisect_left(kept, f.end, key=lambda k: k.start)  # those before i begin before f ends
        if not i or kept[i - 1].end <= f.start:
            kept.insert(i, f)
    if at is None:
        return kept
    ends = [*at, len(text)]
    return [f._replace(start=ends[f.start], end=at[f.end - 1] + 1 + _trailing(text, at[f.end - 1])) for f in kept]


def _trailing(text: str, i: int) -> int:
    """Combining marks and hidden characters that belong to the character at i."""
    n = 0
    while i + 1 + n < len(text) and not text[i + 1 + n].isascii() and (unicodedata.combining(text[i + 1 + n]) or _char_form(text[i + 1 + n]) == ""):
        n += 1
    return n


def redact(text: str | None, found: list[Finding]) -> str | None:
    """The text with a typed placeholder in the place of every finding."""
    if not found:
        return text
    parts, last = [], 0
    for f in found:
        parts += [text[last : f.start], f"[{f.kind.upper()}]"]
        last = f.end
    return "".join([*parts, text[last:]])


_FOUND = "array<struct<pii_type:string,start:int,end:int,score:double>>"
_FOUND_TYPE = pa.list_(pa.struct([("pii_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _rows(found: list[Finding]) -> list[dict]:
    return [{"pii_type": f.kind, "start": f.start, "end": f.end, "score": f.score} for f in found]


def searched(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, position, text, found): every text with its findings and redacted; position numbers
    the elements of a list field from 0 and is null for a plain field. Null texts give no row."""
    kinds = dict(df.dtypes)
    listed = [kinds[f].startswith("array") for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[dict], str]] = {}
        for batch in batches:
            rows, field, position, text, found = [], [], [], [], []
            for i, (name, many) in enumerate(zip(fields, listed), 1):
                for r, value in enumerate(batch.column(i).to_pylist()):
                    for n, t in enumerate(value or [] if many else [value]):
                        if t is None:
                            continue
                        hit = known.get(t) if many else None
                        if hit is None:
                            got = find(t)
                            hit = (_rows(got), redact(t, got))
                            if many and len(known) < 100_000:
                                known[t] = hit
                        rows.append(r), field.append(name), position.append(n if many else None), found.append(hit[0]), text.append(hit[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(field, pa.string()), pa.array(position, pa.int32()), pa.array(text, pa.string()), pa.array(found, _FOUND_TYPE)], [key, "field", "position", "text", "found"])

    return df.select(key, *fields).mapInArrow(run, f"{key} {kinds[key]}, field string, position int, text string, found {_FOUND}")


def findings(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, position, pii_type, start, end, score): one row per finding, positions in code points."""
    return searched(df, key, fields).select(key, "field", "position", F.explode("found").alias("f")).select(key, "field", "position", "f.*")


def redacted(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df's key and fields with placeholders in the texts; one row per row of df, nulls kept."""
    kinds = dict(df.dtypes)
    listed = {f: kinds[f].startswith("array") for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = lambda t: redact(t, find(t))
        for batch in batches:
            out = [batch.column(0)]
            for i, f in enumerate(fields, 1):
                values = batch.column(i).to_pylist()
                made = [None if v is None else [clean(t) for t in v] if listed[f] else clean(v) for v in values]
                out.append(pa.array(made, pa.list_(pa.string()) if listed[f] else pa.string()))
            yield pa.RecordBatch.from_arrays(out, [key, *fields])

    schema = ", ".join([f"{key} {kinds[key]}", *[f"{f} {kinds[f]}" for f in fields]])
    return df.select(key, *fields).mapInArrow(run, schema)
