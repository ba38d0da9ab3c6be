"""What personal data looks like: grammars that propose mentions.

The grammars only propose, and widely: every number of a phone's or a card's
form, every street, every run of capitalised words. Which of them hold is decided
by the sequence model that takes form and surroundings as observations.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import regex

KINDS = ("email", "phone", "id_number", "street_address", "person_name")


class Candidate(NamedTuple):
    """A kind that the text from ``start`` to ``end`` may be, and what makes it so."""

    kind: str
    start: int
    end: int
    form: str


# Words around personal data and around what looks like it.
PHONE_CUES = r"tel|tel\.|telephone|telefon|téléphone|teléfono|phone|mobile|mob|cell|handy|fax|whatsapp|ring|call|call me on|number is|☎|📞|reach me on"
ID_CUES = (
    r"ssn|soc\. ?sec\. ?no\.?|social security(?: number| no\.?)?|nino|ni number|ni no\.?|national insurance(?: number| no\.?)?|passport(?: number| no\.?| nr\.?)?|dni|nie|nif|"
    r"n\.i\.f\.?|n\.i\.e\.?|d\.n\.i\.?|s\.s\.n\.?|aadhaar(?: no\.?| number)?|tax id|tin|tfn|abn|pesel|id(?: number| no\.?| card)?|identity (?:number|card)|personalausweis(?:nummer)?|steuer-id|steuernummer|sozialversicherungsnummer|numéro de sécurité sociale|cpf|pan|sin"
)
NOT_NUMBERS = r"ticket|invoice|isbn|iso|rfc|port|version|v|build|commit|host|release|order|po|class of|class|ref|reference no\.?|account|project|release|sprint|section|page|room|batch|serial|sku|part|case|bug|issue|pr"
STREET_ENDS = (
    r"Street|St|Road|Rd|Row|Terrace|Blvd|Boulevard|Drive|Dr|Close|Way|Avenue|Ave|Lane|Ln|Court|Ct|Crescent|Place|Pl|Square|Sq|Hill|Park|Parade|Quay|Walk|Gardens|Grove|Mews|Highway|Hwy|Parkway|Pkwy|Loop|Alley|Circle|Green|Rise|View|Wharf|Yard"
)
FRENCH_STREETS = r"rue|avenue|impasse|chemin|allée|boulevard|bd|place|quai|cours|passage|route|square|ruelle|sentier|voie"
SPANISH_STREETS = r"Calle|C/|Paseo|Avenida|Avda\.?|Plaza|Camino|Ronda|Travesía|Carrera|Rambla|Rua|Avenida|Largo|Praça|Travessa|Via|Viale|Piazza|Corso|Ulica|ul\."
GERMAN_ENDS = r"straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|steig|chaussee|graben|markt|hof|wall|pfad|stieg"
GERMAN_STARTS = r"Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Unter der|Hinter der|Beim"
PARTICLES = r"de|del|de la|de las|de los|van|van der|van den|von|von der|da|das|do|dos|di|el|al|bin|ibn|ten|ter|le|la|du|st\.?|mac|mc"
NAME_CUES = (
    r"name|nombre|nom|candidate|candidat|candidato|applicant|cv of|resume of|résumé of|curriculum vitae of|my name is|i am|i'm|regards,|sincerely,|yours,|referee|reference|references?|supervised by|reported to|reports to|recommended by|"
    r"worked closely with|closely with|emergency contact|managed by|mentored by|contact person|signed|dear|supervisor|manager"
)
TITLES = r"dr|prof|mr|mrs|ms|mx|herr|frau|señor|señora|sr|sra|mme|m|ing|dipl|phd"
NOT_NAMES = r"engineer|developer|manager|analyst|designer|lead|administrator|architect|scientist|writer|marketer|coach|advocate|consultant|specialist|officer|researcher|tester"
UNITS = r"Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Floor|Room|#|No\.|Wohnung|Whg\.?|App\.?|Piso|Bât\.?|Esc\."

# Words that end the names of firms, projects and other things.
THINGS = (
    r"systems?|labs?|software|studios?|group|partners|analytics|logistics|collective|media|works|capital|foods|company|gmbh|ltd|inc|llc|ag|services|solutions|project|programm?e?|team|account|conference|"
    r"cooperative|union|institute|university|college|school|council|agency|association|foundation|society|club|bank|hospital|street|road|avenue|harbou?r|bridge|release|portal|cluster|service|talk|days|handbook|cloud|language|learning|assurance|translation|boot|relic"
)

TOKEN = regex.compile(r"[^\W\d_]+(?:['’\-‐‑][^\W\d_]+)*|\d+|[^\s]|\n")

_AT = r"(?:\s?[@＠]\s?|\s?[\[\(\{]\s?(?:at|AT|@)\s?[\]\)\}]\s?)"
_DOT = r"(?:[.．]|\s?[\[\(\{]\s?(?:dot|DOT|\.)\s?[\]\)\}]\s?|\s(?:DOT|dot)\s)"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
_EMAIL = regex.compile(
    r"(?<![\w.+%\-])[\p{L}\p{N}](?:[\w.+%\-]*[\p{L}\p{N}_+\-])?"
    rf"(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}{{2,}}|\s(?:AT|at)\s{_LABEL}(?:\s(?:DOT|dot)\s{_LABEL})*\s(?:DOT|dot)\s\p{{L}}{{2,}})"
)

_SEP = r"[ .\-–/  ]"
_PHONE = regex.compile(
    r"(?<![\w+.,/\-])(?:"
    rf"(?P<intl>(?:\+|00)\d{{1,3}}{_SEP}?(?:\(\d{{1,4}}\){_SEP}?)?(?:\d{_SEP}?(?:[/(]\d+\))?){{6,12}}\d)"
    rf"|(?P<area>\(0?\d{{2,4}}\){_SEP}?(?:\d{_SEP}?){{5,9}}\d)"
    rf"|(?P<nanp>(?:1[ .\-])?[2-9]\d\d ?[ .\-/]? ?[2-9]\d\d[ .\-]?\d{{4}})"
    rf"|(?P<local>0\d{{1,4}}(?:{_SEP}?\d){{7,9}})"
    r")(?![\w]|[.,\-/]\d)(?:\s?(?:ext|x|extension|Durchwahl)\.? ?\d{1,5})?"
)
_ID = regex.compile(
    r"(?<![\w.,/\-+])(?:"
    r"(?P<ssn>\d{3}-\d\d-\d{4})"
    r"|(?P<nino>[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D])"
    r"|(?P<dni>[XYZ]?\d{7,8}-?[A-HJ-NP-TV-Z])"
    r"|(?P<pass>[A-Z]{1,2}\d{6,8})"
    r"|(?P<grouped>\d{4} \d{4} \d{4}|\d\d \d{3} \d{3} \d{3}|\d{3} \d{3} \d{3}|\d{3}[ -]\d\d[ -]\d{4})"
    r"|(?P<bare>\d{9}|\d{11}|\d{12})"
    r")(?![\w]|[.,\-/]\d)"
)
_ID_CUE = regex.compile(rf"(?:^|(?<![\p{{L}}]))(?:{ID_CUES})\s*[:#.\-–]?\s*$", regex.I)
_PHONE_CUE = regex.compile(rf"(?:^|(?<![\p{{L}}]))(?:{PHONE_CUES})\s*[:#.\-–]?\s*\(?$", regex.I)
_NOT_CUE = regex.compile(rf"(?:^|(?<![\p{{L}}]))(?:{NOT_NUMBERS})\s*[:#.\-–]?\s*$", regex.I)

_ABROAD = regex.compile(r"\+\d{1,3}[ \-.]?$")

_CAP = r"\p{Lu}[\p{L}'’\-]*"
_UNIT = rf"(?: #\w+|, (?:(?:{UNITS}) ?\w+|\d+\.?[ºª°]\s?(?:izq\.?|dcha\.?|\w{{1,2}})))?"
_TOWN = rf"(?:, (?:\d{{4,6}} )?{_CAP}(?:[ /&\-]{{1,3}}(?:and )?{_CAP})*)?"
_STREET = regex.compile(
    r"(?<![\w\-/.,])(?:"
    rf"(?P<first>\d{{1,5}}(?: ?[a-z])?(?: (?:bis|ter))? (?:[NSEW]\.? |North |South |East |West )?(?:{_CAP} ){{1,3}}(?:{STREET_ENDS})\b\.?)"
    rf"|(?P<french>\d{{1,4}}(?: ?(?:bis|ter|quater|[a-z]))?,? (?:{FRENCH_STREETS}) (?:(?:de|du|des|d['’]|de la|de l['’]|la|le|les|l['’]|{_CAP}) ?){{1,5}}(?<! ))"
    rf"|(?P<spanish>(?:{SPANISH_STREETS}) (?:(?:de|del|de la|de los|de las|la|las|los|el|e|y|{_CAP}) )*{_CAP},? (?:n[ºo.°] ?)?\d{{1,4}}[a-z]?)"
    rf"|(?P<german>(?:\p{{Lu}}[\p{{L}}\-]*(?:{GERMAN_ENDS})|(?:{GERMAN_STARTS}) (?:{_CAP} )?{_CAP}|{_CAP}[ \-](?:Straße|Str\.|Weg|Allee|Platz|Ring|Ufer|Damm)) \d{{1,4}} ?[a-z]?)"
    rf")(?![\p{{L}}\p{{N}}])(?P<rest>{_UNIT}{_TOWN})"
)
# A street name that goes on is part of an account's, firm's or project's name.
_GOES_ON = regex.compile(r"(?<!\.) (?:\p{Lu}|(?:account|project|team|office|programme|program|portal|branch)\b)")

_PIECE = r"[\p{L}][\p{L}'’]*(?:[\-‐‑][\p{L}'’]+)*"
_WORD = regex.compile(rf"(?<![\w@.\-'’]){_PIECE}")
_INITIAL = r"\p{Lu}\."
_CAPS = regex.compile(rf"(?<![\w@.\-'’&/])\p{{Lu}}[\p{{L}}'’\-]*(?: {_INITIAL})*(?: (?:(?:{PARTICLES}) )?\p{{Lu}}[\p{{L}}'’\-]+){{1,3}}(?![\w@]|\s?[@＠])")
_CUED = regex.compile(
    rf"(?:(?<![\p{{L}}])(?:{NAME_CUES})(?: *[:\-–]? *|(?<=,)\n)(?:(?:{TITLES})\.? )*|(?<![\p{{L}}])(?:{TITLES})\. )"
    rf"(?-i:(?P<name>(?:{_INITIAL} ){{1,2}}(?:(?:{PARTICLES}) )?\p{{Lu}}[\p{{L}}'’\-]+|\p{{Lu}}[\p{{L}}'’\-]+(?: {_INITIAL})*(?: (?:{PARTICLES}))? \p{{Lu}}[\p{{L}}'’\-]+))(?![\w@]|\s?[@＠])",
    regex.I,
)
_LONE = regex.compile(rf"(?:^|\n)\s*(?:(?:{TITLES})\. )?(?P<name>(?:\p{{Lu}}\. )+(?:(?:{PARTICLES}) )?\p{{Lu}}[\p{{L}}'’\-]+)(?=\s*(?:[\n,|·/;]|  |$))", regex.I)
_NAME_CUE = regex.compile(rf"(?:(?<![\p{{L}}])(?:{NAME_CUES})(?: *[:\-–]? *|(?<=,)\n)|(?<![\p{{L}}])(?:{TITLES})\. )(?:(?:{TITLES})\.? )*$", regex.I)
_SINGLE = regex.compile(r"(?<![\w@.\-'’])\p{Lu}[\p{L}'’\-]{2,}(?![\w@]|\s?[@＠])")
#: What stands between the two parts of an address.
_AT_SIGN = regex.compile(r"\s?(?:[@＠]|[\[({]\s?(?:at|AT|@)\s?[\])}]|(?<=\s)(?:at|AT)(?=\s))")
_LOCAL = frozenset(".+%-_")

CUES = {"phone": _PHONE_CUE, "id": _ID_CUE, "not": _NOT_CUE, "name": _NAME_CUE}


class Grammar:
    """Proposes mentions; ``given`` holds frequent words of people's names in lower case."""

    def __init__(self, given: frozenset[str] | set[str] = frozenset()):
        self.given = given
        surname = rf"(?:(?:{PARTICLES}) )?{_PIECE}"
        self._order = regex.compile(rf"{_PIECE}(?: {_INITIAL})*(?: {_INITIAL} | ){surname}(?![\w@]|\s?[@＠])", regex.I)
        self._turned = regex.compile(rf"(?<![\w@.\-'’]){surname}, (?P<given>{_PIECE})(?: {_INITIAL})?(?![\w@]|\s?[@＠])", regex.I)

    def _given_names(self, text: str) -> Iterator[tuple[int, int, str]]:
        given = self.given
        for m in _WORD.finditer(text):
            if m.group().lower() in given:
                a, b = m.span()
                o = self._order.match(text, a)
                if text[a - 2 : a] == ", " and not (o and text[b + 1 : b + 2].isupper()):
                    for t in self._turned.finditer(text, max(0, text.rfind("\n", 0, a), a - 80), len(text)):
                        if t.start("given") >= a:
                            if t.start("given") == a:
                                yield t.start(), t.end(), "turned"
                            break
                if o:
                    yield o.start(), o.end(), "order"

    def mentions(self, text: str) -> list[list[Candidate]]:
        """What may be personal data, in order; a mention's candidates are of
        different kinds and overlap, mentions don't."""
        taken = bytearray(len(text) + 1)
        found: list[list[Candidate]] = []

        def add(kind: str, start: int, end: int, form: str) -> None:
            if end > start and not any(taken[start:end]):
                taken[start:end] = b"\x01" * (end - start)
                found.append([Candidate(kind, start, end, form)])

        for at in _AT_SIGN.finditer(text):
            start = at.start()
            while start and ((c := text[start - 1]).isalnum() or c in _LOCAL):
                start -= 1
            if start < at.start() and (m := _EMAIL.match(text, start)) and m.end() > at.end():
                add("email", start, m.end(), "at" if "@" in m.group() else "spelled")
        for m in _STREET.finditer(text):
            goes_on = m["first"] and _GOES_ON.match(text, m.start("rest"))
            add("street_address", m.start(), m.start("rest") if goes_on else m.end(), "goes_on" if goes_on else m.lastgroup if m.lastgroup != "rest" else next(k for k in ("first", "french", "spanish", "german") if m[k]))
        numbers: list[Candidate] = [Candidate("id_number", m.start(), m.end(), m.lastgroup) for m in _ID.finditer(text) if not _ABROAD.search(text, max(0, m.start() - 6), m.start())]
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 20:
                numbers.append(Candidate("phone", m.start(), m.end(), m.lastgroup))
        group: list[Candidate] = []
        for c in sorted((c for c in numbers if not any(taken[c.start : c.end])), key=lambda c: (c.start, c.end)):
            if group and c.start >= max(x.end for x in group):
                found.append(group)
                group = []
            if all(x.kind != c.kind for x in group):
                group.append(c)
        if group:
            found.append(group)
        for g in found:
            for c in g:
                taken[c.start : c.end] = b"\x01" * (c.end - c.start)
        for start, end, form in self._given_names(text):
            add("person_name", start, end, form)
        for form, pattern in (("cued", _CUED), ("lone", _LONE)):
            for m in pattern.finditer(text):
                add("person_name", m.start("name"), m.end("name"), form)
        for m in _CAPS.finditer(text):
            add("person_name", m.start(), m.end(), "caps")
        # A word of a longer name may be a mention by itself.
        words = {w for g in found for c in g if c.kind == "person_name" for w in words_of(text[c.start : c.end]) if len(w) > 2}
        if words:
            for m in _SINGLE.finditer(text):
                if not taken[m.start()] and plain(m.group()) in words:
                    add("person_name", m.start(), m.end(), "single")
        return sorted(found, key=lambda g: g[0].start)


def plain(text: str) -> str:
    """In lower case and without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def words_of(name: str) -> list[str]:
    return [plain(w) for w in _WORDS.findall(name)]


_WORDS = regex.compile(r"\p{L}+")
