"""Units as exponent vectors, and a grammar that reads figures with units.

A unit is a vector of exponents over base dimensions, with the scale and offset
that lead to the canonical unit of its dimension. Units are multiplied, divided
and raised like numbers; a value converts only between equal dimensions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

BASES = ("money", "time", "length", "mass", "temperature")


@dataclass(frozen=True)
class Unit:
    """``canonical = value * scale + offset`` in the dimension ``dim``."""

    dim: tuple[int, ...]
    scale: float = 1.0
    offset: float = 0.0

    @staticmethod
    def of(scale: float = 1.0, offset: float = 0.0, **exponents: int) -> Unit:
        return Unit(tuple(exponents.get(b, 0) for b in BASES), scale, offset)

    def _combined(self, other: Unit, sign: int) -> Unit:
        if self.offset or other.offset:
            raise ValueError("a unit with an offset can't be part of a product")
        return Unit(tuple(a + sign * b for a, b in zip(self.dim, other.dim)), self.scale * other.scale**sign)

    def __mul__(self, other: Unit) -> Unit:
        return self._combined(other, 1)

    def __truediv__(self, other: Unit) -> Unit:
        return self._combined(other, -1)

    def __pow__(self, n: int) -> Unit:
        if self.offset:
            raise ValueError("a unit with an offset can't be raised")
        return Unit(tuple(n * a for a in self.dim), self.scale**n)


def convert(value: float, source: Unit, target: Unit) -> float:
    """``value`` of one unit in another of the same dimension."""
    if source.dim != target.dim:
        raise ValueError(f"dimensions differ: {source.dim} and {target.dim}")
    return (value * source.scale + source.offset - target.offset) / target.scale


# How currencies and periods are written.
CURRENCY_WORDS = {
    "USD": ("USD", "US$", "US dollars", "US dollar", "U.S. dollars", "$", "dollars"),
    "EUR": ("EUR", "€", "euros", "euro"),
    "GBP": ("GBP", "£", "pounds sterling", "pounds", "pound", "sterling", "quid"),
    "CAD": ("CAD", "C$", "CA$", "CAD$", "Canadian dollars", "Canadian dollar"),
    "AUD": ("AUD", "A$", "AU$", "AUD$", "Australian dollars", "Australian dollar"),
    "PLN": ("PLN", "zł", "zl", "zloty", "zlotys", "złoty", "złotych"),
    "INR": ("INR", "₹", "Rs.", "Rs", "Indian rupees", "rupees", "rupee"),
    "SGD": ("SGD", "S$", "SG$", "SGD$", "Singapore dollars", "Singapore dollar"),
}
PERIOD_WORDS = {
    "hour": ("hour", "hours", "hourly", "hr", "hrs", "h", "p.h.", "ph", "stunde", "std", "std.", "stündlich", "heure", "hora", "godz.", "godz", "godzinę", "godzina"),
    "day": ("day", "days", "daily", "d", "diem", "p.d.", "tag", "tagessatz", "täglich", "jour", "día", "dzień"),
    "week": ("week", "weekly", "wk", "w", "p.w.", "pw", "woche", "semaine", "semana", "tydzień"),
    "month": ("month", "monthly", "mo", "mth", "pcm", "p.m.", "monat", "monatlich", "mois", "mes", "mies.", "mies", "miesiąc", "miesięcznie"),
    "year": ("year", "yearly", "annually", "annum", "yr", "y", "p.a.", "pa", "jahr", "jährlich", "an", "année", "año", "rok", "rocznie", "annual"),
}
# Words that are read as a period only after one of the leads.
NEEDS_LEAD = {"h", "d", "w", "y", "an", "mo", "pa", "std", "hr", "wk", "yr", "day", "days", "hours"}
_LEADS = r"/\s*|(?:per|an|a|each|every|pro|im|am|al|por|par|na|de)\s+|de\s+l['’]"
SCALE_WORDS = {"k": 1e3, "thousand": 1e3, "tsd": 1e3, "mille": 1e3, "m": 1e6, "mio": 1e6, "million": 1e6, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lpa": 1e5, "crore": 1e7, "crores": 1e7, "cr": 1e7}


def _either(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


_CURRENCY_OF = {w.lower(): code for code, ws in CURRENCY_WORDS.items() for w in ws}
_PERIOD_OF = {w.lower(): code for code, ws in PERIOD_WORDS.items() for w in ws}
_NUMBER = r"\d{1,3}(?:[ \u00a0\u202f]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:['’]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)*"
_TOKEN = re.compile(
    rf"(?P<lead>{_LEADS})(?P<led>{_either(_PERIOD_OF)})(?![^\W\d_])"
    rf"|(?P<cur>{_either(w for w in _CURRENCY_OF if not w.isalpha() and ' ' not in w)}|(?<![^\W\d_])(?:{_either(w for w in _CURRENCY_OF if w.isalpha() or ' ' in w)})(?![^\W\d_]))"
    rf"|(?P<num>{_NUMBER})"
    rf"|(?<![^\W\d_])(?P<scale>{_either(SCALE_WORDS)})(?![^\W\d_])"
    rf"|(?<![^\W\d_])(?P<period>{_either(w for w in _PERIOD_OF if w not in NEEDS_LEAD)})(?![^\W\d_])"
    r"|(?P<range>[-–—~‒−]|(?<!\w)(?:to|bis|do|until|through|and)(?!\w))"
    r"|(?P<word>[^\W\d_]+(?:['’][^\W\d_]+)?\.?)|(?P<mark>[^\w\s])",
    re.I,
)
# Money that is not pay, from its mark on; and what in a field of its own means no figure.
_ASIDE = re.compile(r"\s(?:\+|plus|incl\b|including|excl\b|and (?:a )?bonus|zzgl\b).*$|[;,]\s+\d+\s*(?:days?|weeks?|hours?|%).*$|\([^)]*\)|\b\d+(?:[.,]\d+)?\s*%.*$", re.I | re.S)
_NOT_PAY = re.compile(r"\b(?:401\s?k|equity|bonus|unpaid|trial|leave|holidays?|vacation|pension|stipend|budget|options)\b", re.I)


def number(text: str) -> float | None:
    """A written number. A point or comma before exactly three digits separates
    thousands unless the number starts with 0; any other last one is decimal."""
    s = re.sub(r"['’\s\u00a0\u202f]", "", text)
    marks = [(m.group(), m.start()) for m in re.finditer(r"[.,]", s)]
    if not marks:
        return float(s)
    last, at = marks[-1]
    tail = len(s) - at - 1
    if len(marks) > 1:
        whole = tail == 3 and (last == marks[0][0] or not s.startswith("0"))
    else:
        whole = tail == 3 and not s.startswith("0")
    digits = re.sub(r"[.,]", "", s)
    return float(digits) if whole else float(re.sub(r"[.,]", "", s[:at]) + "." + s[at + 1 :])


@dataclass
class Figure:
    """A range of amounts as written, with the currency and period found."""

    low: float
    high: float
    currency: str | None
    period: str | None


def _tokens(text: str) -> list[tuple[str, str]]:
    out = []
    for m in _TOKEN.finditer(text):
        kind = "period" if m.lastgroup == "led" else m.lastgroup
        out.append((kind, m.group(m.lastgroup)))
    return out


def read_figure(text: str | None) -> Figure | None:
    """The pay figure of a text, or None.

    figure := [currency] number [scale] [currency] [range [currency] number
    [scale] [currency]] ... [period]; one currency, scale or period covers both
    ends. Bonus, equity, leave and other money after a mark is cut off first.
    """
    if not text or not (tokens := _tokens(_ASIDE.sub(" ", text))):
        return None
    ends: list[list[float | None]] = []
    currency = period = None
    lakh = open_range = closed = False
    for kind, word in tokens:
        lower = word.lower()
        if kind == "num":
            if closed or (ends and not open_range) or len(ends) == 2:
                closed = True
                continue
            ends.append([number(word), None])
            open_range = False
        elif kind == "scale":
            if ends and ends[-1][1] is None and not closed:
                ends[-1][1] = SCALE_WORDS[lower]
                lakh |= lower in ("lakh", "lakhs", "lac", "lpa", "crore", "crores", "cr")
                if lower == "lpa":
                    period = period or "year"
        elif kind == "cur":
            currency = currency or _CURRENCY_OF[lower]
        elif kind == "period":
            if ends:
                period = period or _PERIOD_OF[lower]
        elif kind == "range":
            open_range = len(ends) == 1
    if not ends or (_NOT_PAY.search(_ASIDE.sub(" ", text)) and currency is None):
        return None
    (low, k), (high, q) = ends[0], ends[-1]
    if k is None and q is not None and low <= high:
        k = q
    if q is None and k is not None and high < low * k:
        q = k
    low, high = low * (k or 1), high * (q or 1)
    return Figure(min(low, high), max(low, high), currency or ("INR" if lakh else None), period)


_ANY_CURRENCY = re.compile(rf"(?<![^\W\d_])(?:{_either(w for w in _CURRENCY_OF if w.isalpha() or ' ' in w)})(?![^\W\d_])|[€£₹$]", re.I)
_ANY_PERIOD = re.compile(rf"(?<![^\W\d_])(?:{_either(w for w in _PERIOD_OF if len(w) > 2 and w not in ('hour','days'))}|hour)(?![^\W\d_])", re.I)
# A statement of units is a sentence: subject [place] verb ... currency [period].
# What such a sentence is about, where that stands, and what is said of it.
_SUBJECT = r"(?:pay|salary|salaries|wages?|remuneration|compensation)"
_THING = r"(?:figures?|amounts?|numbers?|values?|ranges?|bands?|rates?)"
_PLACE = r"(?:above|below|here|range|for this (?:post|role|job|position)|in th(?:e|is) (?:posting|ad|field))"
_SAID = r"(?:stated|quoted|paid|given|listed|shown|expressed|meant|measured|denominated)"
STATEMENT_PARTS = (_SUBJECT, _THING, _PLACE, _SAID)
_STATEMENT = re.compile(
    rf"[^.\n]*\b(?:{_THING} in the {_SUBJECT} field|{_SUBJECT} {_THING}|{_SUBJECT})(?: {_PLACE})*(?: ?:| (?:is|are|means?)\b| {_SAID}\b| in\b)[^.\n]*",
    re.I,
)


def stated_units(text: str | None) -> tuple[str | None, str | None]:
    """Currency and period that a description states for a bare pay figure."""
    for m in _STATEMENT.finditer(text or ""):
        if c := _ANY_CURRENCY.search(m.group()):
            p = _ANY_PERIOD.search(m.group())
            return _CURRENCY_OF[c.group().lower()], _PERIOD_OF[p.group().lower()] if p else None
    return None, None


class PayScale:
    """Converts figures to whole US dollars a year by a table of factors."""

    def __init__(self, factors: Mapping[tuple[str, str], float]):
        self.money = {code: Unit.of(factor, money=1) for (code, kind), factor in factors.items() if kind == "currency"}
        # A period's factor is how many of it a year has.
        self.time = {code: Unit.of(1 / factor, time=1) for (code, kind), factor in factors.items() if kind == "period" and factor}
        self.target = Unit.of(money=1) / Unit.of(time=1)

    def usd_per_year(self, value: float, currency: str, period: str) -> int:
        usd = convert(value, self.money[currency] / self.time[period], self.target)
        return math.floor(round(usd, 6) + 0.5)

    def range_of(self, salary: str | None, description: str | None) -> tuple[int, int] | None:
        """Low and high in US dollars a year, or None where there is no figure
        or its currency is neither written nor stated."""
        figure = read_figure(salary)
        if figure is None:
            return None
        currency, period = figure.currency, figure.period
        if currency is None and period is None:
            currency, period = stated_units(description)
        period = period or "year"
        if currency not in self.money or period not in self.time:
            return None
        return self.usd_per_year(figure.low, currency, period), self.usd_per_year(figure.high, currency, period)
