"""Splitting of fields that hold several values.

A finite-state tokenizer walks over the text once. Its state is the open quote
(or none) and the bracket depth; a delimiter counts only outside quotes and at
depth 0. Two things are looked up rather than guessed: names that contain a
delimiter are passed as ``protected`` and never cut, and a comma followed by a
country (``qualifiers``) doesn't end the value before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

# Opening quotes with their closing quote, brackets, delimiters.
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "‘": "’", "«": "»"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}
MARKS = ",;|/&•·\n\r\t、，；｜"
WORDS = ("and", "or")

# English country names by the ISO codes in which places are listed.
COUNTRY_NAMES = {
    "AU": ("Australia",), "BR": ("Brazil", "Brasil"), "CA": ("Canada",), "DE": ("Germany", "Deutschland"), "ES": ("Spain",), "FR": ("France",),
    "GB": ("United Kingdom", "UK", "Great Britain"), "IE": ("Ireland",), "IN": ("India",), "IT": ("Italy",), "KE": ("Kenya",), "MX": ("Mexico",),
    "NL": ("Netherlands",), "NZ": ("New Zealand",), "PL": ("Poland",), "PT": ("Portugal",), "SE": ("Sweden",), "SG": ("Singapore",),
    "US": ("United States", "USA", "United States of America"), "ZA": ("South Africa",),
}


def country_spellings(codes: Iterable[str]) -> dict[str, str]:
    """Every spelling of the given countries in lower case, with its code."""
    return {s.lower(): code for code in codes for s in (code, *COUNTRY_NAMES.get(code, ()))}


def contains_delimiter(name: str) -> bool:
    return any(m in name for m in MARKS) or any(f" {w} " in name.lower() for w in WORDS)


class ValueSplitter:
    """Callable that turns one text into its list of values, in order."""

    def __init__(self, protected: Iterable[str] = (), qualifiers: Iterable[str] = ()):
        names = sorted({n.strip() for n in protected if n and contains_delimiter(n)}, key=lambda n: (-len(n), n))
        pieces = (r"\s+".join(map(re.escape, n.split())) for n in names)
        self._protected = re.compile(r"(?<!\w)(?:" + "|".join(pieces) + r")(?!\w)", re.I) if names else None
        spelled = sorted({q for q in qualifiers if q}, key=lambda q: (-len(q), q))
        stop = rf"(?=\s*(?:$|[{re.escape(MARKS)}]|\s(?:{'|'.join(WORDS)})\s))"
        self._qualifier = re.compile(r",\s*(" + "|".join(map(re.escape, spelled)) + ")" + stop, re.I) if spelled else None
        self._word = re.compile(rf"\s+(?:{'|'.join(WORDS)})(?=\s)")

    def __call__(self, text: str | None) -> list[str]:
        """The values of ``text``; [] for null and blank texts.

        Empty values between delimiters are skipped, repeated ones stay. A
        quote opens only where a value begins, and only if its partner closes
        it; any other quotation mark is an ordinary character. Enclosing
        quotes are removed and doubled quotes inside become single.
        """
        if not text:
            return []
        kept = {m.start(): m.end() for m in self._protected.finditer(text)} if self._protected else {}
        values: list[str] = []
        start = i = depth = 0
        qualified = False
        n = len(text)
        last = {close: text.rfind(close) for close in BRACKETS.values()}
        while i < n:
            c = text[i]
            if i in kept:
                i = kept[i]
                continue
            if c in QUOTES and depth == 0 and not text[start:i].strip():
                end = self._closing(text, i)
                if end:
                    i = end
                    continue
            if c == "\\" and i + 1 < n:
                i += 2
                continue
            if c in BRACKETS and last[BRACKETS[c]] > i:
                depth += 1
            elif depth and c in BRACKETS.values():
                depth -= 1
            elif depth == 0:
                if c == "," and not qualified and self._qualifier and text[start:i].strip() and (m := self._qualifier.match(text, i)) and m.start(1) not in kept:
                    qualified, i = True, m.end()
                    continue
                width = 1 if c in MARKS else m.end() - i if c.isspace() and (m := self._word.match(text, i)) else 0
                if width:
                    self._emit(text[start:i], values)
                    start = i = i + width
                    qualified = False
                    continue
            i += 1
        self._emit(text[start:], values)
        return values

    @staticmethod
    def _closing(text: str, i: int) -> int:
        """Position after the quote that closes the one at ``i``, or 0."""
        close, j = QUOTES[text[i]], i + 1
        while (j := text.find(close, j)) >= 0:
            if text[j : j + 2] == close * 2 and close == text[i]:
                j += 2
            elif close in "'’" and j + 1 < len(text) and text[j + 1].isalnum():
                j += 1  # an apostrophe inside a word
            else:
                return j + 1
        return 0

    @staticmethod
    def _emit(raw: str, values: list[str]) -> None:
        value = raw.strip()
        if len(value) > 1 and value[0] in QUOTES and ValueSplitter._closing(value, 0) == len(value):
            close = QUOTES[value[0]]
            value = value[1:-1].replace(close * 2, close).strip() if close == value[0] else value[1:-1].strip()
        if value:
            values.append(value)
