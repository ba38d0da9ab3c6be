"""Timestamps in many notations, read as milliseconds since 1970-01-01 UTC.

All notations are one regular expression, an alternation whose parts name what
they capture. A text is matched once; its components are checked against the
calendar and assembled by integer day arithmetic. Only a time without offset in
a named zone needs the zone's rules.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

# Zone abbreviations with their offsets in minutes, in any season.
ABBREVIATIONS = {
    "UTC": 0, "UT": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
DATE_ORDERS = ("YMD", "DMY", "MDY")

_MONTH = r"(?P<{0}>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DATES = (
    r"(?P<y1>\d{4})-(?P<m1>\d{1,2})-(?P<d1>\d{1,2})",
    r"(?P<y2>\d{4})(?P<s2>[/.])(?P<m2>\d{1,2})(?P=s2)(?P<d2>\d{1,2})",
    r"(?P<y3>\d{4})(?P<m3>\d\d)(?P<d3>\d\d)",
    r"(?P<a4>\d{1,2})(?P<s4>[-/.])(?P<b4>\d{1,2})(?P=s4)(?P<y4>\d{4})",
    r"(?P<d5>\d{1,2})(?:st|nd|rd|th)?[ -]" + _MONTH.format("m5") + r"[ -](?P<y5>\d{4})",
    _MONTH.format("m6") + r" {1,2}(?P<d6>\d{1,2})(?:st|nd|rd|th)?,? (?P<y6>\d{4})",
)
_DAY = r"(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?(?: ?(?P<ap>[ap])(?:m|\.m\.)(?![A-Za-z]))?"
_TIME_BASIC = r"(?P<hb>\d\d)(?P<mib>\d\d)(?:(?P<sb>\d\d)(?:[.,](?P<fb>\d+))?)?"
_ZONE = (
    r" ?(?:(?P<utc>UTC|GMT)?(?P<sign>[+\-−])(?P<oh>\d\d?):?(?P<om>\d\d)?(?: ?\[[\w/+\-]+\]| ?\([^)]*\))?"
    r"|(?P<abbr>[A-Za-z]{1,5})|\[?(?P<zone>[A-Za-z_]+(?:/[A-Za-z_+\-]+)+)\]?)"
)
_PATTERN = re.compile(
    r"\s*(?:[A-Za-z][A-Za-z ]*:\s*|(?:posted|updated|published|last updated|as of)(?: on)?\s+)?(?:"
    r"(?P<epoch>[+-]?\d{10,})(?:[.,](?P<ef>\d+))?"
    rf"|(?:{_DAY},? )?(?:{'|'.join(_DATES)})(?:(?:[Tt]|,? (?:at )?){_TIME}(?:{_ZONE})?|[Tt]{_TIME_BASIC}(?:(?P<zb>[Zz])|(?P<signb>[+-])(?P<ohb>\d\d):?(?P<omb>\d\d)?)?)?"
    rf"|{_DAY},? " + _MONTH.format("m7") + r" {1,2}(?P<d7>\d{1,2}) (?P<h7>\d\d):(?P<mi7>\d\d):(?P<s7>\d\d)(?: (?P<abbr7>[A-Z]{1,5}))? (?P<y7>\d{4})"
    r")\s*",
    re.I,
)


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days from 1970-01-01 to a date of the proleptic Gregorian calendar."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _valid(y: int, m: int, d: int) -> bool:
    if not (1 <= y <= 9999 and 1 <= m <= 12 and d >= 1):
        return False
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return d <= (29 if m == 2 and leap else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1])


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _offset(zone: ZoneInfo, y: int, m: int, d: int, h: int, mi: int, s: int) -> int:
    """Seconds east of UTC. fold=0 is the earlier of two readings, and in a gap
    the offset in force before the change."""
    delta = datetime(y, m, d, h, mi, s, tzinfo=zone).utcoffset()
    return delta.days * 86400 + delta.seconds


def _millis(fraction: str | None) -> int:
    return int((fraction or "0")[:3].ljust(3, "0"))


def _of_epoch(digits: str, fraction: str | None) -> int:
    sign, digits = (-1, digits[1:]) if digits[0] == "-" else (1, digits.lstrip("+"))
    n, whole = int(digits), len(digits)
    if whole <= 11:
        return sign * (n * 1000 + _millis(fraction))
    if whole <= 14:
        return sign * n
    return sign * (n // 1000 if whole <= 17 else n // 1_000_000)


def epoch_millis(text: str | None, zone_name: str | None = "UTC", date_order: str | None = "YMD") -> int | None:
    """The instant ``text`` states, or None if it states none.

    ``zone_name`` holds for times without zone, ``date_order`` for all-digit
    dates that don't start with the year (for YMD they are read as DMY only if
    that is the one possible reading). None for null, blank, relative and
    impossible values, and for unknown zones. Finer digits are cut off.
    """
    if not text or not (m := _PATTERN.fullmatch(text)):
        return None
    g = m.groupdict()
    if g["epoch"]:
        return _of_epoch(g["epoch"], g["ef"])
    kind = next(k for k in "1234567" if g[f"y{k}"])
    y = int(g[f"y{kind}"])
    if kind == "4":
        a, b = int(g["a4"]), int(g["b4"])
        if date_order == "MDY":
            mo, d = a, b
        elif date_order == "DMY" or a > 12:
            d, mo = a, b
        else:
            return None
    else:
        d = int(g[f"d{kind}"])
        mo = MONTHS[g[f"m{kind}"][:3].lower()] if kind in "567" else int(g[f"m{kind}"])
    if not _valid(y, mo, d):
        return None
    h, mi, s, f = (g["h7"], g["mi7"], g["s7"], None) if kind == "7" else (g["hb"], g["mib"], g["sb"], g["fb"]) if g["hb"] else (g["h"], g["mi"], g["s"], g["f"])
    h, mi, s = int(h or 0), int(mi or 0), int(s or 0)
    if g["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["ap"].lower() == "p")
    if h > 23 or mi > 59 or s > 59:
        return None
    sign, oh, om = (g["signb"], g["ohb"], g["omb"]) if g["signb"] else (g["sign"], g["oh"], g["om"])
    abbr = g["abbr"] or g["abbr7"] or g["zb"]
    if sign:
        if int(oh) > 18 or int(om or 0) > 59:
            return None
        offset = (int(oh) * 3600 + int(om or 0) * 60) * (1 if sign == "+" else -1)
    elif abbr:
        if abbr.upper() not in ABBREVIATIONS:
            return None
        offset = ABBREVIATIONS[abbr.upper()] * 60
    else:
        zone = _zone(g["zone"] or zone_name or "UTC")
        if zone is None:
            return None
        offset = _offset(zone, y, mo, d, h, mi, s)
    return ((days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + s) - offset) * 1000 + _millis(f)
