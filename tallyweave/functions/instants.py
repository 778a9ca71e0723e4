"""Reading one timestamp text of any of the writings that sources use. Plain Python, no Spark."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names of English, German, French, Spanish and Portuguese, in calendar order.
_MONTH_NAMES = """
january jan januar janvier janv enero ene janeiro
february feb februar février fevrier févr febrero fevereiro fev
march mar märz maerz mrz mars marzo março marco
april apr avril avr abril abr
may mai mayo maio
june jun juni juin junio junho
july jul juli juillet juil julio julho
august aug août aout agosto ago
september sep sept septembre septiembre setembro set
october oct oktober okt octobre octubre outubro out
november nov novembre noviembre novembro
december dec dezember dez décembre decembre déc diciembre dic dezembro
"""
MONTHS = {name: i for i, line in enumerate(_MONTH_NAMES.split("\n")[1:13], 1) for name in line.split()}
# Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {"z": 0, "utc": 0, "ut": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "brt": -180, "brst": -120, "ist": 330, "npt": 345, "sgt": 480, "jst": 540, "aest": 600, "aedt": 660}
# Locales whose numeric dates begin with the month or with the year; all others begin with the day.
MONTH_FIRST, YEAR_FIRST = {"en-us"}, {"ja-jp", "ja", "zh-cn", "ko-kr", "sv-se", "hu-hu"}

_WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_NAME = r"(?P<mon>[^\W\d_]{3,10})"
_DATE = rf"""(?: (?P<y>\d{{4}}) (?P<s1>[-/.]) (?P<m>\d{{1,2}}) (?P=s1) (?P<d>\d{{1,2}})
 | (?P<n1>\d{{1,2}}) (?P<s2>[-/.]) (?P<n2>\d{{1,2}}) (?P=s2) (?P<n3>\d{{4}}|\d{{2}})
 | (?P<cy>\d{{4}}) (?P<cm>\d{{2}}) (?P<cd>\d{{2}}) (?=t|$)
 | (?:(?P<wd>mon|tue|wed|thu|fri|sat|sun),?\ +)? (?P<td>\d{{1,2}})(?:er|\.|º)? (?:\ +|-) (?:de\ +)? {_NAME}\.? (?:\ +|-) (?:de\ +)? (?P<ty>\d{{4}})
 | {_NAME.replace("mon", "mon2")}\.? \ + (?P<ed>\d{{1,2}}),? \ + (?P<ey>\d{{4}}) )"""
_TIME = r"""(?: (?:t|,?\ +)(?:à\ +|às\ +|um\ +|at\ +|a\ +las\ +)? (?P<H>\d{1,2}) (?: [:h] (?P<M>\d{2}) (?: : (?P<S>\d{2}) (?: [.,] (?P<f>\d+) )? )?
 | (?P<M2>\d{2}) (?: (?P<S2>\d{2}) (?: [.,] (?P<f2>\d+) )? )? )
 (?: \ * (?P<ap>[ap])\.?m\.? )? (?:\ *uhr)? )?"""
_ZONE = r"(?: \ * (?: (?:utc|gmt)?(?P<sg>[+-])(?P<oh>\d{1,2})(?::?(?P<om>\d{2}))? | (?P<ab>[a-z]{1,5}) ) )? (?: \[ (?P<iana>[\w/+-]+) \] )?"
_WHOLE = re.compile(_DATE + _TIME + _ZONE, re.X)
_EPOCH = re.compile(r"(-?\d+)(?:\.(\d+))?")
_BASE = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


def _local(t: datetime, zone: str | None) -> int | None:
    z = _zone(zone)
    if z is None:
        return None
    utc = t.replace(tzinfo=z, fold=0).astimezone(timezone.utc)
    if utc.astimezone(z).replace(tzinfo=None) != t:
        return None  # the clocks skip this time
    return (utc.replace(tzinfo=None) - _BASE) // _MICRO


def _epoch(digits: str, part: str | None) -> int | None:
    n = len(digits.lstrip("-"))
    if part is not None:
        return int(digits) * 1_000_000 + int(part[:6].ljust(6, "0")) * (-1 if digits[0] == "-" else 1) if n <= 11 else None
    for most, micros in ((11, 1_000_000), (13, 1000), (16, 1)):
        if n in (most, most - 1, most - 2)[: 2 if most == 16 else 3]:
            return int(digits) * micros
    return int(digits) // 1000 if n in (18, 19) else None


def parse_instant(text: str | None, zone: str | None, locale: str | None) -> int | None:
    """Microseconds since 1970 UTC that the text denotes, or None.

    zone is for texts without zone and locale for numeric dates. A local time that occurs twice
    means the first, and 24:00 the end of the day; a skipped one, an impossible date or time, or a text that isn't exactly one
    date with an optional time denotes nothing. Digits beyond microseconds are cut off.
    """
    if text is None:
        return None
    s = text.strip().casefold().replace("−", "-").replace(" ", " ").replace(" ", " ")
    try:
        if m := _EPOCH.fullmatch(s):
            digits, part = m.groups()
            if part is None and len(digits) in (8, 12, 14) and digits[0] != "-":
                f = [int(digits[i:j]) for i, j in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14)) if digits[i:j]]
                return _local(datetime(*f), zone)
            micros = _epoch(digits, part)
            return micros if micros is not None and -62_135_596_800_000_000 <= micros < 253_402_300_800_000_000 else None
        m = _WHOLE.fullmatch(s)
        if not m:
            return None
        g = m.groupdict()
        if g["y"]:
            date = g["y"], g["m"], g["d"]
        elif g["n1"]:
            order = (locale or "").casefold()
            if order in MONTH_FIRST:
                date = g["n3"], g["n1"], g["n2"]
            elif order in YEAR_FIRST and len(g["n3"]) == 2:
                date = g["n1"], g["n2"], g["n3"]
            else:
                date = g["n3"], g["n2"], g["n1"]
            date = (date[0] if len(date[0]) == 4 else f"20{int(date[0]):02d}"), date[1], date[2]
        elif g["cy"]:
            date = g["cy"], g["cm"], g["cd"]
        else:
            name = g["mon"] or g["mon2"]
            if name not in MONTHS:
                return None
            date = g["ty"] or g["ey"], MONTHS[name], g["td"] or g["ed"]
        hour = int(g["H"] or 0)
        if g["ap"]:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (g["ap"] == "p")
        next_day = hour == 24 and not g["ap"]
        if next_day and set((g["M"] or "") + (g["S"] or "") + (g["M2"] or "") + (g["S2"] or "") + (g["f"] or g["f2"] or "")) - {"0"}:
            return None  # 24:00 is the end of the day, later times are impossible
        micro = int(((g["f"] or g["f2"] or "") + "000000")[:6])
        t = datetime(int(date[0]), int(date[1]), int(date[2]), 0 if next_day else hour, int(g["M"] or g["M2"] or 0), int(g["S"] or g["S2"] or 0), micro)
        t += timedelta(days=next_day)
        if g["wd"] and _WEEKDAYS[t.weekday()] != g["wd"]:
            return None
        if g["sg"]:
            if int(g["oh"]) > 18 or int(g["om"] or 0) > 59:
                return None
            off = (int(g["oh"]) * 60 + int(g["om"] or 0)) * (-1 if g["sg"] == "-" else 1)
        elif g["ab"]:
            if g["ab"] not in ABBREVIATIONS:
                return None
            off = ABBREVIATIONS[g["ab"]]
        else:
            return _local(t, m["iana"] and text[text.index("[") + 1 : text.index("]")] or zone)
        if not g["H"]:
            return None  # a zone needs a time
        micros = (t - _BASE) // _MICRO - off * 60_000_000
        return micros if -62_135_596_800_000_000 <= micros < 253_402_300_800_000_000 else None
    except (ValueError, OverflowError):
        return None
