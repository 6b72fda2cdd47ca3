"""Partial dates as strings: reformatting, padding, and date scores.

Dates are ``yyyyMMdd`` with unknown parts as zeros.  They are never cast: impossible and partial dates must survive.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import damerau, damerau_short, ratio, round2, to_fixed

#: Fixed values of the date score.
BLIND, UNCERTAIN, LEAST, POWER = 0.85, 0.95, 0.2, 2.5
YEAR_MS = 31_536_000_000

_ONE = r"\d{4}|\d{4}.?\d{2}.?\d{2}|\d{2}.?\d{2}.?\d{4}"
RANGE = re.compile(rf"^({_ONE})-({_ONE})$")
_PARTS = (("yyyy", 4), ("MM", 2), ("dd", 2))


def as_range(text: str) -> tuple[str, str] | None:
    m = RANGE.match(text) if len(text) == 9 or len(text) > 10 else None
    return (m[1], m[2]) if m else None


def as_limit(text: str) -> tuple[str, str] | None:
    return (text[0], text[1:]) if text[:1] in ("<", ">") else None


def _places(pattern: str) -> dict[str, int]:
    """Where year, month and day start in a pattern; either case of a part, the usual one first."""
    found = {}
    for part, _ in _PARTS:
        for name in (part, part.swapcase()):
            if name in pattern:
                found[part] = pattern.index(name)
                break
    return found


def reformat(text: str, source: str, target: str = "yyyyMMdd") -> str:
    """A date cut by the places of a pattern and put together by another; parts that are not given are zeros."""
    if not text or not text.strip():
        return ""
    if source == target:
        return text
    places, out = _places(source), target
    for part, size in _PARTS:
        value = text[places[part] : places[part] + size] if part in places else "0" * size
        out = out.replace(part, value, 1) if part in out else out.replace(part.swapcase(), value, 1)
    return out


def reformatted(text: Column, source: str, target: str = "yyyyMMdd") -> Column:
    """:func:`reformat` as an expression."""
    places = _places(source)
    pieces, rest = [], target
    while rest:
        for part, size in _PARTS:
            if rest.startswith((part, part.swapcase())):
                pieces.append(F.substring(text, places[part] + 1, size) if part in places else F.lit("0" * size))
                rest = rest[size:]
                break
        else:
            pieces.append(F.lit(rest[0]))
            rest = rest[1:]
    blank = F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0
    return F.when(blank, "").otherwise(text if source == target else F.concat(*pieces))


def from_french(text: str) -> str:
    """dd/MM/yyyy as yyyyMMdd, at its first occurrence; all else as it is."""
    return re.sub(r"(\d{2})/(\d{2})/(\d{4})", r"\3\2\1", text, count=1)


def from_french_column(text: Column) -> Column:
    return F.regexp_replace(text, r"^((?s:.)*?)(\d{2})/(\d{2})/(\d{4})", "$1$4$3$2")


def to_french(text: Column) -> Column:
    return F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$3/$2/$1")


def lower_bound(text: str) -> str:
    return text.ljust(8, "0")


def upper_bound(text: str) -> str:
    return text.ljust(8, "9")


def _day(text: str) -> date | None:
    """The day of a yyyyMMdd string; months and days beyond their end run on into the next."""
    try:
        year, month, day = int(text[:4]), int(text[4:6]), int(text[6:8])
        year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
        return date(year, month, 1) + timedelta(days=day - 1)
    except (ValueError, OverflowError):
        return None


def _raw(a: str, b: str, foreign: bool) -> float:
    a = a.strip()
    if not a or not b or b == "00000000":
        return BLIND
    if (ends := as_range(a)) is not None:
        if ends[0] == ends[1]:
            return _raw(ends[0], b, foreign)
        unknown = b.startswith("0000") or b.endswith("0000")
        return UNCERTAIN if ends[0] <= b <= ends[1] or unknown else LEAST
    if (limit := as_limit(a)) is not None:
        return UNCERTAIN if (limit[1] <= b if limit[0] == ">" else limit[1] >= b) else LEAST
    a = from_french(a)
    if a == b:
        return 1.0
    if b.startswith("0000"):
        return to_fixed(UNCERTAIN * ratio(a[4:8], b[4:8], damerau) ** 2)
    year = ratio(a[:4], b[:4], damerau) ** 2
    if b.endswith("0000"):
        return to_fixed(UNCERTAIN * year)
    if a.endswith("0101") or b.endswith("0101"):
        return to_fixed((UNCERTAIN if foreign and b[:4] < "1990" else UNCERTAIN**2) * year)
    same_month = to_fixed(UNCERTAIN**2) if a[:6] == b[:6] else 0.0
    x, y = _day(a), _day(b)
    near = 0.0 if x is None or y is None else to_fixed(1 - (((x - y).days * 86_400_000 / YEAR_MS) ** 2) ** 0.2)
    return max(ratio(a, b, damerau), same_month, near)


def score(a: str | None, b: str | None, format_a: str | None = None, format_b: str | None = None, foreign: bool = False) -> float:
    """Similarity of a requested date, limit or range and a recorded date."""
    if not a or not b or b == "00000000":
        return BLIND
    if format_b:
        b = reformat(b, format_b)
    if format_a:
        if (ends := as_range(a)) is not None:
            a = "-".join(reformat(x, format_a) for x in ends)
        elif (limit := as_limit(a)) is not None:
            a = limit[0] + reformat(limit[1], format_a)
        else:
            a = reformat(a, format_a)
    return 0.01 * int(_raw(a, b, foreign) ** POWER * 100 + 0.5)


#: Ratios of strings of up to eight characters, to two decimals, by the longer length and the distance.
_RATIOS = [to_fixed(1 - d / max(n, 1)) for n in range(9) for d in range(9)]


def _ratio8(a: Column, b: Column, start: int, size: int) -> Column:
    x, y = F.substring(a, start, size), F.substring(b, start, size)
    at = F.greatest(F.length(x), F.length(y)) * 9 + damerau_short(a, b, size, start)
    return F.when(x == y, 1.0).otherwise(F.get(F.array(*map(F.lit, _RATIOS)), at))


def _days(text: Column) -> Column:
    """Days since 1970 of a yyyyMMdd string; months and days beyond their end run on into the next."""
    year, month, day = (F.substring(text, i, n).cast("int") for i, n in ((1, 4), (5, 2), (7, 2)))
    return F.datediff(F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1), F.lit("1970-01-01").cast("date"))


def score_column(a: Column, b: Column, foreign: Column | None = None) -> Column:
    """:func:`score` of two single yyyyMMdd dates, as an expression."""
    foreign = F.lit(False) if foreign is None else foreign
    year = F.pow(_ratio8(a, b, 1, 4), 2)
    uncertain = F.when(foreign & (F.substring(b, 1, 4) < "1990"), F.lit(UNCERTAIN)).otherwise(F.lit(UNCERTAIN**2))
    same_month = F.when(F.substring(a, 1, 6) == F.substring(b, 1, 6), F.lit(to_fixed(UNCERTAIN**2))).otherwise(0.0)
    apart = (_days(a) - _days(b)) * F.lit(86_400_000.0) / F.lit(float(YEAR_MS))
    near = round2(F.greatest(1 - F.pow(F.pow(apart, 2), 0.2), F.lit(0.0)))
    blank = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0) | (b == "00000000")
    raw = (
        F.when(a == b, 1.0)
        .when(b.startswith("0000"), round2(UNCERTAIN * F.pow(_ratio8(a, b, 5, 4), 2)))
        .when(b.endswith("0000"), round2(UNCERTAIN * year))
        .when(a.endswith("0101") | b.endswith("0101"), round2(uncertain * year))
        .otherwise(F.greatest(_ratio8(a, b, 1, 8), same_month, near))
    )
    return F.when(blank, BLIND).otherwise(0.01 * F.floor(F.pow(raw, POWER) * 100 + 0.5))
