"""Text normalisation and string similarity, as Spark expressions and as plain functions for Arrow batches."""

from __future__ import annotations

import math
import re
import unicodedata
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = "[\u0300-\u036f]"


def normalize(text: str | None) -> str:
    """Compatibility-decomposed, without accents, lower case, runs of other characters as one space; '' for null."""
    if text is None:
        return ""
    plain = re.sub(_MARKS, "", unicodedata.normalize("NFKD", text)).lower()
    return re.sub("[^a-z0-9]+", " ", plain).strip(" ")


@lru_cache
def _folding() -> tuple[str, str]:
    """Characters whose normalisation is a single ASCII letter or digit, and these: a table made by rule."""
    pairs = []
    for code in range(0x80, 0x10000):
        plain = re.sub(_MARKS, "", unicodedata.normalize("NFKD", chr(code)))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalized(text: Column) -> Column:
    """:func:`normalize` as an expression.  Ligatures of several letters count as separators; use the function for them."""
    plain = F.lower(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), _MARKS, ""), *_folding()))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def replace_first(text: Column, pattern: str, by: str) -> Column:
    """Replace the first match only (expressions replace all): the text before it is matched as a group of its own.

    Groups of ``pattern`` and references in ``by`` are numbered from 2.
    """
    return F.regexp_replace(text, f"^((?s:.)*?)(?:{pattern})", f"$1{by}")


def tokens(text: Column) -> Column:
    return F.split(text, r",\s*|\s+")


# ------------------------------------------------------------------ rounding


def let(x: Column, then) -> Column:
    """``then(x)`` with x computed once, however often ``then`` names it (conditionals would repeat it in their branches)."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _up(k: int) -> float:
    """The least double that is not below k - 0.5 hundredths."""
    tie = Fraction(2 * k - 1, 200)
    near = float(tie)
    return near if Fraction(near) >= tie else math.nextafter(near, 2)


#: From which value on k hundredths are the rounded value, of 0 to 1.
_UP = [-1.0, *(_up(k) for k in range(1, 101)), 2.0]


def round2(x: Column) -> Column:
    """Two decimals, half of the exact binary value up, as JavaScript's toFixed does.

    From 0 to 1 a table tells where the next hundredth begins, as formatting numbers takes several times as long.
    """
    tie = lambda v: v * 8 == F.floor(v * 8)
    up = F.array(*map(F.lit, _UP))
    guess = lambda v: F.floor(v * 100 + 0.5).cast("int")
    near = lambda v: let(guess(v), lambda k: (k + F.when(v < F.get(up, k), -1).when(v >= F.get(up, k + 1), 1).otherwise(0)) / 100)
    other = lambda v: F.when(tie(v), F.floor(v * 100 + 0.5) / 100).otherwise(F.regexp_replace(F.format_number(v, 2), ",", "").cast("double"))
    return let(x, lambda v: F.when((v >= 0) & (v <= 1), near(v)).otherwise(other(v)))


def to_fixed(x: float) -> float:
    """:func:`round2` of a number."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))


# ------------------------------------------------------------------ edit distance


def lev_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length, to two decimals; 0 if either is blank or null."""
    blank = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    return F.when(blank, 0.0).when(a == b, 1.0).otherwise(round2(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))))


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def damerau(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours is one edit (optimal string alignment)."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, row = row, now
    return row[-1]


def ratio(a: str, b: str, distance=levenshtein) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else to_fixed(1 - distance(a, b) / max(len(a), len(b)))


def damerau_short(a: Column, b: Column, length: int = 8, start: int = 1) -> Column:
    """Edit distance of short strings (dates) in which a swap of neighbours is one edit, with up to two swaps.

    The least of the plain distances from the string and from its copies with neighbours swapped.  Compared are the
    ``length`` characters from ``start`` on.  Each copy is cut from the column itself, as a copy of a copy would be made
    anew for each of its characters.  A swap changes a distance by two at most, so two swaps can give less than the least of
    all others only where each of them alone gives that least.
    """

    def swapped(*at: int) -> Column:
        pieces, done = [], 0
        for k in at:
            pieces += [F.substring(a, start + done, k - 1 - done)] * (k - 1 > done)
            pieces += [F.substring(a, start + k, 1), F.substring(a, start + k - 1, 1)]
            done = k + 1
        return F.concat(*pieces, *[F.substring(a, start + done, length - done)] * (done < length))

    b = F.substring(b, start, length)
    plain = F.levenshtein(F.substring(a, start, length), b)
    two = lambda v, m: [F.when((v[k] == m) & (v[j] == m), 2 + F.levenshtein(swapped(k, j), b)) for k in range(1, length) for j in range(k + 2, length)]
    both = lambda v: let(F.array_min(v), lambda m: F.when(m <= 2, m).otherwise(F.least(m, *two(v, m))))
    each = F.array(plain, *(1 + F.levenshtein(swapped(k), b) for k in range(1, length)))
    return F.when(plain <= 1, plain).otherwise(let(each, both))


# ------------------------------------------------------------------ phonetic and token similarity

#: Letter classes of the French Soundex; other letters have none.
SOUNDEX_FR = {"bp": "1", "ckq": "2", "dt": "3", "l": "4", "mn": "5", "r": "6", "gj": "7", "sxz": "8", "fv": "9"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CLASSES = "".join(next((d for letters, d in SOUNDEX_FR.items() if c in letters), "0") for c in _LETTERS)


def soundex_fr(text: str) -> str:
    """First letter and the classes of the next three sounding consonants, neighbours of one class counted once."""
    letters = re.sub("[^a-z]", "", text)
    if not letters:
        return ""
    codes = letters.translate(str.maketrans(_LETTERS, _CLASSES))
    codes = re.sub(r"(.)\1+", r"\1", codes)[1:].replace("0", "")
    return (letters[0] + codes + "000")[:4]


def soundex_fr_column(text: Column) -> Column:
    letters = F.regexp_replace(text, "[^a-z]", "")
    codes = F.regexp_replace(F.translate(letters, _LETTERS, _CLASSES), r"(.)\1+", "$1")
    codes = F.replace(F.substring(codes, F.lit(2), F.length(codes)), F.lit("0"), F.lit(""))
    return F.when(F.length(letters) == 0, "").otherwise(F.substring(F.concat(F.substring(letters, 1, 1), codes, F.lit("000")), 1, 4))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _percent(a: str, b: str) -> int:
    return 100 if a == b else int(200 * common_length(a, b) / (len(a) + len(b)) + 0.5) if a and b else 0


def token_sort_ratio(a: str, b: str) -> float:
    a, b = (" ".join(sorted(normalize(x).split())) for x in (a, b))
    return 0.01 * _percent(a, b) if a and b else 0.0


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(normalize(a).split()), set(normalize(b).split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join([both, *sorted(s - (x & y))]).strip() for s in (x, y))
    pairs = [(left, right)] + [(both, left), (both, right)] * bool(both)
    return 0.01 * max(_percent(p, q) for p, q in pairs)
