"""Place scores: official codes, departments, cities, countries, distances."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import rewrite, split
from .text import normalize, normalized, ratio, round2, to_fixed, token_set_ratio

#: Fixed values of the place score.
LEAST, BOROUGH, LEAST_CODE, LEAST_DEPARTMENT, LEAST_CITY_ABROAD = 0.2, 0.9, 0.7, 0.7, 0.65
SWAPPED, LEAST_ABROAD, BLIND, PERFECT, EARTH_KM, NEAR_KM = 0.6, 0.4, 0.75, 0.75, 6370.693486, 20
ROOT = to_fixed(BLIND**0.5)
UNKNOWN_CITY = to_fixed((3 + LEAST_DEPARTMENT) / 4)
CAPITAL, SUBURBS = ("75", "78"), ("91", "92", "93", "94", "95")

_SMALL = "de|en|les|le|la|a|aux|au|du|de la|sous|ss?|sur|l|d|des"
#: Fixed patterns on normalised city names, in order, first match each (the two for particles: all matches).
CITY = (
    (r"^\s*(lyon|marseille|paris)(\s.*|\s*\d\d*.*|.*art.*|.*arr.*)$", r"\1", 1),
    (r"(^|\s)ste(\s|$)", r"\1sainte\2", 1),
    (r"(^|\s)st(\s|$)", r"\1saint\2", 1),
    (r"^aix pce$", "aix provence", 1),
    (rf"(^|\s)({_SMALL})\s", " ", 0),
    (rf"(^|\s)({_SMALL})\s", " ", 0),
    (r"\s+", " ", 1),
    (r"^.*inconnu.*$", "", 1),
    (r"sainte clotilde", "saint denis", 1),
    (r"berck mer", "berck", 1),
    (r"montreuil s.* bois", "montreuil", 1),
    (r"asnieres s.* seine", "asnieres", 1),
    (r"clichy garenne.*", "clichy", 1),
    (r"belleville saone", "belleville", 1),
    (r"^levallois$", "levallois perret", 1),
    (r"^\s*", "", 1),
)
COUNTRY = (
    (r"(^|\s)(de|en|les|le|la|a|aux|au|du|de la|s|sous|sur|l|d|des)\s", " ", 0),
    (r"hollande", "pays-bas", 1),
    (r"(angleterre|grande bretagne)", "royaume-uni", 1),
    (r"(vietnam)", "viet nam", 1),
)
DEPARTMENT = ((r"^0?2[ab]$", "20"), (r"^0*([1-9]+0?)$", r"\1"), (r"^(\D*|99|0)$", ""))
BOROUGH_NUMBER = ((r"^\D*0*([1-9]+0?)\D*$", r"\1"),)


def _many(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _rules(text: str | None, table: tuple) -> str:
    out = normalize(text)
    for pattern, by, count in table:
        out = re.sub(pattern, by, out, count=count)
    return out


def city_name(text: str | None) -> str:
    return _rules(text, CITY)


def _fuzzy(a: str, b: str, compare) -> float:
    if not a or not b:
        return 0.0
    a, b = normalize(a), normalize(b)
    return 1.0 if a == b else to_fixed(compare(a, b))


def _mixed(a: str, b: str) -> float:
    return token_set_ratio(a, b) if " " in a or " " in b else ratio(a, b)


def borough(city: str | None) -> str | None:
    found = rewrite(city or "", BOROUGH_NUMBER)
    return found if found != normalize(city) else None


def city_score(a, b) -> float:
    """Best similarity of the requested cities and the names of the recorded one."""
    best = 0.0
    recorded = [city_name(x) for x in _many(b)]
    for name in _many(a):
        s = max((_fuzzy(city_name(name), x, _mixed) for x in recorded), default=0.0)
        if s == 1 and isinstance(b, list) and len(b) > 1 and recorded[0] == "paris":
            number = borough(name)
            if number and number != borough(b[1]):
                s = BOROUGH
        best = max(best, s)
    return best


#: Old departments whose codes were dealt anew, and the middle of the codes that were.
_DEALT, _MOVED, _OVERSEAS, _ABROAD = ("91", "92", "93", "94"), "352", "98", "99"


def code_score(a, b) -> float:
    """Best similarity of the requested and recorded commune codes.

    Equal 1; else by the first rule that applies: a recorded code that was dealt anew, overseas against abroad, the same
    department, any other.
    """

    def one(x: str, y: str) -> float:
        x = x.zfill(5) if len(x) == 4 else x
        here, there = x[:2], y[:2]
        rules = (
            (x == y, 1.0),
            (there in (*_DEALT, _ABROAD) and y[2:5] == _MOVED, ROOT if here in _DEALT or x[2:5] == _MOVED else LEAST_CODE),
            ({here, there} == {_OVERSEAS, _ABROAD}, BLIND),
            (here == there, BLIND if here == _ABROAD else ROOT),
        )
        return next((value for applies, value in rules if applies), LEAST_CODE)

    return max((one(x, y) for x in _many(a) for y in _many(b)), default=LEAST_CODE)


def code_score_column(a: Column, b: Column) -> Column:
    """:func:`code_score` of two single codes, as an expression."""
    a = F.when(F.length(a) == 4, F.lpad(a, 5, "0")).otherwise(a)
    here, there, tail = F.substring(a, 1, 2), F.substring(b, 1, 2), F.substring(b, 3, 3)
    return (
        F.when(a == b, 1.0)
        .when(there.isin(*_DEALT, _ABROAD) & (tail == _MOVED), F.when(here.isin(*_DEALT) | (F.substring(a, 3, 3) == _MOVED), ROOT).otherwise(LEAST_CODE))
        .when(F.array_sort(F.array(here, there)) == F.array(F.lit(_OVERSEAS), F.lit(_ABROAD)), BLIND)
        .when(here == there, F.when(here == _ABROAD, BLIND).otherwise(ROOT))
        .otherwise(LEAST_CODE)
    )


def department(text) -> str:
    return rewrite(str(text) if text is not None else "", DEPARTMENT)


def department_score(a, b, same_city: bool | None) -> float | None:
    """None if either is no department.  ``same_city`` tells whether city or code agree, None if that is unknown."""
    pair = [department(x) for x in (a, b)]
    if not all(pair):
        return None
    if pair[0] == pair[1]:
        return 1.0
    if any(x in SUBURBS and y in CAPITAL for x, y in (pair, pair[::-1])):  # a suburb may have been of the capital
        return {True: 1.0, None: UNKNOWN_CITY, False: LEAST_DEPARTMENT}[same_city]
    return UNKNOWN_CITY if pair[0] == "97" else LEAST_DEPARTMENT


def department_score_column(a: Column, b: Column, same_city: Column) -> Column:
    """:func:`department_score` as an expression; null where either is no department."""

    def number(x: Column) -> Column:
        out = normalized(x)
        for pattern, by in DEPARTMENT:
            out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
        return out

    a, b = number(a), number(b)
    near = (a.isin(*SUBURBS) & b.isin(*CAPITAL)) | (b.isin(*SUBURBS) & a.isin(*CAPITAL))
    by_city = F.when(same_city.isNull(), UNKNOWN_CITY).when(same_city, 1.0).otherwise(LEAST_DEPARTMENT)
    return F.when((a != "") & (b != ""), F.when(a == b, 1.0).when(near, by_city).when(a == "97", UNKNOWN_CITY).otherwise(LEAST_DEPARTMENT))


def country_name(text: str | None) -> str:
    return _rules(text, COUNTRY)


def country_score(a, b) -> float:
    """Best similarity of the requested and recorded countries, one by one and each with all recorded ones joined.

    Several recorded names are joined as they are for one requested country, in normal form for a list of them; a list
    is also compared as a whole.
    """
    asked, recorded = _many(a), _many(b)
    wanted, names = [country_name(x) for x in asked], [country_name(x) for x in recorded]
    scores = [_fuzzy(x, y, token_set_ratio) for x in wanted for y in names]
    if isinstance(b, list):
        joined = " ".join(names if isinstance(a, list) else recorded)
        scores += [token_set_ratio(x, joined) for x in wanted]
    if isinstance(a, list):
        scores.append(token_set_ratio(" ".join(asked), " ".join(names)))
    return max(scores, default=0.0)


def distance_km(lat_a: float, lon_a: float, lat_b: float, lon_b: float) -> float:
    if (lat_a, lon_a) == (lat_b, lon_b):
        return 0.0
    x, y = math.radians(lat_a), math.radians(lat_b)
    c = math.sin(x) * math.sin(y) + math.cos(x) * math.cos(y) * math.cos(math.radians(lon_a - lon_b))
    return math.acos(max(-1.0, min(1.0, c))) * EARTH_KM


def geo_score(lat_a, lon_a, lat_b, lon_b) -> float:
    if lat_b is None or lon_b is None:
        return 0.0
    return to_fixed(max(0.0, NEAR_KM / (NEAR_KM + distance_km(lat_a, lon_a, lat_b, lon_b))))


def distance_column(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    x, y = F.radians(lat_a), F.radians(lat_b)
    c = F.sin(x) * F.sin(y) + F.cos(x) * F.cos(y) * F.cos(F.radians(lon_a - lon_b))
    return F.when((lat_a == lat_b) & (lon_a == lon_b), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) * EARTH_KM)


def geo_score_column(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    return round2(NEAR_KM / (NEAR_KM + distance_column(lat_a, lon_a, lat_b, lon_b)))


def score(a: dict, b: dict, communes: dict | None = None) -> dict:
    """Scores of the parts of a requested and a recorded place, and their blend as ``score``.

    Places are dicts of city, code, codePostal, codeHistory, departmentCode, country, countryCode, latitude, longitude;
    ``communes`` has lat, lon and code of normalised city names.
    """
    from .blend import reduce_scores

    out: dict = {}
    get, known = a.get, communes or {}
    if get("code") and b.get("code"):
        out["code"] = code_score(a["code"], b.get("codeHistory") or b["code"])
    if get("codePostal") and b.get("codePostal"):
        out["codePostal"] = code_score(a["codePostal"], b["codePostal"])
    if get("latitude") and get("longitude"):
        out["geo"] = geo_score(a["latitude"], a["longitude"], b.get("latitude"), b.get("longitude"))
    has = lambda key: any(normalize(x) for x in _many(get(key)))
    recorded_country = split(b.get("country")) if b.get("country") else None
    if b.get("countryCode") == "FRA":
        if has("country"):
            out["country"] = country_score(a["country"], recorded_country)
            if out.get("code", 0) >= ROOT and out["country"] < PERFECT:
                out["country"] = ROOT
        if has("city") and b.get("city"):
            out["city"] = city_score(a["city"], b["city"])
            spot = known.get(city_name(_many(a["city"])[0]))
            if out.get("code") == 1 and out["city"] < PERFECT:
                out["city"] = ROOT
            elif out["city"] < PERFECT and spot:
                out["code"] = code_score(spot["code"], b.get("codeHistory") or b.get("code"))
                near = geo_score(spot["lat"], spot["lon"], b.get("latitude"), b.get("longitude"))
                out["city"] = 1.0 if out["code"] >= PERFECT else max(near, out["city"])
        if has("departmentCode") and b.get("departmentCode"):
            same = True if out.get("city", 0) >= PERFECT else (out["code"] >= PERFECT) if out.get("code") else None
            found = department_score(a["departmentCode"], b["departmentCode"], same)
            if found is not None:
                out["department"] = BLIND**0.5 if out.get("code", 0) >= PERFECT > found else found
            elif get("departmentCode") == "99":
                if out.get("country", 1) < BLIND:
                    out["country"] = LEAST
                else:
                    out["department"] = LEAST_DEPARTMENT
        told = out.get("country", 1) < 1 or any(out.get(k) for k in ("code", "city", "department", "geo"))
        out["score"] = max(LEAST, reduce_scores(out)) if told else BLIND
        return out
    if has("country"):
        out["country"] = country_score(a["country"], recorded_country)
    elif has("city"):
        swapped = country_score(a["city"], recorded_country)
        if swapped > SWAPPED:
            out["country"] = swapped**0.3
    elif not out.get("code"):
        out["country"] = BLIND
    if has("city") and b.get("city"):
        found = city_score(a["city"], b["city"])
        out["city"] = max(LEAST_CITY_ABROAD, found) if out.get("country", 0) >= PERFECT else found
    out["score"] = max(LEAST_ABROAD, reduce_scores(out))
    return out
