"""The blend of all part scores of a request and a person into one score."""

from __future__ import annotations

from dataclasses import dataclass

from . import dates, names, places
from .text import to_fixed

PERFECT, PRUNE, MULTI_ERROR = 0.75, 0.3, 0.8


def reduce_scores(parts: dict | None, several: bool = False) -> float:
    """One score from a dict of part scores (numbers, or dicts with a score of their own).

    A score that is there already counts.  Else the parts are multiplied; with ``several``, to a power that is the
    smaller the more of them are good.
    """
    if not parts:
        return 0.0
    if parts.get("score"):
        return to_fixed(parts["score"])
    each = [to_fixed(x) if not isinstance(x, dict) else (to_fixed(x["score"]) if x.get("score") else reduce_scores(x, several)) for k, x in parts.items() if k != "explain"]
    if not each:
        return 0.0
    product = 1.0
    for x in each:
        product *= x
    power = MULTI_ERROR * (2 - sum(x >= PERFECT for x in each) / len(each)) if several else 1
    return to_fixed(product**power)


@dataclass(frozen=True)
class Params:
    """Options of a comparison."""

    date_format_a: str | None = None
    date_format_b: str | None = None
    prune: float = PRUNE
    candidates: int = 1
    explain: bool = False


_PLACE_KEYS = ("city", "code", "country", "departmentCode", "latitude")


def compare(a: dict, b: dict, params: Params = Params(), communes: dict | None = None) -> dict:
    """Part scores of a requested and a recorded person, and ``score``.

    Persons are nested dicts: name (first, last, legal), sex, birth and death (date, location).  A part is scored only
    while the blend of those before it is above ``params.prune``; else the whole score is 0, as is all that follows.
    With ``params.explain`` the result has a dict of what was compared.
    """
    out: dict = {}
    birth_a, birth_b, death_a, death_b = (x.get(k) or {} for k in ("birth", "death") for x in (a, b))
    name_a, name_b = a.get("name") or {}, b.get("name") or {}
    alive = lambda: params.prune < reduce_scores(out, True)
    abroad = lambda event: bool((event.get("location") or {}).get("countryCode")) and event["location"]["countryCode"] != "FRA"
    dated = lambda x, y: dates.score(x["date"], y.get("date"), params.date_format_a, params.date_format_b, abroad(y))
    if birth_a.get("date"):
        out["birthDate"] = dated(birth_a, birth_b)
    if name_a.get("first") or name_a.get("last"):
        if alive() or not out.get("birthDate"):
            female = b.get("sex") == "F"
            last = [name_a.get("last"), name_a["legal"]] if female and name_a.get("legal") else name_a.get("last")
            out["name"] = names.score(name_a.get("first"), last, name_b.get("first"), name_b.get("last"), "F" if female else "M")
        else:
            out["score"] = 0.0
    if a.get("sex"):
        if alive():
            out["sex"] = names.sex(a["sex"], b.get("sex"))
        else:
            out["score"] = 0.0
    elif name_a.get("first") and names.sex_mismatch(name_a["first"], name_b.get("first")):
        out["sex"] = names.SEX_MISMATCH
    if alive():
        out["birthLocation"] = places.score(birth_a.get("location") or {}, birth_b.get("location") or {}, communes)
    else:
        out["score"] = 0.0
    if death_a.get("date"):
        if alive():
            out["deathDate"] = dated(death_a, death_b)
        else:
            out["score"] = 0.0
    place = death_a.get("location") or {}
    if any(place.get(k) for k in _PLACE_KEYS):
        if alive():
            out["deathLocation"] = places.score(place, death_b.get("location") or {}, communes)
        else:
            out["score"] = 0.0
    if not out.get("score"):
        out.pop("score", None)
        out["score"] = reduce_scores(out, True) if alive_parts(out) else 0.0
    if params.explain:
        out["explain"] = {k: v for k, v in out.items() if k != "score"}
    return out


def alive_parts(out: dict) -> bool:
    """Whether there is any part to blend."""
    return any(k not in ("score", "explain") for k in out)


def person_from_request(item: dict) -> dict:
    """The person that a request describes.

    A death age counts as the death date and a date of being seen alive as a lower limit of it, both only next to
    another death field; a point of the map counts only next to another field of its place.
    """
    pick = lambda pairs: {k: item[v] for k, v in pairs if item.get(v)}
    out: dict = {}
    if name := pick((("first", "firstName"), ("last", "lastName"), ("legal", "legalName"))):
        out["name"] = name
    if item.get("sex"):
        out["sex"] = item["sex"]
    for event in ("birth", "death"):
        place = pick((("city", f"{event}City"), ("code", f"{event}LocationCode"), ("departmentCode", f"{event}Department"), ("country", f"{event}Country")))
        if not place and not item.get(f"{event}Date"):
            continue
        found: dict = {}
        if event == "death" and item.get("lastSeenAliveDate"):
            found["date"] = f">{item['lastSeenAliveDate']}"
        if item.get(f"{event}Date"):
            found["date"] = item[f"{event}Date"]
        if event == "death" and item.get("deathAge"):
            found["date"] = str(item["deathAge"])
        point = item.get(f"{event}GeoPoint")
        if place or point:
            found["location"] = place | ({"latitude": point["latitude"], "longitude": point["longitude"]} if point else {})
        out[event] = found
    return out
