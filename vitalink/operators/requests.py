"""Requests: the fields that a search accepts, their validation, and their normal form."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..functions import dates

_PLACE = ("City", "LocationCode", "PostalCode", "Department", "Country", "GeoPoint")
SIMPLE = ("q", "fullText")
FIELDS = (
    *("firstName", "lastName", "legalName", "sex", "birthDate"), *(f"birth{x}" for x in _PLACE),
    *("deathDate", "deathAge", "lastSeenAliveDate"), *(f"death{x}" for x in _PLACE), "source",
)
CONTROL = ("id", "size", "page", "sort", "fuzzy", "block", "aggs", "aggsSize", "afterKey", "scroll", "scrollId", "dateFormat")
#: Names that sorting and grouping accept, and their columns.
SORT_COLUMNS = {
    "score": "rank", "firstName": "first", "lastName": "last", "sex": "sex", "birthDate": "birth_date", "birthCity": "birth_city",
    "birthLocationCode": "birth_code", "birthPostalCode": "birth_postal_code", "birthDepartment": "birth_department", "birthCountry": "birth_country",
    "deathDate": "death_date", "deathAge": "death_age", "deathCity": "death_city", "deathLocationCode": "death_code",
    "deathPostalCode": "death_postal_code", "deathDepartment": "death_department", "deathCountry": "death_country",
}

AGE = re.compile(r"^(|[0-9]|[1-9]([0-9]|[0-3][0-9]))$")
DATE = re.compile(r"^(|0000|1[89]\d{2}|20\d{2}|[0-3]\d/[0-1]\d/(1[89]\d{2}|20\d{2}))$")
SEX = re.compile(r"^(F|M|H)?$")
SOURCE = re.compile(r"\d{4}")


class RequestError(ValueError):
    """A request that cannot be run; ``messages`` has one entry for each reason."""

    def __init__(self, messages: list[str]):
        super().__init__("; ".join(messages))
        self.messages = messages


def is_age(text) -> bool:
    return AGE.match(str(text)) is not None


def is_age_or_range(text) -> bool:
    parts = str(text).split("-")
    if len(parts) == 1:
        return is_age(parts[0])
    return len(parts) == 2 and all(x and is_age(x) for x in parts) and int(parts[0]) < int(parts[1])


def is_date(text) -> bool:
    return DATE.match(str(text)) is not None


def is_date_or_range(text) -> bool:
    text = str(text)
    if dates.as_range(text):
        return all(map(is_date, text.split("-")))
    limit = dates.as_limit(text)
    return is_date(limit[1] if limit else text)


def is_flag(value) -> bool:
    return value in (True, False, "true", "false")


def as_flag(value) -> bool:
    return value in (True, "true")


def _parsed(value):
    """JSON text or the value itself; None if it can't be read."""
    if not isinstance(value, str):
        return value
    try:
        return json.loads(value)
    except ValueError:
        return None


def is_point(value) -> bool:
    point = _parsed(value)
    return isinstance(point, dict) and all(k in point for k in ("latitude", "longitude", "distance"))


def is_sort(value) -> bool:
    found = _parsed(value)
    if not isinstance(found, list) or not found:
        return False
    return all(isinstance(x, dict) and len(x) == 1 and next(iter(x)) in SORT_COLUMNS and next(iter(x.values())) in ("asc", "desc") for x in found)


def is_aggs(value) -> bool:
    found = _parsed(value)
    return isinstance(found, list) and bool(found) and all(x in SORT_COLUMNS for x in found)


MASKS = {
    "sex": lambda x: SEX.match(str(x)) is not None, "birthDate": is_date_or_range, "deathDate": is_date_or_range, "lastSeenAliveDate": is_date,
    "deathAge": is_age_or_range, "birthGeoPoint": is_point, "deathGeoPoint": is_point, "source": lambda x: SOURCE.search(str(x)) is not None,
    "fuzzy": is_flag, "sort": is_sort, "aggs": is_aggs,
}


def date_bounds(text: str) -> str | tuple[str | None, str | None]:
    """A date as yyyyMMdd (or a prefix of it), or the ends of a range or limit."""
    text = str(text)
    if (ends := dates.as_range(text)) is not None:
        return tuple(sorted(dates.from_french(x) for x in ends))
    if (limit := dates.as_limit(text)) is not None:
        end = dates.from_french(limit[1])
        return (end, None) if limit[0] == ">" else (None, end)
    return dates.from_french(text)


def age_bounds(text) -> int | tuple[int, int]:
    parts = sorted(map(int, str(text).split("-")))
    return parts[0] if len(parts) == 1 else (parts[0], parts[1])


@dataclass(frozen=True)
class Block:
    """A blocking rule: of the scope's fields so many must match; the others only rank if ``should``."""

    scope: tuple[str, ...] = ("name", "birthDate")
    minimum_match: int = 1
    should: bool = True


@dataclass
class SearchRequest:
    """A validated request.  ``values`` has the normal form of each field that is given."""

    values: dict
    size: int = 20
    page: int = 1
    sort: list[tuple[str, str]] = field(default_factory=lambda: [("score", "desc")])
    fuzzy: bool = True
    block: Block | None = None
    aggs: list[str] = field(default_factory=list)
    aggs_size: int = 250
    uid: str | None = None

    @property
    def full_text(self) -> str | None:
        return self.values.get("q")

    def echo(self) -> dict:
        """The fields that have a value, names spread into first, last and legal."""
        return dict(self.values)


def parse(raw: dict, aggregation: bool = False) -> SearchRequest:
    """Validate a request; RequestError with one message for each rule that fails."""
    errors = [f"unknown parameter {k}" for k in raw if k not in SIMPLE + FIELDS + CONTROL]
    given = {k: v for k, v in raw.items() if v is not None and v != ""}
    simple, complex_ = [k for k in given if k in SIMPLE], [k for k in given if k in FIELDS]
    if simple and complex_:
        errors.append("simple and complex request at the same time")
    if not simple and not complex_ and "id" not in given and not (aggregation and "aggs" in given):
        errors.append("empty request")
    if aggregation and "aggs" not in given:
        errors.append("missing aggs")
    errors += [f"invalid {k} value" for k, v in given.items() if k in MASKS and not MASKS[k](v)]
    if errors:
        raise RequestError(errors)
    values = {}
    for k in simple:
        values["q"] = str(given[k])
    for k in complex_:
        v = given[k]
        if k in ("birthDate", "deathDate"):
            v = date_bounds(v)
        elif k == "sex":
            v = re.sub("^H$", "M", v)
        elif k == "deathAge":
            v = age_bounds(v)
        elif k.endswith("GeoPoint"):
            v = _parsed(v)
        values[k] = v
    if "lastSeenAliveDate" in values:  # wins over a death date
        values["deathDate"] = (dates.from_french(str(values.pop("lastSeenAliveDate"))), None)
    sort = [next(iter(x.items())) for x in _parsed(given["sort"])] if "sort" in given else [("score", "desc")]
    block = given.get("block")
    if isinstance(block, dict):
        block = Block(tuple(block["scope"]), block.get("minimum_match", 1), block.get("should", True))
    return SearchRequest(values, int(given.get("size", 20)), int(given.get("page", 1)), sort, as_flag(given.get("fuzzy", True)), block, list(_parsed(given["aggs"])) if "aggs" in given else [], int(given.get("aggsSize", 250)), given.get("id"))
