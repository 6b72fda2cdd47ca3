"""Search: requests compiled to predicates and a rank over a table of persons.

Persons are the flat columns uid, first, second_name (or an array ``first_names``), last, sex, birth_date, death_date,
death_age, and the place columns that a request names.  Exact conditions are plain comparisons, so they reach the scan.
The rank is a sum of boosts, an approximation of a search server's relevance; it orders results and is no contract.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.places import EARTH_KM, distance_column
from ..functions.text import normalize, normalized
from .requests import SORT_COLUMNS, Block, SearchRequest

#: Words that are no names of their own in a full text.
PARTICLES = ("el", "d", "le", "de", "la", "los")
EQUAL = {
    "birthPostalCode": "birth_postal_code", "deathPostalCode": "death_postal_code", "birthLocationCode": "birth_code", "deathLocationCode": "death_code",
    "birthDepartment": "birth_department", "deathDepartment": "death_department", "sex": "sex", "source": "source",
}
PLACES = {"birthCity": "birth_city", "deathCity": "death_city", "birthCountry": "birth_country", "deathCountry": "death_country"}


def _swaps(a: Column, then) -> Column:
    """Whether ``then`` holds for the string with some two neighbours swapped."""
    n = F.length(a)

    def turned(i: Column) -> Column:
        one = lambda k: F.substring(a, k, F.lit(1))
        return then(F.concat(F.substring(a, F.lit(1), i - 1), one(i + 1), one(i), F.substring(a, i + 2, n)))

    return (n > 1) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), turned)


def within_edits(a: Column, b: Column, k: int) -> Column:
    """Whether an edit distance in which a swap of neighbours is one edit is at most ``k`` (0, 1 or 2)."""
    close = lambda x, t: F.levenshtein(x, b, t) >= 0
    if k == 0:
        return a == b
    out = close(a, k) | _swaps(a, lambda x: close(x, k - 1))
    if k == 2:
        letters = lambda x: F.array_sort(F.split(x, ""))
        out = out | ((F.length(a) == F.length(b)) & (letters(a) == letters(b)) & _swaps(a, lambda x: _swaps(x, lambda y: y == b)))
    # a swap is two plain edits and changes no length: most pairs end here
    return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= k) & close(a, 2 * k) & out)


def auto_edits(length: int) -> int:
    return 0 if length <= 2 else 1 if length <= 5 else 2


def within_auto(a: Column, b: Column) -> Column:
    """:func:`within_edits` with the edits that the length of ``b`` allows."""
    n = F.length(b)
    return F.when(n <= 2, a == b).when(n <= 5, within_edits(a, b, 1)).otherwise(within_edits(a, b, 2))


def words_of(text: Column) -> Column:
    return F.split(normalized(text), " ")


def match(column: Column, value: str, fuzzy: int | None = 0) -> Column:
    """Any word of a column equal to any word of the value, up to ``fuzzy`` edits (None: by the word's length)."""
    words = normalize(value).split()
    if not words:
        return F.lit(False)
    tests = [(w, auto_edits(len(w)) if fuzzy is None else fuzzy) for w in words]
    if all(k == 0 for _, k in tests):
        return F.arrays_overlap(words_of(column), F.array(*(F.lit(w) for w, _ in tests)))
    return F.exists(words_of(column), lambda t: reduce(or_, [within_edits(t, F.lit(w), k) for w, k in tests]))


def one_of(column: Column, is_array: bool, value) -> Column:
    return F.array_contains(column, str(value)) if is_array else column == str(value)


def date_predicate(column: Column, value, fuzzy: bool) -> tuple[Column, Column]:
    """(predicate, exact match) of a date, prefix, limit or range on a yyyyMMdd string column."""
    if isinstance(value, tuple):
        low, high = value
        tests = []
        if low is not None:
            tests.append(column >= dates.lower_bound(low))
        if high is not None:
            tests.append(column <= dates.upper_bound(high))
        return reduce(and_, tests), F.lit(False)
    if len(value) < 8:
        return column.startswith(value), F.lit(False)
    exact = column == value
    return (within_edits(column, F.lit(value), 2) if fuzzy else exact), exact


def age_predicate(column: Column, value) -> Column:
    return column.between(*value) if isinstance(value, tuple) else column == value


def distance_m(text: str) -> float:
    """Metres of a distance such as 10km; 1 km where it can't be read."""
    import re

    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(km|m|mi)\s*", str(text))
    return float(m[1]) * {"km": 1000, "m": 1, "mi": 1609.344}[m[2]] if m else 1000.0


def geo_predicate(lat: Column, lon: Column, point: dict) -> Column | None:
    """Within a distance of a point: a bounding box, which reaches the scan, and the great circle.  None for latitude or longitude 0."""
    import math

    a, b = float(point["latitude"]), float(point["longitude"])
    if not a or not b:
        return None
    km = distance_m(point.get("distance", "")) / 1000
    d_lat = math.degrees(km / EARTH_KM)
    near = distance_column(F.lit(a), F.lit(b), lat, lon) <= km
    c = math.cos(math.radians(a))
    if abs(a) + d_lat >= 89 or math.sin(km / EARTH_KM / 2) >= c:
        return near
    d_lon = math.degrees(2 * math.asin(min(1.0, math.sin(km / EARTH_KM / 2) / c))) * 1.01
    box = lat.between(a - d_lat * 1.001, a + d_lat * 1.001)
    return (box & lon.between(b - d_lon, b + d_lon) if abs(b) + d_lon < 180 else box) & near


def first_names(people: DataFrame) -> Column:
    return F.concat_ws(" ", F.col("first_names")) if "first_names" in people.columns else F.concat_ws(" ", "first", "second_name") if "second_name" in people.columns else F.col("first")


def at_least(tests: list[Column], k: int) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(t.cast("int"), F.lit(0)) for t in tests]) >= k


def name_predicate(people: DataFrame, values: dict, fuzzy: bool, must: bool = True) -> tuple[Column, Column]:
    """(predicate, rank) of first, last and legal names; two of them must match if first and last are given.

    Fuzzily, first and last name may also stand in each other's place.
    """
    first, last, legal = (values.get(k) for k in ("firstName", "lastName", "legalName"))
    k = (2 if first and last else 1) - (0 if must else 1)
    edits = None if fuzzy else 0
    many, own, family = first_names(people), F.col("first"), F.col("last")
    tests = [match(many if fuzzy else own, first, edits)] * bool(first) + [match(family, x, edits) for x in (last, legal) if x]
    straight = at_least(tests, max(k, 1))
    points = lambda ts: reduce(lambda a, b: a + b, [F.coalesce(t.cast("int"), F.lit(0)) for t in ts])
    rank = 2.0 * points(tests)
    if first:
        rank = rank + 4.0 * points([match(own, first)])
    if not fuzzy:
        return straight, rank
    turned = [match(family, first, None)] * bool(first) + [match(many, last, None)] * bool(last)
    return straight | at_least(turned, max(k, 1)), rank + 0.5 * points(turned)


def full_text_parts(text: str) -> tuple[str | None, list[str]]:
    """(the first dd/mm/yyyy date of a free text, as yyyyMMdd; its names)."""
    import re
    import unicodedata

    words = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", text)).split()
    day = next((dates.from_french(w) for w in words if re.fullmatch(r"\d{2}/\d{2}/\d{4}", w)), None)
    return day, [w for w in words if re.search("[A-Za-z]", w) and w.lower() not in PARTICLES]


def full_text_predicate(people: DataFrame, text: str) -> tuple[Column, Column]:
    """(predicate, rank) of a free text: one dd/mm/yyyy date, and names; with two names, one is the last name."""
    day, names = full_text_parts(text)
    born = ((F.col("birth_date") == day) | (F.col("death_date") == day)) if day else None
    if not names:
        return (born, F.lit(1.0)) if day else (F.lit(True), F.lit(1.0))
    many, family = first_names(people), F.col("last")
    everything = F.concat_ws(" ", many, family)
    found = match(everything, " ".join(names), None)
    rank = reduce(lambda a, b: a + b, [match(everything, n, None).cast("int") + 2.0 * match(everything, n).cast("int") for n in names])
    if len(names) == 2:
        a, b = names
        found = found & ((match(family, a, None) & match(many, b, None)) | (match(family, b, None) & match(many, a, None)))
    return found, rank + (4.0 * born.cast("int") if day else 0.0)


def predicates(people: DataFrame, request: SearchRequest) -> dict[str, tuple[Column, Column]]:
    """(predicate, rank) of each field of a request, names together under ``name``."""
    v, fuzzy, none = request.values, request.fuzzy, F.lit(0.0)
    kinds = dict(people.dtypes)
    out: dict[str, tuple[Column, Column]] = {}
    if v.get("firstName") or v.get("lastName") or v.get("legalName"):
        out["name"] = name_predicate(people, v, fuzzy)
    for key, value in v.items():
        if key in ("birthDate", "deathDate"):
            test, exact = date_predicate(F.col("birth_date" if key == "birthDate" else "death_date"), value, fuzzy)
            out[key] = test, 2.0 * exact.cast("int")
        elif key == "deathAge":
            out[key] = age_predicate(F.col("death_age"), value), none
        elif key in EQUAL:
            column = EQUAL[key]
            out[key] = one_of(F.col(column), kinds[column].startswith("array"), value), none
        elif key in PLACES:
            column = F.col(PLACES[key])
            exact = normalized(column) == normalize(value)
            out[key] = (match(column, value, None) if fuzzy else exact), 2.0 * exact.cast("int")
        elif key.endswith("GeoPoint"):
            test = geo_predicate(F.col("lat"), F.col("lon"), value) if key == "birthGeoPoint" else geo_predicate(F.col("death_lat"), F.col("death_lon"), value)
            if test is not None:
                out[key] = test, none
    return out


def block_predicate(tests: dict[str, tuple[Column, Column]], block: Block) -> Column:
    return at_least([tests[k][0] for k in block.scope if k in tests], min(block.minimum_match, sum(k in tests for k in block.scope)))


def adaptive_block_predicate(people: DataFrame, request: SearchRequest) -> Column:
    """The block of requests with first and last name: a name word and the birth date near, and one thing exact.

    Near: a word within the edits that its length allows; a date within one edit or of the same year, or in the range.
    Exact: the last name, the legal name, the birth date or the death date.
    """
    v = request.values
    tests = [match(F.concat_ws(" ", first_names(people), "last"), f"{v['lastName']} {v['firstName']}", None)]
    exact = [match(F.col("last"), v[k]) for k in ("lastName", "legalName") if v.get(k)]
    for key, column in (("birthDate", F.col("birth_date")), ("deathDate", F.col("death_date"))):
        day = v.get(key)
        if isinstance(day, tuple):
            tests.append(date_predicate(column, day, False)[0])
        elif day and len(day) == 8:
            exact.append(column == day)
            if key == "birthDate":
                tests.append(within_edits(column, F.lit(day), 1) | column.startswith(day[:4]))
        elif day:
            tests.append(column.startswith(day))
    return reduce(and_, tests) & reduce(or_, exact)


def compile_request(people: DataFrame, request: SearchRequest) -> tuple[Column, Column]:
    """(predicate, rank) of a whole request: full text, id, block, or all fields."""
    if request.full_text:
        return full_text_predicate(people, request.full_text)
    if request.uid is not None:
        return F.col("uid").cast("string") == str(request.uid), F.lit(1.0)
    tests = predicates(people, request)
    if not tests:
        return F.lit(True), F.lit(1.0)
    rank = reduce(lambda a, b: a + b, [r for _, r in tests.values()]) + 1.0
    if request.block:
        both = request.values.get("firstName") and request.values.get("lastName")
        return (adaptive_block_predicate(people, request) if both else block_predicate(tests, request.block)), rank
    return reduce(and_, [t for t, _ in tests.values()]), rank


def ordered(rows: DataFrame, sort: list[tuple[str, str]], tie: str = "uid") -> DataFrame:
    """Sort by the public names of columns; missing values come last either way, ties go by id."""
    columns = []
    for name, way in sort:
        column = F.col(SORT_COLUMNS[name])
        columns.append(column.desc_nulls_last() if way == "desc" else column.asc_nulls_last())
    return rows.orderBy(*columns, F.asc(tie))


def search(people: DataFrame, request: SearchRequest, least_rank: float = 0.0) -> DataFrame:
    """All matches of a request with their rank."""
    test, rank = compile_request(people, request)
    rows = people.where(test).withColumn("rank", rank.cast("double"))
    return rows.where(F.col("rank") >= least_rank) if least_rank else rows


def page(rows: DataFrame, request: SearchRequest) -> DataFrame:
    """The page of a request in its order; the top rows are kept by each task and merged, not sorted as a whole."""
    rows = ordered(rows, request.sort)
    skip = (request.page - 1) * request.size
    return rows.offset(skip).limit(request.size) if skip else rows.limit(request.size)


def scroll(rows: DataFrame, request: SearchRequest) -> Iterator[list]:
    """All rows in the request's order, a list of its size at a time; one partition at a time comes to the driver."""
    part: list = []
    for row in ordered(rows, request.sort).toLocalIterator(prefetchPartitions=True):
        part.append(row)
        if len(part) == request.size:
            yield part
            part = []
    if part:
        yield part


def search_many(people: DataFrame, asked: dict[int, SearchRequest]) -> DataFrame:
    """The pages of several requests in one plan, told apart by ``qid``.  For tables of requests see linkage."""
    return reduce(DataFrame.unionByName, [page(search(people, r), r).withColumn("qid", F.lit(q)) for q, r in asked.items()])


def lookup(people: DataFrame, uid) -> DataFrame:
    return people.where(F.col("uid") == F.lit(uid))


def status(people: DataFrame) -> DataFrame:
    """Number of persons, and the last source and death date."""
    return people.agg(F.count(F.lit(1)).alias("records"), F.max(F.struct("source", "death_date")).alias("last")).select("records", F.col("last.source").alias("last_source"), F.col("last.death_date").alias("last_death_date"))


def bm25(people: DataFrame, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """uid and rank of persons by Okapi BM25 over all their names; document frequencies are one aggregate over all persons."""
    terms = sorted(set(normalize(text).split()))
    rows = people.select("uid", words_of(F.concat_ws(" ", first_names(people), "last")).alias("w"))
    hits = [F.size(F.array_intersect("w", F.array(F.lit(q)))) for q in terms]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean"), *(F.sum(F.when(h > 0, 1).otherwise(0)).alias(f"df{i}") for i, h in enumerate(hits))).first()
    if not terms or not stats["n"]:
        return rows.select("uid", F.lit(0.0).alias("rank")).limit(0)
    import math

    total = F.lit(0.0)
    for i, h in enumerate(hits):
        idf = math.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        total = total + idf * h * (k1 + 1) / (h + k1 * (1 - b + b * F.size("w") / F.lit(float(stats["mean"]))))
    return rows.select("uid", total.alias("rank")).where("rank > 0")
