"""Scores of candidate pairs: the comparison as an Arrow-batched function, and the penalties of a candidate set as windows."""

from __future__ import annotations

import json
from functools import lru_cache, reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, names
from ..functions.blend import MULTI_ERROR, PERFECT, PRUNE, Params, compare, person_from_request
from ..functions.names import WRONG_LAST
from ..functions.places import BLIND as BLIND_PLACE
from ..functions.text import normalized, round2

#: Fixed values of the candidate-set penalties.
FLOOR, PERFECT_PENALTY, BEST_PENALTY, SECOND_POWER, SECOND_LEAST = 0.5, 0.1, 0.15, 2, 0.4

SCORES = "score double, birthDate double, deathDate double, sex double, name double, name_first double, name_last double, birthLocation double, deathLocation double, n_parts int, explain string"
_PARTS = ("birthDate", "name", "sex", "birthLocation", "deathDate", "deathLocation")


def _number(x) -> float | None:
    return x.get("score") if isinstance(x, dict) else x


@lru_cache(maxsize=1 << 14)
def _person(text: str) -> dict:
    return json.loads(text)


def pair_scores(params: Params = Params(), communes: dict | None = None):
    """An Arrow-batched function of (request, person), both JSON of the nested shape, that gives the SCORES columns.

    Equal pairs of a batch are compared once, pairs with a null not at all.  A pair whose values cannot be compared (a
    number where a text should be) has a null score and says why in ``explain``.
    """

    @F.pandas_udf(SCORES)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows: list = [(None,) * len(SCORES.split(", "))] * len(a)
        for at, (x, y) in enumerate(zip(a, b, strict=True)):
            if x is None or y is None:
                continue
            if (x, y) not in known:
                try:
                    s = compare(_person(x), _person(y), params, communes)
                except (TypeError, ValueError) as error:
                    s = {}
                    known[x, y] = (None,) * 9 + (0, f"failed: {error}")
                    rows[at] = known[x, y]
                    continue
                name = s.get("name")
                first, last = (name.get("first"), name.get("last")) if isinstance(name, dict) else (None, None)
                n = sum(k in s for k in _PARTS)
                known[x, y] = (s.get("score"), s.get("birthDate"), s.get("deathDate"), s.get("sex"), _number(name), first, last, _number(s.get("birthLocation")), _number(s.get("deathLocation")), n, json.dumps(s) if params.explain else None)
            rows[at] = known[x, y]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCORES.split(", ")])

    return run


def blended(*parts: Column) -> Column:
    """The blend of part scores; null ones are left out."""
    each = F.filter(F.array(*(round2(x) for x in parts)), F.isnotnull)
    good = lambda x: F.size(F.filter(x, lambda v: v >= PERFECT)) / F.size(x)
    product = lambda x: F.aggregate(x, F.lit(1.0), lambda acc, v: acc * v)
    return F.element_at(F.transform(F.array(each), lambda x: F.when(F.size(x) > 0, round2(F.pow(product(x), MULTI_ERROR * (2 - good(x))))).otherwise(0.0)), 1)


#: Names and dates whose comparison the expressions cover: Latin letters, one word; a day.
_LATIN, _DAY = r"^[\x20-\x7E\u00C0-\u00FF]*$", "^[0-9]{8}$"


_one = lambda w: (w != "") & ~w.contains(" ") & ~w.isin(*names.UNKNOWN)
_latin = lambda *texts: reduce(and_, [F.coalesce(t, F.lit("")).rlike(_LATIN) for t in texts])
_day = lambda d: F.coalesce(d, F.lit("")).rlike("^$|" + _DAY)


def asked_forms(requests: DataFrame) -> DataFrame:
    """Requests (first_q, last_q, sex_q, birth_q) with what the expressions compare, and whether these cover them.

    Those with a birth place are left to the function.
    """
    first, last = normalized(F.col("first_q")), normalized(F.col("last_q"))
    covered = _one(first) & _one(last) & _latin(F.col("first_q"), F.col("last_q")) & _day(F.col("birth_q")) & (F.coalesce(F.col("sex_q"), F.lit("")) != "")
    for c in ("city_q", "code_q", "department_q", "country_q", "lat_q", "lon_q"):
        if c in requests.columns:
            covered = covered & (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return requests.withColumns({"_fq": names.form(first), "_lq": names.form(last), "_plain_q": F.coalesce(covered, F.lit(False))})


def known_forms(people: DataFrame) -> DataFrame:
    """Persons (first, second_name, last, birth_date) with what the expressions compare, and whether these cover them."""
    given = [F.col(c) for c in ("first", "second_name") if c in people.columns]
    last = normalized(F.col("last"))
    tokens = F.filter(F.split(F.concat_ws(" ", *map(normalized, given)), " "), lambda t: t != "")
    known = ~F.arrays_overlap(tokens, F.array(*map(F.lit, names.UNKNOWN))) & (F.size(tokens) > 0) & F.col("first").isNotNull()
    covered = _one(last) & known & _latin(F.col("last"), *given) & _day(F.col("birth_date"))
    return people.withColumns({"_lp": names.form(last), "_fp": F.transform(tokens, names.form), "_plain_p": F.coalesce(covered, F.lit(False))})


def plain(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """Pairs with the column ``plain``: whether :func:`with_plain_scores` covers them.

    Rows have the columns of :func:`asked_forms` and :func:`known_forms`; what these add is added where it is missing.
    """
    rows = rows if "_plain_q" in rows.columns else asked_forms(rows)
    rows = rows if "_plain_p" in rows.columns else known_forms(rows)
    return rows.withColumn("plain", F.col("_plain_q") & F.col("_plain_p") & F.lit(not (params.date_format_a or params.date_format_b)))


def with_plain_scores(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """The SCORES columns, by the names ``_score``, ``_birthDate`` ..., of rows from :func:`plain`, as expressions.

    A request without a place leaves the place open, whatever the person's.  Each part is scored only while the blend of
    those before it is above ``params.prune``.  With ``params.explain``, ``_explain`` is the JSON that the function
    gives; ``_in_france`` tells which persons have the country code of France, none if there is no such column.
    """
    c = F.col
    alive = lambda *parts: blended(*(c(p) for p in parts)) > params.prune
    asked = F.coalesce(F.length("birth_q"), F.lit(0)) > 0
    rows = rows.withColumn("_birthDate", F.when(asked, dates.score_column(c("birth_q"), c("birth_date"))))
    rows = rows.withColumn("_go", alive("_birthDate") | c("_birthDate").isNull() | (c("_birthDate") == 0))
    rows = rows.withColumn("_n", F.when(c("_go"), names.score_column(c("_fq"), c("_lq"), c("_fp"), c("_lp"), c("sex"))))
    rows = rows.withColumns({"_name": c("_n.score"), "_name_first": c("_n.first"), "_name_last": c("_n.last")})
    rows = rows.withColumn("_go", c("_go") & alive("_birthDate", "_name"))
    rows = rows.withColumn("_sex", F.when(c("_go"), names.sex_column(c("sex_q"), c("sex"))))
    rows = rows.withColumn("_go", c("_go") & alive("_birthDate", "_name", "_sex"))
    rows = rows.withColumn("_birthLocation", F.when(c("_go"), F.lit(BLIND_PLACE)))
    parts = ("_birthDate", "_name", "_sex", "_birthLocation")
    rows = rows.withColumn("_score", blended(*(c(p) for p in parts)))
    if params.explain:
        name = F.when(c("_name").isNotNull(), F.struct(c("_name_first").alias("first"), c("_name_last").alias("last"), c("_name").alias("score")))
        # of a place that was not asked for, the country is left open where it is recorded abroad
        country = F.when(~c("_in_france"), c("_birthLocation")) if "_in_france" in rows.columns else c("_birthLocation")
        place = F.when(c("_birthLocation").isNotNull(), F.struct(country.alias("country"), c("_birthLocation").alias("score")))
        each = [c("_birthDate").alias("birthDate"), name.alias("name"), c("_sex").alias("sex"), place.alias("birthLocation")]
        rows = rows.withColumn("_explain", F.to_json(F.struct(*each, c("_score").alias("score"), F.struct(*each).alias("explain"))))
    return rows.withColumn("_n_parts", sum((c(p).isNotNull().cast("int") for p in parts), F.lit(0)))


def request_weight(item: dict) -> int:
    """How many of name, birth date and birth place a request has."""
    place = ("birthCity", "birthLocationCode", "birthCountry", "birthDepartment", "birthGeoPoint")
    return bool(item.get("fullText") or item.get("lastName") or item.get("firstName")) + bool(item.get("birthDate")) + any(item.get(k) for k in place)


def blind_penalty(score: Column, name: Column, birth_place: Column, n_parts: Column, weight: Column) -> Column:
    """A pair's score to a power that is the smaller the more parts could be compared."""
    good = F.when(name >= PERFECT, 1).otherwise(0) + F.when(birth_place >= PERFECT, 1).otherwise(0)
    return round2(F.pow(score, weight / (0.5 * good + n_parts + 1)))


def candidate_set(pairs: DataFrame, key: str = "qid", rank: str = "rank", sex: str = "sex_b", prune: float = PRUNE, candidates: int = 1) -> DataFrame:
    """Scores of the candidates of each request after the penalties for having several, as column ``final``.

    ``pairs`` has a score column ``score`` (after :func:`blind_penalty`, null where the comparison failed: then the
    rank counts), the name score ``name``, the rank of the search and the recorded sex.  Candidates below ``prune``
    go, before and after the penalties.  Two window passes over one partitioning by request.
    """
    per = Window.partitionBy(key)
    by_rank = round2(0.005 * F.least(F.lit(200.0), F.col(rank).cast("double")))
    rows = pairs.where(F.col(rank) > 0).withColumn("_s", F.coalesce(F.col("score"), by_rank))
    fine = F.coalesce(F.col("name") > WRONG_LAST["F"], F.lit(False))
    rows = rows.select(
        "*", F.max("_s").over(per).alias("_max"), F.sum(F.when(F.col("_s") >= PERFECT, 1).otherwise(0)).over(per).alias("_perfect"),
        F.max(F.when((F.col(sex) == "F") & fine, 1).otherwise(0)).over(per).alias("_female"),
    ).where(F.col("_s") >= prune)
    counted = F.coalesce(F.col(sex) == "M", F.lit(False)) | (F.col("_female") == 0) | fine
    rows = rows.select("*", F.sum(F.when(F.col("_s") == F.col("_max"), 1).otherwise(0)).over(per).alias("_best"), F.sum(F.when(counted, 1).otherwise(0)).over(per).alias("_n"))
    first = F.when((F.col("_female") == 1) & (F.col("_n") > 0) & F.coalesce(F.col("name") <= WRONG_LAST["F"], F.lit(False)), 0.0).otherwise(F.col("_s"))
    lead = F.when(F.col("_perfect") > 0, F.col("_perfect")).otherwise(F.col("_best"))
    price = F.when(F.col("_perfect") > 0, PERFECT_PENALTY).otherwise(BEST_PENALTY)
    factor = F.greatest(F.lit(FLOOR), 1 - price * (lead - 1 + (F.col("_n") - lead) / candidates))
    power = F.when(F.col("_first") == F.col("_max"), 1).otherwise(SECOND_POWER + F.when(F.col("_first") >= PERFECT, 1).otherwise(F.col("_n") - lead))
    rows = rows.withColumn("_first", first)
    rows = rows.withColumn("_then", F.when((F.col("_first") > 0) & (F.col("_n") > 1), round2(factor * F.pow(F.col("_first"), power))).otherwise(F.col("_first")))
    rows = rows.withColumn("final", F.when((F.col("_then") < F.col("_max")) & (F.col("_then") < SECOND_LEAST), 0.0).otherwise(F.col("_then")))
    return rows.where(F.col("final") >= prune).drop("_s", "_max", "_perfect", "_female", "_best", "_n", "_first", "_then")


def best(pairs: DataFrame, n: int = 1, key: str = "qid", rank: str = "rank", uid: str = "uid") -> DataFrame:
    """The ``n`` best candidates of each request by final score, then rank, then id, numbered in ``place``."""
    order = Window.partitionBy(key).orderBy(F.desc("final"), F.desc(rank), F.asc(uid))
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def score_hits(hits: DataFrame, item: dict, person_json: Column, params: Params = Params()) -> DataFrame:
    """The hits of one request (with uid, sex and rank) with part scores and ``final``, best first.

    All hits stay; those that the penalties would drop have the score 0.  ``item`` has the request's fields.
    """
    asked = F.lit(json.dumps(person_from_request(item)))
    rows = hits.withColumn("_s", pair_scores(params)(asked, person_json))
    rows = rows.withColumn("_final", blind_penalty(F.col("_s.score"), F.col("_s.name"), F.col("_s.birthLocation"), F.col("_s.n_parts"), F.lit(request_weight(item))))
    pairs = rows.select(F.lit(0).alias("qid"), "uid", "rank", F.col("_final").alias("score"), F.col("_s.name").alias("name"), F.col("sex").alias("sex_b"))
    kept = candidate_set(pairs, prune=params.prune, candidates=params.candidates).select("uid", "final")
    out = rows.join(kept, "uid", "left").withColumn("final", F.coalesce("final", F.lit(0.0))).withColumnRenamed("_s", "scores").drop("_final")
    return out.orderBy(F.desc("final"), F.desc("rank"), "uid")


def compare_one(a: dict, b: dict, params: Params = Params(), communes: dict | None = None) -> dict:
    """Part scores and the blend of two identities: ``a`` as request fields, ``b`` as request fields or a nested person."""
    nested = any(isinstance(b.get(k), dict) for k in ("name", "birth", "death"))
    return compare(person_from_request(a), b if nested else person_from_request(b), params, communes)
