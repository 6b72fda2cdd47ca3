"""Personal data by weak supervision, in DataFrame functions only.

Wide patterns propose candidate spans.  Those inside a span of the strict
patterns are dropped.  Four labelers vote on each other one (1 personal, -1 not, 0 no opinion): a validity check, a
gazetteer, the words before it, and its shape.  Expectation-maximisation over the counts
of the vote patterns (a table of bounded size, whatever the corpus) estimates how reliable each labeler is; its
posteriors then train the final span classifier, a logistic regression over the votes and over traits of the span and
its surroundings that no labeler looks at, emitted as a Spark expression.  Spans of the strict patterns always stay; the
classifier adds others.  Overlaps are settled in one sweep over the sorted spans, so that time grows nearly linearly
with the length of a text, a span, and with the number of spans of a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("valid", "gazetteer", "context", "shape")
TRAITS = ("after a sign", "begins a line", "usual length", "clean end")

# The strict patterns match what the plain ones would, leftmost and without overlap, but start only where a run of
# their characters starts (or the last match ended), so that long runs take linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[({{](?:at|AT)[\])}}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({{](?:dot|DOT)[\])}}]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: What a text must have for a pattern to be tried.
_HINT = {("email", True): "@", ("phone", True): "+"}
_HINT_PATTERN = {("email", False): r"[\[({](?:at|AT)[\])}]"}

#: Frequent top-level domains.
TOP_LEVEL = "com org net edu gov mil int info biz io co ai app dev me tv us uk fr de es it nl be ch at eu ca au nz jp cn in br mx ru pl se no fi dk pt ie".split()
#: Country calling codes.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 358 420 421".split()
#: Words before a span that speak for its kind, and words that speak against any.
CONTEXT = {
    "email": "mail|e-mail|email|contact|correo|write to",
    "ip": "ip|host|server|address|adresse|client|from",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|telefon|téléphone|teléfono",
}
AGAINST = "version|order|isbn|issn|invoice|serial|ticket|part no|section|chapter"

_SPAN = "struct<kind:int,start:int,end:int,strict:boolean,value:string,before:string,after:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


_BLOCK = 512


def _located(matches: Column, pieces: Column, kind: int, strict: bool) -> Column:
    """Structs of the matches of a pattern, from the matches and the pieces between them; places in code points.

    Places are summed up within blocks of matches, then over the blocks, so that very many matches take no square of time.
    """
    fields = lambda c, start: (c["kind"].alias("kind"), (c["start"] + start).alias("start"), (c["end"] + start).alias("end"), *(c[x].alias(x) for x in ("strict", "value", "before", "after")))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(pieces[i])
        end = start + F.length(matches[i])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.lit(strict).alias("strict"), matches[i].alias("value"),
            F.right(pieces[i], F.lit(40)).alias("before"), F.left(pieces[i + 1], F.lit(4)).alias("after"),
        )
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda c: F.struct(*fields(c, acc["at"])))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("out"))
    last = F.size(matches) - 1
    block = lambda i: F.aggregate(F.sequence(i, F.least(i + F.lit(_BLOCK - 1), last)), none, step)
    blocks = F.transform(F.sequence(F.lit(0), last, F.lit(_BLOCK)), block)
    return F.when(F.size(matches) > 0, F.aggregate(blocks, none, join, lambda acc: acc["out"]))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        d = F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _votes(c: Column) -> Column:
    """The struct of a candidate: place, whether it is base, and its votes."""
    kind, value = c["kind"], c["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    is_kind = lambda name: kind == KINDS.index(name)
    valid = (
        F.when(is_kind("email"), value.rlike(r"[A-Za-z]{2,24}$"))
        .when(is_kind("ip"), F.when(c["strict"], small).otherwise(True))
        .when(is_kind("card"), luhn(digits))
        .otherwise(n.between(9, 15))
    )
    base = c["strict"] & F.when(is_kind("email"), True).otherwise(valid)
    sign = lambda x: F.when(x, 1).otherwise(-1)
    yes = lambda x: F.when(x, 1).otherwise(0)
    ending = F.lower(F.regexp_extract(F.right(value, F.lit(30)), r"([A-Za-z0-9-]+)$", 1))  # the list has none as long
    code = F.array(*(F.substring(digits, 1, k) for k in (1, 2, 3)))
    gazetteer = (
        F.when(is_kind("email"), yes(ending.isin(TOP_LEVEL)))
        .when(is_kind("ip"), F.when(value.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), -1).otherwise(0))
        .when(is_kind("card"), sign(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|30[0-5]|6011|64|65|62)")))
        .otherwise(F.when(c["strict"], yes(F.arrays_overlap(code, F.array(*map(F.lit, CALLING))))).otherwise(0))
    )
    about = F.lit(0)
    for name, known in CONTEXT.items():
        about = F.when(is_kind(name) & c["before"].rlike(rf"(?i)\b(?:{known})\b"), 1).otherwise(about)
    context = F.when(c["before"].rlike(rf"(?i)\b(?:{AGAINST})\b"), -1).otherwise(about)
    glued = c["before"].rlike(r"[0-9A-Za-z.]$") | c["after"].rlike(r"^[0-9A-Za-z]")
    tidy = (
        F.when(is_kind("email"), value.rlike(r"^[A-Za-z0-9]"))
        .when(is_kind("ip"), value.rlike(r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$"))
        .when(is_kind("card"), value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$"))
        .otherwise(value.rlike(r"[0-9][ ().-]+[0-9]") & ~value.rlike(r"\s\s"))
    )
    shape = F.when(glued, -1).otherwise(yes(tidy))
    votes = (sign(valid), gazetteer, context, shape)
    usual = (
        F.when(is_kind("email"), F.length(value).between(8, 40)).when(is_kind("ip"), F.length(value).between(9, 15))
        .when(is_kind("card"), n.isin(15, 16)).otherwise(n.between(10, 12))
    )
    traits = (c["before"].rlike(r"[:=#]\s?$"), c["before"].rlike(r"(?:^|\n)\s*$"), usual, c["after"].rlike(r"^(?:$|[\s,.;)])"))
    return F.struct(
        kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.coalesce(base, F.lit(False)).alias("base"),
        F.array(*(F.coalesce(v, F.lit(0)).cast("int") for v in votes)).alias("votes"), F.array(*(F.coalesce(yes(t), F.lit(0)).cast("int") for t in traits)).alias("traits"),
    )


def unbeaten(rows: DataFrame, column: str, fields: str, beats) -> DataFrame:
    """``rows`` without the spans that an overlapping one beats, beaten or not itself; the others in no fixed order.

    The spans are structs of kind, start, end and ``fields``.  One sweep by their starts: those that still overlap are
    at hand, at most one of each pattern, as the matches of a pattern do not overlap; each is given out once it has
    ended.  What is given out is gathered in blocks, so that very many spans take no square of time.
    """
    span = f"struct<kind:int,start:int,end:int,{fields.replace(' ', ':').replace(',:', ',')}>"
    none = F.expr(f"cast(array() as array<{span}>)")
    alone = lambda live: F.transform(F.filter(live, lambda a: ~a["beaten"]), lambda a: a["span"])

    def step(acc: Column, pair: Column) -> Column:
        new = pair["span"]
        live = F.filter(acc["live"], lambda a: a["span"]["end"] > new["start"])
        over = F.filter(acc["live"], lambda a: a["span"]["end"] <= new["start"])
        marked = F.transform(live, lambda a: F.struct(a["span"].alias("span"), (a["beaten"] | beats(new, a["span"])).alias("beaten")))
        own = F.struct(new.alias("span"), F.exists(live, lambda a: beats(a["span"], new)).alias("beaten"))
        return F.struct(F.array_append(marked, own).alias("live"), F.concat(acc["out"], alone(over)).alias("out"))

    def block(acc: Column, i: Column) -> Column:
        done = lambda d: F.struct(d["live"].alias("live"), F.array_append(acc["out"], d["out"]).alias("out"))
        return F.aggregate(F.slice("_sorted", i, _BLOCK), F.struct(acc["live"].alias("live"), none.alias("out")), step, done)

    start = F.struct(F.expr(f"cast(array() as array<struct<span:{span},beaten:boolean>>)").alias("live"), F.expr(f"cast(array() as array<array<{span}>>)").alias("out"))
    blocks = F.sequence(F.lit(1), F.size("_sorted"), F.lit(_BLOCK))
    swept = F.aggregate(blocks, start, block, lambda acc: F.concat(F.flatten(acc["out"]), alone(acc["live"])))
    sorted_ = rows.withColumn("_sorted", F.sort_array(F.transform(column, lambda c: F.struct(c["start"].alias("at"), c.alias("span")))))
    return sorted_.withColumn(column, F.when(F.size("_sorted") > 1, swept).otherwise(F.transform("_sorted", lambda c: c["span"]))).drop("_sorted")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: the candidate spans of each row with their votes, an empty array for most.

    Candidates that overlap a base span are left out: they are the same find, and no example of another class.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digits", F.col("text").rlike("[0-9]"))
    patterns = [(k, True, p) for k, p in STRICT.items()] + [(k, False, p) for k, p in WIDE.items()]
    columns = []
    for n, (kind, strict, pattern) in enumerate(patterns):
        if (kind, strict) in _HINT:
            hint = F.col("text").contains(_HINT[kind, strict])
        elif (kind, strict) in _HINT_PATTERN:
            hint = F.col("text").rlike(_HINT_PATTERN[kind, strict])
        elif kind == "ip" and not strict:
            hint = F.col("text").rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")
        else:
            hint = F.col("digits")
        columns.append(F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"m{n}"))
    rows = rows.select("doc_id", "text", *columns)
    rows = rows.select("doc_id", *(f"m{n}" for n in range(len(patterns))), *(F.when(F.size(f"m{n}") > 0, F.split("text", p, -1)).alias(f"p{n}") for n, (_, _, p) in enumerate(patterns)))
    found = [F.coalesce(_located(F.col(f"m{n}"), F.col(f"p{n}"), KINDS.index(k), strict), F.expr(_NONE)) for n, (k, strict, _) in enumerate(patterns)]
    rows = rows.select("doc_id", F.concat(*found).alias("spans"))
    rows = rows.select("doc_id", F.transform("spans", _votes).alias("found"))
    return unbeaten(rows, "found", "base boolean, votes array<int>, traits array<int>", lambda a, b: a["base"] & ~b["base"])


def expectation_maximisation(counts: dict[tuple, int], rounds: int = 40) -> tuple[dict[tuple, float], dict]:
    """(posterior of each vote pattern, reliabilities): labelers that are independent given the class.

    ``counts`` has the number of candidates of each pattern of votes (-1, 0, 1).  Starts from the vote sums.
    """
    q = {v: min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v in counts}
    total = sum(counts.values())
    chance: dict = {}
    for _ in range(rounds):
        prior = (sum(n * q[v] for v, n in counts.items()) + 1) / (total + 2)
        chance = {}
        for k in range(len(next(iter(counts), ()))):
            for y in (0, 1):
                weight = lambda v: q[v] if y else 1 - q[v]  # noqa: B023, E731
                mass = sum(n * weight(v) for v, n in counts.items())
                for x in (-1, 0, 1):
                    chance[k, x, y] = (sum(n * weight(v) for v, n in counts.items() if v[k] == x) + 1) / (mass + 3)
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[k, x, 1] / chance[k, x, 0]) for k, x in enumerate(v))
            q[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return q, chance


def train(patterns: dict[tuple[int, tuple, tuple], int], rounds: int = 200, decay: float = 1e-3) -> dict[int, list[float]]:
    """Weights (one for each vote and each trait, and a constant) of the span classifier of each kind.

    ``patterns`` counts candidates by kind, votes and traits; the posteriors of the votes are what is learned.
    """
    out = {}
    for kind in range(len(KINDS)):
        rows = [((*v, *t, 1), v, n) for (k, v, t), n in sorted(patterns.items()) if k == kind]
        w = [0.0] * (len(LABELERS) + len(TRAITS) + 1)
        if rows:
            counts: dict[tuple, int] = {}
            for _, v, n in rows:
                counts[v] = counts.get(v, 0) + n
            q, _ = expectation_maximisation(counts)
            total = sum(counts.values())
            for turn in range(rounds):
                slope = [decay * x for x in w]
                for x, v, n in rows:
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
                    for k, b in enumerate(x):
                        slope[k] += n / total * (p - q[v]) * b
                w = [a - 2.0 / (1 + 0.01 * turn) * s for a, s in zip(w, slope, strict=True)]
        out[kind] = w
    return out


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", names[c["kind"]], c["start"].cast("string"), c["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """doc_id and found: an array of (kind, start, end, base, score) for each row of ``docs``, ordered by kind and start.

    base spans are those of the strict patterns; of the other candidates those stay whose score is ``least`` or more
    and that overlap no base span and no other of a higher score.  Null texts count as empty.  Long texts and texts
    of very many spans are taken whole, in memory in proportion to them.  Repeated rows give repeated rows, null ids stay null,
    other columns are ignored.
    """
    rows = cut(candidates(docs, id_col, text_col))
    tally = rows.select(F.explode("found").alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes"), F.col("c.traits").alias("traits")).agg(F.count(F.lit(1)).alias("n"))
    # at most kinds x 3^labelers x 2^traits rows
    weights = train({(r["kind"], tuple(r["votes"]), tuple(r["traits"])): r["n"] for r in tally.collect()})

    def score(c: Column) -> Column:
        out = F.lit(0.0)
        for kind, w in weights.items():
            z = F.lit(w[-1])
            for k, a in enumerate(w[:-1]):
                z = z + F.lit(a) * (c["votes"][k] if k < len(LABELERS) else c["traits"][k - len(LABELERS)])
            out = F.when(c["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(out)
        return out

    scored = rows.select("doc_id", F.transform("found", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), score(c).alias("score"))).alias("all"))
    scored = scored.select("doc_id", F.filter("all", lambda c: c["base"] | (c["score"] >= least)).alias("all"))
    better = lambda b, c: (b["score"] > c["score"]) | ((b["score"] == c["score"]) & ((b["start"] < c["start"]) | ((b["start"] == c["start"]) & (b["kind"] < c["kind"]))))
    kept = unbeaten(scored, "all", "base boolean, score double", lambda b, c: ~b["base"] & ~c["base"] & better(b, c))
    return kept.select("doc_id", F.sort_array("all").alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of the result of :func:`find`."""
    base = F.filter("found", lambda c: c["base"])
    count = lambda k: F.size(F.filter("found", lambda c: c["base"] & (c["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
