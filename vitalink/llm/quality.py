"""Quality rules: learned decision lists over text statistics, in DataFrame functions only.

The statistics of all texts are one projection.  Sequential covering learns an ordered list of rules from a bounded
sample of labelled rows: each rule is a conjunction of thresholds, grown on one part of the rows by information gain
and pruned on the other, and the list becomes one Spark CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

#: What rules may test, as expressions over the statistics.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}
WINDOW = 3


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """doc_id, the ``carry`` columns and the statistics of each text; null counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, text.alias("_text"))
    body = F.regexp_replace("_text", f"^[{SPACE}]+|[{SPACE}]+$", "")
    rows = rows.withColumn("_words", F.when(F.length(body) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(body, f"[{SPACE}]+")))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    n = F.size("_words")
    rows = rows.withColumn("_windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2]))).otherwise(F.expr("cast(array() as array<bigint>)")))
    rows = rows.withColumn("_repeats", F.size("_windows") > F.size(F.array_distinct("_windows")))
    # equal windows stand next to each other in order of (window, place)
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(F.col("_repeats"), placed))
    p = F.col("_placed")
    again = F.filter(F.transform(p, lambda x, k: F.when(((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | (F.get(p, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("_again", F.when(F.col("_repeats"), F.sort_array(again)))
    a = F.col("_again")
    # each window covers its words up to the next window's start
    covered = F.aggregate(F.transform(a, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(a, k + 1), i + WINDOW) - i)), F.lit(0).cast("int"), lambda s, x: s + x)
    solid = F.translate("_text", " \t\n\x0b\x0c\r", "")
    return rows.select(
        "doc_id",
        *carry,
        n.cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # Catalyst would push conditions on this column below all these projections, and repeat their expressions in
        # each condition; it does not where a column is not deterministic
        F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered, F.lit(0))).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        F.length(F.regexp_replace("_text", r"[\P{L}]+", "")).cast("long").alias("n_letters"),
        (F.length("_text") - F.length(F.translate("_text", "0123456789", ""))).cast("long").alias("n_digits"),
    )


#: Fixed thresholds that need no labels: too few words, or over half of them in repeated windows.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, sign, threshold), sign <= or >; rows that it covers are of low quality."""

    tests: tuple[tuple[str, str, float], ...]

    def covers(self, row: dict) -> bool:
        return all(row[f] <= t if sign == "<=" else row[f] > t for f, sign, t in self.tests)

    def sql(self) -> str:
        return " and ".join(f"(({FEATURES[f]}) {sign} cast('{t!r}' as double))" for f, sign, t in self.tests)


def _thresholds(values: list[float], most: int) -> list[float]:
    ordered = sorted(set(values))
    middle = [(a + b) / 2 for a, b in zip(ordered, ordered[1:], strict=False)]
    return middle[:: max(1, len(middle) // most)]


def _grow(rows: list[dict], bad: list[bool], features: dict[str, list[float]], longest: int) -> tuple:
    at = list(range(len(rows)))
    tests: list[tuple[str, str, float]] = []
    while len(tests) < longest:
        p = sum(bad[i] for i in at)
        if not p or p == len(at):
            break
        now = math.log2(p / len(at))
        best = (1e-9, None, None)
        for f, thresholds in features.items():
            ordered = sorted(at, key=lambda i: rows[i][f])  # noqa: B023
            k = good = 0
            for t in thresholds:
                while k < len(ordered) and rows[ordered[k]][f] <= t:
                    good += bad[ordered[k]]
                    k += 1
                for sign, hits, size in (("<=", good, k), (">", p - good, len(at) - k)):
                    if hits:
                        gain = hits * (math.log2(hits / size) - now)
                        if gain > best[0]:
                            best = (gain, (f, sign, t), None)
        if best[1] is None:
            break
        tests.append(best[1])
        rule = Rule((best[1],))
        at = [i for i in at if rule.covers(rows[i])]
    return tuple(tests)


def _worth(tests: tuple, rows: list[dict], bad: list[bool]) -> float:
    rule = Rule(tests)
    hits = [b for r, b in zip(rows, bad, strict=True) if rule.covers(r)]
    return (sum(hits) - (len(hits) - sum(hits))) / max(len(hits), 1) if hits else -1.0


def learn(rows: list[dict], bad: list[bool], most_rules: int = 8, longest: int = 4, precision: float = 0.9, thresholds: int = 64) -> list[Rule]:
    """An ordered list of rules for low quality, by sequential covering.

    Every third row is for pruning: tests go from a rule's end while that does not lower its worth (covered bad less
    covered good, as a share) there.  The list ends with the first rule that is right for less than ``precision`` of
    the rows it covers in either part.
    """
    part = [k % 3 == 2 for k in range(len(rows))]
    grow = [k for k, x in enumerate(part) if not x]
    prune = [k for k, x in enumerate(part) if x]
    out: list[Rule] = []
    while len(out) < most_rules and any(bad[k] for k in grow):
        own, mark = [rows[k] for k in grow], [bad[k] for k in grow]
        features = {f: _thresholds([r[f] for r in own], thresholds) for f in FEATURES}
        tests = _grow(own, mark, features, longest)
        if not tests:
            break
        test_rows, test_bad = [rows[k] for k in prune], [bad[k] for k in prune]
        while len(tests) > 1 and _worth(tests[:-1], test_rows, test_bad) >= _worth(tests, test_rows, test_bad):
            tests = tests[:-1]
        rule = Rule(tests)
        for some in (grow, prune):
            hits = [bad[k] for k in some if rule.covers(rows[k])]
            if hits and sum(hits) < precision * len(hits):
                return out
        out.append(rule)
        grow = [k for k in grow if not rule.covers(rows[k])]
        prune = [k for k in prune if not rule.covers(rows[k])]
    return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: number of the rule that rejects a row (from 1), or 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(F.expr(rule.sql()), k) if out is None else out.when(F.expr(rule.sql()), k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", most_rows: int = 4000, **options) -> list[Rule]:
    """Rules from labelled documents: up to ``most_rows`` labels of each value, those of least hash of the id.

    Labels are 0 (low) or 1; null labels and ids are left out.  Without low or without high ones there are no rules.
    """
    known = labels.select(F.col(label_id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label_id is not null and label is not null")
    parts = [known.where(F.col("label") == v).withColumn("h", F.xxhash64("label_id")).orderBy("h").limit(most_rows).select("label_id", "label") for v in (0, 1)]
    some = cut(parts[0].union(parts[1]))
    # at most 2 * most_rows rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("doc_id") == some["label_id"])
    rows = statistics(texts, carry=("label",))
    found = rows.select(F.expr(BASE_FAILED).alias("failed"), "doc_id", "label", *(F.expr(x).cast("double").alias(f) for f, x in FEATURES.items())).collect()
    found = sorted({tuple(r[1:]) for r in found if not r["failed"]}, key=lambda r: ((r[0] * 2654435761) % (1 << 32), r[:2]))
    table = [dict(zip(FEATURES, r[2:], strict=True)) for r in found]
    return learn(table, [r[1] == 0 for r in found], **options)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule for each row of ``docs``.

    kept is false where the fixed thresholds fail, else where a learned rule covers the row (``rule`` is its number,
    0 for none).  Null and blank texts have no words, so they fail.  Repeated rows give repeated rows; null ids stay
    null; other columns are ignored.
    """
    failed = F.expr(BASE_FAILED)
    rule = F.when(failed, 0).otherwise(verdict(fit(docs, labels, id_col, text_col, **options)))
    stats = statistics(docs, id_col, text_col)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`judge` keeps."""
    rules = fit(docs, labels, id_col, text_col, **options)
    rows = statistics(docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in docs.columns))), id_col, text_col, ("_row",))
    return rows.where(~F.expr(BASE_FAILED) & (verdict(rules) == 0)).select("_row.*")
