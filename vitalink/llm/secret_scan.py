"""Secret scan with a guess-cost dynamic program.

Values that stand in a credential context are cut into words, dates, repeats, keyboard walks and brute-force spans at
the least total number of guesses; a value that even the cheapest cut leaves expensive is a secret.  Patterns of fixed
form (assignments, access keys, hexadecimal runs) are reported as they are.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import cache
from heapq import heappop, heappush

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of [0-9a-f]+ of 16 or more: a shorter run is never part of a longer one.
HEX = re.compile(r"[0-9a-f]{16,}")
#: A credential word, up to two words or signs between, and a value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|client|auth|encryption|signing)[_-]?(?:key|secret|token)|credentials?|bearer|authorization)"""
    r"""["']?(?:\x20*(?:[:=]|=>|->)\x20*(?:bearer\x20+|basic\x20+)?|\x20+(?:is|was)\x20+|\x20+)["'`]?([^\s"'`,;<>()\[\]{}]{8,})""",
    re.I | re.A,
)
#: What each text is searched for first, by a linear-time engine.
_MAYBE = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "guess": r"(?i)(pass|pwd|secret|token|key|credential|bearer|authorization)",
}

#: Frequent passwords and words, most frequent first; the rank is the number of guesses.
WORDS = """
password 123456 qwerty admin welcome letmein monkey dragon master login secret token key user test hello
iloveyou sunshine princess football baseball shadow superman michael jordan batman trustno access flower hottest
summer winter spring autumn love money freedom whatever computer internet server database root guest public private
default change changeme example sample dummy demo null none true false value string your here this that the and for
with from have will not are you all can was one our out day get has him his how man new now old see two way who boy
did its let put say she too use api pass word client auth access bearer basic config production staging local host
""".split()
RANK = {w: k + 1 for k, w in reversed(list(enumerate(WORDS)))}


WORDS_FILE = public_tokenizers.path("byte_bpe_50k.json")


@cache
def ranks(words_file: str = WORDS_FILE) -> dict[str, int]:
    """RANK, and after it the words of four letters or more that the tokenizer has as one token, in its order, most frequent first."""
    with open(words_file, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = dict(RANK)
    for token, k in sorted(vocabulary.items(), key=lambda x: x[1]):
        word = token[1:].lower()
        if token[0] == "\u0120" and len(word) >= 4 and word.isascii() and word.isalpha():
            out.setdefault(word, len(WORDS) + k)
    return out


#: Rows of a keyboard, for walks.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
_LEET = str.maketrans("0134578@$!", "oieastbasi")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_LONGEST = 40


def _next(a: str, b: str) -> bool:
    """Neighbours on the keyboard, or of code points in order."""
    if abs(ord(a) - ord(b)) == 1:
        return True
    x, y = _PLACE.get(a), _PLACE.get(b)
    return x is not None and y is not None and abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 1 and x != y


def _alphabet(text: str) -> int:
    size = 10 * any(c.isdigit() for c in text) + 26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text)
    return max(2, size + 33 * any(not c.isalnum() for c in text))


def _repeats(value: str, size: int) -> list[int]:
    """For each place, how many characters from there on equal those ``size`` further."""
    n = len(value)
    same = [0] * (n + 1)
    for i in range(n - size - 1, -1, -1):
        if value[i] == value[i + size]:
            same[i] = same[i + 1] + 1
    return same


def guess_cost(value: str, enough: float = math.inf, words_file: str = WORDS_FILE) -> tuple[float, list[tuple[int, int, str]]]:
    """(log10 of the guesses, segments) of the cheapest segmentation of the whole value.

    Segments are (start, end, kind), kind one of word, date, repeat, walk, brute.  Each segment beyond the first also
    costs a factor of two, for the choice of the place where it starts.  Words, dates and walks have at most _LONGEST
    characters, repeats and brute-force spans any number; time and memory grow with the length of the value.  Once every
    segmentation costs ``enough`` or more the search ends, with a lower bound and no segments.
    """
    rank_of = ranks(words_file)
    low = value.lower()
    plain = low.translate(_LEET)
    n = len(value)
    each = math.log10(_alphabet(value)) if value else 0.0
    best = [0.0] + [math.inf] * n
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    more = math.log10(2)
    same = {size: _repeats(value, size) for size in (1, 2, 3, 4, 6, 8) if 2 * size <= n}
    far: list[tuple[float, int]] = []  # segments of repeats that end beyond all others: (cost up to the end, end)

    def offer(i: int, j: int, cost: float, kind: str) -> None:
        total = best[i] + cost + (more if i else 0)
        if total < best[j]:
            best[j], back[j] = total, (i, kind)
            if j > i + _LONGEST:
                heappush(far, (total, j))

    for i in range(n):
        # brute-force spans may go on without the price of a new segment
        step = each if i and back[i][1] == "brute" else each + (more if i else 0)
        if best[i] + step < best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + step, (back[i][0] if i and back[i][1] == "brute" else i, "brute")
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            if (rank := rank_of.get(low[i:j]) or rank_of.get(plain[i:j])) is not None:
                changed = (value[i:j] != low[i:j]) + (low[i:j] not in rank_of)
                offer(i, j, math.log10(rank + 1) + changed * more, "word")
        if (m := _DATE.match(value, i)) is not None:
            offer(i, m.end(), math.log10(200 if m.end() - i == 4 else 365 * 120), "date")
        j = i + 1
        while j < min(n, i + _LONGEST) and _next(low[j - 1], low[j]):
            j += 1
            if j - i >= 3:
                offer(i, j, math.log10(47 * 4) + math.log10(j - i), "walk")
        for size, equal in same.items():
            if equal[i] >= size and (j := i + size + equal[i] // size * size) - i >= 3:
                offer(i, j, size * each + math.log10((j - i) // size), "repeat")
        # all segments across this place have been offered
        while far and far[0][1] <= i:
            heappop(far)
        if min(best[i + 1 : i + 1 + _LONGEST]) >= enough and (not far or far[0][0] >= enough):
            return enough, []
    out, j = [], n
    while j:
        i, kind = back[j]
        out.append((i, j, kind))
        j = i
    return best[n], out[::-1]


def spans(text: str, maybe: dict[str, bool] | None = None, least: float = 14.0, words_file: str = WORDS_FILE) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start, then kind as listed.  Ends are exclusive, places in code points.

    ``least`` is the log10 of the guesses from which a value in a credential context counts.  Such a value is reported
    (kind guess) unless a pattern of fixed form covers it already.
    """
    maybe = maybe or dict.fromkeys(_MAYBE, True)
    found = []
    if maybe["assign"]:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if maybe["access"]:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if maybe["hex"]:
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if maybe["guess"]:
        base = list(found)
        for m in CONTEXT.finditer(text):
            i, j = m.span(1)
            value = m[1].rstrip(".:!?")
            j = i + len(value)
            if len(value) < 8 or any(x < j and i < y for _, x, y in base):
                continue
            if guess_cost(value, least, words_file)[0] >= least:
                found.append(("guess", i, j))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 14.0, words_file: str = WORDS_FILE) -> DataFrame:
    """doc_id and found (array of kind, start, end) of each row of ``docs``.

    ``words_file`` is the tokenizer file, on every machine, whose frequent tokens extend the dictionary.

    Null texts count as empty.  Repeated rows give repeated rows; null ids stay null; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in sliced(batches, 1):
            texts = pc.fill_null(batch.column(1), "")
            maybe = {k: pc.match_substring_regex(texts, p).to_pylist() for k, p in _patterns().items()}
            rows: list = [[]] * len(texts)
            for n in range(len(texts)):
                flags = {k: v[n] for k, v in maybe.items()}
                if any(flags.values()):
                    rows[n] = [dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans(texts[n].as_py(), flags, least, words_file)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def _patterns() -> dict[str, str]:
    return _MAYBE


def digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(listed([x for x in found if x[0] != "guess"]).encode()).hexdigest()
