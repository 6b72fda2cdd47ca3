"""Hierarchical language identification.

A text's language family is predicted first; within the family, linear support vector machines, one for each pair of its
languages, vote on the closely related ones.  All models are linear in the relative frequencies of hashed byte n-grams
(1 to 3 bytes) of the lower-cased text, so the score of a whole text is the mean of one table look-up for each n-gram,
whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, slices, utf8

#: Families of ISO 639-1 languages; each other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "semitic": "ar he mt",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

#: The features: 2^13 hashed n-grams.
DIMENSIONS = 1 << 13
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
UNDETERMINED = "und"


def grams(raw: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed n-grams that start at each byte: three rows (1, 2 and 3 bytes).

    N-grams that would cross the end of their text are none: they have the number ``dimensions``.
    """
    a = raw.astype(np.uint32)
    b = np.zeros_like(a)
    b[:-1] = a[1:]
    c = np.zeros_like(a)
    c[:-2] = a[2:]
    two = a | b << np.uint32(8)
    three = two | c << np.uint32(16)
    shift = np.uint32(33 - dimensions.bit_length())
    out = np.stack([a, (two * np.uint32(2654435761) + np.uint32(0x9E3779B9)) >> shift, (three * np.uint32(2246822519) + np.uint32(0x85EBCA6B)) >> shift]).astype(np.int32)
    size = np.diff(offsets)
    last = offsets[1:][size > 0] - 1
    out[1:, last] = dimensions
    out[2, offsets[1:][size > 1] - 2] = dimensions
    return out


#: Bytes of a long text that are taken at once, and floats of scores at once.
PIECE, CELLS = 1 << 20, 1 << 23


def gram_counts(raw: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """How often each hashed n-gram occurs in one text, piece by piece; the last number is of those that are none."""
    out = np.zeros(dimensions + 1, np.int64)
    for i in range(0, len(raw), PIECE):
        part = raw[i : i + PIECE + 2]  # two bytes more, for the n-grams that start here and end there
        code = grams(part, np.array([0, len(part)]), dimensions)[:, : min(PIECE, len(raw) - i)]
        out += np.bincount(code.ravel(), minlength=dimensions + 1)
    return out


def _sizes(offsets: np.ndarray) -> np.ndarray:
    return np.maximum(np.diff(offsets), 1)


def features(raw: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Relative frequencies of the hashed n-grams of each text (dense: for the training sample only)."""
    out = np.zeros((len(offsets) - 1, dimensions), np.float32)
    code = grams(raw, offsets, dimensions)
    for k, (i, j) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if j > i:
            out[k] = np.bincount(code[:, i:j].ravel(), minlength=dimensions + 1)[:dimensions] / (j - i)
    return out


@dataclass
class Linear:
    """Linear scores of named classes."""

    names: list[str]
    weights: np.ndarray  # classes x DIMENSIONS
    bias: np.ndarray


def fit(x: np.ndarray, labels: list[str], rounds: int = 12, strength: float = 1e-4, seed: int = 7) -> Linear:
    """Linear support vector machines, one class against the others, by averaged stochastic subgradients (Pegasos).

    Classes are in order of name.  Of two classes one machine is trained, and the other class has its negative.
    """
    names = sorted(set(labels))
    if len(names) == 1:
        return Linear(names, np.zeros((1, x.shape[1]), np.float32), np.ones(1, np.float32))
    machines = names[:1] if len(names) == 2 else names
    y = np.where(np.array(labels)[None, :] == np.array(machines)[:, None], 1.0, -1.0)
    w, b = np.zeros((len(machines), x.shape[1]), np.float32), np.zeros(len(machines), np.float32)
    total_w, total_b, steps = np.zeros_like(w), np.zeros_like(b), 0
    rng = np.random.default_rng(seed)
    share = np.maximum((y > 0).mean(axis=1, keepdims=True), 1e-3)
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)  # classes count alike, whatever their size
    size, t = 32, 0
    for turn in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            part = order[at : at + size]
            t += 1
            rate = 1 / (strength * (t + 100))
            margin = y[:, part] * (w @ x[part].T + b[:, None])
            push = np.where(margin < 1, y[:, part] * cost[:, part], 0).astype(np.float32) / len(part)
            w *= 1 - rate * strength
            w += rate * (push @ x[part])
            b += 0.01 * rate * push.sum(axis=1)
            if turn >= rounds // 2:
                total_w += w
                total_b += b
                steps += 1
    w, b = total_w / steps, total_b / steps
    scale = np.abs(w @ x.T + b[:, None]).mean() or 1.0
    if len(names) == 2:
        w, b = np.concatenate([w, -w]), np.concatenate([b, -b])
    return Linear(names, (w / scale).astype(np.float32), (b / scale).astype(np.float32))


@dataclass
class Pairs:
    """One machine for each pair of classes (i, j), i < j: positive for i."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # DIMENSIONS + 1 x pairs; the last row, of no n-gram, is zero
    bias: np.ndarray

    def decide(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class number, confidence) of each row of the machines' mean scores.

        The class that wins the most pairs; of equal ones that of the largest sum of margins, then the first by name.
        The confidence is the winner's mean share against each other class.
        """
        n, size = len(mean), len(self.names)
        margin = np.zeros((n, size, size))
        for k, (i, j) in enumerate(self.pairs):
            margin[:, i, j] = mean[:, k] + self.bias[k]
            margin[:, j, i] = -margin[:, i, j]
        wins = (margin > 0).sum(axis=2)
        total = margin.sum(axis=2)
        total[wins < wins.max(axis=1, keepdims=True)] = -np.inf
        pick = total.argmax(axis=1)
        share = 1 / (1 + np.exp(-4 * np.clip(margin[np.arange(n), pick], -50, 50)))
        return pick, np.ones(n) if size == 1 else (share.sum(axis=1) - 0.5) / (size - 1)


def fit_pairs(x: np.ndarray, labels: list[str]) -> Pairs:
    """One-versus-one machines: each sees the texts of its two classes only."""
    names = sorted(set(labels))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    weights, bias = np.zeros((x.shape[1] + 1, len(pairs)), np.float32), np.zeros(len(pairs))
    for k, (i, j) in enumerate(pairs):
        at = [n for n, c in enumerate(labels) if c in (names[i], names[j])]
        machine = fit(x[at], [labels[n] for n in at])
        weights[:-1, k], bias[k] = machine.weights[0], machine.bias[0]
    return Pairs(names, pairs, weights, bias)


@dataclass
class Hierarchy:
    family: Linear
    table: np.ndarray  # DIMENSIONS + 1 x families
    languages: dict[str, Pairs]


def train(x: np.ndarray, labels: list[str]) -> Hierarchy:
    families = [FAMILY.get(c, c) for c in labels]
    family = fit(x, families)
    languages = {}
    for name in family.names:
        at = [k for k, f in enumerate(families) if f == name]
        languages[name] = fit_pairs(x[at], [labels[k] for k in at])
    table = np.concatenate([family.weights.T, np.zeros((1, len(family.names)), np.float32)])
    return Hierarchy(family, np.ascontiguousarray(table), languages)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(2 * (x - x.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def means(table: np.ndarray, code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean score of each text and model, from the numbers of its n-grams; a block of the models at a time."""
    total = np.zeros((len(offsets) - 1, table.shape[1]))
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        each = max(1, CELLS // code.shape[1])
        for k in range(0, table.shape[1], each):
            some = np.ascontiguousarray(table[:, k : k + each])
            value = some[code[0]]
            value += some[code[1]]
            value += some[code[2]]
            total[full, k : k + each] = np.add.reduceat(value, offsets[:-1][full], axis=0)
    return total / _sizes(offsets)[:, None]


def predict_long(model: Hierarchy, raw: np.ndarray) -> tuple[str, float]:
    """(language, score) of one text of any length: its scores are linear in the counts of its n-grams."""
    mean = gram_counts(raw, len(model.table) - 1) / max(len(raw), 1)
    share = _softmax(mean[None] @ model.table + model.family.bias)[0]
    pick = int(share.argmax())
    inner = model.languages[model.family.names[pick]]
    best, sure = inner.decide(mean[None] @ inner.weights)
    return inner.names[best[0]], float(share[pick] * sure[0])


def predict(model: Hierarchy, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text; the score is the family's share times the language's, both from 0 to 1."""
    n = len(offsets) - 1
    code = grams(raw, offsets, len(model.table) - 1)
    share = _softmax(means(model.table, code, offsets) + model.family.bias)
    pick = share.argmax(axis=1)
    language, score = np.empty(n, object), share[np.arange(n), pick]
    size = np.diff(offsets)
    for k, name in enumerate(model.family.names):
        at = np.flatnonzero(pick == k)
        if not len(at):
            continue
        inner = model.languages[name]
        own = code if len(at) == n else code[:, np.repeat(pick == k, size)]
        best, sure = inner.decide(means(inner.weights, own, np.concatenate([[0], np.cumsum(size[at])])))
        language[at] = np.array(inner.names, object)[best]
        score[at] = score[at] * sure
    return language, score


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, bool)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.logical_or.reduceat(_ASCII_LETTER[raw], offsets[:-1][full])
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = any(any(map(str.isalpha, part)) for part in _decoded(raw[offsets[k] : offsets[k + 1]]))
    return out


def _decoded(raw: np.ndarray):
    """A text piece by piece; no character is cut."""
    i = 0
    while i < len(raw):
        j = min(i + PIECE, len(raw))
        while j < len(raw) and raw[j] & 0xC0 == 0x80:
            j -= 1
        yield raw[i:j].tobytes().decode("utf-8", "replace")
        i = j


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(texts))


def learn(labelled: DataFrame, text_col: str, label_col: str, per_label: int, most_rows: int = 2400, most_labels: int = 500, dimensions: int = DIMENSIONS) -> Hierarchy | None:
    """Fit the hierarchy on a sample of about ``per_label`` different texts of each label; None if no row has a label.

    One pass takes the texts whose hash falls below their label's share, so no task gathers the sample's candidates.
    With many labels each gets fewer, about ``most_rows`` in all but at least 8 of each.  Every label is learned; over
    ``most_labels`` are refused with an error: eight rows of each, of 32 KiB, are what the driver takes.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).limit(most_labels + 1).collect()
    if not counts:
        return None
    if len(counts) > most_labels:
        raise ValueError(f"over {most_labels} labels")
    each = min(per_label, max(8, most_rows // len(counts)))
    # a row for each label, at most most_labels
    share = labelled.sparkSession.createDataFrame([(r["label"], each / r["n"]) for r in counts], "of string, share double")

    def extract(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                x = features(*lowered(part.column(1)), dimensions)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.astype("<f4").tobytes() for v in x], pa.binary())], names=["label", "x"])

    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    some = rows.join(F.broadcast(share), F.col("label") == F.col("of")).where(place < F.col("share"))
    some = some.groupBy("label", "h").agg(F.first("text").alias("text")).select("label", "text")
    found = some.mapInArrow(extract, "label string, x binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["label"], bytes(r["x"])))
    return train(np.stack([np.frombuffer(r["x"], "<f4") for r in found]), [r["label"] for r in found])


def identify(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """The ``carry`` columns, lang_pred and score of each row: ``und`` with score 0 if a text is null or has no letter, or there is no model."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*carry, F.col(text_col).cast("string").alias("_text"))
    last = len(carry)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["lang_pred string", "score double"])

    def run(batches):
        model = shared.value
        for batch in sliced(batches, last):
            raw, offsets = lowered(batch.column(batch.num_columns - 1))
            language, score = np.full(len(offsets) - 1, UNDETERMINED, object), np.zeros(len(offsets) - 1)
            if model is not None:
                for i, j in slices(offsets, PIECE):
                    if offsets[j] - offsets[i] > PIECE:  # one text
                        language[i], score[i] = predict_long(model, raw[offsets[i] : offsets[j]])
                        continue
                    language[i:j], score[i:j] = predict(model, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            none = ~has_letter(raw, offsets)
            language[none], score[none] = UNDETERMINED, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(language, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 300, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``docs``.

    Rows whose crc32(id as text; null as empty) has the remainder 2 modulo 4 are held out of the training.  The model
    is fitted on about ``per_label`` texts of each label (see :func:`learn`); predictions see the text alone, the whole
    of it; n-grams of texts over 1 MB are counted piece by piece, so that little but the text is held.  Null and
    letterless texts are ``und``; so are all where nothing is labelled.  Repeated rows give repeated rows; other columns
    are ignored.
    """
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    model = learn(rows.where(~F.col("held_out")), "text", "label", per_label, **options)
    return identify(rows, model, "text", ("doc_id", "held_out"))
