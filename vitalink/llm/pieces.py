"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

Merging starts from characters and joins, again and again, the neighbours whose joint piece has the best score, the
leftmost of equals.  No merge crosses the border of two final pieces, so of a text's ways to be cut into pieces exactly
one has only neighbours that merging leaves apart when given the two alone.  That one is searched for from the left:
the longest piece at each place comes from an Aho-Corasick automaton, a piece is taken if merging its characters and
its neighbour's anew gives the two again, shorter prefixes are tried next, and a place from which nothing fits is marked
in a bitfield and never tried again.  The work is linear in the length, however unlucky the text.

Pieces of the model hold the space mark only in front, so that a text falls into units (marks and what follows them)
which are encoded once and remembered.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

MARK = "▁"
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Places whose longest pieces are kept at a time, in a unit of more.
BLOCK = 1 << 16
_NEVER = float("inf")


class Backtracker:
    """Cuts strings into the pieces that merging by score would give.  ``scores`` has the mergeable pieces."""

    def __init__(self, scores: dict[str, float], most: int = 1 << 18):
        self.scores, self.most = scores, most
        self.ranks = {p: -x for p, x in scores.items()}
        self.longest = max(map(len, scores), default=1)
        # pieces that their own characters do not merge to can never come out; the automaton reads backwards
        self.automaton = ahocorasick.Automaton()
        self.pieces = {p for p in scores if self.remerge(p) == [p]}
        for p in self.pieces:
            self.automaton.add_word(p[::-1], p)
        if self.pieces:
            self.automaton.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._shorter: dict[str, str | None] = {}

    def remerge(self, text: str) -> list[str]:
        """Merge the characters of a (short) string by the definition."""
        parts, rank = list(text), self.ranks.get
        while len(parts) > 1:
            each = [rank(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(each)
            if best == _NEVER:
                break
            k = each.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging leaves two neighbouring pieces as they are."""
        pair = (left, right)
        found = self._pairs.get(pair)
        if found is None:
            if len(self._pairs) >= self.most:
                self._pairs.clear()
            found = self._pairs[pair] = left + right not in self.scores and self.remerge(left + right) == [left, right]
        return found

    def shorter(self, piece: str) -> str | None:
        """The longest piece, or single character, that is a proper prefix of a piece."""
        if piece not in self._shorter:
            if len(self._shorter) >= self.most:
                self._shorter.clear()
            self._shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.pieces), None)
        return self._shorter[piece]

    def _block(self, text: str, k: int = 0) -> list[str]:
        """The longest piece at each place of a block; a character that no piece has stands for itself."""
        start = k * BLOCK
        size = min(BLOCK, len(text) - start)
        part = text[start : start + size + self.longest - 1]
        found, last = list(part[:size]), -1
        if self.pieces:
            for end, piece in self.automaton.iter(part[::-1]):
                if end != last:  # the first of an end is the longest
                    last, at = end, len(part) - 1 - end
                    if at < size:
                        found[at] = piece
        return found

    def encode(self, text: str) -> list[str]:
        n, at = len(text), 0
        if not n:
            return []
        start, block = 0, self._block(text, 0)
        failed, any_failed = bytearray(n // 8 + 1), False
        out: list[str] = []
        last, piece = None, block[0]
        pairs, fits = self._pairs, self.fits
        while True:
            end = at + len(piece)
            if not (any_failed and failed[end >> 3] >> (end & 7) & 1) and (last is None or ((ok := pairs.get((last, piece))) or (ok is None and fits(last, piece)))):
                out.append(piece)
                if end == n:
                    return out
                last, at = piece, end
                if not start <= at < start + BLOCK:
                    start = at // BLOCK * BLOCK
                    block = self._block(text, at // BLOCK)
                piece = block[at - start]
                continue
            shorter = self.shorter(piece)
            while shorter is None:
                # nothing fits here: the piece before must be a shorter one
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = out.pop()
                at -= len(piece)
                shorter = self.shorter(piece)
            piece, last = shorter, out[-1] if out else None


class _Spelled(dict):
    """Ids of pieces; characters without a piece are spelled in bytes."""

    def __init__(self, ids: dict[str, int], spell: list[int]):
        super().__init__((p, np.array([k], "<u4").tobytes()) for p, k in ids.items())
        self.spell = spell

    def __missing__(self, piece: str) -> bytes:
        return np.array([self.spell[b] for b in piece.encode()], "<u4").tobytes()


class Encoder:
    """Ids of whole texts, and texts of ids, by a SentencePiece model of the merge type with byte pieces.

    The model gives pieces, scores, normal form and decoding; cutting is done here.  Two generations of ``most`` units are
    remembered, longer ones than ``long`` characters never.
    """

    def __init__(self, path: str, most: int = 200_000, long: int = 48):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.long = most, long
        ids = range(m.vocab_size())
        special = {k for k in ids if m.is_control(k) or m.is_unknown(k) or m.is_byte(k)}
        if any(m.is_unused(k) for k in ids):
            raise ValueError("models with unused pieces are not covered")
        self.ids = {m.id_to_piece(k): k for k in ids if k not in special}
        self.spelled = _Spelled(self.ids, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.is_byte = np.array([m.is_byte(k) for k in ids])
        self.cutter = Backtracker({p: m.get_score(k) for p, k in self.ids.items()})
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.begin, self.end = m.bos_id(), m.eos_id()
        #: Whether decoding drops exactly the mark that normalising puts in front, so that ids can be decoded in parts.
        self.one_mark = m.normalize("a") == MARK + "a" and m.decode([m.piece_to_id(MARK)] * 2) == " "
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = b"".join(map(self.spelled.__getitem__, self.cutter.encode(unit)))
        if len(unit) <= self.long:
            if len(self.units) >= self.most:
                self.units, self.older = {}, self.units
            self.units[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids, with those of begin and end."""
        text = self.model.normalize(text)
        units = _UNITS.findall(text) if self.apart else [text] * bool(text)
        ids = [self.units.get(x) or self._unit(x) for x in units]
        return b"".join([np.array([self.begin], "<u4").tobytes(), *ids, np.array([self.end], "<u4").tobytes()])

    def decode(self, ids: bytes, part: int = 1 << 20) -> str:
        """The model's text of ids; many of them in parts, cut where no character is spelled in bytes."""
        at = np.frombuffer(ids, "<u4")
        if len(at) <= part or not self.one_mark:
            return self.model.decode(at.tolist())
        whole = np.flatnonzero(~self.is_byte[at])
        cuts = [0, *(int(whole[k]) for k in np.unique(np.minimum(np.searchsorted(whole, np.arange(part, len(at), part)), len(whole) - 1)) if whole[k]), len(at)]
        mark = self.model.piece_to_id(MARK)
        return "".join(self.model.decode(([mark] if i else []) + at[i:j].tolist()) for i, j in zip(cuts, cuts[1:], strict=False))


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit, begin and end included) and decoded (the text of the ids).

    Null texts count as empty (begin and end only, decoded to an empty text); null ids and repeated rows give a row each;
    other columns are ignored; an empty table gives no row.  Long texts take memory in proportion to their own length.
    Rows never meet, so nothing is shuffled.
    """

    def run(batches):
        encoder = _encoder(model)
        for batch in sliced(batches, 1):
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(encoder.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Rows with the text of a column of little-endian 32-bit ids; null ids have a null text."""

    def run(batches):
        encoder = _encoder(model)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield batch.append_column(out_col, pa.array(texts, pa.string()))

    return rows.drop(out_col).mapInArrow(run, rows.drop(out_col).withColumn(out_col, F.lit("")).schema)
