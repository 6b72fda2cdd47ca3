"""SimHash near-copies at a similarity of 0.8 or more over five-word shingles.

The same method as :mod:`.simhash` with a wider distance.  A text has three SimHash words of 64 bits over its different
shingles.  Two texts are near-copies if one of the words differs in at most ``tau`` bits, and the similarity that all 192
bits and the sizes of the shingle sets give is at least ``similar``.

Candidates come from the generalised pigeonhole principle, word by word: correlated bits share one of m groups, and a
dynamic program over exact cell counts gives each text thresholds that sum to ``tau - m + 1``.  The first bits of a
group's value name a cell; a text is sent, packed, to its own cell of each group and to those within its threshold.  A
cell compares texts of sizes that allow the similarity and emits a spanning forest of the near-copies it finds, never
all pairs.  A cell of over ``most`` texts is cut into blocks.  Texts of different blocks meet in a second round, but
those that the first round has left outside the cell's largest component only: whatever the size of a group of copies,
its members need no more links than connect them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, inside, mix, shuffle_partitions, sliced, slices, utf8, window_hashes, word_hashes, words
from .components import connected_components
from .simhash import allocate, bit_groups, group_value

SHINGLE, TAU, SIMILAR, WORDS = 5, 8, 0.8, 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Each byte as eight bytes of one bit each, so that eight counters of up to 255 fit one addition.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_RECORD = np.dtype([("w", "<u8", WORDS), ("n", "<u4")])
_BIN_BYTES = 4 << 20
_ROW = 64  # texts of a cell that are compared at once


# ---------------------------------------------------------------- fingerprints


def shingle_sets(raw: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): the sorted different shingle hashes of each text, and where those of each start.

    A text of fewer words than a shingle is one shingle; a blank one has none.
    """
    raw = _LOWER[raw]
    start, end, first = words(raw, at)
    h = word_hashes(raw, start, end)
    place = inside(first, shingle)
    value = window_hashes(h, shingle)[place] if len(place) else np.zeros(0, np.uint64)
    owner = np.searchsorted(first, place, "right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        alone = [window_hashes(h[first[k] : first[k + 1]], int(count[k]))[0] + np.uint64(count[k]) for k in short.tolist()]
        value, owner = np.concatenate([value, mix(np.array(alone, np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(at)))


def majority(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the values of each text; 0 for a text without."""
    out = np.zeros(len(first) - 1, np.uint64)
    size = np.diff(first)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    pieces = -(-size[full] // 255)
    skip = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sums = np.add.reduceat(_LANES[value.view(np.uint8).reshape(-1, 8)], np.repeat(first[:-1][full], pieces) + 255 * skip, axis=0)
    ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    out[full] = np.packbits(2 * ones > size[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def wide_prints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(WORDS columns of fingerprint words, number of different shingles) of each text; null counts as blank."""
    raw, at = utf8(column)
    out, size = np.zeros((len(at) - 1, WORDS), np.uint64), np.zeros(len(at) - 1, np.int64)
    for i, j in slices(at, 1 << 20):
        value, first = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        size[i:j] = np.diff(first)
        for k in range(WORDS):
            out[i:j, k] = majority(mix(value + np.uint64(k * 0x632BE59BD9B4E019)), first)
    return out, size


def names(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each fingerprint and size."""
    out = mix(n.astype(np.uint64) + np.uint64(1))
    for k in range(WORDS):
        out = mix(out ^ w[:, k])
    return out


def estimate(apart: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of sets of sizes a and b whose fingerprints differ in so many bits."""
    common = np.cos(np.pi * apart / (64 * WORDS)) * np.sqrt(a * b)
    return common / np.maximum(a + b - common, 1e-9)


def near(w: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, tau: int, similar: float) -> np.ndarray:
    """Whether rows a and b are near-copies."""
    d = np.bitwise_count(w[a] ^ w[b]).astype(np.int64)
    less, more = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    # sets of other sizes, or small ones that differ, are never that similar
    return (more > 4) & (less >= similar * more) & (d.min(axis=1) <= tau) & (estimate(d.sum(axis=1), n[a].astype(float), n[b].astype(float)) >= similar)


# ---------------------------------------------------------------- cells


class Plan:
    """The cells: groups of bits of each word, how many texts each cell has, and in how many blocks it is cut."""

    def __init__(self, groups: list[list[list[int]]], counts: list[np.ndarray], tau: int, most: int):
        self.groups, self.counts, self.tau = groups, counts, tau
        self.blocks = [np.maximum(1, -(-c // most)).astype(np.int64) for c in counts]
        self.m, self.slots = len(groups[0]), counts[0].shape[1]

    def messages(self, w: np.ndarray):
        """For each word and group: (word and group number, rows, cells, whether it is the row's own cell)."""
        for k, groups in enumerate(self.groups):
            fp = w[:, k]
            thresholds = allocate(fp, groups, self.counts[k], self.tau, exact=True)
            for g, group in enumerate(groups):
                value = group_value(fp, group).astype(np.int64)
                row, cell, own = [np.arange(len(fp))], [value], [np.ones(len(fp), bool)]
                for t in range(1, min(len(group), int(thresholds[g].max(initial=-1))) + 1):
                    at = np.flatnonzero(thresholds[g] >= t)
                    for flip in combinations(range(len(group)), t):
                        row.append(at)
                        cell.append(value[at] ^ sum(1 << b for b in flip))
                        own.append(np.zeros(len(at), bool))
                yield k, g, np.concatenate(row), np.concatenate(cell), np.concatenate(own)


def plan(nodes: DataFrame, n: int, tau: int, most: int) -> Plan:
    """Groups and cell counts; the number of groups falls, and that of bits of a cell grows, with the number of texts."""
    m = next((m for m in range(5, 2, -1) if n <= most << min(16, 64 // m)), 3)
    m = min(m, tau + 1)
    bits = max(1, min(16, 64 // m, int(np.ceil(np.log2(max(2, n) / 2048))))) if n > 2048 else 1
    groups = [[g[:bits] for g in bit_groups(nodes.select(F.col(f"w{k}").alias("fp")), m)] for k in range(WORDS)]

    def count(batches):
        total = np.zeros((WORDS, m, 1 << bits), np.int64)
        for batch in batches:
            for k in range(WORDS):
                fp = batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for g, group in enumerate(groups[k]):
                    total[k, g] += np.bincount(group_value(fp, group).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(total.ravel()[at], pa.int64())})

    table = nodes.select(*(f"w{k}" for k in range(WORDS))).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(WORDS * m << bits, np.int64)
    counts[table["cell"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return Plan(groups, list(counts.reshape(WORDS, m, 1 << bits)), tau, most)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    long = lambda k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.stack([long(k).view(np.uint64) for k in range(WORDS)], axis=1), long(WORDS)


def _packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray, n: np.ndarray, n_bins: int) -> pa.RecordBatch:
    """(bin, cell, data) rows from (cell, row, flag) arrays: the records of each cell and block."""
    cell, row, flag = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(cell, kind="stable")
    cell, row, flag = cell[order], row[order], flag[order]
    data = np.empty(len(row), _RECORD)
    data["w"], data["n"] = w[row], n[row] << 1 | flag
    edge = np.flatnonzero(np.diff(cell)) + 1
    lead = np.concatenate([[0], edge]).astype(np.int64) if len(cell) else np.zeros(0, np.int64)
    blobs = [data[i:j].tobytes() for i, j in zip(lead.tolist(), [*edge.tolist(), len(cell)], strict=False)]
    to = (mix(cell[lead].astype(np.uint64)) % np.uint64(n_bins)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(to), pa.array(cell[lead], pa.int64()), pa.array(blobs, pa.binary())], names=["bin", "cell", "data"])


def _name_cell(plan: Plan, k: int, g: int, cell: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A number for each block of each cell."""
    return ((block * WORDS + k) * plan.m + g) * plan.slots + cell


def _word_of(plan: Plan, cell: int) -> int:
    return cell // plan.slots // plan.m % WORDS


def cell_links(w: np.ndarray, n: np.ndarray, asks: np.ndarray, k: int, tau: int, similar: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links, labels): a spanning forest of the near-copies among the rows, each of a pair at least with ``asks``.

    Rows are in order of size.  Rows of equal labels are connected.
    """
    label, out = np.arange(len(n)), []
    asking = np.flatnonzero(asks)
    mine = np.ascontiguousarray(w[:, k])
    for at in range(0, len(asking), _ROW):
        part = asking[at : at + _ROW]
        lo = int(np.searchsorted(n, similar * n[part[0]] - 1e-6))
        hi = int(np.searchsorted(n, n[part[-1]] / similar + 1e-6, "right"))
        a, b = np.nonzero(np.bitwise_count(mine[part][:, None] ^ mine[lo:hi]) <= tau)
        a, b = part[a], b + lo
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            continue
        good = near(w, n, a, b, tau, similar)
        a, b = a[good], b[good]
        edge = np.flatnonzero(np.diff(a)) + 1
        for i, others in zip(a[np.concatenate([[0], edge])].tolist() if len(a) else (), np.split(b, edge), strict=False):
            other = label[others]
            found, lead = np.unique(other, return_index=True)
            keep = found != label[i]
            found, lead = found[keep], lead[keep]
            if len(found):
                out += [(i, int(x)) for x in others[lead]]
                label[np.isin(label, found)] = label[i]
        if (label == label[0]).all():
            break
    return out, label


def _compare(table: pa.Table, plan: Plan, tau: int, similar: float):
    """(cell, rows, links, labels) of each cell of a bin."""
    cells = table.column("cell").to_numpy()
    data = table.column("data").to_pylist()
    order = np.argsort(cells, kind="stable")
    edge = np.flatnonzero(np.diff(cells[order])) + 1
    for part in np.split(order, edge) if len(order) else ():
        rows = np.frombuffer(b"".join(data[x] for x in part.tolist()), _RECORD)
        w, n, asks = rows["w"], (rows["n"] >> 1).astype(np.int64), (rows["n"] & 1).astype(bool)
        by = np.argsort(n, kind="stable")
        w, n, asks = np.ascontiguousarray(w[by]), n[by], asks[by]
        cell = int(cells[part[0]])
        yield cell, w, n, *cell_links(w, n, asks, _word_of(plan, cell), tau, similar)


def links(nodes: DataFrame, n: int, tau: int = TAU, similar: float = SIMILAR, most: int = 1 << 14) -> DataFrame:
    """(a, b): links that connect all near-copies among ``nodes`` (name, w0, w1, w2, n; each fingerprint once)."""
    spark = nodes.sparkSession
    cells = plan(nodes, n, tau, most)
    columns = [*(f"w{k}" for k in range(WORDS)), "n"]
    shared = spark.sparkContext.broadcast(cells)
    per_text = WORDS * (cells.m + (tau - cells.m + 1) * len(cells.groups[0][0]))
    n_bins = max(shuffle_partitions(spark), -(-n * per_text * _RECORD.itemsize // _BIN_BYTES))
    cut_up = any((b > 1).any() for b in cells.blocks)

    def send(batches):
        plan = shared.value
        for batch in batches:
            w, size = _columns(batch)
            name = names(w, size)
            for at in range(0, len(size), 8192):
                some, parts = slice(at, at + 8192), []
                for k, g, row, cell, own in plan.messages(w[some]):
                    block = (name[some][row] % plan.blocks[k][g, cell].astype(np.uint64)).astype(np.int64)
                    parts.append((_name_cell(plan, k, g, cell, block), row, own))
                yield _packed(parts, w[some], size[some], n_bins)

    def meet(table: pa.Table) -> pa.Table:
        a, b = [], []
        for cell, w, size, found, label in _compare(table, shared.value, tau, similar):
            name = names(w, size).view(np.int64)
            a += [int(name[i]) for i, _ in found]
            b += [int(name[j]) for _, j in found]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def dealt(source, fields, run):
        return source.select(*fields).mapInArrow(run, "bin long, cell long, data binary").repartition(n_bins, "bin").groupBy("bin").applyInArrow(meet, "a long, b long").distinct()

    first = dealt(nodes, columns, send)
    if not cut_up:
        return first
    return first.union(_between_blocks(nodes, cut(first), columns, shared, n_bins, dealt))


def _between_blocks(nodes: DataFrame, first: DataFrame, columns: list[str], shared, n_bins: int, dealt) -> DataFrame:
    """The links between texts of different blocks of a cell, given those within blocks.

    The largest component of a cell is counted over its texts; each text outside it asks all blocks of the cell.
    """

    def placed(batches):
        plan = shared.value
        for batch in batches:
            w, size = _columns(batch)
            root = batch.column(WORDS + 1).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, g, row, cell, _ in plan.messages(w):
                at = np.flatnonzero(plan.blocks[k][g, cell] > 1)
                name = _name_cell(plan, k, g, cell[at], np.zeros(len(at), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(root[row[at]])], names=["cell", "root"])

    def ask(lead: dict):
        def run(batches):
            plan, lead_of = shared.value, lead.value
            for batch in batches:
                w, size = _columns(batch)
                root = batch.column(WORDS + 1).to_numpy(zero_copy_only=False).astype(np.int64)
                name = names(w, size)
                for at in range(0, len(size), 1024):
                    some, parts = slice(at, at + 1024), []
                    for k, g, row, cell, _ in plan.messages(w[some]):
                        hot = np.flatnonzero(plan.blocks[k][g, cell] > 1)
                        row, cell = row[hot], cell[hot]
                        blocks = plan.blocks[k][g, cell]
                        base = _name_cell(plan, k, g, cell, np.zeros(len(cell), np.int64))
                        apart = root[some][row] != np.array([lead_of.get(x, 0) for x in base.tolist()], np.int64)
                        block = (name[some][row] % blocks.astype(np.uint64)).astype(np.int64)
                        parts.append((_name_cell(plan, k, g, cell, block)[~apart], row[~apart], np.zeros((~apart).sum(), bool)))
                        row, cell, blocks = row[apart], cell[apart], blocks[apart]
                        every = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                        row, cell = np.repeat(row, blocks), np.repeat(cell, blocks)
                        parts.append((_name_cell(plan, k, g, cell, every), row, np.ones(len(row), bool)))
                    yield _packed(parts, w[some], size[some], n_bins)

        return run

    fields = [*columns, "root"]
    bridge = cut(dealt(nodes, columns, _leads(shared, n_bins)))
    roots = cut(connected_components(first.union(bridge)))
    known = cut(nodes.join(roots, F.col("name") == F.col("node"), "left").withColumn("root", F.coalesce("root", "name")))
    tally = known.select(*fields).mapInArrow(placed, "cell long, root long").groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n"))
    lead = tally.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("root"), F.count(F.lit(1)).alias("several"))
    # a row for each cell that is cut: at most WORDS x m x 2^16
    lead = {r["cell"]: r["root"] for r in lead.collect()}
    return bridge.union(dealt(known, fields, ask(nodes.sparkSession.sparkContext.broadcast(lead))))


def _leads(shared, n_bins: int):
    """Every 64th text of a cut cell, by name, meets the others of its cell at once: what connects most blocks."""

    def run(batches):
        plan = shared.value
        for batch in batches:
            w, size = _columns(batch)
            name, parts = names(w, size), []
            some = np.flatnonzero(name >> np.uint64(58) == 0)
            w, size = w[some], size[some]
            for k, g, row, cell, own in plan.messages(w):
                hot = np.flatnonzero((plan.blocks[k][g, cell] > 1) & own)
                # blocks of their own, past all others
                past = plan.blocks[k][g, cell[hot]] + (names(w, size)[row[hot]] % np.maximum(1, plan.blocks[k][g, cell[hot]] // 64).astype(np.uint64)).astype(np.int64)
                parts.append((_name_cell(plan, k, g, cell[hot], past), row[hot], own[hot]))
            yield _packed(parts, w, size, n_bins)

    return run


# ---------------------------------------------------------------- rows


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, similar: float = SIMILAR, most: int = 1 << 14) -> DataFrame:
    """One row of each group of near-copies: that of the smallest id, then text; rows with a null id come last.

    A group is what near-copies connect, directly or in steps.  ASCII case does not count.  Null and blank texts are
    copies of each other.  Rows are told apart by id and text, whatever else repeats; of rows with equal id and text one
    stays.  Texts are told apart by 64 bits of hash of their fingerprint and size.  All columns of ``docs`` stay; an
    empty table gives an empty one.
    """

    def run(batches):
        for batch in sliced(batches, 2):
            w, n = wide_prints(batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(names(w, n).view(np.int64)), *(pa.array(w[:, k].copy().view(np.int64)) for k in range(WORDS)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "own", "name", *(f"w{k}" for k in range(WORDS)), "n"])

    text = F.col(text_col).cast("string")
    own = F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
    words = ", ".join(f"w{k} long" for k in range(WORDS))
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), own.alias("own"), text.alias("text")).mapInArrow(run, f"id long, own long, name long, {words}, n long"))
    nodes = cut(rows.where("n > 0").select("name", *(f"w{k}" for k in range(WORDS)), "n").dropDuplicates(["name"]))
    roots = cut(connected_components(links(nodes, nodes.count(), tau, similar, most)))
    part = rows.join(roots, F.col("name") == F.col("node"), "left").select(F.coalesce("root", "name").alias("root"), F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "own").alias("row"))
    kept = part.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.none").alias("_kept_none"), F.col("row.id").alias("_kept_id"), F.col("row.own").alias("_kept_own"))
    mine = F.col(id_col).cast("long")
    out = docs.join(kept, (F.coalesce(mine, F.lit(0)) == F.col("_kept_id")) & (mine.isNull() == F.col("_kept_none")) & (own == F.col("_kept_own")), "left_semi")
    if not rows.groupBy("id", "own").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates([id_col, text_col])
    return out
