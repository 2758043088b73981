"""Count-min sketches of very many keys, kept sparse and merged by ranges of cells, that tell each group of rows which of its keys may be repeated.

Every group of rows counts its keys in a sketch of `depth` rows and 2**bits cells, and sends the occupied cells, gap-coded (about
one to two bytes each), to the tasks that merge one range of cells each. Back come bits: which of a group's cells some other group
occupies too. A key is estimated repeated if in every row its cell is hit twice or more; estimates are never too low, so no
repeated key is lost. The sketch is never in one place: it grows with the data, and only ranges of it are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.textkit import mix

CELLS = "_block int, _group long, _row int, _cells binary"
BITS = "_group long, _row int, _block int, _bits binary"
_LOCAL = 24


def squeeze(cells: np.ndarray) -> bytes:
    """Sorted numbers as gaps: one type byte, then gaps of one to four bytes; a full gap goes on in the next."""
    if not len(cells):
        return b""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    mean = float(cells[-1]) / len(cells)
    size = 1 if mean < 120 else 2 if mean < 30_000 else 3 if mean < 8_000_000 else 4
    top = (1 << 8 * size) - 1
    more = gaps // top
    out = np.full(len(gaps) + int(more.sum()), top, "<u4")
    out[np.cumsum(more + 1) - 1] = gaps % top
    return bytes([size]) + out.view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def unsqueeze(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    size = raw[0]
    wide = np.zeros(((len(raw) - 1) // size, 4), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, size)
    gaps = wide.view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.int64)[gaps != (1 << 8 * size) - 1]


class Sketch:
    def __init__(self, keys: int, blocks: int, depth: int = 2, load: float = 0.25) -> None:
        """For about `keys` keys in all, so that each row has 1 / load cells a key."""
        self.bits = min(48, max(16, int(np.ceil(np.log2(max(1, keys) / load)))))
        self.blocks, self.depth = blocks, depth

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        """The cell of each key in a row."""
        x = keys if row == 0 else mix(keys ^ np.uint64(0xA24BAED4963EE407 * row & (2**64 - 1)))
        x = x >> np.uint64(64 - self.bits)
        return x.astype(np.uint32) if self.bits <= 32 else x

    def edges(self) -> np.ndarray:
        return np.array([(b << self.bits) // self.blocks for b in range(self.blocks + 1)], np.int64)

    def _occupied(self, keys: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Occupied cells in order, and which of them are hit twice or more here."""
        cells = np.sort(self.cells(keys, row))
        first = np.flatnonzero(np.diff(cells, prepend=~cells[:1])) if len(cells) else np.zeros(0, np.int64)
        return cells[first], np.diff(np.append(first, len(cells))) > 1

    def send(self, keys: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(block, row, gap-coded cells within the block) of a group's keys."""
        out, edges = [], self.edges()
        for row in range(self.depth):
            cells, _ = self._occupied(keys, row)
            at = np.searchsorted(cells, edges)
            out += [(b, row, squeeze(cells[at[b] : at[b + 1]].astype(np.int64) - edges[b])) for b in range(self.blocks) if at[b + 1] > at[b]]
        return out

    def receive(self, keys: np.ndarray, got: dict[tuple[int, int], bytes]) -> list[np.ndarray]:
        """For each row, a table by a cell's low bits of what may be repeated, from the bits that came back by (row, block)."""
        out, edges = [], self.edges()
        for row in range(self.depth):
            cells, twice = self._occupied(keys, row)
            at = np.searchsorted(cells, edges)
            for b in range(self.blocks):
                if (row, b) in got:
                    n = int(at[b + 1] - at[b])
                    twice[at[b] : at[b + 1]] |= np.unpackbits(np.frombuffer(got[row, b], np.uint8), count=n).view(bool)
            table = np.zeros(1 << min(_LOCAL, self.bits), bool)
            table[(cells[twice] & (len(table) - 1)).astype(np.int64)] = True
            out.append(table)
        return out

    def repeated(self, keys: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Whether each key is estimated to be there twice or more."""
        out = np.ones(len(keys), bool)
        for row, t in enumerate(tables):
            out &= t[(self.cells(keys, row) & (len(t) - 1)).astype(np.int64)]
        return out


def _merge(table: pa.Table) -> pa.Table:
    """One range of cells: for every group and row, bits of its cells that another group occupies too."""
    block = table.column("_block")[0].as_py()
    groups, rows, raws = (table.column(c).to_pylist() for c in ("_group", "_row", "_cells"))
    out = []
    for row in sorted(set(rows)):
        mine = [(g, unsqueeze(c)) for g, r, c in zip(groups, rows, raws) if r == row]
        every = np.sort(np.concatenate([c for _, c in mine]))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        for g, cells in mine:
            if len(shared):
                hit = shared[np.minimum(np.searchsorted(shared, cells), len(shared) - 1)] == cells
                if hit.any():
                    out.append((g, row, block, np.packbits(hit).tobytes()))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["_group", "_row", "_block", "_bits"])


def merged(cells: DataFrame) -> DataFrame:
    """From the cells that groups sent, the bits that each of them gets back. A group without any gets no row."""
    return cells.groupBy("_block").applyInArrow(_merge, BITS)


def cell_table(group: int, sent: list[tuple[int, int, bytes]]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    columns = ([b for b, _, _ in sent], [group] * len(sent), [r for _, r, _ in sent], [c for _, _, c in sent])
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_block", "_group", "_row", "_cells"])


def received(table: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(r, b): x for r, b, x in zip(*(table.column(c).to_pylist() for c in ("_row", "_block", "_bits")))}
