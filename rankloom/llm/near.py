"""N-gram Jaccard join by PartEnum signatures: components of documents whose sets of word k-shingles are similar enough.

Sets of one size band, or of the next, that are similar enough differ in a bounded number h of elements. The feature domain is hashed
into first-level partitions, each into three second-level ones, and every pair of those three gives a signature: the hash of the set's
elements in them. With (h + 1) / 2 first-level partitions, one of them holds one difference at most, so one of its pairs is
equal: similar sets share a signature, always. With e first-level partitions more they share signatures in e + 1 partitions, so that every set may leave
out its e commonest: one of those that both have, the rarest, is left by neither. Empty pairs, which say nothing, go first (a set with empty ones in more
than e partitions keeps them), then those signatures that most sets have. What many documents share by a common passage alone is
so mostly gone before any two sets are compared.

Texts are read once for this. Every task cuts its rows into chunks of bounded size and, chunk by chunk, writes the set's size and 128-bit hash of
each row, and its new sets' signatures, as messages to ranges of signature cells (gap-coded cells and row numbers, about five bytes a
signature). A range gives back the rows of the cells that several have. A cell that many rows of one chunk have goes out as rows of its
own, with one mark in the message, so that no range grows with a hot signature. Where chunks times ranges would be more than `most_messages`, signatures
go out as rows too, about four times the bytes but in proportion to the input at any size. Equal sets are one node, the row of smallest number.

In a few rounds each node is compared exactly with one neighbour of another
component: of the centres of its signatures (first the member that shares most with others, then random ones), the one that most of them share; the links found give components. Then, signature by
signature, all pairs of different components are held against an exact lower bound of their difference (of bits that each element flips, as many as differ), and those that
pass are compared exactly; a large signature is cut into blocks, each two of which are a task's work. So a large group of near copies costs a few comparisons a
member, and every pair that shares a signature is linked, in one component already, or shown not to be similar.

Defined cases. Null or empty text, or one without words: n_shingles 0, alone, component_id its own id. Fewer than k words: the whole
sequence is one shingle. Null doc_id: takes part, never names a component (one of null ids alone has a null component_id). Repeated rows: equal
texts are in one component; rows of one id with different texts are different nodes. Empty table: no rows. Very long texts: whole.
Carried columns may have any name; one that a result has too gets `_given` behind it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import beside, release, settle
from rankloom.llm.sketch import squeeze, unsqueeze
from rankloom.llm.textkit import LOWER, SPACED, mix, spans, text_pieces, window_hashes, word_pairs, words
from rankloom.operators.graph import components

_C1, _C2 = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)
_PAIRS = ((0, 1), (0, 2), (1, 2))
#: As many rows of a chunk in one cell are sent as rows of their own.
_HOT = 16
_SENT = "ref long, doc_id long, n long, hi long, lo long, spare0 int, spare1 int, k1 long, k2 long, block int, cell long, cells binary, refs binary"


class Bands:
    """Size bands and the partitions of each: similar sets are in one band or in neighbouring ones."""

    def __init__(self, percent: int, most: int = 1 << 31) -> None:
        self.low = [1]
        while self.low[-1] <= most:
            self.low.append(self.low[-1] * 100 // percent + 1)
        self.low = np.array(self.low)
        high = self.low[1:] - 1
        self.differences = (100 - percent) * 2 * high // (100 + percent)
        self.spare = np.select([self.differences < x for x in (4, 10, 24, 48)], [0, 1, 2, 3], self.differences // 12)
        self.parts = (self.differences + 2) // 2 + self.spare

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def alone(self, size: np.ndarray) -> np.ndarray:
        """Sets that are similar to equal ones only."""
        return self.differences[self.of(size) + 1] == 0


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, the n + 1 offsets of them, and a 128-bit hash of each set (0 of an empty one)."""
    data = LOWER[data]
    starts, stops, at = words(data, offsets, SPACED)
    pairs = word_pairs(data, starts, stops)
    one, two, of = window_hashes(pairs, at, k)
    sets, nodes = [], np.zeros((len(at) - 1, 2), np.uint64)
    for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist())):
        if a < b:
            order = np.argsort(one[a:b])
            mine, other = one[a:b][order], two[a:b][order]
            new = np.ones(b - a, bool)
            np.not_equal(mine[1:], mine[:-1], out=new[1:])
            mine, other = mine[new], other[new]
        else:
            lo, hi = int(at[i]), int(at[i + 1])
            mine = other = np.zeros(0, np.uint64)
            if lo < hi:  # fewer than k words: all of them
                mine, other, _ = window_hashes((pairs[0][lo:hi], pairs[1][lo:hi]), np.array([0, hi - lo]), hi - lo)
                mine, other = mix(mine ^ np.uint64(hi - lo)), mix(other + np.uint64(hi - lo))
        if len(mine):
            nodes[i] = mix(mine ^ _C1).sum(dtype=np.uint64) + np.uint64(len(mine)), mix(other ^ _C2).sum(dtype=np.uint64)
        sets.append(mine)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64), nodes


def signatures(elements: np.ndarray, at: np.ndarray, bands: Bands, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of the sets to use, the last bit being their band's, and the set that each is of; and, for even and odd bands, how many more
    of its signatures a set may leave out."""
    size, band, out, whose = np.diff(at), bands.of(np.diff(at)), [], []
    left = np.zeros((len(size), 2), np.int32)
    for tag in np.unique(np.concatenate([band, band + 1])).tolist():
        if not bands.differences[tag]:
            continue
        mine = np.flatnonzero(use & ((band == tag) | (band + 1 == tag)))
        if not len(mine):
            continue
        parts, spare = int(bands.parts[tag]), int(bands.spare[tag])
        x = elements[spans(at[mine], size[mine])]
        slot = ((mix(x ^ np.uint64(tag * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(32)) * np.uint64(3 * parts) >> np.uint64(32)).astype(np.int64)
        slot += np.repeat(np.arange(len(mine)) * (3 * parts), size[mine])
        total = np.zeros(len(mine) * 3 * parts, np.uint64)
        np.add.at(total, slot, mix(x ^ _C2))
        total, filled = total.reshape(-1, parts, 3), np.bincount(slot, minlength=len(total)).reshape(-1, parts, 3) > 0
        place = mix(np.arange(3 * parts, dtype=np.uint64) + np.uint64(tag << 32)).reshape(parts, 3)
        signs = np.stack([mix(total[:, :, a] * _C1 + total[:, :, b] * _C2 ^ place[:, j]) for j, (a, b) in enumerate(_PAIRS)], 2)
        empty = np.stack([~(filled[:, :, a] | filled[:, :, b]) for a, b in _PAIRS], 2)
        empties = empty.any(2).sum(1)
        keep = ~empty | (empties > spare)[:, None, None]
        left[mine, tag & 1] = np.maximum(spare - empties, 0)
        out.append(signs[keep] & ~np.uint64(1) | np.uint64(tag & 1))
        whose.append(np.broadcast_to(mine[:, None, None], signs.shape)[keep])
    return (np.concatenate(out), np.concatenate(whose), left) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), left)


def _parities(elements: np.ndarray) -> bytes:
    """Bits that each element flips one of, eight times as many as elements or more: sets differ in as many elements as bits, at least."""
    bits = 1 << max(12, int(8 * len(elements) - 1).bit_length())
    return np.packbits(np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def _folded(parities: list[bytes]) -> np.ndarray:
    """Parities of several sets, halved until all have the size of the least, as rows of 64-bit words."""
    least, out = min(map(len, parities)), []
    for raw in parities:
        x = np.frombuffer(raw, np.uint64)
        while len(x) * 8 > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.stack(out)


class Cells:
    """The cells that signatures fall into and the ranges that cells are merged by."""

    def __init__(self, keys: int, block_keys: int = 1 << 20, chunks: int = 0, most_messages: int = 1 << 32) -> None:
        """For about `keys` signatures in all: 65,536 cells for each, so that hardly any two meet by chance; `block_keys` signatures to a range, or
        fewer for 64 ranges."""
        self.bits = min(62, max(16, int(np.ceil(np.log2(max(1, keys) * 65536)))))
        self.blocks = max(1, min(64, keys >> 14), -(-keys // block_keys))
        self.rows = chunks * self.blocks > most_messages

    def edge(self, block):
        """The first cell of a range."""
        return (int(block) << self.bits) // self.blocks


class _Chunk:
    """Signatures of one chunk's new sets, by cells, until they are sent."""

    def __init__(self, base: int) -> None:
        self.base, self.seen, self.bytes = base, set(), 0
        self.cells: list[np.ndarray] = []
        self.refs: list[np.ndarray] = []

    def messages(self, cells: Cells) -> list[tuple[int, int, bytes | None, bytes]]:
        """(block, cell, cells, refs); block -1 for the rows of a hot cell, or, without a cell, of many."""
        if not self.cells:
            return []
        cell, ref = np.concatenate(self.cells), np.concatenate(self.refs)
        if cells.rows:
            return [(-1, None, cell[a : a + 65536].tobytes(), (self.base + ref[a : a + 65536]).tobytes()) for a in range(0, len(cell), 65536)]
        order = np.lexsort((ref, cell))
        cell, ref = cell[order], ref[order]
        new = np.ones(len(cell), bool)  # a set with two signatures in one cell is there once
        new[1:] = (cell[1:] != cell[:-1]) | (ref[1:] != ref[:-1])
        cell, ref = cell[new], ref[new]
        first = np.flatnonzero(np.diff(cell, prepend=~cell[:1]))
        times = np.diff(np.append(first, len(cell)))
        out, stay = [], np.ones(len(cell), bool)
        wide = int(ref.max()) >= 0xFFFF
        mark = np.uint32(0xFFFFFFFF) if wide else np.uint16(0xFFFF)
        sent = ref.astype(np.uint32 if wide else np.uint16)
        for a, n in zip(first[times > _HOT].tolist(), times[times > _HOT].tolist()):
            out.append((-1, int(cell[a]), None, (self.base + ref[a : a + n]).tobytes()))
            sent[a], stay[a + 1 : a + n] = mark, False
        cell, sent = cell[stay], sent[stay]
        edges = np.array([cells.edge(b) for b in range(cells.blocks + 1)], np.int64)
        at = np.searchsorted(cell, edges)
        head = np.array([self.base], np.int64).tobytes()
        out += [(b, None, squeeze(cell[at[b] : at[b + 1]] - edges[b]), head + sent[at[b] : at[b + 1]].tobytes()) for b in range(cells.blocks) if at[b + 1] > at[b]]
        return out


def _sent(docs: DataFrame, k: int, bands: Bands, cells: Cells, carry: list[str], chunk_bytes: int) -> DataFrame:
    """One pass over the texts: a row for every document (ref: a number of its own; n, hi and lo of its set) and messages of its signatures."""
    schema = T.StructType([*T.StructType.fromDDL(_SENT).fields, *[T.StructField(c, docs.schema[c].dataType) for c in carry]])

    def run(batches):
        base, shape = TaskContext.get().partitionId() << 36, pa.schema([])
        row, chunk = 0, _Chunk(base)

        def flush(chunk):
            found = chunk.messages(cells)
            for lo in range(0, len(found), 4096):
                part = found[lo : lo + 4096]
                columns = [pa.nulls(len(part), kind) for kind in [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] * 2]
                columns += [pa.array([m[i] for m in part], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(part), shape.field(c).type) for c in carry)], schema.names)

        for batch in batches:
            shape = batch.schema
            for lo, data, offsets in text_pieces(batch.column("text")):
                elements, at, nodes = shingle_sets(data, offsets, k)
                size, n = np.diff(at), len(offsets) - 1
                use = (size > 0) & ~bands.alone(np.maximum(size, 1))
                for i in np.flatnonzero(use).tolist():
                    if (key := nodes[i].tobytes()) in chunk.seen:
                        use[i] = False
                    chunk.seen.add(key)
                signs, whose, left = signatures(elements, at, bands, use)
                if len(signs):
                    cell = signs >> np.uint64(64 - cells.bits)
                    chunk.cells.append((cell & ~np.uint64(1) | signs & np.uint64(1)).astype(np.int64))
                    chunk.refs.append(whose + (base + row - chunk.base))
                none, nodes = size == 0, nodes.view(np.int64)
                columns = [pa.array(base + row + np.arange(n)), batch.column("doc_id").slice(lo, n).cast(pa.int64()), pa.array(size), pa.array(nodes[:, 0].copy(), mask=none), pa.array(nodes[:, 1].copy(), mask=none), pa.array(left[:, 0].copy()), pa.array(left[:, 1].copy())]
                columns += [batch.column(c).slice(lo, n) for c in ("k1", "k2")] + [pa.nulls(n, kind) for kind in (pa.int32(), pa.int64(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).slice(lo, n) for c in carry)], schema.names)
                row += n
                chunk.bytes += len(data)
                if chunk.bytes >= chunk_bytes:
                    yield from flush(chunk)
                    chunk = _Chunk(base + row)
        if chunk.cells:
            yield from flush(chunk)

    return docs.select("doc_id", "text", "k1", "k2", *carry).mapInArrow(run, schema)


def _shared_cells(sent: DataFrame, cells: Cells) -> DataFrame:
    """(sign, node): rows whose cells several rows have."""

    def merge(table):
        edge = cells.edge(table.column("block")[0].as_py())
        cell, ref = [], []
        for a, b in zip(table.column("cells"), table.column("refs")):
            raw = b.as_buffer()
            mine, base = unsqueeze(a.as_buffer().to_pybytes()), int(np.frombuffer(raw, np.int64, 1)[0])
            kind = np.uint16 if len(raw) - 8 == 2 * len(mine) else np.uint32
            got = np.frombuffer(raw, kind, len(mine), 8)
            cell.append(mine)
            ref.append(np.where(got == np.iinfo(kind).max, -1, base + got.astype(np.int64)))
        cell, ref = np.concatenate(cell), np.concatenate(ref)
        order = np.argsort(cell, kind="stable")
        cell, ref = cell[order], ref[order]
        again, hit = cell[1:] == cell[:-1], ref < 0
        hit[1:] |= again
        hit[:-1] |= again
        hit &= ref >= 0
        return pa.table([pa.array(edge + cell[hit]), pa.array(ref[hit])], names=["sign", "node"])

    def split(batches):
        for batch in batches:
            for cell, many, raw in zip(batch.column("cell").to_pylist(), batch.column("cells"), batch.column("refs")):
                refs = np.frombuffer(raw.as_buffer(), np.int64)
                of = np.frombuffer(many.as_buffer(), np.int64) if cell is None else np.full(len(refs), cell)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(refs)], ["sign", "node"])

    found = sent.where("block >= 0").select("block", "cells", "refs").groupBy("block").applyInArrow(merge, "sign long, node long")
    return found.unionByName(sent.where("block = -1").select("cell", "cells", "refs").mapInArrow(split, "sign long, node long"))


def _sets_of(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The sets of some nodes and their parities. Asked: node and its row's keys."""

    def run(batches):
        for batch in batches:
            for lo, data, offsets in text_pieces(batch.column("text")):
                elements, at, _ = shingle_sets(data, offsets, k)
                sets = [elements[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, len(sets)), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([_parities(x) for x in sets], pa.binary())], ["node", "elements", "parities"])

    texts = docs.select("k1", "k2", "text").join(asked, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("node").alias("node"))
    return texts.select("node", "text").mapInArrow(run, "node long, elements binary, parities binary")


def _verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by exact intersection."""
    sets = found.select("node", "elements")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("_x")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("_y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x"), batch.column("_y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                one = np.sort(np.concatenate([x, y]))
                shared = int((one[1:] == one[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def _across(rows: DataFrame, sets: DataFrame, percent: int, part_rows: int = 25_000, block: int = 2048) -> DataFrame:
    """Pairs of nodes of one signature but different components that the sizes and parities can't tell apart.

    Rows: sign, node, root, n. Signatures are dealt out over parts of about `part_rows` rows; one of more than `block` rows is cut into blocks,
    and every two of them are a part. A part gets each of its nodes' parities once."""

    def pairs(left, right, node, root, n, bits):
        """Pairs of the places in left with those in right (or after their own, in the same array)."""
        out = []
        for i, a in enumerate(left.tolist()):
            others = right[i + 1 :] if right is left else right
            low, high = np.searchsorted(n[others], [-(-n[a] * percent // 100), n[a] * 100 // percent + 1])
            others = others[low:high]
            b = others[root[others] != root[a]]
            if len(b):
                apart = np.bitwise_count(bits[b] ^ bits[a]).sum(1, dtype=np.int64)
                b = node[b[apart * (100 + percent) <= (100 - percent) * (n[b] + n[a])]]
                out.append(np.stack([np.minimum(b, node[a]), np.maximum(b, node[a])], 1))
        return out

    def run(key, table, held):
        out = [np.zeros((0, 2), np.int64)]
        if table.num_rows and held.num_rows:
            sign, node, root, n, side, i, j = (table.column(c).to_numpy() for c in ("sign", "node", "root", "n", "side", "i", "j"))
            order = np.argsort(held.column("node").to_numpy())
            at = order[np.searchsorted(held.column("node").to_numpy()[order], node)]
            parities = held.column("parities").to_pylist()
            order = np.lexsort((n, side, j, i, sign))
            new = np.any([np.diff(x[order], prepend=x[order[0]] - 1) != 0 for x in (sign, i, j)], 0)
            edges = np.append(np.flatnonzero(new), len(order))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                mine = order[lo:hi]
                own = (node[mine], root[mine], n[mine], _folded([parities[x] for x in at[mine].tolist()]))
                places = np.arange(len(mine))
                if i[mine[0]] == j[mine[0]]:
                    out += pairs(places, places, *own)
                else:
                    cut = int((side[mine] == i[mine]).sum())
                    out += pairs(places[:cut], places[cut:], *own)
                if len(out) > 4096:
                    out = [np.unique(np.concatenate(out), axis=0)]
        out = np.unique(np.concatenate(out), axis=0)
        return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    parts = max(1, -(-rows.count() // part_rows))
    blocks = rows.groupBy("sign").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    dealt = rows.join(blocks, "sign").withColumn("side", F.pmod(F.xxhash64("node"), "_blocks")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("side", "_other"), "j": F.greatest("side", "_other")})
    dealt = dealt.select(F.when(F.col("_blocks") == 1, F.pmod("sign", F.lit(parts))).otherwise(F.xxhash64("sign", "i", "j")).alias("part"), "sign", "node", "root", "n", "side", "i", "j")
    held = dealt.select("part", "node").toDF("part", "node").distinct().join(sets.select("node", "parities"), "node").select("part", "node", "parities").toDF("part", "node", "parities")
    return dealt.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(run, "a long, b long").distinct()


def _open(signs: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of signatures whose nodes are in several components, each with its node's root."""
    rooted = signs.select("sign", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("sign").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("sign")
    return settle(rooted.join(several, "sign").select("sign", "node", "root", "n"))


def _degrees(members: DataFrame, percent: int, block: int = 1024, elements: int = 1 << 20, part_bytes: int = 16 << 20) -> DataFrame:
    """(node, links): how many rows of other nodes each node is similar enough to. Members: node, root, copies, elements.

    Links are within components. A component is cut into blocks of about `block` sets or `elements` shingles; every two blocks meet in one group,
    where shared shingles of all pairs are counted at once, and only sums by node leave it."""

    def degrees(own, sizes_, weights, n_left):
        """Links of the first n_left sets to the rest, and back; among all of them where n_left is 0."""
        whose = np.repeat(np.arange(len(own)), sizes_)
        _, of, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = times[of] > 1
        whose, of = whose[shared], np.unique(of[shared], return_inverse=True)[1]
        order = np.argsort(of, kind="stable")
        whose, of = whose[order], of[order]
        a, b = (slice(None), slice(None)) if not n_left else (slice(0, n_left), slice(n_left, None))
        common = np.zeros((len(sizes_[a]), len(sizes_[b])), np.float32)
        width = 2048
        for lo in range(0, int(of[-1]) + 1 if len(of) else 0, width):
            x, y = np.searchsorted(of, [lo, lo + width])
            held = np.zeros((len(own), width), np.float32)
            held[whose[x:y], of[x:y] - lo] = 1
            common += held[a] @ held[b].T
        common = common.astype(np.int64)
        ok = 100 * common >= percent * (sizes_[a][:, None] + sizes_[b][None, :] - common)
        if not n_left:
            np.fill_diagonal(ok, False)
            return ok @ weights
        return np.concatenate([ok @ weights[b], weights[a] @ ok])

    def run(key, table):
        i, j, root, side, weights = (table.column(c).to_numpy() for c in ("i", "j", "root", "block", "copies"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("elements")]
        sizes_, links = np.array([len(x) for x in sets]), np.zeros(len(sets), np.int64)
        order = np.lexsort((side, j, i, root))
        new = np.any([np.diff(x[order], prepend=x[order[0]] - 1) != 0 for x in (root, i, j)], 0)
        edges = np.append(np.flatnonzero(new), len(order))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            mine = order[lo:hi]
            n_left = int((side[mine] == i[mine]).sum()) if i[mine[0]] != j[mine[0]] else 0
            if i[mine[0]] == j[mine[0]] or 0 < n_left < len(mine):
                links[mine] = degrees([sets[x] for x in mine.tolist()], sizes_[mine], weights[mine], n_left)
        return pa.table([table.column("node"), pa.array(links)], names=["node", "links"])

    size = F.octet_length("elements") / 8
    cut = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(size) / elements)).alias("_blocks"))
    parts = max(1, int((members.agg(F.sum(8 * size)).first()[0] or 0) // part_bytes))
    dealt = members.join(cut, "root").withColumn("block", F.pmod(F.xxhash64("node"), "_blocks")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")})
    dealt = dealt.withColumn("_part", F.when(F.col("_blocks") == 1, F.pmod("root", F.lit(parts))).otherwise(F.xxhash64("root", "i", "j")))
    found = dealt.select("_part", "root", "i", "j", "block", "node", "copies", "elements").groupBy("_part").applyInArrow(run, "node long, links long")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def _keys(doc_id: str = "doc_id", text: str = "text") -> list:
    """Two 64-bit hashes of id and text, by which a row's text is found again."""
    return [F.xxhash64(doc_id, text), F.xxhash64(F.lit("row"), text, doc_id)]


def similar(docs: DataFrame, *, k: int = 4, percent: int = 85, carry: list[str] | None = None, chunk_bytes: int = 4 << 20, block_keys: int = 1 << 20, most_messages: int = 1 << 32, rounds: int = 2, links_too: bool = True, keys_too: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links lead to), n_links where asked for (how many
    other rows have an equal set or one similar enough), and carried columns; where asked for, is_first (one row of each component: the one
    of smallest id) and the row's keys."""
    carry, bands = carry or [], Bands(percent)
    inner = {c: f"_c{i}" for i, c in enumerate(carry)}
    docs = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(x) for c, x in inner.items()], *[x.alias(f"k{i + 1}") for i, x in enumerate(_keys())])
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = Cells(total // 7, block_keys, -(-total // chunk_bytes), most_messages)
    sent = settle(_sent(docs, k, bands, cells, list(inner.values()), chunk_bytes))
    rows = settle(sent.where("block IS NULL").drop("block", "cell", "cells", "refs"))
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "ref")
    nodes = settle(rows.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("ref").alias("node"), F.max("n").alias("n"), F.max("spare0").alias("spare0"), F.max("spare1").alias("spare1"), F.count("*").alias("copies"), F.min(first).alias("first"), F.min(F.struct("ref", "k1", "k2")).alias("key")))
    # rows that are not their set's node go, then cells that one node alone has
    shared = _shared_cells(sent, cells)
    shared = shared.distinct() if cells.rows else shared  # a set may have two signatures in one cell
    found = settle(shared.join(nodes.select("node", "n", "spare0", "spare1"), "node"))
    release(sent)
    counted = found.join(found.groupBy("sign").agg(F.count("*").alias("c")).where("c > 1"), "sign")
    # every node leaves out its commonest signatures of a band, as many as it may; c - 1 over its size says how many others it shares how much with, so
    # that the original of many copies comes first
    of_node = Window.partitionBy("node")
    at = F.row_number().over(Window.partitionBy("node", F.col("sign").bitwiseAND(1)).orderBy(F.desc("c"), "sign"))
    spare = F.when(F.col("sign").bitwiseAND(1) == 0, F.col("spare0")).otherwise(F.col("spare1"))
    kept = settle(counted.withColumns({"at": at, "shares": F.sum(F.col("c") - 1).over(of_node) / F.col("n")}).where(F.col("at") > spare).select("sign", "node", "n", "shares"))
    release(found)
    signs = settle(kept.join(kept.groupBy("sign").agg(F.count("*").alias("c")).where("c > 1").select("sign"), "sign"))
    release(kept)
    sets = settle(_sets_of(docs, nodes.join(signs.select("node").distinct(), "node", "left_semi").select("node", "key.k1", "key.k2"), k))
    links = tried = roots = None
    done = [sets]
    for turn in range(rounds):
        rooted = signs if turn else signs.withColumn("root", F.col("node"))
        order = F.struct(-F.col("shares") if not turn else F.lit(0.0), F.xxhash64(F.lit(turn), "node"))
        centre = rooted.groupBy("sign").agg(F.min(F.struct(order.alias("h"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("top"))).alias("c")).select("sign", "c.*")
        asked = rooted.join(centre, "sign").where(f"root <> top AND 100 * least(n, m) >= {percent} * greatest(n, m)").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c")).groupBy("b").agg(F.min(F.struct(-F.col("c"), F.col("a")))["a"].alias("a"))
        asked = settle(asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = settle(_verified(asked, sets, percent))
        links = found if links is None else links.unionByName(found)
        tried = asked if tried is None else tried.unionByName(asked)
        done += [asked, found]
        roots = components(links)
        before, signs = signs, _open(signs, roots)  # most signatures are within components now
        release(before)
    more = settle(_verified(_across(signs, sets, percent).join(tried, ["a", "b"], "left_anti"), sets, percent))
    if more.take(1):
        roots = components(links.unionByName(more))
    done += [signs, more]
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("top")), "root").select("node", "hi", "lo", "top")
    extra = ["top"]
    if links_too:
        degree = settle(_degrees(roots.join(nodes, "node").join(sets, "node").select("node", "root", "copies", "elements"), percent))
        own = nodes.join(degree, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
        named, extra = named.join(own, "node"), ["top", "links"]
    release(*done)  # the result needs rows, nodes and roots alone
    out = rows.join(named.select("hi", "lo", *extra), ["hi", "lo"], "left")
    result = {"doc_id": F.col("doc_id"), "n_shingles": F.col("n"), "component_id": F.when(F.col("hi").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id"))}
    result |= {"n_links": F.coalesce("links", F.lit(0).cast("long"))} if links_too else {}
    result |= {"is_first": F.col("hi").isNull() | (F.col("ref") == F.col("top.ref")), "k1": F.col("k1"), "k2": F.col("k2")} if keys_too else {}
    return out.select(*[x.alias(c) for c, x in result.items()], *[F.col(x).alias(c) for x, c in zip(inner.values(), beside(carry, result))])


def first_of_each(docs: DataFrame, *, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of docs, whole, of which one stays for each component of near copies: the one of smallest id. Of rows equal in id and text one
    stays; rows without words all stay."""
    found = similar(docs.select("doc_id", "text"), k=k, percent=percent, links_too=False, keys_too=True, **options)
    keep = found.where("is_first").groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.max("n_shingles").alias("_size"))
    names = [f"_d{i}" for i in range(len(docs.columns))]
    keys = _keys(*[names[docs.columns.index(c)] for c in ("doc_id", "text")])
    mine = docs.toDF(*names).withColumns({f"_k{i + 1}": x for i, x in enumerate(keys)})
    kept = mine.join(settle(keep), ["_k1", "_k2"]).withColumn("_row", F.when(F.col("_size") == 0, F.monotonically_increasing_id()))
    return kept.dropDuplicates(["_k1", "_k2", "_row"]).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 3), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, b.b FROM r JOIN b ON r.reach = b.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id"""
