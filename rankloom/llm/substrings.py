"""Substring dedup: every word covered by a window of k words that also starts in a document with a smaller id is removed.

Count-min prefilter: groups of documents count their windows in sketches, which are merged by ranges of cells (see sketch; counts stop at two, which
is all that the estimate is asked for); only windows
estimated repeated go on. A second pass groups these exactly: each group sends its distinct candidates (128-bit hashes)
with the smallest id that has them, by ranges of hashes, and gets a bit back for each: whether a smaller id has it elsewhere. A third pass over
the texts marks the covered words. What is shuffled are the texts (by group), about two bytes a window and sketch row, and
24 bytes a distinct candidate of a group; no window's documents ever meet in one place, however many they are.

Defined cases. Null or empty text: no words; the kept text is empty. Null doc_id: counts as the largest id: its words are removed
where a document with an id has them, and it removes nothing. Repeated rows: rows of one id don't remove each other's words. Texts
of fewer than k words: nothing is removed. Empty table: no rows. Very long texts: whole. A window repeated within one document only
stays. Carried columns may have any name; one that a result has too gets `_given` behind it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import beside, settle
from rankloom.llm.sketch import BITS, CELLS, Sketch, cell_table, merged, received
from rankloom.llm.textkit import SPACED, spans, text_pieces, window_hashes, word_pairs, words

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_KEYS = "_block int, _group long, _keys binary"
_LAST = np.iinfo(np.int64).max


def grouped(docs: DataFrame, carry: list[str], groups: int) -> DataFrame:
    """doc_id, text and carried columns with a group of a bounded share of the texts for every row."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("_group"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)


def sizes(docs: DataFrame, group_bytes: int, least: int = 64) -> tuple[int, int]:
    """The bytes of all texts, and a number of groups: at least `least` unless they'd be under 32 kB, at most `group_bytes` each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return total, max(min(least, total >> 15), -(-total // group_bytes), 1)


def _in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A group's rows by id, null ids last, and the ids."""
    ids = table.column("doc_id").fill_null(int(_LAST)).to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    return table.take(pa.array(order)), ids[order]


def _windows(table: pa.Table, k: int):
    """(first row, words' pieces, window hashes, offsets of windows, other window hashes) of each piece of a group's texts."""
    for lo, data, offsets in text_pieces(table.column("text").combine_chunks()):
        starts, stops, at = words(data, offsets, SPACED)
        one, two, of = window_hashes(word_pairs(data, starts, stops), at, k)
        yield lo, (data, offsets, starts, stops, at), one, of, two


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _sort(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, then id, and which places begin a key. Callers give equal keys in order of ids, or any."""
    order = np.lexsort((ids, one))
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # one half of two keys agrees
        order = np.lexsort((ids, two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, np.concatenate([np.ones(min(1, len(a)), bool), ~same])


class _Group:
    """One group's candidates, the same whenever they are made from the same rows and bits."""

    def __init__(self, table: pa.Table, bits: pa.Table, sketch: Sketch, k: int, blocks: int) -> None:
        self.table, self.ids = _in_order(table)
        keys, found, self.pieces = [], [], []
        for lo, piece, one, of, two in _windows(self.table, k):
            keys.append(one)
            self.pieces.append((lo, piece, of))
            found.append((one, two, np.repeat(self.ids[lo : lo + len(of) - 1], np.diff(of))))
        tables = sketch.receive(_join(keys), received(bits))
        self.chosen = [np.flatnonzero(sketch.repeated(one, tables)) for one, _, _ in found]
        one, two, ids = (_join([f[i][c] for f, c in zip(found, self.chosen)]) for i in range(3))
        ids = ids.astype(np.int64)
        self.order, self.begins = _sort(one, two, ids)
        self.window_ids, first = ids, self.order[self.begins]
        self.one, self.two, self.least = one[first], two[first], ids[first]
        self.edges = np.searchsorted(self.one, np.array([(b << 64) // blocks for b in range(1, blocks)], np.uint64))
        self.edges = np.concatenate([[0], self.edges, [len(self.one)]])


def _second_merge(table: pa.Table) -> pa.Table:
    """One range of hashes: for every group, bits of its keys that a smaller id has in another group."""
    block, groups, raws = table.column("_block")[0].as_py(), table.column("_group").to_pylist(), table.column("_keys").to_pylist()
    ones, twos, ids, sizes = [], [], [], []
    for raw in raws:
        n = len(raw) // 24
        ones.append(np.frombuffer(raw, np.uint64, n))
        twos.append(np.frombuffer(raw, np.uint64, n, 8 * n))
        ids.append(np.frombuffer(raw, np.int64, n, 16 * n))
        sizes.append(n)
    one, two, every = np.concatenate(ones), np.concatenate(twos), np.concatenate(ids)
    order, begins = _sort(one, two, every)
    smaller = np.empty(len(every), bool)
    smaller[order] = every[order] > every[order][begins][np.cumsum(begins) - 1]
    out, at = [], 0
    for g, n in zip(groups, sizes):
        bits = smaller[at : at + n]
        at += n
        if bits.any():
            out.append((g, -1, block, np.packbits(bits).tobytes()))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["_group", "_row", "_block", "_bits"])


def _kept(piece: tuple, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text, one space after each, and the n + 1 offsets of each text's."""
    data, _, starts, stops, at = piece
    stay = np.flatnonzero(~gone)
    length = stops[stay] - starts[stay]
    upto = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(int(upto[-1]), 32, np.uint8)
    out[spans(upto[:-1], length)] = data[spans(starts[stay], length)]
    return out, upto[np.searchsorted(stay, at)]


def _fields(docs: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, docs.schema[n].dataType) for n in names]


def remove_repeats(docs: DataFrame, *, k: int = 13, carry: list[str] | None = None, with_text: bool = False, depth: int = 2, group_bytes: int = 8 << 20, range_bytes: int = 12 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, carried columns and, if asked, the kept text:
    the text as it was if nothing was removed, else the kept words joined by one space. Groups have up to `group_bytes` of text, a range of cells or keys those
    of `range_bytes` of text: tasks stay that small at any size; there is one message from each group to each range."""
    given = carry or []
    carry = [f"_c{i}" for i in range(len(given))]
    docs = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(x) for c, x in zip(given, carry)])
    total, groups = sizes(docs, group_bytes)
    blocks = max(min(groups, 64), -(-total // range_bytes))
    sketch = Sketch(total // 6, blocks, depth)
    x = grouped(docs, carry, groups)

    def first(key, table):
        return cell_table(key[0].as_py(), sketch.send(_join([one for _, _, one, _, _ in _windows(table, k)])))

    bits = settle(merged(x.groupBy("_group").applyInArrow(first, CELLS)))

    def second(key, left, right):
        if not left.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["_block", "_group", "_keys"])
        g = _Group(left, right, sketch, k, blocks)
        out = [(b, a, z) for b, (a, z) in enumerate(zip(g.edges[:-1], g.edges[1:])) if z > a]
        raw = [g.one[a:z].tobytes() + g.two[a:z].tobytes() + g.least[a:z].tobytes() for _, a, z in out]
        return pa.table([pa.array([b for b, _, _ in out], pa.int32()), pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array(raw, pa.binary())], names=["_block", "_group", "_keys"])

    elsewhere = x.groupBy("_group").cogroup(bits.groupBy("_group")).applyInArrow(second, _KEYS).groupBy("_block").applyInArrow(_second_merge, BITS)
    schema = T.StructType([*T.StructType.fromDDL(RESULT).fields, *([T.StructField("text", T.StringType())] if with_text else []), *_fields(docs, carry)])

    def third(key, left, right):
        kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if with_text else [])]
        if not left.num_rows:
            return pa.table([pa.array([], kind) for kind in kinds] + [left.column(c) for c in carry], names=names + carry)
        smaller = received(right.filter(pa.compute.less(right.column("_row"), 0)))
        g = _Group(left, right.filter(pa.compute.greater_equal(right.column("_row"), 0)), sketch, k, blocks)
        more = np.zeros(len(g.one), bool)
        for (_, b), raw in smaller.items():
            more[g.edges[b] : g.edges[b + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(g.edges[b + 1] - g.edges[b])).view(bool)
        which = np.empty(len(g.order), np.int64)
        which[g.order] = np.cumsum(g.begins) - 1
        covered = more[which] | (g.window_ids > g.least[which])
        rows, done = [], 0
        for (lo, piece, of), chosen in zip(g.pieces, g.chosen):
            data, offsets, starts, _, at = piece
            hit = chosen[covered[done : done + len(chosen)]]
            done += len(chosen)
            step = np.zeros(len(starts) + k + 1, np.int32)
            # a window's first word: the window's number plus the k - 1 windows that each earlier text lacks
            text = np.searchsorted(of, hit, "right") - 1
            word = hit - of[text] + at[text]
            np.add.at(step, word, 1)
            np.add.at(step, word + k, -1)
            gone = np.cumsum(step[: len(starts)]) > 0
            count = np.concatenate([[0], np.cumsum(gone)])
            removed = count[at[1:]] - count[at[:-1]]
            kept, upto = _kept(piece, gone)
            raw, plain = kept.tobytes(), data.tobytes()
            for i, (a, z) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist())):
                body = raw[a : max(a, z - 1)]
                row = (int(at[i + 1] - at[i]), int(removed[i]), hashlib.sha256(body).hexdigest())
                rows.append((*row, body.decode() if removed[i] else plain[offsets[i] : offsets[i + 1]].decode()) if with_text else row)
        columns = [g.table.column("doc_id").cast(pa.int64()), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds[1:]))]
        return pa.table(columns + [g.table.column(c) for c in carry], names=names + carry)

    out = x.groupBy("_group").cogroup(bits.unionByName(elsewhere).groupBy("_group")).applyInArrow(third, schema)
    return out.toDF(*schema.names[: -len(carry) or None], *beside(given, schema.names[: -len(carry) or None]))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 12), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT h, min(doc_id) AS first_doc FROM v GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT v.doc_id, v.i FROM v JOIN f USING (h) WHERE v.doc_id > f.first_doc), (SELECT unnest(range(0, 13)) AS j)),
k AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS kept FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) a ANTI JOIN c ON a.doc_id = c.doc_id AND a.p = c.p GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id LEFT JOIN n ON w.doc_id = n.doc_id"""
