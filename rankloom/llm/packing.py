"""Cost-balanced packing of token sequences.

A piece's cost is linear * length + quadratic * length ** 2, as attention within the piece costs. Documents go in descending
order of cost to the sequence of lowest cost of all that have room for the whole; where none has, the piece is cut at the room
of the cheapest. A pool's sequences hold exactly its tokens: full ones of `size`, and for the rest one of each power of two in
it, which needs no padding. A pool is at most `pool_tokens` tokens of one input partition (a longer document is a pool of its
own), so nothing is shuffled and memory is bounded; its documents are ordered by cost, id and content, not by arrival.

Tokens come from a public tokenizer file (a parameter) with one end id after each text. Text is cut at plain spaces between
printable characters, where the byte-level splitter always starts a new token; a block's distinct parts are encoded once, by tiktoken's
merge loop over the file's own vocabulary, and the ids are put together again: the result equals encoding the whole text with
`tokenizers`, at a fraction of its CPU time. A text that holds one of the file's added tokens goes through `tokenizers` itself.

Defined cases. Null text: the empty text; empty text: the end id alone. Null doc_id: kept. Repeated rows: each row is packed.
Empty table: no rows. Very long texts: encoded whole, cut into pieces. Other columns are never read.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from rankloom.llm.textkit import spans, text_pieces, view

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True


def merge_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """The vocabulary of a byte-level BPE file, whose ids are its merges' ranks, by bytes; and its added tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = {x["content"] for x in model.get("added_tokens", [])}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}, [x.encode() for x in sorted(added)]


class Encoder:
    """Token ids of many texts at once, as encoding each of them whole gives them."""

    def __init__(self, path: str, end: int = 0) -> None:
        self.path, (ranks, self.added) = path, merge_ranks(path)
        self.bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.end = end

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where parts begin: at texts' starts and at single spaces between characters that are surely no white space."""
        n = len(data)
        if n < 3:
            return offsets[:-1][offsets[:-1] < n]
        solid = _GRAPH[data]
        # a two-byte letter of U+00C0..U+00FF: lead byte 0xC3, no white space among them
        lead = data == 0xC3
        before = solid.copy()
        before[1:] |= lead[:-1]
        cut = np.zeros(n, bool)
        cut[1:-1] = (data[1:-1] == 32) & before[:-2] & (solid[2:] | lead[2:])
        cut[offsets[:-1][offsets[:-1] < n]] = True
        last = offsets[1:-1] - 1
        edge = last[(last >= 0) & (data[np.maximum(last, 0)] == 32)]
        alone = np.isin(edge, offsets[:-1])
        cut[edge[~alone]] = False  # a space that ends its text stays with what is before it
        return np.flatnonzero(cut)

    def _encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts, end to end, and how many each part has."""
        first, stop = edges[:-1], edges[1:]
        last = data[stop - 1]
        apart = (stop - first > 1) & (data[first] == 32) & (_GRAPH[last] | ((last >= 0x80) & (data[np.maximum(stop - 2, 0)] == 0xC3)))
        second = data[np.minimum(first + 1, len(data) - 1)]
        apart &= _GRAPH[second] | (second == 0xC3)
        # such a part begins with a space between printable characters: all of them are encoded as one text, then cut again
        sizes, out = np.zeros(len(first), np.int64), []
        some = np.flatnonzero(apart)
        length = (stop - first)[some]
        ids = np.array(self.bpe.encode_ordinary(data[spans(first[some], length)].tobytes().decode()), np.uint16)
        sizes[some] = np.diff(np.concatenate([[0], np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(length)) + 1])) if len(some) else 0
        rest = np.flatnonzero(~apart)
        for i, a, b in zip(rest.tolist(), first[rest].tolist(), stop[rest].tolist()):
            out.append(np.array(self.bpe.encode_ordinary(data[a:b].tobytes().decode()), np.uint16))
            sizes[i] = len(out[-1])
        if not out:
            return ids, sizes
        at = np.zeros(len(first) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        flat = np.empty(at[-1], np.uint16)
        flat[spans(at[some], sizes[some])] = ids
        flat[spans(at[rest], sizes[rest])] = np.concatenate(out)
        return flat, sizes

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text's end id included, and the n + 1 offsets of each text's ids."""
        raw = data.tobytes()
        if not any(t in raw for t in self.added):
            return self._plain(data, offsets)
        whole, out = Tokenizer.from_file(self.path), []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if any(t in raw[a:b] for t in self.added):
                out.append(np.array([*whole.encode(raw[a:b].decode(), add_special_tokens=False).ids, self.end], np.uint16))
            else:
                out.append(self._plain(data[a:b], np.array([0, b - a]))[0])
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        n = len(offsets) - 1
        cuts = self._cuts(data, offsets)
        if not len(cuts):
            return np.full(n, self.end, np.uint16), np.arange(n + 1)
        edges = np.append(cuts, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        flat, sizes = self._encode(*view(parts.dictionary))
        at = np.cumsum(sizes) - sizes
        which = parts.indices.to_numpy()
        took = sizes[which]
        got = flat[spans(at[which], took)]
        total = np.zeros(len(cuts) + 1, np.int64)
        np.cumsum(took, out=total[1:])
        upto = total[np.searchsorted(cuts, offsets)]  # ids before each text
        out = np.insert(got, upto[1:], np.uint16(self.end))
        return out, upto + np.arange(n + 1)


class _Open:
    """Sequences with room, from which the cheapest of at least some room is taken: a heap for each room and a tree of their tops."""

    def __init__(self, rooms: list[int], size: int) -> None:
        self.half = 1 << size.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
        for s, room in enumerate(rooms):
            self.heaps[room].append((0.0, s))  # in order: heaps already
        self.tops = [_NONE] * (2 * self.half)
        for room, heap in enumerate(self.heaps):
            if heap:
                self.tops[self.half + room] = heap[0]
        for i in range(self.half - 1, 0, -1):
            self.tops[i] = min(self.tops[2 * i], self.tops[2 * i + 1])

    def _renew(self, room: int) -> None:
        i = self.half + room
        self.tops[i] = self.heaps[room][0] if self.heaps[room] else _NONE
        while i > 1:
            i >>= 1
            self.tops[i] = min(self.tops[2 * i], self.tops[2 * i + 1])

    def put(self, cost: float, s: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, s))
        self._renew(room)

    def cheapest(self, want: int) -> tuple[float, int]:
        """The least (cost, sequence) with room for `want`; (inf, -1) if there is none."""
        best, i, stop = _NONE, self.half + want, 2 * self.half
        while i < stop:
            if i & 1:
                best = min(best, self.tops[i])
                i += 1
            i, stop = i >> 1, stop >> 1
        return best if best != _NONE else (math.inf, -1)

    def take(self, room: int) -> None:
        """Removes the cheapest sequence of exactly this room."""
        heapq.heappop(self.heaps[room])
        self._renew(room)


_NONE = (math.inf, 1 << 62)


def plan(lengths: list[int], size: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents in the order given, which should be of descending cost, and the number of sequences."""
    total = sum(lengths)
    rest = total % size
    room = [size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    capacity, cost = list(room), [0.0] * len(room)
    open_, out = _Open(room, size), []
    queue = [(-min(n, size), i, 0, n) for i, n in enumerate(lengths) if n]
    # a document over the size fills whole sequences first; what is left of it goes on as a shorter piece
    heapq.heapify(queue)
    while queue:
        _, i, start, n = heapq.heappop(queue)
        want = min(n, size)
        s = open_.cheapest(want)[1]
        if s < 0:  # no sequence holds it whole: the cheapest takes what it can
            s = open_.cheapest(1)[1]
        took = min(want, room[s])
        out.append((i, start, took, s, capacity[s] - room[s]))
        open_.take(room[s])
        room[s] -= took
        cost[s] += linear * took + quadratic * took * took
        if room[s]:
            open_.put(cost[s], s, room[s])
        if n > took:
            heapq.heappush(queue, (-min(n - took, size), i, start + took, n - took))
    return out, len(capacity)


def pack(docs: DataFrame, *, tokenizer: str | None = None, end: int = 0, size: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024, pool_tokens: int = 4 << 20) -> DataFrame:
    """The pieces of all documents: which ids, with their checksum, and where they stand in which sequence."""

    def run(batches):
        path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")  # where this worker has it
        encoder, partition, pools = Encoder(path, end), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush():
            nonlocal held, tokens, pools
            order = sorted(held, key=lambda x: (-min(len(x[1]), size), x[0] is None, x[0] or 0, len(x[1]), zlib.crc32(x[1])))
            pieces, _ = plan([len(x[1]) for x in order], size, linear, quadratic)
            first = (partition << 36) + (pools << 22)  # a pool has under 2**22 sequences unless one document has over 4 billion tokens
            pools += 1
            held, tokens = [], 0
            for at in range(0, len(pieces), 50_000):
                part = pieces[at : at + 50_000]
                i, start, length, s, offset = map(list, zip(*part))
                sums = [zlib.crc32(order[a][1][b : b + n].astype("<u4")) for a, b, n, _, _ in part]
                n = np.array(length, float)
                columns = [pa.array([order[a][0] for a in i], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()), pa.array([len(order[a][1]) for a in i], pa.int64()), pa.array(first + np.array(s, np.int64)), pa.array(offset, pa.int64()), pa.array(linear * n + quadratic * n * n)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for lo, data, offsets in text_pieces(batch.column("text"), 4 << 20):
                flat, at = encoder(data, offsets)
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    if tokens and tokens + b - a > pool_tokens:
                        yield from flush()
                    held.append((ids[lo + i], flat[a:b].copy()))
                    tokens += b - a
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
