"""Language-model scores by prediction by partial matching, beside a smoothed word model.

The model is a trie of byte contexts up to three bytes long, whose counts come from all training texts. A symbol seen after the
longest known context costs its share there; else an escape (method C: as many escapes as distinct symbols), after which the next
shorter context predicts among the symbols that the longer one has not seen (symbol exclusion), down to a uniform choice among the
bytes never seen. An end symbol closes every text, so probabilities of texts sum up to one. adaptive() learns from each document
alone as it goes.

Counting: each task counts the four-byte events of its texts and sends one row per distinct event. All contexts count. Those of at
most two bytes (there are at most 65,793) and the `contexts` most frequent of three bytes are broadcast as a table of (contexts + 65,793) * 257
numbers at most; the other three-byte ones are a written table, which the events that need them meet in a join (a bitmap of 2 MB tells
which do). Word counts are a distributed table; the frequent part of it, at most `head` words, is broadcast as hashes, and what is
not in it meets the rest of the table in a join.

Defined cases. Null text: the empty text, of one end. Null doc_id: scored, never trained on, held_out false. Repeated rows: each is
scored, and trained on. No training rows: every symbol is uniform and base_score is 0. Empty table: no rows. Very long texts:
whole. Other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import settle, train_rows
from rankloom.llm.textkit import LOWER, SPACED, text_pieces, word_array, word_hashes, words

END, SYMBOLS, ORDER = 256, 257, 3


# --- training ---------------------------------------------------------------------------------------------------------


def _events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct events (order << 36 | context << 9 | symbol) of lower-cased texts, each with the longest context it has, and their counts."""
    n, docs = len(data), len(offsets) - 1
    size = np.diff(offsets)
    b = data.astype(np.uint32)
    deep = np.ones(n, bool)
    for k in range(ORDER):
        at = offsets[:-1][size > k] + k
        deep[at] = False
    if n > ORDER:
        gram = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        gram = np.sort(gram[deep[3:]])
        first = np.flatnonzero(np.diff(gram, prepend=~gram[:1])) if len(gram) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(gram)))
        gram = gram[first].astype(np.int64)
        keys = (np.int64(ORDER) << 36) | ((gram >> 8) << 9) | (gram & 255)
    else:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rest = []
    for k in range(ORDER + 1):  # symbols of less context, and the ends
        for at, symbol in ((offsets[:-1][size > k] + k, None), (offsets[1:][size == k] if k < ORDER else offsets[1:][size >= k], END)):
            if k == ORDER and symbol is None:
                continue
            context = np.zeros(len(at), np.int64)
            for j in range(k):
                context = (context << 8) | data[at - k + j]
            rest.append((np.int64(k) << 36) | (context << 9) | (data[at].astype(np.int64) if symbol is None else symbol))
    more, times = np.unique(np.concatenate(rest), return_counts=True)
    return np.concatenate([keys, more]), np.concatenate([counts, times])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first)


def event_counts(docs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(event, count) of all texts, by distinct events of each task."""

    def run(batches):
        held, n = [], 0

        def flush():
            keys, counts = _merged(held)
            for a in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 200_000]), pa.array(counts[a : a + 200_000])], ["event", "n"])

        for batch in batches:
            for _, data, offsets in text_pieces(batch.column("text")):
                held.append(_events(LOWER[data], offsets))
                n += len(held[-1][0])
                if n > most:
                    held, n = [_merged(held)], 0
                    if len(held[0][0]) > most:
                        yield from flush()
                        held = []
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "event long, n long").groupBy("event").agg(F.sum("n").alias("n"))


def trie(counts: DataFrame, contexts: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Events and counts of all contexts up to two bytes and of the most frequent three-byte ones, sorted by event; and a written table
    (context, symbols, counts) of the other three-byte ones, if there are any."""
    order, context, symbol = F.shiftright("event", 36), F.shiftright("event", 9).bitwiseAND((1 << 24) - 1), F.col("event").bitwiseAND(511)
    shorter = [F.when(order >= k, F.lit(k << 36).bitwiseOR(F.shiftleft(context.bitwiseAND((1 << 8 * k) - 1), 9)).bitwiseOR(symbol)) for k in range(ORDER)]
    low = counts.select("n", F.explode(F.array(*shorter)).alias("event")).where("event is not null").groupBy("event").agg(F.sum("n").alias("n"))
    deep = counts.where(order == ORDER).withColumn("context", context)
    kept = deep.groupBy("context").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "context").limit(contexts).select("context")
    rest = None
    if deep.select("context").distinct().count() > contexts:
        kept = settle(kept)
        other = deep.join(F.broadcast(kept), "context", "left_anti").groupBy("context")
        rest = settle(other.agg(F.collect_list(F.struct(symbol.alias("s"), "n")).alias("_all")).select("context", F.col("_all.s").alias("symbols"), F.col("_all.n").alias("counts")))
    rows = low.select("event", "n").unionByName(deep.join(F.broadcast(kept), "context").select("event", "n")).toArrow()
    keys, n = rows.column("event").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.int64)
    sort = np.argsort(keys)
    return keys[sort], n[sort], rest


def _level(c: np.ndarray, up_c: np.ndarray, up_u: np.ndarray, lowest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all symbols after contexts of counts c, and those of unseen ones after the escape; up_c and up_u are the next shorter
    contexts' counts and the latter probabilities."""
    seen = c > 0
    new = (up_c > 0) & ~seen
    left, kinds = (up_c * new).sum(1, keepdims=True), new.sum(1, keepdims=True)
    whole = np.maximum(left + kinds, 1)
    if lowest:  # below the empty context: uniform among what was never seen
        unseen = np.repeat(1 / np.maximum((~seen).sum(1, keepdims=True), 1), SYMBOLS, 1)
    else:
        open_ = ((up_c == 0) & ~seen).any(1, keepdims=True)
        # without a symbol left further down, this level takes all of what remains
        unseen = np.where(new, up_c / np.where(open_, whole, np.maximum(left, 1)), np.where(kinds > 0, kinds / whole, 1.0) * up_u)
    total, distinct = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    full = distinct == SYMBOLS
    p = np.where(seen, c / np.where(full, np.maximum(total, 1), np.maximum(total + distinct, 1)), np.where(distinct > 0, distinct / np.maximum(total + distinct, 1), 1.0) * unseen)
    return p, unseen


class Table:
    """Log10 probabilities of every symbol after every context of a trie, and where to find a context's row; `rest` are the three-byte
    contexts that the trie leaves to a join."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, rest: np.ndarray | None = None) -> None:
        node, symbol = keys >> 9, (keys & 511).astype(np.int64)
        ids = np.unique(np.append(node, 0))  # the empty context is there in any case; shorter contexts come first
        row = np.searchsorted(ids, node)
        order, context = ids >> 27, ids & ((1 << 24) - 1)
        # classes of bytes, 0 for those that no context holds and for a text's start
        used = np.unique(np.concatenate([context[order >= k + 1] >> 8 * k & 255 for k in range(ORDER)])) if len(ids) > 1 else np.zeros(0, np.int64)
        self.kinds = len(used) + 1
        self.kind = np.zeros(SYMBOLS, np.int32)
        self.kind[used] = np.arange(1, self.kinds)
        self.logs = np.empty((len(ids), SYMBOLS), np.float32)
        edges = np.searchsorted(row, np.arange(len(ids) + 1))
        lower: tuple = (np.array([-1]), np.zeros((1, SYMBOLS)), np.ones((1, SYMBOLS)) / SYMBOLS)
        for k in range(ORDER + 1):
            mine = np.flatnonzero(order == k)
            if not len(mine):
                break
            kept = ([], [])
            parent = np.zeros(len(mine), np.int64) if k == 0 else np.searchsorted(lower[0], (np.int64(k - 1) << 27) | (context[mine] & ((1 << 8 * (k - 1)) - 1)))
            for a in range(0, len(mine), 2048):
                part = mine[a : a + 2048]
                c = np.zeros((len(part), SYMBOLS))
                lo, hi = edges[part[0]], edges[part[-1] + 1]
                c[row[lo:hi] - part[0], symbol[lo:hi]] = counts[lo:hi]
                p, unseen = _level(c, lower[1][parent[a : a + 2048]], lower[2][parent[a : a + 2048]], k == 0)
                self.logs[part] = np.log10(np.maximum(p, 1e-300))
                if k < ORDER:
                    kept[0].append(c)
                    kept[1].append(unseen)
            lower = (ids[mine], np.concatenate(kept[0]), np.concatenate(kept[1])) if k < ORDER else lower
        self.first = [np.full(self.kinds**ORDER, int(np.searchsorted(ids, 0)), np.int32)]
        whole = self.first[0].reshape((self.kinds,) * ORDER)  # by the class three, two and one bytes back
        for i in np.argsort(order, kind="stable").tolist():
            k = int(order[i])
            at = tuple(int(self.kind[context[i] >> 8 * j & 255]) for j in range(k - 1, -1, -1))
            if k:
                whole[(..., *at)] = i
        self.rest = None
        if rest is not None:
            bits = np.zeros(1 << 24, bool)
            bits[rest] = True
            self.rest = np.packbits(bits)
            mine = slice(*np.searchsorted(keys, [np.int64(ORDER - 1) << 36, np.int64(ORDER) << 36]))
            self.keys, self.counts, self.ids = keys[mine], counts[mine], ids

    def deep(self, context: int, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 probabilities of all symbols after a three-byte context that the trie leaves out, from its counts."""
        node = (np.int64(ORDER - 1) << 27) | (context & ((1 << 8 * (ORDER - 1)) - 1))
        lo, hi = np.searchsorted(self.keys, [node << 9, (node + 1) << 9])
        c, up_c = np.zeros((1, SYMBOLS)), np.zeros((1, SYMBOLS))
        c[0, symbols], up_c[0, self.keys[lo:hi] & 511] = counts, self.counts[lo:hi]
        # the shorter context's unseen symbols have its escape's probability times the one asked for
        total, distinct = up_c.sum(), hi - lo
        up_u = 10.0 ** self.logs[np.searchsorted(self.ids, node)].astype(np.float64)[None] * ((total + distinct) / distinct)
        return np.log10(np.maximum(_level(c, up_c, up_u)[0][0], 1e-300))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Log10 probability of each lower-cased text and its end but for the events after contexts left to the join, and these: lists of
        distinct events (context << 9 | symbol) and their counts."""
        n = len(offsets) - 1
        symbol = np.full(len(data) + n, END, np.int32)
        slot = np.ones(len(symbol), bool)
        slot[offsets[1:] + np.arange(n)] = False
        symbol[slot] = data
        kind = np.concatenate([np.zeros(ORDER, np.int32), self.kind[symbol]])
        at = (kind[:-3] * self.kinds + kind[1:-2]) * self.kinds + kind[2:-1]
        logs = self.logs.ravel()[self.first[0][at].astype(np.int64) * SYMBOLS + symbol]
        if self.rest is None or not n:
            events = times = pa.nulls(n, pa.list_(pa.int64()))
        else:
            context = (symbol[:-3] << 16) | (symbol[1:-2] << 8) | symbol[2:-1]
            context[(symbol[:-3] == END) | (symbol[1:-2] == END) | (symbol[2:-1] == END)] = -1
            hit = np.flatnonzero((context >= 0) & ((self.rest[context >> 3] >> (7 - (context & 7)).astype(np.uint8)) & 1 == 1))
            logs[hit + ORDER] = 0.0
            text = np.searchsorted(offsets[1:] + np.arange(n), hit + ORDER)
            found, count = np.unique((text << 33) | (context[hit].astype(np.int64) << 9) | symbol[hit + ORDER], return_counts=True)
            edges = pa.array(np.searchsorted(found >> 33, np.arange(n + 1)), pa.int32())
            events, times = pa.ListArray.from_arrays(edges, pa.array(found & ((1 << 33) - 1))), pa.ListArray.from_arrays(edges, pa.array(count.astype(np.int64)))
        return np.add.reduceat(logs, offsets[:-1] + np.arange(n), dtype=np.float64) if n else np.zeros(0), events, times


def adaptive(text: bytes, order: int = ORDER) -> float:
    """Log10 probability of a text and its end under a model that starts empty and learns each symbol after coding it."""
    model: dict[bytes, dict[int, int]] = {}
    total = 0.0
    for i in range(len(text) + 1):
        symbol = text[i] if i < len(text) else END
        total += math.log10(probability(model, text[max(0, i - order) : i], symbol))
        for k in range(min(order, i) + 1):
            counts = model.setdefault(text[i - k : i], {})
            counts[symbol] = counts.get(symbol, 0) + 1
    return total


def probability(model: dict[bytes, dict[int, int]], context: bytes, symbol: int) -> float:
    """A symbol's probability after a context, by escapes with exclusion, one context after the other."""
    while context and context not in model:
        context = context[1:]
    p, out = 1.0, set()
    while True:
        counts = {s: c for s, c in model.get(context, {}).items() if s not in out}
        more = SYMBOLS - len(out) - len(counts)
        if counts:
            total = sum(counts.values()) + (len(counts) if more else 0)
            if symbol in counts:
                return p * counts[symbol] / total
            p *= len(counts) / total
            out |= counts.keys()
        if not context:
            return p / (SYMBOLS - len(out))
        context = context[1:]


def adaptive_scores(docs: DataFrame) -> DataFrame:
    """doc_id and the adaptive model's log10 probability of each lower-cased text."""

    def run(batches):
        for batch in batches:
            for lo, data, offsets in text_pieces(batch.column("text")):
                raw = LOWER[data].tobytes()
                out = [adaptive(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(out)), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


# --- words ------------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(word, count) of all lower-cased texts; the empty word stands for the ends."""

    def run(batches):
        held, n, ends = [], 0, 0

        def merged():
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out(found):
            for batch in found.cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).combine_chunks().to_batches(100_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1)], ["word", "n"])

        for batch in batches:
            ends += batch.num_rows
            for _, data, offsets in text_pieces(batch.column("text")):
                data = LOWER[data]
                starts, stops, _ = words(data, offsets, SPACED)
                found = word_array(data, starts, stops, SPACED).dictionary_encode()
                held.append(pa.table({"word": found.dictionary, "n": np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))}))
                n += held[-1].num_rows
                if n > most:
                    held = [merged()]
                    n = held[0].num_rows
                    if n > most // 2:
                        yield from out(held[0])
                        held, n = [], 0
        if held:
            yield from out(merged())
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([ends])], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _head(vocabulary: DataFrame, most: int, longest: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Hashes, sorted, and counts of all words of at least some count, `most` of them at most; whether that is every word."""
    usable = F.col("word").isNotNull() & (F.col("word") != "") & (F.octet_length("word") <= longest)
    sizes = vocabulary.groupBy(F.least("n", F.lit(10_000)).alias("c")).agg(F.count_if(usable).alias("k"), F.count_if(F.col("word") != "").alias("every")).collect()
    least, total = 10_001, 0
    for row in sorted(sizes, key=lambda r: -r.c):
        if total + row.k > most:
            break
        least, total = row.c, total + row.k
    held = vocabulary.where(usable & (F.least("n", F.lit(10_000)) >= least)).select(F.col("word").cast("binary").alias("word"), "n").toArrow()
    column = held.column("word").combine_chunks()
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    edges = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    hashes = np.concatenate([word_hashes(data[edges[a] : edges[min(a + 100_000, len(column))]], edges[a : min(a + 100_000, len(column))] - edges[a], edges[a + 1 : min(a + 100_000, len(column)) + 1] - edges[a]) for a in range(0, len(column), 100_000)] or [np.zeros(0, np.uint64)])
    sort = np.argsort(hashes)
    return hashes[sort], held.column("n").to_numpy()[sort].astype(np.float64), total == sum(r.every for r in sizes)


# --- scores -----------------------------------------------------------------------------------------------------------


def _deep(held):
    """Log10 probabilities of the symbols asked for after contexts of the written table: rows of context, symbols, counts, asked."""

    def run(batches):
        table = held.value[0]
        for batch in batches:
            events, logs = [np.zeros(0, np.int64)], [np.zeros(0)]
            for context, symbols, counts, asked in zip(batch.column("context").to_pylist(), batch.column("symbols"), batch.column("counts"), batch.column("asked")):
                asked = asked.values.to_numpy()
                events.append((context << 9) | asked)
                logs.append(table.deep(context, symbols.values.to_numpy(), counts.values.to_numpy())[asked])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(events)), pa.array(np.concatenate(logs))], ["event", "log"])

    return run


def score(docs: DataFrame, *, fold: int = 1, contexts: int = 1 << 15, head: int = 1 << 20, longest: int = 64) -> DataFrame:
    """Scores of every row, learned from rows outside fold `fold` of five: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    train = docs.where(train_rows("doc_id", fold))
    vocabulary = settle(word_counts(train))
    sums = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("ends")).first()
    total, distinct, ends = sums.n or 0, sums.v or 0, sums.ends or 0
    hashes, counts, every = _head(vocabulary, head, longest)
    keys, n, rest = trie(settle(event_counts(train)), contexts)
    table = Table(keys, n, None if rest is None else rest.select("context").toArrow().column("context").to_numpy())
    held = spark.sparkContext.broadcast((table, hashes, np.log10(counts + 0.5)))
    base = math.log10(total + 0.5 * (distinct + 1))
    end_log = math.log10(ends + 0.5)

    def run(batches):
        table, hashes, logs = held.value
        first, rows = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            for lo, data, offsets in text_pieces(batch.column("text")):
                data, n = LOWER[data], len(offsets) - 1
                starts, stops, at = words(data, offsets, SPACED)
                found = word_array(data, starts, stops, SPACED).dictionary_encode()
                raw, edges = np.frombuffer(found.dictionary.buffers()[2] or b"", np.uint8), np.frombuffer(found.dictionary.buffers()[1], np.int32)[: len(found.dictionary) + 1].astype(np.int64)
                which, h = found.indices.to_numpy(), word_hashes(raw, edges[:-1], edges[1:])
                pos = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                known = hashes[pos] == h if len(hashes) else np.zeros(len(h), bool)
                log = np.where(known, logs[pos], 0.0 if not every else math.log10(0.5)) if len(hashes) else np.full(len(h), 0.0 if not every else math.log10(0.5))
                per = np.concatenate([[0.0], np.cumsum(log[which])])
                hits = np.concatenate([[0], np.cumsum(known[which])])
                if every:
                    tail = pa.nulls(n, pa.list_(pa.string()))
                else:
                    rare = np.flatnonzero(~known[which])
                    tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, at), pa.int32()), found.dictionary.take(pa.array(which[rare])).cast(pa.string()))
                size = np.diff(at)
                # sums of each text by themselves, not as differences of long running sums
                own = np.add.reduceat(np.append(log[which], 0.0), at[:-1]) * (size > 0) if n else per[:0]
                own_score, events, times = table.score(data, offsets)
                yield pa.RecordBatch.from_arrays([
                    pa.array(first + rows + np.arange(n)), batch.column("doc_id").slice(lo, n).cast(pa.int64()), pa.array(size + 1), pa.array(hits[at[1:]] - hits[at[:-1]] + int(ends > 0)),
                    pa.array(own + end_log), pa.array(own_score), tail, events, times,
                ], ["row", "doc_id", "n_tokens", "n_known", "base", "score", "tail", "events", "times"])
                rows += n

    scored = docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<string>, events array<long>, times array<long>")
    if not every or rest is not None:
        scored = settle(scored)
    if not every:
        rare = scored.select("row", F.explode("tail").alias("word")).join(vocabulary, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("known"))
        scored = scored.drop("tail").join(rare, "row", "left").withColumns({"base": F.col("base") + F.coalesce("more", F.lit(0.0)), "n_known": F.col("n_known") + F.coalesce("known", F.lit(0))})
    if rest is not None:
        asked = scored.select("row", F.explode(F.arrays_zip("events", "times")).alias("x")).select("row", F.col("x.events").alias("event"), F.col("x.times").alias("times"))
        symbols = asked.select("event").distinct().groupBy(F.shiftright("event", 9).alias("context")).agg(F.collect_list(F.col("event").bitwiseAND(511)).alias("asked"))
        more = asked.join(rest.join(symbols, "context").mapInArrow(_deep(held), "event long, log double"), "event").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("deep"))
        scored = scored.drop("events", "times").join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("deep", F.lit(0.0)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == fold, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(base)).alias("base_score"), "score")
