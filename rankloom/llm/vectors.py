"""Maximum inner product search with score-aware (anisotropic) four-bit product quantisation.

Every two dimensions have 16 centroids. Codebooks and codes minimise a loss in which the part of a residual that is parallel to its
vector weighs `eta` times the rest, (d - 1) t**2 / (1 - t**2) for scores above t of the norm: that part decides large inner products. Codebooks are
fitted on at most `sample_rows` vectors, those with the smallest hash of their id; every vector is coded. Equal vectors are one candidate, which stands
for the k + 1 smallest ids among them (no query can have more of them as its k nearest), so that copies of one vector never crowd out others.

Codes and vectors are a written table, which stays where it is: queries go past it in blocks of at most `block_queries`, broadcast one block after
the other. Each task scans its codes by tables of the block's products with the centroids, two codes to a byte, in segments of
`segment_rows` vectors; of each segment the best `rerank` go through an exact double-precision product, and the task's best k + 1 of each
query on to the merge. So what is shuffled are the vectors once, to find equal ones, and a few rows a query and task. Broadcast are the codebook and a block
of queries, both of fixed size. Ties go to smaller ids at every step.

Defined cases. Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows
without an id. Repeated rows: each is a candidate; for queries, one row of each id counts (the smallest vector). A query's own id is never its result.
Fewer than k candidates: all of them. Empty table or no query: no rows. Extra columns are never read.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.shared import settle


@dataclasses.dataclass
class Codebook:
    centres: np.ndarray  # subspaces x 16 x 2
    eta: float
    dim: int

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * len(self.centres) - self.dim))).reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x subspaces) by coordinate descent on the anisotropic loss."""
        x = self.pad(x)
        unit = x / np.sqrt((x * x).sum((1, 2), keepdims=True))
        codes = np.stack([((x[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1) for m in range(x.shape[1])], 1)
        rest = x - self.centres[np.arange(x.shape[1]), codes]
        along = (rest * unit).sum((1, 2))
        for _ in range(sweeps):
            for m in range(x.shape[1]):
                part = x[:, m, None] - self.centres[m]
                total = (along - (rest[:, m] * unit[:, m]).sum(1))[:, None] + (part * unit[:, m, None]).sum(2)
                codes[:, m] = ((part * part).sum(2) + (self.eta - 1) * total * total).argmin(1)
                pick = np.arange(len(x)), codes[:, m]
                rest[:, m], along = part[pick], total[pick]
        return codes.astype(np.uint8)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        codes = self.encode(x)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query with each pair of centroids: queries x bytes x 256."""
        one = np.einsum("qmd,mcd->qmc", self.pad(queries), self.centres)
        return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 4) -> Codebook:
    """Codebooks for vectors like those of x: plain k-means in each subspace, then alternating codes and weighted centroids."""
    n, dim = x.shape
    subspaces = -(-dim // 4) * 2
    book = Codebook(np.zeros((subspaces, 16, 2)), max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2)), dim)
    parts = book.pad(x)
    for m in range(subspaces):
        p = parts[:, m]
        centre = p[np.argsort(np.arctan2(p[:, 1], p[:, 0]), kind="stable")[np.linspace(0, n - 1, 16).astype(int)]] * np.linspace(0.5, 1.3, 16)[np.arange(16) * 7 % 16, None]
        for _ in range(10):
            code = ((p[:, None] - centre) ** 2).sum(2).argmin(1)
            count = np.bincount(code, minlength=16)
            mean = np.stack([np.bincount(code, p[:, d], 16) for d in range(2)], 1) / np.maximum(count, 1)[:, None]
            centre = np.where(count[:, None] > 0, mean, centre)
        book.centres[m] = centre
    unit = parts / np.sqrt((parts * parts).sum((1, 2), keepdims=True))
    for _ in range(rounds):
        codes = book.encode(x).astype(np.int64)
        rest = parts - book.centres[np.arange(subspaces), codes]
        along = (rest * unit).sum((1, 2))
        for m in range(subspaces):
            code, u, p = codes[:, m], unit[:, m], parts[:, m]
            other = along - (rest[:, m] * u).sum(1)
            right = p + (book.eta - 1) * u * (other + (p * u).sum(1))[:, None]
            a = np.zeros((16, 2, 2))
            for i in range(2):
                for j in range(2):
                    a[:, i, j] = np.bincount(code, (i == j) + (book.eta - 1) * u[:, i] * u[:, j], 16)
            b = np.stack([np.bincount(code, right[:, d], 16) for d in range(2)], 1)
            some = np.bincount(code, minlength=16) > 0
            book.centres[m][some] = np.linalg.solve(a[some] + 1e-9 * np.eye(2), b[some][..., None])[..., 0]
            rest[:, m] = p - book.centres[m][code]
            along = other + (rest[:, m] * u).sum(1)
    return book


def usable(table: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    """vec_id and vector as doubles, of the rows that take part."""
    good = "vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = table.select("vec_id", F.col(vector).cast("array<double>").alias("v")).where(good)
    if dim is None:
        most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = most.d if most else 1
    return rows.where(F.size("v") == dim)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 0))
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores; at the bound, of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    bound = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > bound)
    return np.sort(np.concatenate([over, np.flatnonzero(scores == bound)[: k - len(over)]]))


def _coded(rows: DataFrame, book, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with their smallest id (rep) and codes; and (rep, vec_id) of the k + 1 smallest ids of each."""
    w = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k + 1)  # cut in every task, then once more
    ranked = settle(ranked.withColumn("rep", F.first("vec_id").over(Window.partitionBy("v").orderBy("vec_id"))))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            codes = book.value.packed(x) if len(x) else np.zeros((0, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["rep", "codes", "vector"])

    return settle(ranked.where("_at = 1").select("rep", "v").mapInArrow(run, "rep long, codes binary, vector binary")), settle(ranked.select("rep", "vec_id"))


def _scan(coded: DataFrame, book, asked, k: int, rerank: int, segment_rows: int) -> DataFrame:
    """(query_id, rep, score): of every task, each broadcast query's k best."""

    def best_of(ids, x, codes, mine, y):
        """Segment by segment: places of the best, by exact score, then id."""
        for a in range(0, len(mine), 64):
            tables = book.value.tables(y[a : a + 64])
            for i, t in enumerate(tables):
                score = t[0][codes[0]]
                for j in range(1, len(codes)):
                    score += t[j][codes[j]]
                near = _best(score, rerank)
                exact = (x[near] * y[a + i]).sum(1)
                pick = _best(exact, k)
                yield a + i, ids[near[pick]], exact[pick]

    def run(batches):
        mine, y = asked.value
        held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(mine)

        def flush(parts):
            table = pa.Table.from_batches(parts).sort_by("rep")
            ids = table.column("rep").to_numpy()
            x, codes = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(len(ids), -1) for c, kind in (("vector", np.float64), ("codes", np.uint8)))
            for q, near, exact in best_of(ids, x, np.ascontiguousarray(codes.T).astype(np.intp), mine, y):
                if held[q] is not None:
                    near, exact = np.concatenate([held[q][0], near]), np.concatenate([held[q][1], exact])
                    order = np.lexsort((near, -exact))[:k]
                    near, exact = near[order], exact[order]
                held[q] = near, exact

        parts, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, segment_rows):
                part = batch.slice(lo, segment_rows)
                parts.append(part)
                n += part.num_rows
                if n >= segment_rows:
                    flush(parts)
                    parts, n = [], 0
        if n:
            flush(parts)
        for a in range(0, len(mine), 2048):
            some = [(int(q), *h) for q, h in zip(mine[a : a + 2048], held[a : a + 2048]) if h is not None]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in some], [len(near) for _, near, _ in some])), pa.array(np.concatenate([near for _, near, _ in some])), pa.array(np.concatenate([exact for _, _, exact in some]))], ["query_id", "rep", "score"])

    return coded.select("rep", "codes", "vector").mapInArrow(run, "query_id long, rep long, score double")


def search(table: DataFrame, *, vector: str = "embedding", every: int = 20, k: int = 20, rerank: int = 400, segment_rows: int = 16384, block_queries: int = 8192, sample_rows: int = 8192, threshold: float = 0.2) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    spark, rows = table.sparkSession, usable(table, vector)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    book = spark.sparkContext.broadcast(fit(_matrix(sample.column("v")), threshold))
    coded, members = _coded(rows, book, k)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() * 5 // (4 * block_queries)))
    queries = settle(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    found = None
    for block in range(blocks):
        mine = queries.where(F.col("block") == block).select("vec_id", "v").toArrow().sort_by("vec_id")
        if mine.num_rows:
            asked = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy(), _matrix(mine.column("v"))))
            one = _scan(coded, book, asked, k + 1, rerank, segment_rows)
            one = settle(one) if blocks > 1 else one
            found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    best = found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k + 1).drop("_at")
    near = best.join(members, "rep").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
