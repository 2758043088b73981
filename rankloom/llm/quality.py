"""Quality classifier by compression: zstandard dictionaries of good and of bad text, and their calibrated size difference.

A dictionary is built from each label's training texts. A text is compressed, block by block and whole, with either
dictionary; the second size less the first, over the raw size, is all that a logistic curve with two numbers gets, which
is fitted on training rows of which no dictionary was built. Everything that is broadcast has a fixed bound:
two dictionaries of `dictionary_bytes`.

Defined cases. Null text: as the empty text. Empty text: the difference is 0, so its score is the curve's value there, and is
a number. Null doc_id: scored, held_out false, never trained on. Repeated rows: each is scored; of an id's different texts the least one trains. Documents labelled
both ways: left out of training. No or one-sided labels, or an empty table: no dictionary can be built and every
score is the share of label 1 (0.5 without labels). Columns other than doc_id and text are never read; a carried one that a result has too
gets `_given` behind it.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import beside, release, settle, train_rows
from rankloom.llm.textkit import view

RESULT = ["doc_id", "score", "predicted"]


@dataclasses.dataclass
class Model:
    good: bytes
    bad: bytes
    level: int
    block: int
    bias: float = 0.0
    slope: float = 0.0

    def differences(self, texts: pa.Array) -> np.ndarray:
        """(size under the bad dictionary - size under the good one) / raw size of each text; 0 of an empty one."""
        by = []
        for raw in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=self.level)
            by.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        data, offsets = view(texts)
        raw, out = memoryview(data), np.zeros(len(offsets) - 1)
        for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for at in range(a, z, self.block):
                part = raw[at : min(z, at + self.block)]
                out[i] += len(by[1].compress(part)) - len(by[0].compress(part))
        return out / np.maximum(np.diff(offsets), 1)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * differences, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Bias and slope by Newton's method, ridge on the standardised slope."""
    mean, scale = x.mean(), x.std() + 1e-9
    a, w = np.stack([np.ones_like(x), (x - mean) / scale], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a / len(y) + ridge * np.eye(2), a.T @ (p - y) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale)


def _measured(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """Carried columns and the size difference x of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in carry], T.StructField("x", T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(batch.column, carry), pa.array(held.value.differences(batch.column("text")))], schema.names)

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", fold: int = 0, sample_rows: int = 3000, sample_blocks: int = 20, block_chars: int = 1024, dictionary_bytes: int = 256 << 10, level: int = 3, block: int = 2048) -> Model | float:
    """A model from at most `sample_rows` labelled rows of each label, those with the smallest hash of their id. Two thirds of them build
    dictionaries, from at most `sample_blocks` blocks spread evenly over each whole text; the rest, whole, fit the curve."""
    known = labels.where(F.col(label).isin(0, 1) & train_rows("doc_id", fold)).groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_most")).where("_y = _most")
    # bounded: at most 2 * sample_rows ids leave this union, before any text is read
    ids = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "_y")
        ids = part if ids is None else ids.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.length("text") > 0).groupBy("doc_id").agg(F.min("_y").alias("y"), F.min("text").alias("text"))
    rows = settle(rows.withColumn("builds", F.pmod(F.xxhash64("doc_id", F.lit("builds")), F.lit(3)) > 0))
    count = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if min(count.get(y, 0) for y in (0, 1)) < 9:
        total = sum(count.values())
        release(rows)
        return count.get(1, 0) / total if total else 0.5
    n = F.least(F.ceil(F.length("text") / block_chars), F.lit(sample_blocks)).cast("int")
    at = F.floor(F.col("i") * F.greatest(F.length("text") - block_chars, F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1))).cast("int")
    parts = rows.where("builds").withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    parts = parts.select("doc_id", "y", "i", F.substring("text", at + 1, F.lit(block_chars)).alias("part")).orderBy(F.xxhash64("doc_id"), "doc_id", "i").collect()
    built = {}
    for y in (0, 1):
        mine = [r.part.encode() for r in parts if r.y == y and len(r.part) >= 8]
        try:
            built[y] = zstandard.train_dictionary(dictionary_bytes, mine, k=1024, d=8, level=level).as_bytes()
        except zstandard.ZstdError:  # too little text for a trained one: raw content serves as one
            built[y] = b"".join(mine)[-dictionary_bytes:]
    model = Model(built[1], built[0], level, block)
    got = sorted((r.doc_id, r.y, r.x) for r in _measured(rows.where("NOT builds"), model, ["doc_id", "y"]).collect())
    release(rows)
    y, x = np.array([r[1] for r in got], float), np.array([r[2] for r in got])
    share = known.agg(F.avg("_y")).first()[0]
    if not 0 < y.mean() < 1:
        return float(share)
    model.bias, model.slope = _logistic(x, y)
    # the sample is balanced by label, not drawn as the table is: the bias gets the table's odds back
    model.bias += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return model


def score(docs: DataFrame, model: Model | float, *, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """doc_id, score in 0 to 1, predicted (1 from `threshold` on) and carried columns of every row."""
    given = carry or []
    names = beside(given, RESULT)
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"), F.lit(int(model >= threshold)).alias("predicted"), *[F.col(f"`{c}`").alias(n) for c, n in zip(given, names)])
    inner = [f"_c{i}" for i in range(len(given))]
    found = _measured(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(x) for c, x in zip(given, inner)]), model, ["doc_id", *inner])
    s = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(model.bias) + F.lit(model.slope) * F.col("x")))))
    found = found.withColumn("_score", s)
    return found.select("doc_id", F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"), *[F.col(x).alias(n) for x, n in zip(inner, names)])


def quality_scores(docs: DataFrame, labels: DataFrame, *, fold: int = 0, threshold: float = 0.3, **options) -> DataFrame:
    """Fits on rows outside fold `fold` of five and scores every row."""
    scored = score(docs, fit(docs, labels, fold=fold, **options), threshold=threshold)
    return scored.select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == fold, F.lit(False))).alias("held_out"), "score", "predicted")
