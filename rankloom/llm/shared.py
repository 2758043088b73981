"""What the operators share: written tables, input tables and the choice of training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.plans.tables import release, settle, shared_dir, spread, table

__all__ = ["beside", "release", "settle", "shared_dir", "spread", "table", "train_rows"]


def train_rows(doc_id: str, out: int) -> object:
    """True for rows whose crc32(doc_id as text) mod 5 is not `out`; rows without an id never train."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != out, F.lit(False))


def beside(given: list[str], results) -> list[str]:
    """Names for given columns beside results: their own, with `_given` behind it where that is taken (Spark's names have no case)."""
    taken, out = {x.lower() for x in results}, []
    for name in given:
        while name.lower() in taken:
            name += "_given"
        taken.add(name.lower())
        out.append(name)
    return out
