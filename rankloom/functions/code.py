"""Source code columns: comment-free text, and segments that cover a text without loss under a token budget."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _standing_strings(source: str) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(first, past the last) (line, character) of strings that are statements of their own, by the syntax tree; none if it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines = source.splitlines(keepends=True)
    at = lambda row, byte: (row, len(lines[row - 1].encode()[:byte].decode()))  # noqa: E731  the tree counts bytes
    return sorted((at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset)) for n in ast.walk(tree) if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str))


def without_comments(source: str) -> str | None:
    """Python source without comments, a string that stands alone as a statement replaced by `pass`; null if it doesn't tokenise."""
    lines = source.splitlines(keepends=True)
    for (a, b), (c, d) in reversed(_standing_strings(source)):
        lines[a - 1 : c] = [lines[a - 1][:b] + "pass" + lines[c - 1][d:]]
    lines = "".join(lines).splitlines(keepends=True)
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO("".join(lines)).readline))
    except (tokenize.TokenError, SyntaxError):
        return None
    for t in reversed(tokens):
        if t.type == tokenize.COMMENT:
            row, column = t.start
            kept = lines[row - 1][:column].rstrip(" \t")
            lines[row - 1] = kept + lines[row - 1][t.end[1] :] if kept else ""
    return "".join(lines).strip()


@F.pandas_udf(T.StringType())
def comment_free(source: pd.Series) -> pd.Series:
    return source.map(without_comments, na_action="ignore")


def cut(text: str, cap: int, budget: int, count, hard: bool = True) -> list[tuple[int, int]]:
    """Ranges that cover the text in order. A text within the token budget stays whole, unless the character cap is hard and it is longer. Else
    each range ends at the last line end within `cap` characters, or at the cap, and is halved, and taken back to a line end again, until
    its tokens fit the budget (one character always does)."""
    if text and count(text) <= budget and not (hard and len(text) > cap):
        return [(0, len(text))]
    ends = np.cumsum([len(line) for line in text.splitlines(keepends=True)])
    out, start = [], 0
    while start < len(text):
        size = min(cap, len(text) - start)
        while True:
            at = int(np.searchsorted(ends, start + size, "right")) - 1
            stop = int(ends[at]) if at >= 0 and ends[at] > start else start + size
            if stop - start <= 1 or count(text[start:stop]) <= budget:
                break
            size = max(1, (stop - start) // 2)
        out.append((start, stop))
        start = stop
    return out


def segments(docs: DataFrame, cap: int = 4000, budget: int = 512, count=lambda s: len(s.split()), hard: bool = True) -> DataFrame:
    """(doc_id, segment, start, stop, text): the segments of every text, which together are the text. Null and empty texts have none."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows += [(i, k, a, b, t[a:b]) for k, (a, b) in enumerate(cut(t or "", cap, budget, count, hard))]
                if len(rows) > 5000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, segment long, start long, stop long, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "segment", "start", "stop", "text"])
