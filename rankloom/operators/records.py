"""Views of items and queries, provenance, selectors, usage and component summaries, captions, windows and schemas: all column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources whose text comes from labels, and sources whose empty text is what was published.
GOLD_SOURCES = ["gold_caption", "gold_transcript", "gold_answer", "gold_docstring"]
EMPTY_SOURCES = ["published_markdown", "published_extracted_text", "ocr", "asr", "whisper_asr"]
#: Answers that a caller may try again for, while nothing has come yet.
RETRY_CODES = [429, 502, 503, 504]


def model_view(items: DataFrame, text_only: bool = False) -> DataFrame:
    """What a model may see of items (id, text, media, surrogate): id, text and media. Text-only views have no media, and the surrogate
    stands for the text where there is media and a surrogate."""
    if not text_only:
        return items.select("id", "text", "media")
    stands = F.col("media").isNotNull() & F.col("surrogate").isNotNull()
    return items.select("id", F.when(stands, F.col("surrogate")).otherwise(F.col("text")).alias("text"))


def generation_view(queries: DataFrame) -> DataFrame:
    """What a generator may see of a query: no labels, no answers."""
    return queries.select("query_id", "question", "language")


def first_of_split(rows: DataFrame, split: str, ordinal: str, limit: int) -> DataFrame:
    """The first rows of a split, by their ordinal."""
    return rows.where(F.col("split") == split).orderBy(ordinal).limit(limit)


def derived_text(items: DataFrame, derived: DataFrame) -> DataFrame:
    """items (id, text, ...) with text that a model made (id, text, source) in its place, and where it is from; ids and everything else stay."""
    new = derived.select("id", F.col("text").alias("_text"), F.col("source").alias("text_source"))
    out = items.join(new, "id", "left").withColumn("text", F.coalesce("_text", "text"))
    return out.select(*items.columns, "text_source")


def leak(source: Column, gold_used: Column, independent: Column) -> Column:
    """Why text may not be candidate text; null if it may. Provenance that isn't stated is a reason too."""
    low = F.lower(F.coalesce(source, F.lit("")))
    named = F.lit(False)
    for s in GOLD_SOURCES:
        named = named | F.contains(low, F.lit(s))
    return F.coalesce(
        F.when(gold_used, "labels used"), F.when(~independent, "depends on the query"), F.when(named, "labels as text"),
        F.when(gold_used.isNull() | independent.isNull(), "provenance not stated"),
    )


def text_gap(text: Column, source: Column, empty_is_valid: Column) -> Column:
    """missing, empty or valid-empty text; null for text. Text that isn't there is a gap, not an empty text."""
    valid = F.coalesce(empty_is_valid, F.lit(False)) | F.coalesce(source.isin(EMPTY_SOURCES), F.lit(False))
    return F.when(text.isNull(), "missing").when(F.trim(text) == "", F.when(valid, "valid empty").otherwise("empty"))


def primary_cell(cells: DataFrame, selectors: DataFrame) -> DataFrame:
    """For each selector, how many completed primary cells have it as their identity or variant, and the cell if it is exactly one."""
    good = cells.where((F.col("status") == "completed") & F.col("primary"))
    keys = good.select("identity", F.explode(F.array_distinct(F.array("identity", "variant"))).alias("selector"))
    found = keys.groupBy("selector").agg(F.count("*").alias("n"), F.min("identity").alias("_one"))
    return selectors.select("selector").join(found, "selector", "left").select("selector", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("_one")).alias("identity"))


def prepared_rows(raw: DataFrame, prepared: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Keys that only one side has, or whose rows differ in a compared column, with the reason: a good preparation gives no rows."""
    a, b = raw.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in compare], F.lit(1).alias("_a")), prepared.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in compare], F.lit(1).alias("_b"))
    differs = [F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), f"other {c}") for c in compare]
    reason = F.coalesce(F.when(F.col("_a").isNull(), "not raw"), F.when(F.col("_b").isNull(), "not prepared"), *differs)
    return a.join(b, keys, "full_outer").withColumn("reason", reason).where("reason IS NOT NULL").select(*keys, "reason")


def with_reference(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Composed queries (query_id, change, reference_id) as text: the reference item's text and the change asked for."""
    texts = items.select(F.col("id").alias("reference_id"), F.col("text").alias("_text"))
    return queries.join(texts, "reference_id").select("query_id", F.concat(F.lit("Reference: "), "_text", F.lit("\nRequested change: "), "change").alias("text"))


def usage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Calls, and tokens and cost of the successful ones (status, tokens, cost); null where none of them was measured."""
    good = F.col("status") == "ok"
    return rows.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(good).alias("succeeded"), F.sum(F.when(good, F.col("tokens"))).alias("tokens"), F.round(F.sum(F.when(good, F.col("cost"))), 6).alias("cost"))


def component_summary(members: DataFrame) -> DataFrame:
    """Of (node, root): components, the smallest, the largest, and the largest's share of all nodes."""
    sizes = members.groupBy("root").agg(F.count("*").alias("_n"))
    return sizes.agg(F.count("*").alias("components"), F.min("_n").alias("smallest"), F.max("_n").alias("largest"), F.round(F.max("_n") / F.sum("_n"), 6).alias("largest_share"))


def windows(length: Column, size: int) -> Column:
    """(start, stop) of consecutive windows of a size; the last one ends where the length does. No length: none."""
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length.cast("long") - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.transform(starts, lambda a: F.struct(a.alias("start"), F.least(a + size, length.cast("long")).alias("stop")))


def assembled(parts: DataFrame, longest: int = 20, tokens: tuple[int, int] = (1, 4096)) -> DataFrame:
    """Streamed captions (id, ordinal, delta, finish, tokens) put together, with the first thing wrong: how it ended, how long it is, or one word
    over and over."""
    from rankloom.operators.audit import longest_run

    one = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "delta"))).alias("_parts"), F.max_by("finish", "ordinal").alias("finish"), F.sum("tokens").alias("tokens"))
    text = F.trim(F.array_join(F.transform("_parts", lambda p: F.coalesce(p["delta"], F.lit(""))), ""))
    one = one.select("id", text.alias("text"), "finish", "tokens")
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    reason = F.coalesce(
        F.when(~F.col("finish").eqNullSafe(F.lit("stop")), "not finished"), F.when(F.col("text") == "", "empty"),
        F.when(~F.coalesce(F.col("tokens").between(*tokens), F.lit(False)), "token count"), F.when(longest_run(words) > longest, "repeated word"),
    )
    return one.withColumn("reason", reason)


def citation_schema(ids: Column) -> Column:
    """A JSON schema of answers that may cite the given ids only."""
    text, listed = F.lit("string").alias("type"), F.lit("array").alias("type")
    items = F.struct(text, F.array_sort(F.array_distinct(ids)).alias("enum")).alias("items")
    fields = F.struct(F.struct(text).alias("answer"), F.struct(listed, items, F.lit(True).alias("uniqueItems")).alias("citations")).alias("properties")
    return F.to_json(F.struct(F.lit("object").alias("type"), fields, F.array(F.lit("answer"), F.lit("citations")).alias("required"), F.lit(False).alias("additionalProperties")))


def parsed_prediction(payload: Column, sources: Column) -> Column:
    """(answer, citations, reason): a payload has exactly these two keys, and cites sources only."""
    held = F.from_json(payload, "answer string, citations array<string>")
    keys = F.array_sort(F.json_object_keys(payload))
    reason = F.coalesce(
        F.when(keys.isNull() | (keys != F.array(F.lit("answer"), F.lit("citations"))), "keys"), F.when(held["answer"].isNull() | held["citations"].isNull(), "types"),
        F.when(F.size(F.array_except(held["citations"], sources)) > 0, "unknown citation"),
    )
    return F.struct(held["answer"].alias("answer"), held["citations"].alias("citations"), reason.alias("reason"))


def outcome(code: Column, started: Column) -> Column:
    """What to do after an answer of this code: try again only where nothing had come yet."""
    return F.when(code.isin(RETRY_CODES) & ~started, "retry").when(code >= 400, "fail").otherwise("done")


def merged(a: Column, b: Column) -> Column:
    """Both maps in one; the second's values where both have a key."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))


def listed(literal: Column) -> Column:
    """An array written as a Python list of strings."""
    return F.from_json(F.replace(literal, F.lit("'"), F.lit('"')), "array<string>")


def aligned(ids: Column, scores: Column) -> Column:
    """(id, score) pairs of two arrays; arrays of different sizes raise when they are read."""
    return F.when(F.size(ids) == F.size(scores), F.zip_with(ids, scores, lambda i, s: F.struct(i.alias("id"), s.alias("score")))).otherwise(F.raise_error(F.lit("arrays of different sizes")).cast("array<struct<id:string,score:double>>"))
