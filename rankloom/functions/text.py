"""Text columns: normal forms, tokens, hashes, checks and formats. All are column expressions except Unicode normal forms and case folding,
which Spark lacks: Arrow UDFs supply them, for those rows alone that hold a character they may change."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
WHITE = r"[\s\x1C-\x1F\x85\p{Z}]+"
#: Characters that a form may change; all others it leaves alone.
_NFC = r"[\p{M}\u0340-\u0387\u0900-\u0DFF\u0F00-\u0FFF\u1100-\u11FF\u1F00-\u1FFF\u2000-\u2FFF\uF900-\uFAFF\uFB1D-\uFB4F]|[^\u0000-\uFFFF]"
_NFKC = r"[^\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E]"
_FOLD = r"[^\x00-\x7F\u00C0-\u00DE\u00E0-\u012F\u0131-\u0148\u014A-\u017E]"


@F.pandas_udf(T.StringType())
def _to_nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def _to_nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def _to_folded(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def _where(pattern: str, text: Column, change, otherwise: Column) -> Column:
    """change(text) where the pattern is found; the UDF gets nulls elsewhere. Texts without wide characters aren't searched."""
    wide = F.octet_length(text) > F.length(text)
    return F.coalesce(change(F.when(wide & text.rlike(pattern), text)), otherwise)


def nfc(text: Column) -> Column:
    return _where(_NFC, text, _to_nfc, text)


def nfkc(text: Column) -> Column:
    return _where(_NFKC, text, _to_nfkc, text)


def casefolded(text: Column) -> Column:
    return _where(_FOLD, text, _to_folded, F.lower(text))


def turkish_lower(text: Column) -> Column:
    """Lower case with the dotless and the dotted I kept apart."""
    return F.lower(F.translate(text, "Iİ", "ıi"))


def words(text: Column) -> Column:
    """Runs of letters, numbers and underscores, in order."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def turkish_tokens(text: Column) -> Column:
    return words(turkish_lower(nfc(text)))


def code_tokens(text: Column) -> Column:
    """All words as they are, then all parts of words split at case changes and underscores; both case-folded, repeats kept."""
    parts = F.translate(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "_", " ")
    joined = F.array_join(F.concat(words(text), words(parts)), "\x01")  # a separator that no word holds
    return F.filter(F.split(casefolded(joined), "\x01"), lambda w: w != "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def _unpunctuated(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"\p{P}", " "))


def plain_answer(text: Column, turkish: bool = True) -> Column:
    """Compatibility form, lower case (Turkish in any language, if asked), without punctuation and doubled spaces."""
    whole = nfkc(text)
    return _unpunctuated(turkish_lower(whole) if turkish else F.lower(whole))


def lexical_answer(text: Column, language: Column) -> Column:
    """Compatibility form, case-folded, the Turkish map for Turkish rows only, without punctuation and doubled spaces."""
    whole = nfkc(text)
    return _unpunctuated(casefolded(F.when(language.isin("tr", "turkish", "tr_tr"), F.translate(whole, "Iİ", "ıi")).otherwise(whole)))


def text_key(text: Column) -> Column:
    """Canonical form with white space collapsed: equal keys are the same text."""
    return collapse(nfc(text))


def transcript(text: Column) -> Column:
    return collapse(casefolded(nfkc(text)))


def error_tokens(text: Column, turkish: bool = False) -> Column:
    """Words for word error rates: compatibility form, case-folded, without punctuation."""
    whole = nfkc(text)
    return F.filter(F.split(_unpunctuated(casefolded(F.translate(whole, "Iİ", "ıi") if turkish else whole)), " "), lambda w: w != "")


def content_key(*columns: str) -> Column:
    """sha256 of the columns as JSON, keys in order, nulls kept: equal contents have equal keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def strip_citations(text: Column, known: Column) -> Column:
    """Without bracketed lists, on one line, all of whose parts (between commas or semicolons) are known ids."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\[[^\[\]\n]+\])"), F.lit(1)))
    parts = lambda c: F.transform(F.split(F.substring(c, F.lit(2), F.length(c) - 2), "[,;]"), lambda x: F.trim(x))
    drop = F.filter(found, lambda c: F.forall(parts(c), lambda p: F.array_contains(known, p)))
    return F.aggregate(drop, text, lambda s, c: F.replace(s, c, F.lit("")))


def passage_format(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("none")), F.lit(" | text: "), text)


def question_format(task: str, question: Column) -> Column:
    return F.concat(F.lit(f"task: {task} | query: "), question)


def lexical_input(title: Column, text: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), text))


def source_kind(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("wikipedia.org/")), "wikipedia").otherwise("web")


def chunk_id(source: Column, article: Column, chunk: Column) -> Column:
    return F.concat(source, F.lit(":"), article.cast("string"), F.lit("#"), chunk.cast("string"))


def question_id(source: Column, article: Column, ordinal: Column) -> Column:
    return F.concat(source, F.lit(":"), article.cast("string"), F.lit("#q"), F.lpad(ordinal.cast("string"), 4, "0"))


def safe_label(value: Column) -> Column:
    """An identifier of up to 256 characters: no spaces, no `..`, and a slash only as owner/name."""
    plain = value.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.:#/@+-]{0,255}$") & ~F.contains(value, F.lit(".."))
    return plain & (~F.contains(value, F.lit("/")) | value.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"))


def safe_path(value: Column) -> Column:
    """Relative, without backslashes and parent folders."""
    return ~(value.startswith("/") | F.contains(value, F.lit("\\")) | value.rlike(r"(^|/)\.\.(/|$)")) & (F.length(value) > 0)


def finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "^\ufeff", ""), "\r?\n")


def _head_size(lines: Column) -> Column:
    """How many lines the front matter has, its two rules included; 0 if there is none."""
    stop = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "---")
    return F.when((F.get(lines, 0) == "---") & (stop > 0), stop + 1).otherwise(F.lit(0).cast("long"))


def front_matter(text: Column, key: str) -> Column:
    """A scalar of a Markdown file's front matter, JSON-quoted, quoted or bare; null if it isn't there."""
    lines = _lines(text)
    head = F.slice(lines, 2, F.greatest(_head_size(lines) - 2, F.lit(0)).cast("int"))
    mine = F.filter(head, lambda line: F.startswith(F.ltrim(line), F.lit(f"{key}:")))
    raw = F.trim(F.substring(F.ltrim(F.get(mine, 0)), F.lit(len(key) + 2), F.lit(1 << 30)))
    quoted = F.startswith(raw, F.lit('"')) & F.endswith(raw, F.lit('"')) & (F.length(raw) > 1)
    unescaped = F.when(quoted, F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])
    return F.nullif(F.coalesce(unescaped, F.replace(F.btrim(raw, F.lit("'\"")), F.lit("''"), F.lit("'"))), F.lit(""))


def body(text: Column) -> Column:
    """What stands below the front matter."""
    lines = _lines(text)
    head = _head_size(lines)
    return F.when(head > 0, F.array_join(F.slice(lines, head.cast("int") + 1, F.size(lines)), "\n")).otherwise(F.regexp_replace(text, "^\ufeff", ""))


def table_cells(line: Column) -> Column:
    """Cells of a Markdown table's line: split at unescaped bars, escapes undone, <br> as a line break."""
    held = F.replace(F.trim(line), F.lit("\\|"), F.lit("\x01"))  # escaped bars stand aside while bars are cut at
    cells = F.split(F.btrim(held, F.lit("|")), re.escape("|"))
    plain = lambda c: F.replace(F.trim(c), F.lit("\x01"), F.lit("|"))
    return F.transform(cells, lambda c: F.replace(F.replace(plain(c), F.lit("<br>"), F.lit("\n")), F.lit("<br/>"), F.lit("\n")))
