"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts where neither neighbour is an ASCII letter or digit. One strict term rejects a url; soft terms reject it
together, when at least `soft_terms` distinct ones are there and their weights sum up to `soft_weight` or more.
One pass over the rows, no shuffle; only the vocabulary is sent to the executors.

Defined cases. Null url, or one without `://`: host and path are empty, no rule fits; the vocabulary still reads the whole
url (a null one holds no term, so it is allowed). Empty table: no rows. Repeated rows and ids: each row is judged by itself.
Null page_id: kept. Equal terms in both lists: strict wins. Other columns are never read.
"""

from __future__ import annotations

import os

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: host/path rules with their verdicts.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _terms() -> tuple[list[str], dict[str, float]]:
    """Terms of which one is enough, and terms with weights that only reject together, of the file beside this one."""
    strict, soft = [], {}
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "url_terms.txt"), encoding="utf-8") as f:
        for kind, term in (line.split() for line in f if not line.startswith("#")):
            if kind == "strict":
                strict.append(term)
            else:
                soft[term] = float(kind)
    return strict, soft


STRICT, SOFT = _terms()

SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_terms int, soft_terms int, soft_weight double"
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SOLID = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path of a url."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:end].translate(_TO_LOWER), path[:stop]


def compile_rules(rules: dict[str, str]) -> dict[str, list[tuple[str, str, str]]]:
    """Rules by their host, longest rule first."""
    by: dict[str, list] = {}
    for rule, verdict in sorted(rules.items(), key=lambda x: (-len(x[0]), x[0])):
        host, _, path = rule.partition("/")
        by.setdefault(host, []).append((rule, "/" + path, verdict))
    return by


def rule_of(host: str, path: str, by: dict) -> tuple[str | None, str | None]:
    """The longest rule whose host is the host or a parent domain of it, and whose path begins the path."""
    best: tuple[str | None, str | None] = (None, None)
    while host:
        for rule, start, verdict in by.get(host, ()):
            if path.startswith(start):
                if best[0] is None or (-len(rule), rule) < (-len(best[0]), best[0]):
                    best = (rule, verdict)
                break
        host = host.partition(".")[2]
    return best


def automaton(strict: list[str], soft: dict[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in soft.items():
        found.add_word(term, (term, weight))
    for term in strict:
        found.add_word(term, (term, None))
    found.make_automaton()
    return found


def terms(url: str, found: ahocorasick.Automaton) -> tuple[int, int, float]:
    """Distinct strict terms, distinct soft terms, and the soft terms' weight."""
    low, strict, soft = url.translate(_TO_LOWER), set(), {}
    for end, (term, weight) in found.iter(low):
        start = end + 1 - len(term)
        if (start and low[start - 1] in _SOLID) or (end + 1 < len(low) and low[end + 1] in _SOLID):
            continue
        if weight is None:
            strict.add(term)
        else:
            soft[term] = weight
    return len(strict), len(soft), sum(soft.values())


def filter_urls(pages: DataFrame, *, rules: dict[str, str] | None = None, strict: list[str] | None = None, soft: dict[str, float] | None = None, soft_terms: int = 2, soft_weight: float = 1.5) -> DataFrame:
    """page_id, host, path, the rule that fits, the verdict (allow or block) and the counts of terms, for every row."""
    rules, strict, soft = RULES if rules is None else rules, STRICT if strict is None else strict, SOFT if soft is None else soft

    def run(batches):
        by, found = compile_rules(rules), automaton(strict, soft) if strict or soft else None
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = split(url)
                rule, verdict = rule_of(host, path, by)
                a, b, w = terms(url, found) if url and found else (0, 0, 0.0)
                rows.append((host, path, rule, verdict or ("block" if a or (b >= soft_terms and w >= soft_weight) else "allow"), a, b, w))
            kinds = [pa.string()] * 4 + [pa.int32(), pa.int32(), pa.float64()]
            columns = [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return pages.select("page_id", "url").mapInArrow(run, SCHEMA)


def oracle(rules: dict[str, str] = RULES, strict: list[str] = STRICT, soft: dict[str, float] = SOFT, soft_terms: int = 2, soft_weight: float = 1.5) -> str:
    """The same verdicts in SQL, with one regular expression for each term."""
    hit = lambda t: f"(CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN 1 ELSE 0 END)"
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    longest = sorted(rules, key=lambda r: (-len(r), r))
    return f"""
    WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
    b AS (SELECT page_id, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
          CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM a),
    c AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
    d AS (SELECT *, CASE {' '.join(f"WHEN {fits(r)} THEN '{r}'" for r in longest)} END AS rule,
          {' + '.join(hit(t) for t in strict)} AS strict_terms,
          {' + '.join(hit(t) for t in soft)} AS soft_terms,
          CAST({' + '.join(f'{w} * {hit(t)}' for t, w in soft.items())} AS DOUBLE) AS soft_weight FROM c)
    SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{rules[r]}'" for r in longest)}
        WHEN strict_terms > 0 OR (soft_terms >= {soft_terms} AND soft_weight >= {soft_weight}) THEN 'block' ELSE 'allow' END AS verdict,
        CAST(strict_terms AS INTEGER) AS strict_terms, CAST(soft_terms AS INTEGER) AS soft_terms, soft_weight FROM d"""
