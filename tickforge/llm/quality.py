"""Quality rules as a short-circuit cascade of native expressions.

A rule is a condition that rejects a document.  On a sample spread over the whole
table, one pass finds which rules reject which documents together, and each
rule's cost is the time it adds to an empty pass.  The cascade is built greedily:
the next rule is the one with most rejections per cost among the documents that
the rules before it let pass.  The rules run as one ``CASE WHEN`` whose later
conditions are only evaluated for documents that passed the earlier ones.  The
order decides how fast a verdict is found and which rule is named, never the
verdict.

Words are ``[^\\x20\\x09-\\x0D]+`` over the whole text.  Null and empty texts
have no words, hence too few, and are rejected.  Null ids pass through; extra
columns are kept, and the added columns win over equally named ones.  The sample
has about ``SAMPLE_ROWS`` documents and only orders the rules.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents on which rules are timed, about; more of them change the order's precision only.
SAMPLE_ROWS = 512
#: Each time is the least of so many.
TRIES = 3
SPACES = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, _SPACE_CHARS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACE_CHARS, "")) > 0)


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _fold(hashes: Column, by: int) -> Column:
    """Hash of every element with the one ``by`` places on; the last ``by`` have none."""
    return let(hashes, lambda h: F.when(F.size(h) > by, F.zip_with(F.slice(h, F.lit(1), F.size(h) - by), F.slice(h, F.lit(1 + by), F.size(h) - by), lambda a, b: F.xxhash64(a, b))).otherwise(F.slice(h, 1, 0)))


def _covered(hashes: Column) -> Column:
    """Words covered by windows found twice: sort (hash, place), keep equal neighbours, add up the gaps between places."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def equal(s: Column, k: Column, x: Column) -> Column:
        return F.coalesce(F.get(s, k).getField("h") == x.getField("h"), F.lit(False))

    twice = let(ranked, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: equal(s, i - 1, x) | equal(s, i + 1, x)), lambda x: x.getField("i"))))
    gaps = let(twice, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def n_repeat_words(text: Column) -> Column:
    windows = F.transform(words(text), lambda w: F.xxhash64(w))
    for by in (1, 2, 4):
        windows = _fold(windows, by)
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))).cast("long")


METRICS: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines,
    "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
}

#: Name, metrics it reads, condition that rejects.
Rule = tuple[str, tuple[str, ...], Callable[..., Column]]
BASE: list[Rule] = [
    ("few_words", ("n_words",), lambda n: n < 20),
    ("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n),
]
RULES: list[Rule] = [
    *BASE,
    ("symbols", ("n_words", "n_symbols"), lambda n, s: 100 * s > 20 * n),
    ("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 20 * n)),
    ("duplicate_lines", ("n_lines", "n_dup_lines"), lambda n, d: (n >= 8) & (100 * d > 60 * n)),
]


def rejects(rule: Rule, text: Column | None = None) -> Column:
    """The rule's condition on metric columns, or computed from the text."""
    _, reads, condition = rule
    return F.coalesce(condition(*(F.col(k) if text is None else METRICS[k](text) for k in reads)), F.lit(True))


def greedy(costs: list[float], patterns: dict[int, int]) -> list[int]:
    """Order of rules: each time most rejections per cost among what is left; ``patterns`` counts documents by the bits of the rules that reject them."""
    left, order = dict(patterns), []
    while len(order) < len(costs):
        gain = {k: sum(n for bits, n in left.items() if bits >> k & 1) for k in range(len(costs)) if k not in order}
        best = max(gain, key=lambda k: (gain[k] / costs[k], -costs[k], -k))
        order.append(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return order


def order_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """Rules in the order of the cascade, with cost (seconds on the sample) and selectivity (share of the whole sample)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(text.alias("text"))
    rows = whole.count()  # without columns: the row counts of the files
    sample = whole.sample(fraction=min(1.0, SAMPLE_ROWS / max(1, rows)), seed=1).persist()
    try:
        n = max(1, sample.count())

        def seconds(condition: Column) -> float:
            began = time.perf_counter()
            sample.agg(F.count_if(condition)).collect()
            return time.perf_counter() - began

        conditions = [rejects(rule, F.col("text")) for rule in rules]
        empty = min(seconds(F.length("text") < 0) for _ in range(TRIES))
        costs = [max(min(seconds(c) for _ in range(TRIES)) - empty, 1e-3) for c in conditions]
        bits = sum((F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))
        patterns = {r["bits"]: r["count"] for r in sample.groupBy(bits.alias("bits")).count().collect()}  # at most 2 ** rules rows
        share = [sum(c for b, c in patterns.items() if b >> k & 1) / n for k in range(len(rules))]
        return [(rules[k], costs[k], share[k]) for k in greedy(costs, patterns)]
    finally:
        sample.unpersist()


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", metrics: bool = False) -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by`` (the rule, null if kept); with ``metrics`` also all metric columns.

    Without ``metrics``, what a rule reads is computed where the rule runs, so
    later rules cost nothing for rejected documents.  With them every metric is
    asked for, and the rules read the columns.
    """
    rules = RULES if rules is None else rules
    ordered = [rule for rule, _, _ in order_rules(docs, rules, text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    if metrics:
        docs = docs.withColumns({k: f(text) for k, f in METRICS.items()})
    chain = F.lit(None).cast("string")
    for rule in reversed(ordered):
        chain = F.when(rejects(rule, None if metrics else text), F.lit(rule[0])).otherwise(chain)
    return docs.withColumn("rejected_by", chain).withColumn("kept", F.col("rejected_by").isNull())


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = cascade(docs, metrics=True)
    failed = rejects(BASE[0]) | rejects(BASE[1])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


#: Documents with the metrics and the verdict, for this query and the pipeline's reference version.
METRIC_SQL = r"""
w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS s FROM w WHERE len(w) >= 8),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
gap AS (SELECT doc_id, least(8, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 8)) AS g FROM twice),
rep AS (SELECT doc_id, sum(g) AS r FROM gap GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_lines >= 8 AND 100 * n_dup_lines > 60 * n_lines) AS more_failed FROM m)
"""

ORACLE = {
    "op3_quality_rules": f"WITH {METRIC_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT more_failed AS kept FROM v"
}
