"""Quality rules: fixed base measures, then a short-circuit cascade of rules.

The cascade estimates, on a bounded sample of the documents, what each rule
costs and what share of the documents still standing it rejects, and runs the
rules in the order of rejection per cost: a document that one rule rejects
costs no later one anything. The verdict is that of all rules together, so it
does not depend on the order found.

Defined results. Null or empty text: no words, all counts 0, base_failed true.
Words are maximal runs without space or the characters 9 to 13. Repeated rows
give repeated results, an empty table an empty table (the order is then the
listed one). Whole texts are measured, however long.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boolean, long, with_text_columns

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


class Measured:
    """A text and what rules ask of it, each computed once when first asked."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes.split() cuts at exactly these six characters

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WHITE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """The \\n-split lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that occur twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        again = np.fromiter((counts[x] > 1 for x in windows), bool, len(windows))
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        data = np.frombuffer(self.text.encode(), np.uint8)
        return int(np.count_nonzero((data - np.uint8(65)) < 26))

    @cached_property
    def n_digits(self) -> int:
        data = np.frombuffer(self.text.encode(), np.uint8)
        return int(np.count_nonzero((data - np.uint8(48)) < 10))

    @cached_property
    def n_distinct_words(self) -> int:
        return len(set(self.words))


@dataclass(frozen=True)
class Rule:
    """A rule rejects where ``rejects`` holds; the limits are whole-number ratios, so that SQL gives the same."""

    name: str
    rejects: Callable[[Measured], bool]


RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule("exclamations", lambda m: 2 * m.text.count("!") > m.n_words),
    Rule("upper_case", lambda m: 10 * m.n_upper > 4 * m.word_chars),
    Rule("digits", lambda m: 2 * m.n_digits > m.word_chars),
    Rule("mean_word", lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 15 * m.n_words),
    Rule("duplicate_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("distinct_words", lambda m: 20 * m.n_distinct_words < m.n_words),
    Rule("ellipses", lambda m: 2 * sum(x.endswith("...") for x in m.lines) > len(m.lines)),
)


def base_failed(m: Measured) -> bool:
    return m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words


def order_rules(sample: list[str | None], rules=RULES, clock=time.perf_counter) -> list[tuple[Rule, float, float]]:
    """Rules in the order to run, with the cost (seconds a document) and the rejected share of those left.

    Greedy: of the rules left, the one that rejects most per cost among the
    sample's documents that no chosen rule rejected. Costs count a fresh text
    each, beyond the base measures, which every document needs anyway.
    """
    left = list(rules)
    cost, verdicts = {}, {}
    measured = [Measured(t) for t in sample]
    standing = [i for i, m in enumerate(measured) if not base_failed(m)]
    for m in measured:  # the base measures are there when the cascade begins
        m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines
    for rule in left:
        fresh = [Measured(measured[i].text) for i in standing]
        for m, i in zip(fresh, standing):
            m.__dict__.update(measured[i].__dict__)
        began = clock()
        found = [rule.rejects(m) for m in fresh]
        cost[rule.name] = max(clock() - began, 1e-9) / max(1, len(standing))
        verdicts[rule.name] = dict(zip(standing, found))
    out = []
    while left:
        share = {r.name: sum(verdicts[r.name][i] for i in standing) / max(1, len(standing)) for r in left}
        best = max(left, key=lambda r: (share[r.name] / cost[r.name], -cost[r.name]))
        out.append((best, cost[best.name], share[best.name]))
        standing = [i for i in standing if not verdicts[best.name][i]]
        left.remove(best)
    return out


FIELDS = [long("n_words"), long("word_chars"), long("n_symbols"), long("n_dup_lines"), long("n_repeat_words"), boolean("base_failed"), boolean("kept")]


def _measure(names: list[str]):
    """Rules go by name, as the functions themselves live on each executor."""

    def make():
        by_name = {r.name: r for r in RULES}
        cascade = [by_name[x].rejects for x in names]

        def work(texts):
            out = [[] for _ in FIELDS]
            for text in texts:
                m = Measured(text)
                failed = base_failed(m)
                row = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, not failed and not any(r(m) for r in cascade))
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return work

    return make


def sample_texts(df: DataFrame, text_col: str, rows: int, seed: int = 7) -> list[str | None]:
    """About ``rows`` whole texts from all over the table, for the estimate of costs only; verdicts never use them."""
    share = min(1.0, 1.2 * rows / max(1, df.count()))
    return [r.t for r in df.select(F.col(text_col).alias("t")).sample(share, seed).limit(rows).collect()]


def with_quality_verdict(df: DataFrame, text_col: str = "text", sample_rows: int = 300, prefix: str = "") -> DataFrame:
    """``df`` with base measures and the verdict of its text."""
    order = [r.name for r, _, _ in order_rules(sample_texts(df, text_col, sample_rows))]
    fields = [T.StructField(prefix + f.name, f.dataType) for f in FIELDS]
    return with_text_columns(df, text_col, fields, _measure(order))


def quality_rules(df: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", sample_rows: int = 300) -> DataFrame:
    """One row per row of ``df``: id, base measures, base_failed and kept."""
    slim = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return with_quality_verdict(slim, "__text", sample_rows).withColumnRenamed("__id", id_col).drop("__text")


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), places AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM base
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM places
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n >= 2) GROUP BY doc_id
), measured AS (
  SELECT b.doc_id, t, ls, ws, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(a.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN again a USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT 10 * n_symbols > 3 * n_words
       AND NOT 2 * len(regexp_extract_all(t, '!')) > n_words
       AND NOT 10 * len(regexp_extract_all(t, '[A-Z]')) > 4 * word_chars
       AND NOT 2 * len(regexp_extract_all(t, '[0-9]')) > word_chars
       AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words)
       AND NOT 2 * n_dup_lines > len(ls)
       AND NOT 20 * len(list_distinct(ws)) < n_words
       AND NOT 2 * len(list_filter(ls, lambda l: ends_with(l, '...'))) > len(ls) AS kept
FROM failed
"""
