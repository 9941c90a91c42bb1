"""Quality rules: a decision list learned from labelled documents.

Statistics of whole texts are taken in a pandas function, as repeated windows need each document's own order of words;
the learned list and its verdicts are Spark conditional expressions over them. Sequential covering grows one rule at a
time: a conjunction of thresholds is extended while that raises its precision for the low class on a growing set, and
pruned from its end on a held-back set; covered rows leave, and the list ends when no rule is precise enough.

Nulls and texts without words have statistics of 0. Long texts are measured whole, one at a time. Without labelled rows of
both classes the list is empty and keeps all that the base rules keep. Repeated rows get equal verdicts, and a labelled id that
repeats counts once; an empty table gives an empty result. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm._common import fresh, labelled_sample

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_digits", "n_marks", "n_distinct", "n_lines")


def repeated_words(words: list) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    base = len(number)
    pair = ids[:-1] * base + ids[1:]
    if base > 1 << 20:  # else three numbers fit into 63 bits
        _, pair = np.unique(pair, return_inverse=True)
    _, which, count = np.unique(pair[:-1] * base + ids[2:], return_inverse=True, return_counts=True)
    hit = count[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of one text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # on bytes this splits on exactly the characters of SPACE
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    codes = np.frombuffer(data, np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        int(((codes > 64) & (codes < 91)).sum()),
        sum(map(text.count, "0123456789")),
        sum(map(text.count, "!?")),
        len(set(words)),
        len(lines),
    )


def text_stats(text: Column) -> Column:
    """A struct of COUNTS and MORE."""

    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=[*COUNTS, *MORE], dtype="int64")

    return F.pandas_udf(stats, ", ".join(f"{n} long" for n in (*COUNTS, *MORE)))(text)


def features(stats: Column) -> dict[str, Column]:
    """What the rules may test: shares of the counts."""
    words = F.greatest(stats["n_words"], F.lit(1))
    chars = F.greatest(stats["word_chars"], F.lit(1))
    of_words = {f"{n}_share": stats[n] / words for n in ("n_symbols", "n_repeat_words", "n_marks", "n_distinct")}
    of_chars = {f"{n}_share": stats[n] / chars for n in ("n_upper", "n_digits")}
    return of_words | of_chars | {
        "n_words": stats["n_words"].cast("double"),
        "chars_per_word": stats["word_chars"] / words,
        "dup_line_share": stats["n_dup_lines"] / F.greatest(stats["n_lines"], F.lit(1)),
    }


def base_failed(stats: Column) -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > F.lit(self.threshold) if self.above else of[self.feature] <= F.lit(self.threshold)


Rule = tuple[Test, ...]


def covered(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (t.holds(data[t.feature]) for t in rule), np.ones(n, bool))


def grow(data: dict[str, np.ndarray], low: np.ndarray, max_tests: int) -> Rule:
    """Adds the test of the largest information gain (FOIL) until the rule covers the low class only."""
    rule: Rule = ()
    inside = np.ones(len(low), bool)
    while len(rule) < max_tests and low[inside].any() and not low[inside].all():
        p0, n0 = low[inside].sum(), inside.sum()
        best, gain = None, 1e-9
        for name in sorted(data):
            values = data[name][inside]
            order = np.argsort(values, kind="stable")
            v, hits = values[order], np.cumsum(low[inside][order])
            at = np.flatnonzero(np.diff(v) > 0)  # cuts between different values
            if not len(at):
                continue
            p, n = hits[at], at + 1
            for above, pos, size in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(pos > 0, pos * (np.log2(pos / size) - np.log2(p0 / n0)), 0)
                i = int(np.argmax(gains))
                if gains[i] > gain:
                    best, gain = Test(name, above, float((v[at[i]] + v[at[i] + 1]) / 2)), gains[i]
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(data[best.feature])
    return rule


def worth(rule: Rule, data: dict[str, np.ndarray], low: np.ndarray) -> float:
    """(p - n) / (p + n) on a held-back set."""
    inside = covered(rule, data, len(low))
    p, n = int(low[inside].sum()), int((~low[inside]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, data: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is worth most on the held-back set."""
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r, data, low), -len(r))) if rule else rule


def learn_list(data: dict[str, np.ndarray], low: np.ndarray, max_rules: int = 12, max_tests: int = 4, precision: float = 0.9, least: int = 8) -> list[Rule]:
    """Ordered rules for the low class. A rule stands if enough rows are covered at the precision on both sets."""
    left = np.arange(len(low))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        growing, back = left[left % 3 != 2], left[left % 3 == 2]
        part = lambda rows: ({k: v[rows] for k, v in data.items()}, low[rows])
        rule = prune(grow(*part(growing), max_tests), *part(back))
        if not rule:
            break
        inside = covered(rule, part(left)[0], len(left))
        held = covered(rule, part(back)[0], len(back))
        if inside.sum() < least or low[left][inside].mean() < precision or not held.any() or low[back][held].mean() < precision:
            break
        rules.append(rule)
        left = left[~inside]
    return rules


def list_column(rules: list[Rule], of: dict[str, Column]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds (from 1), 0 if none does."""
    chain = F.lit(0)
    for k in range(len(rules), 0, -1):
        chain = F.when(reduce(lambda a, b: a & b, (t.column(of) for t in rules[k - 1])), k).otherwise(chain)
    return chain


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 200_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """A list learned from at most max_rows labelled documents of at most max_chars characters (label 0 is the low class)."""
    sample = labelled_sample(docs, labels, labels[label_col], max_rows, max_chars, id_col, text_col)
    stats = sample.select(id_col, "label", text_stats(F.col(text_col)).alias("stats"))
    of = features(F.col("stats"))
    rows = stats.select(id_col, "label", base_failed(F.col("stats")).alias("base_failed"), *(c.alias(n) for n, c in of.items())).toPandas()
    rows = rows[~rows["base_failed"].astype(bool)].sort_values([id_col], kind="stable").sample(frac=1, random_state=7)
    low = (rows["label"] == 0).to_numpy()
    if not low.any() or low.all():
        return []
    return learn_list({n: rows[n].to_numpy(float) for n in of}, low)


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text", stats_name: str = "stats") -> DataFrame:
    """The input's columns and a struct: COUNTS, base_failed, rule (number of the rule that rejects, 0 if none) and kept.

    The struct is the last column: stats_name, with underscores before it where the input has a column of that name.
    """
    stats_name = fresh(docs, stats_name)
    with_stats = docs.withColumn(stats_name, text_stats(docs[text_col]))
    stats = F.col(stats_name)
    rule = list_column(rules, features(stats))
    verdict = F.struct(
        *(stats[n].alias(n) for n in COUNTS),
        base_failed(stats).alias("base_failed"),
        rule.alias("rule"),
        (~base_failed(stats) & (rule == 0)).alias("kept"),
    )
    return with_stats.withColumn(stats_name, verdict)
