"""Quality rules: a decision list learned from text statistics by sequential covering.

Rules are conjunctions of thresholds. Each is grown on two thirds of the labelled rows by FOIL's
gain, pruned on the other third, and kept if it is still precise there; the rows it covers are taken
away and the next rule is grown on the rest. The list becomes one ordered `CASE WHEN` over columns.

Defined results: a null text has no words and the statistics of an empty one; a text of white space
as well; whole texts count, whatever their length; repeated rows each get their own result; an empty
table gives no rows; without labelled rows of both classes the list is empty and only the base
limits decide. Other columns, also of the same names as the statistics, are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import forget, labelled_sample, own_columns, table, text_udf

# Fixed values of the statistics and base limits.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
RUN = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

STATISTICS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_lines bigint, n_upper bigint, n_marks bigint, n_digits bigint, "
    "n_top_word bigint"
)

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS)


def _deleted(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def _repeat_words(words: list[bytes]) -> int:
    """Words covered by runs of three words that stand twice or more in the text."""
    runs = list(zip(words, words[1:], words[2:]))
    seen = Counter(runs)
    if len(seen) == len(runs):
        return 0
    covered, reach = 0, 0
    for i, run in enumerate(runs):
        if seen[run] > 1:
            covered += i + RUN - max(reach, i)
            reach = i + RUN
    return covered


def text_statistics(text: bytes | None) -> tuple[int, ...]:
    """The fields of STATISTICS for one UTF-8 text."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.translate(None, SPACES)]
    spaces = _deleted(text, SPACES)
    chars = len(text.decode("utf-8", "replace")) - spaces
    return (
        len(words),
        chars,
        _deleted(text, SYMBOLS),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        _deleted(text, _UPPER),
        _deleted(text, _MARKS),
        _deleted(text, _DIGITS),
        max(Counter(words).values(), default=0),
    )


def _counter():
    forget()  # nothing of an earlier stage is needed here
    return text_statistics


def statistics(text: Column) -> Column:
    return text_udf(_counter, STATISTICS)(text)


# Name of each feature: numerator and denominator among the statistics.
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "top_word_share": ("n_top_word", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def feature_columns(stats: Column) -> dict[str, Column]:
    """Features as columns; a share of nothing is 0."""
    return {
        name: F.when(stats[low] > 0, stats[up] / stats[low]).otherwise(F.lit(0.0))
        for name, (up, low) in FEATURES.items()
    }


def feature_rows(stats: list[tuple[int, ...]]) -> np.ndarray:
    names = [part.split()[0] for part in STATISTICS.split(", ")]
    at = {name: i for i, name in enumerate(names)}
    table_ = np.array(stats, dtype=float).reshape(-1, len(names))
    return np.column_stack(
        [
            np.divide(
                table_[:, at[up]],
                table_[:, at[low]],
                out=np.zeros(len(table_)),
                where=table_[:, at[low]] > 0,
            )
            for up, low in FEATURES.values()
        ]
    )


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, rows: np.ndarray) -> np.ndarray:
        column = rows[:, self.feature]
        return column >= self.threshold if self.above else column < self.threshold

    def __str__(self) -> str:
        sign = ">=" if self.above else "<"
        return f"{list(FEATURES)[self.feature]} {sign} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, rows: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(rows) for c in rule), np.ones(len(rows), dtype=bool))


@dataclass
class DecisionList:
    """Ordered rules that reject; what none of them covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def keeps(self, rows: np.ndarray) -> np.ndarray:
        return ~reduce(
            np.logical_or, (covers(r, rows) for r in self.rules), np.zeros(len(rows), dtype=bool)
        )

    def column(self, features: dict[str, Column]) -> Column:
        columns = list(features.values())
        verdict = None
        for rule in self.rules:
            tests = [
                columns[c.feature] >= c.threshold
                if c.above
                else columns[c.feature] < c.threshold
                for c in rule
            ]
            test = reduce(Column.__and__, tests)
            verdict = (verdict.when if verdict is not None else F.when)(test, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def _candidates(column: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between neighbouring values, at most about `bins` of them, by quantiles."""
    values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def _grow(rows: np.ndarray, bad: np.ndarray, bins: int, longest: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(rows), dtype=bool)
    while len(rule) < longest and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for f in range(rows.shape[1]):
            column = rows[inside, f]
            for cut in _candidates(column, bins):
                up = column >= cut
                for above, taken in ((True, up), (False, ~up)):
                    p = bad[inside][taken].sum()
                    n = taken.sum() - p
                    if p:
                        got = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if got > gain:
                            best, gain = Condition(f, above, float(cut)), got
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(rows)
    return tuple(rule)


def _prune(rule: Rule, rows: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on the pruning rows."""

    def worth(r: Rule) -> float:
        taken = covers(r, rows)
        p, n = bad[taken].sum(), (~bad[taken]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    starts = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(starts, key=lambda r: (worth(r), -len(r))) if starts else ()


def learn_decision_list(
    rows: np.ndarray,
    bad: np.ndarray,
    precision: float = 0.95,
    min_covered: int = 3,
    longest: int = 4,
    most_rules: int = 24,
    bins: int = 48,
) -> DecisionList:
    """Sequential covering. `precision` is what a rule must reach on the pruning rows, which keeps
    clean texts; `most_rules` and `longest` bound the emitted expression."""
    grow = np.arange(len(rows)) % 3 != 0
    learned = DecisionList()
    left = np.ones(len(rows), dtype=bool)
    while len(learned.rules) < most_rules and bad[left & grow].sum() >= min_covered:
        here, test = left & grow, left & ~grow
        rule = _grow(rows[here], bad[here], bins, longest)
        rule = _prune(rule, rows[test], bad[test])
        if not rule:
            break
        taken = covers(rule, rows)
        hit, out = bad[taken & test].sum(), (~bad[taken & test]).sum()
        if hit < min_covered or hit < precision * (hit + out):
            break
        learned.rules.append(rule)
        left &= ~taken
    return learned


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (
        100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"]
    )


def fit_quality_rules(
    docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000
) -> DecisionList:
    """The list learned from at most `rows_per_class` labelled rows of each class."""
    sample = labelled_sample(docs, labels, "quality", rows_per_class)
    stats = [text_statistics(text) for _, text, _ in sample]
    bad = np.array([label == 0 for *_, label in sample], dtype=bool)
    passed = np.array(
        [s[0] >= MIN_WORDS and 100 * s[4] <= MAX_REPEAT_PERCENT * s[0] for s in stats], dtype=bool
    )
    if not bad[passed].any() or bad[passed].all():
        return DecisionList()
    return learn_decision_list(feature_rows(stats)[passed], bad[passed])


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """All columns of `docs` and `quality`: the statistics, `base_failed` and `kept`. A column named
    `quality` is replaced."""
    judged = docs.withColumn("quality", statistics(F.col(text)))
    stats = F.col("quality")
    failed = base_failed(stats)
    return judged.withColumn(
        "quality",
        stats.withField("base_failed", failed).withField(
            "kept", ~failed & rules.column(feature_columns(stats))
        ),
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judge(docs, rules).select("doc_id", *(f"quality.{name}" for name in names))


@own_columns
def stage_quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the learned list keep, with all their columns."""
    rules = fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).where("quality.kept").drop("quality")
