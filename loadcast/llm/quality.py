"""Quality rules as a short-circuit cascade.

Every rule looks at one text and may reject it. On a sample each rule's cost and rejections are measured;
the rule that rejects most per second goes first, then the one that rejects most of what is left, and so
on. A text meets the rules in that order until one rejects it. The order changes the work, never the verdict.
What rules share (words, repeats) is computed once for a text, when it is first needed.

Defined cases: a null text has no words, like an empty one, and is rejected by ``too_short``; repeated
rows are judged each; an empty table gives an empty one; other columns are kept by ``keep_good`` and ignored
by ``judge``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
#: Rows on which costs and rejections are estimated.
SAMPLE_ROWS = 1000
VERDICTS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, base_failed boolean, kept boolean")


class Text:
    """What the rules look at; each part is computed when first asked for."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()                  # bytes: the space and the controls 9 to 13

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) - sum(map(joined.count, _CONTINUATION)) if not joined.isascii() else len(joined)

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def n_marks(self) -> int:
        return len(self.data) - len(self.data.translate(None, MARKS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_capitals(self) -> int:
        return len(self.data) - len(self.data.translate(None, _CAPITALS))

    @cached_property
    def n_letters(self) -> int:
        return len(self.data) - len(self.data.translate(None, _LETTERS))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of three words that stand twice or more."""
        if self.n_words < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64)
        pairs = ids[:-1] * len(seen) + ids[1:]
        if len(seen) > 2_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(seen) + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = np.diff(windows[order]) == 0
        often = np.zeros(len(windows), bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        inside = np.zeros(len(ids), bool)
        for k in range(3):
            inside[k:k + len(often)] |= often
        return int(inside.sum())


_CONTINUATION = [bytes([b]) for b in range(0x80, 0xC0)]
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))

Rule = Callable[[Text], bool]
#: The first two are the base rules.
RULES: dict[str, Rule] = {
    "too_short": lambda t: t.n_words < 50,
    "repetitive": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
    "symbols": lambda t: 100 * t.n_symbols > 30 * t.n_words,
    "repeated_lines": lambda t: 100 * t.n_dup_lines > 50 * len(t.lines),
    "shouting": lambda t: 100 * t.n_capitals > 60 * t.n_letters,
    "exclaiming": lambda t: 100 * t.n_marks > 50 * t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
}
BASE = ("too_short", "repetitive")


def order_rules(cost: np.ndarray, rejected: np.ndarray) -> list[int]:
    """Rules by rejections per cost, each measured on what the rules before it leave.

    ``cost`` has seconds a rule, ``rejected`` a row for each text and a column for each rule.
    """
    left, order = np.ones(len(rejected), bool), []
    rest = list(range(len(cost)))
    while rest:
        gain = [rejected[left, k].sum() / max(cost[k], 1e-9) for k in rest]
        best = rest.pop(int(np.argmax(gain)))
        order.append(best)
        left &= ~rejected[:, best]
    return order


def plan_cascade(docs: DataFrame, rules: dict[str, Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The names of the rules in the order to run them, from at most ``sample_rows`` rows."""
    rules = rules or RULES
    names = list(rules)

    def measure(batches):
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                spent, rejects = [], []
                for name in names:
                    fresh, start = Text(text or b""), time.perf_counter()
                    rejects.append(bool(rules[name](fresh)))
                    spent.append(time.perf_counter() - start)
                yield pa.RecordBatch.from_arrays([pa.array([spent], pa.list_(pa.float64())),
                                                  pa.array([rejects], pa.list_(pa.bool_()))],
                                                 names=["cost", "rejected"])

    seen = docs.select("text").limit(sample_rows).mapInArrow(
        measure, "cost array<double>, rejected array<boolean>").collect()
    if not seen:
        return names
    order = order_rules(np.array([r.cost for r in seen]).mean(axis=0), np.array([r.rejected for r in seen], bool))
    return [names[k] for k in order]


def passes(text: Text, rules: dict[str, Rule], order: list[str]) -> bool:
    return not any(rules[name](text) for name in order)


def judge(docs: DataFrame, rules: dict[str, Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, the counts of the base rules, ``base_failed`` and ``kept`` of every row."""
    rules = rules or RULES
    order = plan_cascade(docs, rules, sample_rows)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(),
                                    batch.column("text").cast(pa.binary()).to_pylist()):
                t = Text(data or b"")
                kept = passes(t, rules, order)
                failed = any(RULES[name](t) for name in BASE)
                rows.append((doc_id, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words,
                             failed, kept and not failed))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
                names=[c.split()[0] for c in VERDICTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, VERDICTS)


def keep_good(docs: DataFrame, rules: dict[str, Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, unchanged; a rejected text meets no further rule."""
    rules = rules or RULES
    order = plan_cascade(docs, rules, sample_rows)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([passes(Text(t or b""), rules, order) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
