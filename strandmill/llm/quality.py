"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a bounded sample; rules then run by
rejections per cost, and a text meets no rule after the first that rejects it. The order
changes the time taken, never the verdict. What several rules need of a text is computed once.

A null or empty text has no words and fails the rule on length. Repeated rows are judged
each on its own; texts of any length are read whole."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._common import prepare, raw, small

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]").search


class Text:
    """What rules ask of a text, each computed on first use."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        solid = self.data.translate(None, SPACE)
        return len(solid) - int(np.count_nonzero((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in self.words], np.int64)
        two = ids[:-1] * len(known) + ids[1:]
        if len(known) >= 1 << 20:
            two = np.unique(two, return_inverse=True)[1]
        order = np.argsort(three := two[:-1] * len(known) + ids[2:], kind="stable")
        same = three[order][1:] == three[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(n + 2, bool)
        twice[order[1:][same] + 2] = True
        twice[order[:-1][same] + 2] = True
        return int(np.count_nonzero(twice[2:] | twice[1:-1] | twice[:-2]))

    @cached_property
    def n_wordlike(self) -> int:
        """Words with a letter: an ASCII one or a byte beyond ASCII."""
        return sum(map(bool, map(_LETTER, self.words)))


Rule = Callable[[Text], bool]

#: Every document that one of these rejects fails the base rules.
BASE: dict[str, Rule] = {
    "short": lambda t: t.n_words < 50,
    "repeats": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
}
#: The further rules of the cascade.
FURTHER: dict[str, Rule] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    # a short text may well repeat a line or two, such as a license
    "repeated_lines": lambda t: t.n_dup_lines > 3 and 10 * t.n_dup_lines > 3 * len(t.lines),
    "few_wordlike": lambda t: 10 * t.n_wordlike < 7 * t.n_words,
}


def ranked(sample: list[bytes], rules: dict[str, Rule]) -> list[str]:
    """The rules' names by rejections per second on a sample, the best first."""
    worth = {}
    for name, rule in rules.items():
        texts = [Text(t) for t in sample]
        began = time.perf_counter()
        rejected = sum(map(rule, texts))
        worth[name] = rejected / max(1e-9, time.perf_counter() - began)
    return sorted(rules, key=lambda n: (-worth[n], n))


def cascade_order(docs: DataFrame, rules: dict[str, Rule], text_col: str = "text", sample: int = 500, seed: int = 7) -> list[str]:
    """The order in which to run ``rules`` over ``docs``, from a seeded sample of at most ``sample`` texts.

    Of a text in the sample no more than a mebibyte is timed; the rules themselves judge whole texts."""
    n = docs.count()
    rows = docs.select(raw(F.col(text_col))).sample(fraction=min(1.0, 1.2 * sample / max(1, n)), seed=seed).limit(sample).collect()
    return ranked([bytes(r[0][: 1 << 20]) for r in rows], rules)


def judge(docs: DataFrame, text_col: str = "text", sample: int = 500) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``kept`` and ``rejected_by`` in place of the text and of columns of these names.

    ``rejected_by`` is the rule that rejected first in the order at hand. The order follows times
    measured on the sample, so that it may differ between runs; the other columns don't."""
    return _judged(docs, text_col, sample)


def good_only(docs: DataFrame, text_col: str = "text", sample: int = 500) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, unchanged."""
    own = "__kept"
    while own in docs.columns:
        own += "_"
    return _judged(docs, text_col, sample, own).where(F.col(own)).select(*(F.col(f"`{c}`") for c in docs.columns))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(docs: DataFrame, text_col: str, sample: int, only: str | None = None) -> DataFrame:
    """``only`` names the verdict's column where the rows are wanted as they are."""
    prepare(docs.sparkSession)
    rules = BASE | FURTHER
    order = cascade_order(docs, rules, text_col, sample)
    new = (only,) if only else (*_COUNTS, "base_failed", "kept", "rejected_by")
    rest = [c for c in docs.columns if (only or c != text_col) and c not in new]
    kinds = {"base_failed": "boolean", "kept": "boolean", only: "boolean", "rejected_by": "string"}
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} {kinds.get(c, 'long')}" for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            cols: dict[str, list] = {c: [] for c in new}
            for data in b.column(len(rest)):
                t = Text(data.as_py())
                by = next((n for n in order if rules[n](t)), None)
                cols[only or "kept"].append(by is None)
                if not only:
                    cols["rejected_by"].append(by)
                    cols["base_failed"].append(any(r(t) for r in BASE.values()))
                    for c in _COUNTS:
                        cols[c].append(getattr(t, c))
            made = [pa.array(cols[c], {"boolean": pa.bool_(), "string": pa.string()}.get(kinds.get(c), pa.int64())) for c in new]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), *made], names=[*rest, *new])

    return docs.select(*(F.col(f"`{c}`") for c in rest), raw(F.col(f"`{text_col}`")).alias("__raw")).mapInArrow(run, schema)
