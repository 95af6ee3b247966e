"""Quality rules as a short-circuit cascade.

Each rule has a price and a rejection rate, both measured on a sample; rules then run in the order of rejections per
second, each only on the rows that earlier rules let pass. The verdict does not depend on the order.

Defined results: a null text counts as empty; an empty text has no words and fails ``few_words``; a very long text counts whole, in one task; equal rows get
equal verdicts; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TextBlock, Words, text_blocks, text_of, windows5

SYMBOLS = b"#*$%&|<>"


class Features:
    """Counts over a block's rows, each made when first asked for. ``rows`` are indexes into the block."""

    def __init__(self, block: TextBlock):
        self.block, self._words, self._made = block, None, {}

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = Words(self.block)
        return self._words

    def _bytes_in(self, name: str, mask: Callable[[], np.ndarray], rows: np.ndarray) -> np.ndarray:
        if name not in self._made:
            total = np.zeros(len(self.block.data) + 1, np.int64)
            np.cumsum(mask(), out=total[1:])
            self._made[name] = np.diff(total[self.block.offsets])
        return self._made[name][rows]

    def n_words(self, rows: np.ndarray) -> np.ndarray:
        return np.diff(self.words.row_at)[rows]

    def word_chars(self, rows: np.ndarray) -> np.ndarray:
        return self._bytes_in("word_chars", lambda: self.words.solid & ((self.block.data & 0xC0) != 0x80), rows)

    def n_symbols(self, rows: np.ndarray) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(SYMBOLS)] = True
        return self._bytes_in("n_symbols", lambda: table[self.block.data], rows)

    def n_upper(self, rows: np.ndarray) -> np.ndarray:
        return self._bytes_in("n_upper", lambda: (self.block.data >= 65) & (self.block.data <= 90), rows)

    def n_lower(self, rows: np.ndarray) -> np.ndarray:
        return self._bytes_in("n_lower", lambda: (self.block.data >= 97) & (self.block.data <= 122), rows)

    def _lines(self, rows: np.ndarray) -> np.ndarray:
        if "lines" not in self._made:
            self._made["lines"] = np.full((self.block.rows, 2), -1, np.int64)
        made = self._made["lines"]
        for i in rows[made[rows, 0] < 0]:
            lines = [x for x in self.block.raw(i).split(b"\n") if x.strip()]
            made[i] = len(lines), len(lines) - len(set(lines))
        return made[rows]

    def n_lines(self, rows: np.ndarray) -> np.ndarray:
        return self._lines(rows)[:, 0]

    def n_dup_lines(self, rows: np.ndarray) -> np.ndarray:
        return self._lines(rows)[:, 1]

    def n_repeat_words(self, rows: np.ndarray) -> np.ndarray:
        if "hash" not in self._made:
            self._made["hash"] = windows5(self.words.hashes())
            self._made["n_repeat_words"] = np.full(self.block.rows, -1, np.int64)
        made = self._made["n_repeat_words"]
        for i in rows[made[rows] < 0]:
            a, b = self.words.row_at[i], self.words.row_at[i + 1] - 4
            made[i] = repeated_words(self._made["hash"][a:b]) if b - a > 1 else 0
        return made[rows]


def repeated_words(windows: np.ndarray) -> int:
    """Words that lie in a window found twice or more."""
    order = np.argsort(windows, kind="stable")
    w = windows[order]
    same = w[1:] == w[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[1:] = same
    twice[:-1] |= same
    edge = np.zeros(len(w) + 5, np.int64)
    at = order[twice]
    edge[at] += 1
    edge[at + 5] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


@dataclass(frozen=True)
class Rule:
    """``rejects(features, rows)`` is true where a row fails."""

    name: str
    rejects: Callable[[Features, np.ndarray], np.ndarray]


def _few_words(f, r):
    return f.n_words(r) < 10


def _repetition(f, r):
    return 100 * f.n_repeat_words(r) > 20 * f.n_words(r)


def _symbols(f, r):
    return 10 * f.n_symbols(r) > f.n_words(r)


def _dup_lines(f, r):
    return 100 * f.n_dup_lines(r) > 50 * f.n_lines(r)


def _word_length(f, r):
    n, c = f.n_words(r), f.word_chars(r)
    return (c < 2 * n) | (c > 20 * n)


def _shouting(f, r):
    return f.n_upper(r) > f.n_lower(r)


BASE_RULES = (Rule("few_words", _few_words), Rule("repetition", _repetition))
RULES = (Rule("symbols", _symbols), Rule("dup_lines", _dup_lines), Rule("word_length", _word_length), Rule("shouting", _shouting))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(f: Features, rows: np.ndarray, rules: Iterable[Rule]) -> np.ndarray:
    """The rows that pass all rules; each rule sees what the earlier ones left."""
    for rule in rules:
        if not len(rows):
            break
        rows = rows[~rule.rejects(f, rows)]
    return rows


def measured_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, text: str = "text") -> tuple[Rule, ...]:
    """``rules`` by falling rejections per second over about ``sample_rows`` rows; the sample decides the order only."""
    total = docs.count()

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                rows = np.arange(block.rows)
                seen += block.rows
                for k, rule in enumerate(rules):
                    f = Features(block)
                    f.words  # every rule's caller has the words
                    base = time.process_time()
                    rejected[k] += int(rule.rejects(f, rows).sum())
                    spent[k] += time.process_time() - base
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "seconds": spent, "rejected": rejected, "seen": [seen] * len(rules)})

    if not total:
        return rules
    sample = docs.select(text).sample(min(1.0, sample_rows / total), seed=7)
    found = sample.mapInArrow(profile, "rule long, seconds double, rejected long, seen long").groupBy("rule").sum("seconds", "rejected", "seen").collect()
    rate = {r[0]: (r[2] + 1) / (r[3] + 1) / (r[1] / (r[3] + 1) + 1e-9) for r in found}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: -rate.get(k, 0.0)))


def verdicts(column: pa.Array, base: tuple[Rule, ...], rules: tuple[Rule, ...], counts: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The asked counts of every row, ``base_failed`` and ``kept``."""
    n = len(column)
    out = {c: np.zeros(n, np.int64) for c in counts} | {"base_failed": np.ones(n, bool), "kept": np.zeros(n, bool)}
    for block in text_blocks(column):
        f, rows = Features(block), np.arange(block.rows)
        for c in counts:
            out[c][block.first : block.first + block.rows] = getattr(f, c)(rows)
        passed = cascade(f, rows, base)
        out["base_failed"][block.first + passed] = False
        out["kept"][block.first + cascade(f, passed, rules)] = True
    return out


def quality_cascade(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES, counts: tuple[str, ...] = COUNTS, sample_rows: int = 2000) -> DataFrame:
    """Per row: doc_id, ``counts`` (of every row), base_failed (a base rule rejects it), kept (no rule does)."""
    order = measured_order(docs, rules, sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v) for k, v in verdicts(batch.column(1), base, order, counts).items()})

    return text_of(docs).mapInArrow(score, "doc_id long, " + "".join(f"{c} long, " for c in counts) + "base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    order, at = measured_order(docs, rules, sample_rows), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(batch.column(at), base, order, ())["kept"]))

    return docs.mapInArrow(keep, docs.schema)
