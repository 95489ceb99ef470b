"""Repetition rules for text quality.

Words are runs without ASCII white space. A rolling hash, whose prefixes are computed once for a text,
gives the hash of each window of n words for every n from two of its prefixes; windows that occur more
than once in a text are marked (equal hashes are compared word by word, so that a collision can't
count). The characters that such windows and repeated lines cover, as shares of the words' characters,
decide with the base rules whether a text is kept.

Null and empty texts have no words and fail the base rule. Every row is judged for itself, so repeated
rows are judged alike; very long texts are read whole. An empty table gives an empty result. Only
doc_id and text are read, whatever other columns are named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
#: Odd multiplier of the rolling hash, modulo 2**64.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """What a kept text may reach. Shares are of the characters in words."""

    least_words: int = 20
    repeat_word_percent: int = 30
    #: n → largest share of characters in n-word windows found twice or more
    windows: dict[int, float] = field(default_factory=lambda: {3: 0.6, 5: 0.5, 8: 0.4, 16: 0.35})
    line_share: float = 0.35


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base to the powers 0 to n, modulo 2**64."""
    out = np.full(n + 1, base)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


class Rolling:
    """Hashes of all windows of a sequence of ids. A prefix's hash is the sum of its scrambled ids times
    the powers of the multiplier, so that a window's is the difference of two prefixes', brought to the
    first power by the multiplier's inverse."""

    def __init__(self, ids: np.ndarray):
        scrambled = (ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        scrambled ^= scrambled >> np.uint64(29)
        self.prefixes = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled * powers(len(ids), MULTIPLIER)[1:], dtype=np.uint64)))
        self.back = powers(len(ids), INVERSE)

    def windows(self, n: int) -> np.ndarray:
        return (self.prefixes[n:] - self.prefixes[: len(self.prefixes) - n]) * self.back[: len(self.prefixes) - n]


def repeated(ids: np.ndarray, n: int, rolling: Rolling | None = None) -> np.ndarray:
    """Marks the words in n-word windows that occur at least twice."""
    marks = np.zeros(len(ids), bool)
    if len(ids) <= n:
        return marks
    hashes = (rolling or Rolling(ids)).windows(n)
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    if not len(same):
        return marks
    a, b = order[same], order[same + 1]
    equal = np.ones(len(a), bool)
    for k in range(n):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():  # a collision: group the windows themselves
        _, back, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, n), axis=0, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[back.ravel()] > 1)
    else:
        starts = np.unique(np.concatenate((a, b)))
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(text: str, limits: Limits) -> tuple[int, int, int, int, int, bool, bool, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, worst: the
    largest ratio of a share to its limit."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    n_dup_lines, dup_line_chars = 0, 0
    if "\n" in text:
        lines: set[str] = set()
        for line in text.split("\n"):
            if line in lines:
                if bare := line.encode("utf-8", "surrogatepass").split():
                    n_dup_lines += 1
                    dup_line_chars += len(b"".join(bare).decode("utf-8", "surrogatepass"))
            else:
                lines.add(line)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    worst, n_repeat, lengths = dup_line_chars / chars / limits.line_share if chars else 0.0, 0, None
    rolling = Rolling(ids)
    for n in sorted({WINDOW, *limits.windows}):
        marks = repeated(ids, n, rolling)
        if not marks.any():
            break  # nor do longer windows occur twice
        if lengths is None:
            lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        if n == WINDOW:
            n_repeat = int(marks.sum())
        if n in limits.windows:
            worst = max(worst, float(lengths[marks].sum()) / chars / limits.windows[n])
    failed = len(words) < limits.least_words or 100 * n_repeat > limits.repeat_word_percent * len(words)
    return len(words), chars, len(SYMBOLS.findall(text)), n_dup_lines, n_repeat, failed, not failed and worst <= 1, worst


def rate_documents(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The measures of each row of documents (doc_id, text)."""
    kinds = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("worst", pa.float64())]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(text or "", limits) for text in batch["text"].to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *(name for name, _ in kinds)])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, worst double"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, schema)
