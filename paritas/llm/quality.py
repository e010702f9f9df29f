"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words are runs of anything but ASCII white space.  The distinct words of a text are
numbered and each number gets its XXH64; hashes of n consecutive words are rolled
together in numpy by doubling (h[2n] = mix(h[n]) + h[n] shifted) and sorted.
Windows that hash alike are compared number by number, so a collision can't make a
repeat, and every window found twice or more marks its words.  The coverage of a
length is the characters of marked words over all characters of words; the same is
measured for repeated lines.

The method's verdict: a document stays if, for each n-gram length, the coverage
by *repeats* (windows seen before in the text) is at most the limit of
``NGRAM_LIMITS``, and repeated lines cover at most ``LINE_LIMIT`` of the characters.

Defined results: null or empty text has no words and fails the base rule; very long
texts are measured whole, in memory of a few dozen bytes a word; repeated rows each
get their own result; null ids are carried; an empty table gives no rows; other
columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paritas.llm.common import arrow_schema, batches_out, small_batches, text_batches

#: Share of word characters that may lie in repeated windows of so many words.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}
#: Share of characters that may lie in lines seen before in the text.
LINE_LIMIT = 0.20
BASE_MIN_WORDS, BASE_REPEAT_PERCENT, BASE_WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double, worst_coverage double"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_CONT = np.zeros(256, np.int64)
_CONT[[b for b in range(256) if not 0x80 <= b < 0xC0]] = 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MULT
    return h ^ (h >> np.uint64(32))


def rolled(hashes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of every window of so many words, by joining windows of powers of two."""
    power = {1: hashes}
    n = 1
    while 2 * n <= max(lengths):
        h = power[n]
        power[2 * n] = _mix(h[:-n]) + h[n:] if len(h) > n else h[:0]
        n *= 2
    out = {}
    for k in lengths:
        have, size, rest = None, 0, k
        for p in sorted(power, reverse=True):
            if p <= rest:
                if have is None:
                    have, size = power[p], p
                else:
                    tail = power[p][size:]
                    have = _mix(have[: len(tail)]) + tail
                    size += p
                rest -= p
        out[k] = have[: max(0, len(hashes) - k + 1)]
    return out


def repeats(h: np.ndarray, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of n word numbers with their hashes: which occur twice or more, and which were seen earlier."""
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            a, b = order[:-1][same], order[1:][same]
            if any((numbers[a + k] != numbers[b + k]).any() for k in range(n)):  # two windows of one hash: sort the windows themselves
                windows = np.lib.stride_tricks.sliding_window_view(numbers, n)
                order = np.lexsort(windows.T[::-1])
                same = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
            later[order[1:][same]] = True
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
    return twice, later


def covered(marks: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside any marked window of n words."""
    if not marks.any():
        return np.zeros(size, bool)
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str) -> tuple:
    """The figures of one text, in the order of SCHEMA without doc_id."""
    from xxhash import xxh64_intdigest

    raw = text.encode()
    words = raw.split()
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS)) if n else 0
    chars_of = np.fromiter(map(len, words), np.int64, n)
    if len(raw) != len(text) and n:
        starts = np.frombuffer(b"".join(words), np.uint8)
        at = np.concatenate(([0], np.cumsum(chars_of)[:-1]))
        chars_of = np.add.reduceat(_CONT[starts], at)
    chars = int(chars_of.sum())

    seen: set[bytes] = set()
    dup_lines = dup_chars = all_chars = 0
    for line in raw.split(b"\n"):
        bare = len(b"".join(line.split()))
        if bare:
            all_chars += bare
            if line in seen:
                dup_lines += 1
                dup_chars += bare
            else:
                seen.add(line)
    line_cover = dup_chars / all_chars if all_chars else 0.0

    repeat_words, worst = 0, 0.0
    if n >= min(*NGRAM_LIMITS, BASE_WINDOW):
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        numbers = np.fromiter(map(number.__getitem__, words), np.int64, n)
        hashes = np.fromiter((xxh64_intdigest(w, 0x5EED) for w in number), np.uint64, len(number))[numbers]
        for k, h in rolled(hashes, sorted({*NGRAM_LIMITS, BASE_WINDOW})).items():
            twice, later = repeats(h, numbers, k)
            if k == BASE_WINDOW:
                repeat_words = int(covered(twice, k, n).sum())
            if k in NGRAM_LIMITS and later.any():
                worst = max(worst, float(chars_of[covered(later, k, n)].sum()) / chars / NGRAM_LIMITS[k])
    failed = n < BASE_MIN_WORDS or 100 * repeat_words > BASE_REPEAT_PERCENT * n
    kept = not failed and worst <= 1 and line_cover <= LINE_LIMIT
    return n, chars, symbols, dup_lines, repeat_words, failed, kept, line_cover, worst


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; worst_coverage is the highest share of its limit, over the lengths."""
    small_batches(docs.sparkSession)
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(batch, "__text"):
                columns = list(zip(*map(measure, texts)))
                yield batches_out(dict(zip(schema.names, [part.column("__id"), *columns])), schema)

    return docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text")).mapInArrow(run, SCHEMA)
