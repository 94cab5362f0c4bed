"""Repetition coverage: how much of a text lies in repeated n-grams and lines.

Rolling hashes of several n-gram lengths over all words of a text; the characters
of words inside an n-gram that occurs twice are measured, and those of lines that
stood before. One pass, no shuffle.

Null and empty texts have no words and are not kept. Repeated rows give repeated
results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftpanel.llm import textscan as ts
from driftpanel.llm.common import only, prepared

# Largest share of a text's word characters inside repeated n-grams, by length, and
# inside lines that stood before. Both copies count, so a short text with one line
# twice stays.
GRAM_SHARE = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_SHARE = 0.20
LEAST_WORDS = 20
WINDOW = 8
WINDOW_PERCENT = 30

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, gram_share double, line_share double"
)


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = ts.utf8(batch.column("text"))
    found = ts.words(data, offsets, ts.SPACED, lower=False)
    n_words, rows, total = found.counts, found.rows, len(found.starts)
    letters = np.concatenate([[0], np.cumsum(ts.LEADING[data])])
    chars = letters[found.ends] - letters[found.starts]
    word_chars = ts.sums(chars, found.first)

    starts, ends, line_rows = ts.lines(data, offsets)
    in_line = np.searchsorted(found.starts, ends) - np.searchsorted(found.starts, starts)
    full = in_line > 0
    starts, ends, line_rows = starts[full], ends[full], line_rows[full]
    _, again = ts.repeated(line_rows, found.span_hash(starts, ends))
    n_dup = np.bincount(line_rows[again], minlength=len(n_words))
    line_chars = np.concatenate([[0], np.cumsum(chars)])
    line_chars = line_chars[np.searchsorted(found.starts, ends)] - line_chars[np.searchsorted(found.starts, starts)]
    dup_chars = np.bincount(line_rows[again], weights=line_chars[again], minlength=len(n_words))

    # An n-gram can only occur twice where its first words do.
    at = ts.gram_starts(found.first, min(GRAM_SHARE))
    worst = np.zeros(len(n_words))
    repeat_words = np.zeros(len(n_words), np.int64)
    for n, limit in GRAM_SHARE.items():
        at = at[at + n <= found.first[rows[at] + 1]]
        twice, _ = ts.repeated(rows[at], ts.gram_hashes(found.hashes, at, n))
        at = at[twice]
        inside = ts.covered(at, n, total)
        share = ts.sums(chars * inside, found.first) / np.maximum(word_chars, 1)
        worst = np.maximum(worst, share / limit)
        if n == WINDOW:
            repeat_words = ts.sums(inside, found.first)
    line_share = dup_chars / np.maximum(word_chars, 1)
    failed = (n_words < LEAST_WORDS) | (100 * repeat_words > WINDOW_PERCENT * n_words)
    kept = ~failed & (worst <= 1) & (line_share <= LINE_SHARE)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in (
            n_words, word_chars, ts.sums(SYMBOL[data], offsets), n_dup, repeat_words)),
         pa.array(failed), pa.array(kept), pa.array(worst), pa.array(line_share)],
        ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "base_failed", "kept", "gram_share", "line_share"])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ts.slices(batches, "text"):
        yield measure(batch)


def repetition_coverage(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict per row. `gram_share` is the largest share of any length over its limit."""
    prepared(docs.sparkSession)
    return only(docs, doc_id=doc_id, text=text).mapInArrow(scan, SCHEMA)
