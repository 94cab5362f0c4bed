"""Benchmark decontamination by winnowing.

A fingerprint is the least k-gram hash of each window of w k-grams (the last one of
equal ones), so two texts that share w + k - 1 = 10 words share a fingerprint. The
fingerprints of texts and items are joined and each hit is extended to the ten-word
windows around it. Items of fewer words are one window; for each such length that
occurs, every n-gram of the texts is a fingerprint.

The items' fingerprints are folded into a bitmap of fixed size that the workers
hold; a text's fingerprint that it doesn't know can't match and is not sent on. A
full bitmap only sends more, it never loses a hit.

Null and empty texts have no words: no hits for documents, no windows for items.
Repeated documents give repeated rows with equal results; rows are told apart by id
and text, and the id may be null. An item id may stand on several texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.llm import textscan as ts
from driftpanel.llm.bitmap import bitmap, may_hold
from driftpanel.llm.common import keyed, prepared, stored, without

WINDOW = 10
K = 5
U = np.uint64
SALT = 0x5851F42D4C957F2D

# `row` is a hash of the text: with the id it tells rows apart; equal rows share their hits.
NAMES = ["id", "row", "n_words", "kind", "fp", "at", "ctx"]
HIT = "id long, row long, n_words long, kind int, fp long, at long, ctx array<long>"


def winnowed(rows: np.ndarray, at: np.ndarray, values: np.ndarray, w: int) -> np.ndarray:
    """Indices into `at` of the last least value of each window of w neighbours in a row."""
    if not len(at):
        return np.zeros(0, np.int64)
    count = len(at) - w + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    place = np.arange(count)
    best, least = place, values[:count]
    for j in range(1, w):
        other = values[j : j + count]
        better = other <= least
        best = np.where(better, place + j, best)
        least = np.where(better, other, least)
    # Windows that run over the end of a row don't count.
    whole = rows[:count] == rows[w - 1 : w - 1 + count]
    return np.unique(best[whole])


def fingerprints(found: ts.Words, shorts: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, row, word position in the column, fingerprint); kind 0 is winnowed, n a short length."""
    rows = found.rows
    at = ts.gram_starts(found.first, K)
    values = ts.gram_hashes(found.hashes, at, K)
    chosen = winnowed(rows[at], at, values, WINDOW - K + 1)
    yield 0, rows[at[chosen]], at[chosen], values[chosen]
    for n in shorts:
        at = ts.gram_starts(found.first, n)
        yield n, rows[at], at, ts.gram_hashes(found.hashes, at, n) ^ U(SALT * n % (1 << 64))


def around(found: ts.Words, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each ten-word window over a fingerprint, by how far before it the window
    begins, and whether the window lies inside the text."""
    back = np.arange(WINDOW - K + 1)
    begin = at[:, None] - back[None, :]
    inside = (begin >= found.first[rows][:, None]) & (begin + WINDOW <= found.first[rows + 1][:, None])
    hashes = np.zeros(begin.shape, U)
    hashes[inside] = ts.gram_hashes(found.hashes, begin[inside], WINDOW)
    return hashes, inside


def texts_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, ts.Words]:
    found = ts.words(*ts.utf8(batch.column("text")), ts.ALNUM)
    return batch.column("id").cast(pa.int64()), batch.column("row").to_numpy(), found


def emit(ids: pa.Array, texts: np.ndarray, found: ts.Words, kind: int, rows: np.ndarray, at: np.ndarray,
         fps: np.ndarray) -> pa.RecordBatch:
    if kind < 0:
        flat, first = np.zeros(0, np.uint64), np.zeros(len(rows) + 1)
    elif kind:
        flat, first = fps, np.arange(len(fps) + 1)
    else:
        hashes, inside = around(found, rows, at)
        # 0 stands for no window.
        flat, first = np.where(inside, hashes, U(0)).ravel(), np.arange(len(fps) + 1) * hashes.shape[1]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows)), pa.array(texts[rows]), pa.array(found.counts[rows]),
         pa.array(np.full(len(rows), kind, np.int32)), pa.array(ts.signed(fps)),
         pa.array(at - found.first[rows]), ts.list_column(ts.signed(flat), first)], NAMES)


def text_scanner(shorts: tuple[int, ...], known) -> Callable:
    """A row of kind -1 for each text, and its fingerprints that the bitmap `known` may hold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in ts.slices(batches, "text"):
            ids, texts, found = texts_of(batch)
            every = np.arange(len(texts))
            yield emit(ids, texts, found, -1, every, found.first[:-1], np.zeros(len(every), U))
            for kind, rows, at, fps in fingerprints(found, shorts):
                may = may_hold(bits, fps)
                if may.any():
                    yield emit(ids, texts, found, kind, rows[may], at[may], fps[may])

    return scan


def item_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the items: winnowed for long ones, the whole item for short ones."""
    for batch in ts.slices(batches, "text"):
        ids, texts, found = texts_of(batch)
        for kind, rows, at, fps in fingerprints(found, tuple(range(1, WINDOW))):
            keep = (found.counts[rows] >= WINDOW) if kind == 0 else (found.counts[rows] == kind)
            if keep.any():
                yield emit(ids, texts, found, kind, rows[keep], at[keep], fps[keep])


def window_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs and items have (id, row, text). Returns the texts (id, row, n_words), their hit windows
    (id, row, at, n, window) and the items of the windows (window, item)."""
    spark = docs.sparkSession
    theirs = stored(items.mapInArrow(item_scan, HIT), "winnow-items")
    shorts = tuple(r[0] for r in theirs.filter("kind > 0").select("kind").distinct().collect())  # nine at most
    known = spark.sparkContext.broadcast(bitmap(theirs, "fp"))
    ours = stored(docs.mapInArrow(text_scanner(shorts, known), HIT), "winnow-texts")
    prints = theirs.select("kind", "fp", F.col("ctx").alias("their_ctx")).distinct()
    # Extension: the windows around a hit, compared at the same place.
    places = F.expr("filter(sequence(0, size(ctx) - 1), i -> ctx[i] = their_ctx[i] and (ctx[i] <> 0 or kind > 0))")
    windows = (ours.filter("kind >= 0").join(prints, ["kind", "fp"])
               .select("id", "row", "at", "kind", "ctx", F.explode(places).alias("i"))
               .select("id", "row", (F.col("at") - F.col("i")).alias("at"),
                       F.when(F.col("kind") > 0, F.col("kind")).otherwise(WINDOW).alias("n"),
                       F.col("ctx")[F.col("i")].alias("window"))
               .distinct())
    by_item = (theirs.select(F.col("id").alias("item"), F.explode("ctx").alias("window"), "kind")
               .filter("window <> 0 or kind > 0").select("window", "item").distinct())
    return ours.filter("kind = -1").select("id", "row", "n_words"), stored(windows, "winnow-windows"), by_item


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, as they are, without those that hold a window of an item."""
    prepared(docs.sparkSession)
    _, windows, _ = window_hits(keyed(docs, doc_id, text), keyed(items, "item_id", "text"))
    return without(docs, windows.select("id", "row").distinct(), doc_id, text)


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, n_hit (words inside windows of items), items (ids sorted as strings)."""
    prepared(docs.sparkSession)
    texts, windows, by_item = window_hits(keyed(docs, doc_id, text), keyed(items, item_id, item_text))
    # Words in the union of a text's spans: what each adds beyond the furthest end so far.
    n_hit = F.expr(
        "aggregate(spans, named_struct('to', 0L, 'n', 0L), (a, s) -> named_struct("
        "'to', greatest(a.to, s.to), 'n', a.n + greatest(0L, s.to - greatest(a.to, s.at))), a -> a.n)")
    spans = (windows.groupBy("id", "row")
             .agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("to")))).alias("spans"))
             .select("id", "row", n_hit.alias("n_hit")))
    found = (windows.select("id", "row", "window").distinct().join(by_item, "window")
             .groupBy("id", "row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")))
    # Ids may be null, so the parts meet in a grouping, not in a join.
    parts = (texts.groupBy("id", "row").agg(F.max("n_words").alias("n_words"), F.count("*").alias("times"))
             .unionByName(spans, True).unionByName(found, True))
    return (parts.groupBy("id", "row")
            .agg(F.max("n_words").alias("n_words"), F.max("times").cast("int").alias("times"),
                 F.coalesce(F.max("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
                 F.coalesce(F.max("items"), F.array().cast("array<string>")).alias("items"))
            .withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
            .select(F.col("id").alias(doc_id), "n_words", "n_hit", "items"))
