r"""Line deduplication over a deletion neighbourhood.

Lines (\n-split) are compared by their words, lower-cased. A line of `equal_from` or more
words goes if an earlier one, by document id and place, equals it: 1 compares every line
with a word. A line of at least LEAST_WORDS words also goes if an earlier one as long is one
word's insertion, deletion or substitution away; of shorter lines a word is too large a
part for that. Lines with the same id and place are not earlier than each other; null
ids come last.

Equal lines are folded first, by two unrelated 64-bit functions of their words: `hash`,
from which the keys below are made, and `proof`; both must agree. Of the distinct ones, those that share half of their
words with no other can't be near another and are left aside: two lines within one edit
have the same first or the same last half. The others emit a hashed key for each word
left out, alone (it meets the line that lacks the word) and with the place (it meets the
lines that differ there). Each key is folded to its earliest line, so a group of any size
gives one link per member; links are verified on the words. Only the earliest of equal
lines is read again for that, by its place.

Null texts have no lines and stay null. Repeated rows give repeated results. Columns in
`carry` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftpanel.llm import textscan as ts
from driftpanel.llm.bitmap import bitmap, may_hold
from driftpanel.llm.common import prepared, stored
from driftpanel.operators.ordering import position_overall

LEAST_WORDS = 8  # of lines that are compared for one edit
U = np.uint64
LAST = (1 << 63) - 1  # where null ids sort
Arrow = Iterator[pa.RecordBatch]


class Lines:
    """Lines of a column with enough words, as runs of word hashes."""

    def __init__(self, text: pa.Array, least: int = LEAST_WORDS) -> None:
        data, offsets = ts.utf8(text)
        found = ts.words(data, offsets, ts.SPACED)
        starts, ends, rows = ts.lines(data, offsets)
        first, last = np.searchsorted(found.starts, starts), np.searchsorted(found.starts, ends)
        number = np.arange(len(rows)) - np.searchsorted(rows, rows)
        long = last - first >= least
        self.first, self.last, self.row, self.number = first[long], last[long], rows[long], number[long]
        self.size = self.last - self.first
        self.words = ts.Sequence(found.hashes)
        self.hash = self.words.of(self.first, self.last)
        self.bytes = (data, starts[long], ends[long])
        self.lowered = found.data

    def proofs(self, which: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Of the lines' words as they are, without the arithmetic of the other hash."""
        raw, (_, starts, ends) = self.lowered.tobytes(), self.bytes
        words = (raw[a:b].split() for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True))
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words], U)


LINE = ["hash", "proof"]  # the same words
PLACE = ["id", "row", "line"]
PLACES = "id long, row long, line int, hash long, proof long, keys array<long>"


def places(equal_from: int):
    """Every line; the ones compared for one edit have the keys of their halves."""

    def scan(batches: Arrow) -> Arrow:
        for batch in ts.slices(batches, "text"):
            x = Lines(batch.column("text"), equal_from)
            half, less = x.size // 2, (x.size - 1) // 2
            keys = np.stack([x.words.of(x.first, x.first + half), ~x.words.of(x.last - half, x.last),
                             x.words.of(x.first, x.first + less), ~x.words.of(x.last - less, x.last)], axis=1)
            n = np.where(x.size < LEAST_WORDS, 0, np.where(half == less, 2, 4))
            flat = keys.ravel()[(np.arange(4)[None, :] < n[:, None]).ravel()]
            at = pa.array(x.row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("row").take(at), pa.array(x.number.astype(np.int32)), pa.array(ts.signed(x.hash)),
                 pa.array(ts.signed(x.proofs())), ts.list_column(ts.signed(flat), np.concatenate([[0], np.cumsum(n)]))],
                ["id", "row", "line", "hash", "proof", "keys"])

    return scan


def place_hash(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    return ts.mix(row + ts.mix(line.astype(U)))


def place_hashes(batches: Arrow) -> Arrow:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(ts.signed(place_hash(batch.column("row").to_numpy().view(U), batch.column("line").to_numpy())))], ["spot"])


def texts_of(held):
    """The lines that stand where the bitmap may hold."""

    def scan(batches: Arrow) -> Arrow:
        for batch in ts.slices(batches, "text"):
            data, offsets = ts.utf8(batch.column("text"))
            starts, ends, rows = ts.lines(data, offsets)
            number = np.arange(len(rows)) - np.searchsorted(rows, rows)
            which = np.flatnonzero(may_hold(held.value, place_hash(batch.column("row").to_numpy().view(U)[rows], number)))
            at, raw = pa.array(rows[which]), data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("row").take(at), pa.array(number[which].astype(np.int32)),
                 pa.array([raw[a:b].decode() for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)], pa.string())], [*PLACE, "text"])

    return scan


def variants(batches: Arrow) -> Arrow:
    """Keys of each line's deletion neighbourhood; kind 0: the line itself, 1: a word left out, 2: with its place.

    A line that shares its first half with another is only edited behind it, and the
    other way round.
    """
    for batch in ts.slices(batches, "text", 1 << 20):
        x = Lines(batch.column("text"), 1)
        line = np.repeat(np.arange(len(x.size)), x.size)
        place = np.arange(len(line)) - np.repeat(np.concatenate([[0], np.cumsum(x.size)])[:-1], x.size)
        half = ((x.size - 1) // 2)[line]
        head, tail = (batch.column(c).to_numpy(zero_copy_only=False)[x.row][line] for c in ("head", "tail"))
        want = head & (place >= half) | tail & (place < x.size[line] - half)
        line, place = line[want], place[want]
        rest = x.words.without(x.first[line], x.last[line], x.first[line] + place)
        placed = ts.mix(rest ^ ts.mix((place + 1).astype(U)))
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(x.size), len(line), len(line)])
        rows = pa.array(np.concatenate([x.row, x.row[line], x.row[line]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ts.signed(np.concatenate([x.hash, rest, placed]))), pa.array(kind), batch.column("rank").take(rows)],
            ["key", "kind", "rank"])


def one_edit(a: list, b: list) -> bool:
    """At most one word inserted, deleted or substituted."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = next((k for k in range(short) if a[k] != b[k]), short)
    tail = next((k for k in range(short - head) if a[-1 - k] != b[-1 - k]), short - head)
    return head + tail >= max(len(a), len(b)) - 1


def verified(batches: Arrow) -> Arrow:
    split = lambda t: t.encode().translate(LOWER).split()  # noqa: E731  on the same white space
    for batch in batches:
        near = [one_edit(split(a), split(b)) for a, b in zip(batch.column("text").to_pylist(), batch.column("earlier_text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in LINE], LINE)


LOWER = bytes(ts.LOWER)


def near_lines(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Lines with an earlier line one edit away. classes has (hash, proof, place, keys)."""
    spark = rows.sparkSession
    # Keys of first and last halves take turns.
    halves = classes.select(*LINE, F.posexplode("keys").alias("side", "key"))
    shared = halves.groupBy("key").agg(F.min(F.struct(*LINE)).alias("a"), F.max(F.struct(*LINE)).alias("b")).filter("a <> b").select("key")
    sides = (halves.join(shared, "key").groupBy(*LINE)
             .agg(F.bool_or(F.col("side") % 2 == 0).alias("head"), F.bool_or(F.col("side") % 2 == 1).alias("tail")))
    candidates = stored(classes.join(sides, LINE).select(*LINE, "place", "head", "tail"), "line-candidates")
    spots = candidates.select("place.row", "place.line").mapInArrow(place_hashes, "spot long")
    held = spark.sparkContext.broadcast(bitmap(spots, "spot"))
    # A number for each candidate's place: one long to compare.
    ranked = position_overall(candidates, [F.col("place"), *map(F.col, LINE)], "rank")
    # Only the earliest of equal lines is read again; repeated rows give it repeatedly.
    texts = rows.select(F.coalesce("id", F.lit(LAST)).alias("id"), "row", "text").mapInArrow(
        texts_of(held), "id long, row long, line int, text string").groupBy(*PLACE).agg(F.min("text").alias("text"))
    lines = stored(ranked.select("*", *[F.col(f"place.{c}").alias(c) for c in PLACE]).join(texts, PLACE).drop(*PLACE), "line-texts")
    keys = lines.select("text", "rank", "head", "tail").mapInArrow(variants, "key long, kind int, rank long")
    # Kind 2 meets kind 2; kind 1 meets kind 0 and the other way round.
    side = keys.withColumn("space", F.col("kind") == 2)
    first = (side.groupBy("space", "key").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("kind") != 1, F.col("rank"))).alias("whole"),
        F.min(F.when(F.col("kind") == 1, F.col("rank"))).alias("part"))
        .filter("n > 1 and whole is not null"))
    met = side.join(first, ["space", "key"])
    earlier = F.when(F.col("kind") == 0, F.col("part")).otherwise(F.col("whole"))
    links = met.select("rank", earlier.alias("earlier")).filter("earlier < rank").distinct()
    one = lines.select("rank", *LINE, "place", "text")
    other = lines.select(F.col("rank").alias("earlier"), F.col("place").alias("earlier_place"), F.col("text").alias("earlier_text"))
    # The ranks of lines with the same id and number differ, but neither is earlier.
    before = (F.col("earlier_place.id") < F.col("place.id")) | (F.col("earlier_place.line") < F.col("place.line"))
    pairs = links.join(one, "rank").join(other, "earlier").filter(before)
    return stored(pairs.select(*LINE, "text", "earlier_text").mapInArrow(verified, "hash long, proof long").distinct(), "near-lines")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Column | None = None,
                equal_from: int = LEAST_WORDS) -> DataFrame:
    """Per row: id, text without the lines that go, n_lines (compared ones), n_equal and n_near (gone as equal
    to or one edit from an earlier line); `carry` travels along as it is."""
    prepared(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("row"),
                       (carry if carry is not None else F.lit(None).cast("int")).alias("carry"))
    found = stored(rows.select("id", "row", "text").mapInArrow(places(equal_from), PLACES), "line-places")
    place = F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), "line", "row").alias("place")
    classes = stored(found.select(*LINE, place, "keys").groupBy(*LINE).agg(F.min("place").alias("place"), F.first("keys").alias("keys")), "line-classes")
    near = near_lines(rows, classes)
    flags = classes.select(*LINE, F.col("place").alias("first")).join(near.withColumn("near", F.lit(True)), LINE, "left")
    own = F.coalesce("id", F.lit(LAST))
    later = (own > F.col("first.id")) | (own == F.col("first.id")) & (F.col("line") > F.col("first.line"))
    gone = F.when(later, "e").when(F.col("near"), "n")
    # Repeated rows send equal lines: sets keep them once.
    lines = (found.select("id", "row", "line", *LINE).join(flags, LINE).withColumn("gone", gone)
             .groupBy("id", "row").agg(F.collect_set(F.struct("line", "gone")).alias("seen"))
             .select("id", "row", F.transform(F.filter("seen", lambda x: x["gone"].isNotNull()), lambda x: x["line"]).alias("drop"),
                     F.size("seen").alias("n_lines"), F.size(F.filter("seen", lambda x: x["gone"] == "e")).alias("n_equal"),
                     F.size(F.filter("seen", lambda x: x["gone"] == "n")).alias("n_near"))
             .withColumnRenamed("id", "theirs").withColumnRenamed("row", "their_row"))
    joined = rows.join(lines, F.col("id").eqNullSafe(F.col("theirs")) & (F.col("row") == F.col("their_row")), "left")
    # As an array of one, so that a text is split once, not for each of its lines.
    split = F.array(F.split("text", "\n", -1))
    kept = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "drop")
    whole = F.transform(split, lambda parts: F.array_join(F.transform(kept(parts), lambda i: F.get(parts, i)), "\n"))
    left = F.when(F.size("drop") > 0, F.get(whole, 0)).otherwise(F.col("text"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("id", "carry", left.alias("text"), n("n_lines"), n("n_equal"), n("n_near"))
