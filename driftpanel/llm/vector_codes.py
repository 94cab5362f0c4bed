"""Vector code compression: a product quantiser whose nearest entries are found by Orchard's search.

A vector is cut into equal consecutive parts; each part is coded by the nearest entry of its
position's codebook. Components are integers, so distances, sums and ties are exact.

Orchard's search: for every entry all entries are listed by distance from it. A query starts at a
guess and walks down that entry's list; an entry that is nearer is jumped to, and its list walked
from the top; entries already compared are marked and skipped. Once a listed entry stands more than
twice the current distance away, no later one can be nearer or tie. Many queries walk side by side.

Codebooks start as the parts of the first vectors by identifier, and each round replaces an
entry by the floor of the mean of its parts. Tasks return sums per entry, at most one row for each
part and entry; only those sums and the first vectors reach the driver.

A vector is left out when it is null or empty, holds a null, a non-finite component or one of 2^72 or more,
can't be cut evenly, or differs in length from the first one by identifier. Null identifiers come
last; rows of equal identifier are ordered by their vectors. Repeated rows count as often as they
stand. With fewer vectors than entries, codebooks are as short. No vector gives no rows. Labels may
be null; those rows are summed together. Errors beyond a long are given as the greatest long.
Further columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.llm.common import only, prepared, stored

PARTS, ENTRIES, SCALE, ROUNDS = 16, 64, 256, 2
LARGEST = 2.0**80  # of a scaled component; sums over many rows stay within decimal(38)
LONG = (1 << 63) - 1


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """Floors as int64 where distances between them surely fit, else as Python's integers."""
    floors = np.floor(values)
    if not floors.size or 32 * floors.shape[-1] * np.abs(floors).max() ** 2 < 2.0**62:
        return floors.astype(np.int64)
    return np.array([int(v) for v in floors.ravel()], object).reshape(floors.shape)


class Orchard:
    """Nearest entries of several codebooks at once: `books` is (parts, entries, width), of integers."""

    def __init__(self, books: np.ndarray) -> None:
        self.parts, self.size, self.width = books.shape
        self.books = books
        gaps = ((books[:, :, None, :] - books[:, None, :, :]) ** 2).sum(-1)
        index = np.broadcast_to(np.arange(self.size), gaps.shape)
        order = np.stack([[sorted(range(self.size), key=lambda s: (row[s], s)) for row in part] for part in gaps.tolist()])
        self.order = np.concatenate([order, index[:, :, :1]], 2).reshape(-1, self.size + 1)
        # A list ends with what is farther than anything.
        end = np.full(gaps.shape[:2] + (1,), -1, gaps.dtype)
        self.gaps = np.concatenate([np.take_along_axis(gaps, order, 2), end], 2).reshape(-1, self.size + 1)
        self.flat = books.reshape(-1, self.width)
        sums = books.sum(2)
        self.by_sum = [sorted(range(self.size), key=lambda s: (row[s], s)) for row in sums.tolist()]
        self.sums = [row[order] for row, order in zip(sums, self.by_sum, strict=True)]

    def guesses(self, queries: np.ndarray) -> np.ndarray:
        """Entries whose components add up to about as much."""
        total = queries.sum(2)
        out = np.empty(total.shape, np.int64)
        for part in range(self.parts):
            place = np.searchsorted(self.sums[part], total[:, part])
            out[:, part] = np.asarray(self.by_sum[part])[np.minimum(place, self.size - 1)]
        return out.ravel()

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance, each (rows, parts); ties go to the lower index."""
        rows = len(queries)
        q = queries.reshape(-1, self.width)
        base = np.tile(np.arange(self.parts) * self.size, rows)
        at = self.guesses(queries)
        best = ((q - self.flat[base + at]) ** 2).sum(1)
        seen = np.zeros((len(q), self.size), bool)
        seen[np.arange(len(q)), at] = True
        place = np.zeros(len(q), np.int64)
        live = np.arange(len(q))
        while len(live):
            row = base[live] + at[live]
            other, gap = self.order[row, place[live]], self.gaps[row, place[live]]
            go = ((gap >= 0) & (gap <= 4 * best[live])).astype(bool)
            live, other = live[go], other[go]
            place[live] += 1
            new = ~seen[live, other]
            asked, other = live[new], other[new]
            seen[asked, other] = True
            distance = ((q[asked] - self.flat[base[asked] + other]) ** 2).sum(1)
            nearer = ((distance < best[asked]) | ((distance == best[asked]) & (other < at[asked]))).astype(bool)
            asked = asked[nearer]
            at[asked], best[asked], place[asked] = other[nearer], distance[nearer], 0
        return at.reshape(rows, self.parts), best.reshape(rows, self.parts)


def usable(column: pa.Array, parts: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that can be coded, lengths of all rows, starts of all rows and scaled components."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    # A null component reads as not a number.
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale
    ends = np.cumsum(lengths)
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~(np.abs(values) < LARGEST), out=bad[1:])
    fine = (lengths > 0) & (lengths % parts == 0) & (bad[ends] == bad[ends - lengths])
    return np.flatnonzero(fine), lengths, ends - lengths, values


def matrix(column: pa.Array, length: int, parts: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of that length, and their parts as integers: (rows, parts, width)."""
    rows, lengths, starts, values = usable(column, parts, scale)
    rows = rows[lengths[rows] == length]
    return rows, whole_numbers(values[starts[rows][:, None] + np.arange(length)]).reshape(len(rows), parts, length // parts)


def first_of(parts: int, scale: int, entries: int):
    """A task's first vectors by identifier, of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            rows, lengths, starts, values = usable(batch.column("vector"), parts, scale)
            ids = batch.column("id").take(pa.array(rows)).to_pylist()
            found: dict[int, list] = {}
            for row, key in zip(rows.tolist(), ids, strict=True):
                found.setdefault(int(lengths[row]), []).append((key is None, key or 0, row))
            for length, keys in found.items():
                # Identifiers up to the last that could matter; only ties among them look at vectors.
                limit = heapq.nsmallest(entries, keys)[-1][:2]
                have = best.setdefault(length, [])
                if len(have) == entries:
                    limit = min(limit, have[-1][:2])
                have += [(none, key, tuple(values[starts[row] : starts[row] + length].tolist())) for none, key, row in keys if (none, key) <= limit]
                best[length] = heapq.nsmallest(entries, have)
        for length, have in best.items():
            yield pa.RecordBatch.from_pydict({
                "length": pa.array([length] * len(have), pa.int64()), "unknown": pa.array([h[0] for h in have], pa.bool_()),
                "id": pa.array([h[1] for h in have], pa.int64()), "vector": pa.array([list(h[2]) for h in have], pa.list_(pa.float64()))})

    return run


def sums_of(books: np.ndarray, length: int, scale: int):
    """A task's count and componentwise sums per part and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        counts = np.zeros(parts * entries, np.int64)
        totals = np.zeros((parts * entries, width), object)
        search = Orchard(books)
        for batch in batches:
            _, vectors = matrix(batch.column("vector"), length, parts, scale)
            if not len(vectors):
                continue
            code, _ = nearest(search, vectors)
            slot = (code + np.arange(parts) * entries).ravel()
            counts += np.bincount(slot, minlength=len(counts))
            here = np.zeros(totals.shape, vectors.dtype)
            np.add.at(here, slot, vectors.reshape(-1, width))
            totals += here
        used = np.flatnonzero(counts)
        columns = {"slot": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64())}
        for k in range(width):
            columns[f"s{k}"] = pa.array([str(v) for v in totals[used, k]], pa.string())
        yield pa.RecordBatch.from_pydict(columns)

    return run


def nearest(search: Orchard, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if vectors.dtype == search.books.dtype == np.int64:
        return search(vectors)
    return Orchard(search.books.astype(object))(vectors.astype(object))


def codes_of(books: np.ndarray, length: int, scale: int):
    """Per vector: its code as hex digits and its squared distance over all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = books.shape[0]
        search = Orchard(books)
        for batch in batches:
            rows, vectors = matrix(batch.column("vector"), length, parts, scale)
            if not len(rows):
                continue
            code, distance = nearest(search, vectors)
            digits = code.astype(np.uint8).tobytes().hex()
            errors = [min(int(v), LONG) for v in distance.sum(1)]
            kept = batch.select(["id", "label"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()),
                 pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    return run


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The starting codebooks; None without a usable vector. At most `entries` vectors reach the driver."""
    found = stored(vectors.select("id", "vector").mapInArrow(
        first_of(parts, scale, entries), "length long, unknown boolean, id long, vector array<double>"), "first-vectors")
    order = ("unknown", "id", "vector")
    head = found.orderBy(*order, "length").first()
    if head is None:
        return None
    rows = found.filter(F.col("length") == head["length"]).orderBy(*order).limit(entries).collect()
    return whole_numbers(np.array([r["vector"] for r in rows])).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def next_books(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Each entry as the floor of its parts' mean; entries without parts stay."""
    parts, entries, width = books.shape
    names = [f"s{k}" for k in range(width)]
    found = vectors.select("vector").mapInArrow(sums_of(books, parts * width, scale), "slot long, n long, " + ", ".join(f"{s} string" for s in names))
    # One row per part and entry at most.
    rows = found.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in names]).collect()
    out = books.reshape(-1, width).astype(object)
    for r in rows:
        out[r["slot"]] = [int(r[s]) // r["n"] for s in names]
    return whole_integers(out).reshape(parts, entries, width)


def whole_integers(values: np.ndarray) -> np.ndarray:
    fits = 128 * values.size * max((abs(v) for v in values.ravel()), default=0) ** 2 < 1 << 62
    return values.astype(np.int64) if fits else values


def books_sha256(books: np.ndarray) -> str:
    """Of all components, by part, entry and place within the part."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compress(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """Per usable vector: id, label, code, error (codes of two hex digits a part); and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError(f"a code of two hex digits has 1 to 256 entries, not {entries}")
    prepared(df.sparkSession)
    vectors = only(df, id=id_column, vector=vector_column, label=label_column).withColumn("id", F.col("id").cast("long"))
    kind = vectors.schema["label"].dataType.simpleString()
    schema = f"id long, label {kind}, code string, error long"
    books = first_books(vectors, parts, entries, scale)
    if books is None:
        return df.sparkSession.createDataFrame([], schema), None
    for _ in range(rounds):
        books = next_books(vectors, books, scale)
    return vectors.mapInArrow(codes_of(books, books.shape[0] * books.shape[2], scale), schema), books


def coded(df: DataFrame, **options) -> DataFrame:
    """`compress` with each label's total error, and a digest of the codebooks."""
    codes, books = compress(df, **options)
    codes = stored(codes, "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    totals = codes.groupBy("label").agg(total.alias("label_error"))
    digest = books_sha256(books) if books is not None else books_sha256(np.zeros(0, np.int64))
    return codes.join(totals.withColumnRenamed("label", "of_label"), F.col("label").eqNullSafe(F.col("of_label"))).select(
        "id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
