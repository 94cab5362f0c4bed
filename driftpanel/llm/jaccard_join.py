"""Jaccard join of n-gram sets, size-aware, with its connected groups.

Two sets link when percent(union) is at most 100 x intersection. Equal sets are folded
to classes first. Then by size:

* Small sets: for each pair of sizes that can link, every subset of the size the
  intersection must have is enumerated as a hashed key. Sets that share a key of their
  pair of sizes link, so a group of any size gives one link per member and needs no
  verification.
* Large sets: inverted lists over the rarest n-grams of each set, as many as a partner
  can't avoid. List by list, a few hubs are compared with all members; lists whose
  members are not yet one group go on with new hubs, taken from the smallest groups,
  64 times as many each round, until every pair is compared or in one group. Pairs that
  the sets' sizes, the n-gram's places or parity bits rule out are left aside; the others are compared whole.

The boundary between small and large is the size at which enumeration stops being the
cheaper of the two for the sizes that occur. How rare an n-gram is, is estimated by
counters of fixed size over all texts; the estimate orders the lists and changes no
result. Sets of few words are one n-gram; without words they link with nothing.

Null texts have no words. Repeated rows have equal sets, so they are one group. Null ids
take part; a group's id is its smallest one that isn't null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftpanel.llm import textscan as ts
from driftpanel.llm.bitmap import bitmap, may_hold
from driftpanel.llm.common import keyed, prepared, same_row, stored

U = np.uint64
COUNTERS = 22  # bits
CHUNK = 16  # bits of the counters sent together
BITS = 1024  # places of a set's parities
HISTOGRAM = 200
MOST_SUBSETS = 2000  # a set with more is never small
HUBS, ROUND = 3, 64  # hubs of the first round, and how many times as many each next one has
Arrow = Iterator[pa.RecordBatch]


def gram_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, sorted by row and hash; and each row's first."""
    found = ts.words(*ts.utf8(text), ts.SPACED)
    rows, counts = found.rows, found.counts
    at = ts.gram_starts(found.first, n)
    row, value = [rows[at]], [ts.gram_hashes(found.hashes, at, n)]
    for size in range(1, n):  # the whole of a shorter text
        few = np.flatnonzero(counts == size)
        row.append(few)
        value.append(ts.gram_hashes(found.hashes, found.first[few], size))
    row, value = ts.distinct_sets(np.concatenate(row), np.concatenate(value))
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


def set_hash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row's set."""
    return ts.mix(segment_sums(ts.mix(values ^ U(0xC2B2AE3D27D4EB4F)), first) + np.diff(first).astype(U))


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def parities(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Of each row's set, whether an odd number of its n-grams falls on each of BITS places.

    Two sets differ in at least as many n-grams as their parities differ in places.
    """
    size, out = len(first) - 1, []
    rows = np.repeat(np.arange(size), np.diff(first))
    place = (values & U(BITS - 1)).astype(np.int64)
    for begin in range(0, size, 2000):
        end = min(begin + 2000, size)
        at = slice(first[begin], first[end])
        counts = np.bincount((rows[at] - begin) * BITS + place[at], minlength=(end - begin) * BITS)
        out += [x.tobytes() for x in np.packbits((counts & 1).astype(np.uint8).reshape(-1, BITS), axis=1)]
    return pa.array(out, pa.binary())


def needed(s: int, t: int, percent: int) -> int:
    """The least intersection with which sizes s and t link."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int) -> range:
    """Sizes not below s that can link with s."""
    return range(s, 100 * s // percent + 1)


def subsets(s: int, percent: int) -> int:
    """Keys that a set of size s emits."""
    total = sum(math.comb(s, needed(s, t, percent)) for t in partners(s, percent))
    for r in range(-(-percent * s // 100), s):
        if r > 0 and s in partners(r, percent):
            total += math.comb(s, needed(r, s, percent))
    return total


def prefix_size(s: np.ndarray, percent: int) -> np.ndarray:
    """So many of a set's n-grams that a partner shares one of them, in any order."""
    return s - -(-s * percent // 100) + 1


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size to enumerate: that of the least cost over the sizes that occur below HISTOGRAM.

    A key costs 1. A large set costs 2 for each list entry, and 1 for each n-gram that is
    compared. Small sets that can link with a large one stand in the lists, too.
    """
    large = {s: 2 * int(prefix_size(np.array([s]), percent)[0]) + s for s in range(1, HISTOGRAM)}
    best, least, enumerated = 0, math.inf, 0
    for x in range(HISTOGRAM):
        if x and subsets(x, percent) > MOST_SUBSETS:
            break
        enumerated += sizes.get(x, 0) * subsets(x, percent) if x else 0
        cost = enumerated + sum(k * large[s] for s, k in sizes.items() if 100 * s >= percent * (x + 1))
        if cost <= least:
            best, least = x, cost
    return best


SETS = "id long, row long, n long, cls long, bits binary, chunk int, counters binary"
SET_NAMES = [x.split()[0] for x in SETS.split(", ")]


def sketch(n: int):
    """A row per text with its set's size and hash, and chunks of counters of this task's n-grams."""

    def scan(batches: Arrow) -> Arrow:
        counters = np.zeros(1 << COUNTERS, np.uint32)
        for batch in ts.slices(batches, "text"):
            values, first = gram_sets(batch.column("text"), n)
            counters += np.bincount((values >> U(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS).astype(np.uint32)
            size = len(first) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(np.diff(first)), pa.array(ts.signed(set_hash(values, first))),
                 parities(values, first), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], SET_NAMES)
        if not counters.any():
            return
        width = np.uint16 if counters.max() < 1 << 16 else np.uint32
        parts = [x.tobytes() for x in counters.astype(width).reshape(-1, 1 << CHUNK)]
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.nulls(len(parts), pa.binary()), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], SET_NAMES)

    return scan


def folded(batches: Arrow) -> Arrow:
    """Counters of each chunk added up within a task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counters"), strict=True):
            data = raw.as_buffer()
            own = np.frombuffer(data, np.uint16 if data.size == 2 << CHUNK else np.uint32).astype(np.uint64)
            total[chunk] = total[chunk] + own if chunk in total else own
    for chunk, counters in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(255, 8 * np.log2(counters + 1.0)).astype(np.uint8).tobytes()], pa.binary())],
                                         ["chunk", "levels"])


def ordered(values: np.ndarray, first: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Order of all rows' n-grams, each row's from rare to frequent."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rank = (levels[(values >> U(64 - COUNTERS)).astype(np.int64)].astype(U) << U(56)) | (ts.mix(values) >> U(8))
    return ts.order_by(rows, rank)


def lists(n: int, percent: int, small: int, held):
    """List entries (gram, class, size, the gram's place, how frequent the n-grams are) of sets that are large or can link with a large one, each class once per batch."""

    def scan(batches: Arrow) -> Arrow:
        levels = held.value
        for batch in ts.slices(batches, "text"):
            values, first = gram_sets(batch.column("text"), n)
            cls, size = set_hash(values, first), np.diff(first)
            once = np.zeros(len(cls), bool)
            once[np.unique(cls, return_index=True)[1]] = True
            want = once & (100 * size >= percent * (small + 1)) & (size > 0)
            order = ordered(values, first, levels)
            rows = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(values)) - first[rows]
            take = want[rows] & (place < prefix_size(size, percent)[rows])
            known = ts.sums(levels[(values >> U(64 - COUNTERS)).astype(np.int64)], first) * 1000 // np.maximum(size, 1)
            rows, grams = rows[take], values[order[take]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ts.signed(grams)), pa.array(ts.signed(cls[rows])), pa.array(size[rows]), pa.array(place[take]), pa.array(known[rows])],
                ["gram", "cls", "n", "place", "known"])

    return scan


def keys(n: int, percent: int, small: int):
    """Subset keys (key, class, whether the class has the smaller size of the key's pair), each class once per batch."""

    def scan(batches: Arrow) -> Arrow:
        for batch in ts.slices(batches, "text"):
            values, first = gram_sets(batch.column("text"), n)
            cls, size = set_hash(values, first), np.diff(first)
            which = np.unique(cls, return_index=True)[1]
            which = which[(size[which] > 0) & (size[which] <= small)]
            key, owner, lesser = [], [], []
            for k in which:
                own = ts.mix(values[first[k] : first[k + 1]] ^ U(0x165667B19E3779F9))
                s = len(own)
                pairs = [(s, t) for t in partners(s, percent) if t <= small]
                pairs += [(r, s) for r in range(-(-percent * s // 100), s) if r > 0 and s in partners(r, percent)]
                for a, b in pairs:
                    c, salt = needed(a, b, percent), U((a * 1_000_003 + b) * 0x9E3779B97F4A7C15 % (1 << 64))
                    # The sum over a subset, as that over all less that of what it lacks.
                    out = list(itertools.combinations(range(s), s - c))
                    lack = own[np.array(out, int)].sum(axis=1, dtype=U) if s > c else np.zeros(1, U)
                    key.append(ts.mix(own.sum(dtype=U) - lack ^ salt))
                    owner.append(np.full(len(out), cls[k], U))
                    lesser.append(np.full(len(out), s == a))
            if key:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ts.signed(np.concatenate(key))), pa.array(ts.signed(np.concatenate(owner))), pa.array(np.concatenate(lesser))],
                    ["key", "cls", "lesser"])

    return scan


def set_texts(n: int, held):
    """Texts of the sets that the bitmap may hold, each class once per batch."""

    def scan(batches: Arrow) -> Arrow:
        for batch in ts.slices(batches, "text"):
            cls = set_hash(*gram_sets(batch.column("text"), n))
            which = np.unique(cls, return_index=True)[1]
            which = pa.array(which[may_hold(held.value, cls[which])])
            yield pa.RecordBatch.from_arrays([pa.array(ts.signed(cls)).take(which), batch.column("text").take(which)], ["cls", "text"])

    return scan


def may_link(percent: int):
    """Pairs whose sizes and parities don't rule a link out."""

    def scan(batches: Arrow) -> Arrow:
        for batch in batches:
            size = [batch.column(c).to_numpy().astype(np.int64) for c in ("n", "hn")]
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), U).reshape(-1, BITS // 64) for c in ("bits", "hbits")]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            total = size[0] + size[1]
            keep = pa.array((total - apart) // 2 >= -(-percent * total // (100 + percent)))
            yield batch.select(["a", "b"]).filter(keep)

    return scan


def compared(n: int, percent: int):
    """Pairs of texts whose sets link."""

    def scan(batches: Arrow) -> Arrow:
        for batch in ts.slices(ts.slices(batches, "text", 1 << 20), "other", 1 << 20):
            a, first_a = gram_sets(batch.column("text"), n)
            b, first_b = gram_sets(batch.column("other"), n)
            size = len(batch)
            rows = np.concatenate([np.repeat(np.arange(size), np.diff(first_a)), np.repeat(np.arange(size), np.diff(first_b))])
            values = np.concatenate([a, b])
            order = ts.order_by(rows, values)
            rows, values = rows[order], values[order]
            both = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (values[1:] == values[:-1])], minlength=size)
            union = np.diff(first_a) + np.diff(first_b) - both
            link = pa.array(100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), link], ["a", "b", "link"])

    return scan


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge; the root is a group's least node. Edges are (a, b)."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        # Every node's neighbours are hung on the least of them and itself, first those above it, then those below.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b")
        edges = stored(small.distinct(), "edges")
        # All stars: no node hangs on two others, none that others hang on hangs itself.
        twice = edges.groupBy("a").count().filter("count > 1").select("a")
        chained = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
        if twice.union(chained).isEmpty():
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def merged(texts: DataFrame, entries: DataFrame, parity: DataFrame, links: DataFrame, n: int, percent: int) -> DataFrame:
    """Groups (node, root) of the links and of those found in the lists. entries has (gram, cls, n, place, known), parity (cls, n, bits)."""
    spark = texts.sparkSession
    # Lists of one member are left out.
    own = Window.partitionBy("gram")
    members = (entries.withColumn("lo", F.min("cls").over(own)).withColumn("hi", F.max("cls").over(own))
               .filter("lo <> hi").select("gram", "cls", "n", "place", "known").distinct())
    members = stored(members, "list-members")
    groups = components(links)
    done = spark.createDataFrame([], "a long, b long")
    left = members.withColumn("hub", F.lit(False))
    hubs = HUBS
    while True:
        now = left.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        open_lists = (now.filter("not hub").groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                      .filter("lo <> hi").select("gram"))
        now = stored(now.join(open_lists, "gram"), "open-lists")
        if now.isEmpty():
            return groups
        # Hubs: members not yet compared with all others, of the groups with fewest members in the list; of these the
        # ones of the most frequent n-grams, as what copies were made from has nothing of its own.
        weight = now.filter("not hub").groupBy("gram", "root").agg(F.count("*").alias("weight"))
        rank = F.row_number().over(Window.partitionBy("gram").orderBy("weight", F.desc("known"), "cls"))
        chosen = stored(now.filter("not hub").join(weight, ["gram", "root"]).withColumn("rank", rank).filter(F.col("rank") <= hubs)
                        .select("gram", F.col("cls").alias("h"), F.col("n").alias("hn"), F.col("place").alias("hplace"), F.col("root").alias("hroot")), "hubs")
        # In the list of a pair's first common n-gram, what follows must hold the whole intersection.
        follows = F.least(F.col("n") - F.col("place"), F.col("hn") - F.col("hplace"))
        fits = ((100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")) & (F.col("root") != F.col("hroot"))
                & ((100 + percent) * follows >= percent * (F.col("n") + F.col("hn"))))
        # Earlier hubs have met the whole list.
        met = (now.filter("not hub").join(chosen, "gram").filter(fits)
               .select(F.least("cls", "h").alias("a"), F.greatest("cls", "h").alias("b")).distinct()
               .join(done, ["a", "b"], "left_anti"))
        theirs = parity.select(F.col("cls").alias("b"), F.col("n").alias("hn"), F.col("bits").alias("hbits"))
        pairs = stored(met.join(parity.withColumnRenamed("cls", "a"), "a").join(theirs, "b").select("a", "b", "n", "hn", "bits", "hbits")
                       .mapInArrow(may_link(percent), "a long, b long"), "pairs")
        ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "pair-classes")
        held = spark.sparkContext.broadcast(bitmap(ends, "cls"))
        own_texts = (texts.mapInArrow(set_texts(n, held), "cls long, text string").groupBy("cls").agg(F.min("text").alias("text"))
                     .join(ends, "cls", "left_semi"))
        own_texts = stored(own_texts, "pair-texts")
        judged = stored(pairs.join(own_texts.withColumnRenamed("cls", "a"), "a")
                        .join(own_texts.select(F.col("cls").alias("b"), F.col("text").alias("other")), "b")
                        .select("a", "b", "text", "other").mapInArrow(compared(n, percent), "a long, b long, link boolean"), "judged")
        groups = components(groups.toDF("a", "b").union(judged.filter("link").select("a", "b")))
        done = done.union(judged.filter("not link").select("a", "b"))
        used = chosen.select("gram", F.col("h").alias("cls"), F.lit(True).alias("used"))
        left = (now.select("gram", "cls", "n", "place", "known", "hub").join(used, ["gram", "cls"], "left")
                .select("gram", "cls", "n", "place", "known", (F.col("hub") | F.coalesce("used", F.lit(False))).alias("hub")))
        hubs *= ROUND


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """Per row: id, row (a hash of the text), n_grams, group (a number per group, null without words), group_id."""
    spark = prepared(docs.sparkSession)
    rows = keyed(docs, doc_id, text)
    found = stored(rows.select("id", "row", "text").mapInArrow(sketch(n), SETS), "gram-sets")
    sets = found.filter("chunk is null").select("id", "row", "n", "cls")
    chunks = found.filter("chunk is not null").select("chunk", "counters").repartition(1 << (COUNTERS - CHUNK), "chunk")
    levels = np.full(1 << COUNTERS, 0, np.uint8)
    for r in chunks.mapInArrow(folded, "chunk int, levels binary").collect():  # 2^COUNTERS bytes
        levels[r["chunk"] << CHUNK : (r["chunk"] + 1) << CHUNK] = np.frombuffer(r["levels"], np.uint8)
    sizes = {r["n"]: r["count"] for r in sets.filter(f"n > 0 and n < {HISTOGRAM}").groupBy("cls", "n").agg(F.lit(1)).groupBy("n").count().collect()}
    small = boundary(sizes, percent)
    held = spark.sparkContext.broadcast(levels)

    whole = rows.select("text")
    by_key = stored(whole.mapInArrow(keys(n, percent, small), "key long, cls long, lesser boolean").distinct(), "subset-keys")
    hub = by_key.groupBy("key").agg(F.min(F.when(F.col("lesser"), F.col("cls"))).alias("hub"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    hub = hub.filter("hub is not null and lo <> hi").select("key", "hub")
    small_links = by_key.join(hub, "key").filter("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()

    entries = whole.mapInArrow(lists(n, percent, small, held), "gram long, cls long, n long, place long, known long")
    parity = stored(found.filter("chunk is null and n > 0").groupBy("cls").agg(F.max("n").alias("n"), F.max("bits").alias("bits")), "parities")
    groups = merged(whole, entries, parity, small_links, n, percent)
    grouped = sets.join(groups, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    grouped = grouped.select("id", "row", "n", F.when(F.col("n") > 0, F.col("root")).alias("root"))
    least = grouped.filter("root is not null").groupBy(F.col("root").alias("their_root")).agg(F.min("id").alias("least"))
    return (grouped.join(least, F.col("root") == F.col("their_root"), "left")
            .select("id", "row", F.col("n").alias("n_grams"), F.col("root").alias("group"),
                    F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("group_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, as they are, one of each group: that of the least id. Texts without words all stay."""
    found = jaccard_groups(docs, doc_id, text, n, percent)
    rows = stored(found.groupBy("id", "row", "group").agg(F.count("*").alias("times")), "grouped-rows")
    stays = rows.filter("group is not null").groupBy(F.col("group").alias("theirs")).agg(F.min(F.struct("id", "row")).alias("stays"))
    kept = (rows.join(stays, F.col("group") == F.col("theirs"), "left")
            .filter(F.col("group").isNull() | (F.struct("id", "row") == F.col("stays")))
            .select("id", "row", (F.col("group").isNotNull() & (F.col("times") > 1)).alias("again")))
    # The documents' own columns may have the keys' names.
    doc = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    joined = docs.join(kept, same_row(docs, kept, doc_id, text)).select(doc, *[kept[c].alias(f"kept_{c}") for c in kept.columns])
    alone = joined.filter(~F.col("kept_again")).select("doc.*")
    repeated = joined.filter("kept_again").dropDuplicates(["kept_id", "kept_row"]).select("doc.*")
    return alone.union(repeated)
