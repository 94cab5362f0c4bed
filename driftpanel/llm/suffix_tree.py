"""Language-model scoring with a probabilistic suffix tree over words.

Training counts every token (words, then one end per text) and every string of two and
more words. Any context that occurs is a candidate, however rare, up to `depth` words. A
context passes one of each follower's occurrences on to its own suffix (absolute
discounting), down to add-one counts of single tokens:

    p(w | c) = (n(cw) - 1) / n(c) + kinds(c) / n(c) * p(w | suffix of c)

A context stays if that explains what follows it better than its suffix does, per
occurrence and in total; the suffixes of a state stay with it. A token is scored in the
longest suffix state of what stands before it.

Two things follow, so that nothing is left out that could count. A string seen once adds
nothing of its own, and the number of those follows from the other counts. A context seen n
times whose suffix is seen m times gains at most n * log(1 + m / n), so longer strings are
counted only after contexts for which this reaches `evidence`.

A text's score is a sum over its strings of one, two, ... words, each with one value. The
workers hold the values of the most frequent strings, at most `most_held` of each length;
those of all others meet the texts by string. Bitmaps of fixed size only leave out rows
before that.

Strings travel as arrays, a row for each bucket of their hashes; a bucket has a partition of its own, and there are as many
as about BUCKET training tokens each make. Equal strings of a task travel once, so no
bucket grows with the copies of a string.

Null texts read as empty: one token, the end. A null id belongs to the training texts.
Repeated rows give repeated results, all of them counted. With nothing to learn from
every token has the same probability, one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpanel.llm import textscan as ts
from driftpanel.llm.bitmap import large_bitmap, may_hold
from driftpanel.llm.common import dropped, lean, prepared, stored
from driftpanel.llm.lookup import Lookup

U = np.uint64
END = U(0xE7D1A3B5C96F8421)
SYMBOL_BITS = 20
COUNT = "key long, n long"
HELD = 3 << 19  # entries a task gathers before it sends them on
SLICE = 1 << 18  # bytes of text a task looks at together
SENT_AT_ONCE = 4 << 20  # bytes of a batch between Spark and its workers
BUCKET = 1 << 20  # training tokens to a bucket of strings
MANY = 27  # bits of the bitmaps of strings: 16 MB
# Workers live on from stage to stage. Large arrays go back to the machine once they are freed;
# small ones, of a slice of text, are used again.
WORKERS = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Functions made within it run in workers that keep little of what they freed, and get batches of bounded size."""
    settings = spark.sparkContext.environment
    before = dict(settings)
    settings.update(WORKERS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SENT_AT_ONCE))
    try:
        yield
    finally:
        settings.clear()
        settings.update(before)


def looked_up(unique: DataFrame) -> DataFrame:
    """The side of a join that tasks hold: its keys are unique, so hot ones don't add to it, and no side is sorted."""
    return unique.hint("shuffle_hash")


@dataclass(frozen=True)
class Shape:
    """Tests of the tree, and which strings the workers may hold."""

    depth: int = 2
    least_context: float = 0.0  # not looked at: contexts of any share are candidates
    least_string: float = 0.0  # share of all tokens from which a string may be held
    most_held: int = 1 << 19  # strings of a length that are held
    divergence: float = 0.005  # nats per occurrence
    evidence: float = 20.0  # nats over all occurrences


@dataclass
class Tree:
    """What the workers hold of the frequent strings."""

    tokens: int = 0
    distinct: int = 0
    frequent: Lookup | None = None
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    states: list = field(default_factory=list)  # escape mass by token, NaN where no state
    strings: list = field(default_factory=list)  # (Lookup, probability): of (token, token) by number, then by hash
    values: list = field(default_factory=list)  # what a string of one, two, ... words adds to a score
    may_add: np.ndarray | None = None  # bitmap of longer strings that are not held


def words_of(batch: pa.RecordBatch) -> ts.Words:
    return ts.words(*ts.utf8(batch.column("text")), ts.SPACED)


def tokens_of(found: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, one end after each text's words, and the first token of each text."""
    n = len(found.first) - 1
    first = found.first + np.arange(n + 1)
    out = np.full(int(first[-1]), END, U)
    out[np.arange(len(found.hashes)) + found.rows] = found.hashes
    return out, first


def joined_key(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The hash of a string, from those of all but its last and all but its first word."""
    return ts.mix(ts.mix(context) + suffix)


def strings_of(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the `n` tokens that end at each token; of no meaning where a text has fewer so far."""
    keys = tokens
    for _ in range(n - 1):
        keys = np.concatenate([keys[:1], joined_key(keys[:-1], keys[1:])])
    return keys


def places(first: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def summed(keys: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of equal keys as one; the last column is added up."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    del keys
    n = columns[-1][order]
    order = order[begin]
    return [*[c[order] for c in columns[:-1]], np.add.reduceat(n, begin) if len(begin) else n]


def joined(found: list[list[np.ndarray]]) -> list[np.ndarray]:
    """All pieces' columns as one; the pieces are given up column by column."""
    out = []
    for k in range(len(found[0])):
        out.append(np.concatenate([piece[k] for piece in found]))
        for piece in found:
            piece[k] = None
    return out


def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SENT_AT_ONCE bytes, one row at least."""
    rows = max(1, batch.num_rows * SENT_AT_ONCE // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def counted(emit: Callable[[pa.RecordBatch], list[np.ndarray]], key: Callable, send: Callable[[list[np.ndarray]], pa.RecordBatch]) -> Callable:
    """How often each key stands in a task's texts, gathered in bounded pieces.

    `emit` gives the columns that a `key` is made of, `send` makes rows of these and the counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def whole() -> list[np.ndarray]:
            columns = joined(found)
            found.clear()
            return summed(key(*columns[:-1]), columns)

        for batch in ts.slices(batches, "text", SLICE):
            columns = emit(batch)
            found.append([*columns, np.ones(len(columns[0]), np.int32)])
            held += len(columns[0])
            if held > HELD:
                found.append(whole())
                held = len(found[0][0])
                if held > HELD // 2:
                    yield from in_parts(send(found.pop()))
                    held = 0
        if held:
            yield from in_parts(send(whole()))

    return run


def token_counts(train: DataFrame) -> DataFrame:
    run = counted(lambda b: [tokens_of(words_of(b))[0]], lambda key: key,
                  lambda c: pa.RecordBatch.from_arrays([pa.array(ts.signed(c[0])), pa.array(c[1].astype(np.int64))], ["key", "n"]))
    return train.mapInArrow(run, COUNT).groupBy("key").agg(F.sum("n").alias("n"))


def bucketed(keys: np.ndarray, columns: list[np.ndarray], names: list[str], buckets: int) -> pa.RecordBatch:
    """A row for each bucket of the keys, with the columns as arrays, ordered by the first one."""
    bucket = ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(columns[0])
    order = order[np.argsort(bucket[order], kind="stable")]
    first = np.searchsorted(bucket[order], np.arange(buckets + 1))
    there = np.flatnonzero(np.diff(first))
    bounds = np.concatenate([first[there], first[-1:]])
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *[ts.list_column(c[order], bounds) for c in columns]], ["bucket", *names])


def gathered(table: pa.Table, name: str) -> np.ndarray:
    """All elements of an array column."""
    parts = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in table.column(name).chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def pieces(table: pa.Table, name: str, rows: np.ndarray) -> list[np.ndarray]:
    """The arrays of an array column in these rows, not copied."""
    column = table.column(name)
    return [column[int(i)].values.to_numpy(zero_copy_only=False) for i in rows]


def by_bucket(rows: DataFrame, buckets: int):
    """Groups of a bucket, each in a partition of its own, so that no task holds several."""
    return rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket")


def followed(n: int, buckets: int, allowed: tuple = ()) -> Callable:
    """Counts of strings of `n` tokens by bucket, with their context and suffix, where bitmaps allow these."""

    def emit(batch: pa.RecordBatch) -> list[np.ndarray]:
        tokens, first = tokens_of(words_of(batch))
        shorter = strings_of(tokens, n - 1)
        at = np.flatnonzero(places(first) >= n - 1)
        if allowed:
            at = at[may_hold(allowed[0].value, shorter[at - 1])]
            at = at[may_hold(allowed[1].value, shorter[at])]
        return [shorter[at - 1], shorter[at]]

    def send(columns: list[np.ndarray]) -> pa.RecordBatch:
        context, suffix, times = columns
        return bucketed(joined_key(context, suffix), [ts.signed(context), ts.signed(suffix), times.astype(np.int32)], ["context", "suffix", "n"], buckets)

    return counted(emit, joined_key, send)


def repeated_strings(train: DataFrame, n: int, buckets: int, allowed: tuple) -> DataFrame:
    """Strings of `n` tokens seen twice and more."""

    def total(table: pa.Table) -> pa.Table:
        context, suffix = (gathered(table, c).view(U) for c in ("context", "suffix"))
        context, suffix, times = summed(joined_key(context, suffix), [context, suffix, gathered(table, "n").astype(np.int64)])
        twice = times >= 2
        context, suffix, times = context[twice], suffix[twice], times[twice]
        return pa.table({"key": ts.signed(joined_key(context, suffix)), "context": ts.signed(context), "suffix": ts.signed(suffix), "n": times})

    found = train.mapInArrow(followed(n, buckets, allowed), "bucket int, context array<long>, suffix array<long>, n array<int>")
    return by_bucket(found, buckets).applyInArrow(total, "key long, context long, suffix long, n long")


def level(strings: DataFrame, contexts: DataFrame, suffixes: DataFrame, shape: Shape, name: str) -> tuple[DataFrame, DataFrame]:
    """Strings with the probability of their last word and what it adds to the passed on one, and their contexts.

    `contexts` and `suffixes` have (key, n) and (key, p, n) of what is one word shorter.
    """
    strings = stored(strings, f"repeated-{name}")
    sizes = looked_up(strings.groupBy("context").agg(F.sum("n").alias("n_twice"), F.count("*").alias("kinds"))).join(
        contexts.select(F.col("key").alias("context"), F.col("n").alias("n_context")), "context")
    sizes = stored(sizes.select("context", "n_context", (
        (F.col("kinds") + F.col("n_context") - F.col("n_twice")) / F.col("n_context")).alias("escape")), f"sizes-{name}")
    above = suffixes.select(F.col("key").alias("suffix"), F.col("p").alias("p_above"), F.col("n").alias("n_suffix"))
    most = F.col("n") * F.log1p(F.col("n_suffix") / F.col("n"))
    read = strings.join(looked_up(above), "suffix").join(looked_up(sizes), "context").withColumn("passed_on", F.col("escape") * F.col("p_above")).withColumn(
        "p", (F.col("n") - 1) / F.col("n_context") + F.col("passed_on"))
    found = stored(read.select("key", "context", "suffix", "n", "p", F.log10(F.col("p") / F.col("passed_on")).alias("own"),
                               (most >= shape.evidence - 1e-6).alias("leads_on")), name)
    dropped(strings)
    # The sum over all followers of n log(p / p_above): strings seen once have p = escape * p_above.
    gain = F.col("owns") * F.log(F.lit(10.0)) + F.col("n_context") * F.log("escape")
    tested = found.groupBy("context").agg(F.sum(F.col("n") * F.col("own")).alias("owns")).join(looked_up(sizes), "context").select(
        F.col("context").alias("state"), "escape", ((gain >= shape.evidence) & (gain >= shape.divergence * F.col("n_context"))).alias("passes"))
    tested = stored(tested, f"contexts-{name}")
    dropped(sizes)
    return found, tested


def trained(train: DataFrame, shape: Shape) -> tuple[float, int, DataFrame, list[DataFrame], list[DataFrame]]:
    """All tokens, distinct ones, the tokens' counts, strings by length from two on, states by length from one on."""
    broadcast = train.sparkSession.sparkContext.broadcast
    counts = stored(token_counts(train), "token-counts")
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = int(total[0] or 0), int(total[1])
    contexts = suffixes = counts.withColumn("p", (F.col("n") + 1) / F.lit(float(tokens + distinct + 1)))
    levels, tests, allowed = [], [], ()
    for d in range(shape.depth):
        strings = repeated_strings(train, d + 2, buckets_of(tokens), allowed)
        suffixes, tested = level(strings, contexts, suffixes, shape, f"strings-{d + 2}")
        for bits in allowed:  # the strings are written
            bits.destroy()
        levels.append(suffixes)
        tests.append(tested)
        if d + 1 < shape.depth:
            contexts = suffixes.filter("leads_on")
            allowed = broadcast(large_bitmap(contexts, "key", MANY)), broadcast(large_bitmap(suffixes, "key", MANY))
    states: list[DataFrame] = []
    for found, here in zip(reversed(levels), reversed(tests), strict=True):
        if states:  # the suffixes of longer states stay
            longer = states[0].select(F.col("state").alias("key"))
            stays = found.join(looked_up(longer), "key", "left_semi").select(F.col("suffix").alias("state"), F.lit(True).alias("stays")).distinct()
            here = here.join(looked_up(stays), "state", "left").filter("passes or stays")
        states.insert(0, stored(here.filter("passes") if not states else here, f"states-{len(states)}").select("state", "escape"))
    return tokens, distinct, counts, levels, states


def buckets_of(tokens: int) -> int:
    return 1 + tokens // BUCKET


def thresholds(tokens: int, counts: DataFrame, levels: list[DataFrame], shape: Shape) -> list[int]:
    """How often a string of each length must occur to be held; a held string's words are held, too."""
    out, least = [], max(1, int(np.ceil(shape.least_string * tokens)))
    for rows in [counts, *levels]:
        # Counts in steps of an eighth of a doubling.
        step = F.ceil(F.log2("n") * 8)
        sizes = sorted(rows.groupBy(step.alias("step")).count().collect(), reverse=True)
        held = 0
        for at, n in sizes:
            held += n
            if held > shape.most_held:
                # This step and those below stay out.
                least = max(least, int(2 ** (at / 8)) + 1)
                break
        out.append(least)
    return out


def values_of(counts: DataFrame, levels: list[DataFrame], states: list[DataFrame], often: list[int]) -> list[DataFrame]:
    """(key, n, base, score) by length: what a string adds to what a text's unseen tokens score.

    A string brings in the probability of its last word, if its context is a state, and what
    passes on to shorter ones behind it, if it is a state itself. Of strings that are held
    (`often`), context, suffix and p are told as well.
    """
    def passed_on(strings: DataFrame, to: DataFrame | None) -> DataFrame:
        if to is None:
            return strings.withColumn("behind", F.lit(0.0))
        behind = to.select(F.col("state").alias("key"), F.log10("escape").alias("behind"))
        return strings.join(looked_up(behind), "key", "left").fillna(0.0, ["behind"])

    base = F.log10(F.col("n") + 1)
    out = [passed_on(counts, states[0] if states else None).select("key", "n", base.alias("base"), (base + F.col("behind")).alias("score"))]
    for d, found in enumerate(levels):
        here = states[d].select(F.col("state").alias("context"), F.lit(True).alias("used"))
        strings = passed_on(found.join(looked_up(here), "context", "left"), states[d + 1] if d + 1 < len(states) else None)
        own = F.when(F.col("used"), F.col("own")).otherwise(0.0)
        held = [F.when(F.col("n") >= often[d + 1], F.col(c)).alias(c) for c in ("context", "suffix", "p")]
        # What adds nothing is left out.
        out.append(strings.select("key", "n", F.lit(0.0).alias("base"), (own + F.col("behind")).alias("score"), *held).filter("score != 0"))
    return [stored(rows, f"values-{d + 1}") for d, rows in enumerate(out)]


def held_by_workers(tokens: int, distinct: int, values: list[DataFrame], states: list[DataFrame], often: list[int]) -> Tree:
    """The values of strings that occur `often`."""
    tree = Tree(tokens, distinct)
    held = [rows.filter(F.col("n") >= n) for rows, n in zip(values, often, strict=True)]
    frequent = held[0].toArrow().sort_by("key")
    assert len(frequent) < 1 << SYMBOL_BITS
    keys = frequent["key"].to_numpy()
    tree.frequent, tree.counts = Lookup(keys.view(U)), frequent["n"].to_numpy()
    tree.values.append(frequent["score"].to_numpy() - frequent["base"].to_numpy())
    for d, strings in enumerate(held[1:]):
        rows = strings.toArrow()
        key = rows["key"].to_numpy().view(U)
        if d == 0:  # by the tokens' numbers
            context, suffix = (tree.frequent(rows[c].to_numpy().view(U)).astype(np.int64) for c in ("context", "suffix"))
            key = ((context << SYMBOL_BITS) | suffix).view(U)
            escape = np.full(len(keys), np.nan)
            found = states[0].join(held[0].select(F.col("key").alias("state")), "state").toArrow()
            escape[tree.frequent(found["state"].to_numpy().view(U))] = found["escape"].to_numpy()
            tree.states.append(escape)
        tree.strings.append((Lookup(key), rows["p"].to_numpy()))
        tree.values.append(rows["score"].to_numpy())
    pa.default_memory_pool().release_unused()
    return tree


def planted(train: DataFrame, shape: Shape) -> tuple[Tree, DataFrame, list[DataFrame], list[int]]:
    """What the workers hold of the tree, the counts of all tokens, the values of all strings, and how often held ones occur."""
    tokens, distinct, counts, levels, states = trained(train, shape)
    often = thresholds(tokens, counts, levels, shape)
    values = values_of(counts, levels, states, often)
    dropped(*levels)
    return held_by_workers(tokens, distinct, values, states, often), counts, values, often


def grown(train: DataFrame, shape: Shape) -> tuple[Tree, DataFrame]:
    """What the workers hold of the tree, and the counts of all tokens."""
    return planted(train, shape)[:2]


# Of a text, what the strings held add; or, without tokens, what other strings add to the texts of a row hash.
PART = [("id", pa.int64()), ("row", pa.int64()), ("no_id", pa.bool_()), ("held_out", pa.bool_()), ("tokens", pa.int64()),
        ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
# The same as arrays, and with other strings: those of texts (with `times`) and what one adds (without).
TOLD = pa.schema([("bucket", pa.int32()), *[(n, pa.list_(t)) for n, t in PART]])
SENT = pa.schema([*TOLD, ("key", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def spark_schema(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{f.name} array<{names[f.type.value_type]}>" if pa.types.is_list(f.type) else f"{f.name} {names[f.type]}" for f in schema)


def with_nulls(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with all columns of the schema."""
    there = set(batch.schema.names)
    return pa.RecordBatch.from_arrays(
        [batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def scorer(held, buckets: int) -> Callable:
    """The texts with what the strings held add, and by bucket the other strings that may add something."""

    def sent(rare: list) -> pa.RecordBatch:
        keys, *columns = (np.concatenate(c) for c in zip(*rare, strict=True))
        return with_nulls(bucketed(keys, [*columns, ts.signed(keys)], ["row", "times", "key"], buckets), SENT)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        unseen = -np.log10(tree.tokens + tree.distinct + 1)
        root = unseen + np.log10(tree.counts + 1)
        rare, waiting = [], 0
        for batch in ts.slices(batches, "text", SLICE):
            found = words_of(batch)
            ids, held_out = batch.column("id").cast(pa.int64()), batch.column("held_out")
            no_id, ids = ids.is_null(), ids.fill_null(0)
            id_, flags = ids.to_numpy(), 2 * no_id.cast(pa.uint64()).to_numpy() + held_out.cast(pa.uint64()).to_numpy()
            # Texts that differ in case alone have the same strings.
            row = ts.mix(found.span_hash(found.offsets[:-1], found.offsets[1:]) + ts.mix(ts.mix(id_.view(U)) + flags))
            tokens, first = tokens_of(found)
            n, place = len(first) - 1, places(first)
            rows_of = np.repeat(np.arange(n), np.diff(first))
            symbol = tree.frequent(tokens)
            often = symbol >= 0
            base = np.full(len(tokens), unseen)
            base[often] = root[symbol[often]]
            score = base.copy()
            score[often] += tree.values[0][symbol[often]]
            at = np.flatnonzero(~often)
            at = at[may_hold(tree.may_add, tokens[at])]
            rare_rows, rare_keys = [rows_of[at]], [tokens[at]]
            keys = tokens
            for d, ((strings, _), value) in enumerate(zip(tree.strings, tree.values[1:], strict=True)):
                keys = np.concatenate([keys[:1], joined_key(keys[:-1], keys[1:])])
                at = np.flatnonzero(place > d)
                if d == 0:
                    known = np.full(len(at), -1, np.int32)
                    both = np.flatnonzero(often[at] & often[at - 1])
                    known[both] = strings(((symbol[at[both] - 1].astype(np.int64) << SYMBOL_BITS) | symbol[at[both]]).view(U))
                else:
                    known = strings(keys[at])
                score[at[known >= 0]] += value[known[known >= 0]]
                at = at[known < 0]
                at = at[may_hold(tree.may_add, keys[at])]
                rare_rows.append(rows_of[at])
                rare_keys.append(keys[at])
            add = lambda x: np.add.reduceat(x, first[:-1]) if n else np.zeros(0)  # noqa: E731  no text is without its end
            # These texts stay together, in any one bucket.
            at, one = pa.array([int(row[0] % U(buckets))]), pa.array([0, n], pa.int32())
            whole = [ids, pa.array(ts.signed(row)), no_id, held_out, pa.array(np.diff(first)), pa.array(add(often.astype(np.int64))),
                     pa.array(add(base)), pa.array(add(score))]
            yield with_nulls(pa.RecordBatch.from_arrays([at, *[pa.ListArray.from_arrays(one, c) for c in whole]], ["bucket", *[c for c, _ in PART]]), SENT)
            rows, keys = np.concatenate(rare_rows), np.concatenate(rare_keys)
            if not len(rows):
                continue
            order = np.argsort(keys)
            order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")]
            rows, keys = rows[order], keys[order]
            begin = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]))
            times = np.diff(np.concatenate([begin, [len(rows)]])).astype(np.int32)
            rows = rows[begin]
            rare.append([keys[begin], ts.signed(row)[rows], times])
            waiting += len(rows)
            if waiting > HELD // 4:
                yield from in_parts(sent(rare))
                rare, waiting = [], 0
        if rare:
            yield from in_parts(sent(rare))

    return scan


def adding(buckets: int) -> Callable:
    """By bucket, what strings add that are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            found.append([batch.column(c).to_numpy() for c in ("key", "base", "score")])
            held += batch.num_rows
            if held > HELD // 4:
                yield from in_parts(sent(found))
                found, held = [], 0
        if held:
            yield from in_parts(sent(found))

    def sent(found: list) -> pa.RecordBatch:
        keys, base, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return with_nulls(bucketed(keys.view(U), [keys, base, score], ["key", "base", "score"], buckets), SENT)

    return run


def meeting(buckets: int) -> Callable:
    """From a bucket of strings, by bucket of texts: the texts that stood there, and what its strings add to texts."""

    def told(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        row = columns["row"]
        return with_nulls(bucketed(row.view(U), [row, *[c for n, c in columns.items() if n != "row"]],
                                   ["row", *[n for n in columns if n != "row"]], buckets), TOLD)

    def met(table: pa.Table) -> pa.Table:
        texts, strings = (np.flatnonzero(table.column(c).is_valid().to_numpy()) for c in ("tokens", "times"))
        values = np.setdiff1d(np.arange(len(table)), np.concatenate([texts, strings]))
        out = [told({name: np.concatenate(pieces(table, name, texts)) for name, _ in PART})] if len(texts) else []
        if not len(strings) or not len(values):
            return pa.Table.from_batches(out, TOLD)
        keys, base, score = (np.concatenate(pieces(table, c, values)) for c in ("key", "base", "score"))
        known, sums = Lookup(keys.view(U)), []
        # One array after the other: they make up most of a bucket.
        for row, wanted, times in zip(*(pieces(table, c, strings) for c in ("row", "key", "times")), strict=True):
            at = known(wanted.view(U))
            hit = np.flatnonzero(at >= 0)
            if len(hit):
                at, row, times = at[hit], row[hit], times[hit]
                # They are in order of the texts.
                begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                # Only tokens have a base.
                added = (times * (base[at] > 0).astype(np.int64), times * base[at], times * score[at])
                sums.append([row[begin], *[np.add.reduceat(x, begin) for x in added]])
        if sums:
            out.append(told(dict(zip(("row", "known", "base", "score"), (np.concatenate(c) for c in zip(*sums, strict=True)), strict=True))))
        return pa.Table.from_batches(out, TOLD)

    return met


def closed(table: pa.Table) -> pa.Table:
    """The texts of a bucket, with all that strings add to them."""
    texts, sums = table.filter(pc.is_valid(table["tokens"])), table.filter(pc.is_null(table["tokens"]))
    rows, which, copies = np.unique(gathered(texts, "row"), return_inverse=True, return_counts=True)
    at = np.searchsorted(rows, gathered(sums, "row"))

    def whole(name: str) -> np.ndarray:
        # Each of equal rows has sent its strings, so their sums hold them as often.
        return gathered(texts, name) + (np.bincount(at, gathered(sums, name), len(rows)) / copies)[which]

    return pa.table({"id": pa.array(gathered(texts, "id"), mask=gathered(texts, "no_id").astype(bool)), "held_out": gathered(texts, "held_out").astype(bool),
                     "tokens": gathered(texts, "tokens"), "known": np.rint(whole("known")).astype(np.int64),
                     "base": whole("base"), "score": whole("score")})


def suffix_tree_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: str | None = None,
                       shape: Shape = Shape()) -> DataFrame:
    """Scores of all texts; those with a true `held_out` column are not learnt from.

    Without such a column, texts with crc32(id as text) mod 7 = 2 are held out.
    """
    spark = prepared(docs.sparkSession)
    out = docs[held_out] if held_out else F.crc32(docs[doc_id].cast("string")) % 7 == 2
    named = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"), F.coalesce(out, F.lit(False)).alias("held_out"))
    with frugal(spark):
        with lean(spark):
            tree, _, values, often = planted(named.filter(~F.col("held_out")).select("text"), shape)
            rest = reduce(DataFrame.unionByName, [rows.filter(F.col("n") < n).select("key", "base", "score") for rows, n in zip(values, often, strict=True)])
            tree.may_add = large_bitmap(rest, "key", MANY)
        # Half as many buckets as for counting, so that a text's strings stand together in them.
        buckets, sent = buckets_of(tree.tokens // 2), spark_schema(SENT)
        parts = named.mapInArrow(scorer(spark.sparkContext.broadcast(tree), buckets), sent).union(rest.mapInArrow(adding(buckets), sent))
        met = by_bucket(parts, buckets).applyInArrow(meeting(buckets), spark_schema(TOLD))
        scores = by_bucket(met, buckets).applyInArrow(
            closed, "id long, held_out boolean, tokens long, known long, base double, score double")
    return scores.select(
        F.col("id").alias(doc_id), "held_out", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(tree.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
