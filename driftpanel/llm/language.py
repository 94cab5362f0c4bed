"""Language identification by fusing evidence.

Declarations are read by their first subtag in lower case, so `en`, `EN` and `en-US` are
one language; what isn't of two or three letters declares nothing.

A text's likelihood comes from byte trigrams counted per language in a bounded sample: of
each of the LANGUAGES most declared languages (the lesser tag first where as many rows
declare them) all different rows, or if there are more, those with the least hashes, about
SAMPLE. A rare language thus is a candidate like any other. What a language's sample hasn't
got comes from all languages' trigrams, in the same share for all, so that small samples
don't attract strange texts. What declarations are worth, P(declared | language), how
languages divide on an address suffix, and each host's prior, smoothed towards its domain's
and that towards all rows', are grouped aggregates over all rows, counting what the text
alone says. The posterior is their product; of equal ones the least language wins. A row is
rejected if nothing can be said about it: no letters, mostly trigrams that no language has,
or no language above LEAST.

Null and empty texts are rejected. A null declaration or address is no evidence.
Addresses may be URLs, host names or any name of a source. If no row declares a
language, there is nothing to learn from: rows with letters are kept, without a language.
Repeated rows give repeated results. Of a very long text all trigrams count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpanel.llm import textscan as ts
from driftpanel.llm.common import prepared, stored

SAMPLE = 1000  # different rows of each language, about
LANGUAGES = 256  # a quarter of a megabyte each, at every worker
BITS = 16  # of the trigram table
GRAMS = 200  # a text counts as so many independent trigrams at most
SMOOTH = 0.05  # added to the counts of all languages together
SHARED = 0.1  # share of all languages' trigrams in each language's
HOST_WEIGHT = 20.0  # rows that the level above is worth
LEAST = 0.5
KNOWN = 0.5  # share of trigrams that some language has

LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)

Arrow = Iterator[pa.RecordBatch]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter trigrams, single spaces at word ends included, and their bounds by row."""
    letters = LETTER[data]
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    ok = ((a != 32) & (b != 32)) | ((b != 32) & (c != 32))
    for cut in (1, 2):  # not over the end of a row
        edge = offsets - cut
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    at = np.flatnonzero(ok)
    code = (a[at].astype(np.uint32) << 16) | (b[at].astype(np.uint32) << 8) | c[at]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return code.astype(np.int64), np.searchsorted(at, offsets)


@dataclass
class Model:
    """Log-likelihoods by trigram and language; bounded by the table's size."""

    languages: list[str]
    table: np.ndarray
    known: np.ndarray

    def likelihood(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows x languages, tempered; the number of trigrams; the share that is known."""
        data, offsets = ts.utf8(text)
        code, bounds = trigrams(data, offsets)
        n = np.diff(bounds)
        weight = np.minimum(1.0, GRAMS / np.maximum(n, 1))
        total = np.zeros((len(n), len(self.languages)))
        for k in range(len(self.languages)):
            run = np.concatenate([[0.0], np.cumsum(self.table[k][code], dtype=float)])
            total[:, k] = (run[bounds[1:]] - run[bounds[:-1]]) * weight
        return total, n, ts.sums(self.known[code], bounds) / np.maximum(n, 1)


def shares(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def tag_of(declared: Column) -> Column:
    """The language that a declaration names, null where it names none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def fitted(rows: DataFrame) -> Model:
    """rows has (id, text, tag)."""
    tagged = rows.filter("tag is not null").select(F.xxhash64("id", "text").alias("h"), "tag", "text")
    # Only hashes are shuffled; the texts stay where they are. Tags are few, as they are so short.
    different = tagged.select("tag", "h").distinct().groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(LANGUAGES).collect()
    if not different:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(1 << BITS, bool))
    shares = F.create_map(*[F.lit(x) for r in different for x in (r["tag"], min(1.0, SAMPLE / r["count"]))])
    # A language's hashes are spread evenly over 2^32 values.
    least = F.pmod(F.xxhash64("h"), F.lit(1 << 32)) < F.element_at(shares, F.col("tag")) * (1 << 32)
    sample = tagged.filter(least).groupBy("tag", "h").agg(F.min("text").alias("text"))

    def count(batches: Arrow) -> Arrow:
        for batch in ts.slices(batches, "text"):
            code, bounds = trigrams(*ts.utf8(batch.column("text")))
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            key, n = np.unique((row << BITS) | code, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column("tag").take(pa.array(key >> BITS)), pa.array(key & ((1 << BITS) - 1)),
                                              pa.array(n)], ["tag", "code", "n"])

    counts = (sample.select("tag", "text").mapInArrow(count, "tag string, code long, n long")
              .groupBy("tag", "code").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(r["tag"] for r in different)
    n = np.zeros((len(languages), 1 << BITS))
    place = {language: k for k, language in enumerate(languages)}
    n[counts["tag"].map(place).to_numpy(np.int64), counts["code"].to_numpy(np.int64)] = counts["n"]
    return Model(languages, log_shares(n).astype(np.float32), n.sum(axis=0) > 0)


def log_shares(n: np.ndarray) -> np.ndarray:
    """log P(trigram | language) from counts by language and trigram."""
    every = n.sum(axis=0) + SMOOTH
    own = n / np.maximum(n.sum(axis=1, keepdims=True), 1)
    return np.log((1 - SHARED) * own + SHARED * every / every.sum())


def host_of(address: Column) -> Column:
    """The host of a URL, else the address itself, in lower case."""
    rest = F.regexp_replace(F.lower(address), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(rest, r"[/?#].*$", ""), r"^[^@]*@|:[0-9]*$", "")


def places(address: Column) -> list[Column]:
    host = host_of(address)
    dotted = F.contains(host, F.lit("."))
    return [host.alias("host"), F.when(dotted, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(host).alias("domain"),
            F.when(dotted, F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix")]


@dataclass
class Evidence:
    """Small tables of all rows: by language alone, by declaration, and one row per host."""

    overall: np.ndarray
    declared: np.ndarray  # language x declared language: log P(declared | language)
    hosts: DataFrame  # host, prior: log P(language | host) with the suffix's part


def gathered(rows: DataFrame, model: Model, held) -> Evidence:
    """rows has (text, tag, host, domain, suffix)."""
    size = len(model.languages)

    def by_text(batches: Arrow) -> Arrow:
        for batch in ts.slices(batches, "text"):
            log, n, _ = held.value.likelihood(batch.column("text"))
            p = np.where(n[:, None] > 0, shares(log), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("declared", "host", "domain", "suffix")),
                                              *(pa.array(p[:, k].copy()) for k in range(size))],
                                             ["declared", "host", "domain", "suffix", *(f"p{k}" for k in range(size))])

    kind = "declared string, host string, domain string, suffix string, " + ", ".join(f"p{k} double" for k in range(size))
    # One row per host and declaration of a known language: few, whatever the rows.
    known = F.when(F.col("tag").isin(model.languages), F.col("tag"))
    p = [f"p{k}" for k in range(size)]
    cells = stored(rows.select("text", known.alias("declared"), "host", "domain", "suffix").mapInArrow(by_text, kind)
                   .groupBy("declared", "host", "domain", "suffix").agg(*[F.sum(x).alias(x) for x in p]), "language-cells")
    sums = [F.sum(x).alias(x) for x in p]
    declared = {r[0]: np.array(r[1:], float) for r in cells.groupBy("declared").agg(*sums).collect()}
    overall = sum(declared.values(), np.zeros(size)) + 1.0
    overall /= overall.sum()
    confusion = np.array([declared.get(x, np.zeros(size)) for x in model.languages]).T + 0.5
    confusion = np.log(confusion / confusion.sum(axis=1, keepdims=True))
    top = F.array(*[F.lit(float(x)) for x in overall])

    def level(keys: list[str]) -> DataFrame:
        return cells.groupBy(*keys).agg(F.array(*[F.sum(x) for x in p]).alias("n_" + keys[0]))

    def toward(counts: Column, above: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v)
        return F.zip_with(counts, above, lambda n, q: (n + HOST_WEIGHT * q) / (total + HOST_WEIGHT))

    hosts = (level(["host", "domain", "suffix"]).join(level(["domain"]), "domain").join(level(["suffix"]), "suffix", "left")
             .withColumn("by_domain", toward(F.col("n_domain"), top))
             .withColumn("by_host", toward(F.col("n_host"), F.col("by_domain")))
             .withColumn("by_suffix", F.when(F.col("n_suffix").isNull(), top).otherwise(toward(F.col("n_suffix"), top)))
             # The suffix is evidence of its own: how it shifts the languages against all rows.
             .withColumn("prior", F.zip_with("by_host", F.zip_with("by_suffix", top, lambda s, q: s / q), lambda h, s: F.log(h) + F.log(s))))
    return Evidence(overall, confusion, stored(hosts.filter("host is not null").groupBy("host").agg(F.first("prior").alias("prior")), "host-priors"))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = "lang", address: str = "source",
             carry: Column | None = None) -> DataFrame:
    """Per row: id, declared, language, posterior, known_share, kept; `carry` travels along as it is."""
    spark = prepared(docs.sparkSession)
    said = docs[declared].cast("string")
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"), said.alias("declared"), tag_of(said).alias("tag"),
                       *places(docs[address].cast("string")), (carry if carry is not None else F.lit(None).cast("int")).alias("carry"))
    model = fitted(rows.select("id", "text", "tag"))
    languages = model.languages
    out = T.StructType([*rows.select("id", "carry", "declared").schema, T.StructField("language", T.StringType()),
                        T.StructField("posterior", T.DoubleType()), T.StructField("known_share", T.DoubleType()),
                        T.StructField("kept", T.BooleanType())])
    names = [f.name for f in out]
    if not languages:
        letters = F.coalesce(F.col("text"), F.lit("")).rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")
        return rows.select("id", "carry", "declared", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"),
                           F.lit(None).cast("double").alias("known_share"), letters.alias("kept"))
    held = spark.sparkContext.broadcast(model)
    evidence = gathered(rows, model, held)
    overall, confusion = np.log(evidence.overall), evidence.declared

    def fuse(batches: Arrow) -> Arrow:
        model = held.value
        for batch in ts.slices(batches, "text"):
            log, n, known = model.likelihood(batch.column("text"))
            prior = batch.column("prior")
            rows = np.flatnonzero(prior.is_valid().to_numpy(zero_copy_only=False))
            given = np.tile(overall, (len(n), 1))
            if len(rows):
                given[rows] = prior.drop_null().flatten().to_numpy().reshape(len(rows), len(overall))
            log = log + given
            place = {language: k for k, language in enumerate(model.languages)}
            said = np.array([place.get(x, -1) for x in batch.column("tag").to_pylist()], int)
            log[said >= 0] += confusion.T[said[said >= 0]]
            p = shares(log) if len(log) else log
            best = p.argmax(axis=1) if len(log) else np.zeros(0, int)
            top = p[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("carry"), batch.column("declared"), pa.array([model.languages[k] for k in best], pa.string()),
                 pa.array(top), pa.array(known), pa.array((n > 0) & (known >= KNOWN) & (top >= LEAST))], names)

    # Spark broadcasts the hosts where they are few and splits hot hosts where they aren't.
    return rows.join(evidence.hosts, "host", "left").select("id", "text", "declared", "tag", "carry", "prior").mapInArrow(fuse, out)
