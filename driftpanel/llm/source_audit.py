"""How far apart the sources of a language are, by the terms they use.

Tokenizer: one `bytes.translate` lowers A-Z and blanks every separator, `bytes.split` cuts the
terms, two `Counter`s per source count them: all of a document's, and each of its terms once.
Tasks add documents up before anything is shuffled, so frequent terms and large sources travel
as sums; these meet by language and term in one shuffle, for groups and languages alike.

A language keeps the terms of at least `least_documents` of its documents. A group (language and
source) gives each kept term a smoothed share in billionths, and so does the language as a whole.
Reported are the distances between each two sources of a language, and per group the terms that it
has most in excess of its language.

Distances between sources add up over blocks: so many terms by so many sources a side, as
one small dense matrix in a task. Terms that no source of a block pair uses are added from
their number alone. Rows that pair sources exist only as results, never per term.

Nulls in text, language or source read as empty. Texts without terms make their group occur,
but count nothing; a language without kept terms gives distances of 0. Repeated rows count as
often as they stand. Ties rank by item. A table without rows gives none. Further columns are
neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftpanel.llm.common import prepared, stored

LEAST_DOCUMENTS, SMOOTHING, UNIT, RANKS = 30, 5, 1_000_000_000, 50
BLOCK_SOURCES, BLOCK_TERMS = 128, 1024
HELD = 500_000  # terms a task adds up before it passes them on
SENT = 20_000  # rows passed on together

# Letters stay, A-Z lowered, as do all bytes of characters beyond ASCII; all else separates.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents), added up over a task's documents as far as `HELD` allows."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("lang", "source"))
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(*columns, texts, strict=True):
            terms = terms_of(text)
            occurrences, documents = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(occurrences)
            # Lists and sets are counted by the interpreter's own loop, counters by one in Python.
            occurrences.update(terms)
            documents.update(set(terms))
            size += len(occurrences)
            if size > HELD:
                yield from sums(held)
                held, size = {}, 0
    yield from sums(held)


def sums(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (occurrences, documents) in held.items():
        terms = list(occurrences)
        for k in range(0, len(terms), SENT):
            part = terms[k : k + SENT]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(part), pa.string()), "source": pa.array([source] * len(part), pa.string()),
                "term": pa.array(part, pa.binary()).cast(pa.string()),
                "n": pa.array([occurrences[t] for t in part], pa.int64()), "documents": pa.array([documents[t] for t in part], pa.int64())})


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * kept)), exactly."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    below = (total + SMOOTHING * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", top, below))


def kept_counts(counts: DataFrame, least_documents: int) -> DataFrame:
    """(lang, source, term, n, in_lang, leads): the terms a language keeps, with their occurrences in it.

    Sums meet by language and term, so that one shuffle serves groups and languages. Of a
    term's rows one leads: there the term is counted.
    """
    rows = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    in_lang = Window.partitionBy("lang", "term")
    totals = rows.select(
        "lang", "source", "term", "n", F.sum("n").over(in_lang).alias("in_lang"), F.sum("documents").over(in_lang).alias("documents"),
        (F.min("source").over(in_lang) == F.col("source")).alias("leads"))
    return totals.filter(F.col("documents") >= least_documents).drop("documents")


def group_table(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Every occurring group: its number within the language, its total, the language's total and kept terms."""
    occurring = documents.select("lang", "source").distinct()
    per_group = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("leads").alias("leading"))
    per_lang = per_group.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("leading").alias("n_kept"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    filled = occurring.join(per_group.drop("leading"), ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(
        0, ["total", "lang_total", "n_kept"])
    sources = Window.partitionBy("lang")
    return filled.withColumn("no", number).withColumn("n_sources", F.count("*").over(sources)).withColumn(
        "unused", share(F.lit(0), F.col("total"), F.col("n_kept")))


def block_distances(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Distances between the sources of two blocks over the terms of one slice."""
    lang, first, second, _ = key
    groups = groups.sort_values("no")
    names, numbers = groups["source"].to_numpy(object), groups["no"].to_numpy(np.int64)
    unused = groups["unused"].fillna(0).to_numpy(np.int64)
    row, seen = pd.factorize(terms["term"])
    shares = np.tile(unused, (len(seen), 1))
    shares[row, np.searchsorted(numbers, terms["no"].to_numpy(np.int64))] = terms["p"].to_numpy(np.int64)
    half = int((groups["block"] == first).sum())
    pairs = [(a, np.arange(a + 1 if first == second else half, len(names))) for a in range(half)]
    a = np.repeat(np.arange(half), [len(others) for _, others in pairs])
    b = np.concatenate([others for _, others in pairs])
    value = np.concatenate([np.abs(shares[:, others] - shares[:, [k]]).sum(0) for k, others in pairs])
    return pd.DataFrame({
        "lang": np.full(len(a), lang, object), "a": names[a], "b": names[b], "value": value, "seen": len(seen),
        "n_kept": int(groups["n_kept"].iloc[0]), "gap": np.abs(unused[b] - unused[a])}).astype({"lang": object, "a": object, "b": object})


def source_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways."""
    block = F.floor(F.col("no") / BLOCK_SOURCES).cast("int")
    blocks = F.floor((F.col("n_sources") - 1) / BLOCK_SOURCES).cast("int")
    slices = F.floor(F.col("n_kept") / BLOCK_TERMS).cast("int") + 1

    def paired(rows: DataFrame) -> DataFrame:
        each = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks)))
        return each.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))

    keys = ["lang", "first", "second", "slice"]
    left = paired(shares.withColumn("slice", F.pmod(F.xxhash64("term"), slices).cast("int"))).select(*keys, "no", "term", "p")
    # New columns: `shares` holds those of the same table.
    fresh = groups.toDF(*groups.columns)
    right = paired(fresh).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select(*keys, "no", "source", "block", "n_kept", "unused")
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        block_distances, "lang string, a string, b string, value long, seen long, n_kept long, gap long")
    value = F.sum("value") + (F.max("n_kept") - F.sum("seen")) * F.max("gap")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return partial.groupBy("lang", "a", "b").agg(value.alias("value")).select("lang", both.alias("pair"), "value").select("lang", "pair.*", "value")


def ranked(rows: DataFrame, part: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))


def audit_sources(df: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
                  least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` has the distances to the other sources, `term` the terms in excess."""
    prepared(df.sparkSession)
    named = {"lang": lang_column, "source": source_column, "text": text_column}
    documents = df.select(*[F.coalesce(df[theirs].cast("string"), F.lit("")).alias(ours) for ours, theirs in named.items()])
    counts = documents.mapInArrow(count_terms, "lang string, source string, term string, n long, documents long")
    rows = stored(kept_counts(counts, least_documents), "audit-kept")
    groups = stored(group_table(documents, rows), "audit-groups")
    shares = rows.join(groups.drop("unused"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("n_kept")))
    excess = F.col("p") - share(F.col("in_lang"), F.col("lang_total"), F.col("n_kept"))
    terms = ranked(shares.select("lang", "source", F.col("term").alias("item"), excess.alias("value")).filter("value > 0"), "term")
    return ranked(source_distances(shares, groups), "pair").unionByName(terms.filter(F.col("rank") <= ranks))
