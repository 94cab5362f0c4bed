"""Token counts from flat token files without an index.

Files hold 16-bit token identifiers, little end first, an end-of-document identifier
after each document. They are read in blocks that know nothing of each other; each finds
its ends with one vectorised comparison. A prefix scan over the blocks' summaries
(number of ends, place of the last one) stitches documents that cross blocks and gives
each its ordinal; it runs over groups of blocks first, so that no task sees all blocks
of a file.

Texts with very long runs of white space are cut around them where the pattern cuts anyway.
A vocabulary that needs wider identifiers, or uses the end's, is refused.

Null and empty texts are documents of no tokens. Tokens after a file's last end are one
more document, with `ended` false. Repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftpanel.llm import textscan as ts
from driftpanel.llm.common import only, prepared, scratch_path, stored

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
WIDTH = 2  # bytes of an identifier
BLOCK = 4 << 20  # bytes of a block
GROUP = 512  # blocks scanned together
# Fixed value: how this vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The pattern tries a run of white space once per character and gives up on very long ones.
# What it would find there is known: the run, but for its last character if more text follows.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 2000
RUNS = re.compile(f"(?<![{WHITE}])[{WHITE}]{{{LONG_RUN},}}")

Arrow = Iterator[pa.RecordBatch]


def encoder(ranks: str) -> Callable[[str], np.ndarray]:
    import tiktoken

    system, path = fs.FileSystem.from_uri(ranks)
    lines = system.open_input_stream(path).read().split(b"\n")
    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    if max(table.values(), default=0) >= 1 << (8 * WIDTH):
        raise ValueError(f"identifiers of {ranks} don't fit {WIDTH} bytes")
    if END in table.values():
        raise ValueError(f"{END} is an identifier of {ranks}, so it can't end documents")
    split = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
    whole = tiktoken.Encoding("runs", pat_str="(?s).+", mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        parts, at = [], 0
        for run in RUNS.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts += [split.encode_to_numpy(text[at : run.start()], disallowed_special=()),
                      whole.encode_to_numpy(text[run.start() : end], disallowed_special=())]
            at = end
        parts.append(split.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(parts).astype("<u2")

    return encode


def writer(folder: str, ranks: str) -> Callable[[Arrow], Arrow]:
    """A file per task, under a name of its own; a task that is run again leaves the first file unread."""

    def write(batches: Arrow) -> Arrow:
        encode, end = encoder(ranks), np.array([END], "<u2").tobytes()
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name, ordinal, size = f"{uuid.uuid4().hex}.bin", 0, 0
        with system.open_output_stream(f"{path}/{name}") as out:
            for batch in ts.slices(batches, "text"):
                for text in batch.column("text").to_pylist():
                    size += out.write(encode(text or "").tobytes()) + out.write(end)
                n = len(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column("id").cast(pa.int64()),
                     pa.array(np.full(n, size))], ["file", "ordinal", "id", "size"])
                ordinal += n

    return write


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """Writes the texts' tokens; gives each document's (file, ordinal, id), and in `size` the file's bytes so far."""
    rows = only(docs, id=doc_id, text=text).mapInArrow(writer(folder, ranks), "file string, ordinal long, id long, size long")
    return stored(rows, "token-listing")


def scanner(folder: str, end: int) -> Callable[[Arrow], Arrow]:
    """Each block's ends, as places in the file."""

    def scan(batches: Arrow) -> Arrow:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, block, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "size")), strict=True):
                with system.open_input_file(f"{path}/{file}") as source:
                    source.seek(block * BLOCK)
                    tokens = np.frombuffer(source.read(min(BLOCK, size - block * BLOCK)), "<u2")
                ends = np.flatnonzero(tokens == end) + block * (BLOCK // WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()),
                     pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), ts.list_column(ends, np.array([0, len(ends)]))],
                    ["file", "block", "n", "last", "ends"])

    return scan


def scan_token_files(files: DataFrame, folder: str, end: int = END) -> DataFrame:
    """files has (file, size in bytes). Per document: file, ordinal, start, n_tokens, ended."""
    prepared(files.sparkSession)
    blocks = (files.select("file", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / BLOCK)))).alias("block"))
              .filter("size > 0"))
    # One block per row: hash-dealt, so that a file's blocks go to many tasks.
    found = stored(blocks.repartition("file", "block").mapInArrow(
        scanner(folder, end), "file string, block long, n long, last long, ends array<long>"), "token-blocks")
    summary = found.select("file", "block", "n", "last", F.floor(F.col("block") / GROUP).alias("group"))

    def before(keys: list[str], order: str) -> list:
        earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum("n").over(earlier), F.lit(0)), F.coalesce(F.max("last").over(earlier), F.lit(-1))]

    groups = summary.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    n, last = before(["file"], "group")
    groups = groups.select("file", "group", n.alias("group_n"), last.alias("group_last"))
    n, last = before(["file", "group"], "block")
    scanned = (summary.withColumn("own_n", n).withColumn("own_last", last).join(groups, ["file", "group"])
               .select("file", "block", (F.col("own_n") + F.col("group_n")).alias("ordinal"),
                       F.greatest("own_last", "group_last").alias("before")))
    start = F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    whole = (found.filter("n > 0").join(scanned, ["file", "block"])
             .select("file", "ordinal", "before", "ends", F.posexplode("ends").alias("i", "end"))
             .select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), start.alias("start"), "end")
             .select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended")))
    tails = (summary.groupBy("file").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
             .join(files.select("file", "size"), "file")
             .select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("size") / WIDTH).cast("long").alias("size"))
             .filter("start < size").select("file", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False)))
    return whole.union(tails)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """Per document: id, n_tokens, as found in the files."""
    spark = prepared(docs.sparkSession)
    folder = scratch_path(spark, "tokens")
    listing = write_token_files(docs, folder, doc_id, text, ranks)
    files = listing.groupBy("file").agg(F.max("size").alias("size"))
    counts = scan_token_files(files, folder)
    return counts.join(listing.select("file", "ordinal", "id"), ["file", "ordinal"]).select(F.col("id").alias(doc_id), "n_tokens")
