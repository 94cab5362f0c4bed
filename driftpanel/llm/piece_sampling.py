"""Sampled segmentations over a vocabulary's piece lattice, and their decoding.

Every way to spell a text with pieces is a path; a path's weight is the product of its
pieces' weights, which fall with their rank in the vocabulary. Forward filtering sums
the weights of all paths to each place, backward sampling draws one path, piece by
piece from the end, with random numbers that depend only on the row's key and the
place. No piece crosses from a character that isn't a space to a space, or holds a
character that the vocabulary spells in bytes only, so a text falls into segments whose
lattices are independent; each distinct segment of a batch is filtered once, and all
of them are sampled side by side.

Texts are not normalised: a space is the vocabulary's space mark, and what no piece
spells, the mark itself included, is spelled in bytes. So decoding gives back any text.

Null and empty texts have no pieces. Equal keys and texts have equal segmentations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpanel.llm import textscan as ts
from driftpanel.llm.common import prepared
from driftpanel.llm.lookup import Lookup

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SHARPNESS = 1.0  # weight of a piece: (rank + RANK_SHIFT) ** -SHARPNESS
RANK_SHIFT = 10.0
LONG = 64  # bytes; longer segments are filtered on their own
FEW = 8  # segments so few are sampled one by one
STEP = 2 << 20
U = np.uint64
Arrow = Iterator[pa.RecordBatch]


@dataclass
class Pieces:
    """Spellings of the pieces and what the lattice needs of them."""

    spelling: np.ndarray  # bytes of all pieces, one after another
    first: np.ndarray  # pieces + 1
    weights: np.ndarray
    lookup: Lookup  # of all beginnings of spellings, by unmixed hash
    ids: np.ndarray  # the piece that a beginning is, -1 if none
    bytes: np.ndarray  # id of each byte's own piece
    longest: int
    alone: np.ndarray  # bytes that stand in no piece but their own

    @classmethod
    def load(cls, model: str) -> Pieces:
        import sentencepiece

        system, path = fs.FileSystem.from_uri(model)
        p = sentencepiece.SentencePieceProcessor(model_proto=system.open_input_stream(path).read())
        n = p.get_piece_size()
        spelled, own, normal = [b""] * n, np.full(256, -1), []
        for i in range(n):
            if p.is_byte(i):
                value = int(p.id_to_piece(i)[3:5], 16)
                spelled[i], own[value] = bytes([value]), i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                spelled[i] = p.id_to_piece(i).replace(MARK, " ").encode()
                normal.append(i)
        ranks = np.full(n, float(n))
        ranks[normal] = np.arange(len(normal))
        data = np.frombuffer(b"".join(spelled), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
        whole = {spelled[i]: i for i in normal}
        begun = sorted({x[:k] for x in whole for k in range(1, len(x) + 1)})
        prefix = ts.byte_prefix(np.frombuffer(b"".join(begun), np.uint8))
        at = np.concatenate([[0], np.cumsum([len(x) for x in begun])])
        ids = np.array([whole.get(x, -1) for x in begun], np.int32)
        hashes = ts.plain_hash(prefix, at[:-1], at[1:])
        used = np.zeros(256, bool)
        for i in normal:
            used[list(spelled[i])] = True
        return cls(data, first, (ranks + RANK_SHIFT) ** -SHARPNESS, Lookup(hashes), ids, own,
                   max(len(spelled[i]) for i in normal), ~used)


@dataclass
class Lattice:
    """Edges of distinct segments; nodes are places in segments, sorted by edges' ends."""

    first_node: np.ndarray  # of each segment
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    weight: np.ndarray


def segments(data: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends: cut before spaces that follow something else, and around bytes of no piece."""
    cut = np.zeros(len(data) + 1, bool)
    space, alone = data == 32, pieces.alone[data] & (data < 128)
    cut[1:-1] = space[1:] & ~space[:-1]
    cut[:-1] |= alone
    cut[1:] |= alone
    cut[offsets] = True
    bounds = np.flatnonzero(cut)
    return bounds[:-1], bounds[1:]


def lattice(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> Lattice:
    size = ends - starts
    first_node = np.concatenate([[0], np.cumsum(size + 1)])
    places = np.repeat(starts - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(int(size.sum()))
    node = np.repeat(first_node[:-1] - starts, size) + places
    limit = np.repeat(ends, size)
    base, down = prefix[places], ts.unshift(len(prefix) - 1)[places]
    found = []
    for n in range(1, pieces.longest + 1):
        fits = places + n <= limit
        places, node, limit, base, down = places[fits], node[fits], limit[fits], base[fits], down[fits]
        if not len(places):
            break
        at = pieces.lookup((prefix[places + n] - base) * down)
        begun = at >= 0
        places, node, limit, base, down = places[begun], node[begun], limit[begun], base[begun], down[begun]
        piece = pieces.ids[at[begun]]
        hit = piece >= 0
        found.append((node[hit], node[hit] + n, piece[hit]))
    # Bytes spell what no piece does: characters that aren't pieces themselves.
    total = int(size.sum())
    places = np.repeat(starts - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(total)
    node = np.repeat(first_node[:-1] - starts, size) + places
    lead = ts.LEADING[data[places]]
    begins = np.flatnonzero(lead)
    lengths = np.diff(np.concatenate([begins, [total]]))
    at = pieces.lookup(ts.plain_hash(prefix, places[begins], places[begins] + lengths))
    spare = np.repeat((at < 0) | (pieces.ids[at] < 0), lengths)
    found.append((node[spare], node[spare] + 1, pieces.bytes[data[places[spare]]]))
    start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(end, kind="stable")
    return Lattice(first_node, start[order], end[order], piece[order], pieces.weights[piece[order]])


def filtered(lat: Lattice) -> np.ndarray:
    """Share of each edge among the paths to its end."""
    sizes = np.diff(lat.first_node) - 1
    n_nodes = int(lat.first_node[-1])
    seg_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    depth = np.arange(n_nodes) - lat.first_node[seg_of]
    weight = np.zeros(len(lat.start))
    # Short segments together, place by place; weights are scaled by length to stay in range.
    scale = 400.0 ** (lat.end - lat.start)
    alpha = np.zeros(n_nodes)
    alpha[lat.first_node[:-1]] = 1.0
    short = sizes[seg_of[lat.end]] <= LONG
    turn = np.where(short, depth[lat.end], LONG + 1)
    by_depth = np.argsort(turn, kind="stable")
    bounds = np.searchsorted(turn[by_depth], np.arange(LONG + 2))
    for d in range(1, LONG + 1):
        e = by_depth[bounds[d] : bounds[d + 1]]
        if len(e):
            weight[e] = alpha[lat.start[e]] * lat.weight[e] * scale[e]
            np.add.at(alpha, lat.end[e], weight[e])
    # Long ones one by one, in logarithms.
    for s in np.flatnonzero(sizes > LONG):
        lo, hi = np.searchsorted(lat.end, [lat.first_node[s], lat.first_node[s + 1]])
        logs = {int(lat.first_node[s]): 0.0}
        edge_log = np.log(lat.weight[lo:hi])
        e = lo
        while e < hi:
            to, f = int(lat.end[e]), e
            while f < hi and lat.end[f] == to:
                f += 1
            terms = [logs.get(int(lat.start[k]), -np.inf) + edge_log[k - lo] for k in range(e, f)]
            top = max(terms)
            if top > -np.inf:
                values = [np.exp(t - top) for t in terms]
                total = sum(values)
                logs[to] = top + float(np.log(total))
                weight[e:f] = values
                alpha[to] = total
            e = f
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(alpha[lat.end] > 0, weight / alpha[lat.end], 0.0)


def sampled(lat: Lattice, share: np.ndarray, segment: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each occurrence of a segment, drawn from the end; and how many each has."""
    n_nodes = int(lat.first_node[-1])
    edge_first = np.searchsorted(lat.end, np.arange(n_nodes + 1))
    run = np.concatenate([[0.0], np.cumsum(share)])
    node, goal = lat.first_node[segment + 1] - 1, lat.first_node[segment]
    left = np.flatnonzero(node > goal)
    drawn, count, step = [], np.zeros(len(segment), np.int64), 0
    while len(left):
        at = node[left]
        random = ts.mix(seeds[left] + U(0x9E3779B97F4A7C15 * (step + 1) % (1 << 64)))
        u = (random >> U(11)).astype(np.float64) * 2.0**-53
        lo, hi = edge_first[at], edge_first[at + 1]
        goal_run = run[lo] + u * (run[hi] - run[lo])
        e, go = lo.copy(), np.flatnonzero((run[lo + 1] <= goal_run) & (lo + 1 < hi))
        while len(go):
            e[go] += 1
            go = go[(run[e[go] + 1] <= goal_run[go]) & (e[go] + 1 < hi[go])]
        drawn.append((left, np.full(len(left), step), lat.piece[e]))
        node[left] = lat.start[e]
        count[left] += 1
        step += 1
        left = left[node[left] > goal[left]]
        if len(left) <= FEW:
            break
    for one in left:  # the last few, however long, piece by piece
        at, most = int(node[one]), int(node[one] - goal[one])
        random = ts.mix(seeds[one] + np.arange(step + 1, step + most + 1, dtype=U) * U(0x9E3779B97F4A7C15))
        path = []
        for u in ((random >> U(11)).astype(np.float64) * 2.0**-53).tolist():
            lo, hi = int(edge_first[at]), int(edge_first[at + 1])
            target = run[lo] + u * (run[hi] - run[lo])
            while lo + 1 < hi and run[lo + 1] <= target:
                lo += 1
            path.append(int(lat.piece[lo]))
            at = int(lat.start[lo])
            if at <= goal[one]:
                break
        drawn.append((np.full(len(path), one), step + np.arange(len(path)), np.array(path, np.int32)))
        count[one] += len(path)
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(begin[-1]), np.int32)
    for which, k, piece in drawn:
        out[begin[which + 1] - 1 - k] = piece
    return out, count


def encoded(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, pieces: Pieces, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows, and each row's first."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    starts, ends = segments(data, offsets, pieces)
    prefix = ts.byte_prefix(data)
    _, example, segment = np.unique(ts.span_hash(prefix, starts, ends), return_index=True, return_inverse=True)
    lat = lattice(data, prefix, starts[example], ends[example], pieces)
    first = np.searchsorted(starts, offsets)  # of each row's segments
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    place = (starts - offsets[row]).astype(U)
    seeds = ts.mix(ts.mix(keys[row] + U(seed)) ^ ts.mix(place + U(1)))
    out, count = sampled(lat, filtered(lat), segment, seeds)
    return out, np.concatenate([[0], np.cumsum(count)])[first]


def decoded(ids: np.ndarray, first: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes spelled by the ids, and each row's offset."""
    sizes = pieces.first[ids + 1] - pieces.first[ids]
    ends = np.cumsum(sizes)
    at = np.repeat(pieces.first[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pieces.spelling[at], np.concatenate([[0], ends])[first]


def loaded(model: str, cache: dict) -> Pieces:
    if model not in cache:
        cache[model] = Pieces.load(model)
    return cache[model]


_CACHE: dict = {}


def segmented(texts: pa.Array, keys: pa.Array, pieces: Pieces, seed: int) -> tuple[pa.Array, pa.Array]:
    """Each text's piece ids, and whether they spell it."""
    data, offsets = ts.utf8(texts)
    ids, first = encoded(data, offsets, keys.to_numpy().view(U), pieces, seed)
    back, ends = decoded(ids, first, pieces)
    same = np.diff(ends) == np.diff(offsets)
    if len(back) == len(data):
        same &= ts.sums(back != data, offsets) == 0
    else:
        same &= [bytes(back[ends[i] : ends[i + 1]]) == bytes(data[offsets[i] : offsets[i + 1]]) for i in range(len(same))]
    return ts.list_column(ids, first), pa.array(same)


def with_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = 0) -> DataFrame:
    """The documents with `pieces`, `n_pieces` and `lossless`, as `encode` gives them; Python sees keys and texts alone."""
    prepared(docs.sparkSession)
    kind = T.StructType([T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])

    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        pieces = loaded(model, _CACHE)
        batch = pa.RecordBatch.from_arrays([texts, keys], ["text", "key"])
        parts = [pa.StructArray.from_arrays(segmented(part.column("text"), part.column("key"), pieces, seed), ["pieces", "lossless"])
                 for part in ts.slices(iter([batch]), "text", STEP)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("pieces", pa.list_(pa.int32())), ("lossless", pa.bool_())]))

    found = F.arrow_udf(run, kind)(docs[text], F.xxhash64(docs[key]))
    own = [docs[c] for c in docs.columns]
    return docs.select(*own, found.alias("_found")).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("_found.pieces").alias("pieces"),
        F.size("_found.pieces").alias("n_pieces"), F.col("_found.lossless").alias("lossless"))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = 0,
           carry: Column | None = None) -> DataFrame:
    """Per row: key, pieces (ids), lossless (whether decoding gave the text back); `carry` travels along as it is."""
    prepared(docs.sparkSession)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[key]).alias("row_key"),
                       (carry if carry is not None else F.lit(None).cast("int")).alias("carry"))
    out = T.StructType([*rows.select("key", "carry").schema, T.StructField("pieces", T.ArrayType(T.IntegerType())),
                        T.StructField("lossless", T.BooleanType())])

    def run(batches: Arrow) -> Arrow:
        pieces = loaded(model, _CACHE)
        for batch in ts.slices(batches, "text", STEP):
            ids, same = segmented(batch.column("text"), batch.column("row_key"), pieces, seed)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("carry"), ids, same],
                                             ["key", "carry", "pieces", "lossless"])

    return rows.mapInArrow(run, out)


def decode(rows: DataFrame, pieces: str = "pieces", model: str = MODEL, key: str = "key") -> DataFrame:
    """Per row: key, text spelled by the pieces; a null list reads as empty."""
    prepared(rows.sparkSession)
    named = rows.select(rows[key].alias("key"), F.coalesce(rows[pieces], F.array().cast("array<int>")).alias("pieces"))
    out = T.StructType([named.schema["key"], T.StructField("text", T.StringType())])

    def run(batches: Arrow) -> Arrow:
        table = loaded(model, _CACHE)
        for batch in batches:
            lists = batch.column("pieces")
            ids, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            data, offsets = decoded(ids, np.concatenate([[0], np.cumsum(sizes)]), table)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(
                [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())], ["key", "text"])

    return named.mapInArrow(run, out)
