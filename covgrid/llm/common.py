r"""Helpers shared by the training-data operators.

Text is handled as UTF-8 bytes in bounded blocks: token boundaries, token
hashes and shingle hashes are numpy operations over a whole block, so an
Arrow batch never turns into one Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.session import materialize, ship_package

BLOCK_BYTES = 1 << 20
#: A text longer than this is tokenised piece by piece, cut at separators.
PIECE_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTERS = LOWER.astype(np.uint64) + np.uint64(1)

#: Separators of ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:0x30] = True
NOT_WORD[0x3A:0x41] = True
NOT_WORD[0x5B:0x61] = True
NOT_WORD[0x7B:0x80] = True

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS = {"n": 0}


#: Rows in an Arrow batch: texts are long, and a batch is held whole on both sides.
BATCH_ROWS = 1000


def prepare(spark) -> None:
    """Ship the package to the Python workers and bound the session's Arrow batches."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        n = max(n, BLOCK_BYTES)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Yield ``(first_row, end_row, bytes, bounds)`` over a string column, nulls
    as empty; a block holds about ``limit`` bytes, or one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def token_bounds(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray):
    """Byte starts and ends of the tokens; tokens never cross a row bound."""
    token = ~separators[data]
    start, end = token.copy(), token.copy()
    start[1:] &= ~token[:-1]
    end[:-1] &= ~token[1:]
    first = bounds[:-1][bounds[:-1] < len(data)]
    last = bounds[1:][bounds[1:] > 0] - 1
    start[first] = token[first]
    end[last] = token[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _hash_piece(data, bounds, separators):
    starts, ends = token_bounds(data, bounds, separators)
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    letters = _LETTERS[data]
    letters *= up[: len(data)]
    np.cumsum(letters, out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h), starts, ends


def token_hashes(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray):
    """64-bit hash, byte start, byte end and row of every token of a block;
    A-Z are lower-cased first."""
    if len(data) <= PIECE_BYTES:
        h, starts, ends = _hash_piece(data, bounds, separators)
        row = np.searchsorted(bounds, starts, "right") - 1
        return h, starts, ends, row
    parts, at = [], 0  # one long text
    while at < len(data):
        cut = min(at + PIECE_BYTES, len(data))
        while cut < len(data) and not separators[data[cut]]:
            step = np.flatnonzero(separators[data[cut: cut + PIECE_BYTES]])
            cut = cut + int(step[0]) if len(step) else min(cut + PIECE_BYTES, len(data))
        piece = data[at:cut]
        h, s, e = _hash_piece(piece, np.array([0, len(piece)]), separators)
        parts.append((h, s + at, e + at))
        at = cut
    h, starts, ends = (np.concatenate(x) for x in zip(*parts))
    return h, starts, ends, np.searchsorted(bounds, starts, "right") - 1


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-token shingles of one token sequence; a shorter
    sequence is one shingle as a whole; an empty one has none."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    m = np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(k):
        out *= m
        out += h[j: n - k + 1 + j]
    return mix(out)


def row_slices(row: np.ndarray, rows: int) -> np.ndarray:
    """``rows + 1`` positions: the tokens of row i are ``[out[i], out[i+1])``."""
    return np.searchsorted(row, np.arange(rows + 1))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def packed(df: DataFrame, without: list[str] = (), **more) -> DataFrame:
    """The whole row, but for the columns ``without``, as one struct ``doc``, beside
    columns of the operator's own: so no input column can clash with them."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return df.select(F.struct(*kept).alias("doc"), *[v.alias(k) for k, v in more.items()])


def unpacked(df: DataFrame, columns: list[str], **results) -> DataFrame:
    """The packed columns and the results; a result replaces a column of its name."""
    return df.select(*[F.col("doc")[c].alias(c) for c in columns if c not in results],
                     *[v.alias(k) for k, v in results.items()])


def bounded(df: DataFrame, limit: int) -> bool:
    """Does ``df`` have at most ``limit`` rows?  Reads no more than that."""
    return df.limit(limit + 1).count() <= limit


#: Bits of a filter of ids: 8 MB, whatever their number.
FILTER_BITS = 1 << 26


def bitmap_of(places: DataFrame, bits: int = FILTER_BITS):
    """A broadcast bitmap of ``places(p)``, 0 to ``bits - 1``.  It is of fixed size: 64-bit
    words are put together by a distributed aggregation, and at most ``bits / 64`` of
    them reach the driver."""
    at = places.selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, CAST(p % 64 AS INT)) AS b")
    words = at.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # not as Python rows: up to a million
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return places.sparkSession.sparkContext.broadcast(table)


def marked(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 6] >> (places & 63)) & 1 == 1


def made_of_chosen(df: DataFrame, ids: DataFrame, make, schema: str, bits: int = FILTER_BITS) -> DataFrame:
    """``make(batches)`` over ``id, text`` of the rows of ``df(id, text)`` whose ``id`` is
    in ``ids``; what it makes (``schema``) begins with the ``id``.  A semi-join of ``df``
    would shuffle every row (and its text) for a few ids; so rows whose id meets no set
    bit of a bitmap of the ids go first, where they are, in the worker that goes on with
    the others: a filter of its own would keep a second worker a task.  With very many
    ids the bitmap lets more rows through, and the join still decides."""
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    bitmap = bitmap_of(ids.select(place.alias("p")), bits)

    def run(batches):
        def left():
            for batch in batches:
                keep = marked(bitmap.value, batch.column(2).to_numpy(zero_copy_only=False))
                if keep.any():
                    yield batch.select([0, 1]).filter(pa.array(keep))

        yield from make(left())

    asked = df.where(F.col("id").isNotNull()).select("id", "text", place.alias("place"))
    return asked.mapInArrow(run, schema).join(ids, "id", "left_semi")


def chosen(df: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df(id, text)`` whose ``id`` is in ``ids``."""
    return made_of_chosen(df, ids, iter, "id long, text string", bits)


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of ``counts(.., n)`` with the largest ``n``, at most ``limit`` of
    them, without a global sort: counts are ranked in steps of an eighth of a
    power of two, and whole steps are taken from the top while they fit."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).count().collect()  # at most 512 rows
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        if total + r["count"] > limit:
            break
        total, least = total + r["count"], r["step"]
    return counts.where(step >= least) if least is not None else counts.limit(0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(id,
    component)`` per node, component = the smallest id reachable.

    Each round maps every node to its smallest neighbour's smallest neighbour
    and contracts the edges under that map; a map keeps connectivity, and the
    smallest node of a component always maps to itself, so the last name of a
    component is its smallest id.  All tables stay distributed and are written
    to the shared folder between rounds.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    both = edges.select("a").union(edges.select("b")).distinct()
    labels = materialize(both.select(F.col("a").alias("id"), F.col("a").alias("component")), "labels")
    while not edges.isEmpty():
        up = (edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
              .select(F.col("a").alias("id"), F.least("a", "m").alias("to")))
        up = materialize(up, "up")
        nxt = up.select(F.col("id").alias("to"), F.col("to").alias("over"))
        jump = materialize(up.join(nxt, "to", "left").select("id", F.coalesce("over", "to").alias("to")), "jump")
        ja = jump.select(F.col("id").alias("a"), F.col("to").alias("x"))
        jb = jump.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = materialize(
            edges.join(ja, "a").join(jb, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        jl = jump.select(F.col("id").alias("component"), "to")
        labels = materialize(
            labels.join(jl, "component", "left").select("id", F.coalesce("to", "component").alias("component")),
            "labels")
    return labels
