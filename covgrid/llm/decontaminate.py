r"""Benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item (an item of fewer
words, but not none, is one window).  A window is the set of its word shingles
with their offsets; it is contained in a document where all of them occur at
the right places.  As containment must be complete, one shingle is a necessary
prefix, and the rarest one is the cheapest:

1. the occurrences of every benchmark shingle are counted over all documents
   (one distributed sum); a window with a shingle that never occurs is out;
2. the others are ordered by rarity, and each window keeps its rarest shingle
   as its prefix token;
3. documents emit their positions of prefix tokens with the words around;
   an equi-join on the token meets the windows, positional and length bounds
   drop those that would leave the document, and containment is verified
   exactly, word by word, over the window.

Tasks look tokens up in a sorted array of at most ``block`` benchmark
shingles, sent to all nodes; a larger benchmark is worked off in blocks of
items, each with its own pass, with the same result.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, compared by 64-bit
hashes (ten in a row for a full window).

Defined cases: a null or empty text has no words; a benchmark row with a null
id marks words but is not listed; repeated benchmark rows count once; rows are
judged one by one, repeated or not; an empty benchmark hits nothing; an empty
document table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.session import materialize

SIZE = 10
SHINGLE = 3
#: Benchmark shingles looked up at once (8 bytes each, sent to every node).
BLOCK = 1 << 20


def windows(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """``item_id string, m, words array<long>, shingles array<long>`` per window."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, bounds in common.text_blocks(batch.column(1)):
                h, _, _, row = common.token_hashes(data, bounds, common.NOT_WORD)
                cut = common.row_slices(row, j - i)
                out = []
                for r in range(j - i):
                    w = h[cut[r]: cut[r + 1]]
                    m = min(size, len(w))
                    for p in range(len(w) - m + 1 if m else 0):
                        out.append((ids[i + r], w[p: p + m]))
                for a in range(0, len(out), 5000):
                    part = out[a: a + 5000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x[0] for x in part], pa.string()), pa.array([len(x[1]) for x in part], pa.int32()),
                        common.list_array([common.signed(x[1]) for x in part], pa.int64()),
                        common.list_array([common.signed(common.shingle_hashes(x[1], shingle)) for x in part], pa.int64())],
                        names=["item_id", "m", "words", "shingles"])

    return items.mapInArrow(run, "item_id string, m int, words array<long>, shingles array<long>").distinct()


class Lookup:
    """Is a hash among a fixed set?  A small bit table first, then the sorted hashes."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.sorted = sorted_hashes
        bits = max(16, int(len(sorted_hashes) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(sorted_hashes >> self.shift).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions of the members in ``h``."""
        if not len(self.sorted):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        return at[self.sorted[near] == h[at]]


def _lookup(spark, tokens: DataFrame):
    """Broadcast of the distinct ``tokens(token)``: bounded by the block size."""
    t = tokens.toPandas()["token"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(np.sort(t.view(np.uint64)))


def _text_shingles(words: np.ndarray, lengths: list[int]):
    for k in lengths:
        if len(words) >= k:
            yield common.shingle_hashes(words, k)


def count_tokens(docs: DataFrame, wanted, lengths: list[int]) -> DataFrame:
    """``token, n``: occurrences of the wanted shingles in all documents."""

    def run(batches):
        look = Lookup(wanted.value)
        counts = np.zeros(len(look.sorted), np.int64)
        for batch in batches:
            for i, j, data, bounds in common.text_blocks(batch.column(0)):
                h, _, _, row = common.token_hashes(data, bounds, common.NOT_WORD)
                for k in lengths:
                    if len(h) < k:
                        continue
                    s = common.shingle_hashes(h, k)
                    s = s[row[: len(s)] == row[k - 1:]]
                    at = np.searchsorted(look.sorted, s[look.hits(s)])
                    np.add.at(counts, at, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(common.signed(look.sorted[at])), pa.array(counts[at])], ["token", "n"])

    return docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, wanted, lengths: list[int], size: int) -> DataFrame:
    """``id, t, n_words, found array<struct<token, at, pos, around>>`` per row of
    ``docs(id, t, text)``: its prefix tokens, their position, the words a window
    with that token can cover (``around``), and the token's place among them."""
    kind = pa.struct([("token", pa.int64()), ("at", pa.int32()), ("pos", pa.int64()), ("around", pa.list_(pa.int64()))])

    def run(batches):
        look = Lookup(wanted.value)
        for batch in batches:
            for i, j, data, bounds in common.text_blocks(batch.column(2)):
                h, _, _, row = common.token_hashes(data, bounds, common.NOT_WORD)
                cut = common.row_slices(row, j - i)
                tok, at, pos, around, hits = [], [], [], [], []
                for k in lengths:
                    if len(h) >= k:
                        s = common.shingle_hashes(h, k)
                        p = look.hits(s)
                        p = p[row[p] == row[p + k - 1]]
                        hits.append(np.stack([row[p], p, s[p].view(np.int64)], 1))
                hits = np.concatenate(hits) if hits else np.zeros((0, 3), np.int64)
                hits = hits[np.argsort(hits[:, 0], kind="stable")]
                per_row = np.bincount(hits[:, 0], minlength=j - i)
                for r, p, t in hits.tolist():
                    lo, hi = max(cut[r], p - size + 1), min(cut[r + 1], p + size)
                    tok.append(t)
                    at.append(p - lo)
                    pos.append(p - cut[r])
                    around.append(common.signed(h[lo:hi]))
                off = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
                inner = pa.StructArray.from_arrays(
                    [pa.array(tok, pa.int64()), pa.array(at, pa.int32()), pa.array(pos, pa.int64()),
                     common.list_array(around, pa.int64())], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                     pa.array(np.diff(cut).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(off), inner)], names=["id", "t", "n_words", "found"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, t long, n_words long, "
                                "found array<struct<token:long,at:int,pos:long,around:array<long>>>")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", size: int = SIZE, shingle: int = SHINGLE,
                  block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, n_hit, item_ids array<string>
    (sorted), contaminated``."""
    spark = docs.sparkSession
    common.prepare(spark)
    every = materialize(windows(items.select(F.col(item_col).cast("string"), item_text), size, shingle), "windows")
    total = every.select(F.coalesce(F.sum(F.size("shingles")), F.lit(0)), F.collect_set("m")).first()
    lengths = sorted({min(shingle, m) for m in total[1]})
    parts = -(-int(total[0]) // block) or 1
    # (id, hash of the text) names a row: equal rows have equal results
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"),
                       F.col(text_col).alias("text"))
    base, hits = None, None
    for part in range(parts):
        own = every if parts == 1 else every.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part)
        tokens = own.select(F.explode("shingles").alias("token")).distinct()
        counts = count_tokens(docs.select(text_col), _lookup(spark, tokens), lengths) if lengths else None
        if counts is None:
            prefixes = own.select(F.lit(0).cast("long").alias("token"), F.lit(0).alias("offset"), "item_id", "m", "words").limit(0)
        else:
            counts = materialize(counts, "rarity")
            placed = own.select("item_id", "m", "words", F.size("shingles").alias("of"),
                                F.posexplode("shingles").alias("offset", "token")).join(counts, "token")
            prefixes = (placed.groupBy("item_id", "m", "words", "of")
                        .agg(F.count("*").alias("present"), F.min(F.struct("n", "offset", "token")).alias("rarest"))
                        .where("present = of")
                        .select("rarest.token", "rarest.offset", "item_id", "m", "words"))
        prefixes = materialize(prefixes, "prefixes")
        wanted = _lookup(spark, prefixes.select("token").distinct())
        found = materialize(candidates(rows, wanted, lengths, size), "candidates")
        base = base or found.select("id", "t", "n_words")
        places = found.select("id", "t", "n_words", F.explode("found").alias("f")).select("id", "t", "n_words", "f.*")
        start = F.col("pos") - F.col("offset")
        here = F.slice("around", F.col("at") - F.col("offset") + 1, F.col("m"))
        met = (places.join(prefixes, "token")
               .where((start >= 0) & (start + F.col("m") <= F.col("n_words")) & (F.col("at") >= F.col("offset")))
               .where(here == F.col("words"))
               .select("id", "t", "item_id", start.alias("start"), "m"))
        hits = met if hits is None else hits.unionByName(met)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["m"] - 1))))
    marked = (hits.groupBy(F.col("id").alias("_id"), F.col("t").alias("_t"))
              .agg(F.collect_set(F.struct("start", "m")).alias("spans"),
                   F.array_sort(F.collect_set("item_id")).alias("item_ids"))
              .select("_id", "_t", F.size(covered).cast("long").alias("n_hit"), "item_ids"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (base.join(marked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
            .select("id", "n_words", n_hit.alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    (n_hit > 0).alias("contaminated")))
