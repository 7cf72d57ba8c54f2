r"""Substring dedup: repeated passages found by paragraph MinHash banding.

A paragraph is a content-defined run of words: a word ends a paragraph where
the hash of the pair it begins is the smallest within ``reach`` words on either
side (and after ``longest`` words at the latest).  So a passage is cut at the
same places wherever it stands, also in the middle of a line, and its inner
paragraphs are equal in every copy.

1. Paragraphs of equal words share a content id (64 bits): copies are one row
   of the near-duplicate search.
2. Contents of different words are banded by MinHash over their word shingles;
   ``tune_bands`` picks the fewest hashes (two a band at least) that collide a
   pair at the threshold with the wanted recall.  A paragraph with too few
   shingles to reach the threshold other than by equality needs no band.
3. Band keys and contents are dealt by ranges of the key, packed as sorted arrays:
   nearly every key has one content and ends there.  Every other content is paired
   with the first and the previous one of its key (linear in the bucket), verified by exact Jaccard
   similarity of the shingle sets, and clustered by connected components.  Where
   a bucket still holds several components, its members of different ones are
   all compared, block by block: so every colliding pair is either compared or
   in one component.
4. A component held by two documents is repeated; the smallest document id
   keeps it.  Consecutive repeated paragraphs of a document form a passage (a
   gap of up to ``gap`` paragraphs, an edit, does not end it) as long as another
   document takes the same step from one to the next: pieces of several documents
   that only one document strings together are passages each for itself.
5. The ends of a passage lie inside paragraphs that differ between documents.
   Where the paragraphs alone do not decide, the words before and after are
   compared with those around every paragraph of the same component: equal ones
   are one row, the rows are sorted, and the longest beginning shared with
   another document is that with the next row of another document on either
   side.  Passages of at least ``min_words`` words are returned.
6. A passage need not hold a whole paragraph.  Every run of ``min_words`` words
   has a fingerprint, the smallest hash of its runs of half as many words; runs
   with a fingerprint of two documents that no passage overlaps are looked up as
   a whole, and those that two documents hold make up further passages.

Counts are pre-aggregated before every shuffle; a very common paragraph is one
row per block of text before its key is dealt.  Small tables (their row counts
are checked) are broadcast; larger ones are plain equi-joins.

Defined cases: a null or empty text has no paragraphs; rows that share a
document id are one document; a null id is no document; repeated words make
paragraphs of ``longest`` words; an empty table gives no rows; extra columns do
not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.llm.minhash_dedup import dealt, key_groups
from covgrid.session import materialize

REACH = 5
LONGEST = 64
MIN_WORDS = 50
#: Unmatched paragraphs that do not end a passage.
GAP = 2
RECALL = 0.99
#: Members of a bucket that are compared in one task; a larger bucket is dealt.
BLOCK = 2048
#: Tables of at most this many rows (of few numbers) are broadcast.
BROADCAST_ROWS = 1 << 20
#: Ranges of band keys: all (key, content) pairs of one are held by a task at once.
PARTS = 4096
#: Pairs that a task holds before it sends them.
PACKED = 1 << 21


def tune_bands(similarity: float, recall: float, least_rows: int = 2, most_rows: int = 4) -> tuple[int, int]:
    """(bands, rows) with the fewest hashes that reach the recall at the similarity."""
    options = []
    for rows in range(least_rows, most_rows + 1):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-similarity ** rows)))
        options.append((bands * rows, bands, rows))
    _, bands, rows = min(options)
    return bands, rows


def paragraph_ends(h: np.ndarray, row: np.ndarray, rows: int, reach: int, longest: int) -> np.ndarray:
    """One past the last word of each paragraph; ``h`` and ``row`` are the words of
    a block, and words of other rows never matter."""
    n = len(h)
    pair = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    pair[:-1] = common.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    last = np.ones(n, bool)
    last[:-1] = row[1:] != row[:-1]
    pair[last] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = np.arange(n) + (row + 1) * reach  # with room between rows
    wide = np.full(n + (rows + 1) * reach + reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    wide[at] = pair
    end = ~last
    for d in range(1, reach + 1):
        end &= (pair < wide[at - d]) & (pair <= wide[at + d])
    end |= last
    cuts = np.flatnonzero(end) + 1
    # no paragraph is longer than `longest`: cut its rest in equal steps from its start
    starts = np.concatenate([[0], cuts[:-1]])
    over = np.flatnonzero(cuts - starts > longest)
    if len(over):
        more = [np.arange(starts[i] + longest, cuts[i], longest) for i in over]
        cuts = np.sort(np.concatenate([cuts, *more]))
    return cuts


def _block_words(data, bounds):
    h, starts, ends, row = common.token_hashes(data, bounds, common.WHITE)
    return {"h": h, "words": row, "starts": starts, "ends": ends} if len(h) else None


def _block_paragraphs(data, bounds, rows: int, k: int, bands: int, band_rows: int, seeds, reach, longest, near: bool):
    """Paragraphs of a block as arrays: row, first word, words, byte span, content
    and, with ``near``, band keys and shingles of those that can be near-duplicates."""
    words = _block_words(data, bounds)
    if words is None:
        return None
    h, row, starts, ends = words.values()
    cut = paragraph_ends(h, row, rows, reach, longest)
    first = np.concatenate([[0], cut[:-1]])
    up, down = common._powers(len(h) + 1)
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=prefix[1:])
    content = common.mix((prefix[cut] - prefix[first]) * down[first] + (cut - first).astype(np.uint64))
    out = words | {"first": first, "row": row[first], "n": cut - first, "lo": starts[first], "hi": ends[cut - 1], "content": content}
    if near:
        shingles = common.shingle_hashes(h, k) if len(h) >= k else np.zeros(0, np.uint64)
        out["some"] = np.flatnonzero(out["n"] - k + 1 >= near)
        a, b = first[out["some"]], cut[out["some"]] - k + 1
        keys = np.zeros((len(a), bands), np.uint64)
        if len(a):
            pairs = np.stack([a, b], 1).ravel()
            pairs = pairs[:-1] if pairs[-1] == len(shingles) else pairs
            for band in range(bands):
                v = np.full(len(a), band + 1, np.uint64)
                for j in range(band_rows):
                    m = np.minimum.reduceat(common.mix(shingles * seeds[band * band_rows + j]), pairs)[::2]
                    v = v * np.uint64(0x9E3779B97F4A7C15) + m
                keys[:, band] = common.mix(v)
        out |= {"keys": keys, "shingles": shingles, "span": (a, b)}
    return out


class Paragraphs:
    """The paragraph passes over a document table."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, similarity: float, recall: float,
                 reach: int, longest: int):
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
            "doc_id is not null")
        self.k, self.reach, self.longest = k, reach, longest
        self.bands, self.rows = tune_bands(similarity, recall)
        rng = np.random.default_rng(5)
        self.seeds = rng.integers(1, 1 << 62, self.bands * self.rows, dtype=np.uint64) | np.uint64(1)
        # distinct sets with s shared of s + 1 reach the threshold from this s on
        shared = 1
        while shared / (shared + 1) < similarity:
            shared += 1
        self.least = shared

    def _pass(self, emit, schema: str, near: bool, docs: DataFrame | None = None, bands: int = 0,
              gather=None, paragraphs: bool = True) -> DataFrame:
        k, rows, seeds, reach, longest = self.k, self.rows, self.seeds, self.reach, self.longest
        least = self.least if near else 0

        def run(batches):
            for batch in batches:
                for i, j, data, bounds in common.text_blocks(batch.column(1)):
                    p = (_block_paragraphs(data, bounds, j - i, k, bands, rows, seeds, reach, longest, least)
                         if paragraphs else _block_words(data, bounds))
                    if p is not None:  # further columns go to emit() as they are
                        yield emit(batch.column(0).slice(i, j - i), data, bounds, p,
                                   *[c.slice(i, j - i) for c in batch.columns[2:]])

        return (docs or self.docs).mapInArrow(lambda batches: gather(run(batches)) if gather else run(batches), schema)

    def spans(self, wanted: DataFrame) -> DataFrame:
        """``doc_id, t, no, start, stop, n_words, content``: paragraphs with their place
        in the text (code points); those of ``wanted(content)`` and few others."""
        bitmap = common.bitmap_of(wanted.select(F.shiftrightunsigned("content", 38).alias("p")), 1 << 26)

        def emit(ids, data, bounds, p):
            held = common.marked(bitmap.value, (p["content"] >> np.uint64(38)).astype(np.int64))
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            origin = chars[bounds[:-1]][p["row"]]
            begin = np.concatenate([[True], p["row"][1:] != p["row"][:-1]])
            no = np.arange(len(begin)) - np.maximum.accumulate(np.where(begin, np.arange(len(begin)), 0))
            text = [hash_bytes(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            row = p["row"][held]
            return pa.RecordBatch.from_arrays([
                ids.take(pa.array(row)), pa.array(np.array(text, np.int64)[row]), pa.array(no[held].astype(np.int32)),
                pa.array((chars[p["lo"]] - origin)[held]), pa.array((chars[p["hi"]] - origin)[held]),
                pa.array(p["n"][held].astype(np.int32)), pa.array(common.signed(p["content"][held]))],
                names=["doc_id", "t", "no", "start", "stop", "n_words", "content"])

        return self._pass(emit, "doc_id long, t long, no int, start long, stop long, n_words int, content long", False)

    def contexts(self, wanted: DataFrame) -> DataFrame:
        """``doc_id, t, no, content, before, after`` of the paragraphs ``wanted(doc_id,
        contents)``: 32-bit hashes of up to ``longest`` words before (nearest first) and after."""
        context = self.longest

        def emit(ids, data, bounds, p, asked):
            h = (p["h"] >> np.uint64(32)).astype(np.uint32)
            cut = np.searchsorted(p["words"], np.arange(len(bounds)))
            text = np.array([hash_bytes(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], np.int64)
            begin = np.concatenate([[True], p["row"][1:] != p["row"][:-1]])
            no = np.arange(len(begin)) - np.maximum.accumulate(np.where(begin, np.arange(len(begin)), 0))
            off, flat = np.asarray(asked.offsets), np.asarray(asked.values)
            content, start = common.signed(p["content"]), row_starts(p["row"], len(ids))
            at = np.concatenate([np.flatnonzero(np.isin(content[a:b], flat[x:y])) + a for a, b, x, y in
                                 zip(start, start[1:], off, off[1:])])
            row = p["row"][at]
            lo, hi, first = cut[row], cut[row + 1], p["first"][at]
            stop = first + p["n"][at]
            return pa.RecordBatch.from_arrays([
                ids.take(pa.array(row)), pa.array(text[row]), pa.array(no[at].astype(np.int32)), pa.array(content[at]),
                pa.array([h[max(a, f - context): f][::-1].tobytes() for a, f in zip(lo, first)], pa.binary()),
                pa.array([h[e: min(b, e + context)].tobytes() for b, e in zip(hi, stop)], pa.binary())],
                names=["doc_id", "t", "no", "content", "before", "after"])

        return self._pass(emit, "doc_id long, t long, no int, content long, before binary, after binary", False,
                          self.docs.join(hinted(wanted), "doc_id").select("doc_id", "text", "contents"))

    def fingerprints(self, min_words: int) -> DataFrame:
        """``doc_id, t, fp, inner_start, inner_stop``: one row per stretch of runs of
        ``min_words`` words that have one fingerprint, and the place that all of them
        overlap (empty if stop <= start)."""
        def emit(ids, data, bounds, p):
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            at, fp, _ = word_runs(p["h"], p["words"], min_words)
            row = p["words"][at]
            begin = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])])[: len(at)])
            end = np.concatenate([begin[1:], [len(at)]])[: len(begin)] - 1
            text = np.array([hash_bytes(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], np.int64)
            row = row[begin]
            origin = chars[bounds[:-1]][row]
            return pa.RecordBatch.from_arrays([
                ids.take(pa.array(row)), pa.array(text[row]), pa.array(common.signed(fp[begin])),
                pa.array(chars[p["starts"][at[end]]] - origin),
                pa.array(chars[p["ends"][at[begin] + min_words - 1]] - origin)],
                ["doc_id", "t", "fp", "inner_start", "inner_stop"])

        return self._pass(emit, "doc_id long, t long, fp long, inner_start long, inner_stop long", False,
                          paragraphs=False)

    def runs(self, wanted: DataFrame, min_words: int) -> DataFrame:
        """``doc_id, t, word, start, stop, run``: the runs of ``min_words`` words that have
        a fingerprint of ``wanted(doc_id, fps)``."""
        def emit(ids, data, bounds, p, asked):
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            at, fp, whole = word_runs(p["h"], p["words"], min_words)
            off, flat = np.asarray(asked.offsets), np.asarray(asked.values)
            fp, start = common.signed(fp), row_starts(p["words"][at], len(ids))
            keep = np.concatenate([np.flatnonzero(np.isin(fp[a:b], flat[x:y])) + a for a, b, x, y in
                                   zip(start, start[1:], off, off[1:])])
            text = np.array([hash_bytes(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], np.int64)
            at, whole = at[keep], whole[keep]
            row = p["words"][at]
            origin = chars[bounds[:-1]][row]
            return pa.RecordBatch.from_arrays([
                ids.take(pa.array(row)), pa.array(text[row]), pa.array(at - row_starts(p["words"], len(ids))[row]),
                pa.array(chars[p["starts"][at]] - origin), pa.array(chars[p["ends"][at + min_words - 1]] - origin),
                pa.array(common.signed(whole))], ["doc_id", "t", "word", "start", "stop", "run"])

        return self._pass(emit, "doc_id long, t long, word long, start long, stop long, run long", False,
                          self.docs.join(hinted(wanted), "doc_id").select("doc_id", "text", "fps"), paragraphs=False)

    def holders(self) -> DataFrame:
        """``doc_id, content``, each once per block."""
        def emit(ids, data, bounds, p):
            order = np.argsort(p["content"], kind="stable")  # the rows of one content ascend
            row, content = p["row"][order], p["content"][order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (content[1:] != content[:-1])])
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row[new])), pa.array(common.signed(content[new]))],
                                              ["doc_id", "content"])

        return self._pass(emit, "doc_id long, content long", False)

    def keys(self) -> DataFrame:
        """``part, pairs``: see ``packed``."""
        def emit(ids, data, bounds, p):
            content, at = np.unique(p["content"][p["some"]], return_index=True)
            return p["keys"][at], content

        return self._pass(emit, PACKED_ROWS, True, bands=self.bands, gather=packed)

    def sets(self) -> DataFrame:
        """``content, shingles``, contents once per block."""
        def emit(ids, data, bounds, p):
            content, at = np.unique(p["content"][p["some"]], return_index=True)
            lo, n = p["span"][0][at], (p["span"][1] - p["span"][0])[at]  # the shingles of each, one after the other
            off = np.concatenate([[0], np.cumsum(n)])
            flat = p["shingles"][np.arange(off[-1]) + np.repeat(lo - off[:-1], n)]
            return pa.RecordBatch.from_arrays([
                pa.array(common.signed(content)),
                pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(common.signed(flat)))],
                ["content", "shingles"])

        return self._pass(emit, "content long, shingles array<long>", True)


def word_runs(h: np.ndarray, row: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, fingerprint and hash of every run of ``min_words`` words of one row;
    the fingerprint is the smallest hash of the runs of half as many words in it."""
    n, part = len(h), (min_words + 1) // 2
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = common._powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=prefix[1:])
    least = common.mix((prefix[part:] - prefix[:-part]) * down[: n - part + 1])
    width, whole = 1, min_words - part + 1
    while width < whole:  # the smallest of `width` neighbours
        step = min(width, whole - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    at = np.flatnonzero(row[: n - min_words + 1] == row[min_words - 1:])
    run = common.mix((prefix[min_words:] - prefix[:-min_words]) * down[: n - min_words + 1] + np.uint64(min_words))
    return at, least[at], run[at]


def row_starts(row: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(rows + 1))


def hash_bytes(data: np.ndarray) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), "little", signed=True)


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if common.bounded(df, limit) else df


PACKED_ROWS = "part int, pairs binary"


def packed(found):
    """``part, pairs``: band keys and contents, from arrays of the keys (one row per
    content) and of the contents, as pairs sorted by key and cut at ranges of the key."""
    def flush():
        key = np.concatenate([k.ravel() for k, _ in held])
        content = np.concatenate([np.repeat(c, k.shape[1]) for k, c in held])
        order = np.argsort(key)
        pairs = np.stack([key[order], content[order]], 1)
        part = (pairs[:, 0] >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(
            [pairs[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(pairs)])], pa.binary())], ["part", "pairs"])

    held, size = [], 0
    for keys, content in found:
        held.append((keys, content))
        size += keys.size
        if size > PACKED:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def packed_rows(batches):
    """``packed`` of rows ``keys array<long>, content``."""
    def found():
        for batch in batches:
            content = np.asarray(batch.column(1)).view(np.uint64)
            if len(content):
                yield np.asarray(batch.column(0).flatten()).view(np.uint64).reshape(len(content), -1), content

    return packed(found())


def _neighbours(batches):
    """``key, a, b, star``: pairs of contents that share a key, from packed rows sorted by
    part: each with the first (``star``) and the previous one of its key."""
    for group in key_groups(batches, 1):
        pairs = np.frombuffer(b"".join(group.column("pairs").to_pylist()), np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0])
        key = pairs[order, 0]
        same = key[1:] == key[:-1]
        some = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # of keys met more than once
        order = some[np.lexsort((pairs[some, 1], pairs[some, 0]))]
        if not len(order):
            continue
        key, content = pairs[order, 0], pairs[order, 1]
        begin = np.concatenate([[True], key[1:] != key[:-1]])
        first = content[np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))]
        previous = np.concatenate([content[:1], content[:-1]])
        new = ~begin & (previous != content)
        star, chain = new & (first != content), new & (previous != first)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([key[star], key[chain]])), pa.array(np.concatenate([first[star], previous[chain]])),
            pa.array(np.concatenate([content[star], content[chain]])),
            pa.array(np.repeat([True, False], [star.sum(), chain.sum()]))], ["key", "a", "b", "star"])


def linked(off: np.ndarray, flat: np.ndarray, label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the labels: every two members of different labels are compared
    unless earlier links have joined them.  Member i has the distinct shingles
    ``flat[off[i]:off[i + 1]]``."""
    n, size = len(label), np.diff(off)
    shingle = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(shingle, kind="stable")
    member = np.repeat(np.arange(n), size)[order]
    post = np.searchsorted(shingle[order], np.arange(shingle.max(initial=-1) + 2))
    label = np.unique(label, return_inverse=True)[1]
    out = []
    for i in range(n - 1):
        mine = shingle[off[i]: off[i + 1]]
        if len(mine):
            both = np.bincount(np.concatenate([member[post[x]: post[x + 1]] for x in mine]), minlength=n)
            met = (both >= similarity * (size + size[i] - both)) & (label != label[i])
            met[:i] = False
            rows = np.flatnonzero(met)
            if len(rows):
                names, at = np.unique(label[rows], return_index=True)
                out += [(i, int(r)) for r in rows[at]]
                label[np.isin(label, names)] = label[i]
    return out


def near_contents(p: Paragraphs, similarity: float, block: int = BLOCK) -> DataFrame:
    """``id, component`` of the contents that are near-duplicates of another one."""
    rows = p.keys()
    if "pairs" not in rows.columns:  # keys array<long>, content
        rows = rows.mapInArrow(packed_rows, PACKED_ROWS)
    met = materialize(rows.repartition("part").sortWithinPartitions("part")
                      .mapInArrow(_neighbours, "key long, a long, b long, star boolean"), "met")
    pairs = materialize(met.select("a", "b").distinct(), "pairs")
    wanted = materialize(pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct(), "wanted")
    sets = p.sets().join(hinted(wanted), "content", "left_semi").dropDuplicates(["content"])
    sets = materialize(sets.select("content", F.array_distinct("shingles").alias("shingles")), "near-sets")
    joined = (pairs.join(sets.select(F.col("content").alias("a"), F.col("shingles").alias("sa")), "a")
              .join(sets.select(F.col("content").alias("b"), F.col("shingles").alias("sb")), "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = materialize(joined.where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
    labels = common.components(links)

    # buckets that still hold several components; of up to three members all pairs have been compared
    large = met.where("star").groupBy("key").agg(F.count("*").alias("others")).where("others >= 3")
    large = materialize(large, "buckets")
    star = met.where("star").join(large.select("key"), "key", "left_semi")
    members = star.select("key", F.col("b").alias("id")).union(star.select("key", F.col("a")).distinct())
    named = (members.join(hinted(labels), "id", "left")
             .select("key", "id", F.coalesce("component", "id").alias("label")))
    named = materialize(named, "members")
    mixed = (named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
             .where("lo < hi").select("key", "size"))
    open_rows = (dealt(named, materialize(mixed, "mixed"), block)
                 .join(sets.withColumnRenamed("content", "id"), "id").select("key", "part", "id", "label", "shingles"))

    def compare(batches):
        for group in key_groups(batches, 2):
            ids, lists = np.asarray(group.column("id")), group.column("shingles").combine_chunks()
            off = np.concatenate([[0], np.cumsum(lists.value_lengths())])
            found = np.array(linked(off, np.asarray(lists.flatten()), np.asarray(group.column("label")), similarity),
                             np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], ["a", "b"])

    more = materialize(open_rows.repartition("key", "part").sortWithinPartitions("key", "part", "id")
                       .mapInArrow(compare, "a long, b long"), "links")
    return labels if more.isEmpty() else common.components(links.union(more))


def common_steps(found: DataFrame, gap: int) -> DataFrame:
    """``before, component_id, common`` (true): the steps from a repeated paragraph to one of
    the next ``gap + 1`` that two documents take.  Paragraphs that stand together in
    one document only, as pieces of several others do, are no passage."""
    order = Window.partitionBy("doc_id", "t").orderBy("no")
    after = F.array(*[F.struct(F.lead("no", k).over(order).alias("no"), F.lead("component_id", k).over(order).alias("c"))
                      for k in range(1, gap + 2)])
    steps = (found.select("doc_id", "no", F.col("component_id").alias("before"), after.alias("after"))
             .select("doc_id", "no", "before", F.explode("after").alias("to")).where(F.col("to.no") - F.col("no") <= gap + 1))
    return (steps.groupBy("before", F.col("to.c").alias("component_id"))
            .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
            .select("before", "component_id", F.lit(True).alias("common")))


def _longest_shared(batches):
    """``component_id, side, h, more``: the longest beginning that each sequence of words
    shares with one of another document, from distinct rows ``g, words, lo, hi, ...``
    sorted by group and words.  The longest is that with the next sequence of another
    document on either side; only consecutive ones of one document are held."""
    last_g = last_words = last_doc = None
    back, run = 0, []  # of the run of one document: [step, shared, keys]

    def finish(step):
        for row in reversed(run):
            row[1] = max(row[1], step)
            step = min(step, row[0])
        out = [(*row[2], row[1]) for row in run if row[1]]
        run.clear()
        return out

    for batch in batches:
        g, lo, hi = (np.asarray(batch.column(i)) for i in (0, 2, 3))
        side, component, h = (batch.column(i).to_pylist() for i in (4, 5, 6))
        out = []
        for i, words in enumerate(batch.column(1).to_pylist()):
            x = np.frombuffer(words, np.uint32)
            several = lo[i] < hi[i]
            if last_g is None or g[i] != last_g:
                out += finish(0)
                step = back = 0
            else:
                m = min(len(x), len(last_words))
                other = np.flatnonzero(x[:m] != last_words[:m])
                step = int(other[0]) if len(other) else m
                if several or last_doc is None or lo[i] != last_doc:
                    out += finish(step)
                    back = step
                else:
                    back = min(back, step)
            run.append([step, len(x) if several else back, (component[i], side[i], h[i])])
            last_g, last_words, last_doc = g[i], x, None if several else lo[i]
        yield _shared_rows(out)
    yield _shared_rows(finish(0))


def _shared_rows(rows):
    component, side, h, more = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(component, pa.int64()), pa.array(side, pa.string()), pa.array(h, pa.int64()),
                                       pa.array(more, pa.int64())], ["component_id", "side", "h", "more"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                      similarity: float = 0.8, recall: float = RECALL, min_words: int = MIN_WORDS, gap: int = GAP,
                      reach: int = REACH, longest: int = LONGEST) -> DataFrame:
    """One row per repeated passage: ``doc_id, t`` (hash of the text, for rows that
    share an id), ``start, stop`` (code points, whole paragraphs), ``n_words``
    (with the words shared at both ends), ``n_paragraphs, component_id,
    first_doc`` (the smallest document id holding one of its paragraphs) and
    ``removed`` (another document keeps them)."""
    common.prepare(docs.sparkSession)
    p = Paragraphs(docs, id_col, text_col, k, similarity, recall, reach, longest)
    labels = near_contents(p, similarity).select(F.col("id").alias("content"), "component")
    held = p.holders().groupBy("content").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    held = (held.join(hinted(labels), "content", "left").where("lo < hi or component is not null")
            .select("content", F.coalesce("component", "content").alias("component_id"), "lo", "hi"))
    held = materialize(held, "held")
    repeated = (held.groupBy("component_id").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("last"))
                .where("first_doc < last").drop("last"))
    repeated = materialize(held.join(repeated, "component_id"), "repeated")
    found = materialize(p.spans(repeated).join(repeated.drop("lo", "hi"), "content")
                        .withColumn("removed", F.col("first_doc") < F.col("doc_id")), "found")
    run = Window.partitionBy("doc_id", "t", "removed").orderBy("no")
    follows = found.withColumn("before", F.when(F.col("no") - F.lag("no").over(run) <= gap + 1,
                                                F.lag("component_id").over(run)))
    follows = follows.join(common_steps(found, gap), ["before", "component_id"], "left")
    step = F.when(F.col("common"), 0).otherwise(1)
    islands = follows.withColumn("step", step).withColumn("island", F.sum("step").over(run))
    edge = F.struct("no", F.col("component_id").alias("near"))
    passages = (islands.groupBy("doc_id", "t", "removed", "island")
                .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").alias("covered"),
                     F.count("*").alias("n_paragraphs"), F.min("component_id").alias("component_id"),
                     F.min("first_doc").alias("first_doc"), F.min(edge).alias("first"), F.max(edge).alias("last"))
                .drop("island")
                .withColumn("passage", F.xxhash64("doc_id", "t", "removed", "start")))
    passages = materialize(passages, "passages")
    # the ends of passages that the whole paragraphs leave undecided
    short = passages.where(F.col("covered") < min_words)
    ends = (short.select("passage", "doc_id", "t", F.lit("before").alias("side"), "first.*")
            .union(short.select("passage", "doc_id", "t", F.lit("after"), "last.*")))
    near = found.join(hinted(materialize(ends.select(F.col("near").alias("component_id")).distinct(), "edges")),
                      "component_id", "left_semi")
    wanted = near.groupBy("doc_id").agg(F.collect_set("content").alias("contents"))
    around = (p.contexts(materialize(wanted, "wanted")).dropDuplicates(["doc_id", "t", "no"])
              .join(hinted(repeated.select("content", "component_id")), "content")
              .select("doc_id", "t", "no", "component_id", F.explode(F.create_map(
                  F.lit("before"), "before", F.lit("after"), "after")).alias("side", "words"))
              .where("length(words) > 0").withColumn("h", F.xxhash64("words")))
    around = materialize(around, "contexts")
    # equal words are one row, and words that begin alike meet
    words = (around.groupBy("component_id", "side", "h", "words").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
             .select(F.xxhash64("component_id", "side", F.substring("words", 1, 4)).alias("g"), "words", "lo", "hi", "side",
                     "component_id", "h"))
    shared = (words.repartition("g").sortWithinPartitions("g", "words")
              .mapInArrow(_longest_shared, "component_id long, side string, h long, more long"))
    more = (ends.join(around.drop("words", "component_id"), ["doc_id", "t", "no", "side"])
            .withColumnRenamed("near", "component_id").join(shared, ["component_id", "side", "h"])
            .groupBy("passage").agg(F.sum("more").alias("more")))
    n_words = F.col("covered") + F.coalesce("more", F.lit(0))
    passages = (passages.join(more, "passage", "left").withColumn("n_words", n_words).where(n_words >= min_words)
                .select("doc_id", "t", "start", "stop", "n_words", "n_paragraphs", "component_id", "first_doc", "removed"))
    passages = materialize(passages, "passages")
    return passages.unionByName(further_passages(p, passages, min_words))


def further_passages(p: Paragraphs, passages: DataFrame, min_words: int) -> DataFrame:
    """Passages made up of runs of ``min_words`` words that two documents hold and that
    none of ``passages`` overlaps; columns as there, ``n_paragraphs`` = 0."""
    spans = materialize(passages.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")

    def apart(df, start, stop):  # the rows that no passage overlaps
        return (df.join(spans, ["doc_id", "t"], "left")
                .where(~F.coalesce(F.exists("spans", lambda s: (s["start"] < F.col(stop)) & (s["stop"] > F.col(start))),
                                   F.lit(False))).drop("spans"))

    prints = materialize(p.fingerprints(min_words), "fingerprints")
    shared = prints.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("fp")
    shared = materialize(prints.join(hinted(materialize(shared, "shared")), "fp", "left_semi"), "shared")
    # a passage overlaps all runs of a fingerprint if it overlaps their common place
    inner = F.col("inner_start") < F.col("inner_stop")
    left = apart(shared.where(inner), "inner_start", "inner_stop").select("fp").union(shared.where(~inner).select("fp"))
    wanted = (shared.join(hinted(materialize(left.distinct(), "left")), "fp", "left_semi")
              .groupBy("doc_id").agg(F.collect_set("fp").alias("fps")))
    runs = materialize(p.runs(materialize(wanted, "wanted"), min_words), "runs")
    held = runs.groupBy("run").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("first_doc < last")
    found = (apart(runs, "start", "stop").dropDuplicates(["doc_id", "t", "word"]).join(held.drop("last"), "run")
             .withColumn("removed", F.col("first_doc") < F.col("doc_id")))
    order = Window.partitionBy("doc_id", "t", "removed").orderBy("word")
    step = F.when(F.col("word") - F.lag("word").over(order) < min_words, 0).otherwise(1)
    return (found.withColumn("step", step).withColumn("island", F.sum("step").over(order))
            .groupBy("doc_id", "t", "removed", "island")
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop"),
                 (F.max("word") - F.min("word") + min_words).alias("n_words"), F.lit(0).cast("long").alias("n_paragraphs"),
                 F.min("run").alias("component_id"), F.min("first_doc").alias("first_doc"))
            .drop("island"))


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed passages cut out of the text."""
    spans = (passages.where("removed").groupBy(F.col("doc_id").alias("_d"))
             .agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_spans")))
    text = F.col("_text")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["stop"]))
    starts = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(edges.alias("a"), starts.alias("b")),
                                    lambda z: F.substring(text, z["a"].cast("int") + 1, (z["b"] - z["a"]).cast("int"))), "")
    joined = common.packed(docs, _id=F.col(id_col).cast("long"), _text=F.col(text_col)).join(
        spans, F.col("_id") == F.col("_d"), "left")
    return common.unpacked(joined, docs.columns, **{text_col: F.when(F.col("_spans").isNull(), text).otherwise(kept)}
                           ).select(*[f"`{c}`" for c in docs.columns])
